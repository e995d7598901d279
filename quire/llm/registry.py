"""Queries of this package and their SQL."""

from __future__ import annotations

from .alignment import op12_cross_tokenizer_alignment
from .bpe import op4_bpe_encode_decode
from .language_crf import op11_language_id
from .licenses import op6_license_scan
from .mixing import OP7_SQL, op7_source_mix
from .multi_index import op8_embedding_near_dedup
from .ngram_join import op1_ngram_jaccard_join
from .perspectives import op3_perspective_rotation
from .phrases import OP13_SQL, op13_phrase_mining
from .quality import op10_quality_rules
from .templates import op5_html_extraction
from .toxicity import op2_toxicity
from .urls import op9_url_filters

QUERIES = {q.__name__: q for q in (
    op1_ngram_jaccard_join,
    op2_toxicity,
    op3_perspective_rotation,
    op4_bpe_encode_decode,
    op5_html_extraction,
    op6_license_scan,
    op7_source_mix,
    op8_embedding_near_dedup,
    op9_url_filters,
    op10_quality_rules,
    op11_language_id,
    op12_cross_tokenizer_alignment,
    op13_phrase_mining,
)}

ORACLE = {"op7_source_mix": OP7_SQL, "op13_phrase_mining": OP13_SQL}
