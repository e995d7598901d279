"""Translation jobs: chunking, distinct chunks, memory lookup, glossary,
reassembly, corrections.

The reference sends every 500-character chunk to an online service, one
call at a time, and translates link text twice.  Here each distinct
(language, chunk) is translated once: chunks are hashed, deduplicated with
a partial (map-side) aggregate, looked up in a translation memory keyed by
hash, and only the unknown ones reach the translator.  The default
translator is a glossary applied natively (explode -> broadcast join ->
ordered re-join per chunk); any other translator is a pandas function run
with ``mapInPandas`` on the unknown chunks only.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import CHUNK_SIZE, chunk_hash
from ..session import materialize
from .skew import HOT_ROWS, split_hot_join

# --- fixed values -----------------------------------------------------------
TARGET_LANG = "en"
# Glossary rows (lang, source word, English word, priority).  Priority 0 is
# the dictionary; a user row (priority 1) overrides it.  Source words are
# matched on the lower-cased, space-separated token.
GLOSSARY_ROWS = (
    ("fr", "de", "of", 0), ("fr", "la", "the", 0), ("fr", "le", "the", 0),
    ("fr", "et", "and", 0), ("fr", "les", "the", 0), ("fr", "des", "some", 0),
    ("fr", "en", "in", 0), ("fr", "un", "a", 0), ("fr", "une", "a", 0),
    ("fr", "du", "of the", 0), ("fr", "que", "that", 0), ("fr", "est", "is", 0),
    ("fr", "pour", "for", 0), ("fr", "qui", "who", 0), ("fr", "dans", "in", 0),
    ("fr", "par", "by", 0), ("fr", "pas", "not", 0), ("fr", "au", "to the", 0),
    ("fr", "sur", "on", 0), ("fr", "avec", "with", 0), ("fr", "elle", "she", 0),
    ("fr", "de", "from", 1),
    ("de", "der", "the", 0), ("de", "die", "the", 0), ("de", "und", "and", 0),
    ("de", "in", "in", 0), ("de", "den", "the", 0), ("de", "von", "of", 0),
    ("de", "zu", "to", 0), ("de", "das", "the", 0), ("de", "mit", "with", 0),
    ("de", "auf", "on", 0), ("de", "sich", "itself", 0), ("de", "des", "of the", 0),
    ("de", "für", "for", 0), ("de", "ist", "is", 0), ("de", "im", "in the", 0),
    ("de", "dem", "the", 0), ("de", "nicht", "not", 0), ("de", "ein", "a", 0),
    ("de", "eine", "a", 0), ("de", "als", "as", 0),
    ("de", "sich", "oneself", 1),
    ("es", "de", "of", 0), ("es", "la", "the", 0), ("es", "que", "that", 0),
    ("es", "el", "the", 0), ("es", "en", "in", 0), ("es", "y", "and", 0),
    ("es", "los", "the", 0), ("es", "se", "itself", 0), ("es", "del", "of the", 0),
    ("es", "las", "the", 0), ("es", "por", "by", 0), ("es", "un", "a", 0),
    ("es", "no", "not", 0), ("es", "con", "with", 0), ("es", "una", "a", 0),
    ("es", "su", "its", 0), ("es", "es", "is", 0), ("es", "para", "for", 0),
    ("es", "al", "to the", 0),
    ("es", "se", "oneself", 1),
)
# Largest glossary (rows) that is broadcast; beyond it the join shuffles.
BROADCAST_MAX_ROWS = 2_000_000
# Largest glossary (entries) used as an in-expression map literal.
MAP_MAX_ROWS = 10_000
# Separator of (lang, word) in map keys; never inside a language code.
_SEP = "\x01"
# ---------------------------------------------------------------------------

GLOSSARY_SCHEMA = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("src", T.StringType()),
    T.StructField("dst", T.StringType()), T.StructField("priority", T.IntegerType())])


def glossary_frame(spark: SparkSession, rows=GLOSSARY_ROWS) -> DataFrame:
    rows = list(rows)
    df = spark.createDataFrame(rows, GLOSSARY_SCHEMA)
    df.literal_rows = len(rows)  # size known on the driver: no count job needed
    return df


def resolve_glossary(glossary: DataFrame) -> DataFrame:
    """One entry per (lang, src): highest priority wins, then greatest dst."""
    return (glossary.groupBy("lang", "src")
                    .agg(F.max(F.struct("priority", "dst")).alias("best"))
                    .select("lang", "src", F.col("best.dst").alias("dst")))


def sized_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, known_rows: int | None = None) -> DataFrame:
    """Broadcast only when the row count is within the bound (counted,
    unless the caller already knows it, e.g. a literal table)."""
    n = known_rows if known_rows is not None else df.count()
    return F.broadcast(df) if n <= max_rows else df


def chunk_array(text_col: str = "text", size: int = CHUNK_SIZE) -> Column:
    # consecutive greedy matches of 1..size code points: one linear regex pass
    return F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def chunk_texts(df: DataFrame, key_cols, text_col: str = "text", size: int = CHUNK_SIZE) -> DataFrame:
    """(keys..., chunk_no, chunk); empty or NULL text gives no chunk."""
    keys = list(key_cols)
    return (df.select(*keys, F.posexplode(chunk_array(text_col, size)).alias("chunk_no", "chunk"))
              .select(*keys, F.col("chunk_no").cast("long").alias("chunk_no"), "chunk"))


def distinct_chunks(chunks: DataFrame, lang_col: str = "src_lang") -> DataFrame:
    """E5: one row per (src_lang, chunk_hash), with the number of uses.
    A partial aggregate runs before the shuffle, so a chunk repeated across
    a third of the corpus is collapsed map-side."""
    # the text is a grouping key (hash <-> text is one-to-one), not an
    # aggregated value: the aggregate stays hash-based (a string buffer
    # would force a sort-based one)
    return (chunks.withColumn("chunk_hash", chunk_hash("chunk"))
                  .groupBy(F.col(lang_col).alias("src_lang"), "chunk_hash", F.col("chunk").alias("source_text"))
                  .agg(F.count(F.lit(1)).alias("n_uses")))


def glossary_translate(texts: DataFrame, glossary: DataFrame, key_cols,
                       text_col: str = "source_text", lang_col: str = "src_lang",
                       out_col: str = "translated_text") -> DataFrame:
    """Word-level glossary translation of short texts (chunks).

    Tokens are split on ' ' (empty tokens kept, so untouched text comes back
    byte for byte), looked up on (lang, lower(token)) and re-joined in order.

    A glossary within ``MAP_MAX_ROWS`` entries (counted, or known for a
    literal) becomes a map literal looked up inside ``transform``: a narrow
    projection, no explode, join or shuffle.  A larger one is joined to the
    exploded tokens (broadcast when within ``BROADCAST_MAX_ROWS``) and the
    tokens re-joined per text; each group is one chunk, so it is bounded."""
    keys = list(key_cols)
    resolved = resolve_glossary(glossary)
    known = getattr(glossary, "literal_rows", None)
    n = known if known is not None else resolved.count()
    if n <= MAP_MAX_ROWS:
        entries = resolved.collect()  # at most MAP_MAX_ROWS rows: checked above
        lang = F.col(lang_col)
        if entries:
            gmap = F.map_from_arrays(F.lit([f"{r['lang']}{_SEP}{r['src']}" for r in entries]),
                                     F.lit([r["dst"] for r in entries]))
            word = lambda w: F.coalesce(F.try_element_at(gmap, F.concat(lang, F.lit(_SEP), F.lower(w))), w)
            out = F.array_join(F.transform(F.split(F.col(text_col), " ", -1), word), " ")
        else:
            out = F.col(text_col)
        return texts.select(*keys, out.alias(out_col))
    g = sized_broadcast(resolved, known_rows=n)
    toks = texts.select(*keys, F.col(lang_col).alias("_lang"),
                        F.posexplode(F.split(F.col(text_col), " ", -1)).alias("_tpos", "_tok"))
    j = toks.join(g, (toks["_lang"] == g["lang"]) & (F.lower(toks["_tok"]) == g["src"]), "left")
    return (j.groupBy(*keys)
             .agg(F.sort_array(F.collect_list(F.struct("_tpos", F.coalesce("dst", "_tok").alias("w"))))
                  .alias("_ws"))
             .select(*keys, F.array_join(F.transform("_ws", lambda x: x["w"]), " ").alias(out_col)))


def lookup_translations(chunks: DataFrame, memory: DataFrame, lang_col: str = "src_lang",
                        hot: DataFrame | None = None) -> DataFrame:
    """D3: chunks left-joined with the memory on (src_lang, chunk_hash).
    No translation and a non-empty source -> the source is kept; an empty
    translation stays empty (it is dropped when chunks are re-joined)."""
    c = chunks.withColumn("chunk_hash", chunk_hash("chunk")).withColumnRenamed(lang_col, "src_lang")
    m = memory.select("src_lang", "chunk_hash", "translated_text")
    # a boilerplate chunk repeated across the corpus is one hot key
    j = split_hot_join(c, m, ["src_lang", "chunk_hash"], "left", hot=hot)
    return j.withColumn(
        "translated",
        F.when(F.col("translated_text").isNull() & (F.length("chunk") > 0), F.col("chunk"))
         .otherwise(F.col("translated_text"))).drop("translated_text")


def reassemble(chunks: DataFrame, key_cols, text_col: str = "translated", out_col: str = "text") -> DataFrame:
    """Chunks re-joined in order with one space, empty ones dropped;
    nothing left -> NULL.  One group is one source text."""
    keys = list(key_cols)
    kept = chunks.where(F.col(text_col).isNotNull() & (F.col(text_col) != ""))
    return (kept.groupBy(*keys)
                .agg(F.sort_array(F.collect_list(F.struct("chunk_no", F.col(text_col).alias("t")))).alias("_cs"))
                .select(*keys, F.nullif(F.array_join(F.transform("_cs", lambda x: x["t"]), " "), F.lit(""))
                        .alias(out_col)))


def reassemble_paragraphs(chunks: DataFrame, key_cols, para_col: str, text_col: str = "translated", out_col: str = "paragraphs") -> DataFrame:
    """E1 on two levels: chunks joined to paragraphs, paragraphs collected in
    order, per key an array of (para, text); empty paragraphs dropped.  One
    exchange on the outer key serves both levels; a group is one source row."""
    keys = list(key_cols)
    kept = (chunks.where(F.col(text_col).isNotNull() & (F.col(text_col) != ""))
                  .select(*keys, para_col, "chunk_no", F.col(text_col).alias("t")).repartition(*[F.col(k) for k in keys]))
    return (reassemble(kept, [*keys, para_col], "t", "text").groupBy(*keys)
                .agg(F.sort_array(F.collect_list(F.struct(F.col(para_col).alias("para"), "text"))).alias(out_col)))


def pandas_translator(unknown: DataFrame, fn: Callable[[pd.Series, str], pd.Series]) -> DataFrame:
    """Run a batch translator on (src_lang, chunk_hash, source_text) rows with
    mapInPandas; rows go in Arrow batches, one call per language per batch."""
    def run(batches):
        for pdf in batches:
            out = []
            for lang, part in pdf.groupby("src_lang", sort=False, dropna=False):
                lang = None if pd.isna(lang) else lang
                res = fn(part["source_text"], lang)
                out.append(pd.DataFrame({"src_lang": lang, "chunk_hash": part["chunk_hash"].values,
                                         "translated_text": pd.Series(res).values}))
            if out:
                yield pd.concat(out, ignore_index=True)
    return unknown.mapInPandas(run, "src_lang string, chunk_hash string, translated_text string")


def translate_texts(texts: DataFrame, key_cols, glossary: DataFrame | None = None,
                    memory: DataFrame | None = None, translator=None,
                    text_col: str = "text", lang_col: str = "src_lang",
                    target: str = TARGET_LANG, para_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Texts -> chunks -> distinct -> minus memory -> translate -> union
    memory -> lookup -> reassemble.  Returns (translations, new memory rows).
    With ``para_col`` the texts of a key are paragraphs numbered by it: each is
    chunked by itself and the result has one row per key, ``paragraphs`` an
    array of (para, text).

    Text already in the target language skips the translator (filter placed
    before the expensive call by hand: Catalyst cannot move it past Python)."""
    keys = list(key_cols)
    spark = texts.sparkSession
    # an unknown language is translated too: it joins as '' and reaches the
    # translator as NULL
    known_lang = lambda df: df.withColumn("src_lang", F.coalesce("src_lang", F.lit("")))
    null_lang = lambda df: df.withColumn("src_lang", F.nullif(F.col("src_lang"), F.lit("")))
    kept = keys + [para_col] if para_col else keys
    chunks = chunk_texts(known_lang(texts.withColumnRenamed(lang_col, "src_lang")), kept + ["src_lang"], text_col)
    if memory is not None:
        memory = known_lang(memory.select("src_lang", "chunk_hash", "translated_text"))
    # one distinct-chunk table (written once) gives both the translator's
    # input and the hot keys of the lookup join (from n_uses, no extra pass)
    dist = materialize(distinct_chunks(chunks), "distinct-chunks")
    hot = dist.where(F.col("n_uses") > HOT_ROWS).select("src_lang", "chunk_hash")
    todo = dist.where(F.col("src_lang") != target)
    if memory is not None:
        todo = todo.join(memory.select("src_lang", "chunk_hash"), ["src_lang", "chunk_hash"], "left_anti")
    if translator is None:
        g = glossary if glossary is not None else glossary_frame(spark)
        fresh = glossary_translate(todo, g, ["src_lang", "chunk_hash"])
    else:
        fresh = known_lang(pandas_translator(null_lang(todo.select("src_lang", "chunk_hash", "source_text")), translator))
    # every distinct chunk with its translation (its own text where there is
    # none), so an occurrence travels as a hash and never as text
    if memory is None and translator is None:
        kept_text = dist.where(F.col("src_lang") == target).select("src_lang", "chunk_hash", F.col("source_text").alias("translated_text"))
        full = fresh.unionByName(kept_text)
    else:
        known = fresh if memory is None else memory.unionByName(fresh)
        full = (dist.select("src_lang", "chunk_hash", "source_text").join(known, ["src_lang", "chunk_hash"], "left")
                    .select("src_lang", "chunk_hash", F.coalesce("translated_text", "source_text").alias("translated_text")))
    uses = chunks.select(*kept, "src_lang", "chunk_no", chunk_hash("chunk").alias("chunk_hash"))
    looked = split_hot_join(uses, full.withColumnRenamed("translated_text", "translated"), ["src_lang", "chunk_hash"], "left", hot=hot)
    if para_col:
        return reassemble_paragraphs(looked, keys, para_col), null_lang(fresh)
    return reassemble(looked, keys, "translated", "translated_text"), null_lang(fresh)


def as_is(text_col: str = "text") -> Column:
    """What translation makes of a text in the target language: its chunks
    joined again, NULL if there is none."""
    return F.nullif(F.array_join(chunk_array(text_col), " "), F.lit(""))


def translate_rows(df: DataFrame, key_cols, text_col: str = "text", lang_col: str = "src_lang", target: str = TARGET_LANG, **how) -> DataFrame:
    """J2 for a table of texts: (keys..., translated_text), a row for each row
    of ``df``.  Rows in the target language are answered where they lie: only
    the others are chunked, looked up and shuffled (a memory's rows in the
    target language are not looked at).  ``how`` goes to ``translate_texts``."""
    keys = list(key_cols)
    home = F.coalesce(F.col(lang_col) == target, F.lit(False))
    away = df.where(~home)
    tr, _ = translate_texts(away, keys, text_col=text_col, lang_col=lang_col, target=target, **how)
    done = away.select(*keys).join(tr, keys, "left")
    return df.where(home).select(*keys, as_is(text_col).alias("translated_text")).unionByName(done)


def apply_corrections(memory: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrections left-joined to the memory; per key the correction with
    the highest priority wins (then the greatest text)."""
    best = (corrections.groupBy("src_lang", "chunk_hash")
                       .agg(F.max(F.struct("priority", "translated_text")).alias("b"))
                       .select("src_lang", "chunk_hash", F.col("b.translated_text").alias("corrected_text")))
    j = memory.join(best, ["src_lang", "chunk_hash"], "left")
    return j.select("src_lang", "chunk_hash",
                    F.coalesce("corrected_text", "translated_text").alias("translated_text"),
                    F.col("corrected_text").isNotNull().alias("corrected"))
