"""DuckDB SQL forms of the Column functions.

Used only to write the oracle SQL; the library itself never parses SQL.
Paragraphs and article text come by another way than the engine's: the page
is split at '<', the tags counted by window sums.
"""

from __future__ import annotations

from ..functions import html as H
from ..functions import text as T
from ..functions import urls as U


# --- fixed values: what the given pages hold ----------------------------------
ENTITIES = (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;?", "&"))
ANCHOR = r"(?is)<a\b([^>]*)>(.*?)</a>"
HREF = r"""(?i)\bhref\s*=\s*"([^"]*)\""""
HAS_HREF = r"(?i)\bhref\s*="
NAV_PART = r"(?is)<nav\b[^>]*>(.*?)</nav>"
IMG_SRC = r"""(?i)<img\b[^>]*\bsrc\s*=\s*"([^"]*)\""""
# ------------------------------------------------------------------------------


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def unicode_strip(x: str) -> str:
    ws = T.WHITESPACE_CLASS
    return f"regexp_replace({x}, {q('^' + ws + '+|' + ws + '+$')}, '', 'g')"


def normalize_text(x: str, paragraph_tags: bool = False) -> str:
    s = unicode_strip(f"regexp_replace({x}, {q(T.NORMALIZE_RUN)}, ' ', 'g')")
    s = f"(CASE WHEN {s} = {q(T.NONE_LITERAL)} OR {s} = '' THEN '' ELSE {s} END)"
    if paragraph_tags:
        s = f"(CASE WHEN {s} = '' THEN {s} ELSE '<p>' || {s} || '</p>' END)"
    return s


def slug(x: str) -> str:
    return f"lower(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_]', '_', 'g'))"


def decode_entities(x: str) -> str:
    out = x
    for ent, ch in ENTITIES:
        out = f"regexp_replace({out}, {q(ent)}, {q(ch)}, 'g')"
    return out


def escape_html(x: str) -> str:
    out = x
    for ch, ent in H.ESCAPES:
        out = f"replace({out}, {q(ch)}, {q(ent)})"
    return out


def strip_tags(x: str) -> str:
    return f"regexp_replace({x}, {q(H.TAG)}, '', 'g')"


def node_text(x: str) -> str:
    return decode_entities(strip_tags(x))


def drop_scripts(x: str) -> str:
    return f"regexp_replace({x}, {q(H.SCRIPT_STYLE)}, '', 'g')"


def first_or_null(x: str, pattern: str) -> str:
    return f"(CASE WHEN regexp_matches({x}, {q(pattern)}) THEN regexp_extract({x}, {q(pattern)}, 1) END)"


def host(u: str) -> str:
    return f"regexp_extract({u}, {q(U.HOST_PATTERN)}, 1)"


def route(u: str) -> str:
    whens = " ".join(f"WHEN contains({u}, {q(p)}) THEN {q(lbl)}" for p, lbl in U.ROUTES)
    return f"(CASE {whens} ELSE {q(U.DEFAULT_ROUTE)} END)"


def title_text(clean: str) -> str:
    return unicode_strip(node_text(f"coalesce({first_or_null(clean, H.H1)}, {first_or_null(clean, H.TITLE)})"))


def chunk_hash(x: str) -> str:
    return f"sha256({x})"


# Common CTEs -----------------------------------------------------------------

PAGES = f"P AS (SELECT page_id, url, html, {host('url')} AS book_id FROM pages)"
CLEAN = f"C AS (SELECT page_id, url, book_id, {drop_scripts('html')} AS clean FROM P)"
def _running(up: str, down: str) -> str:
    return f"sum(CASE WHEN name IN ({up}) THEN 1 WHEN name IN ({down}) THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i)"


# one row per '<': the tag's name ('/p' closes) and the text up to the next one
_ENDS = ", ".join(q(x) for b in H.BLOCKS.split() for x in (b, "/" + b))
TOKENS = (
    "TK0 AS (SELECT page_id, book_id, generate_subscripts(l, 1) AS i, unnest(l) AS tok FROM (SELECT page_id, book_id, string_split(html, '<') AS l FROM P)), "
    "TK1 AS (SELECT page_id, book_id, i, lower(regexp_extract(tok, '^/?[A-Za-z][A-Za-z0-9]*')) AS name, substring(tok, strpos(tok, '>') + 1) AS txt FROM TK0), "
    f"TK2 AS (SELECT *, {_running(q('script') + ', ' + q('style'), q('/script') + ', ' + q('/style'))} AS raw FROM TK1), "
    f"TK AS (SELECT *, {_running(q('article'), q('/article'))} AS depth, {_running(_ENDS, q('?'))} AS seg FROM TK2 WHERE raw = 0)")
# a paragraph is what follows a <p> up to the next block tag; chr(1): a line break
PARAS = (
    f"{TOKENS}, PA0 AS (SELECT page_id, book_id, seg, min(i) AS first_i, arg_min(name, i) AS opener, "
    "string_agg(CASE WHEN name = 'br' THEN chr(1) || txt ELSE txt END, '' ORDER BY i) AS body FROM TK WHERE depth > 0 GROUP BY page_id, book_id, seg), "
    "PA AS (SELECT page_id, book_id, row_number() OVER (PARTITION BY page_id ORDER BY first_i) - 1 AS pos, "
    + decode_entities("replace(regexp_replace(body, '(\\x01\\s*)+$', ''), chr(1), chr(10))") + " AS text FROM PA0 WHERE opener = 'p')")
NONBLANK = f"PB AS (SELECT * FROM PA WHERE length({unicode_strip('text')}) > 0)"


def _links_cte(name: str, src: str) -> str:
    attrs = f"regexp_extract_all({src}, {q(ANCHOR)}, 1)"
    inner = f"regexp_extract_all({src}, {q(ANCHOR)}, 2)"
    return (f"{name} AS (SELECT page_id, url, book_id, pos, "
            f"CASE WHEN regexp_matches(attrs, {q(HAS_HREF)}) THEN regexp_extract(attrs, {q(HREF)}, 1) END AS href, "
            f"{unicode_strip(node_text('inner_html'))} AS link_text, '<a' || attrs || '>' || inner_html || '</a>' AS markup "
            f"FROM (SELECT page_id, url, book_id, generate_subscripts(la, 1) - 1 AS pos, unnest(la) AS attrs, unnest(li) AS inner_html "
            f"FROM (SELECT page_id, url, book_id, {attrs} AS la, {inner} AS li FROM C)))")


LINKS = _links_cte("L", "clean")
NAV = ("CN AS (SELECT page_id, url, book_id, coalesce(" + first_or_null("clean", NAV_PART) + ", '') AS clean FROM C), "
       + _links_cte("NL", "clean").replace("FROM C)", "FROM CN)"))


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


def with_rec(*ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join(ctes) + " "


NUM = ("N AS (SELECT *, CAST(row_number() OVER (PARTITION BY book_id ORDER BY page_id) AS BIGINT) AS chapter_no "
       "FROM P)")
EDGES = ("E AS (SELECT book_id, url AS from_url, lead(url) OVER (PARTITION BY book_id ORDER BY page_id) AS to_url "
         "FROM P)")
WALK = ("W(head, url, page_no, visited) AS ("
        "SELECT from_url, from_url, CAST(1 AS BIGINT), [from_url] FROM E "
        "WHERE from_url NOT IN (SELECT to_url FROM E WHERE to_url IS NOT NULL) "
        "UNION ALL SELECT W.head, E.to_url, W.page_no + 1, list_append(W.visited, E.to_url) "
        "FROM W JOIN E ON W.url = E.from_url "
        "WHERE E.to_url IS NOT NULL AND NOT list_contains(W.visited, E.to_url))")
CHAIN = "CH AS (SELECT P.book_id, W.page_no, W.url FROM W JOIN P ON W.head = P.url)"
TOC = ("TL AS (SELECT CH.book_id, CH.page_no AS toc_page, NL.url, NL.pos, NL.href, NL.link_text, NL.markup "
       "FROM CH JOIN NL ON CH.url = NL.url)")


def glossary_ctes() -> list[str]:
    from ..operators.translate import GLOSSARY_ROWS
    vals = ", ".join(f"({q(a)}, {q(b)}, {q(c)}, {d})" for a, b, c, d in GLOSSARY_ROWS)
    return [f"GL0(lang, src, dst, priority) AS (VALUES {vals})",
            "GL AS (SELECT lang, src, dst FROM (SELECT *, row_number() OVER "
            "(PARTITION BY lang, src ORDER BY priority DESC, dst DESC) AS rn FROM GL0) WHERE rn = 1)"]


def glossary_translate(src: str, name: str) -> str:
    """(src_lang, chunk_hash, source_text) -> (src_lang, chunk_hash, translated_text)."""
    return (f"{name} AS (SELECT t.src_lang, t.chunk_hash, string_agg(coalesce(GL.dst, t.tok), ' ' ORDER BY t.tpos) "
            f"AS translated_text FROM (SELECT src_lang, chunk_hash, generate_subscripts(l, 1) AS tpos, unnest(l) AS tok "
            f"FROM (SELECT src_lang, chunk_hash, string_split(source_text, ' ') AS l FROM {src})) t "
            f"LEFT JOIN GL ON GL.lang = t.src_lang AND GL.src = lower(t.tok) GROUP BY t.src_lang, t.chunk_hash)")


def chunks(src: str, keys: str, name: str, text: str = "text") -> str:
    n = 500
    return (f"{name} AS (SELECT {keys}, src_lang, chunk_no, substring({text}, CAST(chunk_no * {n} + 1 AS INTEGER), {n}) "
            f"AS chunk FROM (SELECT *, unnest(range(0, CAST((length({text}) + {n - 1}) // {n} AS BIGINT))) AS chunk_no "
            f"FROM {src} WHERE length({text}) > 0))")


def distinct_chunks(src: str, name: str, skip_target: bool = True) -> str:
    where = "WHERE src_lang <> 'en' " if skip_target else ""
    return (f"{name} AS (SELECT src_lang, sha256(chunk) AS chunk_hash, min(chunk) AS source_text, "
            f"count(*) AS n_uses FROM {src} {where}GROUP BY src_lang, sha256(chunk))")


def lookup(chunks_name: str, memory: str, name: str) -> str:
    return (f"{name} AS (SELECT c.*, CASE WHEN m.translated_text IS NULL AND length(c.chunk) > 0 THEN c.chunk "
            f"ELSE m.translated_text END AS translated FROM {chunks_name} c LEFT JOIN {memory} m "
            f"ON c.src_lang = m.src_lang AND sha256(c.chunk) = m.chunk_hash)")


def reassemble(src: str, keys: str, name: str, out: str = "translated_text") -> str:
    return (f"{name} AS (SELECT {keys}, nullif(string_agg(translated, ' ' ORDER BY chunk_no), '') AS {out} "
            f"FROM {src} WHERE translated IS NOT NULL AND translated <> '' GROUP BY {keys})")


def translate_ctes(src: str, keys: str, prefix: str) -> list[str]:
    """Full J2 chain on a CTE ``src`` (keys..., src_lang, text) with no memory;
    final CTE ``{prefix}R`` = (keys..., translated_text)."""
    return [chunks(src, keys, f"{prefix}C"),
            distinct_chunks(f"{prefix}C", f"{prefix}D"),
            glossary_translate(f"{prefix}D", f"{prefix}T"),
            lookup(f"{prefix}C", f"{prefix}T", f"{prefix}L"),
            reassemble(f"{prefix}L", keys, f"{prefix}R")]


def trigram_ctes(text_src: str, key: str) -> list[str]:
    """NB model from documents + scoring of ``text_src`` (key, text) -> BEST(key, lang)."""
    tri = ("SELECT {k}, substring(lt, CAST(i AS INTEGER), 3) AS gram FROM (SELECT {k}, lt, "
           "unnest(range(1, length(lt) - 1)) AS i FROM (SELECT {k}, lower({t}) AS lt FROM {s}) WHERE length(lt) >= 3)")
    return [
        "TG AS (SELECT lang, gram, count(*) AS c FROM (" + tri.format(k="lang", t="text",
                                                                        s="documents WHERE lang IS NOT NULL") + ") GROUP BY lang, gram)",
        "VV AS (SELECT count(DISTINCT gram) AS v FROM TG)",
        "LS AS (SELECT lang, sum(c) AS t FROM TG GROUP BY lang)",
        "ND AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang)",
        "PR AS (SELECT LS.lang, ln(ND.n / (SELECT sum(n) FROM ND)) AS prior, ln(LS.t + VV.v) AS denom "
        "FROM LS JOIN ND ON LS.lang = ND.lang CROSS JOIN VV)",
        f"DG AS (SELECT {key}, gram, count(*) AS n FROM (" + tri.format(k=key, t="text", s=text_src) + f") GROUP BY {key}, gram)",
        f"MM AS (SELECT {key}, sum(n) AS m FROM DG WHERE gram IN (SELECT gram FROM TG) GROUP BY {key})",
        f"SS AS (SELECT DG.{key}, TG.lang, sum(DG.n * ln(TG.c + 1)) AS s FROM DG JOIN TG ON DG.gram = TG.gram "
        f"GROUP BY DG.{key}, TG.lang)",
        f"SC AS (SELECT X.{key}, PR.lang, round(PR.prior - PR.denom * coalesce(MM.m, 0) + coalesce(SS.s, 0), 6) AS score "
        f"FROM {text_src} X CROSS JOIN PR LEFT JOIN MM ON MM.{key} = X.{key} "
        f"LEFT JOIN SS ON SS.{key} = X.{key} AND SS.lang = PR.lang)",
        f"BEST AS (SELECT {key}, lang FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, lang) "
        f"AS rn FROM SC) WHERE rn = 1)",
    ]
