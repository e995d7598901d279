"""DuckDB SQL of equal meaning for each registered query (the driver's oracle)."""

from __future__ import annotations

from ..functions import html as H
from ..functions import text as T
from . import sqlfrag as S
from .sqlfrag import q, with_

ORACLE: dict[str, str] = {}


def sql(name):
    def deco(fn):
        ORACLE[name] = fn()
        return fn
    return deco


_SPLIT = "string_split(url, '/')"
_BASE = f"array_to_string({_SPLIT}[1:3], '/')"
_TAIL = f"(CASE WHEN len({_SPLIT}) > 3 THEN array_to_string({_SPLIT}[4:], '/') ELSE '' END)"


@sql("page_scan")
def _():
    return with_(S.PAGES) + "SELECT page_id, url, book_id, CAST(length(html) AS BIGINT) AS n_chars FROM P"


@sql("decode_pages")
def _():
    return with_(S.PAGES) + ("SELECT page_id, 'utf-8' AS charset, CAST(length(html) AS BIGINT) AS n_chars, "
                             "true AS same_text FROM P")


@sql("route_source")
def _():
    return with_(S.PAGES) + f"SELECT page_id, url, {S.route('url')} AS route FROM P"


@sql("split_url")
def _():
    return with_(S.PAGES) + f"SELECT page_id, {_BASE} AS base_url, {_TAIL} AS path_part FROM P"


@sql("absolute_links")
def _():
    abs_url = (f"CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href "
               f"ELSE {_BASE} || href END")
    return with_(S.PAGES, S.CLEAN, S.LINKS) + f"SELECT page_id, pos, href, {abs_url} AS abs_url FROM L"


@sql("explode_links")
def _():
    return with_(S.PAGES, S.CLEAN, S.LINKS) + "SELECT page_id, pos, href, link_text FROM L"


@sql("anchors_with_href")
def _():
    return with_(S.PAGES, S.CLEAN, S.LINKS) + "SELECT page_id, pos, href FROM L WHERE href IS NOT NULL"


@sql("link_by_text")
def _():
    return with_(S.PAGES, S.CLEAN, S.LINKS) + (
        "SELECT page_id, min(pos) AS pos, arg_min(href, pos) AS href FROM L "
        "WHERE link_text = 'the' AND href IS NOT NULL GROUP BY page_id")


@sql("explode_paragraphs")
def _():
    return with_(S.PAGES, S.CLEAN, S.PARAS) + "SELECT page_id, pos, text FROM PA"


@sql("drop_blank")
def _():
    return with_(S.PAGES, S.CLEAN, S.PARAS, S.NONBLANK) + "SELECT page_id, pos, text FROM PB"


@sql("page_metadata")
def _():
    footer = S.unicode_strip(S.node_text(S.first_or_null("clean", H.FOOTER)))
    title = S.title_text("clean")
    has = f"contains({title}, 'Author:')"
    parts = f"string_split({title}, 'Author:')"
    author_sel = f"CASE WHEN contains({footer}, {q(T.LABEL_SEPARATOR)}) THEN {S.unicode_strip(f'string_split({footer}, {q(T.LABEL_SEPARATOR)})[-1]')} END"
    return with_(S.PAGES, S.PARAS) + (
        f"SELECT F.page_id, CASE WHEN {has} THEN {S.unicode_strip(parts + '[1]')} ELSE {title} END AS title, "
        f"CASE WHEN {has} THEN {S.unicode_strip(parts + '[2]')} ELSE {author_sel} END AS author, "
        f"{S.unicode_strip('PA.text')} AS description, "
        f"{S.first_or_null('clean', S.IMG_SRC)} AS cover_url, {S.first_or_null('html', H.HTML_LANG)} AS html_lang "
        f"FROM (SELECT page_id, html, {S.drop_scripts('html')} AS clean FROM P) F LEFT JOIN PA ON PA.page_id = F.page_id AND PA.pos = 0")


@sql("title_author_split")
def _():
    title = S.unicode_strip(S.node_text(S.first_or_null("clean", H.TITLE)))
    has = f"contains({title}, 'Author:')"
    parts = f"string_split({title}, 'Author:')"
    return with_(S.PAGES, S.CLEAN) + (
        f"SELECT page_id, CASE WHEN {has} THEN {S.unicode_strip(parts + '[1]')} ELSE {title} END AS title, "
        f"CASE WHEN {has} THEN {S.unicode_strip(parts + '[2]')} ELSE NULL END AS author FROM C")


@sql("content_fallback")
def _():
    body = S.unicode_strip(S.node_text(S.drop_scripts(
        f"coalesce({S.first_or_null('html', '(?s)<body\\b[^>]*>(.*)')}, html)")))
    return with_(S.PAGES, S.CLEAN, S.PARAS, S.NONBLANK) + (
        "SELECT P.page_id, CASE WHEN pr.primary_text IS NOT NULL THEN 'article' ELSE 'body' END AS content_source, "
        f"coalesce(pr.primary_text, {body}) AS content FROM P LEFT JOIN "
        "(SELECT page_id, string_agg(text, '</p><p>' ORDER BY pos) AS primary_text FROM PB GROUP BY page_id) pr "
        "ON P.page_id = pr.page_id")


@sql("split_paragraphs")
def _():
    return ("SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS text "
            "FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")


@sql("chunk_text")
def _():
    n = T.CHUNK_SIZE
    return (f"SELECT doc_id, chunk_no, substring(text, CAST(chunk_no * {n} + 1 AS INTEGER), {n}) AS chunk FROM "
            f"(SELECT doc_id, text, unnest(range(0, CAST((length(text) + {n - 1}) // {n} AS BIGINT))) AS chunk_no "
            f"FROM documents WHERE length(text) > 0)")


@sql("normalize_text")
def _():
    return (f"SELECT doc_id, {S.normalize_text('text')} AS normalized, "
            f"{S.normalize_text('text', True)} AS as_paragraph FROM documents")


@sql("slug_title")
def _():
    return with_(S.PAGES, S.CLEAN) + f"SELECT page_id, {S.slug(S.title_text('clean'))} AS slug FROM C"


@sql("unicode_strip")
def _():
    return with_(S.PAGES, S.CLEAN, S.PARAS) + f"SELECT page_id, pos, {S.unicode_strip('text')} AS stripped FROM PA"


@sql("label_value")
def _():
    footer = S.node_text(S.first_or_null("clean", H.FOOTER))
    return with_(S.PAGES, S.CLEAN) + (
        f"SELECT page_id, string_split({footer}, '·')[-1] AS label_last, "
        f"string_split({footer}, '·')[2] AS label_second FROM C")


@sql("page_number")
def _():
    return with_(S.PAGES) + (
        "SELECT page_id, string_split(string_split(url, '-')[3], '.')[1] AS page_number, "
        f"regexp_extract(url, {q(r'/([0-9]+)(?:\.[a-z]+)?/?(?:[?#]|$)')}, 1) AS path_number FROM P")


@sql("strip_tokens")
def _():
    out = "text"
    for t in T.JUNK_TOKENS:
        out = f"replace({out}, {q(t)}, '')"
    return f"SELECT doc_id, {out} AS cleaned FROM documents"


@sql("declared_charset")
def _():
    meta = f"lower({S.first_or_null('html', H.META_CHARSET)})"
    return with_(S.PAGES) + (
        "SELECT page_id, (contains(html, 'charset=gbk') OR contains(html, 'charset=\"gbk\"')) AS declared_gbk, "
        f"{meta} AS declared_charset FROM P")


@sql("page_text")
def _():
    return with_(S.PAGES) + f"SELECT page_id, {S.node_text(S.drop_scripts('html'))} AS text FROM P"


# --- batch 2: chains, joins, aggregations, ordering, translation ------------

from ..functions import markup as M  # noqa: E402

_TITLE_N = S.title_text(S.drop_scripts("N.html"))


def _base(*more):
    return [S.PAGES, S.CLEAN, S.NAV, S.NUM, S.EDGES, S.WALK, S.CHAIN, S.TOC, *more]


_BACK = "BN AS (SELECT *, CAST(row_number() OVER (PARTITION BY book_id ORDER BY page_id DESC) AS BIGINT) AS chapter_no FROM P)"
_NUM_TOC = "NT AS (SELECT *, CAST(row_number() OVER (PARTITION BY book_id ORDER BY toc_page, pos) AS BIGINT) AS link_no FROM TL)"


@sql("follow_next_page")
def _():
    return S.with_rec(S.PAGES, S.EDGES, S.WALK, S.CHAIN) + "SELECT book_id, page_no, url FROM CH"


@sql("chain_depths")
def _():
    return with_(S.PAGES) + (
        "SELECT url, last_value(url) OVER w AS last_url, count(*) OVER w - row_number() OVER (PARTITION BY book_id ORDER BY page_id) AS depth FROM P "
        "WINDOW w AS (PARTITION BY book_id ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")


@sql("conversation_chains")
def _():
    node = "CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)"
    return S.with_rec(
        f"CE AS (SELECT {node} AS from_url, lead({node}) OVER (PARTITION BY conv_id ORDER BY turn) AS to_url, "
        "turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations)",
        # only consecutive turns link (turn n -> n + 1)
        "E AS (SELECT from_url, CASE WHEN next_turn = turn + 1 THEN to_url END AS to_url FROM CE)",
        S.WALK) + (
        "SELECT CAST(string_split(head, ':')[1] AS BIGINT) AS conv_id, page_no, "
        "CAST(string_split(url, ':')[2] AS BIGINT) AS turn FROM W")


@sql("paged_toc")
def _():
    return S.with_rec(*_base(_NUM_TOC)) + "SELECT book_id, link_no, toc_page, pos, href, link_text FROM NT"


_ABS = (f"CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href "
        f"ELSE array_to_string(string_split(url, '/')[1:3], '/') || href END")
_CLINKS = ("CL AS (SELECT book_id, page_id AS from_page_id, pos, 'nav' AS kind, " + _ABS + " AS link_url FROM NL "
           "UNION ALL SELECT E.book_id, P.page_id, CAST(NULL AS BIGINT), 'next', E.to_url FROM E JOIN P "
           "ON E.from_url = P.url WHERE E.to_url IS NOT NULL)")
_CONTENT = "CT AS (SELECT page_id, string_agg(text, '</p><p>' ORDER BY pos) AS content FROM PB GROUP BY page_id)"


@sql("toc_join_pages")
def _():
    return with_(S.PAGES, S.CLEAN, S.NAV, S.EDGES, _CLINKS) + (
        "SELECT CL.book_id, CL.from_page_id, CL.pos, CL.kind, CL.link_url, P.page_id AS target_page_id "
        "FROM CL LEFT JOIN P ON CL.link_url = P.url")


@sql("missing_chapters")
def _():
    return with_(S.PAGES, S.CLEAN, S.NAV, S.EDGES, _CLINKS, S.PARAS, S.NONBLANK, _CONTENT) + (
        "SELECT book_id, link_url AS url, 'no page' AS reason FROM CL WHERE link_url NOT IN (SELECT url FROM P) "
        "UNION ALL SELECT book_id, url, 'no content' FROM P WHERE page_id NOT IN "
        "(SELECT page_id FROM CT WHERE content IS NOT NULL AND content <> '')")


_DOCC = S.chunks("(SELECT doc_id, lang AS src_lang, text FROM documents)", "doc_id", "DC")
_MEM = [_DOCC, S.distinct_chunks("DC", "DD"), *S.glossary_ctes(), S.glossary_translate("DD", "MEM")]


@sql("translate_lookup")
def _():
    return with_(*_MEM, S.lookup("DC", "MEM", "LK")) + "SELECT doc_id, chunk_no, translated FROM LK"


@sql("glossary_override")
def _():
    return with_(*_MEM) + "SELECT src_lang, chunk_hash, translated_text FROM MEM"


_META_TITLE = S.title_text(S.drop_scripts("html"))


@sql("book_chapters")
def _():
    return with_(S.PAGES, S.NUM) + (
        f"SELECT N.book_id, B.book_title, N.chapter_no, {_TITLE_N} AS chapter_title FROM N JOIN "
        f"(SELECT book_id, {_META_TITLE} AS book_title FROM N WHERE chapter_no = 1) B ON N.book_id = B.book_id")


@sql("reassemble_chunks")
def _():
    return with_(_DOCC) + (
        "SELECT doc_id, nullif(string_agg(chunk, ' ' ORDER BY chunk_no), '') AS text FROM DC "
        "WHERE chunk IS NOT NULL AND chunk <> '' GROUP BY doc_id")


@sql("join_paragraphs")
def _():
    return with_(S.PAGES, S.CLEAN, S.PARAS, S.NONBLANK, _CONTENT) + "SELECT page_id, content FROM CT"


@sql("conditional_normalize")
def _():
    joined = "string_agg(piece, '</p><p>' ORDER BY pos, sub)"
    return with_(_DOCC) + (
        "SELECT f.doc_id, f.normalized, CASE WHEN f.normalized THEN "
        + S.normalize_text("coalesce(j.joined, '')", True) + " ELSE coalesce(j.joined, '') END AS content "
        "FROM (SELECT doc_id, bool_or(contains(chunk, chr(10))) AS normalized FROM DC GROUP BY doc_id) f "
        f"LEFT JOIN (SELECT doc_id, {joined} AS joined FROM (SELECT doc_id, chunk_no AS pos, "
        "generate_subscripts(l, 1) AS sub, unnest(l) AS piece FROM (SELECT doc_id, chunk_no, "
        "string_split(chunk, chr(10)) AS l FROM DC)) WHERE piece <> '' AND piece <> chr(10) GROUP BY doc_id) j "
        "ON f.doc_id = j.doc_id")


@sql("assemble_book")
def _():
    return with_(S.PAGES, S.NUM) + (
        "SELECT DISTINCT book_id, CAST(0 AS BIGINT) AS item_no, 'nav' AS file_name, CAST(NULL AS VARCHAR) AS title, "
        "false AS in_spine FROM N UNION ALL SELECT DISTINCT book_id, 1, 'titlepage.html', 'Title page', true FROM N "
        f"UNION ALL SELECT book_id, chapter_no + 1, 'chapter' || chapter_no || '.html', {_TITLE_N}, true FROM N")


@sql("distinct_chunks")
def _():
    return with_(_DOCC, S.distinct_chunks("DC", "DD", skip_target=False)) + (
        "SELECT src_lang, chunk_hash, source_text, n_uses FROM DD")


@sql("translation_savings")
def _():
    return with_(_DOCC, S.distinct_chunks("DC", "DD", skip_target=False)) + (
        "SELECT src_lang, CAST(sum(n_uses) AS BIGINT) AS n_chunks, count(*) AS n_distinct, "
        "CAST(sum(n_uses) - count(*) AS BIGINT) AS saved_calls FROM DD GROUP BY src_lang")


@sql("chapters_per_book")
def _():
    return with_(S.PAGES) + "SELECT book_id, count(*) AS n_chapters FROM P GROUP BY book_id"


@sql("number_chapters")
def _():
    return with_(S.PAGES, S.NUM) + "SELECT book_id, page_id, chapter_no FROM N"


@sql("first_occurrence")
def _():
    return with_(S.PAGES, S.CLEAN, S.NAV) + (
        "SELECT page_id, pos, href, min(pos) OVER (PARTITION BY page_id, href) AS first_pos FROM NL")


_LK_SRC = ("LS0 AS (SELECT NL.page_id, NL.pos, " + S.first_or_null("P.html", H.HTML_LANG)
           + " AS src_lang, NL.markup AS text FROM NL JOIN P ON NL.page_id = P.page_id)")
_LKEYS = [_LK_SRC, *S.glossary_ctes(), *S.translate_ctes("LS0", "page_id, pos", "K"),
          "LK AS (SELECT LS0.page_id, LS0.pos, KR.translated_text AS sort_key FROM LS0 LEFT JOIN KR "
          "ON LS0.page_id = KR.page_id AND LS0.pos = KR.pos)"]


@sql("order_chapters")
def _():
    return with_(S.PAGES, S.CLEAN, S.NAV, *_LKEYS) + (
        "SELECT NL.page_id, NL.pos, NL.href, CAST(row_number() OVER (PARTITION BY NL.page_id "
        "ORDER BY LK.sort_key, NL.pos) AS BIGINT) AS order_no FROM NL JOIN LK ON NL.page_id = LK.page_id AND NL.pos = LK.pos")


@sql("pagewise_order")
def _():
    return S.with_rec(*_base(*_LKEYS)) + (
        "SELECT book_id, toc_page, pos, href, CAST(row_number() OVER (PARTITION BY book_id ORDER BY toc_page, "
        "CASE WHEN toc_page > 1 THEN sort_key END NULLS FIRST, pos) AS BIGINT) AS link_no FROM "
        "(SELECT TL.*, LK.sort_key FROM TL JOIN NL ON TL.url = NL.url AND TL.pos = NL.pos "
        "LEFT JOIN LK ON LK.page_id = NL.page_id AND LK.pos = NL.pos)")


@sql("lexical_order")
def _():
    return with_(S.PAGES, S.NUM) + (
        "SELECT book_id, chapter_no, file_name, CAST(row_number() OVER (PARTITION BY book_id ORDER BY file_name) "
        "AS BIGINT) AS lexical_no FROM (SELECT book_id, chapter_no, 'chapter' || chapter_no || '.html' AS file_name FROM N)")


@sql("append_links")
def _():
    return S.with_rec(*_base()) + (
        "SELECT book_id, toc_page, pos, href FROM TL WHERE toc_page = 1 "
        "UNION ALL SELECT book_id, toc_page, pos, href FROM TL WHERE toc_page > 1")


def _fill_sql(template: str, **fields) -> str:
    return " || ".join(q(v) if k == "text" else fields[v] for k, v in M.template_parts(template))


def _chapter_html_sql(title: str, body: str) -> str:
    t = S.escape_html(f"coalesce({title}, '')")
    return _fill_sql(M.CHAPTER_TEMPLATE, title=t, body=f"coalesce({body}, '')")


def _paragraphs_sql(text: str, order: str, where: str = "true") -> str:
    return f"string_agg('<p>' || {S.escape_html(text)} || '</p>', '' ORDER BY {order}) FILTER (WHERE {where})"


@sql("chapter_html")
def _():
    body = f"BM AS (SELECT page_id, {_paragraphs_sql('text', 'pos')} AS body FROM PB GROUP BY page_id)"
    return with_(S.PAGES, S.CLEAN, S.PARAS, S.NONBLANK, body, S.NUM) + (
        f"SELECT N.book_id, N.chapter_no, {_chapter_html_sql(_TITLE_N, 'BM.body')} AS chapter_html "
        "FROM N LEFT JOIN BM ON N.page_id = BM.page_id")


def _title_page_sql(title: str, author: str) -> str:
    t = S.escape_html(f"coalesce({title}, '')")
    a = S.escape_html(f"coalesce({author}, {q(M.UNKNOWN_AUTHOR)})")
    return _fill_sql(M.TITLE_PAGE_TEMPLATE, title=t, author=a, notice=q(M.NOTICE))


_BOOK_AUTHOR = ("(CASE WHEN contains(" + _META_TITLE + ", 'Author:') THEN "
                + S.unicode_strip("string_split(" + _META_TITLE + ", 'Author:')[2]") + " ELSE "
                "(CASE WHEN contains(ft, " + q(T.LABEL_SEPARATOR) + ") THEN "
                + S.unicode_strip("string_split(ft, " + q(T.LABEL_SEPARATOR) + ")[-1]") + " END) END)")
_BOOK_TITLE = ("(CASE WHEN contains(" + _META_TITLE + ", 'Author:') THEN "
               + S.unicode_strip("string_split(" + _META_TITLE + ", 'Author:')[1]") + " ELSE " + _META_TITLE + " END)")
_BOOKS = ("BK AS (SELECT book_id, " + _BOOK_TITLE + " AS title, " + _BOOK_AUTHOR + " AS author FROM "
          "(SELECT *, " + S.unicode_strip(S.node_text(S.first_or_null(S.drop_scripts("html"), H.FOOTER)))
          + " AS ft FROM N WHERE chapter_no = 1))")


@sql("title_page")
def _():
    return with_(S.PAGES, S.NUM, _BOOKS) + f"SELECT book_id, {_title_page_sql('title', 'author')} AS title_page FROM BK"


_ART_TEXT = ("AT0 AS (SELECT page_id, " + S.decode_entities("string_agg(txt, '' ORDER BY i)") + " AS text FROM TK WHERE depth > 0 GROUP BY page_id)")
_ART = (_ART_TEXT + ", ATX AS (SELECT P.page_id, coalesce(AT0.text, '') AS text, " + S.first_or_null("html", H.HTML_LANG)
        + " AS html_lang FROM P LEFT JOIN AT0 ON P.page_id = AT0.page_id)")


@sql("detect_language")
def _():
    return with_(S.PAGES, S.TOKENS, _ART, *S.trigram_ctes("ATX", "page_id")) + (
        "SELECT ATX.page_id, BEST.lang, ATX.html_lang FROM ATX JOIN BEST ON ATX.page_id = BEST.page_id")


@sql("translate_documents")
def _():
    return with_("DS AS (SELECT doc_id, lang AS src_lang, text FROM documents)", *S.glossary_ctes(),
                 *S.translate_ctes("DS", "doc_id", "J")) + (
        "SELECT DS.doc_id, JR.translated_text FROM DS LEFT JOIN JR ON DS.doc_id = JR.doc_id")


@sql("apply_corrections")
def _():
    first = "substring(translated_text, 1, 1)"
    fix = ("FX AS (SELECT src_lang, chunk_hash, " + S.normalize_text("translated_text") + " AS fixed, 1 AS priority "
           "FROM MEM WHERE contains(translated_text, chr(10)) UNION ALL SELECT src_lang, chunk_hash, "
           f"upper({first}) || substring(translated_text, 2), 2 FROM MEM WHERE regexp_matches({first}, '^[a-z]$'))")
    best = ("FB AS (SELECT src_lang, chunk_hash, fixed FROM (SELECT *, row_number() OVER (PARTITION BY src_lang, "
            "chunk_hash ORDER BY priority DESC, fixed DESC) AS rn FROM FX) WHERE rn = 1)")
    return with_(*_MEM, fix, best) + (
        "SELECT MEM.src_lang, MEM.chunk_hash, coalesce(FB.fixed, MEM.translated_text) AS translated_text, "
        "FB.fixed IS NOT NULL AS corrected FROM MEM LEFT JOIN FB ON MEM.src_lang = FB.src_lang "
        "AND MEM.chunk_hash = FB.chunk_hash")


# --- batch 3: sources, sinks, job, nodes, stream ----------------------------

@sql("landing_roundtrip")
def _():
    return with_(S.PAGES, S.NUM) + (
        "SELECT book_id, chapter_no - 1 AS idx, url, 'page_' || (chapter_no - 1) || '.txt' AS file_name, "
        "CAST(length(html) AS BIGINT) AS n_chars FROM N")


@sql("contents_order")
def _():
    return with_(S.PAGES, _BACK) + ("SELECT book_id, chapter_no, url, 'Page ' || chapter_no AS title, (chapter_no - 1) // 20 + 1 AS toc_page, page_id FROM BN")


def _build_sql(select: str, num: str = "N", more: tuple = ()) -> str:
    cr = "chr(13)"
    parts = [
        S.PAGES, S.CLEAN, S.PARAS, S.NONBLANK, S.NUM, _BACK,
        f"TI AS (SELECT page_id, {S.title_text(S.drop_scripts('html'))} AS title FROM P)",
        f"CF AS (SELECT page_id, bool_or(contains(text, {cr})) AS normalized FROM PB GROUP BY page_id)",
        "CJ AS (SELECT PX.page_id, row_number() OVER (PARTITION BY PX.page_id ORDER BY pos, sub) AS para_no, CASE WHEN CF.normalized THEN "
        + S.normalize_text("piece") + " ELSE piece END AS text FROM "
        f"(SELECT page_id, pos, generate_subscripts(l, 1) AS sub, unnest(l) AS piece FROM "
        f"(SELECT page_id, pos, string_split(text, {cr}) AS l FROM PB)) PX JOIN CF ON PX.page_id = CF.page_id WHERE piece <> '' AND piece <> chr(10))",
        _ART, *S.trigram_ctes("ATX", "page_id"),
        "TX AS (SELECT u.page_id, u.para_no, BEST.lang AS src_lang, u.text FROM (SELECT page_id, 0 AS para_no, "
        "title AS text FROM TI UNION ALL SELECT page_id, para_no, text FROM CJ) u JOIN BEST ON u.page_id = BEST.page_id)",
        *S.glossary_ctes(), *S.translate_ctes("TX", "page_id, para_no", "B"),
        "BW AS (SELECT page_id, max(CASE WHEN para_no = 0 THEN translated_text END) AS t_title, "
        + _paragraphs_sql("translated_text", "para_no", "para_no > 0") + " AS t_body FROM BR GROUP BY page_id)",
    ]
    html = _chapter_html_sql("BW.t_title", "BW.t_body")
    final = ("FB AS (SELECT N.book_id, N.chapter_no, N.page_id, BEST.lang AS src_lang, BW.t_title AS title, "
             f"'chapter' || N.chapter_no || '.html' AS file_name, {html} AS chapter_html FROM {num} N "
             "LEFT JOIN BEST ON N.page_id = BEST.page_id LEFT JOIN BW ON N.page_id = BW.page_id)")
    return with_(*parts, final, *more) + select


@sql("build_books")
def _():
    return _build_sql("SELECT book_id, chapter_no, page_id, src_lang, title, file_name, chapter_html FROM FB")


@sql("build_books_by_rules")
def _():
    return _build_sql("SELECT book_id, chapter_no, page_id, src_lang, title, file_name, chapter_html FROM FB")


@sql("build_books_by_contents")
def _():
    return _build_sql("SELECT book_id, chapter_no, page_id, src_lang, title, file_name, chapter_html FROM FB", "BN")


@sql("chapter_files")
def _():
    return _build_sql("SELECT book_id, file_name, chapter_html FROM FB")


def _book_export_cte() -> str:
    footer = S.unicode_strip(S.node_text(S.first_or_null("clean", H.FOOTER)))
    title = S.title_text("clean")
    has = f"contains({title}, 'Author:')"
    parts = f"string_split({title}, 'Author:')"
    author_sel = (f"CASE WHEN contains({footer}, {q(T.LABEL_SEPARATOR)}) THEN "
                  f"{S.unicode_strip(f'string_split({footer}, {q(T.LABEL_SEPARATOR)})[-1]')} END")
    pm = (f"PM AS (SELECT F.book_id, CASE WHEN {has} THEN {S.unicode_strip(parts + '[1]')} ELSE {title} END AS title, "
          f"CASE WHEN {has} THEN {S.unicode_strip(parts + '[2]')} ELSE {author_sel} END AS author, "
          f"{S.unicode_strip('PA.text')} AS description, "
          f"{S.first_or_null('clean', S.IMG_SRC)} AS cover_url, {S.first_or_null('html', H.HTML_LANG)} AS language_code "
          f"FROM (SELECT page_id, book_id, html, {S.drop_scripts('html')} AS clean FROM N WHERE chapter_no = 1) F "
          "LEFT JOIN PA ON PA.page_id = F.page_id AND PA.pos = 0)")
    return pm


@sql("book_export")
def _():
    return with_(S.PAGES, S.PARAS, S.NUM, _book_export_cte()) + (
        "SELECT PM.*, c.n_chapters FROM PM JOIN (SELECT book_id, count(*) AS n_chapters FROM P GROUP BY book_id) c "
        "ON PM.book_id = c.book_id")


@sql("book_parts")
def _():
    item = "'<li><a href=\"' || file_name || '\">' || " + S.escape_html("coalesce(title, '')") + " || '</a></li>'"
    nav = (f"NV AS (SELECT book_id, (chapter_no - 1) // 1000 AS k, '<nav><ol>' || string_agg({item}, '' ORDER BY chapter_no) || '</ol></nav>' AS content FROM FB GROUP BY ALL)")
    return _build_sql(
        "SELECT book_id, k - max(k) OVER (PARTITION BY book_id) - 1 AS part_no, 'nav' AS kind, 'nav' || k || '.html' AS file_name, CAST(NULL AS VARCHAR) AS title, content FROM NV "
        f"UNION ALL SELECT book_id, 0, 'title', 'titlepage.html', title, {_title_page_sql('title', 'author')} FROM BK "
        "UNION ALL SELECT book_id, chapter_no, 'chapter', file_name, title, chapter_html FROM FB", "N", (_BOOKS, nav))


@sql("translated_metadata")
def _():
    texts = ("MX AS (SELECT PM.book_id, coalesce(BEST.lang, PM.language_code) AS src_lang, u.part, u.text FROM PM LEFT JOIN BEST ON PM.book_id = BEST.book_id, "
             "LATERAL (SELECT 0 AS part, PM.title AS text UNION ALL SELECT 1, PM.author UNION ALL SELECT 2, PM.description) u)")
    one = lambda k, name: f"max(CASE WHEN part = {k} THEN translated_text END) AS {name}"
    return with_(S.PAGES, S.PARAS, S.NUM, _book_export_cte(), f"DX AS (SELECT book_id, description AS text FROM PM WHERE length({S.unicode_strip('description')}) > 0)",
                 *S.trigram_ctes("DX", "book_id"), texts, *S.glossary_ctes(), *S.translate_ctes("MX", "book_id, part", "M"),
                 f"MR2 AS (SELECT book_id, {one(0, 'title')}, {one(1, 'author')}, {one(2, 'description')} FROM MR GROUP BY book_id)") + (
        "SELECT PM.book_id, MR2.title, MR2.author, MR2.description, PM.cover_url, coalesce(BEST.lang, PM.language_code) AS language_code "
        "FROM PM LEFT JOIN MR2 ON PM.book_id = MR2.book_id LEFT JOIN BEST ON PM.book_id = BEST.book_id")


@sql("html_nodes")
def _():
    return ("SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS pos, lower(unnest(l)) AS tag FROM "
            "(SELECT page_id, regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9]*)', 1) AS l FROM pages)")


@sql("tag_counts")
def _():
    return ("SELECT lower(t) AS tag, count(*) AS n_nodes FROM (SELECT unnest(regexp_extract_all(html, "
            "'<([A-Za-z][A-Za-z0-9]*)', 1)) AS t FROM pages) GROUP BY lower(t)")


@sql("apply_rules")
def _():
    art = f"coalesce({S.first_or_null('html', '(?is)<article>(.*?)</article>')}, '')"
    nav = f"coalesce({S.first_or_null('html', S.NAV_PART)}, '')"

    def field(name, src, count_re, first_re):
        n = f"len(regexp_extract_all({src}, {q(count_re)}, 0))"
        first = S.decode_entities(f"regexp_extract({src}, {q(first_re)}, 1)")
        return f"SELECT page_id, '{name}' AS field, CAST({n} AS BIGINT) AS n_nodes, {first} AS first_text FROM P"

    union = " UNION ALL ".join([
        field("title", art, r"<h1\b", r"<h1\b[^>]*>(?:<b>)?([^<]*)"),
        field("body", art, r"<p\b", r"<p\b[^>]*>(?:<b>)?([^<]*)"),
        field("link", nav, r"<a\b", r"<a\b[^>]*>(?:<b>)?([^<]*)"),
        field("advert", "html", r"<div class=\"ad\"", r"<div class=\"ad\"[^>]*>([^<]*)"),
    ])
    return with_(S.PAGES) + f"SELECT * FROM ({union}) WHERE n_nodes > 0"


@sql("stream_ingest")
def _():
    return with_(S.PAGES, S.CLEAN, S.PARAS, S.NONBLANK, _CONTENT) + (
        f"SELECT P.page_id, P.url, P.book_id, CAST(length(P.html) AS BIGINT) AS n_chars, "
        f"{S.title_text(S.drop_scripts('P.html'))} AS title, coalesce(CT.content, '') AS content "
        "FROM P LEFT JOIN CT ON P.page_id = CT.page_id")


@sql("next_page_book")
def _():
    body = "coalesce(AT0.text, '')"
    for t in T.JUNK_TOKENS:
        body = f"replace({body}, {q(t)}, '')"
    pieces = ("PS AS (SELECT page_id, src_lang, piece_no, text FROM (SELECT page_id, src_lang, "
              "generate_subscripts(l, 1) - 1 AS piece_no, unnest(l) AS text FROM (SELECT P.page_id, "
              + S.first_or_null("html", H.HTML_LANG) + " AS src_lang, string_split(" + body + ", "
              + q(T.IDEOGRAPHIC_PARAGRAPH) + ") AS l FROM P LEFT JOIN AT0 ON P.page_id = AT0.page_id)) WHERE text <> '')")
    joined = f"PJ AS (SELECT page_id, {_paragraphs_sql('translated_text', 'piece_no', 'translated_text IS NOT NULL')} AS content FROM QR GROUP BY page_id)"
    html = _fill_sql(M.PAGE_TEMPLATE, page_no="CAST(CH.page_no AS VARCHAR)", body="coalesce(PJ.content, '')")
    return S.with_rec(S.PAGES, S.TOKENS, _ART_TEXT, S.EDGES, S.WALK, S.CHAIN, pieces, *S.glossary_ctes(),
                      *S.translate_ctes("PS", "page_id, piece_no", "Q"), joined) + (
        f"SELECT CH.book_id, CH.page_no, 'page' || CH.page_no || '.html' AS file_name, {html} AS page_html "
        "FROM CH JOIN P ON CH.url = P.url LEFT JOIN PJ ON P.page_id = PJ.page_id")
