"""Registered queries of the engine with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.functions import answer, chunk, embedding, filetype, text, understanding
from quillstream.operators import keyword_index, metadata, parsing, prompting, ranking, vector
from quillstream.plans import derived as d
from quillstream.plans import ingest
from quillstream.sources import stores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


#: Small fixed cases: tests hold them against their SQL, and nobody registers them.
CASES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CASES_SQL: dict[str, str] = {}


def case(sql: str):
    def keep(f):
        CASES[f.__name__] = f
        CASES_SQL[f.__name__] = sql
        return f

    return keep


def values(columns: str, rows: list[tuple]) -> str:
    """Literal rows as a query that both engines run."""
    lit = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({columns})"


def literal(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    esc = [tuple(v.replace("\\", "\\\\").replace("'", "\\'") if isinstance(v, str) else v for v in r) for r in rows]
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return spark.sql(f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in esc)}) AS t({columns})")


def sql_text(value: str) -> str:
    """A text with line ends as an SQL expression."""
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in value.split("\n"))


# ---------------------------------------------------------------- vectors

DIST = "round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))), 9)"


def _knn_sql(on: str, k: int = 8) -> str:
    return f"""{d.with_tables("vectors")}, m AS (
  SELECT q.id AS query_id, v.id AS id, {DIST} AS dist FROM vectors q JOIN vectors v ON {on} WHERE q.id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS INTEGER) AS rank FROM m)
SELECT query_id, id, rank, round(1 / (1 + dist), 6) AS score FROM r WHERE rank <= {k}"""


def _hits(df: DataFrame) -> DataFrame:
    return df.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query(_knn_sql("true"))
def vector_topk(s, sf):
    """Eight nearest of all vectors."""
    return _hits(vector.nearest(d.vector_queries(s, sf), d.vectors(s, sf), by=None))


@query(_knn_sql("q.kb = v.kb"))
def vector_topk_filtered(s, sf):
    """Eight nearest inside the query's knowledge base."""
    return _hits(vector.nearest(d.vector_queries(s, sf), d.vectors(s, sf)))


VARIANTS = """, qv AS (
  SELECT id AS query_id, kb, 0 AS variant, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS embedding FROM vectors WHERE id % 50 = 0
  UNION ALL SELECT id, kb, 1, list_transform(embedding, lambda x: -CAST(x AS DOUBLE)) FROM vectors WHERE id % 50 = 0
), m AS (SELECT q.query_id, q.variant, v.id, """ + DIST + """ AS dist FROM qv q JOIN vectors v ON q.kb = v.kb
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY dist, id) AS rn FROM m
), b AS (SELECT query_id, id, max(1 / (1 + dist)) AS score, min(variant * 1000 + rn) AS seen FROM r WHERE rn <= 8 GROUP BY ALL
), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS INTEGER) AS rank FROM b)
SELECT query_id, id, rank, round(score, 6) AS score FROM o WHERE rank <= 8"""


@query(d.with_tables("vectors") + VARIANTS)
def vector_multi_query(s, sf):
    """Two variants of each query, united by the best score."""
    q = d.vector_queries(s, sf)
    both = q.select(F.concat(F.col("query_id").cast("string"), F.lit("/0")).alias("x"), (F.col("query_id") * 2).alias("query_id"), "kb", F.col("embedding").cast("array<double>").alias("embedding"))
    other = q.select(F.lit("").alias("x"), (F.col("query_id") * 2 + 1).alias("query_id"), "kb", F.transform("embedding", lambda x: -x.cast("double")).alias("embedding"))
    hits = vector.nearest(both.unionByName(other).drop("x"), d.vectors(s, sf))
    hits = hits.select(F.floor(F.col("query_id") / 2).alias("query_id"), (F.col("query_id") % 2).alias("variant"), "id", "rank", "score")
    return _hits(vector.merged(hits))


@query(d.with_tables("vectors") + " SELECT kb, count(*) AS n FROM vectors GROUP BY kb")
def vector_count_by_kb(s, sf):
    return d.vectors(s, sf).groupBy("kb").agg(F.count("*").alias("n"))


@query(d.with_tables("vectors") + " SELECT kb, count(*) AS n FROM vectors WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY kb")
def vector_delete_anti(s, sf):
    """What a deletion of the ids of toxic documents leaves."""
    gone = d.table(s, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return stores.without(d.vectors(s, sf), gone).groupBy("kb").agg(F.count("*").alias("n"))


@query(d.with_tables("vectors") + " SELECT v.id, kb, doc_id AS document_id FROM vectors v JOIN documents ON doc_id = v.id WHERE kb = 3 AND contains(text, 'the')")
def where_filter(s, sf):
    """Equality on the knowledge base and containment in the text."""
    v = d.vectors(s, sf).join(d.table(s, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("document")), "id")
    return vector.filtered(v, kb=3, contains=" the ".strip()).select("id", "kb", F.col("id").alias("document_id"))


@case(values("id, distance", [(1, 0.0), (2, 1.0), (3, None), (4, -1.0)]).replace("SELECT *", "SELECT id, CASE WHEN distance IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(1 / (1 + greatest(distance, 0)) AS DOUBLE) END AS score"))
def distance_score(s, sf):
    return literal(s, "id, distance", [(1, 0.0), (2, 1.0), (3, None), (4, -1.0)]).select("id", vector.score(F.col("distance")).alias("score"))


# ---------------------------------------------------------------- cleaning

SP = text.SPACE


def clean_sql(how: text.Cleaning) -> str:
    c = f"trim(regexp_replace(text, '{SP}+', ' ', 'g'), ' ')"
    if how.width:
        c = f"translate({c}, '{text.WIDE}', '{text.NARROW}')"
    if how.accents:
        c = f"translate({c}, '{text.ACCENTED}', '{text.PLAIN}')"
    if how.punctuation:
        marks = text.ASCII_MARKS.replace("'", "''")
        c = f"translate(replace({c}, '…', '...'), '{text.CJK_MARKS}', '{marks}')"
    return f"SELECT doc_id, md5({c}) AS digest, length({c}) AS n FROM documents"


def _cleaned(s, sf, how):
    c = text.clean(F.col("text"), how)
    return d.table(s, sf, "documents").select("doc_id", F.md5(c).alias("digest"), F.length(c).cast("long").alias("n"))


@query(clean_sql(text.DEFAULT))
def clean_basic(s, sf):
    return _cleaned(s, sf, text.DEFAULT)


@query(clean_sql(text.LIGHT))
def clean_light(s, sf):
    return _cleaned(s, sf, text.LIGHT)


@query(clean_sql(text.AGGRESSIVE))
def clean_aggressive(s, sf):
    return _cleaned(s, sf, text.AGGRESSIVE)


CLEAN_CASES = [(1, "  全角空格　　和ＡＢＣ字符  ", "全角空格 和ABC字符"), (2, "你好，世界。（测试）…", "你好,世界.(测试)..."), (3, "a\r\nb\n\n\n\nc", "a b c"), (4, "Ça Ñandú über", "Ca Nandú uber"), (5, "", "")]


@case(values("id, raw, cleaned", CLEAN_CASES).replace("SELECT *", "SELECT id, cleaned"))
def clean_cases(s, sf):
    return literal(s, "id, raw, cleaned", CLEAN_CASES).select("id", text.clean(F.col("raw")).alias("cleaned"))


MD_CASES = [(1, "##Title ##", "## Title"), (2, "# A", "# A"), (3, "###x", "### x")]


@case(values("id, raw, cleaned", MD_CASES).replace("SELECT *", "SELECT id, cleaned"))
def clean_markdown_heading(s, sf):
    return literal(s, "id, raw, cleaned", MD_CASES).select("id", text.markdown_heading(F.col("raw")).alias("cleaned"))


MD_BLOCKS = [(1, "[ a ]( b ) and [c](d)", "[a](b) and [c](d)"), (2, "* x\n  + y\n- z", "- x\n  - y\n- z")]


@case(values("id, raw, cleaned", MD_BLOCKS).replace("SELECT *", "SELECT id, cleaned"))
def clean_markdown_inline(s, sf):
    return literal(s, "id, raw, cleaned", MD_BLOCKS).select("id", text.markdown_lists(text.markdown_links(F.col("raw"))).alias("cleaned"))


OCR_CASES = [(1, "机 器 学 习", "机器学习"), (2, "a b c", "abc"), (3, "机 a", "机a"), (4, "1 2 年", "12年"), (5, "hel1o", "hello"), (6, "w0rd", "word"), (7, "2024", "2024"), (8, "c1ass1c", "classlc")]


@case(values("id, raw, cleaned", OCR_CASES).replace("SELECT *", "SELECT id, cleaned"))
def clean_ocr(s, sf):
    return literal(s, "id, raw, cleaned", OCR_CASES).select("id", text.ocr_letters(text.ocr_glue(F.col("raw"))).alias("cleaned"))


# ---------------------------------------------------------------- file kinds

@query("""SELECT page_id, 'text/html' AS mime, '.html' AS extension, 1.0::DOUBLE AS confidence FROM pages WHERE lower(html[1:14]) = '<!doctype html'
UNION ALL SELECT page_id, 'text/html', '.html', 0.8 FROM pages WHERE lower(html[1:14]) <> '<!doctype html'""")
def filetype_signature(s, sf):
    f = filetype.identify(F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html")), F.col("html").cast("binary"))
    return d.table(s, sf, "pages").select("page_id", f.alias("f")).select("page_id", "f.mime", "f.extension", "f.confidence")


KINDS = [("x.md", "# a", "text/markdown", 1.0), ("x.txt", "- a", "text/markdown", 0.8), ("x.txt", "BMW", "image/bmp", 0.8), ("x.pdf", "%PDF-1.4", "application/pdf", 1.0), ("x.xyz", "hello", "application/octet-stream", 0.8), ("x.txt", "hello", "text/plain", 0.8), ("a.webp", "RIFFxxxxWEBP", "image/webp", 1.0)]


@case(values("name, body, mime, confidence", KINDS).replace("SELECT *", "SELECT name, body, mime, CAST(confidence AS DOUBLE) AS confidence"))
def filetype_cases(s, sf):
    f = filetype.identify(F.col("name"), F.col("body").cast("binary"))
    return literal(s, "name, body, mime, confidence", KINDS).select("name", "body", f["mime"].alias("mime"), f["confidence"].alias("confidence"))


@query("""SELECT doc_id, CASE WHEN n <= 102400 THEN 'quick' WHEN n <= 10485760 THEN 'balanced' WHEN n <= 104857600 THEN 'deep' ELSE 'stream' END AS strategy,
CAST(CASE WHEN n <= 102400 THEN 60 WHEN n <= 10485760 THEN 180 WHEN n <= 104857600 THEN 600 ELSE 1800 END AS BIGINT) AS timeout FROM (SELECT doc_id, strlen(text) AS n FROM documents)""")
def parse_strategy(s, sf):
    st = filetype.strategy(F.lit("text/plain"), F.octet_length("text"))
    return d.table(s, sf, "documents").select("doc_id", st.alias("strategy")).select("doc_id", "strategy", filetype.settings(F.col("strategy"))["timeout"].alias("timeout"))


ENDINGS = (".pdf", ".jpeg", ".mp4", ".mp3", ".md", "", ".txt", ".html", ".PNG", ".wav", ".docx")


@query(f"""SELECT page_id, CASE WHEN e IN ('.pdf', '.md', '.txt', '.docx') THEN 'document' WHEN e IN ('.jpeg', '.png') THEN 'image' WHEN e = '.mp4' THEN 'video' WHEN e IN ('.mp3', '.wav') THEN 'audio' ELSE 'other' END AS category,
CASE WHEN e = '.md' THEN 'markdown' WHEN e IN ('.jpeg', '.png') THEN 'image' WHEN e = '.pdf' THEN 'rejected' WHEN e = '.docx' THEN 'rejected' ELSE 'plain_text' END AS parser
FROM (SELECT page_id, lower(list_extract({list(ENDINGS)!r}, CAST(page_id % {len(ENDINGS)} AS INTEGER) + 1)) AS e FROM pages)""")
def file_category(s, sf):
    """Pages as files of many kinds, by an ending that their number chooses."""
    name = F.concat(F.lit("page"), F.get(F.array(*map(F.lit, ENDINGS)), (F.col("page_id") % len(ENDINGS)).cast("int")))
    return d.table(s, sf, "pages").select("page_id", filetype.category(name).alias("category"), filetype.parser_of(name).alias("parser"))


NAMES = [("a.PDF", "document", "rejected"), ("b.jpeg", "image", "image"), ("c.mp4", "video", "plain_text"), ("d.mp3", "audio", "plain_text"), ("e.md", "document", "markdown"), ("f", "other", "plain_text"), ("g.txt", "document", "plain_text")]


@case(values("name, category, parser", NAMES))
def file_category_cases(s, sf):
    return literal(s, "name, category, parser", NAMES).select("name", filetype.category(F.col("name")).alias("category"), filetype.parser_of(F.col("name")).alias("parser"))


# ---------------------------------------------------------------- parsing

@query(rf"""WITH l AS (
  SELECT doc_id, i, regexp_replace(parts[i], '{SP}+$', '') AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), range(1, len(parts) + 1) r(i)
), n AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM l
), k AS (SELECT *, regexp_replace(line, '^{SP}+|{SP}+$', '', 'g') AS s, regexp_extract(line, '^([0-9]+\.[0-9]*)\s+(.+)$', 2) AS title,
  regexp_matches(line, '^#{{1,6}}\s+.+$') AS hashed FROM n
), t AS (SELECT *, regexp_matches(line, '^([0-9]+\.[0-9]*)\s+(.+)$') AND NOT coalesce(regexp_matches(trim(nx), '^([0-9]+\.[0-9]*)\s+(.+)$'), false)
  AND NOT (regexp_matches(title, '[\x{{4e00}}-\x{{9fa5}}]') AND length(title) < 20)
  AND (length(title) > 20 OR regexp_matches(title, '[\x{{4e00}}-\x{{9fa5}}].{{4}}') OR regexp_matches(title, '章节|部分|章|节|引言|概述|总结')) AS numbered FROM k WHERE s <> '')
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS element_index,
  CASE WHEN hashed OR numbered THEN 'heading' WHEN regexp_matches(s, '^(\s*)([*+-]|[0-9]+\.)\s+(.*)') THEN 'list_item' ELSE 'paragraph' END AS element_type,
  md5(CASE WHEN hashed OR numbered THEN line ELSE s END) AS digest, CASE WHEN hashed THEN 1.0::DOUBLE ELSE 0.95::DOUBLE END AS parser_confidence FROM t""")
def parse_plain_elements(s, sf):
    e = parsing.plain_elements(d.table(s, sf, "documents"))
    return e.select("doc_id", "element_index", "element_type", F.md5("raw_content").alias("digest"), "parser_confidence")


HEADS = [(1, "heading", 1, "a", "a"), (2, "heading", 3, "b", "a>b"), (3, "heading", 2, "c", "a>c"), (4, "heading", 3, "d", "a>c>d"), (5, "heading", 1, "e", "e")]


@case(values("i, kind, level, title, path", HEADS).replace("SELECT *", "SELECT i, title, path"))
def heading_paths(s, sf):
    order = Window.partitionBy("doc").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    h = literal(s, "i, kind, level, title, path", HEADS).withColumn("doc", F.lit(1))
    return h.select("i", "title", F.array_join(parsing.heading_path(F.col("level"), F.col("title"), order), ">").alias("path"))


NUMBERED = [(1, "1. 引言", "list_item", None), (2, "3.1 Introduction to retrieval systems", "heading", 2), (3, "1. a\n2. b", "list_item", None), (4, "2. 概述以及本系统的总体目标和主要组成部分的说明", "heading", 1)]


@case(values("doc_id, raw, kind, level", NUMBERED).replace("SELECT *", "SELECT doc_id, kind, level"))
def numbered_heading(s, sf):
    e = parsing.plain_elements(literal(s, "doc_id, raw, kind, level", NUMBERED), text_col="raw").where("element_index = 0")
    return e.select("doc_id", F.col("element_type").alias("kind"), F.col("heading_level").alias("level"))


MARKDOWN = "# Top\n\nPara one\nPara two\n- item a\n\n  - item b\n> q1\n> q2\n```python\n# not a heading\ncode\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n## Sub\nend\n```\nopen"
MARKDOWN_ROWS = [
    (0, "heading", "# Top", "Top"), (1, "paragraph", "Para one", ""), (2, "paragraph", "Para two", ""), (3, "list_item", "- item a", ""), (4, "list_item", "- item b", ""), (5, "blockquote", "> q1\nq2", ""),
    (6, "code_block", "```python\n# not a heading\ncode\n```", ""), (7, "table", "| a | b |\n|---|---|\n| 1 | 2 |", ""), (8, "heading", "## Sub", "Top>Sub"), (9, "paragraph", "end", ""), (10, "paragraph", "```", ""), (11, "paragraph", "open", ""),
]


@case(values("element_index, element_type, raw_content, path", MARKDOWN_ROWS))
def parse_markdown_elements(s, sf):
    e = parsing.markdown_elements(literal(s, "doc_id, text", [(1, MARKDOWN)]))
    return e.select("element_index", "element_type", "raw_content", F.array_join("structure_path", ">").alias("path"))


MERGE = [(0, "heading", 2, 0), (1, "paragraph", None, 0), (2, "heading", 3, 0), (3, "list_item", None, 0), (4, "heading", 1, 1), (5, "paragraph", None, 1), (6, "code_block", None, 2), (7, "paragraph", None, 3), (8, "heading", 2, 4)]


@case("SELECT * FROM (VALUES (0, 'e0' || chr(10) || chr(10) || 'e1' || chr(10) || 'e2' || chr(10) || 'e3'), (4, 'e4' || chr(10) || chr(10) || 'e5'), (6, 'e6'), (7, 'e7'), (8, 'e8')) t(element_index, raw_content)")
def merge_headings(s, sf):
    e = literal(s, "element_index, element_type, heading_level, grp", MERGE).select(F.lit(1).alias("doc_id"), "element_index", "element_type", "heading_level", F.concat(F.lit("e"), F.col("element_index").cast("string")).alias("raw_content"), F.array().cast("array<string>").alias("structure_path"), F.lit(1.0).alias("parser_confidence"))
    return parsing.merge_headings(e).select("element_index", "raw_content")


@query(r"""WITH l AS (SELECT doc_id, i, parts[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), range(1, len(parts) + 1) r(i)
), p AS (SELECT *, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS INTEGER) AS position FROM l
), k AS (SELECT doc_id, position, CASE WHEN regexp_matches(line, '^#{1,6}\s+.+$') THEN 'heading' WHEN regexp_matches(line, '^(`{3,}|~{3,})') THEN 'code_block'
 WHEN regexp_matches(line, '^(\s*)([*+-]|[0-9]+\.)\s+') THEN 'list' WHEN regexp_matches(line, '^\s*\|.*\|\s*$') THEN 'table' END AS kind FROM p)
SELECT * FROM k WHERE kind IS NOT NULL""")
def boundaries(s, sf):
    return parsing.boundaries(d.table(s, sf, "documents")).select("doc_id", "position", "kind")


REGION = "array<struct<box:array<array<double>>,text:string,confidence:double>>"
REGIONS = "[" + ", ".join(f'{{"box": [[{x}, {y}], [{x2}, {y}], [{x2}, {y + 20}], [{x}, {y + 20}]], "text": "{t}", "confidence": {c}}}' for x, x2, y, t, c in ((10, 60, 10, "a", 0.98765), (100, 160, 12, "b", 1.5), (10, 60, 60, "c", 0.5), (100, 160, 58, "d", 0.4), (10, 60, 300, "e", 0.9))) + "]"


@case("SELECT * FROM (VALUES ('a', true, 0.988::DOUBLE), ('b', true, 1.0), ('c', true, 0.5), ('d', true, 0.4), ('e', false, 0.9)) t(text, in_table, confidence)")
def ocr_table(s, sf):
    """Recognised regions in order, and whether they lie in the table found among them."""
    r = s.range(1).select(F.from_json(F.lit(REGIONS), REGION).alias("r")).select(parsing.region_boxes(F.col("r")).alias("b")).select(parsing.region_table(F.col("b")).alias("t"), F.explode("b").alias("r"))
    return r.select("r.text", parsing.inside(F.col("r"), F.col("t")).alias("in_table"), "r.confidence")


# ---------------------------------------------------------------- chunking


FIXED_SQL = rf"""WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split(trim(regexp_replace(text, '{SP}+', ' ', 'g'), ' '), ' '), lambda x: x <> '') AS ws FROM documents
), e AS (SELECT doc_id, i, sum(length(ws[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM w, range(1, len(ws) + 1) r(i)
), c AS (SELECT doc_id, list(upto ORDER BY i) AS cum FROM e GROUP BY doc_id
), f AS (SELECT w.doc_id, ws, cum FROM w JOIN c ON w.doc_id = c.doc_id
), k(doc_id, n, a, b) AS (
  SELECT doc_id, 0, 1, greatest(1, len(list_filter(cum, lambda x: x <= 500))) FROM f
  UNION ALL
  SELECT f.doc_id, n + 1, b + 1, greatest(b + 1, len(list_filter(cum, lambda x: x <= cum[b] + 500))) FROM k JOIN f ON k.doc_id = f.doc_id WHERE b < len(cum)
)
SELECT k.doc_id, CAST(n AS INTEGER) AS chunk_index, md5(array_to_string(ws[a:b], ' ')) AS digest FROM k JOIN f ON k.doc_id = f.doc_id"""


@query(FIXED_SQL)
def chunk_fixed(s, sf):
    return d.table(s, sf, "documents").select("doc_id", F.posexplode(chunk.fixed_size(F.col("text"))).alias("chunk_index", "t")).select("doc_id", "chunk_index", F.md5("t").alias("digest"))


@query()
def chunk_paragraph(s, sf):
    return d.table(s, sf, "documents").select("doc_id", F.posexplode(chunk.paragraph(F.col("text"))).alias("chunk_index", "t")).select("doc_id", "chunk_index", F.md5("t").alias("digest"))


@query(r"""WITH r AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS rows FROM documents WHERE regexp_matches(text, '(?m)^\s*\|'))
SELECT doc_id, CAST(i // 20 AS INTEGER) AS chunk_index, md5(array_to_string(rows[i + 1:i + 20], chr(10))) AS digest FROM r, range(0, greatest(len(rows), 1), 20) t(i)""")
def chunk_table(s, sf):
    t = d.table(s, sf, "documents").where(F.col("text").rlike(rf"(?m)^{SP}*\|"))
    return t.select("doc_id", F.posexplode(chunk.table(F.col("text"))).alias("chunk_index", "t")).select("doc_id", "chunk_index", F.md5("t").alias("digest"))


CHUNK_CASES = [(1, "aa bbb cccc dd eeeee f", "aa bbb|cccc dd|eeeee f"), (2, "abcdefghijkl x y", "abcdefghijkl|x y"), (3, "", "")]


@case(values("id, raw, chunks", CHUNK_CASES).replace("SELECT *", "SELECT id, chunks"))
def chunk_fixed_cases(s, sf):
    return literal(s, "id, raw, chunks", CHUNK_CASES).select("id", F.array_join(chunk.fixed_size(F.col("raw"), 8), "|").alias("chunks"))


SENTENCES = [(1, "x!! Y. z", "x!!| Y. z"), (2, "A. B! c? d", "A.| B!| c? d"), (3, "没有空格。的中文！句子", "没有空格。的中文！句子"), (4, "one", "one")]


@case(values("id, raw, parts", SENTENCES).replace("SELECT *", "SELECT id, parts"))
def sentence_cases(s, sf):
    return literal(s, "id, raw, parts", SENTENCES).select("id", F.array_join(chunk.sentences(F.col("raw")), "|").alias("parts"))


@query()
def chunk_code(s, sf):
    """Every document as if it were a code block."""
    return d.table(s, sf, "documents").select("doc_id", F.posexplode(chunk.code(F.col("text"))).alias("chunk_index", "t")).select("doc_id", "chunk_index", F.md5("t").alias("digest"))


@query("""WITH c AS (SELECT doc_id, i, substr(text, i * 500 + 1, 500) AS t, CAST(ceil(length(text) / 500) AS BIGINT) AS n FROM documents, range(0, CAST(ceil(length(text) / 500) AS BIGINT)) r(i))
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, md5(coalesce(right(lag(t) OVER w, 50), '')) AS prefix, md5(CASE WHEN i = 0 THEN '' ELSE coalesce(left(lead(t) OVER w, 50), '') END) AS suffix
FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)""")
def chunk_overlap_simple(s, sf):
    """Overlaps of slices of 500 characters, of all documents."""
    c = d.table(s, sf, "documents").select("doc_id", F.posexplode(chunk.slices(F.col("text"), 500)).alias("chunk_index", "t"))
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    prefix = F.coalesce(F.right(F.lag("t").over(w), F.lit(50)), F.lit(""))
    suffix = F.when(F.col("chunk_index") == 0, "").otherwise(F.coalesce(F.left(F.lead("t").over(w), F.lit(50)), F.lit("")))
    return c.select("doc_id", "chunk_index", F.md5(prefix).alias("prefix"), F.md5(suffix).alias("suffix"))


@query()
def chunk_overlap_semantic(s, sf):
    c = d.table(s, sf, "documents").select("doc_id", F.posexplode(chunk.slices(F.col("text"), 500)).alias("chunk_index", "t"))
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    return c.select("doc_id", "chunk_index", F.coalesce(chunk.semantic_tail(F.lag("t").over(w)), F.lit("")).alias("prefix"), F.when(F.col("chunk_index") == 0, "").otherwise(F.coalesce(chunk.semantic_head(F.lead("t").over(w)), F.lit(""))).alias("suffix"))


TYPES = [("blockquote", "code"), ("code_block", "code"), ("list_item", "list"), ("table", "table"), ("text_region", "text"), ("heading", "heading"), ("paragraph", "text")]


@case(values("kind, chunk_type", TYPES))
def chunk_types(s, sf):
    return literal(s, "kind, chunk_type", TYPES).select("kind", chunk.chunk_type(F.col("kind")).alias("chunk_type"))


@query()
def chunk_pipeline(s, sf):
    """All documents to chunks."""
    return ingest.chunks(d.table(s, sf, "documents")).select("doc_id", "chunk_index", "chunk_type", "has_overlap", F.md5("text").alias("digest"))


@query()
def chunk_type_hist(s, sf):
    return ingest.chunks(d.table(s, sf, "documents")).groupBy("chunk_type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


@query()
def embed_chunks(s, sf):
    """Every chunk as a vector row, with the offline embedder."""
    c = ingest.chunks(d.table(s, sf, "documents"))
    rows = c.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("document_id"), "chunk_index", "text", embedding.hashed(32)(F.col("text")).alias("embedding"), "structure_path", F.array().cast("array<int>").alias("bbox"), F.lit("plain_text").alias("source_type"), F.lit("u").alias("uploader_id"), F.lit("kb").alias("knowledge_base_id"))
    v = stores.vector_rows(rows, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return v.select("id", "document_id", "chunk_index", F.size("embedding").alias("dimension"), "source_info")


# ---------------------------------------------------------------- keyword search and fusion

HAN_RUNS = r"regexp_extract_all(lower(text), '[\x{4e00}-\x{9fff}]+')"
HAN_PAIRS = f"flatten(list_transform({HAN_RUNS}, lambda r: CASE WHEN length(r) < 2 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END))"
TOKENS = f"list_distinct(list_concat({HAN_PAIRS}, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+(?:[._-][a-z0-9]+)*'), lambda t: length(t) > 1 OR regexp_matches(t, '^[0-9]$'))))"
BM25_SQL = f"""tok AS MATERIALIZED (SELECT doc_id AS id, {TOKENS} AS t FROM documents
), post AS MATERIALIZED (SELECT id, len(t) AS dl, unnest(t) AS token FROM tok WHERE len(t) > 0
), df AS MATERIALIZED (SELECT token, count(*) AS df FROM post GROUP BY token
), tot AS MATERIALIZED (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok WHERE len(t) > 0
), raw AS MATERIALIZED (SELECT token, df, ln((n - df + 0.5) / (df + 0.5)) AS raw, avgdl FROM df, tot
), mean AS MATERIALIZED (SELECT avg(raw) AS mean FROM raw
), idf AS MATERIALIZED (SELECT token, df, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf, avgdl FROM raw, mean)"""
BM25_HITS = BM25_SQL + f""", qt AS (SELECT item_id AS query_id, unnest({TOKENS}) AS token FROM benchmark
), sc AS (SELECT query_id, id, round(sum(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN idf USING (token) JOIN post USING (token) GROUP BY query_id, id
), kw AS (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM sc)"""


@query("WITH " + BM25_SQL + " SELECT token, df, round(idf, 6) AS idf FROM idf")
def bm25_idf(s, sf):
    return ranking.idf(ranking.statistics(d.corpus(s, sf))).select("token", "df", F.round("idf", 6).alias("idf"))


@query("WITH " + BM25_HITS + " SELECT query_id, id, score, rank FROM kw WHERE rank <= 8 AND score > 0")
def bm25_topk(s, sf):
    """Eight best documents for every benchmark item."""
    return keyword_index.bm25(d.items(s, sf), d.corpus(s, sf))


@query(f"""SELECT doc_id, CAST(len(t) AS INTEGER) AS n, md5(array_to_string(list_sort(t), ' ')) AS digest FROM (SELECT doc_id, {TOKENS} AS t FROM documents)""")
def tokenize(s, sf):
    t = understanding.tokens(F.col("text"))
    return d.table(s, sf, "documents").select("doc_id", F.size(t).alias("n"), F.md5(F.array_join(F.array_sort(t), " ")).alias("digest"))


HYBRID = BM25_SQL + f""", vectors AS ({d.SQL["vectors"]}), qs AS (SELECT v.id AS query_id, text FROM vectors v JOIN documents ON doc_id = v.id WHERE v.id % 50 = 0
), qt AS (SELECT query_id, unnest({TOKENS}) AS token FROM qs
), sc AS (SELECT query_id, id, round(sum(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN idf USING (token) JOIN post USING (token) GROUP BY query_id, id
), kw AS (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM sc
), m AS (SELECT q.id AS query_id, v.id, {DIST} AS dist FROM vectors q JOIN vectors v ON true WHERE q.id % 50 = 0
), v AS (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS INTEGER) AS rank FROM m
), un AS (SELECT query_id, id, 0 AS source, rank, 1.0 / (60 + rank) AS part FROM v WHERE rank <= 8
  UNION ALL SELECT query_id, id, 1, rank, 0.8 / (60 + rank) FROM kw WHERE rank <= 8 AND score > 0
), su AS (SELECT query_id, id, round(CAST(sum(part) AS DOUBLE), 9) AS score, min(source * 1000 + rank) AS seen, max(CASE WHEN source = 0 THEN rank END) AS vector_rank, max(CASE WHEN source = 1 THEN rank END) AS keyword_rank FROM un GROUP BY query_id, id
), fu AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS INTEGER) AS rank FROM su)"""


@query("WITH " + HYBRID + " SELECT query_id, id, score, vector_rank, keyword_rank, rank FROM fu WHERE rank <= 8")
def rrf_fusion(s, sf):
    """Vector hits and keyword hits of the same queries: a vector and the document with its id."""
    q, docs = d.vector_queries(s, sf), d.corpus(s, sf)
    asked = q.select("query_id").join(docs.select(F.col("id").alias("query_id"), F.col("text").alias("question")), "query_id")
    return ranking.fuse(vector.nearest(q, d.vectors(s, sf), by=None), keyword_index.bm25(asked, docs))


def _keyed(df: DataFrame) -> DataFrame:
    """Hits as chunks: a document is chunk id % 100 of document id // 100."""
    return df.select("query_id", F.floor(F.col("id") / 100).alias("document_id"), (F.col("id") % 100).alias("chunk_index"), "score", "rank")


@query("WITH " + BM25_HITS + """, h AS (SELECT query_id, id // 100 AS document_id, id % 100 AS chunk_index, score, rank FROM kw WHERE rank <= 8 AND score > 0
), st AS (SELECT doc_id // 100 AS document_id, doc_id % 100 AS chunk_index FROM documents
), nb AS (SELECT h.query_id, h.document_id, h.chunk_index + o AS chunk_index, h.score, h.rank FROM h, (VALUES (-1), (0), (1)) x(o) WHERE EXISTS (SELECT 1 FROM st WHERE st.document_id = h.document_id AND st.chunk_index = h.chunk_index + o)
), nw AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id, chunk_index ORDER BY rank) AS n FROM nb WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = nb.query_id AND h.document_id = nb.document_id AND h.chunk_index = nb.chunk_index)
), ad AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_index) AS k FROM nw WHERE n = 1)
SELECT query_id, document_id, chunk_index, round(score, 6) AS score, 'hit' AS retriever FROM h
UNION ALL SELECT query_id, document_id, chunk_index, round(greatest(score * 0.85, 1e-6), 6), 'expanded' FROM ad WHERE k <= 4""")
def neighbor_expand(s, sf):
    c = d.corpus(s, sf)
    store = c.select(F.floor(F.col("id") / 100).alias("document_id"), (F.col("id") % 100).alias("chunk_index"))
    out = ranking.with_neighbours(_keyed(keyword_index.bm25(d.items(s, sf), c)), store)
    return out.select("query_id", "document_id", "chunk_index", F.round("score", 6).alias("score"), "retriever")


def _any_sql(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


NUMBERED_SQL, YEAR_SQL = r"'[0-9]+\.\s+\S+'", "'[0-9]{4}年'"


@query("WITH " + BM25_HITS + rf""", h AS (SELECT kw.query_id, kw.id, kw.rank, b.text AS question, coalesce(o.text, '') AS text, coalesce(source, '') AS source_info, CAST(kw.id % 1600 AS DOUBLE) AS y
  FROM kw JOIN documents o ON doc_id = kw.id JOIN benchmark b ON item_id = kw.query_id WHERE kw.rank <= 8 AND kw.score > 0
), f AS (SELECT query_id, id, rank, CASE WHEN y = 0 THEN 0.5 WHEN {_any_sql("question", ranking.TEMPORAL_QUERY)} OR NOT {_any_sql("question", ranking.TECH_QUERY)} THEN 1 - least(y / 1500, 1.0) ELSE least(y / 1500, 1.0) END AS pos,
  CASE WHEN source_info <> '' THEN regexp_matches(source_info, {NUMBERED_SQL}) OR regexp_matches(text, {YEAR_SQL}) ELSE regexp_matches(text, {NUMBERED_SQL}) OR regexp_matches(text, {YEAR_SQL}) OR {_any_sql("text", ranking.TECH)} END AS spec,
  greatest(CASE WHEN source_info = '' THEN 0 ELSE len(string_split(source_info, ' > ')) END, CASE WHEN regexp_matches(text, '^#+\s+') THEN list_max(list_transform(regexp_extract_all(text, '(?m)^(#+)\s+', 1), lambda x: length(x)))
    WHEN regexp_matches(text, {NUMBERED_SQL}) THEN 1 WHEN regexp_matches(text, '[0-9]+\.[0-9]+\s+') THEN 2 ELSE 0 END) AS lvl,
  {" + ".join(f"CAST(contains(text, '{w}') AS INTEGER)" for w in ranking.TECH)} AS tech FROM h
), o AS (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos DESC, spec DESC, lvl DESC, tech DESC, rank) AS INTEGER) AS new_rank FROM f) SELECT * FROM o WHERE new_rank <= 8""")
def rerank_structural(s, sf):
    """BM25 hits reranked with their source and a position derived from their id."""
    hits = keyword_index.bm25(d.items(s, sf), d.corpus(s, sf)).join(d.items(s, sf), "query_id")
    docs = d.table(s, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("source_info"), (F.col("doc_id") % 1600).cast("double").alias("y_top"))
    return ranking.rerank(hits.join(docs, "id")).select("query_id", "id", "new_rank")


# ---------------------------------------------------------------- query understanding

ASKED = [(1, "什么是机器学习？", "fact_qa", 0.7, 0.35, "zh"), (2, "深度学习和机器学习有什么区别？", "compare", 2.0, 1.0, "zh"), (3, "", "unknown", 0.0, 0.0, "unknown"), (4, "how to setup the guide", "howto", 5.4, 1.0, "en"), (5, "RAG是什么", "definition", 1.6, 0.8, "mixed"), (6, "12345678901", "fact_qa", 0.3, 0.2, "unknown"), (7, None, "unknown", 0.0, 0.0, "unknown")]


@case(values("id, q, intent, score, confidence, language", ASKED).replace("SELECT *", "SELECT id, intent, CAST(score AS DOUBLE) AS score, CAST(confidence AS DOUBLE) AS confidence, language"))
def intent_cases(s, sf):
    i = understanding.intent(F.col("q"))
    return literal(s, "id, q, intent, score, confidence, language", ASKED).select("id", i.alias("i")).select("id", "i.intent", "i.score", F.round("i.confidence", 6).alias("confidence"), "i.language")


def intent_scores(source: str, keys: str, where: str) -> str:
    """SQL of every intent's score (and the sum of the first, f0) of the texts of a table."""
    def hits(name: str) -> str:
        parts = [f"CASE WHEN contains(lower(q), '{k.replace(chr(39), chr(39) * 2)}') THEN {w} ELSE 0 END" for i, w, ks in understanding.LEXICON if i == name for k in ks]
        return " + ".join(parts) or "0"

    names = understanding.INTENTS
    base = ", ".join(f"{hits(n)} AS s{i}" for i, n in enumerate(names))
    total = " + ".join(f"s{i}" for i in range(len(names)))
    words = " OR ".join(f"contains(lower(q), '{w}')" for w in understanding.QUESTION_WORDS)
    short = {n: "".join(dict.fromkeys(c)) for n, c in understanding.SHORT}
    add = {n: f" + CASE WHEN length(q) <= 5 AND regexp_matches(q, '[{c}]') THEN 0.3 ELSE 0 END" for n, c in short.items()}
    final = ", ".join((f"(CASE WHEN tot = 0 AND ({words}) THEN 0.5 WHEN tot = 0 AND length(q) > 5 THEN 0.3 ELSE s0 + x END) + CASE WHEN length(q) <= 5 AND regexp_matches(q, '[0-9]') THEN 0.2 ELSE 0 END" if n == "fact_qa" else f"s{i}") + add.get(n, "") + f" AS f{i}" for i, n in enumerate(names))
    ranked = " UNION ALL ".join(f"SELECT {keys}, '{n}' AS intent, {i} AS ord, round(CAST(f{i} AS DOUBLE), 6) AS score, greatest({', '.join(f'f{k}' for k in range(len(names)))}) AS f0 FROM c" for i, n in enumerate(names))
    return rf"""WITH u AS (SELECT {keys}, regexp_replace(text, '^{SP}+|{SP}+$', '', 'g') AS q FROM {source} WHERE {where}
), a AS (SELECT {keys}, q, {base}, CASE WHEN length(q) <= 10 THEN 0.4 ELSE 0 END + CASE WHEN regexp_matches(q, '[?？]') THEN 0.3 ELSE 0 END AS x FROM u
), b AS (SELECT *, {total} + x AS tot FROM a), c AS (SELECT {keys}, {final} FROM b) {ranked}"""


INTENT_SQL = f"""WITH r AS ({intent_scores("conversations", "conv_id, turn", "role = 'user'")}), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, ord) AS n FROM r)
SELECT conv_id, turn, intent, score, round(least(1.0, greatest(0.2, score / 2)), 6) AS confidence FROM o WHERE n = 1"""


@query(INTENT_SQL)
def intent_classify(s, sf):
    """Intent of every user turn."""
    t = d.table(s, sf, "conversations").where("role = 'user'").select("conv_id", "turn", understanding.intent(F.col("text")).alias("i"))
    return t.select("conv_id", "turn", "i.intent", "i.score", F.round("i.confidence", 6).alias("confidence"))


@query(r"""SELECT doc_id, CASE WHEN zh AND en THEN 'mixed' WHEN zh THEN 'zh' WHEN en THEN 'en' ELSE 'unknown' END AS language FROM (
SELECT doc_id, regexp_matches(text, '[\x{4e00}-\x{9fff}]') AS zh, regexp_matches(text, '[a-zA-Z]') AS en FROM documents)""")
def detect_language(s, sf):
    return d.table(s, sf, "documents").select("doc_id", understanding.language(F.col("text")).alias("language"))


EXPAND = [(1, "API", "应用程序编程接口 API是什么 API有什么 API如何 API的作用", 0.7), (2, "前端", "前端 前端技术", 0.5), (3, "什么意思", "什么意思 XX的意思".replace("XX", "什么XX"), 0.5), (4, "how are things going", "how are things going", 0.3), (5, "", "", 0.0)]


@case(values("id, q, expanded, confidence", EXPAND).replace("SELECT *", "SELECT id, expanded, CAST(confidence AS DOUBLE) AS confidence"))
def query_expand(s, sf):
    return literal(s, "id, q, expanded, confidence", EXPAND).select("id", understanding.expand(F.col("q")).alias("e")).select("id", "e.expanded", "e.confidence")


REWRITE = [(1, "请问  API，怎么用？", "API,怎么用? (kb:k1)", "normalize_whitespace,normalize_punctuation,remove_fillers,append_hints"), (2, "RAG", "RAG (kb:k1)", "append_hints,synonym_expansion"), (3, "", "", "")]


@case(values("id, q, rewritten, rules", REWRITE).replace("SELECT *", "SELECT id, rewritten, rules"))
def query_rewrite(s, sf):
    r = literal(s, "id, q, rewritten, rules", REWRITE).select("id", understanding.rewrite(F.col("q"), F.lit("k1")).alias("r"))
    return r.select("id", "r.rewritten", F.array_join("r.rules", ",").alias("rules"))


SYN = [(1, "RAG原理", "检索增强生成原理|Retrieval Augmented Generation原理"), (2, "向量", "embedding"), (3, "plain", ""), (4, "chroma", "ChromaDB")]


@case(values("id, q, variants", SYN).replace("SELECT *", "SELECT id, variants"))
def synonyms(s, sf):
    return literal(s, "id, q, variants", SYN).select("id", F.array_join(understanding.synonyms(F.col("q")), "|").alias("variants"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 20")
def conversation_window(s, sf):
    """The last twenty turns of every conversation."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return d.table(s, sf, "conversations").withColumn("n", n).where("n <= 20").select("conv_id", "turn", "role")


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
SELECT conv_id, md5(right('[kb=' || conv_id % 10 || ']' || chr(10) || string_agg(CASE WHEN role = 'user' THEN 'U: ' ELSE 'A: ' END || left(text, 160), chr(10) ORDER BY turn), 800)) AS hint FROM l WHERE n <= 6 GROUP BY conv_id""")
def context_hint(s, sf):
    """The last six turns, cut, as a hint of at most 800 characters."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    line = F.concat(F.when(F.col("role") == "user", "U: ").otherwise("A: "), F.left("text", F.lit(160)))
    g = d.table(s, sf, "conversations").withColumn("n", n).where("n <= 6").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("t"))
    hint = F.concat(F.lit("[kb="), (F.col("conv_id") % 10).cast("string"), F.lit("]\n"), F.col("t"))
    return g.select("conv_id", F.md5(F.right(hint, F.lit(800))).alias("hint"))


@query("SELECT conv_id, arg_max(text, turn) AS question FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY conv_id")
def last_user_query(s, sf):
    return d.table(s, sf, "conversations").where("role = 'user' AND trim(text) <> ''").groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"))


# ---------------------------------------------------------------- prompts and answers

BLOCK = "'[' || n || ']' || chr(10) || '来源文档: ' || document_id || chr(10) || '分块序号: ' || chunk_index || chr(10) || '检索方式: keyword' || chr(10) || '内容:' || chr(10) || trim(text, ' ')"
KEPT = BM25_HITS + f""", h AS (SELECT kw.query_id, kw.id, kw.rank AS n, kw.id // 100 AS document_id, kw.id % 100 AS chunk_index, text FROM kw JOIN documents ON doc_id = kw.id WHERE rank <= 8 AND score > 0
), bl AS (SELECT *, {BLOCK} AS block FROM h
), us AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY n) AS used FROM bl
), kept AS (SELECT * FROM us WHERE used <= 5000)"""


def _context_hits(s, sf) -> DataFrame:
    hits = keyword_index.bm25(d.items(s, sf), d.corpus(s, sf))
    h = hits.join(d.corpus(s, sf), "id")
    return h.select("query_id", "rank", "id", F.floor(F.col("id") / 100).alias("document_id"), (F.col("id") % 100).alias("chunk_index"), F.lit("keyword").alias("retriever"), F.lit(None).cast("string").alias("source_info"), "text")


@query("WITH " + KEPT + " SELECT query_id, id, CAST(n AS INTEGER) AS n, CAST(used AS BIGINT) AS used FROM kept")
def prompt_budget(s, sf):
    return prompting.budgeted(_context_hits(s, sf)).select("query_id", "id", "n", "used")


@query("WITH " + KEPT + " SELECT query_id, md5(string_agg(block, chr(10) || chr(10) ORDER BY n)) AS context, count(*) AS n_citations FROM kept GROUP BY query_id")
def prompt_context(s, sf):
    return prompting.contexts(prompting.budgeted(_context_hits(s, sf))).select("query_id", F.md5("context").alias("context"), "n_citations")


@query("WITH " + KEPT + """, p AS (SELECT query_id, document_id, min(n) AS f, count(*) AS k, string_agg(n, ', ' ORDER BY n) AS ns FROM kept GROUP BY query_id, document_id)
SELECT query_id, md5('【参考资料说明】' || chr(10) || '以下参考资料中，相同文档ID的多个条目来自同一个文档的不同部分。' || chr(10) || '请根据内容相关性选择合适的引用编号。' || chr(10) ||
string_agg(CASE WHEN k > 1 THEN chr(10) || '- 文档（来源: 未知来源）包含分块: [' || ns || ']' ELSE '' END, '' ORDER BY f)) AS notice FROM p GROUP BY query_id""")
def doc_source_notice(s, sf):
    return prompting.contexts(prompting.budgeted(_context_hits(s, sf))).select("query_id", F.md5("notice").alias("notice"))


ANSWERS = [(1, "x[1] y[3]", 2, "1,3", "2", False), (2, "none", 2, "", "1,2", False), (3, "[2] and [1] and [2]", 2, "1,2", "", True), (4, None, 1, "", "1", False)]


@case(values("id, a, n, used, unused, valid", ANSWERS).replace("SELECT *", "SELECT id, used, unused, valid"))
def citation_validate(s, sf):
    c = answer.citation_check(F.col("a"), F.sequence(F.lit(1), F.col("n")))
    r = literal(s, "id, a, n, used, unused, valid", ANSWERS).select("id", c.alias("c"))
    return r.select("id", F.array_join(F.col("c.used").cast("array<string>"), ",").alias("used"), F.array_join(F.col("c.unused").cast("array<string>"), ",").alias("unused"), "c.valid")


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '\[(\d+)\]', 1), lambda x: TRY_CAST(x AS INTEGER)))), ',') AS used FROM documents""")
def citations_used(s, sf):
    return d.table(s, sf, "documents").select("doc_id", F.array_join(answer.used_citations(F.col("text")).cast("array<string>"), ",").alias("used"))


QUALITY = [(1, "123456789012345678901234567[1]", 2, 1.0, 0.5, 0.35, "回答可能不够完整"), (2, "short", 3, 0.3, 0.0, 0.016667, "引用使用较少；回答可能不够完整"), (3, "", 1, 0.0, None, None, "回答为空")]


@case(values("id, a, n, grounded, coverage, completeness, comments", QUALITY).replace("SELECT *", "SELECT id, CAST(grounded AS DOUBLE) AS grounded, CAST(coverage AS DOUBLE) AS coverage, CAST(completeness AS DOUBLE) AS completeness, comments"))
def answer_quality(s, sf):
    return literal(s, "id, a, n, grounded, coverage, completeness, comments", QUALITY).select("id", answer.quality(F.col("a"), F.col("n")).alias("q")).select("id", "q.grounded", "q.coverage", "q.completeness", "q.comments")


SSE = [(1, 'data: {"choices":[{"delta":{"content":"hi"}}]}', "hi"), (2, "data: [DONE]", None), (3, ": ping", None)]


@case(values("id, line, delta", SSE).replace("SELECT *", "SELECT id, delta"))
def stream_deltas(s, sf):
    return literal(s, "id, line, delta", SSE).select("id", answer.stream_delta(F.col("line")).alias("delta"))


ASK = d.with_tables("vectors") + f""", m AS (SELECT q.id AS query_id, v.id, v.kb, {DIST} AS dist FROM vectors q JOIN vectors v ON q.kb = v.kb WHERE q.id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM m
), h AS (SELECT query_id, id, rank, text FROM r JOIN documents ON doc_id = id WHERE rank <= 8 AND trim(text) <> ''
), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM h
), a AS (SELECT query_id, string_agg(text, ' ' ORDER BY k) AS t FROM n WHERE k <= 3 GROUP BY query_id)
SELECT q.id AS query_id, CASE WHEN t IS NULL THEN {sql_text(answer.NOT_FOUND)} ELSE {sql_text(answer.FOUND[0])} || CASE WHEN length(t) > 200 THEN left(t, 200) || '...' ELSE t END || {sql_text(answer.FOUND[1])} END AS answer
FROM vectors q LEFT JOIN a ON a.query_id = q.id WHERE q.id % 50 = 0"""


@query(ASK)
def ask_offline(s, sf):
    """Questions (vectors) to answers: search in the knowledge base, texts of the hits, budget, offline answer."""
    hits = vector.nearest(d.vector_queries(s, sf), d.vectors(s, sf)).join(d.corpus(s, sf), "id").where(F.trim("text") != "")
    order = Window.partitionBy("query_id").orderBy("rank")
    return prompting.offline_answer(hits.withColumn("rank", F.row_number().over(order)), asked=d.vector_queries(s, sf))


# ---------------------------------------------------------------- metadata

@query(d.with_tables("users", "groups", "members") + " SELECT g.id, g.name, count(*) AS n_members, string_agg(coalesce(u.name, '') || ':' || role, ',' ORDER BY user_id) AS members FROM groups g JOIN members m ON m.group_id = g.id LEFT JOIN users u ON u.id = m.user_id GROUP BY g.id, g.name")
def group_list(s, sf):
    return metadata.group_list(d.groups(s, sf), d.members(s, sf), d.users(s, sf))


@query(d.with_tables("members", "files") + " SELECT id, group_id, name, size FROM files WHERE group_id IN (SELECT group_id FROM members WHERE user_id = 7)")
def file_list(s, sf):
    return metadata.visible(d.files(s, sf), d.members(s, sf), F.lit(7)).select("id", "group_id", "name", "size")


@query(d.with_tables("members", "files") + " SELECT f.uploader_id AS user_id, f.id AS file_id, m.user_id IS NOT NULL AS allowed FROM files f LEFT JOIN members m ON m.group_id = f.group_id AND m.user_id = f.uploader_id")
def file_download_acl(s, sf):
    f = d.files(s, sf)
    return metadata.file_access(f, d.members(s, sf), f.select(F.col("uploader_id").alias("user_id"), F.col("id").alias("file_id")))


@query(d.with_tables("members", "records") + " SELECT r.user_id + 1 AS user_id, r.id AS qa_id, m.user_id IS NOT NULL AS allowed FROM records r LEFT JOIN members m ON m.group_id = r.group_id AND m.user_id = r.user_id + 1")
def member_acl(s, sf):
    r = d.records(s, sf)
    return metadata.record_access(r, d.members(s, sf), r.select((F.col("user_id") + 1).alias("user_id"), F.col("id").alias("qa_id")))


@query(d.with_tables("favorites") + ", p AS (SELECT * FROM favorites WHERE user_id = 1 ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 0) SELECT p.id, p.qa_id, question FROM p LEFT JOIN records r ON r.id = p.qa_id")
def favorites_page(s, sf):
    return metadata.favorites_page(d.favorites(s, sf), d.records(s, sf), F.lit(1))


@query(d.with_tables("records") + " SELECT id, question FROM records ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 10")
def qa_history_page(s, sf):
    return metadata.page(d.records(s, sf), 10, 50).select("id", "question")


@query(d.with_tables("records") + " SELECT id, '# 问题' || chr(10) || chr(10) || question || chr(10) || chr(10) || '# 回答' || chr(10) || chr(10) || answer || chr(10) AS markdown, '问题: ' || question || chr(10) || '回答: ' || answer AS text FROM records")
def export_qa(s, sf):
    return metadata.export(d.records(s, sf)).select("id", "markdown", "text")


@query(d.with_tables("records") + """ SELECT id, json_extract_string(j, '$.question') AS question, json_extract_string(j, '$.answer') AS answer, CAST(json_extract(j, '$.id') AS BIGINT) AS json_id FROM (SELECT id, to_json({'id': id, 'question': question, 'answer': answer}) AS j FROM records)""")
def export_qa_json(s, sf):
    return metadata.export(d.records(s, sf)).select("id", F.get_json_object("json", "$.question").alias("question"), F.get_json_object("json", "$.answer").alias("answer"), F.get_json_object("json", "$.id").cast("long").alias("json_id"))


@query(d.with_tables("members") + """, w AS (SELECT c_custkey AS actor_id, c_nationkey AS group_id, c_custkey % 1000 + 1 AS user_id FROM customer), ok AS (SELECT DISTINCT w.group_id, w.user_id FROM w JOIN members a ON a.group_id = w.group_id AND a.user_id = w.actor_id AND a.role = 'admin'
), n AS (SELECT * FROM ok WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.group_id = ok.group_id AND m.user_id = ok.user_id)) SELECT group_id, user_id, role FROM members UNION ALL SELECT group_id, user_id, 'member' FROM n""")
def member_add(s, sf):
    w = d.table(s, sf, "customer").select(F.col("c_custkey").alias("actor_id"), F.col("c_nationkey").alias("group_id"), (F.col("c_custkey") % 1000 + 1).alias("user_id"))
    return metadata.added_members(d.members(s, sf), w)


@query(d.with_tables("groups", "members") + """, w AS (SELECT c_custkey AS actor_id, c_nationkey AS group_id, c_custkey + 25 AS user_id FROM customer), ok AS (SELECT w.* FROM w JOIN members a ON a.group_id = w.group_id AND a.user_id = w.actor_id AND a.role = 'admin' JOIN groups g ON g.id = w.group_id WHERE w.user_id <> w.actor_id AND g.owner_id <> w.user_id)
SELECT group_id, user_id, role FROM members m WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.group_id = m.group_id AND ok.user_id = m.user_id)""")
def member_remove(s, sf):
    w = d.table(s, sf, "customer").select(F.col("c_custkey").alias("actor_id"), F.col("c_nationkey").alias("group_id"), (F.col("c_custkey") + 25).alias("user_id"))
    return metadata.removed_members(d.members(s, sf), d.groups(s, sf), w).select("group_id", "user_id", "role")


@query(d.with_tables("members") + " SELECT m.group_id, m.user_id, CASE WHEN a.user_id IS NOT NULL THEN 'member' ELSE m.role END AS role FROM members m LEFT JOIN members a ON a.group_id = m.group_id AND a.user_id = m.user_id AND a.role = 'admin'")
def member_role(s, sf):
    w = d.members(s, sf).select(F.col("user_id").alias("actor_id"), "group_id", "user_id", F.lit("member").alias("new_role"))
    return metadata.changed_roles(d.members(s, sf), w)


@query(d.with_tables("members", "files") + " SELECT f.name, CASE WHEN size > 52428800 THEN 'too_large' WHEN a.user_id IS NOT NULL THEN 'accepted' ELSE 'forbidden' END AS verdict FROM files f LEFT JOIN members a ON a.group_id = f.group_id AND a.user_id = f.uploader_id AND a.role = 'admin'")
def file_upload(s, sf):
    return metadata.accepted_uploads(d.files(s, sf).withColumnRenamed("uploader_id", "user_id"), d.members(s, sf)).select("name", "verdict")


@query(d.with_tables("members", "favorites") + """, w AS (SELECT user_id, id AS qa_id FROM records), ok AS (SELECT DISTINCT user_id, qa_id FROM w WHERE NOT EXISTS (SELECT 1 FROM favorites f WHERE f.user_id = w.user_id AND f.qa_id = w.qa_id))
SELECT user_id, qa_id FROM favorites UNION ALL SELECT user_id, qa_id FROM ok""")
def favorite_add(s, sf):
    r = d.records(s, sf)
    return metadata.added_favorites(d.favorites(s, sf), r, d.members(s, sf), r.select("user_id", F.col("id").alias("qa_id")))


@query(d.with_tables("favorites") + " SELECT id, qa_id FROM favorites WHERE NOT (user_id = 1 AND created_at < 43200)")
def favorite_delete(s, sf):
    f = d.favorites(s, sf)
    return stores.without(f, f.where("user_id = 1 AND created_at < 43200")).select("id", "qa_id")


@query(d.with_tables("members", "records") + " SELECT r.id, r.user_id, CAST(coalesce(m.group_id, r.group_id) AS BIGINT) AS group_id FROM records r LEFT JOIN members m ON m.user_id = r.user_id")
def share_to_group(s, sf):
    r, m = d.records(s, sf), d.members(s, sf)
    return metadata.shared(r, m, r.select("user_id", F.col("id").alias("qa_id")).join(m.select("user_id", F.col("group_id").alias("to_group")), "user_id"))


@query(d.with_tables("groups") + " SELECT n_nationkey AS ask_id, n_nationkey AS group_id FROM nation")
def knowledge_base(s, sf):
    n = d.table(s, sf, "nation")
    asks = n.select(F.col("n_nationkey").alias("ask_id"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey").cast("string")).otherwise(F.col("n_name")).alias("kb"))
    return metadata.knowledge_base(asks, d.groups(s, sf))


@query("SELECT o_orderkey AS task_id, CAST(row_number() OVER (ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS INTEGER) AS place FROM orders")
def priority_order(s, sf):
    """Tasks by priority and then time of submission: a total order by ranges, numbered in two steps."""
    o = d.table(s, sf, "orders").select(F.col("o_orderkey").alias("task_id"), "o_orderpriority", "o_orderdate")
    day = o.groupBy("o_orderpriority", "o_orderdate").agg(F.count("*").alias("n"))
    before = day.withColumn("before", F.sum("n").over(Window.orderBy("o_orderpriority", "o_orderdate")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("o_orderpriority", "o_orderdate").orderBy("task_id"))
    return o.withColumn("k", inside).join(before, ["o_orderpriority", "o_orderdate"]).select("task_id", (F.col("before") + F.col("k")).cast("int").alias("place"))


STORED = [(1, 0, "a.txt", "a.txt"), (1, 1, "a.txt", "a_1.txt"), (1, 2, "b", "b"), (1, 3, "b", "b_1"), (2, 0, "a.txt", "a.txt"), (2, 1, "123456789012345678901234567890123456_a.txt", "a_1.txt")]


@case(values("group_id, i, name, stored", STORED).replace("SELECT *", "SELECT group_id, i, stored"))
def stored_names(s, sf):
    return stores.clash_free(literal(s, "group_id, i, name, stored", STORED)).select("group_id", "i", "stored")


@query("SELECT DISTINCT id, text FROM (SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id + 1000000000, text FROM benchmark)")
def chunk_store_append(s, sf):
    """Documents and then benchmark items twice, each id kept once."""
    new = d.items(s, sf).select((F.col("query_id") + 1_000_000_000).alias("id"), F.col("question").alias("text"))
    return stores.appended(d.corpus(s, sf), new.unionByName(new))
