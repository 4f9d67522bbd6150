"""Further registered queries, over the driver's tables and texts derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.functions import answer, chunk, filetype, understanding
from quillstream.operators import completion, metadata, parsing, prompting, structure, vector
from quillstream.operators.templates import TEMPLATES
from quillstream.plans import derived as d
from quillstream.plans import ingest
from quillstream.plans import queries as q
from quillstream.plans.queries import KEPT, SP, query, sql_text
from quillstream.sources import scratch, stores
from quillstream.streaming import ingest as streaming

# ---------------------------------------------------------------- structure

LINES = rf"""l AS (SELECT doc_id, i, parts[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM marked), range(1, len(parts) + 1) r(i)
), ps AS (SELECT *, CAST(sum(length(line) + 1) OVER w - length(line) - 1 AS INTEGER) AS pos, regexp_replace(line, '{SP}', '', 'g') = '' AS blank FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), ln AS (SELECT *, coalesce(max(CASE WHEN NOT blank THEN pos + length(line) + 1 END) OVER w, 0) AS gap, i - 1 - coalesce(max(CASE WHEN NOT blank THEN i END) OVER w, 0) AS run, max(i) OVER (PARTITION BY doc_id) AS most
  FROM ps WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
BULLET = r"regexp_matches(line, '^(\s*)([*+-]|[0-9]+\.)\s+')"


@query(d.with_tables("marked") + ", " + LINES + rf""" SELECT doc_id, pos AS position, 'paragraph' AS kind FROM ln WHERE (NOT blank AND run >= CASE WHEN run = i - 1 THEN 2 ELSE 1 END) OR (blank AND i = most AND i > 1 AND run >= CASE WHEN run = i - 1 THEN 2 ELSE 1 END)
UNION ALL SELECT doc_id, gap, 'list' FROM ln WHERE {BULLET} UNION ALL SELECT doc_id, pos, 'section' FROM ln WHERE regexp_matches(line, '^( {{2,}}|\t+)') UNION ALL SELECT doc_id, pos, 'custom' FROM ln WHERE i > 1""")
def boundaries_generic(s, sf):
    """Boundaries of plain text in every marked document."""
    return structure.boundaries(d.marked(s, sf), "txt").select("doc_id", "position", "kind")


BOUNDS = rf"""bd AS (
  SELECT doc_id, pos AS position, 0 AS ord, 'heading' AS kind, pos + length(line) AS stop, length(regexp_extract(line, '^(#{{1,6}})\s+(.+)$', 1)) AS level, regexp_extract(line, '^(#{{1,6}})\s+(.+)$', 2) AS title FROM ln WHERE regexp_matches(line, '^#{{1,6}}\s+.+$')
  UNION ALL SELECT doc_id, pos, 1, 'code_block', pos + length(line), NULL, NULL FROM ln WHERE regexp_matches(line, '^(`{{3,}}|~{{3,}})')
  UNION ALL SELECT doc_id, gap, 2, 'list', pos + length(line), NULL, NULL FROM ln WHERE {BULLET}
  UNION ALL SELECT doc_id, gap, 3, 'table', pos + length(line), NULL, NULL FROM ln WHERE regexp_matches(line, '^\s*\|.*\|\s*$')
), hs AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS n FROM bd WHERE kind = 'heading'
), paths(doc_id, n, position, path) AS (
  SELECT doc_id, n, position, [repeat('#', level) || ' ' || title] FROM hs WHERE n = 1
  UNION ALL SELECT hs.doc_id, hs.n, hs.position, list_append(list_slice(path, 1, level - 1), repeat('#', level) || ' ' || title) FROM paths p JOIN hs ON hs.doc_id = p.doc_id AND hs.n = p.n + 1
), st AS (SELECT *, coalesce(lag(CASE WHEN kind = 'heading' THEN stop ELSE position END) OVER w, 0) AS start FROM bd WINDOW w AS (PARTITION BY doc_id ORDER BY position, ord)
), tx AS (SELECT st.*, text FROM st JOIN marked USING (doc_id)
), la AS (SELECT m.doc_id, max_by(CASE WHEN kind = 'heading' THEN stop ELSE position END, position * 10 + ord) AS start, any_value(text) AS text FROM bd JOIN marked m USING (doc_id) GROUP BY m.doc_id
), el AS (
  SELECT doc_id, position, ord, 0 AS part, start AS s, substr(text, start + 1, position - start) AS content, '' AS kind, 0.9::DOUBLE AS confidence FROM tx WHERE position > start
  UNION ALL SELECT doc_id, position, ord, 1, -1, substr(text, position + 1, stop - position), 'heading', 1.0 FROM tx WHERE kind = 'heading'
  UNION ALL SELECT doc_id, 2000000000, 0, 0, start, substr(text, start + 1), 'paragraph', 0.9 FROM la
  UNION ALL SELECT doc_id, 0, 0, 0, -1, text, 'paragraph', 1.0 FROM marked WHERE doc_id NOT IN (SELECT doc_id FROM bd)
), ke AS (SELECT *, CASE WHEN kind <> '' THEN kind WHEN contains(content, '```') OR contains(content, chr(10) || '    ') OR contains(content, chr(10) || chr(9)) THEN 'code_block'
    WHEN len(list_filter(string_split(content, chr(10)), lambda x: starts_with(ltrim(x), '|'))) > 1 THEN 'table' WHEN regexp_matches(content, '(?m)^\s*[*+-]\s+') OR regexp_matches(content, '(?m)^\s*[0-9]+\.\s+') THEN 'list_item' ELSE 'paragraph' END AS element_type
  FROM el WHERE confidence = 1 OR regexp_replace(content, '{SP}', '', 'g') <> ''
), pt AS (SELECT ke.*, (SELECT max_by(path, position) FROM paths p WHERE p.doc_id = ke.doc_id AND p.position <= ke.s) AS path FROM ke)"""


@query(d.with_tables("marked").replace("WITH", "WITH RECURSIVE", 1) + ", " + LINES + ", " + BOUNDS + """
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY position, ord, part) - 1 AS INTEGER) AS element_index, element_type, md5(content) AS digest, array_to_string(coalesce(path, []), ' > ') AS path, confidence FROM pt""")
def structured_elements(s, sf):
    """Every marked document cut at its Markdown boundaries."""
    e = structure.structured_elements(d.marked(s, sf))
    return e.select("doc_id", "element_index", "element_type", F.md5("raw_content").alias("digest"), F.array_join("structure_path", " > ").alias("path"), F.col("parser_confidence").alias("confidence"))


@query()
def chunk_structured(s, sf):
    """Every marked document to chunks of its structured elements."""
    return structure.chunked_by_structure(d.marked(s, sf)).select("doc_id", "chunk_index", "element_type", F.md5("text").alias("digest"))


MD_LINES = rf"""l AS (SELECT doc_id, i, parts[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM marked), range(1, len(parts) + 1) r(i)
), k AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}}\s+.+$') THEN 'heading' WHEN regexp_matches(line, '^(\s*)([*+-]|[0-9]+\.)\s+(.*)') THEN 'list_item' ELSE 'paragraph' END AS kind,
  length(regexp_extract(line, '^(#{{1,6}})\s+', 1)) AS level, regexp_extract(line, '^(#{{1,6}})\s+(.+)$', 2) AS title FROM l WHERE regexp_replace(line, '{SP}', '', 'g') <> ''
), el AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS idx, CASE WHEN kind = 'list_item' THEN regexp_replace(line, '^{SP}+|{SP}+$', '', 'g') ELSE line END AS content FROM k)"""


@query(d.with_tables("marked") + ", " + MD_LINES + """, hd AS (SELECT doc_id, i, level, title FROM el WHERE kind = 'heading'
), op AS (SELECT h.doc_id, h.i, string_agg(t.title, '>' ORDER BY t.i) AS path FROM hd h JOIN hd t ON t.doc_id = h.doc_id AND t.i <= h.i
  WHERE NOT EXISTS (SELECT 1 FROM hd u WHERE u.doc_id = h.doc_id AND u.i > t.i AND u.i <= h.i AND u.level <= t.level) GROUP BY h.doc_id, h.i)
SELECT el.doc_id, CAST(idx AS INTEGER) AS element_index, kind AS element_type, md5(content) AS digest, coalesce(path, '') AS path, CAST(CASE WHEN kind = 'heading' THEN level END AS INTEGER) AS level,
  CASE WHEN kind = 'heading' THEN regexp_replace(regexp_replace(regexp_replace(lower(title), '[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}\\s-]', '', 'g'), '[-\\s]+', '-', 'g'), '^-+|-+$', '', 'g') END AS heading_id
FROM el LEFT JOIN op ON op.doc_id = el.doc_id AND op.i = el.i""".replace("\\\\", "\\"))
def parse_markdown_documents(s, sf):
    """Every marked document through the Markdown parser: types, texts, paths and ids of headings."""
    e = parsing.markdown_elements(d.marked(s, sf))
    return e.select("doc_id", "element_index", "element_type", F.md5("raw_content").alias("digest"), F.array_join("structure_path", ">").alias("path"), F.col("heading_level").alias("level"), "heading_id")


@query(d.with_tables("marked") + ", " + MD_LINES + """, g AS (SELECT *, coalesce(min(CASE WHEN kind = 'heading' THEN level END) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 99) AS lowest FROM el
), n AS (SELECT *, sum(CASE WHEN (kind = 'heading' AND level <= lowest) OR (kind <> 'heading' AND lowest = 99) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS grp FROM g)
SELECT doc_id, CAST(min(idx) AS INTEGER) AS element_index, min_by(kind, idx) AS element_type, md5(min_by(content, idx) || CASE WHEN count(*) > 1 THEN chr(10) || chr(10) || array_to_string(list_slice(list(content ORDER BY idx), 2, count(*)), chr(10)) ELSE '' END) AS digest, count(*) AS parts FROM n GROUP BY doc_id, grp""".replace("count(*) AS parts FROM", "max(grp) IS NOT NULL AS merged FROM"))
def merge_heading_documents(s, sf):
    """Headings of every marked document with what they take in."""
    e = parsing.merge_headings(parsing.markdown_elements(d.marked(s, sf)))
    return e.select("doc_id", "element_index", "element_type", F.md5("raw_content").alias("digest"), F.lit(True).alias("merged"))


# ---------------------------------------------------------------- chunks

CODE_SQL = """WITH RECURSIVE w AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), big AS (SELECT * FROM w WHERE length(text) > 2000 AND len(ls) > 10
), k(doc_id, n, a, b) AS (
  SELECT doc_id, 0, 1, greatest(1, len(list_filter(range(1, len(ls) + 1), lambda j: list_sum(list_transform(ls[1:j], lambda x: length(x))) <= 2000))) FROM big
  UNION ALL SELECT big.doc_id, n + 1, b + 1, greatest(b + 1, b + len(list_filter(range(b + 1, len(ls) + 1), lambda j: list_sum(list_transform(ls[b + 1:j], lambda x: length(x))) <= 2000))) FROM k JOIN big ON k.doc_id = big.doc_id WHERE b < len(ls)
) SELECT k.doc_id, CAST(n AS INTEGER) AS chunk_index, md5(array_to_string(ls[a:b], chr(10))) AS digest FROM k JOIN big ON k.doc_id = big.doc_id
UNION ALL SELECT doc_id, 0, md5(text) FROM w WHERE NOT (length(text) > 2000 AND len(ls) > 10)"""

SENTENCES_SQL = r"list_filter(string_split(regexp_replace(text, '([.!?。！？])(\s|[A-ZА-Я])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> '')"
PARAGRAPH_SQL = rf"""WITH RECURSIVE f AS (SELECT doc_id, text, {SENTENCES_SQL} AS p FROM documents WHERE length(text) > 500
), g AS (SELECT doc_id, list_filter(CASE WHEN len(p) > 1 AND NOT regexp_matches(p[-1], '[.!?。！？]$') THEN list_append(p[1:len(p) - 2], p[len(p) - 1] || p[len(p)]) ELSE p END, lambda x: regexp_replace(x, '{SP}', '', 'g') <> '') AS p FROM f
), k(doc_id, i, cur, done, n) AS (
  SELECT doc_id, 0, '', CAST([] AS VARCHAR[]), 0 FROM g
  UNION ALL SELECT k.doc_id, i + 1,
    CASE WHEN length(cur) + length(p[i + 1]) <= 500 THEN cur || p[i + 1] WHEN length(p[i + 1]) > 500 THEN '' ELSE p[i + 1] END,
    CASE WHEN length(cur) + length(p[i + 1]) <= 500 THEN CAST([] AS VARCHAR[]) ELSE list_concat(list_filter([regexp_replace(cur, '^{SP}+|{SP}+$', '', 'g')], lambda x: x <> ''), CASE WHEN length(p[i + 1]) > 500 THEN list_transform(range(0, CAST(ceil(length(p[i + 1]) / 500) AS BIGINT)), lambda j: substr(p[i + 1], j * 500 + 1, 500)) ELSE CAST([] AS VARCHAR[]) END) END, n + 1
  FROM k JOIN g ON g.doc_id = k.doc_id WHERE i < len(p)
), o AS (SELECT doc_id, i, unnest(done) AS t, generate_subscripts(done, 1) AS j FROM k
  UNION ALL SELECT k.doc_id, i + 1, regexp_replace(cur, '^{SP}+|{SP}+$', '', 'g'), 0 FROM k JOIN g ON g.doc_id = k.doc_id WHERE i = len(p) AND regexp_replace(cur, '{SP}', '', 'g') <> '')
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS INTEGER) AS chunk_index, md5(t) AS digest FROM o UNION ALL SELECT doc_id, 0, md5(text) FROM documents WHERE length(text) <= 500"""

q.SQL["chunk_code"] = CODE_SQL
q.SQL["chunk_paragraph"] = PARAGRAPH_SQL
q.SQL["chunk_overlap_semantic"] = r"""WITH c AS (SELECT doc_id, i, substr(text, i * 500 + 1, 500) AS t FROM documents, range(0, CAST(ceil(length(text) / 500) AS BIGINT)) r(i)
), n AS (SELECT doc_id, i, lag(t) OVER w AS b, CASE WHEN i > 0 THEN lead(t) OVER w END AS f FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), e AS (SELECT doc_id, i, b, right(b, 50) AS tail, f, left(f, 50) AS head FROM n)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index,
  coalesce(CASE WHEN length(b) <= 50 THEN b WHEN regexp_matches(tail, '(?s)[.!?。！？][^a-zA-Z0-9]*$') THEN tail WHEN regexp_matches(tail, '(?s)\s[^a-zA-Z0-9]*$') THEN regexp_extract(tail, '(?s)^(.*?)\s[^a-zA-Z0-9]*$', 1) ELSE tail END, '') AS prefix,
  coalesce(CASE WHEN length(f) <= 50 THEN f WHEN regexp_matches(head, '(?s)^[^.!?。！？]*[.!?。！？]\s*') THEN regexp_extract(head, '(?s)^[^.!?。！？]*[.!?。！？]\s*') WHEN regexp_matches(head, '\s') THEN regexp_extract(head, '(?s)^.*?\s') ELSE head END, '') AS suffix FROM e"""


@query("""WITH c AS (SELECT doc_id, i, substr(text, i * 500 + 1, 500) AS t FROM documents, range(0, CAST(ceil(length(text) / 500) AS BIGINT)) r(i)
), j AS (SELECT doc_id, to_json({'document_id': CAST(doc_id AS VARCHAR), 'source': source, 'chunks': c}) AS j FROM (SELECT doc_id, any_value(source) AS source, list({'text': t, 'chunk_index': i} ORDER BY i) AS c FROM c JOIN documents USING (doc_id) GROUP BY doc_id))
SELECT doc_id, json_extract_string(j, '$.document_id') AS document_id, json_extract_string(j, '$.source') AS source, md5(json_extract_string(j, '$.chunks[0].text')) AS first, CAST(json_array_length(j, '$.chunks') AS INTEGER) AS n FROM j""")
def chunk_envelope(s, sf):
    """Slices of every document in one JSON envelope."""
    c = d.table(s, sf, "documents").select("doc_id", "source", F.posexplode(chunk.slices(F.col("text"), 500)).alias("chunk_index", "text"))
    j = structure.envelope(c, "source")
    n = F.size(F.from_json(F.get_json_object("json", "$.chunks"), "array<struct<chunk_index:int>>"))
    return j.select("doc_id", F.get_json_object("json", "$.document_id").alias("document_id"), F.get_json_object("json", "$.source").alias("source"), F.md5(F.get_json_object("json", "$.chunks[0].text")).alias("first"), n.alias("n"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(i AS INTEGER) AS chunk_index, md5(substr(text, i * 500 + 1, 500)) AS digest, CASE i % 3 WHEN 0 THEN 'code' ELSE 'text' END AS chunk_type FROM documents, range(0, CAST(ceil(length(text) / 500) AS BIGINT)) r(i)""")
def chunk_envelope_read(s, sf):
    """The chunks of envelopes again; unknown types become text."""
    kind = F.when(F.col("chunk_index") % 3 == 0, "code").otherwise("strange")
    c = d.table(s, sf, "documents").select("doc_id", F.posexplode(chunk.slices(F.col("text"), 500)).alias("chunk_index", "text")).withColumn("chunk_type", kind)
    return structure.from_envelope(structure.envelope(c)).select("document_id", "chunk_index", F.md5("text").alias("digest"), "chunk_type")


@query(rf"""WITH e AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_replace(line, '{SP}', '', 'g') <> '' GROUP BY doc_id
) SELECT d.doc_id, CASE WHEN length(text) > 0 THEN 'success' ELSE 'empty' END AS status, coalesce(n, 0) AS n_elements, CAST(ceil(length(text) / 500) AS BIGINT) AS n_chunks FROM documents d LEFT JOIN e ON e.doc_id = d.doc_id""")
def upload_counts(s, sf):
    """Elements and stored chunks of every document."""
    return ingest.counted(d.table(s, sf, "documents"), 500)


# ---------------------------------------------------------------- images

PAGE = """rg AS (SELECT conv_id AS doc_id, turn, CASE WHEN turn % 4 = 0 THEN (turn // 4 + 1) || '. 引言' WHEN turn % 4 = 1 THEN (turn // 4 + 1) || '.' || turn || ' 概述' WHEN turn % 8 = 6 THEN '统计 ' || turn ELSE text END AS text, 0.5 + turn % 7 / 10.0 AS conf FROM conversations WHERE conv_id % 5 <> 4)"""


def _recognised(s, sf) -> DataFrame:
    """Conversations as images: a turn is a region, one below the other, some of them titles; every fifth failed."""
    t = F.when(F.col("turn") % 4 == 0, F.concat((F.floor(F.col("turn") / 4) + 1).cast("string"), F.lit(". 引言"))).when(F.col("turn") % 4 == 1, F.concat((F.floor(F.col("turn") / 4) + 1).cast("string"), F.lit("."), F.col("turn").cast("string"), F.lit(" 概述"))).when(F.col("turn") % 8 == 6, F.concat(F.lit("统计 "), F.col("turn").cast("string"))).otherwise(F.col("text"))
    x, y = F.lit(10.0), F.col("turn") * 40.0
    box = F.array(F.array(x, y), F.array(x + 50, y), F.array(x + 50, y + 20), F.array(x, y + 20))
    region = F.struct(box.alias("box"), t.alias("text"), (F.lit(0.5) + F.col("turn") % 7 / 10).cast("double").alias("confidence"))
    regions = d.table(s, sf, "conversations").select(F.col("conv_id").alias("doc_id"), region.alias("r")).groupBy("doc_id").agg(F.collect_list("r").alias("regions"))
    bad = F.col("doc_id") % 5 == 4
    return regions.select("doc_id", F.when(~bad, F.col("regions")).alias("regions"), F.when(bad, F.concat(F.lit("no image "), F.col("doc_id").cast("string"))).alias("error"))


@query("WITH " + PAGE + r""", k AS (SELECT *, regexp_matches(text, '^[0-9]+[\.0-9]*\s*[\x{4e00}-\x{9fa5}]') AS title, CASE WHEN turn % 4 = 0 THEN 1 ELSE 2 END AS level FROM rg
), p AS (SELECT r.doc_id, r.turn, string_agg(t.text, '>' ORDER BY t.turn) AS path FROM k r JOIN k t ON t.doc_id = r.doc_id AND t.turn <= r.turn AND t.title
  WHERE NOT EXISTS (SELECT 1 FROM k u WHERE u.doc_id = r.doc_id AND u.title AND u.turn > t.turn AND u.turn <= r.turn AND u.level < t.level) GROUP BY r.doc_id, r.turn)
SELECT k.doc_id, CAST(row_number() OVER (PARTITION BY k.doc_id ORDER BY k.turn) - 1 AS INTEGER) AS element_index, CASE WHEN title THEN 'heading' ELSE 'text_region' END AS element_type, md5(text) AS digest, coalesce(path, '') AS path, round(CAST(least(conf, 1) AS DOUBLE), 3) AS confidence
FROM k LEFT JOIN p ON p.doc_id = k.doc_id AND p.turn = k.turn
UNION ALL SELECT DISTINCT conv_id, 0, 'error', md5('图片解析失败: no image ' || conv_id), '', 0.0 FROM conversations WHERE conv_id % 5 = 4""")
def image_elements(s, sf):
    """Elements of images: titles with their paths, and a row for each that failed."""
    e = structure.image_elements(_recognised(s, sf))
    return e.select("doc_id", "element_index", "element_type", F.md5("raw_content").alias("digest"), F.array_join("structure_path", ">").alias("path"), F.round("parser_confidence", 3).alias("confidence"))


@query("WITH " + PAGE + " SELECT doc_id, text FROM rg WHERE regexp_matches(text, '表|统计|数据|对比|清单|明细')")
def table_regions(s, sf):
    """Regions whose text speaks of a table."""
    return structure.table_regions(_recognised(s, sf)).select("doc_id", "text")


# ---------------------------------------------------------------- search

@query("""SELECT vec_id AS id, CASE WHEN x IS NULL THEN CAST(0 AS DOUBLE) ELSE round(1 / (1 + greatest(x, 0)), 9) END AS score FROM (SELECT vec_id, CASE WHEN vec_id % 7 = 3 THEN NULL ELSE 10 * CAST(embedding[1] AS DOUBLE) END AS x FROM embeddings)""")
def distance_scores(s, sf):
    """Scores of distances of every kind: the first components, a seventh of them missing."""
    x = F.when(F.col("vec_id") % 7 != 3, 10 * F.get("embedding", F.lit(0)).cast("double"))
    return d.table(s, sf, "embeddings").select(F.col("vec_id").alias("id"), F.round(vector.score(x), 9).alias("score"))


BOX = "CASE WHEN vec_id % 5 = 0 THEN NULL WHEN vec_id % 5 = 1 THEN '1,x' ELSE (vec_id % 9) || ', ' || (vec_id % 100) / 4.0 || ',3,' || vec_id % 7 END"


@query(f"SELECT vec_id AS id, TRY_CAST(trim(split_part(b, ',', 2)) AS DOUBLE) AS y_top, TRY_CAST(trim(split_part(b, ',', 4)) AS DOUBLE) AS y_bottom, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE CAST(vec_id AS INTEGER) END AS chunk_index FROM (SELECT vec_id, {BOX} AS b FROM embeddings)")
def hit_fields(s, sf):
    """Places of stored hits from boxes of every kind."""
    v = F.col("vec_id")
    box = F.when(v % 5 == 0, None).when(v % 5 == 1, "1,x").otherwise(F.concat((v % 9).cast("string"), F.lit(", "), ((v % 100) / 4.0).cast("string"), F.lit(",3,"), (v % 7).cast("string")))
    chunk_ = F.when(v % 3 == 0, F.concat(F.lit("c"), v.cast("string"))).otherwise(v.cast("string"))
    return d.table(s, sf, "embeddings").select(v.alias("id"), vector.hit_fields(box, chunk_).alias("f")).select("id", "f.y_top", "f.y_bottom", "f.chunk_index")


HAN_TEXT = "replace(replace(text, ' the ', '什么是检索'), ' of ', ' 向 ')"


@query(f"""SELECT doc_id, CAST(len(t) AS INTEGER) AS n, md5(array_to_string(list_sort(t), ' ')) AS digest FROM (SELECT doc_id, {q.TOKENS} AS t FROM (SELECT doc_id, {HAN_TEXT} AS text FROM documents))""")
def tokenize_han(s, sf):
    """Tokens of documents with Chinese words among the others."""
    t = understanding.tokens(F.replace(F.replace("text", F.lit(" the "), F.lit("什么是检索")), F.lit(" of "), F.lit(" 向 ")))
    return d.table(s, sf, "documents").select("doc_id", F.size(t).alias("n"), F.md5(F.array_join(F.array_sort(t), " ")).alias("digest"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _synonyms_sql(q_: str) -> str:
    """A list of all variants of a query, in order and each once."""
    out = []
    for key, others in understanding.SYNONYMS:
        has = f"contains(lower({q_}), {_quoted(key.lower())})"
        out += [f"CASE WHEN {has} THEN replace({q_}, {_quoted(key)}, {_quoted(s)}) END" for s in others]
        out += [f"CASE WHEN NOT {has} AND contains(lower({q_}), {_quoted(s.lower())}) THEN replace({q_}, {_quoted(s)}, {_quoted(key)}) END" for s in others]
    return f"list_filter([{', '.join(out)}], lambda x: x IS NOT NULL)"


@query(f"""WITH t AS (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'RAG ' || text WHEN 1 THEN text || '向量' ELSE 'my chroma ' || text END AS q FROM conversations
), v AS (SELECT conv_id, turn, {_synonyms_sql("q")} AS v FROM t)
SELECT conv_id, turn, CAST(least(len(u), 5) AS INTEGER) AS n, md5(array_to_string(u[1:5], '|')) AS digest FROM (SELECT conv_id, turn, list_filter(v, lambda x, i: list_position(v, x) = i) AS u FROM v)""")
def synonym_turns(s, sf):
    """Variants of every turn with a word that has synonyms."""
    kind = F.col("conv_id") % 3
    asked = F.when(kind == 0, F.concat(F.lit("RAG "), "text")).when(kind == 1, F.concat("text", F.lit("向量"))).otherwise(F.concat(F.lit("my chroma "), "text"))
    t = d.table(s, sf, "conversations").select("conv_id", "turn", understanding.synonyms(asked).alias("v"))
    return t.select("conv_id", "turn", F.size("v").alias("n"), F.md5(F.array_join("v", "|")).alias("digest"))


@query("WITH r AS (" + q.intent_scores("conversations", "conv_id, turn", "role = 'user'") + """), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, ord) AS n FROM r)
SELECT conv_id, turn, coalesce(string_agg(CASE WHEN n <= 3 AND score > 0 THEN intent || ':' || CAST(round(score * 1000000) AS BIGINT) END, ',' ORDER BY n), '') AS signals FROM o GROUP BY conv_id, turn""")
def intent_signals(s, sf):
    """The best three intents of every user turn with their scores in millionths: a map as text."""
    i = understanding.intent(F.col("text"))["signals"]
    t = d.table(s, sf, "conversations").where("role = 'user'").select("conv_id", "turn", i.alias("m"))
    told = F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit(":"), F.round(e["value"] * 1_000_000).cast("long").cast("string")))
    return t.select("conv_id", "turn", F.array_join(told, ",").alias("signals"))


# ---------------------------------------------------------------- prompts and answers

def _prompt_sql() -> str:
    system, user = [], []
    for name, (head, body) in TEMPLATES.items():
        before, after = body.split("{question}")
        between, last = after.split("{context}")
        whole = " || ".join(x for x in (sql_text(before) if before else "", "question", sql_text(between) if between else "", "context", sql_text(last) if last else "") if x)
        if name == "default":
            system.append(f"ELSE {sql_text(head)} END")
            user.append(f"ELSE {whole} END")
        else:
            system.insert(0, f"WHEN intent = '{name}' THEN {sql_text(head)}")
            user.insert(0, f"WHEN intent = '{name}' THEN {whole}")
    notice = f"""{sql_text(prompting.NOTICE)} || string_agg(CASE WHEN k > 1 THEN chr(10) || '- 文档（来源: 未知来源）包含分块: [' || ns || ']' ELSE '' END, '' ORDER BY f)"""
    return "WITH " + KEPT + f""", it AS ({q.intent_scores("benchmark", "item_id", "true")}), best AS (SELECT item_id, max_by(intent, score * 1000 - ord) AS intent FROM it GROUP BY item_id
), cx AS (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY n) AS context, count(*) AS n_citations FROM kept GROUP BY query_id
), pd AS (SELECT query_id, document_id, min(n) AS f, count(*) AS k, string_agg(n, ', ' ORDER BY n) AS ns FROM kept GROUP BY query_id, document_id
), nt AS (SELECT query_id, {notice} AS notice FROM pd GROUP BY query_id
), j AS (SELECT item_id AS query_id, b.text AS question, intent, coalesce(context, {sql_text(prompting.EMPTY_CONTEXT)}) AS context, context IS NULL AS empty, coalesce(n_citations, 0) AS n_citations, notice
  FROM benchmark b JOIN best USING (item_id) LEFT JOIN cx ON cx.query_id = item_id LEFT JOIN nt ON nt.query_id = item_id)
SELECT query_id, md5(CASE {' '.join(system)} || CASE WHEN empty THEN chr(10) || {sql_text(prompting.NO_CONTEXT)} ELSE '' END || chr(10) || {sql_text(prompting.CITE)} || chr(10) || {sql_text(prompting.STYLE)} || coalesce(chr(10) || chr(10) || notice, '')) AS system_prompt,
  md5(CASE {' '.join(user)}) AS user_prompt, n_citations FROM j"""


@query(_prompt_sql())
def prompt_assemble(s, sf):
    """Both prompts of every benchmark item as a question."""
    asked = d.items(s, sf).withColumn("intent", understanding.intent(F.col("question"))["intent"])
    p = prompting.prompts(asked, prompting.contexts(prompting.budgeted(q._context_hits(s, sf))))
    return p.select("query_id", F.md5("system_prompt").alias("system_prompt"), F.md5("user_prompt").alias("user_prompt"), "n_citations")


def _flaky():
    def call(system: str, user: str) -> str:
        if len(user) % 2:
            raise ValueError(f"refused {len(user)}")
        return user[:50]

    return call


@query(f"""SELECT item_id AS query_id, CASE WHEN length(text) % 2 = 1 THEN left({sql_text(answer.FAILED[0])} || 'refused ' || length(text) || {sql_text(answer.FAILED[1])} || regexp_replace(text, '{SP}+$', ''), 1200) ELSE left(text, 50) END AS answer,
CASE WHEN length(text) % 2 = 1 THEN 'refused ' || length(text) END AS error FROM benchmark""")
def completion_fallback(s, sf):
    """Benchmark items by a client that fails for texts of odd length: the context takes its place."""
    p = d.items(s, sf).select("query_id", F.lit("system").alias("system_prompt"), F.col("question").alias("user_prompt"))
    return completion.completed(p, _flaky, F.col("user_prompt")).select("query_id", "answer", "error")


USED = r"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(t, '\[([0-9]+)\]', 1), lambda x: TRY_CAST(x AS INTEGER)), lambda x: x IS NOT NULL)))"


@query(f"""WITH a AS (SELECT doc_id, coalesce(text || CASE doc_id % 4 WHEN 0 THEN '' ELSE ' [' || doc_id % 4 || ']' END, '') AS t FROM documents), u AS (SELECT doc_id, {USED} AS u FROM a)
SELECT doc_id, array_to_string(u, ',') AS used, array_to_string(list_filter([1, 2], lambda x: NOT list_contains(u, x)), ',') AS unused, len(u) > 0 AND len(list_filter(u, lambda x: x NOT IN (1, 2))) = 0 AS valid FROM u""")
def citation_checks(s, sf):
    """Citations of every document as an answer that names one of two known numbers, an unknown one or none."""
    n = F.col("doc_id") % 4
    a = F.concat("text", F.when(n > 0, F.concat(F.lit(" ["), n.cast("string"), F.lit("]"))).otherwise(""))
    c = d.table(s, sf, "documents").select("doc_id", answer.citation_check(a, F.array(F.lit(1), F.lit(2))).alias("c"))
    return c.select("doc_id", F.array_join(F.col("c.used").cast("array<string>"), ",").alias("used"), F.array_join(F.col("c.unused").cast("array<string>"), ",").alias("unused"), "c.valid")


@query(d.with_tables("records") + f""", a AS (SELECT id, answer || CASE WHEN id % 2 = 0 THEN ' [1]' ELSE '' END AS t, id % 4 AS n FROM records
), u AS (SELECT id, t, n, length(t) AS l, len({USED}) AS k FROM a
), m AS (SELECT *, CASE WHEN n > 0 THEN CAST(k AS DOUBLE) / n ELSE 0.0::DOUBLE END AS coverage FROM u
), c AS (SELECT *, least(least(l / 300, 1.0) + least(coverage * 0.5, 0.5), 1.0) AS completeness FROM m)
SELECT id, CASE WHEN t = '' THEN 0.0::DOUBLE WHEN k > 0 THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END AS grounded, CASE WHEN t <> '' THEN round(coverage, 6) END AS coverage, CASE WHEN t <> '' THEN round(CAST(completeness AS DOUBLE), 6) END AS completeness,
  CASE WHEN t = '' THEN '回答为空' WHEN coverage < 0.3 AND completeness < 0.4 THEN '引用使用较少；回答可能不够完整' WHEN coverage < 0.3 THEN '引用使用较少' WHEN completeness < 0.4 THEN '回答可能不够完整' ELSE '评估正常' END AS comments FROM c""")
def answer_qualities(s, sf):
    """Quality of every recorded answer, half of them with a citation."""
    a = F.concat("answer", F.when(F.col("id") % 2 == 0, " [1]").otherwise(""))
    return d.records(s, sf).select("id", answer.quality(a, F.col("id") % 4).alias("q")).select("id", "q.grounded", "q.coverage", "q.completeness", "q.comments")


@query("SELECT conv_id, turn, CASE WHEN role = 'user' AND turn % 10 <> 8 THEN 'turn ' || turn END AS delta FROM conversations")
def stream_lines(s, sf):
    """Deltas of an event stream: user turns as data, others as comments, some as its end."""
    data = F.concat(F.lit('data: {"choices":[{"delta":{"content":"turn '), F.col("turn").cast("string"), F.lit('"}}]}'))
    line = F.when((F.col("role") == "user") & (F.col("turn") % 10 == 8), "data: [DONE]").when(F.col("role") == "user", data).otherwise(": ping")
    return d.table(s, sf, "conversations").select("conv_id", "turn", answer.stream_delta(line).alias("delta"))


# ---------------------------------------------------------------- metadata

@query("""WITH m AS (SELECT event_type, count(*) AS n, count_if(value > 50) AS n_ok, round(avg(value), 6) AS mean FROM events GROUP BY event_type
), l AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events)
SELECT m.event_type, n, n_ok, n - n_ok AS n_failed, mean, round(100.0 * n_ok / n, 6) AS success_rate, (SELECT string_agg(round(value, 2), ',' ORDER BY event_id) FROM l WHERE l.event_type = m.event_type AND k <= 10) AS last FROM m""")
def call_metrics(s, sf):
    """Calls of each type: counts, share of successes, mean and last ten times."""
    m = metadata.call_metrics(d.table(s, sf, "events"), "event_type", F.col("value") > 50, "value", "event_id")
    return m.select("event_type", "n", "n_ok", "n_failed", F.round("mean", 6).alias("mean"), F.round("success_rate", 6).alias("success_rate"), F.array_join(F.transform("last", lambda x: F.round(x, 2).cast("string")), ",").alias("last"))


@query("SELECT count_if(o_orderstatus = 'O') AS pending, count_if(o_orderstatus = 'P') AS running, count_if(o_orderstatus = 'F' AND o_orderkey % 10 <> 0) AS completed, count_if(o_orderstatus = 'F' AND o_orderkey % 10 = 0) AS failed FROM orders")
def queue_status(s, sf):
    """States of all tasks, from the orders."""
    o = F.col("o_orderstatus")
    state = F.when(o == "O", "pending").when(o == "P", "running").when(F.col("o_orderkey") % 10 == 0, "failed").otherwise("completed")
    return metadata.queue_status(d.table(s, sf, "orders").select(state.alias("status")))


CREATED = d.with_tables("groups", "members") + """, w AS (SELECT c_custkey AS actor_id, c_mktsegment AS name FROM customer WHERE c_custkey % 3 = 0), n AS (SELECT (SELECT max(id) FROM groups) + row_number() OVER (ORDER BY actor_id, name) AS id, name, actor_id FROM w)"""


def _created(s, sf):
    w = d.table(s, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("actor_id"), F.col("c_mktsegment").alias("name"))
    return metadata.created_groups(d.groups(s, sf), d.members(s, sf), w)


@query(CREATED + " SELECT CAST(id AS BIGINT) AS id, name, CAST(owner_id AS BIGINT) AS owner_id FROM groups UNION ALL SELECT id, name, actor_id FROM n")
def group_create(s, sf):
    """Groups after every third customer made one."""
    g = _created(s, sf)[0]
    return g.select(F.col("id").cast("long").alias("id"), "name", F.col("owner_id").cast("long").alias("owner_id"))


@query(CREATED + " SELECT CAST(group_id AS BIGINT) AS group_id, CAST(user_id AS BIGINT) AS user_id, role FROM members UNION ALL SELECT id, actor_id, 'admin' FROM n")
def group_create_members(s, sf):
    """Members after every third customer made a group: they administer theirs."""
    m = _created(s, sf)[1]
    return m.select(F.col("group_id").cast("long").alias("group_id"), F.col("user_id").cast("long").alias("user_id"), "role")


@query(d.with_tables("members", "records") + """, a AS (SELECT id + 5000000 AS id, user_id, CASE WHEN id % 3 = 0 THEN NULL ELSE group_id END AS group_id, question FROM records)
SELECT id, user_id, group_id, question FROM records UNION ALL SELECT id, user_id, group_id, question FROM a WHERE group_id IS NULL OR EXISTS (SELECT 1 FROM members m WHERE m.group_id = a.group_id AND m.user_id = a.user_id)""")
def record_append(s, sf):
    """Records after all were asked once more, a third of them in no group."""
    r = d.records(s, sf)
    again = r.withColumns({"id": F.col("id") + 5_000_000, "group_id": F.when(F.col("id") % 3 != 0, F.col("group_id"))})
    return metadata.recorded(r, d.members(s, sf), again).select("id", "user_id", "group_id", "question")


@query("SELECT p % 5 AS group_id, p AS i, CASE WHEN k = 1 THEN stem || '.txt' ELSE stem || '_' || (k - 1) || '.txt' END AS stored FROM (SELECT page_id AS p, 'file' || page_id % 7 AS stem, row_number() OVER (PARTITION BY page_id % 5, page_id % 7 ORDER BY page_id) AS k FROM pages)")
def stored_file_names(s, sf):
    """Names under which all pages are stored, of which many are alike."""
    p = F.col("page_id")
    name = F.concat(F.when(p % 2 == 0, "123456789012345678901234567890123456_").otherwise(""), F.lit("file"), (p % 7).cast("string"), F.lit(".txt"))
    return stores.clash_free(d.table(s, sf, "pages").select((p % 5).alias("group_id"), name.alias("name"), p.alias("i"))).select("group_id", "i", "stored")


@query("SELECT doc_id, replace(replace(source, '/', '_'), ':', '_') AS name, 'doc_' || left(md5(text), 8) AS document_id FROM documents")
def file_guards(s, sf):
    """Safe names and ids by content of every document."""
    return d.table(s, sf, "documents").select("doc_id", filetype.sanitized(F.col("source")).alias("name"), filetype.document_id(F.col("text").cast("binary")).alias("document_id"))


SHOWN = "CASE WHEN n < 1024 THEN printf('%.2f B', CAST(n AS DOUBLE)) " + " ".join(f"WHEN n < {1 << (k + 10)} THEN printf('%.2f {u}', round_even(n / {1 << k}.0, 2))" for u, k in (("KB", 10), ("MB", 20), ("GB", 30))) + f" ELSE printf('%.2f TB', round_even(n / {1 << 40}.0, 2)) END"


@query(f"WITH s AS (SELECT doc_id, strlen(text) AS n FROM documents), a AS (SELECT doc_id, k, n * CAST(pow(1000, k) AS BIGINT) AS n FROM s, range(0, 4) t(k)) SELECT doc_id, CAST(k AS INTEGER) AS k, {SHOWN} AS size FROM a")
def format_sizes(s, sf):
    """Sizes of all documents as they are shown, and of thousands, millions and billions of each."""
    n = F.octet_length("text").cast("long") * F.pow(F.lit(1000), F.col("k")).cast("long")
    t = d.table(s, sf, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    return t.select("doc_id", "k", filetype.format_bytes(n).alias("size"))


@query("SELECT doc_id, CAST(len(w) AS INTEGER) AS words, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, list_filter(string_split(trim(regexp_replace(text, '" + SP + "+', ' ', 'g'), ' '), ' '), lambda x: x <> '') AS w FROM documents)")
def chunk_words(s, sf):
    """Words that chunks of fixed size are packed from."""
    w = chunk.words(F.col("text"))
    return d.table(s, sf, "documents").select("doc_id", F.size(w).alias("words"), F.md5(F.array_join(w, " ")).alias("digest"))


@query("SELECT vec_id AS id, CAST(len(embedding) AS INTEGER) AS dimension FROM embeddings")
def vector_dimensions(s, sf):
    """Lengths of all stored embeddings."""
    return d.table(s, sf, "embeddings").select(F.col("vec_id").alias("id"), F.size("embedding").alias("dimension"))



# ---------------------------------------------------------------- texts of every kind

q.SQL["parse_plain_marked"] = d.with_tables("marked") + ", " + q.SQL["parse_plain_elements"].removeprefix("WITH ").replace("FROM documents", "FROM marked")


@query(q.SQL["parse_plain_marked"])
def parse_plain_marked(s, sf):
    """Elements of every marked document read as plain text, with headings and lists."""
    e = parsing.plain_elements(d.marked(s, sf))
    return e.select("doc_id", "element_index", "element_type", F.md5("raw_content").alias("digest"), "parser_confidence")


@query(rf"""WITH p AS (SELECT doc_id, {SENTENCES_SQL} AS p FROM documents
), g AS (SELECT doc_id, list_filter(CASE WHEN len(p) > 1 AND NOT regexp_matches(p[-1], '[.!?。！？]$') THEN list_append(p[1:len(p) - 2], p[len(p) - 1] || p[len(p)]) ELSE p END, lambda x: regexp_replace(x, '{SP}', '', 'g') <> '') AS p FROM p)
SELECT doc_id, CAST(len(p) AS INTEGER) AS n, md5(array_to_string(p, chr(1))) AS digest FROM g""")
def sentence_documents(s, sf):
    """Sentences of every document."""
    p = chunk.sentences(F.col("text"))
    return d.table(s, sf, "documents").select("doc_id", F.size(p).alias("n"), F.md5(F.array_join(p, "\x01")).alias("digest"))


@query(d.with_tables("marked") + ", " + MD_LINES + " SELECT doc_id, CAST(idx AS INTEGER) AS element_index, CASE kind WHEN 'heading' THEN 'heading' WHEN 'list_item' THEN 'list' ELSE 'text' END AS chunk_type FROM el")
def chunk_type_elements(s, sf):
    """Chunk types of the elements of every marked document."""
    e = parsing.markdown_elements(d.marked(s, sf))
    return e.select("doc_id", "element_index", chunk.chunk_type(F.col("element_type")).alias("chunk_type"))


WIDE_SQL = "replace(replace(replace(text, ' the ', '　ＡＢ９，'), ' of ', ' “Ça” …  '), ' and ', '（ñ）。')"
q.SQL["clean_wide"] = q.clean_sql(q.text.DEFAULT).replace("(text,", f"({WIDE_SQL},")


@query(q.SQL["clean_wide"])
def clean_wide(s, sf):
    """Every document with wide letters, accents and Chinese marks in it, cleaned."""
    c = F.col("text")
    for old, new in ((" the ", "　ＡＢ９，"), (" of ", " “Ça” …  "), (" and ", "（ñ）。")):
        c = F.replace(c, F.lit(old), F.lit(new))
    c = q.text.clean(c)
    return d.table(s, sf, "documents").select("doc_id", F.md5(c).alias("digest"), F.length(c).cast("long").alias("n"))


MD_LINE = "CASE i % 4 WHEN 0 THEN '##' || line || ' ##' WHEN 1 THEN '[ ' || line || ' ]( http://x ) end' WHEN 2 THEN '  * ' || line ELSE '+ ' || line END"


@query(rf"""WITH l AS (SELECT doc_id, i, {MD_LINE} AS line FROM (SELECT doc_id, i, parts[i + 1] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), range(0, len(parts)) r(i)) WHERE NOT regexp_matches(line, '[\[\]()#*+-]') AND regexp_matches(line, '^\S.*\S$'))
SELECT doc_id, CAST(i AS INTEGER) AS i, CASE i % 4 WHEN 0 THEN regexp_replace(regexp_replace(line, '^##', '## '), ' ##$', '') WHEN 1 THEN replace(replace(line, '[ ', '['), ' ]( http://x )', '](http://x)') WHEN 2 THEN '  - ' || substr(line, 5) ELSE '- ' || substr(line, 3) END AS cleaned FROM l""")
def clean_markdown_lines(s, sf):
    """Lines of all documents as headings, links and list items, cleaned."""
    lines = parsing.lines_of(d.table(s, sf, "documents")).where(~F.col("line").rlike(r"[\[\]()#*+-]") & F.col("line").rlike(r"^\S.*\S$"))
    kind, line = F.col("i") % 4, F.col("line")
    made = F.when(kind == 0, F.concat(F.lit("##"), line, F.lit(" ##"))).when(kind == 1, F.concat(F.lit("[ "), line, F.lit(" ]( http://x ) end"))).when(kind == 2, F.concat(F.lit("  * "), line)).otherwise(F.concat(F.lit("+ "), line))
    cleaned = F.when(kind == 0, q.text.markdown_heading(made)).when(kind == 1, q.text.markdown_links(made)).otherwise(q.text.markdown_lists(made))
    return lines.select("doc_id", "i", cleaned.alias("cleaned"))


@query("SELECT conv_id, turn, '机器' || conv_id || '学习' || turn || '年hello' AS glued FROM conversations")
def clean_ocr_turns(s, sf):
    """Recognised labels of all turns, with the spaces and digits that recognition puts in."""
    label = F.concat(F.lit("机 器 "), F.regexp_replace(F.col("conv_id").cast("string"), "(?<=.)(?=.)", " "), F.lit(" 学  习 "), F.col("turn").cast("string"), F.lit(" 年 he1lo"))
    return d.table(s, sf, "conversations").select("conv_id", "turn", q.text.ocr_letters(q.text.ocr_glue(label)).alias("glued"))


def _unfilled(c: str) -> str:
    for f in understanding.FILLERS:
        c = f"replace({c}, '{f}', '')"
    return c


@query(rf"""WITH t AS (SELECT conv_id, turn, regexp_replace('请问  ' || text || '，谢谢？', '^{SP}+|{SP}+$', '', 'g') AS a FROM conversations
), b AS (SELECT *, trim(regexp_replace(a, '{SP}+', ' ', 'g'), ' ') AS b FROM t), c AS (SELECT *, translate(b, '，。？', ',.?') AS c FROM b
), e AS (SELECT *, trim(regexp_replace({_unfilled("c")}, '{SP}+', ' ', 'g'), ' ') AS e, {_synonyms_sql("a")} AS m FROM c)
SELECT conv_id, turn, md5(e || ' (kb:k1)') AS rewritten, array_to_string(list_filter([CASE WHEN b <> a THEN 'normalize_whitespace' END, CASE WHEN c <> b THEN 'normalize_punctuation' END, CASE WHEN e <> c THEN 'remove_fillers' END, 'append_hints', CASE WHEN len(m) > 0 THEN 'synonym_expansion' END], lambda x: x IS NOT NULL), ',') AS rules,
  CAST(least(len(list_distinct(m)), 5) AS INTEGER) AS n_expansions FROM e""")
def rewrite_turns(s, sf):
    """Every turn as a polite question, rewritten."""
    asked = F.concat(F.lit("请问  "), "text", F.lit("，谢谢？"))
    r = d.table(s, sf, "conversations").select("conv_id", "turn", understanding.rewrite(asked, F.lit("k1")).alias("r"))
    return r.select("conv_id", "turn", F.md5("r.rewritten").alias("rewritten"), F.array_join("r.rules", ",").alias("rules"), F.size("r.expansions").alias("n_expansions"))


def _expand_sql() -> str:
    """c to l (the first abbreviation written out), then its phrases, then what is made of them."""
    has = lambda k: f"contains(c, {_quoted(k)})"
    long_ = "CASE " + " ".join(f"WHEN {has(k)} THEN replace(c, {_quoted(k)}, {_quoted(v)})" for k, v in understanding.ABBREVIATIONS) + " ELSE c END"
    any_ = " OR ".join(has(k) for k, _ in understanding.ABBREVIATIONS)
    # XX stands for the text with its keyword as XX.
    full = [(k, "replace({}, 'XX', replace(l, {}, 'XX'))".format(_quoted(p), _quoted(k))) for k, p in understanding.EXPANSIONS]
    found = ", ".join(f"CASE WHEN contains(lower(l), {_quoted(k.lower())}) AND {f} <> l THEN {f} END" for k, f in full)
    chars = lambda x: "".join(dict.fromkeys(x))
    return rf"""l AS (SELECT *, {long_} AS l, {any_} AS short FROM t
), f AS (SELECT *, list_filter([{found}], lambda x: x IS NOT NULL) AS f FROM l
), v AS (SELECT *, CASE WHEN length(c) <= 10 AND len(f) = 0 THEN CASE WHEN regexp_matches(c, '[{chars(understanding.DEFINITION_CHARS)}]') THEN [c || '的相关定义', c || '的具体含义'] WHEN regexp_matches(c, '[{chars(understanding.HOW_CHARS)}]') THEN ['关于' || c || '的操作方法', c || '的实现步骤']
  WHEN NOT regexp_matches(c, '[?？]') THEN [c || '是什么', c || '有什么', c || '如何', c || '的作用'] END END AS v FROM f
), x AS (SELECT *, list_concat(f, coalesce(v, [])) AS p, CAST(short AS INTEGER) + len(f) + CAST(v IS NOT NULL AS INTEGER) AS terms FROM v)"""


@query(rf"""WITH t AS (SELECT conv_id, turn, regexp_replace(CASE conv_id % 3 WHEN 0 THEN 'API ' WHEN 1 THEN '前端 ' ELSE '' END || CASE WHEN turn % 5 = 4 THEN left(text, turn) ELSE text END, '^{SP}+|{SP}+$', '', 'g') AS c FROM conversations), {_expand_sql()}
SELECT conv_id, turn, md5(CASE WHEN c = '' THEN c ELSE regexp_replace(CASE WHEN len(p) > 0 THEN l || ' ' || array_to_string(p, ' ') ELSE l END, '^{SP}+|{SP}+$', '', 'g') END) AS expanded, CASE WHEN c = '' THEN 0.0::DOUBLE ELSE round(least(0.9, 0.3 + 0.2 * terms), 6)::DOUBLE END AS confidence FROM x""")
def expand_turns(s, sf):
    """Every whole turn with an abbreviation, a keyword or neither, expanded; every fifth one as a short question."""
    kind = F.col("conv_id") % 3
    text = F.when(F.col("turn") % 5 == 4, F.left("text", F.col("turn").cast("int"))).otherwise(F.col("text"))
    asked = F.concat(F.when(kind == 0, "API ").when(kind == 1, "前端 ").otherwise(""), text)
    t = d.table(s, sf, "conversations").select("conv_id", "turn", understanding.expand(asked).alias("e"))
    return t.select("conv_id", "turn", F.md5("e.expanded").alias("expanded"), "e.confidence")


@query("""WITH f AS (SELECT page_id, list_extract(['.pdf', '.gif', '.html'], CAST(page_id % 3 AS INTEGER) + 1) AS e, list_extract(['application/pdf', 'image/gif', 'text/html'], CAST(page_id % 3 AS INTEGER) + 1) AS by_name,
  list_extract(['application/pdf', 'image/gif', 'text/html', NULL], CAST(page_id % 4 AS INTEGER) + 1) AS by_bytes FROM pages)
SELECT page_id, coalesce(by_bytes, by_name) AS mime, e AS extension, CASE WHEN by_bytes = by_name THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM f""")
def filetype_contents(s, sf):
    """Kinds of all pages behind other signatures and names, of which some agree."""
    p = F.col("page_id")
    start = F.when(p % 4 == 0, "%PDF-1.7 ").when(p % 4 == 1, "GIF89a").when(p % 4 == 2, "").otherwise("zzz ")
    name = F.concat(F.lit("f"), F.when(p % 3 == 0, ".pdf").when(p % 3 == 1, ".gif").otherwise(".html"))
    f = filetype.identify(name, F.concat(start, F.col("html")).cast("binary"))
    return d.table(s, sf, "pages").select("page_id", f.alias("f")).select("page_id", "f.mime", "f.extension", "f.confidence")


@query(rf"""SELECT doc_id, md5(array_to_string(list_transform(p, lambda x, i: CASE WHEN i = 1 OR i = len(p) THEN regexp_replace(x, '^{SP}+|{SP}+$', '', 'g') ELSE x END), chr(10))) AS digest FROM (SELECT doc_id, string_split('  ' || text || chr(9), chr(10)) AS p FROM documents)""")
def clean_code_documents(s, sf):
    """Every document as a code block, its first and last line trimmed."""
    c = q.text.markdown_code(F.concat(F.lit("  "), "text", F.lit("\t")))
    return d.table(s, sf, "documents").select("doc_id", F.md5(c).alias("digest"))


# ---------------------------------------------------------------- files and streams

@query("SELECT conv_id, turn, length(text) AS n FROM conversations")
def stream_ingest(s, sf):
    """All turns as files that land in a folder, through the streaming ingest, run twice: nothing comes twice."""
    source, sink, marks = (scratch.new_path(s, x) for x in ("landing", "sink", "marks"))
    d.table(s, sf, "conversations").select("conv_id", "turn", "text").write.parquet(source)
    for _ in range(2):
        streaming.ingest(s, source, "conv_id long, turn long, text string", lambda df: df.select("conv_id", "turn", F.length("text").cast("long").alias("n")), sink, marks).awaitTermination()
    return s.read.parquet(sink).select("conv_id", "turn", "n")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS digest, source FROM documents")
def chunk_store_read(s, sf):
    """All documents as stores of chunks, a JSON array in each file, read as stores. Writes a table while it is built."""
    path = scratch.new_path(s, "chunks")
    rows = d.table(s, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.create_map(F.lit("source"), "source").alias("metadata"))
    stores.write_chunk_store(rows, path)
    return stores.chunk_store(s, path).select("id", F.md5("text").alias("digest"), F.col("metadata")["source"].alias("source"))


@query("SELECT doc_id, md5(text) AS digest, md5(text) AS digest_of_bytes FROM documents")
def text_file_lines(s, sf):
    """All documents written into text files, a line each, and read again as whole texts and as bytes. Writes a table while it is built."""
    path = scratch.new_path(s, "texts")
    d.table(s, sf, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit("\t"), F.to_json(F.struct("text"))).alias("line")).write.text(path)

    def told(files, column: str) -> DataFrame:
        lines = files.select(F.explode(F.split(F.rtrim(F.col(column).cast("string")), "\n", -1)).alias("line"))
        parts = F.split("line", "\t", 2)
        return lines.where("line <> ''").select(F.get(parts, F.lit(0)).cast("long").alias("doc_id"), F.md5(F.get_json_object(F.get(parts, F.lit(1)), "$.text")).alias("digest"))

    texts, raw = told(stores.text_files(s, path), "text"), told(stores.binary_files(s, f"{path}/*.txt"), "content")
    return texts.join(raw.withColumnRenamed("digest", "digest_of_bytes"), "doc_id").select("doc_id", "digest", "digest_of_bytes")
