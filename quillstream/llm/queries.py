"""The registered ``opN_`` queries: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import decontaminate, fill_middle, html_text, jaccard_join, language, licences, maxscore, order_packing, packing, phrases, pii, token_orc, url_filter
from quillstream.llm.common import table


def op1_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best vectors for every vector whose id is divisible by 20."""
    vectors = maxscore.quantised(table(spark, sf_dir, "embeddings"))
    return maxscore.top_k(vectors.where("id % 20 = 0"), vectors, k=20)


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document written to ORC, digests read back from the files."""
    return token_orc.round_trip(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document against every benchmark item."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and links of every document by shingles of five words at 0.8."""
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL, by the rules and else by the listed URLs."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.listing(pages))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by a classifier fitted on a sample of them."""
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.learn(pages))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document; its path is source/lang/id, so directories are sources and their languages."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt")))
    return licences.scan(docs.select("doc_id", "text", path.alias("path")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in sequences of the permitted lengths."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack(packing.token_counts(docs), expected=packing.expected_pieces(docs))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.learn(docs))


def op11_order_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of 1,024 tokens, in the order of ids."""
    return order_packing.pack(table(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of two and three words of each language."""
    return phrases.mine(table(spark, sf_dir, "documents"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and put together again, as digests."""
    cut = fill_middle.fill_middle(table(spark, sf_dir, "documents"))
    again = fill_middle.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (op1_maxscore, op2_token_orc, op3_decontamination, op4_jaccard, op5_pii, op6_url_filter, op7_html, op8_licences, op9_packing, op10_language, op11_order_packing, op12_phrases, op13_fill_middle)}

#: DuckDB SQL of the queries that SQL can express.
SQL: dict[str, str] = {
    "op1_maxscore": """
WITH e AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.id AS query_id, c.id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON c.id <> q.id WHERE q.id % 20 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op6_url_filter": url_filter.SQL,
    "op12_phrases": phrases.SQL,
    "op13_fill_middle": fill_middle.SQL,
    "op3_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM benchmark
), n AS (SELECT item, w, least(len(w), 10) AS k FROM i WHERE len(w) > 0
), win AS MATERIALIZED (SELECT DISTINCT item, k, array_to_string(w[j:j + k - 1], ' ') AS g FROM n, range(1, len(w) - k + 2) t(j)
), ks AS (SELECT DISTINCT k FROM win
), dg AS (SELECT doc_id, k, j, array_to_string(w[j:j + k - 1], ' ') AS g FROM d, ks, range(1, len(w) - k + 2) t(j)
), met AS MATERIALIZED (SELECT doc_id, j, k, item FROM dg JOIN win USING (k, g)
), hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + k)) AS p FROM met) GROUP BY doc_id
), own AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM met WHERE item IS NOT NULL GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN own ON own.doc_id = d.doc_id
""",
    "op4_jaccard": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents
), k AS (SELECT doc_id, w, array_to_string(w, ' ') AS key FROM d
), c AS MATERIALIZED (SELECT key, any_value(w) AS w, min(doc_id) AS copy_id, count(*) AS copies FROM k WHERE key <> '' GROUP BY key
), s AS MATERIALIZED (SELECT DISTINCT copy_id, array_to_string(w[j:j + 4], ' ') AS g FROM c, range(1, greatest(len(w) - 4, 1) + 1) t(j)
), z AS (SELECT copy_id, count(*) AS n FROM s GROUP BY copy_id
), p AS MATERIALIZED (SELECT a.copy_id AS a, b.copy_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.copy_id < b.copy_id GROUP BY ALL
), l AS MATERIALIZED (SELECT a, b FROM p JOIN z x ON x.copy_id = a JOIN z y ON y.copy_id = b WHERE 5 * p.n >= 4 * (x.n + y.n - p.n)
), e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(a, b) AS (SELECT copy_id, copy_id FROM c UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b
), g AS (SELECT a, min(b) AS class_id FROM r GROUP BY a
), m AS (SELECT a, count(*) AS n_links, sum(copies) AS n_linked FROM e JOIN c ON c.copy_id = e.b GROUP BY a)
SELECT k.doc_id, coalesce(class_id, k.doc_id) AS class_id, coalesce(c.copy_id, k.doc_id) AS copy_id, coalesce(copies - 1, 0) AS n_copies, coalesce(n_links, 0) AS n_links, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked
FROM k LEFT JOIN c ON c.key = k.key LEFT JOIN g ON g.a = c.copy_id LEFT JOIN m ON m.a = c.copy_id
""",
}
