"""The engine's tables as they are derived from the driver's, for Spark and SQL alike.

users are customers, groups are nations, members customers of a nation (the
customers whose key is divisible by 7 administer), records are user turns with
the assistant turn that follows, favourites are the records with long answers,
files are pages, vectors are embeddings with their label as knowledge base, and
a document's chunk of 500 characters is a stored chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def users(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


def groups(s, d):
    owner = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("n")).agg(F.min("c_custkey").alias("owner_id"))
    n = table(s, d, "nation")
    return n.join(owner, n["n_nationkey"] == owner["n"], "left").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), "owner_id")


def members(s, d):
    return table(s, d, "customer").select(F.col("c_nationkey").alias("group_id"), F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 7 == 0, "admin").otherwise("member").alias("role"))


def records(s, d):
    order = Window.partitionBy("conv_id").orderBy("turn")
    t = table(s, d, "conversations").withColumns({"next_role": F.lead("role").over(order), "answer": F.lead("text").over(order)})
    r = t.where("role = 'user' AND next_role = 'assistant'")
    return r.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), (F.col("conv_id") % 1500 + 1).alias("user_id"), (F.col("conv_id") % 25).alias("group_id"), F.col("text").alias("question"), "answer", (F.col("conv_id") * 7919 % 86400).alias("created_at"))


def favorites(s, d):
    return records(s, d).where("length(answer) > 400").select((F.col("id") + 1_000_000).alias("id"), "user_id", F.col("id").alias("qa_id"), "created_at")


def files(s, d):
    return table(s, d, "pages").select(F.col("page_id").alias("id"), (F.col("page_id") % 25).alias("group_id"), (F.col("page_id") * 31 % 1500 + 1).alias("uploader_id"), F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.octet_length("html").cast("long").alias("size"))


def vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("kb"))


def vector_queries(s, d):
    return vectors(s, d).where("id % 50 = 0").withColumnRenamed("id", "query_id")


def corpus(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")


def marked(s, d):
    """Documents whose lines that begin with T, I and A are headings and list items."""
    t = F.concat(F.lit("\n"), "text")
    for start, mark in MARKS:
        t = F.replace(t, F.lit(f"\n{start}"), F.lit(f"\n{mark}{start}"))
    return table(s, d, "documents").select("doc_id", F.substring(t, F.lit(2), F.length(t)).alias("text"))


def items(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


#: Letters as Chinese characters, so that words become runs without gaps between them.
HAN = "的一是不了人我在有他这中大来上国个到说们为子和你地出"


def han(s, d):
    """Documents in Chinese characters: a letter is one, and no space is left between words."""
    t = F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyz ", HAN)  # the space has no match and goes
    return table(s, d, "documents").select("doc_id", t.alias("text"))


MARKS = (("T", "## "), ("I", "### "), ("W", "# "), ("A", "\n- "), ("O", "\n\n  1. "))


def _marked_sql() -> str:
    sql = "chr(10) || text"
    for start, mark in MARKS:
        new = " || ".join("chr(10)" if c == "\n" else f"'{c}'" for c in f"\n{mark}{start}")
        sql = f"replace({sql}, chr(10) || '{start}', {new})"
    return f"SELECT doc_id, substr({sql}, 2) AS text FROM documents"


SQL = {
    "marked": _marked_sql(),
    "users": "SELECT c_custkey AS id, c_name AS name FROM customer",
    "groups": "SELECT n_nationkey AS id, n_name AS name, (SELECT min(c_custkey) FROM customer WHERE c_nationkey = n_nationkey) AS owner_id FROM nation",
    "members": "SELECT c_nationkey AS group_id, c_custkey AS user_id, CASE WHEN c_custkey % 7 = 0 THEN 'admin' ELSE 'member' END AS role FROM customer",
    "records": """SELECT conv_id * 100 + turn AS id, conv_id % 1500 + 1 AS user_id, conv_id % 25 AS group_id, text AS question, answer, conv_id * 7919 % 86400 AS created_at FROM (
        SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'""",
    "favorites": "SELECT id + 1000000 AS id, user_id, id AS qa_id, created_at FROM records WHERE length(answer) > 400",
    "files": "SELECT page_id AS id, page_id % 25 AS group_id, page_id * 31 % 1500 + 1 AS uploader_id, 'page_' || page_id || '.html' AS name, CAST(strlen(html) AS BIGINT) AS size FROM pages",
    "vectors": "SELECT vec_id AS id, embedding, label AS kb FROM embeddings",
}


def with_tables(*names: str) -> str:
    """A WITH list of derived tables, those that others need included."""
    order = [n for n in ("marked", "users", "groups", "members", "records", "favorites", "files", "vectors") if n in names or (n == "records" and "favorites" in names)]
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in order)
