"""BM25, reciprocal-rank fusion, neighbours of hits, structural reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.understanding import tokens

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K, VECTOR_WEIGHT, KEYWORD_WEIGHT = 60, 1.0, 0.8
WINDOW, MOST_ADDED, DECAY, LEAST = 1, 4, 0.85, 1e-6
BUDGET_CHARS, BUDGET_CHUNKS = 5000, 8

# Reranking words. Fixed values.
TECH = ("机器学习", "深度学习", "计算机视觉", "自然语言处理", "机器人", "语音识别", "图像识别", "专家系统")
TEMPORAL_QUERY = ("发展", "历程", "历史", "年代", "时间", "阶段")
TECH_QUERY = ("技术", "分支", "机器学习", "深度学习", "计算机视觉", "自然语言处理")


def postings(docs: DataFrame) -> DataFrame:
    """id and text to id, token, dl (distinct tokens of the document)."""
    t = docs.select("id", tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    return t.select("id", F.size("t").alias("dl"), F.explode("t").alias("token"))


def statistics(docs: DataFrame) -> DataFrame:
    """token, df, size of a corpus (id, text) in one pass: df documents hold the token;
    the empty token stands for all documents, size is what they hold together."""
    t = docs.select(tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    marked = t.select(F.explode(F.concat(F.array(F.lit("")), "t")).alias("token"), F.size("t").alias("dl"))
    return marked.groupBy("token").agg(F.count("*").alias("df"), F.sum("dl").alias("size"))


def idf(stats: DataFrame) -> DataFrame:
    """token, df, idf and avgdl of statistics(); a negative idf becomes a quarter of the mean one."""
    whole = F.col("token") == ""
    total = stats.agg(F.max(F.when(whole, F.col("df"))).alias("n"), (F.max(F.when(whole, F.col("size"))) / F.max(F.when(whole, F.col("df")))).alias("avgdl"))
    raw = stats.crossJoin(F.broadcast(total)).withColumn("raw", F.when(~whole, F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))))  # one row is broadcast
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).where(~whole).select("token", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"), "avgdl")


def bm25(queries: DataFrame, docs: DataFrame, k: int = 8) -> DataFrame:
    """query_id and question against id and text: query_id, id, score, rank.

    A document's tokens count once. Statistics take one pass over the corpus and
    scores another. A document's tokens meet the weights of the queries' tokens:
    while these are few they are broadcast (adaptive execution checks their size)
    and a document's sums are made where it is; beyond, the join is on tokens,
    whose hot ones it splits. Rows without a common token never meet.
    """
    post = postings(docs)
    asked = queries.select("query_id", F.explode(tokens(F.col("question"))).alias("token"))
    weights = asked.join(idf(statistics(docs)), "token").select("query_id", "token", "idf", "avgdl")
    part = F.col("idf") * (K1 + 1) / (1 + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scores = post.join(weights, "token").groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= k) & (F.col("score") > 0))


def fuse(vector: DataFrame, keyword: DataFrame, k: int = 8) -> DataFrame:
    """Reciprocal-rank fusion of two hit lists (query_id, id, rank); ties in the
    order of the vector list, then of the keyword list."""
    def part(df: DataFrame, source: int, weight: float) -> DataFrame:
        return df.select("query_id", "id", F.lit(source).alias("source"), "rank", (F.lit(weight) / (RRF_K + F.col("rank"))).alias("part"))

    both = part(vector, 0, VECTOR_WEIGHT).unionByName(part(keyword, 1, KEYWORD_WEIGHT))
    pick = lambda s: F.coalesce(F.max(F.when(F.col("source") == s, F.col("part"))), F.lit(0.0))
    summed = both.groupBy("query_id", "id").agg(F.round(pick(0) + pick(1), 9).alias("score"), F.min(F.struct("source", "rank")).alias("seen"), F.max(F.when(F.col("source") == 0, F.col("rank"))).alias("vector_rank"), F.max(F.when(F.col("source") == 1, F.col("rank"))).alias("keyword_rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "seen")
    return summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("seen")


def with_neighbours(hits: DataFrame, store: DataFrame, window: int = WINDOW, most: int = MOST_ADDED) -> DataFrame:
    """hits (query_id, rank, document_id, chunk_index, score) and their chunks'
    neighbours in the store (document_id, chunk_index): the hits first, then at
    most ``most`` new chunks a query in the order of hits and chunks."""
    first = Window.partitionBy("query_id", "document_id", "chunk_index").orderBy("rank")
    own = hits.withColumn("n", F.row_number().over(first)).where("n = 1").select("query_id", "document_id", "chunk_index", "score", "rank")
    near = own.select("query_id", "document_id", "score", "rank", F.explode(F.sequence(F.col("chunk_index") - window, F.col("chunk_index") + window)).alias("chunk_index"))
    near = near.join(store.select("document_id", "chunk_index").distinct(), ["document_id", "chunk_index"]).join(own.select("query_id", "document_id", "chunk_index"), ["query_id", "document_id", "chunk_index"], "left_anti")
    once = Window.partitionBy("query_id", "document_id", "chunk_index").orderBy("rank")
    budget = Window.partitionBy("query_id").orderBy("rank", "chunk_index")
    new = near.withColumn("n", F.row_number().over(once)).where("n = 1").withColumn("n", F.row_number().over(budget)).where(F.col("n") <= most)
    new = new.select("query_id", "document_id", "chunk_index", F.greatest(F.col("score") * DECAY, F.lit(LEAST)).alias("score"), (F.col("n") + 1_000_000).cast("int").alias("rank"), F.lit("expanded").alias("retriever"))
    return own.withColumn("retriever", F.lit("hit")).unionByName(new)


def _contains_any(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def rerank_features(query: Column, text: Column, source: Column, y_top: Column) -> dict[str, Column]:
    """position, specific, level and tech of a hit."""
    text, source = F.coalesce(text, F.lit("")), F.coalesce(source, F.lit(""))
    numbered, year = r"[0-9]+\.\s+\S+", "[0-9]{4}年"
    from_source = F.when(source == "", 0).otherwise(F.size(F.split(source, " > ")))
    hashes = F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^(#+)\s+"), 1), F.length))
    from_text = F.when(text.rlike(r"^#+\s+"), hashes).when(text.rlike(numbered), 1).when(text.rlike(r"[0-9]+\.[0-9]+\s+"), 2).otherwise(0)
    y = F.least(y_top / 1500.0, F.lit(1.0))
    upward = _contains_any(query, TEMPORAL_QUERY) | ~_contains_any(query, TECH_QUERY)
    return {
        "position": F.when(F.coalesce(y_top, F.lit(0.0)) == 0, 0.5).otherwise(F.when(upward, 1 - y).otherwise(y)),
        "specific": F.when(source != "", source.rlike(numbered) | text.rlike(year)).otherwise(text.rlike(numbered) | text.rlike(year) | _contains_any(text, TECH)),
        "level": F.greatest(from_source, from_text),
        "tech": sum((text.contains(w).cast("int") for w in TECH), F.lit(0)),
    }


def rerank(hits: DataFrame, query: str = "question", k: int = 8) -> DataFrame:
    """hits with query_id, question, text, source_info, y_top, rank: their new rank."""
    f = rerank_features(F.col(query), F.col("text"), F.col("source_info"), F.col("y_top"))
    out = hits.withColumns(f)
    order = Window.partitionBy("query_id").orderBy(F.desc("position"), F.desc("specific"), F.desc("level"), F.desc("tech"), "rank")
    return out.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k)
