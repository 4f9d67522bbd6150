"""A stored inverted index for BM25, and top-k search that leaves most of it unread.

A document's tokens count once, so what a token adds to a score depends on the
token and on the document's length alone: ``idf * norm(dl)``, and norm falls with
length. A list of postings in the order of lengths is thus in the order of impact.

Four tables make an index:

* ``forward``: id, dl, tokens of each document;
* ``stats``: token, df, idf, least (the shortest length of its documents);
* ``postings``: documents are dealt into shards by their id; the list of a token in a shard
  is cut into blocks of ``BLOCK`` postings in the order of impact, each a row with
  its shortest length. Blocks lie in folders by their place in the list (tier 0
  has the first ones, tier t some 2^t further ones), so a search that needs the
  beginnings of lists does not open the rest;
* ``about``: number of documents, mean length, postings of a block.

A search asks many queries at once. First the beginnings of the lists of its
tokens give each query candidates; the exact scores of those that most of them
speak for give a threshold: the k-th best so far. Then tokens, weakest first, are not essential while what all of
them could add stays below the threshold: a document that has no other cannot get
there. Of the essential ones those blocks are read whose shortest document could
get there with all tokens of the query. Their sums, with what the others might
add, leave few candidates, whose other tokens are looked up in ``forward``. All
bounds are upper ones, so results are those of scoring every document.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.functions.understanding import tokens
from quillstream.operators import keyword_scan, ranking
from quillstream.sources import scratch

#: Postings of a block, documents of a shard.
BLOCK, SHARD = 128, 1 << 16
#: Shards that give first candidates of a frequent token, and how many candidates for each
#: wanted document are scored to find a threshold.
SEEDS, TRIED = 8, 8
#: Scores are told to six digits: what may round up to the threshold is not left out.
SLACK = 2e-6


def tier(block: Column) -> Column:
    """0 for the first block of a list, then 1 for two of them, 2 for four, ..."""
    return F.floor(F.log2(block + 1) + 1e-9).cast("int")


class KeywordIndex:
    """An index in a folder."""

    def __init__(self, spark: SparkSession, path: str, tokens: Callable[[Column], Column] = tokens):
        self.spark, self.path, self.tokens = spark, path.rstrip("/"), tokens
        about = self._read("about", "n long, avgdl double, block int").first()
        self.n, self.avgdl, self.block = about["n"], about["avgdl"], about["block"]

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    @property
    def forward(self) -> DataFrame:
        return self._read("forward", f"id {self._kind()}, dl int, tokens array<string>")

    @property
    def stats(self) -> DataFrame:
        return self._read("stats", "token string, df long, idf double, least int")

    @property
    def postings(self) -> DataFrame:
        return self._read("postings", f"token string, shard long, block int, least int, ids array<{self._kind()}>, dls array<int>, tier int")

    def _kind(self) -> str:
        return self.spark.read.parquet(f"{self.path}/forward").schema["id"].dataType.simpleString()

    @classmethod
    def build(cls, docs: DataFrame, path: str, block: int = BLOCK, shard: int = SHARD, tokens: Callable[[Column], Column] = tokens) -> KeywordIndex:
        """An index of docs (id, text) in a new folder. Documents without an id or a token are left out.
        ``tokens`` makes distinct tokens of a text, of documents and questions alike."""
        spark, path = docs.sparkSession, path.rstrip("/")
        told = docs.select("id", tokens(F.col("text")).alias("tokens")).where(F.col("id").isNotNull() & (F.size("tokens") > 0))
        told.select("id", F.size("tokens").alias("dl"), "tokens").write.parquet(f"{path}/forward")
        forward = spark.read.parquet(f"{path}/forward")
        about = forward.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl"), F.lit(block).alias("block"))
        about.write.parquet(f"{path}/about")
        n = spark.read.parquet(f"{path}/about").first()["n"]
        # The empty token stands for all documents, as ranking.idf() expects it.
        every = forward.select(F.explode(F.concat(F.array(F.lit("")), "tokens")).alias("token"), "dl")
        counts = scratch.stored(every.groupBy("token").agg(F.count("*").alias("df"), F.sum("dl").alias("size"), F.min("dl").alias("least")), "counts")
        # Two numbers of the whole corpus are broadcast to the counts.
        weights = ranking.idf(counts.drop("least"))
        weights.join(counts.select("token", "least"), "token").select("token", "df", "idf", "least").write.parquet(f"{path}/stats")
        shards = max(1, math.ceil(n / shard))
        # A shard has a bounded number of documents and a document counts once: so have its lists.
        lists = forward.select("id", "dl", F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), F.explode("tokens").alias("token"))
        lists = lists.groupBy("token", "shard").agg(F.array_sort(F.collect_list(F.struct("dl", "id"))).alias("p"))
        last = F.floor((F.size("p") - 1) / block).cast("int")
        cut = lists.select("token", "shard", F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("p", i * block + 1, F.lit(block)))).alias("block", "b"))
        rows = cut.select("token", "shard", "block", F.get("b", F.lit(0))["dl"].alias("least"), F.transform("b", lambda x: x["id"]).alias("ids"), F.transform("b", lambda x: x["dl"]).alias("dls"), tier(F.col("block")).alias("tier"))
        rows.sortWithinPartitions("tier", "token").write.partitionBy("tier").parquet(f"{path}/postings")
        return cls(spark, path, tokens)

    # ------------------------------------------------------------ search

    def _norm(self, dl: Column) -> Column:
        """What a document's length makes of an idf."""
        return (ranking.K1 + 1) / (1 + ranking.K1 * (1 - ranking.B + ranking.B * dl / self.avgdl))

    def _longest(self, share: Column) -> Column:
        """The length at which norm is still ``share``; none where share is not positive."""
        found = ((ranking.K1 + 1) / share - 1) / ranking.K1
        return F.when(share > 0, (found - (1 - ranking.B)) * self.avgdl / ranking.B)

    def _asked(self, queries: DataFrame) -> DataFrame:
        """query_id, token, idf, df, least, whole: the query's tokens that occur, and all their idf together."""
        asked = queries.select("query_id", F.explode(self.tokens(F.col("question"))).alias("token"))
        met = asked.join(self.stats, "token")
        return met.withColumn("whole", F.sum(F.greatest("idf", F.lit(0.0))).over(Window.partitionBy("query_id")))

    def _exact(self, found: DataFrame, weights: DataFrame) -> DataFrame:
        """found (query_id, id) with score, by the documents' own tokens."""
        per = weights.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "idf"))).alias("w"))
        met = found.join(per, "query_id").join(self.forward, "id")
        own = F.array_intersect(F.map_keys("w"), F.col("tokens"))
        total = F.aggregate(own, F.lit(0.0), lambda a, t: a + F.element_at("w", t))
        return met.select("query_id", "id", F.round(total * self._norm(F.col("dl")), 6).alias("score"))

    def _thresholds(self, asked: DataFrame, k: int) -> DataFrame:
        """query_id and floor: the k-th best score among the documents that the beginnings of
        all lists speak for most; none where fewer are there. Of a token with many
        documents a few shards are asked, as any documents give a threshold."""
        first = self.postings.where("tier = 0").select("token", "shard", "ids", "dls")
        met = asked.select("query_id", "token", "idf", "df").join(first, "token").where((F.col("df") <= SEEDS * self.block) | (F.col("shard") < SEEDS))
        met = met.select("query_id", "idf", F.explode(F.arrays_zip("ids", "dls")).alias("p"))
        sums = met.groupBy("query_id", F.col("p.ids").alias("id")).agg((F.sum("idf") * self._norm(F.first("p.dls"))).alias("sure"))
        best = sums.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sure"), "id"))).where(F.col("n") <= TRIED * k)
        scores = self._exact(best.select("query_id", "id"), asked)
        kth = scores.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("n") == k)
        return kth.select("query_id", F.greatest(F.col("score") - SLACK, F.lit(0.0)).alias("floor"))

    def plan(self, queries: DataFrame, k: int = 8) -> DataFrame:
        """query_id, token, idf, df, floor, essential, rest and longest: what a search reads. ``rest`` is the idf of
        all tokens of the query that are not essential, ``longest`` the length of
        documents that may still get there."""
        asked = scratch.stored(self._asked(queries), "asked")
        met = asked.join(self._thresholds(asked, k), "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
        # Where a mean idf is negative so are some weights; as bounds these count as nothing.
        most = F.greatest("idf", F.lit(0.0))
        weakest = Window.partitionBy("query_id").orderBy(most * self._norm(F.col("least")), "token")
        met = met.withColumn("essential", F.sum(most * self._norm(F.col("least"))).over(weakest) >= F.col("floor"))
        rest = F.sum(F.when(~F.col("essential"), most).otherwise(0.0)).over(Window.partitionBy("query_id"))
        return met.withColumn("rest", rest).withColumn("longest", F.coalesce(self._longest(F.col("floor") / F.col("whole")), F.lit(float("inf"))))

    def _blocks(self, plan: DataFrame) -> DataFrame:
        """The blocks that essential tokens need; folders of later blocks than any of them has stay closed."""
        need = plan.where("essential")
        deepest = need.agg(F.max(tier(F.ceil(F.col("df") / self.block))).alias("t")).first()["t"]
        blocks = self.postings.where(F.col("tier") <= (deepest or 0))
        return need.join(blocks.withColumnRenamed("least", "shortest"), "token").where(F.col("shortest") <= F.col("longest"))

    def _postings(self, plan: DataFrame) -> DataFrame:
        read = self._blocks(plan).select("query_id", "idf", "floor", "rest", "longest", F.explode(F.arrays_zip("ids", "dls")).alias("p"))
        return read.select("query_id", "idf", "floor", "rest", F.col("p.ids").alias("id"), F.col("p.dls").alias("dl"), "longest").where(F.col("dl") <= F.col("longest"))

    def _candidates(self, plan: DataFrame) -> DataFrame:
        """query_id, id of documents that may get there by what is read of them and what the other tokens could add."""
        sums = self._postings(plan).groupBy("query_id", "id").agg(F.sum("idf").alias("sure"), F.first("dl").alias("dl"), F.first("floor").alias("floor"), F.first("rest").alias("rest"))
        return sums.where(self._norm(F.col("dl")) * (F.col("sure") + F.col("rest")) >= F.col("floor")).select("query_id", "id")

    def search(self, queries: DataFrame, k: int = 8) -> DataFrame:
        """query_id, id, score, rank of the k best documents of each query (query_id, question),
        those that share a token with it and have a positive score; ties to the smaller id."""
        plan = scratch.stored(self.plan(queries, k), "plan")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        scores = self._exact(self._candidates(plan), plan)
        return scores.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= k) & (F.col("score") > 0))

    def reading(self, queries: DataFrame, k: int = 8) -> DataFrame:
        """One row: how many blocks the tokens of all queries have, how many of them a search
        reads, and how many candidates it scores; for tests and tuning."""
        plan = scratch.stored(self.plan(queries, k), "plan")
        every = plan.select("query_id", "token").join(self.postings.select("token", "block"), "token").agg(F.count("*").alias("blocks"))
        one = lambda df, name: df.agg(F.count("*").alias(name))
        return every.join(one(self._blocks(plan), "blocks_read")).join(one(self._postings(plan), "postings_read")).join(one(self._candidates(plan), "candidates"))


def bm25(queries: DataFrame, docs: DataFrame, k: int = 8) -> DataFrame:
    """The k best of docs (id, text) for each of the queries (query_id, question): query_id, id, score, rank.
    One search does not pay for an index of its own, so the documents are scanned."""
    return keyword_scan.bm25(queries, docs, k)
