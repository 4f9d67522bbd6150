"""Connected components by alternating stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import compact, forget, stored


def _mark(edges: DataFrame):
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node hands its larger (or its smaller) neighbours to its least one.

    Minima are sums with partial sums before the shuffle; a node with very many
    neighbours meets its one minimum in a join that adaptive execution splits.
    """
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    met = both.join(least, both["a"] == least["u"])
    if large:
        out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, size_of: DataFrame | None = None) -> DataFrame:
    """(a, b) edges to (node, root): every node that has an edge, and the least node it reaches.

    The roots themselves are not listed. The number of rounds grows with the
    logarithm of the longest chain; each round ends in a written table.
    ``size_of`` is a table whose size bounds the edges', for the number of files.
    """
    def written(df):
        return stored(df if size_of is None else compact(df, size_of), "edges")

    now = edges.select("a", "b").where("a <> b")
    mark = None
    while True:
        new = written(_star(_star(now, True), False))
        forget(now)
        now, before, mark = new, mark, _mark(new)
        if mark == before or not mark[0]:
            break
    out = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out._stored_at = now._stored_at
    return out
