"""Numbers of rows in an order, without a task that sees them all.

Rows are dealt over tasks by ranges of the order's columns, sorted there and written
down once; a row's number is its place in its range and what other ranges hold
before it. Rows alike in all columns may come in any order, so a number of their
own spreads them too: no value, however frequent, is one task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.sources import scratch


def _ranged(rows: DataFrame, *order: str) -> DataFrame:
    """rows with __part (the number of a range) and __at (the place in it, from 0)."""
    marked = rows.withColumn("__row", F.monotonically_increasing_id())
    dealt = marked.repartitionByRange(*order, "__row").sortWithinPartitions(*order, "__row").drop("__row")
    # The number that Spark gives has the partition in its upper bits and the place in it below.
    held = scratch.stored(dealt.withColumn("__id", F.monotonically_increasing_id()), "ranges")
    return held.select("*", F.shiftright("__id", 33).alias("__part"), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")).drop("__id")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with place: their number from 1 in the order of these columns. A count a range comes to the driver."""
    held = _ranged(rows, *order)
    before, upto = [], 0
    for r in held.groupBy("__part").agg(F.count("*").alias("n")).orderBy("__part").collect():
        before += [F.lit(r["__part"]), F.lit(upto)]
        upto += r["n"]
    start = F.element_at(F.create_map(*before), F.col("__part")) if before else F.lit(0)
    return held.withColumn("place", (start + F.col("__at") + 1).cast("long")).drop("__part", "__at")


def ranked(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with place: their number from 1 among those alike in ``by``, in the order of ``order``.
    A window runs over the ranges that a value lies in, not over its rows; null is a value."""
    held = _ranged(rows, *by, *order)
    spans = held.groupBy("__part", *by).agg(F.min("__at").alias("__from"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__part")) - F.col("__n")
    spans = spans.withColumn("__before", before).select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__{c}") for c in by], "__from", "__before")
    on = held["__part"] == spans["__p"]
    for c in by:
        on = on & held[c].eqNullSafe(spans[f"__{c}"])
    met = held.join(spans, on)
    return met.select(*rows.columns, (F.col("__before") + F.col("__at") - F.col("__from") + 1).cast("long").alias("place"))
