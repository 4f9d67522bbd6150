"""Exact nearest neighbours of many queries at once.

Queries and vectors of one collection meet in a grid: queries in groups,
vectors in shards, both of bounded size and dealt by hash. A cell computes its
distances in one array operation and hands on its best k of each query, so a
collection of any size is spread over many tasks and nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD, GROUP = 8_192, 512
#: Pairs of a query and another row that a task works out at once (8 MB for each of the matrices it makes of them).
PAIRS = 1 << 20
DIGITS = 9


def score(distance: Column) -> Column:
    """1 / (1 + distance); negative distances count as 0, missing ones score 0."""
    d = distance.cast("double")
    return F.when(d.isNull() | F.isnan(d), 0.0).otherwise(1 / (1 + F.greatest(d, F.lit(0.0))))


def _rows(lists: pa.ListArray) -> np.ndarray:
    """A matrix of lists of one length."""
    flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    width = int(at[1] - at[0])
    return flat[at[0] : at[-1]].reshape(len(lists), width).astype(np.float64)


def _nearest(queries: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the k nearest of each query, by distance and place.

    One matrix product gives distances up to rounding, for a bounded number of pairs at
    a time; those that may be among the k nearest are worked out again, term by term."""
    step = max(1, PAIRS // len(vectors))
    if len(queries) > step:
        parts = [_nearest(queries[i : i + step], vectors, k) for i in range(0, len(queries), step)]
        return [x for at, _ in parts for x in at], [x for _, d in parts for x in d]
    rough = (queries**2).sum(axis=1)[:, None] - 2 * queries @ vectors.T + (vectors**2).sum(axis=1)[None, :]
    kth = np.partition(rough, min(k, len(vectors)) - 1, axis=1)[:, min(k, len(vectors)) - 1]
    slack = 1e-9 * (1 + (queries**2).sum(axis=1) + (vectors**2).sum(axis=1).max()) + 10.0**-DIGITS
    out_at, out_d = [], []
    for n, q in enumerate(queries):
        at = np.flatnonzero(rough[n] <= kth[n] + slack[n])
        d = np.round(((vectors[at] - q) ** 2).sum(axis=1), DIGITS)
        order = np.argsort(d, kind="stable")[:k]
        out_at.append(at[order])
        out_d.append(d[order])
    return out_at, out_d


def by_cell(batches, work):
    """Rows sorted by their first column, a cell's number, to the batches that ``work`` makes of each cell's table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        cells = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and held[0].column(0)[0].as_py() != cells[a]:
                yield from work(pa.Table.from_batches(held).combine_chunks())
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield from work(pa.Table.from_batches(held).combine_chunks())


def _grid(k: int):
    names, kinds = ("query_id", "id", "raw_distance"), (pa.int64(), pa.int64(), pa.float64())

    def best(cell: pa.Table) -> Iterator[pa.RecordBatch]:
        asks = cell.column("asks").to_numpy()
        if asks.all() or not asks.any():
            return
        ids, v = cell.column("id").to_numpy(), _rows(cell.column("v").chunk(0))
        order = np.flatnonzero(~asks)[np.argsort(ids[~asks], kind="stable")]
        at, d = _nearest(v[asks], v[order], k)
        columns = np.repeat(ids[asks], [len(x) for x in at]), ids[order][np.concatenate(at)], np.concatenate(d)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return lambda batches: by_cell(batches, best)


def searchable(df: DataFrame, name: str, by: str | None) -> DataFrame:
    """id, v, kb, width of the rows that can take part in a search."""
    v, key = F.col("embedding"), F.col(by) if by else F.lit(0)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    where = F.col("id").isNotNull() & F.col("kb").isNotNull() & (F.col("width") > 0) & ~F.col("odd")
    return df.select(F.col(name).cast("long").alias("id"), v.cast("array<double>").alias("v"), key.alias("kb"), F.size(v).alias("width"), odd.alias("odd")).where(where).drop("odd")


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 8, by: str | None = "kb", shard: int = SHARD, group: int = GROUP) -> DataFrame:
    """query_id, id, raw_distance, score, rank of each query's k nearest vectors.

    queries: query_id, embedding and ``by``; vectors: id, embedding and ``by``.
    Distance is squared Euclidean; ties go to the smaller id. Rows without an
    id, embedding or collection, and embeddings that are empty or hold a null or a
    number that is not finite, take no part; vectors of another length than a
    query's are none of its neighbours.
    """
    left, right = searchable(queries, "query_id", by), searchable(vectors, "id", by)
    size = right.groupBy("kb", "width").agg((F.floor(F.count("*") / shard) + 1).alias("shards"))
    asks = left.groupBy("kb", "width").agg((F.floor(F.count("*") / group) + 1).alias("groups"))
    plan = size.join(asks, ["kb", "width"])
    cell = F.xxhash64("kb", "width", "s", "g").alias("cell")
    l = left.join(plan, ["kb", "width"]).select("kb", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("s"), F.pmod(F.xxhash64("id", F.lit(3)), F.col("groups")).alias("g"), "id", "v", F.lit(True).alias("asks"))
    r = right.join(plan, ["kb", "width"]).select("kb", "width", F.pmod(F.xxhash64("id", F.lit(5)), F.col("shards")).alias("s"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("g"), "id", "v", F.lit(False).alias("asks"))
    both = l.unionByName(r).select(cell, "id", "v", "asks")
    met = both.repartition("cell").sortWithinPartitions("cell").mapInArrow(_grid(k), "query_id long, id long, raw_distance double")
    order = Window.partitionBy("query_id").orderBy("raw_distance", "id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("score", score(F.col("raw_distance")))


def hit_fields(bbox: Column, chunk_index: Column | None = None) -> Column:
    """struct(y_top, y_bottom, chunk_index) of a stored hit: the second and fourth
    numbers of its box, and its chunk's number; null where they are none."""
    parts = F.split(bbox, ",")
    number = lambda i: F.trim(F.get(parts, F.lit(i))).try_cast("double")
    chunk = F.lit(None).cast("int") if chunk_index is None else F.trim(chunk_index.cast("string")).try_cast("int")
    return F.struct(number(1).alias("y_top"), number(3).alias("y_bottom"), chunk.alias("chunk_index"))


def filtered(vectors: DataFrame, kb: str | int | None = None, uploader=None, document=None, source_type=None, contains: str | None = None, extra: dict | None = None) -> DataFrame:
    """Conjunction of the equalities that are given, and of a text's containment; pushed down to the scan."""
    wanted = {"kb": kb, "uploader_id": uploader, "document_id": document, "source_type": source_type} | (extra or {})
    for column, value in wanted.items():
        if value not in (None, ""):
            vectors = vectors.where(F.col(column) == F.lit(value))
    return vectors.where(F.col("document").contains(contains.strip())) if contains and contains.strip() else vectors


def merged(hits: DataFrame, k: int = 8, key: str = "id") -> DataFrame:
    """Hits of several variants of a query: the best score of each vector, its
    place that of its first sighting; variants by variant, then rank."""
    first = F.struct("variant", "rank")
    best = hits.groupBy("query_id", key).agg(F.max("score").alias("score"), F.min(first).alias("seen"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "seen")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", key, "score", "rank")
