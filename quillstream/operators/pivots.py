"""Exact nearest neighbours that leave out what triangles rule out.

A stored index deals the vectors of each collection to their nearest pivot, and
those of a pivot into rings by their distance to it. A ring (a cell, cut further
where it is large) has its least and largest distance to the pivot, so a query
at distance d from the pivot is at least ``d - largest`` and ``least - d`` away from
all its vectors. A search takes two looks: first each query visits the cells of
the smallest such bounds until they hold k vectors, which gives a threshold; then
all cells whose bound is not above it. What is left out cannot be among the k
nearest, so results are those of looking at every vector.

How much is left out depends on the vectors. Clustered ones leave most cells
unvisited; of random directions in many dimensions no bound rules anything out,
and a search does what a search without an index does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.operators import vector
from quillstream.operators.vector import DIGITS, GROUP, SHARD, _rows, by_cell, searchable
from quillstream.sources import scratch

#: Vectors for each pivot, and pivots of a collection at most (a matrix that a task holds).
PER, MOST = 4_096, 1_024
#: Rings for each doubling of the distance to the pivot.
RINGS = 2
MEMBERS = "kb {kb}, width int, pivot long, ring int, part long, id long, v array<double>, far double"
CELL = ("kb", "width", "pivot", "ring", "part")
#: Visits, each with its query's vector, that a task hands on at once.
VISITS_OUT = 8_192


def _dense(v: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return _rows(v.chunk(0) if isinstance(v, pa.ChunkedArray) else v)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances, up to rounding."""
    return np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] - 2 * a @ b.T + (b**2).sum(axis=1)[None, :], 0))


def _to_pivots(cell: pa.Table) -> Iterator[pa.RecordBatch]:
    """Of a cell of vectors and pivots: the nearest pivot of each vector and how far it is."""
    pivot = cell.column("pivot").to_numpy()
    if pivot.all() or not pivot.any():
        return
    ids, v = cell.column("id").to_numpy(), _dense(cell.column("v"))
    names, p = ids[pivot], v[pivot]
    order = np.argsort(names)
    names, p, v = names[order], p[order], v[~pivot]
    step = max(1, vector.PAIRS // len(p))
    nearest = np.concatenate([_distances(v[i : i + step], p).argmin(axis=1) for i in range(0, len(v), step)])
    far = np.sqrt(((v - p[nearest]) ** 2).sum(axis=1))
    rows = cell.filter(pa.array(~pivot))
    yield pa.RecordBatch.from_arrays([rows.column(c).combine_chunks() for c in ("kb", "width", "id", "v")] + [pa.array(names[nearest]), pa.array(far)], names=["kb", "width", "id", "v", "pivot", "far"])


class PivotIndex:
    """An index in a folder: ``members`` (vectors by cell), ``cells`` (count and distances) and ``pivots``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @classmethod
    def build(cls, vectors: DataFrame, path: str, by: str | None = "kb", per: int = PER, shard: int = SHARD) -> PivotIndex:
        """An index of vectors (id, embedding and ``by``) in a new folder. Rows that
        :func:`vector.nearest` leaves out are left out."""
        path, base = path.rstrip("/"), searchable(vectors, "id", by)
        kind = base.schema["kb"].dataType.simpleString()
        # A vector is a pivot if its hash is among the smallest part of its collection's.
        draw = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 31))
        sizes = base.groupBy("kb", "width").agg(F.count("*").alias("n"), F.min(draw).alias("least"))
        pivots = F.least(F.ceil(F.col("n") / per), F.lit(MOST))
        sizes = sizes.select("kb", "width", F.greatest("least", (pivots / F.col("n") * (1 << 31)).cast("long")).alias("until"), (F.floor(F.col("n") / shard) + 1).alias("shards"))
        told = base.join(sizes, ["kb", "width"])
        told.where(draw <= F.col("until")).select("kb", "width", F.col("id").alias("pivot"), "v").dropDuplicates(["kb", "width", "pivot"]).write.parquet(f"{path}/pivots")
        chosen = base.sparkSession.read.parquet(f"{path}/pivots").join(sizes, ["kb", "width"])
        # As many copies of the pivots as shards of vectors; a shard has a bounded number of both.
        p = chosen.select("kb", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("s"), F.col("pivot").alias("id"), "v", F.lit(True).alias("pivot"))
        r = told.select("kb", "width", F.pmod(F.xxhash64("id", F.lit(5)), F.col("shards")).alias("s"), "id", "v", F.lit(False).alias("pivot"))
        both = p.unionByName(r).select(F.xxhash64("kb", "width", "s").alias("cell"), "kb", "width", "id", "v", "pivot")
        near = both.repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda b: by_cell(b, _to_pivots), f"kb {kind}, width int, id long, v array<double>, pivot long, far double")
        ring = F.when(F.col("far") > 0, F.floor(F.log2("far") * RINGS)).otherwise(-10_000).cast("int")
        near = scratch.stored(near.withColumn("ring", ring), "near")
        parts = near.groupBy("kb", "width", "pivot", "ring").agg((F.floor(F.count("*") / shard) + 1).alias("parts"))
        members = near.join(parts, ["kb", "width", "pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(13)), F.col("parts")))
        members.select(*CELL, "id", "v", "far").repartition(*CELL).sortWithinPartitions(*CELL).write.parquet(f"{path}/members")
        out = cls(base.sparkSession, path)
        out._read("members").groupBy(*CELL).agg(F.count("*").alias("n"), F.min("far").alias("least"), F.max("far").alias("most")).write.parquet(f"{path}/cells")
        return out

    def _visits(self, asks: DataFrame, k: int, all_within: bool) -> DataFrame:
        """query_id, v and the cells that each query of asks (id, v, kb, width, limit) visits: those of
        the smallest bounds until they hold k vectors, or all whose bound is not above ``limit``."""
        cells = self._read("cells").groupBy("kb", "width", "pivot").agg(F.collect_list(F.struct("ring", "part", "n", "least", "most")).alias("cells"))
        known = self._read("pivots").join(cells, ["kb", "width", "pivot"])
        groups = asks.groupBy("kb", "width").agg((F.floor(F.count("*") / GROUP) + 1).alias("groups"))
        empty = F.array().cast("array<struct<ring:int,part:bigint,n:bigint,least:double,most:double>>")
        q = asks.join(groups, ["kb", "width"]).select("kb", "width", F.pmod(F.xxhash64("id", F.lit(3)), F.col("groups")).alias("g"), "id", "v", "limit", empty.alias("cells"))
        p = known.join(groups, ["kb", "width"]).select("kb", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("g"), F.col("pivot").alias("id"), "v", F.lit(None).cast("double").alias("limit"), "cells")
        both = q.unionByName(p).select(F.xxhash64("kb", "width", "g").alias("group"), "id", "v", "limit", "cells", "kb", "width")
        kind = asks.schema["kb"].dataType.simpleString()

        def choose(group: pa.Table) -> Iterator[pa.RecordBatch]:
            limit = group.column("limit").to_numpy(zero_copy_only=False)
            asking = ~np.isnan(limit)
            if asking.all() or not asking.any():
                return
            ids, v = group.column("id").to_numpy(), _dense(group.column("v"))
            lists = group.column("cells").combine_chunks().filter(pa.array(~asking))
            of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            told = lists.flatten()
            ring, part, n, least, most = (told.field(i).to_numpy(zero_copy_only=False) for i in range(5))
            asks, pivot, pivots = np.flatnonzero(asking), ids[~asking][of], v[~asking]
            kb, width, vectors = (group.column(c).combine_chunks() for c in ("kb", "width", "v"))
            # The cells grow with the index: so many queries at a time that their pairs stay bounded.
            step = max(1, vector.PAIRS // len(of))
            for lo in range(0, len(asks), step):
                some = asks[lo : lo + step]
                far = _distances(v[some], pivots)[:, of]
                bound = np.maximum(np.maximum(far - most, least - far), 0)
                if all_within:
                    at_q, at_c = np.nonzero(bound <= limit[some][:, None] * (1 + 1e-9) + 1e-7)
                else:
                    order = np.lexsort((np.broadcast_to(np.arange(len(of)), bound.shape), far, bound), axis=1)
                    before = np.cumsum(n[order], axis=1) - n[order]
                    at_q, place = np.nonzero(before < k)
                    at_c = order[at_q, place]
                for a in range(0, len(at_c), VISITS_OUT):
                    c, rows = at_c[a : a + VISITS_OUT], pa.array(some[at_q[a : a + VISITS_OUT]])
                    columns = [kb.take(rows), width.take(rows), pa.array(pivot[c]), pa.array(ring[c]), pa.array(part[c]), pa.array(ids[rows.to_numpy()]), vectors.take(rows)]
                    yield pa.RecordBatch.from_arrays(columns, names=[*CELL, "id", "v"])

        return both.repartition("group").sortWithinPartitions("group").mapInArrow(lambda b: by_cell(b, choose), f"kb {kind}, width int, pivot long, ring int, part long, id long, v array<double>")

    def _met(self, visits: DataFrame, k: int) -> DataFrame:
        """query_id, id, raw_distance: the k nearest of each visited cell."""
        key = F.xxhash64(*CELL).alias("c")
        asked = visits.groupBy(key).agg((F.floor(F.count("*") / GROUP) + 1).alias("groups"))
        q = visits.select(key, "id", "v").join(asked, "c").select("c", F.pmod(F.xxhash64("id", F.lit(3)), F.col("groups")).alias("g"), "id", "v", F.lit(True).alias("asks"))
        m = self._read("members").select(key, "id", "v").join(asked, "c").select("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("g"), "id", "v", F.lit(False).alias("asks"))
        both = q.unionByName(m).select(F.xxhash64("c", "g").alias("cell"), "id", "v", "asks")
        return both.repartition("cell").sortWithinPartitions("cell").mapInArrow(vector._grid(k), "query_id long, id long, raw_distance double")

    def _two_looks(self, queries: DataFrame, k: int, by: str | None) -> DataFrame:
        """The visits of the second look."""
        asks = scratch.stored(searchable(queries, "query_id", by).withColumn("limit", F.lit(0.0)), "asks")
        first = self._met(self._visits(asks, k, all_within=False), k)
        nth = first.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("raw_distance", "id"))).where(F.col("n") == k)
        # Distances are told to so many digits, and ties at the last of them go by id.
        limits = nth.select(F.col("query_id").alias("id"), F.sqrt(F.col("raw_distance") + 10.0**-DIGITS).alias("limit"))
        told = asks.drop("limit").join(limits, "id", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
        return self._visits(scratch.stored(told.select("id", "v", "kb", "width", "limit"), "limits"), k, all_within=True)

    def nearest(self, queries: DataFrame, k: int = 8, by: str | None = "kb") -> DataFrame:
        """query_id, id, raw_distance, score, rank of the k nearest vectors of each query
        (query_id, embedding and ``by``), as :func:`vector.nearest` gives them."""
        met = self._met(scratch.stored(self._two_looks(queries, k, by), "visits"), k)
        order = Window.partitionBy("query_id").orderBy("raw_distance", "id")
        return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("score", vector.score(F.col("raw_distance")))

    def visited(self, queries: DataFrame, k: int = 8, by: str | None = "kb") -> DataFrame:
        """One row: cells that all queries together could visit, and that they do."""
        cells = self._read("cells").groupBy("kb", "width").agg(F.count("*").alias("n"))
        could = searchable(queries, "query_id", by).join(cells, ["kb", "width"]).agg(F.sum("n").alias("cells"))
        return could.join(self._two_looks(queries, k, by).agg(F.count("*").alias("visited")))
