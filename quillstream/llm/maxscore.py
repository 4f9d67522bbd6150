"""Exact top-k inner products by MaxScore.

A dimension is a term; its postings in a shard are the shard's components in
that dimension, kept as one contiguous list a term. For a query, a term's bound
in a block of postings is the largest contribution any posting can make, and its
gain that over the least one. Terms are in the order of their mean gain for the
queries at hand; the longest tail whose gains together cannot lift a vector to
the query's current k-th score is non-essential. Only the essential postings are
read, ``STEP`` terms at a time, each for the queries that need it; a vector stays
a candidate while its sum and the bounds of its unread terms reach the threshold;
the non-essential terms are then probed for the candidates alone, dropping those
that fall behind. Shards hand in their best k, which are merged.

Postings are in blocks of vectors near each other (by their sign pattern), whose
bounds are tight; blocks are visited in descending order of bound, each by the
queries whose threshold its bound reaches. Thresholds start from the k-th score
of each query over ``SEEDS`` vectors of least hash, found in a first pass, so
that no shard starts from nothing.

Defined cases: vectors that are null or empty, or hold null or non-finite
components, and rows without an id take no part; vectors of another length than
a query count as zero in the missing dimensions; rows with the query's id are
its own; repeated rows are separate candidates; ties go to the smaller id; a
query with fewer candidates than k gets all; several rows of one query id are
one query, which gets the best of all; other columns are ignored, whatever their
names. Scores are exact; components over 2**31 in size raise an error, as sums
of their products need not be whole numbers of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.common import stored, worker_state

#: Vectors of a shard and queries of a group: what one task holds.
SHARD, GROUP = 16_384, 2_048
#: Vectors of a block of postings, queries that visit it together, terms that are read at once.
BLOCK, TOGETHER, STEP = 1_024, 256, 8
#: Candidates are probed once they are at most one of so many vectors; while they are
#: more, the next terms are read like essential ones, which costs less than probing.
FEW = 4
#: Vectors that the first pass looks at.
SEEDS = 2_048
#: Cells for each task where there are many.
CELLS = 64
LARGEST = 2**31


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """id and floor(scale * x) of each usable vector, as array<long>."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    ints = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), ints.alias("v"), bad.alias("bad")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.col("bad")).select("id", "v")


class Shard:
    """Postings of some vectors, in blocks; numbers are float64 where sums are exact, else int64."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        signs = np.packbits(vectors[:, : min(16, vectors.shape[1])] > 0, axis=1)
        order = np.lexsort((ids, *signs.T)) if len(ids) > BLOCK else np.argsort(ids, kind="stable")
        self.ids, vectors = ids[order], vectors[order]
        self.largest = int(np.abs(vectors).max(initial=0))
        self.blocks = []
        for lo in range(0, len(ids), BLOCK):
            part = np.ascontiguousarray(vectors[lo : lo + BLOCK].T)  # a row for each term
            self.blocks.append((self.ids[lo : lo + BLOCK], part, part.max(axis=1), part.min(axis=1)))


def exact_type(a: int, b: int, terms: int) -> type:
    most = max(1, a) * max(1, b) * max(1, terms)
    return np.float32 if most < 2**23 else np.float64 if most < 2**52 else np.int64


@dataclass
class Read:
    """What a search touched: postings that were there, read and probed; blocks that were there and visited."""

    postings: int = 0
    read: int = 0
    probed: int = 0
    blocks: int = 0
    visited: int = 0


class Best:
    """The k best of each query so far, by score and then smaller id; only what reaches ``least`` matters."""

    def __init__(self, n: int, k: int, least: np.ndarray | None = None):
        self.k = k
        self.ids: list[np.ndarray] = [np.empty(0, np.int64)] * n
        self.scores: list[np.ndarray] = [np.empty(0, np.int64)] * n
        self.least = np.full(n, -np.inf) if least is None else least.astype(float)

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(scores) > 4 * self.k:
            enough = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            ids, scores = ids[enough], scores[enough]
        ids, scores = np.concatenate([self.ids[q], ids]), np.concatenate([self.scores[q], scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids[q], self.scores[q] = ids[order], scores[order]
        if len(order) == self.k:
            self.least[q] = max(self.least[q], below(self.scores[q][-1:])[0])


def below(scores: np.ndarray) -> np.ndarray:
    """Whole numbers as floats that are not above them."""
    out = scores.astype(float)
    return np.where(np.abs(out) < 2**52, out, np.nextafter(out, -np.inf))


def search_block(queries: np.ndarray, own: np.ndarray, places: np.ndarray, block, best: Best, read: Read) -> None:
    """MaxScore of some queries over one block of postings."""
    ids, postings, top, low = block
    read.blocks += len(queries)
    read.postings += queries.size * len(ids)
    bounds = np.where(queries > 0, queries * top, queries * low)  # the most that a term can add
    live = bounds.sum(axis=1) >= best.least[places]
    if not live.any():
        return
    queries, own, places, bounds = queries[live], own[live], places[live], bounds[live]
    floors = np.where(queries > 0, queries * low, queries * top)
    least = best.least[places]
    gains = bounds - floors
    order = np.argsort(-gains.mean(axis=0), kind="stable")
    # reach[:, j]: what the terms from the j-th on can gain together.
    reach = np.cumsum(gains[:, order[::-1]], axis=1, dtype=float)[:, ::-1]
    tail = (reach < (least - floors.sum(axis=1))[:, None]).sum(axis=1)
    essential = queries.shape[1] - tail
    queries, bounds = queries[:, order], bounds[:, order]
    width, ends = queries.shape[1], np.concatenate([np.zeros((len(bounds), 1)), np.cumsum(bounds, axis=1, dtype=float)], axis=1)
    needed = least[:, None] - (ends[:, -1:] - ends)  # by the first j terms, to stay a candidate
    read.visited += len(queries)
    sums = np.zeros((len(queries), len(ids)), postings.dtype)
    reading = np.arange(len(queries))  # queries whose postings are read for all vectors
    rows, at, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, postings.dtype)
    for j in range(0, width, STEP):
        upto, terms = min(j + STEP, width), order[j : j + STEP]
        if len(rows):  # probing, for the candidates alone
            scores = scores + (queries[rows, j:upto] * postings[terms[None, :], at[:, None]]).sum(axis=1)
            read.probed += len(rows) * len(terms)
            keep = scores >= needed[rows, upto]
            rows, at, scores = rows[keep], at[keep], scores[keep]
        if len(reading):
            sums[reading] += queries[reading, j:upto] @ postings[terms]
            read.read += len(reading) * len(terms) * len(ids)
            # Past the essential terms a query whose candidates are few goes over to probing them.
            past = reading[essential[reading] <= upto]
            if len(past):
                alive = sums[past] >= needed[past, upto][:, None]
                few = alive.sum(axis=1) <= (len(ids) if upto == width else len(ids) // FEW)
                r, a = np.nonzero(alive[few])
                r = past[few][r]
                keep = own[r] != ids[a]
                rows, at = np.concatenate([rows, r[keep]]), np.concatenate([at, a[keep]])
                scores = np.concatenate([scores, sums[r[keep], a[keep]]])
                reading = np.setdiff1d(reading, past[few], assume_unique=True)
    order = np.argsort(rows, kind="stable")
    rows, at, scores = rows[order], at[order], scores[order]
    if len(rows):
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(rows)], strict=True):
            best.add(places[rows[a]], ids[at[a:b]], scores[a:b].astype(np.int64))


def search(query_ids: np.ndarray, queries: np.ndarray, shard: Shard, k: int, least: np.ndarray | None = None, read: Read | None = None) -> Best:
    """The best of each query in a shard, of which only what reaches ``least`` matters."""
    kind = exact_type(int(np.abs(queries).max(initial=0)), shard.largest, queries.shape[1])
    best, read = Best(len(query_ids), k, least), Read() if read is None else read
    queries = queries.astype(kind)
    blocks = [(i, p.astype(kind), t.astype(kind), m.astype(kind)) for i, p, t, m in shard.blocks]
    for lo in range(0, len(query_ids), TOGETHER):
        q = queries[lo : lo + TOGETHER]
        places = np.arange(lo, lo + len(q))
        whole = [np.where(q > 0, q * t, q * m).sum() for _, _, t, m in blocks]
        for b in np.argsort(whole)[::-1]:
            search_block(q, query_ids[lo : lo + TOGETHER], places, blocks[b], best, read)
    return best


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of each cell together; they arrive sorted by cell."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        cells = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if held and held[0].column(0)[0].as_py() != cells[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _matrix(arrays: list[pa.Array], width: int) -> np.ndarray:
    out = np.zeros((sum(len(a) for a in arrays), width), np.int64)
    row = 0
    for a in arrays:
        flat, at = a.values.to_numpy(zero_copy_only=False), a.offsets.to_numpy()
        if len(a) and (np.diff(at) == width).all():
            out[row : row + len(a)] = flat[at[0] : at[-1]].reshape(len(a), width)
        else:
            for i, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True)):
                out[row + i, : y - x] = flat[x:y]
        row += len(a)
    if np.abs(out).max(initial=0) > LARGEST:
        raise OverflowError("a component is over 2**31")
    return out


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of each cell together; they arrive sorted by cell."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        cells = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if held and held[0].column(0)[0].as_py() != cells[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _found(queries: DataFrame, candidates: DataFrame, k: int, shards: int, groups: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each query (id, v, least) in each shard."""
    spark = candidates.sparkSession
    of_query = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(groups)).cast("int")
    of_vector = F.pmod(F.xxhash64("id", "v", F.lit(5)), F.lit(shards)).cast("int")
    left = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"), of_query.alias("g"), "id", "v", F.lit(True).alias("asks"), "least")
    right = candidates.select(of_vector.alias("s"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "id", "v", F.lit(False).alias("asks"), F.lit(None).cast("long").alias("least"))
    both = left.unionByName(right).select((F.col("s").cast("long") * groups + F.col("g")).alias("cell"), "id", "v", "asks", "least")

    def run(batches):
        worker_state("maxscore", bool)  # lets go of other operators' memos
        for cell in _cells(batches):
            cell = cell.combine_chunks()
            asks = cell.column("asks").to_numpy()
            ids = cell.column("id").to_numpy()
            lists = cell.column("v").chunks
            width = max(int(np.diff(a.offsets.to_numpy()).max(initial=0)) for a in lists)
            v = _matrix(lists, width)
            if not asks.any() or asks.all():
                continue
            known = cell.column("least")
            least = np.where(known.is_null().to_numpy()[asks], -np.inf, below(known.fill_null(0).to_numpy()[asks]))
            best = search(ids[asks], v[asks], Shard(ids[~asks], v[~asks]), k, least)
            n = [len(x) for x in best.ids]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[asks], n)), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.scores))], names=["query_id", "vec_id", "score"])

    tasks = min(shards * groups, max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), shards * groups // CELLS))
    return both.repartition(tasks, "cell").sortWithinPartitions("cell").mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, shard: int = SHARD, group: int = GROUP, seeds: int = SEEDS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query.

    Both inputs have id and v (array<long>). Queries are dealt into groups and
    candidates into shards of bounded size by hash; a cell of the grid is one
    group over one shard, so no task holds more than that however many rows
    there are, and nothing is broadcast.
    """
    queries, candidates = queries.select("id", "v"), candidates.select("id", "v")
    shards = candidates.count() // shard + 1
    groups = queries.count() // group + 1
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if shards > 1:
        few = candidates.orderBy(F.xxhash64("id", "v", F.lit(9)), "id", "v").limit(seeds)
        first = _found(queries.withColumn("least", F.lit(None).cast("long")), few, k, 1, groups)
        first = first.withColumn("n", F.row_number().over(order)).where(F.col("n") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
        queries = queries.join(stored(first, "seeds"), "id", "left")
    else:
        queries = queries.withColumn("least", F.lit(None).cast("long"))
    found = _found(queries, candidates, k, shards, groups)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
