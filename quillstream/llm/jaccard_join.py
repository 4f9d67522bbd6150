"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of word shingles. Copies of one word sequence are one class, so
only classes are compared. Classes that agree in a band of MinHash values are
candidates; their values are compared a few at a time, and a pair is dropped as
soon as the posterior probability that its similarity reaches the threshold
falls below a tolerance. What is left is verified on the shingle sets.

No pair becomes a row. The members of a bucket are dealt into blocks; a task
compares two blocks and gives a row a member, with the places of its surviving
partners. A pair is looked at in the first band in which it agrees, so it is
verified and counted once. A bucket of any size is spread over many tasks.

Defined cases: null, empty and wordless texts have no shingles, link to nothing
and are classes of their own; texts of fewer words than a shingle are one
shingle of all their words; repeated rows are copies; ties go to the smaller id;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillstream.llm.common import bit_filter, compact, forget, in_filter, stored, tasks_for, words_of, worker_state
from quillstream.llm.components import components

WORDS, THRESHOLD = 5, 0.8
#: 32 bands of 5 values: a pair at 0.8 agrees in none with probability 3e-6.
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: A byte of each MinHash value, eight to a column.
SIG = [f"s{i}" for i in range(HASHES // 8)]
#: After so many values a pair is judged.
STEPS = (20, 40, 80, HASHES)
TOLERANCE = 1e-6
#: Members of a block of a bucket.
BLOCK = 512
#: Words whose hashes a worker remembers, about 150 bytes each.
MEMO = 200_000
#: Rows that a task hands on at once.
ROWS_OUT = 8_192
#: Cells of a block's incidence matrix (4 bytes each) before sets are met in pairs.
CELLS = 16_000_000

_RNG = np.random.default_rng(20240501)
_A = (_RNG.integers(0, 2**32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _RNG.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)
_C = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Hasher(dict):
    """Word to 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def hasher() -> Hasher:
    return worker_state("hasher", Hasher)


def word_list(text: str | None) -> list[bytes]:
    return words_of(text.lower()) if text else []


def key_of(words: list[bytes]) -> bytes | None:
    """The class of copies: the word sequence."""
    return hashlib.md5(b" ".join(words), usedforsecurity=False).digest() if words else None


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x


def shingles(lists: list[list[bytes]], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of several non-empty word lists, one after another, and where each list starts."""
    look = hasher()
    sizes = np.array([len(x) for x in lists])
    h = np.fromiter((look[w] for x in lists for w in x), dtype=np.uint64, count=int(sizes.sum()))
    out = h * _C[0]
    for j in range(1, n):
        out[:-j] += h[j:] * _C[j]
    counts = np.maximum(sizes - n + 1, 1)
    first = np.cumsum(sizes) - sizes
    starts = np.cumsum(counts) - counts
    if (sizes < n).any():  # sums over fewer words, told apart by their number
        for i in np.flatnonzero(sizes < n):
            a, k = first[i], sizes[i]
            out[a] = np.uint64((sum(int(h[a + j]) * int(_C[j]) for j in range(k)) + int(_C[n + k])) & (2**64 - 1))
    picked = np.repeat(first - starts, counts) + np.arange(counts.sum())
    return _mix(out[picked]), starts


def signatures(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A byte of each MinHash value, a row for each list."""
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), HASHES), np.uint8)
    for k in range(HASHES):
        least = np.minimum.reduceat(h * _A[k] + _B[k], starts)
        out[:, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return out


def signed(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS) -> DataFrame:
    """doc_id, key (two halves) and signature of every row; null without words."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists = [word_list(t) for t in part.column(1).to_pylist()]
                none = np.array([not x for x in lists])
                full = [x for x in lists if x]
                longs = np.zeros((len(lists), 2 + len(SIG)), np.int64)
                if full:
                    longs[~none, :2] = np.frombuffer(b"".join(map(key_of, full)), np.int64).reshape(-1, 2)
                    longs[~none, 2:] = signatures(*shingles(full, n)).view(np.int64)
                columns = [pa.array(np.ascontiguousarray(c), mask=none) for c in longs.T]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "k1", "k2", *SIG])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, " + ", ".join(f"{c} long" for c in SIG))


def bands() -> list:
    """The bucket of each band as a column: the band's number over its bytes."""
    out = []
    for b in range(BANDS):
        word, bit = divmod(ROWS * 8 * b, 64)
        code = F.shiftrightunsigned(SIG[word], bit)
        if bit + 8 * ROWS > 64:
            code = code.bitwiseOR(F.shiftleft(SIG[word + 1], 64 - bit))
        out.append(code.bitwiseAND(F.lit((1 << (8 * ROWS)) - 1)).bitwiseOR(F.lit(b << 40).cast("long")))
    return out


@functools.cache
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each step the fewest equal values with which a pair stays.

    Equal bytes have probability p = J + (1 - J) / 256. With a uniform prior the
    posterior of p after m of n is a Beta; its tail over the threshold's p is
    integrated on a grid.
    """
    grid = (np.arange(200_000) + 0.5) / 200_000
    over = grid >= threshold + (1 - threshold) / 256
    out = {}
    for n in STEPS:
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            mass = np.exp(log - log.max())
            if mass[over].sum() / mass.sum() >= tolerance:
                out[n] = m
                break
    return out


def groups_of(batches, columns):
    """Arrays of the rows that agree in the first two columns; rows arrive sorted
    by them, and columns turns a batch into arrays."""
    held = None
    for batch in batches:
        now = columns(batch)
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        cuts = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])) + 1
        starts = [0, *cuts.tolist()]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield [x[a:b] for x in now]
        held = [x[starts[-1] :] for x in now]
    if held is not None:
        yield held


class Out:
    """Rows of many groups, handed on in batches of some size."""

    def __init__(self, names: list[str]):
        self.names, self.parts, self.rows = names, [], 0

    def add(self, *columns) -> None:
        self.parts.append(columns)
        self.rows += len(columns[0])

    def full(self) -> bool:
        return self.rows >= ROWS_OUT

    def batch(self) -> pa.RecordBatch:
        """Columns are arrays; a list column is a pair of sizes and values."""
        arrays = []
        for column in zip(*self.parts, strict=True):
            if isinstance(column[0], tuple):
                sizes, values = (np.concatenate(x) for x in zip(*column, strict=True))
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)))
            else:
                arrays.append(pa.array(np.concatenate(column)))
        self.parts, self.rows = [], 0
        return pa.RecordBatch.from_arrays(arrays, names=self.names)


def survivors(sigs: np.ndarray, side: np.ndarray, band: int, floor: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of a block, or of two, that pruning leaves; each in its first common band."""
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1)
    inner = not len(right)
    if inner:
        right = left
    codes = sigs.reshape(len(sigs), BANDS, ROWS)
    if len(left) * len(right) <= 4:
        i, j = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
        if inner:
            i, j = i[i < j], j[i < j]
        alive = np.ones(len(i), bool)
    else:
        alive = np.ones((len(left), len(right)), bool)
        if inner:
            alive = np.triu(alive, 1)
        a, b = sigs[left], sigs[right]
        same = np.zeros(alive.shape, np.uint8)
        for k in range(STEPS[0]):
            same += a[:, None, k] == b[None, :, k]
        alive &= same >= floor[STEPS[0]]
        i, j = np.nonzero(alive)
        i, j = left[i], right[j]
        alive = np.ones(len(i), bool)
    if len(i) and band:
        before = np.zeros(len(i), bool)
        for k in range(band):
            before |= (codes[i, k] == codes[j, k]).all(axis=1)
        i, j = i[~before], j[~before]
    for n in STEPS:
        if not len(i):
            break
        keep = (sigs[i, :n] == sigs[j, :n]).sum(axis=1) >= floor[n]
        i, j = i[keep], j[keep]
    return i, j


def _pruned(batches):
    floor = least_matches()
    out = Out(["bucket", "part", "place", "cid", "copies", "mates"])

    def columns(batch):
        get = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy()
        return [*map(get, ("bucket", "part", "cid", "copies", "side")), np.column_stack([get(c) for c in SIG]).view(np.uint8)]

    for bucket, part, ids, copies, side, sigs in groups_of(batches, columns):
        if len(ids) < 2:
            continue
        i, j = survivors(sigs, side, int(bucket[0]) >> 40, floor)
        if not len(i):
            continue
        used = np.unique(np.concatenate([i, j]))
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        mates = np.searchsorted(i, used, side="right") - np.searchsorted(i, used)
        out.add(bucket[used], part[used], used.astype(np.int32), ids[used], copies[used], (mates, j.astype(np.int32)))
        if out.full():
            yield out.batch()
    if out.rows:
        yield out.batch()


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets i and j."""
    if len(i) > 8:
        used = np.unique(np.concatenate([i, j]))
        sizes = [len(sets[u]) for u in used]
        vocab, at = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True)
        if len(vocab) * len(used) <= CELLS:
            grid = np.zeros((len(used), len(vocab)), np.float32)
            grid[np.repeat(np.arange(len(used)), sizes), at] = 1
            a, b = np.searchsorted(used, i), np.searchsorted(used, j)
            left = np.unique(a)
            met = grid[left] @ grid.T
            return met[np.searchsorted(left, a), b].astype(np.int64)
    return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)


def _verified(batches):
    limit = Fraction(str(THRESHOLD))
    out = Out(["cid", "root", "n_links", "n_linked"])

    def columns(batch):
        get = lambda name: batch.column(batch.schema.get_field_index(name))
        lists = [get(name) for name in ("mates", "shingles")]
        held = [np.empty(batch.num_rows, object) for _ in lists]
        for place, column in zip(held, lists, strict=True):
            place[:] = list(column)
        return [*(get(name).to_numpy() for name in ("bucket", "part", "place", "cid", "copies")), *held]

    for _, _, places, ids, copies, mates, shingles in groups_of(batches, columns):
        counts = np.array([len(m) for m in mates])
        if not counts.any():
            continue
        order = np.argsort(places)
        i = np.repeat(np.arange(len(ids)), counts)
        j = order[np.searchsorted(places, np.concatenate([m.values.to_numpy() for m in mates]), sorter=order)]
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in shingles]
        both = overlaps(sets, i, j)
        sizes = np.array([len(s) for s in sets])
        linked = both * limit.denominator >= limit.numerator * (sizes[i] + sizes[j] - both)
        i, j = i[linked], j[linked]
        if not len(i):
            continue
        links = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
        docs = np.zeros(len(ids), np.int64)
        np.add.at(docs, i, copies[j])
        np.add.at(docs, j, copies[i])
        root = list(range(len(ids)))

        def find(x, root=root):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                a, b = (a, b) if ids[a] < ids[b] else (b, a)
                root[b] = a
        used = np.flatnonzero(links)
        out.add(ids[used], ids[[find(u) for u in used.tolist()]], links[used].astype(np.int64), docs[used])
        if out.full():
            yield out.batch()
    if out.rows:
        yield out.batch()


def keys_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of texts and which texts have none."""
    found = [key_of(word_list(t.as_py())) for t in texts]
    none = np.array([k is None for k in found], bool)
    return np.frombuffer(b"".join(k or bytes(16) for k in found), np.int64).reshape(-1, 2), none


def shingle_sets(documents: DataFrame, wanted: DataFrame, text_col: str = "text", n: int = WORDS) -> DataFrame:
    """cid and shingle set of the wanted classes (cid, k1, k2). A filter of bounded
    size spares the others; what passes it wrongly falls out in an exact join."""
    words, bits = bit_filter(wanted)
    shared = documents.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        table, seen = shared.value, set()
        for batch in batches:
            keys, none = keys_of(batch.column(0))
            used, sets = [], []
            for at in np.flatnonzero(in_filter(table, bits, keys) & ~none).tolist():
                if (key := keys[at].tobytes()) in seen:
                    continue
                if len(seen) > MEMO:
                    seen.clear()
                seen.add(key)
                used.append(at)
                sets.append(np.unique(shingles([word_list(batch.column(0)[at].as_py())], n)[0]).tobytes())
            halves = [pa.array(np.ascontiguousarray(keys[used, i])) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*halves, pa.array(sets, pa.binary())], names=["k1", "k2", "shingles"])

    made = documents.select(text_col).mapInArrow(run, "k1 long, k2 long, shingles binary")
    return made.join(wanted, ["k1", "k2"]).groupBy("cid").agg(F.first("shingles").alias("shingles"))


def classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, reps, groups), all written tables. rows: doc_id and key (k1, k2) of
    each row. reps, a row a class of copies: cid, k1, k2, copy_id (least id),
    copies. groups, a row a linked class: k1, k2, class_id (its group's least id),
    first (whether it is the class of that id), n_links, n_linked."""
    tasks = tasks_for(documents)
    rows = stored(compact(signed(documents, id_col, text_col), documents), "signed")
    # All copies have the same signature; sums of whole numbers need no sorting.
    same = [F.min(c).alias(c) for c in SIG]
    per = rows.where(F.col("k1").isNotNull()).groupBy("k1", "k2").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("copies"), *same)
    # Written down, the number of a class stays what it is.
    reps = stored(compact(per.withColumn("cid", F.monotonically_increasing_id()), documents), "reps")
    dealt = reps.select("cid", F.explode(F.array(*bands())).alias("bucket"))
    full = dealt.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    # A bucket has one row in full, so a large bucket is on the streamed side alone.
    members = dealt.join(full.hint("shuffle_hash"), "bucket").select("bucket", "cid", parts.alias("c"), F.pmod(F.xxhash64("cid", F.lit(11)), parts).cast("int").alias("mine"))
    other = F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("other")
    placed = members.select("bucket", "cid", "c", "mine", other).select(
        "bucket", "cid", (F.least("mine", "other") * F.col("c") + F.greatest("mine", "other")).cast("long").alias("part"), F.when(F.col("mine") > F.col("other"), 1).otherwise(0).cast("byte").alias("side")
    )
    ready = placed.join(reps.select("cid", "copies", *SIG), "cid").select("bucket", "part", "side", "cid", "copies", *SIG)
    left = ready.repartition(tasks, "bucket", "part").sortWithinPartitions("bucket", "part").mapInArrow(_pruned, "bucket long, part long, place int, cid long, copies long, mates array<int>")
    pruned = stored(compact(left, documents), "pruned")
    wanted = pruned.select("cid").distinct().join(reps.select("cid", "k1", "k2"), "cid")
    sets = shingle_sets(documents, wanted, text_col)
    met = pruned.join(sets, "cid").select("bucket", "part", "place", "cid", "copies", "mates", "shingles")
    links = met.repartition(tasks, "bucket", "part").sortWithinPartitions("bucket", "part").mapInArrow(_verified, "cid long, root long, n_links long, n_linked long")
    linked = stored(compact(links, documents), "linked")
    forget(pruned)
    found = components(linked.select(F.col("cid").alias("a"), F.col("root").alias("b")), documents)
    roots = found.select(F.col("node").alias("cid"), "root").unionByName(found.select(F.col("root").alias("cid"), "root").distinct())
    counts = linked.groupBy("cid").agg(F.sum("n_links").alias("n_links"), F.sum("n_linked").alias("n_linked"))
    inside = roots.join(counts, "cid", "left").join(reps.select("cid", "k1", "k2", "copy_id"), "cid")
    best = inside.groupBy("root").agg(F.min(F.struct("copy_id", "k1", "k2")).alias("g"))
    zero = F.lit(0).cast("long")
    groups = inside.join(best, "root").select(
        "k1", "k2", F.col("g.copy_id").alias("class_id"), ((F.col("k1") == F.col("g.k1")) & (F.col("k2") == F.col("g.k2"))).alias("first"), F.coalesce("n_links", zero).alias("n_links"), F.coalesce("n_linked", zero).alias("n_linked")
    )
    groups = stored(compact(groups, documents), "groups")
    forget(linked)
    forget(found)
    return rows, reps.select("k1", "k2", "copy_id", "copies"), groups


def join(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document row: doc_id, class_id (least id of all that it is linked
    with, directly or by others), copy_id (least id of its exact copies), n_copies
    (other rows with its words), n_links (other word sequences linked directly),
    n_linked (their rows)."""
    rows, reps, groups = classes(documents, id_col, text_col)
    zero = F.lit(0).cast("long")
    info = reps.join(groups, ["k1", "k2"], "left")
    found = rows.where(F.col("k1").isNotNull()).select("doc_id", "k1", "k2").join(info, ["k1", "k2"])
    found = found.select("doc_id", F.when(F.col("first").isNull(), F.col("copy_id")).otherwise(F.col("class_id")).alias("class_id"), "copy_id", (F.col("copies") - 1).alias("n_copies"), F.coalesce("n_links", zero).alias("n_links"), F.coalesce("n_linked", zero).alias("n_linked"))
    bare = rows.where(F.col("k1").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), zero.alias("n_copies"), zero.alias("n_links"), zero.alias("n_linked"))
    return found.unionByName(bare)


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents, all columns, with one row of each group: the one of least id.

    Rows without words stay. Only rows that a bounded filter marks as copies or
    as linked are shuffled; the others, most of a corpus, pass straight through.
    """
    rows, reps, groups = classes(documents, id_col, text_col)
    # Of each class with copies or links: the id whose row stays, and whether it is in this class.
    told = reps.join(groups, ["k1", "k2"], "left").where((F.col("copies") > 1) | F.col("first").isNotNull())
    lone = F.col("first").isNull()
    told = stored(compact(told.select("k1", "k2", F.when(lone, F.col("copy_id")).otherwise(F.col("class_id")).alias("stays"), (lone | F.col("first")).alias("here")), documents), "special")
    forget(rows)
    forget(groups)
    words, bits = bit_filter(told)
    shared = documents.sparkSession.sparkContext.broadcast(words)
    at = documents.columns.index(text_col)

    def run(batches):
        worker_state("hasher", Hasher)
        table = shared.value
        for batch in batches:
            keys, none = keys_of(batch.column(at))
            none |= ~in_filter(table, bits, keys)
            halves = [pa.array(np.ascontiguousarray(keys[:, i]), mask=none) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *halves], schema=batch.schema.append(pa.field("__k1", pa.int64())).append(pa.field("__k2", pa.int64())))

    schema = StructType([*documents.schema.fields, StructField("__k1", LongType()), StructField("__k2", LongType())])
    marked = documents.mapInArrow(run, schema)
    clear = marked.where(F.col("__k1").isNull()).select(*documents.columns)
    told = told.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("stays").alias("__stays"), F.col("here").alias("__here"))
    asked = marked.where(F.col("__k1").isNotNull()).join(told, ["__k1", "__k2"], "left")
    # What passed the filter wrongly has no copies and stays; of a row that is repeated with its id one stays.
    stay = asked.where(F.col("__here").isNull() | (F.col("__here") & F.col(id_col).eqNullSafe(F.col("__stays")))).dropDuplicates(["__k1", "__k2"])
    return compact(clear.unionByName(stay.select(*documents.columns)), documents)
