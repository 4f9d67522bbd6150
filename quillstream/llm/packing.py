"""Best-fit packing into sequences of several permitted lengths.

Pieces are dealt into shards by hash; a shard is sorted by descending length and
packed by best fit: a piece goes to the open bin that it leaves least room in.
Where none has room, a bin is opened in the size whose cost for each token it is
expected to hold is least, given all pieces of the shard that are still to come
and the room that open bins already offer them. At the end each bin shrinks to
the smallest permitted length that holds its contents.

A text longer than the largest length is split into pieces of that length and a
rest, so that nothing is cut off.

Defined cases: a null or empty text is one end mark; repeated rows are packed
one by one; pieces of equal length keep the order of their ids; an empty table
gives an empty result; texts of any length are split; other columns are ignored,
whatever their names. A task packs a shard at a time, of ``SHARD`` pieces or so;
shards depend on ids, pieces and texts alone, so rows alike in all of them share one.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import worker_state

#: Permitted sequence lengths in tokens.
LENGTHS = (512, 1_024, 2_048, 4_096)
#: What opening a bin costs beside its length, in tokens.
OVERHEAD = 16
#: Pieces of a shard, which a task packs at once.
SHARD = 50_000
#: Bytes of a token, by which pieces are expected.
TOKEN_BYTES = 3
#: Parts of texts that a worker remembers while it counts tokens; fewer than where ids are kept.
MEMO = 100_000


def cost(length: int) -> float:
    """Of a bin: its length and what any bin costs."""
    return length + OVERHEAD


class Packer:
    """Best fit over pieces in descending order of length."""

    def __init__(self, lengths=LENGTHS, cost: Callable[[int], float] = cost):
        self.lengths, self.cost = tuple(sorted(lengths)), cost

    def pack(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bin and offset of each piece; contents and final length of each bin."""
        most = self.lengths[-1]
        left = np.zeros(most + 1, np.int64)  # tokens still to come, by length
        np.add.at(left, sizes, sizes)
        come = np.cumsum(left).tolist()  # in pieces of at most so many tokens
        open_: list[list[int]] = [[] for _ in range(most + 1)]
        mask = room = 0
        bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        filled: list[int] = []
        size_of: list[int] = []
        remaining = int(sizes.sum())
        for i, n in enumerate(sizes.tolist()):
            remaining -= n
            fit = mask >> n
            if fit:
                r = n + (fit & -fit).bit_length() - 1
                b = open_[r].pop()
                if not open_[r]:
                    mask ^= 1 << r
                room -= n
            else:
                b = self._open(n, remaining, room, come)
                r = b
                size_of.append(r)
                filled.append(0)
                room += r - n
                b = len(filled) - 1
            bins[i], offsets[i] = b, filled[b]
            filled[b] += n
            if r > n:
                if not open_[r - n]:
                    mask |= 1 << (r - n)
                open_[r - n].append(b)
        contents = np.array(filled, np.int64)
        final = np.array(self.lengths, np.int64)[np.searchsorted(self.lengths, contents)] if len(contents) else contents
        return bins, offsets, contents, final

    def _open(self, n: int, remaining: int, room: int, come: list[int]) -> int:
        """The permitted length of least cost for each token it is expected to hold.

        Pieces come in descending order, so of those to come that fit into a
        bin's rest at most ``come`` tokens exist; open bins take theirs first.
        """
        best, least = self.lengths[-1], None
        for c in self.lengths:
            if c < n:
                continue
            rest = c - n
            expected = n + min(rest, max(0, min(remaining, come[rest]) - room))
            if least is None or self.cost(c) / expected < least:
                best, least = c, self.cost(c) / expected
        return best


def pieces(sized: DataFrame, lengths=LENGTHS) -> DataFrame:
    """doc_id, n_tokens to pieces: doc_id, piece, start, length."""
    most = max(lengths)
    last = F.floor((F.col("n_tokens") - 1) / most).cast("int")
    salt = F.col("salt") if "salt" in sized.columns else F.lit(0).cast("long").alias("salt")
    cut = sized.select("doc_id", "n_tokens", salt, F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * most
    return cut.select("doc_id", "piece", start.alias("start"), F.least(F.lit(most).cast("long"), F.col("n_tokens") - start).alias("length"), "salt")


def expected_pieces(documents: DataFrame, lengths=LENGTHS, text_col: str = "text") -> int:
    """About how many pieces the documents' texts make, by their bytes; one pass, no Python."""
    tokens = F.coalesce(F.octet_length(text_col), F.lit(0)) / TOKEN_BYTES + 1
    return documents.agg(F.sum(F.ceil(tokens / max(lengths))).alias("n")).first()["n"] or 0


def pack(sized: DataFrame, lengths=LENGTHS, shard: int = SHARD, expected: int | None = None) -> DataFrame:
    """doc_id and n_tokens (1 at least) of each row to its pieces' places: doc_id,
    piece, start, length, bin_id, bin_offset, bin_tokens, bin_length.

    ``salt``, where there is such a column, is a number that tells rows of one id
    apart; shards depend on ids, pieces and salts, not on how rows are stored.
    Their number follows that of the pieces, ``expected`` or else counted."""
    if expected is None:
        last = F.floor((F.col("n_tokens") - 1) / max(lengths))
        expected = sized.agg(F.sum(last + 1).alias("n")).first()["n"] or 0
    shards = expected // shard + 1
    kind = sized.schema["doc_id"].dataType.simpleString()
    cut = pieces(sized, lengths).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(shards)))

    def packed(held: list[pa.RecordBatch], group: int):
        rows = pa.Table.from_batches(held).combine_chunks()
        bins, offsets, contents, final = Packer(lengths).pack(rows.column("length").to_numpy())
        ids = (group << 40) + bins
        out = [rows.column(c) for c in ("doc_id", "piece", "start", "length")]
        table = pa.Table.from_arrays([*out, pa.array(ids), pa.array(offsets), pa.array(contents[bins]), pa.array(final[bins])], names=["doc_id", "piece", "start", "length", "bin_id", "bin_offset", "bin_tokens", "bin_length"])
        yield from table.to_batches(max_chunksize=20_000)

    def run(batches):
        held, group = [], None
        for batch in batches:
            shard_of = batch.column(4).to_numpy()
            cuts = [0, *(np.flatnonzero(shard_of[1:] != shard_of[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if held and int(shard_of[a]) != group:
                    yield from packed(held, group)
                    held = []
                group = int(shard_of[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from packed(held, group)

    schema = f"doc_id {kind}, piece int, start long, length long, bin_id long, bin_offset long, bin_tokens long, bin_length long"
    dealt = cut.select("doc_id", "piece", "start", "length", "shard", "salt").repartition(int(shards), "shard")
    return dealt.sortWithinPartitions("shard", F.desc("length"), "doc_id", "piece", "salt").mapInArrow(run, schema)


def token_counts(documents: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and salt (a sum of the ids) of each row, with its end mark; no shuffle."""
    from quillstream.llm.token_orc import Encoder, vocabulary

    def run(batches):
        path = tokenizer or vocabulary()
        enc = worker_state(("packing", path), lambda: Encoder(path, MEMO))
        for batch in batches:
            n, salt = [], []
            for lo in range(0, batch.num_rows, 500):
                for x in enc.encode(batch.column(1).slice(lo, 500)):
                    n.append(len(x) // 4 + 1)
                    salt.append(zlib.crc32(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(salt, pa.int64())], names=["doc_id", "n_tokens", "salt"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, salt long")


def character_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens where each character is one, with its end mark."""
    return documents.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.length(text_col), F.lit(0)) + 1).cast("long").alias("n_tokens"))
