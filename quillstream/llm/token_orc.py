"""Token ids in ORC files: stripes of run-length encoded integers.

``write_tokens`` deals documents over files by ranges of the document id, sorts
each range and writes ``(doc_id, ids)``. ORC keeps the ids as run-length encoded
integers, with a row index (statistics every ``row_stride`` rows), and Bloom
filters on the document id, so ``lookup`` skips files, stripes and row groups,
and stripes are read in parallel.

Defined cases: a null text counts as empty, so its document holds the end id
alone; rows that share an id follow each other ordered by their text; rows with
a null id come first; an empty table gives files without rows; a text of any
length is encoded whole, and long ones share a batch with fewer others; other
columns are not looked at.
"""

from __future__ import annotations

import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.llm.common import new_path, stored, tasks_for, worker_state

END_ID = 0
#: Pieces of text of which a worker remembers the ids (about 200 bytes each),
#: twice that at most.
MEMO = 300_000
#: Bytes of text whose parts are numbered together, more only where one text has more.
GROUP_BYTES = 7 << 20
#: Token ids that a worker hands on at once, more only where one document has more.
IDS_OUT = 1_000_000
#: Bytes of text for a file.
FILE_BYTES = 256 << 20
#: Marks that may follow a word without being more than marks.
MARKS = ".,;:!?*&%$#|-)"
LINE, NOTHING = pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())

assert array("I").itemsize == 4 and sys.byteorder == "little"


def _loose(c: str) -> bool:
    """A single space or line end between two characters that are not loose always
    starts a pre-token of the byte-level rule, and a line end is one, so the parts may
    be encoded one by one."""
    return c.isspace() or c == "\u180e"


class Encoder:
    """ids of whole texts by the tokenizers library, as little-endian uint32 bytes.

    Texts repeat their parts, so the library encodes each distinct part between
    safe spaces and line ends once and its ids are remembered, in two generations:
    parts that are not met while one generation fills are forgotten. Arrow splits
    the texts, numbers their distinct parts and puts the ids together, so Python
    looks at each distinct part of a group of texts once. ``tests/llm`` hold the
    result against the library's encoding of whole texts.
    """

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        self.tokenizer, self.memo = Tokenizer.from_file(path), memo
        #: Ids of parts: without the space before them, but with the line end. Those
        #: that may not stand alone have none.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        # The characters that stand for bytes inside a byte-level model.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in shown)}
        self.as_chars = {c: "".join(chr(hidden.get(b, b)) for b in chr(c).encode()) for c in range(0x180)}
        self.space = self.as_chars[0x20]
        # Each id as four bytes.
        self.four = [i.to_bytes(4, "little") for i in range(max(self.tokenizer.get_vocab().values()) + 1)]
        self.line = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes() if text else b""

    def _odd(self, part: str) -> bytes | None:
        """Ids of a part that is not letters alone: with marks behind them or a line end before
        them, none if it may not stand alone; None if the library is to encode it."""
        body, before, first = (part[1:], self.line, "") if part[:1] == "\n" else (part, b"", self.space)
        stem = body.rstrip(MARKS)
        if not stem.isalpha() or not (stem.isascii() or max(stem) < "\u0180"):
            return b"" if not body or _loose(body[0]) or _loose(body[-1]) else None
        # Letters and the marks after them are two pre-tokens.
        key = part[: len(part) - len(body) + len(stem)]
        if (ids := self.young.get(key)) is None:
            if (ids := self.old.get(key)) is None:
                ids = before + b"".join([self.four[t.id] for t in self.tokenizer.model.tokenize(first + stem.translate(self.as_chars))])
            self.young[key] = ids
        if stem == body:
            return ids
        if (tail := self.marks.get(end := body[len(stem) :])) is None:
            if len(self.marks) > 10_000:
                self.marks.clear()
            tail = self.marks[end] = self._whole(end)
        return ids + tail

    def _parts(self, parts: list[str]) -> list[bytes]:
        """The ids of distinct parts; none for those that may not stand alone."""
        if len(self.young) > self.memo:
            self.old, self.young = self.young, {}
        young, before, odd, new = self.young, self.old.get, [], []
        tokenize, four, space, as_chars = self.tokenizer.model.tokenize, self.four, self.space, self.as_chars
        out = list(map(young.get, parts))
        for i in [i for i, ids in enumerate(out) if ids is None]:
            p = parts[i]
            if (ids := before(p)) is None:
                if not (p.isalpha() and ((ascii_ := p.isascii()) or max(p) < "\u0180")):
                    odd.append(i)
                    continue
                # Letters and the space before them are one pre-token, which goes straight to
                # the library's model. ASCII letters stand for themselves.
                ids = b"".join([four[t.id] for t in tokenize(space + (p if ascii_ else p.translate(as_chars)))])
            young[p] = out[i] = ids
        # After the words alone, since others are often these with marks.
        for i in odd:
            p = parts[i]
            if (ids := young.get(p)) is None and (ids := self._odd(p)) is None:
                new.append(i)
                continue
            young[p] = out[i] = ids
        whole = [parts[i] if parts[i][0] == "\n" else " " + parts[i] for i in new]
        for i, e in zip(new, self.tokenizer.encode_batch_fast(whole, add_special_tokens=False), strict=True):
            young[parts[i]] = out[i] = array("I", e.ids).tobytes()
        return out

    def _group(self, texts: pa.Array) -> list[bytes]:
        # All parts but a text's first follow a space; a part that begins a line keeps its line
        # end, and the text's first one gets one that is taken off again.
        lines = pc.binary_join_element_wise(LINE, pc.replace_substring(texts, "\n", " \n"), NOTHING)
        split = pc.split_pattern(lines, " ")
        at, numbered = split.offsets.to_numpy(), split.flatten().dictionary_encode()
        indices, parts = numbered.indices, numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        del lines, split, numbered
        known = self._parts(parts)
        ids = pa.array(known, pa.large_binary()).take(indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[at].tolist()
        data, skip = memoryview(ids.buffers()[2] or b""), len(self.line)
        out = [bytes(data[a + skip : b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        alone = np.fromiter(map(len, known), np.int64, len(known))
        if not alone.all():  # white space beside other white space: the library gets the whole text
            met = np.concatenate([[0], np.cumsum(alone[indices.to_numpy()] == 0)])[at]
            for i in np.flatnonzero(np.diff(met)).tolist():
                out[i] = self._whole(texts[i].as_py())
        return out

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """The ids of each text, null ones as empty."""
        column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string()).fill_null("")
        # Groups of bounded size; a text beyond that has one of its own.
        sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // GROUP_BYTES)) + 1).tolist(), len(column)] if len(column) else [0]
        return [x for a, b in zip(cuts[:-1], cuts[1:], strict=True) for x in self._group(column.slice(a, b - a))]


def grouped(batches):
    """Batches put together up to GROUP_BYTES, since texts that are encoded together share their parts."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > GROUP_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def encoder(path: str) -> Encoder:
    return worker_state(("encoder", path), lambda: Encoder(path))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_tokens(documents: DataFrame, path: str, tokenizer: str | None = None, files: int | None = None, end_id: int | None = END_ID, row_stride: int = 2_000, stripe_mb: int = 64, bloom_fpp: float = 0.01) -> None:
    """documents (doc_id, text) as ORC files of token ids under ``path``.

    ``tokenizer`` is a file that every executor can open; by default the
    installed byte-level vocabulary, found anew on each executor.
    """

    def run(batches):
        enc = encoder(tokenizer or vocabulary())
        end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
        for part in grouped(batches):
            data = enc.encode(part.column(1))
            sizes = np.array([(len(x) + len(end)) // 4 for x in data], np.int64)
            # Documents of many tokens go in smaller batches.
            group = (np.cumsum(sizes) - sizes) // IDS_OUT
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(data)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                ids = pa.array(np.frombuffer(end.join([*data[a:b], b""]), dtype="<i4"), pa.int32())
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes[a:b])]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), pa.ListArray.from_arrays(offsets, ids)], names=["doc_id", "ids"])
            # Gone before the next group is there.
            del part, data, ids, offsets

    kind = documents.schema["doc_id"].dataType.simpleString()
    (
        documents.select("doc_id", "text")
        .repartitionByRange(files or tasks_for(documents, FILE_BYTES), "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(run, f"doc_id {kind}, ids array<int>")
        .write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(bloom_fpp))
        .option("orc.row.index.stride", str(row_stride))
        .option("orc.stripe.size", str(stripe_mb << 20))
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """doc_id and ids of all documents, by stripes in parallel."""
    return spark.read.schema(f"doc_id {kind}, ids array<int>").orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The documents of a few ids: the filter reaches the files' statistics and Bloom filters."""
    return read_tokens(spark, path).where(F.col("doc_id").isin(list(doc_ids)))


def file_number(file: Column) -> Column:
    """The number of the partition that wrote a file, which Spark gives in its name: ranges
    have this order. Names do not, once numbers have more than five digits."""
    return F.regexp_extract(file, r"part-(\d+)[^/]*$", 1).cast("long")


def digests(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files.

    The start of a document is a running sum in two steps, so no task sees all
    rows: sums inside each file, and the files' totals (a row a file) before it.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column(1)
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            at = ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "file", "row", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path, kind).select("doc_id", "ids", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row"))
    # Two sums follow; written down, the digests spare a second reading of the ids.
    rows = stored(rows.mapInArrow(run, f"doc_id {kind}, file string, row long, n_tokens long, ids_crc32 long"), "digests")
    # A row a file: what stands in the files before it.
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("file", (F.sum("total").over(Window.orderBy(file_number(F.col("file")))) - F.col("total")).alias("before"))
    inside = Window.partitionBy("file").orderBy("doc_id", "row")
    return rows.withColumn("upto", F.sum("n_tokens").over(inside)).join(before, "file").select("doc_id", (F.col("before") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(documents: DataFrame, **options) -> DataFrame:
    """Write all documents, read the files back and return their digests."""
    spark = documents.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(documents, path, **options)
    return digests(spark, path, documents.schema["doc_id"].dataType.simpleString())
