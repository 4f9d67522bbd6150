"""Fill-in-the-middle: texts cut at seeded places and put together in another order.

Where a text may be cut is worked out once for each distinct text. Texts are
grouped by their SHA-256; that a group holds one text alone is verified by
contents: the group is the set of its texts, which must have one member.
Documents come back to their text by a join; they follow each other where their
text is, so its boundary list is made once for them, in Elias-Fano form, some five
bits a boundary, of which each document selects the two that its own seed names
without decoding the others.

A text that very many documents share is one row of the index; the documents of
such a text are dealt over slices, each with a copy of the row and a boundary list
of its own, so that no task has them all. The others join where their index row
lies: the text of the index is shuffled once, documents go as ids and keys.

Units are runs of white space with the word after them; white space at the end
of a text is one more. The seed of a document is the SHA-256 of ``seed:doc_id``.

Defined cases: a null text counts as empty and stays plain; a null id counts as
the empty string in the seed; repeated rows give equal rows; texts that hold a
sentinel stay plain; a text of any length is cut as a whole; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import stored

#: Sentinels of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
SEED = 42
#: Percent of the texts that are cut, and of these what goes suffix first.
CUT, SUFFIX_FIRST = 50, 80
#: Documents of one text in a slice of their own; a text of fewer is not sliced.
SLICE = 512
#: Keys of sliced texts that are broadcast at most (40 bytes each), and into how
#: many parts each is dealt where there are more.
FEW, SALTS = 200_000, 64


# ---------------------------------------------------------------- boundaries

def boundaries(text: str) -> np.ndarray:
    """Where units end, in code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    ends = np.flatnonzero(~blank & np.append(blank[1:], True)) + 1
    return np.append(ends, len(points)) if len(points) and blank[-1] else ends


class Boundaries:
    """An ascending list of numbers in Elias-Fano form.

    Of each number the low bits are kept as they are and the high ones as unary
    gaps: the i-th number sets bit ``high + i``. ``packed`` is the number of
    entries, the largest and the low bits' width, then low bits, then high bits."""

    HEAD = 17

    def __init__(self, packed: bytes):
        self.packed = packed
        self.n, self.most, self.low = int.from_bytes(packed[:8], "little"), int.from_bytes(packed[8:16], "little"), packed[16]
        self.high_at = self.HEAD + (self.n * self.low + 7) // 8

    @classmethod
    def of(cls, numbers: np.ndarray) -> Boundaries:
        n, most = len(numbers), int(numbers[-1]) if len(numbers) else 0
        low = max(0, (most // n).bit_length() - 1) if n else 0
        numbers = numbers.astype(np.int64)
        lows = (numbers[:, None] >> np.arange(low)) & 1
        high = np.zeros((most >> low) + n + 1 if n else 0, np.uint8)
        high[(numbers >> low) + np.arange(n)] = 1
        head = n.to_bytes(8, "little") + most.to_bytes(8, "little") + bytes([low])
        pack = lambda bits: np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        return cls(head + pack(lows) + pack(high))

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """The i-th number, from 0."""
        high = np.frombuffer(self.packed, np.uint8, offset=self.high_at)
        upto = np.cumsum(np.bitwise_count(high), dtype=np.int64)
        byte = int(np.searchsorted(upto, i + 1))
        left = i - (int(upto[byte - 1]) if byte else 0)
        bit = int(np.flatnonzero(np.unpackbits(high[byte : byte + 1], bitorder="little"))[left])
        top = 8 * byte + bit - i
        first = i * self.low
        a, b = first // 8, (first + self.low + 7) // 8
        rest = int.from_bytes(self.packed[self.HEAD + a : self.HEAD + b], "little") >> (first - 8 * a)
        return (top << self.low) | (rest & ((1 << self.low) - 1))


# ---------------------------------------------------------------- one document

def seeds(doc_id, seed: int = SEED) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def plan(doc_id, text: str, where: Boundaries, seed: int = SEED) -> tuple[str, int | None, int | None]:
    """form, and the code points of prefix and middle."""
    a, b, cut, order = seeds(doc_id, seed)
    n = len(where)
    if not text or cut % 100 >= CUT or any(m in text for m in MARKS):
        return "plain", None, None
    first, second = sorted((a % (n + 1), b % (n + 1)))
    at = [where.select(k - 1) if k else 0 for k in (first, second)]
    return "spm" if order % 100 < SUFFIX_FIRST else "psm", at[0], at[1] - at[0]


def arrange(text: str, form: str, prefix: int | None, middle: int | None) -> str:
    """The text in its form."""
    if form == "plain":
        return text
    p, s, m = MARKS
    start, inner, rest = text[:prefix], text[prefix : prefix + middle], text[prefix + middle :]
    return f"{p}{start}{s}{rest}{m}{inner}" if form == "psm" else f"{s}{rest}{p}{start}{m}{inner}"


# ---------------------------------------------------------------- tables

def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text (never null) and its SHA-256."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("key"))


def index(documents: DataFrame) -> DataFrame:
    """key, text, slices: a row for each distinct text. Texts of one key are compared as
    they are added up, before the shuffle and after it."""
    groups = keyed(documents).groupBy("key").agg(F.collect_set("text").alias("texts"), F.count("*").alias("copies"))
    text = F.when(F.size("texts") == 1, F.get("texts", F.lit(0))).otherwise(F.raise_error(F.lit("two texts have one SHA-256")).cast("string"))
    return groups.select("key", text.alias("text"), F.ceil(F.col("copies") / SLICE).alias("slices"))


def _slices(keys: DataFrame, few: int) -> DataFrame:
    """keys (doc_id, key, salt) with the slices of their text and the one that the row goes to."""
    many = keys.groupBy("key").agg(F.count("*").alias("copies")).where(F.col("copies") > SLICE).select("key", F.ceil(F.col("copies") / SLICE).alias("slices"))
    n = many.count()
    if n <= few:
        told = keys.join(F.broadcast(many), "key", "left")  # at most ``few`` rows, as just counted
    else:
        part = F.pmod(F.xxhash64("salt", F.lit(7)), F.lit(SALTS)).alias("part")
        dealt = many.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("part"))
        told = keys.select("*", part).join(dealt, ["key", "part"], "left").drop("part")
    slices = F.coalesce("slices", F.lit(1).cast("long"))
    return told.select("doc_id", "key", slices.alias("slices"), F.pmod(F.xxhash64("salt"), slices).alias("slice"))


def fill_middle(documents: DataFrame, seed: int = SEED, few: int = FEW) -> DataFrame:
    """documents (doc_id, text) to doc_id, n (units), form (plain, psm or spm),
    prefix_chars, middle_chars (null where plain) and output."""
    spark, kind = documents.sparkSession, documents.schema["doc_id"].dataType.simpleString()
    texts = index(documents)
    # Ids and keys are written once: they are counted, then joined.
    keys = stored(keyed(documents).select("doc_id", "key", F.monotonically_increasing_id().alias("salt")), "middle")
    asks = _slices(keys, few)
    alone = asks.where("slices = 1").select("doc_id", "key").join(texts.where("slices = 1").select("key", "text"), "key")
    copies = texts.where("slices > 1").select("key", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
    shared = asks.where("slices > 1").select("doc_id", "key", "slice").join(copies, ["key", "slice"])
    columns = ("doc_id", "text", "key")
    id_type = spark.createDataFrame([], f"doc_id {kind}").toArrow().schema.field(0).type
    types = {"doc_id": id_type, "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}

    def run(batches):
        at, where = None, None
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                out = []
                for doc_id, text, key in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    if key != at:  # documents of one text follow each other, as the join leaves them
                        at, where = key, Boundaries.of(boundaries(text))
                    form, prefix, middle = plan(doc_id, text, where, seed)
                    out.append((doc_id, len(where), form, prefix, middle, arrange(text, form, prefix, middle)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types.values(), strict=True)], names=list(types))

    met = alone.select(*columns).unionByName(shared.select(*columns))
    return met.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from. No text that is cut holds a
    sentinel, and none arises where parts meet, so each stands once."""
    p, s, m = (F.lit(x) for x in MARKS)
    part = lambda text, mark, i: F.split_part(text, mark, F.lit(i))
    body, inner = part(output, m, 1), part(output, m, 2)
    bare = F.substring(body, F.lit(len(MARKS[0]) + 1), F.length(body))
    psm = F.concat(part(bare, s, 1), inner, part(bare, s, 2))
    spm = F.concat(part(bare, p, 2), inner, part(bare, p, 1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


#: DuckDB SQL of the registered query.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), t AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM d
), k AS (SELECT *, CAST(len(u) AS BIGINT) AS n, list_transform(range(0, 4), lambda i: CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT)) AS r FROM t
), c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k
), s AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM s
"""
