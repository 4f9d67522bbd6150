"""Language identification by compression.

For each language a zstandard raw-content dictionary is made of a bounded
sample of labelled texts. A text is compressed with each dictionary, in pieces
of ``PIECE`` bytes so that its own content does not outweigh the dictionary;
the language of the smallest sum wins. Sizes are whole bytes, so where they tie
in a text so short that one byte is more than the margin, the lengths of the
matches that its places have in the dictionaries decide. Where the runner-up is
nearly as small, the text is rejected.

Defined cases: a null text and a text without a letter get ``und``, score 0 and
are rejected; equal sums go to the smaller language name and are rejected; with
no learned language every text is ``und``, but only those without a letter are
rejected; with one, the runner-up is the size
without a dictionary; repeated rows get the same answer; other columns are not
looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import worker_state

#: Bound of the sample: so many documents of a language, so many bytes of each.
SAMPLE_DOCUMENTS = 64
SAMPLE_BYTES = 512
PIECE = 4_096
#: Matches of four bytes upwards, searched for with some effort: the fast levels
#: look for longer ones and miss what tells languages apart.
SEARCH = {"compression_level": 3, "strategy": zstandard.STRATEGY_LAZY2, "min_match": 4, "search_log": 4, "hash_log": 16, "chain_log": 16, "window_log": 17, "target_length": 16, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
#: Least part by which the best must be below the runner-up.
MARGIN = 0.004
#: Longest match that is looked for where whole sizes tie.
MATCH = 8
UNDETERMINED = "und"
FOLDS, HELD_OUT = 3, 1

_LETTER = re.compile(r"[^\W\d_]")
#: ASCII characters that are no letters become spaces.
_CLEAN = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def letters(text: str) -> bytes:
    """Lower-case words without ASCII digits and marks, one space between them."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_CLEAN).split())


def parts(data: bytes, dictionary: bytes) -> float:
    """Into how many parts a text falls at its matches in a dictionary: at each
    place the longest match of at most ``MATCH`` bytes counts as its share."""
    data, dictionary = b" " + data + b" ", b" " + dictionary + b" "
    total = 0.0
    for window, n in Counter(data[i : i + MATCH] for i in range(len(data))).items():
        k = len(window)
        while k and window[:k] not in dictionary:
            k -= 1
        total += n / (k + 1)
    return total


@dataclass
class Model:
    """Dictionaries by language; compressors are made where they are used."""

    dictionaries: dict[str, bytes]
    margin: float = MARGIN
    _made: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {"dictionaries": self.dictionaries, "margin": self.margin, "_made": []}

    def _compressors(self) -> list:
        if not self._made:
            for lang, data in sorted(self.dictionaries.items()):
                shared = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                search = zstandard.ZstdCompressionParameters(**SEARCH)
                shared.precompute_compress(compression_params=search)
                self._made.append((lang, zstandard.ZstdCompressor(dict_data=shared, compression_params=search).compress))
            if len(self._made) == 1:
                self._made.append((None, zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters(**SEARCH)).compress))
        return self._made

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score (the relative margin's place between 0 and 1), rejected."""
        if not text or not _LETTER.search(text):
            return UNDETERMINED, 0.0, True
        if not self.dictionaries:
            return UNDETERMINED, 0.0, False
        data = letters(text)
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        sizes = sorted((sum(len(f(p)) for p in pieces), lang) for lang, f in self._compressors() if lang is not None)
        if len(sizes) > 1 and sizes[0][0] == sizes[1][0] and sizes[0][0] * self.margin < 1:
            sizes = sorted((parts(data, self.dictionaries[lang]), lang) for n, lang in sizes if n == sizes[0][0])
        if len(sizes) == 1:
            plain = sum(len(self._made[1][1](p)) for p in pieces)
            gain = max(0.0, (plain - sizes[0][0]) / plain)
        else:
            gain = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        return sizes[0][1], min(1.0, gain / (gain + 4 * MARGIN)) if gain else 0.0, gain < self.margin


def fold(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def learn(documents: DataFrame, documents_per_language: int = SAMPLE_DOCUMENTS, bytes_per_document: int = SAMPLE_BYTES, margin: float = MARGIN) -> Model:
    """A model of the labelled rows outside the held-out fold.

    The sample is the row of least hash in each of ``documents_per_language``
    hash buckets of a language: a sum over all rows with partial sums before the
    shuffle, whatever a language's share. Only the sample's texts reach the
    driver, cut to ``bytes_per_document`` each, from the middle of the text.
    """
    rows = documents.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(fold() != HELD_OUT, F.lit(True)))
    rows = rows.withColumn("h", F.xxhash64("doc_id"))
    least = rows.groupBy("lang", F.pmod("h", F.lit(documents_per_language)).alias("b")).agg(F.min("h").alias("h")).collect()
    found: dict[str, dict[int, str]] = {}
    if least:
        room = F.greatest(F.lit(1), F.floor((F.length("text") - bytes_per_document) / 2) + 1)
        cut = F.substr("text", room.cast("int"), F.lit(bytes_per_document))
        wanted = {(r["lang"], r["h"]) for r in least}
        for r in rows.where(F.col("h").isin([r["h"] for r in least])).groupBy("lang", "h").agg(F.min(cut).alias("t")).collect():
            if (r["lang"], r["h"]) in wanted:
                found.setdefault(r["lang"], {})[r["h"]] = r["t"]
    made = {}
    for lang, texts in found.items():
        data = b" ".join(letters(t)[:bytes_per_document] for _, t in sorted(texts.items()))
        if len(data) >= 8:
            made[lang] = data
    return Model(made, margin)


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row; no shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        worker_state("language", bool)  # lets go of other operators' memos
        m = shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            held = [None if i is None else zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT for i in ids]
            got = [m.predict(t.as_py()) for t in batch.column(1)]
            cols = list(zip(*got, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.bool_()), *(pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.float64(), pa.bool_()), strict=True))], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(documents: DataFrame, model: Model) -> DataFrame:
    """documents, all columns, without the rows that the model rejects."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def run(batches):
        worker_state("language", bool)  # lets go of other operators' memos
        for batch in batches:
            keep = [not shared.value.predict(t.as_py())[2] for t in batch.column(at)]
            yield batch if all(keep) else batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
