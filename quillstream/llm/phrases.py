"""Phrases whose words stand together more often than they would by themselves.

A task holds the words of its documents as numbers, a shard of ``SHARD`` words at
a time, and builds the shard's generalised suffix automaton to a bounded depth:
its states are the classes of word sequences that end at the same places, each
with the number of those places, its longest and shortest sequence and the
suffix link to the state of the longest sequence that ends at more places. As
depth is bounded, sorting the ends of all sequences gives the states directly,
with array operations and without walking word by word. The sequences of all states,
with their counts, are summed up over shards by one shuffle; a shard hands on
each sequence once, however often it occurs.

Counts go up by depth. A sequence of three words occurs no more often than the
two pairs in it, so the second pass hands on only those whose two pairs occur
often enough: a Bloom filter of such pairs, of a bounded size, says which may be.
What it lets through wrongly is counted and found too rare; if it is full because
pairs are too many, more is counted and nothing is lost.

Scores and subsumption are joins on what is frequent. A phrase of three words has
two cuts; the words before and after a cut are frequent as the phrase is. A
phrase is subsumed along the suffix link (the same words without the first) and,
from the other side, without the last.

Defined cases: a null text is empty; a null language is ``und``; repeated rows
count as often as they stand there; words of any length are whole; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.common import compact, stored

#: Words of a phrase at most, least occurrences of a phrase, percent at which a longer one takes it in.
WORDS, LEAST, SHARE = 3, 10, 50
#: Phrases of a language that are told, and what a score of one counts.
BEST, UNIT = 2_000, 1_000_000
#: Words of a shard: some 150 MB while it is sorted.
SHARD = 2_000_000
#: Bits of the filter of pairs: 16 for each, 16 MB at most.
FILTER_BITS = 1 << 27
#: Parts that a hot first or last word, and a language, is dealt into.
SALTS = 16

#: Bytes of a text to words and marks: A-Z in lower case, a tab as a space, all marks as one.
_FROM = bytes(range(0x41, 0x5B)) + b"\t" + b",;:!?\n\x0b\x0c\r"
_TO = bytes(range(0x61, 0x7B)) + b" " + b"." * 9
TABLE = bytes.maketrans(_FROM, _TO)
MARK = b"."


class _Numbers(dict):
    """word to number, in the order in which words are met; 0 is the mark between pieces."""

    def __init__(self):
        super().__init__({MARK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Shard:
    """Words of texts of one language as numbers, with the mark between pieces."""

    def __init__(self):
        self.numbers, self.parts, self.size = _Numbers(), [], 0

    def add(self, text: str) -> None:
        # No word holds a mark, so one that stands alone is a mark.
        words = text.encode("utf-8", "surrogatepass").translate(TABLE).replace(b".", b" . ").split()
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.parts.append(np.zeros(1, np.int32))
        self.size += len(words) + 1

    def ids(self) -> np.ndarray:
        return np.concatenate(self.parts) if self.parts else np.empty(0, np.int32)

    def words(self) -> list[bytes]:
        return list(self.numbers)


class Automaton:
    """The generalised suffix automaton of a shard, of sequences of ``depth`` words at most.

    ``first[k]`` has the place where a sequence of k + 1 words starts, for each
    distinct one, ``count[k]`` the number of its end places and ``link[k]`` the number of
    the sequence without its first word, among those of k words. A sequence whose
    count is that of its link ends at the same places: both are of one state."""

    def __init__(self, ids: np.ndarray, depth: int, frequent=None):
        """``frequent`` says of each sequence of depth - 1 words (places, k) whether it may
        be part of one of depth words that is asked for."""
        n = len(ids)
        self.ids, self.first, self.count, self.link = ids, [], [], []
        # Single words are numbered as they are; what starts at each place, -1 where nothing does.
        of, at = ids.astype(np.int64) - 1, np.flatnonzero(ids)
        first = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
        first[ids[::-1]] = np.arange(n)[::-1]
        self.first.append(first[1:])
        self.count.append(np.bincount(ids, minlength=len(first))[1:])
        self.link.append(np.full(len(first) - 1, -1, np.int64))
        for k in range(1, depth):
            # Longer by a word: the k words that start here and those that start one further on.
            at = at[at + 1 < n]
            at = at[(of[at] >= 0) & (of[at + 1] >= 0)]
            if frequent is not None and k == depth - 1:
                good = frequent(self.first[-1], k)
                at = at[good[of[at]] & good[of[at + 1]]]
            key = of[at] * len(self.first[-1]) + of[at + 1]
            order = np.argsort(key)
            key = key[order]
            new = np.append(True, key[1:] != key[:-1]) if len(key) else np.empty(0, bool)
            starts = np.flatnonzero(new)
            some = at[order[starts]]
            self.link.append(of[some + 1])
            self.first.append(some)
            self.count.append(np.diff(np.append(starts, len(key))))
            of = np.full(n, -1, np.int64)
            of[at[order]] = np.cumsum(new) - 1

    def states(self) -> list[tuple[int, int, int]]:
        """longest, shortest and count of each state, by its longest sequence; for tests."""
        out = []
        for k in range(len(self.first)):
            longer = set()
            if k + 1 < len(self.first):
                same = self.count[k + 1] == self.count[k][self.link[k + 1]]
                longer = set(self.link[k + 1][same].tolist())
            for i in range(len(self.first[k])):
                if i in longer:
                    continue
                short, j = k, i
                while short and self.count[short][j] == self.count[short - 1][self.link[short][j]]:
                    j = self.link[short][j]
                    short -= 1
                out.append((k + 1, short + 1, int(self.count[k][i])))
        return out


class PairFilter:
    """A Bloom filter of sequences by two hashes of their words."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)

    @staticmethod
    def hashes(words: list[np.ndarray]) -> np.ndarray:
        """Of sequences, from the hashes of their words in order: two numbers each."""
        out = np.zeros(len(words[0]), np.uint64)
        for w in words:
            out = (out ^ w) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.stack([out, (out * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(17)])

    @staticmethod
    def of_words(lang: str, words: list[bytes]) -> np.ndarray:
        seed = xxhash.xxh32_intdigest(lang.encode())
        return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return ((self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


# ---------------------------------------------------------------- counting

COUNTED = "lang string, words int, phrase string, n long"


def _count(documents: DataFrame, shortest: int, depth: int, packed=None) -> DataFrame:
    """lang, words, phrase, n: sums of all shards, of phrases of ``shortest`` to ``depth``
    words. One of no words has the number of all words of a language."""
    schema = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])

    def told(lang: str, shard: Shard, sieve: PairFilter | None):
        ids, words = shard.ids(), shard.words()
        frequent = None
        if sieve is not None:
            own = PairFilter.of_words(lang, words)
            frequent = lambda at, k: sieve.holds(PairFilter.hashes([own[ids[at + i]] for i in range(k)]))
        found = Automaton(ids, depth, frequent)
        texts = pa.array(words, pa.binary()).cast(pa.string())
        if shortest == 1:
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([0], pa.int32()), pa.array([""]), pa.array([int(np.count_nonzero(ids))], pa.int64())], schema=schema)
        for k in range(shortest - 1, depth):
            first, count = found.first[k], found.count[k]
            for lo in range(0, len(first), 50_000):
                at = first[lo : lo + 50_000]
                columns = [texts.take(pa.array(ids[at + i])) for i in range(k + 1)]
                phrase = columns[0] if k == 0 else pa.compute.binary_join_element_wise(*columns, " ")
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(np.full(len(at), k + 1, np.int32)), phrase, pa.array(count[lo : lo + 50_000])], schema=schema)

    def run(batches):
        import pyarrow.compute  # noqa: F401  is pa.compute

        sieve = PairFilter(np.frombuffer(packed.value, np.uint8)) if packed is not None else None
        shards: dict[str, Shard] = {}
        held = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                shard = shards.setdefault(lang, Shard())
                before = shard.size
                shard.add(text)
                held += shard.size - before
                if held > SHARD:
                    # The fullest language goes; the others wait for more.
                    lang = max(shards, key=lambda x: shards[x].size)
                    held -= shards[lang].size
                    yield from told(lang, shards.pop(lang), sieve)
        for lang, shard in shards.items():
            yield from told(lang, shard, sieve)

    rows = compact(documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text"), documents)
    found = rows.mapInArrow(run, COUNTED)
    # A shard has added up its own, so a sum before the shuffle would find next to nothing.
    found = found.repartition(F.col("lang"), F.col("phrase"))
    return found.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))


def _pair_filter(pairs: DataFrame) -> bytes:
    """Bits of a filter of all pairs (lang, phrase); 16 MB at most."""
    n = pairs.count()
    bits = 1 << 13
    while bits < min(16 * n, FILTER_BITS):
        bits <<= 1

    def run(batches):
        for batch in batches:
            table = batch.to_pydict()
            by: dict[str, list[list[bytes]]] = {}
            for lang, phrase in zip(table["lang"], table["phrase"], strict=True):
                by.setdefault(lang, []).append(phrase.encode().split(b" "))
            for lang, phrases in by.items():
                hashes = PairFilter.hashes([PairFilter.of_words(lang, list(w)) for w in zip(*phrases, strict=True)])
                at = np.unique(hashes & np.uint64(bits - 1))
                words, start = np.unique(at >> np.uint64(6), return_index=True)
                value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), start)
                yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(value.view(np.int64))], names=["word", "bits"])

    got = pairs.select("lang", "phrase").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return out.astype("<u8").tobytes()


def counts(documents: DataFrame, most: int = WORDS, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Phrases of up to ``most`` words that occur ``least`` times (lang, words, phrase, n), and
    lang, total: all words of each language."""
    keep = (F.col("n") >= least) | (F.col("words") == 0)
    base = stored(_count(documents, 1, min(2, most)).where(keep), "phrases")
    found = base.where("words > 0")
    total = base.where("words = 0").select("lang", F.col("n").alias("total"))
    for depth in range(3, most + 1):
        bits = documents.sparkSession.sparkContext.broadcast(_pair_filter(found.where(F.col("words") == depth - 1)))
        found = found.unionByName(stored(_count(documents, depth, depth, bits).where(keep), "phrases"))
    return found, total


# ---------------------------------------------------------------- scores

def scored(found: DataFrame, total: DataFrame, unit: int = UNIT) -> DataFrame:
    """lang, words, phrase, a, l, r, n, score of phrases of two words and more, by the cut of
    the lowest score, ties to the first."""
    parts = F.split("phrase", " ")
    cut = found.where("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("*", F.array_join(F.slice(parts, F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice(parts, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"))
    # A word may begin very many phrases: its row is copied and they are dealt over the copies.
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt")
    copied = found.select("lang", F.col("phrase").alias("part"), F.col("n").alias("times"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    side = lambda name, times: copied.withColumnRenamed("part", name).withColumnRenamed("times", times)
    cut = cut.select("*", salt).join(side("left", "l"), ["lang", "left", "salt"]).join(side("right", "r"), ["lang", "right", "salt"])
    score = F.expr(f"({unit}BD * cast(a as decimal(19,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    lowest = cut.select("lang", "words", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "words", "phrase").agg(F.max("a").alias("a"), F.min("cut").alias("cut"))
    # One row a language; the optimizer sees how many.
    return lowest.join(total, "lang").select("lang", "words", "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")


def kept(phrases: DataFrame, share: int = SHARE) -> DataFrame:
    """Phrases that no longer one takes in: by ``share`` percent of its occurrences."""
    parts = F.split("phrase", " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: F.array_join(F.slice(parts, i, k), " "))))
    longer = phrases.where("words > 2").select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    met = phrases.join(longer, ["lang", "phrase"], "left")
    return met.where(F.col("longer").isNull() | (F.col("longer").cast("decimal(38,0)") * 100 < F.col("a").cast("decimal(38,0)") * share)).drop("longer")


def mine(documents: DataFrame, most: int = WORDS, least: int = LEAST, share: int = SHARE, best: int = BEST) -> DataFrame:
    """documents (lang, text) to lang, rank, phrase, a, l, r, n, score: the ``best`` of each language."""
    found, total = counts(documents, most, least)
    rows = kept(scored(found, total), share)
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # The best of each part of a language, then the best of these.
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    rows = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= best)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL of the registered query.
SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), g AS (SELECT lang, k AS words, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM w, range(1, 4) a(k), range(1, len(w) - k + 2) b(i)
), f AS MATERIALIZED (SELECT lang, words, phrase, count(*) AS a FROM g GROUP BY ALL
), n AS (SELECT lang, sum(a) AS n FROM f WHERE words = 1 GROUP BY lang
), c AS MATERIALIZED (SELECT lang, words, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND a >= 10
), u AS (SELECT c.*, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:words], ' ') AS rp FROM c, range(1, 3) t(k) WHERE k < words
), s AS (SELECT u.lang, u.words, u.phrase, u.a, k, x.a AS l, y.a AS r, CAST(CAST(1000000 AS HUGEINT) * u.a * u.a // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score FROM u JOIN f x ON x.lang = u.lang AND x.phrase = lp JOIN f y ON y.lang = u.lang AND y.phrase = rp
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), o AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE words = 3) GROUP BY ALL
), k AS (SELECT b.* FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * b.a
), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
SELECT r.lang, rank, phrase, a, l, r.r AS r, CAST(n.n AS BIGINT) AS n, score FROM r JOIN n ON n.lang = r.lang WHERE rank <= 2000
"""
