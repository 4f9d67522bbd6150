"""Chinese words without a dictionary: a lexicon learned from the corpus, and the likeliest cut by it.

A string of up to ``LONGEST`` characters is a word if its parts stand together far
more often than by chance (cohesion: the least, over its cuts, of the log of its
share over the product of its parts' shares) and if what stands before and after
it varies (branching entropy on both sides). Tasks count the strings of their
texts; sums of these, cohesion and entropies are groups and joins.

A run is then cut where the product of its words' shares is greatest: a word graph
and one pass from left to right that keeps the best way to each place. Characters
that no word covers stand alone. Time is linear in the run. Many runs are cut at
once: first where no word lies across, then what is left between, one character
further in all of it at a time.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType

from quillstream.sources import scratch

#: Characters of a word, occurrences, cohesion (nats) and branching entropy (nats) of one at least.
LONGEST, LEAST, COHESION, BRANCH = 4, 5, 1.5, 0.8
#: Words of a lexicon that is taken to all tasks, the most frequent ones: some 20 MB.
WORDS = 200_000
#: Characters of texts whose words a task holds at once, beside a longer text.
HELD = 1 << 18
#: Characters of texts whose strings are counted at once.
COUNTED = 1 << 21
#: Characters that NumPy takes at once, so that its arrays stay near.
BLOCK = 1 << 16
#: The first Chinese character, and how many there are.
FIRST, HAN = 0x4E00, 0x5200
#: Entries of a table of steps between beginnings of words; beyond, steps are searched.
TABLE = 1 << 22
#: Stretches that are cut one by one if no more are as long.
FEW = 24


def _characters(texts: Iterable[str | None]) -> np.ndarray:
    """The texts' characters as numbers from the first Chinese one, with a line end before, between and after texts."""
    joined = "\n".join(["", *(t or "" for t in texts), ""])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32) - FIRST  # others wrap around to large numbers


def _text(c: np.ndarray) -> str:
    return (c + np.uint32(FIRST)).astype("<u4", copy=False).tobytes().decode("utf-32-le")


def _strings(chars: np.ndarray, lengths: np.ndarray) -> pa.StringArray:
    """Strings of some lengths out of their characters in a row, which take three bytes each but for marks of ends."""
    data = chars.astype("<u4").tobytes().decode("utf-32-le").encode()
    bytes_ = np.append(0, np.where(chars < 128, 1, 3).cumsum())
    ends = np.append(0, lengths.cumsum())
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(bytes_[ends].astype(np.int32)), pa.py_buffer(data))


def windows(texts: Iterable[str | None], longest: int) -> tuple[pa.StringArray, np.ndarray]:
    """What runs of the texts hold, with ^ before and $ after each: every character and the
    ``longest`` that follow it, as far as the run goes, and how often."""
    c = np.minimum(_characters(texts), HAN)
    n, rank = len(c), np.zeros(HAN + 1, np.int64)
    rank[c] = 1
    rank[HAN] = 0
    present = np.flatnonzero(rank)
    rank[present] = np.arange(1, len(present) + 1)
    c, base, codes = np.append(c, np.full(longest, HAN, np.uint32)), len(present) + 1, []
    if base ** (longest + 1) < 1 << 63:
        # A window is a number whose digits are its characters; 0 is an end, and all after one.
        for i in range(0, n, BLOCK):
            s = rank[c[i : min(n, i + BLOCK) + longest]]
            m = len(s) - longest
            code, open_ = s[:m].copy(), True
            for k in range(1, longest + 1):
                at = s[k : m + k] * open_
                code *= base
                code += at
                open_ = at > 0
            codes.append(code[(s[:m] > 0) | (s[1 : m + 1] > 0)])
        code = np.concatenate(codes)
        code.sort()
        new = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.empty(0, np.int64)
        n, code = np.diff(np.append(new, len(code))), code[new]
        digits = np.empty((len(code), longest + 1), np.int64)
        for k in range(longest, -1, -1):
            code, digits[:, k] = np.divmod(code, base)
        return _strings(*_marked(digits, np.append(0, present + FIRST))), n
    names, parts = np.append(0, present + FIRST), []
    for i in range(0, n, BLOCK):
        starts = i + np.flatnonzero((c[i : min(n, i + BLOCK)] < HAN) | (c[i + 1 : min(n, i + BLOCK) + 1] < HAN))
        parts.append(_strings(*_marked(rank[c[starts[:, None] + np.arange(longest + 1)]], names)))
    told = pc.value_counts(pa.chunked_array(parts, pa.string()))
    return told.field("values"), told.field("counts").to_numpy()


def _marked(digits: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters in a row, and lengths, of windows up to their first 0 after the start, which is the end."""
    ends = digits[:, 1:] == 0
    lengths = np.where(ends.any(1), ends.argmax(1) + 2, digits.shape[1])
    chars = names[digits]
    chars[digits[:, 0] == 0, 0] = ord("^")
    chars[chars == 0] = ord("$")
    return chars[np.arange(digits.shape[1]) < lengths[:, None]], lengths


def _grams(docs: DataFrame, longest: int) -> DataFrame:
    """gram, side, n: of what stands before (0) and after (1) each string, ends of runs among it,
    one row for each character that does.

    Windows of a string and a character beside it are counted where the texts lie;
    their beginnings are all strings with what stands beside them."""

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.append(t)
                size += len(t or "") + 1
                if size >= COUNTED:
                    w, n = windows(held, longest)
                    held, size = [], 0
                    yield from pa.table({"w": w, "n": n.astype(np.int64)}).to_batches(1 << 16)
        w, n = windows(held, longest)
        yield from pa.table({"w": w, "n": n.astype(np.int64)}).to_batches(1 << 16)

    counted = docs.select("text").mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    begun = counted.select(F.explode(F.transform(F.sequence(F.lit(2), F.length("w")), lambda k: F.substring(F.col("w"), F.lit(1), k))).alias("p"), "n")
    begun = begun.groupBy("p").agg(F.sum("n").alias("n"))
    part = lambda a, side: F.struct(F.expr(f"substring(p, {a}, length(p) - 1)").alias("gram"), F.lit(side).alias("side"))
    return begun.select(F.explode(F.array(part(2, 0), part(1, 1))).alias("g"), "n").select("g.gram", "g.side", "n").where(~F.col("gram").rlike("[$^]"))


def statistics(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """docs (text) to gram, n, cohesion (null for one character), branch: of all single
    characters, and of longer strings that occur ``least`` times."""
    sides = _grams(docs, longest).groupBy("gram", "side").agg(F.sum("n").alias("n"), (F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("h"))
    found = sides.groupBy("gram").agg(F.max("n").alias("n"), F.min("h").alias("branch")).where((F.length("gram") == 1) | (F.col("n") >= least))
    found = scratch.stored(found, "grams")
    total = found.where(F.length("gram") == 1).agg(F.sum("n").alias("total"))
    long_ = found.where(F.length("gram") > 1)
    cuts = long_.select("gram", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.length("gram") - 1)).alias("k"))
    cuts = cuts.select("gram", "a", F.substring(F.col("gram"), F.lit(1), F.col("k")).alias("left"), F.substring(F.col("gram"), F.col("k") + 1, F.length("gram")).alias("right"))
    # The parts of a frequent string are frequent.
    side = lambda name, n: found.select(F.col("gram").alias(name), F.col("n").alias(n))
    met = cuts.join(side("left", "l"), "left").join(side("right", "r"), "right").crossJoin(F.broadcast(total))  # one row is broadcast
    cohesion = met.groupBy("gram").agg(F.min(F.log("a") + F.log("total") - F.log("l") - F.log("r")).alias("cohesion"))
    return found.join(cohesion, "gram", "left").select("gram", "n", "cohesion", "branch")


def lexicon(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, cohesion: float = COHESION, branch: float = BRANCH, words: int = WORDS) -> DataFrame:
    """word and n of the corpus docs (text): single characters, and strings that hold together
    and stand among others; the ``words`` most frequent."""
    s = statistics(docs, longest, least)
    kept = s.where(F.col("cohesion").isNull() | ((F.col("cohesion") >= cohesion) & (F.col("branch") >= branch)))
    return kept.select(F.col("gram").alias("word"), "n").orderBy(F.desc("n"), "word").limit(words)


class Segmenter:
    """The likeliest cut of runs of Chinese characters.

    Costs within 1e-9 count as equal. Where no word lies across a place every way
    is cut there, and costs begin anew."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) or 1
        self.cost = {w: math.log(total) - math.log(n) for w, n in counts.items()}
        self.longest = max(map(len, counts), default=1)
        #: Of a character that no word covers: rarer than any word.
        self.unknown = math.log(total) + math.log(2)
        self._tree()

    def _tree(self) -> None:
        """The beginnings of words of Chinese characters as numbered nodes, for words(): 0 is none."""
        self.single = np.full(HAN + 1, self.unknown)
        words = [w for w in self.cost if len(w) > 1 and all(0 <= ord(x) - FIRST < HAN for x in w)]
        for w in self.cost:
            if len(w) == 1 and 0 <= ord(w) - FIRST < HAN:
                self.single[ord(w) - FIRST] = self.cost[w]
        letters = sorted(set("".join(words)))
        self.letter = np.zeros(HAN + 1, np.int32)
        self.letter[[ord(x) - FIRST for x in letters]] = np.arange(1, len(letters) + 1)
        number = {x: i for i, x in enumerate(letters, 1)}
        nodes, self.letters = {}, len(letters) + 1
        self.first, steps = np.zeros(self.letters, np.int32), {}
        for w in words:
            at = nodes.setdefault(w[0], len(nodes) + 1)
            self.first[number[w[0]]] = at
            for k in range(2, len(w) + 1):
                key = at * self.letters + number[w[k - 1]]
                at = steps[key] = nodes.setdefault(w[:k], len(nodes) + 1)
        self.node_cost = np.full(len(nodes) + 1, math.inf)
        self.node_cost[[nodes[w] for w in words]] = [self.cost[w] for w in words]
        self.is_word = np.isfinite(self.node_cost)
        self.deepest = max(map(len, words), default=1)
        self.keys = np.sort(np.fromiter(steps, np.int64, len(steps)))
        self.to = np.array([steps[k] for k in self.keys.tolist()], np.int32)
        self.table = None
        if (len(nodes) + 1) * self.letters <= TABLE:
            self.table = np.zeros((len(nodes) + 1) * self.letters, np.int32)
            self.table[self.keys] = self.to

    def _next(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[node * np.int32(self.letters) + letter]
        key = node.astype(np.int64) * self.letters + letter
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[found] == key, self.to[found], np.int32(0))

    def cut(self, run: str) -> list[str]:
        """Words of a run: of least cost, of these the fewest, of these the one whose last words are longest."""
        n = len(run)
        best: list[tuple[float, int, int, int] | None] = [(0, 0, 0.0, 0)] + [None] * n
        cost, unknown, reach = self.cost, self.unknown, 0
        for j in range(n):
            _, words, base, _ = best[j]
            if reach <= j:
                words, base = 0, 0.0
            for i in range(j + 1, min(n, j + self.longest) + 1):
                c = cost.get(run[j:i], unknown if i - j == 1 else None)
                if c is not None:
                    reach = max(reach, i)
                    way = (round((base + c) * 1e9), words + 1, base + c, j)
                    if best[i] is None or way[:2] < best[i][:2]:
                        best[i] = way
        out, i = [], n
        while i:
            out.append(run[best[i][3] : i])
            i = best[i][3]
        return out[::-1]

    def words(self, texts: Iterable[str | None]) -> pa.ListArray:
        """Words of texts by the same rule, all runs at once."""
        texts = [t or "" for t in texts]
        c = np.minimum(_characters(texts), HAN)
        n, han = len(c), c < HAN
        letter = np.append(self.letter[c], np.zeros(self.deepest, np.int32))
        # ends[k][p]: cost of the word of k + 2 characters that ends before place p.
        ends, cuts = [], np.ones(n + 1, bool)
        node, at = self.first[letter[:n]], None
        for k in range(2, self.deepest + 1):
            node = self._next(node, letter[k - 1 : n + k - 1] if at is None else letter[at + (k - 1)])
            going = np.flatnonzero(node)
            at, node = going if at is None else at[going], node[going]
            is_word = self.is_word[node]
            found = at[is_word]
            ends.append(np.full(n + 1, math.inf))
            ends[-1][found + k] = self.node_cost[node[is_word]]
            for i in range(1, k):
                cuts[found + i] = False
        places = np.flatnonzero(cuts)
        self._cut_between(places[:-1], places[1:], c, ends, cuts)
        # Each Chinese character takes three bytes.
        cuts = cuts[1:] & han
        stops = np.flatnonzero(cuts)
        offsets = np.zeros(len(stops) + 1, np.int32)
        offsets[1:] = 3 * (np.flatnonzero(cuts[han]) + 1)
        values = pa.StringArray.from_buffers(len(stops), pa.py_buffer(offsets), pa.py_buffer(_text(c[han]).encode()))
        until = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        lists = np.append(0, np.searchsorted(stops, until.cumsum())).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(lists), values)

    def _cut_between(self, starts, stops, c, ends, cuts) -> None:
        """Sets in ``cuts`` where stretches without a sure cut are cut: one character further in all
        of them at a time, the longest first, and alone those that are longer than nearly all."""
        many = np.flatnonzero(stops - starts > 1)
        starts, stops = starts[many], stops[many]
        order = np.argsort(starts - stops, kind="stable")
        starts, stops = starts[order], stops[order]
        lengths, back = stops - starts, np.zeros(len(c) + 1, np.int32)
        active = len(starts) - np.searchsorted(lengths[::-1], np.arange(lengths.max(initial=0) + 2))
        # Of the last places: cost and number of words.
        last = [(np.zeros(len(starts)), np.zeros(len(starts), np.int64))]
        steps = 0
        while active[steps + 1] >= FEW:
            steps += 1
            m, p = active[steps], starts[: active[steps]] + steps
            told = None
            for k in range(min(steps, len(ends) + 1), 0, -1):
                base, words = last[-k]
                way = base[:m] + (self.single[c[p - 1]] if k == 1 else ends[k - 2][p])
                key, words = np.rint(way * 1e9), words[:m] + 1
                if told is None:
                    told, least, fewest, size = key, way, words, np.full(m, k, np.int32)
                    continue
                better = (key < told) | ((key == told) & (words < fewest))
                told, least, fewest, size = np.where(better, key, told), np.where(better, way, least), np.where(better, words, fewest), np.where(better, np.int32(k), size)
            back[p] = size
            last = [*last[-len(ends) :], (least, fewest)]
        alone = active[steps + 1]
        for a, b in zip(starts[:alone].tolist(), stops[:alone].tolist(), strict=True):
            cuts[a + np.cumsum([len(w) for w in self.cut(_text(c[a:b]))])] = True
        starts, p = starts[alone:], stops[alone:]
        while len(p):
            p = p - back[p]
            inside = p > starts
            starts, p = starts[inside], p[inside]
            cuts[p] = True


def pieces(texts: pd.Series, most: int = HELD) -> Iterator[pd.Series]:
    """A batch's texts in order, in parts of some ``most`` characters or of one longer text."""
    part = texts.str.len().fillna(0).to_numpy().cumsum() // most
    for a, b in itertools.pairwise([0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]):
        yield texts.iloc[a:b]


def segmenter(found: DataFrame) -> Callable[[Column], Column]:
    """A function from a text column to its Chinese words in order, for segmented_tokens(), by
    a lexicon (word, n) of bounded size, which is taken to all tasks."""
    rows = found.limit(WORDS).collect()
    shared = found.sparkSession.sparkContext.broadcast({r["word"]: r["n"] for r in rows})

    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        s = Segmenter(shared.value)
        for batch in batches:
            # Words take many times the room of their text: a part's are handed on before the next part is cut.
            for texts in pieces(batch.to_pandas() if isinstance(batch, pa.Array) else batch):
                yield s.words(texts.tolist())

    cut.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(cut, ArrayType(StringType()))
