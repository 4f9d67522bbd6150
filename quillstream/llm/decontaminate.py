"""Benchmark decontamination with a generalised suffix automaton.

The automaton is built once over the normalised words of all test items. Each
document is streamed through it word by word; the state's length is the longest
match that ends at that word, so every word of a match of at least ``window``
words lies inside an occurrence of a window, and all other words do not.

Items of more than ``SHARD_WORDS`` words are dealt over several automata. Each
then goes over the documents in a pass of its own, so that a worker holds one of
them, and leaves a row for each text that it hits; these rows are united and
joined to the documents by the texts' digests. One automaton needs no shuffle.

Defined cases: a null or empty text has no words and no hits; repeated rows are
judged separately with the same result; an empty item table marks nothing; item
rows with null or wordless texts take no part; those with a null id mark words
but are not among the items; several rows with one item id count as one item;
texts of any length are streamed whole; other columns are never looked at,
whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillstream.llm.common import WORD_TABLE, bit_filter, in_filter, stored, words_of, worker_state

#: Words of test items in one automaton, about 1 kB each in Python.
SHARD_WORDS = 100_000
#: Words in an occurrence.
WINDOW = 10
#: With more distinct item words than this, pairs are looked up by search and
#: not in a bit table.
PAIR_TABLE_WORDS = 6_000

_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Automaton:
    """Suffix automaton of several word sequences.

    ``step`` tables are dicts by word id; ``full`` lists the short items that
    end in a state, ``owners`` the items that hold the state's window.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = [(i, [self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws]) for i, ws in items if ws]
        for _, seq in sequences:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        self._mark(sequences)
        self._pairs(sequences)

    def _clone(self, p: int, q: int, c: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
        cur = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return cur

    def _mark(self, sequences: list[tuple[str | None, list[int]]]) -> None:
        """Which items a match tells of: by short whole items, and by windows.

        Items without an id are matched like all others and tell of none."""
        self.owners: dict[int, set[str]] = {}
        self.full: dict[int, tuple[int, set[str]]] = {}
        self.shortest = min([len(s) for _, s in sequences], default=1)
        for item, seq in sequences:
            if item is None and len(seq) >= self.window:
                continue
            if len(seq) < self.window:
                state = 0
                for c in seq:
                    state = self.next[state][c]
                self.full.setdefault(state, (len(seq), set()))[1].update(() if item is None else (item,))
                continue
            state = size = 0
            for c in seq:
                state, size = self.next[state][c], size + 1
                if size >= self.window:
                    while self.length[self.link[state]] >= self.window:
                        state = self.link[state]
                    size = min(size, self.length[state])
                    self.owners.setdefault(state, set()).add(item)
        # Chains of short items that end in each state, by suffix links.
        order = sorted(range(len(self.link)), key=self.length.__getitem__)
        self.short: list[tuple[int, ...]] = [()] * len(self.link)
        for s in order[1:]:
            above = self.short[self.link[s]]
            self.short[s] = (s, *above) if s in self.full else above
        self.any_short = bool(self.full)

    def _pairs(self, sequences: list[tuple[str, list[int]]]) -> None:
        n = self.base = len(self.vocab) + 1
        codes = np.unique(np.array([a * n + b for _, s in sequences for a, b in zip(s, s[1:], strict=False)], dtype=np.int64))
        self.single = any(len(s) == 1 for _, s in sequences)
        if n <= PAIR_TABLE_WORDS:
            self.pair_bits, self.pair_codes = np.zeros(n * n, dtype=bool), None
            self.pair_bits[codes] = True
        else:
            self.pair_bits, self.pair_codes = None, codes

    def _known(self, ids: np.ndarray) -> np.ndarray:
        """Whether words i and i + 1 stand so in some item."""
        codes = ids[:-1] * self.base + ids[1:]
        if self.pair_bits is not None:
            return self.pair_bits[codes]
        if not len(self.pair_codes):
            return np.zeros(len(codes), dtype=bool)
        at = np.searchsorted(self.pair_codes, codes)
        at[at == len(self.pair_codes)] = 0
        return self.pair_codes[at] == codes

    def scan(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit word spans [from, to) in order, united, and the items that occur.

        Only stretches of words whose every neighbour pair stands in some item
        and which are long enough to hold a window are streamed: all others
        cannot hold one.
        """
        n, spans, items = len(ids), [], set()
        if not n or not self.vocab:
            return spans, items
        least = min(self.shortest, self.window)
        if self.single or least < 2:
            stretches = [(0, n)] if (ids > 0).any() else []
        elif n < least:
            return spans, items
        else:
            flags = np.zeros(n + 1, dtype=np.int8)
            flags[1:n] = self._known(ids)
            edges = np.flatnonzero(np.diff(flags))
            # flags[k] speaks of words k - 1 and k: a run of flags a+1..b joins words a..b
            stretches = [(int(a), int(b) + 1) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a + 1 >= least]
        nxt, link, length, window, short = self.next, self.link, self.length, self.window, self.short
        for a, b in stretches:
            state = size = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                to = nxt[state].get(c)
                while to is None and state:
                    state = link[state]
                    size = length[state]
                    to = nxt[state].get(c)
                if to is None:
                    continue
                state, size = to, size + 1
                start = i + 1
                if size >= window:
                    start = i + 1 - size
                    s = state
                    while length[link[s]] >= window:
                        s = link[s]
                    items.update(self.owners.get(s, ()))
                if self.any_short:
                    for s in short[state]:
                        k, own = self.full[s]
                        if k <= size:
                            items |= own
                            start = min(start, i + 1 - k)
                if start <= i:
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i + 1))
        return spans, items


def shards(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", limit: int = SHARD_WORDS, window: int = WINDOW) -> Iterator[Automaton]:
    """Automata over all items, each of at most ``limit`` words (or one item).

    Items reach the driver one partition at a time and are let go as soon as
    their automaton is built, so the driver holds one shard.
    """
    held, size = [], 0
    for row in benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).toLocalIterator():
        if ws := words_of(row[1]):
            if held and size + len(ws) > limit:
                yield Automaton(held, window)
                held, size = [], 0
            held.append((row[0], ws))
            size += len(ws)
    yield Automaton(held, window)


def _found(auto, text: str | None):
    words = words_of(text)
    ids = np.fromiter(map(auto.vocab.get, words, [0] * len(words)), dtype=np.int64, count=len(words))
    spans, items = auto.scan(ids)
    return len(words), spans, sorted(items)


def digest_of(text: str | None) -> bytes | None:
    return None if text is None else hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def _halves(texts) -> list[pa.Array]:
    """Digests of texts as two columns of whole numbers; null for null."""
    found = [digest_of(t) for t in texts]
    none = np.array([d is None for d in found], bool)
    both = np.frombuffer(b"".join(d or bytes(16) for d in found), np.int64).reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(both[:, i]), mask=none) for i in (0, 1)]


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def hits(documents: DataFrame, automata: Iterator[Automaton]) -> DataFrame:
    """k1, k2 (a text's digest), spans and items of each text that some automaton
    hits; one pass over the documents for each automaton."""
    spark = documents.sparkSession
    tables = []
    for auto in automata:
        shared = spark.sparkContext.broadcast(auto)

        def run(batches, shared=shared):
            worker_state("decontaminate", bool)
            for batch in batches:
                texts, spans, items = [], [], []
                for text in batch.column(0):
                    _, s, i = _found(shared.value, text.as_py())
                    if s:
                        texts.append(text.as_py())
                        spans.append([{"start": a, "stop": b} for a, b in s])
                        items.append(i)
                yield pa.RecordBatch.from_arrays([*_halves(texts), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))], names=["k1", "k2", "spans", "items"])

        found = documents.select("text").mapInArrow(run, "k1 long, k2 long, spans array<struct<start:int,stop:int>>, items array<string>")
        tables.append(stored(found.dropDuplicates(["k1", "k2"]), "hits"))
        shared.destroy()
    # A text has a row for each automaton at most.
    every = reduce(DataFrame.unionByName, tables)
    return every.groupBy("k1", "k2").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def few(benchmark: DataFrame, window: int, limit: int) -> tuple[Automaton | None, Iterator[Automaton]]:
    """The only automaton, or None and all of them."""
    every = shards(benchmark, limit=limit, window=window)
    first = next(every)
    second = next(every, None)
    if second is None:
        return first, iter(())
    return None, chain([first, second], every)


def unite(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; one row per document row."""
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    one, more = few(benchmark, window, limit)
    if one is None:
        return _contamination_of_many(documents, hits(documents, more), kind)
    shared = spark.sparkContext.broadcast(one)

    def run(batches):
        worker_state("decontaminate", bool)  # lets go of other operators' memos
        for batch in batches:
            rows = []
            for text in batch.column(1):
                n, spans, items = _found(shared.value, text.as_py())
                hit = sum(b - a for a, b in spans)
                rows.append((n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def _contamination_of_many(documents: DataFrame, found: DataFrame, kind: str) -> DataFrame:
    def run(batches):
        worker_state("decontaminate", bool)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), *_halves(texts), pa.array([len(words_of(t)) for t in texts], pa.int64())], names=["doc_id", "k1", "k2", "n_words"])

    rows = documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, n_words long").join(found, ["k1", "k2"], "left")
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], a["end"]))).alias("n"), F.greatest(a["end"], s["stop"]).alias("end"))
    hit = F.coalesce(F.aggregate("spans", zero, step)["n"], F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select("doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans; what stood between them stays apart."""
    # The word rule is the same on characters as on bytes, after lower-casing.
    ends = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : ends[a][0]])
        at = ends[b - 1][1]
    return "".join([*out, text[at:]])


def _without(batch: pa.RecordBatch, at: int, found: Iterator[tuple[list[tuple[int, int]], int]], coverage: float) -> pa.RecordBatch:
    """batch without the spans of each text, and without rows that are mostly such; found gives spans and words."""
    texts, keep, changed = [], [], False
    for value, (spans, n) in zip(batch.column(at), found, strict=True):
        keep.append(not spans or sum(b - a for a, b in spans) <= coverage * n)
        text = value.as_py()
        if spans and keep[-1]:
            text, changed = cut(text, spans), True
        texts.append(text)
    if changed:
        batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
    return batch if all(keep) else batch.filter(pa.array(keep))


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = 0.5, limit: int = SHARD_WORDS) -> DataFrame:
    """documents, all columns kept, without contaminated passages.

    A passage is a united hit span; where hits cover more than ``coverage`` of a
    document's words the whole document goes. Clean rows pass untouched.
    """
    spark = documents.sparkSession
    at = documents.columns.index("text")
    one, more = few(benchmark, window, limit)
    if one is None:
        return _decontaminated_of_many(documents, hits(documents, more), at, coverage)
    shared = spark.sparkContext.broadcast(one)

    def run(batches):
        worker_state("decontaminate", bool)  # lets go of other operators' memos
        for batch in batches:
            found = (_found(shared.value, text.as_py()) for text in batch.column(at))
            yield _without(batch, at, ((spans, n) for n, spans, _ in found), coverage)

    return documents.mapInArrow(run, documents.schema)


def _decontaminated_of_many(documents: DataFrame, found: DataFrame, at: int, coverage: float) -> DataFrame:
    """As decontaminate(), by hits that are joined by digest; only texts that a
    bounded filter marks as possibly hit are shuffled."""
    found = stored(found.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("spans").alias("__spans")), "hits")
    words, bits = bit_filter(found.select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2")))
    shared = documents.sparkSession.sparkContext.broadcast(words)
    schema, columns = documents.schema, documents.columns

    def mark(batches):
        worker_state("decontaminate", bool)
        for batch in batches:
            halves = _halves(batch.column(at).to_pylist())
            keys = np.column_stack([h.fill_null(0).to_numpy() for h in halves]).reshape(-1, 2)
            out = pa.array(~in_filter(shared.value, bits, keys))
            halves = [pa.array([None if o else k for o, k in zip(out.to_pylist(), h.to_pylist(), strict=True)], pa.int64()) for h in halves]
            yield pa.RecordBatch.from_arrays([*batch.columns, *halves], schema=batch.schema.append(pa.field("__k1", pa.int64())).append(pa.field("__k2", pa.int64())))

    def run(batches):
        for batch in batches:
            texts = batch.column(at)
            spans = (unite([(s["start"], s["stop"]) for s in x.as_py() or ()]) for x in batch.column(len(columns)))
            yield _without(batch.select(columns), at, ((s, len(words_of(t.as_py()))) for s, t in zip(spans, texts, strict=True)), coverage)

    marked = documents.mapInArrow(mark, StructType([*schema.fields, StructField("__k1", LongType()), StructField("__k2", LongType())]))
    clear = marked.where(F.col("__k1").isNull()).select(*columns)
    asked = marked.where(F.col("__k1").isNotNull()).join(found, ["__k1", "__k2"], "left").select(*columns, "__spans")
    return clear.unionByName(asked.mapInArrow(run, schema))


assert WORD_TABLE[0x2F] == WORD_TABLE[0x3A] == WORD_TABLE[0x60] == WORD_TABLE[0x7F] == 0x20
