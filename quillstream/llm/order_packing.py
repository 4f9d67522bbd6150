"""Order-preserving packing: where to cut the stream of all documents' tokens.

Documents follow each other by id as one stream of tokens, each with its end
mark. Windows of the stream become sequences. A sequence is padded to ``WIDTH``
tokens, unless it holds exactly a power of two of them. Cuts are allowed where a
document ends, after a sentence and, where sentences are long, every ``FILL``
tokens; dynamic programming chooses those of least padding plus penalties for
texts that are cut. With ``p`` the place of a cut and ``d`` the least cost up to
it, a window from i to j costs ``WIDTH - (p[j] - p[i])``, so the best i is that of
least ``d[i] + p[i]`` among the places within ``WIDTH`` of j: a monotone queue has
it at its head. The powers of two are one look each.

Sentence ends are read from the ids by two tables over the vocabulary: tokens
that end with a mark, and tokens that start with white space.

Documents are dealt over tasks by ranges of their ids. A task works on blocks of
``BLOCK`` tokens; windows near the end of a block wait for the next one, so what
a block does not see yet does not spoil its cuts, and memory is bounded.

Defined cases: a null or empty text is one end mark; rows that share an id
follow each other by their text, rows without an id come first, and each row is
a document of its own; a text of any length is cut wherever that costs least; an
empty table gives an empty result; other columns are ignored, whatever their
names. Sequences of different tasks have different numbers, not dense ones.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quillstream.llm.common import tasks_for, worker_state
from quillstream.llm.token_orc import END_ID, Encoder, vocabulary

#: Tokens of a sequence, a power of two.
WIDTH = 1_024
#: What a cut costs, in tokens of padding: after a sentence and inside one. Between documents it is free.
SENTENCE, INSIDE = 4, 32
#: What a sequence costs beside its padding, so that of equal paddings fewer sequences win.
OPENING = 1
#: Tokens without a sentence end after which a cut is allowed all the same.
FILL = 128
#: Tokens that a task decides on at once, and those at their end that wait for what follows.
BLOCK, WAIT = 1 << 20, 16 * WIDTH


def best_cuts(places: np.ndarray, penalties: np.ndarray, width: int = WIDTH, final: bool = True) -> list[int]:
    """Indices of the cuts of least cost among ``places`` (ascending, from 0 on).

    The last place is the last cut, unless more is to come (not ``final``): then
    the cheapest place within a width of it is. Neighbouring places must not lie
    further apart than ``width``."""
    at, pen, m = places.tolist(), penalties.tolist(), len(places)
    # Pairs (j, i) of places that are a power of two apart, by a table of what is at each token.
    index_of = np.full(at[-1] + width + 1, -1, np.int32)
    index_of[places + width] = np.arange(m, dtype=np.int32)
    js, is_ = [], []
    for k in range(width.bit_length()):
        i = index_of[places + (width - (1 << k))]
        j = np.flatnonzero(i >= 0)
        js.append(j)
        is_.append(i[j])
    js, is_ = np.concatenate(js), np.concatenate(is_)
    order = np.argsort(js, kind="stable")
    exact_j, exact_i = [*js[order].tolist(), m], [*is_[order].tolist(), 0]
    cost, back = [0], [0]
    # The queue: indices, places and keys of what may still be the best, from head on.
    queue, lies, keys, head, e = [], [], [], 0, 0
    c, p = 0, at[0]
    nearest = exact_j[0]
    for j in range(1, m):
        key = c + p
        while len(keys) > head and keys[-1] > key:
            keys.pop()
            lies.pop()
            queue.pop()
        queue.append(j - 1)
        lies.append(p)
        keys.append(key)
        p = at[j]
        while lies[head] < p - width:
            head += 1
        c, i = keys[head] + width - p, queue[head]
        while nearest == j:
            if cost[exact_i[e]] < c:
                i = exact_i[e]
                c = cost[i]
            e += 1
            nearest = exact_j[e]
        c += pen[j] + OPENING
        cost.append(c)
        back.append(i)
    j = m - 1
    if not final:
        last = [i for i in range(1, m) if at[i] > at[-1] - width]
        j = min(last, key=lambda i: (cost[i], -i)) if last else j
    out = [j]
    while j:
        j = back[j]
        out.append(j)
    return out[::-1]


class Marks:
    """Which tokens end a sentence, and which start with white space, by id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        vocabulary_ = Tokenizer.from_file(path).get_vocab()
        size = max(vocabulary_.values()) + 1
        self.ends, self.starts, self.closes = np.zeros(size, bool), np.zeros(size, bool), np.zeros(size, bool)
        for token, i in vocabulary_.items():
            # A byte-level vocabulary shows a space as Ġ and a line end as Ċ.
            self.ends[i] = token.endswith((".", "!", "?", '."', '!"', '?"'))
            self.starts[i] = token.startswith(("Ġ", "Ċ"))
            # Marks after which no space stands: line ends and the bytes of 。！？
            self.closes[i] = token.endswith(("Ċ", "ãĢĤ", "ï¼ģ", "ï¼Ł"))

    def sentences(self, ids: np.ndarray) -> np.ndarray:
        """Places inside ids where a sentence has just ended."""
        if len(ids) < 2:
            return np.empty(0, np.int64)
        return np.flatnonzero(self.closes[ids[:-1]] | (self.ends[ids[:-1]] & self.starts[ids[1:]])) + 1


def allowed(ends: np.ndarray, sentences: np.ndarray, fill: int = FILL) -> tuple[np.ndarray, np.ndarray]:
    """Places of allowed cuts from 0 on and their penalties, from the ends of documents, in
    order (the last of them may be the end of a part), and of sentences before it."""
    at = np.zeros(int(ends[-1]) + 1, np.int64)
    at[sentences], at[ends], at[0] = SENTENCE + 1, 1, 1
    places = np.flatnonzero(at)
    gaps = np.diff(places)
    more = (gaps - 1) // fill
    base = np.repeat(places[:-1], more)
    step = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
    extra = base + step * fill
    at[extra] = INSIDE + 1
    every = np.flatnonzero(at)
    return every, at[every] - 1


class Stream:
    """Documents in order to pieces of sequences, a block at a time."""

    NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

    def __init__(self, marks: Marks, first: int = 0, width: int = WIDTH, block: int = BLOCK, wait: int = WAIT):
        self.marks, self.width, self.block, self.wait = marks, width, block, wait
        self.sequence = first
        # Of each document that waits: id, tokens, what is left of them and where that starts.
        self.docs: list[tuple] = []
        self.held = 0

    def add(self, doc_id, ids: np.ndarray):
        self.docs.append((doc_id, len(ids), ids, 0))
        self.held += len(ids)
        while self.held >= self.block + self.wait:
            yield self._cut(final=False)

    def close(self):
        if self.held:
            yield self._cut(final=True)

    def _cut(self, final: bool) -> dict:
        """Pieces of all windows that are decided; what is left waits."""
        most, take, sizes, n = self.held if final else self.block + self.wait, [], [], 0
        for doc in self.docs:
            take.append(doc[2][: most - n])
            sizes.append(len(doc[2]))
            n += len(take[-1])
            if n == most:
                break
        ids, ends = np.concatenate(take), np.cumsum(sizes)
        ends = ends[ends <= n]
        places, penalties = allowed(np.append(ends, n), self.marks.sentences(ids), min(FILL, self.width))
        # The end of a block that is not a document's is no place for a free cut.
        if not len(ends) or ends[-1] != n:
            penalties[-1] = INSIDE
        cuts = places[best_cuts(places, penalties, self.width, final)]
        if not final:
            cuts = cuts[cuts <= self.block]
        return self._pieces(cuts.tolist(), ids)

    def _pieces(self, cuts: list[int], ids: np.ndarray) -> dict:
        out: list[tuple] = []
        data, at, done = ids.tobytes(), 0, 0
        doc_id, tokens, _, start = self.docs[0]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            at = lo
            while at < hi:
                n = min(hi - at, tokens - start)
                out.append((doc_id, start, n, zlib.crc32(data[4 * at : 4 * (at + n)]), tokens, self.sequence, at - lo))
                at += n
                start += n
                if start == tokens:
                    done += 1
                    if done < len(self.docs):
                        doc_id, tokens, _, start = self.docs[done]
            self.sequence += 1
        self.docs = self.docs[done:]
        if self.docs:
            self.docs[0] = (doc_id, tokens, self.docs[0][2][start - self.docs[0][3] :], start)
        self.held -= at
        return dict(zip(self.NAMES, zip(*out, strict=True), strict=True))


def pack(documents: DataFrame, tokenizer: str | None = None, width: int = WIDTH, files: int | None = None) -> DataFrame:
    """documents (doc_id, text) to their pieces: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset.

    ``start`` counts the tokens of the document before the piece, ``offset`` those
    of its sequence. ``tokenizer`` is a file that every executor can open; by
    default the installed byte-level vocabulary. One shuffle, of the texts."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    types = {"doc_id": documents.sparkSession.createDataFrame([], f"doc_id {kind}").toArrow().schema.field(0).type, "sequence_id": pa.int64()}

    def run(batches):
        path = tokenizer or vocabulary()
        enc, marks = worker_state(("order_packing", path), lambda: (Encoder(path), Marks(path)))
        stream = Stream(marks, TaskContext.get().partitionId() << 40, width)
        end = np.array([END_ID], dtype="<u4")

        def rows(pieces: dict):
            table = pa.table({name: pa.array(values, types.get(name, pa.int64())) for name, values in pieces.items()})
            yield from table.to_batches(max_chunksize=20_000)

        for part in batches:
            for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1)), strict=True):
                for pieces in stream.add(doc_id, np.concatenate([np.frombuffer(ids, dtype="<u4"), end])):
                    yield from rows(pieces)
        for pieces in stream.close():
            yield from rows(pieces)

    dealt = documents.select("doc_id", "text").repartitionByRange(files or tasks_for(documents), "doc_id").sortWithinPartitions("doc_id", "text")
    return dealt.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
