"""Chunking as array expressions: a text becomes an array of chunks.

Greedy packing is a fold over lengths that keeps only where each chunk starts;
the chunks are then sliced out, so a fold's state stays small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstream.functions.text import SPACE, collapse, let, named, strip

PARAGRAPH, CODE, CODE_LINES, TABLE_ROWS, OVERLAP = 500, 2000, 10, 20, 50


def _starts(sizes: Column, limit: int) -> Column:
    """0-based places at which greedy packing of sizes begins a new chunk."""
    zero = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("i"), F.lit(0).alias("n"))

    def step(a, x):
        new = (a["n"] + x > limit) | (a["i"] == 0)
        return F.struct(
            F.when(new, F.concat(a["at"], F.array(a["i"]))).otherwise(a["at"]).alias("at"),
            (a["i"] + 1).alias("i"),
            F.when(new, x).otherwise(a["n"] + x).alias("n"),
        )

    return F.aggregate(sizes, zero, step)["at"]


def _cut(parts: Column, starts: Column, joint: str) -> Column:
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(parts)))
    return F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda z: F.array_join(F.slice(parts, z["s"] + 1, z["e"] - z["s"]), joint))


def _packed(parts: Column, size, limit: int, joint: str) -> Column:
    """parts packed greedily by their sizes; both are worked out once."""
    return let(parts, lambda p: let(_starts(F.transform(p, size), limit), lambda s: _cut(p, s, joint)))


def words(c: Column) -> Column:
    return F.filter(F.split(collapse(c), " "), lambda w: w != "")


def fixed_size(c: Column, limit: int = PARAGRAPH) -> Column:
    """Greedy packing of words, each counted with one space."""
    return _packed(words(c), lambda x: F.length(x) + 1, limit, " ")


def sentences(c: Column) -> Column:
    """Parts that end with closing marks before white space, a capital or the end; what is left over is glued to the last."""

    def glued(parts: Column) -> Column:
        last = F.get(parts, F.size(parts) - 1)
        one = F.concat(F.slice(parts, 1, F.size(parts) - 2), F.array(F.concat(F.get(parts, F.size(parts) - 2), last)))
        return F.when((F.size(parts) > 1) & ~last.rlike(r"[.!?。！？]$"), one).otherwise(parts)

    parts = F.filter(F.split(c, r"(?<=[.!?。！？])(?=\s|$|[A-ZА-Я])"), lambda s: s != "")
    return F.filter(let(parts, glued), lambda s: strip(s) != "")


def slices(c: Column, size: int) -> Column:
    """Pieces of so many characters."""
    n = F.length(c)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda i: F.substring(c, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def paragraph(c: Column, limit: int = PARAGRAPH) -> Column:
    """Whole if short; else greedy packing of sentences, those over the limit sliced."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def flushed(a):
        return let(strip(a["cur"]), lambda t: F.when(t != "", F.concat(a["done"], F.array(t))).otherwise(a["done"]))

    def step(a, s):
        fits = F.length(a["cur"]) + F.length(s) <= limit
        long_ = F.length(s) > limit
        return named(
            done=F.when(fits, a["done"]).when(long_, F.concat(flushed(a), slices(s, limit))).otherwise(flushed(a)),
            cur=F.when(fits, F.concat(a["cur"], s)).when(long_, "").otherwise(s),
        )

    return F.when(F.length(c) <= limit, F.array(c)).otherwise(F.aggregate(sentences(c), zero, step, flushed))


def code(c: Column, limit: int = CODE, lines: int = CODE_LINES, preserve: bool = True) -> Column:
    """Whole unless long in characters and lines; then greedy packing of lines, line ends not counted."""
    if not preserve:
        return slices(c, limit)
    packed = let(F.split(c, "\n", -1), lambda p: F.when(F.size(p) > lines, let(_starts(F.transform(p, F.length), limit), lambda s: _cut(p, s, "\n"))).otherwise(F.array(c)))
    return F.when(F.length(c) > limit, packed).otherwise(F.array(c))


def table(c: Column, split_rows: bool = True, most: int = TABLE_ROWS) -> Column:
    """Groups of rows of a pipe table, or the whole; other text by fixed size."""
    whole = F.array(c)
    if split_rows:
        rows = F.filter(F.split(c, "\n", -1), lambda r: strip(r) != "")
        whole = let(rows, lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.size(p) - 1, F.lit(0)), F.lit(most)), lambda i: F.array_join(F.slice(p, i + 1, most), "\n")))
    return F.when(c.rlike(rf"(?m)^{SPACE}*\|"), whole).otherwise(fixed_size(c))


Chunker = Callable[[Column], Column]
#: Chunkers by element type, others by fixed size; register_chunker() adds to them.
CHUNKERS: dict[str, Chunker] = {"code_block": code, "table": table, "paragraph": paragraph}


def register_chunker(kind: str, chunker: Chunker) -> None:
    """A chunker of one's own for an element type: a text column to an array of chunks."""
    CHUNKERS[kind.lower()] = chunker


def by_element(c: Column, kind: Column) -> Column:
    k, out = F.lower(kind), fixed_size(c)
    for name, chunker in CHUNKERS.items():
        out = F.when(k == name, chunker(c)).otherwise(out)
    return out


def chunk_type(kind: Column) -> Column:
    k = F.lower(kind)
    return F.when(k.contains("code") | k.contains("block"), "code").when(k.contains("table"), "table").when(k.contains("list"), "list").when(k.contains("heading") | k.contains("header"), "heading").otherwise("text")


def semantic_tail(c: Column, n: int = OVERLAP) -> Column:
    """The end of a text, cut at a sentence's end or a word's."""
    sub = F.right(c, F.lit(n))
    # What follows the last mark up to the end must hold no letter or digit.
    at_word = F.regexp_extract(sub, r"(?s)^(.*?)\s[^a-zA-Z0-9]*$", 1)
    has_word = sub.rlike(r"(?s)\s[^a-zA-Z0-9]*$")
    has_mark = sub.rlike(r"(?s)[.!?。！？][^a-zA-Z0-9]*$")
    return F.when(F.length(c) <= n, c).when(has_mark, sub).when(has_word, at_word).otherwise(sub)


def semantic_head(c: Column, n: int = OVERLAP) -> Column:
    sub = F.left(c, F.lit(n))
    sentence = r"(?s)^[^.!?。！？]*[.!?。！？]\s*"
    return F.when(F.length(c) <= n, c).when(sub.rlike(sentence), F.regexp_extract(sub, sentence, 0)).when(sub.rlike(r"\s"), F.regexp_extract(sub, r"(?s)^.*?\s", 0)).otherwise(sub)
