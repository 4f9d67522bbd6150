"""Texts cut at structural boundaries, and images as elements.

Boundaries lie where lines start. A row's lines take one partitioning by the row:
what stands before a line (its position, blank lines, open headings) comes from
running sums and last values over them, and elements are what lies between
boundaries, so the work grows with the lines and not with their square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import chunk
from quillstream.functions.text import let, named, strip
from quillstream.operators.parsing import HEADING, TABLE_WORDS, heading_path, inside, lines_of, region_boxes, region_table, region_title

BULLET = r"^(\s*)([*+-]|[0-9]+\.)\s+"
#: A detector: kinds in the order they have at one position, each with what a line must be
#: (of the columns line, i, most, blank, run) and where the boundary lies: ``at`` the line or
#: at the ``gap``, where the blank lines right before it start. Kind ``heading`` is a line of its own.
Detector = Callable[[], list[tuple[str, Column, str]]]


def markdown_boundaries() -> list[tuple[str, Column, str]]:
    """Headings, fences, list items and table rows. A list item or table row begins with
    the blank lines before it, as its pattern takes them in."""
    line = F.col("line")
    return [("heading", line.rlike(HEADING), "at"), ("code_block", line.rlike(r"^(`{3,}|~{3,})"), "at"), ("list", line.rlike(BULLET), "gap"), ("table", line.rlike(r"^\s*\|.*\|\s*$"), "gap")]


def generic_boundaries() -> list[tuple[str, Column, str]]:
    """Gaps between paragraphs, list items, indents and line ends."""
    line, i, run = F.col("line"), F.col("i"), F.col("run")
    # Two line ends with nothing but white space between; a run that begins the text has one more line.
    enough = run >= F.when(i == run, 2).otherwise(1)
    # A run that ends the text ends where its last line starts.
    tail = F.col("blank") & (i == F.col("most")) & (i >= 1)
    return [("paragraph", (~F.col("blank") | tail) & enough, "at"), ("list", line.rlike(BULLET), "gap"), ("section", line.rlike(r"^( {2,}|\t+)"), "at"), ("custom", i > 0, "at")]


DETECTORS: dict[str, Detector] = {"markdown": markdown_boundaries, "md": markdown_boundaries}


def detector(file_type: str) -> Detector:
    """Boundaries by file type; the generic ones where no detector is registered."""
    return DETECTORS.get(file_type.lower(), generic_boundaries)


def _measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines with at (where each starts), blank, run (blank lines right before it), gap (where
    these start, or the line itself) and most (the number of the last line)."""
    order = Window.partitionBy("row_id").orderBy("i")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, -1)
    n = F.length("line")
    rows = lines_of(docs, id_col, text_col).withColumns({"blank": strip(F.col("line")) == "", "at": (F.sum(n + 1).over(so_far) - n - 1).cast("int"), "most": F.max("i").over(Window.partitionBy("row_id"))})
    written = F.max(F.when(~F.col("blank"), F.struct(F.col("i").alias("i"), (F.col("at") + n + 1).alias("end")))).over(before)
    rows = rows.withColumn("__before", written)
    return rows.withColumns({"run": F.col("i") - 1 - F.coalesce("__before.i", F.lit(-1)), "gap": F.coalesce("__before.end", F.lit(0)).cast("int")}).drop("__before")


def boundaries(docs: DataFrame, file_type: str = "markdown", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_id, doc_id, position, kind, level, title of every boundary."""
    heading = F.col("b.kind") == "heading"
    found = F.array(*[F.when(test, named(position=F.col(where), kind=F.lit(kind))) for kind, test, where in detector(file_type)()])
    rows = _measured(docs, id_col, text_col).select("row_id", "doc_id", "line", F.explode(F.array_compact(found)).alias("b"))
    return rows.select("row_id", "doc_id", "b.position", "b.kind", F.when(heading, F.length(F.regexp_extract("line", HEADING, 1))).alias("level"), F.when(heading, F.regexp_extract("line", HEADING, 2)).alias("title"))


def _with_paths(rows: DataFrame) -> DataFrame:
    """Lines (row_id, i, line, head) with path: the open headings at each line, its own included.

    A heading of level n leaves n - 1 of the open ones and comes after them. So its
    depth is one more than that of the heading before, or n if that is less: its
    number among the headings, less the largest lead that any of them had over its
    own level. The open heading of a depth is the last one of it, if it came after
    the last of every smaller depth."""
    order = Window.partitionBy("row_id").orderBy("i")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head, level = F.col("head"), F.length(F.regexp_extract("line", HEADING, 1))
    rows = rows.withColumn("__k", F.sum(head.cast("int")).over(so_far))
    lead = F.min(F.when(head, level - F.col("__k"))).over(so_far)
    rows = rows.withColumn("__depth", F.when(head, F.col("__k") + F.least(lead, F.lit(0))))
    title = F.concat(F.regexp_extract("line", HEADING, 1), F.lit(" "), F.regexp_extract("line", HEADING, 2))
    return rows.withColumn("path", heading_path(F.col("__depth"), title, so_far)).drop("__k", "__depth")


def inferred_type(content: Column) -> Column:
    """What a stretch of text is: code by fences or indents, a table by two pipe lines, a list by an item."""
    pipes = F.size(F.filter(F.split(content, "\n", -1), lambda r: strip(r).startswith("|")))
    return F.when(content.contains("```") | content.contains("\n    ") | content.contains("\n\t"), "code_block").when(pipes > 1, "table").when(content.rlike(r"(?m)^\s*[*+-]\s+") | content.rlike(r"(?m)^\s*[0-9]+\.\s+"), "list_item").otherwise("paragraph")


def structured_elements(docs: DataFrame, file_type: str = "markdown", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_id, doc_id, element_index, element_type, raw_content, structure_path,
    parser_confidence: what stands between boundaries, and the line of each heading.

    A stretch has the path of the nearest heading at or before its start; headings
    themselves have none. Null and blank texts without a boundary are one paragraph.
    Rows that share an id, or have none, stay apart."""
    found = detector(file_type)()
    any_of = lambda tests: F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False))
    rows = _measured(docs, id_col, text_col)
    # A boundary at a gap lies where blank lines start, before the line that makes it.
    rows = rows.withColumns({"head": any_of([t for kind, t, _ in found if kind == "heading"]), "__own": any_of([t for _, t, where in found if where == "at"]), "__gap": any_of([t for _, t, where in found if where == "gap"])})
    back = Window.partitionBy("row_id").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    follows = F.last(F.when(~F.col("blank"), F.col("__gap")), ignorenulls=True).over(back)
    first = (F.col("run") == 0) & F.coalesce(follows, F.lit(False))
    rows = rows.withColumn("cut", F.col("__own") | first).withColumn("any", F.max("cut").over(Window.partitionBy("row_id")))
    order = Window.partitionBy("row_id").orderBy("i")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The line end of a heading belongs to what follows, unless a boundary lies between.
    after = F.coalesce(F.lag("head").over(order), F.lit(False)) & ~F.col("cut")
    rows = _with_paths(rows).withColumn("after", after)
    rows = rows.withColumn("part", F.sum((F.col("cut") | F.col("after")).cast("int")).over(so_far))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    parts = rows.groupBy("row_id", "doc_id", "part").agg(F.min("i").alias("i"), F.max("i").alias("to"), F.max("most").alias("most"), F.max("any").alias("any"), F.max("head").alias("head"), F.min_by("after", "i").alias("after"), F.min_by("path", "i").alias("path"), body.alias("body"))
    last = F.col("to") == F.col("most")
    # A stretch starts right after the heading before it and ends where the next line starts.
    stretch = F.concat(F.when(F.col("after"), "\n").otherwise(""), "body", F.when(last, "").otherwise("\n"))
    content = F.when(F.col("head") | ~F.col("any"), F.col("body")).otherwise(stretch)
    kind = F.when(F.col("head"), "heading").when(~F.col("any") | last, "paragraph").otherwise(inferred_type(content))
    sure = F.when(F.col("head") | ~F.col("any"), 1.0).otherwise(0.9)
    path = F.when(F.col("head") | ~F.col("any"), F.array().cast("array<string>")).otherwise(F.col("path"))
    out = parts.select("row_id", "doc_id", "i", "any", "head", kind.alias("element_type"), content.alias("raw_content"), path.alias("structure_path"), sure.alias("parser_confidence"))
    out = out.where(F.col("head") | ~F.col("any") | (strip(F.col("raw_content")) != ""))
    return out.select("row_id", "doc_id", (F.row_number().over(order) - 1).alias("element_index"), "element_type", "raw_content", "structure_path", "parser_confidence")


def chunked_by_structure(docs: DataFrame, file_type: str = "markdown", overlap: int = chunk.OVERLAP) -> DataFrame:
    """Documents (doc_id, text) to chunks of their structured elements, numbered through, with overlaps inside an element."""
    e = structured_elements(docs, file_type)
    cut = e.select("row_id", "doc_id", "element_index", "element_type", "structure_path", "parser_confidence", F.posexplode(chunk.by_element(F.col("raw_content"), F.col("element_type"))).alias("local", "t"))
    order = Window.partitionBy("row_id").orderBy("element_index", "local")
    before = F.when(F.col("local") > 0, F.lag("t").over(order))
    cut = cut.withColumn("prefix", F.coalesce(F.right(before, F.lit(overlap)), F.lit("")))
    return cut.select("row_id", "doc_id", (F.row_number().over(order) - 1).alias("chunk_index"), F.concat("prefix", "t").alias("text"), "element_type", chunk.chunk_type(F.col("element_type")).alias("chunk_type"), "structure_path", F.col("parser_confidence").alias("confidence"))


# ---------------------------------------------------------------- chunks as JSON

CHUNK = "struct<text:string,chunk_index:int,structure_path:array<string>,element_type:string,chunk_type:string,metadata:map<string,string>,confidence:double>"
TYPES = ("text", "code", "list", "table", "heading")


def envelope(chunks: DataFrame, *about: str) -> DataFrame:
    """doc_id and json: the columns that tell ``about`` a document, and its chunks in order.
    Fields without a value are left out. A document's chunks meet in its row."""
    names = [c for c in ("text", "chunk_index", "structure_path", "element_type", "chunk_type", "metadata", "overlap_info", "confidence") if c in chunks.columns]
    per = chunks.groupBy("doc_id", *about).agg(F.array_sort(F.collect_list(F.struct(F.col("chunk_index").alias("n"), F.struct(*names).alias("c")))).alias("all"))
    return per.select("doc_id", F.to_json(F.struct(F.col("doc_id").cast("string").alias("document_id"), *about, F.transform("all", lambda x: x["c"]).alias("chunks"))).alias("json"))


def from_envelope(rows: DataFrame, json_col: str = "json") -> DataFrame:
    """document_id and the chunks of envelopes, a row each; unknown chunk types are text."""
    parsed = rows.select(F.from_json(json_col, f"struct<document_id:string,chunks:array<{CHUNK}>>").alias("j")).select("j.document_id", F.explode("j.chunks").alias("c"))
    kind = F.when(F.col("c.chunk_type").isin(*TYPES), F.col("c.chunk_type")).when(F.col("c.chunk_type").isNotNull(), "text")
    return parsed.select("document_id", F.coalesce("c.text", F.lit("")).alias("text"), F.coalesce("c.chunk_index", F.lit(0)).alias("chunk_index"), "c.structure_path", "c.element_type", kind.alias("chunk_type"), "c.metadata", "c.confidence")


# ---------------------------------------------------------------- images

REGIONS = "array<struct<box:array<array<double>>,text:string,confidence:double>>"
#: A recogniser: an image's bytes to regions (box of four points, text, confidence).
Recogniser = Callable[[bytes], list[tuple[list[list[float]], str, float]]]
IMAGE_FAILED = "图片解析失败: "


def recognised(images: DataFrame, make: Callable[[], Recogniser], id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """Images (doc_id, content) to doc_id, regions, error; the recogniser is made once
    in each task. An image that it fails on has its error and no regions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = make()
        for rows in batches:
            found, errors = [], []
            for content in rows.iloc[:, 1]:
                try:
                    found.append([{"box": [list(map(float, p)) for p in box], "text": text, "confidence": float(sure)} for box, text, sure in read(bytes(content))])
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  a recogniser may fail in any way; the row tells how
                    found.append(None)
                    errors.append(str(e))
            yield pd.DataFrame({"doc_id": rows.iloc[:, 0], "regions": found, "error": errors})

    kind = images.schema[id_col].dataType.simpleString()
    return images.select(id_col, content_col).mapInPandas(run, f"doc_id {kind}, regions {REGIONS}, error string")


def region_level(text: Column) -> Column:
    """Level of a title: its marks, or the parts of its number (six at most), else 1."""
    number = F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]+)*)", 1)
    return F.when(text.startswith("#"), F.length(F.regexp_extract(text, r"^(\S+)", 1))).when(number != "", F.least(F.size(F.split(number, r"\.")), F.lit(6))).otherwise(1)


def region_paths(boxes: Column) -> Column:
    """The open titles at each region. A title closes those of larger levels only, so
    titles of one level pile up."""
    kind = "array<struct<level:int,title:string>>"
    zero = F.struct(F.array().cast("array<array<string>>").alias("out"), F.array().cast(kind).alias("open"))

    def step(a, r):
        def popped(level):
            # From the last title down, those of larger levels go up to the first that is not.
            keep = F.array_max(F.transform(F.sequence(F.lit(0), F.size(a["open"])), lambda i: F.when((i == 0) | (F.get(a["open"], i - 1)["level"] <= level), i)))
            return F.slice(a["open"], F.lit(1), keep)

        now = F.when(region_title(r["text"]), let(region_level(r["text"]), lambda n: F.concat(popped(n), F.array(named(level=n.cast("int"), title=r["text"]))))).otherwise(a["open"])
        return let(now, lambda s: named(out=F.concat(a["out"], F.array(F.transform(s, lambda t: t["title"]))), open=s))

    return F.aggregate(boxes, zero, step)["out"]


def image_elements(found: DataFrame) -> DataFrame:
    """doc_id, regions, error to elements: each region from top to bottom as heading or
    text_region, then the table among them, or one error for an image that failed.
    An image without regions has no elements."""
    rows = found.select("doc_id", "error", region_boxes(F.coalesce("regions", F.array().cast(REGIONS))).alias("boxes")).withColumns({"paths": region_paths(F.col("boxes")), "table": region_table(F.col("boxes"))})
    box = lambda r: F.array(r["x1"], r["y1"], r["x2"], r["y2"])
    none, nothing = F.array().cast("array<string>"), F.lit(None)

    def element(type_, text, path, confidence, bbox, in_table):
        return named(type=type_, text=text, path=path, confidence=confidence, bbox=bbox, in_table=in_table)

    regions = F.transform("boxes", lambda r, i: element(F.when(region_title(r["text"]), "heading").otherwise("text_region"), r["text"], F.get(F.col("paths"), i), r["confidence"], box(r), inside(r, F.col("table"))))
    table = element(F.lit("table"), F.concat(F.lit("表格区域: "), F.col("table.rows").cast("string"), F.lit("行 x "), F.col("table.cols").cast("string"), F.lit("列")), none, F.lit(0.9), box(F.col("table")), F.lit(True))
    failed = element(F.lit("error"), F.concat(F.lit(IMAGE_FAILED), F.col("error")), none, F.lit(0.0), nothing.cast("array<int>"), F.lit(False))
    every = F.when(F.col("error").isNotNull(), F.array(failed)).otherwise(F.array_compact(F.concat(regions, F.array(F.when(F.col("table").isNotNull(), table)))))
    return rows.select("doc_id", F.posexplode(every).alias("element_index", "e")).select(
        "doc_id", "element_index", F.col("e.type").alias("element_type"), F.col("e.text").alias("raw_content"), F.col("e.path").alias("structure_path"), F.col("e.confidence").alias("parser_confidence"), F.col("e.bbox").alias("bbox"), F.col("e.in_table").alias("in_table")
    )


def table_regions(found: DataFrame) -> DataFrame:
    """doc_id, text, confidence of the regions whose text speaks of a table."""
    r = found.select("doc_id", F.explode("regions").alias("r")).select("doc_id", "r.text", F.least(F.greatest(F.col("r.confidence"), F.lit(0.0)), F.lit(1.0)).alias("confidence"))
    words = F.lit(False)
    for w in TABLE_WORDS:
        words = words | F.col("text").contains(w)
    return r.where(words)

