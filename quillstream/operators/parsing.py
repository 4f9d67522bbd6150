"""Parsers: a row a document to a row an element.

Lines are classified by expressions; runs become elements by gaps and islands
over one partitioning by document, which the heading paths reuse.

Rows get a number of their own, ``row_id``, before their lines come apart, and all
that follows goes by it: rows that share a doc_id, or have none, stay apart. A
null text is empty; an empty one has no elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.text import named, strip, strip_end

HEADING = r"^(#{1,6})\s+(.+)$"
LIST_ITEM = r"^(\s*)([*+-]|[0-9]+\.)\s+(.*)"
TABLE_ROW = r"^\|(.*?)\|\s*$"
NUMBERED = r"^([0-9]+\.[0-9]*)\s+(.+)$"
HAN = r"[\x{4e00}-\x{9fa5}]"
# Words of chapter titles; confidences by element type.
CHAPTER_WORDS = ("章节", "部分", "章", "节", "引言", "概述", "总结")
CONFIDENCE = {"heading": 1.0, "code_block": 1.0, "paragraph": 0.95, "list_item": 0.98, "blockquote": 1.0, "table": 0.90}
TABLE_WORDS = ("表", "表格", "统计", "数据", "对比", "清单", "明细")


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rstrip: bool = False) -> DataFrame:
    """row_id, doc_id, i, line: row_id tells rows apart whatever their ids."""
    whole = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = whole.select("row_id", "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("i", "line"))
    return out.withColumn("line", strip_end(F.col("line"))) if rstrip else out


def heading_path(level: Column, title: Column, window) -> Column:
    """Titles of the open headings at each row: of each level the last heading,
    where it came after the last one of every smaller level."""
    marks = [F.last(F.when(level == k, F.struct(F.col("i").alias("i"), title.alias("t"))), ignorenulls=True).over(window) for k in range(1, 7)]
    parts, latest = [], F.lit(-1)
    for m in marks:
        at = F.coalesce(m["i"], F.lit(-1))
        parts.append(F.when(at > latest, m["t"]))
        latest = F.greatest(latest, at)
    return F.array_compact(F.array(*parts))


def slug(title: Column) -> Column:
    s = F.regexp_replace(F.lower(title), r"(?U)[^\w\s-]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[-\s]+", "-"), "^-+|-+$", "")
    return F.when(s != "", s).otherwise(F.replace(F.lower(title), F.lit(" "), F.lit("-")))


def plain_elements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_id, doc_id, element_index, element_type, raw_content, heading_level, structure_path, parser_confidence."""
    order = Window.partitionBy("row_id").orderBy("i")
    line, title = F.col("line"), F.regexp_extract("line", NUMBERED, 2)
    rows = lines_of(docs, id_col, text_col, rstrip=True).withColumn("next", strip(F.lead("line").over(order))).where(strip(line) != "")
    han = title.rlike(HAN)
    words = F.lit(False)
    for w in CHAPTER_WORDS:
        words = words | title.contains(w)
    is_title = line.rlike(NUMBERED) & ~F.coalesce(F.col("next").rlike(NUMBERED), F.lit(False)) & ~(han & (F.length(title) < 20)) & ((F.length(title) > 20) | (han & (F.length(title) >= 5)) | words)
    hashed = line.rlike(HEADING)
    digits = F.size(F.filter(F.split(F.regexp_extract(line, NUMBERED, 1), r"\."), lambda x: x != ""))
    level = F.when(hashed, F.length(F.regexp_extract(line, HEADING, 1))).when(is_title, F.least(digits, F.lit(6)))
    rows = rows.select(
        "row_id", "doc_id", "i", "line",
        level.cast("int").alias("heading_level"),
        F.when(hashed, F.regexp_extract(line, HEADING, 2)).otherwise(title).alias("title"),
        F.when(level.isNotNull(), "heading").when(strip(line).rlike(LIST_ITEM), "list_item").otherwise("paragraph").alias("element_type"),
        F.when(hashed, 1.0).otherwise(0.95).alias("parser_confidence"),
    )
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(
        "row_id",
        "doc_id",
        (F.row_number().over(order) - 1).alias("element_index"),
        "element_type",
        F.when(F.col("element_type") == "heading", F.col("line")).otherwise(strip(F.col("line"))).alias("raw_content"),
        "heading_level",
        heading_path(F.col("heading_level"), F.col("title"), so_far).alias("structure_path"),
        "parser_confidence",
    )


def with_code(rows: DataFrame) -> DataFrame:
    """Lines (row_id, i, line) with code: the number of the line that opened the closed code
    block a line is in, or null.

    A mark that starts its line opens a block, any mark closes it, and what nothing
    closes is no block. After a mark that does not start its line no block is open,
    so whether one is depends on whether the starting marks since then are odd."""
    order = Window.partitionBy("row_id").orderBy("i")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, -1)
    mark, starts = strip(F.col("line")).startswith("```"), F.col("line").startswith("```")
    rows = rows.withColumns({"__total": F.sum(starts.cast("int")).over(so_far), "__last": F.max(F.when(mark, F.col("i"))).over(Window.partitionBy("row_id"))})
    since = F.coalesce(F.last(F.when(mark & ~starts, F.col("__total")), ignorenulls=True).over(before), F.lit(0))
    rows = rows.withColumn("__open", (F.coalesce(F.lag("__total").over(order), F.lit(0)) - since) % 2 == 1)
    opened = F.last(F.when(starts & ~F.col("__open") & (F.col("i") < F.col("__last")), F.col("i")), ignorenulls=True).over(so_far)
    closed = F.last(F.when(mark & F.col("__open"), F.col("i")), ignorenulls=True).over(before)
    rows = rows.withColumns({"__from": opened, "__to": closed})
    inside = F.col("__from").isNotNull() & (F.col("__to").isNull() | (F.col("__to") < F.col("__from")))
    return rows.withColumn("code", F.when(inside, F.col("__from"))).drop("__total", "__last", "__open", "__from", "__to")


def markdown_elements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_id, doc_id, element_index, element_type, raw_content, heading_level, heading_id, structure_path, parser_confidence."""
    order = Window.partitionBy("row_id").orderBy("i")
    rows, line = lines_of(docs, id_col, text_col), F.col("line")
    rows = with_code(rows)
    at = F.col("code")
    kind = (
        F.when(at.isNotNull(), "code_block").when(strip(line) == "", "blank").when(line.rlike(HEADING), "heading").when(line.startswith("> "), "blockquote")
        .when(line.rlike(LIST_ITEM), "list_item").when(line.rlike(TABLE_ROW), "table").otherwise("paragraph")
    )
    rows = rows.select("row_id", "doc_id", "i", "line", "code", kind.alias("kind"))
    alone = F.col("kind").isin("heading", "list_item", "paragraph")
    fresh = alone | ~F.col("kind").eqNullSafe(F.lag("kind").over(order)) | ~F.col("code").eqNullSafe(F.lag("code").over(order))
    rows = rows.withColumn("run", F.sum(fresh.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("kind <> 'blank'")
    text = F.when(F.col("kind") == "list_item", strip(line)).when(F.col("kind") == "blockquote", F.substring(line, F.lit(3), F.length(line))).otherwise(line)
    runs = rows.groupBy("row_id", "doc_id", "run", "kind").agg(F.min("i").alias("i"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", text.alias("t")))), lambda x: x["t"]), "\n").alias("body"))
    head = F.col("kind") == "heading"
    level, title = F.when(head, F.length(F.regexp_extract("body", HEADING, 1))), F.when(head, F.regexp_extract("body", HEADING, 2))
    confidence = F.lit(None).cast("double")
    for k, v in CONFIDENCE.items():
        confidence = F.when(F.col("kind") == k, v).otherwise(confidence)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    none = F.array().cast("array<string>")
    return runs.select(
        "row_id",
        "doc_id",
        (F.row_number().over(order) - 1).alias("element_index"),
        F.col("kind").alias("element_type"),
        F.when(F.col("kind") == "blockquote", F.concat(F.lit("> "), F.col("body"))).otherwise(F.col("body")).alias("raw_content"),
        level.cast("int").alias("heading_level"),
        F.when(head, slug(title)).alias("heading_id"),
        F.when(head, heading_path(level, title, so_far)).otherwise(none).alias("structure_path"),
        confidence.alias("parser_confidence"),
    )


def whose(elements: DataFrame) -> list[str]:
    """The columns that tell whose elements these are: parsers of one's own may give a doc_id alone."""
    return [c for c in ("row_id", "doc_id") if c in elements.columns]


def merge_headings(elements: DataFrame) -> DataFrame:
    """A heading takes in the deeper headings, list items and paragraphs after it,
    up to another type or a heading of its own or a smaller level."""
    own = whose(elements)
    order = Window.partitionBy(*own).orderBy("element_index")
    kind = F.col("element_type")
    out = elements.withColumn("seg", F.sum(F.when(kind.isin("heading", "list_item", "paragraph"), 0).otherwise(1)).over(order))
    inside = Window.partitionBy(*own, "seg").orderBy("element_index").rowsBetween(Window.unboundedPreceding, -1)
    breaker = ~kind.isin("heading", "list_item", "paragraph")
    lowest = F.coalesce(F.min(F.when(kind == "heading", F.col("heading_level"))).over(inside), F.lit(99))
    starts = (kind == "heading") & (F.col("heading_level") <= lowest)
    alone = breaker | ((kind != "heading") & (lowest == 99))
    out = out.withColumn("new", (starts | alone).cast("int"))
    out = out.withColumn("grp", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = F.array_sort(F.collect_list(F.struct("element_index", "raw_content", "element_type", "heading_level", "structure_path", "parser_confidence")))
    merged = out.groupBy(*own, "grp").agg(parts.alias("p"))
    first, rest = F.col("p")[0], F.transform(F.slice("p", F.lit(2), F.size("p")), lambda x: x["raw_content"])
    text = F.when(F.size("p") > 1, F.concat(first["raw_content"], F.lit("\n\n"), F.array_join(rest, "\n"))).otherwise(first["raw_content"])
    return merged.select(*own, first["element_index"].alias("element_index"), first["element_type"].alias("element_type"), text.alias("raw_content"), first["heading_level"].alias("heading_level"), first["structure_path"].alias("structure_path"), first["parser_confidence"].alias("parser_confidence"))


def boundaries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, position (in characters), kind, level, title of each structural line,
    with the path of the nearest heading at or before it."""
    order = Window.partitionBy("row_id").orderBy("i")
    rows = lines_of(docs, id_col, text_col)
    before = F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("line") - 1
    line = F.col("line")
    kind = F.when(line.rlike(HEADING), "heading").when(line.rlike(r"^(`{3,}|~{3,})"), "code_block").when(line.rlike(r"^(\s*)([*+-]|[0-9]+\.)\s+"), "list").when(line.rlike(r"^\s*\|.*\|\s*$"), "table")
    rows = rows.withColumns({"position": before.cast("int"), "kind": kind})
    level, title = F.when(F.col("kind") == "heading", F.length(F.regexp_extract("line", HEADING, 1))), F.when(F.col("kind") == "heading", F.concat_ws(" ", F.regexp_extract("line", HEADING, 1), F.regexp_extract("line", HEADING, 2)))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("row_id", "doc_id", "position", "kind", level.cast("int").alias("level"), title.alias("title"), heading_path(level, title, so_far).alias("structure_path")).where(F.col("kind").isNotNull())


# Recognised regions of images: region is struct(box array<array<double>>, text, confidence).

def region_boxes(regions: Column) -> Column:
    """Regions as struct(y, x, x1, y1, x2, y2, text, confidence) from top to bottom and left to right."""
    def one(r):
        xs, ys = F.transform(r["box"], lambda p: p[0]), F.transform(r["box"], lambda p: p[1])
        mean = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)
        fields = {"y": F.array_min(ys), "x": mean, "x1": F.array_min(xs).cast("int"), "y1": F.array_min(ys).cast("int"), "x2": F.array_max(xs).cast("int"), "y2": F.array_max(ys).cast("int"), "text": r["text"], "confidence": F.round(F.least(F.greatest(r["confidence"], F.lit(0.0)), F.lit(1.0)), 3)}
        return named(**fields)

    return F.array_sort(F.transform(regions, one))


def region_rows(boxes: Column, gap: float = 20.0) -> Column:
    """Greedy rows of sorted boxes: a box joins the row whose first box's middle is nearer than the gap."""
    kind = "array<struct<y:double,x:double,x1:int,y1:int,x2:int,y2:int,text:string,confidence:double>>"
    zero = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.array().cast(kind).alias("row"))

    def middle(b):
        return (b["y1"] + b["y2"]) / 2

    def step(a, b):
        same = (F.size(a["row"]) > 0) & (F.abs(middle(b) - middle(F.get(a["row"], F.lit(0)))) < gap)
        return named(done=F.when(same | (F.size(a["row"]) == 0), a["done"]).otherwise(F.concat(a["done"], F.array(a["row"]))), row=F.when(same, F.concat(a["row"], F.array(b))).otherwise(F.array(b)))

    return F.aggregate(boxes, zero, step, lambda a: F.when(F.size(a["row"]) > 0, F.concat(a["done"], F.array(a["row"]))).otherwise(a["done"]))


def region_table(boxes: Column) -> Column:
    """struct(x1, y1, x2, y2, rows, cols, cells) of the table in sorted boxes, or null."""
    rows = F.filter(region_rows(boxes), lambda r: F.size(r) >= 2)
    cells = F.flatten(rows)
    least, most = (lambda k: F.array_min(F.transform(cells, lambda c: c[k]))), (lambda k: F.array_max(F.transform(cells, lambda c: c[k])))
    box = named(x1=least("x1"), y1=least("y1"), x2=most("x2"), y2=most("y2"), rows=F.size(rows), cols=F.array_max(F.transform(rows, F.size)), cells=F.size(cells))
    return F.when((F.size(boxes) >= 4) & (F.size(rows) >= 2), box)


def inside(box: Column, table: Column) -> Column:
    return F.coalesce((box["x1"] >= table["x1"]) & (box["y1"] >= table["y1"]) & (box["x2"] <= table["x2"]) & (box["y2"] <= table["y2"]), F.lit(False))


def region_title(text: Column) -> Column:
    t = strip(text)
    return t.rlike(rf"^[0-9]+[\.0-9]*\s*{HAN}") | t.rlike(r"^第[0-9一二三四五六七八九十]+[章节部分]") | ((F.length(t) <= 20) & t.rlike(rf"(?U)^[\w\x{{4e00}}-\x{{9fa5}}]+[.\s]*{HAN}+$"))
