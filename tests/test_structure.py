"""Boundaries, structured elements, images, envelopes and completions against plain Python."""

import json
import random
import re
import time

from pyspark.sql import functions as F

from quillstream.functions import answer, text
from quillstream.operators import completion, parsing, structure
from quillstream.plans import ingest


MARKDOWN, GENERIC = ("heading", "code_block", "list", "table"), ("paragraph", "list", "section", "custom")


def texts():
    rng = random.Random(9)
    bits = ["# Head", "## Sub one", "### Deep", "word", "- item", "  * inner", "1. first", "", "", "   ", "| a | b |", "```", "    indented", "\ttab", "#nothead", "| broken", "~~~~ x"]
    return ["\n".join(rng.choice(bits) for _ in range(rng.randrange(0, 12))) for _ in range(250)] + ["", "\n", "\n\n", "\n\n\nx", "x\n\n", "x\n \n"]


def markdown(text):
    out = [(m.start(), 0, "heading", len(m[1]), m[2]) for m in re.finditer(r"^(#{1,6})[ ]+(.+)$", text, re.M)]
    out += [(m.start(), 1, "code_block", None, None) for m in re.finditer(r"^(`{3,}|~{3,})", text, re.M)]
    out += [(m.start(), 2, "list", None, None) for m in re.finditer(r"^(\s*)([*+-]|\d+\.)[ ]+", text, re.M)]
    out += [(m.start(), 3, "table", None, None) for m in re.finditer(r"^\s*\|.*\|[ ]*$", text, re.M)]
    return sorted(out, key=lambda b: b[:2])


def generic(text):
    out = [(m.end(), 0, "paragraph") for m in re.finditer(r"\n\s*\n", text)]
    out += [(m.start(), 1, "list") for m in re.finditer(r"^(\s*)([*+-]|\d+\.)[ ]+", text, re.M)]
    out += [(m.start(), 2, "section") for m in re.finditer(r"^( {2,}|\t+)", text, re.M)]
    out += [(m.end(), 3, "custom") for m in re.finditer(r"\n", text)]
    return sorted(out)


def test_boundaries_are_the_patterns(spark):
    every = texts()
    df = spark.createDataFrame(list(enumerate(every)), "doc_id int, text string")
    got = {}
    for kind in ("md", "txt"):
        for r in structure.boundaries(df, kind).collect():
            got.setdefault((kind, r["doc_id"]), []).append((r["position"], r["kind"], r["level"], r["title"]))
    key = lambda b: (b[0], [*MARKDOWN, *GENERIC].index(b[1]))
    for i, text in enumerate(every):
        assert sorted(got.get(("md", i), []), key=key) == [(p, k, n, t) for p, _, k, n, t in markdown(text)]
        assert [b[:2] for b in sorted(got.get(("txt", i), []), key=key)] == [(p, k) for p, _, k in generic(text)]


def guess(content):
    if "```" in content or "\n    " in content or "\n\t" in content:
        return "code_block"
    if sum(x.strip().startswith("|") for x in content.split("\n")) > 1:
        return "table"
    return "list_item" if re.search(r"^\s*[*+-]\s+|^\s*\d+\.\s+", content, re.M) else "paragraph"


def test_structured_elements_are_slices(spark):
    every = texts()
    df = spark.createDataFrame([*enumerate(every), (-1, None)], "doc_id int, text string")
    got = {}
    for r in structure.structured_elements(df).orderBy("doc_id", "element_index").collect():
        got.setdefault(r["doc_id"], []).append((r["element_type"], r["raw_content"], r["structure_path"], r["parser_confidence"]))
    assert got[-1] == [("paragraph", "", [], 1.0)]
    for i, text in enumerate(every):
        bounds, want, start, open_, heads = markdown(text), [], 0, [], []
        for p, _, kind, level, title in bounds:
            if kind == "heading":
                open_ = [*open_[: level - 1], "#" * level + " " + title]
                heads.append((p, open_))
        near = lambda at: next((path for p, path in reversed(heads) if p <= at), [])  # noqa: B023, E731
        for p, _, kind, _, _ in bounds:
            if p > start and text[start:p].strip():
                want.append((guess(text[start:p]), text[start:p], near(start), 0.9))
            start = p
            if kind == "heading":
                start = p + len(text[p:].split("\n")[0])
                want.append(("heading", text[p:start], [], 1.0))
        if not bounds:
            want.append(("paragraph", text, [], 1.0))
        elif text[start:].strip():
            want.append(("paragraph", text[start:], near(start), 0.9))
        assert got.get(i, []) == want


def test_generic_elements_are_lines(spark):
    every = texts()
    got = {}
    for r in structure.structured_elements(spark.createDataFrame(list(enumerate(every)), "doc_id int, text string"), "txt").orderBy("doc_id", "element_index").collect():
        got.setdefault(r["doc_id"], []).append((r["element_type"], r["raw_content"], r["parser_confidence"]))
    for i, text in enumerate(every):
        bounds, want, start = generic(text), [], 0
        for p, _, _ in bounds:
            if p > start and text[start:p].strip():
                want.append((guess(text[start:p]), text[start:p], 0.9))
            start = p
        if not bounds:
            want.append(("paragraph", text, 1.0))
        elif text[start:].strip():
            want.append(("paragraph", text[start:], 0.9))
        assert got.get(i, []) == want


def test_rows_that_share_an_id_stay_apart(spark):
    """Repeated rows, null ids and columns with the names that parsers use."""
    rows = [(1, "# A\na1\n- a2"), (1, "# B\nb1\n- b2"), (None, "# C\nc1"), (None, "# D\nd1"), (1, "# B\nb1\n- b2"), (2, None), (3, "")]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id int, text string, i int, line int, row_id int")
    for parse, join in ((structure.structured_elements, ""), (parsing.plain_elements, "\n"), (parsing.markdown_elements, "\n")):
        e = parse(df)
        whole = [(r["doc_id"], r["t"]) for r in e.groupBy("row_id", "doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("element_index", "raw_content"))), lambda x: x["raw_content"]), join).alias("t")).collect()]
        assert sorted(whole, key=repr) == sorted(((i, t or "") for i, t in rows if t or parse is structure.structured_elements), key=repr)
    merged = parsing.merge_headings(parsing.markdown_elements(df)).collect()
    assert sorted(r["raw_content"] for r in merged) == ["# A\n\na1\n- a2", "# B\n\nb1\n- b2", "# B\n\nb1\n- b2", "# C\n\nc1", "# D\n\nd1"]
    chunks = ingest.chunks(df).collect()
    assert sorted((str(r["doc_id"]), r["chunk_index"]) for r in chunks) == sorted([("1", 0)] * 3 + [("None", 0)] * 2)
    bounds = parsing.boundaries(df).where("kind = 'heading'").collect()
    assert [r["position"] for r in bounds] == [0] * 5


def test_code_blocks_are_a_fold(spark):
    rng = random.Random(4)
    every = ["\n".join(rng.choice(["```", "```py", "  ```", "text", "", "# h"]) for _ in range(rng.randrange(0, 14))) for _ in range(300)]
    got = {}
    for r in parsing.with_code(parsing.lines_of(spark.createDataFrame(list(enumerate(every)), "doc_id int, text string"))).collect():
        got[r["doc_id"], r["i"]] = r["code"]
    for i, text in enumerate(every):
        lines, open_, code = text.split("\n"), None, {}
        marks = [n for n, x in enumerate(lines) if x.strip().startswith("```")]
        for n in marks:
            if open_ is not None:
                code |= dict.fromkeys(range(open_, n + 1), open_)
                open_ = None
            elif lines[n].startswith("```") and n < marks[-1]:
                open_ = n
        assert [got[i, n] for n in range(len(lines))] == [code.get(n) for n in range(len(lines))]


def test_long_documents_take_linear_time(spark):
    """100,000 lines of one document, and ten times as many take not much more than ten times as long."""
    bits = ["# Head", "## Sub", "word and word", "- item", "", "| a | b |", "    indented"]
    took = []
    for n in (10_000, 100_000):
        df = spark.createDataFrame([(1, "\n".join(bits[(i * i + i // 7) % 7] for i in range(n)))], "doc_id int, text string")
        started = time.perf_counter()
        assert structure.structured_elements(df).agg(F.count("*")).first()[0] > n / 2
        assert structure.boundaries(df, "txt").agg(F.count("*")).first()[0] >= n - 1
        took.append(time.perf_counter() - started)
    assert took[1] < 30 * max(took[0], 1.0), took


def test_chunks_by_structure_are_numbered(spark):
    df = spark.createDataFrame([(1, "# A\n" + "A long sentence stands here. " * 60), (2, "x")], "doc_id int, text string")
    rows = structure.chunked_by_structure(df).orderBy("doc_id", "chunk_index").collect()
    assert [r["chunk_index"] for r in rows if r["doc_id"] == 1] == list(range(sum(r["doc_id"] == 1 for r in rows)))
    assert rows[0]["chunk_type"] == "heading" and rows[2]["text"].startswith(rows[1]["text"][-50:]) and rows[-1]["text"] == "x"
    assert structure.detector("md") is structure.markdown_boundaries and structure.detector("pdf") is structure.generic_boundaries


def test_envelopes_come_back(spark):
    df = spark.createDataFrame([("d", 0, "a", None, "text"), ("d", 1, "b", ["x"], "code"), ("e", 0, "c", None, "odd")], "doc_id string, chunk_index int, text string, structure_path array<string>, chunk_type string").withColumn("team_id", F.lit("t"))
    out = structure.envelope(df, "team_id")
    j = {r["doc_id"]: json.loads(r["json"]) for r in out.collect()}
    assert j["d"] == {"document_id": "d", "team_id": "t", "chunks": [{"text": "a", "chunk_index": 0, "chunk_type": "text"}, {"text": "b", "chunk_index": 1, "structure_path": ["x"], "chunk_type": "code"}]}
    assert sorted((r["document_id"], r["chunk_index"], r["text"], r["chunk_type"]) for r in structure.from_envelope(out).collect()) == [("d", 0, "a", "text"), ("d", 1, "b", "code"), ("e", 0, "c", "text")]


def reader():
    def read(content):
        if content == b"bad":
            raise ValueError("not an image")
        box = lambda x, y: [[x, y], [x + 40, y], [x + 40, y + 20], [x, y + 20]]
        cells = [(box(x, y), f"{x}{y}", 0.5) for y in (200, 240) for x in (10, 100)]
        return [(box(10, 10), "1. 引言", 1.7), (box(10, 50), "1.2 概述", 0.98765), (box(10, 90), "text", -1.0), *cells, (box(10, 400), "2. 总结", 0.9)] if content == b"page" else []

    return read


def test_images_become_elements(spark):
    images = spark.createDataFrame([(1, bytearray(b"page")), (2, bytearray(b"bad")), (3, bytearray(b"none"))], "doc_id int, content binary")
    rows = structure.image_elements(structure.recognised(images, reader)).orderBy("doc_id", "element_index").collect()
    assert [(r["element_type"], r["raw_content"], r["structure_path"], r["parser_confidence"], r["in_table"]) for r in rows if r["doc_id"] == 1] == [
        ("heading", "1. 引言", ["1. 引言"], 1.0, False), ("heading", "1.2 概述", ["1. 引言", "1.2 概述"], 0.988, False), ("text_region", "text", ["1. 引言", "1.2 概述"], 0.0, False),
        *[("text_region", f"{x}{y}", ["1. 引言", "1.2 概述"], 0.5, True) for y in (200, 240) for x in (10, 100)],
        ("heading", "2. 总结", ["1. 引言", "2. 总结"], 0.9, False), ("table", "表格区域: 2行 x 2列", [], 0.9, True),
    ]
    assert [(r["doc_id"], r["element_type"], r["raw_content"], r["parser_confidence"]) for r in rows if r["doc_id"] != 1] == [(2, "error", structure.IMAGE_FAILED + "not an image", 0.0)]


def test_failed_calls_get_the_context(spark):
    def make():
        def call(system, user):
            if user == "bad":
                raise RuntimeError("down")
            return f"{system}:{user}"

        return call

    p = spark.createDataFrame([(1, "s", "u", "c" * 3000), (2, "s", "bad", "c" * 3000), (3, None, None, None), (4, "s", "bad", None)], "query_id int, system_prompt string, user_prompt string, context string")
    got = {r["query_id"]: (r["answer"], r["error"]) for r in completion.completed(p, make, F.col("context")).collect()}
    assert got[1] == ("s:u", None) and got[3] == (":", None) and got[2][1] == "down"
    assert got[2][0] == (answer.FAILED[0] + "down" + answer.FAILED[1] + "c" * 3000)[:1200] and got[4][0] == answer.FAILED[0] + "down"
    assert completion.completed(p.select("query_id", "system_prompt", "user_prompt")).count() == 4


def test_white_space_is_trimmed_without_patterns(spark):
    """Every white space at both ends, alone and in runs, as the patterns took it; no pattern looks at each line."""
    ends = ["", *text.SPACES, " \u0085", "  \n", "\r\n ", " x ", " \u3000", "\u3000 "]
    rows = [(a + "b" + m + "c" + z,) for a in ends for m in ("", " ", "  ", " \t", "\t ", "\u0085") for z in ends] + [(None,), ("",), (" ",), ("\n",), ("\u200b",)]
    v, space = F.col("v"), text.SPACE
    df = spark.createDataFrame(rows, "v string").select(
        text.strip(v).eqNullSafe(F.regexp_replace(v, f"^{space}+|{space}+$", "")).alias("a"),
        text.strip_end(v).eqNullSafe(F.regexp_replace(v, f"{space}+$", "")).alias("b"),
        text.collapse(v).eqNullSafe(F.trim(F.regexp_replace(v, f"{space}+", " "))).alias("c"),
    )
    assert df.where("NOT (a AND b AND c)").count() == 0
    plan = spark.createDataFrame(rows, "v string").select(text.strip(v))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan
