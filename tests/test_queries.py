"""Every query of the engine against its SQL, and those without against plain Python."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quillstream.functions import chunk
from quillstream.functions import text as t
from quillstream.operators import segment, structure
from quillstream.plans import derived as d
from quillstream.plans import ingest
from quillstream.plans import more_queries  # noqa: F401
from quillstream.plans import queries as q
from quillstream.plans import service_queries  # noqa: F401
from tests.helpers import SMALL, check, connection


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_sql(spark, con, name):
    check(spark, con, q.QUERIES[name], q.SQL[name])


@pytest.mark.parametrize("name", sorted(q.CASES))
def test_cases(spark, con, name):
    check(spark, con, q.CASES[name], q.CASES_SQL[name])


def plain_chunks(text):
    """(type, chunk) of a document by plain rules: lines, cleaned, headings with what follows them, chunks, overlaps."""
    space = r"[\t-\r \x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
    lines = [re.sub(space + "+$", "", x) for x in text.split("\n")]
    elements = []
    for n, line in enumerate(lines):
        if not re.sub(space, "", line):
            continue
        following = re.sub(f"^{space}+|{space}+$", "", lines[n + 1]) if n + 1 < len(lines) else ""
        m, numbered = re.match(r"(#{1,6})\s+(.+)$", line), re.match(r"([0-9]+\.[0-9]*)\s+(.+)$", line)
        level = None
        if m:
            level = len(m[1])
        elif numbered and not re.match(r"[0-9]+\.[0-9]*\s+.+$", following) and len(numbered[2]) > 20:
            level = min(6, len([x for x in numbered[1].split(".") if x]))
        stripped = re.sub(f"^{space}+", "", line)
        kind = "heading" if level else "list_item" if re.match(r"\s*([*+-]|[0-9]+\.)\s+", stripped) else "paragraph"
        c = re.sub(space + "+", " ", line).strip(" ").translate(str.maketrans(t.WIDE + t.ACCENTED, t.NARROW + t.PLAIN))
        elements.append((kind, level, c.replace("…", "...").translate(str.maketrans(t.CJK_MARKS, t.ASCII_MARKS))))
    merged = []
    for kind, level, c in elements:
        lowest = merged[-1][3] if merged and merged[-1][3] is not None else None
        if lowest is None or (kind == "heading" and level <= lowest):
            merged.append([kind, c, [], level if kind == "heading" else None])
        else:
            merged[-1][2].append(c)
    out = []
    for kind, c, rest, _ in merged:
        whole = c + ("\n\n" + "\n".join(rest) if rest else "")
        parts = paragraph(whole) if kind == "paragraph" else fixed(whole)
        out += [(kind, (parts[i - 1][-50:] if i else "") + p) for i, p in enumerate(parts)]
    return out


def fixed(text, limit=500):
    out, n = [], 0
    for w in text.split():
        if not out or n + len(w) + 1 > limit:
            out.append([])
            n = 0
        out[-1].append(w)
        n += len(w) + 1
    return [" ".join(x) for x in out]


def test_chunk_pipeline_is_plain_rules(spark):
    """The three queries over the ingest plan, and the marked documents, which have headings and lists."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    kinds = {"heading": "heading", "list_item": "list", "paragraph": "text"}
    want = {i: plain_chunks(x) for i, x in docs.items()}
    got = {}
    for r in q.QUERIES["chunk_pipeline"](spark, SMALL).collect():
        got[r["doc_id"], r["chunk_index"]] = (r["chunk_type"], r["digest"])
    assert got == {(i, n): (kinds[k], hashlib.md5(c.encode()).hexdigest()) for i, x in want.items() for n, (k, c) in enumerate(x)}
    hist = {r["chunk_type"]: (r["n"], r["documents"]) for r in q.QUERIES["chunk_type_hist"](spark, SMALL).collect()}
    assert hist == {v: (sum(k == a for x in want.values() for a, _ in x), sum(any(k == a for a, _ in x) for x in want.values())) for k, v in kinds.items() if any(k == a for x in want.values() for a, _ in x)}
    ids = {r["id"]: r["dimension"] for r in q.QUERIES["embed_chunks"](spark, SMALL).collect()}
    assert ids == {f"doc_{i}_chunk_{n}_{hashlib.md5(c.encode()).hexdigest()[:8]}": 32 for i, x in want.items() for n, (_, c) in enumerate(x)}
    marked = d.marked(spark, SMALL)
    for r in ingest.chunks(marked).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_type", "text"))).alias("c")).join(marked, "doc_id").collect():
        assert [(c["chunk_type"], c["text"]) for c in r["c"]] == [(kinds[k], c) for k, c in plain_chunks(r["text"])]


def test_structured_chunks(spark):
    """Chunks by structure against plain rules: each element's type, text, path, overlap and number."""
    kinds = {r["k"]: r["c"] for r in spark.createDataFrame([(k,) for k in ("heading", "paragraph", "list_item", "code_block", "table")], "k string").select("k", chunk.chunk_type(F.col("k")).alias("c")).collect()}
    want = {}
    for r in structure.structured_elements(d.marked(spark, SMALL)).collect():
        kind, body = r["element_type"], r["raw_content"]
        parts = paragraph(body) if kind == "paragraph" else code(body) if kind == "code_block" else table(body) if kind == "table" else fixed(body)
        for i, p in enumerate(parts):
            want[r["doc_id"], r["element_index"], i] = (kind, kinds[kind], (parts[i - 1][-50:] if i else "") + p, tuple(r["structure_path"]), r["parser_confidence"])
    rows = structure.chunked_by_structure(d.marked(spark, SMALL)).collect()
    got = {(r["doc_id"], r["chunk_index"]): (r["element_type"], r["chunk_type"], r["text"], tuple(r["structure_path"]), r["confidence"]) for r in rows}
    number, told = {}, {}
    for key in sorted(want):
        n = number.get(key[0], 0)
        number[key[0]], told[key[0], n] = n + 1, want[key]
    assert got == told and len(rows) == len(got) and {k for k, *_ in got.values()} >= {"heading", "list_item", "paragraph"}
    digests = {(r["doc_id"], r["chunk_index"]): (r["element_type"], r["digest"]) for r in q.QUERIES["chunk_structured"](spark, SMALL).collect()}
    assert digests == {k: (v[0], hashlib.md5(v[2].encode()).hexdigest()) for k, v in told.items()}


def test_han_words_are_the_likeliest_cuts(spark):
    """The words of all documents against plain cuts by the same lexicon; nothing is lost."""
    docs = d.han(spark, SMALL)
    s = segment.Segmenter({r["word"]: r["n"] for r in segment.lexicon(docs).collect()})
    assert s.longest > 1
    got = {r["doc_id"]: (r["n"], r["digest"]) for r in q.QUERIES["han_words"](spark, SMALL).collect()}
    for r in docs.collect():
        words = [w for run in re.findall("[一-鿿]+", r["text"].lower()) for w in s.cut(run)]
        assert got[r["doc_id"]] == (len(words), hashlib.md5(" ".join(words).encode()).hexdigest())


def test_all_queries_without_sql_are_tested_here():
    assert set(q.QUERIES) - set(q.SQL) == {"chunk_pipeline", "chunk_type_hist", "embed_chunks", "chunk_structured", "han_words"}


def sentences(text):
    parts = [p for p in re.split(r"(?<=[.!?。！？])(?=\s|$|[A-ZА-Я])", text) if p]
    if len(parts) > 1 and not re.search(r"[.!?。！？]$", parts[-1]):
        parts[-2:] = [parts[-2] + parts[-1]]
    return [p for p in parts if p.strip()]


def paragraph(text, limit=500):
    if len(text) <= limit:
        return [text]
    out, cur = [], ""
    for s in sentences(text):
        if len(cur) + len(s) <= limit:
            cur += s
            continue
        if cur.strip():
            out.append(cur.strip())
        cur = s
        if len(s) > limit:
            out += [s[i : i + limit] for i in range(0, len(s), limit)]
            cur = ""
    return out + ([cur.strip()] if cur.strip() else [])


def table(text, most=20):
    if not re.search(r"(?m)^\s*\|", text):
        return fixed(text)
    rows = [r for r in text.split("\n") if r.strip()]
    return ["\n".join(rows[i : i + most]) for i in range(0, max(1, len(rows)), most)]


def code(text, limit=2000, most=10):
    lines = text.split("\n")
    if len(text) <= limit or len(lines) <= most:
        return [text]
    out, held, n = [], [], 0
    for line in lines:
        if held and n + len(line) > limit:
            out.append("\n".join(held))
            held, n = [], 0
        held.append(line)
        n += len(line)
    return [*out, "\n".join(held)]


@pytest.mark.parametrize(("column", "plain"), [(chunk.paragraph, paragraph), (chunk.code, code)])
def test_chunkers(spark, column, plain):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for r in docs.select("text", column(F.col("text")).alias("c")).collect():
        assert r["c"] == plain(r["text"])


def test_plans_stay_in_the_engine(spark):
    for name in ("clean_basic", "bm25_topk", "neighbor_expand", "prompt_context", "intent_classify", "chunk_fixed"):
        plan = q.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_filters_reach_the_scan(spark):
    plan = q.QUERIES["where_filter"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(label,3)" in plan


def test_reranking_by_level_and_technique_is_in_its_sql(spark, tmp_path):
    """Hits of one position: those with a decimal, a heading or a source of two parts come first, then those with more techniques."""
    texts = ["alpha one", "alpha version 2.0 one", "# alpha\n### one two", "alpha 3. one", "alpha 2024年 one", "alpha 机器学习 one", "alpha 机器学习 深度学习 one", "alpha one two"]
    docs = [(1500 + 1600 * i, t, "en", s, len(t)) for i, (t, s) in enumerate(zip(texts, ["src1", "src1", "src2", None, "src3", "", None, "a > b > c"], strict=True))]
    docs += [(10 + 1600 * i, f"beta {t}", "en", "1. x" if i % 2 else "src", 9) for i, t in enumerate(texts)] + [(90_000 + i, f"gamma {i} other", "en", "src", 9) for i in range(40)]
    items = [(1, "alpha"), (2, "beta"), (3, "beta 技术"), (4, "alpha 技术 历史"), (5, "alpha beta")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").toPandas().to_parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = sorted(tuple(r) for r in q.QUERIES["rerank_structural"](spark, str(tmp_path)).collect())
    assert len(got) == 40 and got == sorted(con.execute(q.SQL["rerank_structural"]).fetchall())
