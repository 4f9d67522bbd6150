"""Chinese words, capture, counts on the way, queues, numbering and Word files against plain versions."""

import io
import itertools
import math
import random
import re
import zipfile
from collections import Counter, defaultdict

import pandas as pd
import pyarrow.fs as pfs
import pytest
from pyspark.sql import functions as F

from quillstream.functions import understanding
from quillstream.operators import keyword_index, segment
from quillstream.plans import capture, derived, metrics, service_queries
from quillstream.sources import numbering, office
from quillstream.sources.stores import clash_free
from quillstream.streaming import queue
from tests.helpers import SMALL

# ---------------------------------------------------------------- Chinese words


def all_cuts(run):
    for marks in itertools.product([0, 1], repeat=len(run) - 1):
        out, start = [], 0
        for i, m in enumerate(marks, 1):
            if m:
                out.append(run[start:i])
                start = i
        yield [*out, run[start:]]


def test_cuts_are_the_likeliest():
    rng = random.Random(8)
    chars = "天地人你我"
    for _ in range(150):
        counts = {"".join(rng.choice(chars) for _ in range(rng.choice([1, 1, 2, 2, 3]))): rng.randrange(1, 50) for _ in range(12)}
        s, run = segment.Segmenter(counts), "".join(rng.choice(chars) for _ in range(rng.randrange(1, 10)))
        price = lambda words: (round(sum(s.cost.get(w, s.unknown if len(w) == 1 else math.inf) for w in words), 6), len(words))  # noqa: B023, E731
        assert price(s.cut(run)) == min(map(price, all_cuts(run))) and "".join(s.cut(run)) == run
    assert segment.Segmenter({}).cut("天地") == ["天", "地"] and segment.Segmenter({"天地": 5}).cut("") == []


def test_long_runs_take_linear_time():
    import time

    s = segment.Segmenter({"天地": 5, "人": 3, "你我人": 2})
    took = []
    for n in (20_000, 200_000):
        started = time.perf_counter()
        assert "".join(s.cut("天地人你我人" * (n // 6))) == "天地人你我人" * (n // 6)
        took.append(time.perf_counter() - started)
    assert took[1] < 25 * max(took[0], 0.05)


def plain_statistics(texts, longest, least):
    n, sides, total = Counter(), defaultdict(Counter), 0
    for run in (r for t in texts for r in re.findall("[一-鿿]+", t or "")):
        total += len(run)
        for i in range(len(run)):
            for k in range(1, min(longest, len(run) - i) + 1):
                g = run[i : i + k]
                n[g] += 1
                sides[g, 0][run[i - 1] if i else "^"] += 1
                sides[g, 1][run[i + k] if i + k < len(run) else "$"] += 1
    entropy = lambda c: -sum(v / sum(c.values()) * math.log(v / sum(c.values())) for v in c.values())
    out = {}
    for g, v in n.items():
        if len(g) == 1 or v >= least:
            cohesion = min(math.log(v * total / (n[g[:k]] * n[g[k:]])) for k in range(1, len(g))) if len(g) > 1 else None
            out[g] = (v, cohesion, min(entropy(sides[g, 0]), entropy(sides[g, 1])))
    return out


def test_statistics_are_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("天地人你我 x。") for _ in range(rng.randrange(30))) for _ in range(80)] + [None, "", "no Chinese", "天"]
    got = {r["gram"]: (r["n"], r["cohesion"], r["branch"]) for r in segment.statistics(spark.createDataFrame([(t, 1) for t in texts], "text string, n int"), 4, 3).collect()}
    want = plain_statistics(texts, 4, 3)
    assert got.keys() == want.keys()
    for g, (n, cohesion, branch) in want.items():
        assert got[g][0] == n and got[g][2] == pytest.approx(branch, abs=1e-9)
        assert (got[g][1] is None and cohesion is None) or got[g][1] == pytest.approx(cohesion, abs=1e-9)


def test_words_of_a_language_are_found(spark):
    """Texts of known words without gaps: most are cut where their words end."""
    rng = random.Random(6)
    words = list({"".join(chr(0x4E00 + rng.randrange(300)) for _ in range(rng.choice([1, 2, 2, 3]))) for _ in range(150)})
    weights = [1 / (i + 3) for i in range(len(words))]
    texts = [rng.choices(words, weights, k=rng.randrange(5, 40)) for _ in range(600)]
    docs = spark.createDataFrame([("".join(t),) for t in texts], "text string")
    cut = docs.select("text", segment.segmenter(segment.lexicon(docs))(F.col("text")).alias("w")).collect()
    ends = lambda ws: set(itertools.accumulate(map(len, ws)))
    truth = {"".join(t): ends(t) for t in texts}
    right = sum(len(ends(r["w"]) & truth[r["text"]]) for r in cut)
    told, wanted = sum(len(r["w"]) for r in cut), sum(len(truth[r["text"]]) for r in cut)
    assert right / told > 0.9 and right / wanted > 0.9


def test_words_of_a_batch_are_handed_on_in_parts(spark):
    """A batch of any number of texts never has all its words in memory."""
    words = segment.segmenter(spark.createDataFrame([("机器", 9), ("学习", 9)], "word string, n long"))
    texts = pd.Series(["机器学习" * 5_000, None, "", "x"] * 60)
    parts = list(words.func(iter([texts])))
    assert max(sum(map(len, p)) for p in parts) <= segment.HELD and len(parts) > 3
    assert [len(w) for p in parts for w in p] == [10_000, 0, 0, 0] * 60
    assert [len(p) for p in segment.pieces(pd.Series(["aaaa", "b", "cc", None]), 2)] == [2, 2] and [len(p) for p in segment.pieces(pd.Series([], dtype=str))] == [0]


def test_runs_that_are_cut_at_once_are_cut_as_alone(monkeypatch):
    """Any lexicons, ties among them, with steps in a table and searched, and with any number of runs that go on alone."""
    rng = random.Random(4)
    for trial in range(200):
        chars = "天地人你我"[: rng.choice([2, 3, 5])]
        counts = {"".join(rng.choice(chars) for _ in range(rng.choice([1, 1, 2, 2, 3, 4, 6]))): rng.choice([1, 2, 4, 8, rng.randrange(1, 50)]) for _ in range(rng.randrange(20))}
        monkeypatch.setattr(segment, "TABLE", rng.choice([0, 1 << 22]))
        monkeypatch.setattr(segment, "FEW", rng.choice([1, 3, 24]))
        s = segment.Segmenter(counts | rng.choice([{}, {"x": 3, "天x": 4}]))
        texts = [rng.choice([None, "", "x", "𠀀天"]) if rng.random() < 0.2 else "".join(rng.choice(chars + rng.choice(["", "x。"])) for _ in range(rng.randrange(40))) for _ in range(rng.randrange(30))]
        assert s.words(texts).to_pylist() == [[w for run in re.findall("[一-鿿]+", t or "") for w in s.cut(run)] for t in texts], (trial, counts)


@pytest.mark.parametrize("kinds", [3, 300, 20_000])
def test_windows_are_what_runs_hold(kinds):
    """Characters and what follows them, counted, of few and of so many characters that a window is no number."""
    rng = random.Random(kinds)
    texts = [None, "", "x", "一", "鿿一x一一"] + ["".join(chr(0x4E00 + rng.randrange(kinds)) if rng.random() < 0.9 else "x" for _ in range(2_000)) for _ in range(20)]
    want = Counter()
    for run in (f"^{r}$" for t in texts for r in re.findall("[一-鿿]+", t or "")):
        want.update(run[i : i + 5] for i in range(len(run) - 1))
    w, n = segment.windows(texts, 4)
    assert len(w) == len(want) and dict(zip(w.to_pylist(), n.tolist(), strict=True)) == want


def test_many_texts_take_a_fraction_of_their_cuts_alone(spark):
    import time

    rng = random.Random(7)
    counts = {"".join(rng.choice("天地人你我他") for _ in range(k)): rng.randrange(5, 500) for k in (1, 2, 3, 4) for _ in range(12)}
    words = segment.segmenter(spark.createDataFrame(list(counts.items()), "word string, n long"))
    s, texts = segment.Segmenter(counts), ["".join(rng.choices("天地人你我他中国。", k=2_000)) for _ in range(300)]
    started = time.perf_counter()
    alone = [[w for run in re.findall("[一-鿿]+", t) for w in s.cut(run)] for t in texts]
    middle = time.perf_counter()
    parts = list(words.func(iter([pd.Series(texts)])))
    assert time.perf_counter() - middle < (middle - started) / 3
    assert [[str(x) for x in w] for p in parts for w in p] == alone


def test_words_are_searched(spark, tmp_path):
    """An index by words finds what holds the word, not what holds its characters by chance."""
    segments = segment.segmenter(spark.createDataFrame([("机器", 9), ("学习", 9), ("器学", 1), ("大", 3)], "word string, n long"))
    tokens = lambda c: understanding.segmented_tokens(c, segments)
    docs = spark.createDataFrame([(1, "机器学习 RAG"), (2, "大机器"), (3, "器学"), (4, None)], "id long, text string")
    index = keyword_index.KeywordIndex.build(docs, f"{tmp_path}/i", tokens=tokens)
    hits = index.search(spark.createDataFrame([(1, "学习"), (2, "器学"), (3, "rag")], "query_id long, question string")).collect()
    assert sorted((r["query_id"], r["id"]) for r in hits) == [(1, 1), (2, 3), (3, 1)]


# ---------------------------------------------------------------- capture and counts


def test_capture_keeps_every_row(spark):
    def never():
        raise OSError("no model")

    rows = [(1, "a b"), (1, "a b"), (None, "bad"), (2, None), (3, ""), (4, "x" * 50_000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, error int")

    def fussy():
        def step(t):
            if t == "bad":
                raise ValueError("bad text")
            return (t or "").split()

        return step

    good, bad = capture.split(capture.captured(df, [("parser", fussy), ("counter", lambda: len)]), "bigint")
    assert sorted((r["doc_id"], r["result"]) for r in good.collect()) == [(1, 2), (1, 2), (2, 0), (3, 0), (4, 1)]
    assert [tuple(r) for r in bad.collect()] == [(None, "parser", "ValueError: bad text")]
    good, bad = capture.split(capture.captured(df, [("embedder", never)]), "bigint")
    assert good.count() == 0 and {r["error"] for r in bad.collect()} == {"OSError: no model"} and bad.count() == 6
    good, bad = capture.split(capture.captured(df, [("odd", lambda: lambda t: {1, 2})]), "bigint")
    assert bad.count() == 6 and bad.first()["step"] == "result"


def test_counts_are_taken_on_the_way(spark, tmp_path):
    df, told = metrics.observed(spark.range(100).toDF("id"), "pass", n=F.count(F.lit(1)), odd=F.count_if(F.col("id") % 2 == 1))
    df.write.parquet(f"{tmp_path}/out")
    assert told.get == {"n": 100, "odd": 50}
    plan = service_queries.q.ingest.counted(derived.table(spark, SMALL, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_progress_of_streams_is_told(spark, tmp_path):
    kept = []
    listener = metrics.Progress(kept.append)
    spark.streams.addListener(listener)
    try:
        spark.range(30).coalesce(1).write.parquet(f"{tmp_path}/in")
        s = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").observe("seen", F.count(F.lit(1)).alias("n"))
        s.writeStream.queryName("told").format("noop").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    assert [(p["name"], p["rows"], p["observed"]["seen"]["n"]) for p in kept if p["rows"]] == [("told", 30, 30)]


# ---------------------------------------------------------------- queues


def stream_of(spark, folder):
    return spark.readStream.schema(queue.ROWS).option("maxFilesPerTrigger", 1).parquet(folder)


def put(spark, folder, rows):
    spark.createDataFrame(rows, queue.ROWS).coalesce(1).write.mode("append").parquet(folder)


def drain(stream, folder):
    queue.taken(stream).writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()


def test_queues_outlive_batches_and_restarts(spark, tmp_path):
    service_queries._rocks(spark)
    rng, source, folder = random.Random(1), f"{tmp_path}/in", str(tmp_path)
    waiting, want, place = defaultdict(list), [], Counter()
    n = 0
    for _ in range(5):
        rows = []
        for q in "ab":
            for _ in range(rng.randrange(0, 6)):
                n += 1
                task = (rng.randrange(3), rng.randrange(4), n)
                rows.append((q, n, task[0], task[1], None))
                waiting[q].append((-task[0], task[1], task[2]))
            take = rng.randrange(0, 4)
            rows.append((q, None, None, None, take))
            waiting[q].sort()
            for t in waiting[q][:take]:
                place[q] += 1
                want.append((q, place[q], t[2]))
            del waiting[q][:take]
        put(spark, source, rows)
        drain(stream_of(spark, source), folder)  # each time a new query from the checkpoint
    got = [(r["queue"], r["place"], r["task_id"]) for r in spark.read.parquet(f"{folder}/out").collect()]
    assert sorted(got) == sorted(want) and len(got) > 5


def test_tasks_that_wait_too_long_expire(spark, tmp_path):
    """Timers fire while a stream goes on, also without new rows."""
    service_queries._rocks(spark)
    source, folder = f"{tmp_path}/in", str(tmp_path)
    put(spark, source, [("a", 1, 1, 1, None), ("a", 2, 5, 2, None), ("a", None, None, None, 1)])
    out = queue.taken(stream_of(spark, source), patience_ms=1_000)
    run = out.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(processingTime="1 second").start()
    try:
        for _ in range(40):
            run.awaitTermination(1)
            done = (tmp_path / "out").exists() and spark.read.schema(queue.OUT).parquet(f"{folder}/out").count() == 2
            if done:
                break
    finally:
        run.stop()
    got = [(r["queue"], r["place"], r["task_id"], r["status"]) for r in spark.read.schema(queue.OUT).parquet(f"{folder}/out").collect()]
    assert sorted(got) == [("a", 1, 2, "taken"), ("a", 2, 1, "expired")]


def test_tables_of_queues_are_plain_heaps(spark, tmp_path):
    """Random micro-batches, each of them run twice: tasks alike, null queues and priorities, requests
    beyond what waits, tables that are written together every third time and deleted."""
    rng, path = random.Random(4), str(tmp_path)
    waiting, want, place = defaultdict(list), [], Counter()
    for number in range(8):
        rows = []
        for q in ("a", "b", None):
            for _ in range(rng.randrange(0, 7)):
                p, t = rng.choice([None, 0, 1, 2]), rng.randrange(9)
                rows.append((q, t, p, t % 4, None))
                waiting[q].append((9 if p is None else -p, t % 4, t))
            if number % 3 != 1:
                takes = [rng.randrange(0, 4), rng.choice([None, 2])]
                rows += [(q, None, None, None, n) for n in takes]
                waiting[q].sort()
                n = sum(x or 0 for x in takes)
                for t in waiting[q][:n]:
                    place[q] += 1
                    want.append((q, place[q], t[2], None if t[0] == 9 else -t[0]))
                del waiting[q][:n]
        df = spark.createDataFrame(rows, queue.ROWS).repartition(3)
        for _ in range(2):
            queue.Queues(spark, path, every=3).batch(df, number)
    got = [(r["queue"], r["place"], r["task_id"], r["priority"]) for r in queue.Queues(spark, path).taken().collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) > 20
    assert sorted(x.name for x in (tmp_path / "came").iterdir()) == ["batch=6", "batch=7"] and [x.name for x in (tmp_path / "base").iterdir()] == ["batch=5"]


def test_a_long_queue_is_many_tasks_work(spark, tmp_path):
    """One queue: its tasks are written once, and they leave by ranges of its order."""
    source, queues = f"{tmp_path}/in", queue.Queues(spark, f"{tmp_path}/q")
    run = lambda: queues.follow(stream_of(spark, source), f"{tmp_path}/cp").awaitTermination()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for k in range(3):
            put(spark, source, [("a", i, i % 5, i % 7, None) for i in range(k, 3_000, 3)])
            run()
        for n in (1_000, 5_000):
            put(spark, source, [("a", None, None, None, n)])
            run()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    got = sorted((r["place"], r["task_id"]) for r in queues.taken().collect())
    assert got == list(enumerate(sorted(range(3_000), key=lambda i: (-(i % 5), i % 7, i)), 1))
    assert spark.read.parquet(f"{tmp_path}/q/came").count() == 3_000
    files = spark.read.parquet(f"{tmp_path}/q/taken").groupBy(F.input_file_name()).count().collect()
    assert len(files) > 4 and max(r["count"] for r in files) < 1_500


def test_tasks_that_come_do_not_read_the_state():
    class State:
        def __init__(self):
            self.held = []

        def appendList(self, rows):
            self.held += rows

    one = queue.PriorityQueue()
    one.waiting = State()
    came = pd.DataFrame({"task_id": [1, 2], "priority": [1, 1], "submitted": [1, 2], "take": [None, None]})
    assert not list(one.handleInputRows(("a",), iter([came]), None)) and [t[2] for t in one.waiting.held] == [1, 2]


# ---------------------------------------------------------------- numbering


def test_numbers_are_dense_and_in_order(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(5), rng.choice("xyz"), i) for i in range(400)] + [(3, "x", -1)] * 30
    df = spark.createDataFrame(rows, "by int, name string, place int").repartition(5)
    got = numbering.numbered(df.drop("place"), "by", "name").collect()
    assert [r["place"] for r in sorted(got, key=lambda r: r["place"])] == list(range(1, len(rows) + 1))
    in_order = [(r["by"], r["name"]) for r in sorted(got, key=lambda r: r["place"])]
    assert in_order == sorted(in_order)
    assert numbering.numbered(df.drop("place").limit(0), "by", "name").count() == 0
    plan = numbering.numbered(df.drop("place"), "by", "name")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_ranks_inside_hot_values(spark):
    """A third of all rows have one value: it lies in many ranges, and is ranked through."""
    rng = random.Random(3)
    rows = [(None if i % 11 == 0 else "hot" if i % 3 == 0 else f"v{i % 7}", rng.randrange(50), i) for i in range(2_000)]
    df = spark.createDataFrame(rows, "v string, at int, place int").repartition(6)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = numbering.ranked(df, ["v"], ["at", "place"]).drop("at").toDF("v", "id", "place").collect()
        parts = numbering._ranged(df, "v", "at").where("v = 'hot'").select("__part").distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = {}
    for v, at, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        want.setdefault(v, []).append(i)
    assert {(r["v"], r["id"]): r["place"] for r in got} == {(v, i): n for v, ids in want.items() for n, i in enumerate(ids, 1)} and parts > 1


def test_names_of_one_family_need_no_group(spark):
    """Families of one name are numbered; only those whose names differ go through Python."""
    df = spark.createDataFrame([(g, i, n) for g in (1, None) for i, n in enumerate(["a.txt"] * 40 + ["b.txt", "b_1.txt", "b.txt"])], "group_id long, i int, name string")
    got = {(r["group_id"], r["i"]): r["stored"] for r in clash_free(df).collect()}
    for g in (1, None):
        assert [got[g, i] for i in range(40)] == ["a.txt", *[f"a_{n}.txt" for n in range(1, 40)]]
        assert [got[g, i] for i in range(40, 43)] == ["b.txt", "b_1.txt", "b_2.txt"]


# ---------------------------------------------------------------- Word files


def test_word_files_of_every_kind(spark, tmp_path):
    lines = ["Head", "a\tb", "", "x < y & z", "item", "p", "q", "celltext12rest", "end", "字"]
    good = service_queries.docx(lines)
    empty = service_queries.docx([""])
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as z:
        z.writestr("unrelated.txt", "x")
    (tmp_path / "sub").mkdir()
    for name, body in (("good.docx", good), ("sub/UPPER.DOCX", good), ("empty.docx", empty), ("cut.docx", good[:-40]), ("none.docx", b""), ("other.docx", other.getvalue()), ("not.txt", b"x")):
        (tmp_path / name).write_bytes(body)
    office.register(spark)
    rows = spark.read.format("docx").option("path", str(tmp_path)).load().orderBy("path", "element_index").collect()
    by = defaultdict(list)
    for r in rows:
        by[r["path"].rsplit("/", 1)[1]].append((r["element_type"], r["level"], r["raw_content"]))
    want = [("heading", 1, "Head"), ("paragraph", None, "a\tb"), ("paragraph", None, "x < y & z"), ("list_item", None, "item"), ("paragraph", None, "p"), ("paragraph", None, "q"), ("table", None, "| celltext12 | rest |"), ("paragraph", None, "end"), ("heading", 1, "字")]
    assert by["good.docx"] == by["UPPER.DOCX"] == want and "empty.docx" not in by and "not.txt" not in by
    assert {k: v[-1][0] for k, v in by.items() if k in ("cut.docx", "none.docx", "other.docx")} == dict.fromkeys(("cut.docx", "none.docx", "other.docx"), "error")
    (tmp_path / "void").mkdir()
    assert spark.read.format("docx").option("path", str(tmp_path / "void")).load().count() == 0


def test_word_files_are_dealt_by_size():
    reader = office.DocxReader("/x", [(f"/x/{i}.docx", office.PART_BYTES // 3) for i in range(10)])
    assert sorted(p for f in reader.partitions() for p in f.paths) == sorted(p for p, _ in reader.files) and len(reader.partitions()) == 4


def test_packs_of_word_files_are_read_as_files(spark, tmp_path, monkeypatch):
    good = service_queries.docx(["Head", "a", "b"])
    packs = office.Packer(str(tmp_path / "in"), limit=2 * len(good))
    for i in range(5):
        packs.add(f"{i}.docx", good)
    packs.add("cut.docx", good[:-40])
    packs.add("not.txt", b"x")
    packs.close()
    (tmp_path / "in" / "7.docx").write_bytes(good)
    whole = tmp_path / "in" / "pack-00000-00001.tar"
    (tmp_path / "in" / "torn.tar").write_bytes(whole.read_bytes()[: 512 + len(good) // 2])
    assert len(list((tmp_path / "in").iterdir())) == 5
    office.register(spark)
    by = defaultdict(list)
    for r in spark.read.format("docx").option("path", str(tmp_path / "in")).load().orderBy("path", "element_index").collect():
        by[r["path"].rsplit("/", 1)[1]].append((r["element_type"], r["raw_content"]))
    want = [("heading", "Head"), ("paragraph", "a"), ("paragraph", "b")]
    assert {k: v for k, v in by.items() if k[0].isdigit()} == {f"{i}.docx": want for i in (0, 1, 2, 3, 4, 7)}
    assert {k: v[-1][0] for k, v in by.items() if not k[0].isdigit()} == {"cut.docx": "error", "torn.tar": "error"}
    # A large file is held on disk, and batches are cut: the same rows.
    monkeypatch.setattr(office, "HELD_BYTES", 10)
    monkeypatch.setattr(office, "BATCH_CHARS", 150)
    got = list(office.DocxReader(str(tmp_path), []).read(office.Files([str(whole)])))
    assert len(got) == 3 and sum(x.num_rows for x in got) == 6


def test_documents_become_few_files(spark):
    """Not a file a document: as many files as their bytes ask for."""
    path = service_queries.scratch.new_path(spark, "office-test")
    service_queries._docx_folder(derived.table(spark, SMALL, "documents"), path)
    fs, root = office.file_system(path)
    made = fs.get_file_info(pfs.FileSelector(root))
    assert 0 < len(made) <= 8 and all(f.path.endswith(".tar") for f in made)

