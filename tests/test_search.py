"""The keyword index and pruned nearest neighbours against scoring everything."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstream.operators import keyword_index, keyword_scan, pivots, ranking, vector
from quillstream.operators.keyword_index import KeywordIndex
from quillstream.operators.pivots import PivotIndex


def plain_bm25(queries, docs, k):
    told = {i: set((t or "").split()) for i, t in docs if i is not None and (t or "").split()}
    n = len(told)
    avgdl = sum(map(len, told.values())) / n if n else 1
    df = {}
    for ts in told.values():
        for t in ts:
            df[t] = df.get(t, 0) + 1
    raw = {t: math.log((n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    mean = sum(raw.values()) / len(raw) if raw else 0
    idf = {t: x if x >= 0 else 0.25 * mean for t, x in raw.items()}
    out = []
    for q, text in queries:
        scores = []
        for i, ts in told.items():
            norm = 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(ts) / avgdl))
            both = ts & set(text.split())
            if both:
                scores.append((-round(sum(idf[t] for t in both) * norm, 6), i))
        out += [(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(scores)[:k]) if s < 0]
    return sorted(out)


def close(got, want):
    return [(q, i, r) for q, i, _, r in got] == [(q, i, r) for q, i, _, r in want] and all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want, strict=True))


@pytest.mark.parametrize("seed", range(3))
def test_index_is_brute_force(spark, tmp_path, seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.9))}" for _ in range(400)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))) for i in range(250)] + [(900, None), (901, ""), (None, "w1 w2"), (902, "w1"), (903, "w1")]
    queries = [(q, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))) for q in range(12)] + [(50, "unknown"), (51, "")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "id long, text string, df int, token int")
    index = KeywordIndex.build(df, f"{tmp_path}/index", block=4, shard=40)
    asked = spark.createDataFrame(queries, "query_id long, question string")
    got = sorted(tuple(r) for r in index.search(asked, 5).select("query_id", "id", "score", "rank").collect())
    assert close(got, plain_bm25(queries, docs, 5)) and len(got) > 30


@pytest.mark.parametrize("seed", range(2))
def test_scan_is_brute_force_and_shuffles_no_pairs(spark, monkeypatch, seed):
    """Small cells, rounds and sums: the same hits, of documents in any number of tasks."""
    for name, value in (("GROUP", 3), ("DOCS", 40), ("SUMS", 50), ("DENSE", 0.2)):
        monkeypatch.setattr(keyword_scan, name, value)
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.9))}" for _ in range(400)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))) for i in range(250)] + [(900, None), (901, ""), (None, "w1 w2"), (902, "w1"), (903, "w1")] + [(i, "w1 w2 w3") for i in range(1_000, 1_090)]
    queries = [(q, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))) for q in range(12)] + [(50, "unknown"), (51, ""), (52, "w1 w2 w3")]
    df = spark.createDataFrame(docs, "id long, text string").repartition(3)
    hits = keyword_scan.bm25(spark.createDataFrame(queries, "query_id long, question string"), df, 5, most=20)
    got = sorted(tuple(r) for r in hits.select("query_id", "id", "score", "rank").collect())
    assert close(got, plain_bm25(queries, docs, 5)) and len(got) > 30
    # Before, keyword_index.bm25 shuffled what each query and each document share.
    plan = keyword_index.bm25(df.select(F.col("id").alias("query_id"), F.col("text").alias("question")), df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan


def test_most_blocks_stay_unread(spark, tmp_path):
    """Frequent words are left aside and long documents are not looked at once a few short ones hold the rare words."""
    n = 4_000
    i = F.col("id")
    text = F.concat_ws(" ", F.lit("der die das"), F.concat(F.lit("r"), (i % 400).cast("string")), F.array_join(F.transform(F.sequence(F.lit(1), i % 37 + 1), lambda j: F.concat(F.lit("f"), ((j * 7 + i) % 200).cast("string"))), " "))
    docs = spark.range(n).select("id", text.alias("text"))
    index = KeywordIndex.build(docs, f"{tmp_path}/index", block=32, shard=1_000)
    asked = spark.range(20).select(i.alias("query_id"), F.concat(F.lit("der die das r"), (i * 3).cast("string")).alias("question"))
    work = index.reading(asked, 5).first()
    assert work.blocks_read < work.blocks / 4 and work.candidates < 20 * n / 50
    got = sorted(tuple(r) for r in index.search(asked, 5).collect())
    assert got == sorted(tuple(r) for r in ranking.bm25(asked, docs, 5).collect()) and len(got) == 100


def test_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], "id long, text string")
    index = KeywordIndex.build(none, f"{tmp_path}/index")
    assert index.search(spark.createDataFrame([(1, "w1")], "query_id long, question string")).count() == 0
    assert keyword_index.bm25(none.select(F.col("id").alias("query_id"), F.col("text").alias("question")), spark.createDataFrame([(1, "w1")], "id long, text string")).count() == 0


# ---------------------------------------------------------------- nearest neighbours


def plain_nearest(queries, vectors, k):
    out = []
    for q, v, kb in queries:
        near = sorted((round(sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), 9), i) for i, w, other in vectors if other == kb and len(w or ()) == len(v))
        out += [(q, i, r + 1) for r, (_, i) in enumerate(near[:k])]
    return sorted(out)


def clustered(seed, n, clusters=8, width=6):
    rng = random.Random(seed)
    centres = [[rng.uniform(-20, 20) for _ in range(width)] for _ in range(clusters)]
    return [(i, [float(x + rng.gauss(0, 0.5)) for x in rng.choice(centres)], i % 3 // 2) for i in range(n)]


@pytest.mark.parametrize("per", [20, 10_000])
def test_pivots_are_brute_force(spark, tmp_path, per):
    rows = clustered(1, 600) + [(1_000 + i, [1.0] * 6, 0) for i in range(60)] + [(2_000, [1.0, 2.0], 0), (2_001, [1.0, 2.5], 0)]
    odd = [(3_000, None, 0), (3_001, [], 0), (3_002, [float("nan")] * 6, 0), (None, [1.0] * 6, 0), (3_003, [1.0] * 6, None)]
    df = spark.createDataFrame([(i, v, kb, 1) for i, v, kb in rows + odd], "id long, embedding array<double>, kb int, part int")
    index = PivotIndex.build(df, f"{tmp_path}/index", per=per, shard=50)
    asked = [r for r in rows if r[0] % 7 == 0] + [(5_000, [1.0] * 6, 0), (5_001, [100.0] * 6, 1), (5_002, [1.0, 2.0], 0), (5_003, [1.0] * 6, 9)]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<double>, kb int")
    got = sorted((r.query_id, r.id, r.rank) for r in index.nearest(queries, 5).collect())
    assert got == plain_nearest(asked, rows, 5)


def test_most_cells_of_clusters_are_left_out(spark, tmp_path):
    rows = clustered(2, 3_000, clusters=25)
    df = spark.createDataFrame(rows, "id long, embedding array<double>, kb int")
    index = PivotIndex.build(df, f"{tmp_path}/index", per=60)
    seen = index.visited(df.where("id % 50 = 0").withColumnRenamed("id", "query_id"), 8).first()
    assert seen.visited < seen.cells / 4


def test_empty_pivot_index(spark, tmp_path):
    none = spark.createDataFrame([], "id long, embedding array<double>, kb int")
    index = PivotIndex.build(none, f"{tmp_path}/index")
    assert index.nearest(spark.createDataFrame([(1, [1.0], 0)], "query_id long, embedding array<double>, kb int")).count() == 0


def test_searches_work_out_a_bounded_number_of_pairs_at_once(monkeypatch):
    """The same pivots and neighbours, and no matrix larger than is allowed."""
    rng = np.random.default_rng(5)
    v, q = rng.normal(size=(400, 6)), rng.normal(size=(90, 6))
    n = len(v) + 50
    rows = {"cell": [1] * n, "kb": [0] * n, "width": [6] * n, "id": range(n), "v": [*v.tolist(), *v[:50].tolist()], "pivot": [False] * len(v) + [True] * 50}
    table = pa.table({k: list(x) for k, x in rows.items()})
    dealt = lambda: pa.Table.from_batches(list(vector.by_cell(table.to_batches(max_chunksize=70), pivots._to_pivots))).to_pydict()
    asked, plain = [], pivots._distances
    monkeypatch.setattr(pivots, "_distances", lambda a, b: asked.append(len(a) * len(b)) or plain(a, b))
    want, near = dealt(), vector._nearest(q, v, 5)
    monkeypatch.setattr(vector, "PAIRS", 1_000)
    asked.clear()
    got = vector._nearest(q, v, 5)
    assert dealt() == want and len(asked) == 20 and max(asked) <= 1_000
    assert all((a == b).all() for x, y in zip(got, near, strict=True) for a, b in zip(x, y, strict=True)) and len(got[0]) == 90
