"""The operators and the pipeline on tables: against SQL, brute force and odd rows."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from quillstream.llm import decontaminate, html_text, jaccard_join, language, licences, maxscore, packing, pii, queries, token_orc, url_filter
from quillstream.llm.common import stored, words_of
from quillstream.llm.components import components
from tests.helpers import SMALL, check, connection

ODD = [(1, "The same text of words one two three four", "en", "s"), (1, "The same text of words one two three four", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (None, "no id but words here", "en", "s"), (5, "!!! 123", "de", "s"), (6, "word " * 30_000, "en", "s"), (7, "The same text of words one two three four", "fr", "s"), (8, "Ünïcödé ☃ a@b.co", "de", None)]
EXTRA = ("n_hit", "key", "spans", "file", "rank", "cell", "class_id", "shard", "dir", "canonical", "bucket")


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(c) for c in EXTRA})


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "same text of words"), (2, None), (3, ""), (1, "never there at all")], "item_id long, text string")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    check(spark, connection(), queries.QUERIES[name], queries.SQL[name])


def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()


def test_tokens_round_trip(spark):
    tok = token_orc.Encoder(token_orc.vocabulary()).tokenizer
    start, want = 0, {}
    for r in docs(spark):
        ids = [*tok.encode(r["text"], add_special_tokens=False).ids, 0]
        want[r["doc_id"]] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = queries.op2_token_orc(spark, SMALL).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)


def test_token_files_are_pruned(spark, tmp_path):
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    token_orc.write_tokens(d, str(tmp_path / "t"), files=4)
    found = token_orc.lookup(spark, str(tmp_path / "t"), [5, 77])
    assert sorted(r["doc_id"] for r in found.collect()) == [5, 77]
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().executedPlan().toString()


def test_tokens_of_odd_rows(odd, none):
    rows = token_orc.round_trip(odd).collect()
    assert len(rows) == len(ODD) and min(r["n_tokens"] for r in rows) == 1
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in rows)
    assert all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert token_orc.round_trip(none).count() == 0


def test_contamination(spark):
    items = [(str(r["item_id"]), words_of(r["text"])) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = {r["doc_id"]: r for r in queries.op3_decontamination(spark, SMALL).collect()}
    for r in docs(spark):
        words, hit, own = words_of(r["text"]), set(), set()
        grams = {}
        for j in range(len(words) - 9):
            grams.setdefault(tuple(words[j : j + 10]), []).append(j)
        for i, ws in items:
            for k in range(len(ws) - 9):
                for j in grams.get(tuple(ws[k : k + 10]), ()):
                    hit |= set(range(j, j + 10))
                    own.add(i)
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_hit"], g["n_items"], g["items_sha256"], g["contaminated"]) == (len(words), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit))


def test_shards_give_the_same(spark):
    d, b = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    assert sorted(decontaminate.contamination(d, b).collect()) == sorted(decontaminate.contamination(d, b, limit=100).collect())


def test_contamination_of_odd_rows(odd, none, benchmark):
    rows = decontaminate.contamination(odd, benchmark).collect()
    assert len(rows) == len(ODD) and sum(r["contaminated"] for r in rows) == 3
    assert decontaminate.contamination(odd, benchmark.where("false")).where("contaminated").count() == 0
    assert decontaminate.contamination(none, benchmark).count() == 0
    kept = decontaminate.decontaminate(odd, benchmark, coverage=0.9)
    assert kept.count() == len(ODD) and kept.columns == odd.columns and kept.where("text LIKE '%same text of words%'").count() == 0


def brute_links(rows):
    sets, seqs = {}, {}
    for i, t in rows:
        w = jaccard_join.word_list(t)
        seqs[i], sets[i] = tuple(w), {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    links = {i: set() for i in ids}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
                links[a].add(b)
                links[b].add(a)
    return seqs, links


def test_join_is_brute_force(spark):
    base = " ".join(f"w{i}" for i in range(60)).split()
    rng = np.random.default_rng(4)
    rows = []
    for i in range(90):  # one group of near copies of many degrees, one of exact copies, and strangers
        w = list(base)
        for _ in range(int(rng.integers(0, 5))):
            w[int(rng.integers(0, 60))] = f"x{i}_{rng.integers(0, 99)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, "exactly the same few words as all the others") for i in range(40)] + [(200 + i, f"stranger {i} " * 3) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seqs, links = brute_links(rows)
    for block in (512, 16):
        jaccard_join.BLOCK, held = block, jaccard_join.BLOCK
        try:
            got = {r["doc_id"]: r for r in jaccard_join.join(df).collect()}
        finally:
            jaccard_join.BLOCK = held
        for i, _ in rows:
            seen, todo = {i}, [i]
            while todo:
                for b in links[todo.pop()] - seen:
                    seen.add(b)
                    todo.append(b)
            r = got[i]
            assert (r["class_id"], r["n_copies"], r["n_links"], r["n_linked"]) == (min(seen), sum(seqs[b] == seqs[i] for b in links[i]), len({seqs[b] for b in links[i]} - {seqs[i]}), sum(seqs[b] != seqs[i] for b in links[i]))
    assert sorted(r["doc_id"] for r in jaccard_join.keep_one(df).collect()) == sorted({r["class_id"] for r in got.values()})


def test_join_of_odd_rows(odd, none):
    rows = jaccard_join.join(odd).collect()
    assert len(rows) == len(ODD) and {r["class_id"] for r in rows if r["doc_id"] in (1, 7)} == {1}
    kept = jaccard_join.keep_one(odd).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(["1", "2", "3", "None", "5", "6", "8"])
    assert jaccard_join.join(none).count() == 0 and jaccard_join.keep_one(none).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101), (200, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(2, 41), 1), 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pii_of_odd_rows(odd, none):
    rows = pii.personal_data(odd).collect()
    assert len(rows) == len(ODD) and sum(r["n_email"] for r in rows) == 1 and next(r["spans"] for r in rows if r["n_email"]) == "email:10:16"
    assert pii.redact(odd).where("text LIKE '%<EMAIL>'").count() == 1 and pii.redact(odd).columns == odd.columns
    assert pii.personal_data(none).count() == 0


def test_maxscore_of_odd_rows(spark):
    bad = [(0, [1.0, 0.5]), (20, [0.25, -1.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, []), (6, [2.0]), (7, [1.0, 0.5]), (7, [1.0, 0.5])]
    v = maxscore.quantised(spark.createDataFrame(bad, "vec_id long, embedding array<double>"))
    got = [tuple(r) for r in maxscore.top_k(v.where("id % 20 = 0"), v, 20).orderBy("query_id", "rank").collect()]
    assert got[:4] == [(0, 1, 6, 8192), (0, 2, 7, 5120), (0, 3, 7, 5120), (0, 4, 20, -1024)] and len(got) == 8
    assert maxscore.top_k(v.where("false"), v, 20).count() == 0 and maxscore.top_k(v.where("false"), v.where("false"), 20).count() == 0


def test_maxscore_over_shards(spark):
    """Shards, groups and seeds, repeated ids and vectors, columns with clashing names."""
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.integers(-50, 50, 6).tolist()) for i in rng.integers(0, 300, 400)] + [(1000 + i, [7, 7, 7, -7, 0, 1]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<long>").withColumns({c: F.lit(c) for c in ("cell", "asks", "least", "rank", "score", "query_id", "vec_id", "s", "g")})
    got = {}
    for r in maxscore.top_k(df.where("id % 20 = 0"), df, 5, shard=100, group=7, seeds=50).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    for q in {i for i, _ in rows if i % 20 == 0}:
        scores = [(-sum(a * b for a, b in zip(v, w, strict=True)), i) for x, v in rows if x == q for i, w in rows if i != q]
        assert [(i, -s) for s, i in sorted(scores)[:5]] == [got[q][k] for k in range(1, 6)]


def test_url_cases(spark):
    urls = ["http://A.net/x", "http://b.example.net/en/y?q=1", "https://www.example.com/de/", "http://example.com/fr", "ftp://q.org/fr/z", "no scheme", None, "", "http://", "http://net", "http://casino.example.com/en/1.html?utm_source=a", "https://www.casino.example.com/en/1#x", "http://casino-x.example.com/de/2"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("rule", F.lit("x"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, url_filter.listing(pages)).collect()}
    assert got[0] == ("a.net", "/x", "net/", "block") and got[1] == ("b.example.net", "/en/y", "example.net/en/", "allow")
    assert got[2][2:] == ("example.com/de/", "block") and got[3][2:] == (None, "allow") and got[4][2:] == ("org/fr/", "allow")
    assert got[5] == got[6] == got[7] == got[8] == ("", "", None, "allow") and got[9] == ("net", "", None, "allow")
    assert got[10][2:] == got[11][2:] == (None, "block") and got[12][2:] == ("example.com/de/", "block") and len(got) == len(urls)
    assert url_filter.judge(pages, url_filter.listing(pages.where("false"))).where("rule IS NULL AND verdict = 'block'").count() == 0
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(urls)))
    assert {r[0]: r[1:5] for r in con.execute(url_filter.SQL).fetchall()} == got


def test_urls_of_long_lists_and_odd_tables(spark, monkeypatch):
    """The same verdicts when list and filter are too large to be broadcast; long URLs, an empty table, clashing columns."""
    urls = [f"http://{'casino.' if i % 3 else ''}h{i % 40}.example.info/a/{i % 50}" for i in range(600)] + ["http://casino.example.info/" + "x" * 200_000, "http://x.example.info/?" + "&".join(f"p{i}=1" for i in range(5_000)), None, None]
    names = ("host", "path", "verdict", "canonical", "block", "w0", "listed")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({c: F.lit(c) for c in names})
    run = lambda p: sorted(tuple(r) for r in url_filter.judge(p, url_filter.listing(p)).collect())
    first = run(pages)
    assert len(first) == len(urls) and {r[4] for r in first} == {"block", "allow"} and first[600][4] == "block"
    assert run(pages.where("false")) == []
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", 0)
    assert run(pages) == first


def test_url_plan_reads_the_pages_once(spark):
    p = spark.read.parquet(f"{SMALL}/pages.parquet")
    plan = url_filter.judge(p, url_filter.listing(p))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [page_id") == 1 and "Python" not in plan and "Arrow" not in plan


def test_bloom_filter_holds_all_keys(spark):
    keys = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    f = url_filter.bloom(keys, "k", 100)
    assert f.count() == 100 and len(f.columns) == 1 + url_filter.WORDS


def test_html_of_odd_rows(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>Some words that are long enough to be kept here.</p>"), (3, "u", "<article>" + "<p>Sentence of words.</p>" * 3000)], "page_id long, url string, html string")
    got = html_text.extract(pages).collect()
    assert [r["n_chars"] for r in got] == [0, 0, 48, 3000 * 18 + 2999] and html_text.extract(pages.where("false")).count() == 0


def test_html_of_repeated_rows_and_other_columns(spark):
    page = "<nav><a href=x>Menu</a></nav><article><h1>A</h1><p>Some words of the article.</p></article><div>Beside it stands this.</div>"
    pages = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, "v", "bare text")], "page_id long, url string, html string").withColumns({c: F.lit(c) for c in ("text", "n_chars", "label", "h", "a")})
    got = sorted((r["page_id"], r["text"]) for r in html_text.extract(pages, html_text.learn(pages)).collect())
    assert got == [(1, "A\nSome words of the article."), (1, "A\nSome words of the article."), (2, "bare text")]
    assert html_text.learn(pages.where("false")).table == html_text.Classifier().table


def test_html_of_the_table(spark):
    """The articles of the given pages, and labels that only the cut gives."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = queries.op7_html(spark, SMALL).collect()
    assert len(got) == len(pages) and sum(r["n_changed"] for r in got) >= len(got)
    for r in got:
        inside = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        lines = (" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?[bi]>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", inside))
        assert r["text"] == "\n".join(x for x in lines if x) and r["n_chars"] == len(r["text"])


def test_benchmark_rows_without_an_id(spark):
    long, short = " ".join(f"w{i}" for i in range(14)), "just four short words"
    d = spark.createDataFrame([(1, f"before {long} after it all there is more and more of this"), (2, f"x {short} y z and some"), (3, "clean words here")], "doc_id long, text string")
    b = spark.createDataFrame([(None, long), (None, short), ("a", " ".join(long.split()[:10])), (None, None), (None, "")], "item_id string, text string")
    for limit in (5, 200_000):
        got = {r["doc_id"]: r for r in decontaminate.contamination(d, b, limit=limit).collect()}
        assert [(got[i]["n_hit"], got[i]["n_items"], got[i]["contaminated"]) for i in (1, 2, 3)] == [(14, 1, True), (4, 0, True), (0, 0, False)]
        assert got[1]["items_sha256"] == hashlib.sha256(b"a").hexdigest()
        kept = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(d, b, coverage=0.9, limit=limit).collect()}
        assert kept == {1: "before  after it all there is more and more of this", 2: "x  y z and some", 3: "clean words here"}


def test_licences_inherit(spark):
    files = [(1, "Licensed under the MIT License.", "a/LICENSE"), (2, "code", "a/b/x.py"), (3, "code", "a/y.py"), (4, "Licensed under CC BY 4.0.", "a/b/c/COPYING"), (5, "code", "a/b/c/d/z.py"), (6, "code", "q/z.py"), (7, None, None), (8, "code\nLicensed under the Apache License, Version 2.0.\ncode code code", "a/own.py"), (9, "", "top.py")]
    df = spark.createDataFrame(files, "doc_id long, text string, path string").withColumn("license", F.lit(1))
    got = {r["doc_id"]: (r["license"], r["license_from"], r["how"]) for r in licences.scan(df).collect()}
    assert got == {1: ("MIT", None, "own"), 2: ("MIT", "a", "inherited"), 3: ("MIT", "a", "inherited"), 4: ("CC-BY-4.0", None, "own"), 5: ("CC-BY-4.0", "a/b/c", "inherited"), 6: (None, None, "none"), 7: (None, None, "none"), 8: ("Apache-2.0", None, "own"), 9: (None, None, "none")}
    assert licences.scan(df.where("false")).count() == 0


def test_licences_inherit_over_levels(spark):
    rng = random.Random(8)
    texts = dict(licences.full_texts())
    held = {"MIT": "Licensed under the MIT License.", "Apache-2.0": texts["Apache-2.0"], "GPL-2.0": texts["GPL-2.0"], "BSD-3-Clause": texts["BSD-3-Clause"]}
    dirs = ["/".join(rng.choice("abc") for _ in range(rng.randrange(7))) for _ in range(600)]
    # A licence file in some of the directories; there are files with and without licences of their own.
    of = {d: rng.choice(sorted(held)) for d in sorted(set(dirs)) if rng.random() < 0.15}
    files = [(held[n], f"{d}/COPYING" if d else "COPYING", n) for d, n in of.items()]
    for i, d in enumerate(dirs):
        own = "CC-BY-4.0" if rng.random() < 0.1 else None
        files.append(("a word and\nLicensed under CC BY 4.0.\nsome code code code" if own else "some code code code", f"{d}/{i}.py" if d else f"{i}.py", own))
    rows = [(i, t, p) for i, (t, p, _) in enumerate(files)]
    got = {r["doc_id"]: (r["license"], r["license_from"], r["how"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
    levels = set()
    for i, (_, path, own) in enumerate(files):
        parts = path.split("/")[:-1]
        near = next((k for k in range(len(parts), -1, -1) if "/".join(parts[:k]) in of), None)
        if own:
            want = (own, None, "own")
        elif near is None:
            want = (None, None, "none")
        else:
            levels.add(len(parts) - near)
            want = (of["/".join(parts[:near])], "/".join(parts[:near]), "inherited")
        assert got[i] == want
    assert len(got) == len(files) and levels >= {0, 1, 2, 3}


def test_licences_of_a_large_directory(spark, monkeypatch):
    """One directory holds most files: the same answers when its row is broadcast and when it is dealt out."""
    rows = [(1, "Licensed under the MIT License.", "big/LICENSE"), (2, "Licensed under CC BY 4.0.", "b/COPYING")] + [(i, "code", f"big/{i % 3}/{i}.py" if i % 4 else f"b/{i}.py") for i in range(3, 200)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, path string").withColumns({c: F.lit(c) for c in ("dir", "of", "found", "salt", "license")})
    first = sorted(tuple(r) for r in licences.scan(df).collect())
    monkeypatch.setattr(licences, "BROADCAST_BYTES", -1)
    assert sorted(tuple(r) for r in licences.scan(df).collect()) == first and len(first) == len(rows)
    assert {r[4] for r in first if r[1].startswith("big/")} == {"MIT"} and {r[4] for r in first if r[1].startswith("b/")} == {"CC-BY-4.0"}


def test_licence_scores_are_the_cosines(spark):
    """own_license and own_score of a whole table against plain TF-IDF vectors."""
    table = docs(spark)
    words = {w for _, t in licences.TEMPLATES for w in words_of(t)}
    df = {w: sum(w in set(words_of(r["text"])) for r in table) for w in words}
    idf = lambda w: math.log((len(table) + 1) / (df[w] + 1)) + 1 if w in df else math.log(len(table) + 1) + 1
    vector = lambda t: {w: n * idf(w) for w, n in Counter(words_of(t)).items()}
    cosine = lambda a, b: sum(x * b.get(w, 0) for w, x in a.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    templates = [(n, vector(t)) for n, t in licences.TEMPLATES]
    most = max(len(t.split()) for _, t in licences.TEMPLATES)
    got = {r["doc_id"]: r for r in queries.op8_licences(spark, SMALL).collect()}
    found = 0
    for r in table:
        best = {}
        for p in licences.passages(r["text"], most):
            v = vector(p)
            for n, t in templates if v else ():
                if (c := cosine(v, t)) >= (0.9 if n == licences.RESERVED else 0.6):
                    best[n] = max(best.get(n, 0), c)
        if len(best) > 1:
            best.pop(licences.RESERVED, None)
        g = got[r["doc_id"]]
        assert (g["own_license"] is None) == (not best)
        if best:
            found += 1
            assert abs(g["own_score"] - max(best.values())) < 1e-9 and best[g["own_license"]] >= g["own_score"] - 1e-9
    assert found


def test_licence_lines_of_the_table(spark):
    got = {r["doc_id"]: r["own_license"] for r in queries.op8_licences(spark, SMALL).collect()}
    for r in docs(spark):
        for line, name in (("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("General Public License, version 3.", "GPL-3.0")):
            if line in r["text"]:
                assert got[r["doc_id"]] == name


def test_packing_keeps_every_token(spark, odd, none):
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    sized = packing.token_counts(d)
    got = packing.pack(sized, shard=30).collect()
    want = {r["doc_id"]: r["n_tokens"] for r in sized.collect()}
    by_doc, by_bin = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_bin.setdefault(r["bin_id"], []).append(r)
    for i, n in want.items():
        p = sorted(by_doc[i])
        assert [s for s, _ in p] == np.cumsum([0, *(x for _, x in p)])[:-1].tolist() and sum(x for _, x in p) == n
    for rows in by_bin.values():
        assert sum(r["length"] for r in rows) == rows[0]["bin_tokens"] <= rows[0]["bin_length"] and rows[0]["bin_length"] in packing.LENGTHS
        at = sorted((r["bin_offset"], r["length"]) for r in rows)
        assert [o for o, _ in at] == np.cumsum([0, *(n for _, n in at)])[:-1].tolist()
    assert packing.pack(packing.token_counts(odd)).where("piece = 0").count() == len(ODD)
    assert packing.pack(packing.character_counts(none)).count() == 0


def test_packing_does_not_depend_on_storage(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet").withColumns({c: F.lit(c) for c in ("piece", "start", "length", "bin_id", "shard")})
    places = lambda docs: sorted(tuple(r) for r in packing.pack(packing.token_counts(docs), shard=40).collect())
    assert places(d) == places(d.repartition(7, "text")) == places(d.coalesce(1).orderBy(F.desc("doc_id")))


def test_language_is_brute_force(spark):
    """Every prediction against sizes of plain compression with the learned dictionaries."""
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.learn(d)
    fs = {}
    for lang, data in model.dictionaries.items():
        held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        fs[lang] = zstandard.ZstdCompressor(dict_data=held, compression_params=zstandard.ZstdCompressionParameters(**language.SEARCH))
    text = {r["doc_id"]: r["text"] for r in d.collect()}
    learned = {r["lang"] for r in d.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    assert set(fs) == learned
    for r in language.identify(d, model).collect():
        letters = "".join(c if ("a" <= c <= "z" or ord(c) >= 0x80) else " " for c in text[r["doc_id"]].lower())
        data = b" ".join(letters.encode().split())
        sizes = sorted((sum(len(f.compress(data[i : i + language.PIECE])) for i in range(0, len(data), language.PIECE)), lang) for lang, f in fs.items())
        if sizes[0][0] < sizes[1][0]:
            assert r["lang_pred"] == sizes[0][1] and r["rejected"] == ((sizes[1][0] - sizes[0][0]) / sizes[1][0] < language.MARGIN)
        else:
            assert r["lang_pred"] in {lang for n, lang in sizes if n == sizes[0][0]}


def planted(spark):
    """Documents of the table with near copies around the threshold, that a plain comparison sorts out."""
    rng = random.Random(21)
    rows = [(r["doc_id"], r["text"]) for r in docs(spark)]
    long = [t for _, t in rows if 60 < len(t.split()) < 400][:40]
    for k, t in enumerate(long):
        words = t.split()
        for n in (1, 2, 3, 4, 6):
            w = list(words)
            for _ in range(n * len(w) // 60 + 1):
                w[rng.randrange(len(w))] = f"changed{rng.randrange(10**6)}"
            rows.append((10_000 + k * 10 + n, " ".join(w)))
    return rows


def test_join_finds_planted_copies(spark):
    rows = planted(spark)
    _, links = brute_links(rows)
    got = {r["doc_id"]: r for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(bool(x) for x in links.values()) > 60
    for i, found in links.items():
        assert got[i]["n_copies"] + got[i]["n_linked"] == len(found)


def test_language_accuracy(spark):
    got = queries.op10_language(spark, "/root/testdata/sf0.01").collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got) and all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) > 0.96 * len(held)


def test_language_of_odd_rows(odd, none):
    m = language.learn(odd)
    rows = language.identify(odd, m).collect()
    assert len(rows) == len(ODD) and sum(r["lang_pred"] == "und" for r in rows) == 3 and [r["held_out"] for r in rows if r["doc_id"] is None] == [None]
    assert language.identify(none, m).count() == 0 and language.learn(none).dictionaries == {}
    assert language.keep_identified(odd, language.learn(none)).count() == len(ODD) - 3


def test_pipeline(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, n = d.columns, d.count()
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stored(stage(spark, d, SMALL), name)
        assert d.columns == columns
        kept.append(d.count())
    assert n >= kept[0] >= kept[1] >= kept[2] == kept[3] > 0.8 * n
    assert decontaminate.contamination(d, spark.read.parquet(f"{SMALL}/benchmark.parquet")).where("contaminated").count() == 0
    assert jaccard_join.join(d).where("n_links > 0").count() <= 2  # cuts may bring two texts together again
    assert pii.personal_data(d).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    out = corpus_pipeline.run(spark, SMALL)
    assert sorted({r["doc_id"] for r in out.collect()}) == sorted(r["doc_id"] for r in d.select("doc_id").collect())


def test_pipeline_of_odd_rows(spark, odd, none):
    for start in (odd, none):
        d = start
        for name, stage in corpus_pipeline.STAGES:
            d = stored(stage(spark, d, SMALL), name)
        assert d.columns[0] == "doc_id"
