"""Order-preserving packing, phrases and fill-in-the-middle against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.llm import fill_middle, order_packing, phrases
from quillstream.llm.fill_middle import Boundaries, arrange, boundaries, plan
from quillstream.llm.order_packing import Marks, Stream, allowed, best_cuts
from quillstream.llm.token_orc import vocabulary

# ---------------------------------------------------------------- order-preserving packing


def plain_cost(places, penalties, width):
    """Least cost of all cuts up to the last place, without a queue."""
    cost = [0]
    for j in range(1, len(places)):
        best = None
        for i in range(j):
            n = places[j] - places[i]
            if n <= width:
                c = cost[i] + (0 if n & (n - 1) == 0 else width - n)
                best = c if best is None or c < best else best
        cost.append(best + penalties[j] + order_packing.OPENING)
    return cost[-1]


def test_cuts_are_the_cheapest():
    rng = random.Random(3)
    for _ in range(500):
        width = rng.choice([4, 8, 16])
        n = rng.randrange(1, 120)
        ends = np.unique([rng.randrange(1, n + 1) for _ in range(rng.randrange(1, 6))] + [n])
        sentences = np.array(sorted({rng.randrange(1, n + 1) for _ in range(rng.randrange(0, 12))}), np.int64)
        places, penalties = allowed(ends, sentences, rng.randrange(1, width + 1))
        assert places[0] == 0 and places[-1] == n and np.diff(places).max(initial=1) <= width
        assert set(ends) | set(sentences) <= set(places[penalties < order_packing.INSIDE]) | {0}
        cuts = best_cuts(places, penalties, width)
        assert cuts[0] == 0 and cuts[-1] == len(places) - 1
        cost = 0
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            m = int(places[j] - places[i])
            assert 0 < m <= width
            cost += (0 if m & (m - 1) == 0 else width - m) + int(penalties[j]) + order_packing.OPENING
        assert cost == plain_cost(places.tolist(), penalties.tolist(), width)


def test_blocks_keep_every_token_in_order():
    marks, rng = Marks(vocabulary()), np.random.default_rng(5)
    for block, wait in ((64, 64), (1 << 20, 1 << 14), (100, 37)):
        docs = [(i, rng.integers(0, 50_000, rng.integers(1, 300)).astype("<u4")) for i in range(40)] + [(40, rng.integers(0, 50_000, 5_000).astype("<u4"))]
        stream, rows = Stream(marks, 7, 32, block, wait), []
        for i, ids in docs:
            for out in stream.add(i, ids):
                rows += zip(*out.values(), strict=True)
        for out in stream.close():
            rows += zip(*out.values(), strict=True)
        whole, at, filled = dict(docs), Counter(), Counter()
        for doc, start, length, crc, tokens, sequence, offset in rows:
            assert start == at[doc] and offset == filled[sequence] and tokens == len(whole[doc])
            assert crc == zlib.crc32(whole[doc][start : start + length].tobytes())
            at[doc] += length
            filled[sequence] += length
        assert at == {i: len(x) for i, x in docs} and max(filled.values()) <= 32
        assert [r[0] for r in rows] == sorted(r[0] for r in rows) and sorted(filled) == list(range(7, 7 + len(filled)))


def test_sentence_ends_are_read_from_ids():
    from tokenizers import Tokenizer

    path = vocabulary()
    tok, marks = Tokenizer.from_file(path), Marks(path)
    for text, want in (("One two. Three 3.5 four! Five", ["One two.", " Three 3.5 four!", " Five"]), ("a\nb", ["a\n", "b"]), ("好。不", ["好。", "不"]), ("", [""]), ("x", ["x"])):
        ids = np.array(tok.encode(text, add_special_tokens=False).ids, np.int64)
        cuts = [0, *marks.sentences(ids).tolist(), len(ids)]
        assert [tok.decode(ids[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)] == want


ODD = [(1, "One. Two! Three? Four. " * 200, "en"), (2, None, "en"), (None, "null id here.", None), (2, "twice", "fr"), (2, "twice", "fr"), (3, "", None), (4, "word " * 5_000, "de"), (5, "a<P>b c d", "en"), (6, "  \t lead and trail \n ", "en")]


def odd(spark):
    """Rows of every kind, with columns whose names the operators use themselves."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    return df.select("*", *[F.lit(1).alias(c) for c in ("key", "copies", "n", "rank", "phrase", "words", "output", "length", "start")])


def test_order_packing_of_odd_rows(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    rows = order_packing.pack(odd(spark), files=2).collect()
    filled = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 1_024
    want = Counter((i, len(tok.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, _ in ODD)
    assert Counter({k: v * k[1] for k, v in want.items()}) == sum((Counter({(r.doc_id, r.doc_tokens): r.length}) for r in rows), Counter())
    assert order_packing.pack(odd(spark).limit(0)).count() == 0


# ---------------------------------------------------------------- phrases


def plain_counts(texts, most):
    out = Counter()
    for t in texts:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            out.update(tuple(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    return out


def plain_mine(rows, most=3, least=10, share=50, best=2_000):
    out = []
    for lang in {x or "und" for _, x in rows}:
        f = plain_counts([t for t, x in rows if (x or "und") == lang], most)
        n = sum(v for k, v in f.items() if len(k) == 1)
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        told = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            told.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]]))
        told.sort()
        out += [(lang, i + 1, p.decode(), a, left, right, n, -s) for i, (s, _, p, a, left, right) in enumerate(told[:best])]
    return sorted(out)


def some_texts(seed, n):
    rng = random.Random(seed)
    words = ["a", "B", "cc", "é", "[x]", "\x00", "of the", "Z\tq", "--"]
    return [("".join(rng.choice(words) + rng.choice([" ", " ", " ", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randrange(60))), rng.choice(["en", None, "fr"])) for _ in range(n)] + [(None, "en"), ("", None)]


def test_automaton_has_the_states_of_all_sequences():
    rng = random.Random(11)
    for _ in range(300):
        texts = [" ".join(rng.choice("abc") + rng.choice(["", "", "."]) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(5))]
        shard = phrases.Shard()
        for t in texts:
            shard.add(t)
        ids = shard.ids()
        ends = {}
        for k in (1, 2, 3):
            for i in range(len(ids) - k + 1):
                if ids[i : i + k].all():
                    ends.setdefault(tuple(ids[i : i + k]), set()).add(i + k)
        classes = {}
        for s, e in ends.items():
            # Of one class: the same end places, and one is the end of the other.
            classes.setdefault((frozenset(e)), []).append(len(s))
        want = sorted((max(v), min(v), len(e)) for e, v in classes.items())
        assert sorted(phrases.Automaton(ids, 3).states()) == want


@pytest.mark.parametrize("most", [2, 3, 4])
def test_phrases_are_brute_force(spark, monkeypatch, most):
    rows = some_texts(most, 300)
    monkeypatch.setattr(phrases, "SHARD", 700)
    df = spark.createDataFrame([(t, x, 1, 2) for t, x in rows], "text string, lang string, n int, phrase int").repartition(3)
    got = sorted(tuple(r) for r in phrases.mine(df, most=most, best=40).collect())
    assert got == plain_mine(rows, most, best=40)


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FILTER_BITS", 64)
    rows = some_texts(9, 200)
    got = sorted(tuple(r) for r in phrases.mine(spark.createDataFrame(rows, "text string, lang string")).collect())
    assert got == plain_mine(rows)


def test_phrases_of_odd_rows(spark):
    got = sorted(tuple(r) for r in phrases.mine(odd(spark)).collect())
    assert got == plain_mine([(t, x) for _, t, x in ODD]) and got
    assert phrases.mine(odd(spark).limit(0)).count() == 0


# ---------------------------------------------------------------- fill in the middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_cut(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    x, y = sorted((a % (len(units) + 1), b % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= 50:
        return doc_id, len(units), "plain", None, None, text
    p, m, s = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    form = "spm" if d % 100 < 80 else "psm"
    return doc_id, len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_boundary_lists():
    rng = random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice(["a", "é", "字", "😀", " ", "\n", "\t", "\x1c", "\xa0"]) for _ in range(rng.randrange(40)))
        want = np.cumsum([len(u) for u in UNIT.findall(text)])
        assert boundaries(text).tolist() == want.tolist()
    for _ in range(200):
        numbers = np.array(sorted(rng.sample(range(1, 10 ** rng.randrange(3, 9)), rng.randrange(1, 300))))
        packed = Boundaries.of(numbers)
        assert len(Boundaries(packed.packed)) == len(numbers)
        assert [Boundaries(packed.packed).select(i) for i in range(len(numbers))] == numbers.tolist()
        # Low bits, one bit a number and at most two gaps of the high bits for each.
        assert len(packed.packed) <= Boundaries.HEAD + 2 + len(numbers) * (np.log2(numbers[-1] / len(numbers)) + 4) / 8
    assert len(Boundaries.of(np.empty(0, np.int64))) == 0


def test_one_document():
    for i in range(300):
        text = "ein  kurzer Text\n mit é und 😀 "[: i % 31]
        doc, n, form, prefix, middle, output = plain_cut(i, text)
        where = Boundaries.of(boundaries(text))
        assert (len(where), *plan(i, text, where)) == (n, form, prefix, middle)
        assert arrange(text, form, prefix, middle) == output


@pytest.mark.parametrize("few", [0, 1_000])
def test_fill_middle_is_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(fill_middle, "SLICE", 3)
    rows = [(i, t) for i, t, _ in ODD] + [(i, "the same text for many <") for i in range(10, 60)] + [(i, f"text {i % 7} of few\n P> ") for i in range(60, 100)] + [(None, "the same text for many <")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("key"), F.lit(2).alias("slices"), F.lit(3).alias("output"), F.lit(4).alias("where"))
    out = fill_middle.fill_middle(df, few=few).withColumn("again", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in out), key=repr) == sorted((plain_cut(*r) for r in rows), key=repr)
    assert sorted((str(r.doc_id), r.again) for r in out) == sorted((str(i), t or "") for i, t in rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fill_middle.fill_middle(df.limit(0)).count() == 0


# ---------------------------------------------------------------- earlier operators


def test_files_are_ordered_by_their_numbers(spark):
    """Beyond 99,999 files names have more digits and another order than numbers."""
    from quillstream.llm.token_orc import file_number

    names = ["file:/x/part-99999-a-c000.snappy.orc", "file:/x/part-100000-a-c000.snappy.orc", "file:/part-7/part-00012-a.orc"]
    got = spark.createDataFrame([(n,) for n in names], "file string").orderBy(file_number(F.col("file"))).collect()
    assert [r["file"] for r in got] == [names[2], names[0], names[1]] and sorted(names[:2]) != names[:2]


def test_a_form_round_the_page_is_its_wrapper():
    from quillstream.llm.html_text import main_text

    body = "".join(f"<p>Sentence number {i} tells something that a reader of this page may want to know, and it ends here.</p>" for i in range(8))
    page = f"<html><body><form id='aspnetForm'><input type='hidden' name='__VIEWSTATE' value='x'><input name='q'><div>{body}</div></form><div id='ft'>Copyright 2020 Someone</div></body></html>"
    text = main_text(page)
    assert text.count("Sentence number") == 8 and "Copyright" not in text
    small = f"<html><body><article>{body}</article><form><p>Sign up for our letter and get news each week.</p><input name='mail'><button>Go</button></form></body></html>"
    assert "Sign up" not in main_text(small) and main_text(small).count("Sentence number") == 8


def test_bins_do_not_depend_on_how_rows_are_stored(spark):
    """Shards follow the number of pieces; storage, batches and partitions change nothing."""
    from quillstream.llm import packing

    rows = [(i, 1 + i * i % 900 + (20_000 if i % 50 == 0 else 0)) for i in range(3_000)]
    seen = []
    for parts, batch in ((1, 1_000), (7, 37)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        df = spark.createDataFrame(rows[:: 1 if parts == 1 else -1], "doc_id long, n_tokens long").repartition(parts)
        seen.append(sorted(tuple(r) for r in packing.pack(df, shard=500).collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert seen[0] == seen[1] and len({r[4] >> 40 for r in seen[0]}) > 5
