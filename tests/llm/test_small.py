"""The operators' cores against plain versions, without Spark."""

import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillstream.llm import html_text, jaccard_join, language, licences, maxscore, packing, pii, token_orc
from quillstream.llm.common import words_of
from quillstream.llm.decontaminate import Automaton, _found, cut


def plain_hits(items, words, window):
    hit, own = set(), set()
    for i, ws in items:
        k = min(window, len(ws))
        wins = {tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)} if k else set()
        for j in range(len(words) - k + 1) if k else ():
            if tuple(words[j : j + k]) in wins:
                hit |= set(range(j, j + k))
                own.add(i)
    return len(words), len(hit), sorted(own)


def test_automaton_is_brute_force():
    rng = random.Random(0)
    for _ in range(800):
        v, window = rng.choice([2, 3, 5]), rng.choice([2, 3, 4])
        items = [(str(i), [bytes([97 + rng.randrange(v)]) for _ in range(rng.randrange(8))]) for i in range(rng.randrange(5))]
        words = [bytes([97 + rng.randrange(v + 1)]) for _ in range(rng.randrange(25))]
        n, spans, own = _found(Automaton(items, window), " ".join(w.decode() for w in words))
        assert (n, sum(b - a for a, b in spans), own) == plain_hits(items, words, window)


def test_words_and_cut():
    assert words_of("Ab-1é X\x7fy") == [b"ab", "1é".encode(), b"x", b"y"] and words_of(None) == words_of("") == []
    assert cut("a b, c d", [(1, 3)]) == "a  d"
    assert cut("The Cat SAT, Éa on MATS.", [(1, 3), (5, 6)]) == "The , Éa on ."


def test_encoder_is_the_librarys():
    enc = token_orc.Encoder(token_orc.vocabulary(), memo=50)
    rng = random.Random(1)
    bits = ["a", "b", " ", "  ", "\n", " \n", "'s", "é", "　", "\x1c", "\x85", "1", "!", "<|endoftext|>", "字", "\t", "᠎", "​", '"', "ab, cd. ef", "x***", "y!!.", "-", "'", "ß%", "|"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(3000)] + [None, ""]
    for lo in range(0, len(texts), 100):
        part = texts[lo : lo + 100]
        for t, got in zip(part, enc.encode(part), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == enc.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_encoder_of_arrow_groups(monkeypatch):
    monkeypatch.setattr(token_orc, "GROUP_BYTES", 40)
    enc = token_orc.Encoder(token_orc.vocabulary(), memo=3)
    texts = ["no", None, "A first.\nThen, a Second\nline é", "", "x\n\ny", "\nlead", "end\n", "tab\tand  two", "naïve\nÉté!\n字 's 'll\n's", "a\rb\r\nc", "<|endoftext|>\n<|endoftext|> x", "long " * 40 + "\nlast"]
    want = [enc.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for column in (pa.array(texts), pa.array(["cut", *texts, "cut"], pa.large_string()).slice(1, len(texts))):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(column)] == want
    assert enc.encode([]) == enc.encode(pa.array([], pa.string())) == []
    rows = [pa.RecordBatch.from_pydict({"text": texts[a : a + 2]}) for a in range(0, len(texts), 2)]
    met = list(token_orc.grouped(iter([*rows, rows[0].slice(0, 0)])))
    assert [t for b in met for t in b.column(0).to_pylist()] == texts and all(b.num_rows for b in met)


def test_encoder_asks_the_library_once_a_word():
    asked = []

    class Spy:
        def __init__(self, inner):
            self.inner, self.model = inner, self

        def tokenize(self, chars):
            asked.append(chars)
            return self.inner.model.tokenize(chars)

        def encode(self, text, **options):
            asked.append(text)
            return self.inner.encode(text, **options)

        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return self.inner.encode_batch_fast(texts, **options)

    enc = token_orc.Encoder(token_orc.vocabulary())
    plain = enc.tokenizer
    enc.tokenizer = Spy(plain)
    words = [f"{a}{b}" for a in ("sol", "wind", "pé", "strom") for b in ("ar", "en", "tion", "ly", "es")]
    texts = [f"{a} {b}.\n{c} {a}, {b}" for a in words for b in words for c in words[:5]]
    got = enc.encode(texts)
    # Each word after a space, and after a line end or at the beginning of a text, and the two marks:
    # sentences that meet at a line end are no words of their own, nor are the texts' first words.
    assert len(asked) <= 2 * len(words) + 2
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in plain.encode_batch_fast(texts, add_special_tokens=False)]


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": pii.IP.pattern, "card": pii.CARD.pattern, "phone": pii.PHONE.pattern}


def plain_pii(text):
    out = []
    for k, p in BASE.items():
        for m in re.finditer(p, text):
            d = re.sub(r"\D", "", m[0])
            if (k == "ip" and any(int(x) > 255 for x in m[0].split("."))) or (k == "card" and not (14 <= len(d) <= 19 and pii.luhn(d))) or (k == "phone" and not 10 <= len(d) <= 15):
                continue
            out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], pii.ORDER[s[2]]))


def test_pii_base_is_the_patterns():
    rng = random.Random(3)
    bits = ["a", "b", "@", ".", "1", "2", "0", "+", " ", "-", "(", ")", "25", "4242 4242 4242 4242", "x@y.z", "+1 (301) 555-0346", "1.2.3.4", "é", "token = ", "@@"]
    for _ in range(8000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(16)))
        assert [s for s in pii.spans(t) if s[2] in pii.BASE] == plain_pii(t)
    assert pii.spans(None) == pii.spans("") == []


def test_pii_added_kinds():
    t = 'token = "ab12cd34ef" at 12 Main Street, see https://bob:pw@h.example.com/x. IBAN DE89 3704 0044 0532 0130 00'
    kinds = [k for *_, k in pii.spans(t)]
    assert {"account", "address", "url"} <= set(kinds) and kinds.count("account") == 2
    assert "ab12cd34ef" not in pii.redacted(t, pii.spans(t))
    assert pii.redacted("x a@b.co y", pii.spans("x a@b.co y")) == "x <EMAIL> y"


def test_pii_reaches_to_the_boundaries():
    kinds = lambda t: {(t[a:b], k) for a, b, k in pii.spans(t) if k not in pii.BASE}
    long = "Annabella-Wilhelmina-Constantia-Philippa-Maximiliana-Theodora-Eleonora"
    assert (f"17 {long} {long} Street", "address") in kinds(f"lives at 17 {long} {long} Street.")
    assert kinds("a 12 Main Street b") == {("12 Main Street", "address")} and kinds("the 12 main street") == kinds("Main Street") == set()
    assert kinds("1234567 Main Street") == {("34567 Main Street", "address")}
    iban = "DE89 3704 0044 0532 0130 00"
    assert kinds(f"{'far from any cue ' * 9}{iban} is it") == {(iban, "account")}
    assert kinds("DE88 3704 0044 0532 0130 00") == kinds("XDE89370400440532013000") == set()


def test_maxscore_is_brute_force(monkeypatch):
    rng = np.random.default_rng(0)
    read = maxscore.Read()
    for _ in range(150):
        n, w = int(rng.integers(1, 200)), int(rng.integers(1, 6))
        v, ids, q = rng.integers(-3, 4, (n, w)) * int(rng.choice([1, 2**27])), rng.permutation(1000)[:n], rng.random(n) < 0.3
        if not q.any():
            continue
        monkeypatch.setattr(maxscore, "BLOCK", int(rng.integers(2, 50)))
        monkeypatch.setattr(maxscore, "TOGETHER", 7)
        monkeypatch.setattr(maxscore, "STEP", int(rng.integers(1, 4)))
        scores = v[q] @ v.T
        want = [[k for k in np.lexsort((ids, -s)) if ids[k] != i][:5] for i, s in zip(ids[q], scores, strict=True)]
        # Thresholds at the k-th score of some of the vectors, and at the k-th of all.
        least = np.array([s[o[-1]] if len(o) == 5 and rng.random() < 0.5 else -np.inf for o, s in zip(want, scores.astype(float), strict=True)])
        for start in (None, least):
            best = maxscore.search(ids[q], v[q], maxscore.Shard(ids, v), 5, start, read)
            for o, s, got_ids, got_scores in zip(want, scores, best.ids, best.scores, strict=True):
                assert ids[o].tolist() == got_ids.tolist() and s[o].tolist() == got_scores.tolist()
    assert read.read < read.postings


def test_maxscore_leaves_postings_and_blocks_unread(monkeypatch):
    rng = np.random.default_rng(1)
    v = np.zeros((8000, 16), np.int64)
    v[:, :2] = rng.integers(0, 100, (8000, 2))
    v[:, 2:] = rng.integers(0, 2, (8000, 14))
    q = np.array([[9, 7] + [1] * 14])
    read = maxscore.Read()
    monkeypatch.setattr(maxscore, "STEP", 2)
    best = maxscore.search(np.array([-1]), q, maxscore.Shard(np.arange(8000), v), 20, None, read)
    want = np.sort((q @ v.T)[0])[::-1][:20]
    assert best.scores[0].tolist() == want.tolist()
    # In blocks after the first the two large terms alone are essential; of the others only candidates' postings are probed.
    assert read.read < 0.3 * read.postings and 0 < read.probed < 0.1 * read.postings
    # From the right threshold on, fewer are read still, and blocks that can't reach it are left out.
    near, far = maxscore.Shard(np.arange(8000), v), maxscore.Shard(np.arange(8000, 16000), v // 50)
    for shard, fewer in ((near, read.read), (far, 1)):
        again = maxscore.Read()
        maxscore.search(np.array([-1]), q, shard, 20, np.array([float(want[-1])]), again)
        assert again.read < fewer and (shard is near or again.visited == 0 < again.blocks)


def test_minimum_cut_is_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randrange(1, 7)
        costs = [rng.randrange(-9, 10) for _ in range(n)]
        edges = [(a, b, rng.randrange(1, 6)) for a in range(n) for b in range(a) if rng.random() < 0.4]
        loss = lambda x: sum(-c if c < 0 and s else c if c > 0 and not s else 0 for c, s in zip(costs, x, strict=True)) + sum(w for a, b, w in edges if x[a] != x[b])  # noqa: B023, E731
        least = min(loss([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert loss(html_text.minimum_cut(costs, edges)) == least


def test_html_cases():
    page = '<html><head><title>t</title></head><body><nav><a href="/">Home</a></nav><header>Site</header><div class="cookie-notice">We use cookies.</div><article><header><h1>A &amp; B</h1></header><p>First  par\nwith <b>bold<br>text.</b></p><form>Subscribe</form><p>Second one is here.</p><aside>Related</aside><section class="comments"><p>Reader says hello there.</p></section></article><footer>&copy; x</footer><script>var a = "<p>no</p>";</script></body></html>'
    assert html_text.main_text(page) == "A & B\nFirst par with bold text.\nSecond one is here."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("<article><p>Open <script>never closed") == "Open"


@pytest.mark.parametrize("tags", ['body class="has-sidebar"|body', 'main class="with-banner"|main', 'div class="overflow-hidden"|div', 'body style="display: none"|body', 'div data-role="banner"|div', 'article class="no-comments"|article', 'div class="page has-sidebar"|div'])
def test_html_names_of_wrappers(tags):
    start, end = tags.split("|")
    text = "The first sentence of a page stands here and is long enough to be kept by the cut."
    assert html_text.main_text(f"<{start}><article><p>{text}</p><p>It ends.</p></article></{end}>") == text + "\nIt ends."


def test_html_what_stays_outside_and_inside():
    p = "<p>Some words that would be long enough to be kept here.</p>"
    for attrs in ("hidden", 'class="hidden"', 'aria-hidden="true"', "style='display:none'", 'role="banner"', 'class="x sidebar"', 'id="footer"'):
        assert html_text.main_text(f"<div {attrs}>{p}</div>") == ""
    page = "<noscript>Turn scripts on.</noscript><article><p>Let <math><mi>x</mi><annotation>x_1</annotation></math> be <object data='a'>a plan</object> and <noscript>a picture</noscript> here.</p></article>"
    assert html_text.main_text(page) == "Let x be a plan and a picture here."


def brute_text(page, classifier):
    """The text of least cost over all labellings of the page's graph; of several the one with least content."""
    blocks, boxes = html_text.parsed(page)
    if not blocks:
        return ""
    g = html_text.graph_of(blocks, boxes, classifier)
    best = None
    for mask in range(1 << len(g.costs)):
        x = [bool(mask >> i & 1) for i in range(len(g.costs))]
        loss = sum(-c if c < 0 and s else c if c > 0 and not s else 0 for c, s in zip(g.costs, x, strict=True)) + sum(w for a, b, w in g.edges if x[a] != x[b])
        if best is None or (loss, sum(x)) < best[:2]:
            best = (loss, sum(x), x)
    return "\n".join(b.text for b, yes in zip(blocks, best[2], strict=False) if yes)


def test_html_is_brute_force():
    rng = random.Random(11)
    texts = ["Short.", "a b", "Some words of a longer sentence that goes on for a while here.", "No mark at the end of this line", "x " * 40 + "."]
    boxes = ["div", "section", 'div class="sidebar"', 'div class="post-related"', "article", "main", "nav", "aside", "ul", 'div class="content"', "form", "header", "footer", 'section class="comments"']
    leaves = ["p", "h2", "li", "td", 'p class="advert"', "div", "pre"]
    changed = 0

    def some(depth):
        out = []
        for _ in range(rng.randrange(1, 3)):
            if depth and rng.random() < 0.5:
                tag = rng.choice(boxes)
                out.append(f"<{tag}>{some(depth - 1)}</{tag.split()[0]}>")
            else:
                tag, text = rng.choice(leaves), rng.choice(texts)
                out.append(f"<{tag}>" + (f"<a href=x>{text}</a>" if rng.random() < 0.3 else text) + f"</{tag.split()[0]}>")
        return "".join(out)

    fitted = html_text.Classifier.fitted({(0, 3, 0, 2): (50, 1), (5, 0, 1, 1): (2, 60), (1, 0, 0, 0): (20, 9)})
    for _ in range(150):
        page = f"<html><body>{some(3)}{some(2)}</body></html>"
        blocks, tree = html_text.parsed(page)
        for c in (html_text.Classifier(), fitted):
            if blocks and len(html_text.graph_of(blocks, tree, c).costs) <= 13:
                assert html_text.main_text(page, c) == brute_text(page, c)
                _, content, alone = html_text.labelled(page, c)
                changed += content != alone
    assert changed > 50


def test_html_what_the_cut_decides():
    long = "The first sentence of a page stands here and is long enough to be kept."
    article = f"<h1>Title</h1><p>{long}</p><p>Yes.</p>"
    want = f"Title\n{long}\nYes."
    # Names that only sound like boilerplate, elements without containers, pages without tags.
    assert html_text.main_text(f'<article>{article}<section class="related-work"><p>{long}</p></section></article>') == f"{want}\n{long}"
    assert html_text.main_text(f'<article>{article}<p class="advert">{long}</p></article>') == want
    assert html_text.main_text("Hello world") == "Hello world" and html_text.main_text("<p>Just this.</p>") == "Just this."
    assert html_text.main_text(f"<div>{long}</div>") == long
    # What lies beside an article, readers' articles, lists of links; forms only where they hold no article.
    assert html_text.main_text(f"<body><div>{long}</div><article>{article}</article><p>{long}</p></body>") == want
    assert html_text.main_text(f'<article>{article}</article><section id="comments"><article><p>{long}</p></article></section>') == want
    assert html_text.main_text(f'<article>{article}<div class="comment-list"><p>{long}</p></div><div class="related-posts"><ul><li><a href="x">{long}</a></ul></div></article>') == want
    assert html_text.main_text(f"<form><article>{article}</article></form>") == want and html_text.main_text(f"<form><p>{long}</p></form>") == ""
    assert html_text.main_text(f"<article>{article}<ul><li>One thing.<li>Another</ul></article>") == f"{want}\nOne thing.\nAnother"


def test_html_classifier_moves_little():
    c = html_text.Classifier.fitted({(0, 0, 0, 0): (10**9, 0), (5, 3, 1, 3): (0, 10**9)})
    for w, first in zip(c.weights, html_text.Classifier().weights, strict=True):
        assert np.abs(w - first).max() <= html_text.STEP + 1e-6
    assert html_text.Classifier.fitted({}).table == html_text.Classifier().table


def test_html_of_long_pages():
    text = "A sentence of words."
    page = "<article>" + f"<p>{text}</p><ul><li><a href=x>link</a></ul><div class=ad>{text}</div>" * 4_000 + "</article>"
    began = time.time()
    got = html_text.main_text(page).split("\n")
    assert got.count(text) == 4_000 and time.time() - began < 30


def test_packing_rules():
    p = packing.Packer((4, 8, 16), cost=lambda c: c)
    sizes = np.array(sorted([16, 9, 7, 5, 4, 4, 3, 1, 1], reverse=True))
    bins, offsets, contents, final = p.pack(sizes)
    assert contents.sum() == sizes.sum() and (contents <= final).all() and set(final.tolist()) <= {4, 8, 16}
    for b in range(len(contents)):
        mine = sorted((int(o), int(n)) for o, n, x in zip(offsets, sizes, bins, strict=True) if x == b)
        assert [o for o, _ in mine] == np.cumsum([0, *(n for _, n in mine)])[:-1].tolist()
        assert not any(contents[b] <= c < final[b] for c in (4, 8, 16))
    assert len(p.pack(np.array([], np.int64))[0]) == 0


def test_packing_is_best_fit_by_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(40):
        lengths = (8, 16, 32)
        p = packing.Packer(lengths)
        sizes = np.sort(rng.integers(1, 33, int(rng.integers(1, 60))))[::-1]
        bins, offsets, contents, final = p.pack(sizes)
        capacity, filled = {}, {}
        for k, (n, b, at) in enumerate(zip(sizes.tolist(), bins.tolist(), offsets.tolist(), strict=True)):
            rooms = sorted(capacity[x] - filled[x] for x in capacity if capacity[x] - filled[x] >= n)
            if b in capacity:  # an open bin: the one that is left least room in
                assert capacity[b] - filled[b] == rooms[0]
            else:  # none has room: the size of least cost for each token that it is expected to hold
                assert not rooms
                later, room, best = sizes[k + 1 :], sum(capacity[x] - filled[x] for x in capacity), None
                for c in lengths:
                    if c >= n:
                        held = n + min(c - n, max(0, min(int(later.sum()), int(later[later <= c - n].sum())) - room))
                        best = min(best or (packing.cost(c) / held, c), (packing.cost(c) / held, c))
                capacity[b], filled[b] = best[1], 0
            assert at == filled[b]
            filled[b] += n
            assert filled[b] <= capacity[b]
        assert contents.tolist() == [filled[b] for b in range(len(filled))]
        assert final.tolist() == [min(c for c in lengths if c >= n) for n in contents.tolist()]


def test_best_fit_beats_one_bin_each():
    rng = np.random.default_rng(0)
    sizes = np.sort(rng.integers(1, 4096, 5000))[::-1]
    _, _, contents, final = packing.Packer().pack(sizes)
    assert contents.sum() / final.sum() > 0.97


def test_posterior_table():
    floor = jaccard_join.least_matches()
    assert list(floor) == list(jaccard_join.STEPS) and all(0 < m < n for n, m in floor.items())
    assert [floor[n] / n for n in jaccard_join.STEPS] == sorted(floor[n] / n for n in jaccard_join.STEPS)


def test_overlap_forms_agree():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(12)]
    i, j = np.triu_indices(12, 1)
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]
    assert jaccard_join.overlaps(sets, i, j).tolist() == want == [int(jaccard_join.overlaps(sets, i[k : k + 1], j[k : k + 1])[0]) for k in range(len(i))]


def test_language_cases():
    m = language.Model({"en": b"the and that with this have from they " * 30, "de": "und der die das nicht mit einer auch ".encode() * 30})
    assert m.predict("the and that with this from they have")[0] == "en" and m.predict("und der die nicht mit einer auch das")[0] == "de"
    assert m.predict(None) == m.predict("") == m.predict("123 !!") == ("und", 0.0, True)
    assert language.Model({}).predict("abc") == ("und", 0.0, False)
    assert language.Model({"en": b"the and that " * 30}).predict("the and that")[0] == "en"
    assert zlib.crc32(b"12") % 3 == zlib.crc32(str(12).encode()) % 3


def test_language_of_short_texts():
    m = language.Model({"de": "und der die das nicht mit einer auch ".encode() * 30, "en": b"the and that with this have from they " * 30})
    for text, want in (("This.", "en"), ("They.", "en"), ("Auch!", "de"), ("Nicht.", "de"), ("The that.", "en")):
        assert m.predict(text)[::2] == (want, False)
    assert m.predict("qpq")[2] and m.predict("qpq " * 30_000)[2]  # what is in neither stays rejected


def test_licence_cases():
    t = licences.Templates({b"the": 90, b"under": 40}, 100)
    for name, notice in licences.TEMPLATES:
        assert licences.own_licence(f"Some code.\n{notice}\nmore", False, t)[0] == name
    assert licences.own_licence("nothing of the kind", False, t)[0] is None and licences.own_licence(None, False, t)[0] is None
    assert licences.own_licence("Licensed under CC BY-NC 4.0.", False, t)[2]


def test_licence_passages():
    t = licences.Templates({b"the": 90, b"under": 40}, 100)
    # A phrase of prose is no licence; the sentence by itself is.
    prose = "He had a driving licence. All rights reserved to the king. Nobody may pass."
    assert licences.own_licence(prose, False, t)[0] is None
    assert licences.own_licence("code\nCopyright 2020 Someone. All rights reserved.\ncode", False, t)[0] == licences.RESERVED
    # Notices of any length, broken into many short lines with empty ones between, with code right after them.
    for name in ("ISC", "GPL-3.0", "Apache-2.0", "AGPL-3.0", "MIT"):
        notice = max((x for n, x in licences.TEMPLATES if n == name), key=len)
        lines = [" * " + w for w in re.findall(r"\S+(?:\s+\S+)?(?:\s+\S+)?", notice)]
        code = "int main() { return 0; }\n" * 300
        assert len(lines) > 9
        for sep in ("\n", "\n *\n"):
            assert licences.own_licence("/*\n" + sep.join(lines) + "\n */\n" + code, False, t)[0] == name
    # Very many cues in one long text.
    began = time.time()
    assert licences.own_licence("a licence of some kind\n" * 5_000 + "Licensed under the MIT License.\n", False, t)[0] == "MIT" and time.time() - began < 20


def test_whole_licence_files():
    t = licences.Templates({b"the": 90, b"under": 40}, 100)
    texts = dict(licences.full_texts())
    for name, text in texts.items():
        assert licences.own_licence(text, True, t)[::2] == (name, True)
        # Holders and addresses differ, and title lines are often left out.
        assert licences.own_licence("Copyright 2020 Some Holder of Rights\n\n" + "\n".join(text.split("\n")[2:]), True, t)[0] == name
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "BSD-2-Clause", "BSD-3-Clause"} <= set(texts)
    # Texts that are much like others' are told by their titles.
    alike = texts["GPL-3.0"].split("\n", 2)[2]
    assert licences.own_licence(" GNU AFFERO GENERAL PUBLIC LICENSE\n\n Version 3, 19 November 2007\n" + alike, True, t)[0] == "AGPL-3.0"
    assert licences.own_licence(texts["CC-BY-SA-4.0"].replace("-ShareAlike", ""), True, t)[0] == "CC-BY-4.0"
    # Passages of files tell too; reserved rights are no licence beside one.
    assert licences.own_licence("Ours. All rights reserved.\n\n" + "other words here\n" * 9 + "\nLicensed under the MIT License.\n", True, t)[0] == "MIT"
    assert licences.own_licence("All rights reserved.", True, t)[0] == licences.RESERVED
    assert licences.own_licence("words that are no licence at all " * 50, True, t)[0] is None


def test_spdx_lines():
    t = licences.Templates({b"the": 90, b"under": 40}, 50_000_000)
    code = "#!/bin/sh\n{}\nimport this\n" + "some code\n" * 50
    for i in {n for n, _ in licences.TEMPLATES}:
        assert licences.own_licence(code.format(f"# SPDX-License-Identifier: {i}"), False, t) == (i, 1.0, False)
    for line, want in (
        ("/* SPDX-License-Identifier: GPL-2.0-or-later */", "GPL-2.0"), ("<!-- spdx-license-identifier: mit -->", "MIT"), ("// SPDX-License-Identifier: ISC", "ISC"),
        ("# SPDX-License-Identifier: (MIT OR Apache-2.0) AND Zlib", "(MIT OR Apache-2.0) AND Zlib"), ("# SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note", "GPL-2.0 WITH Linux-syscall-note"),
        ("# SPDX-License-Identifier: LicenseRef-Ours", "LicenseRef-Ours"), ("# SPDX-License-Identifier: see below", None), ("# SPDX-License-Identifier:", None), ("# SPDX-License-Identifier: MIT OR", None), ("# SPDX-License-Identifier: Nothing-1.0", None),
    ):
        assert licences.own_licence(code.format(line), False, t)[0] == want
    # The line goes before other notices, and alone it makes a licence file.
    assert licences.own_licence("// Copyright. All rights reserved.\n// SPDX-License-Identifier: MIT\n// Licensed under CC BY 4.0.", False, t)[0] == "MIT"
    assert licences.own_licence("SPDX-License-Identifier: MIT", False, t) == ("MIT", 1.0, True)


@pytest.mark.parametrize("text", ["", None, "one two", "a b c d e f g"])
def test_shingle_cases(text):
    words = jaccard_join.word_list(text)
    if not words:
        assert jaccard_join.key_of(words) is None
    else:
        h, starts = jaccard_join.shingles([words, words])
        assert len(h) == 2 * max(1, len(words) - 4) and starts.tolist() == [0, len(h) // 2] and (h[: len(h) // 2] == h[len(h) // 2 :]).all()
