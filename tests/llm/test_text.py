"""Decontamination, language-model scores, quality rules and main text against their definitions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from llm_data import prose

from civicledger.llm import decontaminate, html_extract, lm_score, quality
from civicledger.llm.queries import vocabulary

PIECES = vocabulary("piece_bpe_32k.model")


def low(text):
    return re.sub("[A-Z]", lambda c: c[0].lower(), text or "")


def test_decontamination(spark, documents, odd, monkeypatch):
    items = [(k, prose(50 + k, 30)) for k in range(20)] + [(30, "short item"), (31, "One"), (32, ""), (33, None), (34, " -- "), (35, "a b c d"), (36, prose(50, 30)), (37, "ab " * 12)]
    hits = [(4000 + k, prose(900 + k, 50) + "! " + " ".join(prose(50 + k, 30).split()[k : k + 11]).upper() + "? " + prose(950 + k, 50)) for k in range(20)]
    hits += [(4100, "has a Short, item in it"), (4101, "ab-" * 40), (4102, "xshort itemy"), (4103, prose(50, 30) + "\n" + prose(51, 30))]
    pairs = odd + hits
    benchmark = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, doc_id string")
    want = sorted(decontaminate.brute_force(pairs, [i for i in items if i[1] is not None]))
    got = lambda: sorted(map(tuple, decontaminate.digests(decontaminate.contaminated(documents(pairs), benchmark)).collect()))
    assert got() == want and sum(r[-1] for r in want) > 20
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1000)  # the benchmark in several blocks
    assert got() == want
    assert decontaminate.contaminated(documents([]), benchmark).count() == 0
    clean = decontaminate.contaminated(documents(pairs), benchmark.limit(0)).where("n_hit > 0")
    assert clean.count() == 0


def test_items_without_an_id_are_found(spark, documents, monkeypatch):
    docs = documents([(1, f"{prose(970, 20)} {prose(60, 12)} {prose(971, 20)}"), (2, f"{prose(61, 12)} {prose(60, 12)} {prose(62, 12)}"), (3, prose(972, 40))])
    benchmark = spark.createDataFrame([(None, prose(60, 12)), (7, prose(61, 12)), (None, prose(62, 12)), (None, None)], "item_id long, text string")
    for size in (decontaminate.BLOCK_BYTES, 50):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        found = {r["doc_id"]: r for r in decontaminate.contaminated(docs, benchmark).collect()}
        assert {k: (r["n_hit"], r["items"]) for k, r in found.items()} == {1: (12, [None]), 2: (36, ["7", None]), 3: (0, [])}
    rows = {r["doc_id"]: (r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.digests(decontaminate.contaminated(docs, benchmark)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert rows == {1: (1, sha(""), True), 2: (2, sha("7"), True), 3: (0, sha(""), False)}  # as its SQL has it


def lattice_sum(word, pieces, weights):
    """All spellings one by one."""
    total = 0.0
    for n in range(len(word)):
        for cuts in combinations(range(1, len(word)), n):
            parts = [word[a:b] for a, b in zip((0, *cuts), (*cuts, len(word)))]
            if all(p in pieces for p in parts):
                total += math.exp(sum(weights[pieces[p]] for p in parts))
    return total


def test_lattice_sums_all_spellings():
    pieces, weights = lm_score.vocabulary(PIECES)
    assert abs(np.exp(weights).sum() - 1) < 1e-9
    lattice = lm_score.Lattice(pieces, weights)
    for word in ["▁the", "▁reading", "▁x", "▁unseen"]:
        assert math.isclose(math.exp(lattice.forward([word])[0]), lattice_sum(word, pieces, weights), rel_tol=1e-9)
    assert np.isfinite(lattice.forward(["▁" + "q" * 30 + "日" * 10])).all()
    uses = lattice.expected(["▁the", "▁and"])
    assert uses.sum() >= 2 and uses.min() >= 0


def held(k):
    return k is None or zlib.crc32(str(k).encode()) % 7 == 2


def test_scores(documents, odd):
    vocabulary = prose(1, 300).split()
    pairs = odd + [(5000 + k, " ".join(random.Random(k).choices(vocabulary, k=60))) for k in range(150)]
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", low(t)) + ["\n"] for k, t in pairs}
    counts = Counter(w for k, own in words.items() if not held(k) for w in own)
    n, v = sum(counts.values()), len(counts)
    rows = {r["doc_id"]: r for r in lm_score.scores(documents(pairs), PIECES).collect()}
    assert rows.keys() == words.keys()
    for k, own in words.items():
        r = rows[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(k), len(own), sum(counts[w] > 0 for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0
    out = [k for k in words if held(k) and k >= 5000]
    assert len(out) > 10 and sum(rows[k]["score"] for k in out) > sum(rows[k]["base_score"] for k in out)


def test_scores_by_join_equal_scores_of_sent_words(documents, monkeypatch):
    pairs = [(k, prose(k, 50)) for k in range(60)]
    want = {r["doc_id"]: (r["n_known"], r["base_score"], r["score"]) for r in lm_score.scores(documents(pairs), PIECES).collect()}
    monkeypatch.setattr(lm_score, "HOT", 5)
    for r in lm_score.scores(documents(pairs), PIECES).collect():
        assert (r["n_known"], pytest.approx(r["base_score"]), pytest.approx(r["score"])) == want[r["doc_id"]]


def test_scores_without_training(documents):
    assert lm_score.scores(documents([]), PIECES).count() == 0
    only_held = [(k, "some words") for k in range(200) if held(k)][:3] + [(None, "x")]
    rows = lm_score.scores(documents(only_held), PIECES).collect()
    assert len(rows) == 4 and all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in rows)


def counted(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


def test_quality_counts(spark, documents, odd):
    pairs = odd + [(6000, "a b c a b c d\nx\nx\n \n\nx"), (6001, "##*$%&|<> é日\t[]"), (6002, prose(1, 60) + "\n" + prose(1, 60)), (6003, "a b\na b c"), (6004, "\n\nq\r\nq\r\n")]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for r in quality.judge(documents(pairs), labels).collect():
        want = counted(dict(pairs)[r["doc_id"]])
        assert tuple(r[c] for c in quality.COUNTS) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r["kept"] == (not r["base_failed"])


def test_quality_cutoffs(spark, documents):
    rng, pairs, labels = random.Random(1), [], []
    for k in range(3000):
        junk = k % 5 == 0
        text = prose(k, 60)
        pairs.append((k, re.sub(" ", lambda _: rng.choice(["%%% ", "### ", " "]), text) if junk else text))
        labels.append((k, 0 if junk else 1, 0))
    labels += [(0, 0, 0), (None, 1, 0), (99999, 1, 0), (3, None, 0)]
    rows = {r["doc_id"]: r for r in quality.judge(documents(pairs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert not any(rows[k]["kept"] for k in range(0, 3000, 5))
    assert all(rows[k]["kept"] for k in range(3000) if k % 5)
    few = quality.judge(documents(pairs[:100]), spark.createDataFrame(labels[:100], "doc_id long, quality int, toxic int"))
    assert few.where("kept = base_failed").count() == 0  # nothing is proven by so few labels
    assert quality.judge(documents([]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_binomial_bound():
    assert math.isclose(quality.binomial_tail(0, 100, 0.05), 0.95**100)
    assert math.isclose(quality.binomial_tail(3, 10, 0.3), sum(math.comb(10, k) * 0.3**k * 0.7 ** (10 - k) for k in range(4)))
    good, bad = np.zeros(quality.BINS + 1), np.zeros(quality.BINS + 1)
    good[0], good[5], bad[30] = 1000, 200, 50
    assert quality.proven(good, good, bad, 0.01, 0.001) == 30  # a cutoff of 5 would reject a sixth of the good
    assert quality.proven(good * 0, good * 0, bad, 0.01, 0.001) is None
    # over many draws, hardly ever is a cutoff accepted that rejects more than it may
    rng, wrong = np.random.default_rng(1), 0
    for _ in range(300):
        drawn = rng.multinomial(400, [0.97, 0.03])
        good = np.zeros(quality.BINS + 1)
        good[0], good[10] = drawn
        wrong += quality.proven(good, good * 0, bad, 0.02, 0.05) is not None and quality.proven(good, good * 0, np.eye(quality.BINS + 1)[10], 0.02, 0.05) == 10
    assert wrong <= 300 * 0.05


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav>menu<ul><li>a<li>b</nav>
<div class="cookie-notice">We use cookies</div><div class=ad>Buy</div><main><h1>A &amp; B</h1><p>One<br>two <b>bo</b>ld&nbsp;x<p>Three <ul><li>i1<li>i2</ul><aside>side</aside>
<script>if (a < b) { document.write("</p>") }</script><table><tr><td>c1<td>c2</table>a < b<form>f<input></form><!-- <p>no</p> --></main><div id="comments"><article><p>reader</p></article></div><footer>foot"""


@pytest.mark.parametrize("page, text", [
    (PAGE, "A & B One two bold x Three i1 i2 c1 c2 a < b"), ("", ""), ("plain", "plain"), ("plain <unclosed", "plain"), ("<p>a<div>b</div>c <span>d</span>e<style>p{}</style> t", "a b c de t"),
    ("<article><h1>x</h1>&#233;&bogus;&lt;p&gt;<br></article><footer>y</footer>", "x é&bogus;<p>"), ("<nav>open menu<article><p>kept</article>", "kept"), ("<body><ul><li>one<ul><li>two</ul><li>three</ul>", "one two three"),
    ("<p hidden>x</p><p aria-hidden=true>y</p><p>z", "z"), ("<textarea><p>t</textarea><title>no</title>ok", "ok"), ("<div>a<br/>b<hr>c</div>", "a b c"), ("</p></div>x</body></html>", "x"), ("a\n\n  b\tc", "a b c"),
])
def test_main_text(page, text):
    assert html_extract.main_text(html_extract.parse(page)) == text


@pytest.mark.parametrize("page, text", [
    ('<article class="post category-legal"><p>Body text</p></article>', "Body text"), ('<article class="tag-social"><p>x y</p></article>', "x y"), ('<div class="banner"><main><p>m</p></main></div>', "m"),
    ('<article><p class="side">running</p> <span class="social">in</span></article>', "running in"), ("<h1>Title</h1><main><p>Body</p></main>", "Title Body"),
    ("<div><h1>Site</h1></div><h1>Title</h1><article><p>Body</p></article>", "Title Body"), ("<h1>Site</h1><main><h1>Own</h1><p>Body</p></main>", "Own Body"), ("<header><h1>Site</h1></header><main><p>Body</p></main>", "Body"),
    ('<div class="comments"><article class="comment"><p>c</p></article></div><article><p>a</p></article>', "a"), ('<article><p>a</p><section class="comments"><article><p>c</p></article></section></article>', "a"),
    ('<article class="comment"><p>c</p></article><p>rest</p>', "rest"),
])
def test_names_never_take_the_content(page, text):
    assert html_extract.main_text(html_extract.parse(page)) == text


def test_untagged_templates_against_plain_counting(spark):
    """Pages of plain divs: what stands on five pages and a quarter of the site goes, what a plain count of boxes per site says."""
    import random

    rng = random.Random(8)
    boxes = [f"<div><span>box {k}</span></div>" for k in range(30)]
    shown, pages = {}, []
    for site in range(4):
        some = rng.sample(boxes, 12)
        for k in range(rng.choice([6, 20, 40])):
            mine = [b for i, b in enumerate(some) if rng.random() < (i + 1) / 13]
            shown[len(pages)] = site, mine
            pages.append((len(pages), f"http://s{site}.example/{k}", f"<body><p>own {len(pages)}</p>" + "".join(mine)))
    count = Counter((site, b) for site, mine in shown.values() for b in mine)
    size = Counter(site for site, _ in shown.values())
    gone = {key for key, n in count.items() if n >= html_extract.MIN_PAGES and n >= html_extract.SHARE * size[key[0]]}
    want = {k: " ".join([f"own {k}", *(re.sub("<.*?>", "", b) for b in mine if (site, b) not in gone)]) for k, (site, mine) in shown.items()}
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == want and gone and any(len(t.split()) > 2 for t in got.values())


def test_very_deep_and_long_pages():
    assert html_extract.main_text(html_extract.parse("<div>" * 20000 + "x")) == "x"
    assert len(html_extract.main_text(html_extract.parse("<p>word " * 50000))) == 5 * 50000 - 1


@pytest.mark.parametrize("sent", [1_000_000, -1])
def test_site_templates_go(spark, monkeypatch, sent):
    monkeypatch.setattr(html_extract, "SENT_HASHES", sent)
    slogan = "<div><p>Our slogan on every page</p></div>"
    pages = [(k, f"https://www.a.example:80/{k}", f"<body>{slogan}<div><p>own text {k}</p></div><div><span>made by us</span></div>") for k in range(20)]
    pages += [(100 + k, f"http://b.example/{k}", f"<body>{slogan}<p>other {k}</p>") for k in range(3)]  # too few pages to tell
    pages += [(200 + k, f"http://c.example/{k}", f"<article><p>said on every page</p><div>Follow us</div><p>own {k}</p></article>") for k in range(20)]
    pages += [(300, None, None), (301, "no url", ""), (302, None, "<p>x</p>"), (0, "https://a.example/0", f"<body>{slogan}<p>again</p>")]
    df = spark.createDataFrame([(*p, "h", "t") for p in pages], "page_id long, url string, html string, host string, text string")
    got = Counter((r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract(df).collect())
    want = [(k, f"own text {k}") for k in range(20)] + [(100 + k, f"Our slogan on every page other {k}") for k in range(3)]
    want += [(200 + k, f"said on every page own {k}") for k in range(20)] + [(300, ""), (301, ""), (302, "x"), (0, "again")]
    assert got == Counter((k, t, len(t)) for k, t in want)
    assert html_extract.extract(df.limit(0)).count() == 0


def test_box_on_many_pages_of_a_large_host(spark):
    pages = [(k, f"http://a.example/{k}", f"<body>{'<div><span>Our offers</span></div><p>yes</p>' if k < 12 else ''}<p>own {k}</p></body>") for k in range(60)]
    rows = html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string"), many_pages=12).collect()
    assert {r["page_id"]: r["text"] for r in rows} == {k: ("yes " if k < 12 else "") + f"own {k}" for k in range(60)}


def test_copies_of_a_page_do_not_make_it_template(spark):
    box = "<div><span>Our offers</span></div>"
    copy = f"<body>{box}<article><div class=body><p>told once</p><p>in two parts</p></div></article>"
    pages = [(k, f"http://a.example/{k}", copy) for k in range(8)] + [(10 + k, f"http://a.example/{k}", f"<body>{box}<article><p>own {k}</p></article>") for k in range(8)]
    pages += [(20 + k, f"http://b.example/{k}", f"<body><div><p>no landmark</p></div><div>{'x' if k < 6 else k}</div>") for k in range(9)]  # six copies
    # the same body below a line that differs
    pages += [(30 + k, f"http://c.example/{k}", f"<main><span>view {k}</span><div><p>body of the text</p></div><div>Follow us</div></main>") for k in range(8)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = {k: "told once in two parts" for k in range(8)} | {10 + k: f"own {k}" for k in range(8)} | {20 + k: f"no landmark {'x' if k < 6 else k}" for k in range(9)}
    want |= {30 + k: f"view {k} body of the text" for k in range(8)}
    assert {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()} == want
