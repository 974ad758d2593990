"""Jaccard join, line dedup and repeated passages against their definitions."""

import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from llm_data import prose
from pyspark.sql import functions as F

from civicledger.llm import jaccard_join, line_dedup, suffix_dedup
from civicledger.llm.graph import components


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def near_copies(seed, base, n, edits):
    rng, out = random.Random(seed), []
    for _ in range(n):
        words = base.split()
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**9)}"
        out.append(" ".join(words))
    return out


def corpus():
    """A group of near copies round one text that no two of them link by themselves, chains, a passage in many texts, exact copies."""
    base = prose(7, 120)
    texts = near_copies(1, base, 40, 2) + [base] + near_copies(2, prose(8, 200), 30, 5) + near_copies(3, prose(9, 30), 20, 1)
    chain = prose(10, 150)
    for k in range(10):
        chain = near_copies(20 + k, chain, 1, 2)[0]
        texts.append(chain)
    passage = prose(11, 60)
    texts += [prose(100 + k, 40) + " " + passage + " " + prose(300 + k, 40) for k in range(60)]
    texts += [prose(12, 80)] * 25 + [prose(12, 80).upper()] * 3 + [prose(500 + k, 100) for k in range(60)] + ["a b c d", "A B C D", "a b c", "a b c d e f g h", "a b c d e f g h i"]
    random.Random(5).shuffle(texts)
    return list(enumerate(texts, 1000))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_jaccard_join(documents, odd):
    pairs = odd + corpus()
    sets, union = {k: shingles(t) for k, t in pairs}, Union()
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and x and 100 * len(x & y) >= 80 * len(x | y):
                union.link(a, b)
    rows, links = jaccard_join.join(documents(pairs))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows.collect()}
    assert got == {k: (len(s), union.find(k)) for k, s in sets.items()}
    for r in links.collect():
        assert 100 * r["shared"] >= 80 * r["united"]


def test_jaccard_join_without_ids_and_with_repeated_ones(documents):
    rows = jaccard_join.join(documents([(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "q r s t u v w"), (2, "a b c d e f"), (3, "")]))[0].collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows) == Counter({(None, 2, None): 1, (1, 2, 1): 1, (2, 2, 1): 2, (2, 3, 2): 1, (3, 0, 3): 1})
    assert jaccard_join.join(documents([]))[0].count() == 0
    with pytest.raises(ValueError):
        jaccard_join.join(documents([]), percent=50)


def test_components(spark):
    chain = [(k, k + 1) for k in range(100, 130)] + [(5, 9), (9, 7), (7, 5), (1, 1), (50, 40)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 131)}, 5: 5, 9: 5, 7: 5, 50: 40, 40: 40}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def normal(line):
    return re.sub(r"[ \t\n\r\f\v\x00]+", " ", line.lower()).strip(" ")


def simhash(norm):
    words, out = set(norm.split(" ")), 0
    longer = {w for w in words if len(w) >= 4}
    words = longer if len(longer) >= 4 else words
    hashes = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words]
    for b in range(63):
        out |= (2 * sum(h >> b & 1 for h in hashes) > len(words)) << b
    return out


def edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def dropped_lines(pairs):
    lines = [(k, i, normal(line)) for k, t in sorted(pairs, key=lambda p: p[0]) for i, line in enumerate((t or "").split("\n")) if normal(line)]
    distinct = sorted({n for _, _, n in lines})
    hashes, union = {n: simhash(n) for n in distinct}, Union()
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (hashes[a] ^ hashes[b]).bit_count() <= 3:
                longest = max(len(a), len(b))
                if edits(a, b) <= longest * 20 // 100:
                    union.link(a, b)
    seen, out = set(), defaultdict(set)
    for k, i, n in lines:
        group = union.find(n)
        if group in seen:
            out[k].add(i)
        seen.add(group)
    return out


def line_corpus():
    long = prose(3, 90)
    variants = [long.replace("x,", "y,", 1), long + " tail", "Head " + long, long.upper(), "  " + long.replace(" ", "   ") + " "]
    texts = [long, "\n".join([*variants, prose(4, 20), "", prose(4, 20)]), "first line\nsecond line\n\nfirst line", prose(4, 20) + "\n\n", "a | b | c\nd | e | f\na | b | c"]
    texts += ["\n".join([prose(5, 12), prose(600 + k, 12), f"page {k} of 300"]) for k in range(40)] + ["\r\n".join(["crlf line", "crlf line"])]
    return [(2000 + k, t) for k, t in enumerate(texts)]


def test_line_dedup(documents):
    pairs = [(k, t) for k, t in enumerate([None, "", " \n\t ", "One", "one", "word " * 3000, "word " * 3001])] + line_corpus()
    docs, gone = documents(pairs), dropped_lines(pairs)
    got = line_dedup.dedup(docs, counted=True)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    for r in got.collect():
        t = dict(pairs)[r["doc_id"]]
        rest = None if t is None else "\n".join(line for i, line in enumerate(t.split("\n")) if i not in gone[r["doc_id"]])
        assert (r["text"], r["n_dropped"], r["source"]) == (rest, len(gone[r["doc_id"]]), "s")


def test_line_dedup_is_native(documents):
    plan = line_dedup.dedup(documents(line_corpus()))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_simhashes_within_the_row(documents):
    texts = [prose(900 + n, n, words=3000) for n in (1, 3, 7, 8, 20, 300, 700, 2500)]
    got = line_dedup.simhashes(line_dedup.lines_of(documents(list(enumerate(texts))), "doc_id", "text"))
    assert {r["id"]: r["sim"] for r in got.collect()} == {k: simhash(normal(t)) for k, t in enumerate(texts)}
    assert "Exchange" not in got._jdf.queryExecution().toString()  # words of a line are not shuffled to meet


def test_majority_of_every_width(spark):
    rng = random.Random(7)
    lists = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 7, 14, 63, 254, 255)]
    words = spark.createDataFrame([(h,) for h in lists], "words array<long>")
    counts = [line_dedup._counted_by_sevens(F.col("words")), *[line_dedup._counted(F.col("words"), width) for width in line_dedup.LANES[1:]]]
    out = words.select("words", *[line_dedup._majority(c, F.size("words"), width) for c, width in zip(counts, line_dedup.LANES)])
    for h, *sims in out.collect():
        assert sims == [sum((2 * sum(w >> b & 1 for w in h) > len(h)) << b for b in range(63))] * 3


def test_edits_are_bounded_exactly(spark):
    rng, base = random.Random(11), prose(41, 30).lower().split(" ")
    pairs = [("a b", "b a"), ("a", "a a"), ("a a a", "a a"), ("x y", "x q y"), ("tail here", "other tail here"), ("ab c", "abc")]
    for n in range(60):
        words = list(base)
        for _ in range(rng.randint(1, 9)):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 2)] = rng.choice([[], ["new"], [words[at] + "s"], [words[at], words[at]]])
        pairs.append((" ".join(base), " ".join(words)))
    pairs = [(p, q, n) for p, q in pairs if p != q for d in [edits(p, q)] for n in {max(d - 1, 0), d, d + 1, 2 * d}]
    table = spark.createDataFrame(pairs, "p string, q string, n int")
    for p, q, n, within in table.select("p", "q", "n", line_dedup._with([F.col("p"), F.col("q"), F.col("n")], line_dedup._within)).collect():
        assert within == (edits(p, q) <= n), (p, q, n)


def test_line_dedup_without_ids_and_rows(documents):
    got = line_dedup.dedup(documents([(None, "a b c"), (1, "a b c\nd"), (1, "a b c\nd")])).select("doc_id", "text").collect()
    assert Counter(map(tuple, got)) == Counter({(None, "a b c"): 1, (1, "d"): 2})
    assert line_dedup.dedup(documents([])).count() == 0


def test_repeated_passages(documents, odd):
    passage, longer = prose(31, 50), prose(32, 300)
    texts = [prose(700 + k, 30 + 7 * k) + " " + passage + " " + prose(800 + k, 30) for k in range(12)] + [prose(33, 20) + " " + longer, longer + " " + prose(34, 15), prose(35, 49), prose(35, 49) + " more"]
    texts += [prose(36, 70) + "\n" + prose(37, 30) + "\n" + prose(36, 70), prose(38, 400), prose(38, 400).title(), " ".join([passage] * 3)]
    pairs = odd + [(3000 + k, t) for k, t in enumerate(texts)]
    got = defaultdict(set)
    for r in suffix_dedup.repeats(documents(pairs)).collect():
        assert r["n_words"] == r["end_word"] - r["start_word"] >= 50
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    want = suffix_dedup.brute_force(pairs)
    assert {k: got[k] for k in want} == want
    assert suffix_dedup.repeats(documents([])).count() == 0


def test_first_of_equal_texts(documents):
    text = prose(40, 80)
    rows = suffix_dedup.repeats(documents([(5, text), (4, text), (9, prose(41, 80))])).collect()
    assert {(r["doc_id"], r["whole_text"], r["first"]) for r in rows} == {(4, True, True), (5, True, False)}


def test_repeats_round_a_frequent_core(documents):
    """48 words that all texts share; the 50th comes from before, from after, or from both sides."""
    rng, core = random.Random(50), prose(51, 48)
    side = lambda: f"side{rng.randrange(12)}"
    pairs = [(5000 + k, f"{prose(1000 + k, 5)} {side()} {core} {side()} {prose(2000 + k, 5)}") for k in range(600)]
    want, got, first = suffix_dedup.brute_force(pairs), defaultdict(set), defaultdict(bool)
    for r in suffix_dedup.repeats(documents(pairs)).collect():
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
        first[r["doc_id"]] |= r["first"]
    assert {k: got[k] for k in want} == want
    assert first[5000]
