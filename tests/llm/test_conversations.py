"""Conversation repair, prefix trie and byte-level BPE against plain definitions and the tiktoken library."""

import base64
import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from compare import DATA, duck
from llm_data import prose

from civicledger.llm import byte_bpe, conversation_repair, prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, base string, conv string, present string, depth int, key string, letters int, copies int"
COST = {"D": 4, "I": 3, "K": 0, "R": 3}


@pytest.fixture
def talks(spark):
    return lambda rows: spark.createDataFrame([(*r, "b", "c", "p", 1, "k", 2, 3) for r in rows], SCHEMA).repartition(3)


def some_talks(seed, n=60, turns=7):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(0, turns)):
            text = rng.choice(["", " \t", "Hm.", "so", "Yes!", "No?", "a b", None, "Hm.", f"t{turn}."])
            rows.append((conv, None if rng.random() < 0.05 else turn + (rng.random() < 0.1), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), text))
    return rows + [(None, 1, "user", "x."), (None, 2, None, "y"), (-7, 3, "user", "below nought.")] + [(999, 0, "user", "same.")] * 3


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:3]))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\f\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, lines) over all edit sequences with up to two insertions in a row, by trying them all."""
    best = (10**9, "", [])
    gaps = [("",), ("I",), ("I", "I")]
    for letters in itertools.product("DKR", repeat=len(rows)):
        for ins in itertools.product(gaps, repeat=len(rows) + 1):
            state, cost, audit, lines = "", 0, "", []
            for k in range(len(rows) + 1):
                for _ in (x for x in ins[k] if x):
                    role = "assistant" if state.endswith("u") else "user"
                    state, cost, audit = state + role[0], cost + 3, audit + "I"
                    lines.append(f"{role}:")
                if k == len(rows):
                    break
                (_, role, text), fault, letter = rows[k], found[k], letters[k]
                audit, cost = audit + letter, cost + COST[letter]
                if letter == "D":
                    continue
                if fault in ("blank", "duplicate"):
                    cost = 10**9
                    break
                new = role if letter == "K" else "assistant" if state.endswith("u") else "user"
                state, cost = state + (new[:1] or "?"), cost + (3 if fault == "truncated" else 0)
                lines.append(f"{new}:{text}")
            body = state[1:] if state[:1] == "s" else state
            if (state == "" or (body and body == "ua" * (len(body) // 2))) and (cost, audit) < best[:2]:
                best = cost, audit, lines
    return best


def test_repair_equals_all_edits_tried(talks):
    rows = some_talks(1, n=40, turns=3)
    edits = conversation_repair.repair(talks(rows))
    got = {r["conv"]: r for r in conversation_repair.reports(edits).collect()}
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        by_conv[conv].append((turn, " " if role is None else role, " " if text is None else text))
    assert got.keys() == by_conv.keys()
    for conv, talk in by_conv.items():
        talk = in_order(talk)
        found = faults(talk)
        cost, audit, lines = cheapest(talk, found)
        turns = {t for t, _, _ in talk if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(talk)]
        want = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, found.count("blank"), found.count("duplicate"), found.count("truncated"),
                sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
        assert tuple(got[conv])[1:] == want, (conv, talk)


def test_repaired_rows_follow_the_roles(talks):
    rows = some_talks(2, n=80, turns=9)
    spoken = defaultdict(str)
    for part in conversation_repair.repair(talks(rows)).where("edit <> 'D'").toLocalIterator():
        spoken[part["conv"]] += part["role"][:1]
    for roles in spoken.values():
        body = roles.removeprefix("s")
        assert body and body == "ua" * (len(body) // 2)


def test_giant_conversation_over_many_batches(spark, talks):
    rows = [(5, t, "user" if t % 2 == 0 else "assistant", f"turn {t}." if t % 50 else "lost") for t in range(30_000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        report, = conversation_repair.reports(conversation_repair.repair(talks(rows))).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # "lost" repeats after the first: a deleted turn of the user, whose place an inserted one takes
    assert report["truncated"] == 1 and report["duplicate"] == 599 and report["cost"] == 3 + 599 * 7
    assert len(report["audit"]) == 30_000 + 599 and report["illegal"] == report["gaps"] == 0


def test_empty_conversation_tables(talks):
    assert conversation_repair.reports(conversation_repair.repair(talks([]))).count() == 0
    assert prefix_trie.trie(prefix_trie.rebuilt(talks([]))).count() == 0


def test_dropped_conversations_are_reported(talks):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = conversation_repair.damaged(talks([(dropped, 0, "user", "gone.")]))
    report, = conversation_repair.reports(conversation_repair.repair(rows, present="present")).collect()
    assert tuple(report) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def trie_of(paths):
    nodes = {}
    for conv, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(conv)
    children = defaultdict(list)
    for k in nodes:
        if k:
            children[k[:-1]].append(k)

    def sums(k):
        own = (len(nodes[k]) - 1) * len(k[-1][1].encode()) if k else 0
        below = [sums(c) for c in children[k]]
        return (sum(b[0] for b in below) or 1), own + sum(b[1] for b in below)

    out = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if paths[c] == k)
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(children[k]), *sums(k), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [3, 4])
def test_trie_equals_plain_trie(talks, seed):
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(-3, 120), 70):
        for turn in range(rng.choice([0, 1, 2, 5, 12])):
            role, text = rng.choice([("user", "a"), ("assistant", "é"), ("user", "a"), (None, None), ("u", "sera"), ("user", "")])
            rows.append((conv, None if turn == 0 and rng.random() < 0.2 else turn, role, text))
    rows += [(500 + k, t, "user", f"copy {t}") for k in range(0, 50, 5) for t in range(20)] + [(None, 0, "user", "no id")] + rows[:3]
    talk = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            talk[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: tuple(t[2:] for t in sorted(turns)) for c, turns in talk.items()}
    paths = {}
    for c, turns in own.items():
        base, h = c - int(c - 5 * int(c / 5)), zlib.crc32(str(c).encode()) % 9
        paths[c] = own.get(base, ())[:h] + turns[h:]
    got = prefix_trie.trie(prefix_trie.rebuilt(talks(rows))).drop("key", "parent").collect()
    assert sorted((tuple(r) for r in got), key=str) == trie_of(paths)


def test_deep_copies_and_pieces_of_ends(talks, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 40) for t in range(12 + c % 3)]
    nodes = {r["depth"]: r for r in prefix_trie.trie(prefix_trie.keyed_turns(talks(rows))).collect()}
    assert len(nodes) == 15 and nodes[0]["n_convs"] == 40 and nodes[0]["n_leaves"] == 1
    for depth in (12, 13, 14):
        ends = ",".join(str(c) for c in range(40) if 12 + c % 3 == depth)
        assert nodes[depth]["ends_sha256"] == hashlib.sha256(ends.encode()).hexdigest()
        assert nodes[depth]["n_convs"] == sum(12 + c % 3 >= depth for c in range(40))


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op13_prefix_trie"])
def test_queries_equal_sql(spark, name):
    folder = f"{DATA}/sf0.01"
    cur = duck(folder).execute(queries.ORACLES[name])
    columns = [d[0] for d in cur.description]
    got = [tuple(r) for r in queries.QUERIES[name](spark, folder).select(*columns).collect()]
    assert sorted(got, key=str) == sorted(cur.fetchall(), key=str)


def library():
    import public_tokenizers
    import tiktoken

    path = queries.vocabulary("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return path, public_tokenizers.PATTERN, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_the_library(documents, odd, monkeypatch):
    path, pattern, tik = library()
    rng = random.Random(5)
    more = ["aa" * 4001, "日本語テキスト" * 300, "x" * 20_000, "".join(chr(rng.choice([*range(32, 700), *range(0x4E00, 0x4F00), 0x1F600, 9, 10, 13, 0xA0, 0])) for _ in range(6000)), prose(9, 3000)]
    texts = dict(odd + [(100 + k, t) for k, t in enumerate(more)] + [(None, "no id")])
    docs = documents(list(texts.items()))
    tokens = byte_bpe.encode(docs, path, pattern)
    other = byte_bpe.encode(docs, path, f"(?:{pattern})")  # the same matches, without the way over chunks
    assert sorted(map(str, other.collect())) == sorted(map(str, tokens.collect()))
    rows = byte_bpe.decode(tokens, path).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == tik.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
    got = {r["doc_id"]: r for r in byte_bpe.digests(byte_bpe.decode(tokens, path)).collect()}
    for k, t in texts.items():
        listed = ",".join(map(str, tik.encode_ordinary(t or ""))).encode()
        assert (got[k]["n_tokens"], got[k]["ids_sha256"], got[k]["decoded_sha256"]) == (len(tik.encode_ordinary(t or "")), hashlib.sha256(listed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_long_texts_and_a_full_memory_give_the_same_ids(monkeypatch):
    path, pattern, tik = library()
    monkeypatch.setattr(byte_bpe, "LONG_TEXT", 300)
    monkeypatch.setattr(byte_bpe, "PART", 50)
    texts = [prose(k, n) for k, n in ((11, 2000), (12, 20), (13, 30), (14, 0), (15, 500))]
    got = byte_bpe.Encoder(byte_bpe.load_ranks(path), pattern, keep=40).ids(texts)
    assert [np.frombuffer(ids, "<i4").tolist() for ids in got] == [tik.encode_ordinary(t) for t in texts]


def test_trees_side_by_side_equal_single_trees():
    path, _, _ = library()
    ranks, rng = byte_bpe.load_ranks(path), random.Random(3)
    pairs = byte_bpe.Pairs(ranks)
    for size in range(1, 7):
        pieces = [bytes(rng.choice(b"aetrs nioABC\xc3\xa9\x00\xff") for _ in range(rng.randint((1 << size - 1) + 1, 1 << size))) for _ in range(300)]
        for piece, ids in zip(pieces, byte_bpe.merge_many(pieces, pairs)):
            assert np.frombuffer(ids, "<i4").tolist() == byte_bpe.merge(piece, ranks)


def test_whole_table_against_the_library(spark):
    path, pattern, tik = library()
    got = {r["doc_id"]: r for r in queries.op12_byte_bpe(spark, f"{DATA}/sf0.001").collect()}
    for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect():
        ids = tik.encode_ordinary(r["text"] or "")
        assert (got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_empty_documents(documents):
    path, pattern, _ = library()
    assert byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(documents([]), path, pattern), path)).count() == 0
