"""Token files, packing and token counts against the tokenizers library itself."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from llm_data import prose
from tokenizers import Tokenizer

from civicledger.llm import packing, token_counts, token_output
from civicledger.llm.queries import vocabulary

BYTES, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("ranks", [[], [0], [255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1], list(range(0, 70000, 7))])
def test_streams_round_trip(ranks):
    control, data = token_output.encode_ranks(np.array(ranks, dtype=np.uint32))
    assert len(control) == -(-len(ranks) // 4)
    assert token_output.decode_ranks(control, data, len(ranks)).tolist() == ranks


def test_token_files(documents, odd):
    docs = documents(odd + [(100 + k, prose(k, 30)) for k in range(60)])
    files, book = token_output.write_token_files(docs, BYTES, shards=5)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_output.read_token_files(files, book).collect())
    want, start = [], 0
    for k, t in sorted(odd + [(100 + k, prose(k, 30)) for k in range(60)]):
        ids = [*ids_of(BYTES, t), 0]
        want.append((start, k, len(ids), crc(ids)))
        start += len(ids)
    assert got == want
    assert [r["n"] for r in book.orderBy("rank").collect()] == sorted((r["n"] for r in book.collect()), reverse=True)


def test_token_files_without_ids_or_rows(documents):
    files, book = token_output.write_token_files(documents([(None, "x"), (None, "y z"), (3, "x")]), BYTES)
    rows = sorted(token_output.read_token_files(files, book).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, None, 3] and rows[-1]["start"] == sum(r["n_tokens"] for r in rows[:2])
    assert token_output.read_token_files(*token_output.write_token_files(documents([]), BYTES)).count() == 0


def test_hot_ids_are_dealt_over_shards_in_order(documents):
    texts = [(None if k % 5 == 0 else 7 if k % 3 == 0 else k, prose(k, 20)) for k in range(300)]
    files, book = token_output.write_token_files(documents(texts), BYTES, shards=12)
    rows = sorted(token_output.read_token_files(files, book).collect(), key=lambda r: r["start"])
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in rows]
    assert order == sorted(order) and len(rows) == 300
    assert [r["start"] for r in rows] == np.cumsum([0, *[r["n_tokens"] for r in rows]])[:-1].tolist()
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) > 3 and len({r["shard"] for r in rows if r["doc_id"] == 7}) > 1
    assert sorted((r["doc_id"] or -1, r["ids_crc32"]) for r in rows) == sorted((k or -1, crc([*ids_of(BYTES, t), 0])) for k, t in texts)
    counts = np.zeros(60_000, np.int64)
    for _, t in texts:
        np.add.at(counts, [*ids_of(BYTES, t), 0], 1)
    assert {r["id"]: r["n"] for r in book.collect()} == {int(i): int(counts[i]) for i in np.flatnonzero(counts)}


def test_packing(documents, odd):
    texts = dict(odd + [(100 + k, prose(k, 40 + 9 * k)) for k in range(120)])
    rows = packing.digests(packing.pack(documents(list(texts.items())).repartition(3), WORDS)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert by_doc.keys() == texts.keys()
    for k, pieces in by_doc.items():
        ids, at = [*ids_of(WORDS, texts[k]), 1], 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    sizes = []
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        sizes.append(at)
    assert max(sizes) <= 2048 and len(sizes) <= sum(sizes) / 2048 + 2 * 3  # a task leaves less than a sequence or two


def test_windows_are_near_equal_and_grow_in_number():
    sizes = [900, 800, 700, 600, 500, 400, 300, 200, 100, 90, 80, 70]
    split = packing.differencing(sizes, 3)
    sums = [sum(sizes[i] for i in w) for w in split]
    assert sorted(i for w in split for i in w) == list(range(len(sizes))) and max(sums) - min(sums) <= 100
    assert len(packing.windows_of([1500, 1500, 1500], 2048)) == 3  # 4500 tokens would ask for three anyway; two can't share one
    assert len(packing.windows_of([1100, 1100, 1100], 2048)) == 3  # 3300 tokens ask for two, but then one exceeds the capacity
    assert packing.windows_of([], 2048) == []


def test_empty_tables(documents):
    assert packing.pack(documents([]), WORDS).count() == 0
    assert token_counts.token_counts(documents([]), BYTES).count() == 0


@pytest.mark.parametrize("path", [BYTES, WORDS, vocabulary("piece_bpe_32k.model")])
def test_token_counts(documents, odd, path):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t or ""))
    else:
        count = lambda t: len(ids_of(path, t))
    got = {r["doc_id"]: r for r in token_counts.token_counts(documents(odd), path, limit=1024).collect()}
    for k, t in odd:
        n = count(t)
        assert (got[k]["n_bytes"], got[k]["n_tokens"], got[k]["over_limit"]) == (len((t or "").encode()), n, n > 1024)


def test_whole_tokens_are_one_token():
    tok, whole = Tokenizer.from_file(BYTES), token_counts.whole_tokens(BYTES)
    assert len(whole) > 40000 and " the" in whole and "a b" not in whole
    assert all(len(e.ids) == 1 for e in tok.encode_batch(sorted(whole)[:2000], add_special_tokens=False))
