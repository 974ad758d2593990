"""Benchmark passages in documents by multi-pattern search after Wu and Manber, over words.

Patterns are the windows of 10 words of each benchmark item (one shorter window for a shorter item). For the patterns of one length a
shift table says, for each block of two neighbouring words, how far a window ending in that block may move on without skipping an
occurrence; blocks of no pattern allow the longest move. Where the move is 0, the block's bucket names the patterns that end in it,
and their words are compared one by one. A task scans many segments of its texts side by side, one numpy step moving all of them.

The benchmark is taken in blocks of at most BLOCK_BYTES of text; each block is sent to the tasks (a checked size) and is one pass over
the rows as they stream by, so a larger benchmark costs passes, not memory. Nothing is shuffled.

A null or wordless text has no words and is clean; items without words match nothing; rows repeated in either table count one by one
(an item's id once). Items without an id are searched like the others; together they are one item, null, at the end of a document's
items. Extra columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .textarrays import ALNUM, LOWER, ranges, slices, span_hashes, text_arrays, window_hashes, word_spans

WINDOW = 10
BLOCK_BYTES = 4 << 20
SEGMENT = 128
TABLE_BITS = 18


def words_of(column):
    data, offsets = text_arrays(column)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, ALNUM)
    return data, starts, ends, first, span_hashes(data, starts, ends)


class Patterns:
    """The patterns of one length with their shift table and buckets."""

    def __init__(self, words, texts, items):
        """words: a row of word hashes for each pattern; texts: the words themselves; items: numbers of the items of each pattern."""
        self.m = words.shape[1]
        self.block = min(2, self.m)
        self.longest = self.m - self.block + 1
        self.shift = np.full(1 << TABLE_BITS, self.longest, np.uint8)
        last = None
        for j in range(self.longest):
            h = _joined(words[:, j : j + self.block])
            np.minimum.at(self.shift, (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64), np.uint8(self.longest - 1 - j))
            last = h
        order = np.argsort(last, kind="stable")
        self.suffix, self.words = last[order], words[order]
        self.texts, self.items = [texts[i] for i in order], [items[i] for i in order]


def _joined(columns):
    return window_hashes(np.ascontiguousarray(columns).reshape(-1), columns.shape[1])[:: columns.shape[1]]


def patterns_of(items, window=WINDOW):
    """Tables for all lengths that occur, from (item_id, text) pairs."""
    data, starts, ends, first, hashes = words_of(pa.array([t for _, t in items], pa.string()))
    raw, by_length = data.tobytes(), {}
    for i in range(len(items)):
        n = int(first[i + 1] - first[i])
        m = min(n, window)
        for at in range(first[i], first[i] + n - m + 1) if n else ():
            text = tuple(raw[starts[k] : ends[k]] for k in range(at, at + m))
            own = by_length.setdefault(m, {}).setdefault(text, (hashes[at : at + m], set()))
            own[1].add(i)
    return [Patterns(np.array([h for h, _ in own.values()]), list(own), [sorted(s) for _, s in own.values()]) for own in by_length.values()]


def occurrences(p, data, starts, ends, first, hashes):
    """(first word of the occurrence, number of its pattern), all of them."""
    counts = np.diff(first)
    lasts = first[1:] - p.m  # last start of a window in each text
    n_segments = np.maximum(-(-(counts - p.m + 1) // SEGMENT), 0)
    owner = np.repeat(np.arange(len(counts)), n_segments)
    if not len(owner):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = first[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(n_segments) - n_segments, n_segments)) * SEGMENT
    stop = np.minimum(at + SEGMENT, lasts[owner] + 1)
    blocks = window_hashes(hashes, p.block)
    moves = p.shift[(blocks >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
    found = []
    while len(at):
        move = moves[at + p.longest - 1]
        zero = move == 0
        if zero.any():
            found.append(at[zero])
        at = at + np.maximum(move, 1)
        on = at < stop
        if not on.all():
            at, stop = at[on], stop[on]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.concatenate(found)
    suffix = blocks[at + p.longest - 1]
    low, high = np.searchsorted(p.suffix, suffix, "left"), np.searchsorted(p.suffix, suffix, "right")
    at, which = np.repeat(at, high - low), ranges(low, high - low)
    same = np.ones(len(at), dtype=bool)
    for j in range(p.m):
        same[same] = hashes[at[same] + j] == p.words[which[same], j]
    at, which = at[same], which[same]
    raw = memoryview(data)
    sure = np.array([all(bytes(raw[starts[a + j] : ends[a + j]]) == w for j, w in enumerate(p.texts[k])) for a, k in zip(at.tolist(), which.tolist())], dtype=bool)
    return at[sure], which[sure]


def _blocks(benchmark, item_id, text):
    """The items in blocks of bounded size, in order of their ids, each brought to the driver alone."""
    sized = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where("t is not null")
    total = sized.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-int(total) // BLOCK_BYTES))
    for k in range(n):
        own = sized if n == 1 else sized.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r["i"], r["t"]) for r in own.collect()]


def contaminated(docs, benchmark, window=WINDOW, id_column="doc_id", text="text", item_id="item_id", item_text="text"):
    """One row per row of docs: its id, n_words, n_hit (words inside an occurrence), items (sorted ids of items found, null last), spans of hit words.

    spans are pairs of word numbers, the end not included.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    out = docs.select(id_column, text).withColumns({"spans": F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)"), "items": F.expr("cast(array() as array<string>)"), "n_words": F.lit(0).cast("bigint")})
    for items in _blocks(benchmark, item_id, item_text):
        sent = docs.sparkSession.sparkContext.broadcast((patterns_of(items, window), [i for i, _ in items]))

        def scan(batches, sent=sent):
            tables, ids = sent.value
            for part in slices(batches, text):
                data, starts, ends, first, hashes = words_of(part.column(1))
                mark, found = np.zeros(len(starts) + 1, np.int64), [set(x) for x in part.column(3).to_pylist()]
                for k, spans in enumerate(part.column(2).to_pylist()):
                    for s in spans:
                        mark[first[k] + s["a"]] += 1
                        mark[first[k] + s["b"]] -= 1
                for p in tables:
                    at, which = occurrences(p, data, starts, ends, first, hashes)
                    np.add.at(mark, at, 1)
                    np.add.at(mark, at + p.m, -1)
                    owner = np.searchsorted(first, at, "right") - 1
                    for k, w in {*zip(owner.tolist(), which.tolist())}:
                        found[k].update(ids[i] for i in p.items[w])
                hit = np.concatenate([[False], np.cumsum(mark[:-1]) > 0, [False]])
                edge = np.zeros(len(starts) + 1, dtype=bool)
                edge[first] = True
                a = np.flatnonzero(hit[1:] & (~hit[:-1] | edge))
                b = np.flatnonzero(hit[:-1] & (~hit[1:] | edge))
                owner = np.searchsorted(first, a, "right") - 1
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(first))), pa.int32()),
                                                 pa.StructArray.from_arrays([pa.array(a - first[owner]), pa.array(b - first[owner])], names=["a", "b"]))
                yield pa.record_batch([*part.columns[:2], spans, pa.array([sorted(x, key=lambda i: (i is None, i)) for x in found], pa.list_(pa.string())), pa.array(np.diff(first))],
                                      names=[id_column, text, "spans", "items", "n_words"])

        out = out.mapInArrow(scan, f"`{id_column}` {kind}, `{text}` string, spans array<struct<a:bigint,b:bigint>>, items array<string>, n_words bigint")
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["b"] - s["a"])
    return out.select(id_column, "n_words", n_hit.alias("n_hit"), "items", "spans")


def digests(found, id_column="doc_id"):
    return found.select(id_column, "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def brute_force(docs, items, window=WINDOW):
    """The same by definition, for tests: docs and items are (id, text) pairs."""
    import re

    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))
    own = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            own.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    for key, t in docs:
        w, hit, found = split(t), set(), set()
        for m in {len(p) for p in own}:
            for k in range(len(w) - m + 1):
                if (p := tuple(w[k : k + m])) in own:
                    hit.update(range(k, k + m))
                    found |= own[p]
        yield key, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)
