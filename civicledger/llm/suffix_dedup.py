"""Repeated passages by the windows round sparse suffixes.

Of all suffixes (in words) those are kept that start at a minimiser: the place with the least hash of GRAM words among WINDOW neighbouring
places. Every passage of LENGTH words has one among its first WINDOW places, the same one wherever the passage stands, and at
least LENGTH - WINDOW + 1 words follow it inside the passage. Where another text has a suffix that begins with the same words, the passages
of LENGTH words of which the suffix's start is the minimiser are looked at one by one: each is a hash, counted over all texts. A
passage that two texts hold is a repeat, and overlapping or touching repeats of a text are one. So every passage of LENGTH words that stands in
two texts is found, whatever the texts have before and after it; only 64-bit hashes are compared, not the words themselves.

Equal texts collapse before: each is one repeat as a whole. A passage in very many texts is one hash with one count, whose partial results
are made where the texts are read.

What a text repeats in itself is found while it is read, from the hashes of all its passages of LENGTH words.

Words are lower-cased (A-Z) and end at white space. Null texts and those of fewer than LENGTH words have no passage. Rows with a null id
are reported under it. Repeated rows are equal texts; of equal ids none is the first for certain. Extra columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from civicledger.session import stored

from .textarrays import LOWER, NOT_BLANK, mix, per_text_windows, powers, slices, span_hashes, text_arrays, window_hashes, word_spans

LENGTH, GRAM, WINDOW = 50, 8, 26
SHARED = LENGTH - WINDOW + 1
#: texts, and hashes of repeated passages, that may be sent to all tasks; beyond it they are joined by a shuffle
SENT_TEXTS = SENT_PASSAGES = 1_000_000


def words_of(column):
    data, offsets = text_arrays(column)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, NOT_BLANK)
    return span_hashes(data, starts, ends), first


def minimiser_of(grams, at):
    """The minimiser of the passage that starts at each of the places."""
    return at + np.argmin(np.lib.stride_tricks.sliding_window_view(grams, WINDOW)[at], axis=1)


def minimisers(words, first):
    """Places of the kept suffixes, with SHARED words inside the text behind each."""
    at, _ = per_text_windows(first, LENGTH)
    return np.unique(minimiser_of(window_hashes(words, GRAM), at)) if len(at) else at


def passage_hashes(words, at):
    """Hash of the LENGTH words from each of the places on."""
    up, down = powers(len(words))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[at + LENGTH] - total[at]) * down[at])


def own_repeats(words, first):
    """Spans (text, a, b) covered by passages of LENGTH words that their text holds twice, also overlapping."""
    at, owner = per_text_windows(first, LENGTH)
    up, down = powers(len(words))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    h = mix((total[at + LENGTH] - total[at]) * down[at] + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    mark = np.zeros(len(words) + 1, np.int64)
    twice = np.unique(at[np.concatenate([order[1:][same], order[:-1][same]])]) if same.any() else at[:0]
    mark[twice] += 1
    mark[twice + LENGTH] -= 1
    covered = np.concatenate([[False], np.cumsum(mark[:-1]) > 0, [False]])
    edge = np.zeros(len(words) + 1, dtype=bool)
    edge[first] = True
    a, b = np.flatnonzero(covered[1:] & (~covered[:-1] | edge)), np.flatnonzero(covered[:-1] & (~covered[1:] | edge))
    owner = np.searchsorted(first, a, "right") - 1
    return owner, a - first[owner], b - first[owner]


def suffixes(docs, id_column="doc_id", text="text"):
    """Per row: id, fp (hash of the text), n (words), for each kept suffix h (hash of its SHARED words) and its place, and own_repeats."""
    kind = docs.schema[id_column].dataType.simpleString()

    def find(batches):
        for part in slices(batches, text):
            words, first = words_of(part.column(1))
            at = minimisers(words, first)
            h = np.zeros(len(at), np.uint64)
            for k in range(SHARED):
                h = h * np.uint64(0x9FB21C651E98DF25) + words[at + k]
            owner = np.searchsorted(first, at, "right") - 1
            bounds = pa.array(np.searchsorted(owner, np.arange(len(first))), pa.int32())
            text_of, a, b = own_repeats(words, first)
            own = pa.StructArray.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["a", "b"])
            own = pa.ListArray.from_arrays(pa.array(np.searchsorted(text_of, np.arange(len(first))), pa.int32()), own)
            yield pa.record_batch([part.column(0), part.column(2), pa.array(np.diff(first)), pa.ListArray.from_arrays(bounds, pa.array(mix(h).view(np.int64))),
                                   pa.ListArray.from_arrays(bounds, pa.array((at - first[owner]).astype(np.int32))), own], names=[id_column, "fp", "n", "h", "place", "own"])

    return docs.select(id_column, text, F.xxhash64(text).alias("fp")).mapInArrow(find, f"`{id_column}` {kind}, fp bigint, n bigint, h array<bigint>, place array<int>, own array<struct<a:int,b:int>>")


def passages(docs, places, id_column="doc_id", text="text"):
    """(fp, least_id, w, start): for each text the hashes and first words of its passages whose minimiser is one of its places."""
    kind = docs.schema[id_column].dataType.simpleString()

    def cut(batches):
        for part in slices(batches, text):
            words, first = words_of(part.column(2))
            at, owner = per_text_windows(first, LENGTH)
            held = np.zeros(len(words) + 1, dtype=bool)
            found = part.column(3)
            held[found.flatten().to_numpy() + np.repeat(first[:-1], found.value_lengths().to_numpy())] = True
            if len(at):
                on = held[minimiser_of(window_hashes(words, GRAM), at)]
                at, owner = at[on], owner[on]
            bounds = pa.array(np.searchsorted(owner, np.arange(len(first))), pa.int32())
            w = passage_hashes(words, at).view(np.int64)
            yield pa.record_batch([*part.columns[:2], pa.ListArray.from_arrays(bounds, pa.array(w)), pa.ListArray.from_arrays(bounds, pa.array((at - first[owner]).astype(np.int32)))],
                                  names=["fp", "least_id", "w", "start"])

    texts = docs.select(F.xxhash64(text).alias("fp"), F.col(id_column).alias("own id"), text)
    needed = places.select("fp").distinct()
    if needed.count() <= SENT_TEXTS:
        texts = texts.join(F.broadcast(needed), "fp", "left_semi")
    # one of the equal texts is enough
    texts = texts.groupBy("fp").agg(F.min("own id").alias("least_id"), F.first(text).alias(text)).join(places, "fp").select("fp", "least_id", text, "found")
    return texts.mapInArrow(cut, f"fp bigint, least_id {kind}, w array<bigint>, start array<int>")


def islands(rows):
    """(fp, spans) from rows (fp, at: spans that may overlap or touch): a span is first if all that it is made of are."""

    def merge(batches):
        for batch in batches:
            out = []
            for at in batch.column(1):
                a, b, first = (at.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                order = np.argsort(a, kind="stable")
                a, b, first = a[order], np.maximum.accumulate(b[order]), first[order]
                new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
                ends = b[np.concatenate([new[1:], [len(a)]]) - 1]
                out.append([{"a": x, "b": y, "first": z} for x, y, z in zip(a[new].tolist(), ends.tolist(), np.logical_and.reduceat(first, new).tolist())])
            yield pa.record_batch([batch.column(0), pa.array(out, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("first", pa.bool_())])))], names=["fp", "spans"])

    return rows.mapInArrow(merge, "fp bigint, spans array<struct<a:int,b:int,first:boolean>>")


def repeats(docs, id_column="doc_id", text="text"):
    """One row per repeated passage of a row of docs: its id, start_word, end_word (not included), n_words, whole_text (equal texts exist),
    first (no text with a smaller id holds what is repeated in it)."""
    base = stored(suffixes(docs, id_column, text), "suffixes")
    each = base.select(id_column, "fp", F.explode(F.arrays_zip("h", "place")).alias("x")).select(id_column, "fp", "x.h", "x.place")
    held = each.groupBy("h").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least <> most").select("h")
    places = each.join(held, "h").select("fp", "place").distinct().groupBy("fp").agg(F.collect_list("place").alias("found"))
    places = stored(places, "places")
    found = stored(passages(docs, places, id_column, text), "passages")
    # a passage in two texts: its first text is the one with the least id
    text_of = F.struct("least_id", "fp")
    shared = found.select("fp", "least_id", F.explode("w").alias("w")).groupBy("w").agg(F.min(text_of).alias("f"), F.max(text_of).alias("other")).where("f.fp <> other.fp")
    shared = stored(shared.select("w", F.col("f.fp").alias("first_fp")), "shared-passages")
    small = F.broadcast if shared.count() <= SENT_PASSAGES else (lambda side: side)
    matches = found.select("fp", F.explode(F.arrays_zip("w", "start")).alias("x")).select("fp", "x.w", F.col("x.start").alias("a")).join(small(shared), "w")
    matches = matches.select("fp", "a", (F.col("a") + LENGTH).alias("b"), (F.col("first_fp") == F.col("fp")).alias("first"))

    # equal texts: how many rows, the least id
    texts = base.groupBy("fp", "n").agg(F.count("*").alias("copies"), F.min(id_column).alias("least_id"))
    within = base.where(F.size("own") > 0).select("fp", F.explode("own").alias("x")).select("fp", "x.a", "x.b", F.lit(True).alias("first")).distinct()
    spans = islands(matches.union(within).groupBy("fp").agg(F.collect_list(F.struct("a", "b", "first")).alias("at")))  # no more than a text has words
    told = texts.join(spans, "fp", "left").where(F.col("spans").isNotNull() | (F.col("copies") > 1) & (F.col("n") >= LENGTH))
    rows = base.select(id_column, "fp", "n").join(told.select("fp", "copies", "least_id", "spans"), "fp")
    whole = (F.col("copies") > 1) & (F.col("n") >= LENGTH)
    one = F.array(F.struct(F.lit(0).alias("a"), F.col("n").cast("int").alias("b"), F.lit(True).alias("first")))
    rows = rows.withColumn("whole_text", whole).withColumn("s", F.explode(F.when(whole, one).otherwise(F.col("spans"))))
    is_first = F.when(F.col("whole_text"), F.col(id_column) == F.col("least_id")).otherwise(F.col("s.first"))
    return rows.select(id_column, F.col("s.a").cast("bigint").alias("start_word"), F.col("s.b").cast("bigint").alias("end_word"), (F.col("s.b") - F.col("s.a")).cast("bigint").alias("n_words"), "whole_text", is_first.alias("first"))


def brute_force(docs, length=LENGTH):
    """For tests: {id: words inside a passage of `length` words that stands in another place too} of (id, text) pairs."""
    import re
    from collections import defaultdict

    words = {k: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or "")) for k, t in docs}
    seen = defaultdict(list)
    for k, w in words.items():
        for i in range(len(w) - length + 1):
            seen[tuple(w[i : i + length])].append((k, i))
    out = {k: set() for k in words}
    for found in seen.values():
        if len(found) > 1:
            for k, i in found:
                out[k].update(range(i, i + length))
    return out
