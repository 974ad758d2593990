"""Byte-level BPE by ranks: encoding through a segment tree of pair ranks, decoding by table.

A text falls into the matches of the vocabulary's pattern. A match that is a token itself gives its id. Any other is merged: the leaves
of a segment tree stand for its byte positions and hold the rank of the pair that the live token there forms with the next one; the root
holds the least rank and, among equal ones, the leftmost position. A merge changes three leaves (the token's own pair, the pair of the
token before, and the swallowed token's, which is gone), each a logarithmic update, so a match of n bytes takes n log n steps. Short
matches are merged many at a time, their trees side by side in numpy (`merge_many`), long ones alone (`merge`). A worker keeps the ids of
the matches it has met.

Defined cases: null and empty texts have no ids and decode to no bytes; texts are encoded whole, memory grows with the longest text
only. Rows are encoded one by one, so repeated rows give repeated results; a null or shared row id is carried as it is. Further columns
are ignored, whatever their names. An empty table gives an empty one.
"""

import base64
from array import array
from collections import defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from .chunks import Known, chunk_starts
from .textarrays import ranges, slices, text_arrays
from .token_counts import PATTERN

#: distinct matches whose ids a worker keeps before it begins anew, and matches looked at together in a long text
KEEP, PART = 1 << 20, 1 << 17
#: matches of up to so many bytes are merged side by side, so many at once
SHORT, TOGETHER = 64, 1 << 14
#: characters from which on a text's matches are read part by part instead of as one list
LONG_TEXT = 1 << 22
#: ids decoded at once
DECODED = 1 << 18
NONE = (1 << 63) - 1
_LOADED = {}


def load_ranks(path):
    """{token bytes: rank} of a file with one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge(piece, ranks):
    """The ids of one match: merges the leftmost pair of least rank until no pair has one."""
    n, rank = len(piece), ranks.get
    if n < 2:
        return [ranks[piece]] if n else []
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = array("q", [NONE]) * (2 * size)  # the rank above the position: the least is the leftmost of the least rank
    for at in range(n - 1):
        if (r := rank(piece[at : at + 2])) is not None:
            tree[size + at] = r << 32 | at
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(at, value):
        node = size + at
        tree[node] = value
        while node > 1:
            node >>= 1
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                return
            tree[node] = least

    def pair(at, to):
        return NONE if (r := rank(piece[at:to])) is None else r << 32 | at

    ends, before = array("q", range(1, n + 1)), array("q", range(-1, n))
    while tree[1] != NONE:
        at = tree[1] & 0xFFFFFFFF
        gone = ends[at]
        ends[at] = to = ends[gone]
        if gone < n - 1:
            put(gone, NONE)
        if to < n:
            before[to] = at
            put(at, pair(at, ends[to]))
        else:
            put(at, NONE)
        if (left := before[at]) >= 0:
            put(left, pair(left, to))
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : ends[at]]])
        at = ends[at]
    return out


class Pairs:
    """Ranks of pairs of tokens as sorted arrays."""

    def __init__(self, ranks):
        self.width = max(ranks.values()) + 1
        known = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    known[left * self.width + right] = rank
        self.keys = np.array(sorted(known), np.int64)
        self.ranks = np.array([known[k] for k in self.keys.tolist()], np.int64)
        self.bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)

    def leaves(self, left, right, at):
        """What a leaf holds for each pair of tokens at a position."""
        key = left * self.width + right
        place = np.searchsorted(self.keys, key)
        place[place == len(self.keys)] = 0
        found = self.keys[place] == key if len(self.keys) else np.zeros(len(key), bool)
        return np.where(found, self.ranks[place] << 32 | at if len(self.keys) else NONE, NONE)


def merge_many(pieces, pairs):
    """ids, as bytes of 32-bit numbers, of matches of 2 to SHORT bytes that have the same next power of two."""
    n, size = np.array([len(p) for p in pieces]), 1 << (len(pieces[0]) - 1).bit_length()
    count, all_of = len(pieces), np.arange(len(pieces))
    data = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(count, size).T
    token = pairs.bytes[data]
    if (token < 0).any():
        raise KeyError("a byte that is no token")
    tree = np.full((2 * size, count), NONE, np.int64)
    for at in range(size - 1):
        here = np.flatnonzero(n > at + 1)
        tree[size + at, here] = pairs.leaves(token[at, here], token[at + 1, here], at)
    for node in range(size - 1, 0, -1):
        np.minimum(tree[2 * node], tree[2 * node + 1], out=tree[node])
    after = np.repeat(np.arange(1, size + 2)[:, None], count, axis=1)
    before = np.repeat(np.arange(-1, size)[:, None], count, axis=1)
    live = np.arange(size)[:, None] < n

    def put(at, of, value):
        node = size + at
        tree[node, of] = value
        for _ in range(size.bit_length() - 1):
            node = node >> 1
            tree[node, of] = np.minimum(tree[2 * node, of], tree[2 * node + 1, of])

    of = all_of[tree[1] != NONE]
    while len(of):
        at = tree[1, of] & 0xFFFFFFFF
        token[at, of] = tree[1, of] >> 32
        gone = after[at, of]
        after[at, of] = to = after[gone, of]
        live[gone, of] = False
        before[to, of] = at
        put(gone, of, NONE)
        more = to < n[of]
        own = np.full(len(of), NONE, np.int64)
        own[more] = pairs.leaves(token[at[more], of[more]], token[to[more], of[more]], at[more])
        put(at, of, own)
        left = before[at, of]
        some = left >= 0
        left, at, some = left[some], at[some], of[some]
        put(left, some, pairs.leaves(token[left, some], token[at, some], left))
        of = of[tree[1, of] != NONE]
    ids = token.T[live.T].astype("<i4").tobytes()
    ends = 4 * np.cumsum(live.sum(axis=0))
    return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


class Encoder:
    """Ids of texts for one vocabulary and pattern."""

    def __init__(self, ranks, pattern, keep=KEEP):
        self.ranks, self.pairs, self.pattern, self.known, self.keep = ranks, Pairs(ranks), regex.compile(pattern), {}, keep

    def ids(self, texts):
        """The ids of each text, as bytes of 32-bit numbers."""
        found = [self.pattern.findall(t) if len(t) < LONG_TEXT else None for t in texts]
        self._learn({m for matches in found if matches for m in matches})
        out = [None if matches is None else self._joined(matches) for matches in found]
        return [self._alone(t) if ids is None else ids for t, ids in zip(texts, out)]

    def ask(self, texts):
        """Numbers of ids, and the ids of all texts one after another."""
        out = self.ids(texts)
        return np.array([len(ids) // 4 for ids in out], np.int64), np.frombuffer(b"".join(out), np.uint32)

    def _joined(self, matches):
        return b"".join(map(self.known.__getitem__, matches))

    def _alone(self, text):
        found, out = self.pattern.finditer(text), []
        while part := [m.group() for m in islice(found, PART)]:
            self._learn(set(part))
            out.append(self._joined(part))
        return b"".join(out)

    def _learn(self, matches):
        """Ids of all these matches are known afterwards."""
        new = [m for m in matches if m not in self.known]
        if len(self.known) + len(new) > self.keep:
            self.known.clear()
            new = list(matches)
        trees = defaultdict(list)
        for match in new:
            piece = match.encode()
            if (own := self.ranks.get(piece)) is not None:
                self.known[match] = own.to_bytes(4, "little")
            elif len(piece) <= SHORT:
                trees[(len(piece) - 1).bit_length()].append((match, piece))
            else:
                self.known[match] = array("i", merge(piece, self.ranks)).tobytes()
        for some in trees.values():
            for k in range(0, len(some), TOGETHER):
                part = some[k : k + TOGETHER]
                self.known.update(zip((m for m, _ in part), merge_many([p for _, p in part], self.pairs)))


def _ranks(path):
    if path not in _LOADED:
        _LOADED[path] = load_ranks(path)
    return _LOADED[path]


def _encoder(path, pattern):
    """bytes of texts and their offsets -> (ids, number of ids of each text).

    Where the pattern ends matches at lone blanks, texts are looked up by what stands between them, and only new such chunks are matched.
    """
    if pattern != PATTERN:
        encoder = Encoder(_ranks(path), pattern)

        def whole(data, offsets):
            raw = data.tobytes()
            counts, ids = encoder.ask([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
            return ids, counts

        return whole
    known = Known(Encoder(_ranks(path), pattern, keep=0).ask, np.uint32)

    def by_chunks(data, offsets):
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        starts, first = chunk_starts(data, offsets)
        ids, counts = known.runs(known.look_up(data, starts))
        return ids, np.diff(np.concatenate([[0], np.cumsum(counts)])[first])

    return by_chunks


def encode(docs, path, pattern, id_column="doc_id", text="text"):
    """One row per row of docs: its id, and ids (array of int) of its whole text, without special tokens."""
    docs = docs.select(id_column, text)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        ids_of = _LOADED.get((path, pattern)) or _LOADED.setdefault((path, pattern), _encoder(path, pattern))
        for part in slices(batches, text):
            ids, counts = ids_of(*text_arrays(part.column(1)))
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))], names=[id_column, "ids"])

    return docs.mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def decode(tokens, path, id_column="doc_id", ids="ids"):
    """tokens with the bytes that their ids stand for: the id column, ids, decoded (binary). Null ids decode to no bytes."""
    tokens = tokens.select(id_column, ids)
    kind = tokens.schema[id_column].dataType.simpleString()

    def table():
        if ("table", path) not in _LOADED:
            by_id = {r: token for token, r in _ranks(path).items()}
            sizes = np.array([len(by_id.get(k, b"")) for k in range(max(by_id) + 1)], np.int64)
            data = np.frombuffer(b"".join(by_id.get(k, b"") for k in range(len(sizes))), np.uint8)
            _LOADED["table", path] = data, np.cumsum(sizes) - sizes, sizes
        return _LOADED["table", path]

    def run(batches):
        data, starts, sizes = table()
        for batch in batches:
            out = []
            for row in batch.column(1):
                got = row.values.to_numpy() if row.is_valid else np.zeros(0, np.int32)
                out.append(b"".join(data[ranges(starts[part], sizes[part])].tobytes() for part in (got[k : k + DECODED] for k in range(0, len(got), DECODED))))
            yield pa.record_batch([*batch.columns, pa.array(out, pa.binary())], names=[id_column, "ids", "decoded"])

    return tokens.mapInArrow(run, f"`{id_column}` {kind}, ids array<int>, decoded binary")


def digests(decoded, id_column="doc_id"):
    """id, n_tokens, ids_sha256 (of the decimal ids, comma-joined) and decoded_sha256 of rows with ids and decoded."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(id_column, F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
