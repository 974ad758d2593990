"""Whole texts of Arrow batches as numpy arrays: bytes, word spans, span hashes.

Shared by the operators that look at every word. A batch is cut into slices of a few megabytes, so a task holds a few hundred
megabytes however many rows Spark puts into a batch; a text longer than a slice is one slice of its own and is never cut.
"""

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: odd multiplier of the polynomial over bytes, and its inverse modulo 2^64
P = 0x9E3779B97F4A7C15 | 1
P_INV = pow(P, -1, 1 << 64)
_BYTES = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
_POWERS = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: bytes of words that white space (blank, tab to carriage return) ends
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[9, 10, 11, 12, 13, 32]] = False
#: bytes of words made of digits, lower-case ASCII letters and everything beyond ASCII
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def powers(n):
    """p^0..p^n and the same of the inverse; kept, and grown by doubling."""
    if len(_POWERS.get("up", ())) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        for key, base in (("up", P), ("down", P_INV)):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            _POWERS[key] = np.cumprod(out)
    return _POWERS["up"], _POWERS["down"]


def mix(x):
    """Finisher of 64-bit hashes."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def text_arrays(column):
    """(bytes, offsets) of a string column; null counts as empty. No copy beyond Arrow's own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches, text="text", limit=SLICE_BYTES):
    """The batches in slices of about `limit` bytes of text, at least one row each."""
    for batch in batches:
        _, offsets = text_arrays(batch.column(batch.schema.get_field_index(text)))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, min(to, n) - at)
            at = to


def word_spans(data, offsets, inside):
    """starts, ends, and first word of each text (len + 1), of the maximal runs of bytes with inside[byte]."""
    on = np.zeros(len(data) + 2, dtype=bool)
    on[1:-1] = inside[data]
    # a text's first byte starts a new run although the text before it may end in a word
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(on[1:] & (~on[:-1] | edge))
    ends = np.flatnonzero(on[:-1] & (~on[1:] | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data, starts, ends):
    """A 64-bit hash of each span of bytes, the same wherever the span stands."""
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def window_hashes(words, size):
    """Hash of each run of `size` neighbouring word hashes (len - size + 1)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9FB21C651E98DF25) + words[k : k + n]
    return mix(out)


def per_text_windows(first, size):
    """For texts whose words start at first[i]: the global starts of their windows of `size` words, and the text of each."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    return ranges(first[:-1], counts), owner


def ranges(starts, counts):
    """starts[0], starts[0]+1, ... counts[0] of them, then those of the next."""
    counts = np.asarray(counts, dtype=np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, dtype=np.int64) - before, counts)
