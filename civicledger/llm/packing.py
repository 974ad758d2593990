"""Packing documents into sequences by multiway differencing.

Every task packs the documents it reads, so nothing is shuffled. What a document has in full sequences is cut off first: such a
sequence is full by itself. The rests are gathered into groups of WINDOWS sequences, in pieces of half a sequence at most and, towards the
end of a group, of a SHARE of what it still takes, so that ever shorter pieces are there to level the windows. Each group is split into windows by Karmarkar-Karp differencing: every piece begins as a partial partition with one filled window, and the
two partitions with the widest spread are merged again and again, the fullest window of one with the emptiest of the other, until
one partition with near-equal windows is left. Where a window exceeds the capacity, the group is split into one window more.

A task recomputed after a loss reads the same split and gives the same rows. Null and empty texts hold only the end id. Repeated rows
are packed one by one; an empty table gives no rows; extra columns are ignored. A null id is kept as it is.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from . import chunks
from .textarrays import slices, text_arrays

CAPACITY = 2048
WINDOWS = 16
#: a piece takes at most this part of what its group still has room for
SHARE = 16


def differencing(sizes, k):
    """k lists of the numbers of the sizes, their sums near equal."""
    if not len(sizes):
        return [[] for _ in range(k)]
    heap = []
    for i, size in enumerate(sizes):
        heap.append((-size, i, [(size, i)] + [(0, None)] * (k - 1)))
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # fullest with emptiest; what all windows hold alike doesn't matter for the spread
        merged = sorted(((x + y, p if q is None else q if p is None else (p, q)) for (x, p), (y, q) in zip(a, reversed(b))), key=_sum, reverse=True)
        low = merged[-1][0]
        if low:
            merged = [(x - low, p) for x, p in merged]
        heapq.heappush(heap, (-merged[0][0], serial, merged))
        serial += 1
    return [sorted(_leaves(p)) for _, p in heap[0][2]]


def _sum(window):
    return window[0]


def _leaves(tree):
    out, todo = [], [tree]
    while todo:
        t = todo.pop()
        if isinstance(t, tuple):
            todo.extend(t)
        elif t is not None:
            out.append(t)
    return out


def windows_of(sizes, capacity=CAPACITY):
    """Windows of at most `capacity` for pieces of at most `capacity`: as few as the total asks for, or more until none exceeds it."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        split = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in split):
            return [w for w in split if w]
        k += 1


def pack(docs, path, end_id=1, capacity=CAPACITY, id_column="doc_id", text="text"):
    """One row per piece: id, start and length in its document, doc_tokens, sequence_id, offset in the sequence, ids (uint32, little-endian)."""
    docs = docs.select(id_column, text)
    kind = docs.schema[id_column].dataType.simpleString()
    names = [id_column, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    room = WINDOWS * capacity

    def pieces(batches):
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 36
        key_type, group, held, out = None, [], 0, []

        def close():
            nonlocal sequence, group, held
            for window in windows_of([len(p[3]) for p in group], capacity):
                at = 0
                for i in window:
                    key, start, total, ids = group[i]
                    out.append((key, start, len(ids), total, sequence, at, ids.tobytes()))
                    at += len(ids)
                sequence += 1
            group, held = [], 0

        def flush():
            columns = list(zip(*out)) or [()] * 7
            out.clear()
            return pa.record_batch([pa.array(columns[0], key_type), *(pa.array(c, pa.int64()) for c in columns[1:6]), pa.array(columns[6], pa.binary())], names=names)

        for part in slices(batches, text):
            key_type = part.column(0).type
            data, offsets = text_arrays(part.column(1))
            ids, counts = chunks.text_ids(path, data, offsets)
            ends = np.concatenate([[0], np.cumsum(counts)])
            for i, key in enumerate(part.column(0).to_pylist()):
                own = np.append(ids[ends[i] : ends[i + 1]], np.uint32(end_id)).astype("<u4")
                full = len(own) // capacity * capacity
                for start in range(0, full, capacity):
                    out.append((key, start, capacity, len(own), sequence, 0, own[start : start + capacity].tobytes()))
                    sequence += 1
                at = full
                while at < len(own):
                    to = min(len(own), at + min(max(1, capacity // 2), max(1, (room - held) // SHARE)))
                    group.append((key, at, len(own), own[at:to]))
                    held, at = held + to - at, to
                    if held >= room:
                        close()
            yield flush()
        if group:
            close()
            yield flush()

    return docs.mapInArrow(pieces, f"`{id_column}` {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")


def digests(packed, id_column="doc_id"):
    return packed.select(id_column, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
