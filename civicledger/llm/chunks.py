"""Token ids of whole texts through chunks that repeat.

A text falls into chunks at a blank or line break that stands alone between two characters that are surely no white space. Both
byte-level and word-end vocabularies end a pre-token there, so the ids of a text are those of its chunks, one after another. A
worker asks the tokenizers library once for each distinct chunk and keeps the answer; texts that hold one of the vocabulary's
special strings go to the library whole.
"""

import os

import numpy as np

from .textarrays import mix, ranges, span_hashes

#: distinct chunks that a worker keeps before it begins anew
KEEP = 1 << 21
#: characters of missing chunks that make one string for the library
PIECE = 1 << 9

_SAFE_AFTER = np.zeros(256, dtype=bool)
_SAFE_AFTER[33:127] = True
# lead bytes of characters among which Unicode has no white space
_SAFE_AFTER[0xC3:0xE0] = _SAFE_AFTER[0xE4:0xF5] = True
_SAFE_BEFORE = np.zeros(256, dtype=bool)
_SAFE_BEFORE[33:127] = True
_TWO = np.zeros(256, dtype=bool)
_TWO[0xC3:0xE0] = True
_LATER = np.zeros(256, dtype=bool)
_LATER[0x80:0xC0] = True


def chunk_starts(data, offsets):
    """Where the chunks of the texts start, and the first chunk of each text (len + 1); an empty text has none."""
    cut = np.zeros(len(data) + 1, dtype=bool)
    if len(data) > 2:
        mid = data[1:-1]
        before = _SAFE_BEFORE[data[:-2]]
        before[1:] |= _LATER[data[1:-2]] & _TWO[data[:-3]]
        cut[1 : len(data) - 1] = ((mid == 32) | (mid == 10)) & before & _SAFE_AFTER[data[2:]]
    cut[offsets] = True
    cut[len(data)] = False
    starts = np.flatnonzero(cut)
    return starts, np.searchsorted(starts, offsets)


class Known:
    """What is known of distinct chunks: sorted hashes, and a run of values for each. Answers come from `ask(list of str)`."""

    def __init__(self, ask, dtype=np.uint16, keep=KEEP):
        self.ask, self.dtype, self.keep = ask, dtype, keep
        self.clear()

    def clear(self):
        self.hashes, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first, self.values, self.used, self.n = np.zeros(1, np.int64), np.zeros(0, self.dtype), 0, 0

    def look_up(self, data, starts):
        """For each chunk its entry's number; entries' values are at first[entry]..first[entry + 1]."""
        ends = np.append(starts[1:], len(data))
        h = span_hashes(data, starts, ends)
        order = np.argsort(h, kind="stable")
        ranked = h[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = ranked[1:] != ranked[:-1]
        distinct, where = ranked[new], order[new]
        if self.n + len(distinct) > self.keep:
            self.clear()
        at = np.searchsorted(self.hashes, distinct)
        at[at == len(self.hashes)] = 0
        missing = self.hashes[at] != distinct if len(self.hashes) else np.ones(len(distinct), dtype=bool)
        if missing.any():
            raw = data.tobytes()
            spans = where[missing]
            counts, values = self.ask([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[spans].tolist(), ends[spans].tolist())])
            self._add(distinct[missing], counts, values)
            at = np.searchsorted(self.hashes, distinct)
        entry = np.empty(len(h), np.int64)
        entry[order] = self.slot[at][np.cumsum(new) - 1]
        return entry

    def _add(self, hashes, counts, values):
        room = self.used + len(values)
        if room > len(self.values):
            self.values = np.concatenate([self.values[: self.used], np.zeros(max(room, 1 << 16), self.dtype)])
        self.values[self.used : room] = values
        self.first = np.concatenate([self.first, self.used + np.cumsum(counts)])
        self.used = room
        slots = np.arange(self.n, self.n + len(hashes))
        self.n += len(hashes)
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.slot = np.insert(self.hashes, at, hashes), np.insert(self.slot, at, slots)

    def runs(self, entries):
        """Values of the entries, one run after another, and the length of each run."""
        counts = self.first[entries + 1] - self.first[entries]
        return self.values[ranges(self.first[entries], counts)], counts


_LOADED = {}


def tokenizer(path):
    """The tokenizers library's object for a file, once per worker and on one thread."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def special_strings(path):
    return {t.content: i for i, t in tokenizer(path).get_added_tokens_decoder().items()}


def ask_ids(path):
    """Ids of many chunks: some are joined by a special string, whose id shows where one ends, and asked as one text."""
    tok = tokenizer(path)
    mark, mark_id = next(iter(special_strings(path).items()))

    def ask(chunks):
        pieces, at = [], 0
        while at < len(chunks):
            to, size = at, 0
            while to < len(chunks) and (to == at or size < PIECE):
                size += len(chunks[to])
                to += 1
            pieces.append(mark.join(chunks[at:to]))
            at = to
        counts, values = [], []
        for k in range(0, len(pieces), 256):
            for got in tok.encode_batch_fast(pieces[k : k + 256], add_special_tokens=False):
                ids = np.array(got.ids, dtype=np.uint32)
                own = ids != mark_id
                counts.append(np.diff(np.flatnonzero(np.concatenate([[True], ~own, [True]]))) - 1)
                values.append(ids[own])
        return np.concatenate(counts), np.concatenate(values)

    return ask


_IDS = {}


def text_ids(path, data, offsets):
    """ids (uint32) of the texts one after another, and the number of ids of each text, as the tokenizers library gives them."""
    if path not in _IDS:
        _IDS[path] = Known(ask_ids(path), np.uint32), list(special_strings(path))
    known, special = _IDS[path]
    n = len(offsets) - 1
    whole = holding(data, offsets, special)
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(n, np.int64)
    starts, first = chunk_starts(data, offsets)
    entries = known.look_up(data, starts) if not len(whole) else known.look_up(*_without(data, offsets, whole))
    if len(whole):
        return _mixed(path, known, data, offsets, whole, entries)
    ids, counts = known.runs(entries)
    ends = np.concatenate([[0], np.cumsum(counts)])
    return ids, np.diff(ends[first])


def holding(data, offsets, strings):
    """Numbers of the texts that hold one of the strings."""
    raw, found = data.tobytes(), set()
    for s in strings:
        s, at = s.encode(), 0
        while (at := raw.find(s, at)) >= 0:
            k = int(np.searchsorted(offsets, at, "right")) - 1
            if at + len(s) <= offsets[k + 1]:
                found.add(k)
            at += 1
    return sorted(found)


def _without(data, offsets, whole):
    """The bytes and chunk starts of the texts that are not asked whole."""
    keep = np.ones(len(offsets) - 1, dtype=bool)
    keep[whole] = False
    sizes = np.where(keep, np.diff(offsets), 0)
    data = data[ranges(offsets[:-1], sizes)]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return data, chunk_starts(data, offsets)[0] if len(data) else np.zeros(0, np.int64)


def _mixed(path, known, data, offsets, whole, entries):
    keep = np.ones(len(offsets) - 1, dtype=bool)
    keep[whole] = False
    sizes = np.where(keep, np.diff(offsets), 0)
    own = np.concatenate([[0], np.cumsum(sizes)])
    short = data[ranges(offsets[:-1], sizes)]
    first = chunk_starts(short, own)[1] if len(short) else np.zeros(len(own), np.int64)
    ids, counts = known.runs(entries)
    ends = np.concatenate([[0], np.cumsum(counts)])
    totals = np.diff(ends[first])
    out, raw, asked = [], data.tobytes(), set(whole)
    for k in range(len(totals)):
        if k in asked:
            got = np.array(tokenizer(path).encode(raw[offsets[k] : offsets[k + 1]].decode("utf-8", "replace"), add_special_tokens=False).ids, dtype=np.uint32)
            totals[k] = len(got)
            out.append(got)
        else:
            out.append(ids[ends[first[k]] : ends[first[k + 1]]])
    return np.concatenate(out) if out else ids, totals


__all__ = ["Known", "chunk_starts", "holding", "mix", "special_strings", "text_ids", "tokenizer"]
