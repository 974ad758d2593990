"""Token counts without encoding what is known to be one token.

Whole-token shortcut: `whole_tokens` proves, from the vocabulary alone, which of its strings are one pre-token and come out of the
merges as one token. Texts are cut into pre-tokens; those strings count one each, and only the other pre-tokens are merged, once
per worker for each distinct chunk.

Null and empty texts have 0 tokens. Rows are counted one by one, so repeated rows give repeated results. Extra columns are ignored.
"""

import os

import numpy as np
import pyarrow as pa
import regex

from . import chunks
from .textarrays import slices, text_arrays

#: how the byte-level vocabulary cuts texts (a fixed value of that vocabulary)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_STATE = {}


def byte_characters():
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in table:
            table[b], extra = chr(extra), extra + 1
    return table


def whole_tokens(path):
    """Strings of the vocabulary that are one pre-token and one token: the proof is made by encoding each alone."""
    tok = chunks.tokenizer(path)
    back = {c: b for b, c in byte_characters().items()}
    special, strings = set(chunks.special_strings(path)), []
    for piece in tok.get_vocab():
        if piece in special:
            continue
        try:
            s = bytes(back[c] for c in piece).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if regex.findall(PATTERN, s) == [s]:
            strings.append(s)
    return {s for s, got in zip(strings, tok.encode_batch_fast(strings, add_special_tokens=False)) if len(got.ids) == 1}


def _ask_counts(path):
    whole, merged, cut = whole_tokens(path), chunks.ask_ids(path), regex.compile(PATTERN)

    def ask(texts):
        counts, rest, owner = np.zeros(len(texts), np.uint32), [], []
        for k, t in enumerate(texts):
            for pre in cut.findall(t):
                if pre in whole:
                    counts[k] += 1
                else:
                    rest.append(pre)
                    owner.append(k)
        if rest:
            distinct = {p: i for i, p in enumerate(dict.fromkeys(rest))}
            sizes, _ = merged(list(distinct))
            np.add.at(counts, owner, sizes[[distinct[p] for p in rest]].astype(np.uint32))
        return np.ones(len(texts), np.int64), counts

    return ask


def _byte_level(path):
    import json

    with open(path, encoding="utf-8") as f:
        pre = json.load(f).get("pre_tokenizer") or {}
    return pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")


def counts_of(path, data, offsets):
    """Tokens of each text. Vocabularies that cut texts by another rule than PATTERN are asked text by text."""
    n, raw = len(offsets) - 1, data.tobytes()
    text = lambda k: raw[offsets[k] : offsets[k + 1]].decode("utf-8", "replace")
    if path.endswith(".model"):
        if path not in _STATE:
            import sentencepiece

            _STATE[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        return np.array([len(_STATE[path].encode(text(k), num_threads=1)) for k in range(n)], np.int64)
    if path not in _STATE:
        _STATE[path] = chunks.Known(_ask_counts(path), np.uint32) if _byte_level(path) else None
    known, tok = _STATE[path], chunks.tokenizer(path)
    if known is None:
        return chunks.text_ids(path, data, offsets)[1]
    out = np.zeros(n, np.int64)
    if len(data):
        starts, first = chunks.chunk_starts(data, offsets)
        entries = known.look_up(data, starts)
        sums = np.concatenate([[0], np.cumsum(known.values[known.first[entries]], dtype=np.int64)])
        out = np.diff(sums[first])
    for k in chunks.holding(data, offsets, chunks.special_strings(path)):
        out[k] = len(tok.encode(text(k), add_special_tokens=False).ids)
    return out


def token_counts(docs, path, limit=1024, id_column="doc_id", text="text"):
    """One row per row of docs: its id, n_bytes, n_tokens, over_limit."""
    docs = docs.select(id_column, text)

    def count(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for part in slices(batches, text):
            data, offsets = text_arrays(part.column(1))
            n = counts_of(path, data, offsets)
            yield pa.record_batch([part.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=[id_column, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.mapInArrow(count, f"`{id_column}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
