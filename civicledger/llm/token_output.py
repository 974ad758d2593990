"""Token ids in files: frequency-ranked, byte-aligned, with control bytes apart from data bytes.

The most frequent id of the corpus gets rank 0, so that frequent ids take one byte. Each rank is written with as few of one to four
little-endian bytes as it needs; two bits per rank, four ranks to a control byte, hold the number of bytes less one. Both streams of
a document are columns of one row, and a codebook beside the rows gives the id of each rank. Reading looks the lengths of four ranks
up in a table by their control byte and gathers the data bytes.

Texts are encoded once: their ids go, compressed, to shards of the id's range, are stored in order, and rewritten as ranks. Every
encoding task adds one row with its counts of all ids, so the codebook is made without a pass over the ids.

Null and empty texts hold only the end id. Rows without a document id come first, in shards of their own (NULL_SHARDS, dealt by the
text); rows with the same id stand together, and an id of very many rows fills several shards. Among equal ids the order is that of
the shard, then of the compressed ids. An empty table gives no rows. Extra columns are ignored.
"""

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Window
from pyspark.sql import functions as F

from civicledger.session import stored

from . import chunks
from .textarrays import SLICE_BYTES, slices, text_arrays

#: bytes that each of the four ranks of a control byte takes
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.int64)


def encode_ranks(ranks):
    """(control bytes, data bytes) of ranks."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    codes = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    four = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    four[: len(ranks)] = codes
    control = (four.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    taken = np.arange(4, dtype=np.uint8) <= codes[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[taken].tobytes()


def decode_ranks(control, data, n):
    """The n ranks of two streams."""
    sizes = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(sizes)
    data = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)]).astype(np.uint32)
    at, out = ends - sizes, np.zeros(n, np.uint32)
    for k in range(4):
        more = sizes > k
        if not more.any():
            break
        out[more] |= data[at[more] + k] << np.uint32(8 * k)
    return out


NULL_SHARDS = 8


def _cuts(docs, key, n):
    """n - 1 quantiles of all ids, one that many rows have several times."""
    if n == 1:
        return np.zeros(0, np.int64)
    cuts = docs.agg(F.percentile_approx(F.col(key), [k / n for k in range(1, n)], 10000).alias("c")).first()["c"]
    return np.array(cuts or [], dtype=np.int64)


def shards_of(keys, cuts, spread):
    """A shard for each id: those without one first, then by the cuts; an id that is a cut more than once is dealt by `spread`."""
    filled = keys.fill_null(0).to_numpy(zero_copy_only=False)
    low, high = np.searchsorted(cuts, filled, "left"), np.searchsorted(cuts, filled, "right")
    # equal cuts leave shards between them that hold this id only, so any of those keeps the order
    inner = np.maximum(high - low, 1)
    own = low + spread % inner
    return np.where(keys.is_null().to_numpy(zero_copy_only=False), spread % NULL_SHARDS, NULL_SHARDS + own).astype(np.int32)


def tokenized(docs, path, end_id, id_column="doc_id", text="text", shards=None):
    """Stored rows (shard, id, n_tokens, ids compressed, counts, position) in order of the shard and the id within each shard's file.

    position rises in each shard's file. A row with counts (compressed, by id) stands for a task and for no document.
    """
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id_column].dataType.simpleString()
    cuts = _cuts(docs, id_column, n)
    names = ["shard", id_column, "n_tokens", "ids", "counts"]

    def ids_of(batches):
        pack, total, key = zstandard.ZstdCompressor(level=3), np.zeros(1, np.int64), None
        for part in slices(batches, text):
            data, offsets = text_arrays(part.column(1))
            ids, counts = chunks.text_ids(path, data, offsets)
            total = _added(total, np.bincount(ids))
            total = _added(total, np.bincount([end_id], [len(counts)]).astype(np.int64))
            ends = np.concatenate([[0], np.cumsum(counts)])
            rows = [pack.compress(_narrow(np.append(ids[a:b], np.uint32(end_id)))) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            key = part.column(0)
            spread = np.array([zlib.crc32(r) for r in rows], np.int64)
            shard = shards_of(key, cuts, spread)
            yield pa.record_batch([pa.array(shard), key, pa.array(counts + 1), pa.array(rows, pa.binary()), pa.nulls(len(rows), pa.binary())], names=names)
        if key is not None:
            yield pa.record_batch([pa.array(shard[:1]), pa.nulls(1, key.type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([pack.compress(total.tobytes())], pa.binary())], names=names)

    out = docs.select(id_column, text).mapInArrow(ids_of, f"shard int, `{id_column}` {kind}, n_tokens bigint, ids binary, counts binary")
    placed = out.repartitionById(len(cuts) + 1 + NULL_SHARDS, "shard").sortWithinPartitions("shard", F.col(id_column).asc_nulls_first(), "ids")
    return stored(placed.withColumn("position", F.monotonically_increasing_id()), "token-ids")


def _added(total, more):
    if len(more) > len(total):
        total = np.concatenate([total, np.zeros(len(more) - len(total), np.int64)])
    total[: len(more)] += more
    return total


def _narrow(ids):
    """Two bytes an id where that is enough, else four, behind a byte that says which."""
    return b"\2" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\4" + ids.astype("<u4").tobytes()


def _wide(raw):
    raw = zstandard.ZstdDecompressor().decompress(raw)
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.uint32)


def codebook(tokens):
    """(id, n) of every id that occurs, added up from the counts of the tasks: no more rows than the vocabulary has."""

    def listed(batches):
        for batch in batches:
            for raw in batch.column(0):
                got = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw.as_py()), np.int64)
                used = np.flatnonzero(got)
                yield pa.record_batch([pa.array(used.astype(np.int64)), pa.array(got[used])], names=["id", "n"])

    return tokens.where("counts is not null").select("counts").mapInArrow(listed, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(docs, path, end_id=0, id_column="doc_id", text="text", shards=None):
    """Writes the files; returns (files, codebook), two tables read back from the shared folder.

    files: shard, the id column, n_tokens, position (rises in the file of a shard), control, data. codebook: id, n, rank.
    """
    tokens = tokenized(docs, path, end_id, id_column, text, shards)
    spark, kind = docs.sparkSession, docs.schema[id_column].dataType.simpleString()
    book = sorted(((-r["n"], r["id"]) for r in codebook(tokens).toLocalIterator()))  # bounded by the vocabulary
    ranked = np.array([i for _, i in book] or [0], dtype=np.int64)
    rank_of = np.zeros(int(ranked.max()) + 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)
    rank_of = spark.sparkContext.broadcast(rank_of)

    def rank(batches):
        for batch in batches:
            for part in slices_of_bytes(batch, 4):
                streams = [encode_ranks(rank_of.value[_wide(raw.as_py())]) for raw in part.column(4)]
                yield pa.record_batch([*part.columns[:4], pa.array([c for c, _ in streams], pa.binary()), pa.array([d for _, d in streams], pa.binary())],
                                      names=["shard", id_column, "n_tokens", "position", "control", "data"])

    rows = tokens.where("counts is null").select("shard", id_column, "n_tokens", "position", "ids")
    files = rows.mapInArrow(rank, f"shard int, `{id_column}` {kind}, n_tokens bigint, position bigint, control binary, data binary")
    table = spark.createDataFrame([(i, -n, k) for k, (n, i) in enumerate(book)], "id long, n long, rank long")
    return stored(files, "token-files"), stored(table.coalesce(1), "token-codebook")


def slices_of_bytes(batch, column, limit=SLICE_BYTES):
    """A batch in slices of about `limit` bytes of a binary column, a row each at least."""
    sizes = batch.column(column).cast(pa.large_binary())
    offsets = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1] if len(sizes) else np.zeros(1, np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, min(to, batch.num_rows) - at)
        at = to


def read_token_files(files, book, id_column="doc_id"):
    """One row per document from the files: its id, start (ids of all documents before it), n_tokens, ids_crc32, shard.

    `start` follows the documents' positions in the files: a running sum in each shard plus the totals of the shards before; only the
    totals, one row a shard, meet in one task.
    """
    spark, kind = files.sparkSession, files.schema[id_column].dataType.simpleString()
    ids = np.zeros(book.count() or 1, np.uint32)
    for r in book.toLocalIterator():
        ids[r["rank"]] = r["id"]
    ids = spark.sparkContext.broadcast(ids)

    def decode(batches):
        for batch in batches:
            for part in slices_of_bytes(batch, 5):
                got = [ids.value[decode_ranks(c.as_py(), d.as_py(), n)].astype("<u4").tobytes() for c, d, n in zip(part.column(4), part.column(5), part.column(2).to_pylist())]
                yield pa.record_batch([*part.columns[:4], pa.array([zlib.crc32(g) for g in got], pa.int64())], names=["shard", id_column, "n_tokens", "position", "ids_crc32"])

    read = files.select("shard", id_column, "n_tokens", "position", "control", "data").mapInArrow(decode, f"shard int, `{id_column}` {kind}, n_tokens bigint, position bigint, ids_crc32 bigint")
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("shard_tokens"))
    before = totals.select("shard", (F.sum("shard_tokens").over(Window.orderBy("shard")) - F.col("shard_tokens")).alias("shard_start"))
    own = Window.partitionBy("shard").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (read.withColumn("upto", F.sum("n_tokens").over(own)).join(before, "shard")
            .select(id_column, (F.col("shard_start") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32", "shard"))
