"""Prefix trie of conversations by truncation peeling.

A node is a distinct sequence of first turns. Its key is a chained 128-bit digest of them, made while the sorted turns of a conversation
stream by. Conversations that are equal as a whole are one, with a count, from the start.

Peeling descends from the greatest depth that two conversations share. At each depth the conversations that end there or have no
company below it meet the nodes that survived from the depth below, stripped of their last turn; one regrouping by key merges them
and yields the nodes of that depth together with their sums (members, children, leaves, saved bytes), which the next depth takes up. A
regrouping combines on the map side, so a first turn that a third of all conversations have is a row per task. Tails without
company need no regrouping: they are peeled where they lie, in one pass over the turns. There are as many rounds as the longest prefix of
two different conversations has turns; a round reads the nodes of one depth only, from a table the round before wrote.

`ends_sha256` streams the sorted ids of a node's conversations in pieces: ids of one node are joined to pieces by many tasks, and one
task hashes them in order without holding them.

Defined cases: null roles and texts are empty, a null turn comes first, rows of one turn come by role, then text; repeated rows are
turns of their own. Rows without a conversation id belong to no conversation. A conversation without turns is a member of the root. An empty
table has no nodes. Further columns are ignored, whatever their names.
"""

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import functions as F

from ..session import stored

ROOT = b"\0" * 16
ROWS = 1 << 14
#: greatest number of turns taken from another conversation
MOST_BORROWED = 8
#: ids that one piece of a node's list holds
PIECE = 1 << 14
_TURNS = "conv_id bigint, depth bigint, key binary, parent binary, size bigint, upto bigint, last boolean"
_TURNS_ARROW = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), ("size", pa.int64()), ("upto", pa.int64()), ("last", pa.bool_())])


def _batch(rows, schema):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _keyed(batches):
    """Turns with their prefix keys, from rows sorted by base, conversation (the base first) and turn.

    The first turns of the base are the only ones kept; they are digests and sizes, no texts.
    """
    base = conv = None
    borrowed, out = [], []
    row = position = None  # the last turn so far, given out when it is known whether another one follows

    def grown(digest, size):
        nonlocal row
        if row[1]:
            out.append((*row, False))
        key = hashlib.sha256(row[2] + digest).digest()[:16]
        row = conv, row[1] + 1, key, row[2], size, row[5] + size

    def begun():
        nonlocal row
        row = conv, 0, ROOT, None, 0, 0
        if conv != base:
            for known in borrowed[:borrow]:
                grown(*known)

    for batch in batches:
        for new_base, new_conv, borrow_now, role, text in zip(*(batch.column(n).to_pylist() for n in ("base", "conv_id", "borrow", "role", "text"))):
            if new_conv != conv:
                if conv is not None:
                    out.append((*row, True))
                if new_base != base:
                    base, borrowed = new_base, []
                conv, borrow, position = new_conv, borrow_now, 0
                begun()
            text = text.encode()
            known = hashlib.sha256(role.encode() + b"\xff" + text).digest(), len(text)  # no UTF-8 text holds this byte
            if conv == base and position < MOST_BORROWED:
                borrowed.append(known)
            if conv == base or position >= borrow:
                grown(*known)
            position += 1
            if len(out) >= ROWS:
                yield _batch(out, _TURNS_ARROW)
                out = []
    if conv is not None:
        yield _batch([*out, (*row, True)], _TURNS_ARROW)


def keyed_turns(rows, base=None, borrow=None):
    """Turns of all conversations with keys: conv_id, depth, key, parent (key), size (bytes of its text), upto (bytes so far), last.

    `base` and `borrow` are columns of conv_id: the conversation whose first `borrow` turns (MOST_BORROWED at most) stand in place of the
    own first ones. All conversations with one base lie in one task, so a base should have few. Without them turns stay as they are.
    """
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv_id is not null")
    base, borrow = F.col("conv_id") if base is None else base, F.lit(0) if borrow is None else borrow
    rows = rows.withColumns({"base": base.cast("long"), "borrow": borrow.cast("int")})
    order = ["base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    return rows.repartition("base").sortWithinPartitions(*order).select("base", "conv_id", "borrow", "role", "text").mapInArrow(_keyed, _TURNS)


def hashed_ends(turns):
    """key and ends_sha256 of every node at which conversations end."""
    ends = turns.where("last").select("key", "conv_id")

    def pieces(batches):
        now, first, ids = None, None, []
        for batch in batches:
            out = []
            for key, conv in zip(*(batch.column(n).to_pylist() for n in ("key", "conv_id"))):
                if key != now or len(ids) == PIECE:
                    if ids:
                        out.append((now, first, ",".join(map(str, ids))))
                    now, first, ids = key, conv, []
                ids.append(conv)
            if out:
                yield _batch(out, piece_schema)
        if ids:
            yield _batch([(now, first, ",".join(map(str, ids)))], piece_schema)

    def hashes(batches):
        now, digest = None, None
        for batch in batches:
            out = []
            for key, piece in zip(*(batch.column(n).to_pylist() for n in ("key", "piece"))):
                if key == now:
                    digest.update(b"," + piece.encode())
                    continue
                if now is not None:
                    out.append((now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(piece.encode())
            if out:
                yield _batch(out, hash_schema)
        if now is not None:
            yield _batch([(now, digest.hexdigest())], hash_schema)

    piece_schema = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("piece", pa.string())])
    hash_schema = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])
    # ranges of (key, id) cut a node of very many ends into parts for several tasks; a part's pieces stay in order
    parts = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(pieces, "key binary, first bigint, piece string")
    return parts.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashes, "key binary, ends_sha256 string")


def _peeled_tails(turns, tops):
    """Nodes below the last shared turn of a conversation: nobody but its copies is there."""
    below = turns.join(tops, "conv_id").where("depth > shared")
    saved = (F.col("copies") - 1) * (F.col("total") - F.col("upto") + F.col("size"))
    return below.select("key", "parent", "depth", "conv_id", F.col("copies").alias("n_convs"), F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"),
                        F.lit(1).cast("long").alias("n_leaves"), saved.alias("saved_tokens"))


def _arriving(turns, tops):
    """A row per distinct conversation as it arrives at its last shared turn: its path so far, and the sums of its peeled tail."""
    path = turns.join(tops.select("conv_id", "shared"), "conv_id").where("depth between 1 and shared")
    path = path.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "key", "size"))).alias("path"), F.max("upto").alias("upto"))
    here = tops.join(path, "conv_id", "left")
    ended = F.col("shared") == F.col("length")
    return here.select(F.col("shared").alias("depth"), F.coalesce("path.key", F.array().cast("array<binary>")).alias("keys"), F.coalesce("path.size", F.array().cast("array<bigint>")).alias("sizes"),
                       "conv_id", F.col("copies").alias("n_convs"), F.when(ended, 0).otherwise(1).cast("long").alias("children"), F.when(ended, 0).otherwise(1).cast("long").alias("leaves"),
                       F.when(ended, 0).otherwise((F.col("copies") - 1) * (F.col("total") - F.coalesce("upto", F.lit(0)))).cast("long").alias("saved"))


def _regrouped(arrived, depth):
    """The nodes of a depth from what arrives there, with what they carry to the depth above."""
    key = F.element_at("keys", depth) if depth else F.lit(ROOT)
    nodes = arrived.groupBy(key.alias("key")).agg(F.any_value("keys").alias("keys"), F.any_value("sizes").alias("sizes"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
                                                  F.sum("children").alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    size = F.element_at("sizes", depth) if depth else F.lit(0)
    parent = (F.element_at("keys", depth - 1) if depth > 1 else F.lit(ROOT)) if depth else F.lit(None).cast("binary")
    return nodes.select("key", parent.alias("parent"), F.lit(depth).cast("long").alias("depth"), "conv_id", "n_convs", "n_children", F.when(F.col("n_children") == 0, 1).otherwise(F.col("leaves")).alias("n_leaves"),
                        (F.col("saved") + (F.col("n_convs") - 1) * size).alias("saved_tokens"), F.slice("keys", 1, max(depth - 1, 0)).alias("keys"), F.slice("sizes", 1, max(depth - 1, 0)).alias("sizes"))


def _stripped(nodes):
    """Nodes of one depth, their last turn gone, as they arrive at the depth above."""
    return nodes.select("keys", "sizes", "conv_id", "n_convs", F.lit(1).cast("long").alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))


def trie(turns):
    """One row per node of `keyed_turns`: conv_id (its least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, key, parent (keys)."""
    turns = stored(turns, "trie-turns")
    ends = turns.where("last").groupBy("key").agg(F.min(F.struct("conv_id", "depth", "upto")).alias("of"), F.count("*").alias("copies"))
    ends = ends.select("of.conv_id", "copies", F.col("of.depth").alias("length"), F.col("of.upto").alias("total"))
    one_each = turns.join(ends.select("conv_id"), "conv_id", "left_semi").where("depth > 0")
    shared = one_each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    deepest = one_each.join(shared, "key").groupBy("conv_id").agg(F.max("depth").alias("shared"))
    tops = stored(ends.join(deepest, "conv_id", "left").withColumn("shared", F.coalesce("shared", F.lit(0))), "trie-tops")
    arriving = stored(_arriving(turns, tops), "trie-arriving")
    columns = ["key", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    levels, above = [], None
    for depth in range(arriving.agg(F.max("depth")).first()[0] or 0, -1, -1):
        here = arriving.where(F.col("depth") == depth).drop("depth")
        above = stored(_regrouped(here if above is None else here.unionByName(_stripped(above)), depth), f"trie-depth-{depth}")
        levels.append(above.select(*columns))
    nodes = reduce(lambda a, b: a.unionByName(b), [_peeled_tails(turns, tops), *levels])
    parents = reduce(lambda a, b: a.unionByName(b), levels).select(F.col("key").alias("parent"), F.col("conv_id").alias("above"))
    # a turn of a tail has its own conversation above it, but for the first one
    nodes = nodes.join(parents, "parent", "left").join(hashed_ends(turns), "key", "left")
    above = F.when(F.col("depth") > 0, F.coalesce("above", "conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return nodes.select("conv_id", "depth", above.alias("parent_conv_id"), *columns[4:], F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"), "key", "parent")


def rebuilt(rows):
    """keyed_turns of conversations whose first turns come from the conversation c - c % 5, as many as crc32 of the id says."""
    conv = F.col("conv_id").cast("long")
    return keyed_turns(rows, conv - conv % 5, F.crc32(F.encode(conv.cast("string"), "utf-8")) % 9)
