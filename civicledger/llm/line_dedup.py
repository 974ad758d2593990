"""Fuzzy line deduplication by DataFrame functions alone.

Lines are normalised (lower case, runs of white space one blank, trimmed). A line's SimHash has 63 bits: bit b is set if more than half of its
distinct words' hashes have it (a separator that stands after every word must not decide alone). Words of less than LONG characters, which
unlike lines of a language share, count only in lines without ENOUGH longer ones. The counts of several bits share one long, so a line's words
are added up within its row. Lines whose SimHashes differ in at most TOLERANCE = 3 bits agree in two of five blocks; each pair of blocks makes a bucket. A line is compared
with its bucket's hub, the least line in it, and, once links have made components, with the lines of the bucket that are in another
component: no link inside the tolerance is lost, and a bucket of many variants is not expanded into all its pairs. A link needs edit
similarity: at most (100 - percent) % of the longer line's characters edited; words that both lines have at the same place bound the edits
before the distance of the rest is worked out. Of each connected group, equal lines included, the first
occurrence by document id, text and line number is kept.

Lines without a visible character are never dropped. Null texts stay null. Rows with the same id and text count as one; a null id sorts first. Empty tables give no rows. Further columns of docs are kept
as they are; their names don't matter.
"""

from functools import reduce
from itertools import combinations
from operator import or_

from pyspark.sql import functions as F

from civicledger.session import stored

from .graph import components

BLOCKS = (13, 13, 13, 12, 12)
TOLERANCE = 3
BITS = 63
#: bits of a count: 7, 3 or 1 of them in a long; its highest bit is left for the comparison, so up to 255 and 1,048,575 words go by the first two
LANES = (9, 21, 63)
#: words of fewer characters are left out where ENOUGH others remain
LONG, ENOUGH = 4, 4
#: lines, and bytes of line numbers, that may be sent to all tasks; beyond it they are joined by a shuffle
SENT = 1_000_000
SENT_BYTES = 32 << 20
FP = "line_dedup fp"  # a name no table has
#: a character that counts as visible; what else there is besides single blanks
VISIBLE = r"[^\s\x00]"
ODD_SPACES = ("  ", "\t", "\x0b", "\f", "\r", "\x00")


def _with(values, f):
    """f of the values, each worked out once however often f uses it."""
    names = [f"v{i}" for i in range(len(values))]
    return F.transform(F.array(F.struct(*[v.alias(n) for v, n in zip(values, names)])), lambda row: f(*[row[n] for n in names]))[0]


def _normal(raw):
    """Lower case, runs of white space one blank, trimmed; most lines have single blanks only and need no replacing."""
    low = F.lower(raw)
    odd = reduce(or_, [F.contains(raw, F.lit(c)) for c in ODD_SPACES])
    return F.trim(F.when(odd, F.regexp_replace(low, r"[\s\x00]+", " ")).otherwise(low))


def lines_of(docs, id_column, text):
    """Every line with a visible character: id, fp (hash of the text), line (number), norm, and its two hashes k1 and k2."""
    lines = docs.where(F.col(text).isNotNull()).select(F.col(id_column).alias("id"), F.xxhash64(text).alias("fp"), F.posexplode(F.split(text, "\n")).alias("line", "raw"))
    # asked of the line as it stands: a condition on norm would have every line normalised twice
    lines = lines.where(F.col("raw").rlike(VISIBLE)).select("id", "fp", "line", _normal(F.col("raw")).alias("norm"))
    return lines.withColumns({"k1": F.xxhash64("norm"), "k2": F.xxhash64(F.lit("second"), "norm")})


def _zeros(n):
    return F.struct(*[F.lit(0).cast("bigint").alias(f"s{i}") for i in range(n)])


def _ones(width):
    return sum(1 << at for at in range(0, BITS, width))


def _counted(hashes, width):
    """Sum i of `width` counts, side by side in a long, how many hashes have the bits i, i + width, i + 2 * width, ..."""
    ones = F.lit(_ones(width))
    bits = lambda h, i: (F.shiftrightunsigned(h, i) if i else h).bitwiseAND(ones)
    return F.aggregate(hashes, _zeros(width), lambda sums, h: F.struct(*[(sums[f"s{i}"] + bits(h, i)).alias(f"s{i}") for i in range(width)]))


def _counted_by_sevens(hashes):
    """The same at a width of 9: seven hashes at a time are counted in 3 bits, which takes three sums, and those are widened."""
    sevens = F.transform(F.sequence(F.lit(1), F.size(hashes), F.lit(7)), lambda at: _counted(F.slice(hashes, at, 7), 3))
    counts = F.lit(7 * _ones(9))
    bits = lambda c, i: F.shiftrightunsigned(c[f"s{i % 3}"], i - i % 3).bitwiseAND(counts)
    return F.aggregate(sevens, _zeros(9), lambda sums, c: F.struct(*[(sums[f"s{i}"] + bits(c, i)).alias(f"s{i}") for i in range(9)]))


def _majority(counts, words, width):
    """The bits that more than half of the words have."""
    ones = _ones(width)
    lift = (F.lit((1 << (width - 1)) - 1) - F.shiftright(words, 1)) * F.lit(ones)  # takes a count of more than half to its highest bit

    def decide(sums):
        high = [(sums[f"s{i}"] + lift).bitwiseAND(F.lit(ones << (width - 1))) for i in range(width)]
        return reduce(lambda x, y: x.bitwiseOR(y), [F.shiftrightunsigned(b, width - 1 - i) for i, b in enumerate(high)])

    return _with([counts], decide)


def simhashes(lines):
    """Every line with its SimHash and length."""
    keys = ["id", "fp", "line", "k1", "k2", "length"]
    hashed = lambda words: F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))
    words = lines.select(*keys[:-1], F.length("norm").alias("length"), F.split("norm", " ").alias("every"))
    words = words.select(*keys, "every", hashed(F.filter("every", lambda w: F.length(w) >= LONG)).alias("long"))
    words = words.select(*keys, F.when(F.size("long") >= ENOUGH, F.col("long")).otherwise(hashed(F.col("every"))).alias("words"))
    counts = [_counted_by_sevens(F.col("words")), *[_counted(F.col("words"), width) for width in LANES[1:]]]
    small, middle, large = (_majority(c, F.size("words"), width) for c, width in zip(counts, LANES))
    fits = [F.size("words") < 1 << (width - 1) for width in LANES]
    return words.select(*keys, F.when(fits[0], small).when(fits[1], middle).otherwise(large).alias("sim"))


def buckets(distinct):
    """(bucket, k1, sim, length) of the lines of buckets that may hold two lines inside the tolerance."""
    starts = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    blocks = [F.shiftrightunsigned("sim", s).bitwiseAND(F.lit((1 << n) - 1)) for s, n in zip(starts, BLOCKS)]
    # the pair's number above the bits of both blocks
    pairs = [F.shiftleft(F.lit(k).cast("bigint"), 32).bitwiseOR(F.shiftleft(blocks[a], 16)).bitwiseOR(blocks[b]) for k, (a, b) in enumerate(combinations(range(len(BLOCKS)), 2))]
    rows = distinct.select("k1", "sim", "length", F.explode(F.array(*pairs)).alias("bucket"))
    # most buckets of two lines hold two that have nothing in common; their least and greatest SimHash tell
    full = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("sim").alias("u"), F.max("sim").alias("v"))
    full = stored(full.where((F.col("n") > 1) & ((F.col("n") > 2) | (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= TOLERANCE))).select("bucket"), "full-buckets")
    return rows.join(F.broadcast(full) if full.count() <= SENT else full, "bucket")


def _near(percent):
    """Condition on lines x and y: few different bits, lengths that the edit similarity allows."""
    longer = F.greatest("x.length", "y.length")
    return (F.bit_count(F.col("x.sim").bitwiseXOR(F.col("y.sim"))) <= TOLERANCE) & (F.least("x.length", "y.length") * 100 >= longer * percent)


def _common(p, q):
    """How many words the arrays p and q of different lines share from their beginning on."""
    return (F.array_position(F.zip_with(p, q, lambda x, y: x.eqNullSafe(y)), False) - 1).cast("int")


def _replaced(p, q):
    """Characters edited if each word becomes the one at its place in the other array: no fewer than the edit distance has."""
    cost = F.zip_with(p, q, lambda x, y: F.when(x == y, 0).otherwise(F.greatest(F.length(x), F.length(y)) + F.when(x.isNull() | y.isNull(), 1).otherwise(0)))
    return F.aggregate(cost, F.lit(0), lambda n, c: n + c)


def _within(p, q, allowed):
    """Whether the different lines p and q are at most `allowed` edits apart."""

    def banded(x, y):
        # most lines this near differ in a few characters, and a narrow band costs a fraction of the whole one
        bands = [F.least(allowed, F.floor(allowed / part).cast("int") + 4) for part in (32, 8, 1)]
        return reduce(or_, [F.greatest(F.length(x), F.length(y)) <= allowed, *[F.call_function("levenshtein", x, y, band) >= 0 for band in bands]])

    def between(head, tail):
        return _with([F.substring(t, head + 1, F.length(t) - head - tail) for t in (p, q)], banded)

    def trimmed(u, v):
        # words at both ends that the lines share don't change the distance; none counts for both ends
        tail = lambda head: F.least(_common(F.reverse(u), F.reverse(v)), F.size(u) - head, F.size(v) - head)
        chars = lambda start, n: F.length(F.array_join(F.slice(u, start, n), " "))
        ends = lambda head, tail: _with([chars(F.lit(1), head), chars(F.size(u) - tail + 1, tail)], between)
        return _with([_common(u, v)], lambda head: _with([head, tail(head)], ends))

    return _with([F.split(p, " "), F.split(q, " ")], lambda u, v: (_replaced(u, v) <= allowed) | trimmed(u, v))


def verified(pairs, texts, percent):
    """The pairs (a, b) of lines whose edit similarity reaches percent."""
    x, y = texts.select(F.col("k1").alias("a"), F.col("norm").alias("p")), texts.select(F.col("k1").alias("b"), F.col("norm").alias("q"))
    allowed = F.floor(F.greatest(F.length("p"), F.length("q")) * (100 - percent) / 100).cast("int")
    return pairs.join(x, "a").join(y, "b").where(_with([F.col("p"), F.col("q"), allowed], _within)).select("a", "b")


def _texts(docs, occurrences, pairs, id_column, text):
    """(k1, norm) of the lines that occur in the pairs, each read from one place that holds it."""
    nodes = stored(pairs.select(F.explode(F.array("a", "b")).alias("k1")).distinct(), "lines-to-read")
    few = nodes.count() <= SENT
    small = F.broadcast if few else (lambda side: side)
    place = F.max(F.struct("fp", "line")).alias("place")
    places = stored(occurrences.join(small(nodes), "k1").groupBy("k1").agg(place).select("k1", F.col("place.fp").alias("holder"), F.col("place.line").alias("at")), "places-to-read")
    held = docs.select(F.col(text).alias("text"), F.xxhash64(text).alias(FP)).join(small(places.select("holder").distinct()), F.col(FP) == F.col("holder"), "left_semi")
    lines = held.select(FP, F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    read = lines.join(small(places), (F.col(FP) == F.col("holder")) & (F.col("line") == F.col("at"))).select("k1", "raw")
    return read.groupBy("k1").agg(F.first("raw").alias("raw")).select("k1", _normal(F.col("raw")).alias("norm"))


def linked(docs, occurrences, percent, id_column, text):
    """(k1, component) of the lines that are linked to another one."""
    distinct = occurrences.groupBy("k1").agg(F.min("k2").alias("k2"), F.max("k2").alias("other"), F.max("sim").alias("sim"), F.max("length").alias("length"))
    rows = stored(buckets(stored(distinct.where("k2 = other").select("k1", "sim", "length"), "distinct-lines")), "line-buckets")
    hubs = rows.join(rows.groupBy("bucket").agg(F.min("k1").alias("k1")), ["bucket", "k1"])
    pairs = rows.alias("x").join(hubs.alias("y"), F.col("x.bucket") == F.col("y.bucket")).where((F.col("x.k1") != F.col("y.k1")) & _near(percent))
    pairs = stored(pairs.select(F.col("y.k1").alias("a"), F.col("x.k1").alias("b")).distinct(), "hub-pairs")
    links = stored(verified(pairs, _texts(docs, occurrences, pairs, id_column, text), percent), "hub-links")
    # what is left: lines of one bucket in different components; a bucket whose lines are all together is passed over
    own = rows.join(components(links).withColumnRenamed("node", "k1"), "k1", "left").withColumn("component", F.coalesce("component", "k1"))
    mixed = own.groupBy("bucket").agg(F.min("component").alias("u"), F.max("component").alias("v"), F.count("*").alias("n")).where("u <> v and n > 2").select("bucket")
    own = own.join(mixed, "bucket")
    pairs = own.alias("x").join(own.alias("y"), F.col("x.bucket") == F.col("y.bucket")).where((F.col("x.component") < F.col("y.component")) & _near(percent))
    pairs = stored(pairs.select(F.col("x.k1").alias("a"), F.col("y.k1").alias("b")).distinct().join(links, ["a", "b"], "left_anti"), "cross-pairs")
    links = links.union(stored(verified(pairs, _texts(docs, occurrences, pairs, id_column, text), percent), "cross-links"))
    return components(links).withColumnRenamed("node", "k1")


def repeated_lines(docs, percent=80, id_column="doc_id", text="text"):
    """(id, fp, lines): for each document with lines to drop their numbers; fp is the hash of its text."""
    occurrences = stored(simhashes(lines_of(docs, id_column, text)), "line-hashes")
    groups = linked(docs, occurrences, percent, id_column, text)
    # lines that stand once and are linked to none need no decision
    counts = occurrences.groupBy("k1", "k2").agg(F.count("*").alias("n")).join(groups, "k1", "left").where("n > 1 or component is not null")
    group = F.struct(F.coalesce("component", "k1").alias("c"), F.when(F.col("component").isNull(), F.col("k2")).alias("k"))
    repeated = stored(counts.select("k1", "k2", group.alias("group")), "repeated-lines")
    placed = stored(occurrences.select("k1", "k2", F.struct("id", "fp", "line").alias("place")).join(repeated, ["k1", "k2"]).select("group", "place"), "places")
    kept = placed.groupBy("group").agg(F.min("place").alias("kept"))
    dropped = placed.join(kept.withColumnRenamed("group", "g"), F.col("group").eqNullSafe(F.col("g"))).where(~F.col("place").eqNullSafe(F.col("kept")))
    return stored(dropped.groupBy("place.id", "place.fp").agg(F.sort_array(F.collect_set("place.line")).alias("lines")), "dropped-lines")


def dedup(docs, percent=80, id_column="doc_id", text="text", counted=False):
    """docs with the repeated lines taken out of their text; with `counted` also n_lines and n_dropped (visible lines before, dropped)."""
    dropped = repeated_lines(docs, percent, id_column, text)
    size = dropped.agg(F.sum(F.size("lines") * 4 + 64)).first()[0] or 0
    dropped = F.broadcast(dropped) if size <= SENT_BYTES else dropped
    d = docs.withColumn(FP, F.xxhash64(text)).alias("d").join(dropped.alias("x"), F.col(f"d.`{FP}`").eqNullSafe(F.col("x.fp")) & F.col(f"d.{id_column}").eqNullSafe(F.col("x.id")), "left")
    whole = F.split(F.col(f"d.{text}"), "\n")
    rest = F.array_join(F.filter(whole, lambda _, i: ~F.array_contains(F.col("x.lines"), i)), "\n")
    out = [F.when(F.col("x.lines").isNull(), F.col(f"d.{text}")).otherwise(rest).alias(text) if c == text else F.col(f"d.`{c}`") for c in docs.columns]
    if counted:
        visible = F.regexp_count(F.concat(F.lit("\n"), F.col(f"d.{text}")), F.lit(r"\n[ \t\x0B\f\r\x00]*" + VISIBLE))  # a line's beginning up to its first visible character
        out += [F.when(F.col(f"d.{text}").isNull(), 0).otherwise(visible).cast("bigint").alias("n_lines"), F.coalesce(F.size("x.lines"), F.lit(0)).cast("bigint").alias("n_dropped")]
    return d.select(*out)
