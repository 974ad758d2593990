"""Ordered work inside groups that may be very large.

Spark puts a whole window partition into one task, so a group holding a third of all rows must not become one. The
helpers below cut groups into bins first, or reduce them to one row per distinct value before any window runs.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: lots in which groups are counted, and rows of a lot from which its groups may be too large for one task
LOTS, FULL = 1 << 14, 1 << 18


def numbered(df: DataFrame, keys, tie_break, out="number", ways=4096, large=None, full=FULL) -> DataFrame:
    """Number the rows of each group 0, 1, 2, … without one task seeing a group of more than ``full`` rows.

    Small groups are numbered by one window, in the order of ``tie_break``. Rows of large ones are dealt over ``ways`` bins by a hash of
    ``tie_break``; a bin's first number is what the earlier bins hold, so that numbering is dense and repeatable, but not in that order.

    ``large`` says which rows may belong to a large group: a condition that holds for all rows of a group or for none, or False where
    there is none. Without it groups are counted in lots first, which reads the keys of ``df`` once more.
    """
    if large is None:
        lot = F.pmod(F.xxhash64(*keys), F.lit(LOTS)).cast("int")
        lots = df.groupBy(lot.alias("_lot")).agg(F.count("*").alias("_n")).filter(F.col("_n") > full).collect()  # at most LOTS numbers
        large = lot.isin([r["_lot"] for r in lots]) if lots else False
    if large is False:
        return df.withColumn(out, (F.row_number().over(Window.partitionBy(*keys).orderBy(*tie_break)) - 1).cast("long"))
    bin_of = F.when(large, F.pmod(F.xxhash64(*tie_break), F.lit(ways)).cast("int")).otherwise(0)
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        df.filter(large).withColumn("_bin", bin_of).groupBy(*keys, "_bin").agg(F.count("*").alias("_n"))
        .withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    )
    first = first.filter("_first > 0").drop("_n")
    within = Window.partitionBy(*keys, "_bin").orderBy(*tie_break)
    local = df.withColumn("_bin", bin_of).withColumn(out, F.row_number().over(within) - 1)
    return (
        local.join(first, [*keys, "_bin"], "left")
        .withColumn(out, (F.col(out) + F.coalesce("_first", F.lit(0))).cast("long"))
        .drop("_bin", "_first")
    )


def earlier_rank(cells: DataFrame, group, moment, value, weight) -> DataFrame:
    """For every (group, moment, value): the weight strictly earlier with a smaller, and with the same, value.

    ``cells`` has one row per (group, moment, value). The moments of a group are ranked, and "everything before rank r"
    is read as one aligned block of ranks per set bit of r: where bit k of a cell's rank is set it asks the block just
    before its own on level k, where it is clear it is held by its own block. Each cell so emits one row per bit, a
    group of g moments is cut into g blocks on its lowest level, and no pair of rows of a group is ever formed. Moments are ranked within
    one task per group; for groups that are too large for that there is :func:`order_stats.earlier_ranks`.
    """
    in_group = Window.partitionBy(group)
    kept = [c for c in cells.columns if c not in (group, moment, value)]
    rank = (F.dense_rank().over(in_group.orderBy(moment)) - 1).cast("long")
    ranked = cells.withColumn("_rank", rank).withColumn("_bits", F.length(F.bin(F.max("_rank").over(in_group))))

    def role(k):
        block = F.call_function("shiftright", F.col("_rank"), k)
        asks = (block % 2).cast("int")
        return F.struct(k.alias("level"), (block - asks).alias("block"), (asks == 1).alias("asks"))

    # one further row asks nothing and carries the cell itself, so a group's first moment is not lost
    itself = F.struct(F.lit(-1).alias("level"), F.lit(-1).cast("long").alias("block"), F.lit(True).alias("asks"))
    roles = F.concat(F.transform(F.sequence(F.lit(0), F.col("_bits") - 1), role), F.array(itself))
    rows = ranked.withColumn("_r", F.explode(roles)).select(
        group, moment, value, "_r.*",
        F.when(~F.col("_r.asks"), F.col(weight)).alias("_w"),
        *[F.when(F.col("_r.level") == -1, F.col(c)).alias(c) for c in kept],
    )
    block = [group, "level", "block"]
    up_to = Window.partitionBy(*block).orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    equal = Window.partitionBy(*block, value)
    counted = rows.withColumns({
        "_upto": F.when(F.col("level") >= 0, F.sum("_w").over(up_to)), "_same": F.sum("_w").over(equal)})
    zero = F.lit(0).cast("long")
    return (
        counted.filter("asks").groupBy(group, moment, value)
        .agg(F.coalesce(F.sum("_upto"), zero).alias("_upto"), F.coalesce(F.sum("_same"), zero).alias("same"),
             *[F.max(c).alias(c) for c in kept])
        .withColumn("less", F.col("_upto") - F.col("same")).drop("_upto")
    )


def newest_per(df: DataFrame, key, order, k) -> DataFrame:
    """The first ``k`` rows of each group. Spark trims groups to ``k`` before the shuffle, so a hot group stays small."""
    position = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)
    return df.withColumn("_position", F.row_number().over(position)).filter(F.col("_position") <= k).drop("_position")


def latest_by(df: DataFrame, keys, order, columns) -> DataFrame:
    """One row per key with the values of the row that is last in ``order`` (a map-side combined aggregate)."""
    return df.groupBy(*keys).agg(
        F.max_by(F.struct(*columns), F.struct(*order)).alias("_last")
    ).select(*keys, "_last.*")
