"""Rank and median among everything earlier in the same group, for groups of any size.

Values are whole numbers (keys) of some bits and are read four bits at a time, highest first. On each level the weights of a group are
summed by the bits above (prefix), the moment and the next four bits (digit); a running sum over moments then tells what is earlier with
each digit. A window so never holds more than a row per moment of a prefix, that is per calendar day, however many values a group has, and
hot groups spread over their prefixes and levels.

* The rank of a value is the sum, over the levels, of what is earlier with its prefix and a smaller digit: all levels at once.
* The k-th smallest is found from level to level: the digit whose running sum passes k is taken, and k falls by what lies before it.
"""

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS = 4
DIGITS = range(1 << BITS)


def _shifted(key, by):
    return F.call_function("shiftright", key, by)


def _digit(key, shift):
    return (_shifted(key, shift) % len(DIGITS)).cast("int")


def _levels(highest):
    """Shifts of the levels that a greatest key needs, highest first."""
    return [BITS * i for i in reversed(range(max(1, -(-int(highest).bit_length() // BITS))))]


def with_moments(cells: DataFrame, group, moment, weight) -> DataFrame:
    """Adds what depends on (group, moment) only: prior (weight of earlier moments), _rank of the moment, _moments and _cells of the group.

    The window runs over distinct moments of a group, at most the days of the calendar.
    """
    moments = cells.groupBy(group, moment).agg(F.sum(weight).alias("_w"), F.count("*").alias("_n"))
    in_order, whole = Window.partitionBy(group).orderBy(moment), Window.partitionBy(group)
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    moments = moments.withColumns({
        "prior": F.coalesce(F.sum("_w").over(before), F.lit(0)), "_rank": (F.row_number().over(in_order) - 1).cast("long"),
        "_moments": F.count("*").over(whole), "_cells": F.sum("_n").over(whole)})
    return cells.join(moments.drop("_w", "_n"), [group, moment])


def _earlier_by_digit(rows: DataFrame, keys, moment, weight) -> DataFrame:
    """Per (keys, moment): _c0 to _c15, the weights of strictly earlier moments by digit."""
    sums = [F.sum(F.when(F.col("_digit") == d, F.col(weight))).alias(f"_c{d}") for d in DIGITS]
    earlier = Window.partitionBy(*keys).orderBy(moment).rowsBetween(Window.unboundedPreceding, -1)
    by_moment = rows.groupBy(*keys, moment).agg(*sums)
    return by_moment.select(*keys, moment, *[F.coalesce(F.sum(f"_c{d}").over(earlier), F.lit(0)).alias(f"_c{d}") for d in DIGITS])


def earlier_ranks(cells: DataFrame, group, moment, key, weight, highest) -> DataFrame:
    """cells, one row per (group, moment, key), with `less` and `same`: the weight strictly earlier with a smaller and with the same key."""
    shift = F.explode(F.array(*[F.lit(s) for s in _levels(highest)])).alias("_shift")
    rows = cells.select(group, moment, key, weight, shift).withColumns({
        "_prefix": _shifted(F.col(key), F.col("_shift") + BITS), "_digit": _digit(F.col(key), F.col("_shift"))})
    at = [group, "_shift", "_prefix"]
    met = rows.join(_earlier_by_digit(rows, at, moment, weight), [*at, moment])
    smaller = reduce(add, [F.when(F.col("_digit") > d, F.col(f"_c{d}")).otherwise(0) for d in DIGITS])
    equal = reduce(add, [F.when(F.col("_digit") == d, F.col(f"_c{d}")).otherwise(0) for d in DIGITS])
    ranks = met.groupBy(group, moment, key).agg(F.sum(smaller).alias("less"), F.sum(F.when(F.col("_shift") == 0, equal)).alias("same"))
    return cells.join(ranks, [group, moment, key])


def earlier_medians(cells: DataFrame, group, moment, key, weight, highest) -> DataFrame:
    """(group, moment, median) of the keys strictly earlier in the group; moments with nothing earlier are absent.

    With an even number of keys the median is the mean of the two in the middle. `cells` has `prior`.
    """
    asked = cells.filter("prior > 0").select(group, moment, "prior").distinct()
    middle = F.array_distinct(F.transform(F.array(F.col("prior") - 1, F.col("prior")), lambda n: F.floor(n / 2).cast("long")))
    asked = asked.select(group, moment, F.explode(middle).alias("_k")).withColumns({"_rest": F.col("_k"), "_prefix": F.lit(0).cast("long")})
    held = cells.filter(F.col(weight) > 0).select(group, moment, key, weight)
    for shift in _levels(highest):
        rows = held.select(group, moment, weight, _shifted(F.col(key), F.lit(shift + BITS)).alias("_prefix"), _digit(F.col(key), F.lit(shift)).alias("_digit"))
        # a question stands among the sums of its prefix as a row without weight
        asking = asked.select(group, moment, "_prefix").distinct().withColumns({weight: F.lit(0).cast("long"), "_digit": F.lit(0)})
        seen = asked.join(_earlier_by_digit(rows.unionByName(asking), [group, "_prefix"], moment, weight), [group, "_prefix", moment])
        upto = [reduce(add, [F.col(f"_c{d}") for d in range(d + 1)]) for d in DIGITS]
        taken = reduce(add, [(F.col("_rest") >= u).cast("int") for u in upto])
        passed = reduce(add, [F.when(F.col("_rest") >= u, F.col(f"_c{d}")).otherwise(0) for d, u in enumerate(upto)])
        asked = seen.select(group, moment, "_k", (F.col("_rest") - passed).alias("_rest"), (F.col("_prefix") * len(DIGITS) + taken).alias("_prefix"))
    return asked.groupBy(group, moment).agg(F.avg("_prefix").alias("median"))
