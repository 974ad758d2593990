"""Per-trade signals: unusual size, late disclosure, large excess return."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import constants as K
from ..functions.rules import date_problem, delay_signal, is_true, trade_size
from ..functions.text import round_exact
from ..session import shuffles_freed, stored
from .order_stats import earlier_medians, earlier_ranks, with_moments
from .ordered import earlier_rank
from .performance import trade_performance

#: trades up to which a politician's history is carried along by one window over the trades themselves
CARRIED_TRADES = 256
#: trades up to which a politician is one group of a task's batches
GROUPED_TRADES = 1 << 18
#: cells up to which a politician's history is worked out by windows in one task; beyond it, by digits in many
USUAL_CELLS = 4096
#: sizes are whole or half dollars
PER_DOLLAR = 2
HISTORY = ["politician_id", "transaction_date", "value", "weight", "prior_n", "prior_median", "less", "same"]
NO_DAY = -(1 << 31)  # a trade without a date is earlier than all others, as in the windows
NO_VALUE = -1.0  # stands for "no usable range" in the size key; disclosed amounts are never negative


def _most_trades(trades):
    """Trades of the politician with most of them."""
    with shuffles_freed(trades.sparkSession):
        return trades.groupBy("politician_id").count().agg(F.max("count")).first()[0] or 0


def size_history(trades: DataFrame, today, most=None) -> DataFrame:
    """(politician, day, value) with what the politician's strictly earlier trades look like.

    All copies of a size on a day are one row from here on, so a politician with a third of all trades contributes
    days × distinct sizes rows. ``value`` is NO_VALUE for trades without a usable range: they ask, but do not count.
    """
    value, _ = trade_size("amount_min", "amount_max")
    cells = (
        trades.filter(date_problem("transaction_date", "disclosure_date", today).isNull())
        .select("politician_id", "transaction_date", F.coalesce(value, F.lit(NO_VALUE)).alias("value"))
        .groupBy("politician_id", "transaction_date", "value").agg(F.count("*").alias("_n"))
        .withColumn("weight", F.when(F.col("value") != NO_VALUE, F.col("_n")).otherwise(F.lit(0)).cast("long"))
        .drop("_n")
    )
    most = _most_trades(trades) if most is None else most
    if most <= USUAL_CELLS:  # nobody has more cells than trades
        return _usual_history(cells)
    sized = stored(with_moments(cells, "politician_id", "transaction_date", "weight").withColumnRenamed("prior", "prior_n"), "size-cells")
    usual = _usual_history(sized.filter(F.col("_cells") <= USUAL_CELLS).select(*cells.columns))
    large = sized.filter(F.col("_cells") > USUAL_CELLS)
    return usual.unionByName(_large_history(large, large.agg(F.max("value")).first()[0]))


def _usual_history(cells: DataFrame) -> DataFrame:
    earlier = Window.partitionBy("politician_id").orderBy(F.unix_date("transaction_date")).rangeBetween(Window.unboundedPreceding, -1)
    counted = cells.withColumns({
        "prior_n": F.coalesce(F.sum("weight").over(earlier), F.lit(0)),
        "prior_median": F.percentile(F.when(F.col("weight") > 0, F.col("value")), F.lit(0.5), F.col("weight")).over(earlier)})
    return earlier_rank(counted, "politician_id", "transaction_date", "value", "weight").select(*HISTORY)


def _large_history(cells: DataFrame, highest) -> DataFrame:
    """The same by digits of the size, for politicians whose days × sizes are too many for one task."""
    keyed = cells.withColumns({"_key": (F.greatest("value", F.lit(0.0)) * PER_DOLLAR).cast("long"), "prior": F.col("prior_n")})
    sized = keyed.filter(F.col("value") != NO_VALUE)
    top = int(highest * PER_DOLLAR) if highest and highest > 0 else 0
    ranks = earlier_ranks(sized, "politician_id", "transaction_date", "_key", "weight", top)
    unsized = keyed.filter(F.col("value") == NO_VALUE).withColumns({"less": F.lit(0).cast("long"), "same": F.lit(0).cast("long")})
    medians = earlier_medians(keyed, "politician_id", "transaction_date", "_key", "weight", top).withColumn("prior_median", F.col("median") / PER_DOLLAR)
    return ranks.unionByName(unsized).join(medians, ["politician_id", "transaction_date"], "left").select(*HISTORY)


def _with_carried_history(trades: DataFrame, today) -> DataFrame:
    """Trades with prior_n, prior_median, less and same, where no politician has many trades.

    One window over the trades holds the earlier sizes of a politician, so trades are dealt by politician once and not joined again. In
    the sorted sizes with a trade's own among them, its first place from either end tells what is smaller and what is larger.
    """
    value, _ = trade_size("amount_min", "amount_max")
    counts = date_problem("transaction_date", "disclosure_date", today).isNull() & value.isNotNull()
    earlier = Window.partitionBy("politician_id").orderBy(F.unix_date("transaction_date")).rangeBetween(Window.unboundedPreceding, -1)
    known = F.col("politician_id").isNotNull() & F.col("transaction_date").isNotNull()
    carried = trades.withColumn("_value", value).withColumn("_earlier", F.collect_list(F.when(counts, F.col("_value"))).over(earlier)).withColumns({
        "_earlier": F.array_sort("_earlier"), "_own": F.sort_array(F.concat("_earlier", F.array("_value")))})
    n, half = F.size("_earlier"), F.lit(2)
    middle = [F.get("_earlier", F.floor((n - k) / half).cast("int")) for k in (1, 0)]
    carried = carried.withColumns({
        "prior_n": F.when(known, n.cast("long")), "prior_median": F.when(known & (n > 0), (middle[0] + middle[1]) / 2),
        "less": F.when(known, F.array_position("_own", F.col("_value")) - 1)})
    larger = F.array_position(F.reverse("_own"), F.col("_value")) - 1
    return carried.withColumn("same", F.col("prior_n") - F.col("less") - F.when(known, larger)).drop("_value", "_earlier", "_own")


def grouped_history():
    """(earlier_order, history of a group). Made here, they travel with the job: workers need not have this package."""

    def earlier_order(day, value, counts):
        """Per row: how many counted rows have an earlier day, their median, and how many of them are smaller than and equal to the row's value.

        Counted values, as ranks in order of days, are sorted bit by bit, highest first and zeros before ones. Per bit the zeros before a place
        tell where a run of earlier rows goes on, for all rows at once: the run of a value's own bits, and the runs of the two in the middle.
        """
        order = np.flatnonzero(counts)[np.argsort(day[counts], kind="stable")]
        levels, ranks = np.unique(value[order], return_inverse=True)
        n = np.searchsorted(day[order], day, side="left")
        own = np.searchsorted(levels, value)
        known = (own < len(levels)) & (levels[np.minimum(own, len(levels) - 1)] == value) if len(levels) else np.zeros(len(day), bool)
        less, found = np.zeros(len(day), np.int64), np.zeros((2, len(day)), np.int64)
        # the run of own values, and for the two in the middle the run and the place looked for in it
        runs = [(np.zeros_like(n), n.copy()) for _ in range(3)]
        places = [np.maximum(n - 1, 0) // 2, n // 2]
        top = int(len(levels)).bit_length()  # one beyond the greatest rank, for values larger than all
        for bit in reversed(range(top)):
            ones = ranks >> bit & 1
            before = np.concatenate([[0], np.cumsum(1 - ones)])  # zeros before a place
            zeros = before[-1]
            for k, (low, high) in enumerate(runs):
                z_low, z_high = before[low], before[high]
                up = own >> bit & 1 == 1 if k == 0 else places[k - 1] >= z_high - z_low
                if k == 0:
                    less += np.where(up, z_high - z_low, 0)
                else:
                    places[k - 1] -= np.where(up, z_high - z_low, 0)
                    found[k - 1] |= up.astype(np.int64) << bit
                runs[k] = (np.where(up, zeros + low - z_low, z_low), np.where(up, zeros + high - z_high, z_high))
            ranks = np.concatenate([ranks[ones == 0], ranks[ones == 1]])
        same = np.where(known, runs[0][1] - runs[0][0], 0)
        at = np.minimum(found, max(len(levels) - 1, 0))
        median = (levels[at[0]] + levels[at[1]]) / 2 if len(levels) else np.zeros(len(day))
        return n, median, less, same

    def history(group: pa.Table) -> pa.Table:
        day, sizes = group["_day"].combine_chunks(), group["_value"].combine_chunks()
        known = np.asarray(day.is_valid()) & np.asarray(group["politician_id"].combine_chunks().is_valid())
        sized = np.asarray(sizes.is_valid())
        n, median, less, same = earlier_order(
            np.asarray(day.fill_null(NO_DAY)), np.asarray(sizes.fill_null(NO_VALUE)), np.asarray(group["_counts"].combine_chunks()))
        out = group.drop_columns(["_day", "_value", "_counts"])
        for name, kind, values, there in (("prior_n", pa.int64(), n, known), ("prior_median", pa.float64(), median, known & (n > 0)), ("less", pa.int64(), less, known & sized), ("same", pa.int64(), same, known & sized)):
            out = out.append_column(name, pa.array(values, kind, mask=~there))
        return out

    return earlier_order, history


def _with_grouped_history(trades: DataFrame, today) -> DataFrame:
    """The same for politicians of up to GROUPED_TRADES trades: they are dealt by politician once, and a politician is one group of rows."""
    value, _ = trade_size("amount_min", "amount_max")
    usable = date_problem("transaction_date", "disclosure_date", today).isNull()
    # what is added is added behind the exchange
    dealt = trades.repartition("politician_id").withColumns({"_day": F.unix_date("transaction_date"), "_value": value.cast("double"), "_counts": F.coalesce(usable & value.isNotNull(), F.lit(False))})
    added = "prior_n long, prior_median double, less long, same long"
    schema = StructType(trades.schema.fields + StructType.fromDDL(added).fields)
    return dealt.groupBy("politician_id").applyInArrow(grouped_history()[1], schema)


def _with_joined_history(trades: DataFrame, today, most) -> DataFrame:
    """The same for politicians of any number of trades: trades meet the history of their politician's days and sizes."""
    value, _ = trade_size("amount_min", "amount_max")
    history = size_history(trades, today, most).select(
        "politician_id", "transaction_date", F.col("value").alias("_size_key"), "prior_n", "prior_median", "less", "same")
    return trades.withColumn("_size_key", F.coalesce(value, F.lit(NO_VALUE))).join(
        history, ["politician_id", "transaction_date", "_size_key"], "left").drop("_size_key")


def size_signal(trades: DataFrame, today, size_percentile=90.0, min_history=10) -> DataFrame:
    """Adds the size columns of a trade's context. The signal uses the unrounded percentile."""
    value, basis = trade_size("amount_min", "amount_max")
    date_ok = date_problem("transaction_date", "disclosure_date", today).isNull()
    most = _most_trades(trades)
    if most <= CARRIED_TRADES:
        joined = _with_carried_history(trades, today)
    elif most <= GROUPED_TRADES:
        joined = _with_grouped_history(trades, today)
    else:
        busy = stored(trades.groupBy("politician_id").count().filter(F.col("count") > GROUPED_TRADES).select("politician_id"), "busy-politicians")
        joined = _with_grouped_history(trades.join(busy, "politician_id", "left_anti"), today).unionByName(
            _with_joined_history(trades.join(busy, "politician_id", "left_semi"), today, most))
    has_value = date_ok & value.isNotNull()
    enough = has_value & (F.col("prior_n") >= min_history)
    percentile = F.when(
        enough & (F.col("prior_n") > 0), (F.col("less") + F.lit(0.5) * F.col("same")) / F.col("prior_n") * 100)
    return (
        joined.withColumn("_percentile", percentile)
        .withColumns({
            "trade_size_anomaly": F.col("_percentile") >= size_percentile,
            "trade_size_value": value,
            "trade_size_basis": basis,
            "trade_size_percentile": round_exact("_percentile"),
            "trade_size_sample_size": F.when(date_ok, F.col("prior_n")),
            "trade_size_median": F.when(has_value, F.col("prior_median")),
        })
        .drop("_percentile", "prior_n", "prior_median", "less", "same")
    )


def with_delay_signal(trades: DataFrame, today, delay_days=45) -> DataFrame:
    days, late = delay_signal("transaction_date", "disclosure_date", today, delay_days)
    return trades.withColumns({"disclosure_delay_days": days, "disclosure_delay_signal": late})


def excess_signal(trades, bars, benchmark, today, threshold=0.20, horizon_days=90) -> DataFrame:
    """Adds the fixed-horizon performance columns of a trade's context."""
    perf = trade_performance(trades, bars, benchmark, today, horizon_days, legs=("transaction",))
    leg = F.col("transaction")
    excess = leg["excess_return"]
    measured = excess.isNotNull()
    return perf.withColumns({
        "performance_status": F.col("status"),
        "security_return": leg["return"],
        "benchmark_return": leg["benchmark_return"],
        "excess_return": excess,
        "excess_return_direction_adjusted": F.col("direction_adjusted.transaction_excess_return"),
        "performance_anchor_date": leg["anchor_date"],
        "performance_horizon_days": F.when(measured, F.lit(horizon_days)),
        "performance_through_date": F.when(measured, F.date_add(leg["anchor_date"], horizon_days)),
        "excess_return_signal": F.when(
            F.col("status") == K.OK, F.abs(excess) + K.EXCESS_TOLERANCE >= threshold),
    }).drop("status", "detail", "latest_date", "latest_price", "direction", "transaction", "direction_adjusted")


def secondary_count(*signals):
    total = F.lit(0)
    for s in signals:
        total = total + is_true(s).cast("int")
    return total
