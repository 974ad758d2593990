"""Dashboard aggregates over trades, prices and their dimensions."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.rules import day
from .ordered import newest_per

BUY = "transaction_type = 'buy'"
SELL = "transaction_type IN ('sell', 'sell_partial')"


def _buys():
    return F.count_if(F.expr(BUY))


def _sells():
    return F.count_if(F.expr(SELL))


def _one_row(*parts: DataFrame) -> DataFrame:
    """One-row aggregates side by side: stacked, then folded into one row."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def _in_window(today, days):
    return F.col("disclosure_date") >= F.date_sub(day(today), days)


def overview_totals(trades, politicians, securities, today, days=30) -> DataFrame:
    """Totals, and counts of disclosures since ``days`` ago (later ones than today included)."""
    recent = _in_window(today, days)
    facts = trades.agg(
        F.count("*").alias("trades"),
        F.count_if(recent).alias("trades_in_window"),
        F.count_if(recent & F.expr(BUY)).alias("buys_in_window"),
        F.count_if(recent & F.expr(SELL)).alias("sells_in_window"),
        F.max("disclosure_date").alias("latest_disclosure_date"),
    )
    return _one_row(facts, politicians.agg(F.count("*").alias("politicians")),
                    securities.agg(F.count("*").alias("securities")))


def daily_counts(trades: DataFrame, today, days=30) -> DataFrame:
    """Disclosures per day, dense from ``days`` ago to today."""
    end = day(today)
    spark = trades.sparkSession
    calendar = spark.range(days + 1).select(F.date_sub(end, (days - F.col("id")).cast("int")).alias("date"))
    counts = (
        trades.filter(_in_window(today, days) & (F.col("disclosure_date") <= end))
        .groupBy(F.col("disclosure_date").alias("date")).agg(F.count("*").alias("count"))
    )
    return calendar.join(counts, "date", "left").select("date", F.coalesce("count", F.lit(0)).alias("count")).orderBy("date")


def monthly_counts(trades: DataFrame) -> DataFrame:
    return (
        trades.filter("disclosure_date IS NOT NULL")
        .groupBy(F.date_format("disclosure_date", "yyyy-MM").alias("month"))
        .agg(_buys().alias("buys"), _sells().alias("sells"),
             F.count_if(F.expr(f"NOT ({BUY}) AND NOT ({SELL})")).alias("other"))
        .orderBy("month")
    )


def top_entities(trades, dim, key, today, days=30, n=10) -> DataFrame:
    """The most disclosed securities or people of the window, ties by key. The dimension joins after the count."""
    counts = trades.filter(_in_window(today, days) & F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("trades"), _buys().alias("buys"), _sells().alias("sells"))
    return counts.join(dim, key).orderBy(F.col("trades").desc(), key).limit(n)


def entity_summary(dim, trades, key) -> DataFrame:
    """Every row of a dimension with its number of trades and latest transaction date."""
    counts = trades.groupBy(key).agg(
        F.count("*").alias("trade_count"), F.max("transaction_date").alias("latest_trade_date"))
    return dim.join(counts, key, "left").withColumn("trade_count", F.coalesce("trade_count", F.lit(0)))


def status_report(trades, politicians, securities, bars, today, benchmark) -> DataFrame:
    """One row of freshness and coverage figures."""
    today = day(today)
    facts = trades.agg(
        F.count("*").alias("trades_total"),
        F.max("disclosure_date").alias("latest_disclosure_date"),
        F.max(F.when(F.col("transaction_date") <= today, F.col("transaction_date"))).alias("latest_transaction_date"),
        F.count_if((F.col("transaction_date") > today)
                   | F.coalesce(F.col("transaction_date") > F.col("disclosure_date"), F.lit(False))).alias("invalid_date_trades"),
    )
    traded = securities.join(trades.select("ticker").distinct(), "ticker", "left_semi")
    coverage = traded.agg(
        F.count("*").alias("securities_total"),
        F.count_if(F.col("price_status") == "ok").alias("securities_priced"),
        F.count_if(F.col("price_status") == "unavailable").alias("securities_unavailable"),
        F.count_if(F.col("price_status").isNull()).alias("securities_pending"),
    )
    prices = bars.agg(F.count("*").alias("price_bars"), F.max("date").alias("latest_bar_date"))
    bench = securities.filter(F.col("ticker") == benchmark).agg(
        F.max("price_from").alias("benchmark_from"), F.max("price_to").alias("benchmark_to"),
        F.max("price_status").alias("benchmark_status"))
    return _one_row(facts, politicians.agg(F.count("*").alias("politicians_total")), coverage, prices, bench)


def trades_by_source(trades: DataFrame) -> DataFrame:
    return trades.groupBy("source").agg(F.count("*").alias("trades"))


def ingest_status(state: DataFrame, now, stale_hours) -> DataFrame:
    """Age of the last successful ingest; unknown counts as stale."""
    hours = (F.unix_timestamp(F.lit(str(now)).cast("timestamp")) - F.unix_timestamp(
        F.max("last_success_at").cast("timestamp"))) / 3600
    return state.agg(F.max("last_success_at").alias("last_success_at"), hours.alias("_age")).select(
        "last_success_at", F.round("_age", 2).alias("age_hours"),
        (F.col("_age").isNull() | (F.col("_age") > stale_hours)).alias("stale"))


def half_window_trend(daily: DataFrame, totals: DataFrame, monthly: DataFrame) -> DataFrame:
    """Later half of the daily series against the earlier one, share of buys, and the last twelve months."""
    # the series has one row per day of the window and per month, so a single ordered pass is small
    by_day = Window.orderBy("date")
    placed = daily.select(
        "count", (F.row_number().over(by_day) - 1).alias("i"), F.count("*").over(Window.partitionBy()).alias("n"))
    later = F.col("i") >= F.floor(F.col("n") / 2)
    halves = placed.agg(
        F.coalesce(F.sum(F.when(later, F.col("count"))), F.lit(0)).alias("recent"),
        F.coalesce(F.sum(F.when(~later, F.col("count"))), F.lit(0)).alias("earlier"))
    last_year = monthly.orderBy(F.col("month").desc()).limit(12).agg(
        F.coalesce(F.sum(F.col("buys") + F.col("sells") + F.col("other")), F.lit(0)).alias("last_12_months"))
    share = totals.select(F.when(
        F.col("trades_in_window") > 0, _round_half_up(F.col("buys_in_window") / F.col("trades_in_window") * 100)).alias("buy_share_pct"))
    change = F.when(F.col("earlier") > 0, _round_half_up((F.col("recent") - F.col("earlier")) / F.col("earlier") * 100))
    return _one_row(halves, last_year, share).withColumn("change_pct", change)


def _round_half_up(c):
    return F.floor(c + 0.5).cast("long")


GROUP_KEY = ["politician_id", "ticker_key", "transaction_date", "transaction_type"]


def with_group_size(trades: DataFrame) -> DataFrame:
    """Adds a display key for lines that belong together and how many share it. Nothing is merged.

    The size is counted with map-side combine and joined back; a window would put all copies of a line in one task.
    """
    keyed = trades.withColumn("ticker_key", F.coalesce("ticker", F.lit("")))
    sizes = keyed.groupBy(*GROUP_KEY).agg(F.count("*").alias("group_size"))
    label = F.concat_ws("|", *[F.col(c).cast("string") for c in GROUP_KEY])
    return keyed.join(sizes, GROUP_KEY).withColumn("group_key", label).drop("ticker_key")


def politician_breakdown(trades: DataFrame, politician=None, newest=None) -> tuple[DataFrame, DataFrame]:
    """(buys and sells per month, top ten tickers) over all trades of each politician, or of one.

    ``newest`` narrows it to that many of a politician's newest trades.
    """
    wanted = trades if politician is None else trades.filter(F.col("politician_id") == politician)
    if newest:
        wanted = newest_per(wanted, "politician_id", [F.col("transaction_date").desc(), F.col("id").desc()], newest)
    counts = [_buys().alias("buys"), _sells().alias("sells")]
    monthly = wanted.groupBy(
        "politician_id", F.date_format("transaction_date", "yyyy-MM").alias("month")).agg(*counts)
    tickers = wanted.groupBy("politician_id", F.coalesce("ticker", F.lit("—")).alias("ticker")).agg(*counts)
    return monthly, newest_per(tickers, "politician_id", [(F.col("buys") + F.col("sells")).desc(), F.col("ticker")], 10)


def price_slice(bars, ticker=None, start=None, end=None) -> DataFrame:
    out = bars if ticker is None else bars.filter(F.col("ticker") == ticker.upper())
    out = out.filter(F.col("date") >= day(start)) if start else out
    out = out.filter(F.col("date") <= day(end)) if end else out
    return out.orderBy("ticker", "date")


def range_window(bars: DataFrame, months) -> DataFrame:
    """Bars of each security on or after ``months`` before its last bar.

    A start day its month does not have runs into the next month, as in the calendar of a browser.
    """
    last = bars.groupBy("ticker").agg(F.max("date").alias("_last"))
    first_of_month = F.trunc(F.add_months("_last", -months), "month")
    start = F.date_add(first_of_month, F.dayofmonth("_last") - 1)
    return bars.join(last, "ticker").filter(F.col("date") >= start).drop("_last")


def order_seats(seats: DataFrame) -> DataFrame:
    """A person's seats with their ``position``: committees by name, each before its subcommittees. A person has few seats."""
    order = ["committee_name", F.col("subcommittee_name").isNotNull(), F.coalesce("subcommittee_name", F.lit("")), "temporal_precision"]
    return seats.withColumn("position", F.row_number().over(Window.partitionBy("politician_id").orderBy(*order))).orderBy("politician_id", "position")


def committee_groups(seats: DataFrame) -> DataFrame:
    """Per person and committee: the role on the full committee and the subcommittees under it."""
    sub = F.col("subcommittee_code").isNotNull()
    return seats.groupBy("politician_id", "committee_code").agg(
        F.min("committee_name").alias("committee_name"),
        F.max(F.when(~sub, F.col("role"))).alias("role"),
        F.array_sort(F.collect_set(F.when(sub, F.struct(
            F.coalesce("subcommittee_name", "subcommittee_code").alias("name"), "role")))).alias("subcommittees"),
    )


def distinct_values(df: DataFrame, column) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct()


def fresh_explanations(explanations: DataFrame, context: DataFrame) -> DataFrame:
    """The newest stored explanation per trade that was written for exactly the current context."""
    current = context.select("trade_id", "context_version", "mapping_version", F.col("result_digest").alias("context_digest"))
    return (
        explanations.filter(F.col("prompt_version") == K.PROMPT_VERSION)
        .join(current, ["trade_id", "context_version", "mapping_version", "context_digest"], "left_semi")
        .groupBy("trade_id").agg(F.max_by(F.struct("id", "headline", "created_at"), F.struct("created_at", "id")).alias("e"))
        .select("trade_id", F.col("e.id").alias("explanation_id"), "e.headline", "e.created_at")
    )
