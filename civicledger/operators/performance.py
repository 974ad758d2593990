"""Returns of disclosed trades against a benchmark, to the latest bar or over a fixed number of days."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.rules import date_problem, day, direction, ret, spread_null
from ..functions.text import legacy_value
from ..session import stored
from .asof import asof_backward, forward_days, price_series, repeat_days, with_first_day
from .ordered import newest_per


def leg_days(bars: DataFrame, benchmark: DataFrame, horizon_days=None) -> DataFrame:
    """The outcome of a leg for every (security, stated day) that finds a price.

    A leg depends on nothing but the security and the stated day, so it is worked out on that calendar grid and not
    per trade. All ordered work happens inside one security's daily rows.
    """
    by_day = Window.partitionBy("ticker").orderBy(F.unix_date("date"))
    whole = Window.partitionBy("ticker")
    series = price_series(bars)
    priced = series.select(
        "*",
        F.max("date").over(whole).alias("latest_date"),
        F.max_by("price", "date").over(whole).alias("latest_price"),
    )
    if horizon_days is None:
        priced = priced.select(
            "*", F.col("latest_date").alias("end_date"), F.col("latest_price").alias("end_price"),
            F.lit(True).alias("elapsed"))
    else:
        reach = by_day.rangeBetween(0, horizon_days)
        priced = priced.select(
            "*", F.last("date").over(reach).alias("end_date"), F.last("price").over(reach).alias("end_price"),
            (F.col("latest_date") >= F.date_add("date", horizon_days)).alias("elapsed"))

    # what the benchmark stood at on a day: reduced to one row per calendar day, so broadcasting it is bounded
    bench = price_series(benchmark).groupBy("date").agg(F.min_by("price", "ticker").alias("price")).select(F.lit("b").alias("bench"), "date", "price")
    starts = forward_days(bench, on="bench").select(
        "day", F.col("date").alias("b_date"), F.col("price").alias("b_price"))
    end_days = priced.select("end_date").distinct().withColumn("bench", F.lit("b"))
    ends = asof_backward(end_days, bench, "end_date", on="bench").select(
        "end_date", F.col("asof_date").alias("b_end_date"), F.col("asof_price").alias("b_end_price"))

    # the end is looked up per bar, before a bar is repeated for the days it answers
    priced = with_first_day(priced).join(F.broadcast(ends), "end_date", "left")
    legs = repeat_days(priced).join(F.broadcast(starts), "day", "left")
    ok = F.col("elapsed")
    return_ = F.when(ok, ret("price", "end_price"))
    bench_return = F.when(ok & (F.col("b_date") <= F.col("b_end_date")), ret("b_price", "b_end_price"))
    return legs.select(
        "ticker", "day",
        F.when(ok, K.OK).otherwise(K.HORIZON_NOT_ELAPSED).alias("status"),
        F.col("date").alias("anchor_date"), "price",
        return_.alias("return"), bench_return.alias("benchmark_return"),
        (return_ - bench_return).alias("excess_return"),
    )


#: (security, day) rows up to which each task holds the whole grid, about 40 MB
SENT_ROWS = 1 << 18
LEG_FIELDS = ["anchor_date", "price", "return", "benchmark_return", "excess_return"]


def _leg(trades, grid, date_col, today, name):
    found = grid.select(
        F.col("ticker").alias("_ticker"), F.col("day").alias(date_col),
        F.struct("status", *LEG_FIELDS).alias("_found"))
    joined = trades.join(found, ["_ticker", date_col], "left")
    stated = F.col(date_col)
    usable = stated <= day(today)
    status = (
        F.when(stated.isNull(), K.NO_DATE)
        .when(~usable, K.INVALID_DATE)
        .otherwise(F.coalesce("_found.status", F.lit(K.NO_PRICE_AT_DATE)))
    )
    fields = [F.when(usable, F.col(f"_found.{f}")).alias(f) for f in LEG_FIELDS]
    return joined.withColumn(name, F.struct(status.alias("status"), *fields)).drop("_found")


def trade_performance(trades, bars, benchmark, today, horizon_days=None, legs=("transaction", "disclosure")):
    """Trades with ``status``, ``detail``, the latest bar, a direction and one struct per leg.

    Trades need id, ticker, transaction_type, transaction_date and disclosure_date; other columns pass through. A
    caller that reads one leg asks for that one and saves an exchange of the fact table.
    """
    series = price_series(bars)
    latest = series.groupBy(F.col("ticker").alias("_ticker")).agg(
        F.max("date").alias("latest_date"), F.max_by("price", "date").alias("latest_price"))
    # written once, so that it can be counted: trades are dealt anew only to meet a grid that tasks should not hold
    grid = stored(leg_days(bars, benchmark, horizon_days), "leg-days")
    if grid.count() <= SENT_ROWS:
        grid = F.broadcast(grid)
    out = trades.withColumn("_ticker", spread_null("ticker", "id")).join(latest, "_ticker", "left")
    for name in legs:
        out = _leg(out, grid, f"{name}_date", today, name)
    problem = date_problem("transaction_date", "disclosure_date", today)
    main = F.col("transaction.status") if "transaction" in legs else F.lit(K.OK)
    status = (
        F.when(F.coalesce("ticker", F.lit("")) == "", K.NO_TICKER_STATUS)
        .when(problem.isNotNull(), K.INVALID_DATE)
        .when(F.col("latest_date").isNull(), K.NO_PRICES)
        .otherwise(main)
    )
    out = out.withColumn("status", status).withColumn(
        "detail", F.when((F.col("status") == K.INVALID_DATE) & (F.coalesce("ticker", F.lit("")) != ""), problem))
    measured = ~F.col("status").isin(K.NO_TICKER_STATUS, K.INVALID_DATE, K.NO_PRICES)
    out = out.withColumn("latest_date", F.when(measured, F.col("latest_date")))
    out = out.withColumn("latest_price", F.when(measured, F.col("latest_price")))
    out = out.withColumn("direction", F.when(measured, direction("transaction_type")))
    for name in legs:
        out = out.withColumn(name, F.when(measured, F.col(name)))
    signed = [
        (F.col("direction") * F.col(f"{leg}.{field}")).alias(f"{leg}_{field}")
        for leg in legs for field in ("return", "excess_return")
    ]
    return out.withColumn("direction_adjusted", F.struct(*signed)).drop("_ticker")


def performance_status_counts(perf: DataFrame) -> DataFrame:
    """How many trades ended in each status, for the trade itself and for its disclosure leg."""
    return (
        perf.select(F.explode(F.array(
            F.struct(F.lit("trade").alias("leg"), F.col("status")),
            F.struct(F.lit("disclosure").alias("leg"), F.col("disclosure.status").alias("status")),
        )).alias("s"))
        .filter("s.status IS NOT NULL")
        .groupBy("s.leg", "s.status").agg(F.count("*").alias("trades"))
    )


def security_averages(perf: DataFrame) -> DataFrame:
    """Mean return and mean excess return of a security's priced trades, and how many trades were purchases."""
    priced = F.col("status") == K.OK
    return perf.filter("ticker IS NOT NULL").groupBy("ticker").agg(
        F.count("*").alias("trades"),
        F.count_if(priced).alias("priced_trades"),
        F.count_if(F.col("transaction_type") == "buy").alias("buys"),
        F.avg(F.when(priced, F.col("transaction.return"))).alias("avg_return"),
        F.avg(F.when(priced, F.col("transaction.excess_return"))).alias("avg_excess_return"),
    )


def security_performance(trades, bars, benchmark, today, ticker=None, limit=None):
    """The trades of every security, or of one, with their performance; ``limit`` narrows it to the newest of each."""
    wanted = trades.filter("ticker IS NOT NULL")
    if ticker is not None:
        wanted, bars = (df.filter(F.col("ticker") == ticker.upper()) for df in (wanted, bars))
    if limit:
        wanted = newest_per(wanted, "ticker", [F.col("transaction_date").desc(), F.col("id").desc()], limit)
    return trade_performance(wanted, bars, benchmark, today)


def rebased_series(bars, benchmark, perf, start=None):
    """Each security and the benchmark as a percentage of their first shown price, with prices at buys and sells."""
    shown = bars.filter(F.col("adj_close").isNotNull())
    if start is not None:
        shown = shown.filter(F.col("date") >= day(start))
    by_day = Window.partitionBy("ticker").orderBy("date")
    whole = Window.partitionBy("ticker")
    priced = shown.select(
        "ticker", "date", "adj_close",
        F.first("adj_close").over(by_day).alias("base"), F.min("date").over(whole).alias("first_date"))
    bench = benchmark.filter(F.col("adj_close").isNotNull()).select(
        F.lit("b").alias("bench"), "date", F.col("adj_close").alias("price"))
    firsts = priced.select("first_date").distinct().withColumn("bench", F.lit("b"))
    # the base is the benchmark's next row, however far ahead: look backward on a mirrored calendar
    mirror = bench.withColumn("date", F.date_from_unix_date(-F.unix_date("date")))
    bases = asof_backward(
        firsts.withColumn("mirrored", F.date_from_unix_date(-F.unix_date("first_date"))), mirror, "mirrored", on="bench"
    ).select("first_date", F.col("asof_price").alias("bench_base"))
    marks = (
        perf.select("ticker", F.col("transaction.anchor_date").alias("date"), direction("transaction_type").alias("d"))
        .filter("date IS NOT NULL AND d IS NOT NULL")
        .groupBy("ticker", "date")
        .agg(F.bool_or(F.col("d") > 0).alias("bought"), F.bool_or(F.col("d") < 0).alias("sold"))
    )
    rebased = F.col("adj_close") / F.col("base") * 100
    return (
        priced.join(bench.select("date", F.col("price").alias("bench_price")), "date", "left")
        .join(bases, "first_date", "left")
        .join(marks, ["ticker", "date"], "left")
        .select(
            "ticker", "date", rebased.alias("price_index"),
            (F.col("bench_price") / F.col("bench_base") * 100).alias("benchmark_index"),
            F.when(F.col("bought"), rebased).alias("buy_mark"),
            F.when(F.col("sold"), rebased).alias("sell_mark"),
        )
    )


def legacy_notable_filter(trades: DataFrame, today) -> DataFrame:
    """Recent purchases and sales of plain tickers whose disclosed range is worth reporting."""
    ticker = F.upper(F.trim(F.coalesce("ticker", F.lit(""))))
    kind = F.lower(F.coalesce("trade_type", F.lit("")))
    return (
        trades.withColumn("ticker", ticker)
        .withColumn("estimated_value", legacy_value("amount"))
        .filter(F.col("transaction_date") >= F.date_sub(day(today), K.LEGACY_LOOKBACK_DAYS))
        .filter(~F.col("ticker").isin("", "--", "N/A") & (F.length("ticker") <= K.LEGACY_MAX_TICKER))
        .filter(kind.contains("purchase") | kind.contains("sale"))
        .filter(F.col("estimated_value") >= K.LEGACY_MIN_VALUE)
        .withColumn("side", F.when(kind.contains("purchase"), "BUY").otherwise("SELL"))
    )


def legacy_move(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Percent move from the first close after the (weekday-rolled) trade date to the newest close."""
    closes = bars.select("ticker", "date", F.col("close").alias("price")).filter("price IS NOT NULL")
    current = closes.groupBy("ticker").agg(F.max_by("price", "date").alias("current_price"))
    weekday = F.weekday("transaction_date")
    rolled = F.date_add("transaction_date", F.when(weekday >= 5, 7 - weekday).otherwise(0))
    grid = forward_days(closes, K.LEGACY_GAP_DAYS).select(
        "ticker", F.col("day").alias("_rolled"), F.col("price").alias("price_at_trade"))
    start, now = F.col("price_at_trade"), F.col("current_price")
    usable = (start > 0) & (now > 0)
    return (
        trades.withColumn("_rolled", rolled)
        .join(grid, ["ticker", "_rolled"], "left").drop("_rolled")
        .join(current, "ticker", "left")
        .withColumn("price_move_pct", F.when(usable, (now - start) / start * 100))
    )


def notable_moves(moves: DataFrame, n=K.LEGACY_TOP_N) -> DataFrame:
    size = F.abs("price_move_pct")
    return (
        moves.filter("price_move_pct IS NOT NULL")
        .withColumn("notable", size >= K.LEGACY_MIN_MOVE_PCT)
        .orderBy(size.desc(), F.col("id")).limit(n)
    )

