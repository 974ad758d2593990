"""Keeping the daily price table current: what to fetch, in which batches, and how an answer is applied."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.rules import date_problem, day


def price_starts(trades: DataFrame, today, benchmark) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(earliest day needed per ticker, invalid trades with the reason, tickers without any valid trade)."""
    listed = trades.filter("ticker IS NOT NULL").withColumn(
        "problem", date_problem("transaction_date", "disclosure_date", today))
    known_disclosure = F.when(F.col("disclosure_date") <= day(today), F.col("disclosure_date"))
    earliest = F.least("transaction_date", known_disclosure, day(today))
    per_ticker = listed.groupBy("ticker").agg(
        F.min(F.when(F.col("problem").isNull(), earliest)).alias("start"))
    starts = per_ticker.filter("start IS NOT NULL")
    bench = starts.agg(F.min("start").alias("start")).filter("start IS NOT NULL").select(
        F.lit(benchmark).alias("ticker"), "start")
    all_starts = starts.filter(F.col("ticker") != benchmark).unionByName(bench)
    invalid = listed.filter("problem IS NOT NULL").select("id", "ticker", "problem")
    return all_starts, invalid, per_ticker.filter("start IS NULL").select("ticker")


def price_fetch_plan(starts, securities, today, now, retry_days=7, overlap_days=7) -> DataFrame:
    """(ticker, action, lo, hi) with action deferred, fetch or cached.

    ``securities`` carries price_status, price_checked_at, price_from and price_to; ``now`` is a timestamp.
    """
    known = securities.select("ticker", "price_status", "price_checked_at", "price_from", "price_to")
    end, now = day(today), F.lit(str(now)).cast("timestamp_ntz")
    waiting = (F.col("price_status") == "unavailable") & (
        F.col("price_checked_at") > now - F.make_dt_interval(F.lit(retry_days)))
    uncovered = F.col("price_from").isNull() | F.col("price_to").isNull()
    head, tail = F.col("start") < F.col("price_from"), F.col("price_to") < end
    lo = F.when(uncovered | head, F.col("start")).when(tail, F.date_sub("price_to", overlap_days))
    hi = F.when(uncovered | tail, end).when(head, F.col("price_from"))
    planned = starts.join(known, "ticker", "left").withColumn(
        "action",
        F.when(F.coalesce(waiting, F.lit(False)), "deferred").when(uncovered | head | tail, "fetch").otherwise("cached"))
    fetch = F.col("action") == "fetch"
    return planned.select(
        "ticker", "action", F.when(fetch, lo).alias("lo"), F.when(fetch, hi).alias("hi"), "start",
        F.col("price_from").isNotNull().alias("had_coverage"))


def batch_plan(plan: DataFrame, size=40) -> DataFrame:
    """Fetches sorted by (lo, hi, ticker) and cut into batches of ``size``; each batch covers its widest range.

    The position of a fetch is the number of fetches that start on earlier days, plus that of fetches from the same day with
    an earlier end, plus its place in its own range. The only step over all rows at once has one row per calendar day.
    """
    fetch = plan.filter("action = 'fetch'")
    before = (Window.unboundedPreceding, -1)
    ranges = fetch.groupBy("lo", "hi").agg(F.count("*").alias("_n"))
    days = ranges.groupBy("lo").agg(F.sum("_n").alias("_day")).withColumn(
        "_earlier", F.coalesce(F.sum("_day").over(Window.orderBy("lo").rowsBetween(*before)), F.lit(0)))
    same_day = Window.partitionBy("lo").orderBy("hi").rowsBetween(*before)
    offsets = (
        ranges.withColumn("_same", F.coalesce(F.sum("_n").over(same_day), F.lit(0))).join(days, "lo")
        .select("lo", "hi", (F.col("_earlier") + F.col("_same")).alias("_before"))
    )
    inside = Window.partitionBy("lo", "hi").orderBy("ticker")
    placed = (
        fetch.withColumn("_place", F.row_number().over(inside) - 1).join(offsets, ["lo", "hi"])
        .withColumn("batch", F.floor((F.col("_before") + F.col("_place")) / size))
    )
    whole = Window.partitionBy("batch")
    return placed.withColumns({
        "batch_lo": F.min("lo").over(whole), "batch_hi": F.max("hi").over(whole),
        "batch_size": F.count("*").over(whole),
    }).drop("_before", "_place")


def detect_restatement(bars: DataFrame, incoming: DataFrame, tol=K.ADJ_DRIFT_TOLERANCE) -> DataFrame:
    """Per ticker: did an adjusted close we already hold come back changed?"""
    old = bars.select("ticker", "date", F.col("adj_close").alias("_old"))
    both = incoming.select("ticker", "date", F.col("adj_close").alias("_new")).join(old, ["ticker", "date"])
    moved = F.when((F.col("_old") != 0) & (F.col("_new") != 0), F.abs(F.col("_new") / F.col("_old") - 1) > tol)
    return both.groupBy("ticker").agg(
        F.coalesce(F.bool_or(moved), F.lit(False)).alias("restated"),
        F.count("*").alias("overlapping_bars"),
    )


def batch_failed(incoming: DataFrame, batches: DataFrame) -> DataFrame:
    """(batch, failed): a batch of several tickers that brought nothing at all is a failure, not missing data."""
    held = incoming.groupBy("ticker").agg(F.count("*").alias("_bars"))
    return batches.join(held, "ticker", "left").groupBy("batch").agg(
        ((F.coalesce(F.sum("_bars"), F.lit(0)) == 0)
         & (F.count("*") >= K.MIN_BATCH_FOR_TOTAL_FAILURE)).alias("failed"))


def apply_price_batch(bars, incoming, plan, securities, now, whole=False):
    """Apply fetched bars: (bars, securities, outcome per ticker).

    ``plan`` has ticker, lo, hi, had_coverage and batch. Outcomes: written, restated (rebuild later), unavailable,
    too_recent, failed. Only written ranges are replaced; ``whole`` replaces a security's complete history.
    """
    ranges = plan.select("ticker", "lo", "hi", "had_coverage", "batch")
    wanted = incoming.join(ranges.select("ticker", "lo", "hi"), "ticker").filter("date BETWEEN lo AND hi").drop("lo", "hi")
    held = wanted.groupBy("ticker").agg(F.count("*").alias("bars_fetched"))
    drift = detect_restatement(bars, wanted).select("ticker", "restated")
    empty = F.col("bars_fetched") == 0
    outcome = (
        ranges.join(batch_failed(incoming, ranges), "batch", "left")
        .join(held, "ticker", "left").join(drift, "ticker", "left")
        .withColumn("bars_fetched", F.coalesce("bars_fetched", F.lit(0)))
        .withColumn(
            "outcome",
            F.when(F.col("failed"), "failed")
            .when(empty & ~F.col("had_coverage") & (F.datediff("hi", "lo") >= K.MIN_SPAN_TO_CALL_UNAVAILABLE), "unavailable")
            .when(empty & ~F.col("had_coverage"), "too_recent")
            .when(empty & F.lit(whole), "failed")
            .when(F.lit(not whole) & F.col("had_coverage") & F.coalesce("restated", F.lit(False)), "restated")
            .otherwise("written"))
        .drop("failed", "restated")
    )
    written = outcome.filter("outcome = 'written'").select("ticker", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    replaced = F.lit(True) if whole else F.col("b.date").between(F.col("w._lo"), F.col("w._hi"))
    kept = bars.alias("b").join(written.alias("w"), (F.col("b.ticker") == F.col("w.ticker")) & replaced, "left_anti")
    new_bars = kept.unionByName(wanted.join(written.select("ticker"), "ticker", "left_semi").select(*bars.columns))

    seen = outcome.select("ticker", "lo", "hi", "had_coverage", "outcome")
    done = F.col("outcome") == "written"
    fresh = F.lit(whole) | ~F.col("had_coverage")
    touched = done | (F.col("outcome") == "unavailable")
    new_securities = (
        securities.join(seen, "ticker", "left")
        .withColumn("price_from", F.when(done & fresh, F.col("lo")).when(done, F.least("price_from", "lo"))
                    .otherwise(F.col("price_from")))
        .withColumn("price_to", F.when(done & fresh, F.col("hi")).when(done, F.greatest("price_to", "hi"))
                    .otherwise(F.col("price_to")))
        .withColumn("price_status", F.when(done, "ok").when(F.col("outcome") == "unavailable", "unavailable")
                    .otherwise(F.col("price_status")))
        .withColumn("price_checked_at", F.when(touched, F.lit(str(now)).cast("timestamp_ntz"))
                    .otherwise(F.col("price_checked_at")))
        .select(*securities.columns)
    )
    return new_bars, new_securities, outcome


def rebuild_plan(outcome: DataFrame, starts: DataFrame, today) -> DataFrame:
    """Whole-history fetches for the securities whose adjusted closes were restated."""
    return outcome.filter("outcome = 'restated'").select("ticker", "had_coverage").join(
        starts.select("ticker", "start"), "ticker"
    ).select("ticker", F.lit("fetch").alias("action"), F.col("start").alias("lo"), day(today).alias("hi"),
             "start", "had_coverage")
