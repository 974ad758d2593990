"""As-of lookups on daily series.

A daily series has at most one row per security and calendar day, so everything derived from it is bounded by the
calendar. The lookups are therefore answered once per (security, day); the fact table then meets the answers in a plain
equi-join on (security, day), which spreads a hot security over its days and never multiplies fact rows.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K


def price_series(bars: DataFrame) -> DataFrame:
    """(ticker, date, price): adjusted close where there is one, else close; days without a price are left out."""
    return (
        bars.select("ticker", "date", F.coalesce("adj_close", "close").alias("price"))
        .filter(F.col("price").isNotNull())
    )


def with_first_day(series: DataFrame, max_gap=K.MAX_ANCHOR_GAP_DAYS, on="ticker") -> DataFrame:
    """Adds the first stated day each row is the next row of, never more than ``max_gap`` days earlier."""
    by_day = Window.partitionBy(on).orderBy(F.unix_date("date"))
    first_day = F.greatest(F.date_add(F.lag("date").over(by_day), 1), F.date_sub("date", max_gap))
    return series.withColumn("_first_day", first_day)


def repeat_days(series: DataFrame) -> DataFrame:
    """One row per stated day a row answers; ``day`` is the stated one."""
    return series.withColumn("day", F.explode(F.sequence("_first_day", "date"))).drop("_first_day")


def forward_days(series: DataFrame, max_gap=K.MAX_ANCHOR_GAP_DAYS, on="ticker") -> DataFrame:
    return repeat_days(with_first_day(series, max_gap, on))


def asof_forward(left: DataFrame, series: DataFrame, date_col, max_gap=K.MAX_ANCHOR_GAP_DAYS, on="ticker") -> DataFrame:
    """First row of the series on or after a date, at most ``max_gap`` days away; NULL when there is none."""
    grid = forward_days(series, max_gap, on).select(
        on, F.col("day").alias(date_col), F.col("date").alias("asof_date"), F.col("price").alias("asof_price"))
    return left.join(grid, [on, date_col], "left")


def asof_backward(left: DataFrame, series: DataFrame, date_col, on="ticker") -> DataFrame:
    """Last row of the series on or before a date, however long ago.

    The distinct days asked for are merged into the series and carry the last price forward, so the ordered step sees
    at most the calendar days of one security.
    """
    asked = left.select(on, F.col(date_col).alias("day")).distinct()
    timeline = asked.withColumn("_asked", F.lit(True)).unionByName(
        series.select(on, F.col("date").alias("day"), "date", "price"), allowMissingColumns=True
    )
    so_far = Window.partitionBy(on).orderBy("day", F.col("_asked").isNotNull()).rowsBetween(
        Window.unboundedPreceding, 0)
    found = (
        timeline.select(
            on, F.col("day").alias(date_col), "_asked",
            F.last("date", ignorenulls=True).over(so_far).alias("asof_date"),
            F.last("price", ignorenulls=True).over(so_far).alias("asof_price"),
        )
        .filter("_asked").drop("_asked")
    )
    return left.join(found, [on, date_col], "left")
