"""Daily bars as a provider delivers them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VALUES = ["open", "high", "low", "close", "adj_close"]


def provider_symbol(ticker):
    """Providers write share classes with a hyphen; the ticker itself is kept as disclosed."""
    return F.replace(ticker, F.lit("."), F.lit("-"))


def normalize_bars(raw: DataFrame, tickers: DataFrame | None = None) -> DataFrame:
    """Bars with not-a-number turned into NULL, days without a close left out.

    With ``tickers`` the provider's symbols are mapped back to the tickers that were asked for.
    """
    out = raw.withColumns({v: F.nanvl(F.col(v).cast("double"), F.lit(None).cast("double")) for v in VALUES})
    volume = F.nanvl(F.col("volume").cast("double"), F.lit(None).cast("double")).cast("long")
    out = out.filter("close IS NOT NULL").withColumn("volume", volume)
    if tickers is not None:
        asked = tickers.select("ticker", provider_symbol("ticker").alias("_symbol")).distinct()
        out = out.withColumnRenamed("ticker", "_symbol").join(asked, "_symbol").drop("_symbol")
    return out
