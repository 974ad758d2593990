"""The daily price table by ticker bucket and month: a fetch rewrites the folders of its own range and no others.

Layout: bars/bucket=<b>/month=<yyyy-MM>. A ticker has one bucket, so a fetch of some days reads and replaces one folder per touched
bucket and month, however long the history is. Folders are replaced by dynamic partition overwrite after the new rows were written
aside; a folder that loses all its bars is removed. A run that is lost half-way is simply repeated: the same answer gives the same table.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from ..streaming.ledger import Files
from .prices import apply_price_batch

CELL = ["bucket", "month"]


def month_of(date):
    return F.date_format(date, "yyyy-MM")


class PriceTable:
    def __init__(self, spark: SparkSession, root, buckets=16):
        self.spark, self.root, self.buckets = spark, str(root).rstrip("/"), buckets
        self.path, self.files = f"{self.root}/bars", Files(spark, f"{self.root}/bars")

    def placed(self, bars: DataFrame) -> DataFrame:
        return bars.withColumns({"bucket": F.pmod(F.xxhash64("ticker"), F.lit(self.buckets)).cast("int"), "month": month_of("date")})

    def write(self, placed: DataFrame):
        """Replace the folders that `placed` has rows for."""
        rows = placed.repartition(*CELL).sortWithinPartitions(*CELL, "ticker", "date")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*CELL).parquet(self.path)

    def create(self, bars: DataFrame):
        self.write(self.placed(bars))

    def read(self) -> DataFrame:
        return self._cells().drop(*CELL)

    def _cells(self) -> DataFrame:
        # months look like dates to the discovery of partitions
        return self.spark.read.parquet(self.path).withColumns({"bucket": F.col("bucket").cast("int"), "month": F.substring(F.col("month").cast("string"), 1, 7)})

    def within(self, buckets) -> DataFrame:
        """Bars, with their cells, of some buckets and a range of months each: {bucket: (first month, last month)}; all months where None."""
        wanted = F.lit(False)
        for bucket, months in sorted(buckets.items()):
            here = F.col("bucket") == bucket
            wanted = wanted | (here if months is None else here & F.col("month").between(*months))
        return self._cells().filter(wanted)

    def apply(self, incoming: DataFrame, plan: DataFrame, securities: DataFrame, now, whole=False) -> tuple[DataFrame, DataFrame]:
        """Apply a fetch as `apply_price_batch` does, to this table; (securities, outcome per ticker).

        Reads the buckets and months of the plan, writes those of the tickers whose outcome is `written`.
        """
        ranges = plan.select("ticker", "lo", "hi", F.pmod(F.xxhash64("ticker"), F.lit(self.buckets)).cast("int").alias("bucket"))
        spans = ranges.groupBy("bucket").agg(F.min(month_of("lo")).alias("lo"), F.max(month_of("hi")).alias("hi")).collect()  # a row per bucket
        cells = stored(self.within({r["bucket"]: None if whole else (r["lo"], r["hi"]) for r in spans}), "price-cells")
        bars, new_securities, outcome = apply_price_batch(cells.drop(*CELL), incoming, plan, securities, now, whole)
        outcome = stored(outcome, "price-outcome")
        written = outcome.filter("outcome = 'written'").select("ticker").join(ranges, "ticker")
        months = F.explode(F.transform(F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"), F.expr("INTERVAL 1 MONTH")), month_of))
        touched = written.select("bucket", months.alias("month")).distinct()
        if whole:  # what lies outside the plan's range goes too
            touched = touched.union(cells.join(written.select("ticker"), "ticker", "left_semi").select(*CELL)).distinct()
        touched = stored(touched, "price-touched")
        new = stored(self.placed(bars).join(touched, CELL, "left_semi"), "price-new")
        if not new.isEmpty():
            self.write(new)
        # buckets x months of the fetch at most
        for r in cells.select(*CELL).distinct().join(touched, CELL, "left_semi").join(new.select(*CELL).distinct(), CELL, "left_anti").collect():
            self.files.delete(f"bucket={r['bucket']}/month={r['month']}")
        return new_securities, outcome
