"""Session settings the jobs are written for, and where they may put intermediate tables."""

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # hot tickers and hot people are split at the join, also where that costs one more exchange
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app="civicledger", master=None, shuffle_partitions=None):
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


#: folders of local sessions that name none, by application
_OWN_FOLDERS = {}


def work_dir(spark):
    """The cluster's shared folder for intermediate tables; a local session without one gets its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _OWN_FOLDERS:
        _OWN_FOLDERS[application] = tempfile.mkdtemp(prefix="civicledger-")
        atexit.register(shutil.rmtree, _OWN_FOLDERS[application], ignore_errors=True)  # what a local session stored ends with it
    return _OWN_FOLDERS[application]


#: bytes of a table per partition of a shuffle, and of shuffled bytes that adaptive execution puts into one task
INPUT_BYTES, TASK_BYTES = 2 << 20, 4 << 20


def fit_shuffles(spark, path):
    """Deal shuffles over partitions that grow with the table at `path`, so that what a task sorts or gathers stays the same.

    A session's own settings stay where they are finer. Rows here compress to few bytes, so tasks of the usual 64 MB would hold millions.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    size = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    if size // INPUT_BYTES > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(size // INPUT_BYTES))
    advised = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    given = spark.conf.get(advised, None)
    if given is None or given in ("64MB", "67108864b", "67108864"):
        spark.conf.set(advised, f"{TASK_BYTES}b")


#: intermediate tables are read back a few times at most, so they are packed tightly
PACKED = "zstd"


@contextmanager
def shuffles_freed(spark):
    """Shuffle files of a query that runs in here go when it ends. Else they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    given = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, given)


def write_packed(df, path, partition=None):
    """Write a table that ends a plan; nothing of the plan's shuffles stays."""
    writer = df.write.option("compression", PACKED)
    with shuffles_freed(df.sparkSession):
        (writer.partitionBy(partition) if partition else writer).parquet(path)


def stored(df, name):
    """Write a result once to the shared folder and read it back: the plan behind it ends there.

    Later steps start from files any executor can read again, so a lost executor repeats none of the work before.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/civicledger/{name}-{uuid.uuid4().hex}"
    write_packed(df, path)
    return spark.read.parquet(path)


def unstored(df):
    """Drop a table that :func:`stored` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
