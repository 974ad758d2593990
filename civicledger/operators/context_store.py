"""Where contexts and their evidence are kept: a log of changes per engine and mapping version."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..streaming.ledger import Ledger, Table
from .context import VERSION_KEY, context_actions

TABLES = {"context": Table(keys=tuple(VERSION_KEY)), "evidence": Table(keys=tuple(VERSION_KEY))}


class ContextStore:
    """A run writes the rows it inserts or changes, with their evidence, and nothing else; other versions are not touched.

    Readers merge the changes of one version. An equal second run writes no row and leaves no folder, and so does an empty one.
    """

    def __init__(self, spark: SparkSession, root):
        self.spark, self.root = spark, str(root).rstrip("/")

    def ledger(self, version, mapping) -> Ledger:
        return Ledger(self.spark, f"{self.root}/{version}/mappings-{mapping}", TABLES)

    def load(self, table, mappings: DataFrame, version=K.ENGINE_VERSION) -> DataFrame | None:
        """The stored rows ("context" or "evidence") of the newest mapping version; None where that was never analysed."""
        newest = mappings.agg(F.max("mapping_version")).first()[0]
        return self.ledger(version, newest).read(table)

    def save(self, new: DataFrame, evidence, force=False) -> DataFrame:
        """Store a run's rows of one version; (action, rows, evidence) tells what became of all rows of that version.

        Evidence of new and changed rows is replaced, that of all others stays as it is. ``evidence`` is a table, or a function that
        derives it from context rows: then only that of the changed rows is worked out, and needs no join.
        """
        versions = new.select("context_version", "mapping_version").distinct().limit(2).collect()
        if not versions:
            return self.spark.createDataFrame([], "action string, rows long, evidence long")
        (version,) = versions
        ledger = self.ledger(*version)
        change = ledger.begin()
        old = change.base.read("context")
        if old is None:
            merged, changed = new.select(*VERSION_KEY, F.lit("inserted").alias("action")), new
        else:
            # only keys and actions are staged; the rows are read where they lie
            merged = change.staged(context_actions(new, old, force))
            changed = new.join(merged.filter("action IN ('inserted', 'updated')").select(*VERSION_KEY), VERSION_KEY, "left_semi")
        some = old is None or not merged.filter("action IN ('inserted', 'updated')").isEmpty()
        if some:
            changed = change.add("context", changed.drop("action"))
            proofs = evidence(changed) if callable(evidence) else evidence.join(changed.select(*VERSION_KEY), VERSION_KEY, "left_semi")
            # only a changed row may have had evidence that it has no more
            gone = None if old is None else merged.filter("action = 'updated'").select(*VERSION_KEY).join(proofs, VERSION_KEY, "left_anti")
            change.add("evidence", proofs, gone=gone)
        proofs = change.preview().read("evidence")
        counts = proofs.groupBy("trade_id").agg(F.count("*").alias("n"))
        out = merged.select("trade_id", "action").join(counts, "trade_id", "left").groupBy("action").agg(
            F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("evidence")).collect()  # a row per action
        if some:
            change.commit()
            ledger.compact()
        else:
            change.discard()
        return self.spark.createDataFrame(out, "action string, rows long, evidence long")
