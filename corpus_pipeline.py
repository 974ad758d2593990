"""The corpus pipeline: each stage works on what the one before it kept; the last one packs the rest.

Each row is decided on its own, also without an id or with one that other rows have: what a stage rejects is found again by id and text.
"""

from pyspark.sql import functions as F

from civicledger.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from civicledger.llm.queries import table, vocabulary
from civicledger.session import stored

#: rows to go that may be sent to all tasks; beyond it documents are joined to them by a shuffle
SENT_IDS = 1_000_000
#: names of the hash and the number of a row within a stage, which no table has
FP, ROW = "pipeline_fp", "pipeline_row"


def _marked(docs, *further):
    """docs with the hash of what a row is judged by besides its id."""
    return docs.withColumn(FP, F.xxhash64("text", *further))


def _without(docs, gone):
    """Marked docs but for the rows with an id and a hash of gone."""
    gone = stored(gone.select(F.col("doc_id").alias("gone"), F.col(FP).alias("gone fp")).distinct(), "rows-to-go")
    gone = F.broadcast(gone) if gone.count() <= SENT_IDS else gone
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone"]) & (docs[FP] == gone["gone fp"]), "left_anti").drop(FP)


def quality_rules(spark, docs, sf_dir):
    """Documents that the rules reject go."""
    docs = _marked(docs, "lang")
    return _without(docs, quality.judge(docs, table(spark, sf_dir, "labels"), carried=(FP,)).where(~F.col("kept")))


def lines_once(spark, docs, sf_dir):
    """Repeated lines go; so do documents of which no visible line is left. n_chars follows the text."""
    out = line_dedup.dedup(docs, counted=True).where("n_lines = 0 or n_dropped < n_lines")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def one_of_each_group(spark, docs, sf_dir):
    """Of documents whose shingles link them, the one with the least id stays; one without an id only if none has one."""
    docs = stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    rows = jaccard_join.join(docs, id_column=ROW)[0].select(F.col(ROW).alias("row"), F.col("component_id").alias("component"))
    rows = stored(rows.join(docs.select(F.col(ROW).alias("row"), "doc_id"), "row"), "components-of-rows")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    groups = rows.groupBy("component").agg(F.count("*").alias("n"), F.min(order).alias("kept")).where("n > 1")
    groups = stored(groups.select("component", F.col("kept.row").alias("kept")), "groups")
    gone = rows.join(F.broadcast(groups) if groups.count() <= SENT_IDS else groups, "component").where("row <> kept").select("row")
    gone = stored(gone, "rows-to-go")
    return docs.join(F.broadcast(gone) if gone.count() <= SENT_IDS else gone, docs[ROW] == gone["row"], "left_anti").drop(ROW)


def decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark passage go."""
    docs = _marked(docs)
    found = decontaminate.contaminated(docs.withColumn(ROW, F.struct("doc_id", FP)), table(spark, sf_dir, "benchmark"), id_column=ROW)
    return _without(docs, found.where("n_hit > 0").select(f"{ROW}.*"))


def packed(spark, docs, sf_dir):
    """What is left, as pieces of sequences of 2048 tokens."""
    return packing.digests(packing.pack(docs, vocabulary("word_bpe_49k.json")))


STAGES = [("quality_rules", quality_rules), ("line_dedup", lines_once), ("ngram_jaccard_join", one_of_each_group), ("decontamination", decontamination), ("packing", packed)]
#: SQL has neither the tokenizers nor the similarity operators
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
