"""What round 4 found: disk that is not given back, rows wider than what reads them, work done for texts that cannot need it."""

import os
import time

import pytest
from pyspark.sql import functions as F

from civicledger.operators import context as C, performance as P, screen as S
from civicledger.plans import queries as Q
from civicledger.plans.tables import TODAY, Tables
from civicledger.session import stored, unstored

FOLDER = f"{os.environ.get('TESTDATA', '/root/testdata')}/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_a_stored_table_leaves_no_shuffle_behind(spark):
    before = shuffle_files(spark)
    out = stored(spark.range(1000).repartition(3, "id"), "dealt")
    for _ in range(50):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.2)
    assert shuffle_files(spark) <= before and out.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
    folder = out.inputFiles()[0].rpartition("/")[0].removeprefix("file://")
    unstored(out)
    assert not os.path.exists(folder)


@needs_tables
def test_a_stored_context_derives_its_digests(spark):
    t = Tables(spark, FOLDER)
    kept = Q._stored_context(t)
    written = spark.read.parquet(kept.inputFiles()[0].rpartition("/")[0])
    assert "result_digest" not in written.columns and kept.columns[-1] == "result_digest"
    fresh = Q._context(t).select("trade_id", F.col("result_digest").alias("other"))
    assert fresh.join(kept, "trade_id").filter("other = result_digest").count() == kept.count() == t.trades.count()


def test_trades_are_not_dealt_to_meet_a_grid_that_tasks_can_hold(spark, table):
    bars = table("ticker string, date date, close double, adj_close double", *[("A", f"2025-01-{d:02d}", float(d), None) for d in range(2, 20)])
    trades = table("id string, ticker string, transaction_type string, transaction_date date, disclosure_date date", ("1", "A", "buy", "2025-01-03", "2025-01-09"))
    limit = "spark.sql.autoBroadcastJoinThreshold"
    given = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        out = P.trade_performance(trades, bars, bars, "2025-02-01", legs=("transaction",))
        assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
        assert [r.transaction.anchor_date.day for r in out.collect()] == [3]
    finally:
        spark.conf.set(limit, given)


@needs_tables
def test_a_screen_takes_to_the_join_what_the_rule_says(spark):
    t = Tables(spark, FOLDER)
    out = S.screened(Q._screen_tables(t), S.PRESETS["strict"]).select("id", "matches")
    plan = out._jdf.queryExecution().optimizedPlan()
    sides = [n for n in plan.toString().split("\n") if "Join LeftOuter" in n]
    assert len(sides) == 1
    joins = [node for node in _nodes(plan) if node.nodeName() == "Join" and node.joinType().toString() == "LeftOuter"]
    names = joins[0].right().output().mkString(",")
    assert "matches" in names and "performance_status" not in names and "excess_return" not in names


def _nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from _nodes(plan.children().apply(i))


@needs_tables
@pytest.mark.parametrize("limit", ["10485760", "-1"])
def test_counts_of_lists_are_those_of_each_screen(spark, limit):
    tables, rule = Q._screen_tables(Tables(spark, FOLDER)), S.PRESETS["market_focus"]
    # one trade has no context: lists that ask nothing of a context still take it
    missing = tables.context.orderBy("trade_id").limit(40).select("trade_id")
    tables.context = tables.context.join(missing, "trade_id", "left_anti")
    lists = {name: Q.filters_of(name) for name in Q.FILTER_SETS} | {"all": [], "own": Q.filters_of("dimensions")[:3]}
    name, given = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(name, limit)
    try:
        each = {r.filters: tuple(r)[1:] for r in S.screen_counts_each(tables, rule, lists).collect()}
        for key, filters in lists.items():
            assert each[key] == tuple(S.screen_counts(S.screened(tables, rule, filters)).first()), key
    finally:
        spark.conf.set(name, given)
    wide = S.screen_counts_each(tables, rule, lists)._jdf.queryExecution().optimizedPlan()
    met = [n for n in _nodes(wide) if n.nodeName() == "Join" and n.joinType().toString() == "LeftOuter" and "politician_name" in n.left().output().mkString(",")]
    assert not met  # names are judged before any join


def test_an_audit_reads_the_words_of_a_text_once(spark):
    from civicledger.operators import audit as A

    facts = spark.createDataFrame(
        [("t", [20.0], [("Committee on Sea Ports", None)], "Ada Mc", False)],
        "trade_id string, numbers array<double>, committees array<struct<committee_name:string,subcommittee_name:string>>, own_names string, flagged boolean")
    texts = spark.createDataFrame(
        [("t", "A", "The Air Committee saw 20 and 21 flags. The Committee on Sea Ports of Mc met an insider.", "C", [("committee_relevance", "COMMITTEES met.")])],
        "trade_id string, headline string, summary string, limitations string, signals array<struct<type:string,explanation:string>>")
    out = A.explanation_audit(texts, facts, spark.createDataFrame([("Committee on Sea Ports",)], "committee_name string"))
    assert out._jdf.queryExecution().analyzed().toString().count(A.WORD) == 1
    assert out.first().problems == [
        "summary names a committee that is not in the evidence: air", "summary speaks of a flag, but the trade is not flagged",
        "summary states 21, which was not supplied", "summary uses insider outside a denial"]


def test_a_commit_packs_its_rows_and_leaves_no_shuffle(spark, tmp_path):
    from civicledger.streaming.ledger import Ledger, Table

    before = shuffle_files(spark)
    ledger = Ledger(spark, f"file://{tmp_path}/store", {"rows": Table(keys=("id",))})
    change = ledger.begin()
    change.add("rows", change.staged(spark.range(500).repartition(3, "id")).repartition(4, "id"))
    change.commit()
    for _ in range(50):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.2)
    assert shuffle_files(spark) <= before
    kept = ledger.read("rows")
    assert kept.count() == 500 and all("zstd" in name for name in kept.inputFiles())
