"""The log of segments, runs over pages and streams, and the stores built on them."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from civicledger.streaming import ingest as I
from civicledger.streaming.ledger import Ledger, Table
from civicledger.streaming.pages import CAUGHT_UP, END, ERROR, MORE, PageFiles, run_pages

TABLES = {"log": Table(partition="month"), "dim": Table(keys=("k",))}
REC = {"member": "Ann Lee", "chamber": "House", "trade_type": "buy", "amount": "$1 - $2", "tx_date": "2026-01-05", "disclosed": "2026-01-06", "asset": "Acme", "ticker": "ACM", "link": ""}


def commit(ledger, spark, n, gone=()):
    change = ledger.begin()
    change.add("log", spark.createDataFrame([(n, f"2020-{n % 12 + 1:02d}")], "n long, month string"))
    change.add("dim", spark.createDataFrame([(n % 5, n)], "k long, v long"), gone=spark.createDataFrame([(k,) for k in gone], "k long"))
    return change.commit({"n": n})


def folders(tmp_path, table):
    return {p.name for p in (tmp_path / table).iterdir() if p.name.startswith("segment")}


def test_many_commits_leave_few_folders(spark, tmp_path):
    ledger = Ledger(spark, tmp_path, TABLES, fan=3, keep=1)
    for n in range(15):
        commit(ledger, spark, n)
        ledger.compact()
    assert len(folders(tmp_path, "log")) <= 8 and len(folders(tmp_path, "dim")) <= 8
    assert len([p for p in (tmp_path / "manifest").iterdir() if p.suffix == ".json"]) <= 3
    assert sorted(r["n"] for r in ledger.read("log").collect()) == list(range(15))
    assert {r["k"]: r["v"] for r in ledger.read("dim").collect()} == {k: 10 + k for k in range(5)}
    some = ledger.snapshot().read("log", "2020-02", "2020-03")
    plan = some._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "2020-02" in plan.split("PartitionFilters: [")[1]
    assert sorted(r["n"] for r in some.collect()) == [n for n in range(15) if n % 12 in (1, 2)]


def test_readers_keep_their_snapshot_and_failed_attempts_do_not_show(spark, tmp_path):
    ledger = Ledger(spark, tmp_path, TABLES, fan=2, keep=9)
    commit(ledger, spark, 0)
    seen = ledger.snapshot()
    commit(ledger, spark, 5, gone=[7])
    ledger.compact()
    abandoned = ledger.begin()
    abandoned.add("log", spark.createDataFrame([(99, "2020-01")], "n long, month string"))
    assert [r["n"] for r in seen.read("log").collect()] == [0] and [r["v"] for r in seen.read("dim").collect()] == [0]
    assert sorted(r["n"] for r in ledger.read("log").collect()) == [0, 5] and [r["v"] for r in ledger.read("dim").collect()] == [5]
    late = ledger.begin()
    commit(ledger, spark, 6)
    with pytest.raises(Exception, match="(?i)exist"):
        late.commit()
    (tmp_path / "manifest" / f"{ledger.snapshot().version + 1:012d}.json").write_text('{"segm')  # a writer died here
    assert ledger.snapshot().facts == {"n": 6}


def test_gone_keys_stay_hidden_until_merged_away(spark, tmp_path):
    ledger = Ledger(spark, tmp_path, TABLES, fan=3)
    commit(ledger, spark, 1)
    commit(ledger, spark, 2, gone=[1])
    assert [r["k"] for r in ledger.read("dim").collect()] == [2]
    commit(ledger, spark, 3)
    snapshot = ledger.compact()
    assert sorted(r["k"] for r in ledger.read("dim").collect()) == [2, 3] and snapshot.rows("dim") == 2
    assert ledger.read("log").count() == 3 and Ledger(spark, tmp_path / "none", TABLES).read("log") is None


def pages(spark, folder, records, size, chunk=2):
    fields = ", ".join(f"{k} string" for k in REC)
    df = spark.createDataFrame([(i, *[r[k] for k in REC]) for i, r in enumerate(records)], f"place long, {fields}")
    return PageFiles(spark, folder, chunk).publish(df, "place", size)


def rec(n, **other):
    return REC | {"tx_date": str(dt.date(2025, 1, 1) + dt.timedelta(n))} | other


def last_run(df):
    return df.select("start_page", "pages", "fetched", "rejected", "inserted", "stopped", F.col("last_success_at").isNotNull().alias("ok")).first()


@pytest.mark.parametrize("window", [4])
def test_runs_over_pages(spark, tmp_path, window):
    old = [rec(n) for n in range(40, 0, -1)]
    old[10:10] = [old[10]] * 3  # four identical lines, over two pages
    old[30]["chamber"] = "?"
    store = I.TradeStore(spark, tmp_path / f"t{window}", fan=4)
    feed = pages(spark, tmp_path / f"a{window}", old, 4)  # 43 records, 11 pages
    assert tuple(last_run(run_pages(store, feed, 4, 5, window=window))) == (0, 5, 20, 0, 20, MORE, True)
    assert tuple(last_run(run_pages(store, feed, 4, 99, window=window))) == (4, 7, 27, 1, 22, END, True)
    assert store.read("trades").count() == 42 and store.read("trades").filter("occurrence > 0").count() == 3
    grown = [rec(n) for n in range(46, 40, -1)] + old
    feed = pages(spark, tmp_path / f"b{window}", grown, 4)
    # the second page has two new ones, the third none
    assert tuple(last_run(run_pages(store, feed, 4, 99, window=window))) == (0, 3, 12, 0, 6, CAUGHT_UP, True)
    assert tuple(last_run(run_pages(store, feed, 4, 99, window=window))) == (0, 1, 4, 0, 0, CAUGHT_UP, True)
    assert store.read("trades").count() == 48 and store.read("politicians").count() == 1 and store.read("rejects").count() == 1
    assert I.state(store).first()["inserted"] == 48


def test_a_broken_page_is_no_success(spark, tmp_path):
    store = I.TradeStore(spark, tmp_path / "t")
    feed = pages(spark, tmp_path / "f", [rec(n) for n in range(20)], 4, chunk=1)
    part = next((tmp_path / "f" / "chunk=2").glob("part*"))
    part.write_text(part.read_text()[:50])
    (tmp_path / "f" / "chunk=2" / f".{part.name}.crc").unlink()
    run = last_run(run_pages(store, feed, 4, 99))
    assert (run["pages"], run["inserted"], run["stopped"], run["ok"]) == (2, 8, ERROR, False)
    part.write_text(json.dumps({"total": 20, "offset": 8, "limit": 4, "has_more": True, "trades": [rec(n) for n in range(8, 12)]}))
    again = last_run(run_pages(store, feed, 4, 99))
    assert (again["start_page"], again["inserted"], again["stopped"], again["ok"]) == (1, 12, END, True)


def write_page(folder, n, records):
    (folder / f"page{n}.json").write_text(json.dumps({"total": 9, "offset": n * 100, "limit": 100, "has_more": False, "trades": records}))


def test_a_filing_cut_by_batches_is_numbered_through(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    for n, times in enumerate((2, 1, 3)):
        write_page(feed, n, [rec(0)] * times + [rec(n + 1)])
    store = I.TradeStore(spark, tmp_path / "tables")
    stream = lambda: I.page_stream(spark, str(feed), files_per_batch=1)
    I.catch_up(stream(), store, tmp_path / "checkpoint", now="2026-01-01")
    trades = store.read("trades")
    assert store.read("batches").count() == 3 and trades.count() == 9
    assert sorted(r["occurrence"] for r in trades.filter("transaction_date = DATE '2025-01-01'").collect()) == list(range(6))
    I.store_batch(store, I.explode_pages(spark.read.schema(I.DISCLOSURE_PAGE).option("multiLine", True).json(str(feed))), 2, "disclosure_feed", "x")
    assert store.read("trades").count() == 9
    # a later run counts from nought: the feed shows three of the lines again, and one more is new only beyond six
    write_page(feed, 7, [rec(0)] * 7)
    I.catch_up(stream(), store, tmp_path / "checkpoint", now="2026-01-02")
    assert store.read("trades").count() == 10


def test_a_run_that_was_cut_counts_on(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    write_page(feed, 0, [rec(0)] * 2)
    store = I.TradeStore(spark, tmp_path / "tables")
    I.open_run(store)
    raw = lambda: I.explode_pages(spark.read.schema(I.DISCLOSURE_PAGE).option("multiLine", True).json(str(feed)))
    I.store_batch(store, raw(), 0, "disclosure_feed", "x")
    I.open_run(store)  # started again after a failure: the run is still open
    I.store_batch(store, raw(), 1, "disclosure_feed", "x")
    assert store.read("trades").count() == 4 and store.snapshot().facts["run"] == 1


def test_context_store_writes_changes_only(spark, tmp_path):
    from civicledger import constants as K
    from civicledger.operators.context_store import ContextStore

    store, v = ContextStore(spark, tmp_path), (K.ENGINE_VERSION, "2")
    rows = lambda *r: spark.createDataFrame([(*x, *v) for x in r], "trade_id string, result_digest string, context_version string, mapping_version string")
    proof = lambda *r: spark.createDataFrame([(x, *v, d) for x, d in r], "trade_id string, context_version string, mapping_version string, description string")
    assert store.save(rows(), proof()).count() == 0
    store.save(rows(("a", "1"), ("b", "1")), proof(("a", "x"), ("b", "y")))
    before = store.ledger(*v).snapshot()
    assert [tuple(r) for r in store.save(rows(("a", "1"), ("b", "1")), proof(("a", "other"))).collect()] == [("unchanged", 2, 2)]
    assert store.ledger(*v).snapshot().version == before.version
    store.save(rows(("b", "2")), proof())
    after = store.ledger(*v).snapshot()
    assert after.rows("context") == 3
    mappings = spark.createDataFrame([("2",)], "mapping_version string")
    assert [r["description"] for r in store.load("evidence", mappings).collect()] == ["x"]
    for k in range(8):
        store.save(rows(("b", f"n{k}")), proof(("b", f"z{k}")))
    assert sorted((r["trade_id"], r["result_digest"]) for r in store.load("context", mappings).collect()) == [("a", "1"), ("b", "n7")]
    assert sorted(r["description"] for r in store.load("evidence", mappings).collect()) == ["x", "z7"]


def test_a_local_session_without_a_shared_folder_gets_its_own():
    from types import SimpleNamespace as Stub

    from civicledger.session import work_dir

    spark = lambda master, app, shared=None: Stub(conf=Stub(get=lambda key, default: shared or default), sparkContext=Stub(master=master, applicationId=app))
    own = work_dir(spark("local[2]", "app-a"))
    assert own == work_dir(spark("local[2]", "app-a")) != work_dir(spark("local[2]", "app-b"))
    assert work_dir(spark("yarn", "app-c", "hdfs://x/shared/")) == "hdfs://x/shared"
    with pytest.raises(RuntimeError):
        work_dir(spark("yarn", "app-c"))
