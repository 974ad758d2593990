"""Lines of a run are cleaned once and numbered in one shuffle; only large groups of identical lines are dealt over bins."""

from collections import Counter

from pyspark.sql import functions as F

from civicledger.operators import ingest as I
from civicledger.operators.ordered import numbered
from civicledger.sources.disclosures import normalize_disclosures
from test_ingest import feed


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_groups_are_numbered_by_one_exchange(spark):
    df = spark.range(300).select("id", (F.col("id") % 70).alias("k"))
    out = numbered(df, ["k"], ["id"])
    assert plan(out).count("Exchange hashpartitioning") == 1 and "Join" not in plan(out)
    assert {(r.k, r.id, r.number) for r in out.collect()} == {(i % 70, i, i // 70) for i in range(300)}


def test_only_lots_with_a_large_group_are_dealt(spark):
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    for large in (None, F.col("k") == "hot"):
        rows = numbered(df, ["k"], ["id"], ways=16, large=large, full=1000).collect()
        assert sorted(r.number for r in rows if r.k == "hot") == list(range(2000))
        assert all(r.number == 0 for r in rows if r.k != "hot") and len(rows) == 6000
    hot = numbered(df, ["k"], ["id"], ways=16, full=1000).filter("k = 'hot'").sort("id").collect()
    assert [r.number for r in hot] != list(range(2000))  # dealt, not sorted by one task


def test_two_runs_over_a_feed_clean_it_once(spark):
    trades, _ = normalize_disclosures(feed(spark, {}, {}, {"ticker": "MSFT"}, {"tx_date": "2026-02-01"}, {}))
    lines = I.identified(trades)
    new = I.dedupe_trades(lines, I.dedupe_trades(lines.filter("transaction_date < DATE '2026-02-01'")))
    assert "regexp" not in plan(new).lower()  # what cleans a line stands before the files that both runs read
    assert [(str(r.transaction_date), r.occurrence) for r in new.collect()] == [("2026-02-01", 0)]
    want = Counter((r.fingerprint, r.occurrence) for r in I.dedupe_trades(trades).collect())
    assert want == Counter((r.fingerprint, r.occurrence) for r in I.dedupe_trades(lines).collect())


def variants(spark):
    people = spark.createDataFrame([(1, "John J Mc", "house"), (2, "John Mc", "house"), (3, "John Mc", "senate"), (4, "Dan Ray", "house"), (5, "Eve", None)], "id long, name string, chamber string")
    who = [1, 2, 2, 3, 4, 4, 5, 9, 9, None]  # 9 is nobody known, 5 has no key
    trades = spark.range(60).select(
        "id", F.element_at(F.array(*[F.lit(w).cast("long") for w in who]), (F.col("id") % 10 + 1).cast("int")).alias("politician_id"), F.lit("x").alias("politician_name"), F.lit("house").alias("chamber"), F.lit("T").alias("ticker"),
        F.lit(None).cast("string").alias("asset_name"), F.lit("buy").alias("transaction_type"), F.lit("2026-01-01").cast("date").alias("transaction_date"), F.lit(None).cast("date").alias("disclosure_date"),
        (F.col("id") % 2).alias("amount_min"), F.lit(2).cast("long").alias("amount_max"), F.lit("old").alias("fingerprint"))
    return people, trades


def test_variants_are_numbered_alike_with_and_without_busy_names(spark):
    people, trades = variants(spark)
    results = [I.merge_variants(people, trades, full=full)[1] for full in (1 << 18, 20, 1)]
    rows = [Counter((r.politician_name, r.amount_min, r.occurrence, r.fingerprint) for r in moved.collect()) for moved in results]
    assert rows[0] == rows[1] == rows[2] and sum(rows[0].values()) == 60
    # one chamber in the trades: the senate's and the house's John Mc have the same lines, and so share their numbers
    assert sorted(o for (name, low, o, _), n in rows[0].items() if name == "John Mc" and low == 0 for _ in range(n)) == list(range(12))
    assert len({f for *_, f in rows[0]}) == 60


def test_variants_key_names_once_per_politician(spark):
    people, trades = variants(spark)
    moved = I.merge_variants(people, trades)[1]
    text = moved._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("row_number") == 1  # no bins where no name is busy
    window = text[:text.index("Join")]
    assert "[^a-z0-9]+" not in window  # a trade's identity is put together from its politician's key


def test_files_of_many_pages_are_streamed_line_by_line(spark, tmp_path):
    from civicledger.streaming import ingest as S
    from test_stores import pages, rec

    old = [rec(n) for n in range(40, 0, -1)]
    old[19:19] = [old[19]] * 2  # three identical lines, cut by the end of a file
    feed = pages(spark, tmp_path / "feed", old, 4, chunk=5)
    store = S.TradeStore(spark, tmp_path / "tables")
    S.catch_up(S.page_stream(spark, f"{feed.path}/chunk=*", files_per_batch=1, lines=True), store, tmp_path / "checkpoint", now="2026-01-01")
    assert store.read("trades").count() == 42 and store.read("batches").count() == 3
    assert sorted(r.occurrence for r in store.read("trades").collect() if r.occurrence) == [1, 2]


def test_pages_of_a_feed_stay_small_however_large_it_is(spark, monkeypatch):
    import os

    import pytest

    from civicledger.plans import queries
    from test_queries import FOLDER

    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    seen, stream = [], queries.page_stream
    monkeypatch.setattr(queries, "PAGE", 20)
    monkeypatch.setattr(queries, "page_stream", lambda spark, path, **more: seen.append(path) or stream(spark, path, **more))
    rows = queries.QUERIES["stream_pages"](spark, FOLDER)
    read = spark.read.json(seen[0])
    assert read.agg(F.max(F.size("trades"))).first()[0] <= 20 and len(read.inputFiles()) == 12
    assert rows.count() == I.dedupe_trades(normalize_disclosures(queries.Tables(spark, FOLDER).feed)[0]).count()
