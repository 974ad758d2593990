import datetime as dt

import pytest

from civicledger.operators import prices as B

D = dt.date.fromisoformat
TODAY, NOW = "2026-01-15", "2026-01-15 09:00:00"
SEC = "ticker string, price_status string, price_checked_at string, price_from date, price_to date"


def securities(table, *rows):
    from pyspark.sql import functions as F
    return table(SEC, *rows).withColumn("price_checked_at", F.col("price_checked_at").cast("timestamp_ntz"))


def test_starts(table):
    trades = table("id long, ticker string, transaction_date date, disclosure_date date",
                   (1, "A", "2025-12-05", "2025-12-01"), (2, "A", "2025-12-05", "2026-02-01"), (3, "A", "2025-12-09", "2025-12-20"),
                   (4, "B", "2026-02-01", None), (5, None, "2025-01-01", None))
    starts, invalid, none_valid = B.price_starts(trades, TODAY, "SPY")
    assert {r.ticker: r.start for r in starts.collect()} == {"A": D("2025-12-05"), "SPY": D("2025-12-05")}
    assert {r.id for r in invalid.collect()} == {1, 4} and [r.ticker for r in none_valid.collect()] == ["B"]


def test_plan(table):
    starts = table("ticker string, start date", *[(t, "2025-12-01") for t in ("new", "dead", "retry", "head", "tail", "both", "done")])
    known = securities(
        table, ("dead", "unavailable", "2026-01-14 09:00:00", None, None), ("retry", "unavailable", "2026-01-08 09:00:00", None, None),
        ("head", "ok", None, "2025-12-20", TODAY), ("tail", "ok", None, "2025-11-01", "2026-01-10"),
        ("both", "ok", None, "2025-12-20", "2026-01-10"), ("done", "ok", None, "2025-12-01", TODAY))
    got = {r.ticker: (r.action, str(r.lo), str(r.hi)) for r in B.price_fetch_plan(starts, known, TODAY, NOW).collect()}
    whole = ("fetch", "2025-12-01", TODAY)
    assert got == {"new": whole, "dead": ("deferred", "None", "None"), "retry": whole, "head": ("fetch", "2025-12-01", "2025-12-20"),
                   "tail": ("fetch", "2026-01-03", TODAY), "both": whole, "done": ("cached", "None", "None")}


def test_batches_hold_neighbours(table):
    plan = table("ticker string, action string, lo date, hi date, start date, had_coverage boolean", *[
        (f"T{i}", "fetch", f"2025-12-{1 + i % 3:02d}", TODAY, "2025-12-01", False) for i in range(7)])
    rows = B.batch_plan(plan, 3).collect()
    place = sorted(rows, key=lambda r: (r.lo, r.hi, r.ticker))
    assert [r.batch for r in place] == [0, 0, 0, 1, 1, 1, 2] and place[0].batch_size == 3 and place[5].batch_hi == D(TODAY)


BAR = "ticker string, date date, adj_close double"


@pytest.mark.parametrize("whole, outcome, prices", [(False, "restated", [1.0, 2.0]), (True, "written", [3.0])])
def test_a_restated_history_is_rebuilt_as_a_whole(table, whole, outcome, prices):
    bars = table(BAR, ("A", "2026-01-08", 1.0), ("A", "2026-01-09", 2.0))
    plan = table("ticker string, lo date, hi date, had_coverage boolean, batch long", ("A", "2026-01-09", TODAY, True, 0))
    known = securities(table, ("A", "ok", None, "2026-01-01", "2026-01-10"))
    new, secs, found = B.apply_price_batch(bars, table(BAR, ("A", "2026-01-09", 3.0)), plan, known, NOW, whole)
    assert found.first().outcome == outcome
    assert sorted(r.adj_close for r in new.collect()) == prices


def test_outcomes_of_empty_answers(table):
    bars = table(BAR, ("C", "2026-01-09", 1.0))
    plan = table("ticker string, lo date, hi date, had_coverage boolean, batch long", ("A", "2025-12-01", TODAY, False, 0),
                 ("B", "2026-01-10", TODAY, False, 0), ("C", "2026-01-08", TODAY, True, 0), ("D", "2026-01-08", TODAY, True, 1),
                 ("E", "2025-01-08", TODAY, False, 1), ("F", "2025-01-08", TODAY, False, 1))
    known = securities(table, *[(t, None, None, None, None) for t in "ABDEF"], ("C", "ok", None, "2026-01-09", "2026-01-09"))
    answer = table(BAR, ("A", "2020-01-01", 1.0))
    new, secs, found = B.apply_price_batch(bars, answer, plan, known, NOW)
    assert {r.ticker: r.outcome for r in found.collect()} == {
        "A": "unavailable", "B": "too_recent", "C": "written", "D": "failed", "E": "failed", "F": "failed"}
    after = {r.ticker: r for r in secs.collect()}
    assert after["A"].price_status == "unavailable" and after["C"].price_to == D(TODAY) and new.count() == 0
    # an empty rebuild never wipes a history
    kept, _, found = B.apply_price_batch(bars, answer, plan.filter("ticker = 'C'"), known, NOW, whole=True)
    assert found.first().outcome == "failed" and kept.count() == 1


def test_drift_tolerance(table):
    old = table(BAR, ("A", "2026-01-01", 100.0), ("B", "2026-01-01", 100.0), ("C", "2026-01-01", 0.0))
    new = table(BAR, ("A", "2026-01-01", 100.009), ("B", "2026-01-01", 100.02), ("C", "2026-01-01", 5.0))
    assert {r.ticker: r.restated for r in B.detect_restatement(old, new).collect()} == {"A": False, "B": True, "C": False}


def snapshot(root):
    return {str(p.relative_to(root).parent): p.name for p in root.rglob("*.parquet")}


def test_a_tail_fetch_rewrites_its_own_folders_only(spark, table, tmp_path):
    from civicledger.operators.price_table import PriceTable

    days = [D("2025-01-01") + dt.timedelta(k) for k in range(0, 376, 5)]
    history = [(t, str(day), 1.0) for t in ("A", "B", "C", "D") for day in days]
    prices = PriceTable(spark, tmp_path, buckets=4)
    prices.create(table(BAR, *history))
    before = snapshot(tmp_path / "bars")
    plan = table("ticker string, lo date, hi date, had_coverage boolean, batch long",
                 ("A", "2026-01-01", TODAY, True, 0), ("B", "2026-01-01", TODAY, True, 0), ("D", "2025-06-01", "2025-06-30", True, 1))
    known = securities(table, *[(t, "ok", None, "2025-01-01", "2026-01-10") for t in "ABCD"])
    answer = table(BAR, *[("A", f"2026-01-{k:02d}", 1.0) for k in range(1, 16)], ("B", "2026-01-09", 1.0), ("D", "2025-06-20", 1.0), ("D", "2025-07-20", 9.0))
    secs, outcome = prices.apply(answer, plan, known, NOW)
    assert {r.ticker: r.outcome for r in outcome.collect()} == {"A": "written", "B": "written", "D": "written"}
    assert {r.ticker: str(r.price_to) for r in secs.collect()}["A"] == TODAY
    after = snapshot(tmp_path / "bars")
    changed = {k for k in before.keys() | after.keys() if before.get(k) != after.get(k)}
    assert {k.split("month=")[1] for k in changed} == {"2026-01", "2025-06"} and 2 <= len(changed) <= 3
    got = prices.read().groupBy("ticker").count().collect()
    june = sum(day.month == 6 for day in days)
    january = sum(str(day) >= "2026-01-01" for day in days)
    assert {r["ticker"]: r["count"] for r in got} == {"A": len(days) - january + 15, "B": len(days) - january + 1, "C": len(days), "D": len(days) - june + 1}


def test_folders_without_bars_go_and_rebuilds_replace_everything(spark, table, tmp_path):
    from civicledger.operators.price_table import PriceTable

    prices = PriceTable(spark, tmp_path, buckets=1)
    prices.create(table(BAR, ("A", "2025-11-03", 1.0), ("A", "2025-12-03", 1.0), ("A", "2026-01-05", 1.0)))
    known = securities(table, ("A", "ok", None, "2025-11-01", "2026-01-10"))
    plan = "ticker string, lo date, hi date, had_coverage boolean, batch long"
    prices.apply(table(BAR, ("A", "2020-01-01", 1.0)), table(plan, ("A", "2025-12-01", "2025-12-31", True, 0)), known, NOW)
    assert sorted(p.name for p in (tmp_path / "bars" / "bucket=0").iterdir()) == ["month=2025-11", "month=2026-01"]
    _, found = prices.apply(table(BAR, ("A", "2026-01-05", 2.0)), table(plan, ("A", "2026-01-01", TODAY, True, 0)), known, NOW)
    assert found.first().outcome == "restated" and prices.read().count() == 2
    prices.apply(table(BAR, ("A", "2026-01-05", 2.0)), table(plan, ("A", "2026-01-01", TODAY, True, 0)), known, NOW, whole=True)
    assert [(str(r.date), r.adj_close) for r in prices.read().collect()] == [("2026-01-05", 2.0)]
