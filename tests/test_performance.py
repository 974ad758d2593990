import datetime as dt

import pytest

from civicledger.operators import asof, performance as P

D = dt.date.fromisoformat
TODAY = "2026-01-15"
HOLIDAYS = {"2025-11-27", "2025-12-25", "2026-01-01"}


def weekdays(start, end):
    day = D(start)
    while day <= D(end):
        if day.weekday() < 5 and str(day) not in HOLIDAYS:
            yield day
        day += dt.timedelta(1)


@pytest.fixture
def bars(spark):
    days = list(weekdays("2025-11-20", "2026-01-14"))
    rows = [("X", d, None, 100.0 + i, 5.0) for i, d in enumerate(days)]
    bench = [("B", d, None, 400.0 + 2 * i, 5.0) for i, d in enumerate(days)]
    schema = "ticker string, date date, open double, adj_close double, close double"
    return spark.createDataFrame(rows, schema), spark.createDataFrame(bench, schema)


def perf(table, bars, trades, horizon=None, today=TODAY):
    df = table("id long, ticker string, transaction_type string, transaction_date date, disclosure_date date",
               *[(i, *t) for i, t in enumerate(trades)])
    return [r for r in P.trade_performance(df, *bars, today, horizon).orderBy("id").collect()]


def test_statuses_in_order_of_precedence(table, bars):
    rows = perf(table, bars, [
        (None, "buy", "2030-01-01", None), ("X", "buy", "2030-01-01", None), ("X", "buy", "2025-12-02", "2025-12-01"),
        ("GONE", "buy", "2025-12-02", None), ("X", "buy", "2025-10-01", None), ("X", "buy", "2025-12-02", None)])
    assert [r.status for r in rows] == ["no_ticker", "invalid_date", "invalid_date", "no_prices", "no_price_at_date", "ok"]
    assert [r.detail for r in rows][:3] == [None, "transaction date is in the future", "transaction date is after disclosure date"]
    assert rows[4].latest_price == 100 + len(list(weekdays("2025-11-20", "2026-01-14"))) - 1
    assert rows[0].transaction is None and rows[5].disclosure.status == "no_date"


def test_weekends_and_holidays_roll_forward(table, bars):
    rows = perf(table, bars, [("X", "buy", "2025-11-22", None), ("X", "buy", "2025-12-25", None), ("X", "sell", "2026-01-14", None)])
    assert [r.transaction.anchor_date for r in rows] == [D("2025-11-24"), D("2025-12-26"), D("2026-01-14")]
    assert rows[2].transaction["return"] == 0 and rows[2].direction == -1


def test_excess_and_direction(table, bars):
    (r,) = perf(table, bars, [("X", "sell_partial", "2025-11-20", "2025-11-21")])
    last = len(list(weekdays("2025-11-20", "2026-01-14"))) - 1
    assert r.transaction["return"] == (100 + last) / 100 - 1
    assert r.transaction.excess_return == (100 + last) / 100 - 1 - ((400 + 2 * last) / 400 - 1)
    assert r.direction_adjusted.transaction_excess_return == -r.transaction.excess_return
    assert r.disclosure.anchor_date == D("2025-11-21")


def test_gap_of_more_than_a_week_is_no_price(spark, table):
    schema = "ticker string, date date, adj_close double, close double"
    series = spark.createDataFrame([("X", D("2025-01-01"), 1.0, 1.0), ("X", D("2025-03-10"), 2.0, 2.0)], schema)
    rows = perf(table, (series, series.filter("false")), [("X", "buy", "2025-03-02", None), ("X", "buy", "2025-03-03", None)])
    assert [r.status for r in rows] == ["no_price_at_date", "ok"]
    assert rows[1].transaction.benchmark_return is None and rows[1].transaction.excess_return is None


def test_horizon(table, bars):
    rows = perf(table, bars, [("X", "buy", "2025-11-20", None), ("X", "buy", "2026-01-10", None)], horizon=30)
    assert rows[0].transaction["return"] == (100 + len(list(weekdays("2025-11-20", "2025-12-20"))) - 1) / 100 - 1
    late = rows[1].transaction
    assert (rows[1].status, late.status, late.anchor_date, late["return"]) == ("horizon_not_elapsed",) * 2 + (D("2026-01-12"), None)


def test_nonpositive_start_has_no_return(spark, table):
    series = spark.createDataFrame([("X", D("2025-01-01"), 0.0, 0.0), ("X", D("2025-01-02"), 2.0, 2.0)],
                                   "ticker string, date date, adj_close double, close double")
    (r,) = perf(table, (series, series), [("X", "buy", "2025-01-01", None)])
    assert r.status == "ok" and r.transaction["return"] is None


def test_asof_against_bisect(spark, table):
    """Both lookups against a plain reading, a third of all questions about one security."""
    import random
    rng = random.Random(5)
    days = {t: sorted(rng.sample(range(60), 15)) for t in "AB"}
    start = D("2025-01-01")
    series = spark.createDataFrame([(t, start + dt.timedelta(d), float(d)) for t, ds in days.items() for d in ds], "ticker string, date date, price double")
    asked = [(i, "A" if i % 3 else "B", rng.randrange(70)) for i in range(300)]
    left = spark.createDataFrame([(i, t, start + dt.timedelta(d)) for i, t, d in asked], "id int, ticker string, day date")
    forward = {r.id: r.asof_price for r in asof.asof_forward(left, series, "day").collect()}
    backward = {r.id: r.asof_price for r in asof.asof_backward(left, series, "day").collect()}
    for i, t, d in asked:
        nxt = min((x for x in days[t] if d <= x <= d + 7), default=None)
        prev = max((x for x in days[t] if x <= d), default=None)
        assert (forward[i], backward[i]) == (nxt, prev)


def test_rebased_and_moves(table, bars, spark):
    trades = table("id long, ticker string, transaction_type string, transaction_date date, disclosure_date date",
                   (1, "X", "buy", "2025-11-22", None))
    p = P.trade_performance(trades, *bars, TODAY, legs=("transaction",))
    rows = {r.date: r for r in P.rebased_series(*bars, p).collect()}
    assert rows[D("2025-11-20")].price_index == 100 and rows[D("2025-11-20")].benchmark_index == 100
    assert rows[D("2025-11-24")].buy_mark == rows[D("2025-11-24")].price_index and rows[D("2025-11-21")].buy_mark is None
    moves = P.notable_moves(P.legacy_move(trades, bars[0].withColumn("close", bars[0].adj_close)))
    assert moves.first().notable
