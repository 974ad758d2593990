import datetime as dt
import itertools
import random
from dataclasses import replace
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from civicledger.operators import context as C, screen as S, signals as G
from civicledger.operators.ordered import earlier_rank
from test_history_and_relevance import MAPPING, SEAT, mapping

D = dt.date.fromisoformat
TODAY = "2026-06-30"
TRADE = ("id string, politician_id long, politician_name string, chamber string, party string, state string, ticker string, asset_name string, "
         "transaction_type string, transaction_date date, disclosure_date date, amount_min long, amount_max long")


def test_rank_among_earlier_against_counting(spark):
    rng = random.Random(11)
    raw = [("hot" if i % 3 == 0 else f"p{i % 7}", rng.randrange(40), float(rng.randrange(6))) for i in range(900)]
    cells = spark.createDataFrame(raw, "p string, d int, v double").groupBy("p", "d", "v").agg(F.count("*").alias("w"))
    for partitions in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        rows = earlier_rank(cells, "p", "d", "v", "w").collect()
        assert len(rows) == len({(p, d, v) for p, d, v in raw})
        for r in rows:
            earlier = [v for p, d, v in raw if p == r.p and d < r.d]
            assert (r.less, r.same) == (sum(v < r.v for v in earlier), earlier.count(r.v))
            assert r.w == raw.count((r.p, r.d, r.v))
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def sized(spark, *rows):
    return spark.createDataFrame([(i, p, D(tx), D(di) if di else None, lo, hi) for i, (p, tx, di, lo, hi) in enumerate(rows)],
                                 "id int, politician_id int, transaction_date date, disclosure_date date, amount_min long, amount_max long")


def test_size_signal(spark):
    small = [(1, f"2026-01-{d:02d}", None, 1001, 15000) for d in range(1, 11)]
    rows = sized(spark, *small, (1, "2026-02-01", None, 250001, 500000), (1, "2026-02-01", None, None, None), (2, "2026-02-01", None, 5, 5),
                 (1, "2026-02-02", "2026-01-01", 1001, 15000), (1, "2026-01-10", None, 1001, 15000))
    got = {r.id: r for r in G.size_signal(rows, TODAY).collect()}
    big = got[10]
    assert (big.trade_size_anomaly, big.trade_size_percentile, big.trade_size_sample_size, big.trade_size_median) == (True, 100.0, 11, 8000.5)
    assert (got[11].trade_size_anomaly, got[11].trade_size_sample_size, got[11].trade_size_median) == (None, 11, None)
    assert (got[12].trade_size_sample_size, got[12].trade_size_percentile) == (0, None)
    assert (got[13].trade_size_sample_size, got[13].trade_size_value) == (None, 8000.5)
    assert got[14].trade_size_sample_size == 9 and got[14].trade_size_anomaly is None


def test_delay_is_strict_and_unknown_when_dates_are_wrong(spark):
    rows = sized(spark, (1, "2026-01-01", "2026-02-15", 1, 1), (1, "2026-01-01", "2026-02-16", 1, 1), (1, "2026-01-01", None, 1, 1),
                 (1, "2026-01-02", "2026-01-01", 1, 1), (1, "2026-01-01", "2026-07-15", 1, 1))
    got = [tuple(r) for r in G.with_delay_signal(rows, TODAY).orderBy("id").select("disclosure_delay_days", "disclosure_delay_signal").collect()]
    assert got == [(45, False), (46, True), (None, None), (None, None), (None, None)]


@pytest.fixture
def world(spark, table):
    """One politician with small earlier trades and one large, late, well-performing trade in a mapped industry."""
    start = D("2025-01-01")
    days = [start + dt.timedelta(i) for i in range(520) if (start + dt.timedelta(i)).weekday() < 5]
    schema = "ticker string, date date, adj_close double, close double"
    bars = spark.createDataFrame([("ACM", d, 100.0 + i, 1.0) for i, d in enumerate(days)], schema)
    bench = spark.createDataFrame([("SPY", d, 400.0, 1.0) for d in days], schema)
    base = ("Ann Lee", "house", "D", "NY", "ACM", "Acme", "buy")
    trades = table(TRADE, *[(f"s{i:02d}", 1, *base, f"2025-01-{i + 1:02d}", "2025-01-20", 1001, 15000) for i in range(12)],
                   ("big", 1, *base, "2025-03-03", "2025-05-01", 250001, 500000),
                   ("other", 2, "Bob Ray", "senate", None, None, None, "Bond", "sell", "2025-03-03", None, 1001, 15000))
    seats = table(SEAT, (1, "X", None, "exact_date", 119, "2025-01-03", None, "2026-06-01", True), (1, "X", None, "current_snapshot", 119, None, None, "2026-06-01", None))
    mappings = table(MAPPING, mapping(1, "X", 3700, 3799), mapping(2, "X", 3721, 3721, "related")).withColumns(
        {c: F.lit(c) for c in ("rationale", "source_url", "source_citation")})
    secs = table("ticker string, name string, company_name string, sic_code string, industry string, sector string", ("ACM", "Acme", "Acme Inc", "3721", "Aircraft", "Manufacturing"))
    people = table("id long, name string, chamber string, district string", (1, "Ann Lee", "house", "3"), (2, "Bob Ray", "senate", None))
    return SimpleNamespace(trades=trades, bars=bars, benchmark=bench, seats=seats, mappings=mappings, securities=secs, politicians=people)


def test_context_end_to_end(world):
    context = C.analyze(world, today=TODAY).cache()
    rows = {r.trade_id: r for r in context.collect()}
    big = rows["big"]
    assert big.flagged_for_contextual_review and big.secondary_signal_count == 3 and big.signal_count == 4
    assert (big.committee_relevance_reason, big.committee_temporal_status) == ("direct_match", "temporally_verified")
    assert (big.performance_horizon_days, big.performance_through_date) == (90, D("2025-06-01"))
    assert (rows["other"].committee_relevance, rows["other"].committee_relevance_reason, rows["other"].committee_temporal_status) == (None, "no_sic", "unavailable")
    assert not rows["s11"].flagged_for_contextual_review and rows["s11"].trade_size_anomaly is False
    evidence = C.context_evidence(context, world.mappings).filter("trade_id = 'big'").collect()
    assert sorted(e.evidence_key for e in evidence) == ["mapping:1", "mapping:2", "metric", "metric", "metric"]
    assert any("Filed on day 59" in e.description for e in evidence)
    assert any(e.description.startswith("Sized at $375,000 (range midpoint) within the range $250,001 to $500,000") for e in evidence)

    merged = C.merge_context(context, context)
    assert [tuple(r) for r in merged.groupBy("action").count().collect()] == [("unchanged", 14)]
    assert C.merge_context(context, context, force=True).filter("action = 'updated'").count() == 14
    summary = {(r.measure, r.item): r.trades for r in C.context_summary(context).collect()}
    assert summary["flag", "flagged"] == 1 and summary["evaluated", "trades"] == 14 and summary["flagged_distinct", "tickers"] == 1

    # a run over one trade still compares it with everything earlier
    (one,) = C.analyze(world, today=TODAY, ids=["big"]).collect()
    assert one.result_digest == big.result_digest
    assert C.analyze(world, today=TODAY, politician="ann").count() == 13


def test_only_verified_committee_evidence_flags(world, table):
    world.seats = world.seats.filter("temporal_precision = 'current_snapshot'")
    cfg = C.ContextConfig(require_temporal_verification=False)
    (r,) = C.analyze(world, today=TODAY, ids=["big"]).collect()
    assert (r.meets_flag_rule, r.flagged_for_contextual_review, r.pending_temporal) == (True, False, True)
    (w,) = C.analyze(world, cfg, TODAY, ids=["big"]).collect()
    assert w.flagged_for_contextual_review and w.context_version.startswith("2026.3+custom-") and cfg.version_label() != C.ContextConfig().version_label()


def test_a_seat_that_was_not_held_rejects_the_match(world, table):
    world.seats = table(SEAT, (1, "X", None, "exact_date", 119, "2025-09-03", None, "2026-06-01", True), (1, "X", None, "current_snapshot", 119, None, None, "2026-06-01", None))
    (r,) = C.analyze(world, today=TODAY, ids=["big"]).collect()
    assert (r.committee_relevance, r.committee_relevance_reason, r.committee_temporal_status, r.committee_contradicted) == (
        False, "seat_not_held_on_transaction_date", "contradicted", True)
    assert [m.mapping_id for m in r.rejected] == [1] and r.direct == [] and r.related == []


def plain_match(rule, row):
    """The rule read without Spark."""
    def secondary(on, threshold, default, stored, value):
        return on and (stored is True if threshold == default else value is not None and value)
    pct, days, ex = row["trade_size_percentile"], row["disclosure_delay_days"], row["excess_return"]
    size = secondary(rule.enable_trade_size_signal, rule.trade_size_percentile_threshold, 90.0, row["trade_size_anomaly"],
                     None if pct is None else pct >= rule.trade_size_percentile_threshold)
    delay = secondary(rule.enable_disclosure_delay_signal, rule.disclosure_delay_threshold_days, 45, row["disclosure_delay_signal"],
                      None if days is None else days > rule.disclosure_delay_threshold_days)
    excess = secondary(rule.enable_excess_return_signal, rule.excess_return_threshold_pct_points, 20.0, row["excess_return_signal"],
                       None if ex is None or row["performance_status"] != "ok" else abs(ex) * 100 + 1e-7 >= rule.excess_return_threshold_pct_points)
    committee = row["committee_relevance"] is True or (not rule.reviewed_direct_only and row["has_related"] is True)
    if rule.require_temporal_verification:
        committee = committee and row["committee_temporal_status"] == "temporally_verified"
    n = size + delay + excess
    return (committee or not rule.committee_relevance_required) and n >= rule.minimum_secondary_signals


def test_every_rule_setting_against_a_plain_reading(spark):
    rng = random.Random(2)
    tri = [True, False, None]
    rows = [dict(
        context_id=str(i), committee_relevance=rng.choice(tri), has_related=rng.choice([True, None]), trade_size_anomaly=rng.choice(tri),
        committee_temporal_status=rng.choice(["temporally_verified", "current_assignment_only"]), disclosure_delay_signal=rng.choice(tri),
        excess_return_signal=rng.choice(tri), trade_size_percentile=rng.choice([None, 60.0, 92.5]), disclosure_delay_days=rng.choice([None, 20, 50]),
        excess_return=rng.choice([None, -0.25, 0.1]), performance_status=rng.choice(["ok", "no_prices"])) for i in range(60)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "context_id string, committee_relevance boolean, has_related boolean, "
                               "trade_size_anomaly boolean, committee_temporal_status string, disclosure_delay_signal boolean, excess_return_signal boolean, "
                               "trade_size_percentile double, disclosure_delay_days int, excess_return double, performance_status string")
    rules = []
    for c, d, v, a, b, e in itertools.product([True, False], repeat=6):
        for need in range(4):
            try:
                rules.append(S.ContextRule(c, d, v, a, 90.0, b, 45, e, 20.0, need))
            except ValueError:
                continue
    rules += [replace(r, trade_size_percentile_threshold=55, disclosure_delay_threshold_days=10, excess_return_threshold_pct_points=15) for r in rules]
    found = df.select("context_id", *[S.rule_columns(r)["matches"].alias(f"r{i}") for i, r in enumerate(rules)]).collect()
    for row in found:
        plain = rows[int(row.context_id)]
        assert [row[f"r{i}"] for i in range(len(rules))] == [plain_match(r, plain) for r in rules]


def test_rules_and_presets():
    assert [p.kind for p in S.PRESETS.values()] == ["default", "custom", "committee_only", "market_only"]
    for bad in (dict(minimum_secondary_signals=4), dict(enable_trade_size_signal=False, minimum_secondary_signals=3),
                dict(committee_relevance_required=False, minimum_secondary_signals=0), dict(trade_size_percentile_threshold=101)):
        with pytest.raises(ValueError):
            S.ContextRule(**bad)


@pytest.mark.parametrize("field, op, value", [
    ("nope", "is", 1), ("ticker", "gte", "A"), ("ticker", "is", " "), ("chamber", "is", "moon"), ("value", "gte", True), ("value", "gte", "x"),
    ("transaction_date", "between", ["2025-01-01"]), ("transaction_date", "gte", "yesterday"), ("transaction_type", "in", []), ("politician", "is", "me")])
def test_invalid_filters_are_rejected(field, op, value):
    with pytest.raises(ValueError):
        S.FilterSpec(field, op, value)


def test_filters_narrow_and_counts_agree(world):
    context = C.analyze(world, today=TODAY).cache()
    tables = S.ScreenTables(world.trades, context, C.context_evidence(context, world.mappings), world.politicians, world.securities,
                            world.mappings.withColumn("committee_name", F.lit("Committee on Flight")))
    total = S.screen_counts(S.screened(tables)).first()
    assert tuple(total) == (14, 1, 1) and S.screened(tables).filter("differs_from_canonical").count() == 0
    expected = {("review_status", "is", "flagged"): {"big"}, ("committee_name", "contains", "flight"): {f"s{i:02d}" for i in range(12)} | {"big"},
                ("committee_name", "contains", "nowhere"): set(), ("committee_relevance", "is", "unknown"): {"other"}, ("district", "is", "3"): {f"s{i:02d}" for i in range(12)} | {"big"},
                ("disclosure_delay", "gte", 59): {"big"}, ("value", "gte", 250001): {"big"}, ("company", "contains", "bond"): {"other"},
                ("ai_context", "is", "available"): set(), ("excess_return", "abs_gte", 1): {f"s{i:02d}" for i in range(12)} | {"big"},
                ("politician", "is", 2): {"other"}, ("transaction_date", "between", ("2025-03-01", "2025-03-31")): {"big", "other"}}
    for spec, ids in expected.items():
        assert {r.id for r in S.screened(tables, filters=[S.FilterSpec(*spec)]).collect()} == ids, spec
    rows, counts = S.screen(tables, sort_by="ticker", order="asc", limit=3, offset=12)
    assert [r.id for r in rows.collect()] == ["big", "other"]
    assert counts.first().total == 14


def test_pages_put_missing_values_last(table):
    df = table("id string, ticker string", ("1", "b"), ("2", None), ("3", "a"), ("4", "B"), ("5", "b"))
    assert [r.id for r in S.page(df, "ticker", "asc").collect()] == ["4", "3", "5", "1", "2"]
    assert [r.id for r in S.page(df, "ticker", "desc").collect()] == ["5", "1", "3", "4", "2"]
    with pytest.raises(ValueError):
        S.page(df, "ticker", limit=501)
