"""Registered queries: each binds operators to the tables of a data folder and returns a DataFrame."""

import uuid
from functools import reduce
from types import SimpleNamespace

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as X
from ..operators import asof, audit as A, context as C, dashboards as D, history as H, ingest as I, performance as P
from ..operators import prices as B, relevance as V, resolve as E, screen as S, signals as G
from ..operators.context_store import ContextStore
from ..operators.ordered import latest_by, newest_per
from ..operators.price_table import PriceTable
from ..sources.bars import normalize_bars
from ..sources.disclosures import normalize_disclosures
from ..sources.resolutions import committee_events, listed_names, parse_resolutions
from ..sources.reviewed import load_overrides as load_overrides_file, sync_mappings
from ..sources.roster import normalize_members
from ..session import stored, unstored, work_dir
from ..streaming.ingest import TradeStore, catch_up, page_stream
from ..streaming.pages import PageFiles, run_pages
from .tables import (BENCHMARK, CONGRESS, FIRST_EXPLANATION, FIRST_NAMES, HEADLINE, LAST_SIGNAL, LIMITATIONS, NOW, SUMMARY, TODAY, Tables, feed_records, last_name, letter,
                     official_id, pick)

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = lambda spark, folder: fn(Tables(spark, folder))
    return fn


def _r(c, digits=6):
    return F.round(c, digits)


# --- performance -----------------------------------------------------------------------------------------------------

def _performance(t, horizon=None, legs=("transaction", "disclosure")):
    return P.trade_performance(t.trades, t.bars, t.benchmark, TODAY, horizon, legs)


@query
def flagship_performance_by_security(t):
    avg = P.security_averages(_performance(t, legs=("transaction",)))
    return avg.withColumns({c: _r(c) for c in ("avg_return", "avg_excess_return")})


@query
def performance_status_histogram(t):
    return P.performance_status_counts(_performance(t))


@query
def trade_performance(t):
    p = _performance(t)
    legs = [
        F.col(f"{leg}.{field}").alias(f"{short}_{field}")
        for leg, short in (("transaction", "tx"), ("disclosure", "di"))
        for field in ("status", "anchor_date", "price", "return", "benchmark_return", "excess_return")
    ]
    return p.select("id", "status", "detail", "latest_date", "latest_price", "direction", *legs,
                    F.col("direction_adjusted.disclosure_excess_return").alias("adjusted_disclosure_excess"))


@query
def fixed_horizon_excess(t):
    p = _performance(t, 90, ("transaction",))
    return p.select("id", "status", F.col("transaction.anchor_date").alias("anchor_date"),
                    F.col("transaction.return").alias("security_return"),
                    F.col("transaction.benchmark_return").alias("benchmark_return"),
                    F.col("transaction.excess_return").alias("excess_return"))


@query
def security_performance(t):
    p = P.security_performance(t.trades, t.bars, t.benchmark, TODAY, limit=200)
    return p.select("id", "ticker", "status", F.col("transaction.return").alias("return"), F.col("transaction.excess_return").alias("excess_return"))


@query
def asof_next_bar(t):
    asked = t.trades.filter("ticker IS NOT NULL").select("id", "ticker", "disclosure_date").filter("disclosure_date IS NOT NULL")
    return asof.asof_forward(asked, asof.price_series(t.bars), "disclosure_date").select("id", "asof_date", "asof_price")


@query
def asof_previous_bar(t):
    asked = t.trades.filter("ticker IS NOT NULL").select("id", "ticker", "transaction_date")
    return asof.asof_backward(asked, asof.price_series(t.bars), "transaction_date").select("id", "asof_date", "asof_price")


@query
def rebased_series(t):
    perf = _performance(t, legs=("transaction",))
    return P.rebased_series(t.bars, t.benchmark, perf, "1996-01-01")


def _digest(t):
    """Trades in the shape of the legacy digest feed."""
    label = (
        F.when(F.col("amount_max") == 15000, "$1,001 - $15,000").when(F.col("amount_max") == 50000, "$15,001 - $50,000")
        .when(F.col("amount_max") == 100000, "$50,001 - $100,000").when(F.col("amount_max").isNull(), "Over $1,000,000")
        .otherwise("exact figure"))
    kind = F.when(F.col("transaction_type") == "buy", "purchase").when(
        F.col("transaction_type").startswith("sell"), "sale_full").otherwise("exchange")
    return t.trades.withColumns({"amount": label, "trade_type": kind, "ticker": F.replace("ticker", F.lit("Brand#"), F.lit("B"))})


def _digest_bars(t):
    return t.bars.withColumn("ticker", F.replace("ticker", F.lit("Brand#"), F.lit("B")))


@query
def legacy_notable_filter(t):
    return P.legacy_notable_filter(_digest(t), TODAY).select("id", "ticker", "estimated_value", "side")


@query
def legacy_moves(t):
    return P.legacy_move(_digest(t), _digest_bars(t)).select("id", "price_at_trade", "current_price", _r("price_move_pct").alias("price_move_pct"))


@query
def notable_moves(t):
    moves = P.legacy_move(P.legacy_notable_filter(_digest(t), TODAY), _digest_bars(t))
    return P.notable_moves(moves).select("id", "ticker", _r("price_move_pct").alias("price_move_pct"), "notable")


# --- ingest ----------------------------------------------------------------------------------------------------------

@query
def normalize_disclosures_feed(t):
    return normalize_disclosures(t.feed)[0].drop("party", "state", "source")


@query
def rejected_disclosures(t):
    return normalize_disclosures(t.feed)[1].groupBy("reject_reason").agg(F.count("*").alias("records"))


@query
def legacy_value_and_display(t):
    lo, hi = X.parse_amount("amount")
    return t.feed.select("seq", X.legacy_value("amount").alias("legacy_value"), X.format_amount_range(lo, hi).alias("shown"))


@query
def dedupe_occurrences(t):
    """How often each line was disclosed, as numbered fingerprints."""
    return I.dedupe_trades(normalize_disclosures(t.feed)[0]).select("fingerprint", "occurrence")


@query
def dedupe_against_stored(t):
    """A second run over the feed after everything up to the middle of the month is stored: only later lines are new."""
    trades = I.identified(normalize_disclosures(t.feed)[0])  # both runs clean the same feed
    stored = I.dedupe_trades(trades.filter("transaction_date <= DATE '2024-01-15'"))
    return I.dedupe_trades(trades, stored).groupBy("transaction_date", "transaction_type").agg(F.count("*").alias("new_trades"))


@query
def upsert_politicians(t):
    trades = normalize_disclosures(t.feed)[0]
    known = I.upsert_politicians(trades.filter("transaction_date <= DATE '2024-01-15'")).withColumn("party", F.lit("D"))
    return I.upsert_politicians(trades, known)


@query
def upsert_securities(t):
    return I.upsert_securities(normalize_disclosures(t.feed)[0])


@query
def merge_variants(t):
    """Politicians whose names differ only by a middle initial become one; fingerprints are recomputed."""
    trades = t.trades.withColumn("fingerprint", F.lit(None).cast("string"))
    people, moved = I.merge_variants(t.politicians.select("id", "name", "chamber", "party", "state"), trades)
    kept = people.select("id", "name", "canonical_key")
    return moved.groupBy(F.col("politician_id").alias("id")).agg(
        F.count("*").alias("trades"), F.min("fingerprint").alias("first_fingerprint"), F.max("fingerprint").alias("last_fingerprint")).join(kept, "id")


@query
def table_fingerprint(t):
    return I.table_fingerprint(t.source("orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], "orders").unionByName(
        I.table_fingerprint(t.source("events"), ["event_id", "user_id", "event_type", "props"], "events"))


# --- dashboards ------------------------------------------------------------------------------------------------------

@query
def overview_totals(t):
    return D.overview_totals(t.trades, t.politicians, t.securities, TODAY, 30)


@query
def overview_daily(t):
    return D.daily_counts(t.trades, TODAY, 365)


@query
def overview_monthly(t):
    return D.monthly_counts(t.trades)


@query
def half_window_trend(t):
    totals = D.overview_totals(t.trades, t.politicians, t.securities, TODAY, 365)
    return D.half_window_trend(D.daily_counts(t.trades, TODAY, 365), totals, D.monthly_counts(t.trades))


@query
def top_tickers(t):
    return D.top_entities(t.trades, t.securities.select("ticker", "name"), "ticker", TODAY, 365)


@query
def top_politicians(t):
    people = t.politicians.select(F.col("id").alias("politician_id"), "name", "chamber")
    return D.top_entities(t.trades, people, "politician_id", TODAY, 365)


@query
def politician_summary(t):
    people = t.politicians.select(F.col("id").alias("politician_id"), "name")
    return D.entity_summary(people, t.trades, "politician_id")


@query
def security_summary(t):
    return D.entity_summary(t.securities.select("ticker", "price_status"), t.trades, "ticker")


@query
def status_report(t):
    return D.status_report(t.trades, t.politicians, t.securities, t.bars, TODAY, "Brand#3")


@query
def trades_by_source(t):
    return D.trades_by_source(t.trades)


@query
def ingest_freshness(t):
    state = t.source("events").groupBy(F.col("event_type").alias("source")).agg(F.max("ts").cast("timestamp_ntz").alias("last_success_at"))
    return D.ingest_status(state, "2024-01-31 12:00:00", 12)


@query
def group_sizes(t):
    return D.with_group_size(t.trades).select("id", "group_key", "group_size")


@query
def politician_breakdown_months(t):
    return D.politician_breakdown(t.trades)[0]


@query
def politician_breakdown_tickers(t):
    return D.politician_breakdown(t.trades)[1]


@query
def newest_per_security(t):
    order = [F.col("disclosure_date").desc_nulls_last(), F.col("id").desc()]
    return newest_per(t.trades.filter("ticker IS NOT NULL"), "ticker", order, 10).select("ticker", "id", "disclosure_date")


@query
def price_slice(t):
    return D.price_slice(t.bars, start="1997-01-01", end="1999-12-31").select("ticker", "date", "close", "adj_close")


@query
def range_window(t):
    return D.range_window(t.bars, 6).select("ticker", "date", "close")


@query
def committee_groups(t):
    g = D.committee_groups(t.seats)
    return g.select("politician_id", "committee_code", "role", F.size("subcommittees").alias("subcommittees"))


@query
def ordered_seats(t):
    return D.order_seats(t.seats).select("politician_id", "committee_name", "subcommittee_name", "temporal_precision", "position")


@query
def traded_tickers(t):
    return D.distinct_values(t.trades, "ticker")


# --- signals ---------------------------------------------------------------------------------------------------------

@query
def trade_size_values(t):
    value, basis = R.trade_size("amount_min", "amount_max")
    return t.trades.select(basis.alias("basis"), value.alias("value")).groupBy("basis").agg(
        F.count("*").alias("trades"), F.sum("value").alias("total"))


def _sized(t):
    """What sizes are judged by: trades are dealt with these columns."""
    return t.trades.select("id", "politician_id", "transaction_date", "disclosure_date", "amount_min", "amount_max")


@query
def size_percentile_prior(t):
    return G.size_signal(_sized(t), TODAY).select(
        "id", "trade_size_anomaly", "trade_size_value", "trade_size_basis", "trade_size_percentile", "trade_size_sample_size")


@query
def prior_median(t):
    return G.size_signal(_sized(t), TODAY).select("id", "trade_size_sample_size", "trade_size_median")


@query
def delay_signal(t):
    return G.with_delay_signal(t.trades, TODAY).select("id", "disclosure_delay_days", "disclosure_delay_signal")


@query
def excess_signal(t):
    out = G.excess_signal(t.trades, t.bars, t.benchmark, TODAY)
    return out.select("id", "performance_status", "excess_return", "excess_return_direction_adjusted", "performance_through_date",
                      "excess_return_signal")


@query
def invalid_dates(t):
    return t.trades.select("id", R.date_problem("transaction_date", "disclosure_date", TODAY).alias("problem")).filter("problem IS NOT NULL")


# --- price cache -----------------------------------------------------------------------------------------------------

def _plan(t):
    starts, _, _ = B.price_starts(t.trades, TODAY, BENCHMARK)
    return B.price_fetch_plan(starts, t.securities, TODAY, NOW)


@query
def price_starts(t):
    return B.price_starts(t.trades, TODAY, BENCHMARK)[0]


@query
def price_invalid_trades(t):
    return B.price_starts(t.trades, TODAY, BENCHMARK)[1]


#: the first day of trading: some tickers have nothing valid yet
FIRST_DAYS = "1995-01-02"


@query
def price_no_valid_dates(t):
    """Tickers whose every trade is invalid when the clock stands before most of them."""
    return B.price_starts(t.trades, FIRST_DAYS, BENCHMARK)[2]


@query
def price_fetch_plan(t):
    return _plan(t)


@query
def price_batches(t):
    return B.batch_plan(_plan(t), 4).select("ticker", "lo", "hi", "batch", "batch_lo", "batch_hi", "batch_size")


def _stored_bars(t):
    """What an earlier run left behind: bars inside each security's recorded coverage."""
    covered = t.securities.select("ticker", "price_from", "price_to")
    return t.bars.join(covered, "ticker").filter("date BETWEEN price_from AND price_to").drop("price_from", "price_to")


def _incoming_bars(t):
    """A provider's answer: all bars, restated by a dividend for every third security, nothing for every seventh."""
    no = F.substring("ticker", 7, 10).cast("int")
    restated = F.when(no % 3 == 0, F.col("adj_close") * 0.99).otherwise(F.col("adj_close"))
    answered = F.when(no % 7 == 0, F.lit(None)).otherwise(F.col("close"))
    return normalize_bars(t.bars.withColumn("adj_close", restated).withColumn("close", answered))


def _applied(t):
    batches = B.batch_plan(_plan(t), 4)
    return B.apply_price_batch(_stored_bars(t), _incoming_bars(t), batches, t.securities, NOW)


@query
def restatement_check(t):
    return B.detect_restatement(_stored_bars(t), _incoming_bars(t))


@query
def price_batch_outcome(t):
    return _applied(t)[2].select("ticker", "outcome", "bars_fetched", "lo", "hi")


@query
def price_range_replace(t):
    return _applied(t)[0].groupBy("ticker").agg(
        F.count("*").alias("bars"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.sum((F.col("close") * 100).cast("long")).alias("cents"))


@query
def price_coverage(t):
    return _applied(t)[1].select("ticker", "price_status", "price_from", "price_to", "price_checked_at")


def _new_listings(t):
    """A week's fetch: tails for what is covered, and first fetches, among them of tickers that trade for three days only."""
    starts, _, _ = B.price_starts(t.trades, TODAY, BENCHMARK)
    no = F.substring("ticker", 7, 10).try_cast("int")
    fresh = F.date_sub(F.lit(TODAY).cast("date"), 3)
    starts = starts.withColumn("start", F.when(no % 10 == 1, fresh).otherwise(F.col("start")))
    return B.batch_plan(B.price_fetch_plan(starts, t.securities.withColumn("price_checked_at", F.lit(None).cast("timestamp_ntz")), TODAY, NOW), 3)


def _silent_provider(t, plan):
    """A provider that says nothing of every second batch and of every seventh ticker."""
    silent = plan.filter("batch % 2 = 1").select("ticker")
    return _incoming_bars(t).join(silent, "ticker", "left_anti")


def _price_table(t):
    table = PriceTable(t.spark, f"{work_dir(t.spark)}/civicledger/prices-{uuid.uuid4().hex}", buckets=2)  # some dozens of tickers
    table.create(_stored_bars(t))
    plan = stored(_new_listings(t), "price-plan")
    securities, outcome = table.apply(_silent_provider(t, plan), plan, t.securities, NOW)
    return table, securities, outcome


@query
def price_table_outcome(t):
    """Every outcome a fetch can have, of failed batches and tickers too recent to judge too."""
    return _price_table(t)[2].select("ticker", "outcome", "bars_fetched", "lo", "hi")


@query
def price_table_content(t):
    """The stored table after the fetch, month by month."""
    bars = _price_table(t)[0].read()
    return bars.groupBy("ticker", F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("bars"), F.sum(F.round(F.col("close") * 100).cast("long")).alias("cents"), F.sum(F.round(F.col("adj_close") * 10000).cast("long")).alias("adjusted"))


# --- relevance -------------------------------------------------------------------------------------------------------

def _subjects(t):
    described, subjects = V.trade_subjects(t.trades, t.securities)
    return subjects.drop("trades")


def _mappings(t):
    return V.current_version(t.mappings)


@query
def industry_relevance(t):
    out = V.industry_relevance(_subjects(t), t.seats, _mappings(t), ["subject"])
    return out.drop("subject")


@query
def seat_mapping_matches(t):
    found = V.seat_mapping_matches(_subjects(t), t.seats, _mappings(t), ["subject", "sic_code"])
    return found.select("politician_id", "sic_code", "mapping_id")


@query
def primary_match(t):
    found = V.seat_mapping_matches(_subjects(t), t.seats, _mappings(t), ["subject", "politician_id", "sic_code"])
    best = V.primary_match(found, ["subject", "politician_id", "sic_code"])
    return best.select("politician_id", "sic_code", "mapping_id", "match_count")


@query
def relevance_report(t):
    return V.relevance_report(t.trades, t.securities, t.seats, _mappings(t), t.politicians)


def _stats(t):
    stats = V.mapping_review_stats(_mappings(t), t.trades, t.seats, t.securities)
    titles = t.securities.filter("sic_code IS NOT NULL").select("sic_code").distinct()
    return V.scrutiny_flags(V.with_titles(stats, titles))


@query
def mapping_review_stats(t):
    return V.mapping_review_stats(_mappings(t), t.trades, t.seats, t.securities).select(
        "mapping_id", "row_key", "securities_matched", "industry_groups", "trades_matched", "trades_primary", "politicians_matched",
        F.array_join("example_tickers", ",").alias("example_tickers"))


@query
def security_descriptions(t):
    return V.security_descriptions(_mappings(t), t.trades, t.securities)


@query
def mapping_overlaps(t):
    """Overlapping ranges of different committees in the draft, and how many members the committee of each has."""
    members = t.seats.groupBy("committee_code").agg(F.count_distinct("politician_id").alias("members"))
    return V.mapping_overlaps(t.part_ranges, members)


@query
def scrutiny_flags(t):
    return _stats(t).select("mapping_id", F.array_join("flags", ",").alias("flags"), "official_titles")


@query
def review_summary(t):
    return V.review_summary(_stats(t))


@query
def priority_rows(t):
    return V.priority_rows(_stats(t)).select("row_key", "relevance_level", "trades_matched", "position")


@query
def top_mappings(t):
    return V.top_mappings(_stats(t)).select("row_key", "trades_matched", "trades_primary")


@query
def recommendation_gaps(t):
    """Recommendations written for the rows that match trades, checked against the priority rows."""
    stats = _stats(t)
    recs = stats.filter("trades_matched > 0").select(
        "row_key", F.when(F.col("mapping_id") % 3 == 0, "APPROVE DIRECT").when(F.col("mapping_id") % 3 == 1, "KEEP RELATED")
        .otherwise("CHANGE").alias("action"), F.when(F.col("mapping_id") != 8, "read").alias("reason"))
    return V.recommendation_gaps(V.priority_rows(stats), recs)


@query
def mapping_sync(t):
    """Loading the current mapping file over the stored versions, from its untyped form."""
    raw = _mappings(t).withColumns({c: F.lpad(F.col(c).cast("string"), 4, "0") for c in ("sic_start", "sic_end")}).withColumn(
        "reviewed_at", F.col("reviewed_at").cast("string"))
    # a file is written for the committees that have seats
    raw = raw.join(t.seats.select("committee_code").distinct(), "committee_code", "left_semi")
    rows, violations = sync_mappings(raw, t.mappings)
    return rows.select("mapping_id", "mapping_version", "sic_start", "sic_end").unionByName(
        violations.select("mapping_id", F.col("problem").alias("mapping_version")), allowMissingColumns=True)


# --- seats over time -------------------------------------------------------------------------------------------------

@query
def seat_intervals(t):
    return H.seat_intervals(t.events).select(
        "bioguide_id", "committee_code", "congress", "start_date", "end_date", "url", "history_complete", "re_elections", "orphan_removals")


@query
def seats_on_date(t):
    return H.seats_on_date(t.trades, t.seats).select("politician_id", "transaction_date", "committee_code", "temporal_precision")


@query
def committee_history_status(t):
    return H.committee_history_status(t.trades, t.seats)


@query
def effective_seats(t):
    return H.effective_seats(t.trades, t.seats).select(
        "politician_id", "transaction_date", "committee_code", "subcommittee_code", "temporal_precision", "seat_status")


@query
def congress_numbers(t):
    return t.source("orders").groupBy(R.congress_of(F.to_date("o_orderdate")).alias("congress")).agg(F.count("*").alias("days"))


@query
def sync_seat_history(t):
    """Seats after the dated seats of one Congress were rebuilt from the events and the snapshot was annotated."""
    people = t.politicians.select("id", official_id(F.col("id")).alias("bioguide_id"))
    committees = t.events.select("committee_code", F.concat(F.lit("Committee "), "committee_code").alias("committee_name")).distinct()
    out = H.sync_seat_history(H.seat_intervals(t.events), people, t.seats, committees, 104, TODAY, CONGRESS)
    return out.select("politician_id", "committee_code", "subcommittee_code", "temporal_precision", "congress_number", "start_date",
                      "end_date", "verified_through", "history_complete", "committee_name")


# --- context ---------------------------------------------------------------------------------------------------------

def _analysed(t):
    """The tables of an analysis. Trades are joined once and written with the columns it reads, so what that join shuffled is gone before
    they are dealt by politician."""
    trades = stored(t.trades.select(*C.ANALYSED), "analysed-trades")
    return SimpleNamespace(trades=trades, politicians=t.politicians, securities=t.securities, seats=t.seats, mappings=t.mappings, bars=t.bars, benchmark=t.benchmark)


def _context(t, cfg=C.ContextConfig(), **selectors):
    return C.analyze(_analysed(t), cfg, TODAY, **selectors)


CONTEXT_COLUMNS = [
    "trade_id", "context_version", "mapping_version", "committee_relevance", "committee_relevance_reason", "committee_temporal_status",
    "committee_contradicted", "trade_size_anomaly", "disclosure_delay_signal", "excess_return_signal", "signal_count",
    "secondary_signal_count", "meets_flag_rule", "flagged_for_contextual_review", "pending_temporal", "pending_review",
]


@query
def committee_signal(t):
    out = C.committee_signal(t.trades, t.seats, _mappings(t), t.securities)
    return out.select("politician_id", "transaction_date", F.coalesce("ticker", F.lit("")).alias("ticker_key"),
                      "committee_relevance", "committee_relevance_reason",
                      "committee_temporal_status", F.size("direct").alias("direct"), F.size("related").alias("related"),
                      F.size("rejected").alias("rejected"), "pending_review")


@query
def context_flags(t):
    return _context(t).select(*CONTEXT_COLUMNS)


_CONTEXTS = {}


def _stored_context(t):
    """The default context of a data folder, worked out once in a session; all readers share the stored table.

    Tables of a folder are taken not to change within a session.
    """
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _CONTEXTS:
        tables = _analysed(t)
        kept = stored(C.analyze(tables, today=TODAY).drop("result_digest"), "trade_context")
        unstored(tables.trades)
        # a digest says nothing its row does not, and does not pack: readers that compare digests derive them
        _CONTEXTS[key] = kept.withColumn("result_digest", C.result_digest())
    return _CONTEXTS[key]


def _evidence(t):
    """The evidence of the stored context: a narrow step over its rows, several times as large, so readers derive what they ask for."""
    return C.context_evidence(_stored_context(t), t.mappings)


@query
def context_flags_custom(t):
    """A what-if run: longer delay, shorter history, one secondary signal, no temporal gate."""
    cfg = C.ContextConfig(delay_days=60, min_history=5, min_secondary_signals=1, require_temporal_verification=False)
    return _context(t, cfg).select("trade_id", "flagged_for_contextual_review", "meets_flag_rule", "secondary_signal_count")


@query
def context_summary(t):
    return C.context_summary(_stored_context(t))


@query
def context_evidence(t):
    """Evidence rows by kind, with the numbers behind the metric rows."""
    e = _evidence(t)
    days = F.get_json_object("metadata", "$.days").cast("long")
    return e.groupBy("signal_type", "evidence_type", "evidence_key").agg(
        F.count("*").alias("rows"), F.sum(days).alias("days"), F.min("trade_id").alias("first_trade"), F.max("trade_id").alias("last_trade"))


@query
def context_evidence_text(t):
    e = _evidence(t)
    return e.filter("signal_type IN ('committee_relevance', 'disclosure_delay_signal')").select(
        "trade_id", "evidence_key", "evidence_type", "description")


@query
def context_merge(t):
    """A default run written over the rows an earlier, stricter reading left: which rows change."""
    new = _stored_context(t)
    earlier = new.filter("transaction_date <= DATE '2000-06-30'").withColumn("result_digest", F.when(
        F.col("trade_size_anomaly"), F.lit("older")).otherwise(F.col("result_digest")))
    store = ContextStore(t.spark, f"{work_dir(t.spark)}/civicledger/contexts-{uuid.uuid4().hex}")
    proofs = lambda rows: C.context_evidence(rows, t.mappings)
    store.save(earlier, proofs)
    return store.save(new, proofs)


def _screen_tables(t):
    """A screen reads the stored context; evidence is derived by those that ask for a committee, from a few columns."""
    context = _stored_context(t)
    return S.ScreenTables(t.trades, context, _evidence(t), t.politicians, t.securities, t.mappings,
                          _explanations(context))


def _explanations(context):
    """Stored explanations: written for the current context, for an outdated one, and under an older prompt."""
    words = F.filter(F.split("trade_id", "-"), lambda w: w != "")
    n = F.get(words, F.lit(0)).cast("long")
    return context.select(
        n.alias("id"), "trade_id", "context_version", "mapping_version",
        F.when(n % 5 == 0, "2").otherwise("3").alias("prompt_version"),
        F.when(n % 3 == 0, "outdated").otherwise(F.col("result_digest")).alias("context_digest"),
        F.concat(F.lit("Trade "), "trade_id").alias("headline"), F.col("transaction_date").alias("created_at"))


@query
def fresh_explanations(t):
    context = _stored_context(t)
    return D.fresh_explanations(_explanations(context), context).select("trade_id", "explanation_id", "headline")


@query
def trade_list_page(t):
    return S.page(S.filter_trades(t.trades, chamber="house", transaction_type="buy", date_from="1998-01-01"), limit=500, offset=100).select(
        "id", "politician_name", "disclosure_date")


@query
def trade_list_flagged(t):
    return S.filter_trades(t.trades, _stored_context(t), flagged=True).select("id", "ticker", "transaction_date")


@query
def trade_page_nulls_last(t):
    return S.page(t.trades, "ticker", "desc", limit=500).select("id", "ticker", "amount_min")


@query
def politician_list(t):
    return S.list_politicians(t.politicians, "senate", "marie").select("id", "name")


FILTER_SETS = {
    "dimensions": [("politician", "contains", "marie"), ("chamber", "is", "house"), ("party", "is", "r"), ("company", "contains", "ring"),
                   ("industry", "contains", "ndustr"), ("transaction_type", "in", ["buy", "sell"])],
    "numbers": [("transaction_date", "between", ["1996-01-01", "2000-12-31"]), ("value", "gte", 15001), ("disclosure_delay", "gte", 30),
                ("excess_return", "abs_gte", 10), ("trade_size_percentile", "lte", 95)],
    "context": [("committee_relevance", "is", "yes"), ("committee_name", "contains", "machinery"), ("active_signals", "gte", 2)],
    "unknowns": [("committee_relevance", "is", "unknown"), ("review_status", "is", "not_flagged"), ("custom_screen", "is", "no_match"),
                 ("ai_context", "is", "unavailable")],
    "exclusions": [("district", "is", "3"), ("ticker", "contains", "rand#1"), ("disclosure_date", "gte", "1997-01-01"),
                   ("value", "lte", 50000), ("state", "is", "sd"), ("ai_context", "is", "available")],
}


def filters_of(name):
    return S.parse_filters([{"field": f, "op": op, "value": v} for f, op, v in FILTER_SETS[name]])


@query
def screen_counts(t):
    """Totals of every filter set under the canonical rule."""
    return S.screen_counts_each(_screen_tables(t), S.PRESETS["balanced"], {name: filters_of(name) for name in FILTER_SETS})


def _rule_rows(t, rule, filters=()):
    return S.screened(_screen_tables(t), rule, filters).select(
        "id", "committee_active", "size_active", "delay_active", "excess_active", "active_count", "matches", "differs_from_canonical")


@query
def screen_rule_balanced(t):
    return _rule_rows(t, S.PRESETS["balanced"])


@query
def screen_rule_strict(t):
    return _rule_rows(t, S.PRESETS["strict"])


@query
def screen_rule_related(t):
    """Related mappings count too, timing does not matter, and the thresholds are the reader's own."""
    return _rule_rows(t, S.ContextRule(
        reviewed_direct_only=False, require_temporal_verification=False, trade_size_percentile_threshold=75,
        disclosure_delay_threshold_days=30, excess_return_threshold_pct_points=10, minimum_secondary_signals=1))


@query
def screen_rule_market(t):
    return _rule_rows(t, S.PRESETS["market_focus"])


@query
def rule_sweep(t):
    """Matches under all rules that differ in what is required, enabled and needed; incoherent ones are refused."""
    settings = {f"{'committee' if required else 'market'}-{enabled}-{need}": {
        "committee_relevance_required": required, "enable_disclosure_delay_signal": enabled > 1, "enable_excess_return_signal": enabled > 2, "minimum_secondary_signals": need}
        for required in (True, False) for enabled in (1, 2, 3) for need in (0, 1, 2, 3)}
    return S.rule_counts(_screen_tables(t), settings)


@query
def screen_page(t):
    rows, _ = S.screen(_screen_tables(t), S.PRESETS["committee_focus"], filters_of("numbers"), "politician_name", "asc", 200, 20)
    return rows.select("id", "politician_name", "matches", "active_count")


# --- people and securities -------------------------------------------------------------------------------------------

def _matches(t):
    return E.match_politicians(t.politicians, t.roster)


@query
def match_politicians(t):
    return _matches(t).drop("name", "chamber", "state")


@query
def due_politicians(t):
    overrides = t.politicians.filter("enrichment_status = 'review'").select(F.col("id").alias("politician_id"))
    suggested = t.politicians.filter("district IS NOT NULL").select(F.col("id").alias("politician_id"))
    return E.due_politicians(t.politicians, NOW, overrides, suggested).select("id", "due_reason")


def _links(t):
    """A reviewed link for every politician; some name an official nobody knows, some one of the other chamber."""
    key = F.col("id")
    wanted = F.when(key % 5 == 0, "Z999999").when(key % 7 == 0, official_id(key + 1)).otherwise(official_id(key))
    return t.politicians.select(key.alias("politician_id"), wanted.alias("bioguide_id"))


@query
def override_resolution(t):
    unmatched = _matches(t).filter("status = 'unmatched'").select("id", "name", "chamber", "state")
    return E.resolve_overrides(unmatched, _links(t), t.roster)


@query
def ownership_conflicts(t):
    return E.ownership_conflicts(_matches(t).select("id", "bioguide_id"), t.politicians)


@query
def refresh_seats(t):
    """Clerk seats of the matched politicians replaced by today's roster seats."""
    matched = _matches(t).filter("status = 'matched'").select("id", "bioguide_id")
    today = t.source("customer").select(
        official_id(F.col("c_custkey")).alias("bioguide_id"), F.col("c_mktsegment").alias("committee_code"),
        F.lit("current_snapshot").alias("temporal_precision"))
    out = E.refresh_seats(matched, today, t.seats, "house.clerk")
    return out.select("politician_id", "committee_code", "subcommittee_code", "temporal_precision", "start_date")


@query
def load_overrides(t):
    """Reviewed links checked as a file: how often each rule is broken. A single problem keeps the whole file out."""
    key = F.col("id")
    entries = t.politicians.select(
        F.when(key % 29 == 0, "house:nobody").otherwise(F.concat("canonical_key", F.lit("#"), key.cast("string"))).alias("canonical_key"),
        F.lit(None).cast("long").alias("politician_id"),
        F.when(key % 5 == 0, "12345").otherwise(F.lower(official_id(key))).alias("bioguide_id"),
        F.when(key % 3 == 0, "").otherwise("roster page").alias("reason"), F.lit("official site").alias("source"),
        F.lit("2001-05-01").alias("reviewed_at"))
    people = t.politicians.withColumn("canonical_key", F.concat("canonical_key", F.lit("#"), key.cast("string")))
    rows, skipped, violations = load_overrides_file(entries, people)
    counted = violations.groupBy(F.col("problem").alias("item")).agg(F.count("*").alias("entries"))
    return counted.unionByName(skipped.agg(F.count("*").alias("entries")).select(F.lit("skipped").alias("item"), "entries")).unionByName(
        rows.agg(F.count("*").alias("entries")).select(F.lit("accepted").alias("item"), "entries"))


def _suggestions(t):
    key = F.col("id")
    chosen = (
        F.when(key % 7 == 0, F.lit(None)).when(key % 7 == 1, "Z000000").when(key % 7 == 2, official_id(key + 1)).otherwise(official_id(key)))
    return t.politicians.select(
        key.alias("suggestion_id"), key.alias("politician_id"), chosen.alias("selected_bioguide_id"),
        ((key % 11) / 10).alias("confidence"), F.array().cast("array<string>").alias("alternates"))


@query
def suggestion_gate(t):
    return E.gate_suggestions(_suggestions(t), t.politicians, t.roster, 0.3).select("politician_id", "outcome", "reason")


@query
def review_queue(t):
    judged = E.gate_suggestions(_suggestions(t), t.politicians, t.roster, 0.3)
    return E.review_queue(t.politicians, judged).drop("name", "chamber")


@query
def member_records(t):
    """Roster entries read from raw member records, one per customer."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    raw = t.source("customer").select(
        F.concat(F.lit(" "), official_id(key)).alias("bioguideId"),
        F.concat(last_name(key), F.lit(", "), pick(FIRST_NAMES, key), F.when(key % 2 == 0, " Lee").otherwise(""),
                 F.when(key % 4 == 1, ", Jr.").otherwise("")).alias("name"),
        *[F.lit(None).cast("string").alias(c) for c in ("firstName", "middleName", "lastName")],
        pick(["Democratic", "Republican", "Green"], key).alias("partyName"),
        F.lit(None).cast("array<struct<partyName:string,startYear:int>>").alias("partyHistory"),
        pick(["Ohio", "new york", "TX", "Atlantis"], nation.cast("long")).alias("state"), (key % 4).cast("string").alias("district"),
        F.concat(
            F.when(key % 3 == 0, '{"item": ').otherwise(""), F.lit('[{"chamber": "Senate", "startYear": 1980, "endYear": 1986}, {"chamber": "'),
            F.when(key % 9 == 8, "Council").otherwise("House of Representatives"), F.lit('", "startYear": 1991'),
            F.when(key % 5 == 0, ', "endYear": 1999').otherwise(""), F.lit("}]"), F.when(key % 3 == 0, "}").otherwise("")).alias("terms"))
    return normalize_members(raw).select(
        "bioguide_id", "full_name", "suffix", "chamber", "party", "state", "district", "active", "term_start_year", "official_url")


def _registers(t):
    """(full list, plain list, company records) for the traded brands, with gaps, doubles and companies without a code."""
    brands = t.source("part").groupBy("p_brand").agg(F.min("p_name").alias("name")).withColumn("no", F.substring("p_brand", 7, 10).cast("int"))
    number = F.col("no") + 1000
    ciks = F.when(F.col("no") % 6 == 0, F.array(number, number + 500)).otherwise(F.array(number))
    full = brands.withColumn("cik", F.explode(F.when(F.col("no") % 5 != 0, ciks))).select(
        F.col("cik").cast("string").alias("cik"), "name", F.upper("p_brand").alias("ticker"), F.lit("NYSE").alias("exchange"), F.col("cik").alias("position"))
    plain = brands.withColumn("cik", F.explode(F.when(F.col("no") % 10 != 0, ciks))).select(F.lower("p_brand").alias("ticker"), F.col("cik").cast("string").alias("cik"))
    records = brands.select(
        number.cast("string").alias("cik"), F.concat(F.lit(" "), "name", F.lit(" Corp ")).alias("name"),
        F.when(F.col("no") % 4 == 0, "0").when(F.col("no") % 4 == 1, "").otherwise((F.col("no") * 40).cast("string")).alias("sic"),
        F.concat(F.lit("Kind "), "no").alias("sic_description"), F.array(F.lit(""), F.lit("OTC")).alias("exchanges"))
    return full, plain, records


@query
def resolve_profiles(t):
    out = E.resolve_profiles(t.securities, *_registers(t), NOW)
    return out.select("ticker", "company_name", "cik_code", "sic_code", "industry", "sector", "exchange", "profile_status", "profile_note")


@query
def due_securities(t):
    return E.due_securities(t.securities, t.trades, NOW).select("ticker", "due_reason")


def _documents(t):
    """One adopted resolution per order: two members, by surname and by full name, on the committee of its priority."""
    key, order = F.col("o_custkey"), F.col("o_orderkey")
    verb = F.when(F.col("o_orderstatus") == "O", "removed from").otherwise("elected to")
    state = F.when(order % 2 == 0, F.concat(F.lit(" of N"), letter(key % 25))).otherwise("")
    head = F.when(order % 11 == 0, "Committee on Ways").otherwise(F.concat(F.lit("<italic>Committee on</italic> Priority "), pick(["A", "B", "C", "D", "E"], key)))
    adopted = F.when(order % 13 != 0, F.concat(
        F.lit("In the House of Representatives, U. S., "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit("."))).otherwise("Introduced")
    xml = F.concat(
        F.lit("<resolution><form><action><action-desc>"), adopted, F.lit("</action-desc></action></form><resolution-body><section><text>That the following named Members be "),
        verb, F.lit(" the following standing committees of the House:</text><paragraph><enum>(1)</enum><header>"), head,
        F.lit(":</header><text>Mr. "), last_name(key), state, F.lit(" (Chair), Ms. "), pick(FIRST_NAMES, key), F.lit(" "), last_name(key),
        F.lit(", to rank immediately after, the Speaker.</text></paragraph></section></resolution-body></resolution>"))
    return t.source("orders").select(F.concat(F.lit("Res. "), order.cast("string")).alias("label"), order.cast("string").alias("url"), xml.alias("xml"))


def _house(t):
    """Members as the clerk lists them; every eighth is known only as departed."""
    key = F.col("c_custkey")
    return t.source("customer").select(
        F.when(key % 8 != 7, official_id(key)).alias("bioguide_id"), pick(FIRST_NAMES, key).alias("first_name"), last_name(key).alias("last_name"),
        F.concat_ws(" ", pick(FIRST_NAMES, key), last_name(key)).alias("official_name"), F.concat(F.lit("N"), letter(key % 25)).alias("state_name"),
        F.when(key % 10 == 0, F.lit("1998-01-01").cast("date")).alias("sworn"), F.lit(0).alias("prior_congress"))


def _priorities(t):
    code = pick(["A", "B", "C", "D", "E"], F.col("o_custkey"))
    return t.source("orders").select(code.alias("committee_code")).distinct().withColumn(
        "committee_name", F.concat(F.lit("Committee on the Priority "), "committee_code"))


@query
def committee_paragraphs(t):
    return listed_names(parse_resolutions(_documents(t))).select("label", "date", "verb", "header", "segment", "name", "state", "odd")


@query
def committee_events_found(t):
    events, _ = committee_events(_documents(t), _house(t), _priorities(t))
    return events.select("bioguide_id", "committee_code", "date", "verb", "url", F.col("seq.segment").alias("segment"))


@query
def committee_event_report(t):
    _, report = committee_events(_documents(t), _house(t), _priorities(t))
    return report.groupBy("outcome").agg(F.count("*").alias("names"))


@query
def latest_trade_per_politician(t):
    return latest_by(t.trades, ["politician_id"], ["transaction_date", "id"], ["id", "ticker", "transaction_type"])


# --- explanations ----------------------------------------------------------------------------------------------------

def _texts(context):
    """An explanation per trade, right or wrong in one of many ways."""
    facts = context.select(
        "trade_id", F.get(F.split("trade_id", "-"), F.lit(0)).cast("long").alias("n"), F.col("disclosure_delay_days").alias("days"),
        "transaction_date", "ticker", "amount_min")
    see, first = F.lit("See the stored value."), F.expr(FIRST_EXPLANATION)
    signals = F.array(*[F.struct(kind.alias("type"), text.alias("explanation")) for kind, text in (
        (F.lit("committee_relevance"), first), (F.lit("trade_size_anomaly"), see), (F.lit("disclosure_delay_signal"), see), (F.expr(LAST_SIGNAL), see))])
    return facts.select("trade_id", F.expr(HEADLINE).alias("headline"), F.expr(SUMMARY).alias("summary"), F.expr(LIMITATIONS).alias("limitations"), signals.alias("signals"))


@query
def explanation_audit(t):
    context = _stored_context(t)
    facts = A.explanation_facts(context, _evidence(t), t.trades)
    out = A.explanation_audit(_texts(context), facts, t.mappings)
    return out.select("trade_id", F.array_join("problems", "; ").alias("problems"))


# --- streaming -------------------------------------------------------------------------------------------------------

@query
def stream_ingest(t):
    """The feed as a file stream, stored by a catch-up run that is then run once more."""
    root = f"{work_dir(t.spark)}/civicledger/ingest-{uuid.uuid4().hex}"
    events = t.spark.readStream.schema(t.source("events").schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    store = TradeStore(t.spark, f"{root}/tables")
    for _ in range(2):
        state = catch_up(feed_records(events), store, f"{root}/checkpoint", now=NOW)
    tables = [("trades", store.read("trades")), ("rejects", store.read("rejects")), ("politicians", store.latest("politicians")),
              ("securities", store.latest("securities"))]
    counts = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows")) for name, df in tables]
    counts += [state.select(F.lit(name).alias("table_name"), F.col(name).alias("rows")) for name in ("inserted", "skipped")]
    return reduce(lambda a, b: a.unionByName(b), counts)


PAGE = 500


def _total(count):
    """Records of the first `count` events: every tenth event has a second, identical record."""
    return count + -(-count // 10)


def _published(t, events, count, page_size, chunk):
    """The records of the first `count` events as a paged feed, newest first."""
    ceiling = F.ceil(F.col("_event") / 10)
    records = feed_records(events).withColumn("_event", F.floor(F.col("seq") / 2))
    total = _total(count)
    place = (total - 1 - F.col("_event") - ceiling - F.col("seq") % 2).cast("long")
    pages = PageFiles(t.spark, f"{work_dir(t.spark)}/civicledger/feed-{uuid.uuid4().hex}", chunk)
    return pages.publish(records.withColumn("_place", place).drop("seq", "_event"), "_place", page_size)


@query
def paged_ingest(t):
    """Three runs over a paged feed: one that meets its page limit, one that reads the rest, one after the feed has grown."""
    events = t.source("events")
    count = events.count()
    early = count * 4 // 5
    before = _published(t, events.filter(F.col("event_id") < early), early, PAGE, 4)
    after = _published(t, events, count, PAGE, 4)
    store = TradeStore(t.spark, f"{work_dir(t.spark)}/civicledger/ingest-{uuid.uuid4().hex}")
    limit = max(1, -(-_total(early) // PAGE) // 2)
    run_pages(store, before, PAGE, limit, now=NOW)
    run_pages(store, before, PAGE, 10**6, now=NOW)
    run_pages(store, after, PAGE, 10**6, now=NOW)
    return store.read("runs").drop("last_success_at", "source")


@query
def stream_pages(t):
    """A feed in twelve files, which cut groups of identical records, stored in batches of four files."""
    events = t.source("events")
    count = events.count()
    per_file = max(1, -(-_total(count) // (12 * PAGE)))  # pages stay small, files hold as many as it takes
    pages = _published(t, events, count, max(1, -(-_total(count) // (12 * per_file))), per_file)
    root = f"{work_dir(t.spark)}/civicledger/ingest-{uuid.uuid4().hex}"
    store = TradeStore(t.spark, f"{root}/tables")
    catch_up(page_stream(t.spark, f"{pages.path}/chunk=*", files_per_batch=4, lines=True), store, f"{root}/checkpoint", now=NOW)
    return store.read("trades").select("fingerprint", "occurrence")
