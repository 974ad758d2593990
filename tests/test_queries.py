"""Registered queries against their SQL. CIVIC_ALL=1 runs every query, otherwise some of each family."""

import os

import pytest

from compare import DATA, compare, duck

from civicledger.plans.oracles import ORACLES
from civicledger.plans.queries import QUERIES

FOLDER = f"{DATA}/sf0.001"
SOME = ["flagship_performance_by_security", "fixed_horizon_excess", "dedupe_occurrences", "overview_totals", "size_percentile_prior",
        "price_batch_outcome", "relevance_report", "seat_intervals", "context_flags", "match_politicians", "committee_events_found", "committee_event_report",
        "context_evidence_text", "context_merge", "screen_counts", "screen_rule_balanced", "screen_rule_strict", "screen_rule_related", "screen_rule_market", "explanation_audit",
        "mapping_overlaps", "mapping_sync", "priority_rows", "ordered_seats", "politician_breakdown_months", "sync_seat_history", "price_batches", "stream_ingest", "paged_ingest", "stream_pages", "price_table_content", "table_fingerprint", "rule_sweep", "prior_median"]
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("CIVIC_ALL") else SOME)
def test_query_equals_sql(spark, con, name):
    rows, problem = compare(spark, FOLDER, name, con)
    assert problem is None and rows > 0
