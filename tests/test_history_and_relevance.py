import datetime as dt
import random

import pytest

from civicledger.operators import history as H, relevance as V

D = dt.date.fromisoformat
EVENT = "bioguide_id string, committee_code string, date date, verb string, url string, seq long"
SEAT = ("politician_id long, committee_code string, subcommittee_code string, temporal_precision string, congress_number int, "
        "start_date date, end_date date, verified_through date, history_complete boolean")


def read_intervals(events):
    """A plain reading of elections and removals in order."""
    out, clean, open_ = [], True, None
    for d, verb in sorted(events, key=lambda e: (e[0], e[1] == "removed")):
        if verb == "elected":
            clean, open_ = clean and open_ is None, d
        elif open_ is not None:
            out, open_ = [*out, (open_, d)], None
        else:
            clean = False
    return sorted([*out, *([(open_, None)] if open_ else [])], key=str), clean


def test_intervals_equal_a_plain_reading(spark, table):
    rng = random.Random(3)
    start, by_member, rows = D("2025-02-01"), {}, []
    for m in range(60):
        events = [(start + dt.timedelta(rng.randrange(6)), rng.choice(["elected", "removed"])) for _ in range(rng.randrange(1, 7))]
        by_member[f"M{m}"] = read_intervals(events)
        rows += [(f"M{m}", "AG00", d, v, "u", i) for i, (d, v) in enumerate(events)]
    df = spark.createDataFrame(rows, EVENT)
    found = {}
    for r in H.seat_intervals(df).collect():
        found.setdefault(r.bioguide_id, []).append(r)
    for member, (spans, clean) in by_member.items():
        got = found.get(member, [])
        assert sorted([(r.start_date, r.end_date) for r in got], key=str) == spans
        assert all(r.history_complete == clean for r in got)


def test_snapshot_confirms_open_seats_of_its_own_congress(table):
    events = table(EVENT, ("A", "X", "2025-01-10", "elected", "u1", 1), ("B", "X", "2025-01-10", "elected", "u2", 2),
                   ("C", "X", "2023-01-10", "elected", "u3", 3), ("D", "X", "2025-01-10", "elected", "u4", 4))
    listed = table("bioguide_id string, committee_code string", ("A", "X"), ("C", "X"), ("D", "X"))
    doubt = table("bioguide_id string", ("D",))
    rows = {r.bioguide_id: r for r in H.seat_intervals(events, listed, doubt, "2026-03-01", 119).collect()}
    assert {k: r.verified_through for k, r in rows.items()} == {"A": D("2026-03-01"), "B": None, "C": None, "D": D("2026-03-01")}
    assert [rows[k].history_complete for k in "ABCD"] == [True, True, True, False]


SNAP = ("current_snapshot", 119, None, None, "2026-03-01", None)


@pytest.mark.parametrize("seats, status, applies", [
    ([("X", None, *SNAP)], "unknown", 1),
    ([("X", None, "exact_date", 119, "2025-01-10", None, "2026-03-01", True)], "verified", 1),
    ([("X", None, "exact_date", 119, "2025-08-10", None, "2026-03-01", True), ("X", "S1", *SNAP)], "contradicted", 0),
    ([("X", None, "exact_date", 119, "2025-08-10", None, "2026-03-01", False), ("X", "S1", *SNAP)], "unknown", 1),
    ([("X", None, "exact_date", 119, "2025-01-10", None, "2025-02-01", True), ("X", None, *SNAP)], "unknown", 1),
    ([("X", None, "congress", 119, None, None, None, None)], "verified", 1),
    ([("X", None, "exact_date", 119, "2025-08-10", None, None, True), ("X", None, "congress", 119, None, None, None, None)], "contradicted", 0),
    ([("X", None, "exact_date", 119, "2025-01-10", "2025-03-01", None, True), ("X", None, "exact_date", 119, "2025-07-01", "2025-09-01", None, True)],
     "contradicted", 0),
])
def test_what_is_known_about_a_seat_on_a_day(table, seats, status, applies):
    days = table("politician_id long, transaction_date date", (1, "2025-06-01"), (1, "2025-06-01"))
    held = table(SEAT, *[(1, *s) for s in seats])
    assert H.committee_history_status(days, held).first().history_status == status
    assert H.effective_seats(days, held).count() == applies


def test_reading_another_congress_contradicts_a_missing_committee(table):
    days = table("politician_id long, transaction_date date", (1, "2023-06-01"))
    held = table(SEAT, (1, "X", None, "exact_date", 118, "2023-01-10", None, "2023-12-01", True), (1, "Y", None, *SNAP))
    got = {r.committee_code: r.history_status for r in H.committee_history_status(days, held).collect()}
    assert got == {"X": "verified", "Y": "contradicted"}


def test_subcommittees_are_never_better_than_current(table):
    days = table("politician_id long, transaction_date date", (1, "2025-06-01"))
    held = table(SEAT, (1, "X", None, "exact_date", 119, "2025-01-10", None, "2026-03-01", True), (1, "X", None, *SNAP), (1, "X", "S1", *SNAP))
    got = {(r.subcommittee_code, r.temporal_precision): r.seat_status for r in H.effective_seats(days, held).collect()}
    assert got == {(None, "exact_date"): "temporally_verified", (None, "current_snapshot"): "temporally_verified",
                   ("S1", "current_snapshot"): "current_assignment_only"}


MAPPING = ("mapping_id long, committee_code string, subcommittee_code string, committee_name string, subcommittee_name string, sic_start int, "
           "sic_end int, industry_pattern string, relevance_level string, review_status string, reviewed_at date, jurisdiction_basis string, "
           "mapping_version string, review_note string")


def mapping(i, code, lo, hi, level="direct", sub=None, pattern=None, status="reviewed"):
    return (i, code, sub, code, sub, lo, hi, pattern, level, status, "2026-01-01" if status == "reviewed" else None, "rule_x_text", "v1", None)


def test_relevance_reasons_and_best_match(table):
    mappings = table(MAPPING, mapping(1, "X", 1000, 1999), mapping(2, "X", 1500, 1599), mapping(3, "X", 1000, 1999, "related", "S1"),
                     mapping(4, "X", 1500, 1500, pattern="steel"), mapping(5, "Z", None, None, "none"), mapping(6, "X", 7000, 7999, status="needs_review"))
    seats = table(SEAT, (1, "X", "S1", *SNAP), (2, "X", None, *SNAP), (3, "Q", None, *SNAP), (3, "X", None, *SNAP), (5, "Z", None, *SNAP))
    subjects = table("k long, politician_id long, sic_code string, industry string", (1, 1, "1500", "Iron"), (2, 2, "1500", "STEEL works"),
                     (3, 3, "9000", "x"), (4, 4, "1500", "x"), (5, 5, "1500", "x"), (6, 2, "150", "x"), (7, 2, "7001", None))
    rows = {r.k: r for r in V.industry_relevance(subjects, seats, mappings, ["k"]).collect()}
    assert [rows[k].reason for k in range(1, 8)] == [
        "match", "match", "unmapped_committees", "no_committee_assignments", "no_match", "no_sic", "match"]
    assert (rows[1].mapping_id, rows[1].match_count) == (3, 3)  # a subcommittee row comes before a narrower direct one
    assert (rows[2].mapping_id, rows[2].match_count) == (4, 3)
    assert [rows[k].review_category for k in (1, 5, 7)] == ["reviewed_direct", "no_relevance", "needs_review_only"]


def test_overlaps_cross_thousands(table):
    mappings = table(MAPPING, mapping(1, "X", 1990, 2010), mapping(2, "Y", 2010, 5000, "related"), mapping(3, "X", 2000, 2001), mapping(4, "Y", 5001, 6000))
    got = {(r.mapping_id, r.overlaps_with) for r in V.mapping_overlaps(mappings).collect()}
    assert got == {(1, "Y 2010-5000 (related)"), (2, "X 1990-2010 (direct)")}


def test_recommendations_need_exactly_one_fitting_answer(table):
    rows = table("row_key string, relevance_level string", ("a", "direct"), ("b", "related"), ("c", "direct"), ("d", "direct"))
    recs = table("row_key string, action string, reason string", ("a", "APPROVE DIRECT", "r"), ("b", "REMOVE", " "), ("c", "KEEP RELATED", "r"),
                 ("x", "REMOVE", "r"), ("e", "MAYBE", "r"))
    got = {r.row_key: r.problem for r in V.recommendation_gaps(rows, recs).collect()}
    assert got == {"b": "reason needed", "c": "action needs a related row", "d": "missing recommendation", "x": "not a selected row", "e": "unknown action"}


def test_history_replaces_one_congress_only(table):
    seats = table(SEAT + ", source string", (1, "X", None, "exact_date", 118, None, None, None, True, "house.resolutions"),
                  (1, "X", None, "exact_date", 119, None, None, None, True, "house.resolutions"), (1, "Y", None, *SNAP, "house.clerk"))
    people = table("id long, bioguide_id string", (1, "A"), (2, None))
    events = table(EVENT, ("A", "X", "2025-01-10", "elected", "u", 1), ("A", "X", "2023-01-10", "elected", "u", 1))
    names = table("committee_code string, committee_name string", ("X", "Committee X"))
    out = H.sync_seat_history(H.seat_intervals(events), people, seats, names, 119, "2026-03-02", 120).collect()
    dated = [r for r in out if r.temporal_precision == "exact_date"]
    assert sorted((r.congress_number, r.start_date) for r in dated if r.start_date) == [(119, D("2025-01-10"))] and len(dated) == 2
    (snapshot,) = [r for r in out if r.temporal_precision == "current_snapshot"]
    assert (snapshot.congress_number, snapshot.verified_through) == (120, D("2026-03-02"))
