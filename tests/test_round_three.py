"""Steps that are to stay the same per row however large the tables get."""

from civicledger.operators import signals as G
from civicledger.session import TASK_BYTES, fit_shuffles

TRADES = "id string, politician_id long, transaction_date date, disclosure_date date, amount_min long, amount_max long"
ROWS = [
    ("a", 1, "2000-01-01", "2000-01-05", 1, 3), ("b", 1, "2000-01-01", None, 5, 5), ("c", 1, "2000-01-02", None, 2, 2),
    ("d", 1, "2000-01-03", None, None, None), ("e", 1, "2000-01-04", "2000-01-01", 9, 9), ("f", 1, "2000-01-05", None, 2, 2),
    ("g", 1, "2000-01-06", None, 4, None), ("h", 1, None, None, 4, 4), ("i", None, "2000-01-06", None, 4, 4), ("j", 2, "2000-01-01", None, 7, 8),
    ("k", 1, "2000-01-06", None, 100, 100), ("l", 1, "2000-01-06", None, 0, 0), ("m", 2, "2000-01-09", None, 8, 7)]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_carried_history_gives_the_rows_of_the_joined_one(spark, table, monkeypatch):
    trades = table(TRADES, *ROWS)
    carried = G.size_signal(trades, "2001-01-01", min_history=1)
    monkeypatch.setattr(G, "CARRIED_TRADES", 0)
    joined = G.size_signal(trades, "2001-01-01", min_history=1)
    assert sorted(map(str, carried.select(*joined.columns).collect())) == sorted(map(str, joined.collect()))
    assert exchanges(carried) == 1  # trades are dealt by politician, and not once more to meet their history


def test_shuffles_follow_the_size_of_the_input(spark, tmp_path):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        (tmp_path / "big").write_bytes(b"\0" * (21 << 20))
        (tmp_path / "small").write_bytes(b"\0")
        fit_shuffles(spark, tmp_path / "small")
        assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
        fit_shuffles(spark, tmp_path / "big")
        fit_shuffles(spark, tmp_path / "small")
        assert spark.conf.get("spark.sql.shuffle.partitions") == "10"
        assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == f"{TASK_BYTES}b"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_evidence_is_derived_for_the_changed_rows_only(spark, tmp_path):
    from civicledger.operators.context_store import ContextStore

    def rows(*digests):
        return spark.createDataFrame([(f"t{i}", "v", "m", d) for i, d in enumerate(digests)], "trade_id string, context_version string, mapping_version string, result_digest string")

    def proofs(df):
        asked.append(sorted(r.trade_id for r in df.collect()))
        return df.filter("result_digest <> 'none'").select("trade_id", "context_version", "mapping_version")

    store, asked = ContextStore(spark, str(tmp_path)), []
    assert [tuple(r) for r in store.save(rows("a", "b"), proofs).collect()] == [("inserted", 2, 2)]
    out = store.save(rows("a", "none", "c"), proofs)
    assert sorted(map(tuple, out.collect())) == [("inserted", 1, 1), ("unchanged", 1, 1), ("updated", 1, 0)]
    assert asked == [["t0", "t1"], ["t1", "t2"]]


DRAFT = "mapping_id long, committee_code string, subcommittee_code string, sic_start int, sic_end int, relevance_level string, review_status string, reviewed_at string"


def test_overlaps_are_paired_by_distinct_range_and_not_shuffled_after_that(spark):
    from civicledger.operators import relevance as V

    ranges = [("A", 10, 19), ("B", 15, 30), ("A", 20, 25), ("C", 30, 30), ("B", 40, 39), ("C", 10, 60)]
    rows = [(i, *ranges[i % 6][:1], "S" if i % 4 == 0 else None, *ranges[i % 6][1:], "none" if i % 7 == 0 else "direct", "reviewed", "x") for i in range(120)]
    drafts = spark.createDataFrame(rows, DRAFT)
    label = lambda r: f"{r[1]}{'/' + r[2] if r[2] else ''} {r[3]:04d}-{r[4]:04d} ({r[5]})"
    live = [r for r in rows if r[5] != "none"]
    want = {(m[0], label(o)) for m in live for o in live if m[1] != o[1] and max(m[3], o[3]) <= min(m[4], o[4])}
    found = V.mapping_overlaps(drafts)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # rows of the result are as many as mappings times labels: none of them goes through an exchange
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    members = spark.createDataFrame([("A", 3), ("B", 4)], "committee_code string, members long")
    code = {r[0]: r[1] for r in rows}
    assert {tuple(r) for r in V.mapping_overlaps(drafts, members).collect()} == {(*w, {"A": 3, "B": 4}[code[w[0]]]) for w in want if code[w[0]] != "C"}


def test_no_task_holds_the_seats_of_all_people(spark, table):
    from civicledger.operators import history as H

    seats = table("politician_id long, committee_code string, subcommittee_code string, temporal_precision string, congress_number int, start_date date, "
                  "end_date date, verified_through date, history_complete boolean", (1, "A", None, "exact_date", 106, "2000-01-01", "2000-06-01", None, True))
    days = table("politician_id long, transaction_date date", (1, "2000-02-01"), (1, "2000-07-01"), (2, "2000-02-01"))
    out = H.effective_seats(days, seats)
    assert [str(r.transaction_date) for r in out.collect()] == ["2000-02-01"]
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_trades_meet_small_price_tables_without_an_exchange(spark, table, tmp_path):
    from civicledger.operators import performance as P

    trades = table("id string, ticker string, transaction_type string, transaction_date date, disclosure_date date", ("a", "X", "buy", "2000-01-03", "2000-01-05"), ("b", None, "buy", "2000-01-03", None))
    bars = table("ticker string, date date, close double, adj_close double", ("X", "2000-01-03", 10.0, 10.0), ("X", "2000-01-10", 11.0, 11.0))
    bars.write.parquet(str(tmp_path / "bars"))
    bars = spark.read.parquet(str(tmp_path / "bars"))
    perf = P.trade_performance(trades, bars, bars, "2001-01-01", None, ("transaction",))
    # the days' outcomes are a table whose size is known
    assert "SortMergeJoin" not in perf._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.status) for r in perf.collect()) == [("a", "ok"), ("b", "no_ticker")]


def test_screens_write_no_evidence(spark):
    import glob
    import os

    import pytest

    from civicledger.plans.queries import QUERIES
    from civicledger.session import work_dir
    from test_queries import FOLDER

    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    before = set(glob.glob(f"{work_dir(spark)}/civicledger/*evidence*"))
    assert QUERIES["screen_rule_balanced"](spark, FOLDER).count() > 0
    assert set(glob.glob(f"{work_dir(spark)}/civicledger/*evidence*")) == before


def test_an_audit_keeps_a_trade_in_one_row(spark):
    from civicledger.operators import audit as A

    facts = spark.createDataFrame(
        [("t1", [1.0], [("Committee on Sea Ports", None)], "Ada Mc", True), ("t2", [1.0], [], "Ben Mc", True), ("t3", [1.0], [], "Cora Mc", True)],
        "trade_id string, numbers array<double>, committees array<struct<committee_name:string,subcommittee_name:string>>, own_names string, flagged boolean")
    good = [("committee_relevance", "See.")]
    texts = spark.createDataFrame(
        [("t1", "A", "It belongs to sea ports.", "C", good), ("t2", "A", "It belongs to sea ports.", "C", good), ("t3", "A", "B", "C", None)],
        "trade_id string, headline string, summary string, limitations string, signals array<struct<type:string,explanation:string>>")
    known = spark.createDataFrame([("Committee on Sea Ports",)], "committee_name string")
    out = A.explanation_audit(texts, facts, known)
    assert {r.trade_id: r.problems for r in out.collect()} == {
        "t1": [], "t2": ["summary mentions sea ports, which is not in the evidence"], "t3": ["no signal explanations"]}
    # texts are not multiplied for all rules: only the search for names takes them apart
    assert out._jdf.queryExecution().analyzed().toString().count("explode(") == 2
