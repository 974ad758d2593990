"""Cases where earlier results were wrong or incomplete."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from civicledger.functions import text as X
from civicledger.operators import audit, context as C, dashboards as D, history as H, ingest as I, screen as S
from civicledger.sources import resolutions as R
from civicledger.sources.reviewed import unusable_pattern
from civicledger.streaming.ingest import TradeStore, catch_up, state


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(column).collect()]


def test_white_space_of_any_kind_is_cut(spark):
    assert one(spark, X.normalize_chamber("v"), "House\t", "\n senate \r\n", None, "\t") == ["house", "senate", None, None]
    assert one(spark, X.normalize_ticker("v"), "AAPL\t", "AAPL\n", "\u000bmsft ", "A\nB") == ["AAPL", "AAPL", "MSFT", None]
    assert one(spark, X.parse_date("v"), "\t2020-01-02\n") == [dt.date(2020, 1, 2)]


def test_letters_beyond_latin_one_fold(spark):
    assert one(spark, X.name_words("v"), "Ｊｏｈｎ Smith", "ﬁn Æ é ﷺ", "Ⅷ", "Łukasz Ño") == ["john smith", "fin e", "viii", "ukasz no"]


@pytest.mark.parametrize("pattern, bad", [
    ("(?:oil|gas)", False), ("(?i)oil", False), ("a{1,2}", False), ("a{2}", False), ("(?<!x)oil(?=y)", False), ("[(*]+", False), (r"\(oil\)", False), ("a*?b+?c??", False), ("((a|b)c)+", False),
    ("a{2,1}", True), ("(oil", True), ("oil)", True), (")(", True), ("*oil", True), ("a|*b", True), ("[oil", True), ("oil\\", True), ("a{x}", True), ("a**", True), ("a+++", True), ("{2}", True),
])
def test_patterns(spark, pattern, bad):
    df = spark.createDataFrame([(pattern,)], "p string")
    assert df.select(unusable_pattern(F.col("p"))).first()[0] is bad
    if not bad:
        df.select(F.col("p").rlike(pattern)).first()  # and Spark takes it


def versions(spark, *rows):
    return spark.createDataFrame(rows, "trade_id string, context_version string, mapping_version string, flagged_for_contextual_review boolean")


def test_readers_use_the_current_context_only(spark):
    from civicledger import constants as K

    rows = versions(spark, ("a", K.ENGINE_VERSION, "1", True), ("a", K.ENGINE_VERSION, "2", False), ("b", K.ENGINE_VERSION, "2", True), ("b", "other", "2", True), ("c", "other", "2", True))
    assert sorted(r["trade_id"] for r in C.current_context(rows).collect()) == ["a", "b"]
    mappings = spark.createDataFrame([("1",)], "mapping_version string")
    assert [r["trade_id"] for r in C.current_context(rows, mappings).collect()] == ["a"]
    trades = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert [r["id"] for r in S.filter_trades(trades, rows, flagged=True).collect()] == ["b"]


def test_table_hash_tells_values_apart(spark):
    df = lambda *rows: spark.createDataFrame(list(rows), "x string, y string")
    key = lambda d: tuple(I.table_fingerprint(d).first())
    assert len({key(df(("a|b", "c"))), key(df(("a", "b|c"))), key(df((None, "c"))), key(df(("<null>", "c"))), key(df(("", "c")))}) == 5
    assert key(df(("a", "b"), ("c", "d"))) == key(df(("c", "d"), ("a", "b")))


SEAT = "politician_id long, committee_code string, subcommittee_code string, temporal_precision string, congress_number int, start_date date, end_date date, verified_through date, history_complete boolean, source string"


def test_seats_without_precision_say_nothing_about_the_snapshot(spark):
    days = spark.createDataFrame([(1, dt.date(1996, 5, 1))], "politician_id long, transaction_date date")
    seats = spark.createDataFrame([(1, "A", None, "exact_date", 104, dt.date(1995, 2, 1), None, dt.date(1996, 12, 1), True, "house.resolutions"), (1, "B", None, None, 107, None, None, None, None, "x")], SEAT)
    assert {r["committee_code"]: r["history_status"] for r in H.committee_history_status(days, seats).collect()} == {"A": "verified", "B": "unknown"}


def test_breakdown_covers_all_trades(spark):
    rows = [(f"t{k:04d}", 1, "T", dt.date(2000, 1 + k % 12, 1), "buy") for k in range(501)]
    trades = spark.createDataFrame(rows, "id string, politician_id long, ticker string, transaction_date date, transaction_type string")
    months, tickers = D.politician_breakdown(trades)
    assert months.agg(F.sum("buys")).first()[0] == tickers.agg(F.sum("buys")).first()[0] == 501
    assert D.politician_breakdown(trades, newest=500)[0].agg(F.sum("buys")).first()[0] == 500


def resolution(clause, header="Committee on Ways", names="Mr. Smith", broken=False):
    xml = (f"<resolution><attestation><text>In the House of Representatives, U. S., January 5, 1995.</text></attestation><resolution-body><section><text>{clause}</text><paragraph><header>{header}</header>"
           f"<text>{names}</text></paragraph></section></resolution-body></resolution>")
    return xml.replace("</section>", "") if broken else xml


def read(spark, *documents):
    return spark.createDataFrame([(f"r{k}", "u", d) for k, d in enumerate(documents)], "label string, url string, xml string")


def test_documents_are_read_to_the_end(spark):
    long = "That the committee " + "of long words " * 60 + "members are hereby removed"
    docs = read(spark, resolution(long), resolution("the committee members be elected, nobody removed"), resolution("the committee", ), resolution("committee elected", broken=True))
    found = {r["label"]: r["verb"] for r in R.parse_resolutions(docs).collect()}
    unread = {r["label"]: r["reason"] for r in R.unread_documents(docs).collect()}
    assert found == {"r0": "removed", "r1": "elected"}
    assert unread == {"r2": "neither elects nor removes", "r3": "broken XML"}


def test_references_by_number_are_decoded(spark):
    assert one(spark, R._plain(F.col("v")), "Garc&#237;a &amp; <b>Jos&#xE9;</b>", "a &lt; b &#60; c", "&bogus;&#xZZ;") == ["García & José", "a < b < c", "&bogus;&#xZZ;"]


def test_numbers_of_signals_are_always_allowed():
    assert audit.ALWAYS_ALLOWED == (1, 2, 3, 4)


RAW = "record string"


def test_a_run_without_news_is_stamped(spark, tmp_path):
    from civicledger.plans.tables import feed_records

    folder = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    events = lambda: feed_records(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder))
    store = TradeStore(spark, tmp_path / "tables")
    first = catch_up(events(), store, tmp_path / "checkpoint", now="2024-01-01").first()
    second = catch_up(events(), store, tmp_path / "checkpoint", now="2024-01-02").first()
    assert (first["last_success_at"], second["last_success_at"]) == (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2))
    assert first["inserted"] == second["inserted"] == store.read("trades").count() and state(store).count() == 1


def test_contexts_are_replaced_by_version(spark, tmp_path):
    from civicledger import constants as K
    from civicledger.operators.context_store import ContextStore

    store = ContextStore(spark, tmp_path / "contexts")
    rows = lambda *r: spark.createDataFrame(r, "trade_id string, result_digest string, context_version string, mapping_version string")
    proof = lambda *r: spark.createDataFrame(r, "trade_id string, context_version string, mapping_version string, description string")
    v = (K.ENGINE_VERSION, "2")
    first = store.save(rows(("a", "1", *v), ("b", "1", *v)), proof(("a", *v, "x"), ("b", *v, "y")))
    assert [tuple(r) for r in first.collect()] == [("inserted", 2, 2)]
    second = store.save(rows(("a", "1", *v), ("b", "2", *v), ("c", "1", *v)), proof(("a", *v, "not written"), ("b", *v, "new"), ("b", *v, "newer")))
    assert {r["action"]: (r["rows"], r["evidence"]) for r in second.collect()} == {"unchanged": (1, 1), "updated": (1, 2), "inserted": (1, 0)}
    store.save(rows(("a", "9", K.ENGINE_VERSION, "1")), proof())
    newest = spark.createDataFrame([("1",), ("2",)], "mapping_version string")
    assert sorted((r["trade_id"], r["result_digest"]) for r in store.load("context", newest).collect()) == [("a", "1"), ("b", "2"), ("c", "1")]
    assert sorted(r["description"] for r in store.load("evidence", newest).collect()) == ["new", "newer", "x"]
    assert store.load("context", spark.createDataFrame([("3",)], "mapping_version string")) is None


@pytest.mark.parametrize("usual", [0, 30, 10**6])
def test_size_history_by_digits_equals_plain_counting(spark, monkeypatch, usual):
    import random
    import statistics

    from civicledger.operators import signals as G

    monkeypatch.setattr(G, "USUAL_CELLS", usual)
    rng = random.Random(7)
    rows = []
    for person, n in ((1, 400), (2, 12), (3, 1), (4, 40)):
        for k in range(n):
            low = rng.choice([None, 0, 1, 1001, rng.randrange(10**7)])
            rows.append((f"{person}-{k}", person, dt.date(2000, 1, 1) + dt.timedelta(rng.randrange(60)), None, low, None if low is None else rng.choice([low, low + 1, low + 14000])))
    rows.append(("5-0", 5, dt.date(2000, 1, 9), None, None, None))
    trades = spark.createDataFrame(rows, "id string, politician_id long, transaction_date date, disclosure_date date, amount_min long, amount_max long")
    sizes = {r[0]: r[1] for r in trades.select("id", G.trade_size("amount_min", "amount_max")[0]).collect()}
    got = {(r["politician_id"], r["transaction_date"], r["value"]): r for r in G.size_history(trades, "2001-01-01").collect()}
    want = {}
    for name, person, day, *_ in rows:
        value = G.NO_VALUE if sizes[name] is None else sizes[name]
        earlier = [sizes[o] for o, p, d, *_ in rows if p == person and d < day and sizes[o] is not None]
        want[person, day, value] = (len(earlier), statistics.median(earlier) if earlier else None, sum(v < value for v in earlier), sum(v == value for v in earlier))
    assert got.keys() == want.keys()
    for key, r in got.items():
        assert (r["prior_n"], r["prior_median"], r["less"], r["same"]) == want[key]


def test_one_politician_with_very_many_sizes_spreads_over_tasks(spark):
    from civicledger.operators import signals as G
    from pyspark.sql.functions import spark_partition_id

    n = 20_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("politician_id"), F.expr("date_add(DATE '2000-01-01', CAST(id % 200 AS int))").alias("transaction_date"),
                                 F.lit(None).cast("date").alias("disclosure_date"), (F.col("id") * 7919 % n).alias("amount_min"), (F.col("id") * 7919 % n).alias("amount_max"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        history = G.size_history(rows, "2010-01-01")
        per_task = [r["count"] for r in history.groupBy(spark_partition_id()).count().collect()]
        last = history.filter("transaction_date = DATE '2000-07-18'").agg(F.min("prior_n"), F.max("prior_n"), F.min("prior_median")).first()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(per_task) == n and max(per_task) < n / 2
    assert last[0] == last[1] == 19_900 and abs(last[2] - n / 2) < n / 100
