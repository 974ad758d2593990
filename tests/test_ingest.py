import datetime as dt
import hashlib

from pyspark.sql import functions as F

from civicledger.operators import ingest as I
from civicledger.operators.ordered import numbered
from civicledger.sources.disclosures import normalize_disclosures

RAW = "seq long, member string, chamber string, trade_type string, amount string, tx_date string, disclosed string, asset string, ticker string, link string"
BASE = (1, "Ada Lovelace", "House", "Purchase", "$1,001 - $15,000", "2026-01-05", "2026-01-20", "Apple Inc.", "AAPL", "u")


def feed(spark, *changes):
    names = [f.split()[0] for f in RAW.split(", ")]
    rows = [tuple({**dict(zip(names, BASE)), "seq": i, **c}[n] for n in names) for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, RAW)


def test_identity_and_fingerprint(spark):
    trades, rejects = normalize_disclosures(feed(spark, {}, {}, {"member": "Ada K. Lovelace"}, {"ticker": "--"}, {"chamber": "?"}, {"amount": "none", "link": ""}))
    rows = I.dedupe_trades(trades).orderBy("seq").collect()
    assert rejects.count() == 1 and rejects.first().reject_reason == "no chamber"
    assert len({r.fingerprint for r in rows}) == 5
    assert sorted(r.occurrence for r in rows if r.ticker and r.amount_min) == [0, 1, 2]
    want = hashlib.sha256(b"house:adalovelace|AAPL||buy|2026-01-05|2026-01-20|None|None|0").hexdigest()
    assert rows[-1].fingerprint == want and rows[-1].source_url is None
    unlisted = next(r for r in rows if r.ticker is None)
    assert unlisted.fingerprint == hashlib.sha256(b"house:adalovelace||apple inc.|buy|2026-01-05|2026-01-20|1001|15000|0").hexdigest()


def test_second_run_adds_nothing(spark):
    trades, _ = normalize_disclosures(feed(spark, {}, {}, {"ticker": "MSFT"}))
    stored = I.dedupe_trades(trades)
    assert I.dedupe_trades(trades, stored).count() == 0
    more, _ = normalize_disclosures(feed(spark, {}, {}, {}, {"ticker": "MSFT"}))
    assert [(r.ticker, r.occurrence) for r in I.dedupe_trades(more, stored).collect()] == [("AAPL", 2)]


def test_a_hot_line_is_numbered_densely_over_many_tasks(spark):
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    rows = numbered(df, ["k"], ["id"], ways=16)
    hot = sorted(r.number for r in rows.filter("k = 'hot'").collect())
    assert hot == list(range(2000)) and rows.filter("k <> 'hot' AND number <> 0").count() == 0


def test_dimensions_keep_what_was_known_first(spark, table):
    schema = "seq long, politician_name string, chamber string, party string, state string, ticker string, asset_name string"
    first = table(schema, (2, "Ada Lovelace", "house", None, "NY", "A", None), (1, "Ada K Lovelace", "house", "D", None, "A", "Apple"))
    people = I.upsert_politicians(first)
    assert [tuple(r) for r in people.collect()] == [("house:adalovelace", "Ada K Lovelace", "house", "D", "NY")]
    later = table(schema, (9, "Ada Lovelace", "house", "R", "TX", "A", "Other"), (8, "Bob", "senate", None, None, None, None))
    merged = {r.canonical_key: tuple(r) for r in I.upsert_politicians(later, people).collect()}
    assert merged["house:adalovelace"][1:] == ("Ada K Lovelace", "house", "D", "NY") and "senate:bob" in merged
    assert [tuple(r) for r in I.upsert_securities(later, I.upsert_securities(first)).collect()] == [("A", "Apple")]


def test_variants_merge_into_the_busiest(spark, table):
    people = table("id long, name string, chamber string", (1, "John J Mr McGuire", "house"), (2, "John McGuire", "house"),
                   (3, "Dan Ray", "house"), (4, "Daniel Ray", "house"))
    trades = spark.createDataFrame(
        [(i, p, "x", "house", "T", None, "buy", dt.date(2026, 1, 1), None, 1, 2, "old") for i, p in enumerate([1, 2, 2, 3])],
        "id long, politician_id long, politician_name string, chamber string, ticker string, asset_name string, transaction_type string, "
        "transaction_date date, disclosure_date date, amount_min long, amount_max long, fingerprint string")
    kept, moved = I.merge_variants(people, trades)
    assert sorted((r.id, r.name) for r in kept.collect()) == [(2, "John McGuire"), (3, "Dan Ray"), (4, "Daniel Ray")]
    rows = moved.collect()
    assert sorted(r.politician_id for r in rows) == [2, 2, 2, 3] and len({r.fingerprint for r in rows}) == 4
    assert sorted(r.occurrence for r in rows if r.politician_id == 2) == [0, 1, 2]


def test_table_fingerprint_sees_changes_and_duplicates(spark):
    df = spark.range(50).withColumn("v", F.col("id") * 2)
    same = I.table_fingerprint(df.repartition(7))
    assert I.compare_fingerprints(I.table_fingerprint(df), same).first().identical
    for other in (df.union(df.limit(1)), df.withColumn("v", F.when(F.col("id") == 3, 0).otherwise(F.col("v")))):
        assert not I.compare_fingerprints(I.table_fingerprint(df), I.table_fingerprint(other)).first().identical
