import datetime as dt
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from civicledger.functions import identity, rules, text


def values(spark, inputs, build, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


def test_amounts(spark):
    cases = {
        "$1,001 - $15,000": (1001, 15000), "Over $50,000,000": (50000000, None), "$250": (250, 250), "none": (None, None),
        "$50,000 - $15,001": (15001, 50000), "more than $5": (5, None), "$1,000,001 +": (1000001, None), None: (None, None), "": (None, None),
        "$1 to $2 and $9": (1, 2), "Overstock 12": (12, 12),
    }
    found = values(spark, cases, lambda c: F.struct(*text.parse_amount(c)))
    assert [tuple(f) for f in found] == list(cases.values())


def test_names(spark):
    cases = {
        "John J Mr McGuire": "John J McGuire", "Scott Scott Franklin": "Scott Franklin", "Hon. Ada  Lovelace": "Ada Lovelace",
        "Boutros Boutros": "Boutros Boutros", "Smith, Jr., Bob": "Smith Jr. Bob", "Scott. scott Franklin": "scott Franklin",
        "Mrs. Dr. Eve": "Eve", "Mrsa Drew": "Mrsa Drew", "Ann Annabel Lee": "Ann Annabel Lee", "": "", None: "",
    }
    assert values(spark, cases, text.normalize_name) == list(cases.values())


def test_identity_key(spark):
    cases = {"John J McGuire": "house:johnmcguire", "John J. McGuire": "house:johnmcguire", "John McGuire Jr.": "house:johnmcguirejr",
             "J McGuire": "house:jmcguire", "Dan O'Neil": "house:danoneil", "Mary Ann Q": "house:maryannq"}
    assert values(spark, cases, lambda c: identity.politician_key(c, F.lit("house"))) == list(cases.values())


def test_codes(spark):
    assert values(spark, [" House", "SENATE", "board", None], text.normalize_chamber) == ["house", "senate", None, None]
    assert values(spark, ["aapl ", "--", "n/a", "BRK.B", "a b", "", None], text.normalize_ticker) == ["AAPL", None, None, "BRK.B", None, None, None]
    assert values(spark, ["Purchase", "sale (partial)", "S", "Exchange", "gift", None], text.normalize_transaction_type) == [
        "buy", "sell_partial", "sell", "exchange", "unknown", "unknown"]


def test_assets_and_dates(spark):
    assert values(spark, ["Apple Inc. [ST] (AAPL)", "Acme P 09/08/2026 10/05/2026 $1,001 - $15,000", " - ", None, "A  B -"], text.clean_asset_name) == [
        "Apple Inc.", "Acme", None, None, "A B"]
    assert values(spark, ["2026-01-05T10:00", "2026", "2026-1-5", "2026-02-30", None, "20260105"], text.parse_date) == [
        dt.date(2026, 1, 5), None, None, None, None, dt.date(2026, 1, 5)]


def test_name_words(spark):
    cases = {"José Ñandú": "jose nandu", "Tom O’Halleran": "tom ohalleran", "J. Ærø-Smith": "j r smith", "ﬁn Łuk": "fin uk"}
    assert values(spark, cases, text.name_words) == list(cases.values())
    assert values(spark, ["bob smith jr", "bob jr", "a b c iii"], text.without_suffix) == ["bob smith", "bob jr", "a b c"]


def test_display(spark):
    df = spark.createDataFrame([(1001, 15000), (50000000, None), (None, None), (250, 250), (999999, 1500000)], "a long, b long")
    assert [r[0] for r in df.select(text.format_amount_range("a", "b")).collect()] == [
        "$1K – $15K", "Over $50M", "—", "$250", "$1M – $1.5M"]


def test_legacy_value(spark):
    assert values(spark, ["$15,001 - $50,000", "over $1,000,000 total", "?"], text.legacy_value) == [32500, 1500000, 0]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.floats(0, 100), min_size=200, max_size=400))
def test_rounding_is_exact(spark, xs):
    xs = [*xs, 2.675, 0.625, 1.005, 12.345, 0.125, 99.995]
    want = [float(Decimal(x).quantize(Decimal("0.01"), ROUND_HALF_EVEN)) for x in xs]
    assert values(spark, xs, text.round_exact, "double") == want


def test_congress(spark):
    days = ["2025-01-02", "2025-01-03", "2026-12-31", "1789-03-04", "1995-01-03"]
    assert values(spark, days, lambda c: rules.congress_of(F.to_date(c))) == [118, 119, 119, 1, 104]


def test_sic(spark):
    assert values(spark, ["0100", "3721", "0000", "37", "9999", None], rules.sic_number) == [100, 3721, None, None, 9999, None]
    assert values(spark, ["0100", "3721", "9000", "37", None], rules.sic_division) == [
        "Agriculture, Forestry, and Fishing", "Manufacturing", None, None, None]
    assert values(spark, [3812, 6000, 6500, None], rules.sic_group, "int") == ["defense", "finance", None, None]


@pytest.mark.parametrize("lo, hi, want", [
    (None, 5, (None, None)), (5, None, (5.0, "open_ended_lower_bound")), (5, 4, (None, None)), (5, 5, (5.0, "exact_figure")),
    (1001, 15000, (8000.5, "range_midpoint"))])
def test_trade_size(spark, lo, hi, want):
    df = spark.createDataFrame([(lo, hi)], "a long, b long")
    assert tuple(df.select(*rules.trade_size("a", "b")).first()) == want
