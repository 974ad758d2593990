"""Domain tables bound to the order, customer, part and event tables of a data folder.

Every row of the source tables takes part. Attributes the sources lack are computed from their keys, in arithmetic any
SQL engine repeats exactly: integers, dates and text only.
"""

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import politician_key
from ..functions.rules import congress_of, sic_division
from ..session import fit_shuffles, stored

TODAY = "2001-06-30"
NOW = "2001-06-30 12:00:00"
BENCHMARK = "ALL"
CONGRESS = 107

FIRST_NAMES = ["Ada", "Ben", "Cora", "Dan", "Eve", "Finn", "Gail", "Hugo", "Iris", "Jack", "Kate", "Liam"]
MIDDLES = ["", "Q.", "Marie", "J"]
ROSTER_MIDDLES = ["Quentin", None, "Marie", "J.", None, "Q"]
COMMITTEES = ["MACHINERY", "BUILDING", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD"]

# (id, committee, subcommittee, start, end, pattern, level, status, basis, version, note)
MAPPINGS = [
    (1, "MACHINERY", None, 1000, 1500, None, "direct", "reviewed", "rule_x_text", "2001.0", None),
    (2, "BUILDING", None, 1000, 4500, None, "direct", "reviewed", "rule_x_text", "2001.0", None),
    (3, "MACHINERY", None, 1100, 1999, None, "direct", "reviewed", "rule_x_text", "2001.1", None),
    (4, "MACHINERY", None, 2000, 2999, None, "related", "reviewed", "committee_published_text", "2001.1", None),
    (5, "MACHINERY", "MACHINERY1", 1100, 2600, "INDUSTRY 1", "direct", "reviewed", "subcommittee_name", "2001.1", "Review history: narrowed"),
    (6, "BUILDING", None, 1500, 2500, None, "direct", "needs_review", "committee_name", "2001.1", None),
    (7, "BUILDING", "BUILDING0", 2000, 3500, None, "direct", "reviewed", "subcommittee_name", "2001.1", None),
    (8, "BUILDING", None, 3000, 4500, "industry 2[0-9]", "related", "reviewed", "rule_x_text", "2001.1", None),
    (9, "AUTOMOBILE", None, 3000, 4500, None, "direct", "reviewed", "rule_x_text", "2001.1", None),
    (10, "AUTOMOBILE", "AUTOMOBILE2", 1100, 1300, None, "related", "needs_review", "subcommittee_name", "2001.1", None),
    (11, "AUTOMOBILE", None, 2500, 2550, "INDUSTRY", "direct", "reviewed", "committee_name", "2001.1", "Review history: regex added"),
    (12, "FURNITURE", None, None, None, None, "none", "reviewed", "rule_x_text", "2001.1", None),
]
MAPPING_SCHEMA = (
    "mapping_id long, committee_code string, subcommittee_code string, sic_start int, sic_end int, industry_pattern string, "
    "relevance_level string, review_status string, jurisdiction_basis string, mapping_version string, review_note string"
)

# explanations of trades, as SQL that any engine reads; n is the order's number, days the delay of the filing
SUMMARIES = [
    "'It does not establish insider knowledge. The trade is not flagged here.'",
    "'The records show an insider at work.'",
    "'The value was $987,654,321 in total.'",
    "'The Foreign Affairs Committee oversees this.'",
    "'Nothing stands out; no breach is known.'",
    "'This trade was flagged by the engine.'",
    "'It was filed ' || cast(days as string) || ' days later, and 45 are usual.'",
    "'It was filed ' || cast(days + 1 as string) || ' days later.'",
    "'The range begins at $' || cast(amount_min as string) || ' or ' || cast(cast(floor(amount_min / 1000) as bigint) as string) || 'k.'",
    "'Members of the Committee on Machinery and Works know the field.'",
    "'It falls under building and works! Somebody benefited from it; nobody was flagged.'",
    "'It was an improper trade in ' || cast(year(transaction_date) as string) || '. The Subcommittee on Machinery Standards never met.'",
]
SUMMARY = "coalesce(CASE n % 12 " + " ".join(f"WHEN {k} THEN {text}" for k, text in enumerate(SUMMARIES)) + " END, 'Nothing is known.')"
HEADLINE = "CASE WHEN n % 7 = 4 THEN '' ELSE 'A disclosed trade of ' || coalesce(ticker, 'an unlisted asset') END"
LIMITATIONS = "CASE WHEN n % 11 = 3 THEN repeat('Public data only. ', 40) ELSE 'Public data only.' END"
LAST_SIGNAL = "CASE n % 13 WHEN 4 THEN 'a_hunch' WHEN 5 THEN 'committee_relevance' ELSE 'excess_return_signal' END"
FIRST_EXPLANATION = "CASE WHEN n % 13 = 6 THEN '' ELSE 'See the stored value.' END"


def pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def last_name(key):
    third = ((key - key % 3) / 3).cast("long").cast("string")
    return F.concat(F.lit("Mc"), F.translate(third, "0123456789", "abcdefghij"))


def politician_name(key):
    tail = F.when(key % 10 == 9, "Jr.").otherwise("")
    return F.array_join(F.filter(F.array(pick(FIRST_NAMES, key), pick(MIDDLES, key), last_name(key), tail), lambda w: w != ""), " ")


def chamber(key):
    return F.when(key % 5 < 4, "house").otherwise("senate")


def letter(n):
    return F.char((F.lit(65) + n).cast("int"))


def official_id(key):
    return F.concat(letter(key % 26), F.lpad((key % 1000000).cast("string"), 6, "0"))


def plus_days(date, days):
    return F.date_add(date, days.cast("int"))


def _dated(lines):
    return lines.withColumns({"day": F.to_date("l_shipdate"), "cents": F.round(F.col("l_extendedprice") * 100).cast("long")})


@dataclass
class Tables:
    """Lazily built domain tables of one data folder."""

    spark: SparkSession
    folder: str

    def source(self, name) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        fit_shuffles(self.spark, path)
        return self.spark.read.parquet(path)

    @cached_property
    def lines(self) -> DataFrame:
        return _dated(self.source("lineitem"))

    @cached_property
    def trades(self) -> DataFrame:
        brands = self.source("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size", "p_name")
        people = self.source("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("politician_id"))
        # what follows from a line's own columns is added behind the joins
        joined = _dated(self.source("lineitem").join(people, "l_orderkey").join(brands, "l_partkey"))
        key, day = F.col("politician_id"), F.col("day")
        identity = F.concat_ws(
            "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long"), "cents",
            F.date_format("day", "yyyyMMdd"))
        flag, price = F.col("l_returnflag"), F.col("l_extendedprice")
        kind = F.when(flag == "A", "buy").when(flag == "R", "sell").when(F.col("l_linestatus") == "F", "sell_partial").otherwise("exchange")
        disclosed = plus_days(day, (F.col("l_partkey") * 7 + F.col("l_suppkey")) % 100 - 5)
        whole = F.floor(price).cast("long")
        exact, swapped = F.col("l_linenumber") == 7, F.col("l_quantity") == 50
        lowest = (
            F.when(price < 1001, F.lit(None)).when(exact, whole).when(swapped, 99999).when(price <= 15000, 1001)
            .when(price <= 50000, 15001).when(price <= 100000, 50001).otherwise(100000)
        ).cast("long")
        highest = (
            F.when(price < 1001, F.lit(None)).when(exact, whole).when(swapped, 15000).when(price <= 15000, 15000)
            .when(price <= 50000, 50000).when(price <= 100000, 100000)
        ).cast("long")
        return joined.select(
            identity.alias("id"), F.concat(F.lit("src-"), "l_linestatus").alias("source"), "politician_id",
            politician_name(key).alias("politician_name"), chamber(key).alias("chamber"),
            F.when(key % 3 == 0, "D").when(key % 3 == 1, "R").alias("party"),
            F.concat(F.lit("S"), letter(key % 25)).alias("state"),
            F.when(F.col("p_size") != 1, F.col("p_brand")).alias("ticker"), F.col("p_name").alias("asset_name"),
            kind.alias("transaction_type"), day.alias("transaction_date"),
            F.when(F.col("l_quantity") != 1, disclosed).alias("disclosure_date"),
            lowest.alias("amount_min"), highest.alias("amount_max"),
        )

    def _daily(self, rows, keys):
        paid = F.call_function("div", F.sum("cents"), F.sum(F.col("l_quantity").cast("long")))
        close = F.col("paid") / 100
        return (
            rows.filter(F.weekday("day") < 5).groupBy(*keys, F.col("day").alias("date"))
            .agg(paid.alias("paid"), F.sum(F.col("l_quantity").cast("long")).alias("volume"))
            .select(*keys, "date", close.alias("open"), close.alias("high"), close.alias("low"), close.alias("close"),
                    F.when(F.dayofmonth("date") != 13, close).alias("adj_close"), "volume", F.lit("lines").alias("provider"))
        )

    @cached_property
    def bars(self) -> DataFrame:
        brands = self.source("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
        return stored(self._daily(self.lines.join(brands, "l_partkey"), ["ticker"]), "bars")  # a row per ticker and day, read many times

    @cached_property
    def benchmark(self) -> DataFrame:
        return stored(self._daily(self.lines, []).select(F.lit(BENCHMARK).alias("ticker"), "*"), "benchmark")

    @cached_property
    def politicians(self) -> DataFrame:
        key = F.col("c_custkey")
        status = F.when(key % 8 == 0, "matched").when(key % 8 == 1, "unmatched").when(key % 8 == 2, "review")
        now = F.lit(NOW).cast("timestamp_ntz")
        base = self.source("customer").select(
            key.alias("id"), politician_name(key).alias("name"), chamber(key).alias("chamber"),
            F.when(F.col("c_acctbal") < 0, F.lit(None)).when(key % 3 == 0, "D").otherwise("R").alias("party"),
            F.when(key % 19 != 0, F.concat(F.lit("N"), letter(F.col("c_nationkey")))).alias("state"),
            F.when(key % 5 < 4, (key % 10 + 1).cast("string")).alias("district"),
            status.alias("enrichment_status"),
            F.when(key % 8 == 0, official_id(F.when(key % 64 == 0, key + 1).otherwise(key))).alias("bioguide_id"),
            F.when(key % 8 == 0, now - F.make_dt_interval((key % 60).cast("int"))).alias("enriched_at"),
            F.when(key % 8 < 3, now - F.make_dt_interval((key % 14).cast("int"))).alias("enrichment_checked_at"),
            F.when(key % 8 == 0, "exact_name+chamber").alias("enrichment_method"),
        )
        return base.withColumn("canonical_key", politician_key("name", "chamber"))

    @cached_property
    def roster(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.source("customer").select(
            official_id(key).alias("bioguide_id"), pick(FIRST_NAMES, key).alias("first_name"),
            pick(ROSTER_MIDDLES, key).alias("middle_name"),
            F.when(key % 9 == 4, F.concat(F.lit("O'"), last_name(key))).otherwise(last_name(key)).alias("last_name"),
            F.when(key % 13 == 5, "senate").otherwise(chamber(key)).alias("chamber"),
            F.when(key % 17 != 0, F.concat(F.lit("N"), letter(F.col("c_nationkey")))).alias("state"),
            F.when(key % 5 < 4, (key % 10 + 1).cast("string")).alias("district"),
        )

    @cached_property
    def securities(self) -> DataFrame:
        no = F.col("no")
        sic = F.when(no % 8 != 0, F.lpad((F.lit(1000) + no * 137).cast("string"), 4, "0"))
        covered = no % 5 > 1
        start, end = F.lit("1995-01-02").cast("date"), F.lit(TODAY).cast("date")
        now = F.lit(NOW).cast("timestamp_ntz")
        listed = (
            self.source("part").select(F.col("p_brand").alias("ticker")).distinct()
            .withColumn("no", F.substring("ticker", 7, 10).cast("int")).withColumn("sic_code", sic)
            .select(
                "ticker", F.concat(F.lit("Company "), "no").alias("name"), F.concat(F.lit("Company "), "no", F.lit(" Inc")).alias("company_name"),
                "sic_code", F.when(F.col("sic_code").isNotNull(), F.concat(F.lit("Industry "), "no")).alias("industry"),
                sic_division("sic_code").alias("sector"),
                F.when(no % 5 == 0, "unavailable").when(covered, "ok").alias("price_status"),
                F.when(no % 5 != 1, now - F.make_dt_interval(no % 10)).alias("price_checked_at"),
                F.when(covered, plus_days(start, no * 11)).alias("price_from"),
                F.when(covered, plus_days(end, -(no % 3))).alias("price_to"),
                F.when(no % 4 == 0, "ok").when(no % 4 == 1, "unresolved").alias("profile_status"),
                F.when(no % 4 < 2, now - F.make_dt_interval(no * 6)).alias("profile_checked_at"),
                F.lit(None).cast("string").alias("cik_code"), F.lit(None).cast("string").alias("exchange"),
            )
        )
        return stored(listed, "securities")

    @cached_property
    def mappings(self) -> DataFrame:
        """The reviewed mapping file: a closed, hand-written list."""
        rows = self.spark.createDataFrame(MAPPINGS, MAPPING_SCHEMA)
        return rows.withColumns({
            "chamber": F.lit("house"),
            "committee_name": F.concat(F.lit("Committee on "), F.initcap("committee_code"), F.lit(" and Works")),
            "subcommittee_name": F.when(F.col("subcommittee_code").isNotNull(), F.concat(
                F.lit("Subcommittee on "), F.initcap("committee_code"), F.lit(" Standards"))),
            "rationale": F.concat(F.lit("Jurisdiction row "), F.col("mapping_id").cast("string"), F.lit(".")),
            "jurisdiction_text": F.lit(None).cast("string"),
            "source_citation": F.lit("Rule X"), "source_url": F.lit("https://example.gov/rules"),
            "reviewed_at": F.when(F.col("review_status") == "reviewed", F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")),
            "reviewed_by": F.lit(None).cast("string"),
        })

    @cached_property
    def part_ranges(self) -> DataFrame:
        """A draft of mappings, one range of codes per part: as many as the table of parts has."""
        key = F.col("p_partkey")
        start = (F.lit(1000) + (key * 37 + F.col("p_size") * 131) % 797 * 10).cast("int")
        return self.source("part").select(
            key.alias("mapping_id"), pick(COMMITTEES, key).alias("committee_code"), F.when(key % 4 == 0, F.concat(F.lit("S"), (key % 3).cast("string"))).alias("subcommittee_code"),
            start.alias("sic_start"), (start + F.col("p_size") % 12).cast("int").alias("sic_end"), F.when(key % 5 == 0, "none").when(key % 2 == 0, "direct").otherwise("related").alias("relevance_level"),
            F.lit("reviewed").alias("review_status"), F.lit("2001-01-01 00:00:00").cast("timestamp_ntz").alias("reviewed_at"))

    @cached_property
    def seats(self) -> DataFrame:
        key, segment, nation = F.col("c_custkey"), F.col("c_mktsegment"), F.col("c_nationkey")
        start = plus_days(F.lit("1995-01-03").cast("date"), key * 13 % 1500)
        none_s, none_d, none_b = F.lit(None).cast("string"), F.lit(None).cast("date"), F.lit(None).cast("boolean")
        dated_code = F.when(key % 4 == 0, segment).otherwise(pick(COMMITTEES, key))

        def seat(code, sub, precision, congress, begin, end, through, complete):
            return F.struct(
                code.alias("committee_code"), sub.alias("subcommittee_code"), F.lit(precision).alias("temporal_precision"),
                congress.cast("int").alias("congress_number"), begin.alias("start_date"), end.alias("end_date"),
                through.alias("verified_through"), complete.alias("history_complete"))

        today = F.lit(TODAY).cast("date")
        end = F.when(key % 3 == 0, F.date_add(start, 900))
        held = F.array_compact(F.array(
            seat(segment, none_s, "current_snapshot", F.lit(CONGRESS), none_d, none_d, today, none_b),
            F.when(nation % 2 == 0, seat(segment, F.concat(segment, (nation % 3).cast("string")), "current_snapshot",
                                         F.lit(CONGRESS), none_d, none_d, today, none_b)),
            F.when(key % 2 == 0, seat(dated_code, none_s, "exact_date", congress_of(start), start, end,
                                      F.when(key % 3 != 0, F.date_add(start, 400)), key % 5 != 0)),
            F.when(key % 11 == 0, seat(segment, none_s, "congress", F.lit(105), none_d, none_d, none_d, none_b)),
        ))
        seated = F.when(F.col("c_acctbal") >= 0, held)
        return self.source("customer").select(key.alias("politician_id"), F.explode(seated).alias("s")).select(
            "politician_id", "s.*", F.initcap("s.committee_code").alias("committee_name"),
            F.when(F.col("s.subcommittee_code").isNotNull(), F.initcap("s.subcommittee_code")).alias("subcommittee_name"),
            F.when(F.col("politician_id") % 7 == 0, "Chair").otherwise("Member").alias("role"),
            F.when(F.col("s.temporal_precision") == "current_snapshot", "house.clerk").otherwise("house.resolutions").alias("source"),
        )

    @cached_property
    def events(self) -> DataFrame:
        """Committee elections and removals, one per order."""
        return self.source("orders").select(
            official_id(F.col("o_custkey")).alias("bioguide_id"), F.substring("o_orderpriority", 1, 1).alias("committee_code"),
            F.to_date("o_orderdate").alias("date"), F.when(F.col("o_orderstatus") == "O", "removed").otherwise("elected").alias("verb"),
            F.concat(F.lit("https://example.gov/"), F.col("o_orderkey").cast("string")).alias("url"), F.col("o_orderkey").alias("seq"))

    @cached_property
    def feed(self) -> DataFrame:
        """Raw disclosure records, one per event and a second copy of some: every event type in every text shape."""
        return feed_records(self.source("events"))


def feed_records(events: DataFrame) -> DataFrame:
    key, user, value = F.col("event_id"), F.col("user_id"), F.col("value")
    low = F.floor(value * 100).cast("long")
    dollars = F.concat(F.lit("$"), F.format_number(low, 0))
    upper = F.concat(F.lit("$"), F.format_number(low * 3, 0))
    shape = key % 6
    amount = (
        F.when(shape == 0, F.concat(dollars, F.lit(" - "), upper)).when(shape == 1, F.concat(F.lit("Over "), dollars))
        .when(shape == 2, dollars).when(shape == 3, F.concat(upper, F.lit(" - "), dollars))
        .when(shape == 4, "undisclosed")
    )
    who = F.concat(pick(["Mr. ", "", "Hon. ", "Rep ", ""], key), pick(FIRST_NAMES, user), F.lit(" "),
                   pick(["", "Q ", "Marie "], user), F.lit("Mc"), F.translate(user.cast("string"), "0123456789", "abcdefghij"))
    name = F.when(key % 97 == 0, "  ").when(key % 10 == 3, F.concat(pick(FIRST_NAMES, user), F.lit(" "), who)).otherwise(who)
    day = F.to_date("ts")
    record = F.struct(
        name.alias("member"),
        F.when(key % 53 == 0, "unknown").when(user % 5 < 4, pick(["House", " house ", "HOUSE"], key)).otherwise("Senate").alias("chamber"),
        F.when(F.col("event_type") == "purchase", "Purchase").when(F.col("event_type") == "click", "Sale (Partial)")
        .when(F.col("event_type") == "view", "S").when(F.col("event_type") == "signup", "Exchange").otherwise("error").alias("trade_type"),
        amount.alias("amount"),
        F.when(key % 89 == 0, "2024-1-5").otherwise(F.concat(day.cast("string"), F.lit("T00:00:00"))).alias("tx_date"),
        F.when(key % 7 == 0, "").otherwise(F.date_add(day, (key % 60).cast("int")).cast("string")).alias("disclosed"),
        F.concat(F.lit(" Acme  Works "), (user % 9).cast("string"), pick([" [ST]", " (ACM)", " - ", " P 01/02/2024 02/03/2024 $1,001 - $15,000", ""], key)).alias("asset"),
        F.when(key % 4 == 0, "--").when(key % 4 == 1, F.concat(F.lit(" t"), (user % 30).cast("string"))).when(key % 4 == 2, "brk.b")
        .otherwise("not a ticker").alias("ticker"),
        F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("https://example.gov/d/"), key.cast("string"))).alias("link"),
    )
    copies = F.when(key % 10 == 0, F.sequence(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return events.select(F.explode(copies).alias("copy"), key.alias("event_id"), record.alias("r")).select(
        (F.col("event_id") * 2 + F.col("copy")).alias("seq"), "r.*")
