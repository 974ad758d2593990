"""Official rosters: member records, the clerk's snapshot, registrant lists."""

from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.rules import is_true
from ..functions.text import empty_to_null
from ..schemas import CLERK_ROSTER, MEMBER_PAGE, REGISTRANT, REGISTRANT_LIST, TERM


def _lookup(table):
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])


def _is_suffix(word):
    return F.regexp_replace(F.lower(word), r"\.+$", "").isin(K.NAME_SUFFIXES)


def read_members(spark: SparkSession, path) -> DataFrame:
    pages = spark.read.schema(MEMBER_PAGE).option("multiLine", True).json(path)
    return normalize_members(pages.select(F.explode("members").alias("m")).select("m.*"))


def normalize_members(raw: DataFrame) -> DataFrame:
    """Usable roster entries from member records; the chamber, state and district come from the latest term."""
    parts = F.filter(F.transform(F.split(F.coalesce("name", F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")
    given = F.filter(F.split(F.coalesce(F.get("_parts", F.lit(1)), F.lit("")), r"\s+"), lambda w: w != "")
    after = F.get("_parts", F.lit(2))
    tail = F.try_element_at("_given", F.lit(-1))
    has_tail = is_true(_is_suffix(tail))
    words = F.when(has_tail, F.slice("_given", 1, F.size("_given") - 1)).otherwise(F.col("_given"))
    terms = F.coalesce(
        F.from_json("terms", f"struct<item:array<{TERM}>>")["item"], F.from_json("terms", f"array<{TERM}>"))
    by_year = F.array_sort(
        F.transform("_terms", lambda t, i: F.struct(F.coalesce(t["startYear"], F.lit(0)).alias("y"), i.alias("i"), t.alias("t"))))
    party_by_year = F.array_sort(F.transform(
        "partyHistory", lambda p, i: F.struct(F.coalesce(p["startYear"], F.lit(0)).alias("y"), i.alias("i"), p["partyName"].alias("n"))))
    out = (
        raw.withColumn("_parts", parts).withColumn("_given", given).withColumn("_words", words)
        .withColumn("_terms", terms).withColumn("_latest", F.try_element_at(by_year, F.lit(-1))["t"])
    )
    first, last = F.coalesce(F.get("_words", F.lit(0)), F.lit("")), F.coalesce(F.get("_parts", F.lit(0)), F.lit(""))
    whole = (first != "") & (last != "")
    spelled_out = empty_to_null(F.array_join(F.slice("_words", 2, F.greatest(F.size("_words"), F.lit(1))), " "))
    term_chamber = F.lower(F.coalesce("_latest.chamber", F.lit("")))
    chamber = F.when(term_chamber.contains("senate"), "senate").when(term_chamber.contains("house"), "house")
    state = F.trim(F.coalesce(empty_to_null("state"), "_latest.stateName", F.lit("")))
    district = F.coalesce("district", "_latest.district")
    party = F.coalesce("partyName", F.try_element_at(party_by_year, F.lit(-1))["n"])
    out = out.select(
        F.trim(F.coalesce("bioguideId", F.lit(""))).alias("bioguide_id"),
        F.when(whole, first).otherwise(F.coalesce(empty_to_null("firstName"), first)).alias("first_name"),
        F.when(whole, spelled_out).otherwise(F.coalesce(empty_to_null("middleName"), spelled_out)).alias("middle_name"),
        F.when(whole, last).otherwise(F.coalesce(empty_to_null("lastName"), last)).alias("last_name"),
        F.when(has_tail, tail).when(is_true(_is_suffix(after)), after).alias("suffix"),
        chamber.alias("chamber"),
        F.coalesce(F.try_element_at(_lookup(K.PARTIES), F.lower(F.trim(party))), empty_to_null(party)).alias("party"),
        F.when(F.length(state) == 2, F.upper(state)).otherwise(
            F.try_element_at(_lookup(K.STATE_CODES), F.lower(state))).alias("state"),
        F.when(chamber == "house", F.when(district == "0", "At Large").otherwise(district)).alias("district"),
        F.when(F.col("_latest").isNotNull(), F.col("_latest.endYear").isNull()).alias("active"),
        F.col("_latest.startYear").alias("term_start_year"), F.col("_latest.endYear").alias("term_end_year"),
    )
    return out.filter("bioguide_id <> '' AND first_name <> '' AND last_name <> '' AND chamber IS NOT NULL").withColumns({
        "full_name": F.concat_ws(" ", "first_name", "middle_name", "last_name", "suffix"),
        "official_url": member_url("bioguide_id", "first_name", "last_name"),
    })


def member_url(bioguide_id, first, last):
    slug = F.btrim(F.regexp_replace(F.lower(F.concat_ws(" ", first, last)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.format_string(K.MEMBER_URL, slug, F.col(bioguide_id))


def read_clerk_roster(spark: SparkSession, path) -> DataFrame:
    """The clerk's snapshot documents; one row per file, a file being bounded by the size of the House."""
    return spark.read.format("xml").option("rowTag", "MemberData").schema(CLERK_ROSTER).load(path)


def _meta():
    published = F.try_to_date(F.col("`_publish-date`"), "MMMM d, yyyy")
    return published.alias("snapshot_date"), F.col("`title-info`.`congress-num`").try_cast("int").alias("snapshot_congress")


def clerk_members(roster: DataFrame) -> DataFrame:
    """Sitting members, and departed ones known only from a vacancy (no official id), for reading resolutions."""
    rows = roster.select(F.explode("members.member").alias("m"))
    info = rows.select("m.`member-info`.*").filter("bioguideID <> ''").select(
        F.col("bioguideID").alias("bioguide_id"), F.col("firstname").alias("first_name"),
        F.col("middlename").alias("middle_name"), F.col("lastname").alias("last_name"), "suffix",
        F.coalesce("`official-name`", F.concat_ws(" ", "firstname", "middlename", "lastname", "suffix")).alias("official_name"),
        F.col("`formal-name`").alias("formal_name"), F.lit("house").alias("chamber"), "party",
        F.col("state.`_postal-code`").alias("state"), F.col("state.`state-fullname`").alias("state_name"), "district",
        F.try_to_date(F.col("`sworn-date`._date"), "yyyyMMdd").alias("sworn"),
        F.coalesce(F.col("`prior-congress`").try_cast("int"), F.lit(0)).alias("prior_congress"),
    )
    departed = rows.select("m.`predecessor-info`.*", F.col("m.`member-info`.state.`state-fullname`").alias("state_name")).filter(
        "`pred-lastname` <> ''").select(
        F.col("`pred-firstname`").alias("first_name"), F.col("`pred-lastname`").alias("last_name"),
        F.col("`pred-official-name`").alias("official_name"), F.lit("house").alias("chamber"), "state_name")
    return info.unionByName(departed, allowMissingColumns=True)


def clerk_committees(roster: DataFrame) -> DataFrame:
    return (
        roster.select(F.explode("committees.committee").alias("c"))
        .select(F.col("c._comcode").alias("committee_code"), F.col("c.`committee-fullname`").alias("committee_name"),
                F.col("c.subcommittee").alias("subs"))
        .filter("committee_code <> '' AND committee_name <> ''")
    )


def clerk_seats(roster: DataFrame, source="house.clerk") -> DataFrame:
    """Today's seats on committees and subcommittees. The snapshot has no seat dates, so none are given."""
    committees = clerk_committees(roster)
    subs = committees.select("committee_code", "committee_name", F.explode("subs").alias("s")).select(
        "committee_code", "committee_name", F.col("s._subcomcode").alias("subcommittee_code"),
        F.col("s.`subcommittee-fullname`").alias("subcommittee_name"))
    members = roster.select(*_meta(), F.explode("members.member").alias("m")).select(
        "snapshot_date", "snapshot_congress", F.col("m.`member-info`.bioguideID").alias("bioguide_id"),
        F.col("m.`committee-assignments`").alias("a")).filter("bioguide_id <> ''")

    def seats(entries, code, names, keys):
        rows = members.select("bioguide_id", "snapshot_date", "snapshot_congress", F.explode(entries).alias("e"))
        rows = rows.withColumn(keys, F.col(f"e.{code}")).withColumn("role", F.coalesce("e._leadership", F.lit("Member")))
        return rows.drop("e").join(names, keys)

    full = seats("a.committee", "_comcode", committees.drop("subs"), "committee_code")
    under = seats("a.subcommittee", "_subcomcode", subs, "subcommittee_code")
    return full.unionByName(under, allowMissingColumns=True).select(
        "bioguide_id", "committee_code", "committee_name", "subcommittee_code", "subcommittee_name", "role",
        F.lit("house").alias("chamber"), F.lit(source).alias("source"),
        F.lit(K.PRECISION_SNAPSHOT).alias("temporal_precision"),
        F.col("snapshot_congress").alias("congress_number"), F.col("snapshot_date").alias("verified_through"))


def read_registrants(spark: SparkSession, path) -> DataFrame:
    """The registrant list: a header naming the fields and rows of values in that order."""
    doc = spark.read.schema(REGISTRANT_LIST).option("multiLine", True).json(path)
    rows = doc.select("fields", F.posexplode("data").alias("position", "row"))
    pairs = rows.filter(F.size("row") <= F.size("fields")).select(
        "position", F.map_from_entries(F.arrays_zip(F.slice("fields", 1, F.size("row")), "row")).alias("v"))
    return pairs.select("position", *[F.try_element_at("v", F.lit(f)).alias(f) for f in ("cik", "name", "ticker", "exchange")])


def read_registrant_text(spark: SparkSession, path) -> DataFrame:
    """The plain list: a ticker and a registrant number per line; other lines are ignored."""
    words = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select(words.alias("w")).filter((F.size("w") == 2) & F.get("w", F.lit(1)).rlike(r"^\d+$"))
    return lines.select(F.get("w", F.lit(0)).alias("ticker"), F.get("w", F.lit(1)).alias("cik"))


def read_submissions(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(REGISTRANT).option("multiLine", True).json(path).withColumnRenamed("sicDescription", "sic_description")


