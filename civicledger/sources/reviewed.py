"""Hand-reviewed inputs: committee/industry mappings and person-to-official links. All or nothing, with reasons."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.rules import is_true, sic_number
from ..functions.text import empty_to_null


#: brackets nested deeper than this make a pattern unusable
PATTERN_DEPTH = 12


def _blank(name):
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) == ""


def unusable_pattern(c):
    """Whether a pattern won't compile. rlike would fail the job on one, so its parts are looked at instead of trying it."""
    # escapes and classes stand for one character, flags for none, the heads of special groups for a bracket
    plain = F.regexp_replace(c, r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]", "x")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\(\?[a-zA-Z-]+\)", ""), r"\(\?(?:[a-zA-Z-]*:|<?[=!]|>|<[a-zA-Z]\w*>)", "(")
    repeats = F.regexp_extract_all(plain, F.lit(r"\{\d+,\d+\}"), F.lit(0))
    falling = F.exists(repeats, lambda r: F.regexp_extract(r, r"\d+", 0).try_cast("long") > F.regexp_extract(r, r",(\d+)", 1).try_cast("long"))
    misplaced = plain.rlike(r"\[|\\$|(?:^|[(|])[*+?]|(?:^|[(|])\{|\{(?!\d+(?:,\d*)?\})|[*+?}][+?]?[*]|[*+?}][+?][+?]")
    for _ in range(PATTERN_DEPTH):
        plain = F.regexp_replace(plain, r"\([^()]*\)", "x")
    return misplaced | falling | plain.rlike("[()]")


def mapping_violations(rows: DataFrame) -> DataFrame:
    """(mapping_id, problem): every rule a mapping row breaks, and -1 for the file as a whole."""
    start, end = sic_number("sic_start"), sic_number("sic_end")
    is_none = F.col("relevance_level") == "none"
    reviewed = F.col("review_status") == "reviewed"
    bad_pattern = unusable_pattern(F.col("industry_pattern"))
    tests = [
        *[(f"missing {c}", _blank(c)) for c in K.MAPPING_REQUIRED],
        ("unknown relevance_level", ~F.col("relevance_level").isin(K.LEVELS)),
        ("unknown review_status", ~F.col("review_status").isin(K.REVIEW_STATUSES)),
        ("unknown jurisdiction_basis", ~F.col("jurisdiction_basis").isin(K.BASES)),
        ("reviewed_at must be set exactly for reviewed rows", reviewed == _blank("reviewed_at")),
        ("a 'none' row has no SIC range", is_none & (F.col("sic_start").isNotNull() | F.col("sic_end").isNotNull())),
        ("SIC range needs four-digit codes in order", ~is_none & (start.isNull() | end.isNull() | (start > end))),
        ("industry_pattern is not usable", bad_pattern),
        ("subcommittee_name needed", ~_blank("subcommittee_code") & _blank("subcommittee_name")),
    ]
    found = F.array_compact(F.array(*[F.when(is_true(test), text) for text, test in tests]))
    per_row = rows.select("mapping_id", F.explode(found).alias("problem"))
    whole = rows.agg(F.count("*").alias("n"), F.count_distinct("mapping_version").alias("v")).select(
        F.lit(-1).cast("long").alias("mapping_id"),
        F.when(F.col("n") == 0, "no rows").when(F.col("v") != 1, "exactly one mapping_version is needed").alias("problem"),
    ).filter("problem IS NOT NULL")
    return per_row.unionByName(whole)


def sync_mappings(rows: DataFrame, current: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(mappings, violations). One version is replaced as a whole, and only when no row breaks a rule."""
    violations = mapping_violations(rows)
    typed = rows.withColumns({
        "sic_start": sic_number("sic_start"), "sic_end": sic_number("sic_end"),
        **{c: empty_to_null(c) for c in ("subcommittee_code", "subcommittee_name", "industry_pattern", "reviewed_by", "review_note")},
        "reviewed_at": F.col("reviewed_at").try_cast("timestamp_ntz"),
    })
    accepted = typed.filter(~violations.exists())
    if current is None:
        return accepted, violations
    kept = current.join(accepted.select("mapping_version").distinct(), "mapping_version", "left_anti")
    return kept.select(*current.columns).unionByName(accepted, allowMissingColumns=True), violations


def load_overrides(entries: DataFrame, politicians: DataFrame, overrides: DataFrame | None = None):
    """(rows, skipped, violations) for reviewed links; a single violation empties ``rows``.

    Entries name a politician by canonical key or id. Unknown keys are skipped, everything else must hold: the shape of
    the id, reason and source, an unmatched politician, and an official id nobody else has.
    """
    people = politicians.select(
        F.col("id").alias("p_id"), F.col("canonical_key"), "name", "enrichment_status", "enrichment_method",
        F.col("bioguide_id").alias("p_bioguide"))
    keyed = entries.filter(~is_true(_blank("canonical_key"))).join(people, "canonical_key", "left")
    skipped = keyed.filter("p_id IS NULL").select("canonical_key")
    by_id = entries.filter(_blank("canonical_key")).join(
        people.drop("canonical_key"), F.col("politician_id") == F.col("p_id"), "left")
    named = keyed.filter("p_id IS NOT NULL").unionByName(by_id, allowMissingColumns=True)
    named = named.withColumn("bioguide_id", F.upper(F.trim(F.coalesce("bioguide_id", F.lit("")))))

    owners = politicians.filter("bioguide_id IS NOT NULL").groupBy("bioguide_id").agg(
        F.min("id").alias("_owner_min"), F.max("id").alias("_owner_max"))
    in_file = named.groupBy("bioguide_id").agg(F.count_distinct("p_id").alias("_claims"))
    joined = named.join(owners, "bioguide_id", "left").join(in_file, "bioguide_id", "left")
    if overrides is not None:
        held = overrides.groupBy("bioguide_id").agg(
            F.min("politician_id").alias("_held_min"), F.max("politician_id").alias("_held_max"))
        joined = joined.join(held, "bioguide_id", "left")
    else:
        joined = joined.withColumns({"_held_min": F.lit(None).cast("long"), "_held_max": F.lit(None).cast("long")})

    def someone_else(low, high):
        return is_true((F.col(low) != F.col("p_id")) | (F.col(high) != F.col("p_id")))

    same_override = F.col("enrichment_method").eqNullSafe("override") & F.col("p_bioguide").eqNullSafe(F.col("bioguide_id"))
    tests = [
        ("no such politician", F.col("p_id").isNull()),
        ("politician_id does not belong to the key", (F.col("politician_id") != F.col("p_id"))),
        ("not an official id", ~F.col("bioguide_id").rlike(K.BIOGUIDE_PATTERN)),
        ("reason needed", _blank("reason")),
        ("reason too long", F.length(F.trim("reason")) > K.OFFICIAL_ID_REASON_MAX),
        ("source needed", _blank("source")),
        ("source too long", F.length(F.trim("source")) > K.OFFICIAL_ID_SOURCE_MAX),
        ("reviewed_at needed", F.col("reviewed_at").try_cast("timestamp_ntz").isNull()),
        ("already matched automatically", (F.col("enrichment_status") == "matched") & ~same_override),
        ("official id belongs to another politician", someone_else("_owner_min", "_owner_max")),
        ("official id is another politician's override", someone_else("_held_min", "_held_max")),
        ("official id appears for several politicians", F.col("_claims") > 1),
    ]
    found = F.array_compact(F.array(*[F.when(is_true(test), text) for text, test in tests]))
    checked = joined.withColumn("problems", found)
    violations = checked.select("p_id", "bioguide_id", F.explode("problems").alias("problem"))
    rows = checked.select(
        F.col("p_id").alias("politician_id"), "bioguide_id", F.trim("reason").alias("reason"),
        F.trim("source").alias("source"), F.col("reviewed_at").try_cast("timestamp_ntz").alias("reviewed_at"),
    ).filter(~violations.exists())
    return rows, skipped, violations


