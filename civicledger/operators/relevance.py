"""Is a security's industry within the jurisdiction of a committee the politician sits on?

Mappings hold mapping_id, committee_code, subcommittee_code, committee_name, subcommittee_name, sic_start, sic_end,
industry_pattern, relevance_level, review_status, reviewed_at, jurisdiction_basis and mapping_version. A subject is any
row with a key, sic_code and industry; its seats are found through the columns in ``on``.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.rules import is_true, sic_group, sic_number


def mapping_rank() -> list[Column]:
    """Best first: subcommittee before committee, direct before related, the narrower range, the lower id."""
    return [
        F.col("subcommittee_code").isNull().cast("int").alias("r_scope"),
        (F.col("relevance_level") != "direct").cast("int").alias("r_level"),
        (F.col("sic_end") - F.col("sic_start")).alias("r_width"),
        F.col("mapping_id").alias("r_id"),
    ]


def usable_mappings(mappings: DataFrame) -> DataFrame:
    reviewed = (F.col("review_status") == "reviewed") & F.col("reviewed_at").isNotNull()
    return mappings.filter("relevance_level <> 'none' AND sic_start IS NOT NULL").withColumn("is_reviewed", reviewed)


def current_version(mappings: DataFrame) -> DataFrame:
    """The rows of the most recently loaded mapping version."""
    newest = mappings.agg(F.max_by("mapping_version", "mapping_id").alias("mapping_version"))
    return mappings.join(newest, "mapping_version", "left_semi")


def code_segments(mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cuts, covered): the codes at which any range starts or ends, numbered, and (mapping_id, segment) for the stretches between
    two cuts that a mapping's range is made of.

    Codes have four digits, so there are at most 10,000 cuts, and the one window over all of them is bounded.
    """
    return range_segments(usable_mappings(mappings), ["mapping_id"])


def range_segments(ranges: DataFrame, key) -> tuple[DataFrame, DataFrame]:
    """:func:`code_segments` of any ranges with a key."""
    ranges = ranges.select(*{c: 0 for c in (*key, "sic_start")}, F.expr("sic_end + 1").alias("_past"))
    cuts = ranges.select(F.explode(F.array("sic_start", "_past")).alias("_cut")).distinct()
    cuts = cuts.withColumn("segment", F.row_number().over(Window.orderBy("_cut")))
    first, past = cuts.select(F.col("_cut").alias("sic_start"), F.col("segment").alias("_first")), cuts.select(F.col("_cut").alias("_past"), F.col("segment").alias("_end"))
    spans = ranges.filter("_past > sic_start").join(first, "sic_start").join(past, "_past")
    return cuts, spans.select(*key, F.explode(F.sequence("_first", F.col("_end") - 1)).alias("segment"))


def with_segment(subjects: DataFrame, cuts: DataFrame) -> DataFrame:
    """Subjects with a usable code, and the segment the code lies in; codes below the first cut are in none."""
    coded = subjects.withColumn("_sic", sic_number("sic_code")).filter("_sic IS NOT NULL")
    codes = coded.select("_sic").distinct().withColumn("_cut", F.col("_sic")).join(cuts, "_cut", "full_outer")
    upto = F.max("segment").over(Window.orderBy("_cut").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = codes.withColumn("segment", upto).filter("_sic IS NOT NULL AND segment IS NOT NULL").select("_sic", "segment")
    return coded.join(placed, "_sic").drop("_sic")


def seat_mapping_matches(subjects, seats, mappings, key, on=("politician_id",)) -> DataFrame:
    """One row per subject and mapping that applies to one of its seats.

    Equal keys only: a mapping stands under its committee, the subcommittee it asks for (or none) and each segment of its range; a
    subject meets it with the seats of its holder and the segment of its code. No row is made for a mapping whose range is another one.
    """
    on, none = list(on), F.lit("")
    described = usable_mappings(mappings).drop("committee_name", "subcommittee_name", "chamber")
    cuts, covered = code_segments(mappings)
    offers = described.join(covered, "mapping_id").withColumn("_seat", F.coalesce("subcommittee_code", none))
    # a seat on a subcommittee is a seat on its committee, too
    holds = seats.select(*on, "committee_code", F.explode(F.array(none, F.coalesce("subcommittee_code", none))).alias("_seat")).distinct()
    subject = with_segment(subjects, cuts).select(*key, *[c for c in on if c not in key], "industry", "segment")
    pattern = F.col("industry_pattern")
    fits = pattern.isNull() | is_true(F.rlike("industry", F.concat(F.lit("(?i)"), pattern)))
    met = subject.join(holds, on).join(offers, ["committee_code", "_seat", "segment"])
    return met.filter(fits).drop("industry", "segment", "_seat")


def primary_match(matches: DataFrame, key) -> DataFrame:
    """The best match of every subject."""
    fields = ["mapping_id", "committee_code", "subcommittee_code", "relevance_level", "review_status"]
    return matches.groupBy(*key).agg(
        F.min_by(F.struct(*fields), F.struct(*mapping_rank())).alias("_best"), F.count("*").alias("match_count"),
    ).select(*key, "_best.*", "match_count")


def unmapped_seats(seats: DataFrame, mappings: DataFrame) -> DataFrame:
    """Seats on committees no mapping row mentions, 'none' rows included."""
    return seats.join(mappings.select("committee_code").distinct(), "committee_code", "left_anti")


def _seat_facts(seats, mappings, on):
    mapped = mappings.select("committee_code").distinct().withColumn("_mapped", F.lit(True))
    return seats.join(mapped, "committee_code", "left").groupBy(*on).agg(
        F.lit(True).alias("_seated"), F.bool_or(F.col("_mapped").isNull()).alias("_unmapped"))


def industry_relevance(subjects, seats, mappings, key, on=("politician_id",)) -> DataFrame:
    """Subjects with status, reason, the best match and how reviewed the matches are."""
    on = list(on)
    matches = seat_mapping_matches(subjects, seats, mappings, key, on)
    reviewed = F.col("review_status") == "reviewed"
    best = matches.groupBy(*key).agg(
        F.min_by(F.struct("mapping_id", "committee_code", "subcommittee_code", "relevance_level"),
                 F.struct(*mapping_rank())).alias("_best"),
        F.count("*").alias("match_count"),
        F.bool_or(reviewed & (F.col("relevance_level") == "direct")).alias("_reviewed_direct"),
        F.bool_or(reviewed).alias("_reviewed"),
    )
    facts = _seat_facts(seats, mappings, on)
    reason = (
        F.when(sic_number("sic_code").isNull(), "no_sic")
        .when(F.col("_seated").isNull(), "no_committee_assignments")
        .when(F.col("match_count").isNotNull(), "match")
        .when(F.col("_unmapped"), "unmapped_committees")
        .otherwise("no_match")
    )
    status = (
        F.when(F.col("reason") == "match", "relevant").when(F.col("reason") == "no_match", "not_relevant")
        .otherwise("unknown")
    )
    category = (
        F.when(F.col("status") == "not_relevant", "no_relevance").when(F.col("status") == "unknown", "unknown")
        .when(F.col("_reviewed_direct"), "reviewed_direct").when(F.col("_reviewed"), "reviewed_related_only")
        .otherwise("needs_review_only")
    )
    return (
        subjects.join(best, list(key), "left").join(facts, on, "left")
        .withColumn("reason", reason).withColumn("status", status).withColumn("review_category", category)
        .select(*subjects.columns, "status", "reason", "review_category",
                F.coalesce("match_count", F.lit(0)).alias("match_count"), "_best.*")
    )


SUBJECT = ["politician_id", "sic_code", "industry"]


def trade_subjects(trades: DataFrame, securities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trades with a subject id, distinct subjects): the answer depends only on person, code and industry."""
    # one aggregate before any join: a hot person or ticker is already down to its distinct pairs
    counted = trades.groupBy("politician_id", "ticker").agg(F.count("*").alias("trades"))
    described = counted.join(securities.select("ticker", "sic_code", "industry"), "ticker", "left")
    subjects = described.groupBy(*SUBJECT).agg(F.sum("trades").alias("trades")).withColumn(
        "subject", F.sha2(F.to_json(F.struct(*SUBJECT)), 256))
    return described, subjects


def relevance_report(trades, securities, seats, mappings, politicians=None) -> DataFrame:
    """Trade counts in long form: by status, reason, level of the best match, review category, committee, and the totals.

    Subjects are added up once per combination of all items; the long form is made of those few rows.
    """
    described, subjects = trade_subjects(trades, securities)
    rel = industry_relevance(subjects, seats, mappings, ["subject"])
    items = {
        "status": F.col("status"),
        "review_category": F.col("review_category"),
        "unknown_reason": F.when(F.col("status") == "unknown", F.col("reason")),
        "best_level": F.col("relevance_level"),
        "primary_committee": F.nullif(F.concat_ws("/", "committee_code", "subcommittee_code"), F.lit("")),
        "sic_group": F.when(F.col("status") == "relevant", sic_group(sic_number("sic_code"))),
    }
    together = rel.groupBy(*[item.alias(f"_{name}") for name, item in items.items()]).agg(F.sum("trades").alias("trades"))
    entries = F.array(*[F.struct(F.lit(name).alias("measure"), F.col(f"_{name}").alias("item")) for name in items],
                      F.struct(F.lit("total").alias("measure"), F.lit("trades").alias("item")),
                      F.struct(F.lit("total").alias("measure"), F.when(F.col("_status") != "unknown", "evaluable").alias("item")))
    counted = together.select("trades", F.explode(entries).alias("e")).filter("e.item IS NOT NULL").groupBy("e.measure", "e.item").agg(F.sum("trades").alias("trades"))
    left_open = rel.filter("reason = 'unmapped_committees'").groupBy("politician_id").agg(F.sum("trades").alias("trades"))
    name = F.min(F.coalesce("committee_name", "committee_code")).alias("item")
    unmapped = (
        left_open.join(unmapped_seats(seats, mappings).groupBy("politician_id", "committee_code").agg(name), "politician_id")
        .groupBy(F.lit("unmapped_committee").alias("measure"), "item").agg(F.sum("trades").alias("trades"))
    )
    return counted.unionByName(unmapped).unionByName(_totals(described, seats, politicians))


def _totals(described, seats, politicians):
    """Traded securities, those with a code, people, people with seats: (measure, item, trades), the last one the count."""
    traded = described.filter("ticker IS NOT NULL").select("ticker", "sic_code").distinct()
    counts = [traded.agg(F.count_distinct("ticker").alias("securities"), F.count_distinct(F.when(F.col("sic_code").isNotNull(), F.col("ticker"))).alias("securities_with_code")),
              seats.agg(F.count_distinct("politician_id").alias("politicians_with_seats"))]
    if politicians is not None:
        counts.append(politicians.agg(F.count("*").alias("politicians")))
    out = None
    for df in counts:
        rows = df.select(F.explode(F.array(*[F.struct(F.lit("total").alias("measure"), F.lit(c).alias("item"), F.col(c).alias("trades")) for c in df.columns])).alias("e")).select("e.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def row_key() -> Column:
    where = F.concat_ws("/", "committee_code", "subcommittee_code")
    sic_range = F.concat_ws("-", F.lpad(F.col("sic_start").cast("string"), 4, "0"), F.lpad(F.col("sic_end").cast("string"), 4, "0"))
    return F.concat_ws(":", where, F.when(F.col("sic_start").isNotNull(), sic_range).otherwise("none"), "relevance_level")


def mapping_security_hits(mappings, securities) -> DataFrame:
    """(mapping, ticker) for the traded securities a mapping's range and pattern take in, whoever trades them."""
    m = mappings.filter("sic_start IS NOT NULL").select("mapping_id", "sic_start", "sic_end", "industry_pattern")
    # tickers collapse to their distinct codes and descriptions before the range test
    codes = securities.withColumn("_sic", sic_number("sic_code")).filter("_sic IS NOT NULL")
    profiles = codes.select("sic_code", "industry", "_sic").distinct()
    fits = F.col("industry_pattern").isNull() | is_true(
        F.rlike("industry", F.concat(F.lit("(?i)"), F.col("industry_pattern"))))
    # a range covers at most 9999 codes, so it is turned into an equi-join on the code
    per_code = m.withColumn("_sic", F.explode(F.sequence("sic_start", "sic_end")))
    hits = per_code.join(profiles, "_sic").filter(fits).select("mapping_id", "sic_code", "industry")
    return hits.join(
        codes.select("sic_code", F.col("industry").alias("_industry"), "ticker"), "sic_code"
    ).filter(F.col("industry").eqNullSafe(F.col("_industry"))).drop("_industry")


def mapping_review_stats(mappings, trades, seats, securities) -> DataFrame:
    """Per mapping: securities and trades it takes in, trades it is the best match of, people, first tickers."""
    traded = securities.join(trades.select("ticker").distinct(), "ticker", "left_semi")
    hits = mapping_security_hits(mappings, traded)
    by_security = hits.groupBy("mapping_id").agg(F.count("*").alias("securities_matched")).join(
        first_tickers(hits), "mapping_id")
    groups = hits.groupBy("mapping_id").agg(
        F.count_distinct(F.substring("sic_code", 1, 3)).alias("industry_groups"))
    _, subjects = trade_subjects(trades.filter("ticker IS NOT NULL"), securities)
    matches = seat_mapping_matches(subjects.drop("trades"), seats, mappings, ["subject", "politician_id"])
    best = Window.partitionBy("subject").orderBy(*mapping_rank())
    ranked = matches.withColumn("_place", F.row_number().over(best)).join(
        subjects.select("subject", "trades"), "subject")
    by_trade = ranked.groupBy("mapping_id").agg(
        F.sum("trades").alias("trades_matched"),
        F.sum(F.when(F.col("_place") == 1, F.col("trades")).otherwise(0)).alias("trades_primary"),
        F.count_distinct("politician_id").alias("politicians_matched"),
    )
    numbers = ["securities_matched", "industry_groups", "trades_matched", "trades_primary", "politicians_matched"]
    out = mappings.withColumn("row_key", row_key())
    for part in (by_security, groups, by_trade):
        out = out.join(part, "mapping_id", "left")
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n in numbers})


def first_tickers(hits: DataFrame, n=8) -> DataFrame:
    """The alphabetically first tickers per mapping, trimmed before they are gathered."""
    position = Window.partitionBy("mapping_id").orderBy("ticker")
    kept = hits.select("mapping_id", "ticker").withColumn("_p", F.row_number().over(position)).filter(F.col("_p") <= n)
    return kept.groupBy("mapping_id").agg(F.array_sort(F.collect_list("ticker")).alias("example_tickers"))


def security_descriptions(mappings, trades, securities) -> DataFrame:
    """How many traded securities per mapping, code and description."""
    traded = securities.join(trades.select("ticker").distinct(), "ticker", "left_semi")
    return mapping_security_hits(mappings, traded).groupBy(
        "mapping_id", "sic_code", F.coalesce("industry", F.lit("")).alias("industry")).agg(F.count("*").alias("securities"))


def mapping_overlaps(mappings: DataFrame, committees: DataFrame | None = None) -> DataFrame:
    """Pairs of rows of different committees whose ranges share a code, once per label.

    ``mapping_id`` is the key of the mappings. A draft repeats ranges and labels, so pairs are formed of distinct ranges and distinct
    labels and then meet the mappings; nothing is shuffled or made distinct after that. ``committees`` (committee_code and what else is
    known of it) adds its columns and leaves out the mappings of other committees; it too meets ranges.
    """
    live = usable_mappings(mappings)
    span = ["sic_start", "sic_end"]
    label = F.format_string(
        "%s %04d-%04d (%s)", F.concat_ws("/", "committee_code", "subcommittee_code"), "sic_start", "sic_end", "relevance_level")
    # two ranges share a code exactly where they share a stretch between two cuts; the first one they share stands for the pair
    _, covered = range_segments(live.select(*span).distinct(), span)
    covered = covered.withColumn("_from", F.min("segment").over(Window.partitionBy(*span)))
    other = covered.select(*[F.col(c).alias(f"o_{c}") for c in span], "segment", F.col("_from").alias("_o_from"))
    meet = covered.join(other, "segment").filter("segment = greatest(_from, _o_from)").select(*span, "o_sic_start", "o_sic_end")
    # a label is one row per range, with the committees that read so
    labels = live.select(F.col("committee_code").alias("_code"), *[F.col(c).alias(f"o_{c}") for c in span], label.alias("overlaps_with")).groupBy(
        "o_sic_start", "o_sic_end", "overlaps_with").agg(F.collect_set("_code").alias("_codes"))
    mine = live.select("committee_code", *span).distinct()
    if committees is not None:
        mine = mine.join(committees, "committee_code")
    known = [c for c in mine.columns if c != "committee_code" and c not in span]
    pairs = mine.join(meet, span).join(labels, ["o_sic_start", "o_sic_end"]).filter("exists(_codes, c -> c <> committee_code)")
    # few ranges make many pairs, which are dealt over as many tasks as their own size asks for
    pairs = pairs.select("committee_code", *span, "overlaps_with", *known).repartition("committee_code", *span)
    return live.select("mapping_id", "committee_code", *span).distinct().join(pairs, ["committee_code", *span]).select(
        "mapping_id", "overlaps_with", *known)


def with_titles(stats: DataFrame, sic_titles: DataFrame) -> DataFrame:
    """Adds how many official SIC titles (sic_code, title) a mapping's range covers."""
    ranges = stats.filter("sic_start IS NOT NULL").select(
        "mapping_id", F.explode(F.sequence("sic_start", "sic_end")).alias("_sic"))
    counts = ranges.join(sic_titles.select(sic_number("sic_code").alias("_sic")), "_sic").groupBy("mapping_id").agg(
        F.count("*").alias("official_titles"))
    return stats.join(counts, "mapping_id", "left").withColumn(
        "official_titles", F.coalesce("official_titles", F.lit(0)))


def scrutiny_flags(stats: DataFrame) -> DataFrame:
    """Adds ``flags``: why a reviewer should look at a mapping, in a fixed order."""
    if "official_titles" not in stats.columns:
        stats = stats.withColumn("official_titles", F.lit(0))
    overlapping = mapping_overlaps(stats).select("mapping_id").distinct().withColumn("_overlaps", F.lit(True))
    live = (F.col("relevance_level") != "none") & F.col("sic_start").isNotNull()
    broad = (F.col("sic_end") - F.col("sic_start") >= K.BROAD_WIDTH) | (F.col("official_titles") >= K.BROAD_TITLES)
    tests = [
        ("broad_range", live & broad),
        ("mixed_industries", live & (F.col("industry_groups") >= 2)),
        ("inferred_from_name", ~is_true(F.col("jurisdiction_basis").isin(K.EXPLICIT_BASES))),
        ("related_level", F.col("relevance_level") == "related"),
        ("many_matches", F.col("trades_matched") >= K.MANY_TRADES),
        ("overlaps_other_committee", is_true("_overlaps")),
        ("false_positive_history", is_true(F.col("review_note").startswith("Review history"))),
    ]
    flags = F.array_compact(F.array(*[F.when(test, name) for name, test in tests]))
    return stats.join(overlapping, "mapping_id", "left").withColumn("flags", flags).drop("_overlaps")


def _is_priority():
    return F.arrays_overlap("flags", F.array(*[F.lit(f) for f in K.SUBSTANTIVE_FLAGS]))


def review_summary(flagged: DataFrame) -> DataFrame:
    """One row of counts over all mappings."""
    live = F.col("relevance_level") != "none"
    explicit = is_true(F.col("jurisdiction_basis").isin(K.EXPLICIT_BASES))
    counts = {
        "mappings": F.lit(True),
        **{level: F.col("relevance_level") == level for level in ("direct", "related", "none")},
        "committee_level": F.col("subcommittee_code").isNull(),
        "subcommittee_level": F.col("subcommittee_code").isNotNull(),
        "explicit_jurisdiction": explicit,
        "inferred_subcommittee_name": F.col("jurisdiction_basis") == "subcommittee_name",
        "inferred_committee_name": F.col("jurisdiction_basis") == "committee_name",
        "explicit_jurisdiction_non_none": explicit & live,
        "needs_review": F.col("review_status") == "needs_review",
        "reviewed": F.col("review_status") == "reviewed",
        "rows_flagged_for_scrutiny": F.size("flags") > 0,
        "rows_with_a_priority_concern": _is_priority(),
        "rows_matching_no_current_security": live & (F.col("securities_matched") == 0),
        "rows_matching_no_current_trade": live & (F.col("trades_matched") == 0),
    }
    return flagged.agg(*[F.count_if(test).alias(name) for name, test in counts.items()])


def priority_order() -> list[Column]:
    level = F.when(F.col("relevance_level") == "direct", 0).when(F.col("relevance_level") == "related", 1).otherwise(2)
    breadth = F.array_contains("flags", "broad_range").cast("int") + F.array_contains("flags", "mixed_industries").cast("int")
    return [level, F.col("trades_matched").desc(), breadth.desc(), F.col("row_key")]


def priority_rows(flagged: DataFrame) -> DataFrame:
    """The rows to look at first with their ``position``; no more than the mapping file has."""
    position = F.row_number().over(Window.orderBy(*priority_order()))
    return flagged.filter(_is_priority()).withColumn("position", position).orderBy("position")


def top_mappings(flagged: DataFrame, n=20) -> DataFrame:
    return flagged.filter("relevance_level <> 'none'").orderBy(F.col("trades_matched").desc(), "row_key").limit(n)


def recommendation_gaps(rows: DataFrame, recs: DataFrame) -> DataFrame:
    """What is wrong between selected rows (row_key, relevance_level) and recommendations (row_key, action, reason)."""
    per_key = recs.groupBy("row_key").agg(
        F.count("*").alias("_n"), F.min("action").alias("action"),
        F.bool_or(F.trim(F.coalesce("reason", F.lit(""))) == "").alias("_no_reason"),
        F.bool_or(~is_true(F.col("action").isin(K.REVIEW_ACTIONS))).alias("_bad_action"))
    wanted = rows.select("row_key", "relevance_level").withColumn("_wanted", F.lit(True))
    level = F.col("relevance_level")
    problem = (
        F.when(F.col("_n").isNull(), "missing recommendation")
        .when(F.col("_n") > 1, "duplicate recommendation")
        .when(F.col("_no_reason"), "reason needed")
        .when(F.col("_bad_action"), "unknown action")
        .when(F.col("_wanted").isNull(), "not a selected row")
        .when(F.col("action").isin(K.DIRECT_ONLY_ACTIONS) & (level != "direct"), "action needs a direct row")
        .when((F.col("action") == "KEEP RELATED") & (level != "related"), "action needs a related row")
    )
    return (
        wanted.join(per_key, "row_key", "full_outer").withColumn("problem", problem)
        .filter("problem IS NOT NULL").select("row_key", "action", "problem")
    )
