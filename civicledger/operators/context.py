"""The context of a trade: four signals, the flag, the evidence behind it, and how results are kept by version."""

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.rules import is_true, sic_number, spread_null
from .history import held_seats, with_standing
from .relevance import current_version, mapping_rank, usable_mappings
from .signals import excess_signal, secondary_count, size_signal, with_delay_signal


@dataclass(frozen=True)
class ContextConfig:
    delay_days: int = 45
    excess_return: float = 0.20
    size_percentile: float = 90.0
    excess_horizon_days: int = 90
    min_history: int = 10
    min_secondary_signals: int = 2
    require_temporal_verification: bool = True
    benchmark: str = "SPY"

    def version_label(self) -> str:
        """Any configuration but the default one gets a label of its own, so it never replaces default results."""
        if self == ContextConfig():
            return K.ENGINE_VERSION
        settings = json.dumps(asdict(self), sort_keys=True)
        return f"{K.ENGINE_VERSION}+custom-{hashlib.sha256(settings.encode()).hexdigest()[:6]}"


DAY = ["politician_id", "transaction_date"]


def seat_reach(seats: DataFrame, mappings: DataFrame) -> DataFrame:
    """Seats with the ids of the mappings each brings into play, and whether any mapping row knows its committee.

    Done on the seats themselves, before they meet any day: a seat's list is at most as long as the mapping file. A
    mapping for a subcommittee needs a seat on that subcommittee.
    """
    usable = "relevance_level <> 'none' AND sic_start IS NOT NULL"
    rows = mappings.groupBy("committee_code").agg(F.expr(
        f"collect_list(struct(mapping_id, subcommittee_code AS sub)) FILTER (WHERE {usable})").alias("_rows"))
    reach = F.expr(
        "transform(filter(_rows, m -> m.sub IS NULL OR coalesce(m.sub = subcommittee_code, false)), m -> m.mapping_id)")
    return seats.join(rows, "committee_code", "left").select(
        *seats.columns, F.col("_rows").isNotNull().alias("mapped"),
        F.coalesce(reach, F.array().cast("array<long>")).alias("reach"))


def with_seats(trades: DataFrame, seats: DataFrame, mappings: DataFrame) -> DataFrame:
    """Adds how the politician's seats stand on the trade's day, and the mappings behind applying and behind current seats.

    The seats of a person are one value, which meets the trades by politician; days are judged within the row. Today's
    snapshot seats are followed in the same pass: they only matter where the record shows a seat was not held. Without a
    seat, or a day, all is NULL.
    """
    met = trades.join(held_seats(seat_reach(seats, mappings)), "politician_id", "left").withColumn(
        "_held", F.when(F.col("transaction_date").isNotNull(), F.col("_held")))
    stands = with_standing(met)
    verified = f"s.applies AND s.seat_status = '{K.TEMPORALLY_VERIFIED}'"

    def ids(condition):
        return F.expr(f"array_distinct(flatten(transform(filter(_stands, s -> {condition}), s -> s.reach)))")

    return stands.withColumns({
        "seats": F.expr("CASE WHEN _stands IS NOT NULL THEN size(_stands) END"),
        "seats_applied": F.expr("CASE WHEN _stands IS NOT NULL THEN size(filter(_stands, s -> s.applies)) END"),
        "all_verified": F.expr(f"CASE WHEN exists(_stands, s -> s.applies) THEN forall(_stands, s -> NOT s.applies OR ({verified})) END"),
        "any_unmapped": F.expr("exists(_stands, s -> s.applies AND NOT s.mapped)"),
        "applied_ids": ids("s.applies"), "verified_ids": ids(verified), "snapshot_ids": ids("s.is_snapshot"),
    }).drop("_stands")


def security_mappings(securities: DataFrame, mappings: DataFrame) -> DataFrame:
    """Securities with ``fit``: the mappings whose range and pattern take the industry in, best first.

    The mapping file is one value for all securities; ranges and patterns are tested once per security, not per trade.
    """
    text = F.xxhash64(*[c for c in mappings.columns if c in (
        "rationale", "source_url", "source_citation", "sic_start", "sic_end", "jurisdiction_basis", "mapping_id",
        "committee_code", "committee_name", "subcommittee_code", "subcommittee_name", "relevance_level", "review_status")])
    item = F.struct(
        *mapping_rank(), "mapping_id", "sic_start", "sic_end", "industry_pattern", F.col("is_reviewed").alias("reviewed"),
        F.expr("relevance_level = 'direct'").alias("is_direct"), text.alias("text_hash"))
    book = usable_mappings(mappings).agg(F.array_sort(F.collect_list(item)))
    fits = ("filter(_book, m -> _sic BETWEEN m.sic_start AND m.sic_end AND (m.industry_pattern IS NULL "
            "OR coalesce(rlike(industry, concat('(?i)', m.industry_pattern)), false)))")
    return securities.select("ticker", "sic_code", "industry", sic_number("sic_code").alias("_sic")).withColumn(
        "_book", book.scalar()).select(
        "ticker", "sic_code", "industry", F.col("_sic").isNotNull().alias("has_sic"),
        F.expr(f"CASE WHEN _sic IS NOT NULL THEN {fits} END").alias("fit"))


def with_committee_signal(trades: DataFrame, seats: DataFrame, mappings: DataFrame, securities: DataFrame) -> DataFrame:
    """Adds committee relevance and the industry to trades.

    Two equi-joins, on the politician and on the ticker; the rest happens within a row. Unlisted trades are dealt
    over the partitions of the ticker join.
    """
    profile = security_mappings(securities, mappings).withColumnRenamed("ticker", "_ticker")
    joined = (
        with_seats(trades, seats, mappings)
        .withColumn("_ticker", spread_null("ticker", F.struct(*DAY))).join(profile, "_ticker", "left").drop("_ticker")
    )

    def listed(ids, test):
        """Matches best first; the struct starts with the rank."""
        return F.expr(
            f"transform(filter(fit, m -> m.reviewed AND {test} AND array_contains({ids}, m.mapping_id)), m -> named_struct("
            "'r_scope', m.r_scope, 'r_level', m.r_level, 'r_width', m.r_width, 'r_id', m.r_id, 'mapping_id', m.mapping_id, "
            f"'status', if(array_contains(verified_ids, m.mapping_id), '{K.TEMPORALLY_VERIFIED}', '{K.CURRENT_ASSIGNMENT_ONLY}'), "
            "'text_hash', m.text_hash))")

    lists = {"direct": listed("applied_ids", "m.is_direct"), "related": listed("applied_ids", "NOT m.is_direct"),
             "_current": listed("snapshot_ids", "m.is_direct")}
    joined = joined.withColumns({
        **lists, "pending_review": F.expr(
            "coalesce(size(filter(fit, m -> NOT m.reviewed AND array_contains(applied_ids, m.mapping_id))), 0)")})
    joined = joined.withColumn("committee_relevance_reason", F.expr("""
        CASE WHEN NOT coalesce(has_sic, false) THEN 'no_sic'
             WHEN seats IS NULL THEN 'no_committee_assignments'
             WHEN size(direct) > 0 THEN 'direct_match'
             WHEN seats_applied < seats AND size(_current) > 0 THEN 'seat_not_held_on_transaction_date'
             WHEN seats_applied = 0 THEN 'no_seat_on_transaction_date'
             WHEN any_unmapped THEN 'unmapped_committees'
             ELSE 'no_reviewed_direct_match' END"""))
    joined = joined.withColumns({
        "committee_relevance": F.expr("""
            CASE WHEN committee_relevance_reason NOT IN ('no_sic', 'no_committee_assignments', 'unmapped_committees')
                 THEN committee_relevance_reason = 'direct_match' END"""),
        "committee_contradicted": F.expr("committee_relevance_reason = 'seat_not_held_on_transaction_date'"),
        "committee_temporal_status": F.expr(f"""
            CASE WHEN seats IS NULL THEN '{K.UNAVAILABLE}'
                 WHEN committee_relevance_reason = 'seat_not_held_on_transaction_date' THEN '{K.CONTRADICTED}'
                 WHEN CASE committee_relevance_reason
                        WHEN 'direct_match' THEN exists(direct, m -> m.status = '{K.TEMPORALLY_VERIFIED}')
                        WHEN 'no_seat_on_transaction_date' THEN true ELSE coalesce(all_verified, false) END
                 THEN '{K.TEMPORALLY_VERIFIED}' ELSE '{K.CURRENT_ASSIGNMENT_ONLY}' END"""),
        "rejected": F.expr(
            "if(committee_relevance_reason = 'seat_not_held_on_transaction_date', _current, slice(_current, 1, 0))"),
    })
    empty = {n: F.expr(f"coalesce({n}, filter(_none, m -> false))") for n in ("direct", "related", "rejected")}
    none = F.array().cast(joined.schema["direct"].dataType)
    return joined.withColumn("_none", none).withColumns(empty).drop(
        "_none", "_current", "fit", "has_sic", "seats", "seats_applied", "all_verified", "any_unmapped",
        "applied_ids", "verified_ids", "snapshot_ids")


def committee_signal(trades, seats, mappings, securities) -> DataFrame:
    """Committee relevance for every distinct (politician, day, ticker) of the trades."""
    subjects = trades.select(*DAY, "ticker").distinct()
    return with_committee_signal(subjects, seats, mappings, securities)


def flags(context: DataFrame, cfg: ContextConfig = ContextConfig()) -> DataFrame:
    """Adds the counts and the flag. Unknown never counts as true."""
    secondary = secondary_count("trade_size_anomaly", "disclosure_delay_signal", "excess_return_signal")
    committee = is_true("committee_relevance")
    gate = (F.col("committee_temporal_status") == K.TEMPORALLY_VERIFIED) | F.lit(not cfg.require_temporal_verification)
    return (
        context.withColumn("secondary_signal_count", secondary)
        .withColumn("signal_count", F.col("secondary_signal_count") + committee.cast("int"))
        .withColumn("meets_flag_rule", committee & (F.col("secondary_signal_count") >= cfg.min_secondary_signals))
        .withColumn("flagged_for_contextual_review", F.col("meets_flag_rule") & gate)
        .withColumn("pending_temporal", F.col("meets_flag_rule") & ~F.col("flagged_for_contextual_review"))
    )


STORED = [
    "context_version", "mapping_version", "committee_relevance", "committee_relevance_reason",
    "committee_temporal_status", "committee_contradicted", "trade_size_anomaly", "disclosure_delay_signal",
    "excess_return_signal", "trade_size_value", "trade_size_basis", "trade_size_percentile", "trade_size_sample_size",
    "trade_size_median", "disclosure_delay_days", "performance_status", "security_return", "benchmark_return",
    "excess_return", "excess_return_direction_adjusted", "performance_anchor_date", "performance_horizon_days",
    "performance_through_date", "signal_count", "secondary_signal_count", "meets_flag_rule",
    "flagged_for_contextual_review", "pending_temporal", "pending_review", "direct", "related", "rejected",
]


def result_digest():
    """A hash of everything stored for a trade and everything its evidence quotes, so an unchanged result is recognised."""
    return F.sha2(F.to_json(F.struct(*STORED, "sic_code", "industry", "amount_min", "amount_max"), {"ignoreNullFields": "false"}), 256)


def select_trades(trades, politicians, ids=None, ticker=None, politician=None, limit=None) -> DataFrame:
    """The trades an analysis run is about. ``politician`` is an id or part of a name."""
    picked = trades
    if ids:
        picked = picked.filter(F.col("id").isin(list(ids)))
    if ticker:
        picked = picked.filter(F.col("ticker") == ticker.upper())
    if politician:
        if str(politician).isdigit():
            picked = picked.filter(F.col("politician_id") == int(politician))
        else:
            named = politicians.filter(F.col("name").ilike(f"%{politician}%"))
            picked = picked.join(named.select(F.col("id").alias("politician_id")), "politician_id", "left_semi")
    return picked.orderBy("id").limit(limit) if limit else picked


#: what an analysis reads of a trade
ANALYSED = ["id", "politician_id", "ticker", "transaction_type", "transaction_date", "disclosure_date", "amount_min", "amount_max"]


def analyze(tables, cfg: ContextConfig = ContextConfig(), today=None, **selectors) -> DataFrame:
    """One context row per selected trade.

    ``tables`` has trades, politicians, securities, seats, mappings, bars and benchmark. The size signal compares with
    every earlier trade of a politician, selected or not.
    """
    mappings = current_version(tables.mappings)
    sized = size_signal(tables.trades, today, cfg.size_percentile, cfg.min_history)
    picked = select_trades(sized, tables.politicians, **selectors)
    # sizes and seats are both dealt by politician, so the seats come before trades are dealt anew to meet the prices
    related = with_committee_signal(with_delay_signal(picked, today, cfg.delay_days), tables.seats, mappings, tables.securities)
    measured = excess_signal(
        related, tables.bars, tables.benchmark, today, cfg.excess_return, cfg.excess_horizon_days)
    version = mappings.agg(F.max("mapping_version").alias("mapping_version"))
    joined = measured.withColumns({
        "mapping_version": version.scalar(), "context_version": F.lit(cfg.version_label())})
    carried = ["politician_id", "ticker", "transaction_date", "amount_min", "amount_max", "sic_code", "industry"]
    return flags(joined, cfg).select(
        F.col("id").alias("trade_id"), *carried, *STORED, result_digest().alias("result_digest"))


def _money(c):
    return F.coalesce(F.concat(F.lit("$"), F.format_number(c, 0)), F.lit("n/a"))


def _sorted_json(**fields):
    return F.to_json(
        F.struct(*[c.alias(n) for n, c in sorted(fields.items())]), {"ignoreNullFields": "false"})


def context_evidence(context: DataFrame, mappings: DataFrame, cfg: ContextConfig = ContextConfig()) -> DataFrame:
    """Long table of evidence: one row per mapping that mattered and one per signal with a value."""
    key = ["trade_id", "context_version", "mapping_version"]
    return _mapping_evidence(context, mappings, key).unionByName(_metric_evidence(context, cfg, key), allowMissingColumns=True)


def _mapping_evidence(context, mappings, key):
    def tag(name, kind, label):
        return F.transform(F.col(name), lambda m: F.struct(
            F.lit(kind).alias("evidence_type"), F.lit(label).alias("label"), m["mapping_id"].alias("mapping_id"),
            (F.lit(K.CONTRADICTED) if name == "rejected" else m["status"]).alias("temporal_status")))

    tagged = [tag(name, *texts) for name, texts in K.EVIDENCE_KINDS.items()]
    rows = context.select(*key, "sic_code", "industry", F.explode(F.concat(*tagged)).alias("m")).select(
        *key, "sic_code", "industry", "m.*")
    described = rows.join(mappings.drop("mapping_version"), "mapping_id")
    where = F.concat_ws(" / ", "committee_name", "subcommittee_name")
    sic_range = F.format_string("%04d-%04d", "sic_start", "sic_end")
    timing = F.when(F.col("temporal_status") == K.CONTRADICTED, "").otherwise(
        F.format_string(K.SEAT_TIMING_TEXT, F.replace("temporal_status", F.lit("_"), F.lit(" "))))
    return described.select(
        *key, F.lit("committee_relevance").alias("signal_type"), "evidence_type",
        F.concat(F.lit("mapping:"), F.col("mapping_id").cast("string")).alias("evidence_key"),
        F.concat(F.format_string(K.MAPPING_TEXT, "label", where, sic_range, "rationale"), timing).alias("description"),
        "committee_code", "subcommittee_code", "mapping_id", "source_url",
        _sorted_json(
            committee_name=F.col("committee_name"), subcommittee_name=F.col("subcommittee_name"),
            scope=F.when(F.col("subcommittee_code").isNull(), "committee").otherwise("subcommittee"),
            sic_range=sic_range, level=F.col("relevance_level"), review_status=F.col("review_status"),
            jurisdiction_basis=F.col("jurisdiction_basis"), mapping_version=F.col("mapping_version"),
            source_citation=F.col("source_citation"), security_sic_code=F.col("sic_code"),
            security_industry=F.col("industry"), temporal_status=F.col("temporal_status"),
        ).alias("metadata"),
    )


def _metric_evidence(context, cfg, key):
    value = F.col("trade_size_value")
    sample = F.coalesce("trade_size_sample_size", F.lit(0))
    upper = F.when(F.col("amount_max").isNull(), "open-ended").otherwise(_money("amount_max"))
    basis = F.replace("trade_size_basis", F.lit("_"), F.lit(" "))
    ranked = F.format_string(K.SIZE_RANK_TEXT, F.bround("trade_size_percentile"), sample, _money("trade_size_median"))
    short = F.format_string(K.SIZE_SHORT_TEXT.format(min_history=cfg.min_history), sample)
    size_text = F.concat(
        F.format_string(K.SIZE_TEXT, _money(value), basis, _money("amount_min"), upper),
        F.when(F.col("trade_size_percentile").isNotNull(), ranked).otherwise(short))
    delay_text = F.format_string(K.DELAY_TEXT.format(delay_days=cfg.delay_days), "disclosure_delay_days")
    excess_text = F.format_string(
        K.EXCESS_TEXT.format(benchmark=cfg.benchmark, horizon=cfg.excess_horizon_days, points=f"{cfg.excess_return * 100:.0f}"),
        F.col("excess_return") * 100, F.col("performance_anchor_date").cast("string"),
        F.col("security_return") * 100, F.col("benchmark_return") * 100)

    def metric(signal, present, text, **fields):
        return F.when(present, F.struct(
            F.lit(signal).alias("signal_type"), F.lit("metric").alias("evidence_type"),
            F.lit("metric").alias("evidence_key"), text.alias("description"), _sorted_json(**fields).alias("metadata")))

    items = F.array(
        metric("trade_size_anomaly", value.isNotNull(), size_text, value=value, basis=F.col("trade_size_basis"),
               percentile=F.col("trade_size_percentile"), sample_size=F.col("trade_size_sample_size"),
               median=F.col("trade_size_median"), threshold_percentile=F.lit(cfg.size_percentile),
               min_history=F.lit(cfg.min_history)),
        metric("disclosure_delay_signal", F.col("disclosure_delay_days").isNotNull(), delay_text,
               days=F.col("disclosure_delay_days"), threshold_days=F.lit(cfg.delay_days)),
        metric("excess_return_signal", F.col("excess_return").isNotNull(), excess_text,
               security_return=F.col("security_return"), benchmark_return=F.col("benchmark_return"),
               excess_return=F.col("excess_return"), anchor_date=F.col("performance_anchor_date"),
               horizon_days=F.lit(cfg.excess_horizon_days),
               direction_adjusted_excess_return=F.col("excess_return_direction_adjusted"),
               threshold=F.lit(cfg.excess_return)),
    )
    return context.select(*key, F.explode(F.array_compact(items)).alias("e")).select(*key, "e.*")


def context_summary(context: DataFrame) -> DataFrame:
    """Counts over all context rows in long form (measure, item, trades)."""
    def tri(name):
        return F.when(F.col(name), "true").when(~F.col(name), "false").otherwise("unknown")

    relevant = is_true("committee_relevance")

    def level_item(name, wanted, sub):
        scope = F.filter("direct", lambda m: m["r_scope"] == (0 if sub else 1))
        test = F.size(scope) > 0
        if wanted == "verified":
            test = F.exists(scope, lambda m: m["status"] == K.TEMPORALLY_VERIFIED)
        return F.struct(F.lit(name).alias("measure"), F.when(relevant & test, "trades").alias("item"))

    sub_only = relevant & ~F.exists("direct", lambda m: m["r_scope"] == 1)

    def entry(measure, item):
        return F.struct(F.lit(measure).alias("measure"), item.cast("string").alias("item"))

    entries = F.array(
        entry("evaluated", F.lit("trades")),
        *[entry(s, tri(s)) for s in K.SIGNALS],
        entry("secondary_signals", F.col("secondary_signal_count")),
        entry("secondary_signals_committee", F.when(relevant, F.col("secondary_signal_count"))),
        entry("temporal_status", F.col("committee_temporal_status")),
        entry("temporal_status_committee", F.when(relevant, F.col("committee_temporal_status"))),
        entry("committee_unknown_reason", F.when(F.col("committee_relevance").isNull(), F.col("committee_relevance_reason"))),
        entry("flag", F.when(F.col("meets_flag_rule"), "meets_rule")),
        entry("flag", F.when(F.col("flagged_for_contextual_review"), "flagged")),
        entry("flag", F.when(F.col("pending_temporal"), "pending_temporal")),
        entry("contradicted", F.when(F.col("committee_contradicted"), "trades")),
        entry("needs_review_ignored", F.when(F.col("pending_review") > 0, "trades")),
        level_item("committee_level", "any", False), level_item("committee_level_verified", "verified", False),
        level_item("subcommittee_level", "any", True), level_item("subcommittee_level_verified", "verified", True),
        entry("subcommittee_only", F.when(sub_only, "trades")),
    )
    # contexts are counted per combination of all items first; only those few rows become long
    together = context.groupBy(entries.alias("entries")).agg(F.count("*").alias("n"))
    counted = together.select("n", F.explode("entries").alias("e")).filter("e.item IS NOT NULL").groupBy("e.measure", "e.item").agg(F.sum("n").alias("trades"))
    flagged = context.filter("flagged_for_contextual_review").agg(
        F.count_distinct("politician_id").alias("p"), F.count_distinct("ticker").alias("t"))
    distinct = flagged.select(F.explode(F.array(
        F.struct(F.lit("flagged_distinct").alias("measure"), F.lit("politicians").alias("item"), F.col("p").alias("trades")),
        F.struct(F.lit("flagged_distinct").alias("measure"), F.lit("tickers").alias("item"), F.col("t").alias("trades")),
    )).alias("e")).select("e.*")
    return counted.unionByName(distinct)


VERSION_KEY = ["trade_id", "context_version", "mapping_version"]


def current_context(rows: DataFrame, mappings: DataFrame | None = None, version=K.ENGINE_VERSION) -> DataFrame:
    """Stored context or evidence of the engine's own version and the newest mapping version; readers use no other rows.

    Without the mappings the newest mapping version is that of the rows themselves.
    """
    own = rows.filter(F.col("context_version") == version)
    newest = (own if mappings is None else mappings).agg(F.max("mapping_version"))
    return own.filter(F.col("mapping_version") == newest.scalar())


def context_actions(new: DataFrame, stored: DataFrame, force=False) -> DataFrame:
    """What a run does to each row, by key: inserted, updated, unchanged, or kept (not part of this run)."""
    old = stored.select(*VERSION_KEY, F.col("result_digest").alias("_old"))
    met = new.select(*VERSION_KEY, F.col("result_digest").alias("_new"), F.lit(True).alias("_run")).join(old, VERSION_KEY, "full_outer")
    changed = F.lit(force) | (F.col("_old") != F.col("_new"))
    action = F.when(F.col("_run").isNull(), "kept").when(F.col("_old").isNull(), "inserted").when(changed, "updated").otherwise("unchanged")
    return met.select(*VERSION_KEY, action.alias("action"))


def merge_context(new: DataFrame, stored: DataFrame, force=False) -> DataFrame:
    """All rows after a run with ``action``: inserted, updated, unchanged, or kept (not part of this run)."""
    stored = stored.drop("action")
    old = stored.select(*VERSION_KEY, F.col("result_digest").alias("_old"))
    changed = F.lit(force) | (F.col("_old") != F.col("result_digest"))
    action = F.when(F.col("_old").isNull(), "inserted").when(changed, "updated").otherwise("unchanged")
    fresh = new.join(old, VERSION_KEY, "left").withColumn("action", action).drop("_old")
    others = stored.join(new.select(*VERSION_KEY), VERSION_KEY, "left_anti").withColumn("action", F.lit("kept"))
    return fresh.unionByName(others, allowMissingColumns=True)
