"""Committee seats over time: events into dated seats, and what is established about a seat on a day.

Seat rows carry politician_id, committee_code, subcommittee_code, temporal_precision, congress_number, start_date,
end_date, verified_through and history_complete, as far as their source knows them.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.rules import congress_of, is_true

SEAT_KEY = ["bioguide_id", "committee_code", "congress"]


def seat_intervals(events: DataFrame, roster_seats=None, ambiguous=None, snapshot_date=None, snapshot_congress=None):
    """Dated seats from election and removal events (bioguide_id, committee_code, date, verb, url, seq).

    Events are first reduced to one row per member, committee and day; an election counts before a removal of the same
    day. What a day leaves open depends on that day alone, so a single look at the neighbouring days settles every
    interval, and a group never has more rows than a Congress has days.
    """
    elected, removed = F.col("verb") == "elected", F.col("verb") == "removed"
    days = (
        events.filter(elected | removed)
        .withColumn("congress", congress_of("date"))
        .groupBy(*SEAT_KEY, "date")
        .agg(F.count_if(elected).alias("elections"), F.count_if(removed).alias("removals"),
             F.max_by(F.when(elected, F.col("url")), F.when(elected, F.col("seq"))).alias("url"))
    )
    by_day = Window.partitionBy(*SEAT_KEY).orderBy("date")
    group = Window.partitionBy(*SEAT_KEY)
    leaves_open = F.col("removals") == 0
    was_open = F.coalesce(F.lag(leaves_open).over(by_day), F.lit(False))
    days = days.select("*", was_open.alias("was_open"), F.lag("date").over(by_day).alias("prev_date"),
                       F.lag("url").over(by_day).alias("prev_url"), F.lead("date").over(by_day).alias("next_date"))
    reelected = F.greatest(F.col("elections") - 1, F.lit(0)) + F.when((F.col("elections") > 0) & F.col("was_open"), 1).otherwise(0)
    can_close = F.when((F.col("elections") > 0) | F.col("was_open"), 1).otherwise(0)
    orphaned = F.greatest(F.col("removals") - can_close, F.lit(0))
    days = days.select(
        "*", F.sum(reelected).over(group).alias("re_elections"), F.sum(orphaned).over(group).alias("orphan_removals"))
    closes_here = (F.col("removals") > 0) & (can_close == 1)
    starts_today = F.col("elections") > 0
    stays_open = leaves_open & F.col("next_date").isNull()
    spans = days.filter(closes_here | stays_open).select(
        *SEAT_KEY,
        F.when(starts_today, F.col("date")).otherwise(F.col("prev_date")).alias("start_date"),
        F.when(closes_here, F.col("date")).alias("end_date"),
        F.when(starts_today, F.col("url")).otherwise(F.col("prev_url")).alias("url"),
        "re_elections", "orphan_removals",
    )
    if ambiguous is None:
        spans = spans.withColumn("_doubt", F.lit(False))
    else:
        spans = spans.join(
            ambiguous.select("bioguide_id").distinct().withColumn("_doubt", F.lit(True)), "bioguide_id", "left")
    spans = spans.withColumn(
        "history_complete",
        ~is_true("_doubt") & (F.col("re_elections") == 0) & (F.col("orphan_removals") == 0)).drop("_doubt")
    if roster_seats is None or snapshot_date is None:
        return spans.withColumn("verified_through", F.lit(None).cast("date"))
    listed = roster_seats.select("bioguide_id", "committee_code").distinct().withColumn("_listed", F.lit(True))
    confirmed = F.col("end_date").isNull() & (F.col("congress") == snapshot_congress) & F.col("_listed")
    return (
        spans.join(listed, ["bioguide_id", "committee_code"], "left")
        .withColumn("verified_through", F.when(confirmed, F.lit(str(snapshot_date)).cast("date")))
        .drop("_listed")
    )


def covers(d, at=F.col) -> Column:
    """Is a seat established on a day? An open seat is confirmed only up to ``verified_through``. ``at`` gives a seat's columns."""
    d = F.col(d) if isinstance(d, str) else d
    exact = at("temporal_precision") == K.PRECISION_EXACT
    last = F.coalesce(at("end_date"), at("verified_through"))
    return F.coalesce(
        F.when(at("temporal_precision") == K.PRECISION_CONGRESS, at("congress_number") == congress_of(d))
        .when(exact, (d >= at("start_date")) & (d <= last)),
        F.lit(False),
    )


def seats_on_date(trades: DataFrame, seats: DataFrame) -> DataFrame:
    """Distinct (politician, day) of the trades with the dated seats held that day."""
    days = trades.select("politician_id", "transaction_date").distinct()
    return days.join(seats, "politician_id").filter(covers("transaction_date"))


def held_seats(seats: DataFrame) -> DataFrame:
    """One row per politician with ``_held``, their seats and what of them no day changes; the seats of one person are few.

    All people's seats together are not: their size, which no file tells, must not make every task hold them.
    """
    is_exact = is_true(F.col("temporal_precision") == K.PRECISION_EXACT)
    is_congress = is_true(F.col("temporal_precision") == K.PRECISION_CONGRESS)
    no_sub = F.coalesce("subcommittee_code", F.lit("")) == ""
    known = {
        "is_snapshot": is_true(F.col("temporal_precision") == K.PRECISION_SNAPSHOT), "_is_dated": is_exact | is_congress, "_no_sub": no_sub,
        "_complete": is_true("history_complete"), "_scans": is_exact & is_true("history_complete"),
        "_starts": is_exact & no_sub & F.col("start_date").isNotNull(), "_whole": is_congress & no_sub,
    }
    return seats.withColumns(known).groupBy("politician_id").agg(
        F.collect_list(F.struct(*[c for c in seats.columns if c != "politician_id"], *known)).alias("_held")).hint("merge")


def with_standing(days: DataFrame) -> DataFrame:
    """Turns ``_held`` into ``_stands``: the same seats with what the record says about them on the row's day.

    ``history_status`` is verified, contradicted or unknown for the committee; ``applies`` and ``seat_status`` tell
    whether the seat counts and how well it is established. A committee the record contradicts is dropped together with
    its subcommittees. Subcommittee seats have no dated history, so they are never better than current_assignment_only.

    All is decided within the row, from the few seats of one person.
    """
    fields = [f.name for f in days.schema["_held"].dataType.elementType.fields]
    own = [c for c in fields if not c.startswith("_")]
    flags = ["_is_dated", "_no_sub", "_covers"]

    def judged(s):
        d = F.col("transaction_date")
        sitting = is_true(s["congress_number"] == F.col("_congress"))
        more = {
            "_covers": covers(d, lambda c: s[c]), "_scan": s["_scans"] & sitting, "_exact": s["_starts"] & sitting,
            "_dated": s["_is_dated"] & s["_no_sub"] & sitting, "_by_congress": s["_whole"] & sitting,
            "_absent": ((d < s["start_date"]) | is_true(d > s["end_date"])) & s["_complete"],
        }
        return F.struct(*[s[c].alias(c) for c in (*own, *flags[:2])], *[c.alias(n) for n, c in more.items()])

    seen = days.withColumn("_congress", congress_of("transaction_date")).withColumn("_held", F.transform("_held", judged))
    seen = seen.withColumn("_other_scanned", F.expr(
        "exists(_held, s -> s._scan) AND coalesce(array_max(transform(filter(_held, s -> s.is_snapshot), s -> s.congress_number)) <> _congress, false)"))

    def on_committee(s, test):
        return F.exists("_held", lambda x: x["committee_code"].eqNullSafe(s["committee_code"]) & F.coalesce(test(x), F.lit(False)))

    def status(s):
        return (
            F.when(~on_committee(s, lambda x: x["_dated"]), F.when(F.col("_other_scanned"), "contradicted").otherwise("unknown"))
            .when(on_committee(s, lambda x: x["_exact"] & x["_covers"]), "verified")
            .when(on_committee(s, lambda x: x["_exact"] & x["_absent"]) & ~on_committee(s, lambda x: x["_exact"] & ~x["_absent"]), "contradicted")
            .when(on_committee(s, lambda x: x["_by_congress"]), "verified")
            .otherwise("unknown")
        )

    seen = seen.withColumn("_held", F.transform("_held", lambda s: F.struct(*[s[c].alias(c) for c in (*own, *flags)], status(s).alias("history_status"))))

    def stands(s):
        applies = (s["history_status"] != "contradicted") & (~s["_is_dated"] | s["_covers"])
        standing = F.when(s["_is_dated"] | (s["_no_sub"] & (s["history_status"] == "verified")), K.TEMPORALLY_VERIFIED).otherwise(K.CURRENT_ASSIGNMENT_ONLY)
        return F.struct(*[s[c].alias(c) for c in own], s["history_status"].alias("history_status"),
                        applies.alias("applies"), F.when(applies, standing).alias("seat_status"))

    return seen.withColumn("_stands", F.transform("_held", stands)).drop("_held", "_congress", "_other_scanned")


def seat_days(days: DataFrame, seats: DataFrame) -> DataFrame:
    """Every seat of a politician for each distinct day, as :func:`with_standing` judges it.

    Days are made distinct first: a politician with very many trades costs no more than the calendar has days times the
    few seats of one person.
    """
    distinct = days.select("politician_id", "transaction_date").distinct()
    stands = with_standing(distinct.join(held_seats(seats), "politician_id"))
    # nobody's list is empty; an inner explode would test its size first, with the whole list worked out once more
    return stands.select("politician_id", "transaction_date", F.explode_outer("_stands").alias("_s")).select("politician_id", "transaction_date", "_s.*")


def committee_history_status(days: DataFrame, seats: DataFrame) -> DataFrame:
    """verified, contradicted or unknown for every (politician, day, committee the politician ever sat on)."""
    return seat_days(days, seats).groupBy("politician_id", "transaction_date", "committee_code").agg(
        F.first("history_status").alias("history_status"))


def effective_seats(days: DataFrame, seats: DataFrame) -> DataFrame:
    return seat_days(days, seats).filter("applies").drop("applies", "is_snapshot", "history_status")


def sync_seat_history(intervals, politicians, seats, committees, congress, snapshot_date=None, snapshot_congress=None,
                      relevant=None) -> DataFrame:
    """Replace the dated seats of one Congress for the politicians in scope; annotate the snapshot rows.

    ``relevant`` narrows the scope to politicians with a committee-relevant trade; without it everyone with an
    official id is in scope.
    """
    scope = politicians.filter("bioguide_id IS NOT NULL").select(F.col("id").alias("politician_id"), "bioguide_id")
    if relevant is not None:
        scope = scope.join(relevant.select("politician_id").distinct(), "politician_id", "left_semi")
    replaced = scope.select("politician_id").withColumns({
        "source": F.lit(K.HISTORY_SOURCE), "congress_number": F.lit(congress)})
    kept = seats.join(replaced, ["politician_id", "source", "congress_number"], "left_anti").select(*seats.columns)
    if snapshot_date is not None:
        is_snapshot = is_true((F.col("temporal_precision") == K.PRECISION_SNAPSHOT) & (F.col("source") == K.ROSTER_SOURCE))
        kept = kept.withColumns({
            "congress_number": F.when(is_snapshot, F.lit(snapshot_congress)).otherwise(F.col("congress_number")),
            "verified_through": F.when(is_snapshot, F.lit(str(snapshot_date)).cast("date"))
            .otherwise(F.col("verified_through")),
        })
    fresh = (
        intervals.filter(F.col("congress") == congress).join(scope, "bioguide_id")
        .join(committees.select("committee_code", "committee_name"), "committee_code", "left")
        .select(
            "politician_id", "committee_code", "committee_name", F.lit(None).cast("string").alias("subcommittee_code"),
            F.lit(None).cast("string").alias("subcommittee_name"), F.lit("Member").alias("role"),
            F.lit("house").alias("chamber"), F.lit(K.HISTORY_SOURCE).alias("source"), F.col("url").alias("source_url"),
            F.col("congress").alias("congress_number"), F.lit(K.PRECISION_EXACT).alias("temporal_precision"),
            "start_date", "end_date", "verified_through", "history_complete",
        )
    )
    return kept.unionByName(fresh, allowMissingColumns=True)
