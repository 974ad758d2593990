"""Matching people to an official roster and tickers to a registrant list. Anything unclear is set aside, not guessed."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import is_true, sic_division
from ..functions.text import empty_to_null, name_words, normalize_name, without_suffix


def _name_parts(politicians: DataFrame) -> DataFrame:
    """Adds the words of a politician's name without middle initials, and the first initial left out."""
    return politicians.withColumn("_t", without_suffix(name_words(normalize_name("name")))).withColumns({
        "_words": F.regexp_replace("_t", r"(?<=\S )\S (?=\S)", ""),
        "_initial": empty_to_null(F.regexp_extract("_t", r" (\S) ", 1)),
    }).drop("_t")


def _surname(words):
    return F.regexp_extract(words, r"(\S+)$", 1)


def _roster_parts(roster: DataFrame) -> DataFrame:
    return roster.withColumns({
        "_first": name_words("first_name"), "_last": name_words("last_name"),
        "_middle": name_words(F.coalesce("middle_name", F.lit(""))),
    }).withColumn("_m_initial", empty_to_null(F.substring("_middle", 1, 1)))


def _spellings(roster: DataFrame) -> DataFrame:
    """The word sequences an official entry may be matched under; one row per entry and spelling."""
    long_middle = F.trim(F.regexp_replace(F.concat(F.lit(" "), "_middle", F.lit(" ")), r"(?<= )\S (?=\S|$)", ""))
    spellings = F.array(
        F.concat_ws(" ", "_first", empty_to_null(F.col("_long")), "_last"), F.concat_ws(" ", "_first", "_last"))
    if "aliases" in roster.columns:
        aliases = F.transform(
            F.coalesce("aliases", F.array().cast("array<string>")), lambda a: without_suffix(name_words(a)))
        spellings = F.concat(spellings, aliases)
    return roster.withColumn("_long", long_middle).select(
        "bioguide_id", "chamber", F.col("state").alias("r_state"), "_m_initial",
        F.explode(F.array_distinct(spellings)).alias("spelling"))


ANY = "*"


def _offered(officials: DataFrame, keys, wild) -> DataFrame:
    """Officials counted per key and per value of the ``wild`` columns, once with the value and once with any.

    A blank value on either side of a wild column fits everything. With the totals at hand a person asks for at most
    two values of each, so a very common name costs a person a handful of rows however many officials bear it.
    """
    out = officials
    for c in wild:
        out = out.withColumn(c, F.explode(F.array(F.coalesce(c, F.lit("")), F.lit(ANY))))
    return out.groupBy(*keys, *wild).agg(
        F.count_distinct("bioguide_id").alias("_n"), F.min("bioguide_id").alias("_id"))


def _asked(people: DataFrame, wild) -> DataFrame:
    out = people
    for c in wild:
        given = F.coalesce(c, F.lit(""))
        out = out.withColumn(c, F.explode(F.when(given != "", F.array(given, F.lit(""))).otherwise(F.array(F.lit(ANY)))))
    return out


def _candidates(people, officials, keys, wild, rule) -> DataFrame:
    """(id, rule, candidates, bioguide_id) for people whose keys meet any official."""
    found = _asked(people, wild).join(_offered(officials, keys, wild), [*keys, *wild]).groupBy("id").agg(
        F.sum("_n").alias("candidates"), F.min("_id").alias("_id"))
    return found.select("id", F.lit(rule).alias("rule"), "candidates",
                        F.when(F.col("candidates") == 1, F.col("_id")).alias("bioguide_id"))


def name_candidates(politicians: DataFrame, roster: DataFrame) -> DataFrame:
    """(id, rule, candidates, bioguide_id): how many officials fit each politician's name, strict rule before loose."""
    people = _name_parts(politicians.withColumn("state", F.upper("state")))
    officials = _roster_parts(roster)
    strict = _candidates(
        people.select("id", "chamber", "state", F.col("_words").alias("spelling"), F.col("_initial").alias("initial")),
        _spellings(officials).withColumnsRenamed({"r_state": "state", "_m_initial": "initial"}),
        ["chamber", "spelling"], ["state", "initial"], "exact_name")

    # people without a strict match: a longer name around the same first and last words
    rest = people.join(strict.select("id"), "id", "left_anti").select(
        "id", "chamber", "state", F.split("_words", " ").alias("_w"))
    cuts = F.expr(
        "flatten(transform(sequence(1, size(_w) - 2), a -> transform(sequence(1, size(_w) - a - 1), b -> struct(a, b))))")
    split = rest.filter(F.size("_w") > 2).withColumn("_cut", F.explode(cuts)).select(
        "id", "chamber", "state",
        F.expr("array_join(slice(_w, 1, _cut.a), ' ')").alias("first"),
        F.expr("array_join(slice(_w, size(_w) - _cut.b + 1, _cut.b), ' ')").alias("last"),
        F.expr("array_join(slice(_w, _cut.a + 1, size(_w) - _cut.a - _cut.b), ' ')").alias("extra"))
    # the official may have no middle name, abbreviate it to a letter, or have exactly the same one
    wants = split.withColumn("middle", F.explode(F.array(
        F.lit(""), F.concat(F.lit("letter "), F.substring("extra", 1, 1)), F.concat(F.lit("name "), "extra")))).drop("extra")
    has = officials.select(
        "bioguide_id", "chamber", "state", F.col("_first").alias("first"), F.col("_last").alias("last"),
        F.when(F.col("_middle") == "", "").when(F.col("_middle").rlike(r"^\S( |$)"), F.concat(F.lit("letter "), "_m_initial"))
        .otherwise(F.concat(F.lit("name "), "_middle")).alias("middle"))
    loose = _candidates(wants, has, ["chamber", "first", "last", "middle"], ["state"], "name_with_extra_middle")
    return strict.unionByName(loose)


def match_politicians(politicians: DataFrame, roster: DataFrame) -> DataFrame:
    """matched, ambiguous or unmatched for every politician, with the rule; unmatched ones get same-surname officials."""
    found = name_candidates(politicians, roster)
    surnames = (
        _roster_parts(roster).withColumn("surname", _surname("_last"))
        .groupBy("chamber", "surname").agg(F.count("*").alias("_near"), F.min("bioguide_id").alias("_near_first"))
    )
    people = _name_parts(politicians.select("id", "name", "chamber", "state")).withColumn("surname", _surname("_words"))
    matched = F.col("candidates") == 1
    status = F.when(matched, "matched").when(F.col("candidates") > 1, "ambiguous").otherwise("unmatched")
    unmatched = F.col("status") == "unmatched"
    return (
        people.join(found, "id", "left").join(surnames, ["chamber", "surname"], "left")
        .withColumn("status", status)
        .select(
            "id", "name", "chamber", "state", "status",
            F.when(F.col("status") == "matched", F.concat("rule", F.lit("+chamber"))).alias("method"),
            "bioguide_id",
            F.when(unmatched, F.coalesce("_near", F.lit(0))).alias("same_surname"),
            F.when(unmatched, F.col("_near_first")).alias("same_surname_first"),
        )
    )


def due_politicians(politicians, now, overrides=None, suggested=None, stale_days=30, retry_days=7, force=False):
    """Adds ``due_reason``: override, suggestion, current, recent_attempt or due. The first two jump the queue.

    ``suggested`` are the politicians a suggestion run has already seen; pass it to make such a run reach the others.
    """
    now = F.lit(str(now)).cast("timestamp_ntz")
    out = politicians
    for name, other in (("_override", overrides), ("_seen", suggested)):
        if other is None:
            out = out.withColumn(name, F.lit(name == "_seen"))
        else:
            ids = other.select(F.col("politician_id").alias("id")).filter("id IS NOT NULL").distinct()
            out = out.join(ids.withColumn(name, F.lit(True)), "id", "left").withColumn(name, is_true(name))
    matched = F.col("enrichment_status").eqNullSafe("matched")

    def younger(column, days):
        return is_true(F.col(column) > now - F.make_dt_interval(F.lit(days)))

    reason = (
        F.when(F.col("_override") & ~matched, "override")
        .when(~F.col("_seen") & F.col("enrichment_status").eqNullSafe("unmatched"), "suggestion")
        .when(F.lit(not force) & matched & younger("enriched_at", stale_days), "current")
        .when(F.lit(not force) & ~matched & younger("enrichment_checked_at", retry_days), "recent_attempt")
        .otherwise("due")
    )
    return out.withColumn("due_reason", reason).drop("_override", "_seen")


def resolve_overrides(unmatched, overrides, roster) -> DataFrame:
    """Reviewed links for unmatched people, checked against the roster: matched or conflict with the reason."""
    official = roster.select("bioguide_id", F.col("chamber").alias("r_chamber"), F.col("state").alias("r_state"))
    known = F.coalesce("state", F.lit("")) != ""
    note = (
        F.when(F.col("r_chamber").isNull(), "not in the official roster")
        .when(F.col("r_chamber") != F.col("chamber"), "other chamber")
        .when(known & (F.col("r_state") != F.col("state")), "other state")
    )
    return (
        unmatched.select("id", "name", "chamber", "state")
        .join(overrides.select(F.col("politician_id").alias("id"), "bioguide_id"), "id")
        .join(official, "bioguide_id", "left")
        .withColumn("note", note)
        .select("id", "bioguide_id", F.when(F.col("note").isNull(), "matched").otherwise("conflict").alias("status"), "note")
    )


def ownership_conflicts(matches: DataFrame, politicians: DataFrame) -> DataFrame:
    """Matches (id, bioguide_id) with a verdict: an official id belongs to one politician only.

    An id already stored stays with its owner. Of several new claims the lowest politician id wins, unless that
    politician is itself barred by a different stored id. The winner is an aggregate, so an id claimed very often is
    not gathered.
    """
    stored = politicians.filter("bioguide_id IS NOT NULL")
    owners = stored.groupBy("bioguide_id").agg(F.max("id").alias("owner"))
    own = stored.select("id", F.col("bioguide_id").alias("own_id"))
    claims = matches.filter("bioguide_id IS NOT NULL").select("id", "bioguide_id").join(own, "id", "left").join(
        owners, "bioguide_id", "left")
    barred = is_true(F.col("own_id") != F.col("bioguide_id"))
    winners = claims.filter(F.col("owner").isNull() & ~barred).groupBy("bioguide_id").agg(F.min("id").alias("winner"))
    taken = F.coalesce("owner", F.when(F.col("winner") < F.col("id"), F.col("winner")))
    note = F.when(is_true(taken != F.col("id")), "belongs to another politician").when(barred, "linked to another official")
    return claims.join(winners, "bioguide_id", "left").withColumn("note", note).select(
        "id", "bioguide_id", F.when(F.col("note").isNull(), "matched").otherwise("conflict").alias("status"), "note")


def apply_matches(politicians, verdicts, roster, now, method="method") -> DataFrame:
    """Write matched officials into the politician dimension; an earlier verified match is never downgraded."""
    official = roster.select(
        "bioguide_id", *[F.col(c).alias(f"r_{c}") for c in
                         ("party", "state", "district", "official_url", "active", "term_start_year", "term_end_year")])
    seen = verdicts.select(
        "id", F.col("bioguide_id").alias("v_id"), F.col("status").alias("v_status"), F.col("note").alias("v_note"),
        F.col(method).alias("v_method")).join(official.withColumnRenamed("bioguide_id", "v_id"), "v_id", "left")
    matched = F.col("v_status").eqNullSafe("matched")
    tried = F.col("v_status").isNotNull()
    keep = F.col("enrichment_status").eqNullSafe("matched")
    stamp = F.lit(str(now)).cast("timestamp_ntz")

    def filled(column):
        return F.when(matched, F.coalesce(f"r_{column}", column)).otherwise(F.col(column))

    def replaced(column):
        return F.when(matched, F.col(f"r_{column}")).otherwise(F.col(column))

    return politicians.join(seen, "id", "left").withColumns({
        "bioguide_id": F.when(matched, F.col("v_id")).otherwise(F.col("bioguide_id")),
        "party": filled("party"), "state": filled("state"),
        **{c: replaced(c) for c in ("district", "official_url", "active", "term_start_year", "term_end_year")},
        "enriched_at": F.when(matched, stamp).otherwise(F.col("enriched_at")),
        "enrichment_checked_at": F.when(tried, stamp).otherwise(F.col("enrichment_checked_at")),
        "enrichment_method": F.when(matched, F.col("v_method")).otherwise(F.col("enrichment_method")),
        "enrichment_note": F.when(matched, F.lit(None)).when(tried & ~keep, F.col("v_note")).otherwise(F.col("enrichment_note")),
        "enrichment_status": F.when(tried & (matched | ~keep), F.col("v_status")).otherwise(F.col("enrichment_status")),
    }).select(*politicians.columns)


def refresh_seats(matched: DataFrame, roster_seats: DataFrame, seats: DataFrame, source) -> DataFrame:
    """Replace the seats of the matched politicians that came from ``source``."""
    holders = matched.select(F.col("id").alias("politician_id"), "bioguide_id")
    replaced = holders.select("politician_id").withColumn("source", F.lit(source))
    kept = seats.join(replaced, ["politician_id", "source"], "left_anti").select(*seats.columns)
    fresh = roster_seats.join(holders, "bioguide_id").drop("bioguide_id").withColumn("source", F.lit(source))
    return kept.unionByName(fresh, allowMissingColumns=True)


def gate_suggestions(suggestions, politicians, roster, min_confidence=0.9, auto_accept=False) -> DataFrame:
    """Every suggestion with its outcome and, when rejected, the first test it failed.

    The candidates of a suggestion are the officials of the politician's chamber with the same surname. They are reduced
    to counts per (chamber, surname, state, district); no list of candidates is ever built.
    """
    officials = roster.select(
        "bioguide_id", F.col("chamber").alias("r_chamber"), F.col("state").alias("r_state"),
        F.col("district").alias("r_district"), _surname(name_words("last_name")).alias("r_surname"))
    people = _name_parts(politicians).select("id", "chamber", "state", "district", _surname("_words").alias("surname"))
    asked = suggestions.join(people.withColumnRenamed("id", "politician_id"), "politician_id")

    def differs(mine, official):
        return is_true((F.col(mine) != "") & (F.col(official) != "") & (F.col(mine) != F.col(official)))

    off_state = differs("state", "r_state")
    off_district = differs("district", "r_district") & (F.col("r_chamber") == "house")
    offered = officials.select(
        "bioguide_id", F.col("r_chamber").alias("chamber"), F.col("r_surname").alias("surname"), F.col("r_state").alias("state"),
        F.when(F.col("r_chamber") == "house", F.col("r_district")).alias("district"))
    by_group = _candidates(people, offered, ["chamber", "surname"], ["state", "district"], "surname").select(
        F.col("id").alias("politician_id"), F.col("candidates").alias("valid"), F.col("bioguide_id").alias("only_valid"))
    chosen = officials.withColumnRenamed("bioguide_id", "selected_bioguide_id")
    owners = politicians.filter("bioguide_id IS NOT NULL").groupBy(
        F.col("bioguide_id").alias("selected_bioguide_id")).agg(F.max("id").alias("owner"))
    joined = (
        asked.join(by_group, "politician_id", "left").join(chosen, "selected_bioguide_id", "left")
        .join(owners, "selected_bioguide_id", "left")
    )
    shown = is_true((F.col("r_chamber") == F.col("chamber")) & (F.col("r_surname") == F.col("surname")))
    another = is_true(F.exists(
        F.coalesce("alternates", F.array().cast("array<string>")),
        lambda a: (a != F.col("selected_bioguide_id")) & (a == F.col("only_valid"))))
    reason = (
        F.when(F.coalesce("valid", F.lit(0)) != 1, "not exactly one valid candidate")
        .when(F.col("selected_bioguide_id").isNull(), "nothing selected")
        .when(F.col("r_chamber").isNull(), "not in the official roster")
        .when(F.col("r_chamber") != F.col("chamber"), "other chamber")
        .when(off_state, "other state")
        .when(off_district, "other district")
        .when(~shown, "not a candidate that was shown")
        .when(F.col("selected_bioguide_id") != F.col("only_valid"), "not the valid candidate")
        .when(is_true(F.col("owner") != F.col("politician_id")), "belongs to another politician")
        .when(another, "another valid candidate is named")
        .when(F.col("confidence").isNull() | (F.col("confidence") < min_confidence), "confidence too low")
    )
    outcome = F.when(F.col("reason").isNotNull(), "rejected").otherwise("accepted" if auto_accept else "review")
    return joined.withColumn("reason", reason).withColumn("outcome", outcome).select(
        *suggestions.columns, "outcome", "reason")


def review_queue(politicians, suggestions) -> DataFrame:
    """Politicians that are still unresolved, with the latest suggestion about them."""
    open_cases = politicians.filter("enrichment_status IS NOT NULL AND enrichment_status <> 'matched'")
    fields = ["selected_bioguide_id", "confidence", "outcome", "reason"]
    latest = suggestions.groupBy(F.col("politician_id").alias("id")).agg(
        F.max_by(F.struct(*fields), "suggestion_id").alias("s"))
    return open_cases.join(latest, "id", "left").select(
        "id", "name", "chamber", "enrichment_status", *[F.col(f"s.{f}").alias(f"suggestion_{f}") for f in fields])


def ticker_lookup(securities: DataFrame, primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """(ticker, ciks, cik, list_name, list_exchange) from the first spelling that any list knows.

    Spellings are the ticker as given, then with dot and hyphen exchanged; the full list counts before the plain one.
    """
    listed = primary.withColumn("ticker", F.upper(F.trim("ticker"))).filter("ticker <> '' AND cik IS NOT NULL").withColumn(
        "cik", F.col("cik").try_cast("long")).filter("cik IS NOT NULL")
    plain = fallback.withColumn("ticker", F.upper(F.trim("ticker"))).withColumn(
        "cik", F.col("cik").try_cast("long")).filter("cik IS NOT NULL")

    def summed(df, order, name, exchange):
        return df.groupBy(F.col("ticker").alias("variant")).agg(
            F.count_distinct("cik").alias("ciks"), F.min("cik").alias("cik"),
            name.alias("list_name"), exchange.alias("list_exchange")).withColumn("source", F.lit(order))

    known = summed(listed, 0, F.min_by("name", "position"), F.min_by("exchange", "position")).unionByName(
        summed(plain, 1, F.lit(None).cast("string"), F.lit(None).cast("string")))
    t = F.upper(F.trim("ticker"))
    variants = F.array_distinct(F.array(t, F.replace(t, F.lit("."), F.lit("-")), F.replace(t, F.lit("-"), F.lit("."))))
    asked = securities.select("ticker", F.posexplode(variants).alias("position", "variant"))
    return (
        asked.join(known, "variant").groupBy("ticker").agg(
            F.min_by(F.struct("ciks", "cik", "list_name", "list_exchange"), F.struct("position", "source")).alias("f"))
        .select("ticker", "f.*")
    )


def due_securities(securities, trades, now, stale_days=90, retry_days=30, force=False) -> DataFrame:
    """Traded securities with ``due_reason`` current, recent_attempt or due."""
    stamp = F.lit(str(now)).cast("timestamp_ntz")

    def younger(days):
        return is_true(F.col("profile_checked_at") > stamp - F.make_dt_interval(F.lit(days)))

    known, unresolved = is_true(F.col("profile_status").isin("ok", "partial")), is_true(F.col("profile_status") == "unresolved")
    reason = (
        F.when(F.lit(not force) & known & younger(stale_days), "current")
        .when(F.lit(not force) & unresolved & younger(retry_days), "recent_attempt").otherwise("due")
    )
    return securities.join(trades.select("ticker").distinct(), "ticker", "left_semi").withColumn("due_reason", reason)


def resolve_profiles(securities, primary, fallback, submissions, now) -> DataFrame:
    """Securities with company data from the registrant records: ok, partial (no code) or unresolved.

    One ticker under several registrants is never decided. A profile verified earlier is kept when the lookup fails.
    """
    found = ticker_lookup(securities, primary, fallback)
    records = submissions.select(
        F.col("cik").try_cast("long").alias("cik"), F.col("name").alias("s_name"), F.col("sic").cast("string").alias("s_sic"),
        F.col("sic_description").alias("s_industry"), F.col("exchanges").alias("s_exchanges"),
        F.lit(True).alias("_record"))
    single = F.col("ciks").eqNullSafe(1)
    sic_text = F.trim(F.coalesce("s_sic", F.lit("")))
    sic = F.when(sic_text.rlike(r"^\d+$") & ~sic_text.rlike("^0+$"), F.lpad(sic_text, F.greatest(F.length(sic_text), F.lit(4)), "0"))
    first_exchange = F.get(F.filter(F.coalesce("s_exchanges", F.array().cast("array<string>")),
                                    lambda e: is_true(F.trim(e) != "")), F.lit(0))
    was_known = is_true(F.col("profile_status").isin("ok", "partial"))
    joined = securities.join(found, "ticker", "left").join(records, "cik", "left").withColumn("_sic", sic)
    # a registrant whose record could not be read is left as it was, so the next run asks again
    joined = joined.withColumn("_hit", single & is_true("_record")).withColumn("_unread", single & ~is_true("_record"))

    def updated(new, old):
        return F.when(F.col("_hit"), new).otherwise(F.col(old))

    return joined.select(
        "ticker",
        updated(empty_to_null(F.trim(F.coalesce("s_name", "list_name"))), "company_name").alias("company_name"),
        updated(F.lpad(F.col("cik").cast("string"), 10, "0"), "cik_code").alias("cik_code"),
        updated(F.col("_sic"), "sic_code").alias("sic_code"),
        updated(F.when(F.col("_sic").isNotNull(), empty_to_null(F.trim("s_industry"))), "industry").alias("industry"),
        updated(sic_division("_sic"), "sector").alias("sector"),
        updated(F.coalesce("list_exchange", first_exchange), "exchange").alias("exchange"),
        F.when(F.col("_hit"), F.when(F.col("_sic").isNotNull(), "ok").otherwise("partial"))
        .when(was_known | F.col("_unread"), F.col("profile_status")).otherwise("unresolved").alias("profile_status"),
        F.when(F.col("_hit") & F.col("_sic").isNotNull(), F.lit(None).cast("string"))
        .when(F.col("_hit"), "no industry code is published for this company")
        .when(F.col("_unread"), "company record not read")
        .when(was_known, "not found in the latest list; earlier profile kept")
        .when(F.col("ciks") > 1, "listed under several registrants").otherwise("not listed").alias("profile_note"),
        F.when(F.col("_unread"), F.col("profile_checked_at")).otherwise(F.lit(str(now)).cast("timestamp_ntz"))
        .alias("profile_checked_at"),
    )

