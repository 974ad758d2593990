"""Adopted committee resolutions: which member was elected to or removed from which committee, and when."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.rules import congress_of, is_true, spread_null
from ..functions.text import once

# from a heading to the end of the next text; what closes a paragraph in between belongs to neither
BLOCK = r"(?s)<header\b.*?</text>"
LAST_HEADER = r"(?s)^.*(?=<header\b)"
PARAGRAPH_END = r"</(?:committee-appointment-)?paragraph>"


def _plain(c):
    text = F.regexp_replace(c, r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#x2019;", "’"), ("&#8217;", "’")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(once(text, _numbered), r"\s+", " "))


def _numbered(text):
    """References by number are rare: only a text that has one is read as XML once more."""
    shielded = F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    decoded = F.from_xml(F.concat(F.lit("<r><t>"), shielded, F.lit("</t></r>")), "t string")["t"]
    return F.replace(F.when(text.contains("&#"), F.coalesce(decoded, text)).otherwise(text), F.lit("&amp;"), F.lit("&"))


def _letters(c):
    return F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("-"), F.lit(" ")), "[^a-z ]+", ""))


def _committee_words(c):
    named = F.replace(F.replace(F.replace(c, F.lit("’"), F.lit("'")), F.lit("Committee on "), F.lit("")), F.lit("the "), F.lit(""))
    return _letters(named)


def _documents(documents: DataFrame) -> DataFrame:
    """(label, url, date, verb, body, whole): what a document says as a whole, and whether its XML is complete."""
    body = F.regexp_extract("xml", r"(?s)<resolution-body\b[^>]*>(.*)</resolution-body>", 1)
    adopted = F.regexp_extract(F.regexp_replace(F.regexp_replace("xml", r"<[^>]*>", " "), r"\s+", " "), K.ADOPTED_PATTERN, 1)
    clauses = F.regexp_extract_all(body, F.lit(r"(?s)<text\b[^>]*>(.*?)</text>"), F.lit(1))
    spoken = F.filter(clauses, lambda t: F.lower(t).contains("committee"))
    # the verb that comes first, wherever in the clauses it stands
    found = F.regexp_extract(F.lower(_plain(F.array_join(spoken, " "))), "elected|removed", 0)
    verb = F.nullif(found, F.lit(""))
    whole = F.from_xml(F.col("xml"), "broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})["broken"].isNull()
    # the generator keeps the optimizer from repeating the work on the document in every condition on its outcome
    parts = F.struct(adopted.alias("adopted"), body.alias("body"), verb.alias("verb"), whole.alias("whole"))
    return documents.select("label", "url", F.explode(F.array(parts)).alias("d")).select(
        "label", "url", F.try_to_date("d.adopted", "MMMM d, yyyy").alias("date"),
        "d.verb", "d.body", "d.whole")


def unread_documents(documents: DataFrame) -> DataFrame:
    """(label, url, reason) of the documents that give no paragraph."""
    reason = F.when(~F.col("whole"), "broken XML").when(F.col("date").isNull(), "no date of adoption").when(F.col("verb").isNull(), "neither elects nor removes")
    return _documents(documents).select("label", "url", reason.alias("reason")).filter("reason IS NOT NULL")


def parse_resolutions(documents: DataFrame) -> DataFrame:
    """(label, url, date, verb, header, text): one row per committee paragraph of an adopted election or removal."""
    parsed = _documents(documents).filter("whole AND date IS NOT NULL AND verb IS NOT NULL")
    blocks = F.filter(
        F.transform(F.regexp_extract_all("body", F.lit(BLOCK), F.lit(0)), lambda p: F.regexp_replace(p, LAST_HEADER, "")),
        lambda p: ~p.rlike(PARAGRAPH_END))
    return parsed.select("label", "url", "date", "verb", F.posexplode(blocks).alias("paragraph", "p")).select(
        "label", "url", "date", "verb", "paragraph",
        F.btrim(_plain(F.regexp_extract("p", r"(?s)<header\b[^>]*>(.*?)</header>", 1)), F.lit(" :")).alias("header"),
        _plain(F.regexp_extract("p", r"(?s)<text\b[^>]*>(.*)</text>", 1)).alias("text"))


def listed_names(paragraphs: DataFrame) -> DataFrame:
    """Every name under a committee heading: ``name`` and ``state``, or ``odd`` for a segment that is not a name."""
    segments = F.split(F.regexp_replace("text", r"\([^)]*\)", ""), ",")
    rows = paragraphs.select("*", F.posexplode(segments).alias("segment", "_s")).withColumn("_s", F.btrim("_s", F.lit(" .")))
    rows = rows.filter((F.col("_s") != "") & ~F.col("_s").rlike(K.NAME_ROLE_PATTERN))
    rows = rows.withColumn("_s", F.trim(F.regexp_replace("_s", r"\s+to rank\b.*$", "")))
    titled = F.col("_s").rlike(K.NAME_TITLE_PATTERN)
    rest = F.trim(F.regexp_replace("_s", K.NAME_TITLE_PATTERN, ""))
    return rows.withColumn("_rest", rest).select(
        *[c for c in paragraphs.columns if c != "text"], "segment",
        F.when(~titled, F.col("_s")).alias("odd"),
        F.when(titled, F.trim(F.regexp_replace("_rest", r" of (?!.* of ).*$", ""))).alias("name"),
        F.when(titled, F.nullif(F.trim(F.regexp_extract("_rest", r"^.* of (.*)$", 1)), F.lit(""))).alias("state"))


def committee_events(documents, members, committees, current_congress=None):
    """(events, report): names that fit exactly one member become events, everything else is counted, never guessed.

    ``members`` also lists departed members without an official id, so that a shared surname is set aside.
    """
    names = listed_names(parse_resolutions(documents)).withColumn("_words", _committee_words("header"))
    codes = committees.select("committee_code", _committee_words("committee_name").alias("_words"))
    lines = names.join(codes.groupBy("_words").agg(F.min("committee_code").alias("committee_code")), "_words", "left")
    lines = lines.withColumn("_n", _letters("name")).withColumn("_w", F.split("_n", " +")).withColumn(
        "_key", F.try_element_at("_w", F.lit(-1)))
    people = members.select(
        "bioguide_id", "sworn", "prior_congress", _letters("state_name").alias("m_state"),
        F.split(_letters("last_name"), " +").alias("m_last"),
        F.split(_letters(F.concat_ws(" ", "first_name", "official_name")), " +").alias("m_words"),
    ).withColumn("_key", F.try_element_at("m_last", F.lit(-1))).filter("_key <> ''")
    given = F.slice("_w", 1, F.greatest(F.size("_w") - F.size("m_last"), F.lit(0)))
    fits = (F.size(F.array_except(given, "m_words")) == 0) & (
        F.col("state").isNull() | (_letters("state") == F.col("m_state")))
    sitting = congress_of("date")
    if current_congress is None:
        served = ~is_true(F.col("date") < F.col("sworn"))
    else:
        served = F.when(sitting == current_congress, ~is_true(F.col("date") < F.col("sworn"))).when(
            sitting < current_congress, F.coalesce("prior_congress", F.lit(0)) >= sitting).otherwise(True)
    line = ["label", "url", "date", "verb", "committee_code", "paragraph", "segment"]
    # names that cannot be placed have no key; they are dealt over the partitions and meet nobody
    placeable = F.col("committee_code").isNotNull() & F.col("name").isNotNull()
    keyed = lines.withColumn("_key", spread_null(F.when(placeable, F.col("_key")), F.struct("label", "segment")))
    official = people.withColumn("_member", F.lit(True))
    candidate = F.col("_member") & fits & (F.col("bioguide_id").isNull() | served)
    counted = keyed.join(official, "_key", "left").withColumn("_fits", is_true(candidate)).groupBy(*line).agg(
        *[F.first(c).alias(c) for c in ("header", "name", "state", "odd")],
        F.count_if("_fits").alias("candidates"), F.min(F.when(F.col("_fits"), F.col("bioguide_id"))).alias("bioguide_id"),
        F.collect_set(F.when(F.col("_fits"), F.col("bioguide_id"))).alias("_maybe"))
    outcome = (
        F.when(F.col("committee_code").isNull(), "unmapped_committee").when(F.col("odd").isNotNull(), "odd_segment")
        .when((F.col("candidates") == 1) & F.col("bioguide_id").isNotNull(), "event")
        .when(F.col("candidates") > 1, "ambiguous").otherwise("unresolved")
    )
    report = counted.withColumn("outcome", outcome).select(
        *line, "header", "name", "state", "odd", "outcome",
        F.when(F.col("outcome") == "event", F.col("bioguide_id")).alias("bioguide_id"),
        F.when(F.col("outcome") == "ambiguous", F.col("_maybe")).alias("maybe"))
    events = report.filter("outcome = 'event'").select(
        "bioguide_id", "committee_code", "date", "verb", "url", F.struct("label", "paragraph", "segment").alias("seq"))
    return events, report


def ambiguous_members(report: DataFrame) -> DataFrame:
    return report.filter("outcome = 'ambiguous'").select(F.explode("maybe").alias("bioguide_id")).distinct()
