"""Identity of people and of disclosed lines."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def politician_key(name, chamber) -> Column:
    """Chamber plus the letters and digits of the name; single-letter words between first and last do not count."""
    return keyed_in(chamber, name_key(name))


def keyed_in(chamber, key) -> Column:
    """The key of a person of a chamber whose name's key is known."""
    return F.concat(chamber, F.lit(":"), key)


def name_key(name) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    last = F.size(words) - 1
    kept = F.filter(words, lambda w, i: (i == 0) | (i == last) | ~w.rlike(r"^\p{L}\.*$"))
    return F.regexp_replace(F.lower(F.array_join(kept, " ")), "[^a-z0-9]+", "")


def _shown(c):
    return F.coalesce(F.col(c).cast("string"), F.lit("None"))


def line_identity(key=None) -> Column:
    """What makes two disclosed lines the same line, whichever source reported them."""
    key = politician_key("politician_name", "chamber") if key is None else key
    unlisted = F.when(F.col("ticker").isNull(), F.lower(F.col("asset_name")))
    return F.concat_ws(
        "|", key, F.coalesce("ticker", F.lit("")), F.coalesce(unlisted, F.lit("")), "transaction_type",
        F.col("transaction_date").cast("string"), F.coalesce(F.col("disclosure_date").cast("string"), F.lit("")),
        _shown("amount_min"), _shown("amount_max"),
    )


def fingerprint(identity, occurrence) -> Column:
    return F.sha2(F.concat_ws("|", identity, occurrence.cast("string")), 256)
