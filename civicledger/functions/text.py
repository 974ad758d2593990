"""Column expressions that clean disclosure text. Everything here stays inside Spark's generated code."""

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def _text(c):
    """Text without white space of any kind at its ends; NULL as the empty text."""
    return F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"^\s+|\s+\z", "")


def once(c, use) -> Column:
    """``use(c)`` where ``c`` is worked out a single time, however often ``use`` names it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def empty_to_null(c) -> Column:
    c = _col(c)
    return F.when(c != "", c)


def parse_amount(c) -> tuple[Column, Column]:
    """(lowest, highest) whole-dollar bound of a disclosed range; the upper one is NULL when the range is open."""
    c = _col(c)
    figures = F.transform(
        F.regexp_extract_all(c, F.lit(K.AMOUNT_NUMBER_PATTERN), F.lit(0)),
        lambda n: F.regexp_replace(n, ",", "").try_cast("bigint"),
    )
    pair = F.slice(figures, 1, 2)
    is_open = c.rlike(K.OPEN_ENDED_PATTERN)
    return (
        F.when(is_open, F.get(figures, F.lit(0))).otherwise(F.array_min(pair)),
        F.when(~is_open, F.array_max(pair)),
    )


def normalize_name(c) -> Column:
    """A tidy member name: honorifics go, and a first name given twice is given once when a surname still follows.

    Written as replacements on the text, each naming its input once, so nesting it in other expressions stays cheap.
    """
    titles = r"(?i)(?<!\S)(?:" + "|".join(K.HONORIFICS) + r")\.*(?!\S)"
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(_col(c), F.lit("")), ",", " "), titles, " ")
    spaced = F.trim(F.regexp_replace(plain, r"\s+", " "))
    return F.regexp_replace(spaced, r"(?iu)^(\S*?)\.* (?=\1\.* \S)", "")


def normalize_chamber(c) -> Column:
    value = F.lower(_text(c))
    return F.when(value.isin(K.CHAMBERS), value)


def normalize_ticker(c) -> Column:
    value = F.upper(_text(c))
    return F.when(~value.isin(K.NO_TICKER) & value.rlike(K.TICKER_PATTERN), value)


def normalize_transaction_type(c) -> Column:
    value = F.lower(_text(c))
    return (
        F.when(value.contains("partial"), "sell_partial")
        .when(value.isin("buy", "purchase", "p"), "buy")
        .when(value.isin("sell", "sale", "s"), "sell")
        .when(value.contains("exchange"), "exchange")
        .otherwise("unknown")
    )


def clean_asset_name(c) -> Column:
    noise = [(K.ASSET_TAIL_PATTERN, ""), (K.ASSET_CODE_PATTERN, ""), (K.ASSET_TICKER_PATTERN, ""), (r"\s+", " ")]
    stripped = reduce(lambda col, rule: F.regexp_replace(col, *rule), noise, F.trim(_col(c)))
    return empty_to_null(F.btrim(stripped, F.lit(" -")))


def parse_date(c) -> Column:
    """ISO calendar dates only: a plain cast would also take '2026' or '2026-1-1'."""
    head = F.substring(_text(c), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd")).when(
        head.rlike(r"^\d{8}$"), F.try_to_date(head, "yyyyMMdd")
    )


def _fold_tables():
    """Accent folding derived from the Unicode database: one-to-one letters, and the few that become several."""
    single, several = {}, {}
    for code in [*range(0x00A0, 0xD800), *range(0xE000, 0x20000)]:
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            single[chr(code)] = plain
        elif plain.strip():
            several[chr(code)] = plain
    return single, several


_SINGLE, _SEVERAL = _fold_tables()


def fold_accents(c) -> Column:
    """Letters with a plain form as that form, full-width ones included; whatever has none is dropped.

    Signs that become several letters are rare, so they are looked for only in texts that still hold something foreign.
    """
    table = F.create_map(*[F.lit(x) for pair in _SEVERAL.items() for x in pair])
    single = F.translate(_col(c), "".join(_SINGLE), "".join(_SINGLE.values()))
    letters = F.transform(F.split(single, ""), lambda x: F.coalesce(F.try_element_at(table, x), x))
    return F.when(single.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.array_join(letters, ""), r"[^\x00-\x7F]", "")).otherwise(single)


def name_words(c) -> Column:
    """Lower-case ASCII words of a name, one space apart; apostrophes and full stops vanish, anything else separates."""
    plain = F.regexp_replace(F.lower(fold_accents(F.regexp_replace(_col(c), "[’]", ""))), r"['`.]", "")
    return F.trim(F.regexp_replace(plain, r"[^a-z0-9]+", " "))


def without_suffix(words) -> Column:
    """Words of a name without a generational suffix, as long as two words remain."""
    return F.regexp_replace(words, r"^(\S+(?: \S+)+) (?:" + "|".join(K.NAME_SUFFIXES) + ")$", "$1")


def legacy_value(c) -> Column:
    """Midpoint of the first known range the text mentions, 0 when none is."""
    text = F.lower(_col(c))
    branches = [F.when(text.contains(label.lower()), value) for label, value in K.LEGACY_VALUES]
    return F.coalesce(*branches, F.lit(0))


def _compact_usd(c):
    """$1.5K / $250K / $50M: at most one decimal, rolling over to the next unit when rounding reaches 1000."""
    v = _col(c).cast("double")

    def scaled(unit, suffix):
        shown = F.round(v / unit, 1)
        digits = F.when(shown == F.floor(shown), shown.cast("bigint").cast("string")).otherwise(
            F.format_string("%.1f", shown))
        return F.concat(F.lit("$"), digits, F.lit(suffix))

    return (
        F.when(F.round(v, 1) < 1000, scaled(1, ""))
        .when(F.round(v / 1e3, 1) < 1000, scaled(1e3, "K"))
        .when(F.round(v / 1e6, 1) < 1000, scaled(1e6, "M"))
        .otherwise(scaled(1e9, "B"))
    )


def format_amount_range(lo, hi) -> Column:
    lo, hi = _col(lo), _col(hi)
    low, high = _compact_usd(F.coalesce(lo, F.lit(0))), _compact_usd(hi)
    return (
        F.when(lo.isNull() & hi.isNull(), "—")
        .when(hi.isNull(), F.concat(F.lit("Over "), low))
        .when(lo == hi, high)
        .otherwise(F.concat(low, F.lit(" – "), high))
    )


def format_pct(fraction, digits=1) -> Column:
    pct = _col(fraction) * 100
    sign = F.when(pct > 0, "+").otherwise("")
    return F.when(pct.isNull() | F.isnan(pct), "—").otherwise(F.concat(sign, F.format_string(f"%.{digits}f%%", pct)))


def round_exact(c, digits=2) -> Column:
    """Round a double by its exact binary value, ties to even.

    Spark's round works on the shortest decimal form, which moves values such as 2.675 up. The product with the
    power of ten is split into its high and low part, so the comparison with one half is exact.
    """
    scale = float(10 ** digits)
    split = float(2 ** 27 + 1)
    x = _col(c)
    product = x * scale
    x_hi = x * split - (x * split - x)
    s_hi = float(scale * split - (scale * split - scale))
    low = ((x_hi * s_hi - product) + x_hi * (scale - s_hi) + (x - x_hi) * s_hi) + (x - x_hi) * (scale - s_hi)
    whole = F.floor(product).cast("double")
    beyond_half = (product - whole - 0.5) + low
    up = (beyond_half > 0) | ((beyond_half == 0) & (whole % 2 != 0))
    return (whole + F.when(up, 1.0).otherwise(0.0)) / scale


