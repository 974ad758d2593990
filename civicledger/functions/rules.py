"""Small decisions shared by several jobs, as column expressions."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def day(value) -> Column:
    """A date literal from a date or an ISO text, or a column left as it is."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def date_problem(tx, disclosure, today) -> Column:
    """Why a transaction date cannot be trusted, NULL when it can."""
    tx, disclosure = _col(tx), _col(disclosure)
    return F.when(tx > day(today), K.FUTURE_DATE_TEXT).when(tx > disclosure, K.AFTER_DISCLOSURE_TEXT)


def ret(start, end) -> Column:
    start, end = _col(start), _col(end)
    return F.when(start > 0, end / start - 1)


def direction(transaction_type) -> Column:
    t = _col(transaction_type)
    return F.when(t == "buy", 1).when(t.isin("sell", "sell_partial"), -1)


def trade_size(lo, hi) -> tuple[Column, Column]:
    """(representative dollars, how they were derived) for a disclosed range."""
    lo, hi = _col(lo), _col(hi)
    value = F.when(hi.isNull(), lo.cast("double")).when(hi >= lo, (lo + hi) / 2)
    basis = (
        F.when(lo.isNull(), F.lit(None).cast("string"))
        .when(hi.isNull(), "open_ended_lower_bound")
        .when(hi == lo, "exact_figure")
        .when(hi > lo, "range_midpoint")
    )
    return value, basis


def delay_signal(tx, disclosure, today, delay_days) -> tuple[Column, Column]:
    tx, disclosure = _col(tx), _col(disclosure)
    usable = date_problem(tx, disclosure, today).isNull() & (disclosure <= day(today))
    days = F.when(usable, F.datediff(disclosure, tx))
    return days, days > delay_days


def congress_of(c) -> Column:
    """The numbered two-year Congress sitting on a date; each begins on 3 January."""
    sitting = F.year(F.date_sub(_col(c), 2))
    return F.floor((sitting - 1789) / 2).cast("int") + 1


def sic_number(c) -> Column:
    """A four-digit code as a number, NULL for anything else."""
    text = F.trim(_col(c).cast("string"))
    return F.when(text.rlike(r"^\d{4}$") & (text != "0000"), text.try_cast("int"))


def sic_division(c) -> Column:
    code = _col(c)
    major = F.when(code.rlike(r"^\d{4}$"), F.substring(code, 1, 2).try_cast("int"))
    return F.coalesce(*[F.when(major.between(lo, hi), name) for lo, hi, name in K.SIC_DIVISIONS])


def sic_group(c) -> Column:
    code = _col(c)
    branches = [
        F.when(reduce(lambda a, b: a | b, [code.between(lo, hi) for lo, hi in ranges]), name)
        for name, ranges in K.SIC_GROUPS
    ]
    return F.coalesce(*branches)


def is_true(c) -> Column:
    return F.coalesce(_col(c), F.lit(False))


def spread_null(key, spread_by, ways=512) -> Column:
    """A join key whose NULLs are dealt over many partitions. The stand-ins match nothing, as NULL would."""
    dealt = F.concat(F.lit("\x00"), F.pmod(F.xxhash64(_col(spread_by)), F.lit(ways)).cast("string"))
    return F.coalesce(_col(key), dealt)
