"""Reusable Column expressions.

Everything here returns a ``Column`` made of built-in functions, so it stays
inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "col_of", "safe_div", "pct", "xsum", "xavg", "rnd", "r2", "r6", "month_start", "period_start",
    "period_step", "clean_amount", "contains_safe", "quartile_score", "PERIODS",
]

# Truncation unit and spine step for each period code the reference accepts.
PERIODS = {
    "D": ("DAY", "1 day"),
    "W": ("WEEK", "7 days"),
    "M": ("MONTH", "1 month"),
    "Q": ("QUARTER", "3 months"),
    "Y": ("YEAR", "1 year"),
}


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num, den) -> Column:
    """num / den, null when den is 0 or null (ANSI-safe)."""
    return F.try_divide(col_of(num), col_of(den))


def pct(num, den) -> Column:
    return safe_div(num, den) * F.lit(100.0)


def xsum(c) -> Column:
    """Sum that does not depend on the order of addition: added as decimals
    with 8 places, then turned into the nearest double. NaN and infinite
    values are skipped, as null is."""
    return F.sum(col_of(c).try_cast("decimal(38,8)")).cast("double")


def xavg(c) -> Column:
    """Mean from ``xsum``: one division."""
    return safe_div(xsum(c), F.count(col_of(c).try_cast("decimal(38,8)")))


def rnd(c, d: int) -> Column:
    """Half-even rounding to ``d`` places, whatever the magnitude.

    One ``rint`` between a multiplication and a division by 10**d: the same
    IEEE operations as DuckDB's ``round_even`` on doubles, so the oracles use
    that function as it is. Inputs must not depend on the order of addition:
    sum with ``xsum`` and ``xavg``.
    """
    p = F.lit(float(10 ** d))
    return F.rint(col_of(c).cast("double") * p) / p


def r2(c) -> Column:
    """Half-even rounding to 2 places (money, pandas ``round(2)``)."""
    return rnd(c, 2)


def r6(c) -> Column:
    """Half-even rounding to 6 places: the fixed output precision of ratios."""
    return rnd(c, 6)


def month_start(c) -> Column:
    return F.to_date(F.date_trunc("MONTH", col_of(c)))


def period_start(c, freq: str = "M") -> Column:
    unit, _ = PERIODS[freq]
    return F.to_date(F.date_trunc(unit, col_of(c)))


def period_step(freq: str = "M") -> Column:
    return F.expr(f"INTERVAL {PERIODS[freq][1]}")


def clean_amount(c) -> Column:
    """Amount text such as ``'1 234,50 €'`` -> 1234.5; unparsable -> null.

    Removes currency signs, NBSP and blanks, turns the decimal comma into a
    dot, then ``try_cast`` (never raises under ANSI mode).
    """
    s = F.regexp_replace(col_of(c).cast("string"), "[€$£¥ \\s]", "")
    s = F.replace(s, F.lit(","), F.lit("."))
    return s.try_cast("double")


def contains_safe(c, needle: str) -> Column:
    """Case-sensitive substring test; null -> false."""
    return F.coalesce(F.contains(col_of(c), F.lit(needle)), F.lit(False))


def quartile_score(x, q1, q2, q3, reverse: bool = False) -> Column:
    """1..4 by quartile edges; equals ``qcut`` labels when edges differ and
    stays defined when edges tie."""
    x = col_of(x)
    s = (F.lit(1) + (x > col_of(q1)).cast("int") + (x > col_of(q2)).cast("int")
         + (x > col_of(q3)).cast("int"))
    return (F.lit(5) - s) if reverse else s

