"""Presentation text for numbers, built from native column expressions.

Numbers are pre-rounded half-even with ``bround`` before formatting, so the
text follows the numeric contract rather than printf's rounding.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: A click rate is a few tenths of a percent, so it is shown finer than ROAS.
CTR_DECIMALS = 3


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _whole(c) -> Column:
    return F.bround(_c(c).cast("double"), 0).cast("bigint")


def money_text(c) -> Column:
    """Whole number with thousands separators: 1234567.5 -> '1,234,568'."""
    return F.format_string("%,d", _whole(c))


def pct_text(c, decimals: int = 1) -> Column:
    """Percent with d decimals: 12.345 -> '12.3%'."""
    return F.format_string(f"%.{decimals}f%%", F.bround(_c(c).cast("double"), decimals))


def signed_money_text(c) -> Column:
    """Signed whole number with separators: '+1,234', '-56', '+0'."""
    return F.format_string("%+,d", _whole(c))


def signed_points_text(c, decimals: int = 1) -> Column:
    """Signed percentage points: '+1.2p', '-0.4p'."""
    return F.format_string(f"%+.{decimals}fp", F.bround(_c(c).cast("double"), decimals))


def as_text(df, money=(), pct=(), signed_money=(), signed_points=(), pct_decimals: int = 1):
    """A figure as text: the named columns formatted, every other
    column passed through unchanged, column order kept."""
    rules = {}
    rules.update({c: money_text(c) for c in money})
    rules.update({c: pct_text(c, pct_decimals) for c in pct})
    rules.update({c: signed_money_text(c) for c in signed_money})
    rules.update({c: signed_points_text(c, pct_decimals) for c in signed_points})
    return df.select(*[rules[c].alias(c) if c in rules else F.col(c) for c in df.columns])
