"""Two-day grouped comparison (current day vs previous day), SS or DB basis.

The reference builds one grouped frame per day and full-outer-joins them,
filling gaps with 0. Here it is one scan with conditional aggregation: rows of
either day are grouped once, and each side is a ``coalesce(sum(when ..), 0)``.
A key present on one day only gets zeros on the other, exactly as the outer
join would. The date predicate is a literal ``IN`` list, so it reaches the
scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adpulse.config import FigureConfig
from adpulse.functions.measures import BASIS, csum, day_in, day_is, q, ratio_sql, sql_str

COMPARE_VALUES = ("rev_cur", "rev_prev", "rev_delta", "cost_cur", "cost_prev", "cost_delta",
                  "buy_cur", "buy_prev", "buy_delta", "roas_cur", "roas_prev", "roas_delta",
                  "influence")


def two_day_sums(fact: DataFrame, keys: list[str], basis: str, d_cur: dt.date, d_prev: dt.date,
                 cfg: FigureConfig, fill_keys: bool = True) -> DataFrame:
    """keys + rev/cost/buy summed for each of the two days (exact DECIMAL sums)."""
    rev, buy = BASIS[basis]
    f = fact.where(day_in([d_cur, d_prev]))
    key_cols = [f"coalesce(CAST({q(k)} AS STRING), {sql_str(cfg.missing)}) AS {q(k)}"
                if fill_keys else q(k) for k in keys]
    f = f.selectExpr(*key_cols, "activity_date", f"{q(rev)} AS _rev", "cost AS _cost",
                     f"{q(buy)} AS _buy")
    cur, prev = day_is(d_cur), day_is(d_prev)
    return f.groupBy(*keys).agg(
        csum("_rev", cur, "rev_cur"), csum("_rev", prev, "rev_prev"),
        csum("_cost", cur, "cost_cur"), csum("_cost", prev, "cost_prev"),
        csum("_buy", cur, "buy_cur"), csum("_buy", prev, "buy_prev"),
    )


def with_deltas(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Deltas, ROAS on both days, point difference and influence = |rev delta|."""
    roas_cur = ratio_sql("rev_cur", "cost_cur", 100.0)
    roas_prev = ratio_sql("rev_prev", "cost_prev", 100.0)
    return sums.selectExpr(
        *[q(k) for k in keys],
        "CAST(rev_cur AS DOUBLE) AS rev_cur",
        "CAST(rev_prev AS DOUBLE) AS rev_prev",
        "CAST(rev_cur - rev_prev AS DOUBLE) AS rev_delta",
        "CAST(cost_cur AS DOUBLE) AS cost_cur",
        "CAST(cost_prev AS DOUBLE) AS cost_prev",
        "CAST(cost_cur - cost_prev AS DOUBLE) AS cost_delta",
        "CAST(buy_cur AS BIGINT) AS buy_cur",
        "CAST(buy_prev AS BIGINT) AS buy_prev",
        "CAST(buy_cur - buy_prev AS BIGINT) AS buy_delta",
        f"{roas_cur} AS roas_cur",
        f"{roas_prev} AS roas_prev",
        f"({roas_cur}) - ({roas_prev}) AS roas_delta",
        "abs(CAST(rev_cur - rev_prev AS DOUBLE)) AS influence",
    )


def influence_order(keys: list[str]) -> list[str]:
    """Largest absolute revenue change first; ties end on the keys (SQL text)."""
    return ["influence DESC"] + [f"{q(k)} ASC" for k in keys]


def influence_cols(keys: list[str]) -> list[Column]:
    """The same order as sort Columns (for orderBy / window specs)."""
    return [F.col("influence").desc()] + [F.col(k).asc() for k in keys]


def two_day_compare(fact: DataFrame, keys: list[str], basis: str, d_cur: dt.date,
                    d_prev: dt.date, cfg: FigureConfig, order: bool = True) -> DataFrame:
    """Per key: current/previous sums, deltas, ROAS and influence."""
    out = with_deltas(two_day_sums(fact, keys, basis, d_cur, d_prev, cfg), keys)
    return out.orderBy(*influence_cols(keys)) if order else out
