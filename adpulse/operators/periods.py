"""Period comparisons: standard comparison periods of a selection, arbitrary
base-vs-comparison ranges and the day headline (J4-J8).

All periods of one question are aggregated in one scan (``periods_totals``);
the small per-period records are then reshaped without touching the fact.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adpulse.functions.labels import direction
from adpulse.functions.measures import MEASURES, RECORD, q, sql_str
from adpulse.operators.anchors import Anchors, anchors_of
from adpulse.operators.totals import brand_filter, periods_totals, sum_measures, typed_record

DAY = dt.timedelta(days=1)

# Labels of the four standard comparison periods.
STANDARD_PERIODS = ("prev_period", "same_weekday", "two_days_before", "three_days_before")

BASIS_METRICS = {
    "ss": (("cost", "cost"), ("purchases", "buy_ss"), ("revenue", "rev_ss"), ("roas", "roas_ss")),
    "db": (("cost", "cost"), ("purchases", "buy_db"), ("revenue", "rev_db"), ("roas", "roas_db")),
}


def standard_periods(start: dt.date, end: dt.date) -> list[tuple[str, dt.date, dt.date]]:
    """Selection plus: directly before (same length), same weekday (both
    bounds −7 days), ending 2 days and 3 days before the start."""
    if end < start:
        raise ValueError(f"selection ends ({end}) before it starts ({start})")
    n = (end - start).days + 1
    span = dt.timedelta(days=n - 1)
    p1_e = start - DAY
    p2_e = start - 2 * DAY
    p3_e = start - 3 * DAY
    week = dt.timedelta(days=7)
    return [
        ("selection", start, end),
        ("prev_period", p1_e - span, p1_e),
        ("same_weekday", start - week, end - week),
        ("two_days_before", p2_e - span, p2_e),
        ("three_days_before", p3_e - span, p3_e),
    ]


def multi_period(fact: DataFrame, start: dt.date | None = None, end: dt.date | None = None,
                 anchors: Anchors | None = None, brand: str | None = None) -> DataFrame:
    """The 11-key record for the selection and its four comparison periods
    (default selection: the last day). Empty periods give zeros."""
    if start is None or end is None:
        a = anchors_of(fact, anchors)
        start, end = start or a.d_max, end or a.d_max
    return periods_totals(fact, standard_periods(start, end), brand)


def period_table(fact: DataFrame, periods: DataFrame, anchors: Anchors | None = None,
                 brand: str | None = None) -> DataFrame:
    """J4 and J6 for any number of periods: the 11-key record of every row of
    ``periods`` (period_start, period_end, both days included; other columns are kept).
    Periods may overlap and repeat; one that is empty, reversed or has a null bound
    gives zeros.

    One scan adds up the fact by day, and running sums over the days (one row a day, gaps
    filled) turn a period into the difference of two of them. So a period costs two
    equi-joins with the day table, however long it is, and no row of the fact meets more
    than its day; the sums are exact DECIMALs, so the difference is exact as well.
    """
    a = anchors_of(fact, anchors)
    daily = (brand_filter(fact, brand).where(F.col("activity_date").isNotNull())
             .groupBy("activity_date").agg(*sum_measures()))
    first, last = F.lit(a.d_min), F.lit(a.d_max)
    spine = fact.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("activity_date"))
    upto = Window.orderBy("activity_date").rowsBetween(Window.unboundedPreceding, 0)  # one row a day
    running = spine.join(daily, "activity_date", "left").select(
        "activity_date", *[F.coalesce(F.sum(m).over(upto), F.lit(0)).alias(m) for m in MEASURES])

    def at(day: str, prefix: str) -> DataFrame:
        return running.select(F.col("activity_date").alias(day), *[F.col(m).alias(f"{prefix}{m}") for m in MEASURES])

    start, end = F.col("period_start"), F.col("period_end")
    whole = start <= end
    # the running sum ends with the last day; before the first it is nothing
    keyed = (periods.withColumn("_to", F.when(whole, F.least(end, last)))
             .withColumn("_before", F.when(whole, F.least(F.date_sub(start, 1), last))))
    joined = keyed.join(at("_to", "_t_"), "_to", "left").join(at("_before", "_b_"), "_before", "left")
    zero = F.lit(0)
    sums = [(F.coalesce(F.col(f"_t_{m}"), zero) - F.coalesce(F.col(f"_b_{m}"), zero)).alias(m) for m in MEASURES]
    return typed_record(joined.select(*periods.columns, *sums), periods.columns)


def _pick(col: str, idx: int) -> str:
    """Metric ``col`` of period ``idx`` from the period records, as DOUBLE."""
    return f"max(CASE WHEN period_idx = {idx} THEN CAST({q(col)} AS DOUBLE) END)"


def _wide(recs: DataFrame, cols: list[str], n: int) -> DataFrame:
    """One row: <col>_<i> for every metric and period (a pivot of n rows)."""
    return recs.agg(*[F.expr(f"{_pick(c, i)} AS {q(f'{c}_{i}')}") for c in cols for i in range(n)])


def _rows(items: list[list[str]]) -> str:
    """inline(array(struct(...), ...)) from per-row lists of 'expr AS name'."""
    return "inline(array(" + ", ".join("struct(" + ", ".join(r) + ")" for r in items) + "))"


def multi_period_delta(fact: DataFrame, basis: str = "ss", start: dt.date | None = None,
                       end: dt.date | None = None, anchors: Anchors | None = None,
                       brand: str | None = None) -> DataFrame:
    """Per metric of one basis (cost, purchases, revenue, ROAS): the
    selection's value and its difference to each comparison period."""
    recs = multi_period(fact, start, end, anchors, brand)
    metrics = BASIS_METRICS[basis]
    wide = _wide(recs, [src for _, src in metrics], 5)
    return wide.selectExpr(_rows([
        [f"{sql_str(basis.upper())} AS basis", f"{k} AS metric_idx", f"{sql_str(name)} AS metric",
         f"{src}_0 AS value"]
        + [f"{src}_0 - {src}_{i + 1} AS delta_{lbl}" for i, lbl in enumerate(STANDARD_PERIODS)]
        for k, (name, src) in enumerate(metrics)]))


def period_delta(fact: DataFrame, base: tuple[dt.date, dt.date] | None = None,
                 comp: tuple[dt.date, dt.date] | None = None, anchors: Anchors | None = None,
                 brand: str | None = None) -> DataFrame:
    """Base range vs comparison range, every metric of the record with the
    signed delta and its direction. Defaults: base = last day, comparison =
    the calendar day before it."""
    if base is None or comp is None:
        a = anchors_of(fact, anchors)
        base = base or (a.d_max, a.d_max)
        comp = comp or (a.calendar_prev, a.calendar_prev)
    for s_, e_ in (base, comp):
        if e_ < s_:
            raise ValueError(f"range ends ({e_}) before it starts ({s_})")
    recs = periods_totals(fact, [("base", base[0], base[1]), ("comp", comp[0], comp[1])], brand)
    wide = _wide(recs, list(RECORD), 2)
    out = wide.selectExpr(_rows([
        [f"{k} AS metric_idx", f"{sql_str(m)} AS metric", f"{m}_0 AS base_value",
         f"{m}_1 AS comp_value", f"{m}_0 - {m}_1 AS delta"]
        for k, m in enumerate(RECORD)]))
    return out.withColumn("direction", direction("delta"))


HEADLINE = ("buy_ss", "buy_db", "rev_ss", "rev_db", "roas_ss", "roas_db")


def daily_headline(fact: DataFrame, anchors: Anchors | None = None,
                   brand: str | None = None) -> DataFrame:
    """J7 + J8: last day's purchases, revenue and ROAS on both bases, the
    change against the previous available day and against the same weekday a
    week earlier (zeros when that day is absent), and the up/down flag of the
    day-over-day change."""
    a = anchors_of(fact, anchors)
    periods = [("cur", a.d_max, a.d_max), ("prev", a.d_prev, a.d_prev),
               ("same_weekday", a.same_weekday, a.same_weekday)]
    recs = periods_totals(fact, periods, brand)
    wide = _wide(recs, list(HEADLINE), 3)
    out = wide.selectExpr(_rows([
        [f"{k} AS metric_idx", f"{sql_str(m)} AS metric", f"{m}_0 AS value",
         f"{m}_0 - {m}_1 AS delta_prev", f"{m}_0 - {m}_2 AS delta_same_weekday"]
        for k, m in enumerate(HEADLINE)]))
    return out.select(F.lit(a.d_max).alias("day"), F.lit(a.d_prev).alias("prev_day"),
                      F.lit(a.same_weekday).alias("same_weekday_day"), "*",
                      direction("delta_prev", two_way=True).alias("direction"))
