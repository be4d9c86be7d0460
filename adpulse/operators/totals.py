"""Period totals and the day / media / month breakdowns built on them.

A period record has seven exact sums (impressions, clicks, cost, SS/DB revenue
and purchases) and four guarded rates (CPC, CTR %, ROAS SS, ROAS DB). Several
periods are computed in ONE scan by conditional aggregation, so overlapping
periods need no join and no repeated scan.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adpulse.functions.measures import (MEASURES, RECORD, csum, day_between, day_in, out_type, q,
                                        ratio_sql, roas, sql_date, sql_str)
from adpulse.operators.anchors import Anchors, anchors_of
from adpulse.sources.schema import column_absent


def brand_filter(fact: DataFrame, brand: str | None, col: str = "brand") -> DataFrame:
    """Optional equality filter: None ('all') is a no-op, and so is a column that
    the source did not have."""
    if brand is None or column_absent(fact, col):
        return fact
    return fact.where(f"CAST({q(col)} AS STRING) = {sql_str(brand)}")


def _record_sql(prefix: str = "") -> list[str]:
    """SQL text of the typed 11-key record from summed measure columns."""
    def n(x):
        return q(f"{prefix}{x}")
    rates = {
        "cpc": ratio_sql(n("cost"), n("clicks")),
        "ctr": ratio_sql(n("clicks"), n("impressions"), 100.0),
        "roas_ss": ratio_sql(n("rev_ss"), n("cost"), 100.0),
        "roas_db": ratio_sql(n("rev_db"), n("cost"), 100.0),
    }
    return [f"{rates[k]} AS {k}" if k in rates else f"CAST({n(k)} AS {out_type(k)}) AS {k}"
            for k in RECORD]


def typed_record(df: DataFrame, keep: list[str]) -> DataFrame:
    """From summed DECIMAL/BIGINT measure columns to the typed 11-key record."""
    return df.selectExpr(*[q(k) for k in keep], *_record_sql())


def sum_measures(cond: str | None = None) -> list[Column]:
    return [csum(m, cond, m) for m in MEASURES]


def period_totals(fact: DataFrame, start: dt.date, end: dt.date,
                  brand: str | None = None) -> DataFrame:
    """A1: one row of the 11-key record for the inclusive day range [start, end]."""
    f = brand_filter(fact, brand).where(day_between(start, end))
    agg = f.agg(*sum_measures())
    return agg.selectExpr(f"{sql_date(start)} AS period_start", f"{sql_date(end)} AS period_end",
                          *_record_sql())


def mtd_totals(fact: DataFrame, anchors: Anchors | None = None,
               brand: str | None = None) -> DataFrame:
    """A2: month-to-date totals, first of d_max's month through d_max."""
    a = anchors_of(fact, anchors)
    return period_totals(fact, a.month_start, a.d_max, brand)


def in_any_period(ranges: list[tuple[dt.date, dt.date]]) -> str:
    """Rows in the union of the day ranges (not their hull): single days become
    one IN list, longer ranges OR-ed BETWEENs; both push down to the scan."""
    days = sorted({s for s, e in ranges if s == e})
    spans = sorted({(s, e) for s, e in ranges if s != e})
    parts = ([day_in(days)] if days else []) + [day_between(s, e) for s, e in spans]
    return " OR ".join(f"({p})" for p in parts) or "false"


def periods_totals(fact: DataFrame, periods: list[tuple[str, dt.date, dt.date]],
                   brand: str | None = None) -> DataFrame:
    """Many periods, one scan: rows (period, period_idx, period_start,
    period_end, record...).

    Periods may overlap; each is an independent conditional sum. The scan
    reads only the union of the ranges (literal predicate, pushed down).
    """
    f = brand_filter(fact, brand).where(in_any_period([(s, e) for _, s, e in periods]))
    aggs = [csum(m, day_between(s, e), f"p{i}_{m}")
            for i, (_, s, e) in enumerate(periods) for m in MEASURES]
    wide = f.agg(*aggs)
    structs = ", ".join(
        "struct(" + ", ".join([f"{sql_str(label)} AS period", f"{i} AS period_idx",
                               f"{sql_date(s)} AS period_start", f"{sql_date(e)} AS period_end"]
                              + [f"{q(f'p{i}_{m}')} AS {m}" for m in MEASURES]) + ")"
        for i, (label, s, e) in enumerate(periods))
    long = wide.selectExpr(f"inline(array({structs}))")
    return typed_record(long, ["period", "period_idx", "period_start", "period_end"])


def basis_table(totals: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """A3: the record as two rows, one per attribution basis (SS, DB).

    Impressions, clicks, CPC, CTR and cost repeat on both rows.
    """
    keep = keep or []
    return totals.select(*keep, F.inline(F.array(
        F.struct(F.lit("SS").alias("basis"), F.col("impressions"), F.col("clicks"),
                 F.col("cpc"), F.col("ctr"), F.col("cost"),
                 F.col("buy_ss").alias("purchases"), F.col("rev_ss").alias("revenue"),
                 F.col("roas_ss").alias("roas")),
        F.struct(F.lit("DB").alias("basis"), F.col("impressions"), F.col("clicks"),
                 F.col("cpc"), F.col("ctr"), F.col("cost"),
                 F.col("buy_db").alias("purchases"), F.col("rev_db").alias("revenue"),
                 F.col("roas_db").alias("roas")),
    )))


def daily_detail(fact: DataFrame, anchors: Anchors | None = None,
                 brand: str | None = None) -> DataFrame:
    """A4: one record per day of d_max's month.

    Days come from the unfiltered fact and measures from the brand-filtered
    rows, so a day without rows of the brand still shows, with zeros: one
    group-by with the brand test inside each conditional sum.
    """
    a = anchors_of(fact, anchors)
    f = fact.where(day_between(a.month_start, a.d_max))
    cond = None
    if brand is not None and not column_absent(fact, "brand"):
        cond = f"coalesce(CAST(brand AS STRING) = {sql_str(brand)}, false)"
    agg = f.groupBy("activity_date").agg(*sum_measures(cond))
    out = agg.selectExpr("date_format(activity_date, 'yyyy-MM-dd') AS day", "activity_date",
                         *_record_sql())
    return out.orderBy("activity_date")


def media_mtd(fact: DataFrame, anchors: Anchors | None = None,
              brand: str | None = None) -> DataFrame:
    """Channel × media month-to-date record, by SS revenue (no limit).

    Null channel or media stays its own group (pandas dropna=False).
    """
    a = anchors_of(fact, anchors)
    f = brand_filter(fact, brand).where(day_between(a.month_start, a.d_max))
    agg = f.groupBy("channel", "media").agg(*sum_measures())
    out = typed_record(agg, ["channel", "media"])
    return out.orderBy(F.col("rev_ss").desc(), F.col("channel").asc(), F.col("media").asc())


def roas_trend(fact: DataFrame, end: dt.date | None = None, n: int = 7,
               anchors: Anchors | None = None, days: Sequence[dt.date] | None = None) -> DataFrame:
    """The last n distinct days up to ``end``: daily SS ROAS (rounded to
    0.1), cost in units of 10,000 (rounded to 0.1) and the plain mean of the
    rounded ROAS values over the window.

    The n days come from ``days``, the list of a snapshot's days, or are found on
    the date column alone (distinct + top-n) and brought back as a list of at most n
    dates, so the fact is then read with a literal ``IN`` filter: a partition filter on
    a day-partitioned snapshot and a pushed Parquet filter on any other layout.
    """
    if end is None:
        end = anchors_of(fact, anchors).d_max
    if days is not None:
        return _trend(fact, sorted({x for x in days if x <= end})[-n:])
    d = F.col("activity_date")
    days = [r[0] for r in fact.select(d).where(d.isNotNull() & (d <= F.lit(end))).distinct()
            .orderBy(d.desc()).limit(n).collect()]
    return _trend(fact, days)


def roas_trend_between(fact: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """A16 for a chosen range: every day with data in [start, end] (the chart's
    range picker), or the last 7 days up to its end if it has none; same
    columns as ``roas_trend``."""
    chosen = fact.where(F.col("activity_date").between(start, end))
    if chosen.isEmpty():
        return roas_trend(fact, end, 7)
    return _trend(chosen, None)


def _trend(fact: DataFrame, days: list | None) -> DataFrame:
    d = F.col("activity_date")
    if days is None:
        picked = fact.where(d.isNotNull())
    else:
        picked = fact.where(d.isin(*days)) if days else fact.where(F.lit(False))
    daily = picked.groupBy("activity_date").agg(csum("rev_ss").alias("rev_ss"),
                                              csum("cost").alias("cost"))
    roas_1 = F.bround(roas("rev_ss", "cost"), 1)
    out = daily.select(
        "activity_date",
        F.date_format(d, "MM/dd").alias("label"),
        roas_1.alias("roas_ss"),
        F.bround(F.col("cost").cast("double") / F.lit(10000.0), 1).alias("cost_10k"),
        roas_1.cast("decimal(20,1)").alias("_r"),
    )
    # One row per picked day: the window spans the chart's days only.
    w = Window.partitionBy()
    mean = (F.sum("_r").over(w).cast("double") / F.count(F.lit(1)).over(w).cast("double"))
    return out.select("activity_date", "label", "roas_ss", "cost_10k",
                      mean.alias("avg_roas_ss")).orderBy("activity_date")


def _media_days(fact: DataFrame, start: dt.date | None, end: dt.date | None,
                days: Sequence[dt.date] | None = None) -> tuple[DataFrame, list[str]]:
    """The rows of the range with their day as yyyy-MM-dd (with the year, so
    labels never collide), and the days with data (one entry a day), looked up unless
    the list of the frame's days is passed."""
    d = F.col("activity_date")
    f = fact.where(d.isNotNull())
    if start is not None:
        f = f.where(d >= F.lit(start))
    if end is not None:
        f = f.where(d <= F.lit(end))
    f = f.select("media", F.date_format(d, "yyyy-MM-dd").alias("day"), "rev_db")
    if days is not None:
        return f, [x.isoformat() for x in sorted(set(days)) if (start is None or x >= start) and (end is None or x <= end)]
    return f, sorted(r[0] for r in f.select("day").distinct().collect())


def media_daily(fact: DataFrame, start: dt.date | None = None, end: dt.date | None = None,
                days: Sequence[dt.date] | None = None) -> DataFrame:
    """A14 as rows: DB revenue of every media on every day with data, missing
    cells 0. One (media, day) aggregate, then each media's map is read off for
    every day: the form for a long history."""
    f, found = _media_days(fact, start, end, days)
    sums = f.groupBy("media", "day").agg(F.sum("rev_db").cast("double").alias("v"))
    per_media = sums.groupBy("media").agg(
        F.map_from_entries(F.collect_list(F.struct("day", "v"))).alias("m"))
    day = F.explode(F.split(F.lit(",".join(found)), ","))
    return per_media.select("media", "m", day.alias("day")).select(
        "media", "day", F.coalesce(F.col("m")[F.col("day")], F.lit(0.0)).alias("rev_db"))


def media_daily_pivot(fact: DataFrame, start: dt.date | None = None,
                      end: dt.date | None = None) -> DataFrame:
    """Media × day matrix of DB revenue, missing cells 0, one column a day.

    Made for a bounded range such as a month: the days are looked up first, as
    the columns must be known when the plan is built.
    """
    f, days = _media_days(fact, start, end)
    if not days:
        return f.select("media").distinct()
    wide = f.groupBy("media").pivot("day", days).agg(F.sum("rev_db").cast("double"))
    return wide.na.fill(0.0, days)


def date_extent(fact: DataFrame) -> DataFrame:
    """First and last day of a (filtered) fact, and the number of days."""
    d = F.col("activity_date")
    return fact.agg(F.min(d).alias("first_day"), F.max(d).alias("last_day"),
                    F.count_distinct(d).alias("n_days"))
