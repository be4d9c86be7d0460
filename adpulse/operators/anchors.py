"""Anchors: last and previous available day of the unfiltered fact.

``day_anchors`` is a one-row DataFrame computed from the distinct dates
(partial aggregation, then a per-partition top-2); ``resolve_anchors`` brings
that single row to the driver so every later query filters with literal dates
that Catalyst pushes into the Parquet scan (row-group skipping, partition
pruning on a date-partitioned snapshot). The row is bounded by construction.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Anchors:
    d_max: dt.date
    d_prev: dt.date
    d_min: dt.date

    @property
    def month_start(self) -> dt.date:
        return self.d_max.replace(day=1)

    @property
    def same_weekday(self) -> dt.date:
        return self.d_max - dt.timedelta(days=7)

    @property
    def calendar_prev(self) -> dt.date:
        return self.d_max - dt.timedelta(days=1)


def day_anchors(fact: DataFrame) -> DataFrame:
    """One row: d_max, d_prev (= d_max when only one date), d_min, month_start."""
    dates = fact.select("activity_date").where(F.col("activity_date").isNotNull()).distinct()
    top2 = dates.orderBy(F.col("activity_date").desc()).limit(2).withColumn("top", F.lit(True))
    first = dates.orderBy(F.col("activity_date").asc()).limit(1).withColumn("top", F.lit(False))
    d = F.col("activity_date")
    return (top2.unionByName(first)
            .agg(F.max(d).alias("d_max"),
                 F.min(F.when(F.col("top"), d)).alias("d_prev"),
                 F.min(d).alias("d_min"))
            .where(F.col("d_max").isNotNull())
            .withColumn("month_start", F.trunc("d_max", "month")))


def resolve_anchors(fact: DataFrame) -> Anchors:
    rows = day_anchors(fact).collect()
    if not rows:
        raise ValueError("the snapshot has no dated rows")
    r = rows[0]
    return Anchors(d_max=r["d_max"], d_prev=r["d_prev"], d_min=r["d_min"])


def anchors_of(fact: DataFrame, anchors: Anchors | None) -> Anchors:
    return anchors if anchors is not None else resolve_anchors(fact)


def anchors_from_dates(dates) -> Anchors:
    """Anchors from a list of distinct dates already known (e.g. the day
    partitions of a snapshot, read from its directory listing)."""
    ds = sorted({d for d in dates if d is not None})
    if not ds:
        raise ValueError("the snapshot has no dated rows")
    return Anchors(d_max=ds[-1], d_prev=ds[-2] if len(ds) > 1 else ds[-1], d_min=ds[0])
