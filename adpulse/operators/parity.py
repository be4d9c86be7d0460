"""Parity of snapshots of the same data (J20): row counts, measure
totals within a tolerance, per-media totals, and the days restated from tag to tag.

Both snapshots are tagged, unioned and grouped once by media with
conditional sums per side: one shuffle, no join, and a null media pairs with
the other side's null media as a group. Totals are exact DECIMAL sums until
the final projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adpulse.functions.measures import csum

PARITY_MEASURES = ("cost", "rev_ss", "rev_db", "buy_ss")


def _per_media_exact(a: DataFrame, b: DataFrame) -> DataFrame:
    cols = ["media", *PARITY_MEASURES]
    u = (a.select(*cols).withColumn("_side", F.lit("a"))
         .unionByName(b.select(*cols).withColumn("_side", F.lit("b"))))
    aggs = []
    for side in ("a", "b"):
        cond = f"_side = '{side}'"
        aggs.append(F.expr(f"count_if({cond}) AS rows_{side}"))
        aggs += [csum(m, cond, f"{m}_{side}") for m in PARITY_MEASURES]
    return u.groupBy("media").agg(*aggs)


def _ok(eps: float):
    """Exact sums are compared as such: as DOUBLEs, totals beyond 2^53 units of
    the last digit would hide a difference."""
    ok = F.col("rows_a") == F.col("rows_b")
    for m in PARITY_MEASURES:
        ok = ok & (F.abs(F.col(f"{m}_a") - F.col(f"{m}_b")) < F.lit(Decimal(repr(eps))))
    return ok


def snapshot_parity(a: DataFrame, b: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Per media (null media is its own group): counts and totals of both
    snapshots and whether they agree."""
    per = _per_media_exact(a, b).withColumn("ok", _ok(eps))
    return per.select("media", "rows_a", "rows_b",
                      *[F.col(f"{m}_{s}").cast("double").alias(f"{m}_{s}")
                        for s in ("a", "b") for m in PARITY_MEASURES], "ok")


def parity_totals(a: DataFrame, b: DataFrame, eps: float = 1e-6) -> DataFrame:
    """One row: overall counts and totals of both snapshots, whether the
    totals agree, and whether every media agrees. Each snapshot is scanned
    once; totals are summed exactly from the per-media sums."""
    per = _per_media_exact(a, b).withColumn("_media_ok", _ok(eps))
    aggs = [F.sum("rows_a").alias("rows_a"), F.sum("rows_b").alias("rows_b")]
    for m in PARITY_MEASURES:
        aggs += [F.sum(f"{m}_a").alias(f"{m}_a"), F.sum(f"{m}_b").alias(f"{m}_b")]
    aggs.append(F.coalesce(F.bool_and("_media_ok"), F.lit(True)).alias("media_ok"))
    tot = per.agg(*aggs)
    out = tot.select("rows_a", "rows_b",
                     *[F.col(f"{m}_{s}").cast("double").alias(f"{m}_{s}")
                       for s in ("a", "b") for m in PARITY_MEASURES], "media_ok")
    return out.withColumn("totals_ok", _ok(eps))


def restated_days(snapshots: DataFrame, tags: Sequence[str]) -> DataFrame:
    """J20 over many snapshots: the days that differ between consecutive tags.

    ``snapshots`` holds the rows of all of them, told apart by ``tag``
    (``versions.read_tags``); ``tags`` gives their order. One scan adds up rows and
    measures by (tag, day); each of these few rows then takes part in two comparisons, as
    the later and as the earlier side, in one grouped pass without a join. One row per
    (tag, previous tag, day) whose count or an exact sum differs: added, removed or
    restated, with both sides' values. Rows without a date are a day of their own.
    """
    tags = list(tags)
    number = F.array_position(F.array(*[F.lit(t) for t in tags]), F.col("tag")).cast("int")
    per = (snapshots.select("tag", "activity_date", *PARITY_MEASURES).withColumn("_no", number).where("_no > 0")
           .groupBy("_no", "activity_date")
           .agg(F.count(F.lit(1)).alias("rows"), *[csum(m, None, m) for m in PARITY_MEASURES]))
    values = ["rows", *PARITY_MEASURES]
    sides = F.explode(F.array(*[F.struct((F.col("_no") + step).alias("_pair"), F.lit(side).alias("_side"))
                                for step, side in ((0, "after"), (1, "before"))]))
    both = (per.withColumn("_s", sides).select("_s.*", "activity_date", *values)
            .groupBy("_pair", "activity_date")
            .agg(*[F.expr(f"max(CASE WHEN _side = '{side}' THEN {v} END) AS {v}_{side}")
                   for side in ("before", "after") for v in values]))
    before, after = F.col("rows_before").isNull(), F.col("rows_after").isNull()
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"{v}_before").eqNullSafe(F.col(f"{v}_after"))
    named = F.array(*[F.lit(t) for t in tags])
    zero = F.lit(0)
    return (both.where(F.col("_pair").between(2, len(tags)) & ~same)
            .select(F.element_at(named, F.col("_pair")).alias("tag"),
                    F.element_at(named, F.col("_pair") - 1).alias("previous_tag"), "activity_date",
                    F.when(before, "added").when(after, "removed").otherwise("restated").alias("change"),
                    *[F.coalesce(F.col(f"rows_{side}"), zero).alias(f"rows_{side}") for side in ("before", "after")],
                    *[F.coalesce(F.col(f"{m}_{side}"), zero).cast("double").alias(f"{m}_{side}")
                      for m in PARITY_MEASURES for side in ("before", "after")]))
