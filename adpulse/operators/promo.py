"""Always-on vs promotion split of one media's day change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adpulse.config import FigureConfig
from adpulse.functions.labels import promo_class
from adpulse.functions.measures import csum, day_in, day_is, roas
from adpulse.operators.anchors import Anchors, anchors_of


def promo_split(fact: DataFrame, cfg: FigureConfig, anchors: Anchors | None = None,
                media: str | None = None, history: DataFrame | None = None) -> DataFrame:
    """Per media and promo class (unclassified dropped): cost, DB revenue and
    ROAS on the last and previous day, with changes.

    A class prints when the media has rows of it on ANY day, with zeros when
    neither day has any: the class list comes from a distinct over the whole
    history (two columns), the money from the two days only, left-joined on
    the aggregated (media, class) keys. ``history`` stands in for the whole
    history (``dimensions.choice_keys``), so that it need not be read again.
    """
    a = anchors_of(fact, anchors)

    def classed(df: DataFrame) -> DataFrame:
        f = df.where(F.col("media").isNotNull())
        if media is not None:
            f = f.where(F.col("media") == F.lit(media))
        return f.withColumn("promo_class", promo_class("promo", cfg)) \
                .where(F.col("promo_class") != "unclassified")

    f = classed(fact)
    # Which classes a media has: two narrow columns over the whole history,
    # reduced to one row per (media, class) before any shuffle.
    present = classed(history if history is not None else fact).select("media", "promo_class").distinct()
    # Their money: only the two days (pushed-down date predicate).
    cur, prev = day_is(a.d_max), day_is(a.d_prev)
    days = f.where(day_in([a.d_max, a.d_prev])).groupBy("media", "promo_class").agg(
        csum("cost", cur, "c1"), csum("rev_db", cur, "r1"),
        csum("cost", prev, "c0"), csum("rev_db", prev, "r0"))
    g = present.join(days, ["media", "promo_class"], "left")
    c = F.col
    z = F.lit(0)
    c1, r1 = F.coalesce(c("c1"), z), F.coalesce(c("r1"), z)
    c0, r0 = F.coalesce(c("c0"), z), F.coalesce(c("r0"), z)
    o1, o0 = roas(r1, c1), roas(r0, c0)
    return g.select(
        "media", "promo_class",
        r1.cast("double").alias("rev_cur"), r0.cast("double").alias("rev_prev"),
        (r1 - r0).cast("double").alias("rev_delta"),
        c1.cast("double").alias("cost_cur"), c0.cast("double").alias("cost_prev"),
        (c1 - c0).cast("double").alias("cost_delta"),
        o1.alias("roas_cur"), o0.alias("roas_prev"), (o1 - o0).alias("roas_delta"),
    ).orderBy("media", "promo_class")
