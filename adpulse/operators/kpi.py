"""Target attainment by channel rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adpulse.config import FigureConfig
from adpulse.functions.labels import strip
from adpulse.functions.measures import csum, day_between, sql_str
from adpulse.operators.anchors import Anchors, anchors_of


def target_rule(cfg: FigureConfig, col: str = "channel") -> Column:
    """Rule of a target row: store / market / other / none (checked in order)."""
    key = F.lower(strip(col))
    store = key == F.lit(cfg.store_channel.lower())
    for alias in cfg.store_target_aliases:
        store = store | key.contains(alias.lower())
    market = key.isin(*[n.lower() for n in cfg.market_target_names])
    for alias in cfg.market_target_aliases:
        market = market | key.contains(alias.lower())
    return (F.when(store, F.lit("store"))
             .when(market, F.lit("market"))
             .when(key == F.lit(cfg.other_target.lower()), F.lit("other"))
             .otherwise(F.lit("none")))


def rule_revenue(fact: DataFrame, cfg: FigureConfig, a: Anchors) -> DataFrame:
    """Month-to-date SS revenue per rule, one scan, three rows.

    Store and market rows are found by a case-insensitive contains on the
    channel; 'other' is neither, and a null channel counts as other.
    """
    ch = "lower(coalesce(channel, ''))"
    is_store = f"contains({ch}, {sql_str(cfg.store_marker.lower())})"
    is_market = f"contains({ch}, {sql_str(cfg.market_marker.lower())})"
    f = fact.where(day_between(a.month_start, a.d_max))
    agg = f.agg(csum("rev_ss", is_store, "store"), csum("rev_ss", is_market, "market"),
                csum("rev_ss", f"NOT {is_store} AND NOT {is_market}", "other"))
    return agg.select(F.inline(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.col(r).alias("achieved"))
        for r in ("store", "market", "other")])))


def kpi_attainment(fact: DataFrame, targets: DataFrame, cfg: FigureConfig,
                   anchors: Anchors | None = None) -> DataFrame:
    """A5 + A6: for every target row, achieved month-to-date SS revenue by its
    rule (unknown rule → 0), the attainment rate capped at 100 % (0 when the
    target is 0), the uncapped rate and the colour band.

    Both sides are tiny (3 rule rows; one row per configured target), so the
    rule table is broadcast.
    """
    a = anchors_of(fact, anchors)
    rev = rule_revenue(fact, cfg, a)
    t = targets.withColumn("rule", target_rule(cfg))
    j = t.join(F.broadcast(rev), "rule", "left")
    achieved = F.coalesce(F.col("achieved"), F.lit(0)).cast("double")
    target = F.col("target_rev").cast("double")
    raw = F.when(target != 0, achieved / target).otherwise(F.lit(0.0))
    rate = F.when(target != 0, F.least(raw, F.lit(1.0)) * F.lit(100.0)).otherwise(F.lit(0.0))
    out = j.select("target_idx", "channel", "rule", achieved.alias("achieved"),
                   target.alias("target_rev"), F.col("target_cost").cast("double").alias("target_cost"),
                   F.col("target_roas").cast("double").alias("target_roas"),
                   rate.alias("rate_pct"), (raw * F.lit(100.0)).alias("rate_pct_uncapped"))
    band = (F.when(F.col("rate_pct") >= cfg.band_green, F.lit("green"))
             .when(F.col("rate_pct") >= cfg.band_amber, F.lit("amber"))
             .otherwise(F.lit("red")))
    return out.withColumn("band", band).orderBy("target_idx")
