"""Product tables with history: last-day top 10 with the previous day, its
summary, and day-over-day gainers and losers (J3, A17, J15, J16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adpulse.config import FigureConfig
from adpulse.functions.labels import strip
from adpulse.functions.measures import csum, day_in, day_is, ratio_sql, sql_str
from adpulse.operators.anchors import Anchors, anchors_of
from adpulse.operators.compare import influence_order, two_day_compare
from adpulse.operators.ranking import product_rows, top_k, top_k_per_group


def product_top10(fact: DataFrame, cfg: FigureConfig, anchors: Anchors | None = None,
                  media: str | None = None, k: int = 10) -> DataFrame:
    """Per media, the last day's top k products by DB revenue, joined to
    the previous day (missing there = 0). ROAS rounded to 0.1; the ROAS change
    is 0 unless both days have cost, and is taken from the unrounded ratios.

    One scan of the two days: a conditional aggregate per (media, product)
    plus a flag for "has rows on the last day" replaces the left join.
    """
    a = anchors_of(fact, anchors)
    f = fact.where(f"{day_in([a.d_max, a.d_prev])} AND media IS NOT NULL")
    if media is not None:
        f = f.where(F.col("media") == F.lit(media))
    f = f.selectExpr("media", f"coalesce(CAST(product AS STRING), {sql_str(cfg.missing)}) AS product",
                     "activity_date", "rev_db", "cost", "buy_db")
    cur, prev = day_is(a.d_max), day_is(a.d_prev)
    g = f.groupBy("media", "product").agg(
        F.expr(f"max({cur}) AS _on_last"),
        csum("rev_db", cur, "rv1"), csum("cost", cur, "c1"), csum("buy_db", cur, "b1"),
        csum("rev_db", prev, "rv0"), csum("cost", prev, "c0"), csum("buy_db", prev, "b0"),
    ).where("_on_last")
    top = top_k_per_group(g, ["media"], ["rv1 DESC", "product ASC"], k)
    gap = ("(CAST(rv1 AS DOUBLE) / CAST(c1 AS DOUBLE) - CAST(rv0 AS DOUBLE) / CAST(c0 AS DOUBLE))"
           " * 100.0D")
    return top.selectExpr(
        "media", "rank", "product",
        "CAST(b1 AS BIGINT) AS buy_cur", "CAST(b0 AS BIGINT) AS buy_prev",
        "CAST(b1 - b0 AS BIGINT) AS buy_delta",
        "CAST(rv1 AS DOUBLE) AS rev_cur", "CAST(rv0 AS DOUBLE) AS rev_prev",
        "CAST(rv1 - rv0 AS DOUBLE) AS rev_delta",
        f"bround({ratio_sql('rv1', 'c1', 100.0)}, 1) AS roas_cur",
        f"bround({ratio_sql('rv0', 'c0', 100.0)}, 1) AS roas_prev",
        f"CASE WHEN c1 != 0 AND c0 != 0 THEN bround({gap}, 1) ELSE 0.0D END AS roas_delta",
    )


def product_top10_summary(top10: DataFrame) -> DataFrame:
    """Per media of a top table of any length: how many rose and fell, and
    the two largest revenue changes (whatever their sign). All its rows count."""
    ranked = top10.selectExpr(
        "media", "product", "rev_delta",
        "row_number() OVER (PARTITION BY media ORDER BY rev_delta DESC, product ASC) AS _gain_rank")
    return ranked.groupBy("media").agg(
        F.count_if(F.col("rev_delta") > 0).alias("n_up"),
        F.count_if(F.col("rev_delta") < 0).alias("n_down"),
        F.max(F.when(F.col("_gain_rank") == 1, F.col("product"))).alias("top_gainer_1"),
        F.max(F.when(F.col("_gain_rank") == 2, F.col("product"))).alias("top_gainer_2"),
    )


def _product_compare(fact: DataFrame, cfg: FigureConfig, a: Anchors, keys: list[str],
                     brand: str | None) -> DataFrame:
    f = product_rows(fact, cfg, brand)
    if "media" in keys:
        f = f.where(F.col("media").isNotNull())
    cmp = two_day_compare(f, keys, "ss", a.d_max, a.d_prev, cfg, order=False)
    return cmp.where((F.col("product") != cfg.missing) & (strip("product") != "-"))


def product_movers(fact: DataFrame, cfg: FigureConfig, anchors: Anchors | None = None,
                   gainers: bool = True, k: int = 10, brand: str | None = None) -> DataFrame:
    """Product-page day-over-day SS comparison; gainers (change > 0) in
    influence order, or losers (change < 0) from the largest fall; top k."""
    a = anchors_of(fact, anchors)
    cmp = _product_compare(fact, cfg, a, ["product"], brand)
    if gainers:
        return top_k(cmp.where("rev_delta > 0"), influence_order(["product"]), k)
    return top_k(cmp.where("rev_delta < 0"), ["rev_delta ASC", "product ASC"], k)


def media_product_movers(fact: DataFrame, cfg: FigureConfig, anchors: Anchors | None = None,
                         gainers: bool = True, k: int = 10,
                         brand: str | None = None) -> DataFrame:
    """J15 per media of the product pages."""
    a = anchors_of(fact, anchors)
    cmp = _product_compare(fact, cfg, a, ["media", "product"], brand)
    if gainers:
        return top_k_per_group(cmp.where("rev_delta > 0"), ["media"],
                               ["influence DESC", "product ASC"], k)
    return top_k_per_group(cmp.where("rev_delta < 0"), ["media"],
                           ["rev_delta ASC", "product ASC"], k)
