"""Top-k tables: global and per-group rankings.

Grouped top-k is ``row_number() over (partition by g order by metric desc,
keys) <= k``. Catalyst turns it into a WindowGroupLimit, so each task keeps at
most k rows per group before the shuffle, and the ranking input is already an
aggregate (one row per group key), never raw rows. Every order ends with the
key columns so ties are settled the same way on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adpulse.config import FigureConfig
from adpulse.functions.labels import is_store_channel, truncate_label, valid_label
from adpulse.functions.measures import csum, out_measure, q, roas
from adpulse.operators.anchors import Anchors, anchors_of
from adpulse.operators.totals import brand_filter
from adpulse.sources.schema import column_absent


def _order_sql(order: list) -> str | None:
    """ORDER BY text when every item is SQL text such as 'rev_ss DESC'."""
    return ", ".join(order) if all(isinstance(o, str) for o in order) else None


def top_k_per_group(df: DataFrame, group: list[str], order: list, k: int,
                    rank_col: str = "rank") -> DataFrame:
    """Rank 1..k per group; ``order`` items are SQL text ('rev_ss DESC') or
    Columns. ASC puts nulls first and DESC puts them last, as Spark does."""
    text = _order_sql(order)
    if text is not None:
        parts = ", ".join(q(g) for g in group)
        ranked = df.selectExpr(
            "*", f"CAST(row_number() OVER (PARTITION BY {parts} ORDER BY {text}) AS BIGINT)"
                 f" AS {q(rank_col)}")
        return ranked.where(f"{q(rank_col)} <= {int(k)}")
    w = Window.partitionBy(*group).orderBy(*order)
    return (df.withColumn(rank_col, F.row_number().over(w).cast("bigint"))
              .where(F.col(rank_col) <= k))


def top_k(df: DataFrame, order: list, k: int, rank_col: str = "rank") -> DataFrame:
    """Global top-k with a 1..k rank column: a TakeOrderedAndProject (each task
    sends k rows), then ranks over those k rows."""
    cols = [sort_col(o) for o in order]
    head = df.orderBy(*cols).limit(k)
    return head.withColumn(rank_col,
                           F.row_number().over(Window.partitionBy().orderBy(*cols)).cast("bigint"))


def sort_col(o) -> Column:
    """A sort Column from SQL-ish text 'name DESC' / 'name ASC' (or a Column)."""
    if not isinstance(o, str):
        return o
    name, _, direction = o.strip().rpartition(" ")
    name = name.strip().strip("`")
    return F.col(name).desc() if direction.upper() == "DESC" else F.col(name).asc()


def _mtd(fact: DataFrame, a: Anchors) -> DataFrame:
    return fact.where(F.col("activity_date").between(a.month_start, a.d_max))


def _sums(cols: list[str]) -> list[Column]:
    return [csum(c).alias(c) for c in cols]


def _typed(cols: list[str]) -> list[Column]:
    return [out_measure(F.col(c), c) for c in cols]


ALL7 = ["impressions", "clicks", "cost", "rev_ss", "buy_ss", "rev_db", "buy_db"]


def campaign_mtd_top(fact: DataFrame, anchors: Anchors | None = None, k: int = 30,
                     brand: str | None = None) -> DataFrame:
    """Per media, campaign × group month-to-date sums with both ROAS, top k
    by SS revenue. Null campaign/group stay groups; null media is not a page."""
    a = anchors_of(fact, anchors)
    f = _mtd(brand_filter(fact, brand), a).where(F.col("media").isNotNull())
    g = f.groupBy("media", "campaign", "ad_group").agg(*_sums(ALL7))
    g = g.select("media", "campaign", "ad_group", *_typed(ALL7),
                 roas("rev_ss", "cost").alias("roas_ss"), roas("rev_db", "cost").alias("roas_db"))
    order = ["rev_ss DESC", "campaign ASC", "ad_group ASC"]
    return top_k_per_group(g, ["media"], order, k)


def keyword_mtd_top(fact: DataFrame, cfg: FigureConfig, anchors: Anchors | None = None,
                    k: int = 20, brand: str | None = None) -> DataFrame:
    """Keyword media only, valid keywords, month-to-date SS revenue,
    purchases, cost and SS ROAS, top k per media by SS revenue."""
    a = anchors_of(fact, anchors)
    f = _mtd(brand_filter(fact, brand), a).where(
        F.col("media").isin(*cfg.keyword_media) & valid_label("keyword"))
    cols = ["rev_ss", "buy_ss", "cost"]
    g = f.groupBy("media", "keyword").agg(*_sums(cols))
    g = g.select("media", "keyword", *_typed(cols), roas("rev_ss", "cost").alias("roas_ss"))
    return top_k_per_group(g, ["media"], ["rev_ss DESC", "keyword ASC"], k)


def creative_rows(fact: DataFrame, cfg: FigureConfig, campaign: str | None = None,
                  ad_group: str | None = None, brand: str | None = None) -> DataFrame:
    """Creative media's rows with a valid creative, by brand, campaign and group."""
    f = fact.where(F.col("media").isin(*cfg.creative_media) & valid_label("creative"))
    f = brand_filter(brand_filter(f, campaign, "campaign"), ad_group, "ad_group")
    return brand_filter(f, brand)


def creative_mtd_top(fact: DataFrame, cfg: FigureConfig, anchors: Anchors | None = None,
                     k: int = 20, campaign: str | None = None,
                     ad_group: str | None = None, brand: str | None = None) -> DataFrame:
    """A10: creative media only, valid creatives (optionally one campaign and
    group), month-to-date sums and both ROAS, top k per media by DB revenue."""
    a = anchors_of(fact, anchors)
    f = _mtd(creative_rows(fact, cfg, campaign, ad_group, brand), a)
    cols = ["rev_ss", "buy_ss", "cost", "rev_db", "buy_db"]
    g = f.groupBy("media", "creative").agg(*_sums(cols))
    g = g.select("media", "creative", *_typed(cols), roas("rev_ss", "cost").alias("roas_ss"),
                 roas("rev_db", "cost").alias("roas_db"))
    return top_k_per_group(g, ["media"], ["rev_db DESC", "creative ASC"], k)


def product_rows(fact: DataFrame, cfg: FigureConfig, brand: str | None = None) -> DataFrame:
    """Rows of the product pages: store channel, valid product label, excluded
    media removed (a null media is kept, as the reference's negated match).
    A source without a channel column gets no channel filter."""
    keep = valid_label("product") & ~F.coalesce(F.col("media"), F.lit("")).rlike(
        cfg.product_excluded_media)
    # Without a channel column in the source, the page has no channel filter.
    if not column_absent(fact, "channel"):
        keep = is_store_channel(cfg) & keep
    f = fact.where(keep)
    return brand_filter(f, brand)


def mtd_top_products(fact: DataFrame, cfg: FigureConfig, anchors: Anchors | None = None,
                     k: int = 10, brand: str | None = None) -> DataFrame:
    """A11 + F13: month-to-date top k products by SS revenue, ranked 1..k,
    with the short chart label."""
    a = anchors_of(fact, anchors)
    f = _mtd(product_rows(fact, cfg, brand), a)
    cols = ["rev_ss", "buy_ss"]
    g = f.groupBy("product").agg(*_sums(cols)).select("product", *_typed(cols))
    out = top_k(g, ["rev_ss DESC", "product ASC"], k)
    return out.select("rank", "product", truncate_label("product", cfg.label_len_short)
                      .alias("short_label"), "rev_ss", "buy_ss")


def media_top_products(fact: DataFrame, cfg: FigureConfig, anchors: Anchors | None = None,
                       k: int = 10, last_day_only: bool = False,
                       brand: str | None = None) -> DataFrame:
    """Per media of the product pages, top k products by SS revenue,
    month to date or on the last day only."""
    a = anchors_of(fact, anchors)
    f = product_rows(fact, cfg, brand).where(F.col("media").isNotNull())
    if last_day_only:
        f = f.where(F.col("activity_date") == F.lit(a.d_max))
    else:
        f = _mtd(f, a)
    cols = ["rev_ss", "buy_ss"]
    g = f.groupBy("media", "product").agg(*_sums(cols)).select("media", "product", *_typed(cols))
    return top_k_per_group(g, ["media"], ["rev_ss DESC", "product ASC"], k)
