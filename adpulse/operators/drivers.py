"""Drill-down of a day's change: channel section → media → product / campaign,
the media summary and the per-media change tables (J9-J14, J17-J19).

The reference walks this tree with one filter-and-compare per node. Here each
level is ONE grouped comparison over the two days for all parents at once,
ranked with a grouped top-k; a child level is attached to its parents by a
join with the (bounded) parent list. Drill-downs read the whole fact, not the
channel slice, so a media present in two channels drills across both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adpulse.config import FigureConfig
from adpulse.functions.measures import sql_str
from adpulse.sources.schema import column_absent
from adpulse.functions.labels import (direction, is_market_channel, is_store_channel,
                                      path_label, truncate_label, valid_label)
from adpulse.operators.anchors import Anchors, anchors_of
from adpulse.operators.compare import (influence_cols, influence_order, two_day_compare,
                                       two_day_sums, with_deltas)
from adpulse.operators.ranking import creative_rows, top_k_per_group
from adpulse.operators.totals import brand_filter

SECTIONS = ("store", "market")


def _section(cfg: FigureConfig) -> Column:
    """Channel sections a row belongs to (a row may match both rules)."""
    tags = F.array(F.when(is_store_channel(cfg), F.lit("store")),
                   F.when(is_market_channel(cfg), F.lit("market")))
    return F.filter(tags, lambda x: x.isNotNull())


def _sectioned(fact: DataFrame, cfg: FigureConfig, a: Anchors) -> DataFrame:
    f = fact.where(F.col("activity_date").isin(a.d_max, a.d_prev))
    if column_absent(fact, "channel"):
        # No channel column in the source: the store section is the whole
        # fact and the market section is empty.
        return f.withColumn("section", F.lit("store"))
    return f.select("*", F.explode(_section(cfg)).alias("section"))


def _rows_of_media(fact: DataFrame, media: DataFrame, cfg: FigureConfig) -> DataFrame:
    """Rows whose (missing-filled) media is in ``media``: a semi-join with the
    parent list, applied before any aggregation so only the parents' rows are
    grouped and shuffled. The list is the caller's, so Spark picks the join by
    its size."""
    filled = fact.withColumn(
        "media", F.expr(f"coalesce(CAST(media AS STRING), {sql_str(cfg.missing)})"))
    return filled.join(media.select("media").distinct(), "media", "left_semi")


def channel_headline(fact: DataFrame, cfg: FigureConfig,
                     anchors: Anchors | None = None) -> DataFrame:
    """Per channel section, SS revenue, cost and ROAS on both days and the
    changes. A section without rows on either day has no row."""
    a = anchors_of(fact, anchors)
    sums = two_day_sums(_sectioned(fact, cfg, a), ["section"], "ss", a.d_max, a.d_prev, cfg,
                        fill_keys=False)
    return with_deltas(sums, ["section"]).withColumn("direction", direction("rev_delta", True))


def channel_drivers(fact: DataFrame, cfg: FigureConfig, anchors: Anchors | None = None,
                    k: int = 3) -> DataFrame:
    """Per channel section, the k media with the largest absolute SS
    revenue change."""
    a = anchors_of(fact, anchors)
    f = _sectioned(fact, cfg, a)
    cmp = with_deltas(two_day_sums(f, ["section", "media"], "ss", a.d_max, a.d_prev, cfg),
                      ["section", "media"])
    top = top_k_per_group(cmp, ["section"], influence_order(["media"]), k)
    return top.withColumn("direction", direction("rev_delta", True))


def media_product_drivers(fact: DataFrame, cfg: FigureConfig, anchors: Anchors | None = None,
                          k_media: int = 3, k: int = 3,
                          top_media: DataFrame | None = None) -> DataFrame:
    """Under each top media of a section (media holding the market marker
    skipped), the k products with the largest absolute SS revenue change,
    valid product labels only, over the whole fact of that media.

    The parent list has at most k_media rows per section, so it is broadcast.
    """
    a = anchors_of(fact, anchors)
    parents = top_media if top_media is not None else channel_drivers(fact, cfg, a, k_media)
    parents = (parents.where(~F.col("media").contains(cfg.market_marker))
                      .select("section", F.col("rank").alias("media_rank"), "media"))
    f = _rows_of_media(fact.where(valid_label("product", cfg)), parents, cfg)
    cmp = two_day_compare(f, ["media", "product"], "ss", a.d_max, a.d_prev, cfg, order=False)
    joined = cmp.join(parents, "media")
    top = top_k_per_group(joined, ["section", "media"], influence_order(["product"]), k)
    return top.select("section", "media_rank", "media", "rank", "product",
                      truncate_label("product", cfg.label_len_long).alias("product_label"),
                      *[c for c in cmp.columns if c not in ("media", "product")],
                      direction("rev_delta", True).alias("direction"))


def display_media_breakdown(fact: DataFrame, cfg: FigureConfig,
                            anchors: Anchors | None = None, order: bool = True) -> DataFrame:
    """The display sub-media, DB basis, all of them, by influence."""
    a = anchors_of(fact, anchors)
    f = fact.where(F.col("media").isin(*cfg.display_sub_media))
    cmp = two_day_compare(f, ["media"], "db", a.d_max, a.d_prev, cfg, order=order)
    return cmp.withColumn("direction", direction("rev_delta", True))


def media_campaign_drivers(fact: DataFrame, cfg: FigureConfig, anchors: Anchors | None = None,
                           k: int = 3, only_media: DataFrame | None = None) -> DataFrame:
    """Per media, the k campaign/group pairs with the largest absolute DB
    revenue change, labelled 'campaign > group'. ``only_media`` (a bounded
    list) restricts the work to those media before aggregating."""
    a = anchors_of(fact, anchors)
    if only_media is not None:
        fact = _rows_of_media(fact, only_media, cfg)
    keys = ["media", "campaign", "ad_group"]
    cmp = two_day_compare(fact, keys, "db", a.d_max, a.d_prev, cfg, order=False)
    top = top_k_per_group(cmp, ["media"], influence_order(["campaign", "ad_group"]), k)
    return top.withColumn("label", path_label(["campaign", "ad_group"], cfg,
                                              cfg.path_fallback_driver)) \
              .withColumn("direction", direction("rev_delta", True))


def media_summary(fact: DataFrame, cfg: FigureConfig,
                  anchors: Anchors | None = None) -> DataFrame:
    """Every media by absolute SS revenue change with its top campaign/
    group by DB change as 'campaign > group' ('-' when none)."""
    a = anchors_of(fact, anchors)
    ss = two_day_compare(fact, ["media"], "ss", a.d_max, a.d_prev, cfg, order=False)
    top1 = (media_campaign_drivers(fact, cfg, a, k=1)
            .select("media", path_label(["campaign", "ad_group"], cfg, cfg.path_fallback_summary)
                    .alias("key_campaign")))
    out = ss.join(top1, "media", "left").select(
        "media", "rev_cur", "rev_delta", "cost_delta", "roas_cur", "roas_delta", "influence",
        F.coalesce(F.col("key_campaign"), F.lit(cfg.path_fallback_summary)).alias("key_campaign"))
    return out.orderBy(*influence_cols(["media"]))


def _per_media_change(fact: DataFrame, cfg: FigureConfig, a: Anchors, keys: list[str],
                      basis: str, k: int) -> DataFrame:
    cmp = two_day_compare(fact.where(F.col("media").isNotNull()), ["media"] + keys, basis,
                          a.d_max, a.d_prev, cfg, order=False)
    return top_k_per_group(cmp, ["media"], influence_order(keys), k)


def campaign_change_top(fact: DataFrame, cfg: FigureConfig, anchors: Anchors | None = None,
                        k: int = 20, brand: str | None = None) -> DataFrame:
    """Per media, top k campaign/group pairs by absolute DB change."""
    a = anchors_of(fact, anchors)
    return _per_media_change(brand_filter(fact, brand), cfg, a, ["campaign", "ad_group"], "db", k)


def keyword_change_top(fact: DataFrame, cfg: FigureConfig, anchors: Anchors | None = None,
                       k: int = 20, brand: str | None = None) -> DataFrame:
    """Keyword media, valid keywords, top k by absolute SS change."""
    a = anchors_of(fact, anchors)
    f = brand_filter(fact, brand).where(
        F.col("media").isin(*cfg.keyword_media) & valid_label("keyword"))
    return _per_media_change(f, cfg, a, ["keyword"], "ss", k)


def creative_change_top(fact: DataFrame, cfg: FigureConfig, anchors: Anchors | None = None,
                        k: int = 20, campaign: str | None = None, ad_group: str | None = None,
                        brand: str | None = None) -> DataFrame:
    """Creative media, valid creatives (optionally one campaign and group),
    top k by absolute DB change."""
    a = anchors_of(fact, anchors)
    f = creative_rows(fact, cfg, campaign, ad_group, brand)
    return _per_media_change(f, cfg, a, ["creative"], "db", k)


TREE_COLUMNS = ("section", "level", "parent", "rank", "label", "basis", "rev_cur",
                "rev_delta", "cost_cur", "cost_delta", "buy_delta", "roas_cur", "roas_delta")


def drilldown_tree(fact: DataFrame, cfg: FigureConfig, anchors: Anchors | None = None,
                   k: int = 3) -> DataFrame:
    """The whole day-change tree as one long frame: for each channel section,
    its top media (SS), under each the top products (SS, market media
    skipped), the top campaign/group pairs (DB) and, for display media, every
    display sub-media (DB)."""
    a = anchors_of(fact, anchors)
    media = channel_drivers(fact, cfg, a, k)
    parents = media.select("section", "media", F.col("rank").alias("media_rank"))

    def shape(df: DataFrame, level: str, parent: Column, label: Column, basis: str) -> DataFrame:
        return df.select(F.col("section"), F.lit(level).alias("level"), parent.alias("parent"),
                         F.col("rank"), label.alias("label"), F.lit(basis).alias("basis"),
                         "rev_cur", "rev_delta", "cost_cur", "cost_delta", "buy_delta",
                         "roas_cur", "roas_delta")

    lvl_media = shape(media, "media", F.lit(None).cast("string"), F.col("media"), "ss")
    products = media_product_drivers(fact, cfg, a, k, k, top_media=media)
    lvl_product = shape(products, "product", F.col("media"), F.col("product_label"), "ss")
    camp = (media_campaign_drivers(fact, cfg, a, k, only_media=parents)
            .join(F.broadcast(parents), "media"))
    lvl_campaign = shape(camp, "campaign", F.col("media"), F.col("label"), "db")
    # Every display parent gets the same sub-media breakdown. The breakdown
    # (one row per display sub-media, bounded by configuration) is tagged with
    # every section and joined to the display parents on the section.
    display = (display_media_breakdown(fact, cfg, a, order=False)
               .withColumn("rank", F.row_number().over(
                   Window.partitionBy().orderBy(*influence_cols(["media"]))).cast("bigint"))
               .withColumnRenamed("media", "sub_media")
               .withColumn("section", F.explode(F.array(*[F.lit(x) for x in SECTIONS]))))
    display_parents = parents.where(F.col("media").contains(cfg.display_marker))
    lvl_display = shape(display.join(F.broadcast(display_parents), "section"),
                        "display_sub_media", F.col("media"), F.col("sub_media"), "db")
    return lvl_media.unionByName(lvl_product).unionByName(lvl_campaign).unionByName(lvl_display)
