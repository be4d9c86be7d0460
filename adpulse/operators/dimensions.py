"""Dimension lists and label filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adpulse.config import FigureConfig
from adpulse.functions.labels import truncate_label, valid_label

FILTER_DIMENSIONS = ("brand", "media", "campaign", "ad_group")


def dimension_values(fact: DataFrame, dims: tuple[str, ...] = FILTER_DIMENSIONS) -> DataFrame:
    """distinct non-null values of each filter dimension, as text, sorted.

    The distinct combinations come first (partial aggregation leaves a few
    thousand rows of them); only these fan out to one pair per dimension.
    """
    dims = [d for d in dims if d in fact.columns]
    keys = fact.select(*[F.col(d).cast("string").alias(d) for d in dims]).distinct()
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dims])
    out = keys.select(F.inline(pairs)).where(F.col("value").isNotNull()).distinct()
    return out.orderBy("dimension", "value")


def cascading_filter(fact: DataFrame, cfg: FigureConfig) -> DataFrame:
    """for creative media, the campaign choices and, under each, the group
    choices (rows with a valid creative only). A campaign whose groups are all
    null appears once with a null group."""
    f = fact.where(F.col("media").isin(*cfg.creative_media) & valid_label("creative")
                   & F.col("campaign").isNotNull())
    trip = f.select("media", F.col("campaign").cast("string").alias("campaign"),
                    F.col("ad_group").cast("string").alias("ad_group")).distinct()
    # Keep a null group only when the campaign has no named group: a count
    # over the campaign's distinct groups (window on the deduplicated rows,
    # no self-join).
    named = F.count("ad_group").over(Window.partitionBy("media", "campaign"))
    out = trip.withColumn("_named", named) \
              .where(F.col("ad_group").isNotNull() | (F.col("_named") == 0)) \
              .drop("_named")
    return out.orderBy("media", "campaign", "ad_group")


def choice_keys(fact: DataFrame, cfg: FigureConfig) -> DataFrame:
    """The distinct keys that the choice lists and the promo classes of the whole
    history need, from one pass: its rows stand for the fact's in
    ``dimension_values``, ``cascading_filter`` and as ``history`` of ``promo_split``
    (which look at keys, not at measures)."""
    cols = [c for c in (*FILTER_DIMENSIONS, "promo") if c in fact.columns]
    usable = F.when(valid_label("creative"), F.lit("x"))
    return fact.select(*cols, usable.alias("creative")).distinct()


def valid_product_rows(fact: DataFrame, cfg: FigureConfig) -> DataFrame:
    """fact rows whose product label is usable (not null, not blank, not
    '-', not the missing label)."""
    return fact.where(valid_label("product", cfg)).select(
        "activity_date", "channel", "media", "product", "rev_ss", "buy_ss")


def product_labels(fact: DataFrame, cfg: FigureConfig) -> DataFrame:
    """Every distinct product with its long (drill-down) and short (chart)
    label."""
    p = fact.select("product").where(F.col("product").isNotNull()).distinct()
    return p.select("product",
                    truncate_label("product", cfg.label_len_long).alias("label_long"),
                    truncate_label("product", cfg.label_len_short).alias("label_short"),
                    F.length("product").cast("bigint").alias("n_chars"))
