"""Advertising fact derived from the driver's TPC-H-shaped tables.

The driver tables carry no advertising data, so the fact is a fixed mapping of
``lineitem ⋈ supplier ⋈ nation ⋈ region ⋈ part`` onto the canonical schema.
The same mapping exists as SQL text (``FACT_CTE``) for the DuckDB oracle.

Joins: nation and region have a fixed size (25 and 5 rows), so they are
broadcast explicitly. Supplier and part grow with the scale factor. Supplier's join
strategy is left to Catalyst/AQE, which broadcasts only below
``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles. Part always comes by a
shuffle: the rows must be dealt to tasks once anyhow, to be sorted by date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adpulse.sources.schema import FACT_COLUMNS, MONEY_TYPE


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fact is derived from, a row a line item, with each label once. Part meets
    the line items in a shuffle at any size, the only one that they make (where supplier
    is small); it also deals them to tasks of like size."""
    li = _read(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    region = _read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    geo = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    supplier = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    # nation and region come after the shuffle, as a key until then
    return (li.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
              .join(part.hint("merge"), F.col("l_partkey") == F.col("p_partkey"))
              .join(F.broadcast(geo), F.col("s_nationkey") == F.col("n_nationkey"))
              .select(F.to_date("l_shipdate").alias("activity_date"), "l_linenumber", "l_quantity", "l_extendedprice",
                      "l_discount", "l_tax", "l_returnflag", "l_linestatus", "n_name", "r_name", "p_name", "p_brand", "p_type"))


def fact_of(rows: DataFrame) -> DataFrame:
    """The fact of `source_rows`, row by row: a projection, which keeps their order."""
    # Precision stays <= 18 through the products below (decimal(12,2) ×
    # decimal(4,2) → decimal(17,4)), so Spark keeps the long-backed decimal
    # path; extended prices are far below 10^10.
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    label = F.when(F.col("l_returnflag") == "N", F.lit("-")).otherwise(F.col("p_name"))
    zero = F.lit(0).cast(MONEY_TYPE)
    out = rows.select(
        "activity_date",
        (F.when(F.col("r_name") == "ASIA", F.lit("storefront"))
          .when(F.col("r_name") == "EUROPE", F.lit("market_a"))
          .when(F.col("r_name") == "MIDDLE EAST", F.lit(None).cast("string"))
          .otherwise(F.lower("r_name"))).alias("channel"),
        F.col("n_name").alias("media"),
        F.col("p_brand").alias("campaign"),
        F.when(F.col("p_type") == "LARGE", F.lit(None).cast("string"))
         .otherwise(F.col("p_type")).alias("ad_group"),
        label.alias("creative"),
        label.alias("keyword"),
        F.col("l_linestatus").alias("brand"),
        (F.when(F.col("l_linenumber") == 7, F.lit(None).cast("string"))
          .when(F.col("l_linenumber") == 6, F.lit("-"))
          .otherwise(F.col("p_name"))).alias("product"),
        (F.when(F.col("p_type") == "PROMO", F.lit("always_on"))
          .when(F.col("p_type") == "STANDARD", F.lit(None).cast("string"))
          .otherwise(F.col("p_type"))).alias("promo"),
        (F.col("l_quantity") * 100).cast("bigint").alias("impressions"),
        F.col("l_quantity").cast("bigint").alias("clicks"),
        (price * F.col("l_discount").cast("decimal(4,2)")).cast(MONEY_TYPE).alias("cost"),
        price.cast(MONEY_TYPE).alias("rev_ss"),
        (price * (F.lit(1).cast("decimal(1,0)") - F.col("l_tax").cast("decimal(4,2)")))
        .cast(MONEY_TYPE).alias("rev_db"),
        F.col("l_quantity").cast("bigint").alias("buy_ss"),
        F.col("l_linenumber").cast("bigint").alias("buy_db"),
        zero.alias("rev_market_a"),
        zero.alias("rev_market_b"),
    )
    return out.select(*FACT_COLUMNS)


def ad_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_of(source_rows(spark, sf_dir))


# The same mapping as DuckDB SQL; oracle queries start with this CTE.
FACT_CTE = """
WITH ad_fact AS (
  SELECT
    CAST(l.l_shipdate AS DATE) AS activity_date,
    CASE r.r_name WHEN 'ASIA' THEN 'storefront' WHEN 'EUROPE' THEN 'market_a'
                  WHEN 'MIDDLE EAST' THEN NULL ELSE lower(r.r_name) END AS channel,
    n.n_name AS media,
    p.p_brand AS campaign,
    CASE WHEN p.p_type = 'LARGE' THEN NULL ELSE p.p_type END AS ad_group,
    CASE l.l_returnflag WHEN 'N' THEN '-' ELSE p.p_name END AS creative,
    CASE l.l_returnflag WHEN 'N' THEN '-' ELSE p.p_name END AS keyword,
    l.l_linestatus AS brand,
    CASE WHEN l.l_linenumber = 7 THEN NULL WHEN l.l_linenumber = 6 THEN '-'
         ELSE p.p_name END AS product,
    CASE p.p_type WHEN 'PROMO' THEN 'always_on' WHEN 'STANDARD' THEN NULL
                  ELSE p.p_type END AS promo,
    CAST(l.l_quantity * 100 AS BIGINT) AS impressions,
    CAST(l.l_quantity AS BIGINT) AS clicks,
    CAST(CAST(l.l_extendedprice AS DECIMAL(12,2)) * CAST(l.l_discount AS DECIMAL(4,2))
         AS DECIMAL(18,4)) AS cost,
    CAST(CAST(l.l_extendedprice AS DECIMAL(12,2)) AS DECIMAL(18,4)) AS rev_ss,
    CAST(CAST(l.l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l.l_tax AS DECIMAL(4,2)))
         AS DECIMAL(18,4)) AS rev_db,
    CAST(l.l_quantity AS BIGINT) AS buy_ss,
    CAST(l.l_linenumber AS BIGINT) AS buy_db,
    CAST(0 AS DECIMAL(18,4)) AS rev_market_a,
    CAST(0 AS DECIMAL(18,4)) AS rev_market_b
  FROM lineitem l
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey
)"""
