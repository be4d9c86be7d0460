"""Registered queries over the driver tables.

Each entry takes (spark, sf_dir) and returns a DataFrame. The fact is the
fixed mapping of the TPC-H-shaped tables (``sources.tpch_fact``); anchors are
resolved once per call (a one-row job) and passed on as literal dates.

``*_all`` variants run a month-to-date ranking over the whole history so the
top-k limits really cut something at small scale factors.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import threading
import time
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adpulse.config import TEST_CONFIG as CFG
from adpulse.functions.formatting import CTR_DECIMALS, money_text, pct_text, signed_money_text, signed_points_text
from adpulse.operators import dimensions, drivers, kpi, periods, products, promo, ranking, totals
from adpulse.operators.anchors import Anchors, anchors_from_dates, day_anchors
from adpulse.operators.compare import two_day_compare
from adpulse.operators.parity import parity_totals, restated_days, snapshot_parity
from adpulse.sources.schema import FACT_SCHEMA, conform
from adpulse.sources.snapshots import audit_rows, write_fact
from adpulse.sources.storage import file_identity, path_exists, read_text, write_new_text
from adpulse.sources.targets import targets_frame
from adpulse.sources.tpch_fact import FACT_CTE, fact_of, source_rows

# Targets of the test mapping: store, marketplace by exact name (a longer
# name is not the marketplace) and by alias, everything else, an unknown
# channel, an alias of the store rule with a zero target, and a duplicate
# where the later row wins.
TEST_TARGETS = [
    ("storefront", 50000, 2000000, 400),
    ("market_a", 40000, 1500000, 350),
    ("market_ab", 1000, 2000, 100),
    ("MKT team", 1000, 700000, 100),
    ("othermall", 30000, 900000, 300),
    ("unknown_x", 1000, 5000, 100),
    ("Store Team ", 0, 0, 0),
    ("othermall", 35000, 1000000, 300),
]
BRAND = "O"
DETAIL_BRAND = "F"
CAMPAIGN, AD_GROUP = "Brand#8", "PROMO"


SOURCE_TABLES = ("lineitem", "supplier", "nation", "region", "part")
#: The setting that names the folder for snapshots (shared by all executors).
SNAPSHOT_SETTING = "spark.adpulse.snapshots"
#: The days of a snapshot, one a line, beside its files.
DAY_LIST = "_days"
INGEST_SECONDS: dict[str, float] = {}
_LOCK = threading.Lock()


def snapshot_folder(spark: SparkSession) -> str:
    """The folder that ``spark.adpulse.snapshots`` names, else that of
    ``spark.checkpoint.dir``; in local mode, where one machine does all, the
    warehouse folder will do."""
    folder = spark.conf.get(SNAPSHOT_SETTING, None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        # a remote session does not say its master: it is not taken for a local one
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError(f"set {SNAPSHOT_SETTING} to a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/adpulse"


def snapshot_path(spark: SparkSession, sf_dir: str) -> str:
    """The snapshot of the driver tables, ingested once.

    As in the reference (a workbook is converted to Parquet once, then every
    figure reads the Parquet), the fact is derived from the source tables once
    per state of their files (names, lengths, modification times) and written
    by the same step as any snapshot. A changed part file gives another
    snapshot. Its list of days is stored beside it, last: without that list an
    interrupted write is redone.
    """
    tables = [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in SOURCE_TABLES]
    state = repr((file_identity(spark, tables), FACT_CTE))
    path = f"{snapshot_folder(spark)}/ad_fact-{hashlib.sha1(state.encode()).hexdigest()[:16]}"
    with _LOCK:
        if not path_exists(spark, f"{path}/{DAY_LIST}"):
            t0 = time.perf_counter()
            write_fact(source_rows(spark, sf_dir), path, partition_by=None, derive=fact_of)
            days = spark.read.schema(FACT_SCHEMA).parquet(path).select("activity_date").distinct().na.drop()
            listed = sorted(r["activity_date"].isoformat() for r in days.collect())  # one row a day
            write_new_text(spark, f"{path}/{DAY_LIST}", "\n".join(listed))
            INGEST_SECONDS[sf_dir] = time.perf_counter() - t0
    return path


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FACT_SCHEMA).parquet(path)


def _days(spark: SparkSession, path: str) -> list[dt.date]:
    return [dt.date.fromisoformat(d) for d in read_text(spark, f"{path}/{DAY_LIST}").split()]


def snapshot_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, snapshot_path(spark, sf_dir))


def snapshot_days(spark: SparkSession, sf_dir: str) -> list[dt.date]:
    """The days of the snapshot, from the list beside it: no job reads the fact."""
    return _days(spark, snapshot_path(spark, sf_dir))


def _fa(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Anchors]:
    """The snapshot and its anchors."""
    path = snapshot_path(spark, sf_dir)
    return _read(spark, path), anchors_from_dates(_days(spark, path))


def q_compare_media_ss(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return two_day_compare(f, ["media"], "ss", a.d_max, a.d_prev, CFG)


def q_compare_campaign_db(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return two_day_compare(f, ["campaign", "ad_group"], "db", a.d_max, a.d_prev, CFG)


def q_day_anchors(spark, sf_dir):
    return day_anchors(snapshot_fact(spark, sf_dir))


MONEY_COLUMNS = ("cost", "rev_ss", "rev_db", "rev_market_a", "rev_market_b")


def _money_as_double(df: DataFrame) -> DataFrame:
    """Output typing for comparison: money as DOUBLE (exact DECIMAL inside)."""
    return df.select(*[F.col(c).cast("double").alias(c) if c in MONEY_COLUMNS else F.col(c)
                       for c in df.columns])


def q_scan_snapshot(spark, sf_dir):
    """The ingested snapshot read back through the canonical conform step."""
    return _money_as_double(conform(snapshot_fact(spark, sf_dir), headers={}, keep_extra=False))


def q_ingest_audit(spark, sf_dir):
    return audit_rows(snapshot_fact(spark, sf_dir))


def q_product_date_extent(spark, sf_dir):
    """First and last day (and day count) of the product pages' rows."""
    f, a = _fa(spark, sf_dir)
    return totals.date_extent(ranking.product_rows(f, CFG))


def q_period_totals(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return totals.period_totals(f, a.d_max - dt.timedelta(days=6), a.d_max)


def q_mtd_totals(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return totals.mtd_totals(f, a)


def q_mtd_totals_by_brand(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return totals.mtd_totals(f, a, brand=BRAND)


def q_mtd_basis_table(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return totals.basis_table(totals.mtd_totals(f, a))


def q_daily_detail(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return totals.daily_detail(f, a, brand=DETAIL_BRAND)


def q_media_mtd(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return totals.media_mtd(f, a)


def q_kpi_attainment(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return kpi.kpi_attainment(f, targets_frame(spark, TEST_TARGETS), CFG, a)


def q_campaign_mtd_top30(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return ranking.campaign_mtd_top(f, a, k=30)


def q_campaign_top30_all(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return ranking.campaign_mtd_top(f, _all_month(a), k=30)


def _all_month(a: Anchors) -> Anchors:
    return _AllHistory(a.d_max, a.d_prev, a.d_min)


class _AllHistory(Anchors):
    """Anchors whose month start is the first day of the history."""

    @property
    def month_start(self):
        return self.d_min


def q_keyword_mtd_top20(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return ranking.keyword_mtd_top(f, CFG, a, k=20)


def q_keyword_top20_all(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return ranking.keyword_mtd_top(f, CFG, _all_month(a), k=20)


def q_creative_mtd_top20(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return ranking.creative_mtd_top(f, CFG, a, k=20)


def q_creative_top20_all(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return ranking.creative_mtd_top(f, CFG, _all_month(a), k=20)


def q_mtd_top_products(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return ranking.mtd_top_products(f, CFG, a, k=10)


def q_top_products_all(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return ranking.mtd_top_products(f, CFG, _all_month(a), k=10)


def q_media_top_products_mtd(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return ranking.media_top_products(f, CFG, a, k=10)


def q_media_top_products_all(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return ranking.media_top_products(f, CFG, _all_month(a), k=10)


def q_media_top_products_day(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return ranking.media_top_products(f, CFG, a, k=10, last_day_only=True)


def q_media_daily(spark, sf_dir):
    """A14 as rows (the wide form's columns depend on the data)."""
    return totals.media_daily(snapshot_fact(spark, sf_dir), days=snapshot_days(spark, sf_dir))


def q_promo_split(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return promo.promo_split(f, CFG, a)


def q_roas_trend(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return totals.roas_trend(f, a.d_max, 7, days=snapshot_days(spark, sf_dir))


def q_product_top10(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return products.product_top10(f, CFG, a)


def q_product_top10_summary(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return products.product_top10_summary(products.product_top10(f, CFG, a))


def q_multi_period(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return periods.multi_period(f, anchors=a)


def q_multi_period_week(spark, sf_dir):
    """A 7-day selection ending on the last day: its −7 period touches it."""
    f, a = _fa(spark, sf_dir)
    return periods.multi_period(f, a.d_max - dt.timedelta(days=6), a.d_max, a)


def q_multi_period_delta(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return periods.multi_period_delta(f, "ss", anchors=a)


def q_multi_period_delta_db(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return periods.multi_period_delta(f, "db", anchors=a)


def q_period_delta(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return periods.period_delta(f, anchors=a)


def q_daily_headline(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return periods.daily_headline(f, a)


def q_channel_headline(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return drivers.channel_headline(f, CFG, a)


def q_channel_drivers(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return drivers.channel_drivers(f, CFG, a)


def q_media_product_drivers(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return drivers.media_product_drivers(f, CFG, a)


def q_display_media_breakdown(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return drivers.display_media_breakdown(f, CFG, a)


def q_media_campaign_drivers(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return drivers.media_campaign_drivers(f, CFG, a)


def q_media_summary(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return drivers.media_summary(f, CFG, a)


def q_drilldown_tree(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return drivers.drilldown_tree(f, CFG, a)


def q_product_gainers(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return products.product_movers(f, CFG, a, gainers=True)


def q_product_losers(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return products.product_movers(f, CFG, a, gainers=False)


def q_media_product_gainers(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return products.media_product_movers(f, CFG, a, gainers=True)


def q_media_product_losers(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return products.media_product_movers(f, CFG, a, gainers=False)


def q_campaign_change_top20(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return drivers.campaign_change_top(f, CFG, a)


def q_keyword_change_top20(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return drivers.keyword_change_top(f, CFG, a)


def q_creative_change_top20(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return drivers.creative_change_top(f, CFG, a)


def q_keyword_mtd_top20_by_brand(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return ranking.keyword_mtd_top(f, CFG, _all_month(a), k=20, brand=DETAIL_BRAND)


def q_creative_mtd_top20_by_brand(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return ranking.creative_mtd_top(f, CFG, _all_month(a), k=20, brand=DETAIL_BRAND)


def q_campaign_change_top20_by_brand(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return drivers.campaign_change_top(f, CFG, a, brand=BRAND)


def q_keyword_change_top20_by_brand(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return drivers.keyword_change_top(f, CFG, a, brand=BRAND)


def q_creative_change_top20_by_brand(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return drivers.creative_change_top(f, CFG, a, brand=BRAND)


def q_creative_top20_of_campaign(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return ranking.creative_mtd_top(f, CFG, _all_month(a), k=20, campaign=CAMPAIGN, ad_group=AD_GROUP)


def q_creative_change_of_group(spark, sf_dir):
    f, a = _fa(spark, sf_dir)
    return drivers.creative_change_top(f, CFG, a, ad_group=AD_GROUP)


def sql_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact derived a second way: the oracle's SQL text run by Spark SQL
    over the same files (same columns, independent expression tree)."""
    base = sf_dir.rstrip("/")
    text = FACT_CTE
    for t in ("lineitem", "supplier", "nation", "region", "part"):
        text = text.replace(f"FROM {t} ", f"FROM parquet.`{base}/{t}.parquet` ") \
                   .replace(f"JOIN {t} ", f"JOIN parquet.`{base}/{t}.parquet` ")
    return spark.sql(text + " SELECT * FROM ad_fact")


def q_snapshot_parity(spark, sf_dir):
    """The stored snapshot against a fresh derivation by the SQL text."""
    return snapshot_parity(snapshot_fact(spark, sf_dir), sql_fact(spark, sf_dir))


def q_snapshot_parity_totals(spark, sf_dir):
    """J20 totals: row counts and the four totals of both, and the verdicts."""
    return parity_totals(snapshot_fact(spark, sf_dir), sql_fact(spark, sf_dir))


def other_snapshot(fact: DataFrame) -> DataFrame:
    """A snapshot that differs from the first: one media lacks a brand's rows,
    another has 0.01 more cost in a row of each day."""
    fewer = (F.col("media") == "NATION_12") & (F.col("brand") == "F")
    more = (F.col("media") == "NATION_3") & (F.col("buy_db") == 1)
    cost = F.when(more, F.col("cost") + F.lit(Decimal("0.0100"))).otherwise(F.col("cost"))
    return fact.where(~F.coalesce(fewer, F.lit(False))).withColumn("cost", cost.cast("decimal(18,4)"))


def q_snapshot_parity_diff(spark, sf_dir):
    """J20 on two snapshots that differ."""
    f = snapshot_fact(spark, sf_dir)
    return snapshot_parity(f, other_snapshot(f))


RESTATED_TAGS = ("t1", "t2", "t3")


def q_restated_days(spark, sf_dir):
    """J20 over three snapshots: the stored one, one that differs in some rows, and the
    stored one without its last day."""
    f, a = _fa(spark, sf_dir)
    columns = ["activity_date", "cost", "rev_ss", "rev_db", "buy_ss"]
    whole = (f.select(F.lit("t1").alias("tag"), *columns)
             .unionByName(other_snapshot(f).select(F.lit("t2").alias("tag"), *columns))
             .unionByName(f.where(F.col("activity_date") < F.lit(a.d_max)).select(F.lit("t3").alias("tag"), *columns)))
    return restated_days(whole, RESTATED_TAGS)


def q_period_table(spark, sf_dir):
    """J4/J6 for a table of periods: from every order date as many days as seven times
    its month, and the same ten years later, where the fact has no rows left."""
    f, a = _fa(spark, sf_dir)
    days = (spark.read.parquet(f"{sf_dir.rstrip('/')}/orders.parquet")
            .select(F.to_date("o_orderdate").alias("period_start")).distinct().na.drop())
    own = days.select("period_start", F.expr("date_add(period_start, 7 * month(period_start) - 1)").alias("period_end"))
    later = own.select(*[F.date_add(c, 3650).alias(c) for c in own.columns])
    return periods.period_table(f, own.unionByName(later), a)


def q_dimension_values(spark, sf_dir):
    return dimensions.dimension_values(snapshot_fact(spark, sf_dir))


def q_cascading_filter(spark, sf_dir):
    return dimensions.cascading_filter(snapshot_fact(spark, sf_dir), CFG)


def q_valid_product_filter(spark, sf_dir):
    return _money_as_double(dimensions.valid_product_rows(snapshot_fact(spark, sf_dir), CFG))


def q_label_truncate(spark, sf_dir):
    return dimensions.product_labels(snapshot_fact(spark, sf_dir), CFG)


def q_format_metrics(spark, sf_dir):
    """The base-vs-comparison table as text."""
    f, a = _fa(spark, sf_dir)
    pd_ = periods.period_delta(f, anchors=a)
    is_pct = F.col("metric").isin("ctr", "roas_ss", "roas_db")
    return pd_.select(
        "metric",
        F.when(F.col("metric") == "ctr", pct_text("base_value", CTR_DECIMALS))
         .when(is_pct, pct_text("base_value")).otherwise(money_text("base_value"))
         .alias("value_text"),
        F.when(is_pct, signed_points_text("delta", 1)).otherwise(signed_money_text("delta"))
         .alias("delta_text"),
        "direction")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items())
    if name.startswith("q_") and callable(fn)
}
