"""Scale probe: a larger, skewed snapshot and the main operators on it.

Builds R copies of the sf snapshot (row copies get distinct campaigns so
group counts grow too), sends about a third of all rows to ONE media (the hot
key), stores it day-partitioned like the production ingest, then times the
main figures and prints one JSON line. Local evidence that the plans hold
under volume and skew; not a registered query.

Usage: python tools/scale_probe.py [sf_dir] [copies]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from adpulse.config import TEST_CONFIG as CFG  # noqa: E402
from adpulse.operators import drivers, kpi, periods, ranking, totals  # noqa: E402
from adpulse.operators.anchors import anchors_from_dates  # noqa: E402
from adpulse.operators.compare import two_day_compare  # noqa: E402
from adpulse.plans.registry import TEST_TARGETS, snapshot_fact, snapshot_folder  # noqa: E402
from adpulse.session import build_session  # noqa: E402
from adpulse.sources.snapshots import partition_values, path_exists  # noqa: E402
from adpulse.sources.targets import targets_frame  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    copies = int(sys.argv[2]) if len(sys.argv) > 2 else 20
    spark = build_session("local[8]", app="adpulse-scale", shuffle_partitions=8,
                          extra={"spark.driver.memory": "16g"})
    base = snapshot_fact(spark, sf)
    path = f"{snapshot_folder(spark)}/" + (f"scale-probe-{os.path.basename(sf)}-x{copies}")
    t0 = time.perf_counter()
    if not path_exists(spark, f"{path}/_SUCCESS"):
        big = (base.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
                   .withColumn("campaign", F.concat_ws("#", "campaign", F.col("_copy").cast("string")))
                   .withColumn("media", F.when(F.pmod(F.xxhash64("product", "_copy", "buy_db"), F.lit(3)) == 0,
                                               F.lit("NATION_HOT")).otherwise(F.col("media")))
                   .drop("_copy"))
        (big.hint("rebalance", "activity_date").write.mode("overwrite")
            .partitionBy("activity_date").parquet(path))
    build = time.perf_counter() - t0
    fact = spark.read.parquet(path)
    rows = fact.count()
    hot = fact.where(F.col("media") == "NATION_HOT").count()
    t0 = time.perf_counter()
    a = anchors_from_dates(__import__("datetime").date.fromisoformat(d)
                           for d in partition_values(spark, path))
    anchors_sec = time.perf_counter() - t0
    tgt = targets_frame(spark, TEST_TARGETS)
    figures = {
        "compare_media_ss": lambda: two_day_compare(fact, ["media"], "ss", a.d_max, a.d_prev, CFG),
        "campaign_change_top20": lambda: drivers.campaign_change_top(fact, CFG, a),
        "drilldown_tree": lambda: drivers.drilldown_tree(fact, CFG, a),
        "media_summary": lambda: drivers.media_summary(fact, CFG, a),
        "media_mtd": lambda: totals.media_mtd(fact, a),
        "kpi_attainment": lambda: kpi.kpi_attainment(fact, tgt, CFG, a),
        "daily_headline": lambda: periods.daily_headline(fact, a),
        "roas_trend": lambda: totals.roas_trend(fact, a.d_max, 7, a),
        "campaign_top30_whole_history": lambda: ranking.campaign_mtd_top(
            fact, type("H", (), {"month_start": a.d_min, "d_max": a.d_max})(), 30),
        "media_daily_pivot": lambda: totals.media_daily_pivot(fact),
    }
    times = {}
    for name, make in figures.items():
        make().write.format("noop").mode("overwrite").save()
        t0 = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"rows": rows, "hot_media_share": round(hot / rows, 3), "copies": copies,
                      "build_sec": round(build, 1), "anchors_from_listing_sec": round(anchors_sec, 3),
                      "figures_sec": times}))


if __name__ == "__main__":
    main()
