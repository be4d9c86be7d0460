"""All figures of a day as one Spark application.

    zip -r adpulse.zip adpulse
    spark-submit --py-files adpulse.zip adpulse/plans/figures_job.py \
        --snapshots <folder> --facts <folder> --out <folder>

1. list the snapshot folder and pick the newest valid snapshot (or ``--tag``);
2. ingest it to ``<facts>/tag=<YYMMDD>`` (typed Parquet by day, changed days only)
   unless that was made from the source as it is now;
3. build every figure from that snapshot and write each as
   Parquet under ``<out>/tag=<YYMMDD>/<figure>``.

The steps are the reference's convert-then-show flow; nothing but file
listings and the one-row anchors reaches the driver.
"""

from __future__ import annotations

import os
import sys

if __package__ in (None, ""):  # run as a script by spark-submit
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import argparse
import datetime as dt
import json
import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from adpulse.config import DEFAULT_CONFIG, TEST_CONFIG, FigureConfig
from adpulse.operators.anchors import anchors_from_dates
from adpulse.plans.figures import Figures
from adpulse.sources import snapshots, versions
from adpulse.sources.targets import read_targets


def run_figures_job(spark: SparkSession, folder: str, facts: str, out: str,
              cfg: FigureConfig = DEFAULT_CONFIG, tag: str | None = None,
              as_of: dt.date | None = None, targets: str | None = None,
              extra_headers: dict | None = None, persist: bool = False,
              parallel: int = 4, cache_recent: bool = False, brand: str | None = None,
              campaign: str | None = None, ad_group: str | None = None,
              allow_unreadable: bool = False, multi_line: bool = False,
              name_re: str = snapshots.SNAPSHOT_NAME_RE) -> dict:
    cat = snapshots.snapshot_catalog(spark, folder, name_re)
    readable = cat.where(F.col("ext").isin(*snapshots.READABLE))
    src = (snapshots.snapshot_by_tag(readable, tag) if tag
           else snapshots.newest_valid_snapshot(cat, as_of=as_of, exts=snapshots.READABLE))
    if src is None:
        raise FileNotFoundError(f"no readable snapshot for tag {tag}")
    newest = snapshots.snapshot_by_tag(cat, tag) if tag else snapshots.newest_snapshot(cat)
    skipped = None if newest == src else newest  # newer, or preferred, but not readable or not valid
    tag = re.search(name_re, src.rstrip("/").rsplit("/", 1)[-1]).group(3)
    fact_path = f"{facts.rstrip('/')}/tag={tag}"
    audit = None
    if snapshots.needs_ingest(spark, src, fact_path):
        audit = snapshots.ingest_snapshot(spark, src, fact_path, extra_headers=extra_headers,
                                          allow_unreadable=allow_unreadable, multi_line=multi_line)
    # The published days are listed: the anchors need no scan.
    of = versions.published(spark, fact_path)
    fact, anchors = versions.read_published(spark, fact_path, of), anchors_from_dates(of.dates)
    tgt, problem = read_targets(spark, targets) if targets else (None, None)
    run = Figures(fact, cfg, tgt, persist=persist, anchors=anchors,
                         cache_recent=cache_recent, brand=brand, campaign=campaign,
                         ad_group=ad_group)
    try:
        dest = f"{out.rstrip('/')}/tag={tag}"
        figures = run.write_all(dest, parallel=parallel)
    finally:
        run.close()
    return {"tag": tag, "source": src, "skipped": skipped, "ingested": audit, "targets_not_read": problem, "out": dest, "figures": figures,
            "d_max": str(run.anchors.d_max), "d_prev": str(run.anchors.d_prev)}


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    ap.add_argument("--snapshots", required=True)
    ap.add_argument("--facts", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--tag")
    ap.add_argument("--as-of", type=dt.date.fromisoformat)
    ap.add_argument("--targets")
    ap.add_argument("--config", choices=("default", "test"), default="default")
    ap.add_argument("--cache-recent", action="store_true",
                    help="keep the recent days (month to date + comparison days) cached for the run")
    ap.add_argument("--brand", help="only this brand's rows in the figures that can be filtered")
    ap.add_argument("--campaign", help="only this campaign in the creative tables")
    ap.add_argument("--ad-group", help="only this group in the creative tables")
    ap.add_argument("--header", action="append", default=[], metavar="SOURCE=NAME",
                    help="another source header, such as that of the brand column (NAME: brand)")
    ap.add_argument("--allow-unreadable", action="store_true",
                    help="take a snapshot with unreadable cells in required measures")
    ap.add_argument("--multi-line", action="store_true", help="CSV cells may hold line breaks")
    ap.add_argument("--name-re", default=snapshots.SNAPSHOT_NAME_RE,
                    help="pattern of snapshot names; groups: stem, separator, tag, extension")
    a = ap.parse_args(argv)
    headers = dict(h.rsplit("=", 1) for h in a.header)
    from adpulse.session import build_session
    spark = build_session()
    cfg = TEST_CONFIG if a.config == "test" else DEFAULT_CONFIG
    print(json.dumps(run_figures_job(spark, a.snapshots, a.facts, a.out, cfg, a.tag, a.as_of,
                               a.targets, extra_headers=headers, cache_recent=a.cache_recent, brand=a.brand,
                               campaign=a.campaign, ad_group=a.ad_group,
                               allow_unreadable=a.allow_unreadable, multi_line=a.multi_line,
                               name_re=a.name_re), default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
