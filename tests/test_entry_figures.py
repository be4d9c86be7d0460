import os
import re

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from adpulse.plans.figures import Figures
from adpulse.sources.tpch_fact import ad_fact
from adpulse.config import TEST_CONFIG
from adpulse.sources.targets import targets_frame
from conftest import CFG, D0
from adpulse.plans.registry import QUERIES, TEST_TARGETS

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())
    assert set(QUERIES) <= set(oracle_sql())
    assert len(QUERIES) >= 60


@needs_data
def test_entry_smoke(spark):
    df = entry(spark)
    assert df.columns[0] == "media" and "roas_delta" in df.columns
    rows = df.collect()
    assert rows and len({r["media"] for r in rows}) == len(rows)
    assert [r["influence"] for r in rows] == sorted((r["influence"] for r in rows), reverse=True)


@needs_data
@pytest.mark.parametrize("key", ["compare_media_ss", "kpi_attainment", "drilldown_tree",
                                 "media_daily", "roas_trend", "creative_top20_of_campaign", "snapshot_parity_diff",
                                 "format_metrics", "keyword_change_top20_by_brand", "product_top10_summary", "multi_period_week",
                                 "product_top10", "media_summary"])
def test_query_matches_oracle_small(spark, key):
    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries()[key](spark, SF)
    cur = con.execute(oracle_sql()[key])
    d_cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(d_cols)
    order = sorted(df.columns)
    s_rows = sorted([tuple(str(r[c]) for c in order) for r in df.collect()])
    idx = [d_cols.index(c) for c in order]
    d_rows = sorted([tuple(str(r[i]) for i in idx) for r in cur.fetchall()])
    assert len(s_rows) == len(d_rows)
    assert s_rows == d_rows


@needs_data
def test_figures_builds_every_figure(spark):
    rep = Figures(ad_fact(spark, SF), TEST_CONFIG, targets_frame(spark, TEST_TARGETS),
                      persist=True)
    try:
        figs = rep.all_figures()
        assert {"kpi_attainment", "media_summary", "mtd_top_products", "creative_change_top",
                "drilldown_tree"} <= set(figs)
        assert figs["kpi_attainment"].count() == len({r[0].strip() for r in TEST_TARGETS})
        media = {r["media"] for r in figs["media_summary"].collect()}
        assert media and {r["media"] for r in figs["channel_drivers"].collect()} <= media
    finally:
        rep.close()


@needs_data
def test_queries_use_the_callers_session(spark):
    """Another session gets its own frame and the same result."""
    first = queries()["compare_media_ss"](spark, SF)
    other = spark.newSession()
    again = queries()["compare_media_ss"](other, SF)
    assert again.sparkSession is other
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect()))


@needs_data
def test_recent_slice_changes_no_figure(spark):
    """Figures built from the cached recent slice equal those built from the
    whole snapshot."""
    from adpulse.plans.registry import snapshot_fact
    fact = snapshot_fact(spark, SF)
    targets = targets_frame(spark, TEST_TARGETS)
    whole = Figures(fact, TEST_CONFIG, targets)
    whole.recent = whole.fact  # every figure from the whole snapshot
    plain = whole.all_figures()
    cached = Figures(fact, TEST_CONFIG, targets, cache_recent=True)
    try:
        fast = cached.all_figures()
        assert set(plain) == set(fast)
        for name in plain:
            a = sorted(map(tuple, plain[name].collect()), key=repr)
            b = sorted(map(tuple, fast[name].collect()), key=repr)
            assert a == b, name
    finally:
        cached.close()


@needs_data
def test_a_rewritten_part_file_changes_the_result(spark, tmp_path):
    """Tables may be directories of part files: their state is that of the files
    inside, so a rewritten one gives another snapshot."""
    from adpulse.plans.registry import SOURCE_TABLES, snapshot_fact
    for t in SOURCE_TABLES:
        spark.read.parquet(f"{SF}/{t}.parquet").repartition(2).write.parquet(str(tmp_path / f"{t}.parquet"))
    before = snapshot_fact(spark, str(tmp_path)).count()
    assert snapshot_fact(spark, str(tmp_path)).count() == before
    part = sorted((tmp_path / "lineitem.parquet").glob("part-*"))[0]
    import pyarrow.parquet as pq
    half = pq.read_table(part).slice(0, 10)
    pq.write_table(half, part)
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    spark.catalog.clearCache()
    assert snapshot_fact(spark, str(tmp_path)).count() < before


@needs_data
def test_date_predicates_reach_the_snapshot_scan(spark):
    plan = queries()["compare_media_ss"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[.*In\(activity_date|PushedFilters: \[.*activity_date", plan)


def test_a_cluster_needs_a_shared_folder(spark):
    from adpulse.plans.registry import SNAPSHOT_SETTING, snapshot_folder
    other = spark.newSession()
    other.conf.set(SNAPSHOT_SETTING, "s3a://bucket/facts/")
    assert snapshot_folder(other) == "s3a://bucket/facts/adpulse"


@needs_data
def test_a_brand_filters_every_table_of_the_media_page(spark, make_fact):
    rows = [dict(activity_date=D0, brand=b, media=m, campaign=f"{b}-c", ad_group=f"{b}-g", keyword=f"{b}-k",
                 creative=f"{b}-r", rev_ss=5, rev_db=7, cost=3) for b in ("b1", "b2") for m in ("Search", "Banner")]
    rep = Figures(make_fact(rows), CFG, brand="b1")
    for name, df in rep.media_page().items():
        text = str(df.collect())
        if name not in ("media_mtd", "dimension_values", "cascading_filter"):
            assert "b1-" in text and "b2-" not in text, name
    one = Figures(make_fact(rows), CFG, campaign="b2-c", ad_group="b2-g").media_page()
    for name in ("creative_mtd_top", "creative_change_top"):
        assert [r["creative"] for r in one[name].collect()] == ["b2-r"]
