import datetime as dt
import os
import re
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adpulse.operators.compare import two_day_compare
from adpulse.operators.parity import parity_totals, snapshot_parity
from adpulse.sources import snapshots as snap
from adpulse.sources.schema import SOURCE_HEADERS, conform
from adpulse.sources.versions import read_published
from conftest import CFG

STEM = "Some"


def touch(folder, name, size=500, mtime=None):
    p = folder / name
    p.write_bytes(b"x" * size)
    if mtime is not None:
        os.utime(p, (mtime, mtime))
    return p


def test_newest_tag_wins_and_parquet_preferred(spark, tmp_path):
    """R2: newest tag; parquet over workbook on an equal tag; unrelated names ignored."""
    touch(tmp_path, f"{STEM} export_260401.xlsx")
    touch(tmp_path, f"{STEM} export_260405.xlsx")
    touch(tmp_path, f"{STEM} export_260405.parquet")
    touch(tmp_path, "notes_2604.xlsx")
    cat = snap.snapshot_catalog(spark, str(tmp_path))
    assert cat.count() == 3
    assert snap.newest_snapshot(cat).endswith("export_260405.parquet")
    assert snap.newest_snapshot(cat, ext="xlsx").endswith("export_260405.xlsx")
    assert snap.snapshot_by_tag(cat, "260401").endswith("260401.xlsx")
    assert snap.snapshot_by_name(cat, f"{STEM.lower()} export_260405.XLSX").endswith("260405.xlsx")
    assert snap.snapshot_by_name(cat, "nope.xlsx") is None
    choices = [(r["tag"], r["ext"]) for r in snap.snapshot_choices(cat).collect()]
    assert choices == [("260405", "parquet"), ("260405", "xlsx"), ("260401", "xlsx")]
    assert [r["tag"] for r in snap.snapshot_choices(cat, ext="xlsx").collect()] == ["260405", "260401"]


def test_name_variants_and_case(spark, tmp_path):
    touch(tmp_path, f"{STEM}-export_260402.PARQUET")
    touch(tmp_path, f"{STEM} export_260402.parquet")
    cat = snap.snapshot_catalog(spark, str(tmp_path))
    assert cat.count() == 2
    # Space form is tried before the hyphen form.
    assert snap.newest_snapshot(cat).endswith(f"{STEM} export_260402.parquet")


def test_newest_valid_window_and_size(spark, tmp_path):
    """> 200 bytes, within 120 days, else error."""
    touch(tmp_path, f"{STEM} export_260410.parquet", size=150)   # too small
    touch(tmp_path, f"{STEM} export_260405.xlsx", size=300)
    touch(tmp_path, f"{STEM} export_251201.parquet", size=900)   # older than 120 days
    cat = snap.snapshot_catalog(spark, str(tmp_path))
    got = snap.newest_valid_snapshot(cat, as_of=dt.date(2026, 4, 12))
    assert got.endswith("260405.xlsx")
    with pytest.raises(FileNotFoundError):
        snap.newest_valid_snapshot(cat, as_of=dt.date(2026, 12, 1))
    # 2025-12-01 is the 120th day back from 2026-03-30 (today counts as day 1)
    assert snap.newest_valid_snapshot(cat, as_of=dt.date(2026, 3, 30)).endswith("251201.parquet")
    with pytest.raises(FileNotFoundError):
        snap.newest_valid_snapshot(cat, as_of=dt.date(2026, 3, 31))


def test_stale_conversions(spark, tmp_path):
    """Convert only when the output is missing or older than the input."""
    src = tmp_path / "src"
    dst = tmp_path / "dst"
    src.mkdir()
    dst.mkdir()
    now = time.time()
    touch(src, f"{STEM} export_260401.xlsx", mtime=now - 100)
    touch(src, f"{STEM} export_260402.xlsx", mtime=now)
    touch(src, f"{STEM} export_260403.xlsx", mtime=now)
    touch(dst, f"{STEM} export_260401.parquet", mtime=now)        # fresh
    touch(dst, f"{STEM} export_260402.parquet", mtime=now - 500)  # stale (rewritten input)
    stale = snap.stale_conversions(snap.snapshot_catalog(spark, str(src)),
                                   snap.snapshot_catalog(spark, str(dst)))
    assert sorted(r["tag"] for r in stale.collect()) == ["260402", "260403"]


def raw_pdf(n_days=3, date_kind="datetime"):
    rows = []
    for d in range(n_days):
        for i in range(3):
            day = pd.Timestamp(2026, 4, 1 + d)
            rows.append({"날짜": day, "채널": "StoreA" if i == 0 else "Mkt",
                         "매체상세": ["Search", "Mkt", "Gm"][i], "캠페인": f"c{i}", "그룹": f"g{i}",
                         "소재/키워드": f"k{i}", "실 전환 발생 상품": f"p{i}", "프로모션명": None,
                         "노출": 1000 + i, "클릭": 100 + i, "비용(markup+)": 100.0 * (i + 1),
                         "(스마트스토어센터기준) 전체 매출": 500.0, "(대시보드기준) 전체 매출": 400.0,
                         "(스마트스토어센터기준) 전체 구매": 5, "(대시보드기준) 전체 구매": 4})
    pdf = pd.DataFrame(rows)
    if date_kind == "text":
        pdf["날짜"] = pdf["날짜"].dt.strftime("%Y-%m-%d")
    return pdf


def test_pandas_nanosecond_parquet_reads(spark, tmp_path):
    """H13 / hard 7: pandas writes TIMESTAMP(NANOS); read as long, coerced to DATE."""
    p = tmp_path / f"{STEM} export_260403.parquet"
    raw_pdf().to_parquet(p, engine="pyarrow", index=False)
    fact = snap.scan_snapshot(spark, str(p))
    assert fact.schema["activity_date"].dataType == T.DateType()
    days = sorted({r["activity_date"] for r in fact.select("activity_date").collect()})
    assert days == [dt.date(2026, 4, 1), dt.date(2026, 4, 2), dt.date(2026, 4, 3)]
    assert fact.agg(F.sum("cost")).collect()[0][0] == 1800


def test_date_storage_forms(spark):
    """DATE, TIMESTAMP and text dates give the same day; junk text → NULL."""
    df = spark.createDataFrame(
        [(dt.date(2026, 4, 1), dt.datetime(2026, 4, 1, 13, 5), "2026-04-01", 1775001600000000000),
         (None, None, "not a date", None)],
        "d date, ts timestamp, s string, ns bigint")
    from adpulse.sources.schema import coerce_date
    out = df.select(*[coerce_date(df, c).alias(c) for c in ("d", "ts", "s", "ns")]).collect()
    assert tuple(out[0]) == (dt.date(2026, 4, 1),) * 4
    assert tuple(out[1]) == (None,) * 4


def test_conform_mixed_types_and_missing_columns(spark):
    """A mixed-type column stays text with its null; missing optional
    measures become 0; missing required ones raise."""
    df = spark.createDataFrame([("2026-04-06", "0:30:00", 100.0, "Search", 1.0, 2.0),
                                ("2026-04-06", "text", 200.0, "Search", 1.0, 2.0),
                                ("2026-04-06", None, 300.0, "Search", 1.0, 2.0)],
                               ["날짜", "노출/시간", "비용(markup+)", "매체상세",
                                "(스마트스토어센터기준) 전체 매출", "(대시보드기준) 전체 매출"])
    f = conform(df)
    assert f.where(F.col("노출/시간").isNull()).count() == 1
    assert f.agg(F.sum("cost")).collect()[0][0] == 600
    assert f.agg(F.sum("clicks")).collect()[0][0] == 0
    with pytest.raises(ValueError):
        conform(df.drop("비용(markup+)"))


def test_ingest_round_trip_prunes_partitions(spark, tmp_path):
    """S6 + S8: the converted snapshot keeps rows and totals, stores DATE, and a
    day comparison on it reads only the two day partitions."""
    src = tmp_path / f"{STEM} export_260403.parquet"
    raw_pdf().to_parquet(src, engine="pyarrow", index=False)
    out = str(tmp_path / "converted" / "tag=260403")
    audit = snap.ingest_snapshot(spark, str(src), out)
    assert audit["rows"] == 9 and audit["size_mb"] > 0
    fact = read_published(spark, out)
    assert fact.schema["activity_date"].dataType == T.DateType()
    assert fact.agg(F.sum("cost")).collect()[0][0] == 1800
    q = two_day_compare(fact, ["media"], "ss", dt.date(2026, 4, 3), dt.date(2026, 4, 2), CFG)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[activity_date#\d+ IN \(2026-04-03,2026-04-02\)\]", plan)
    assert {r["media"] for r in q.collect()} == {"Search", "Mkt", "Gm"}


def test_parity_of_two_formats(spark, tmp_path, sample_fact):
    """The same data in two formats agrees on counts, totals and
    per-media SS revenue."""
    p = str(tmp_path / "a")
    sample_fact.write.parquet(p)
    js = str(tmp_path / "b")
    sample_fact.write.json(js)
    other = conform(spark.read.json(js), headers={})
    per = snapshot_parity(spark.read.parquet(p), other)
    assert per.where(~F.col("ok")).count() == 0 and per.count() == 3
    tot = parity_totals(spark.read.parquet(p), other).collect()[0]
    assert tot["rows_a"] == tot["rows_b"] == 15 and tot["media_ok"]
    changed = other.withColumn("rev_ss", F.when(F.col("media") == "Gm", F.col("rev_ss") + 1)
                               .otherwise(F.col("rev_ss")))
    bad = snapshot_parity(spark.read.parquet(p), changed).where(~F.col("ok")).collect()
    assert [r["media"] for r in bad] == ["Gm"]


def test_header_map_is_complete():
    assert set(SOURCE_HEADERS.values()) >= {"activity_date", "media", "cost", "rev_ss", "rev_db"}


def test_day_partitions_prune_and_give_anchors(spark, tmp_path, sample_fact):
    """On a day-partitioned snapshot: anchors from the directory listing equal
    the scanned ones, and the trend reads only its days' partitions."""
    from adpulse.operators import totals
    from adpulse.operators.anchors import anchors_from_dates, resolve_anchors
    out = str(tmp_path / "by_day")
    sample_fact.write.partitionBy("activity_date").parquet(out)
    days = snap.partition_values(spark, out)
    assert len(days) == 5
    fact = spark.read.parquet(out)
    assert anchors_from_dates(dt.date.fromisoformat(d) for d in days) == resolve_anchors(fact)
    q = totals.roas_trend(fact, dt.date(2026, 4, 5), 2)
    assert [r["activity_date"] for r in q.collect()] == [dt.date(2026, 4, 4), dt.date(2026, 4, 5)]
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[activity_date#\d+ IN \(2026-04-05,2026-04-04\)\]", plan)


def test_unreadable_measure_cell_becomes_null(spark):
    """A text cell in a measure column does not fail the snapshot (ANSI casts
    would): it reads as NULL and sums skip it."""
    df = spark.createDataFrame([("2026-04-06", "Search", "100", "5", "4"),
                                ("2026-04-06", "Search", "n/a", "5", "4")],
                               ["날짜", "매체상세", "비용(markup+)", "(스마트스토어센터기준) 전체 매출",
                                "(대시보드기준) 전체 매출"])
    f = conform(df)
    assert f.where(F.col("cost").isNull()).count() == 1
    assert f.agg(F.sum("cost")).collect()[0][0] == 100


def write_raw(path, rows):
    lines = ["날짜,매체상세,비용(markup+),(스마트스토어센터기준) 전체 매출,(대시보드기준) 전체 매출", *rows]
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_doubled_quotes_keep_columns_in_place(spark, tmp_path):
    src = write_raw(tmp_path / "a.csv", ['2026-04-01,"a ""b"", c",10,20,30', '2026-04-01,"line\nbreak",1,2,3'])
    rows = snap.scan_snapshot(spark, src).where("cost = 10").collect()
    assert [(r["media"], r["cost"], r["rev_ss"], r["rev_db"]) for r in rows] == [('a "b", c', 10, 20, 30)]
    whole = conform(snap.read_source(spark, src, multi_line=True)).collect()
    assert sorted(r["media"] for r in whole) == ['a "b", c', "line\nbreak"]


def test_thousands_and_unreadable_cells(spark, tmp_path):
    """1,234 is a number; 50%, 1,23 and amounts too wide are counted and refused."""
    good = write_raw(tmp_path / "good.csv", ['2026-04-01,Search,"1,234"," 2,345,678.5 ",-3', '2026-04-01,Search,,1,2'])
    audit = snap.ingest_snapshot(spark, good, str(tmp_path / "out"))
    assert audit["rows"] == 2 and audit["unreadable"] == {}
    got = read_published(spark, str(tmp_path / "out")).agg(F.sum("cost"), F.sum("rev_ss"), F.sum("rev_db")).first()
    assert [float(x) for x in got] == [1234.0, 2345679.5, -1.0]
    bad = write_raw(tmp_path / "bad.csv", ["2026-04-01,Search,50%,100000000000000,4", '2026-04-01,Search,"1,23",2,3',
                                          "soon,Search,1,2,3"])
    with pytest.raises(snap.UnreadableSnapshot, match="'cost': 2, 'rev_ss': 1"):
        snap.ingest_snapshot(spark, bad, str(tmp_path / "out"))
    assert read_published(spark, str(tmp_path / "out")).count() == 2  # the earlier one stays
    audit = snap.ingest_snapshot(spark, bad, str(tmp_path / "out"), allow_unreadable=True)
    assert audit["rows"] == 3 and audit["unreadable"] == {"activity_date": 1, "cost": 2, "rev_ss": 1}


def test_missing_columns_and_dates_refuse_a_snapshot(spark, tmp_path):
    with pytest.raises(snap.UnreadableSnapshot, match="readable date"):
        snap.ingest_snapshot(spark, write_raw(tmp_path / "a.csv", ["x,Search,1,2,3"]), str(tmp_path / "out"))
    (tmp_path / "b.csv").write_text("a,b\n1,2\n")
    with pytest.raises(snap.UnreadableSnapshot, match="missing required"):
        snap.ingest_snapshot(spark, str(tmp_path / "b.csv"), str(tmp_path / "out"))


def test_latest_per_tag(spark, tmp_path):
    """The preferred file of every tag."""
    for name in ("260401.xlsx", "260401.parquet", "260402.xlsx"):
        touch(tmp_path, f"{STEM} export_{name}")
    touch(tmp_path, f"{STEM}-export_260401.parquet")
    got = snap.latest_per_tag(snap.snapshot_catalog(spark, str(tmp_path))).collect()
    assert sorted(r["name"] for r in got) == [f"{STEM} export_260401.parquet", f"{STEM} export_260402.xlsx"]


def test_storage_errors_are_not_an_empty_folder(spark):
    with pytest.raises(Exception, match="(?i)no filesystem|nosuch"):
        snap.snapshot_catalog(spark, "nosuch://bucket/folder")


def test_file_identity_sees_part_files(spark, tmp_path):
    d = tmp_path / "t.parquet"
    d.mkdir()
    part = touch(d, "part-0", mtime=1_000_000_000)
    one = snap.file_identity(spark, [str(d)])
    assert one == snap.file_identity(spark, [str(d)]) and one[0][1:3] == (1, 500)
    part.write_bytes(b"y" * 500)
    assert snap.file_identity(spark, [str(d)]) != one


def test_parity_is_exact(spark, make_fact):
    """Totals beyond a DOUBLE's digits that differ by 0.01 are not equal."""
    rows = [dict(media="a", rev_ss="99999999999999.99")] * 2
    other = [dict(media="a", rev_ss="99999999999999.99"), dict(media="a", rev_ss="99999999999999.98")]
    assert snapshot_parity(make_fact(rows), make_fact(other)).first()["ok"] is False
    assert snapshot_parity(make_fact(rows), make_fact(rows)).first()["ok"] is True
