import time

from pyspark.sql import functions as F
from pyspark.sql import types as T

from adpulse.sources import storage
from adpulse.sources.versions import published, read_published
from adpulse.streaming.ingest import start_ingest_stream

# Headers and file names as the source writes them.
HEAD = ["날짜", "매체상세", "비용(markup+)", "(스마트스토어센터기준) 전체 매출", "(대시보드기준) 전체 매출"]


def write_csv(path, rows):
    lines = [",".join(HEAD)] + [",".join(str(x) for x in r) for r in rows]
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")


def test_stream_ingest_per_tag_and_quarantine(spark, tmp_path):
    """New matching files become date-partitioned snapshots per tag; a bad
    file is quarantined and the stream keeps going; names starting with '_'
    (files still being written) and unrelated names are ignored."""
    watch = tmp_path / "watch"
    out = tmp_path / "out"
    watch.mkdir()
    write_csv(watch / "Some export_260401.csv",
              [("2026-04-01", "Search", 10, 50, 40), ("2026-03-31", "Search", 5, 20, 10)])
    write_csv(watch / "_Some export_260402.csv", [("2026-04-02", "Search", 1, 1, 1)])
    write_csv(watch / "notes.csv", [("2026-04-02", "Search", 1, 1, 1)])
    ckpt = str(tmp_path / "ckpt")
    q = start_ingest_stream(spark, str(watch), str(out), settle=0, checkpoint=ckpt, available_now=True)
    q.awaitTermination(120)
    snap = read_published(spark, str(out / "tag=260401"))
    assert snap.count() == 2
    assert snap.agg(F.sum("cost")).collect()[0][0] == 15
    assert not (out / "tag=260402").exists()

    # Second delivery: a new tag plus a broken file (no readable date).
    write_csv(watch / "Some export_260402.csv", [("2026-04-02", "Search", 3, 9, 9)])
    write_csv(watch / "Some-export_260403.csv", [("garbage", "Search", 3, 9, 9)])
    q = start_ingest_stream(spark, str(watch), str(out), settle=0, checkpoint=ckpt, available_now=True)
    q.awaitTermination(120)
    assert q.exception() is None
    assert read_published(spark, str(out / "tag=260402")).count() == 1
    assert not (out / "tag=260403").exists()
    bad = spark.read.parquet(str(out / "_quarantine")).collect()
    assert [r["tag"] for r in bad] == ["260403"] and "readable date" in bad[0]["error"]
    # The first tag was not re-processed.
    assert read_published(spark, str(out / "tag=260401")).count() == 2


def test_stream_ingest_pandas_parquet_exports(spark, tmp_path):
    """Parquet exports written by pandas (nanosecond timestamps) stream in and
    land with a DATE column."""
    import pandas as pd
    watch = tmp_path / "watch"
    out = tmp_path / "out"
    watch.mkdir()
    pdf = pd.DataFrame({"날짜": pd.to_datetime(["2026-04-01", "2026-04-02"]),
                        "매체상세": ["Search", "Search"], "비용(markup+)": [1.5, 2.5],
                        "(스마트스토어센터기준) 전체 매출": [10.0, 20.0],
                        "(대시보드기준) 전체 매출": [9.0, 19.0]})
    pdf.to_parquet(watch / "Some export_260402.parquet", index=False)
    q = start_ingest_stream(spark, str(watch), str(out), settle=0, checkpoint=str(tmp_path / "ck"), available_now=True)
    q.awaitTermination(120)
    snap = read_published(spark, str(out / "tag=260402"))
    assert isinstance(snap.schema["activity_date"].dataType, T.DateType)
    assert sorted(str(r["activity_date"]) for r in snap.collect()) == ["2026-04-01", "2026-04-02"]
    assert float(snap.agg(F.sum("cost")).collect()[0][0]) == 4.0


def test_stream_writes_the_figures_of_each_new_snapshot(spark, tmp_path):
    """Watch → convert → figures: a new snapshot file ends as its figures."""
    from conftest import CFG
    watch = tmp_path / "watch"
    watch.mkdir()
    write_csv(watch / "Some export_260402.csv",
              [("2026-04-01", "Search", 10, 50, 40), ("2026-04-02", "Search", 5, 80, 10)])
    out, rep = tmp_path / "out", tmp_path / "figures"
    q = start_ingest_stream(spark, str(watch), str(out), settle=0, checkpoint=str(tmp_path / "ck"),
                            available_now=True, figures_out=str(rep), cfg=CFG)
    q.awaitTermination(180)
    assert q.exception() is None
    ms = spark.read.parquet(str(rep / "tag=260402" / "media_summary")).collect()
    assert [(r["media"], r["rev_delta"]) for r in ms] == [("Search", 30.0)]


def run(spark, watch, out, **more):
    q = start_ingest_stream(spark, str(watch), str(out), settle=0, available_now=True, **more)
    q.awaitTermination(180)
    assert q.exception() is None


def test_one_file_of_a_tag_wins(spark, tmp_path):
    """Two names of one tag are the same data: S1's order picks one, also when
    the other arrives later; nothing is added up."""
    watch, out = tmp_path / "watch", tmp_path / "out"
    watch.mkdir()
    write_csv(watch / "Some-export_260401.csv", [("2026-04-01", "Search", 1, 1, 1)])
    run(spark, watch, out)
    assert read_published(spark, str(out / "tag=260401")).first()["cost"] == 1
    write_csv(watch / "Some export_260401.csv", [("2026-04-01", "Search", 10, 50, 40)])
    write_csv(watch / "Tome export_260401.csv", [("2026-04-01", "Search", 77, 50, 40)])
    run(spark, watch, out)
    assert [r["cost"] for r in read_published(spark, str(out / "tag=260401")).collect()] == [10]


def test_a_directory_of_part_files_is_a_snapshot(spark, tmp_path):
    watch, out = tmp_path / "watch", tmp_path / "out"
    watch.mkdir()
    rows = spark.createDataFrame([("2026-04-01", "Search", 1.0, 2.0, 3.0), ("2026-04-02", "Search", 4.0, 2.0, 3.0)], HEAD)
    rows.repartition(2).write.parquet(str(watch / "_writing"))
    run(spark, watch, out)
    (watch / "_writing").rename(watch / "Some export_260402.parquet")
    run(spark, watch, out)
    assert read_published(spark, str(out / "tag=260402")).agg(F.sum("cost")).first()[0] == 5


def test_a_passing_error_is_tried_again_and_a_restart_reads_nothing_twice(spark, tmp_path, monkeypatch):
    from adpulse.streaming import ingest
    watch, out = tmp_path / "watch", tmp_path / "out"
    watch.mkdir()
    write_csv(watch / "Some export_260401.csv", [("2026-04-01", "Search", 10, 50, 40)])
    calls, real = [], ingest.ingest_snapshot

    def fails_once(*args, **kw):
        calls.append(args[1])
        if len(calls) == 1:
            raise OSError("storage is away")
        return real(*args, **kw)

    monkeypatch.setattr(ingest, "ingest_snapshot", fails_once)
    q = start_ingest_stream(spark, str(watch), str(out), settle=0, available_now=True)
    try:
        q.awaitTermination(120)
    except Exception as e:  # the stream ends with the error
        assert "storage is away" in str(e)
    assert not (out / "tag=260401").exists() and not (out / "_quarantine").exists()
    run(spark, watch, out)
    assert read_published(spark, str(out / "tag=260401")).count() == 1 and len(calls) == 2
    run(spark, watch, out)
    assert len(calls) == 2


def test_unreadable_cells_go_to_quarantine(spark, tmp_path):
    watch, out = tmp_path / "watch", tmp_path / "out"
    watch.mkdir()
    write_csv(watch / "Some export_260401.csv", [("2026-04-01", "Search", "50%", 50, 40)])
    run(spark, watch, out)
    bad = spark.read.parquet(str(out / "_quarantine")).first()
    assert bad["tag"] == "260401" and "'cost': 1" in bad["error"] and not (out / "tag=260401").exists()


def counting(monkeypatch, name):
    from adpulse.streaming import ingest
    calls, real = [], getattr(ingest, name)
    monkeypatch.setattr(ingest, name, lambda *a, **kw: (calls.append(a[1]), real(*a, **kw))[1])
    return calls


def test_a_file_rewritten_in_place_is_taken_by_the_running_stream(spark, tmp_path, monkeypatch):
    calls = counting(monkeypatch, "ingest_snapshot")
    watch, out = tmp_path / "watch", tmp_path / "out"
    watch.mkdir()
    src = watch / "Some export_260402.csv"
    write_csv(src, [("2026-04-01", "Search", 1, 1, 1), ("2026-04-02", "Search", 2, 1, 1)])
    q = start_ingest_stream(spark, str(watch), str(out), processing_time="500 milliseconds", settle=0.3)

    def wait(cost):
        for _ in range(120):
            assert q.exception() is None
            if published(spark, str(out / "tag=260402")) and \
                    read_published(spark, str(out / "tag=260402")).agg(F.sum("cost")).first()[0] == cost:
                return
            time.sleep(0.5)
        raise AssertionError(q.lastProgress)

    try:
        wait(3)
        time.sleep(2)  # further triggers find nothing new
        assert len(calls) == 1
        write_csv(src, [("2026-04-01", "Search", 1, 1, 1), ("2026-04-02", "Search", 20, 1, 1)])
        wait(21)
    finally:
        q.stop()
    assert len(calls) == 2
    days = {d.day: d.version for d in published(spark, str(out / "tag=260402")).days}
    assert days["2026-04-01"] != days["2026-04-02"]  # only the changed day was written


def test_a_directory_of_many_parts_is_ingested_once(spark, tmp_path, monkeypatch):
    """Triggers list the folder's names, not the parts; a restart finds the ledger."""
    from adpulse.streaming import ingest
    watch, out = tmp_path / "watch", tmp_path / "out"
    (watch / "Some export_260402.csv").mkdir(parents=True)
    for i in range(300):
        write_csv(watch / "Some export_260402.csv" / f"part-{i:05d}.csv", [("2026-04-01", "Search", 1, 1, 1)])
    calls, listed = counting(monkeypatch, "ingest_snapshot"), []
    real = storage.files
    monkeypatch.setattr(storage, "files", lambda s, p: (listed.append(p), real(s, p))[1])
    write = ingest.make_batch_writer(str(watch), str(out), settle=0, at_most=1)
    for i in range(4):
        write(spark.range(1), i)
    assert len(calls) == 1 and read_published(spark, str(out / "tag=260402")).count() == 300
    parts = len(listed)
    again = ingest.make_batch_writer(str(watch), str(out), settle=0)
    again(spark.range(1), 4)
    assert len(calls) == 1 and len(listed) == parts  # an unchanged directory is not looked into


def test_so_many_snapshots_a_trigger(spark, tmp_path, monkeypatch):
    from adpulse.streaming import ingest
    calls = counting(monkeypatch, "ingest_snapshot")
    watch, out = tmp_path / "watch", tmp_path / "out"
    watch.mkdir()
    for day in (1, 2, 3):
        write_csv(watch / f"Some export_26040{day}.csv", [(f"2026-04-0{day}", "Search", 1, 1, 1)])
    write = ingest.make_batch_writer(str(watch), str(out), settle=0, at_most=2)
    write(spark.range(1), 0)
    assert len(calls) == 2
    write(spark.range(1), 1)
    write(spark.range(1), 2)
    assert len(calls) == 3


def test_a_refused_snapshot_is_not_tried_until_it_changes(spark, tmp_path, monkeypatch):
    calls = counting(monkeypatch, "ingest_snapshot")
    watch, out = tmp_path / "watch", tmp_path / "out"
    watch.mkdir()
    src = watch / "Some export_260401.csv"
    write_csv(src, [("2026-04-01", "Search", "50%", 50, 40)])
    run(spark, watch, out)
    run(spark, watch, out)
    assert len(calls) == 1
    write_csv(src, [("2026-04-01", "Search", "501", 50, 40)])
    run(spark, watch, out)
    assert len(calls) == 2 and read_published(spark, str(out / "tag=260401")).count() == 1


def test_a_file_that_changes_is_left_for_the_next_trigger(spark, tmp_path, monkeypatch):
    from adpulse.streaming import ingest
    calls = counting(monkeypatch, "ingest_snapshot")
    watch, out = tmp_path / "watch", tmp_path / "out"
    watch.mkdir()
    src = watch / "Some export_260401.csv"
    write_csv(src, [("2026-04-01", "Search", 1, 1, 1)])
    write = ingest.make_batch_writer(str(watch), str(out), settle=1)
    # it grows while the trigger waits
    monkeypatch.setattr(ingest.time, "sleep", lambda s: write_csv(src, [("2026-04-01", "Search", 1, 1, 1)] * 2))
    write(spark.range(1), 0)
    assert not calls
    monkeypatch.undo()
    calls = counting(monkeypatch, "ingest_snapshot")
    write(spark.range(1), 1)
    assert read_published(spark, str(out / "tag=260401")).count() == 2


def test_line_breaks_and_unreadable_cells_by_setting(spark, tmp_path):
    watch, out = tmp_path / "watch", tmp_path / "out"
    watch.mkdir()
    write_csv(watch / "Some export_260401.csv", [("2026-04-01", '"two\nlines"', 5, 50, 40), ("2026-04-01", "Search", "50%", 1, 1)])
    run(spark, watch, out, multi_line=True, allow_unreadable=True)
    got = read_published(spark, str(out / "tag=260401")).collect()
    assert sorted((r["media"], r["cost"] and int(r["cost"])) for r in got) == [("Search", None), ("two\nlines", 5)]


def test_figures_of_one_campaign(spark, tmp_path):
    from conftest import CFG
    watch, out, rep = tmp_path / "watch", tmp_path / "out", tmp_path / "figures"
    watch.mkdir()
    head = [*HEAD, "캠페인", "소재/키워드"]
    lines = [",".join(head), "2026-04-01,Banner,1,2,3,c1,one", "2026-04-02,Banner,1,2,3,c1,one", "2026-04-02,Banner,1,2,3,c2,two"]
    (watch / "Some export_260402.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    run(spark, watch, out, figures_out=str(rep), cfg=CFG, campaign="c1")
    got = spark.read.parquet(str(rep / "tag=260402" / "creative_mtd_top")).collect()
    assert [r["creative"] for r in got] == ["one"]
