import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from adpulse.operators.parity import restated_days
from adpulse.sources import snapshots as snap
from adpulse.sources import storage, versions
from test_snapshots import STEM, raw_pdf, write_raw

COST = "비용(markup+)"


def dump(folder, pdf, tag):
    path = folder / f"{STEM} export_{tag}.parquet"
    pdf.to_parquet(path, index=False)
    return str(path)


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def changed(pdf):
    """A re-dump: one day's cost changes, a day is new, the others stay."""
    out = pd.concat([pdf, raw_pdf(n_days=6).iloc[-3:]], ignore_index=True)
    out.loc[3, COST] += 1
    return out.sample(frac=1, random_state=1)  # in another order


def test_a_redump_writes_the_changed_days_only(spark, tmp_path):
    out, whole = str(tmp_path / "facts"), str(tmp_path / "whole")
    first = snap.ingest_snapshot(spark, dump(tmp_path, raw_pdf(n_days=5), "260405"), out)
    assert (first["rows"], first["days_written"], first["days_kept"]) == (15, 5, 0)
    before = versions.published(spark, out)
    src = dump(tmp_path, changed(raw_pdf(n_days=5)), "260406")
    audit = snap.ingest_snapshot(spark, src, out)
    assert (audit["rows"], audit["days_written"], audit["days_kept"], audit["days_dropped"]) == (18, 2, 4, 0)
    now = versions.published(spark, out)
    assert {d.day for d in now.days if d not in before.days} == {"2026-04-02", "2026-04-06"}
    snap.ingest_snapshot(spark, src, whole)
    assert rows(versions.read_published(spark, out)) == rows(versions.read_published(spark, whole))
    # the same data once more writes nothing, fewer days drop theirs
    again = snap.ingest_snapshot(spark, src, out)
    assert (again["days_written"], again["rows"]) == (0, 18)
    less = snap.ingest_snapshot(spark, dump(tmp_path, raw_pdf(n_days=2), "260407"), out)
    assert less["days_dropped"] == 4 and versions.read_published(spark, out).count() == 6


def test_another_column_rewrites_all_days(spark, tmp_path):
    out = str(tmp_path / "facts")
    snap.ingest_snapshot(spark, dump(tmp_path, raw_pdf(n_days=2), "260402"), out)
    wide = raw_pdf(n_days=2).assign(note="x")
    audit = snap.ingest_snapshot(spark, dump(tmp_path, wide, "260403"), out)
    assert audit["days_written"] == 2
    assert {r["note"] for r in versions.read_published(spark, out).collect()} == {"x"}


def test_what_was_absent_stays_marked(spark, tmp_path):
    from adpulse.sources.schema import column_absent
    out = str(tmp_path / "facts")
    snap.ingest_snapshot(spark, write_raw(tmp_path / "a.csv", ["2026-04-01,Search,1,2,3"]), out)
    fact = versions.read_published(spark, out)
    assert column_absent(fact, "channel") and column_absent(fact, "brand") and not column_absent(fact, "media")


@pytest.mark.parametrize("step", ["write_new_text", "remove_superseded"])
def test_a_crash_leaves_one_whole_snapshot(spark, tmp_path, monkeypatch, step):
    """Before the publication is written the earlier snapshot is current, after it the
    new one; what a dead writer left goes with a later publication."""
    out = str(tmp_path / "facts")
    snap.ingest_snapshot(spark, dump(tmp_path, raw_pdf(n_days=5), "260405"), out)
    old = rows(versions.read_published(spark, out))
    src = dump(tmp_path, changed(raw_pdf(n_days=5)), "260406")

    def dies(*args, **kw):
        raise OSError("the driver is gone")

    monkeypatch.setattr(storage if step == "write_new_text" else versions, step, dies)
    with pytest.raises(OSError, match="is gone"):
        snap.ingest_snapshot(spark, src, out)
    monkeypatch.undo()
    got = rows(versions.read_published(spark, out))
    assert got == old if step == "write_new_text" else len(got) == 18
    folders = [e[1] for e in storage.entries(spark, out, "^version=")]
    assert len(folders) == 2
    snap.ingest_snapshot(spark, src, out)
    assert len(rows(versions.read_published(spark, out))) == 18
    snap.ingest_snapshot(spark, dump(tmp_path, raw_pdf(n_days=1), "260407"), out)
    snap.ingest_snapshot(spark, dump(tmp_path, raw_pdf(n_days=2), "260408"), out)
    listed = {d.version for d in versions.published(spark, out).days}
    kept = {e[1][len("version="):] for e in storage.entries(spark, out, "^version=")}
    assert listed <= kept and len(kept) <= 3


def test_a_half_written_publication_is_not_read(spark, tmp_path):
    out = str(tmp_path / "facts")
    snap.ingest_snapshot(spark, dump(tmp_path, raw_pdf(n_days=3), "260403"), out)
    whole = storage.read_text(spark, f"{out}/_published/00000001.json")
    storage.write_new_text(spark, f"{out}/_published/00000002.json", whole[:len(whole) // 2])
    assert versions.published(spark, out).number == 1
    storage.write_new_text(spark, f"{out}/_published/00000003.json", "")
    assert versions.read_published(spark, out).count() == 9
    audit = snap.ingest_snapshot(spark, dump(tmp_path, raw_pdf(n_days=4), "260404"), out)
    assert audit["days_written"] == 1 and versions.published(spark, out).number == 4


def test_a_reader_keeps_its_snapshot_during_a_replacement(spark, tmp_path):
    out = str(tmp_path / "facts")
    snap.ingest_snapshot(spark, dump(tmp_path, raw_pdf(n_days=5), "260405"), out)
    reader = versions.read_published(spark, out)
    snap.ingest_snapshot(spark, dump(tmp_path, raw_pdf(n_days=5).assign(**{COST: 7.0}), "260406"), out)
    assert reader.agg(F.sum("cost")).first()[0] == 3000  # files of the earlier one stay for its readers
    assert versions.read_published(spark, out).agg(F.sum("cost")).first()[0] == 105


def test_the_second_of_two_writers_fails(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "facts")
    snap.ingest_snapshot(spark, dump(tmp_path, raw_pdf(n_days=2), "260402"), out)
    real = storage.write_new_text

    def other_first(spark_, path, text):
        real(spark_, path, storage.read_text(spark, f"{out}/_published/00000001.json"))
        real(spark_, path, text)

    monkeypatch.setattr(storage, "write_new_text", other_first)
    with pytest.raises(Exception, match="(?i)exist"):
        snap.ingest_snapshot(spark, dump(tmp_path, raw_pdf(n_days=3), "260403"), out)
    assert versions.read_published(spark, out).count() == 6


def test_a_source_that_changes_while_it_is_read_is_not_published(spark, tmp_path):
    out, src = str(tmp_path / "facts"), dump(tmp_path, raw_pdf(n_days=2), "260402")
    fact = snap.scan_snapshot(spark, src)
    digests = {d: (n + 1, x) for d, n, x in ((r["activity_date"].isoformat(), r["n_rows"], r["digest"])
                                             for r in versions.day_digests(fact).collect())}
    with pytest.raises(versions.SourceChanged):
        versions.publish(spark, out, fact, digests, src, "state")
    assert versions.published(spark, out) is None
    with pytest.raises(FileNotFoundError):
        versions.read_published(spark, out)


def test_digests_tell_rows_apart_but_not_their_order(spark):
    def digest(values):
        df = spark.createDataFrame([(dt.date(2026, 4, 1), *v) for v in values], "activity_date date, a string, b string")
        return versions.day_digests(df).first()["digest"]

    one = digest([("x", None), ("y", "z"), ("y", "z")])
    assert one == digest([("y", "z"), ("x", None), ("y", "z")])
    assert len({one, digest([(None, "x"), ("y", "z"), ("y", "z")]), digest([("x", None), ("y", "z")]),
                digest([("x", None), ("z", "y"), ("y", "z")]), digest([("x", ""), ("y", "z"), ("y", "z")]),
                digest([("x", None), ("x", None), ("y", "z")])}) == 6


def test_rows_without_a_date_are_kept_and_counted(spark, tmp_path):
    out = str(tmp_path / "facts")
    src = write_raw(tmp_path / "a.csv", ["2026-04-01,Search,1,2,3", ",Search,10,2,3", "soon,Search,20,2,3"])
    audit = snap.ingest_snapshot(spark, src, out)
    assert audit["rows"] == 3 and audit["unreadable"] == {"activity_date": 1} and audit["days_written"] == 2
    fact = versions.read_published(spark, out)
    assert fact.where("activity_date is null").agg(F.sum("cost")).first()[0] == 30
    assert versions.published(spark, out).dates == [dt.date(2026, 4, 1)]
    (tmp_path / "a.csv").unlink()
    write_raw(tmp_path / "a.csv", ["2026-04-01,Search,1,2,3", ",Search,11,2,3", "soon,Search,20,2,3"])
    audit = snap.ingest_snapshot(spark, src, out)
    assert audit["days_written"] == 1 and versions.read_published(spark, out).agg(F.sum("cost")).first()[0] == 32


def test_audit_from_the_committed_files(spark, tmp_path):
    out = str(tmp_path / "facts")
    audit = snap.ingest_snapshot(spark, dump(tmp_path, raw_pdf(n_days=3), "260403"), out)
    got = snap.ingest_audit(spark, out)
    assert got["rows"] == audit["rows"] == 9 and got["size_mb"] == pytest.approx(audit["size_mb"])


def test_needs_ingest_follows_the_files_state(spark, tmp_path):
    out, src = str(tmp_path / "facts"), dump(tmp_path, raw_pdf(n_days=3), "260403")
    assert snap.needs_ingest(spark, src, out)
    snap.ingest_snapshot(spark, src, out)
    assert not snap.needs_ingest(spark, src, out)
    dump(tmp_path, raw_pdf(n_days=2), "260403")
    assert snap.needs_ingest(spark, src, out)


def test_restated_days_of_many_tags_in_one_scan(spark, tmp_path):
    facts = str(tmp_path / "facts")
    one = raw_pdf(n_days=5)
    three = changed(one)
    three = three[three["날짜"] != pd.Timestamp(2026, 4, 1)]
    for tag, pdf in (("260405", one), ("260406", one), ("260407", three)):
        snap.ingest_snapshot(spark, dump(tmp_path, pdf, tag), f"{facts}/tag={tag}")
    tags = ["260405", "260406", "260407"]
    whole = versions.read_tags(spark, facts)
    assert sorted({r["tag"] for r in whole.select("tag").distinct().collect()}) == tags
    scans = restated_days(whole, tags)._jdf.queryExecution().executedPlan().toString().count("FileScan")
    assert scans == 1
    got = [(r["tag"], r["previous_tag"], str(r["activity_date"]), r["change"], r["rows_before"], r["rows_after"],
            r["cost_after"] - r["cost_before"])
           for r in sorted(restated_days(whole, tags).collect(), key=lambda r: r["activity_date"])]
    assert got == [("260407", "260406", "2026-04-01", "removed", 3, 0, -600.0),
                   ("260407", "260406", "2026-04-02", "restated", 3, 3, 1.0),
                   ("260407", "260406", "2026-04-06", "added", 0, 3, 600.0)]
    # the lists of days say the same, without any scan
    lists = versions.restated_days([versions.published(spark, f"{facts}/tag={t}") for t in tags], spark).collect()
    assert [(str(r["activity_date"]), r["change"]) for r in lists] == [(x[2], x[3]) for x in got]
    assert restated_days(versions.read_tags(spark, facts, tags[:2]), tags[:2]).count() == 0


def test_part_files_of_different_types(spark, tmp_path):
    """An exporter types a column by what a part holds: int, double, text, nothing."""
    folder = tmp_path / f"{STEM} export_260403.parquet"
    folder.mkdir()
    base = raw_pdf(n_days=1)
    for name, cost, date in (("a", [1, 2, 3], None), ("b", [1.5, 2.5, 3.5], "%Y-%m-%d"), ("c", ["1,000", "n/a", " 7 "], None),
                             ("d", [None, None, None], "%Y/%m/%d")):
        part = base.assign(**{COST: cost})
        if date:
            part["날짜"] = part["날짜"].dt.strftime(date)
        if name == "d":
            part = part.drop(columns=["채널", "노출"]).assign(extra="e")
        part.to_parquet(folder / f"part-{name}.parquet", index=False)
    (folder / "_SUCCESS").write_text("")
    out = str(tmp_path / "facts")
    with pytest.raises(snap.UnreadableSnapshot, match="'cost': 1"):
        snap.ingest_snapshot(spark, str(folder), out)
    audit = snap.ingest_snapshot(spark, str(folder), out, allow_unreadable=True)
    assert audit["rows"] == 12 and audit["unreadable"] == {"cost": 1}
    fact = versions.read_published(spark, out)
    got = fact.agg(F.sum("cost"), F.count("cost"), F.sum("impressions"), F.count("channel"), F.count("extra")).first()
    assert [float(x) for x in got] == [1020.5, 8.0, 9009.0, 9.0, 3.0]
    assert snap.scan_snapshot(spark, str(folder)).where("activity_date = DATE'2026-04-01'").count() == 12


def test_csv_parts_with_columns_in_another_order(spark, tmp_path):
    folder = tmp_path / f"{STEM} export_260403.csv"
    folder.mkdir()
    write_raw(folder / "part-0.csv", ["2026-04-01,Search,1,2,3"])
    (folder / "part-1.csv").write_text(
        f"매체상세,날짜,(대시보드기준) 전체 매출,(스마트스토어센터기준) 전체 매출,{COST}\nShop,2026-04-02,30,20,10\n")
    got = rows(snap.scan_snapshot(spark, str(folder)).select("activity_date", "media", "cost", "rev_ss", "rev_db"))
    assert [tuple(map(str, r)) for r in got] == [
        ("2026-04-01", "1.0000", "Search", "3.0000", "2.0000"), ("2026-04-02", "10.0000", "Shop", "30.0000", "20.0000")]


def test_the_newest_valid_pick_sizes_one_directory(spark, tmp_path, monkeypatch):
    for day in range(1, 9):
        d = tmp_path / f"{STEM} export_26040{day}.parquet"
        d.mkdir()
        (d / "part-0").write_bytes(b"x" * (500 if day < 8 else 10))
    calls, real = [], snap.is_larger
    monkeypatch.setattr(snap, "is_larger", lambda s, p, n: (calls.append(p), real(s, p, n))[1])
    cat = snap.snapshot_catalog(spark, str(tmp_path))
    assert not calls and cat.count() == 8
    got = snap.newest_valid_snapshot(cat, as_of=dt.date(2026, 4, 9))
    assert got.endswith("260407.parquet") and len(calls) == 2  # the newest is too small


def test_a_source_names_its_files_its_own_way(spark, tmp_path):
    (tmp_path / "260401 daily.csv").write_bytes(b"x" * 300)
    assert snap.snapshot_catalog(spark, str(tmp_path)).count() == 0
    own = r"^()()([0-9]{6}) daily\.(csv)$"
    assert [r["tag"] for r in snap.snapshot_catalog(spark, str(tmp_path), own).collect()] == ["260401"]


def test_publications_are_plain_text(spark, tmp_path):
    out = str(tmp_path / "facts")
    snap.ingest_snapshot(spark, dump(tmp_path, raw_pdf(n_days=2), "260402"), out)
    head, *days, end = storage.read_text(spark, f"{out}/_published/00000001.json").splitlines()
    assert end == "complete" and json.loads(head)["source"].endswith("260402.parquet")
    assert [json.loads(d)["rows"] for d in days] == [3, 3]
