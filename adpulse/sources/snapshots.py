"""Snapshot files: catalog, newest pick, scan, ingest, freshness skip and audit
(S1-S8).

Every daily file re-dumps the whole history, so the newest valid snapshot IS
the table; older ones are superseded, never unioned. Listing a folder is
metadata work (one call to the storage's file system, a handful of entries);
the catalog is then an ordinary small DataFrame and every choice on it
(regex match, order, 120-day window, size floor) is a Spark expression.
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adpulse.sources import versions
from adpulse.sources.schema import (ABSENT, FACT_COLUMNS, REQUIRED, column_absent, conform, csv_reader,
                                    unreadable)
from adpulse.sources.storage import (_hadoop, _local, entries, file_identity, files, first_line, is_larger,  # noqa: F401
                                     partition_values, path_exists, path_size)

# File name of a daily snapshot: any stem, a separator, the six digits of the date tag
# (YYMMDD), the extension. A source's own pattern is a setting (``name_re``) with the same
# four groups.
SNAPSHOT_NAME_RE = r"(?i)^(.*?)([ _-]?)([0-9]{6})\.(xlsx|parquet|csv)$"

CATALOG_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("length", T.LongType()),
    T.StructField("mtime", T.TimestampType()),
    T.StructField("is_dir", T.BooleanType()),
])


def snapshot_catalog(spark: SparkSession, folder: str, name_re: str = SNAPSHOT_NAME_RE) -> DataFrame:
    """Matching snapshot files with their date tag and ranks, from one listing
    of the folder. A directory (a snapshot in part files) has no length here:
    the picks size the few they come to.

    Columns: path, name, length, mtime, is_dir, tag, tag_date, ext, ext_rank
    (parquet 1, csv 1, xlsx 0), sep_rank (a name with spaces 1, another form 0).
    """
    rows = entries(spark, folder, name_re)
    cat = spark.createDataFrame(rows, CATALOG_SCHEMA)
    name = F.col("name")
    ext = F.lower(F.regexp_extract(name, name_re, 4))
    return (cat.where(name.rlike(name_re))
               .select("*",
                       F.regexp_extract(name, name_re, 3).alias("tag"),
                       F.to_date(F.regexp_extract(name, name_re, 3), "yyMMdd").alias("tag_date"),
                       ext.alias("ext"),
                       F.when(ext == "xlsx", F.lit(0)).otherwise(F.lit(1)).alias("ext_rank"),
                       F.when(name.contains(" "), F.lit(1)).otherwise(F.lit(0)).alias("sep_rank")))


def _newest_first(cat: DataFrame) -> DataFrame:
    return cat.orderBy(F.col("tag").desc(), F.col("ext_rank").desc(), F.col("sep_rank").desc(),
                       F.col("path").asc())


def snapshot_choices(cat: DataFrame, ext: str | None = None) -> DataFrame:
    """S3: the snapshots to choose from, newest tag first (Parquet before
    workbook on a tag); ``ext`` keeps one format."""
    if ext is not None:
        cat = cat.where(F.col("ext") == ext)
    return _newest_first(cat).select("tag", "tag_date", "name", "path", "ext", "length", "mtime")


def newest_snapshot(cat: DataFrame, ext: str | None = None) -> str | None:
    """Path of the newest snapshot (tag, then Parquet over workbook);
    ``ext`` restricts the pick to one format (e.g. 'xlsx' for conversion)."""
    if ext is not None:
        cat = cat.where(F.col("ext") == ext)
    rows = _newest_first(cat).select("path").limit(1).collect()
    return rows[0]["path"] if rows else None


def newest_valid_snapshot(cat: DataFrame, as_of: dt.date | None = None, max_days: int = 120,
                          min_bytes: int = 200, exts: tuple[str, ...] | None = None) -> str:
    """Newest snapshot tagged within the last ``max_days`` days (today
    included) and larger than ``min_bytes``; error when there is none.
    ``exts`` keeps some formats (``READABLE``: those that can be loaded).

    The candidates (at most the window's names) are walked from the newest on, and
    only a directory that is reached is sized."""
    if exts is not None:
        cat = cat.where(F.col("ext").isin(*exts))
    as_of = as_of or dt.date.today()
    lo = as_of - dt.timedelta(days=max_days - 1)
    large = F.col("is_dir") | (F.col("length") > min_bytes)
    for row in _newest_first(cat.where(F.col("tag_date").between(lo, as_of) & large)).select("path", "is_dir").collect():
        if not row["is_dir"] or is_larger(cat.sparkSession, row["path"], min_bytes):
            return row["path"]
    raise FileNotFoundError(f"no valid snapshot within the last {max_days} days")


def snapshot_by_tag(cat: DataFrame, tag: str) -> str | None:
    """S3: the snapshot of one date tag (Parquet preferred)."""
    rows = _newest_first(cat.where(F.col("tag") == tag)).select("path").limit(1).collect()
    return rows[0]["path"] if rows else None


def snapshot_by_name(cat: DataFrame, name: str) -> str | None:
    """S3: the snapshot with this exact file name (case-insensitive)."""
    rows = (cat.where(F.lower(F.col("name")) == name.lower()).orderBy("path")
               .select("path").limit(1).collect())
    return rows[0]["path"] if rows else None


def _ext(path: str) -> str:
    return os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")


#: Formats that ``read_source`` reads; workbooks must be exported first.
READABLE = ("parquet", "csv")


def read_source(spark: SparkSession, path: str, fmt: str | None = None,
                multi_line: bool = False) -> DataFrame:
    """Raw source frame by extension: parquet, csv (header, doubled quotes;
    ``multi_line`` for line breaks in cells) or json.

    Workbooks need a per-file reader that this environment does not ship;
    export the raw sheet to CSV or Parquet first.
    """
    fmt = fmt or _ext(path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "csv":
        return csv_reader(spark, multi_line).csv(path)
    if fmt == "json":
        return spark.read.json(path)
    if fmt == "xlsx":
        raise NotImplementedError("workbook snapshots must be exported to CSV or Parquet first")
    return spark.read.format(fmt).load(path)


#: Part files whose schemas are read at a time, where they differ.
_READERS = 16


def source_groups(spark: SparkSession, path: str, fmt: str | None = None,
                  multi_line: bool = False) -> list[DataFrame]:
    """A raw source as frames of one schema each. Part files of a directory may type a
    column differently (an exporter infers the types of each), or order a CSV
    header differently; then there is a frame for each kind of file.

    Parquet footers are merged by one distributed job; only if they contradict each
    other are the schemas read file by file. Of CSV parts the first line is read.
    """
    fmt = fmt or _ext(path)
    parts = []
    if fmt in ("parquet", "csv") and path_exists(spark, path):
        parts = sorted(f for f, _, _ in files(spark, path) if not f.rsplit("/", 1)[-1].startswith(("_", ".")))
    if len(parts) < 2:
        return [read_source(spark, path, fmt, multi_line)]
    if fmt == "parquet":
        reader = lambda: spark.read.option("basePath", path)
        try:
            return [reader().option("mergeSchema", True).parquet(path)]
        except Exception as e:
            if "CANNOT_MERGE" not in str(e):
                raise
        kind = lambda f: reader().parquet(f).schema.json()
        read = lambda fs: reader().parquet(*fs)
    else:
        # a compressed part's header can't be seen here: such parts count as alike, and
        # Spark compares each header with the first
        kind = lambda f: first_line(spark, f) if f.lower().endswith(".csv") else ""
        read = lambda fs: csv_reader(spark, multi_line).option("enforceSchema", False).csv(fs)
    with ThreadPoolExecutor(_READERS) as pool:
        kinds = list(pool.map(kind, parts))
    of: dict[str, list[str]] = {}
    for k, f in zip(kinds, parts):
        of.setdefault(k, []).append(f)
    return [read(fs) for fs in of.values()]


def _united(facts: list[DataFrame]) -> DataFrame:
    """Conformed frames as one; a column counts as absent if none of them had it."""
    if len(facts) == 1:
        return facts[0]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), facts)
    gone = {c for c in FACT_COLUMNS if all(column_absent(f, c) for f in facts)}
    return whole.select(*[F.col(f"`{c}`").alias(c, metadata={ABSENT: True} if c in gone else {})
                          for c in whole.columns])


def scan_snapshot(spark: SparkSession, path: str, fmt: str | None = None,
                  headers: dict | None = None, extra_headers: dict | None = None,
                  multi_line: bool = False) -> DataFrame:
    """A snapshot as the canonical fact (headers mapped, date coerced)."""
    return _united([conform(raw, headers, extra_headers) for raw in source_groups(spark, path, fmt, multi_line)])


class UnreadableSnapshot(ValueError):
    """A snapshot that must not replace an earlier one: a required column is
    missing, no row has a date, or a required measure has unreadable cells."""


def _flagged(raw: DataFrame, headers: dict | None, extra_headers: dict | None) -> tuple[DataFrame, list[str]]:
    """The conformed frame with a 0/1 column per column that may hold unreadable cells."""
    bad = unreadable(raw, headers, extra_headers)
    flags = [c.cast("int").alias(f"_bad_{n}") for n, c in bad.items()]
    return conform(raw.select("*", *flags), headers, extra_headers), list(bad)


def source_state(spark: SparkSession, src: str) -> str:
    """A digest of the names, lengths and modification times of a source's files."""
    return file_identity(spark, [src])[0][3]


def ingest_snapshot(spark: SparkSession, src: str, out: str, fmt: str | None = None,
                    headers: dict | None = None, extra_headers: dict | None = None,
                    allow_unreadable: bool = False, multi_line: bool = False,
                    source_mtime: str = "", source_length: int | None = None) -> dict:
    """S6 + S7 + S8: conforms a raw export and publishes it as typed Parquet by day.

    The first pass reads the source and counts, per day, rows, the cells that can't be
    read, and a digest of the rows; its aggregates come out of a shuffle, so a
    task that runs twice counts once. A snapshot without dates, or (unless
    ``allow_unreadable``) with unreadable cells in required measures, is refused
    before anything is written. The second pass writes the days whose digest differs
    from the published one: of a re-dump of the whole history, those that changed.
    Then the rows of the written files are compared with the first pass, and the new
    state becomes current at once (``versions``).

    Returns the audit: rows and MB of the published snapshot, unreadable cells per
    column, and the days written, kept and dropped.
    """
    state = source_state(spark, src)
    try:
        parts = [_flagged(raw, headers, extra_headers)
                 for raw in source_groups(spark, src, fmt, multi_line)]
    except ValueError as e:
        raise UnreadableSnapshot(str(e)) from e
    both = _united([p for p, _ in parts])
    bad = sorted({n for _, names in parts for n in names})
    flags = [f"_bad_{n}" for n in bad]
    counts: list[Column] = [F.coalesce(F.sum(F.col(f).cast("long")), F.lit(0)).alias(f) for f in flags]
    found = versions.day_digests(both, *counts, keep=flags).collect()  # one row a day
    cells = {n: sum(r[f"_bad_{n}"] for r in found) for n in bad}
    if not any(r["activity_date"] for r in found):
        raise UnreadableSnapshot(f"{src} has no row with a readable date")
    refused = {n: k for n, k in cells.items() if k and n in REQUIRED and n != "activity_date"}
    if refused and not allow_unreadable:
        raise UnreadableSnapshot(f"{src} has unreadable cells in required measures: {refused}")
    digests = {r["activity_date"].isoformat() if r["activity_date"] else None: (r["n_rows"], r["digest"]) for r in found}
    before = versions.published(spark, out)
    now, written = versions.publish(spark, out, both.drop(*flags), digests, src, state, source_mtime,
                                    source_length, before)
    versions.remove_superseded(spark, out)
    dropped = {d.day for d in before.days} - digests.keys() if before else ()
    return {"rows": now.rows, "size_mb": sum(d.bytes for d in now.days) / (1024 * 1024),
            "unreadable": {n: k for n, k in cells.items() if k}, "days_written": len(written),
            "days_kept": len(digests) - len(written), "days_dropped": len(dropped)}


def write_fact(df: DataFrame, path: str, partition_by: str | None = "activity_date",
               derive: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Write a fact as plain Parquet. ``rebalance`` deals rows by day, and AQE splits a
    day that holds a large share of them instead of writing one huge file.

    Without ``partition_by`` (days too small for a folder each) rows stay in their
    tasks, which sort them by date, so that pages cover few days and date predicates
    skip the others by Parquet's page index. Then ``derive`` may make the fact from ``df``
    by a projection (Spark drops sorts below joins), so that narrower rows are sorted.
    """
    derive = derive or (lambda rows: rows)
    if partition_by:
        derive(df).hint("rebalance", partition_by).write.mode("overwrite").partitionBy(partition_by).parquet(path)
    else:
        derive(df.sortWithinPartitions("activity_date")).write.mode("overwrite").parquet(path)


def needs_ingest(spark: SparkSession, src: str, out: str) -> bool:
    """S7 for one snapshot: convert unless the published state was made from this
    source in the state that its files have now."""
    done = versions.published(spark, out)
    return done is None or done.source != src or done.state != source_state(spark, src)


def audit_rows(fact: DataFrame) -> DataFrame:
    """S8, what a snapshot's rows say: their number, days, first and last day."""
    d = F.col("activity_date")
    return fact.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(d).alias("n_days"),
                    F.min(d).alias("first_day"), F.max(d).alias("last_day"))


def ingest_audit(spark: SparkSession, path: str) -> dict:
    """Rows and MB of a published snapshot, as its committed files say: rows are
    counted from the footers of the listed days, bytes by listing them."""
    of = versions.published(spark, path)
    rows = versions.read_published(spark, path, of).count()
    size = sum(n for d in of.days for _, n, _ in files(spark, f"{path.rstrip('/')}/{d.folder}"))
    return {"rows": rows, "size_mb": size / (1024 * 1024)}


def stale_conversions(src: DataFrame, dst: DataFrame) -> DataFrame:
    """Source snapshots whose converted output is missing, older, or, where
    ``dst`` names them, made from another file or another length of it.

    ``dst`` has tag and mtime (of the output, or of the source when it was converted),
    and may have source_path and source_length. Matched by tag; one row per source
    that needs (re)conversion.
    """
    more = [c for c in ("source_path", "source_length") if c in dst.columns]
    d = dst.groupBy("tag").agg(F.max("mtime").alias("dst_mtime"),
                               *[F.max_by(c, "mtime").alias(f"_{c}") for c in more])
    j = src.join(d, "tag", "left")
    stale = F.col("dst_mtime").isNull() | (F.col("dst_mtime") < F.col("mtime"))
    if "source_path" in more:
        stale = stale | ~F.col("_source_path").eqNullSafe(F.col("path"))
    if "source_length" in more:
        stale = stale | ~F.col("_source_length").eqNullSafe(F.col("length"))
    return j.where(stale).select("tag", "path", "mtime", "dst_mtime")


def latest_per_tag(cat: DataFrame) -> DataFrame:
    """The preferred file of every tag."""
    w = Window.partitionBy("tag").orderBy(F.col("ext_rank").desc(), F.col("sep_rank").desc(),
                                          F.col("path").asc())
    return cat.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")
