"""Snapshot ingest as a Structured Streaming job.

A folder receives daily exports: files, or directories of part files. At every trigger the
job lists the folder's top-level names (one call, through the session's Hadoop file
systems) and compares each date tag's preferred snapshot (S1's order: Parquet before other
formats, a name with spaces before another form) with the ledger: the path, length and
modification time that the tag's published snapshot was made from, or that was refused
before. What is new or changed, also a file rewritten in place under its old name, is
ingested as ``<out>/tag=<YYMMDD>/``; what is not changed is not looked into. Every snapshot
is a full re-dump, so two files of a tag are never added up, only the days that differ are
written, and a replayed batch finds the same state and does nothing. Optionally the
snapshot's figures are written next, under ``<figures_out>/tag=<YYMMDD>/``.

The ledger is kept with what it speaks of: each publication names its source's state
and becomes current together with its days. The triggers come from the ``rate-micro-batch``
source, whose rows are not used. A file source would list every part file of every
snapshot at each trigger, and take a path only once; a Python data source would have to
list without the session's file systems.

A snapshot that can't be used (a required column missing, no readable date,
unreadable cells in a required measure) is recorded in ``<out>/_quarantine`` and the
stream goes on. Any other error, such as a storage or executor failure, ends the
batch: it is not committed and is tried again when the stream restarts.

Settling (T2): names starting with ``_`` or ``.`` are not read, so producers write under
such a temporary name (a directory always) and rename when done. A file that is being
rewritten in place is taken once its length and time have been the same for ``settle``
seconds.
"""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from adpulse.sources import versions
from adpulse.sources.snapshots import (READABLE, SNAPSHOT_NAME_RE, UnreadableSnapshot, ingest_snapshot,
                                       latest_per_tag, needs_ingest, snapshot_catalog, stale_conversions)
from adpulse.sources.storage import entries, path_exists

QUARANTINE_SCHEMA = T.StructType([
    T.StructField("tag", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("at", T.TimestampType()),
    T.StructField("mtime", T.StringType()),
    T.StructField("length", T.LongType()),
])
LEDGER_SCHEMA = "tag string, source_path string, source_length long, mtime timestamp"
#: Seconds for which a file must not have changed.
SETTLE = 2.0


def _write_figures(spark: SparkSession, out_dir: str, figures_out: str, tag: str, cfg,
                   targets_path: str | None, brand: str | None = None, campaign: str | None = None,
                   ad_group: str | None = None) -> None:
    """The figures of one freshly published snapshot (every figure, overwrite)."""
    from adpulse.config import DEFAULT_CONFIG
    from adpulse.operators.anchors import anchors_from_dates
    from adpulse.plans.figures import Figures
    from adpulse.sources.targets import load_targets
    path = f"{out_dir.rstrip('/')}/tag={tag}"
    of = versions.published(spark, path)
    targets = load_targets(spark, targets_path) if targets_path else None
    figures = Figures(versions.read_published(spark, path, of), cfg or DEFAULT_CONFIG, targets, brand=brand,
                      campaign=campaign, ad_group=ad_group, anchors=anchors_from_dates(of.dates))
    figures.write_all(f"{figures_out.rstrip('/')}/tag={tag}")


class Ledger:
    """Per tag the state (path, length, mtime) of the source that was published last,
    and the states that were refused. Read from the output once; a restart reads it again."""

    def __init__(self, spark: SparkSession, out: str):
        self.done: dict[str, tuple] = {}
        self.refused: set[tuple] = set()
        for _, name, _, _, is_dir in entries(spark, out, "^tag="):
            of = versions.published(spark, f"{out}/{name}") if is_dir else None
            if of is not None and of.source_mtime:
                self.done[name[len("tag="):]] = (of.source, of.source_length, dt.datetime.fromisoformat(of.source_mtime))
        if path_exists(spark, f"{out}/_quarantine"):
            for r in spark.read.schema(QUARANTINE_SCHEMA).parquet(f"{out}/_quarantine").collect():  # one row a refusal
                if r["mtime"]:
                    self.refused.add((r["source"], r["length"], dt.datetime.fromisoformat(r["mtime"])))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(tag, *state) for tag, state in self.done.items()], LEDGER_SCHEMA)


def settled(spark: SparkSession, watch_dir: str, name_re: str, settle: float) -> DataFrame:
    """The catalog of the folder without files that change: what was modified within the
    last `settle` seconds must look the same after them."""
    found = snapshot_catalog(spark, watch_dir, name_re)
    if settle <= 0:
        return found
    edge = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) - dt.timedelta(seconds=settle)
    seen = {e[0]: e for e in entries(spark, watch_dir, name_re)}
    if all(e[3] <= edge for e in seen.values()):
        return found
    time.sleep(settle)
    same = [e[0] for e in entries(spark, watch_dir, name_re) if seen.get(e[0]) == e]
    return found.where(F.col("path").isin(*same)) if same else found.limit(0)


def make_batch_writer(watch_dir: str, out_dir: str, name_re: str = SNAPSHOT_NAME_RE,
                      headers: dict | None = None, extra_headers: dict | None = None,
                      figures_out: str | None = None, cfg=None, targets_path: str | None = None,
                      exts: tuple[str, ...] = READABLE, brand: str | None = None,
                      campaign: str | None = None, ad_group: str | None = None, multi_line: bool = False,
                      allow_unreadable: bool = False, settle: float = SETTLE, at_most: int | None = None):
    """foreachBatch function: ingests every tag whose preferred snapshot the ledger does
    not know; with ``figures_out``, also writes its figures. ``at_most``: so many a batch,
    the others with the next ones."""
    out, ledgers = out_dir.rstrip("/"), []

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not ledgers:
            ledgers.append(Ledger(spark, out))
        ledger = ledgers[0]
        found = settled(spark, watch_dir, name_re, settle)
        chosen = latest_per_tag(found.where(F.col("ext").isin(*exts) & ~F.col("name").rlike("^[_.]")))
        stale = stale_conversions(chosen, ledger.frame(spark)).select("tag", "path")
        rows = chosen.join(stale, ["tag", "path"]).select("tag", "path", "length", "mtime").collect()  # new or changed
        bad = []
        todo = [r for r in sorted(rows) if (r["path"], r["length"], r["mtime"]) not in ledger.refused]
        for row in todo[:at_most]:
            tag, path = row["tag"], row["path"]
            state, dest = (path, row["length"], row["mtime"]), f"{out}/tag={tag}"
            if needs_ingest(spark, path, dest):
                try:
                    ingest_snapshot(spark, path, dest, headers=headers, extra_headers=extra_headers,
                                    allow_unreadable=allow_unreadable, multi_line=multi_line,
                                    source_mtime=row["mtime"].isoformat(), source_length=row["length"])
                except UnreadableSnapshot as e:
                    bad.append((tag, path, str(e), int(batch_id), dt.datetime.now(), row["mtime"].isoformat(), row["length"]))
                    ledger.refused.add(state)
                    continue
                if figures_out:
                    _write_figures(spark, out, figures_out, tag, cfg, targets_path, brand, campaign, ad_group)
            ledger.done[tag] = state
        if bad:
            (spark.createDataFrame(bad, QUARANTINE_SCHEMA)
                  .write.mode("append").parquet(f"{out}/_quarantine"))

    return write_batch


def start_ingest_stream(spark: SparkSession, watch_dir: str, out_dir: str,
                        checkpoint: str | None = None, name_re: str = SNAPSHOT_NAME_RE,
                        headers: dict | None = None, extra_headers: dict | None = None,
                        available_now: bool = False,
                        processing_time: str = "30 seconds", figures_out: str | None = None,
                        cfg=None, targets_path: str | None = None,
                        max_snapshots_per_trigger: int | None = None,
                        exts: tuple[str, ...] = READABLE, brand: str | None = None,
                        campaign: str | None = None, ad_group: str | None = None, multi_line: bool = False,
                        allow_unreadable: bool = False, settle: float = SETTLE) -> StreamingQuery:
    """Start the watcher stream. ``available_now`` processes what is there and
    stops (scheduled runs, tests). With ``figures_out`` every new snapshot's
    figures (of one ``brand``, ``campaign`` or ``ad_group`` if given) are written under
    ``<figures_out>/tag=<tag>``. ``multi_line`` and ``allow_unreadable`` are those of
    ``ingest_snapshot``. The stream's offsets are kept under ``<out_dir>/_checkpoint``
    unless another place is named."""
    ticks = (spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load())
    writer = make_batch_writer(watch_dir, out_dir, name_re, headers, extra_headers, figures_out, cfg, targets_path,
                               exts, brand, campaign, ad_group, multi_line, allow_unreadable, settle,
                               None if available_now else max_snapshots_per_trigger)
    w = (ticks.writeStream.foreachBatch(writer)
              .option("checkpointLocation", checkpoint or f"{out_dir.rstrip('/')}/_checkpoint"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()
