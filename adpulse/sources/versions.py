"""A snapshot published by day, in versions, so that a re-dump rewrites only the days
that changed and readers always see one whole state.

    <table>/version=<n>-<id>/activity_date=<day>/part-*   written once, never changed
    <table>/_published/<n>.json                           written last: what is current

A publication lists every day with the version that holds it, its rows, bytes and
digest. It is a small file that is complete or is not read (its last line says so), and its
number is one higher than that of the state it was made from, so of two writers the second
fails instead of overwriting. A crash before it leaves the earlier state current, and the
unlisted files are removed with a later publication. Readers take the highest number, then
name the day folders themselves: what is not listed is never read, and what they have read
stays for `KEEP` publications.

A day's digest is its row count and two sums of row hashes, which neither order nor
partitions change. Spark sums them before the shuffle: one row a day.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adpulse.sources import storage

DAY_COLUMN = "activity_date"
NULL_DAY = "__HIVE_DEFAULT_PARTITION__"
#: Publications whose files stay: the current one and those that readers may still use.
KEEP = 2
_END = "complete"


@dataclass(frozen=True)
class Day:
    day: str | None  # None: rows without a date
    version: str
    rows: int
    bytes: int
    digest: str

    @property
    def folder(self) -> str:
        return f"version={self.version}/{DAY_COLUMN}={self.day or NULL_DAY}"


@dataclass(frozen=True)
class Publication:
    number: int
    source: str  # path that it was made from
    state: str  # of the source's files when it was read
    source_mtime: str
    source_length: int | None
    schema: str
    days: tuple[Day, ...]

    @property
    def rows(self) -> int:
        return sum(d.rows for d in self.days)

    @property
    def dates(self) -> list[dt.date]:
        return sorted(dt.date.fromisoformat(d.day) for d in self.days if d.day)


def _numbers(spark: SparkSession, table: str) -> list[int]:
    names = [e[1] for e in storage.entries(spark, f"{table}/_published", r"^[0-9]+\.json$")]
    return sorted((int(n.split(".")[0]) for n in names), reverse=True)


def _read(spark: SparkSession, table: str, number: int) -> Publication | None:
    lines = storage.read_text(spark, f"{table}/_published/{number:08d}.json").splitlines()
    if not lines or lines[-1] != _END:  # its writer did not come to the end
        return None
    head, *days = map(json.loads, lines[:-1])
    return Publication(number=number, days=tuple(Day(**d) for d in days), **head)


def published(spark: SparkSession, table: str) -> Publication | None:
    """The current publication; None if there is none."""
    table = table.rstrip("/")
    return next((p for n in _numbers(spark, table) if (p := _read(spark, table, n))), None)


def read_published(spark: SparkSession, table: str, of: Publication | None = None) -> DataFrame:
    """The rows of the current publication (or of another one). Days are partition
    folders, so date filters prune them."""
    table = table.rstrip("/")
    of = of or published(spark, table)
    if of is None:
        raise FileNotFoundError(f"{table} has no published snapshot")
    schema = T.StructType.fromJson(json.loads(of.schema))
    paths = [f"{table}/{d.folder}" for d in of.days]
    if not paths:
        return spark.createDataFrame([], schema)
    return (spark.read.schema(schema).option("basePath", table).parquet(*paths)
            .select(*[F.col(f"`{f.name}`") for f in schema.fields]))


def read_tags(spark: SparkSession, facts: str, tags: Sequence[str] | None = None) -> DataFrame:
    """The published snapshots of several tags (all by default) of a facts folder as one
    scan, with the column ``tag``. Columns that a tag's snapshot does not have are null
    there."""
    facts = facts.rstrip("/")
    found = [e[1][len("tag="):] for e in storage.entries(spark, facts, "^tag=") if e[4]]
    of = {t: p for t in (found if tags is None else tags) if (p := published(spark, f"{facts}/tag={t}"))}
    if not of:
        raise FileNotFoundError(f"{facts} has no published snapshot of {tags or 'any tag'}")
    columns: dict[str, T.StructField] = {}
    for p in of.values():
        for f in T.StructType.fromJson(json.loads(p.schema)).fields:
            columns.setdefault(f.name, T.StructField(f.name, f.dataType))
    paths = [f"{facts}/tag={t}/{d.folder}" for t, p in of.items() for d in p.days]
    schema = T.StructType([*columns.values(), T.StructField("tag", T.StringType())])
    return (spark.read.schema(schema).option("basePath", facts).parquet(*paths)
            .select("tag", *[F.col(f"`{c}`") for c in columns]))


def row_hashes(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a row's columns but for the day, by name; a null is told
    from an absent value."""
    cells = [x for c in sorted(df.columns) if c != DAY_COLUMN for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    return [F.xxhash64(F.lit(seed), *cells) for seed in (1, 2)]


def day_digests(df: DataFrame, *more: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Per day its digest (`n_rows`, `digest`) of all columns but those in `keep`,
    which are there for the further aggregates."""
    hashes = row_hashes(df.drop(*keep))
    wide = T.DecimalType(38, 0)
    sums = [F.sum(h.cast(wide)).cast("string") for h in hashes]
    return df.groupBy(DAY_COLUMN).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.concat_ws(":", F.count(F.lit(1)).cast("string"), *sums).alias("digest"), *more)


def changed_days(before: Publication | None, schema: str, digests: dict[str | None, str]) -> list[str | None]:
    """Days that must be written: new ones, and those whose digest differs from
    the published one; all if the columns have changed."""
    known = {d.day: d.digest for d in before.days} if before and before.schema == schema else {}
    return [day for day, digest in digests.items() if known.get(day) != digest]


class SourceChanged(OSError):
    """What was written is not what was counted: the source changed in between. Passing."""


def publish(spark: SparkSession, table: str, df: DataFrame, digests: dict[str | None, tuple[int, str]],
            source: str, state: str, source_mtime: str = "", source_length: int | None = None,
            before: Publication | None = None) -> tuple[Publication, list[str | None]]:
    """Writes the days of `df` that differ from the publication `before`, checks the rows
    of the written files, and makes the new state current. `digests`: rows and digest of
    each day of `df`. Returns the publication and the days written."""
    table = table.rstrip("/")
    schema = df.schema.json()
    wanted = changed_days(before, schema, {d: x for d, (_, x) in digests.items()})
    newest = max(_numbers(spark, table), default=0)
    number = newest + 1
    version = f"{number:08d}-{uuid.uuid4().hex[:8]}"
    folder, sizes, rows = f"{table}/version={version}", {}, {}
    if wanted:
        day = F.col(DAY_COLUMN)
        if len(wanted) < len(digests):
            some = day.isin(*[dt.date.fromisoformat(d) for d in wanted if d]) if any(wanted) else F.lit(False)
            df = df.where(some | day.isNull()) if None in wanted else df.where(some)
        df.hint("rebalance", DAY_COLUMN).write.partitionBy(DAY_COLUMN).parquet(folder)
        for path, length, _ in storage.files(spark, folder):
            at = path.rfind(f"{DAY_COLUMN}=")
            if at >= 0:
                name = path[at + len(DAY_COLUMN) + 1:].split("/")[0]
                name = None if name == NULL_DAY else name
                sizes[name] = sizes.get(name, 0) + length
        # counted from the committed files; no column is read, only their footers
        whole = spark.read.schema(df.schema).parquet(folder)
        rows = {r[DAY_COLUMN].isoformat() if r[DAY_COLUMN] else None: r["n"] for r in
                whole.groupBy(DAY_COLUMN).agg(F.count(F.lit(1)).alias("n")).collect()}
    if rows != {d: digests[d][0] for d in wanted}:
        raise SourceChanged(f"{source} changed while it was read")
    kept = {d.day: d for d in before.days} if before else {}
    days = tuple(Day(d, version, digests[d][0], sizes[d], digests[d][1]) if d in rows else kept[d]
                 for d in sorted(digests, key=lambda d: d or ""))
    out = Publication(number, source, state, source_mtime, source_length, schema, days)
    head = {k: v for k, v in asdict(out).items() if k not in ("number", "days")}
    lines = [json.dumps(head), *(json.dumps(asdict(d)) for d in days), _END]
    storage.write_new_text(spark, f"{table}/_published/{number:08d}.json", "\n".join(lines) + "\n")
    return out, wanted


def remove_superseded(spark: SparkSession, table: str, keep: int = KEEP) -> None:
    """Removes day folders that none of the last `keep` publications lists. Folders
    of numbers above the current one belong to a writer at work and stay."""
    table = table.rstrip("/")
    numbers = _numbers(spark, table)
    whole = [p for n in numbers if (p := _read(spark, table, n))][:keep]
    if not whole:
        return
    used = {d.folder for p in whole for d in p.days}
    used_versions = {f.split("/")[0] for f in used}
    for path, name, _, _, is_dir in storage.entries(spark, table, "^version="):
        if not is_dir or int(name[len("version="):].split("-")[0]) > whole[0].number:
            continue
        if name not in used_versions:
            storage.delete(spark, path)
            continue
        for day_path, day_name, _, _, _ in storage.entries(spark, path, f"^{DAY_COLUMN}="):
            if f"{name}/{day_name}" not in used:
                storage.delete(spark, day_path)
    for n in numbers:
        if n < whole[-1].number:
            storage.delete(spark, f"{table}/_published/{n:08d}.json")


def restated_days(publications: Iterable[Publication], spark: SparkSession) -> DataFrame:
    """Days that differ between consecutive publications, from their lists alone:
    source, previous_source, day, change (added, removed, restated), rows before and after."""
    out, earlier = [], None
    for p in publications:
        now = {d.day: d for d in p.days}
        if earlier is not None:
            old = {d.day: d for d in earlier.days}
            for day in sorted(now.keys() | old.keys(), key=lambda d: d or ""):
                a, b = old.get(day), now.get(day)
                if a is None or b is None or a.digest != b.digest:
                    kind = "added" if a is None else "removed" if b is None else "restated"
                    out.append((p.source, earlier.source, dt.date.fromisoformat(day) if day else None, kind,
                                a.rows if a else 0, b.rows if b else 0))
        earlier = p
    return spark.createDataFrame(out, "source string, previous_source string, activity_date date, change string, "
                                      "rows_before long, rows_after long")
