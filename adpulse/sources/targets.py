"""Target table (channel → cost, revenue and ROAS goals), S9.

Columns are positional (channel, target cost, target revenue, target ROAS);
header names do not matter. The channel is trimmed, blank or unreadable
numbers count as 0. A channel that appears again keeps its first place and takes
the later values. A missing file gives an empty table, so figures without
targets still come out; any other failure does so as well, but is logged and named.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adpulse.functions.labels import strip
from adpulse.sources.schema import csv_reader

log = logging.getLogger(__name__)

TARGET_SCHEMA = T.StructType([
    T.StructField("target_idx", T.LongType()),
    T.StructField("channel", T.StringType()),
    T.StructField("target_cost", T.DoubleType()),
    T.StructField("target_rev", T.DoubleType()),
    T.StructField("target_roas", T.DoubleType()),
])


def conform_targets(raw: DataFrame) -> DataFrame:
    """Positional columns → named, trimmed and typed; of a repeated channel the
    first place and the last values."""
    cols = raw.columns
    if len(cols) < 4:
        raise ValueError("target table needs four columns: channel, cost, revenue, ROAS")
    named = raw.select(
        F.monotonically_increasing_id().alias("_row"),
        strip(F.col(f"`{cols[0]}`")).alias("channel"),
        *[F.coalesce(strip(F.col(f"`{c}`")).try_cast("double"), F.lit(0.0)).alias(n)
          for c, n in zip(cols[1:4], ("target_cost", "target_rev", "target_roas"))],
    )
    values = F.struct("target_cost", "target_rev", "target_roas")
    dedup = named.groupBy("channel").agg(F.min("_row").alias("_row"),
                                         F.max_by(values, "_row").alias("v"))
    # a few configured rows
    order = Window.partitionBy().orderBy("_row")
    return dedup.select(F.row_number().over(order).cast("bigint").alias("target_idx"),
                        "channel", "v.*")


def read_targets(spark: SparkSession, path: str, fmt: str = "csv") -> tuple[DataFrame, str | None]:
    """A target file (csv with a header row, or parquet) as a table, and what was wrong:
    the table is empty if there is no file, or if it can't be read."""
    try:
        if fmt == "csv":
            raw = csv_reader(spark).csv(path)
        else:
            raw = spark.read.format(fmt).load(path)
        out = conform_targets(raw)
        out.take(1)
        return out, None
    except Exception as e:
        problem = str(e).split("\n")[0]
        if "PATH_NOT_FOUND" not in problem:
            log.warning("targets %s not read, their figure stays empty: %s", path, problem)
        return spark.createDataFrame([], TARGET_SCHEMA), problem


def load_targets(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The target table; empty if there is none or it can't be read."""
    return read_targets(spark, path, fmt)[0]


def targets_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Targets given inline as (channel, cost, revenue, ROAS) tuples."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in
                           ("channel", "target_cost", "target_rev", "target_roas")])
    raw = spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in rows],
                                schema)
    return conform_targets(raw)
