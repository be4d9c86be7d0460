"""Canonical fact schema and the source-header map.

Engine code uses only canonical names; ``conform`` maps a source frame (any
locale's headers) onto them, coerces the date and casts measures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adpulse.functions.labels import strip

MONEY_TYPE = T.DecimalType(18, 4)

FACT_SCHEMA = T.StructType([
    T.StructField("activity_date", T.DateType()),
    T.StructField("channel", T.StringType()),
    T.StructField("media", T.StringType()),
    T.StructField("campaign", T.StringType()),
    T.StructField("ad_group", T.StringType()),
    T.StructField("creative", T.StringType()),
    T.StructField("keyword", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("product", T.StringType()),
    T.StructField("promo", T.StringType()),
    T.StructField("impressions", T.LongType()),
    T.StructField("clicks", T.LongType()),
    T.StructField("cost", MONEY_TYPE),
    T.StructField("rev_ss", MONEY_TYPE),
    T.StructField("rev_db", MONEY_TYPE),
    T.StructField("buy_ss", T.LongType()),
    T.StructField("buy_db", T.LongType()),
    T.StructField("rev_market_a", MONEY_TYPE),
    T.StructField("rev_market_b", MONEY_TYPE),
])

FACT_COLUMNS = tuple(f.name for f in FACT_SCHEMA.fields)
REQUIRED = ("activity_date", "media", "cost", "rev_ss", "rev_db")
# Column metadata key set by ``conform`` on a column the source did not have.
ABSENT = "adpulse_absent"

# Optional measures count as 0 when the source lacks them.
OPTIONAL_ZERO = ("impressions", "clicks", "buy_ss", "buy_db")

# Source headers of the reference's daily sheet, mapped
# to canonical names. The brand-split column is source specific; pass its
# header through ``extra_headers`` (e.g. {"<header>": "brand"}).
SOURCE_HEADERS = {
    "날짜": "activity_date",
    "채널": "channel",
    "매체상세": "media",
    "캠페인": "campaign",
    "그룹": "ad_group",
    "소재/키워드": "creative",
    "스마트스토어센터_키워드": "keyword",
    "실 전환 발생 상품": "product",
    "프로모션명": "promo",
    "노출": "impressions",
    "클릭": "clicks",
    "비용(markup+)": "cost",
    "(스마트스토어센터기준) 전체 매출": "rev_ss",
    "(대시보드기준) 전체 매출": "rev_db",
    "(스마트스토어센터기준) 전체 구매": "buy_ss",
    "(대시보드기준) 전체 구매": "buy_db",
    "쿠팡_매출": "rev_market_a",
    "g마켓_매출": "rev_market_b",
}


def column_absent(df: DataFrame, col: str) -> bool:
    """True when the source had no such column (or the frame lacks it)."""
    if col not in df.columns:
        return True
    return bool(df.schema[col].metadata.get(ABSENT, False))


def coerce_date(df: DataFrame, col: str) -> F.Column:
    """Day of any stored date form; unparsable text becomes NULL.

    DATE stays, TIMESTAMP truncates, BIGINT is read as nanoseconds since the
    epoch (pandas/pyarrow files read with nanosAsLong), text is parsed
    leniently with ``try_to_timestamp``.
    """
    dtype = df.schema[col].dataType
    c = F.col(f"`{col}`")
    if isinstance(dtype, T.DateType):
        return c
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.to_date(c)
    if isinstance(dtype, (T.LongType, T.IntegerType)):
        return F.to_date(F.timestamp_micros(F.floor(c / 1000)))
    text = strip(c)
    return F.coalesce(F.to_date(F.try_to_timestamp(text)),
                      F.try_to_date(text, "yyyy-MM-dd"),
                      F.try_to_date(text, "yyyy/MM/dd"),
                      F.try_to_date(text, "yyyyMMdd"))


def csv_reader(spark: SparkSession, multi_line: bool = False) -> DataFrameReader:
    """CSV with a header as spreadsheets and pandas write it: quotes inside a
    quoted cell are doubled. ``multi_line`` allows line breaks in cells; such a
    file is read by one task, so it is off by default."""
    return (spark.read.option("header", True).option("mode", "PERMISSIVE")
            .option("quote", '"').option("escape", '"').option("multiLine", multi_line))


# 1,234 or -1,234,567.5: separators at every third digit, nothing else
_THOUSANDS = r"^[+-]?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]*)?$"


def read_measure(df: DataFrame, col: str, dtype: T.DataType) -> F.Column:
    """A measure cell as a number. Text may have white space around it and
    thousands separators; blank text is NULL, and so is what can't be read (other
    text, or too large for the type): ``unreadable`` tells these cells."""
    c = F.col(f"`{col}`")
    if not isinstance(df.schema[col].dataType, T.StringType):
        return c.try_cast(dtype)
    text = strip(c)
    return F.when(text.rlike(_THOUSANDS), F.regexp_replace(text, ",", "")).otherwise(text).try_cast(dtype)


def source_columns(df: DataFrame, headers: dict[str, str] | None = None,
                   extra_headers: dict[str, str] | None = None) -> dict[str, str]:
    """Canonical name → column of the source; the first of equal headers."""
    mapping = dict(SOURCE_HEADERS if headers is None else headers)
    mapping.update(extra_headers or {})
    for canon in FACT_COLUMNS:
        mapping.setdefault(canon, canon)
    present: dict[str, str] = {}
    for src in df.columns:
        canon = mapping.get(src.strip())
        if canon is not None and canon not in present:
            present[canon] = src
    return present


def unreadable(df: DataFrame, headers: dict[str, str] | None = None,
               extra_headers: dict[str, str] | None = None) -> dict[str, F.Column]:
    """Per date or measure column of the source, whether a row's cell holds
    something that ``conform`` can't read and so makes NULL."""
    present, out = source_columns(df, headers, extra_headers), {}
    for field in FACT_SCHEMA.fields:
        if field.name not in present or isinstance(field.dataType, T.StringType):
            continue
        c = F.col(f"`{present[field.name]}`")
        value = coerce_date(df, present[field.name]) if field.name == "activity_date" \
            else read_measure(df, present[field.name], field.dataType)
        out[field.name] = c.isNotNull() & (strip(c) != "") & value.isNull()
    return out


def conform(df: DataFrame, headers: dict[str, str] | None = None,
            extra_headers: dict[str, str] | None = None,
            keep_extra: bool = True) -> DataFrame:
    """Rename source headers to canonical names and cast to FACT_SCHEMA.

    Missing optional measures become 0, missing label columns NULL; a missing
    required column raises; an unreadable value becomes NULL (``unreadable``
    counts these, and ``snapshots.ingest_snapshot`` refuses them). Extra
    columns pass through as strings (nulls kept).
    """
    present = source_columns(df, headers, extra_headers)
    missing = [c for c in REQUIRED if c not in present]
    if missing:
        raise ValueError(f"snapshot is missing required columns: {missing}")

    cols = []
    for field in FACT_SCHEMA.fields:
        name = field.name
        if name not in present:
            default = F.lit(0) if name in OPTIONAL_ZERO else F.lit(None)
            # Marked, so operators can tell "no such column" from "all null".
            cols.append(default.cast(field.dataType).alias(name, metadata={ABSENT: True}))
        elif name == "activity_date":
            cols.append(coerce_date(df, present[name]).alias(name))
        elif isinstance(field.dataType, T.StringType):
            cols.append(F.col(f"`{present[name]}`").cast("string").alias(name))
        else:
            cols.append(read_measure(df, present[name], field.dataType).alias(name))
    if keep_extra:
        used = set(present.values())
        for src in df.columns:
            if src not in used:
                cols.append(F.col(f"`{src}`").cast("string").alias(src))
    return df.select(*cols)
