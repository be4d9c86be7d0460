"""Shards of near-equal bytes by k-d tree partitioning.

Each document is a point in the space of its metadata (size, source, language, place
in the id order). Starting from one node with all documents, a node that stands for n
shards is split along its widest dimension at the point below which n // 2 of n parts
of its bytes lie (the weighted median, for an even n), until every node is one shard.
Documents of one shard so have similar metadata.

Split points are found by distributed histograms. A coordinate is a whole number: the
dimension's value, then a hash of the row, so that even a value shared by most documents
can be split. Each pass sums the bytes of every open node in BINS equal ranges of its
interval, keeps the range with the split point, and goes on with it until that range
holds a negligible share of a shard. The ranges' sums are added up on the executors, so that
one row a node and pass reaches the driver; all nodes of a level are worked on together.
Only metadata is read again, never a text.

Slots are numbered gaplessly in each shard by counting small buckets of rows and adding
up the counts, so no task holds a shard.

Defined cases: a null text has no bytes beside the fixed 16 and crc32 of nothing; null
metadata is a value of its own; null and repeated doc_ids, equal texts and repeated rows
are sharded row by row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adpulse.llm.common import stored

#: Bytes a document counts beside its text.
FIXED_BYTES = 16
BINS = 1024
#: A split may be off by this share of a shard.
TOLERANCE = 0.0005
VALUE_BITS, TIE_BITS = 20, 30
#: Rows of a bucket when slots are numbered.
SLOT_ROWS = 20_000
#: Open nodes (one a shard at most, some 40 bytes each) up to which their table is sent to
#: every task; more are joined.
SENT_NODES = 50_000


@dataclass
class Node:
    shards: int
    dim: int = 0
    low: int = 0
    high: int = 0          # the split point lies in [low, high)
    below: int = 0         # bytes below low
    wanted: float = 0.0
    share: float = 0.0     # bytes of a shard


def _value(x: Column) -> Column:
    """A place on the axis for a category; null is one of its own."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(x.cast("string"), F.lit("\x00null"))), 64 - VALUE_BITS)


def _rows(docs: DataFrame) -> DataFrame:
    have = {c.lower(): c for c in docs.columns}
    text = F.col("text").cast("string")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + FIXED_BYTES).cast("long")
    category = {c: _value(F.col(have[c])) if c in have else F.lit(0).cast("long") for c in ("source", "lang")}
    doc_id = F.col("doc_id").cast("long")
    raw = docs.select(
        doc_id.alias("doc_id"), size.alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        # sizes on a logarithmic axis; ids by their leading bits, so by age
        F.least(F.floor(F.log2(size) * 30_000), F.lit(2**VALUE_BITS - 1)).cast("long").alias("v0"),
        category["source"].alias("v1"), category["lang"].alias("v2"),
        F.coalesce(F.floor(F.log2(F.abs(doc_id).cast("double") + 1) * 16_000), F.lit(0)).cast("long").alias("v3"),
        F.monotonically_increasing_id().alias("row"), F.lit(0).alias("node"))
    # stored, so that a row keeps its number and its tie-break
    return stored(raw, "metadata")


def _points(rows: DataFrame) -> DataFrame:
    def coordinate(d: int) -> Column:
        tie = F.shiftrightunsigned(F.xxhash64("row", "doc_id", F.lit(d)), 64 - TIE_BITS)
        return F.shiftleft(F.col(f"v{d}"), TIE_BITS).bitwiseOR(tie)
    return rows.select("row", "size", "node", *[coordinate(d).alias(f"c{d}") for d in range(4)])


def _own(points: DataFrame, nodes: dict[int, Node]) -> DataFrame:
    """The rows of these nodes with their coordinate x and the node's interval."""
    spark = points.sparkSession
    table = spark.createDataFrame([(i, n.dim, n.low, n.high, n.below, n.wanted) for i, n in nodes.items()],
                                  "node int, dim int, low long, high long, below long, wanted double")
    x = F.element_at(F.array(*[f"c{d}" for d in range(4)]), F.col("dim") + 1)
    return points.join(F.broadcast(table) if len(nodes) <= SENT_NODES else table, "node").withColumn("x", x)


def _split_points(points: DataFrame, nodes: dict[int, Node]) -> dict[int, int]:
    cuts: dict[int, int] = {}
    upto = Window.partitionBy("node").orderBy("bin")  # BINS rows a node at most
    while nodes:
        step = F.greatest(F.ceil((F.col("high") - F.col("low")) / F.lit(BINS)), F.lit(1))
        inside = _own(points, nodes).where("x >= low and x < high")
        sums = (inside.withColumn("bin", F.floor((F.col("x") - F.col("low")) / step).cast("int"))
                .groupBy("node", "bin", "below", "wanted").agg(F.sum("size").alias("bytes"))
                .withColumn("upto", F.col("below") + F.sum("bytes").over(upto)))
        # the first range at whose end the wanted bytes are reached
        hit = {r["node"]: r["first"] for r in sums.where("upto >= wanted").groupBy("node")
               .agg(F.min(F.struct("bin", "bytes", "upto")).alias("first")).collect()}
        for i in list(nodes):
            n = nodes[i]
            width = max(-(-(n.high - n.low) // BINS), 1)
            if i not in hit:
                cuts[i] = n.high
            else:
                bin_, got, at = hit[i]
                low, before = n.low + bin_ * width, at - got
                if got <= TOLERANCE * n.share or width == 1:
                    # the nearer end of the range
                    cuts[i] = low if n.wanted - before < at - n.wanted else low + width
                else:
                    n.low, n.high, n.below = low, min(n.high, low + width), before
            if i in cuts:
                del nodes[i]
    return cuts


def shards(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document. The number of
    shards is given, or follows from the bytes a shard should have."""
    rows = _rows(docs)
    points = _points(rows)
    dims = range(4)
    spread = [F.max(f"c{d}").alias(f"max{d}") for d in dims] + [F.min(f"c{d}").alias(f"min{d}") for d in dims]
    whole = points.agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), *spread).first()
    n_shards = n_shards or max(1, round((whole["bytes"] or 0) / target_bytes))
    open_nodes = {0: n_shards} if n_shards > 1 and whole["n"] else {}
    while open_nodes:
        stats = points.where(F.col("node").isin(list(open_nodes))).groupBy("node").agg(
            F.sum("size").alias("bytes"), *spread).collect()
        searched = {}
        for s in stats:
            k = open_nodes[s["node"]]
            width = [(s[f"max{d}"] - s[f"min{d}"]) / max(1, whole[f"max{d}"] - whole[f"min{d}"]) for d in dims]
            dim = max(dims, key=width.__getitem__)
            searched[s["node"]] = Node(k, dim, s[f"min{dim}"], s[f"max{dim}"] + 1, 0,
                                       s["bytes"] * (k // 2) / k, s["bytes"] / k)
        dim_of = {i: n.dim for i, n in searched.items()}
        cuts = _split_points(points, dict(searched))
        # a node is named by its first shard, so its second half is named by the middle one
        table = {i: Node(open_nodes[i], dim_of[i], cuts[i], open_nodes[i] // 2, 0, 0.0) for i in cuts}
        split = _own(points, table)
        points = stored(
            points.where(~F.col("node").isin(list(table))).unionByName(
                split.withColumn("node", F.when(F.col("x") < F.col("low"), F.col("node"))
                                 .otherwise(F.col("node") + F.col("high")).cast("int")).select(points.columns)),
            "kd-level")
        halves = [(i, open_nodes[i] // 2) for i in table] \
            + [(i + open_nodes[i] // 2, open_nodes[i] - open_nodes[i] // 2) for i in table]
        open_nodes = {i: k for i, k in halves if k > 1}
    return _slots(rows.drop("node").join(points.select("row", F.col("node").alias("shard")), "row"), n_shards)


def _slots(rows: DataFrame, n_shards: int) -> DataFrame:
    buckets = max(1, rows.count() // (n_shards * SLOT_ROWS))
    placed = stored(rows.select("doc_id", "size", "text_crc32", "shard", "row",
                                F.pmod(F.xxhash64("row"), F.lit(buckets)).alias("bucket")), "placed")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = (placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
             .withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    order = Window.partitionBy("shard", "bucket").orderBy("doc_id", "row")
    return (placed.withColumn("at", F.row_number().over(order) - 1).join(first, ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("at")).cast("long").alias("slot")))
