"""Near-duplicate documents by SimHash, found through segment popcounts.

A fingerprint's 64 bits are cut into 32 segments of two bits, and each segment is
mapped to its number of set bits. Flipping one bit moves one count by one, so the
Manhattan distance of two count vectors is at most the Hamming distance of the
fingerprints: a lower bound to search by. The vectors lie on a grid {0, 1, 2}^32. A
distance of 3 at most leaves at least 3 of 6 blocks of coordinates equal, so each
vector goes to the 20 cells named by 3 of its 6 blocks, and all pairs in range share
a cell. Within a cell the Manhattan bound is tested first, then the exact Hamming
distance. Counts are kept in unary (00, 01, 11), which makes the Manhattan distance a
popcount of an exclusive or.

Equal fingerprints are merged before the search, so groups of copies cost one row. A
cell of very many different fingerprints (a large group of near copies) is split into
chunks, and each pair of chunks is a task of its own. A cell returns no more links
than join what is connected there (a forest), never all pairs. Connected components of
the links come from alternating large-star and small-star steps, each stored.

Defined cases: a null or empty text, or one without words, has fingerprint zero and is
linked like any other; fewer words than a shingle make one shingle; null doc_ids are
fingerprinted and linked, a component's id is the smallest non-null doc_id in it (null
if there is none); repeated rows are kept; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adpulse.llm.common import in_slices, stored, whole_groups

SEED = 42
#: Cells with more fingerprints are split into chunks of about this many.
CELL_ROWS = 20_000
#: Groups up to this size return all their links, larger ones a forest.
SMALL_GROUP = 16
_ODD = np.uint64(0x5555555555555555)  # the lower bit of each segment


def fingerprint(text: str, shingle: int) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    parts = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    h = np.array([digest(b" ".join(p), SEED) for p in parts], dtype="<u8")
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65_536):
        set_bits += np.unpackbits(h[at:at + 65_536].view(np.uint8).reshape(-1, 8), axis=1,
                                  bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, keep: list[str]) -> DataFrame:
    """The columns `keep` (longs) and `fp`, the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            fp = np.array([fingerprint(x or "", shingle) for x in batch.column("text").to_pylist()],
                          dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fp.view(np.int64))],
                                             names=[*keep, "fp"])

    schema = ", ".join(f"{c} long" for c in [*keep, "fp"])
    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def embed(fp: np.ndarray) -> np.ndarray:
    """Per segment of two bits its number of set bits, in unary."""
    either = (fp | (fp >> np.uint64(1))) & _ODD
    both = (fp & (fp >> np.uint64(1))) & _ODD
    return either | (both << np.uint64(1))


def cell_masks(bits: int) -> list[int]:
    """Masks over the embedding: all choices of 3 of bits + 3 blocks of segments."""
    blocks = np.array_split(np.arange(32), bits + 3)
    masks = [sum(3 << (2 * int(s)) for s in block) for block in blocks]
    return [sum(choice) for choice in itertools.combinations(masks, 3)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def cells(distinct: DataFrame, bits: int) -> DataFrame:
    """(cell, fp) for each cell of each fingerprint. Cells are named by a hash;
    should two share a name, their rows only meet in vain."""
    masks = cell_masks(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().astype(np.int64)
            code = embed(fp.view(np.uint64))
            names = [_mixed(_mixed(code & np.uint64(m)) + np.uint64(i)).view(np.int64)
                     for i, m in enumerate(masks)]
            yield pa.RecordBatch.from_pydict({"cell": np.concatenate(names), "fp": np.tile(fp, len(masks))})

    return distinct.select("fp").mapInArrow(run, "cell long, fp long")


def _forest(fp: np.ndarray, code: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that join what is connected among the fingerprints, no more."""
    label, edges = np.arange(len(fp)), []
    for i in range(len(fp) - 1):
        near = np.flatnonzero(np.bitwise_count(code[i + 1:] ^ code[i]) <= bits) + i + 1
        near = near[np.bitwise_count(fp[near] ^ fp[i]) <= bits]
        near = near[label[near] != label[i]]
        while len(near):
            edges.append((i, int(near[0])))
            label[label == label[near[0]]] = label[i]
            near = near[label[near] != label[i]]
    return edges


def links(distinct: DataFrame, bits: int) -> DataFrame:
    """Pairs (a, b), a < b, of different fingerprints at most `bits` apart; with the
    pairs left out that others join already."""
    sizes = cells(distinct, bits).groupBy("cell").agg(F.count("*").alias("n"))
    large = stored(sizes.where(F.col("n") > CELL_ROWS)
                   .select("cell", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("chunks")), "large-cells")
    rows = cells(distinct, bits).join(large, "cell", "left")
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    other = F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(None).cast("int")))
                      .otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = (rows.withColumn("chunk", chunk).withColumn("other", other)
            .select(F.when(F.col("other").isNull(), F.col("cell")).otherwise(
                F.xxhash64("cell", F.least("chunk", "other"), F.greatest("chunk", "other"))).alias("cell"), "fp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "cell"):
            cell = table.column("cell").to_numpy()
            fp = table.column("fp").to_numpy().view(np.uint64)
            code = embed(fp)
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            sizes = np.diff(np.r_[starts, len(cell)])
            small = np.repeat(sizes <= SMALL_GROUP, sizes)
            left, right = [], []
            for d in range(1, SMALL_GROUP):
                i = np.flatnonzero((cell[d:] == cell[:-d]) & small[:-d])
                if not len(i):
                    break
                i = i[np.bitwise_count(code[i] ^ code[i + d]) <= bits]
                i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= bits]
                left.append(fp[i])
                right.append(fp[i + d])
            for s, n in zip(starts[sizes > SMALL_GROUP], sizes[sizes > SMALL_GROUP]):
                edges = np.array(_forest(fp[s:s + n], code[s:s + n], bits), dtype=np.int64).reshape(-1, 2)
                left.append(fp[s + edges[:, 0]])
                right.append(fp[s + edges[:, 1]])
            a = np.concatenate([*left, np.empty(0, np.uint64)]).view(np.int64)
            b = np.concatenate([*right, np.empty(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return (rows.repartition("cell").sortWithinPartitions("cell")
            .mapInArrow(run, "a long, b long").where("a <> b").distinct())


def connected(pairs: DataFrame) -> DataFrame:
    """(node, root) of each node with a link: the smallest node it is connected to.

    Large-star links every greater neighbour of a node to the smallest node of its
    neighbourhood, small-star every smaller one; after a logarithmic number of rounds
    all nodes point to their root."""
    edges = stored(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        edges = stored(small.select("u", F.col("m").alias("v"))
                       .unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
                       .where("u <> v").distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def components(prints: DataFrame, bits: int) -> DataFrame:
    """(fp, root) for each distinct fingerprint of `prints`: root names its component."""
    distinct = stored(prints.groupBy("fp").agg(F.count("*").alias("n")), "fingerprints")
    roots = connected(links(distinct, bits))
    return stored(distinct.join(roots, distinct["fp"] == roots["node"], "left")
                  .select("fp", F.coalesce("root", "fp").alias("root")), "components")


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 3) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    prints = stored(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
                                 shingle, ["doc_id"]), "prints")
    of = components(prints, bits)
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    lowest = of.join(first, "fp").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = stored(of.join(lowest, "root").select("fp", "component_id"), "named-components")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, shingle: int = 3, bits: int = 3) -> DataFrame:
    """One document of each component, with all its columns: that of the smallest
    doc_id (null last), of repeated ones any."""
    row = "_simhash_row"
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    prints = stored(fingerprints(rows.select(F.col("doc_id").cast("long").alias("doc_id"), row, "text"),
                                 shingle, ["doc_id", row]), "prints")
    placed = prints.join(components(prints, bits), "fp")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", row)
    kept = placed.groupBy("root").agg(F.min(rank)[row].alias(row))
    # few documents go, so it is they that the texts are joined with
    gone = stored(prints.select(row).join(kept, row, "left_anti"), "gone")
    return rows.join(gone, row, "left_anti").drop(row)
