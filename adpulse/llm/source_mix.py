"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's words lie in one line, document after document in an order of hashes, and are
cut into blocks of equal size. A target in words gives a source its quota of block draws:
whole passes over its blocks, and of one more pass as many blocks, in a permuted
order, as the rest needs; the last one is cut, so that the words taken are the target,
rounded.

The quotas of all sources are dealt to the output shards by a binary tree. A node
holds a vector of quotas and a range of shards; its left half gets a fixed number of draws,
whose sources are drawn without replacement from the node's (multivariate
hypergeometric, one source after the other), and the right half gets the rest. So each
shard gets its exact share of draws, all quotas come out exactly, and what a shard gets is
distributed as if all draws had been shuffled. A node's random numbers depend on its
place alone: any worker can walk from the root to a leaf by itself, and adding up what
goes left on the way gives the leaf its first draw of each source.

A source's draws are numbered; the draw's number gives pass and block by a permutation
that is computed, not stored (a Feistel network on the numbers below a power of four,
walked until it falls among the blocks). So shards draw disjoint blocks without knowing of
each other. Blocks meet their documents' pieces in one join by block, and each shard
orders its own draws by a hash.

Bounds: the driver holds one row a source, MOST_SOURCES at most (more is an error: weights
belong to sources that someone named), and a task's path in the tree has as many numbers
a level. All else is spread by blocks, shards or buckets of documents, never by source, so
a source that holds a third of all rows is like any other. Reruns on the same rows
give the same mix, whatever the partitions.

Defined cases: a null or empty text has size 0, lies in no block and is never taken; null
is a source like others, behind them; equal rows are taken each by itself; doc_ids may be
null or repeat; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adpulse.llm.common import stored, text_key

#: Words of a block.
BLOCK = 256
#: Most times a source or document is taken.
MOST_TIMES = 3
MOST_SOURCES = 10_000
#: Documents of a bucket, by which a source's line is added up.
BUCKET_ROWS = 5_000
#: Draws that a task hands on at a time.
BATCH = 1 << 16
_WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: Sequence[int], weights: Sequence[int], most: int = MOST_TIMES) -> list[Fraction]:
    """Shares of the sum of sizes by weight, none above `most` times its size; what is
    above goes to the others by weight, until none is."""
    out = [Fraction(0)] * len(sizes)
    left, open_ = Fraction(sum(sizes)), [i for i, s in enumerate(sizes) if s]
    while open_:
        each = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if each * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = each * weights[i]
            break
        for i in full:
            out[i] = Fraction(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def permuted(numbers: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """Where a permutation of 0 .. n - 1, chosen by `key`, takes the numbers (or which
    numbers it takes there)."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = [np.uint64(xxhash.xxh3_64_intdigest(b"%d %d" % (key, r))) for r in range(6)]
    out = np.array(numbers, dtype=np.uint64)
    todo = np.arange(len(out))
    while len(todo):  # below four times as many numbers as wanted, so four turns on average at most
        left, right = out[todo] >> half, out[todo] & mask
        for k in reversed(keys) if back else keys:
            if back:
                left, right = right ^ (_mixed(left ^ k) & mask), left
            else:
                left, right = right, left ^ (_mixed(right ^ k) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def hypergeometric(u: float, good: int, bad: int, draws: int) -> int:
    """How many of `draws` draws without replacement are good: the number at which the
    distribution function passes u. Summed over 12 standard deviations about the mode;
    what lies beyond weighs less than double precision can show."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    spread = math.sqrt(draws * (good / total) * (bad / total) * ((total - draws) / max(1, total - 1)))
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    reach = int(12 * spread) + 16
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=np.float64)  # from k to k + 1
    step = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(step)])
    sums = np.cumsum(np.exp(logs - logs.max()))
    return low + min(int(np.searchsorted(sums, u * sums[-1], "right")), high - low)


def _uniform(*parts: int) -> float:
    return (xxhash.xxh3_64_intdigest(" ".join(map(str, parts)).encode()) >> 11) / (1 << 53)


class SplittingTree:
    """Deals quotas to shards; every node can be worked out anywhere."""

    def __init__(self, quotas: Sequence[int], n_shards: int, seed: int):
        self.quotas, self.n_shards, self.seed, self.total = list(quotas), n_shards, seed, sum(quotas)
        self.known: dict[tuple[int, int], list[int]] = {}

    def draws_before(self, shard: int) -> int:
        return shard * self.total // self.n_shards

    def _left(self, low: int, middle: int, quotas: list[int]) -> list[int]:
        """What goes to the shards from low to middle, of a node's quotas."""
        left = self.known.get((low, middle))
        if left is None:
            if len(self.known) > 1000:
                self.known.clear()
            left, draws, rest = [], self.draws_before(middle) - self.draws_before(low), sum(quotas)
            for i, good in enumerate(quotas):
                rest -= good
                left.append(hypergeometric(_uniform(self.seed, low, middle, i), good, rest, draws))
                draws -= left[-1]
            self.known[low, middle] = left
        return left

    def leaf(self, shard: int) -> tuple[list[int], list[int]]:
        """Per source the shard's first draw and its number of draws."""
        low, high, first, quotas = 0, self.n_shards, [0] * len(self.quotas), self.quotas
        while high - low > 1:
            middle = (low + high) // 2
            left = self._left(low, middle, quotas)
            if shard < middle:
                high, quotas = middle, left
            else:
                low = middle
                first = [a + b for a, b in zip(first, left)]
                quotas = [a - b for a, b in zip(quotas, left)]
        return first, quotas


@dataclass(frozen=True)
class Source:
    """What the mix takes of a source."""
    index: int
    key: str
    size: int
    target: Fraction
    n_blocks: int
    n_draws: int
    cut: int  # words that the last draw leaves out
    seed: int

    def pass_key(self, turn: int) -> int:
        return xxhash.xxh3_64_intdigest(f"{self.seed} {self.index} {turn}".encode())

    def blocks(self, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pass and block of each of its draws, which are in ascending order."""
        turns, block = draws // self.n_blocks, np.empty(len(draws), dtype=np.int64)
        for turn in np.unique(turns).tolist():
            own = turns == turn
            block[own] = permuted(draws[own] % self.n_blocks, self.n_blocks, self.pass_key(turn))
        return turns, block


def source(index: int, key: str, size: int, target: Fraction, block: int, seed: int) -> Source:
    """The draws that come to the target, rounded: whole passes, then blocks until
    the rest is reached. The last block of a source's line may be short."""
    words, n_blocks = math.floor(target + Fraction(1, 2)), -(-size // block)
    if not words:
        return Source(index, key, size, target, n_blocks, 0, 0, seed)
    turns, rest = divmod(words, size)
    draws, cut = turns * n_blocks, 0
    if rest:
        key_of = Source(index, key, size, target, n_blocks, 0, 0, seed).pass_key(turns)
        short_at = int(permuted(np.array([n_blocks - 1]), n_blocks, key_of, back=True)[0])
        lacking, n = n_blocks * block - size, -(-rest // block)
        if short_at < n and n * block - lacking < rest:
            n += 1
        cut = n * block - (lacking if short_at < n else 0) - rest
        draws += n
    return Source(index, key, size, target, n_blocks, draws, cut, seed)


class Mix:
    """The mix of a table: `lines` (its documents with their places in their sources'
    lines, without texts), `sources` and the splitting tree."""

    def __init__(self, docs: DataFrame, weights: Sequence[int] = (1, 2, 3), n_shards: int = 40,
                 block: int = BLOCK, most_times: int = MOST_TIMES, seed: int = 11, source_column: str = "source"):
        self.spark, self.block, self.n_shards, self.seed = docs.sparkSession, block, n_shards, seed
        text, name = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col(source_column).cast("string")
        rows = stored(docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), name.alias("source"),
            # sorts like the names, null last
            F.coalesce(F.concat(F.lit("0"), name), F.lit("1")).alias("source_key"),
            F.regexp_count(text, F.lit(_WORD)).cast("long").alias("size"),
            text_key().alias("text_key")).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_key")), "mix-rows")
        n_buckets = 1 + rows.count() // BUCKET_ROWS
        by = ["source_key", "bucket"]
        rows = rows.withColumn("bucket", F.pmod(F.col("h"), F.lit(n_buckets)))
        buckets = stored(rows.groupBy(*by).agg(F.sum("size").alias("words")), "mix-buckets")
        found = buckets.groupBy("source_key").agg(F.sum("words").alias("words")).limit(MOST_SOURCES + 1).collect()
        if len(found) > MOST_SOURCES:
            raise ValueError(f"a mix has {MOST_SOURCES} sources at most")
        # Python sorts strings by code point
        sizes = sorted((r["source_key"], r["words"]) for r in found)
        aims = targets([n for _, n in sizes], [weights[i % len(weights)] for i in range(len(sizes))], most_times)
        self.sources = [source(i, key, n, aim, block, seed) for i, ((key, n), aim) in enumerate(zip(sizes, aims))]
        self.tree = SplittingTree([s.n_draws for s in self.sources], n_shards, seed)
        before = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = buckets.select(*by, F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
        # equal rows may change places: they are equal
        inside = Window.partitionBy(*by).orderBy("h", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
        index = self.spark.createDataFrame(  # one row a source, MOST_SOURCES at most
            [(s.key, s.index, s.size, float(s.target)) for s in self.sources],
            "source_key string, source_index int, source_size long, target double")
        placed = rows.join(starts, by).withColumn(
            "line_start", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        self.lines = stored(placed.join(F.broadcast(index), "source_key").select(
            "doc_id", "source", "source_index", "size", "source_size", "target", "line_start", "h"), "mix-lines")

    def draws(self) -> DataFrame:
        """Every draw of every shard: shard, source_index, draw, turn (the pass over the
        source), block, and the words of the block that it leaves out at the end."""
        tree, sources = self.tree, self.sources

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard in batch.column(0).to_pylist():
                    for own, first, n in zip(sources, *tree.leaf(shard)):
                        for at in range(first, first + n, BATCH):
                            draws = np.arange(at, min(at + BATCH, first + n), dtype=np.int64)
                            turns, blocks = own.blocks(draws)
                            cut = np.where(draws == own.n_draws - 1, own.cut, 0)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(draws), shard), pa.int32()),
                                 pa.array(np.full(len(draws), own.index), pa.int32()),
                                 *[pa.array(x, pa.int64()) for x in (draws, turns, blocks, cut)]],
                                names=["shard", "source_index", "draw", "turn", "block", "cut"])

        shards = self.spark.range(0, self.n_shards, 1, min(self.n_shards, 10_000))
        return shards.mapInArrow(deal, "shard int, source_index int, draw long, turn long, block long, cut long")

    def pieces(self) -> DataFrame:
        """The mix: per piece of a document in a drawn block its shard, draw, turn, block,
        the document's place (source_index, line_start), doc_id, first word there and
        number of words, and its offset in the block."""
        # a block's words from x to y; in a short last block the cut counts from its end
        size = F.lit(self.block).cast("long")
        spans = (self.lines.where("size > 0")
                 .withColumn("block", F.explode(F.sequence(
                     F.floor(F.col("line_start") / size).cast("long"),
                     F.floor((F.col("line_start") + F.col("size") - 1) / size).cast("long"))))
                 .withColumn("from", F.greatest(F.col("block") * size, F.col("line_start")))
                 .withColumn("to", F.least((F.col("block") + 1) * size, F.col("line_start") + F.col("size")))
                 .withColumn("block_end", F.least((F.col("block") + 1) * size, F.col("source_size"))))
        to = F.least(F.col("to"), F.col("block_end") - F.col("cut"))
        # both sides grow with the mix, though the plan can't see it of the draws
        return (self.draws().hint("merge").join(spans, ["source_index", "block"]).where(to > F.col("from"))
                .select("shard", "source_index", "draw", "turn", "block", "line_start", "doc_id",
                        (F.col("from") - F.col("line_start")).alias("first_word"),
                        (to - F.col("from")).alias("n_words"),
                        (F.col("from") - F.col("block") * size).alias("offset")))

    def shuffled(self) -> DataFrame:
        """The pieces with their position in their shard, draws in an order of hashes."""
        order = F.xxhash64(F.lit(self.seed + 1), "shard", "source_index", "draw")
        local = Window.partitionBy("shard").orderBy("_order", "source_index", "draw", "offset")
        return (self.pieces().withColumn("_order", order)
                .withColumn("position", F.row_number().over(local).cast("long")).drop("_order"))

    def taken(self) -> DataFrame:
        """Per document its size, its source's size and target, and the words that the
        mix takes of it."""
        # a document with words is named by its place; documents without share theirs, and
        # any name without a partner will do
        place = F.when(F.col("size") > 0, F.col("line_start")).otherwise(-1 - F.pmod(F.col("h"), F.lit(1 << 20)))
        words = (self.pieces().groupBy("source_index", F.col("line_start").alias("place"))
                 .agg(F.sum("n_words").alias("taken")))
        return (self.lines.withColumn("place", place).join(words, ["source_index", "place"], "left")
                .select("doc_id", "source", "size", "source_size", "target",
                        F.coalesce("taken", F.lit(0).cast("long")).alias("taken")))
