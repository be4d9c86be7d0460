"""Benchmark decontamination by winnowing.

Of each 6 consecutive 5-grams of words the one with the smallest hash is kept (the
rightmost of equal ones). Two texts that share 10 words or more share all 5-grams of
some such window and so keep the same one at the same place: every shared span of 10
words has a common fingerprint. Document and benchmark fingerprints are joined on the
hash, and each hit is extended: the 6 windows of 10 words around the two 5-grams are
compared word by word. Items of fewer than 10 words are one window of n words; for
them k is n and the winnowing window 1, so all n-grams are kept.

Documents are winnowed in one pass. A bit filter of fixed size over the benchmark's
fingerprints lets only possible matches leave that pass, with the words around them,
so texts are never shuffled. What is found hangs on the text's content: copies meet in
one row before they are shuffled, and it is joined to the documents by the content's
hash.

Defined cases: null or empty texts have no words and no hits; items without words are
ignored; an item without id makes words hit, but is not counted or named; repeated
items count once; an empty benchmark leaves every document clean; repeated documents
are rated each; other columns are ignored (operator) or kept (`clean`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adpulse.llm.common import (BitFilter, documents, gram_hashes, in_slices, lower_words, stored,
                                text_key, word_hashes)

FILTER_BITS = 26  # 8 MB
CANDIDATES = "array<struct<fp long, first int, n int, context array<string>>>"


def schemes(n_words: int, window: int, k: int) -> tuple[int, int, int]:
    """(words of a window, k, winnowing window) for an item of so many words."""
    t = min(n_words, window)
    return (t, k, t - k + 1) if t == window else (t, t, 1)


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions of the rightmost minimum of each w consecutive hashes."""
    if len(grams) < w:
        return np.empty(0, dtype=np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, w)[:, ::-1]
    return np.unique(np.arange(len(views)) + w - 1 - views.argmin(axis=1))


def fingerprints(hashes: np.ndarray, t: int, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept positions and their hashes, told apart by t."""
    grams = gram_hashes(hashes, k)
    at = winnow(grams, w)
    return at, grams[at] ^ np.uint64(t * 0x9E3779B97F4A7C15 % 2**64)


def context(words: list[bytes], at: int, t: int, w: int) -> list[str]:
    """The words of all windows of t words that hold the gram at `at`; "" outside."""
    first, end = at - (w - 1), at + t
    own = [x.decode() for x in words[max(0, first):end]]
    return [""] * max(0, -first) + own + [""] * (end - max(len(words), max(0, first)))


def item_fingerprints(items: DataFrame, window: int, k: int) -> DataFrame:
    """Per fingerprint and context the ids of the items that have it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            rows = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                if words := lower_words(text):
                    t, k_, w = schemes(len(words), window, k)
                    for at, fp in zip(*fingerprints(word_hashes(words), t, k_, w)):
                        rows.append((int(fp.astype(np.int64)), t, context(words, int(at), t, w), item))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in
                 enumerate((pa.int64(), pa.int32(), pa.list_(pa.string()), pa.string()))],
                names=["fp", "n", "item_context", "item"])

    texts = items.select(F.col("item_id").cast("string").alias("item_id"),
                         F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return (texts.mapInArrow(run, "fp long, n int, item_context array<string>, item string")
            .groupBy("fp", "n", "item_context").agg(F.collect_set("item").alias("items")))


def candidates(docs: DataFrame, lengths: list[int], window: int, k: int, passes) -> DataFrame:
    """Per document its key, its number of words and the fingerprints that the
    filter lets through, with the words around them."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(passes)
    struct = pa.list_(pa.struct([("fp", pa.int64()), ("first", pa.int32()), ("n", pa.int32()),
                                 ("context", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = sent.value
        for batch in in_slices(batches):
            keys, counts, found = [], [], []
            for text in batch.column("text").to_pylist():
                words = lower_words(text)
                hashes, own = word_hashes(words), []
                for length in lengths:
                    t, k_, w = schemes(length, window, k)
                    at, fp = fingerprints(hashes, t, k_, w)
                    for i in np.flatnonzero(test(fp)):
                        own.append({"fp": int(fp[i].astype(np.int64)), "first": int(at[i]) - (w - 1), "n": t,
                                    "context": context(words, int(at[i]), t, w)})
                keys.append(hashlib.md5(text.encode()).digest())
                counts.append(len(words))
                found.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()),
                 pa.array(found, struct)], names=["doc_id", "key", "n_words", "candidates"])

    return documents(docs).mapInArrow(run, f"doc_id long, key binary, n_words long, candidates {CANDIDATES}")


def spans(found: DataFrame, items: DataFrame, window: int, k: int) -> DataFrame:
    """(key, first, n, items): the places of item windows in each distinct text."""
    rows = found.select("key", F.explode("candidates").alias("c")).select("key", "c.*").distinct()
    w = F.when(F.col("n") == window, window - k + 1).otherwise(1)
    same = F.filter(F.sequence(F.lit(0), w - 1),
                    lambda s: (F.slice("context", s + 1, F.col("n")) == F.slice("item_context", s + 1, F.col("n")))
                    & ~F.array_contains(F.slice("context", s + 1, F.col("n")), ""))
    return (rows.join(items, ["fp", "n"]).withColumn("s", F.explode(same))
            .select("key", (F.col("first") + F.col("s")).alias("first"), "n", "items").distinct())


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """All documents (doc_id, key, n_words), and of each distinct contaminated text
    (key, n_hit, items): its hit words and the sorted ids of the items found in it."""
    items = stored(item_fingerprints(benchmark, window, k), "item-fingerprints")
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())  # `window` of them at most
    passes = BitFilter(items, "fp", FILTER_BITS)
    found = stored(candidates(docs, lengths, window, k, passes), "candidates")
    places = stored(spans(found, items, window, k), "spans")
    covered = places.select("key", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("at"))
    n_hit = covered.distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    named = places.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return found.select("doc_id", "key", "n_words"), stored(n_hit.join(named, "key"), "contaminated")


def rate(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids as strings, sorted) of every document."""
    every, hit = contamination(docs, benchmark, window, k)
    return every.join(hit, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """The documents without a hit, with all their columns."""
    hit = contamination(docs, benchmark, window, k)[1].select(F.col("key").alias("_winnowing_key"))
    return docs.join(hit, text_key() == F.col("_winnowing_key"), "left_anti")
