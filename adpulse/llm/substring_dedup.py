"""Removal of repeated passages by super-k-mer partitioning.

A window is `window` consecutive words of a text. Its minimiser is the smallest hash of its
`minimiser`-word grams (the leftmost of equal ones). Consecutive windows with the same
minimiser travel as one string, a super-k-mer, to the bucket of that minimiser, where all
windows equal to any of them arrive as well: equal windows have the same minimiser at the
same place. In a bucket the windows are sorted and equal ones counted. Words covered by a
window that occurs twice or more are removed.

A window can only repeat if its minimiser does. So a first pass counts minimisers, and a
bit filter of fixed size over the repeated ones keeps most unique text from travelling. A
task sends equal super-k-mers once, with their number. A minimiser that occurs very often,
as in large groups of copies or a very common passage, would fill one bucket: its windows
travel singly instead, each to the bucket of its own hash.

What is removed from a text depends on its words only, so it is joined to the documents by
the text's hash, once for all copies.

Defined cases: null and empty texts have no words; a text shorter than a window keeps all;
repeated rows repeat each other's windows and lose them all; an empty table gives no rows;
other columns are ignored (operator) or kept (`without_repeats`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adpulse.llm.common import (BitFilter, documents, gram_hashes, in_slices, stored, text_key,
                                whole_groups, word_hashes)

FILTER_BITS = 28  # 32 MB
#: Minimisers of more super-k-mers than this are dealt out by window. They are known by a
#: bit filter of fixed size (2 MB); one that it takes for such by mistake is dealt out as well,
#: which changes no result.
HOT_LEAST, HOT_BITS = 2_000, 24
#: Bytes of super-k-mers a task gathers before it hands them on.
GATHER_BYTES = 32 << 20


def runs(words: list[bytes], window: int, minimiser: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each super-k-mer its first window, its number of windows and its minimiser."""
    n = len(words) - window + 1
    if n < 1:
        none = np.empty(0, np.int64)
        return none, none, none.astype(np.uint64)
    grams = gram_hashes(word_hashes(words), minimiser)
    width = window - minimiser + 1
    at = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1) + np.arange(n)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return first, np.diff(np.r_[first, n]), grams[at[first]]


def count_minimisers(texts: DataFrame, window: int, minimiser: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out():
            fp, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_pydict({"fp": fp.view(np.int64), "n": n.astype(np.int64)})

        for batch in in_slices(batches):
            for text in batch.column("text").to_pylist():
                held.append(runs(text.encode().split(), window, minimiser)[2])
            if sum(map(len, held)) > 1_000_000:
                yield out()
                held.clear()
        if held:
            yield out()

    return texts.mapInArrow(run, "fp long, n long").groupBy("fp").agg(F.sum("n").alias("n"))


SENT = "kind int, key binary, first int, digest binary, bucket long, packed binary, n long"
PLACE, SUPER_KMER = 0, 1


def super_kmers(texts: DataFrame, window: int, minimiser: int, repeated: BitFilter, hot: np.ndarray) -> DataFrame:
    """Two kinds of rows: the places of super-k-mers in each text, and the
    super-k-mers with their bucket and their number."""
    sent = texts.sparkSession.sparkContext.broadcast((repeated, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes, hot_ones = sent.value
        gathered: dict[bytes, list] = {}
        held, seen = 0, set()

        def out(kind: int, rows: list[tuple]) -> pa.RecordBatch:
            """rows: key, first, digest, bucket, packed, n"""
            kinds = [pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.int64()]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.int32()), *columns],
                                              names=["kind", "key", "first", "digest", "bucket", "packed", "n"])

        def flush() -> pa.RecordBatch:
            rows = [(None, None, d, b, p, n) for d, (b, p, n) in gathered.items()]
            gathered.clear()
            return out(SUPER_KMER, rows)

        for batch in in_slices(batches):
            places = []
            for text in batch.column("text").to_pylist():
                words = text.encode().split()
                first, count, fp = runs(words, window, minimiser)
                sure = passes(fp)
                if not sure.any():
                    continue
                key = hashlib.md5(text.encode()).digest()
                new = key not in seen
                seen.add(key)
                single = hot_ones(fp)
                for f, n, h, alone in zip(first[sure].tolist(), count[sure].tolist(), fp[sure], single[sure]):
                    parts = [(i, 1) for i in range(f, f + n)] if alone else [(f, n)]
                    for i, m in parts:
                        packed = b" ".join(words[i:i + m + window - 1])
                        digest = xxhash.xxh3_128_digest(packed)
                        if new:
                            places.append((key, i, digest, None, None, None))
                        if (entry := gathered.get(digest)) is not None:
                            entry[2] += 1
                        else:
                            bucket = int.from_bytes(digest[:8], "little", signed=True) if alone \
                                else int(h.astype(np.int64))
                            gathered[digest] = [bucket, packed, 1]
                            held += len(packed)
            if places:
                yield out(PLACE, places)
            if held > GATHER_BYTES:
                yield flush()
                held = 0
        if gathered:
            yield flush()

    return texts.mapInArrow(run, SENT)


def repeats_of(rows: list[tuple[int, bytes, bytes, int]], window: int) -> list[tuple[bytes, bytes]]:
    """(digest, flags) of the super-k-mers with a repeated window; a flag (0 or 1) for
    each of their windows. rows: bucket, digest, packed, n; all of their buckets."""
    number: dict[bytes, int] = {}
    packed: dict[bytes, bytes] = {}
    in_bucket: dict[int, list[bytes]] = {}
    for bucket, digest, text, n in rows:
        if digest not in number:
            in_bucket.setdefault(bucket, []).append(digest)
            packed[digest] = text
        number[digest] = number.get(digest, 0) + n
    out = []
    for digests in in_bucket.values():
        if len(digests) == 1:  # its windows differ, as they hold the minimiser at different places
            if number[digests[0]] > 1:
                out.append((digests[0], b"\1" * (packed[digests[0]].count(b" ") + 2 - window)))
            continue
        windows = []
        for d in digests:
            words = packed[d].split(b" ")
            windows += [(b" ".join(words[i:i + window]), d, i) for i in range(len(words) - window + 1)]
        windows.sort()
        flags = {d: bytearray(packed[d].count(b" ") + 2 - window) for d in digests}
        at = 0
        while at < len(windows):
            end = at + 1
            while end < len(windows) and windows[end][0] == windows[at][0]:
                end += 1
            if sum(number[d] for _, d, _ in windows[at:end]) > 1:
                for _, d, i in windows[at:end]:
                    flags[d][i] = 1
            at = end
        out += [(d, bytes(f)) for d, f in flags.items() if any(f)]
    return out


def repeated_windows(sent: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "bucket"):
            found = repeats_of(list(zip(*(table.column(c).to_pylist() for c in ("bucket", "digest", "packed", "n")))), window)
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.binary()),
                                              pa.array([f for _, f in found], pa.binary())], names=["digest", "flags"])

    rows = sent.where(F.col("kind") == SUPER_KMER).select("bucket", "digest", "packed", "n")
    return (rows.repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(run, "digest binary, flags binary"))


def repeats(docs: DataFrame, window: int = 35, minimiser: int = 12) -> DataFrame:
    """(key, found) of each distinct text with repeated windows; found lists
    (first window, flags)."""
    texts = documents(docs).select("text")
    counts = stored(count_minimisers(texts, window, minimiser), "minimisers")
    repeated = BitFilter(counts.where("n > 1"), "fp", FILTER_BITS)
    hot = BitFilter(counts.where(F.col("n") > HOT_LEAST), "fp", HOT_BITS)
    sent = stored(super_kmers(texts, window, minimiser, repeated, hot), "super-kmers", "kind")
    flags = stored(repeated_windows(sent, window), "repeated-windows")
    places = sent.where(F.col("kind") == PLACE).select("key", "first", "digest")
    return stored(places.join(flags, "digest").groupBy("key")
                  .agg(F.collect_set(F.struct("first", "flags")).alias("found")), "repeats")


def kept_words(text: str, found: list[dict] | None, window: int) -> tuple[int, int, bytes]:
    """Number of words, of removed words, and the others joined by a space."""
    words = text.encode().split()
    if not found:
        return len(words), 0, b" ".join(words)
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    for x in found:
        at = np.flatnonzero(np.frombuffer(x["flags"], np.uint8)) + x["first"]
        starts[at] = 1
    ends = np.zeros_like(starts)
    ends[window:] = starts[:-window]
    gone = np.cumsum(starts - ends)[:-1] > 0
    return len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


def _with_repeats(docs: DataFrame, window: int, minimiser: int) -> DataFrame:
    found = repeats(docs, window, minimiser)
    return (documents(docs).withColumn("key", text_key()).join(found, "key", "left")
            .select("doc_id", "text", "found"))


def without_repeats(docs: DataFrame, window: int = 35, minimiser: int = 12) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words (text) of every document."""
    return _finished(_with_repeats(docs, window, minimiser), window, "text string", lambda x: x.decode())


def digests(docs: DataFrame, window: int = 35, minimiser: int = 12) -> DataFrame:
    """As `without_repeats`, with the kept words' SHA-256 in place of the words."""
    return _finished(_with_repeats(docs, window, minimiser), window, "kept_sha256 string",
                     lambda x: hashlib.sha256(x).hexdigest())


def _finished(rows: DataFrame, window: int, column: str, of) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            done = [kept_words(t, f, window) for t, f in
                    zip(batch.column("text").to_pylist(), batch.column("found").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([n for n, _, _ in done], pa.int64()),
                 pa.array([n for _, n, _ in done], pa.int64()), pa.array([of(x) for _, _, x in done], pa.string())],
                names=["doc_id", "n_words", "n_removed", column.split()[0]])

    return rows.mapInArrow(run, f"doc_id long, n_words long, n_removed long, {column}")
