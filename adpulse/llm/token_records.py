"""Token-id output as length-delimited binary records.

A record file is a row of frames, each

    length   8 bytes, little-endian
    check    4 bytes, masked CRC-32C of the length
    payload  `length` bytes
    check    4 bytes, masked CRC-32C of the payload

the framing that common training loaders read. A payload holds one document:
8 bytes of doc_id (signed, little-endian), a flag byte (1: doc_id is null, 2: ids
are 4 bytes wide instead of 2), then the ids. Beside each record file lies an
index file with 16 bytes a record: offset and number of tokens (unsigned,
little-endian), so that a reader can fetch records in any order.

`write_records` deals documents out by ranges of doc_id, encodes them and writes a
file pair in each task. A task writes under names of its own attempt and returns
them as manifest rows; the manifest is stored, so files of lost attempts are never
read. `read_records` reads the files back and checks every frame.

Defined cases: null text is an empty one (only the end id); null doc_ids come
first; rows with the same doc_id follow each other ordered by text; an empty table
gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adpulse.llm.common import bpe, documents, in_slices, new_path, stored

MANIFEST = ("part int, seq int, path string, index_path string, n_records long, "
            "n_tokens long, n_bytes long")
#: A task starts another file beyond this many bytes.
FILE_BYTES = 256 << 20
#: Records that one reading task takes at a time.
BLOCK_RECORDS = 8192
_CASTAGNOLI = 0x82F63B78  # reversed polynomial of CRC-32C
_MASK_DELTA = 0xA282EAD8


def _tables() -> np.ndarray:
    """tables[k][b]: what byte b followed by k zero bytes adds to a register."""
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = np.where(first & 1, (first >> 1) ^ np.uint32(_CASTAGNOLI), first >> 1)
    tables = [first.astype(np.uint32)]
    for _ in range(3):
        tables.append(tables[0][tables[-1] & 255] ^ (tables[-1] >> 8))
    return np.array(tables, dtype=np.uint32)


_T = _tables()
_SHIFTS: dict[int, np.ndarray] = {}


def storage(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that Spark names, and the path there. Hadoop calls an
    object store s3a (or s3n) that Arrow calls s3."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def _feed(register: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = register ^ word
    return _T[3][x & 255] ^ _T[2][(x >> 8) & 255] ^ _T[1][(x >> 16) & 255] ^ _T[0][x >> 24]


def _shift(register: np.ndarray, chunk: int) -> np.ndarray:
    """The register after `chunk` zero bytes, by four tables (it is linear)."""
    if chunk not in _SHIFTS:
        t = (np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
        for _ in range(chunk // 4):
            t = _feed(t, np.uint32(0))
        _SHIFTS[chunk] = t
    t = _SHIFTS[chunk]
    return t[0][register & 255] ^ t[1][(register >> 8) & 255] ^ t[2][(register >> 16) & 255] ^ t[3][register >> 24]


def masked_crc32c(buffers: list[bytes], chunk: int = 512) -> np.ndarray:
    """Masked CRC-32C of each buffer (4 bytes at least), all buffers together.

    Zeros before a message leave a zero register alone, and a register of ones at
    the start is the same as the first four bytes inverted. So each buffer is
    padded in front to whole chunks, all chunks run in step, and the chunks of a
    buffer are joined by the shift of a chunk's zeros.
    """
    if not buffers:
        return np.empty(0, np.uint32)
    sizes = np.array([len(x) for x in buffers], dtype=np.int64)
    counts = -(-sizes // chunk)
    pads = counts * chunk - sizes
    data = np.frombuffer(b"".join(y for x, p in zip(buffers, pads) for y in (bytes(p), x)), np.uint8).copy()
    starts = np.concatenate([[0], np.cumsum(counts * chunk)[:-1]]) + pads
    data[(starts[:, None] + np.arange(4)).ravel()] ^= 255
    words = data.view("<u4").reshape(-1, chunk // 4)
    register = np.zeros(len(words), np.uint32)
    for k in range(words.shape[1]):
        register = _feed(register, words[:, k])
    order = np.argsort(-counts, kind="stable")
    first = (np.cumsum(counts) - counts)[order]
    joined = np.zeros(len(buffers), np.uint32)
    more = counts[order]
    for k in range(int(more[0])):
        n = int(np.searchsorted(-more, -k, "left"))  # buffers with more than k chunks
        joined[:n] = _shift(joined[:n], chunk) ^ register[first[:n] + k]
    crc = np.empty(len(buffers), np.uint32)
    crc[order] = joined ^ np.uint32(0xFFFFFFFF)
    return (((crc >> 15) | (crc << 17)) + np.uint32(_MASK_DELTA)).astype(np.uint32)


def frames(payloads: list[bytes]) -> list[bytes]:
    heads = [struct.pack("<Q", len(x)) for x in payloads]
    return [b"".join((h, int(a).to_bytes(4, "little"), x, int(b).to_bytes(4, "little")))
            for h, a, x, b in zip(heads, masked_crc32c(heads, 8), payloads, masked_crc32c(payloads))]


def payload(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    return struct.pack("<qB", doc_id or 0, (doc_id is None) + 2 * wide) \
        + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack(record: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flag = struct.unpack_from("<qB", record)
    ids = np.frombuffer(record, "<u4" if flag & 2 else "<u2", offset=9).astype("<u4")
    return None if flag & 1 else doc_id, ids


def write_records(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes all documents as records in ascending doc_id order; returns the
    stored manifest, one row a file, whose (part, seq) follow that order."""
    spark = docs.sparkSession
    folder = new_path(spark, "records")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, base = storage(folder)
        cache, part, seq = bpe(tokenizer), task.partitionId(), 0
        out = index = None
        n_records = n_tokens = n_bytes = 0
        names: tuple[str, str] = ("", "")

        def close():
            out.close()
            index.close()
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
                "path": [names[0]], "index_path": [names[1]],
                "n_records": [n_records], "n_tokens": [n_tokens], "n_bytes": [n_bytes]})

        for batch in in_slices(batches):
            if out is None:
                store.create_dir(base, recursive=True)
                stem = f"{part:06d}-{seq:04d}-{task.taskAttemptId()}"
                names = (f"{folder}/{stem}.rec", f"{folder}/{stem}.idx")
                out = store.open_output_stream(f"{base}/{stem}.rec")
                index = store.open_output_stream(f"{base}/{stem}.idx")
                n_records = n_tokens = n_bytes = 0
            tail = end_id.to_bytes(4, "little")
            ids = [np.frombuffer(x + tail, "<u4") for x in cache.ids(batch.column("text").to_pylist())]
            framed = frames([payload(d, x) for d, x in zip(batch.column("doc_id").to_pylist(), ids)])
            entry = np.empty((len(framed), 2), "<u8")
            sizes = np.array([len(x) for x in framed], dtype=np.uint64)
            entry[:, 0] = n_bytes + np.cumsum(sizes) - sizes
            entry[:, 1] = [len(x) for x in ids]
            out.write(b"".join(framed))
            index.write(entry.tobytes())
            n_records += len(framed)
            n_tokens += int(entry[:, 1].sum())
            n_bytes += int(sizes.sum())
            if n_bytes >= FILE_BYTES:
                yield close()
                out, seq = None, seq + 1
        if out is not None:
            yield close()

    text_hash = F.xxhash64("text")
    ordered = (documents(docs).repartitionByRange("doc_id", text_hash)
               .sortWithinPartitions("doc_id", text_hash, "text"))
    return stored(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_records(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per record of the manifest's files: doc_id, start (ids of all records
    before it), n_tokens, ids_crc32 (of the ids as unsigned 32-bit integers), and the
    ids if asked for. A frame whose checks fail ends the task with an error."""
    # one row a file, so this window stays small: 800,000 rows for 100 TB of text
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    total = manifest.agg(F.count("*").alias("n"), F.sum("n_records").alias("r")).first()
    blocks = files.withColumn("first", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("n_records") - 1, F.lit(BLOCK_RECORDS).cast("long"))))
    # few small rows that stand for much reading: dealt out evenly, one block a task
    tasks = max(1, min(100_000, (total["r"] or 0) // BLOCK_RECORDS + total["n"]))
    blocks = blocks.repartitionByRange(int(tasks), "part", "seq", "first")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = storage(row["path"])
                index_path = storage(row["index_path"])[1]
                with store.open_input_file(index_path) as f:
                    entry = np.frombuffer(f.read(), "<u8").reshape(-1, 2).astype(np.int64)
                first, last = row["first"], min(row["first"] + BLOCK_RECORDS, row["n_records"])
                ends = np.append(entry[:, 0], row["n_bytes"])
                starts = row["before"] + np.cumsum(entry[:, 1]) - entry[:, 1]
                with store.open_input_file(path) as f:
                    for at in range(first, last, 1024):
                        to = min(at + 1024, last)
                        data = f.read_at(int(ends[to] - ends[at]), int(ends[at]))
                        yield _records(data, ends[at:to + 1] - ends[at], starts[at:to], row["path"], with_ids)

    return blocks.mapInArrow(read, schema)


def _records(data: bytes, ends: np.ndarray, starts: np.ndarray, path: str, with_ids: bool) -> pa.RecordBatch:
    raw = [data[a:b] for a, b in zip(ends, ends[1:])]
    heads, bodies = [x[:8] for x in raw], [x[12:-4] for x in raw]
    said = np.array([[int.from_bytes(x[8:12], "little"), int.from_bytes(x[-4:], "little")] for x in raw], np.uint32)
    if any(int.from_bytes(h, "little") != len(x) for h, x in zip(heads, bodies)) \
            or (masked_crc32c(heads, 8) != said[:, 0]).any() or (masked_crc32c(bodies) != said[:, 1]).any():
        raise ValueError(f"a record of {path} fails its check")
    got = [unpack(x) for x in bodies]
    columns = {"doc_id": pa.array([d for d, _ in got], pa.int64()), "start": pa.array(starts, pa.int64()),
               "n_tokens": pa.array([len(x) for _, x in got], pa.int64()),
               "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for _, x in got], pa.int64())}
    if with_ids:
        columns["ids"] = pa.array([x.tolist() for _, x in got], pa.list_(pa.int64()))
    return pa.RecordBatch.from_pydict(columns)
