"""What the corpus operators share: intermediate tables in the shared folder,
cached tokenisation of whole texts, and streaming over sorted groups."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import sys
import tempfile
import uuid
import zipfile
from array import array
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of text that a task handles at a time, one text at least (bounds
#: what it holds beside the batch).
SLICE = 2000
SLICE_BYTES = 2 << 20
#: Bytes of an Arrow batch, where the session leaves Spark's default.
BATCH_BYTES = 4 << 20
#: Known pieces (some 40 bytes each) after which a worker's cache starts anew; the
#: last one is still looked into. Pieces of more than CACHED_PIECE bytes are not kept.
CACHED = 600_000
CACHED_PIECE = 64
#: Characters of one text that are encoded at a time.
STRETCH = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    It is only made up where it is unset and the master is local (tests); on a
    cluster a missing setting is an error, as a machine-local folder would
    lose rows there.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None) \
        or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_to:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        set_to = "file://" + tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", set_to)
    return set_to.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Gives the workers this package, as spark-submit's --py-files would, once an
    application: a query may run where they don't find it by themselves. Batches of
    very long texts are bounded too, unless the session sets that bound itself."""
    most = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(most).rstrip("b") == str(64 << 20):  # Spark's default
        spark.conf.set(most, str(BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_adpulse_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="adpulse-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))  # the driver serves it to all executors
    context._adpulse_shipped = True


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/corpus/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: it is computed
    once, its row ids stay, and a lost executor costs only a read."""
    spark = df.sparkSession
    path = new_path(spark, label)
    out = df.write.mode("errorifexists")
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(docs: DataFrame) -> DataFrame:
    """doc_id as long and the whole text (null: empty); other columns go."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE,
              most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of `rows` rows and `most` bytes of strings, one row at least. After the
    last one the task's memory is given back."""
    for batch in batches:
        ends = np.zeros(batch.num_rows, dtype=np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) \
                    or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
                ends += pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(ends), 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + most, "right"))))
            yield batch.slice(at, to - at)
            at = to
    rest()


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold all rows of each of their keys, from batches sorted by
    the (non-null) long column `key`; only the last key's rows are held back."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
        first = int(np.searchsorted(keys, keys[-1], "left"))
        if held:
            before = held[-1].column(batch.schema.get_field_index(key))[-1].as_py()
            if before != keys[0]:
                yield pa.Table.from_batches(held)
                held = []
        if first:
            yield pa.Table.from_batches([*held, batch.slice(0, first)])
            held = []
        held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held)


def piece_hashes(pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each piece (128 bits name it), byte by byte, all pieces in
    step."""
    at = np.frombuffer(pieces.buffers()[1], "<i4")[pieces.offset:pieces.offset + len(pieces) + 1].astype(np.int64)
    data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)
    order = np.argsort(at[:-1] - at[1:], kind="stable")  # the longest first
    start, length = at[:-1][order], np.diff(at)[order]
    one = length.astype(np.uint64) + np.uint64(0xCBF29CE484222325)
    two = length.astype(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)
    for k in range(int(length[0]) if len(length) else 0):
        n = int(np.searchsorted(-length, -k, "left"))  # pieces with more than k bytes
        byte = data[start[:n] + k].astype(np.uint64)
        one[:n] = (one[:n] ^ byte) * np.uint64(0x100000001B3)
        x = (two[:n] + byte + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        two[:n] = x ^ (x >> np.uint64(31))
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return (one ^ (one >> np.uint64(32)))[back], two[back]


class Known:
    """Ids of pieces by the pieces' hashes: sorted arrays, some 40 bytes a piece."""

    def __init__(self):
        self.one, self.two = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)
        self.start = np.empty(0, dtype=np.int64)
        self.count = np.empty(0, dtype=np.int32)
        self.ids = np.empty(0, dtype="<u4")

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Where each piece is; -1: not known."""
        if not len(self.start):
            return np.full(len(one), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.one, one), len(self.start) - 1)
        return np.where((self.one[at] == one) & (self.two[at] == two), at, -1)

    def get(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids, and the ids behind each other."""
        return self.count[at], self.ids[spread(self.start[at], self.count[at])]

    def add(self, one: np.ndarray, two: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        starts = len(self.ids) + np.cumsum(counts, dtype=np.int64) - counts
        order = np.argsort(one, kind="stable")
        to = np.searchsorted(self.one, one[order])
        self.one = np.insert(self.one, to, one[order])
        self.two = np.insert(self.two, to, two[order])
        self.start = np.insert(self.start, to, starts[order])
        self.count = np.insert(self.count, to, counts[order])
        self.ids = np.concatenate([self.ids, ids])


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, `counts` of them, behind each other."""
    ends = np.cumsum(counts, dtype=np.int64)
    return np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


_IN_USE: list[PieceCache] = []


class PieceCache:
    """Token ids of whole texts, each distinct piece of text encoded once a slice,
    and pieces that were met lately not at all.

    `split` makes lists of pieces of texts, cut at places where the tokenizer
    splits them as well, so the ids of the pieces in a row are the ids of the text.
    `stretches` cuts one very long text at such places. A text that `whole` picks is
    not cut. The cache stays with the worker from task to task.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], split: Callable[[list[str]], pa.ListArray],
                 stretches: Callable[[str], list[str]], whole: Callable[[str], bool] = lambda text: False):
        self.encode, self.split, self.stretches, self.whole = encode, split, stretches, whole
        self.forget()

    def forget(self) -> None:
        self.known, self.older = Known(), Known()

    def ids(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        if _IN_USE != [self]:  # a worker keeps the pieces of one tokenizer
            for other in _IN_USE:
                other.forget()
            _IN_USE[:] = [self]
        found: dict[str, bytes] = dict.fromkeys(texts, b"")  # equal texts once
        short = []
        for text in found:
            if self.whole(text):
                found[text] = self.encode([text])[0]
            elif len(text) > STRETCH:
                found[text] = b"".join(self._ids([x])[0] for x in self.stretches(text))
            else:
                short.append(text)
        # nothing here makes reference cycles, and looking for them among so
        # many objects takes a quarter of the time
        collecting = gc.isenabled()
        gc.disable()
        try:
            found.update(zip(short, self._ids(short)))
        finally:
            if collecting:
                gc.enable()
        return [found[x] for x in texts]

    def _encoded(self, pieces: pa.StringArray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = self.encode(pieces.take(pa.array(at)).to_pylist()) if len(at) else []
        return (np.fromiter(map(len, own), dtype=np.int32, count=len(own)) // 4, np.frombuffer(b"".join(own), "<u4"))

    def _learn(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct pieces: start and number of their ids, and an array of ids."""
        if len(self.known.start) > CACHED:
            self.known, self.older = Known(), self.known
        kept, short = np.arange(len(pieces)), pieces
        long = pc.binary_length(pieces).to_numpy() > CACHED_PIECE
        if long.any():
            kept = np.flatnonzero(~long)
            short = pieces.take(pa.array(kept))
        one, two = piece_hashes(short)
        lacking = np.flatnonzero(self.known.find(one, two) < 0)
        if len(lacking):
            before = self.older.find(one[lacking], two[lacking])
            again, new = lacking[before >= 0], lacking[before < 0]
            old, fresh = self.older.get(before[before >= 0]), self._encoded(short, new)
            added = np.concatenate([again, new])
            self.known.add(one[added], two[added], *map(np.concatenate, zip(old, fresh)))
        at = np.full(len(pieces), -1)
        at[kept] = self.known.find(one, two)
        start, count, ids = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int32), self.known.ids
        start[at >= 0], count[at >= 0] = self.known.start[at[at >= 0]], self.known.count[at[at >= 0]]
        apart = np.flatnonzero(at < 0)  # long ones, and such as share their first hash with another
        if len(apart):
            count[apart], more = self._encoded(pieces, apart)
            start[apart] = len(ids) + np.cumsum(count[apart], dtype=np.int64) - count[apart]
            ids = np.concatenate([ids, more])
        return start, count, ids

    def _ids(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        lists = self.split(texts)
        coded = lists.flatten().dictionary_encode()
        at = coded.indices.to_numpy()
        start, count, ids = self._learn(coded.dictionary)
        each = count[at]
        # the ids of piece after piece
        row = ids[spread(start[at], each)].tobytes()
        bounds = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()] * 4
        return [row[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def rest() -> None:
    """At a task's end: what the allocators hold for later goes back to the system, so
    that idle workers stay small."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


# White space of both Python and the tokenizer's pattern. Before white space that
# follows something else, the pattern always starts a new token; so it does
# between a letter and one of these marks.
_SPACE = r"[^\S\x1c-\x1f]"
_AT_SPACE = re.compile(rf"(?<=\S)(?={_SPACE})")
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_MARK_ELSEWHERE = re.compile(rf"[.,](?<![{_LETTERS}].)").search
_ONE_TOKEN = re.compile(rf" ?[{_LETTERS}]+").fullmatch
# Text without letters or digits beyond Latin, on whose kind all Unicode versions
# agree, in the parts that the tokenizer's pattern makes of it.
_LATIN = re.compile(r"[\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]*").fullmatch
_PARTS = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\x09-\x0d\x20{_LETTERS}0-9]+"
                    r"|[\x09-\x0d\x20]+(?![^\x09-\x0d\x20])|[\x09-\x0d\x20]+").findall
_ODD = [chr(c) for c in range(0x10000) if chr(c).isspace() and chr(c) not in " \n"] + ["  ", "\n\n", " \n", "\n "]
_TOKENIZERS: dict[str, PieceCache] = {}


def _marked(text: str, mark: str) -> str:
    """A text with marks where the tokenizer's pattern never joins: before white
    space and, if they all follow a letter, full stops and commas."""
    for x in _ODD:
        if x in text:
            return _AT_SPACE.sub(mark, text)
    marked = text.replace(" ", mark + " ").replace("\n", mark + "\n")
    if not _MARK_ELSEWHERE(text):
        marked = marked.replace(",", mark + ",").replace(".", mark + ".")
    return marked


def _split(texts: list[str]) -> pa.ListArray:
    mark = next(c for c in map(chr, range(0xD800)) if not any(c in x for x in texts))
    return pc.split_pattern(pa.array([_marked(x, mark) for x in texts], pa.string()), mark)


def _stretches(text: str) -> list[str]:
    """One text in parts of some STRETCH characters, cut before white space that
    follows something else."""
    out, at = [], 0
    while len(text) - at > STRETCH and (found := _AT_SPACE.search(text, at + STRETCH)):
        out.append(text[at:found.start()])
        at = found.start()
    return [*out, text[at:]]


def _byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: printable
    Latin-1 characters stand for themselves, the others for 256 and on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [x for x in range(256) if x not in shown]
    return {x: chr(x) for x in shown} | {x: chr(256 + i) for i, x in enumerate(other)}


if sys.byteorder == "little":
    _little = array.tobytes
else:
    def _little(ids: array) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()


def little(ids: list[int]) -> bytes:
    """The ids as little-endian unsigned 32-bit integers."""
    return _little(array("I", ids))


def bpe(path: str) -> PieceCache:
    """The worker's cache for the byte-level BPE file at `path`, with the ids of the
    unaltered tokenizer: a text that holds an added token's string goes to it whole."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        holds_added = lambda text: any(x in text for x in added)
        merge, letters = tokenizer.model.tokenize, _byte_letters()
        space = letters[0x20]

        def ids_of(part: str) -> list[int]:
            """Of one part of the pattern, by the tokenizer's merges."""
            if part.isascii() and part.isprintable():  # only the space has another letter
                return [t.id for t in merge(part.replace(" ", space))]
            return [t.id for t in merge(part.encode().decode("latin-1").translate(letters))]

        def encode(pieces: list[str]) -> list[bytes]:
            out, other = [], []
            for x in pieces:
                if x.isascii() and _ONE_TOKEN(x):
                    out.append(array("I", [t.id for t in merge(x.replace(" ", space))]))
                elif _ONE_TOKEN(x):
                    out.append(array("I", ids_of(x)))
                elif _LATIN(x) and not holds_added(x):
                    out.append(array("I", [i for part in _PARTS(x) for i in ids_of(part)]))
                else:
                    other.append(len(out))
                    out.append(array("I"))
            whole = tokenizer.encode_batch_fast([pieces[i] for i in other], add_special_tokens=False)
            for i, x in zip(other, whole):
                out[i] = array("I", x.ids)
            return list(map(_little, out))

        _TOKENIZERS[path] = PieceCache(encode, _split, _stretches, holds_added)
    return _TOKENIZERS[path]


# Letters and digits, and all characters beyond ASCII, make words; A-Z in lower case.
_WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isalnum() else 0x20
                    for c in range(256))


def lower_words(text: str) -> list[bytes]:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text in lower case (A-Z)."""
    return text.encode().translate(_WORD_BYTES).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array(list(map(xxhash.xxh3_64_intdigest, words)), dtype=np.uint64)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A mixed hash of each k consecutive words, from the words' hashes."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k if n else 0):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[j:j + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    return out


class BitFilter:
    """A fixed number of bits, set at the hashes of a column: a small test, of the
    same size for any table, that lets through every row a join could match. It only
    spares rows the way to that join."""

    def __init__(self, df: DataFrame, column: str, log2_bits: int):
        self.log2_bits = log2_bits
        at = F.shiftrightunsigned(F.col(column), 64 - log2_bits) + 1
        rows = (df.groupBy(F.bitmap_bucket_number(at).alias("bucket"))
                .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect())
        self.bits = np.zeros((1 << log2_bits) // 8, dtype=np.uint8)
        for row in rows:  # 4 kB each, 2^log2_bits / 32768 of them at most
            start = (row["bucket"] - 1) * 4096
            self.bits[start:start + 4096] = np.frombuffer(row["bits"], dtype=np.uint8)[:len(self.bits) - start]

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.log2_bits)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def text_key(text: str = "text"):
    """A 16-byte name of a text's content, by which what holds for a text is joined
    to all documents that have it."""
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))
