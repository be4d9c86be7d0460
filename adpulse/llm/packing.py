"""Harmonic packing of tokenised documents into fixed-length sequences.

Documents that fit a sequence of capacity C are partitioned by length into the classes
(C/(j+1), C/j]. A bin of class j is filled with exactly j documents, whichever come, and
then closed: no look at other bins, no search. Each worker does so by itself for the documents of
its task, so there is no shuffle, and the sequences of different tasks are told apart by
their task's number.

What j documents leave of a sequence is a gap. Longer documents, which must be cut anyhow,
are cut to fill gaps, the widest first, then whole sequences; what is left of one is an item
like a document of its length. So a document that fits stays whole as long as longer ones come
by. A worker keeps back the last items that it has read (`HELD` sequences' worth), and

- while more than half as much room waits in gaps, an item goes whole to the narrowest
  gap that holds it, or is cut like a long document if there is none;
- at the task's end all open bins are gaps, and the items kept back go, whole documents
  before what is left of cut ones and the longest first, whole to the narrowest gap that holds them, else to a new sequence if the gaps can't take
  all that is left, else they are cut.

There are at most 2 * sqrt(C) classes, so what is kept back outweighs the open bins and the
waiting gaps, and in the end the room left over is less than one sequence a task, of
some millions of ids.

Defined cases: null text is an empty one (only the end id, one piece of length 1);
doc_ids may be null or repeat, each row is packed; an empty table gives no pieces;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from adpulse.llm.common import bpe, documents, in_slices

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")
#: Sequences' worth of documents that a worker keeps back.
HELD = 256
#: sequence_id = number of the task * TASK + number of the sequence there.
TASK = 1 << 32


class Packer:
    """Packs the documents of one task. A document is any object beside its number of
    ids; `placed` collects (document, start, length, number of ids, sequence, offset)."""

    def __init__(self, capacity: int, held: int = HELD):
        self.capacity, self.most_held = capacity, max(held, 4 * isqrt(capacity) + 4) * capacity
        self.placed: list[tuple] = []
        self.sequences = 0
        self.open: dict[int, list[int]] = {}  # class: sequence, ids in it, items in it
        self.gaps: list[tuple[int, int, int]] = []  # room, sequence, offset; by room
        self.room = 0
        self.kept: deque[tuple] = deque()  # length, document, start, number of ids
        self.kept_ids = 0

    def add(self, document, n: int) -> None:
        if n > self.capacity:
            self._cut(document, 0, n, n)
        else:
            self._keep(document, 0, n, n)
        while self.kept_ids > self.most_held:
            length, *item = self.kept.popleft()
            self.kept_ids -= length
            if self.room <= self.most_held // 2:
                self._into_class(length, *item)
            elif not self._into_gap(length, *item):
                document, start, n = item
                self._cut(document, start, start + length, n)

    def end(self) -> None:
        for sequence, used, _ in self.open.values():
            self._leave(sequence, used)
        self.open.clear()
        items, left = sorted(self.kept, key=lambda x: (x[2] > 0, -x[0])), self.kept_ids
        self.kept.clear()
        for length, document, start, n in items:
            if not self._into_gap(length, document, start, n):
                if left > self.room:
                    self._put(document, start, length, n, self._new(), 0)
                    self._leave(self.sequences - 1, length)
                else:
                    self._cut(document, start, start + length, n)
            left -= length
        self.kept_ids = 0

    def _keep(self, document, start: int, length: int, n: int) -> None:
        self.kept.append((length, document, start, n))
        self.kept_ids += length

    def _new(self) -> int:
        self.sequences += 1
        return self.sequences - 1

    def _put(self, document, start: int, length: int, n: int, sequence: int, offset: int) -> None:
        self.placed.append((document, start, length, n, sequence, offset))

    def _leave(self, sequence: int, used: int) -> None:
        """What is left of a sequence is a gap."""
        if used < self.capacity:
            insort(self.gaps, (self.capacity - used, sequence, used))
            self.room += self.capacity - used

    def _into_class(self, length: int, document, start: int, n: int) -> None:
        """An item of class j to its open bin, the j-th closes it."""
        j = self.capacity // length
        own = self.open.get(j) or self.open.setdefault(j, [self._new(), 0, 0])
        self._put(document, start, length, n, own[0], own[1])
        own[1] += length
        own[2] += 1
        if own[2] == j:
            self._leave(own[0], own[1])
            del self.open[j]

    def _into_gap(self, length: int, document, start: int, n: int) -> bool:
        """A whole item to the narrowest gap that holds it."""
        at = bisect_left(self.gaps, (length,))
        if at == len(self.gaps):
            return False
        room, sequence, offset = self.gaps.pop(at)
        self._put(document, start, length, n, sequence, offset)
        self.room -= room
        self._leave(sequence, offset + length)
        return True

    def _cut(self, document, start: int, end: int, n: int) -> None:
        """The ids from start to end: to gaps, the widest first, then to sequences; the
        rest is kept back."""
        while start < end and self.gaps:
            room, sequence, offset = self.gaps.pop()
            self.room -= room
            length = min(room, end - start)
            self._put(document, start, length, n, sequence, offset)
            self._leave(sequence, offset + length)
            start += length
        while end - start >= self.capacity:
            self._put(document, start, self.capacity, n, self._new(), 0)
            start += self.capacity
        if start < end:
            self._keep(document, start, end - start, n)


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """Each piece of each document with its sequence and its offset there."""
    names = [x.split()[0] for x in PIECES.split(", ")] + (["ids"] if with_ids else [])
    kinds = [pa.int64()] * 7 + [pa.binary()]

    def rows(packer: Packer, part: int) -> pa.RecordBatch:
        out = []
        for (doc_id, ids), start, length, n, sequence, offset in packer.placed:
            own = memoryview(ids)[4 * start:4 * (start + length)]
            out.append((doc_id, start, length, zlib.crc32(own), n, part * TASK + sequence, offset,
                        *((bytes(own),) if with_ids else ())))
        packer.placed.clear()
        columns = zip(*out) if out else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part, packer = bpe(tokenizer), TaskContext.get().partitionId(), Packer(capacity)
        tail = end_id.to_bytes(4, "little")
        for batch in in_slices(batches):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), cache.ids(batch.column("text").to_pylist())):
                ids += tail
                packer.add((doc_id, ids), len(ids) // 4)
            yield rows(packer, part)
        packer.end()
        yield rows(packer, part)

    return documents(docs).mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))
