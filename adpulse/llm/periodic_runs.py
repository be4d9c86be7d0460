"""Runs of words that repeat with a period, found in each text by its diagonals.

A run is a stretch of words with smallest period q, at least `least` words and `times`
periods long, that no neighbouring word extends. In the matrix of matches of a text with
itself it lies on diagonal q: words i and i - q are equal from its start + q to its end.
The method goes through the words, lets each word's earlier occurrences lengthen the
diagonals of their lags, and emits a diagonal as a run when the next word doesn't match.

Only matches that can belong to a run are looked at, or one word a million times over
would make 10^12 of them. A run with a lag in (L/2, L] holds at least L matches in a row
(`least` and `times` >= 3 see to that), so there a word counts with the L - 1 words after it.
Of the earlier occurrences of such a window only the nearest matters: if it has a lag r
below the run's q <= L, then r and q are both periods of a stretch of L + r words,
so their greatest common divisor is one (Fine and Wilf), and q is not the smallest. So
each word is on one active diagonal a lag class at most, and the smallest period needs no
further test. Windows are named by pairs of names of half their length, exactly and not
by hashes, and those that occur once drop out: n log n steps for any text, and few for
prose.

Texts are handled by the slice, all of a slice in step; windows never cross texts. There
is no shuffle, so hot sources and copies do no harm.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text; a
null doc_id is kept (and never planted by `decimal_tail`); repeated rows are judged one by
one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from adpulse.llm.common import documents, in_slices

SCHEMA = ("doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, "
          "collapsed string")


def _named(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each distinct key, and which keys occur more than once."""
    _, names, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return names.astype(np.int64), counts[names] > 1


def find_runs(ids: np.ndarray, text: np.ndarray, least: int = 24, times: int = 3) -> np.ndarray:
    """Rows (start, length, period), by start and period, of all runs of the texts that
    lie behind each other in `ids` (a number per distinct word); `text` tells them apart."""
    if times < 3 or least < 1:
        raise ValueError("runs of three periods and one word at least")
    n = len(ids)
    found: list[np.ndarray] = []
    # matches that a run of lag q holds at least: max(least - q, (times - 1) * q)
    window = min(max(least - q, (times - 1) * q) for q in range(1, least + 1))
    name = np.full(n, -1, dtype=np.int64)  # of the window at each word; -1: occurs once
    if n:
        names, often = _named(text.astype(np.int64) * (int(ids.max()) + 1) + ids)
        name[often] = names[often]
    width, low = 1, 0
    while True:
        while width < window:
            step = min(width, window - width)
            at = np.flatnonzero(name[:max(0, n - step)] >= 0)
            at = at[(name[at + step] >= 0) & (text[at] == text[at + step])]
            names, often = _named(name[at] * n + name[at + step]) if len(at) else (at, at.astype(bool))
            name = np.full(n, -1, dtype=np.int64)
            name[at[often]] = names[often]
            width += step
        at = np.flatnonzero(name >= 0)
        if not len(at):
            break
        # the nearest earlier occurrence of each window
        order = np.argsort(name[at], kind="stable")
        same = np.flatnonzero(name[at][order][1:] == name[at][order][:-1])
        lag = np.zeros(len(at), dtype=np.int64)
        lag[order[same + 1]] = at[order[same + 1]] - at[order[same]]
        active = (lag > low) & (lag <= window)
        at, lag = at[active], lag[active]
        if len(at):
            # a diagonal goes on with the next word at the same lag, else it ends
            begins = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (lag[1:] != lag[:-1])])
            first = np.flatnonzero(begins)
            last = np.append(first[1:], len(at)) - 1
            period = lag[first]
            length = at[last] - at[first] + window + period
            enough = length >= np.maximum(least, times * period)
            found.append(np.stack([at[first] - period, length, period], axis=1)[enough])
        low, window = window, 2 * window
    if not found:
        return np.empty((0, 3), dtype=np.int64)
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def decimal_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Planted repeats: from word a on, a text repeats its p words there. With
    h = crc32 of the decimal doc_id and g = h // 10: if h % 10 = 0 and n > 0, a = g % n and
    p = 1 + (n - a) // (3 + g % 8)."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    a = h // 10 % n
    return None if h % 10 else (a, 1 + (n - a) // (3 + h // 10 % 8))


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3,
                  tail: Callable[[int | None, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """Per document its number of words, its runs by start and period, and its words
    without those that a run repeats (what follows a run's first period), joined by one
    space. `tail(doc_id, n_words)` gives (a, p) if word i >= a is to become word
    a + (i - a) % p first."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            doc_ids = batch.column("doc_id")
            split = pc.ascii_split_whitespace(batch.column("text"))
            bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
            word = split.flatten()
            real = pc.binary_length(word).to_numpy() > 0  # none before the first space
            bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
            word = word.filter(pa.array(real))
            source = np.arange(len(word))
            if tail:
                for doc_id, a, b in zip(doc_ids.to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    if planted := tail(doc_id, b - a):
                        at, period = planted
                        source[a + at:b] = a + at + np.arange(b - a - at) % period
            ids = word.dictionary_encode().indices.to_numpy().astype(np.int64)[source]
            text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            runs = find_runs(ids, text, least, times)
            change = np.zeros(len(ids) + 1, dtype=np.int64)
            np.add.at(change, runs[:, 0] + runs[:, 2], 1)
            np.add.at(change, runs[:, 0] + runs[:, 1], -1)
            kept = np.cumsum(change[:-1]) == 0
            kept_bounds = np.concatenate([[0], np.cumsum(kept)])[bounds]
            lists = pa.ListArray.from_arrays(pa.array(kept_bounds, pa.int32()),
                                             word.take(pa.array(source[kept])))
            of = text[runs[:, 0]]
            columns = [pa.array(x, pa.int64()) for x in (runs[:, 0] - bounds[of], runs[:, 1], runs[:, 2])]
            run_bounds = np.searchsorted(of, np.arange(len(bounds)))
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(np.diff(bounds), pa.int64()),
                 pa.ListArray.from_arrays(pa.array(run_bounds, pa.int32()),
                                          pa.StructArray.from_arrays(columns, names=["start", "length", "period"])),
                 pc.binary_join(lists, " ")],
                names=["doc_id", "n_words", "runs", "collapsed"])

    return documents(docs).mapInArrow(find, SCHEMA)
