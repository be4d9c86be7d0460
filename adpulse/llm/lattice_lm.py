"""Language-model scores by subword lattice likelihood.

A word (between white space, A-Z in lower case) can be cut into pieces of a public
vocabulary in many ways. Each piece has a probability, each way has the product of its
pieces, and the word has the sum over all ways, which a forward recursion over the word's
lattice gives in log space. Pieces do not cross white space, so a text's probability is
the product of its words' and of an end token.

Piece probabilities: the vocabulary file's own scores (ranks, read as a Zipf law) are the
prior. By it, every segmentation of the training documents' words has a weight, and the
expected number of each piece over all of them, which a forward and a backward recursion
give, is added to the prior, which counts for PRIOR_SHARE as many pieces. Characters without
a piece go by their bytes' pieces. Training documents are those whose crc32(doc_id as text)
mod 10 is not 0.

Words of equal length go through the recursions together, place by place. A substring is
looked for among the pieces by a 64-bit hash.

One pass counts words: tasks count, then counts are added up by word. Each distinct word
gets its lattice probability once. To score, every document's words need their word's
row. Words that make up at least 1 / FREQUENT of all tokens number FREQUENT at most;
these, and no others, are sent to all tasks, where they cover most tokens. The others are
joined by word: none of them has more than 1 / FREQUENT of the rows, so no key is hot.

Defined cases: null text is an empty one (the end token only); a null doc_id reads as
empty text, so its document is held out; repeated rows are scored and counted each;
without training documents N and V are 0; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adpulse.llm.common import documents, in_slices, stored

#: At most so many words are sent to all tasks (about 30 MB).
FREQUENT = 200_000
#: A counting task hands its counts on beyond so many different words.
COUNT_ENTRIES = 300_000
#: Weight of the vocabulary's prior, as a share of the pieces counted, and base smoothing.
PRIOR_SHARE, SMOOTHING = 0.01, 0.1
#: Characters of words that go through a recursion together; longer words go by themselves.
TOGETHER, LONG = 100_000, 64
_SPACE_MARK = "▁"  # stands for the white space before a word
_LOG10 = math.log(10)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n, c): how often each word is in all and in training documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every: Counter[bytes] = Counter()
        train: Counter[bytes] = Counter()

        def out():
            words = list(every)
            return pa.RecordBatch.from_pydict({
                "word": pa.array(words, pa.binary()).cast(pa.string()),
                "n": pa.array(every.values(), pa.int64()),
                "c": pa.array([train[w] for w in words], pa.int64())})

        for batch in in_slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                every.update(words)
                if not held_out(doc_id):
                    train.update(words)
            if len(every) > COUNT_ENTRIES:
                yield out()
                every.clear()
                train.clear()
        if every:
            yield out()

    return (documents(docs).mapInArrow(run, "word string, n long, c long")
            .groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c")))


def vocabulary(path: str):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path)


class Lattice:
    """Pieces' log probabilities (natural) and the recursions over words' lattices."""

    _BASE, _MASK, _FILTER_BITS = 0x9E3779B97F4A7C15, (1 << 64) - 1, 20

    def __init__(self, path: str, counts: Mapping[int, float] | None = None, ends: float = 0):
        sp, counts = vocabulary(path), counts or {}
        usable = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i))]
        best = max(sp.get_score(i) for i in usable)
        prior = {i: 1.0 / (1.0 + best - sp.get_score(i)) for i in usable}
        counted = sum(counts.get(i, 0) for i in usable) + ends
        mass = PRIOR_SHARE * counted or 1.0
        scale = mass / (sum(prior.values()) + 1)
        log = {i: math.log((counts.get(i, 0) + scale * prior[i]) / (counted + mass)) for i in usable}
        self.end = math.log((ends + scale) / (counted + mass))
        self.byte, self.byte_id = np.zeros(256), np.zeros(256, dtype=np.int64)
        found: dict[int, int] = {}
        self.longest = 1
        for i in usable:
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte[value], self.byte_id[value] = log[i], i
            else:
                h = 0
                for c in piece:
                    h = (h * self._BASE + ord(c) + 1) & self._MASK
                found[h] = i
                self.longest = max(self.longest, len(piece))
        self.hashes = np.array(sorted(found), dtype=np.uint64)
        self.ids = np.array([found[int(h)] for h in self.hashes], dtype=np.int64)
        self.scores = np.array([log[int(i)] for i in self.ids])
        self.filter = np.zeros(1 << self._FILTER_BITS, dtype=bool)
        self.filter[self._slot(self.hashes)] = True

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self._FILTER_BITS)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, -1 for none."""
        flat = hashes.ravel()
        out = np.full(len(flat), -1, dtype=np.int64)
        maybe = np.flatnonzero(self.filter[self._slot(flat)])
        at = np.minimum(np.searchsorted(self.hashes, flat[maybe]), len(self.hashes) - 1)
        same = self.hashes[at] == flat[maybe]
        out[maybe[same]] = at[same]
        return out.reshape(hashes.shape)

    def _edges(self, codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per length the pieces (-1: none) and log probabilities of the substrings that
        start at each place (rows) of each word (columns). A character without a piece
        has its bytes'."""
        out, hashes = [], np.zeros_like(codes)
        for n in range(1, min(self.longest, len(codes)) + 1):
            hashes = hashes[:len(codes) - n + 1] * np.uint64(self._BASE) + codes[n - 1:] + np.uint64(1)
            at = self._find(hashes)
            score = np.where(at >= 0, self.scores[at], -np.inf)
            if n == 1 and (at < 0).any():
                spelt = {int(c): self.byte[list(chr(int(c)).encode())].sum() for c in np.unique(codes[at < 0])}
                score[at < 0] = [spelt[int(c)] for c in codes[at < 0]]
            out.append((at, score))
        return out

    @staticmethod
    def _sum(rows: list[np.ndarray]) -> np.ndarray:
        x = np.stack(rows)
        top = x.max(axis=0)
        return top + np.log(np.exp(x - top).sum(axis=0))

    def _forward(self, edges: list, n: int) -> np.ndarray:
        """The log probability of all ways to each place."""
        alpha = np.zeros((n + 1, edges[0][1].shape[1]))
        for j in range(1, n + 1):
            alpha[j] = self._sum([alpha[j - k] + edges[k - 1][1][j - k] for k in range(1, min(len(edges), j) + 1)])
        return alpha

    def _backward(self, edges: list, n: int) -> np.ndarray:
        beta = np.zeros((n + 1, edges[0][1].shape[1]))
        for i in range(n - 1, -1, -1):
            beta[i] = self._sum([edges[k - 1][1][i] + beta[i + k] for k in range(1, min(len(edges), n - i) + 1)])
        return beta

    def _together(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of words of equal length, and their characters, a column a word."""
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        for n in np.unique(length).tolist():
            own = np.flatnonzero(length == n)
            most = max(1, TOGETHER // (n + 1)) if n <= LONG else 1
            for first in range(0, len(own), most):
                some = own[first:first + most]
                text = "".join([_SPACE_MARK + words[i] for i in some])
                codes = np.frombuffer(text.encode("utf-32-le"), "<u4").reshape(len(some), n + 1)
                yield some, np.ascontiguousarray(codes.T).astype(np.uint64)

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """The sum over all segmentations of each word."""
        out = np.zeros(len(words))
        for some, codes in self._together(words):
            out[some] = self._forward(self._edges(codes), len(codes))[-1]
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """By piece id, how often each piece is expected in the words, of which there are
        `counts`, over all their segmentations."""
        out = np.zeros(max(int(self.ids.max()), int(self.byte_id.max())) + 1)
        for some, codes in self._together(words):
            n, edges = len(codes), self._edges(codes)
            alpha, beta = self._forward(edges, n), self._backward(edges, n)
            for k, (at, score) in enumerate(edges, 1):
                share = np.exp(alpha[:n - k + 1] + score + beta[k:] - alpha[n]) * counts[some]
                real = at >= 0
                out += np.bincount(self.ids[at[real]], share[real], len(out))
                if k == 1 and not real.all():
                    for c in np.unique(codes[~real]).tolist():
                        weight = share[~real & (codes == np.uint64(c))].sum()
                        np.add.at(out, self.byte_id[list(chr(c).encode())], weight)
        return out


def count_pieces(words: DataFrame, prior: Lattice) -> dict[int, float]:
    """How often each piece is expected in the training words, by the prior's weights of
    their segmentations. As many rows as the vocabulary has pieces reach the driver."""
    sent = words.sparkSession.sparkContext.broadcast(prior)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in in_slices(batches, 20_000):
            got = sent.value.expected(batch.column("word").to_pylist(), batch.column("c").to_numpy().astype(float))
            total = got if total is None else total + got
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"piece": at.astype(np.int64), "c": total[at]})

    rows = (words.where("c > 0").select("word", "c").mapInArrow(run, "piece long, c double")
            # whole numbers of 2^-20, so that the sum does not depend on the tasks' order
            .groupBy("piece").agg((F.sum(F.round(F.col("c") * F.lit(float(1 << 20))).cast("decimal(38,0)"))).alias("c")).collect())
    return {r["piece"]: float(r["c"]) / (1 << 20) for r in rows}


def with_lattice(words: DataFrame, model: Lattice) -> DataFrame:
    """(word, n, c, lattice): lattice is the word's log10 probability."""
    sent = words.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 20_000):
            score = sent.value.log_probabilities(batch.column("word").to_pylist()) / _LOG10
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())],
                                             names=[*batch.schema.names, "lattice"])

    return words.select("word", "n", "c").mapInArrow(run, "word string, n long, c long, lattice double")


def _partly_scored(docs: DataFrame, frequent: dict, base_of: float, base_end: float, end: float) -> DataFrame:
    """Per document its sums over frequent words, and its other words with their
    number. `frequent` has (c, lattice) by word; a word's base score is
    log10(c + SMOOTHING) - base_of."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)
    rest_type = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = sent.value["index"]
        c, lattice = sent.value["c"], sent.value["lattice"]
        # one entry more: what a word that is not frequent adds here, nothing
        base = np.append(np.log10(c + SMOOTHING) - base_of, 0.0)
        lattice, known = np.append(lattice, 0.0), np.append(c > 0, False)
        none = len(c)
        for batch in in_slices(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                index = [at.get(w, none) for w in words]
                rest = Counter([w for w, i in zip(words, index) if i == none])
                index = np.array(index, dtype=np.int64)
                rows.append((held_out(doc_id), len(words) + 1, int(known[index].sum()),
                             float(base[index].sum()) + base_end, float(lattice[index].sum()) + end,
                             [{"word": w.decode(), "n": n} for w, n in rest.items()]))
            kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), rest_type]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"),
                 *[pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]],
                names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "lattice", "rest"])

    schema = ("row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, "
              "lattice double, rest array<struct<word string, n long>>")
    return documents(docs).withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, schema)


def score(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (both
    log10) of every document."""
    counts = stored(count_words(docs), "word-counts")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    is_held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    train_docs = ids.where(~is_held).count()
    total = counts.agg(F.sum("n").alias("n"), F.sum("c").alias("c"),
                       F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n_train = (total["c"] or 0) + train_docs
    n_distinct = total["v"] + (train_docs > 0)
    model = Lattice(path, count_pieces(counts, Lattice(path)), train_docs)
    words = stored(with_lattice(counts, model), "word-scores")
    frequent = words.where(F.col("n") * FREQUENT >= (total["n"] or 0)).select("word", "c", "lattice").toPandas()
    table = {"index": {w.encode(): i for i, w in enumerate(frequent["word"])},
             "c": frequent["c"].to_numpy(dtype=float), "lattice": frequent["lattice"].to_numpy(dtype=float)}
    base_of = math.log10(n_train + SMOOTHING * (n_distinct + 1))
    part = stored(_partly_scored(docs, table, base_of, math.log10(train_docs + SMOOTHING) - base_of,
                                 model.end / _LOG10), "partly-scored")
    rest = part.select("row", F.explode("rest").alias("r")).select("row", "r.*")
    added = (rest.join(words.select("word", "c", F.col("lattice").alias("w_lattice")), "word")
             .groupBy("row").agg(
                 F.sum(F.col("n") * (F.log10(F.col("c") + F.lit(SMOOTHING)) - F.lit(base_of))).alias("more_base"),
                 F.sum(F.col("n") * F.col("w_lattice")).alias("more_lattice"),
                 F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known")))
    none = F.lit(0)
    return part.drop("rest").join(added, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.lit(int(train_docs > 0)) + F.coalesce("more_known", none)).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", none)).alias("base_score"),
        (F.col("lattice") + F.coalesce("more_lattice", none)).alias("score"))
