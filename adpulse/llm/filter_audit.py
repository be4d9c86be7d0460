"""How filters of a corpus interact: what each removes in every order, and its Shapley share.

A document fails some subset of k filters, its mask. What a coalition S of filters
removes, v(S), is the number of documents whose mask meets S, so one count of masks per
part gives all 2^k coalitions. Every figure of every order is a difference of two of
them: a filter f after the filters P removes v(P + f) - v(P).

The Shapley value is the solution of a least squares problem: the additive game that
comes nearest to v over all proper coalitions, weighted by the Shapley kernel
(k - 1) / (C(k, s) s (k - s)), and that shares out v of all filters exactly. Its normal
equations, bordered by that constraint, are solved in rational numbers. They are linear
in v and their matrix depends on k alone, so they are solved once, for each coalition's
unit game; a part's values are then sums of products of its 2^k counts, in integers:
k! times the value, the removals summed over all orders.

Work is counted before it is shuffled: the table is read once, into one narrow row per
distinct document, and whether a text occurs under a smaller id is found by keeping the
smallest id of each text on both sides of the shuffle, so a text that a third of all
documents share is a few rows.

Defined cases: a null text is an empty one; an empty text has no words (fails A alone,
and E if it is not the first); a null part is the empty string; a null doc_id has no label,
no smaller id, and is no smaller id of another row; rows that repeat a doc_id are judged
one by one, and of equal texts all rows with the smallest id pass E; several labels of a
doc_id count as good or toxic if any says so; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adpulse.llm.common import stored, text_key

#: The most filters: 2^k sums a part and k! orders.
MOST_FILTERS = 7
#: Null ids match no label; they are dealt out over so many join keys.
SALTS = 4096
_SPACES = r"[\x20\x09-\x0D]+"


def shapley_weights(k: int) -> list[list[int]]:
    """Per filter, by which its counts of removals v[mask], mask from 0 to 2^k - 1, are
    multiplied to give k! times its Shapley value."""
    full = (1 << k) - 1
    members = [[i for i in range(k) if mask >> i & 1] for mask in range(full + 1)]
    kernel = [Fraction(k - 1, comb(k, len(m)) * len(m) * (k - len(m))) if 0 < len(m) < k else Fraction(0)
              for m in members]
    # the normal equations, bordered by the efficiency constraint, beside a unit matrix
    side = k + 1
    rows = [[Fraction(0)] * side + [Fraction(int(i == j)) for j in range(side)] for i in range(side)]
    for mask, inside in enumerate(members):
        for i in inside:
            for j in inside:
                rows[i][j] += kernel[mask]
    for i in range(k):
        rows[i][k] = rows[k][i] = Fraction(1)
    for c in range(side):
        pivot = next(r for r in range(c, side) if rows[r][c])
        rows[c], rows[pivot] = rows[pivot], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for r in range(side):
            if r != c and rows[r][c]:
                rows[r] = [x - rows[r][c] * y for x, y in zip(rows[r], rows[c])]
    inverse = [row[side:] for row in rows]
    out = []
    for i in range(k):
        weights = [kernel[mask] * sum((inverse[i][j] for j in inside), Fraction(0))
                   for mask, inside in enumerate(members)]
        weights[full] += inverse[i][k]
        weights = [factorial(k) * w for w in weights]
        assert all(w.denominator == 1 for w in weights)
        out.append([int(w) for w in weights])
    return out


def coalitions(masks: DataFrame, k: int, part: str, games: Sequence[str]) -> DataFrame:
    """Per part the number of documents, and per game an array of how many documents each
    coalition removes, from rows (part, mask, n, a boolean per game). The game "all"
    counts every document."""
    if not 1 <= k <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")

    def removed(game: str) -> Column:
        counts = F.col("n") if game == "all" else F.when(F.col(game), F.col("n"))
        return F.array(*[F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(s) != 0, counts)), F.lit(0).cast("long"))
                         for s in range(1 << k)])

    cells = masks.groupBy(part, "mask", *games).agg(F.sum("n").alias("n"))
    return cells.groupBy(part).agg(F.sum("n").alias("n_all"), removed("all").alias("v_all"),
                                   *[removed(g).alias(f"v_{g}") for g in games])


def audit(masks: DataFrame, filters: Sequence[str], part: str, games: Sequence[str] = ()) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant,
    unique_fails, shapley (summed over all orders), and per game <game>_lost.

    `masks` has the columns part, mask (bit i set: fails filters[i]), n (documents) and a
    boolean column per game."""
    k = len(filters)
    table = coalitions(masks, k, part, games)
    steps, full = [], (1 << k) - 1
    for order in permutations(range(k)):
        before = 0
        for step, i in enumerate(order, 1):
            steps.append({"o": "".join(filters[j] for j in order), "s": step, "i": i, "b": before})
            before |= 1 << i
    # a literal of k * k! steps, the same for every part
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<o string, s int, i int, b int>>")
    shares = F.array(*[
        F.expr("0L" + "".join(f" + {w}L * v_all[{s}]" for s, w in enumerate(weights) if w))
        for weights in shapley_weights(k)])
    x = table.withColumn("shares", shares).withColumn("x", F.explode(plan))
    bit = F.expr("shiftleft(1, x.i)")
    after, own = F.col("x.b").bitwiseOR(bit), F.lit(full).bitwiseXOR(bit)

    def lost(game: str) -> Column:
        v = F.col(f"v_{game}")
        return F.get(v, after) - F.get(v, F.col("x.b"))

    v = F.col("v_all")
    return x.select(
        F.col(part), F.col("x.o").alias("filter_order"), F.col("x.s").alias("step"),
        (F.col("n_all") - F.get(v, after)).alias("kept"), lost("all").alias("removed"),
        (F.get(v, bit) - lost("all")).alias("redundant"),
        (F.get(v, F.lit(full)) - F.get(v, own)).alias("unique_fails"),
        *[lost(g).alias(f"{g}_lost") for g in games],
        F.get("shares", F.col("x.i")).alias("shapley"))


#: The text filters of the audit of documents, by letter; E follows in `text_masks`.
def text_filters(text: Column) -> Mapping[str, Column]:
    """Failure conditions: A: under 50 words; B: 100 * distinct words < 65 * words;
    C: 100 * capitals > 5 * characters; D: holds a symbol."""
    words = F.array_remove(F.split(text, _SPACES), "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": n < 50, "B": F.size(F.array_distinct(words)) * 100 < n * 65,
            "C": capitals * 100 > F.length(text) * 5, "D": text.rlike(r"[#$%&*|]")}


def text_masks(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, mask, good, toxic, n) of the filters A to E over all documents."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    conditions = text_filters(text)
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions.values())]
    last = 1 << len(bits)
    narrow = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"),
                          F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                          sum(bits[1:], bits[0]).alias("mask"))
              .groupBy("doc_id", "text_key", "part", "mask").agg(F.count("*").alias("n")))
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text_key"), F.lit(SALTS))).otherwise(F.lit(0))
    rated = (labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
             .withColumn("salt", F.lit(0).cast("long")))
    known = stored(narrow.withColumn("salt", salt.cast("long")).join(rated, ["doc_id", "salt"], "left")
                   .select("doc_id", "text_key", "part", "mask", "n",
                           F.coalesce("good", F.lit(False)).alias("good"),
                           F.coalesce("toxic", F.lit(False)).alias("toxic")), "audit")
    cell = ["part", "mask", "good", "toxic"]
    # rank 1 keeps all rows with the smallest id; it is applied before the shuffle as well
    by_text = Window.partitionBy("text_key").orderBy("doc_id")
    first = (known.where("doc_id is not null").withColumn("at", F.rank().over(by_text)).where("at = 1")
             .select(*cell, "n").unionByName(known.where("doc_id is null").select(*cell, "n")))
    every = known.groupBy(*cell).agg(F.sum("n").alias("n"))
    repeat = F.col("mask").bitwiseOR(last)
    # all documents count as repeats but for the first ones of their text
    move = F.inline(F.array(F.struct(repeat.alias("mask"), (-F.col("n")).alias("n")), F.struct("mask", "n")))
    return (every.select("part", repeat.alias("mask"), "good", "toxic", "n")
            .unionByName(first.groupBy(*cell).agg(F.sum("n").alias("n")).select("part", "good", "toxic", move))
            .groupBy(*cell).agg(F.sum("n").alias("n")).where("n > 0"))


def audit_documents(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """The audit of the filters A to E per value of `part`."""
    return audit(text_masks(docs, labels, part), "ABCDE", "part", ("good", "toxic"))
