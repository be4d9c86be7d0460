"""The registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adpulse.llm import (filter_audit, kd_shards, lattice_lm, license_scan, packing, periodic_runs, pii, quality_rules, simhash,
                         source_mix, substring_dedup, token_records, winnowing)
from adpulse.llm.common import load, ship


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file (a parameter of the operators)."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = lambda x: F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    found = lambda kind: lambda s: F.when(s["kind"] == kind, 1)
    spans, kinds = F.col("spans"), list(pii.PATTERNS)
    base = F.filter(spans, lambda s: s["kind"].isin(kinds))
    return pii.spans(load(spark, sf_dir, "documents")).select(
        "doc_id",
        *[F.size(F.array_compact(F.transform(spans, found(k)))).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(F.concat_ws(",", written(base)), 256).alias("base_sha256"),
        F.concat_ws(",", written(spans)).alias("spans"))


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_records.write_records(load(spark, sf_dir, "documents"),
                                           tokenizer_file("byte_bpe_50k.json"), end_id=2)
    return token_records.read_records(manifest)


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_shards.shards(load(spark, sf_dir, "documents"), n_shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = winnowing.rate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), window=10)
    return rated.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, own = F.col("places.label"), F.col("spans.label")
    return license_scan.scan(load(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.first").alias("first_word"), F.array_max("places.first").alias("last_word"),
        F.concat_ws(",", F.array_sort(F.array_distinct(base))).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union(base, own))).alias("labels"), "score")


def op6_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(load(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op7_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=0)


def op8_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(load(spark, sf_dir, "documents"), window=35)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"), shingle=3, bits=3)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality_rules.rate(load(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        "base_failed", "kept", "n_tokens", "chars_per_token", "byte_share", "entropy")


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = source_mix.Mix(load(spark, sf_dir, "documents"), weights=(1, 2, 3), n_shards=40)
    return mix.taken().select("doc_id", "size", "source_size", "target", "taken", "source")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(load(spark, sf_dir, "documents"), least=24, times=3,
                                        tail=periodic_runs.decimal_tail)
    # the greatest length/period, compared without division; the first of equal ones
    more = lambda a, b: F.when(
        a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), more)
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"],
                                                   F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _shipped(query) for name, query in {
    "op1_pii": op1_pii,
    "op2_token_records": op2_token_records,
    "op3_kd_shards": op3_kd_shards,
    "op4_winnowing": op4_winnowing,
    "op5_license_scan": op5_license_scan,
    "op6_lattice_lm": op6_lattice_lm,
    "op7_harmonic_packing": op7_harmonic_packing,
    "op8_super_kmers": op8_super_kmers,
    "op9_simhash": op9_simhash,
    "op10_quality_rules": op10_quality_rules,
    "op11_source_mix": op11_source_mix,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_filter_audit": op13_filter_audit,
}.items()}
_WORDS_SQL = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

ORACLE_SQL: dict[str, str] = {
    "op4_winnowing": f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS n, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
       FROM b WHERE len(w) > 0),
bk AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM bw),
dn AS (SELECT doc_id, w, n FROM d, (SELECT DISTINCT n FROM bk) WHERE len(w) >= n),
dw AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dn),
dk AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM dw),
hit AS (SELECT dk.doc_id, dk.n, dk.i, bk.item_id FROM dk JOIN bk ON dk.n = bk.n AND dk.k = bk.k),
pos AS (SELECT doc_id, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT doc_id, n, i FROM hit)),
nh AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM pos GROUP BY doc_id),
ni AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN ni USING (doc_id)""",
    "op8_super_kmers": """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS k FROM win),
rep AS (SELECT doc_id, i FROM k WHERE k IN (SELECT k FROM k GROUP BY k HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM rep)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.j) AS kept, count(*) AS n
         FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.j = gone.j GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op13_filter_audit": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
             max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT r, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             [len(w) < 50, 100 * list_unique(w) < 65 * len(w),
              100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t),
              regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)] AS fails
      FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
letters AS (SELECT unnest(range(1, 6)) AS i, unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (SELECT a.c || b.c || e.c || g.c || h.c AS o, [a.i, b.i, e.i, g.i, h.i] AS x
           FROM letters a, letters b, letters e, letters g, letters h
           WHERE len(list_distinct([a.i, b.i, e.i, g.i, h.i])) = 5),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
parts AS (SELECT part, sum(n) AS n FROM cells GROUP BY part),
own AS (SELECT part, i, sum(CASE WHEN fails[i] THEN n ELSE 0 END) AS fail,
               sum(CASE WHEN fails[i] AND len([b for b in fails if b]) = 1 THEN n ELSE 0 END) AS alone
        FROM cells, letters GROUP BY part, i),
gone AS (SELECT part, o, x, list_position([fails[j] for j in x], true) AS step, n, good, toxic
         FROM cells, orders),
steps AS (SELECT part, n, o, x, step, x[step] AS i FROM parts, orders, (SELECT unnest(range(1, 6)) AS step)),
out AS (SELECT steps.part, steps.o, steps.step, steps.i, any_value(steps.n) AS n, coalesce(sum(gone.n), 0) AS removed,
               coalesce(sum(gone.good), 0) AS good_lost, coalesce(sum(gone.toxic), 0) AS toxic_lost
        FROM steps LEFT JOIN gone ON steps.part = gone.part AND steps.o = gone.o AND steps.step = gone.step
        GROUP BY steps.part, steps.o, steps.step, steps.i)
SELECT out.part, o AS filter_order, CAST(step AS INTEGER) AS step,
       CAST(n - sum(removed) OVER (PARTITION BY out.part, o ORDER BY step) AS BIGINT) AS kept,
       CAST(removed AS BIGINT) AS removed, CAST(fail - removed AS BIGINT) AS redundant,
       CAST(alone AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY out.part, out.i) AS BIGINT) AS shapley
FROM out JOIN own ON out.part = own.part AND out.i = own.i""",
}
