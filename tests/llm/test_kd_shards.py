from __future__ import annotations

import zlib
from collections import defaultdict

import pytest

from adpulse.llm import kd_shards


def check(docs, got, n_shards):
    want = sorted((r.doc_id is not None, r.doc_id or 0, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode()))
                  for r in docs.select("doc_id", "text").collect())
    assert sorted((r.doc_id is not None, r.doc_id or 0, r["size"], r.text_crc32) for r in got) == want
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in got:
        assert 0 <= r.shard < n_shards
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return sizes


@pytest.mark.parametrize("table", ["odd_docs", "no_docs"])
def test_odd_tables(request, table):
    docs = request.getfixturevalue(table)
    for n in (1, 5):
        check(docs, kd_shards.shards(docs, n).collect(), n)


def test_bytes_are_near_equal(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    sizes = check(docs, kd_shards.shards(docs, 40).collect(), 40)
    mean, largest = sum(sizes.values()) / 40, max(len(r.text.encode()) for r in docs.collect())
    assert len(sizes) == 40
    assert all(abs(x - mean) < 0.02 * mean + largest / 2 for x in sizes.values())


def test_equal_rows_are_split(spark, make_docs, monkeypatch):
    monkeypatch.setattr(kd_shards, "SLOT_ROWS", 7)
    docs = make_docs([(None, "the same")] * 400)
    sizes = check(docs, kd_shards.shards(docs, 7).collect(), 7)
    assert len(sizes) == 7 and max(sizes.values()) - min(sizes.values()) <= 3 * 24


def test_shards_follow_the_target(make_docs):
    docs = make_docs([(i, "x" * 84) for i in range(100)])
    assert len({r.shard for r in kd_shards.shards(docs, target_bytes=2500).collect()}) == 4


def brute_tree(points, shards):
    """{row: shard}: split along the widest dimension at the weighted median, written out."""
    whole = [max(p[d] for p in points.values()) - min(p[d] for p in points.values()) for d in range(4)]
    out = {}

    def split(rows, first, n):
        if n == 1 or not rows:
            out.update(dict.fromkeys(rows, first))
            return
        spread = [(max(points[r][d] for r in rows) - min(points[r][d] for r in rows)) / max(1, whole[d]) for d in range(4)]
        d = spread.index(max(spread))
        total, wanted, at = sum(points[r][4] for r in rows), 0, 0
        wanted = total * (n // 2) / n
        sums = defaultdict(int)
        for r in rows:
            sums[points[r][d]] += points[r][4]
        for x in sorted(sums):
            before, at = at, at + sums[x]
            if at >= wanted:
                cut = x if wanted - before < at - wanted else x + 1
                break
        split([r for r in rows if points[r][d] < cut], first, n // 2)
        split([r for r in rows if points[r][d] >= cut], first + n // 2, n - n // 2)

    split(list(points), 0, shards)
    return out


@pytest.mark.parametrize("n,sent", [(8, 50_000), (5, 0), (2, 50_000)])
def test_the_tree_equals_brute_force(spark, monkeypatch, n, sent):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = kd_shards._rows(docs)
    monkeypatch.setattr(kd_shards, "_rows", lambda _: rows)
    monkeypatch.setattr(kd_shards, "TOLERANCE", 0)  # to the last bit of a coordinate
    monkeypatch.setattr(kd_shards, "SENT_NODES", sent)
    points = {r.row: (r.c0, r.c1, r.c2, r.c3, r["size"]) for r in kd_shards._points(rows).collect()}
    want = brute_tree(points, n)
    ids = {r.row: r.doc_id for r in rows.select("row", "doc_id").collect()}
    got = {r.doc_id: r.shard for r in kd_shards.shards(docs, n).collect()}
    assert got == {ids[r]: s for r, s in want.items()} and len(set(got.values())) == n


def test_shards_keep_like_metadata_together(spark):
    """Beside shards drawn by lot, those of the tree hold far fewer kinds of documents."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = kd_shards.shards(docs, 8).join(docs.select("doc_id", "source", "lang"), "doc_id").collect()
    kinds = lambda shard_of: sum(len({(r.source, r.lang) for r in got if shard_of(r) == s}) for s in range(8))
    by_lot = kinds(lambda r: zlib.crc32(str(r.doc_id).encode()) % 8)
    assert kinds(lambda r: r.shard) < 0.7 * by_lot
