from __future__ import annotations

import itertools
import os
import random
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from adpulse.llm import common, packing, token_records
from adpulse.llm.common import bpe, documents, whole_groups
from adpulse.llm.queries import tokenizer_file

FILE = tokenizer_file("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encode():
    t = Tokenizer.from_file(FILE)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_cached_ids_equal_the_tokenizers(encode):
    rnd = random.Random(1)
    letters = " \n\t\x1c\x00\xa0ab'st.,1²é٣ⅷ漢　|ß"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(5000)]
    got = bpe(FILE).ids(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [encode(x) for x in texts]


def test_an_added_tokens_string_counts_as_that_token(encode):
    mark = "<|endoftext|>"
    texts = [mark, mark + " b", "a " + mark, "a " + mark + " b", "a" + mark + "b", "a  " + mark + "  b\n",
             mark * 3, mark[:-1], "x." + mark + ",y é"]
    got = [np.frombuffer(x, "<u4").tolist() for x in bpe(FILE).ids(texts)]
    assert got == [encode(x) for x in texts]
    assert got[3] == [64, 220, 50256, 275]


def test_very_long_texts_are_encoded_in_stretches(encode, monkeypatch):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abé.,' ") for _ in range(rnd.randint(1, 9))) for _ in range(3000)]
    monkeypatch.setattr(common, "STRETCH", 500)
    texts = [" ".join(words), "\n \t".join(words), "z" * 3000, " " * 3000, "a" + " " * 2000 + "b"]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe(FILE).ids(texts)] == [encode(x) for x in texts]


def test_pieces_with_the_same_first_hash(encode, monkeypatch):
    real = common.piece_hashes
    monkeypatch.setattr(common, "piece_hashes", lambda p: (real(p)[0] % np.uint64(7), real(p)[1]))
    monkeypatch.setattr(common, "CACHED", 40)  # the cache starts anew again and again
    bpe(FILE).known, bpe(FILE).older = common.Known(), common.Known()
    long = ["w" * 70, "", "é" * 50]  # nothing is known yet
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe(FILE).ids(long)] == [encode(x) for x in long]
    rnd = random.Random(4)
    for _ in range(6):
        texts = [" ".join(rnd.choice(["some", "words", "w" * 70, "é", "x" * rnd.randint(1, 30)]) for _ in range(20))
                 for _ in range(20)]
        assert [np.frombuffer(x, "<u4").tolist() for x in bpe(FILE).ids(texts)] == [encode(x) for x in texts]
    bpe(FILE).known, bpe(FILE).older = common.Known(), common.Known()


def test_piece_hashes_tell_pieces_apart():
    pieces = pa.array(sorted({"".join(x) for n in range(4) for x in itertools.product("ab\0é", repeat=n)} | {"a" * n for n in range(60)}))
    one, two = common.piece_hashes(pieces)
    assert len(set(one.tolist())) == len(set(two.tolist())) == len(pieces)
    again = common.piece_hashes(pieces.slice(5, 20))
    assert (again[0] == one[5:25]).all() and (again[1] == two[5:25]).all()


def test_slices_are_bounded_by_bytes():
    texts = ["x" * n for n in (10, 10, 90, 500, 5, 5, 5, 0, 0)] + [None]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(10)), "text": texts})
    got = [b.column("text").to_pylist() for b in common.in_slices(iter([batch]), 4, 100)]
    assert got == [texts[:2], texts[2:3], texts[3:4], texts[4:8], texts[8:]]


def test_a_worker_stays_small_on_many_long_texts(tmp_path):
    """500 texts of 20,000 words, as one large batch, on both encoding paths."""
    script = tmp_path / "grow.py"
    script.write_text("""
import random, resource, sys
import pyarrow as pa
from adpulse.llm import quality_rules
from adpulse.llm.common import bpe, in_slices
from adpulse.llm.queries import tokenizer_file
rnd = random.Random(1)
letters = "etaoinshrdlu"
vocabulary = ["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 9))) for _ in range(200_000)]
batch = pa.RecordBatch.from_pydict({"text": [" ".join(rnd.choices(vocabulary, k=20_000)) for _ in range(500)]})
cache, vocab = bpe(tokenizer_file("byte_bpe_50k.json")), tokenizer_file("piece_bpe_32k.model")
def peak():
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
cache.ids(vocabulary[:100])
quality_rules.judge([""], [None], vocab, quality_rules.BANDS)
before = peak()
for part in in_slices(iter([batch])):
    cache.ids(part.column("text").to_pylist())
bpe_grown = peak() - before
for part in in_slices(iter([batch])):
    quality_rules.judge(part.column("text").to_pylist(), [None] * part.num_rows, vocab, quality_rules.BANDS)
print(bpe_grown, peak() - before - bpe_grown)
""")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, str(script)], env={**os.environ, "PYTHONPATH": root + ":" + os.environ.get("PYTHONPATH", "")},
                         capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr
    assert all(x < 150 for x in map(int, out.stdout.split())), out.stdout


def crc32c(data: bytes) -> int:
    """Bit by bit."""
    r = 0xFFFFFFFF
    for b in data:
        r ^= b
        for _ in range(8):
            r = (r >> 1) ^ (0x82F63B78 if r & 1 else 0)
    return r ^ 0xFFFFFFFF


def test_masked_checksums():
    assert crc32c(b"123456789") == 0xE3069283  # the published check value
    rnd = random.Random(2)
    buffers = [rnd.randbytes(rnd.choice([4, 5, 8, 511, 512, 513, 1500, 3000])) for _ in range(60)]
    want = [(((c := crc32c(x)) >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF for x in buffers]
    assert token_records.masked_crc32c(buffers).tolist() == want
    assert token_records.masked_crc32c(buffers, 8).tolist() == want


def brute_records(docs, encode, end_id):
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()), key=lambda r: r[:2])
    return [(d if known else None, np.array([*encode(t), end_id], "<u4")) for known, d, t in rows]


@pytest.mark.parametrize("table", ["odd_docs", "no_docs"])
def test_records_round_trip(request, encode, table):
    docs = request.getfixturevalue(table)
    got = token_records.read_records(token_records.write_records(docs, FILE, 2), with_ids=True).collect()
    got.sort(key=lambda r: r.start)
    at = 0
    for r in got:  # gapless, with ids in ascending order, nulls first
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += r.n_tokens
    want = brute_records(docs, encode, 2)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted([(r.doc_id, r.ids) for r in got], key=key) == sorted([(d, x.tolist()) for d, x in want], key=key)
    assert [r.doc_id for r in got] == [d for d, _ in want]


def test_a_broken_record_is_found(spark, make_docs):
    manifest = token_records.write_records(make_docs([(1, "some words here")]), FILE, 2)
    path = manifest.first().path.removeprefix("file://")
    with open(path, "r+b") as f:
        f.seek(25)
        f.write(b"\xff")
    with pytest.raises(Exception, match="fails its check"):
        token_records.read_records(manifest).collect()


def test_names_of_object_stores(tmp_path):
    assert token_records.storage(f"file://{tmp_path}")[1] == str(tmp_path)
    try:
        token_records.storage("s3a://bucket/folder?region=xx-none-1")
    except Exception as e:
        assert "Unrecognized filesystem type" not in str(e)


def test_wide_ids_and_index(make_docs):
    ids = np.array([1, 70_000], "<u4")
    assert token_records.unpack(token_records.payload(-5, ids))[0] == -5
    assert token_records.unpack(token_records.payload(None, ids))[1].tolist() == [1, 70_000]


def check_packing(docs, got, encode, end_id, capacity):
    want = {}
    for r in docs if not hasattr(docs, "collect") else docs.collect():
        ids = np.array([*encode(r.text), end_id], "<u4")
        want.setdefault(r.doc_id, []).append(ids)
    used: dict = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    tokens = sum(r.length for r in got)
    assert tokens == sum(len(x) for same in want.values() for x in same)
    by_doc: dict = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert by_doc.keys() == want.keys()
    whole = cut = 0
    for doc_id, rows in by_doc.items():
        # every id of every row of this id once: pieces that start with an id's text
        assert sorted(r.doc_tokens for r in rows if r.start == 0) == sorted(map(len, want[doc_id]))
        if len(want[doc_id]) == 1:
            at, ids = 0, want[doc_id][0]
            for r in sorted(rows, key=lambda r: r.start):
                assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
                at += r.length
            assert at == len(ids)
            if len(ids) <= capacity:
                whole, cut = whole + (len(rows) == 1), cut + (len(rows) > 1)
    return used, tokens, whole, cut


@pytest.mark.parametrize("table", ["odd_docs", "no_docs"])
def test_packing_is_whole(request, encode, table):
    docs = request.getfixturevalue(table)
    for parts in (1, 5):
        for capacity in (1024, 8):
            check_packing(docs, packing.pack(docs.repartition(parts), FILE, 0, capacity).collect(), encode, 0, capacity)


def test_packing_keeps_documents_and_wastes_little(spark, encode):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = packing.pack(docs.coalesce(1), FILE, 0, 1024).collect()
    used, tokens, whole, cut = check_packing(docs, got, encode, 0, 1024)
    assert len(used) * 1024 - tokens < 1024  # one task: less than one sequence of padding
    assert cut < 0.02 * whole
    assert [r.ids for r in packing.pack(docs.limit(3), FILE, 0, 1024, with_ids=True).collect()]


def test_whole_groups_keeps_keys_together():
    keys = [1, 1, 2, 2, 2, 2, 3, 5, 5, 5, 6]
    for size in (1, 2, 3, 4, 11):
        batches = [pa.RecordBatch.from_pydict({"k": keys[i:i + size]}) for i in range(0, len(keys), size)]
        out = [t.column("k").to_pylist() for t in whole_groups(iter(batches), "k")]
        assert sum(out, []) == keys
        assert not any(set(a) & set(b) for i, a in enumerate(out) for b in out[i + 1:])


def test_other_columns_are_ignored(odd_docs):
    assert documents(odd_docs.withColumn("x", F.lit(1))).columns == ["doc_id", "text"]
