from __future__ import annotations

import random
import re

import pytest
from llm.conftest_llm import rows_of

from adpulse.llm import license_scan
from adpulse.llm.queries import QUERIES

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = sorted((i, label) for p, label in PHRASES.items() for i in range(len(words))
                    if words[i:i + len(p.split())] == p.split())
    return len(words), places


@pytest.mark.parametrize("table", ["odd_docs", "no_docs"])
def test_odd_tables(request, table):
    docs = request.getfixturevalue(table)
    got = license_scan.scan(docs)
    want = [(r.doc_id, brute(r.text)[0], 0.0) for r in docs.collect()]
    assert rows_of(got, "doc_id", "n_words", "score") == sorted(
        want, key=lambda r: [(x is not None, x if x is not None else 0) for x in r])


def test_places_equal_brute_force(make_docs):
    rnd = random.Random(6)
    vocabulary = "under the mit license apache version 2 cc by nc Cc BY-NC, x é 0".split(" ")
    rows = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 300)))) for i in range(150)]
    rows += [(900, "Released under the MIT License. cc by nc cc by nc. Under, the mit license"), (901, "cc by cc by nc nc")]
    got = {r.doc_id: (r.n_words, sorted((p.first, p.label) for p in r.places)) for r in license_scan.scan(make_docs(rows)).collect()}
    assert got == {d: brute(t) for d, t in rows}
    assert sum(len(p) for _, p in got.values()) > 20


def test_automaton_accepts_the_runs_of_its_templates_only():
    rnd = random.Random(8)
    for _ in range(60):
        templates = [[rnd.choice([b"a", b"b", b"c"]) for _ in range(rnd.randint(1, 12))] for _ in range(4)]
        a = license_scan.build(templates, [])
        def longest(words, end):  # noqa: E306
            return max(n for n in range(end + 1) if any(words[end - n:end] == t[i:i + n]
                                                        for t in templates for i in range(len(t) - n + 1)))
        words = [rnd.choice([b"a", b"b", b"c", b"d"]) for _ in range(40)]
        stats = [longest(words, e + 1) for e in range(40)]
        want = {(e + 1 - n, n) for e, n in enumerate(stats) if n >= 3 and (e == 39 or stats[e + 1] != n + 1)}
        _, found = license_scan.matches(a, words, 1)
        # a match ends where the next word does not extend it
        assert {(f, n) for f, n, _ in found} == {(f, n) for f, n in want}
        for first, n, state in found:
            for t, end in a.ends[state]:
                assert templates[t][end + 1 - n:end + 1] == words[first:first + n]


def test_templates_are_found_in_part(make_docs):
    mit = license_scan.TEMPLATES[0][1]
    changed = mit.replace("hereby granted", "now given").replace("publish, distribute,", "publish & distribute,")
    rows = [(1, "Some code. " + mit), (2, "x " + changed + " y"), (3, " ".join(mit.split()[:8])),
            (4, "the rights of any person to use this software and the limitation of copies"),
            (5, "This work is licensed under the GNU General Public License, version 3.")]
    got = {r.doc_id: r for r in license_scan.scan(make_docs(rows)).collect()}
    assert [s.label for s in got[1].spans] == ["mit"] and got[1].spans[0].share == 1.0 and got[1].spans[0].first == 2
    assert [s.label for s in got[2].spans] == ["mit"] and 0.7 <= got[2].spans[0].share < 1.0
    assert not got[3].spans and not got[4].spans and 0 < got[3].score < 0.5
    assert [s.label for s in got[5].spans] == ["GPL-3.0"]


def brute_chains(templates, words):
    """(first, last, template, covered) of the best chain of each group of overlapping ones,
    from every run that can't be extended and every way to link them."""
    runs = []
    for end in range(len(words)):
        n = max((n for n in range(end + 2) if any(words[end + 1 - n:end + 1] == t[i:i + n]
                                                  for t in templates for i in range(len(t) - n + 1))), default=0)
        further = end + 1 < len(words) and any(words[end + 1 - n:end + 2] == t[i:i + n + 1]
                                               for t in templates for i in range(len(t) - n))
        if n >= license_scan.LEAST_MATCH and not further:
            runs.append((end + 1 - n, n))
    out = []
    for number, t in enumerate(templates):
        own = sorted((f, i, n) for f, n in runs for i in range(len(t) - n + 1) if t[i:i + n] == words[f:f + n])

        def longest(m):  # the most words of a chain that ends with m, and its first word; the earliest of equals
            best = (m[2], m[0])
            for o in own[:own.index(m)]:
                if 0 <= m[0] - (o[0] + o[2]) <= license_scan.GAP and 0 <= m[1] - (o[1] + o[2]) <= license_scan.GAP:
                    covered, first = longest(o)
                    if covered + m[2] > best[0]:
                        best = (covered + m[2], first)
            return best

        groups = []
        for m in own:
            covered, first = longest(m)
            entry = (covered, first, m[0] + m[2] - 1)
            if groups and first <= groups[-1][2]:
                groups[-1] = entry if covered > groups[-1][0] else groups[-1]
            else:
                groups.append(entry)
        out += [(f, e, number, covered) for covered, f, e in groups]
    return sorted(out)


def test_chains_equal_brute_force():
    rnd = random.Random(9)
    some = 0
    for _ in range(150):
        letters = [b"a", b"b", b"c", b"d", b"e"][:rnd.choice([3, 5])]
        templates = [[rnd.choice(letters) for _ in range(rnd.randint(4, 14))] for _ in range(3)]
        words = []
        for _ in range(rnd.randint(1, 3)):  # templates with words changed, left out and put in
            for w in rnd.choice(templates):
                words += rnd.choice([[w], [w], [w], [w], [w, b"x"], [], [rnd.choice(letters)]])
            words += [b"x"] * rnd.choice([0, 2, 9])
        a = license_scan.build(templates, [])
        sizes = [len(t) for t in templates]
        _, found = license_scan.matches(a, words, 1)
        got = sorted((f, e, t, round(s * sizes[t])) for f, e, t, s in license_scan.chains(a, found, sizes))
        want = [(f, e, t, min(covered, sizes[t])) for f, e, t, covered in brute_chains(templates, words)]
        assert got == want
        some += sum(covered > 6 for *_, covered in want)
    assert some > 30


def test_every_licence_has_one_label(make_docs):
    templates = license_scan.TEMPLATES
    assert len({label for label, _ in templates}) >= 50
    assert not {"MIT", "Apache-2.0", "CC-BY-NC-4.0"} & {label for label, _ in templates}
    rows = [(i, f"Notes on 12 things.\n# {text}.\nOther words follow") for i, (_, text) in enumerate(templates)]
    got = {r.doc_id: r for r in license_scan.scan(make_docs(rows)).collect()}
    for i, (label, _) in enumerate(templates):
        assert {s.label for s in got[i].spans} | {p.label for p in got[i].places} == {label}


def test_spans_in_one_another():
    spans = [(0, 9, 0, 1.0), (0, 19, 1, 0.8), (5, 19, 2, 1.0), (30, 39, 0, 1.0), (30, 39, 2, 0.7), (38, 50, 1, 0.9), (60, 61, 0, 0.5)]
    assert license_scan.outermost(spans, [10, 25, 15]) == [(0, 19, 1, 0.8), (30, 39, 2, 0.7), (38, 50, 1, 0.9)]


def test_the_query_keeps_base_labels(spark):
    rows = QUERIES["op5_license_scan"](spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for r in rows:
        n, places = brute(texts[r.doc_id])
        starts = [f for f, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert any(r.n_base for r in rows) and any("GPL-3.0" in r.labels for r in rows)
