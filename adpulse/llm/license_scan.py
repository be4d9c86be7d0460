"""Licence scan by matching statistics over a generalised suffix automaton.

The automaton of all templates' words (built once on the driver, a few states a word)
accepts every run of words that is in any template. Each text streams through it word by
word: at every place the state and length give the longest run ending there that some
template holds. Words that no template has reset it, so runs of them are skipped whole.

Phrases are templates that must be there in full: one is found where a match reaches its
state and length. The other templates are found in part: matches that cannot be extended
are chained, in the same order in text and template and with small gaps; a chain that
covers enough of the template's words is a span with its label. Of spans of several
templates that lie in one another the widest says which licence it is (the notices of a
family begin alike); at the same place the one that is covered best.

Each text is scanned by itself in one pass without a shuffle.

Defined cases: null and empty texts have no words, no places and score 0; places of a
phrase may overlap; repeated rows are scanned each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from adpulse.llm.common import documents, in_slices, lower_words

# Phrases and the labels that go with them.
PHRASES: Mapping[str, str] = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Well-known notices of public licences, by SPDX name, or by the phrases'
# label where there is one: a licence has one label.
TEMPLATES: Sequence[tuple[str, str]] = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
            "and associated documentation files, to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "The MIT License (MIT)"),
    ("MIT-0", "MIT No Attribution"),
    ("apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file except in "
                 "compliance with the License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                 "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("Apache-1.1", "The Apache Software License, Version 1.1"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
                     "permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
                     "or promote products derived from this software without specific prior written permission"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-2-Clause", "The views and conclusions contained in the software and documentation are those of the authors and "
                     "should not be interpreted as representing official policies"),
    ("BSD-4-Clause", "All advertising materials mentioning features or use of this software must display the following "
                     "acknowledgement: This product includes software developed by"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
             "hereby granted"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("ISC", "Licensed under the ISC License"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
             "held liable for any damages arising from the use of this software"),
    ("Zlib", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("GPL-1.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation; either version 1, or (at your option) any "
                "later version"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
                "option) any later version"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License version 2 as published by the Free Software Foundation"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the "
                "GNU General Public License as published by the Free Software Foundation, either version 3 of "
                "the License, or (at your option) any later version"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library "
                 "General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
                 "General Public License as published by the Free Software Foundation; either version 2.1 of the License, "
                 "or (at your option) any later version"),
    ("LGPL-3.0", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, "
                 "either version 3 of the License, or (at your option) any later version"),
    ("AGPL-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
                 "either version 3 of the License, or (at your option) any later version"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("GFDL-1.2", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free "
                 "Documentation License, Version 1.2 or any later version published by the Free Software Foundation"),
    ("GFDL-1.3", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free "
                 "Documentation License, Version 1.3 or any later version published by the Free Software Foundation"),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may "
                "not use this file except in compliance with the License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "Licensed under the Mozilla Public License 2.0"),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the "
                "Eclipse Public License v1.0 which accompanies this distribution"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public "
                "License 2.0 which is available at"),
    ("CDDL-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License "
                 "(the \"License\"). You may not use this file except in compliance with the License"),
    ("CPL-1.0", "made available under the terms of the Common Public License v1.0"),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2"),
    ("EUPL-1.1", "Licensed under the EUPL, Version 1.1"),
    ("OSL-3.0", "Licensed under the Open Software License version 3.0"),
    ("AFL-3.0", "Licensed under the Academic Free License version 3.0"),
    ("ECL-2.0", "Licensed under the Educational Community License, Version 2.0"),
    ("Artistic-1.0", "it under the terms of the Artistic License"),
    ("Artistic-2.0", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it "
                     "is not allowed. Preamble This license establishes the terms under which a given free software Package "
                     "may be copied, modified, distributed, and/or redistributed"),
    ("Artistic-2.0", "Licensed under the Artistic License 2.0"),
    ("LPPL-1.3c", "This work may be distributed and/or modified under the conditions of the LaTeX Project Public License, "
                  "either version 1.3c of this license or (at your option) any later version"),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1"),
    ("PSF-2.0", "Python Software Foundation License Version 2"),
    ("PostgreSQL", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, "
                   "without fee, and without a written agreement is hereby granted, provided that the above copyright notice "
                   "and this paragraph and the following two paragraphs appear in all copies"),
    ("NCSA", "University of Illinois/NCSA Open Source License"),
    ("OpenSSL", "This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit"),
    ("PHP-3.01", "This source file is subject to version 3.01 of the PHP license"),
    ("MS-PL", "Microsoft Public License (Ms-PL)"),
    ("MS-RL", "Microsoft Reciprocal License (Ms-RL)"),
    ("UPL-1.0", "Licensed under the Universal Permissive License v 1.0"),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
                  "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights "
                "to this software to the public domain worldwide"),
    ("CC0-1.0", "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication"),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
                 "International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International "
                        "License"),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 "
                        "International License"),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("ODbL-1.0", "This database is made available under the Open Database License"),
    ("PDDL-1.0", "made available under the Public Domain Dedication and License v1.0"),
    ("ODC-By-1.0", "made available under the Open Data Commons Attribution License"),
)
#: Matches of fewer words are no part of a chain; gaps between its matches are at most GAP words.
LEAST_MATCH, GAP = 3, 6
#: A span covers at least this share of its template's words.
LEAST_SHARE = 0.7
SCANNED = ("doc_id long, n_words long, places array<struct<first: long, label: string>>, "
           "spans array<struct<first: long, last: long, label: string, share: double>>, score double")


@dataclass
class Automaton:
    """Generalised suffix automaton over the words of many templates."""
    words: dict[bytes, int] = field(default_factory=dict)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: (template, place of the last word) of the state's runs
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])
    #: (words, phrase) of the phrases that end wherever the state's runs end
    phrases: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        self.phrases.append([])
        return len(self.step) - 1

    def _split(self, p: int, word: int) -> int:
        """The state of exactly p's longest run and the word."""
        q = self.step[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        own = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = own
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = own
            p = self.link[p]
        return own

    def _extend(self, last: int, word: int) -> int:
        if word in self.step[last]:
            return self._split(last, word)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and word not in self.step[p]:
            self.step[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word)
        return new

    def add(self, number: int, words: list[bytes]) -> None:
        state = 0
        for i, w in enumerate(words):
            state = self._extend(state, self.words.setdefault(w, len(self.words)))
            self.ends[state].append((number, i))

    def finish(self, phrases: list[list[bytes]]) -> Automaton:
        """Hands every state's ends to the states of its suffixes, and each phrase
        to the states whose runs end with it."""
        order = sorted(range(1, len(self.step)), key=self.length.__getitem__)
        for s in reversed(order):
            self.ends[self.link[s]] += self.ends[s]
        self.ends[0] = []
        self.ends = [sorted(set(e)) for e in self.ends]
        for number, words in enumerate(phrases):
            s = 0
            for w in words:
                s = self.step[s][self.words[w]]
            self.phrases[s].append((len(words), number))
        for s in order:
            self.phrases[s] = self.phrases[self.link[s]] + self.phrases[s]
        return self


def build(templates: list[list[bytes]], phrases: list[list[bytes]]) -> Automaton:
    automaton = Automaton()
    for i, words in enumerate([*templates, *phrases]):
        automaton.add(i, words)
    return automaton.finish(phrases)


def matches(automaton: Automaton, words: list[bytes], shortest: int) -> tuple[list, list]:
    """Phrase places (first word, phrase), and the matches that cannot be extended
    as (first word, number of words, state)."""
    ids = np.array([automaton.words.get(w, -1) for w in words], dtype=np.int64)
    known = np.flatnonzero(ids >= 0)
    places, found = [], []
    if not len(known):
        return places, found
    step, link, length_of, phrases = automaton.step, automaton.link, automaton.length, automaton.phrases
    for run in np.split(known, np.flatnonzero(np.diff(known) > 1) + 1):
        if len(run) < shortest:
            continue
        at, state, length = int(run[0]), 0, 0
        for i, word in enumerate(ids[run].tolist(), at):
            if word not in step[state]:
                if length >= LEAST_MATCH:
                    found.append((i - length, length, state))
                while word not in step[state]:
                    state = link[state]
                length = length_of[state]
            state = step[state][word]
            length += 1
            for n, phrase in phrases[state]:
                if n <= length:
                    places.append((i + 1 - n, phrase))
        if length >= LEAST_MATCH:
            found.append((int(run[-1]) + 1 - length, length, state))
    return places, found


def chains(automaton: Automaton, found: list[tuple[int, int, int]], sizes: list[int]) -> Iterator[tuple[int, int, int, float]]:
    """(first word, last word, template, share covered) of the best chain of each
    run of matches that lie near each other."""
    by_template: dict[int, list[tuple[int, int, int]]] = {}
    for first, n, state in found:
        for template, end in automaton.ends[state]:
            if template < len(sizes):
                by_template.setdefault(template, []).append((first, end + 1 - n, n))
    for template, own in by_template.items():
        own.sort()
        # (words covered, first word of the chain), by its last match
        best: list[tuple[int, int]] = []
        near = 0
        groups: list[tuple[int, int, int]] = []
        for i, (first, place, n) in enumerate(own):
            while own[near][0] + own[near][2] + GAP + sizes[template] < first:
                near += 1
            chain = (n, first)
            for j in range(near, i):
                f, p, m = own[j]
                if 0 <= first - (f + m) <= GAP and 0 <= place - (p + m) <= GAP and best[j][0] + n > chain[0]:
                    chain = (best[j][0] + n, best[j][1])
            best.append(chain)
            entry = (chain[0], chain[1], first + n - 1)
            # of chains that overlap in the text, the one that covers most
            if groups and chain[1] <= groups[-1][2]:
                groups[-1] = max(groups[-1], entry, key=lambda g: g[0])
            else:
                groups.append(entry)
        for covered, first, last in groups:
            yield first, last, template, min(1.0, covered / sizes[template])


def outermost(spans: list[tuple[int, int, int, float]], sizes: list[int]) -> list[tuple[int, int, int, float]]:
    """The spans that cover enough of their template and lie in no other such span, by
    place. Of spans at the same place those stay that cover most words of their template,
    and of these the shortest template's."""
    own = sorted((s for s in spans if s[3] >= LEAST_SHARE), key=lambda s: (s[0], -s[1], -s[3] * sizes[s[2]], sizes[s[2]], s[2]))
    out: list[tuple[int, int, int, float]] = []
    for s in own:  # a span that starts later lies in an earlier one that reaches its end
        if not out or s[1] > out[-1][1]:
            out.append(s)
        elif (s[0], s[1]) == (out[-1][0], out[-1][1]) and s[3] * sizes[s[2]] == out[-1][3] * sizes[out[-1][2]] \
                and sizes[s[2]] == sizes[out[-1][2]]:
            out.append(s)
    return out


def scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES,
         templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, the places of phrases, the spans of templates, and the
    largest share of a template covered, of every document."""
    phrase_words = [lower_words(p) for p in phrases]
    phrase_labels = list(phrases.values())
    template_words = [lower_words(t) for _, t in templates]
    labels, sizes = [label for label, _ in templates], [len(w) for w in template_words]
    shortest = min([LEAST_MATCH, *map(len, phrase_words)])
    sent = docs.sparkSession.sparkContext.broadcast(build(template_words, phrase_words))

    def one(automaton: Automaton, text: str) -> tuple:
        words = lower_words(text)
        places, found = matches(automaton, words, shortest)
        spans = list(chains(automaton, found, sizes))
        score = 1.0 if places else max([s for *_, s in spans], default=0.0)
        return (len(words), [{"first": f, "label": phrase_labels[p]} for f, p in places],
                [{"first": f, "last": e, "label": labels[t], "share": s} for f, e, t, s in outermost(spans, sizes)], score)

    places_type = pa.list_(pa.struct([("first", pa.int64()), ("label", pa.string())]))
    spans_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()),
                                     ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = sent.value
        for batch in in_slices(batches):
            rows = [one(automaton, x) for x in batch.column("text").to_pylist()]
            kinds = [pa.int64(), places_type, spans_type, pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]],
                names=["doc_id", "n_words", "places", "spans", "score"])

    return documents(docs).mapInArrow(run, SCANNED)
