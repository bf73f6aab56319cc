"""Licence scans with a generalised suffix automaton over the words of licence templates.

The automaton of all templates (a few hundred words, built once per task) is fed a file's
words; after each word it knows the longest stretch ending there that occurs in some
template (the matching statistics), and by its suffix links the longest one of every other
template. Stretches of at least ``min_words`` words (or a whole shorter template) that their
own template does not continue are chained, template by template, in template order; a chain
that covers enough of its template is a span with that licence's label. So a short notice counts
also where the text goes on as another template does. Phrases are further strings of
the same automaton: a phrase ends at a word exactly if its node is the current state or one
of its suffix-link ancestors.

Words are streamed: only runs of word pairs that occur in some template reach the
automaton (a match of two words or more has no other pair). One scan, one Arrow map, no shuffle.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import AZ, documents, identifier, keep_columns, pieces, texts

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
RESULT = ["n_words", "base", "license_spans"]

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Short notices and the public licences' own grant and notice paragraphs.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("mit", """The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the
warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or
copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise,
arising from, out of or in connection with the software or the use or other dealings in the software."""),
    ("bsd", """This software is provided by the copyright holders and contributors "as is" and any express or implied warranties,
including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are
disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special,
exemplary, or consequential damages"""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("mpl", "Mozilla Public License Version 2.0"),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any
later version."""),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version."""),
    ("agpl", "GNU Affero General Public License"),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions"""),
    ("bsl", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so"""),
    ("epl", """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is
available at https://www.eclipse.org/legal/epl-2.0/"""),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution NoDerivatives 4.0 International License."),
    ("cc0", """To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this
software to the public domain worldwide. This software is distributed without any warranty."""),
]


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate(AZ))


class Automaton:
    """Generalised suffix automaton of word strings; ``ends[state]``: (string, end) pairs."""

    def __init__(self, strings: list[list[str]]):
        self.strings = strings
        self.vocab = {w: i for i, w in enumerate(dict.fromkeys(w for s in strings for w in s))}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        own: list[list[tuple[int, int]]] = [[]]
        for k, s in enumerate(strings):
            last = 0
            for end, w in enumerate(s):
                last = self._extend(last, self.vocab[w])
                while len(own) < len(self.next):
                    own.append([])
                own[last].append((k, end))
        self.ends = [list(x) for x in own]
        for v in sorted(range(1, len(self.next)), key=lambda v: -self.size[v]):
            self.ends[self.link[v]] += self.ends[v]
        n = len(self.vocab)
        self.pairs = np.zeros(n * n, bool)
        for s in strings:
            for a, b in zip(s, s[1:], strict=False):
                self.pairs[self.vocab[a] * n + self.vocab[b]] = True

    def _node(self, size: int, nxt: dict, link: int) -> int:
        self.next.append(nxt)
        self.size.append(size)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """A state for the strings of ``q`` that end a path through ``p``."""
        clone = self._node(self.size[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.size[q] == self.size[last] + 1 else self._split(last, q, c)
        cur, p = self._node(self.size[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, c)
        return cur

    def state(self, words: list[str]) -> int:
        v = 0
        for w in words:
            v = self.next[v][self.vocab[w]]
        return v

    def statistics(self, codes: list[int]) -> Iterator[tuple[int, int]]:
        """(state, matched length) after each word code; -1 is a word of no string."""
        v = n = 0
        for c in codes:
            while v and c not in self.next[v]:
                v = self.link[v]
                n = self.size[v]
            if c in self.next[v]:
                v = self.next[v][c]
                n += 1
            yield v, n

    def runs(self, words: list[str]) -> Iterator[tuple[int, list[int]]]:
        """(first word, codes) of the maximal stretches whose neighbouring words are all pairs of some string."""
        if len(words) < 2:
            return
        get = self.vocab.get
        code = np.array([get(w, -1) for w in words], np.int64)
        known = (code[:-1] >= 0) & (code[1:] >= 0)
        known[known] = self.pairs[code[:-1][known] * len(self.vocab) + code[1:][known]]
        if not known.any():
            return
        edge = np.diff(np.concatenate([[0], known.astype(np.int8), [0]]))
        for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            yield i, code[i:j + 1].tolist()


class Scanner:
    def __init__(self, templates, phrases, min_words: int, max_gap: int, coverage: float):
        self.labels = [label for label, _ in templates]
        strings = [words_of(t) for _, t in templates]
        self.length = [len(s) for s in strings]
        self.max_gap, self.coverage = max_gap, coverage
        self.need = [max(2, min(min_words, n)) for n in self.length]       # words a stretch must have
        self.least = min(self.need, default=2)
        found = [(words_of(p), label) for p, label in phrases]
        self.phrase = [(len(p), label) for p, label in found]
        self.sam = Automaton(strings + [p for p, _ in found])
        at = {}
        for k, (p, _) in enumerate(found):
            at.setdefault(self.sam.state(p), []).append(k)
        # phrases that are a suffix of the state's strings: its own, then its ancestors'
        self.tails = [[] for _ in self.sam.next]
        for v in sorted(range(len(self.sam.next)), key=lambda v: self.sam.size[v]):
            self.tails[v] = at.get(v, []) + (self.tails[self.sam.link[v]] if v else [])

    def scan(self, words: list[str]) -> tuple[list, list]:
        """Phrase places (label, first word) and covered template spans (label, first, last, coverage)."""
        base, hits = [], []
        for first, codes in self.sam.runs(words):
            last: dict[tuple[int, int], int] = {}
            for i, (v, n) in enumerate(self.sam.statistics(codes)):
                for k in self.tails[v]:
                    if n >= self.phrase[k][0]:
                        base.append((self.phrase[k][1], first + i - self.phrase[k][0] + 1))
                now = self._matches(v, n)
                hits += self._ended(last, now, first + i - 1)
                last = now
            hits += self._ended(last, {}, first + len(codes) - 1)
        return base, self._chain(hits)

    def _matches(self, v: int, n: int) -> dict[tuple[int, int], int]:
        """(template, its word) -> how many words up to here are the template's up to that word: the
        state's strings by the whole match, its suffix-link ancestors' by their own lengths."""
        out: dict[tuple[int, int], int] = {}
        while v and n >= self.least:
            for k, end in self.sam.ends[v]:
                if k < len(self.length) and n >= self.need[k]:
                    out.setdefault((k, end), n)
            v = self.sam.link[v]
            n = self.sam.size[v]
        return out

    @staticmethod
    def _ended(last: dict, now: dict, at: int) -> list[tuple[int, int, int, int]]:
        """Matches up to text word ``at`` that their own template does not continue."""
        return [(k, at - n + 1, end - n + 1, n) for (k, end), n in last.items() if now.get((k, end + 1)) != n + 1]

    def _chain(self, hits: list[tuple[int, int, int, int]]) -> list:
        """hits: (template, text start, template start, words) -> spans of chains."""
        spans = []
        for k in sorted({h[0] for h in hits}):
            mine = sorted(h[1:] for h in hits if h[0] == k)
            score, back = [], []
            for j, (t, p, n) in enumerate(mine):
                best, prev = n, -1
                for i in range(j - 1, -1, -1):
                    ti, pi, ni = mine[i]
                    if t - (ti + ni) > self.max_gap + self.length[k]:
                        break
                    gain = min(n, t + n - ti - ni, p + n - pi - ni)       # words the overlap leaves
                    if ti < t and pi < p and gain > 0 and t - (ti + ni) <= self.max_gap and score[i] + gain > best:
                        best, prev = score[i] + gain, i
                score.append(best)
                back.append(prev)
            used = [False] * len(mine)
            for j in sorted(range(len(mine)), key=lambda j: (-score[j], j)):
                chain, i = [], j
                while i >= 0 and not used[i]:
                    chain.append(i)
                    i = back[i]
                total = score[j] - (score[i] if i >= 0 else 0)
                if not chain or total < self.coverage * self.length[k]:
                    continue
                for i in chain:
                    used[i] = True
                spans.append((self.labels[k], mine[chain[-1]][0], mine[j][0] + mine[j][2] - 1, min(1.0, total / self.length[k])))
        return sorted(spans, key=lambda s: (s[1], s[2], s[0]))


@functools.lru_cache(maxsize=4)
def _scanner(templates, phrases, min_words, max_gap, coverage) -> Scanner:
    return Scanner(templates, phrases, min_words, max_gap, coverage)


def scan_licenses(docs: DataFrame, templates=None, phrases=None, text_col: str = "text", min_words: int = 4, max_gap: int = 12,
                  coverage: float = 0.6) -> DataFrame:
    """``docs`` with ``n_words``, ``base`` and ``license_spans``.

    ``base``: array of (label, word), the places where a phrase's words stand in a row;
    ``license_spans``: array of (label, first_word, last_word, coverage), word positions from
    0, for chains covering at least ``coverage`` of a template. Texts are lower-cased in A-Z
    only and scanned whole; a NULL or empty text has no words. Rows are independent, so
    repeated rows and NULL identifiers need no care; an empty table gives an empty result; input
    columns named like a result column give way.
    """
    args = (tuple(templates or TEMPLATES), tuple((PHRASES if phrases is None else phrases).items()), min_words, max_gap, coverage)
    carried = keep_columns(docs, RESULT)
    place = T.StructType([T.StructField("label", T.StringType()), T.StructField("word", T.LongType())])
    span = T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()),
                         T.StructField("last_word", T.LongType()), T.StructField("coverage", T.DoubleType())])
    schema = T.StructType([docs.schema[c] for c in carried] + [
        T.StructField("n_words", T.LongType()), T.StructField("base", T.ArrayType(place)), T.StructField("license_spans", T.ArrayType(span))])
    arrow_place = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    arrow_span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("coverage", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(*args)
        for b in pieces(batches, text_col):
            n, base, spans = [], [], []
            for t in texts(b.column(text_col)):
                words = words_of(t)
                p, s = scanner.scan(words)
                n.append(len(words))
                base.append([{"label": x, "word": w} for x, w in p])
                spans.append([{"label": x, "first_word": i, "last_word": j, "coverage": c} for x, i, j, c in s])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(base, arrow_place), pa.array(spans, arrow_span)],
                                             names=schema.names)

    return docs.select(*[F.col(identifier(c)) for c in carried]).mapInArrow(run, schema)


def read_templates(spark, path: str) -> list[tuple[str, str]]:
    """Templates as data: every text file under ``path`` is one, named ``<label>.txt`` or
    ``<label>-<anything>.txt`` with two hyphens between. They are held by every task, so the
    folder is meant for licence texts (a few megabytes), not for a corpus."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:--.*)?\.txt$", 1)
    rows = spark.read.option("wholetext", True).text(path).select(name.alias("label"), "value").collect()
    return sorted((r.label, r.value) for r in rows if r.label)


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licence phrases and template spans in every whole text of ``documents``."""
    s = scan_licenses(documents(spark, sf_dir).select("doc_id", "text"))
    listed = lambda *c: F.array_join(F.array_sort(F.array_distinct(F.concat(*c))), ",")
    return s.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"), listed("base.label").alias("base_labels"),
        listed("base.label", "license_spans.label").alias("labels"),
        F.coalesce(F.array_max("license_spans.coverage"), F.lit(0.0)).alias("score"))
