"""License scan with a positional rare-token index.

Each template's words are posted with their positions, rarest first: IDF is counted over all files.
Of a file, the highest-IDF licence words of every template whose key-phrase words it all holds are
looked up; postings that agree on the relative position (file position less template position) vote
for one alignment of one template, and an alignment is believed if the set share of the template
stands in its place and all mandatory key phrases stand in the file near theirs.

So many of a template's rarest words are looked up that no alignment can escape: where a share s of
L words is in place, at most (1 - s) L are not, so of any (1 - s) L + 2 at least two are.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table

#: Phrases that count by themselves, wherever their words stand consecutively.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: label, licence text or notice (case and punctuation do not matter), mandatory key phrases. Texts of the licences as published; fixed values.
TEMPLATES = (
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "The MIT License (MIT)", ("the mit license",)),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
        IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
        COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
        THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", ("permission is hereby granted free of charge", "without restriction")),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
        ("permission is hereby granted free of charge", "without restriction")),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and
        this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS.""", ("for any purpose with or without fee is hereby granted",)),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of
        source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
        ("redistribution and use in source and binary forms", "following conditions are met", "redistributions in binary form must reproduce")),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms", "following conditions are met")),
    ("apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License", ("apache license version 2",)),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License
        at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
        License.""", ("apache license version 2", "distributed on an as is basis")),
    ("apache-2", "Apache License Version 2.0, January 2004 TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", ("apache license version 2", "terms and conditions for use reproduction and distribution")),
    ("apache-2", "SPDX-License-Identifier: Apache-2.0", ("license identifier apache 2",)),
    ("mit", "SPDX-License-Identifier: MIT", ("license identifier mit",)),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later", ("license identifier gpl",)),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause", ("license identifier bsd",)),
    ("cc-by-nc", "licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4",)),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", ("gnu general public license",)),
    ("gpl", """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU General Public License for more details.""", ("in the hope that it will be useful", "gnu general public license")),
    ("lgpl", "under the terms of the GNU Lesser General Public License", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the GNU Affero General Public License", ("gnu affero general public license",)),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ("eclipse public license",)),
    ("boost-1", "Distributed under the Boost Software License, Version 1.0", ("boost software license version 1",)),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely""",
        ("without any express or implied warranty", "alter it and redistribute it freely")),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed", ("changing it is allowed as long as the name is changed",)),
    ("all-rights-reserved", "Copyright. All rights reserved.", ("all rights reserved",)),
)

#: Words of an alignment that must agree, and the share of the template that stands in place.
MIN_AGREED = 2
MIN_SHARE = 0.4
#: Words by which a key phrase may stand off its place.
SLACK = 8

#: Bytes of words [0-9a-z and all beyond ASCII] as they are, A-Z lower-cased, all others blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def places(found: list[bytes], phrase: list[bytes]) -> list[int]:
    """Starts of phrase in found, overlapping ones too."""
    first, n, out, at = phrase[0], len(phrase), [], -1
    while True:
        try:
            at = found.index(first, at + 1)
        except ValueError:
            return out
        if found[at : at + n] == phrase:
            out.append(at)


class Index:
    """Templates' postings in the order of their words' IDF, and templates by a word they cannot do without."""

    def __init__(self, templates=TEMPLATES, idf: dict[bytes, float] | None = None):
        self.labels = [t[0] for t in templates]
        self.texts = [words(t[1]) for t in templates]
        self.keys = [[words(k) for k in t[2]] for t in templates]
        self.vocabulary = frozenset(w for text in [*self.texts, *[k for keys in self.keys for k in keys]] for w in text)
        rank = lambda w: (-(idf or {}).get(w, 0.0), w)
        self.needed = [frozenset(w for k in keys for w in k) for keys in self.keys]
        self.lookups: list[dict[bytes, list[int]]] = []  # of each template: its rarest words and their positions
        self.by_needed: dict[bytes, list[int]] = defaultdict(list)
        for t, text in enumerate(self.texts):
            n = math.floor((1 - MIN_SHARE) * len(text)) + MIN_AGREED
            postings = defaultdict(list)
            for q in sorted(range(len(text)), key=lambda q: (rank(text[q]), q))[:n]:
                postings[text[q]].append(q)
            self.lookups.append(dict(postings))
            self.by_needed[min(self.needed[t] or text, key=rank)].append(t)

    def in_place(self, t: int, start: int, found: list[bytes]) -> float:
        """Share of template t that stands in found at start on."""
        text = self.texts[t]
        inside = found[max(0, start) : max(0, start + len(text))]
        return sum(a == b for a, b in zip(text[max(0, -start) :], inside)) / len(text)

    def keys_near(self, t: int, start: int, found: list[bytes]) -> bool:
        near = found[max(0, start - SLACK) : max(0, start + len(self.texts[t]) + SLACK)]
        return all(places(near, k) for k in self.keys[t])

    def scan(self, found: list[bytes], present: set[bytes]) -> list[tuple[str, int, float]]:
        """(label, start word, share of the template in place) of each believed alignment: all that have
        MIN_AGREED words and MIN_SHARE of the template in place and its key phrases near."""
        could = [t for w in present if w in self.by_needed for t in self.by_needed[w] if self.needed[t] <= present]
        if not could:
            return []
        at, wanted = defaultdict(list), {w for t in could for w in self.lookups[t]}
        for p, w in enumerate(found):
            if w in wanted:
                at[w].append(p)
        out = []
        for t in could:
            votes: Counter[int] = Counter(p - q for w, posted in self.lookups[t].items() for q in posted for p in at.get(w, ()))
            for start, agreed in votes.items():
                if agreed >= MIN_AGREED:
                    share = self.in_place(t, start, found)
                    if share >= MIN_SHARE and self.keys_near(t, start, found):
                        out.append((self.labels[t], max(0, start), share))
        return out


def document_frequency(docs: DataFrame, text: str, vocabulary: frozenset[bytes]) -> tuple[int, dict[bytes, int]]:
    """Number of files, and of files with each licence word: as many rows as the vocabulary has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        n = 0
        for batch in batches:
            n += batch.num_rows
            for t in batch.column(0):
                held.update(vocabulary.intersection(words(t.as_py())))
        yield pa.RecordBatch.from_pydict({"w": [b"", *held], "n": [n, *held.values()]}, schema=pa.schema([("w", pa.binary()), ("n", pa.int64())]))

    rows = docs.select(text).mapInArrow(count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    found = {bytes(r["w"]): r["n"] for r in rows}
    return found.pop(b"", 0), found


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, base=BASE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans per row of docs.

    spans lists the alignments as label@word, a place once for each label. score is 1 where a base phrase
    stands, else the largest share of a template in place. A null or empty text has no words and no labels (empty strings),
    null places and score 0. Texts of any length are scanned whole, a task holds the words of one at a time. Repeated rows are scanned alike; other columns are not looked at; an
    empty table gives an empty table.
    """
    known = Index(templates).vocabulary
    n, df = document_frequency(docs, text, known)
    index = Index(templates, {w: math.log((n + 1) / (df.get(w, 0) + 1)) for w in known})
    phrases = [(words(p), b" " + b" ".join(words(p)) + b" ", label) for p, label in base]
    vocabulary = index.vocabulary | {w for phrase, _, _ in phrases for w in phrase}
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.string())])

    def each(value: str | None) -> tuple:
        found = words(value)
        present = vocabulary.intersection(found)
        starts, labels, spans, score = [], set(), set(), 0.0
        stand = [(phrase, spelled, label) for phrase, spelled, label in phrases if present.issuperset(phrase)]
        joined = b" " + b" ".join(found) + b" " if stand else b""
        for phrase, spelled, label in stand:
            if spelled in joined:
                starts += places(found, phrase)
                labels.add(label)
        for label, start, share in index.scan(found, present):
            spans.add((start, label))
            score = max(score, share)
        every = labels | {label for _, label in spans}
        return (
            len(found), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(every)),
            1.0 if starts else score, ",".join(f"{label}@{start}" for start, label in sorted(spans)),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [each(t.as_py()) for t in batch.column(1)]
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *schema.names])

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {"op4_license_scan": op4_license_scan}
ORACLES: dict[str, str] = {}
