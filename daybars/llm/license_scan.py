"""Licence scan: a positional index over the rarest licence words.

Templates are paragraphs of licence texts, and short phrases, as word
sequences with key phrases, at least one of which is mandatory. All template
words are indexed with their positions; their document frequencies are counted
over the whole corpus.

Of a file, the templates matter that have a key phrase all of whose words the
file has. Of each, the ``RARE`` words with the highest IDF that the file has are
looked up; their places minus their positions in the template are starts, and a
start stays if ``AGREE`` of these words (all, if there are fewer) give it.
There a key phrase must stand word for word at its relative position. The share of
template words that stand at theirs is the score; the label counts from
``MIN_SCORE`` on or with ``FRAGMENT`` words, so a piece from the body of a licence
is labelled too.

A phrase of the base counts every place where its words stand consecutively:
it is a template whose key phrase is all of it, so no place is lost.

Defined results: null and empty texts have no words, no labels and score 0;
repeated rows are each scanned; very long texts are scanned whole, in time
proportional to their words and to the places of the words looked up; of equal
IDFs the first word in the template is rarer, so an empty corpus, with all IDFs equal, is scanned
like any other; columns of the input that have our names stay as they are.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybars.llm.common import words_of

MIN_SCORE, FRAGMENT, RARE, AGREE = 0.7, 12, 4, 2


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    keys: tuple[str, ...]           # each stands within ``words``
    base: bool = False


def _phrase(label: str, words: str, base: bool = False) -> Template:
    return Template(label, words, (words,), base)


# Phrases, and paragraphs of common licence texts with their key phrases.
TEMPLATES = (
    _phrase("mit", "mit license", True),
    _phrase("apache", "apache license", True),
    _phrase("gpl", "general public license", True),
    _phrase("bsd", "bsd license"),
    _phrase("lgpl", "gnu lesser general public license"),
    _phrase("agpl", "gnu affero general public license"),
    _phrase("mpl", "mozilla public license"),
    _phrase("epl", "eclipse public license"),
    _phrase("cc-by-nc", "licensed under cc by nc 4 0"),
    _phrase("cc-by-sa", "licensed under cc by sa 4 0"),
    _phrase("cc-by", "licensed under cc by 4 0"),
    _phrase("cc0", "cc0 1 0 universal"),
    _phrase("mit", "spdx license identifier mit"),
    _phrase("apache", "spdx license identifier apache 2 0"),
    _phrase("gpl", "spdx license identifier gpl"),
    _phrase("cc-by", "creative commons attribution 4 0 international license"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                    "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
                    "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
                    "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
                    "following conditions:",
             ("permission is hereby granted free of charge", "to deal in the software without restriction",
              "merge publish distribute sublicense and or sell")),
    Template("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial "
                    "portions of the Software.", ("copies or substantial portions of the software",)),
    Template("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
                    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
                    "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
                    "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
                    "USE OR OTHER DEALINGS IN THE SOFTWARE.",
             ("purpose and noninfringement", "the use or other dealings in the software")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
                    "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
             ("permission to use copy modify and or distribute", "with or without fee is hereby granted")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                    "that the following conditions are met:", ("redistribution and use in source and binary forms",)),
    Template("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
                    "following disclaimer.", ("redistributions of source code must retain",)),
    Template("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
                    "following disclaimer in the documentation and/or other materials provided with the distribution.",
             ("redistributions in binary form must reproduce",)),
    Template("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                    "products derived from this software without specific prior written permission.",
             ("to endorse or promote products derived from this software",)),
    Template("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                       "compliance with the License. You may obtain a copy of the License at "
                       "http://www.apache.org/licenses/LICENSE-2.0",
             ("licensed under the apache license version 2 0", "may not use this file except in compliance with the license")),
    Template("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                       "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
                       "implied. See the License for the specific language governing permissions and limitations under the "
                       "License.",
             ("unless required by applicable law or agreed to in writing", "language governing permissions and limitations")),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                    "option) any later version.",
             ("under the terms of the gnu general public license",)),
    Template("gpl", "You should have received a copy of the GNU General Public License along with this program.",
             ("a copy of the gnu general public license along with",)),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
                     "General Public License as published by the Free Software Foundation",
             ("under the terms of the gnu lesser general public license",)),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
                    "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
             ("subject to the terms of the mozilla public license", "if a copy of the mpl was not distributed")),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
                          "modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
                          "compiled binary, for any purpose, commercial or non-commercial, and by any means.",
             ("free and unencumbered software", "for any purpose commercial or non commercial and by any means")),
)


def vocabulary(templates: tuple[Template, ...] = TEMPLATES) -> frozenset[bytes]:
    return frozenset(w for t in templates for w in words_of(t.words))


def document_frequencies(docs: DataFrame, words: frozenset[bytes], text_col: str = "text") -> tuple[int, dict[bytes, int]]:
    """Documents, and how many of them hold each word: over all documents.

    Each task counts its own batch; at most one row per word and batch is
    shuffled and one per word comes to the driver.
    """
    names = sorted(w.decode() for w in words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                total.update(words.intersection(words_of(t.as_py())))
            total[b""] += b.num_rows
        yield pa.RecordBatch.from_pydict({"word": [w.decode() for w in total], "n": list(total.values())},
                                         pa.schema([("word", pa.string()), ("n", pa.int64())]))
    rows = docs.select(text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"]: r["n"] for r in rows.collect()}
    return found.get("", 0), {n.encode(): found.get(n, 0) for n in names}


class Index:
    """Positions of all template words, and what a file must have for each
    template to matter."""

    def __init__(self, n_docs: int, df: dict[bytes, int], templates: tuple[Template, ...] = TEMPLATES):
        self.idf = {w: math.log((n_docs + 1) / (n + 1)) for w, n in df.items()}
        self.templates: list[tuple[str, list[bytes], list[tuple[int, list[bytes]]], list[bytes], bool]] = []
        self.places: list[dict[bytes, list[int]]] = []              # word -> positions in the template
        self.needs: dict[bytes, list[tuple[frozenset[bytes], int]]] = defaultdict(list)
        for number, t in enumerate(templates):
            words, keys, places = words_of(t.words), [], defaultdict(list)
            for i, w in enumerate(words):
                places[w].append(i)
            for key in map(words_of, t.keys):
                keys.append((next(i for i in range(len(words)) if words[i:i + len(key)] == key), key))
                self.needs[max(key, key=self.idf.__getitem__)].append((frozenset(key), number))
            rarest = sorted(places, key=lambda w: -self.idf[w])     # a stable sort: ties in order of the template
            self.templates.append((t.label, words, keys, rarest, t.base))
            self.places.append(dict(places))

    def starts(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(template, start) on which the file's rarest words of the template agree."""
        have = set(words)
        chosen = {number for w in self.needs.keys() & have for need, number in self.needs[w] if need <= have}
        if not chosen:
            return
        lookup: dict[bytes, list[tuple[int, int, int]]] = defaultdict(list)     # word -> (template, position, its bit)
        wanted = {}
        for number in chosen:
            rare = [w for w in self.templates[number][3] if w in have][:RARE]
            wanted[number] = min(AGREE, len(rare))
            for bit, w in enumerate(rare):
                lookup[w] += [(number, at, 1 << bit) for at in self.places[number][w]]
        agree: dict[tuple[int, int], int] = defaultdict(int)
        for i, w in enumerate(words):
            for number, at, bit in lookup.get(w, ()):
                agree[number, i - at] |= bit
        for (number, start), bits in agree.items():
            if bits.bit_count() >= wanted[number]:
                yield number, start

    def scan(self, text: str | None) -> tuple:
        words = words_of(text)
        n, places, base, labels, score = len(words), [], set(), set(), 0.0
        for number, start in self.starts(words):
            label, t, keys, _, is_base = self.templates[number]
            if not any(start + at >= 0 and words[start + at:start + at + len(key)] == key for at, key in keys):
                continue
            found = sum(0 <= start + k < n and words[start + k] == x for k, x in enumerate(t))
            if is_base:
                places.append(start)
                base.add(label)
            if found >= MIN_SCORE * len(t) or found >= FRAGMENT:
                labels.add(label)
                score = max(score, found / len(t))
        return (n, len(places), min(places, default=None), max(places, default=None),
                ",".join(sorted(base)), ",".join(sorted(labels)), score)


FOUND = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def scan(docs: DataFrame, text_col: str = "text", out: str = "licence",
         templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``docs`` with a struct column of what was found in the whole text."""
    index = docs.sparkSession.sparkContext.broadcast(
        Index(*document_frequencies(docs, vocabulary(templates), text_col), templates))
    names = [f.split()[0] for f in FOUND.split(", ")]

    @F.pandas_udf(FOUND)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = pd.DataFrame([index.value.scan(t) for t in texts], columns=names, dtype=object)
            yield found.astype({"first_word": "Int64", "last_word": "Int64", "n_words": "int64", "n_base": "int64",
                                "score": "float64"})
    return docs.withColumn(out, run.asNondeterministic()(F.col(text_col)))


def report(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text"), out="licence").select("doc_id", "licence.*")
