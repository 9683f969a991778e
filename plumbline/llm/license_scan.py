"""License scans (operator 8) by a positional index of rare words.

The rarest words of every licence paragraph are indexed with their positions: the highest IDFs, until what is left
of its words could not reach half of the share that must agree.  Their occurrences in a file vote for the place at
which the paragraph would start, with the weight of the IDF; places up to 2 * SLACK words apart count together, so
that inserted and left-out words are tolerated.  Where the votes reach what the other words cannot make up for, the
whole paragraph is laid against the file.  It stands if enough of its weight agrees and its mandatory key phrase is
there, and if no word stands in it that makes another licence of it.  The IDF is that of the words among the
paragraphs."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes, tune

# Base phrases and their labels, templates (label, paragraph, key phrase), words too common to look up.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)", "any person obtaining a copy"),
    ("mit", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "without limitation the rights to use"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "this permission notice shall be included in all copies"),
    ("apache-2", "licensed under the apache license version 2.0", "apache license version 2"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache org licenses license 2 0"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License", "without warranties or conditions of any kind"),
    ("apache-2", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form", "prepare derivative works of"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "source and binary forms"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "must retain the above copyright notice"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", "must reproduce the above copyright notice"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived from this software"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "for any purpose with or without fee is hereby granted"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-3", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "either version 3 of the license"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-2", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "either version 2 of the license"),
    ("agpl-3", "licensed under the gnu affero general public license version 3", "gnu affero general public license version 3"),
    ("agpl-3", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "gnu affero general public license"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "gnu lesser general public license"),
    ("cc-by-nc", "licensed under cc by nc 4.0", "cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial 4.0 international license", "creative commons attribution noncommercial"),
    ("cc-by-nc", "You may not use the material for commercial purposes. NonCommercial means not primarily intended for or directed towards commercial advantage or monetary compensation", "directed towards commercial advantage or monetary compensation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "mozilla public license v 2 0"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means", "free and unencumbered software released into the public domain"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", "to alter it and redistribute it freely"),
    ("bsl-1", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software", "person or organization obtaining a copy of the software and accompanying documentation"),
]
# Words that make another licence of a paragraph in which they stand.
CONTRARY = set("affero lesser library organization".split())
COMMON = set("a an and any are as at be by can for from in into is it its may not of on one or so such that the this to use was with you your".split())

#: The share of a template's indexed weight that agrees, and where its key phrase has fewer than SHORT words.
AGREE, SHORT_AGREE, SHORT = 0.5, 0.75, 3
#: Words by which places of one template may differ and still count together.
SLACK = 4

_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of lower-cased (A-Z) UTF-8: runs of digits, letters and all characters from U+0080 on."""
    return text.translate(_FOLD).split()


class Template:
    """A paragraph of a licence: its weighted words, and the rarest of them as positions to look up."""

    def __init__(self, label: str, words: list[bytes], phrase: list[bytes], idf: dict[bytes, float]):
        self.label, self.words, self.phrase = label, words, phrase
        self.weights = [(q, w, idf[w]) for q, w in enumerate(words) if w in idf]
        self.total = sum(x for _, _, x in self.weights)
        self.key_at = next(q for q in range(len(words)) if words[q : q + len(phrase)] == phrase)
        self.key_words = {w for w in phrase if w in idf}
        self.agree = SHORT_AGREE if len(phrase) < SHORT else AGREE
        self.contrary = {w.encode() for w in CONTRARY} - set(words)
        self.rare, left = [], self.total
        for q, w, x in sorted(self.weights, key=lambda v: (-v[2], v[0])):
            if left <= self.agree / 2 * self.total:
                break
            self.rare.append((q, w, x))
            left -= x
        #: The votes that a place needs, as the words that are not looked up cannot make up for more.
        self.needed = self.agree * self.total - left

    def places(self, at: dict[bytes, list[int]]) -> Iterator[int]:
        """Starts at which the votes of the rare words suffice."""
        votes = sorted((i - q, q, x) for q, w, x in self.rare for i in at.get(w, ()))
        seen: Counter = Counter()
        weight, end = 0.0, 0
        for k, (start, q, x) in enumerate(votes):
            while end < len(votes) and votes[end][0] <= start + 2 * SLACK:
                seen[votes[end][1]] += 1
                weight += votes[end][2] * (seen[votes[end][1]] == 1)
                end += 1
            if weight >= self.needed - 1e-9 and (k == 0 or votes[k - 1][0] != start):
                yield start + SLACK
            seen[q] -= 1
            weight -= x * (seen[q] == 0)

    def agreeing(self, start: int, words: list[bytes]) -> float:
        """The share of the weight that agrees at a start, 0 if that is too little, if the key phrase is not there or a
        contrary word is."""
        if not self.contrary.isdisjoint(words[max(0, start) : max(0, start) + len(self.words)]):
            return 0.0
        low, n = start + self.key_at - SLACK, len(self.phrase)
        if not any(words[k : k + n] == self.phrase for k in range(max(0, low), low + 2 * SLACK + 1)):
            return 0.0
        share = sum(x for q, w, x in self.weights if w in words[max(0, start + q - SLACK) : max(0, start + q + SLACK + 1)]) / self.total
        return share if share >= self.agree else 0.0


class Index:
    def __init__(self, templates=TEMPLATES, base=BASE):
        parts = [(label, words_of(text.encode()), words_of(phrase.encode())) for label, text, phrase in templates]
        self.base = [(words_of(phrase.encode()), label) for phrase, label in base.items()]
        df = Counter(w for _, words, _ in parts for w in set(words))
        self.idf = {w: math.log(1 + len(parts) / n) for w, n in df.items() if w.decode() not in COMMON}
        self.templates = [Template(*part, self.idf) for part in parts]
        self.anchors = {phrase: min(phrase, key=lambda w: (-self.idf.get(w, 0), w)) for phrase in map(tuple, (p for p, _ in self.base))}
        self.wanted = frozenset(self.idf) | frozenset(self.anchors.values())

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], dict[str, float]]:
        """Base places (start, label) and the method's labels with the share of the template that agrees."""
        at: dict[bytes, list[int]] = {w: [] for w in self.wanted.intersection(words)}
        if not at:
            return [], {}
        for i, w in enumerate(words):
            if w in at:
                at[w].append(i)
        places = []
        for phrase, label in self.base:
            anchor = self.anchors[tuple(phrase)]
            back = phrase.index(anchor)
            places += [(i - back, label) for i in at.get(anchor, ()) if i >= back and words[i - back : i - back + len(phrase)] == phrase]
        found: dict[str, float] = {}
        for t in self.templates:
            if at.keys() >= t.key_words:
                best = 0.0
                for start in t.places(at):
                    best = max(best, t.agreeing(start, words))
                    if best == 1:
                        break
                if best:
                    found[t.label] = max(found.get(t.label, 0.0), best)
        return places, found


def scan_licenses(docs: DataFrame, templates=TEMPLATES, base=BASE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    first_word and last_word are the smallest and largest start of a base place, else null; base_labels and labels
    are distinct, sorted and comma-joined, empty if there are none.  score: 1 with a base place, else the largest
    agreeing share among the method's labels, 0 without any.

    Null texts count as empty.  Long texts are read whole.  Repeated rows and null doc_ids are scanned like any
    other; extra columns are ignored; an empty table gives an empty result."""
    tune(docs.sparkSession)
    index = Index(templates, base)
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                places, found = index.scan(words)
                starts, base_labels = [p for p, _ in places], {label for _, label in places}
                score = 1.0 if places else max(found.values(), default=0.0)
                rows.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(base_labels | set(found))), score))
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], [f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(run, schema)
