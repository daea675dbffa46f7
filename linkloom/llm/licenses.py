"""License scans by patience alignment.

A text is aligned with a license template around words that are unique to both: the longest increasing subsequence of
these anchors is kept, and the gaps between them are aligned in the same way, where other words may have become unique.
The share of the template's words that is aligned is its coverage.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from linkloom.llm.common import lower, query, record_batch, table, texts

# The wording of public licenses and of the notices that point to them.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        'an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
        "the specific language governing permissions and limitations under the License."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
        "other materials provided with the distribution."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "gpl-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}
MIN_COVERAGE = 0.85
PUNCTUATION = b".,;:!?()[]{}\"'`*#>"
#: Words that are too common to start a search from.
COMMON = frozenset(
    b"a all an and any are as at be by can copy either except file following for form free from in is it list may must "
    b"not of on one or other person provided see shall subject terms that the this to under use used useful will with "
    b"without work you your".split()
)


def normal_words(text: bytes) -> list[bytes]:
    """Words in lower case without punctuation; what is only punctuation is no word."""
    return lower(text).translate(None, PUNCTUATION).split()


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, ascending in the first, that also ascends in the second (patience sorting)."""
    tops: list[int] = []
    top_at: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        before[k] = top_at[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(j)
            top_at.append(k)
        else:
            tops[pile], top_at[pile] = j, k
    out: list[tuple[int, int]] = []
    k = top_at[-1] if top_at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions of equal words, ascending in both."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = increasing([(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place])
        if not anchors:
            continue
        found += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(found)


class Scanner:
    def __init__(self, templates: dict[str, str], least: float):
        self.least = least
        self.templates: list[tuple[str, list[bytes]]] = []
        self.places: dict[bytes, list[tuple[int, int]]] = {}
        for name, text in templates.items():
            body = normal_words(text.encode())
            once = Counter(body)
            seeds = [j for j, w in enumerate(body) if once[w] == 1 and w not in COMMON and not w.isdigit()]
            if not seeds:
                seeds = [j for j, w in enumerate(body) if once[w] == 1]
            for j in seeds:
                self.places.setdefault(body[j], []).append((len(self.templates), j))
            self.templates.append((name, body))
        self.seeds = frozenset(self.places)

    def findings(self, text: bytes) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, words) of each place that is covered well enough; words count as in
        ``normal_words``. Findings of one license do not overlap."""
        body = normal_words(text)
        if self.seeds.isdisjoint(body):
            return []
        # A seed at position p that is word j of a template suggests a copy that begins near p - j.
        begins: dict[int, set[int]] = {}
        for p, word in enumerate(body):
            for t, j in self.places.get(word, ()):
                begins.setdefault(t, set()).add(p - j)
        out: list[tuple[str, float, int, int]] = []
        for t, found in sorted(begins.items()):
            name, template = self.templates[t]
            size = len(template)
            slack = max(2, size // 4)
            hits: list[tuple[float, int, int]] = []
            end = None
            for begin in sorted(found):
                if end is not None and begin <= end:  # the same copy, shifted by a few words
                    continue
                end = begin + slack
                low = max(0, begin - slack)
                matched = align(body[low : begin + size + 2 * slack + 1], template)
                if matched and len(matched) >= self.least * size:
                    first, last = low + matched[0][0], low + matched[-1][0]
                    hits.append((len(matched) / size, first, last - first + 1))
            taken: list[tuple[int, int]] = []
            for coverage, first, length in sorted(hits, key=lambda h: (-h[0], h[1])):
                if all(first >= b or first + length <= a for a, b in taken):
                    taken.append((first, first + length))
                    out.append((name, coverage, first, length))
        return sorted(out, key=lambda x: (x[2], x[0]))


def license_findings(
    docs: DataFrame, *, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE
) -> DataFrame:
    """Rows (doc_id, license, coverage, first_word, n_words) for each place in a whole text that covers a template to at
    least ``min_coverage``.

    Words count from 0 in lower case and without punctuation. A null or empty text has no finding. Rows are scanned one
    by one: repeated rows give repeated findings, a null id stays null, an empty table gives no rows, and columns other
    than doc_id and text are not read. Of overlapping findings of one license the best covered one, then the first,
    stays. A place is looked for around any word that is unique in a template and not a common one.
    """
    chosen = dict(TEMPLATES if templates is None else templates)
    ddl = "doc_id bigint, license string, coverage double, first_word bigint, n_words bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, min_coverage)
        schema = pa.schema(
            [
                ("doc_id", pa.int64()),
                ("license", pa.string()),
                ("coverage", pa.float64()),
                ("first_word", pa.int64()),
                ("n_words", pa.int64()),
            ]
        )
        for batch in batches:
            rows = [
                (doc_id, *finding)
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for finding in scanner.findings(text)
            ]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
            yield record_batch(schema, dict(zip(schema.names, columns, strict=True)))

    return texts(docs).mapInArrow(run, ddl)


@query("op9_license_alignment")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_findings(table(spark, sf_dir, "documents"))
