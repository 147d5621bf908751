"""License scans by Patience alignment of texts and license templates.

Text and template are words in lower case. Words that occur once in both are anchors; the longest increasing run of their places is
kept, and the gaps between kept anchors, where further words may be unique by now, are aligned in the same way. Equal words at the
edges of a gap are matched first. Coverage is the share of the template's words that are matched.

A long text is aligned in regions of ``REACH`` template lengths, each beginning half a length after the last, so words elsewhere don't
take away a template's anchors, and licenses in a row have regions in which half of their words are unique. Finds of one template that overlap
count once, so of several in a row some may be counted together. Regions that hold too few of the
template's words to reach the coverage are passed over; no region that could reach it is.

Defined cases: null or empty text has no license. Of equally covered templates the longer one, then the smaller id, is named first. Documents
without an id and repeated rows are scanned like others. An empty table gives an empty result; no templates, no license.
Input columns named like a result are replaced by it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COVERAGE = 0.8
REACH = 2
_WORD = re.compile(r"\w+")

# Wording of licenses and of the notes that name them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
}


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing run, by piles: each value goes on the leftmost pile whose top is not smaller."""
    tops: list[int] = []
    on_top: list[int] = []
    before: list[int] = []
    for place, value in enumerate(values):
        pile = bisect_left(tops, value)
        before.append(on_top[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(value)
            on_top.append(place)
        else:
            tops[pile], on_top[pile] = value, place
    run, place = [], on_top[-1] if on_top else -1
    while place >= 0:
        run.append(place)
        place = before[place]
    return run[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Matched places (text, template), both increasing."""
    matched, gaps = [], [(0, len(text), 0, len(template))]
    while gaps:
        a, a_end, b, b_end = gaps.pop()
        while a < a_end and b < b_end and text[a] == template[b]:
            matched.append((a, b))
            a, b = a + 1, b + 1
        while a < a_end and b < b_end and text[a_end - 1] == template[b_end - 1]:
            a_end, b_end = a_end - 1, b_end - 1
            matched.append((a_end, b_end))
        if a == a_end or b == b_end:
            continue
        in_text, in_template = Counter(text[a:a_end]), Counter(template[b:b_end])
        place = {w: i for i, w in enumerate(text[a:a_end], a) if in_text[w] == 1}
        common = [(place[w], j) for j, w in enumerate(template[b:b_end], b) if in_template[w] == 1 and w in place]
        anchors = [common[i] for i in longest_increasing([i for i, _ in common])]
        if anchors:
            matched += anchors
            edges = [(a - 1, b - 1), *anchors, (a_end, b_end)]
            gaps += [(i + 1, i2, j + 1, j2) for (i, j), (i2, j2) in zip(edges, edges[1:])]
    return sorted(matched)


def scan(text: str | None, templates: dict[str, list[str]], coverage: float = COVERAGE) -> list[tuple[str, float, int, int]]:
    """Every license found: id, coverage, first and last word; the best covered first. Overlapping finds of one template count once."""
    tokens = words(text)
    counted = Counter(tokens)
    found = []
    for name, template in templates.items():
        size = len(template)
        need = Counter(template)
        enough = coverage * size
        if not size or sum((counted & need).values()) < enough:
            continue
        best: list[tuple[float, int, int]] = []
        for start in range(0, max(1, len(tokens) - size + 1), max(1, size // 2)):
            region = tokens[start:start + REACH * size]
            if sum((Counter(region) & need).values()) < enough:
                continue
            pairs = align(region, template)
            if len(pairs) >= enough:
                hit = (len(pairs) / size, start + pairs[0][0], start + pairs[-1][0])
                if best and hit[1] <= best[-1][2]:
                    best[-1] = max(best[-1], hit, key=lambda h: (h[0], h[1] - h[2]))
                else:
                    best.append(hit)
        found += [(name, *hit) for hit in best]
    return sorted(found, key=lambda f: (-f[1], -len(templates[f[0]]), f[0], f[2]))


def scan_licenses(docs: DataFrame, text_col: str = "text", templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` with ``licenses``: id, coverage, first and last word of every license found, the best covered first."""
    cut = {name: words(text) for name, text in templates.items()}

    @F.pandas_udf("array<struct<license:string,coverage:double,first_word:long,last_word:long>>")
    def scanned(texts: pd.Series) -> pd.Series:
        names = ("license", "coverage", "first_word", "last_word")
        return texts.map(lambda t: [dict(zip(names, f)) for f in scan(t, cut, coverage)])

    found = docs.select(F.struct("*").alias("row"), scanned.asNondeterministic()(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("licenses"))
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != "licenses"], "licenses")
