"""Licence scan: Dice coefficient over word bigrams against licence templates, pruned by size.

Units of a text are its lines and its paragraphs (runs of at least two lines that are not blank).  A unit is lower-cased and cut into
words of ASCII letters and digits; its bigrams, repeats included, are compared with each template's.  A coefficient of
at least t needs sizes within a factor of (2 - t) / t, so only templates of such sizes are looked at, and of those only ones that share
enough bigrams.  Each unit reports its best template, ties by name.  A line that holds comment marks only is blank.

A notice inside a longer unit, or over several, is found by windows over all words of the text: for each notice and each full licence
text (``license_texts``), windows of any size within the Dice bound that begin and end with a bigram of the template.  Of windows that
overlap, the one with the highest coefficient counts, then the longest template, then the name; a window inside a reported unit
is not told again.  A window's lines are those of its first to its last word.

Defined cases: NULL and empty texts have no units; a unit of fewer than two words has no bigrams and matches nothing; very
long units are compared whole (their size alone rules them out) and searched by windows; rows keep their id, NULL or repeated; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import as_text, map_rows, read

THRESHOLD = 0.8
_WORD = re.compile("[a-z0-9]+")


def _templates() -> dict[str, list[str]]:
    """Notices by licence.  Fixed wording, as the licences' own notices have it."""
    out = {
        "apache-2.0": [
            "Licensed under the Apache License, Version 2.0.",
            "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
            "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
            "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
            "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        ],
        "mit": [
            "Released under the MIT License.",
            "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        ],
        "isc": [
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies.",
        ],
        "bsd": [
            "Licensed under the BSD License.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        ],
        "mpl-2.0": [
            "Licensed under the Mozilla Public License, version 2.0.",
            "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
            "You can obtain one at http://mozilla.org/MPL/2.0/.",
        ],
        "unlicense": ["This is free and unencumbered software released into the public domain."],
        "public-domain": ["This work is in the public domain.", "Released into the public domain."],
        "all-rights-reserved": ["All rights reserved. No part of this work may be reproduced without permission."],
    }
    gnu = {"gpl": "GNU General Public License", "lgpl": "GNU Lesser General Public License", "agpl": "GNU Affero General Public License"}
    for short, name in gnu.items():
        for version in ("2", "3"):
            out[f"{short}-{version}.0"] = [
                f"This work is licensed under the {name}, version {version}.",
                f"Licensed under the {name}, version {version}.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the "
                f"{name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
            ]
    words = {"by": "Attribution", "nc": "NonCommercial", "sa": "ShareAlike", "nd": "NoDerivatives"}
    for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"):
        full = "-".join(words[part] for part in kind.split("-"))
        out[f"cc-{kind}-4.0"] = [
            f"Licensed under CC {kind.upper()} 4.0.",
            f"This work is licensed under a Creative Commons {full} 4.0 International License.",
        ]
    return out


TEMPLATES = _templates()
#: Complete licence texts by licence.
FULL_TEXTS = {path.stem: [path.read_text()] for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
#: What a blank line of a comment is made of.
_MARKS = " \t\v\f\r#*/;%!<>-"


def bigrams(text: str) -> list[str]:
    words = _WORD.findall(text.lower())
    return list(map(" ".join, zip(words, words[1:])))


class Scanner:
    """Templates in order of size, and which of them hold a bigram."""

    def __init__(self, templates: dict[str, list[str]], threshold: float, full_texts: dict[str, list[str]] | None = None) -> None:
        self.threshold = threshold
        known = [(name, Counter(bigrams(text))) for name, texts in templates.items() for text in texts]
        self.known = sorted(((sum(c.values()), name, c) for name, c in known), key=lambda x: x[:2])
        self.sizes = [size for size, _, _ in self.known]
        self.words = frozenset().union(*(c for _, _, c in self.known))
        self.least = self.bound(self.sizes[0])[0]
        self.most = self.bound(self.sizes[-1])[1]
        full = [(name, Counter(bigrams(text))) for name, texts in (full_texts or {}).items() for text in texts]
        self.windowed = [(sum(c.values()), name, c) for name, c in [*known, *full]]
        self.holders: dict[str, list[int]] = {}
        for at, (_, _, c) in enumerate(self.windowed):
            for gram in c:
                self.holders.setdefault(gram, []).append(at)

    def bound(self, size: int) -> tuple[float, float]:
        ratio = self.threshold / (2 - self.threshold)
        return size * ratio - 1e-9, size / ratio + 1e-9

    def best(self, text: str) -> tuple[str, float] | None:
        """The most alike template of at least the threshold."""
        own = bigrams(text)
        if not self.least <= len(own) <= self.most or not own:
            return None
        shared = [b for b in own if b in self.words]
        if 2 * len(shared) < self.threshold * len(own) / (2 - self.threshold):
            return None
        counts, found = Counter(shared), None
        low, high = self.bound(len(own))
        for size, name, template in self.known[bisect_left(self.sizes, low) : bisect_right(self.sizes, high)]:
            common = sum(min(n, template[b]) for b, n in counts.items() if b in template)
            dice = 2 * common / (len(own) + size)
            if dice >= self.threshold and (found is None or (-dice, name) < (-found[1], found[0])):
                found = name, dice
        return found

    def scan(self, text: str) -> Iterator[tuple[int, int, str, float]]:
        """(first line, lines, licence, Dice coefficient) of every unit and window that matches."""
        lines = text.split("\n")
        units = []
        for found in self.units(lines):
            units.append(found[:2])
            yield found
        chosen: list[tuple[int, int]] = []
        words = [_WORD.findall(line.lower()) for line in lines]
        line_of = np.repeat(np.arange(len(lines)), [len(w) for w in words])
        for dice, _, name, first, last in sorted(self.windows([w for own in words for w in own]), key=lambda x: (-x[0], -x[1], x[2:])):
            low, high = int(line_of[first]), int(line_of[last + 1])
            if any(a <= low and high < a + n for a, n in units) or any(first <= b and a <= last for a, b in chosen):
                continue
            chosen.append((first, last))
            yield low, high - low + 1, name, dice

    def windows(self, words: list[str]) -> Iterator[tuple[float, int, str, int, int]]:
        """(Dice coefficient, template size, licence, first and last bigram) of the best window of each place, per template."""
        places: dict[int, list[tuple[int, str]]] = {}
        for at, gram in enumerate(map(" ".join, zip(words, words[1:]))):
            for template in self.holders.get(gram, ()):
                places.setdefault(template, []).append((at, gram))
        for template, own in places.items():
            size, name, counts = self.windowed[template]
            least, most = self.bound(size)
            need = max(1, int(np.ceil(least)))
            if len(own) < need:
                continue
            at = np.array([place for place, _ in own])
            dense = at[need - 1 :] - at[: len(at) - need + 1] < most
            if not dense.any():
                continue
            # A bigram counts unless the window holds it as often as the template does already.
            seen: dict[str, list[int]] = {}
            before = np.full(len(own), -1)
            for n, (_, gram) in enumerate(own):
                earlier = seen.setdefault(gram, [])
                if len(earlier) >= counts[gram]:
                    before[n] = earlier[-counts[gram]]
                earlier.append(n)
            stops = np.searchsorted(at, at + int(most))
            best, until = None, -1
            free = 0
            for n in np.flatnonzero(dense).tolist():
                if best and n > until:
                    yield best[0], size, name, int(at[best[1]]), int(at[best[2]])
                    free, best = best[2] + 1, None
                if n < free:
                    continue
                part = slice(n, stops[n])
                dice = 2 * np.cumsum(before[part] < n) / (at[part] - at[n] + 1 + size)
                top = int(dice.argmax())
                if dice[top] >= self.threshold - 1e-12 and (best is None or dice[top] > best[0]):
                    if best is None:
                        until = n + top
                    best = float(dice[top]), n, n + top
            if best:
                yield best[0], size, name, int(at[best[1]]), int(at[best[2]])

    def units(self, lines: list[str]) -> Iterator[tuple[int, int, str, float]]:
        """The lines and paragraphs that match as a whole."""
        start = 0
        for at, line in enumerate([*lines, ""]):
            if at < len(lines) and (found := self.best(line)):
                yield at, 1, *found
            if not line.strip(_MARKS).strip():
                if at - start > 1 and (found := self.best("\n".join(lines[start:at]))):
                    yield start, at - start, *found
                start = at + 1


def scan_licenses(
    docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, line_no, n_lines, license, dice) of every line, paragraph or window that is like a template."""
    scanner = Scanner(templates, threshold, FULL_TEXTS)

    def step(ids, texts):
        return [(doc_id, *found[:3], round(found[3], 6)) for doc_id, text in zip(ids, texts) for found in scanner.scan(text)]

    rows = docs.select(F.col(id_col).cast("long"), as_text(text_col))
    return map_rows(rows, step, "doc_id long, line_no int, n_lines int, license string, dice double")


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    """Licence notices of every document."""
    return scan_licenses(read(spark, sf_dir, "documents"))


def _sql() -> str:
    quoted = ",\n    ".join(f"('{name}', {at}, '{text.replace(chr(39), chr(39) * 2)}')" for name, texts in TEMPLATES.items() for at, text in enumerate(texts))
    return f"""
with template(license, n, body) as (values
    {quoted}
), lines as (
    select row_number() over () as row, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents
), line as (
    select row, doc_id, unnest(lines) as body, generate_subscripts(lines, 1) - 1 as line_no from lines
), run as (
    select *, sum(case when trim(body, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) = '' then 1 else 0 end)
        over (partition by row order by line_no rows unbounded preceding) as run
    from line
), paragraph as (
    select row, doc_id, string_agg(body, chr(10) order by line_no) as body, min(line_no) as line_no, count(*) as n_lines
    from run where trim(body, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '' group by row, doc_id, run having count(*) > 1
), unit as (
    select row_number() over () as unit, * from (
        select doc_id, body, line_no, 1 as n_lines from line
        union all
        select doc_id, body, line_no, n_lines from paragraph
    )
), unit_words as (
    select unit, regexp_extract_all(lower(body), '[a-z0-9]+') as w from unit
), unit_grams as (
    select unit, len(w) - 1 as size, list_transform(list_zip(w[:-2], w[2:]), lambda x: x[1] || ' ' || x[2]) as grams
    from unit_words where len(w) between 2 and 200
), template_words as (
    select license, n, regexp_extract_all(lower(body), '[a-z0-9]+') as w from template
), template_grams as (
    select license, n, len(w) - 1 as size, list_transform(list_zip(w[:-2], w[2:]), lambda x: x[1] || ' ' || x[2]) as grams
    from template_words
), a as (
    select unit, size, gram, count(*) as c from (select unit, size, unnest(grams) as gram from unit_grams) group by all
), b as (
    select license, n, size, gram, count(*) as c from (select license, n, size, unnest(grams) as gram from template_grams) group by all
), dice as (
    select a.unit, b.license, 2.0::double * sum(least(a.c, b.c)) / (any_value(a.size) + any_value(b.size)) as dice
    from a join b using (gram) group by a.unit, b.license, b.n
), best as (
    select *, row_number() over (partition by unit order by dice desc, license) as rank from dice where dice >= {THRESHOLD}
)
select doc_id, line_no::int as line_no, n_lines::int as n_lines, license, round(dice, 6) as dice from best join unit using (unit) where rank = 1
"""


OP9_SQL = _sql()
