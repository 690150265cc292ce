"""License scans: units of a text against licence templates by the Dice coefficient over word bigrams.

A text is cut at line ends and sentence ends into pieces; a piece is normalised to lower-case
words.  Its units are runs of consecutive pieces: the whole text, its paragraphs, lines and
sentences of any size, and every other run of at most ``run_bound`` words, so that notices that
are wrapped in a comment block, follow prose or span paragraphs are units too.  A unit with m
distinct bigrams can reach a Dice coefficient d with a template of n only if m d / (2 - d) <= n
<= m (2 - d) / d, which prunes the templates and gives the bound of runs, and only if at least
m d / (2 - d) of its bigrams are bigrams of the templates, which passes over most units unseen.
Both bounds are exact.

Related licences have like notices: a unit gives each licence that it reaches, and the largest
coefficient is the closest.  Overlapping units count each in ``n_units``.

Nulls and edge cases: null and empty texts have no unit and give no row.  A unit of one word
has no bigram and matches nothing.  Null ids are kept.  Repeated rows give repeated results.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
PARAGRAPH = re.compile(r"\n[ \t\r]*\n")

# Short notices and the opening paragraphs by which licences are commonly declared.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "LGPL-3.0": ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License.",),
    "AGPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License.",),
    "BSD": (
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "CC0-1.0": (
        "This work is released into the public domain under the Creative Commons Zero license.",
        "Licensed under CC0 1.0.",
        "CC0 1.0",
        "CC0 1.0 Universal",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "Zlib": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "Public-Domain": ("This work is in the public domain.", "Released into the public domain."),
    "All-Rights-Reserved": ("All rights reserved.",),
}

# Creative Commons licences in short and long spelling, by version.
for _code, _name in {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-NC": "Attribution-NonCommercial",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}.items():
    for _version, _scope in (("4.0", "International"), ("3.0", "Unported")):
        TEMPLATES[f"CC-{_code}-{_version}"] = (
            f"Licensed under CC {_code} {_version}.",
            f"This work is licensed under CC {_code} {_version}.",
            f"CC {_code} {_version}",
            f"This work is licensed under a Creative Commons {_name} {_version} {_scope} License.",
            f"Creative Commons {_name} {_version} {_scope}",
        )

# Short notices of the other licences: by name, and as SPDX tags.
for _code, _names, _tags in (
    ("Apache-2.0", ("Apache License 2.0", "Apache License, Version 2.0"), ("Apache-2.0",)),
    ("MIT", ("MIT License",), ("MIT",)),
    ("GPL-3.0", ("GNU General Public License v3.0", "GNU General Public License, version 3", "GPL 3.0"), ("GPL-3.0-only", "GPL-3.0-or-later")),
    ("GPL-2.0", ("GNU General Public License v2.0", "GNU General Public License, version 2", "GPL 2.0"), ("GPL-2.0-only", "GPL-2.0-or-later")),
    ("LGPL-3.0", ("GNU Lesser General Public License v3.0", "GNU Lesser General Public License, version 3"), ("LGPL-3.0-only", "LGPL-3.0-or-later")),
    ("AGPL-3.0", ("GNU Affero General Public License v3.0", "GNU Affero General Public License, version 3"), ("AGPL-3.0-only", "AGPL-3.0-or-later")),
    ("BSD", ("BSD License", "BSD 2-Clause License", "BSD 3-Clause License"), ("BSD-2-Clause", "BSD-3-Clause")),
    ("MPL-2.0", ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0"), ("MPL-2.0",)),
    ("ISC", ("ISC License",), ("ISC",)),
):
    _notices = [f"{_how} the {_n}." for _n in _names for _how in ("Licensed under", "Released under")] + [f"SPDX-License-Identifier: {_t}" for _t in _tags]
    TEMPLATES[_code] += tuple(n for n in _notices if n not in TEMPLATES[_code])


def normalised(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:]))


def dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def run_bound(templates: dict[str, tuple[str, ...]], least: float) -> int:
    """The most words of a run: those of a text without repeats that can still reach the longest template."""
    return int(max((len(normalised(t)) for texts in templates.values() for t in texts), default=0) * (2 - least) / least)


def pieces(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, line, paragraph) of the pieces with a word, cut at line ends and sentence ends."""
    breaks = [m.end() for m in PARAGRAPH.finditer(text)]
    out, at, paragraph = [], 0, 0
    for number, line in enumerate(text.split("\n")):
        while paragraph < len(breaks) and at >= breaks[paragraph]:
            paragraph += 1
        start = at
        for end, after in [m.span() for m in SENTENCE.finditer(line)] + [(len(line), len(line))]:
            if WORDS.search(text, start, at + end):
                out.append((start, at + end, number, paragraph))
            start = at + after
        at += len(line) + 1
    return out


def ranges(cut: list[tuple[int, int, int, int]], n_words: list[int], most: int) -> Iterator[tuple[int, int]]:
    """First and last piece of each unit, each once."""
    n = len(cut)
    if not n:
        return
    larger = {(0, n - 1)}
    for k in (2, 3):
        starts = [i for i in range(n) if not i or cut[i][k] != cut[i - 1][k]]
        larger.update(zip(starts, [s - 1 for s in starts[1:]] + [n - 1]))
    for i in range(n):
        size = 0
        for j in range(i, n):
            size += n_words[j]
            if size > most and j > i:
                break
            larger.discard((i, j))
            yield i, j
    yield from larger


def units(text: str, most: int | None = None) -> Iterator[str]:
    """The units of a text, the runs of up to ``most`` words (by default those that the fixed templates need)."""
    cut = pieces(text)
    most = run_bound(TEMPLATES, 0.8) if most is None else most
    for i, j in ranges(cut, [len(normalised(text[a:b])) for a, b, _, _ in cut], most):
        yield text[cut[i][0] : cut[j][1]]


class Scanner:
    def __init__(self, least: float = 0.8, templates: dict[str, tuple[str, ...]] | None = None):
        self.least = least
        templates = TEMPLATES if templates is None else templates
        made = sorted(((len(b), name, b) for name, texts in templates.items() for b in [bigrams(normalised(t)) for t in texts] if b), key=lambda x: x[:2])
        self.sizes, self.made = [m[0] for m in made], made
        self.pairs = {pair for _, _, b in made for pair in b}
        self.most = run_bound(templates, least)

    def unit(self, own: set[tuple[str, str]]) -> list[tuple[str, float]]:
        """Licences and coefficients of the templates that the bigrams of a unit reach."""
        m, d = len(own), self.least
        slack = 1e-9
        low = bisect_left(self.sizes, m * d / (2 - d) - slack)
        high = bisect_right(self.sizes, m * (2 - d) / d + slack)
        return [(name, c) for _, name, b in self.made[low:high] if (c := dice(own, b)) >= d]

    def scan(self, text: str | None) -> dict[str, tuple[float, int]]:
        """By licence: the best coefficient and the count of units that reach it."""
        found: dict[str, tuple[float, int]] = {}
        if not text or not self.sizes:
            return found
        everything = normalised(text)
        if self.pairs.isdisjoint(zip(everything, everything[1:])):
            return found
        share = self.least / (2 - self.least) - 1e-9
        cut = pieces(text)
        words = [normalised(text[a:b]) for a, b, _, _ in cut]
        flat = [w for part in words for w in part]
        place = [0, *accumulate(map(len, words))]
        known = [0, *accumulate(map(self.pairs.__contains__, zip(flat, flat[1:])))]
        fewest = max(1, self.sizes[0] * share)
        for i, j in ranges(cut, list(map(len, words)), self.most):
            a, b = place[i], place[j + 1]
            if b - a < 2 or known[b - 1] - known[a] < fewest:
                continue
            own = bigrams(flat[a:b])
            if len(own & self.pairs) < share * len(own):
                continue
            for name, c in self.unit(own):
                best, n = found.get(name, (0.0, 0))
                found[name] = max(best, c), n + 1
        return found


def scan_licenses(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``doc_id``, ``license``, ``dice``, ``n_units``: a row for each licence found in a document.

    ``templates`` holds the notices of each licence in place of the fixed ``TEMPLATES``.
    """
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(least, templates)
        for batch in batches:
            ids, rows = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for name, (best, n) in sorted(scanner.scan(text.as_py()).items()):
                    ids.append(doc)
                    rows.append((name, best, n))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.int64())], ["doc_id", "license", "dice", "n_units"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, license string, dice double, n_units long")
