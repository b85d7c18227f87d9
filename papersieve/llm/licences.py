"""Licence scan: windows of words against licence templates by the Dice coefficient of word bigrams.

Windows slide over the words of the whole text, whatever its line ends. A window of s bigrams and a
template of t can reach the coefficient c only if s lies between t c / (2 - c) and t (2 - c) / c, and
only if t c / (2 - c) of the window's bigrams are the template's; a text in which no stretch of that
length holds so many ends there. A best window begins and ends with a bigram of the template.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersieve.llm.common import blocks

DICE = 0.8
#: Full texts, without the copyright line where there is one.
TEXTS = Path(__file__).parent / "licence_texts"
# Notices under which these licences are applied, as their texts or stewards word them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    *((path.stem, path.read_text()) for path in sorted(TEXTS.glob("*.txt"))),
)

# A-Z folded, line ends kept, all else but letters, digits and characters beyond ASCII to blanks
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b == 10 or 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def normalise(text: str | None) -> list[list[bytes]]:
    """Words of every line."""
    return [line.split() for line in (text or "").encode("utf-8", "replace").translate(_FOLD).split(b"\n")]


def dice(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return 2 * both / (sum(a.values()) + sum(b.values())) if a and b else 0.0


class Scanner:
    def __init__(self, templates=TEMPLATES, least: float = DICE):
        self.least = least
        self.names = [name for name, _ in templates]
        self.number: dict[tuple[bytes, bytes], int] = defaultdict(lambda: len(self.number))
        words = [[w for line in normalise(text) for w in line] for _, text in templates]
        grams = [Counter(self.number[g] for g in zip(w, w[1:])) for w in words]
        self.number.default_factory = None
        self.sizes = np.array([sum(g.values()) for g in grams], np.int64)
        #: How often each template holds each bigram; the last column stands for all other bigrams.
        self.times = np.zeros((len(grams), len(self.number) + 1), np.int64)
        for i, g in enumerate(grams):
            self.times[i, list(g)] = list(g.values())
        self.share = least / (2 - least)

    def windows(self, gram: np.ndarray, i: int) -> list[tuple[int, float, int, int, int]]:
        """(bigrams in common, coefficient, -first, last bigram, -i) of the best window from every start, where it matches template ``i``."""
        size, times = int(self.sizes[i]), self.times[i]
        need, longest = self.share * size - 1e-9, int(size / self.share + 1e-9)
        inside = times[gram] > 0
        total = np.append(0, np.cumsum(inside))
        hits = np.flatnonzero(inside)
        starts = hits[total[np.minimum(hits + longest, len(gram))] - total[hits] >= need]
        if not len(starts):
            return []
        # a bigram counts if fewer of its kind than the template holds come before it in the window
        hits = hits[np.argsort(gram[hits], kind="stable")]
        kind = gram[hits]
        back = np.arange(len(hits)) - times[kind]
        before = np.full(len(gram), len(gram), np.int64)
        before[hits] = np.where((back >= 0) & (kind[back] == kind), hits[back], -1)
        both = np.arange(1, longest + 1) + size
        out = []
        for p in starts.tolist():
            common = np.cumsum(before[p : p + longest] < p)
            score = 2 * common / both[: len(common)]
            k = int(score.argmax())
            if score[k] >= self.least:
                out.append((int(common[k]), float(score[k]), -p, p + k, -i))
        return out

    def scan(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """(first line, last line, licence, coefficient) of windows that match and do not overlap.

        Of windows that overlap, the one with most bigrams of its template is taken, then the nearest;
        what is left between those taken is scanned again.
        """
        lines = normalise(text)
        words = [w for line in lines for w in line]
        get = self.number.get
        grams = np.fromiter((get(g, -1) for g in zip(words, words[1:])), np.int64)
        out, left = [], [(0, len(grams))]
        while left:
            start, end = left.pop()
            gram = grams[start:end]
            here = (self.times[:, gram[gram >= 0]] > 0).sum(axis=1)
            able = np.flatnonzero((self.sizes > 0) & (here >= self.share * self.sizes - 1e-9))
            taken: list[tuple[int, int]] = []
            free = np.ones(len(gram) + 1, bool)
            for _, score, first, last, i in sorted((w for i in able.tolist() for w in self.windows(gram, i)), reverse=True):
                if free[-first : last + 2].all():
                    free[-first : last + 2] = False
                    taken.append((-first, last))
                    out.append((start - first, start + last + 1, self.names[-i], score))
            if taken:
                taken.sort()
                ends = [-2, *(b for _, b in taken)]
                # between two windows stand the bigrams of the words that neither holds
                left += [(start + a + 2, start + b - 1) for a, b in zip(ends, [*(a for a, _ in taken), len(gram) + 1]) if b - 1 > a + 2]
        if not out:
            return []
        line = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
        return [(int(line[a]), int(line[b]), name, score) for a, b, name, score in sorted(out)]


def scan_licences(docs: DataFrame, least: float = DICE, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_matches, licences (distinct names, sorted, comma-joined), best (coefficient), matches of every row.

    ``matches`` lists first line:last line:licence, comma-joined. The whole text is read; a null or
    empty text, or one without matches, has 0, "", null and "". Equal rows give equal rows; an empty
    table stays empty; other columns are not read.
    """

    def work(batches):
        scanner = Scanner(templates, least)
        for block in blocks(batches, "text"):
            found = [scanner.scan(t) for t in block.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                block.column("doc_id"), pa.array([len(f) for f in found], pa.int64()),
                pa.array([",".join(sorted({m[2] for m in f})) for f in found], pa.string()),
                pa.array([max((m[3] for m in f), default=None) for f in found], pa.float64()),
                pa.array([",".join(f"{a}:{b}:{n}" for a, b, n, _ in f) for f in found], pa.string()),
            ], ["doc_id", "n_matches", "licences", "best", "matches"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        work, "doc_id long, n_matches long, licences string, best double, matches string"
    )
