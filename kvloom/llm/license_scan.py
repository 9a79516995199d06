"""License scans: normalised text against license templates by Dice coefficient over word bigrams.

Words are runs of letters and digits in lower case. A place of a bigrams shares s of them (repeats counted) with a
template of b bigrams: Dice is 2 s / (a + b). For Dice to reach t, a must lie between b t / (2 - t) and b (2 - t) / t,
and s must be at least b t / (2 - t). Places are therefore only looked for where so many of a template's bigrams stand
within the larger bound; most templates are given up for most texts without a comparison.

Of overlapping places the one with the largest Dice stays, then the longer, then the first, then the first license by
name. Hashes of bigrams find the places; the coefficient that counts is that of the words. Null and empty texts match
nothing; rows with the same id and repeated rows are scanned each for itself, long texts whole. Extra columns do not matter.
An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_parts, mix64, row_chunks, small_batches, span_hashes, word_spans

#: Notices that name a license, and the wording of short licenses.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "bsd-3-clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "bsd-2-clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution."
    ),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "mit": "Released under the MIT License.",
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

#: Typographic marks that separate words.
_MARKS = "‘’“”–—©«»… "
_PLAIN = np.full(256, 32, dtype=np.uint8)
for _b in range(256):
    if chr(_b).isascii() and chr(_b).isalnum():
        _PLAIN[_b] = ord(chr(_b).lower())
    elif _b >= 128:
        _PLAIN[_b] = _b
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """The words as they are compared."""
    return re.sub(r"[^0-9a-z\x80-\U0010FFFF]+", " ", re.sub(r"[A-Z]", lambda m: m[0].lower(), text.translate({ord(c): " " for c in _MARKS}))).split()


def dice(a: list, b: list) -> float:
    """Over the bigrams of two word lists."""
    x, y = Counter(zip(a, a[1:], strict=False)), Counter(zip(b, b[1:], strict=False))
    n = x.total() + y.total()
    return 2 * (x & y).total() / n if n else 0.0


@dataclass
class _Template:
    name: str
    need: Counter  # bigram hash to count
    size: int
    low: int
    high: int
    least: int


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float) -> None:
        self.threshold = threshold
        self.templates: list[_Template] = []
        self.words: dict[str, list[bytes]] = {}
        for name, text in sorted(templates.items()):
            data = " ".join(words_of(text)).encode()
            _, hashes = _bigrams(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
            b = len(hashes)
            self.words[name] = data.split()
            if b:
                # rounding must not lose a bound that is met exactly
                low, high = math.ceil(b * threshold / (2 - threshold) - 1e-9), math.floor(b * (2 - threshold) / threshold + 1e-9)
                self.templates.append(_Template(name, Counter(hashes.tolist()), b, low, high, low))
        self.known = np.unique(np.array([h for t in self.templates for h in t.need], dtype=np.uint64))

    def scan(self, buf: np.ndarray, offsets: np.ndarray) -> list[tuple[int, str, float, int, int]]:
        """(row, license, dice, first word, last word + 1) of each match."""
        buf = _PLAIN[buf]
        firsts, hashes = _bigrams(buf, offsets)
        if not len(hashes) or not len(self.known):
            return []
        k = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        at = np.flatnonzero(self.known[k] == hashes)
        if len(at) == 0:
            return []
        row = np.searchsorted(firsts, at, side="right") - 1
        at, row = at[at + 1 < firsts[row + 1]], row[at + 1 < firsts[row + 1]]  # both words in one text
        value = hashes[at]
        found: dict[int, list] = {}
        for t in self.templates:
            own = np.isin(value, np.array(list(t.need), dtype=np.uint64))
            p, r, v = at[own], row[own], value[own]
            if len(p) < t.least:
                continue
            last = t.least - 1
            start = np.flatnonzero((p[last:] - p[: len(p) - last] < t.high) & (r[last:] == r[: len(r) - last]))
            for i in start.tolist():
                best = self._best(t, p, r, v, i)
                if best:
                    found.setdefault(int(r[i]), []).append((best[0], t.name, int(p[i]), best[1]))
        out = []
        for r, places in found.items():
            taken: list[tuple[int, int]] = []
            for d, name, s, e in sorted(places, key=lambda x: (-x[0], x[2] - x[3], x[2], x[1])):
                if all(e <= a or b <= s for a, b in taken):
                    taken.append((s, e))
                    out.append((r, name, d, s - int(firsts[r]), e - int(firsts[r])))
        return sorted(out, key=lambda x: (x[0], x[3]))

    def _best(self, t: _Template, p: np.ndarray, r: np.ndarray, v: np.ndarray, i: int) -> tuple[float, int] | None:
        """The best place that begins with bigram i and ends with a bigram of the template."""
        seen: Counter = Counter()
        shared, best = 0, None
        for j in range(i, len(p)):
            size = int(p[j] - p[i]) + 1
            if size > t.high or r[j] != r[i]:
                break
            h = int(v[j])
            seen[h] += 1
            shared += seen[h] <= t.need[h]
            d = 2 * shared / (size + t.size)
            if size >= t.low and d >= self.threshold and (best is None or d > best[0]):
                best = (d, int(p[j]) + 2)
        return best


def _bigrams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each text, hash of each word with the next, across texts too)."""
    s, e, firsts = word_spans(buf, offsets)
    h = span_hashes(buf, s, e)
    return firsts, mix64(h[:-1] * _STEP + h[1:])


def verified(scanner: Scanner, buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, str, float, int, int]]:
    """What the scanner finds by hashes, with the Dice coefficient of the words themselves."""
    for row, name, _, first, end in scanner.scan(buf, offsets):
        words = _PLAIN[buf[offsets[row] : offsets[row + 1]]].tobytes().split()[first:end]
        d = dice(words, scanner.words[name])
        if d >= scanner.threshold - 1e-12:
            yield row, name, d, first, end


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row per match: id, license, dice, first_word, end_word."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(templates or TEMPLATES, threshold))
    text = F.translate(F.col(text_col).cast("string"), _MARKS, " " * len(_MARKS)).cast("binary")

    def run(batches):
        for batch in batches:
            buf, off = binary_parts(batch.column(1))
            for a, z in row_chunks(off):
                hits = list(verified(shared.value, buf[off[a] : off[z]], off[a : z + 1] - off[a]))
                if hits:
                    c = list(zip(*hits, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([a + x for x in c[0]])), pa.array(c[1], pa.string()), pa.array(c[2], pa.float64()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int64())],
                        names=[id_col, "license", "dice", "first_word", "end_word"],
                    )

    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("license", T.StringType()), T.StructField("dice", T.DoubleType()),
        T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()),
    ])
    return docs.select(F.col(id_col).alias(id_col), text.alias("_t")).mapInArrow(run, schema)
