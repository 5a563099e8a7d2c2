"""License scans: MinHash bands over overlapping windows retrieve templates, shingle containment verifies them.

Texts and templates are tokens (runs of ASCII letters and digits and other non-ASCII characters, A-Z in lower case) in
shingles of SHINGLE tokens. A template with m shingles belongs to the size class c, the least power of two that's m or
more. Windows of class c have c + step shingles and begin at every step = max(1, c / 4) shingles, so that any c shingles in a row
lie within one window, in any document and at any place.

The signature of a window is the least of its shingles under each of HASHES hash functions; each is a band of its own (one
row a band). A template of which SIMILARITY is in the window shares at least s = 0.8 m / (w + 0.2 m) of the shingles of both,
where w is the window's size and m > c / 2; that's 0.22 or more, and HASHES = 96 bands all miss with probability
(1 - 0.22) ** 96 < 1e-10. Windows without any shingle of any template cannot share a least shingle with one, and
are passed over before their signatures are computed.

A retrieved template is verified exactly: the share of its shingles that the window holds must reach SIMILARITY. Windows
of one template that overlap or touch are one match, from the first to the last shingle of the template in them.

Templates of fewer tokens than SHINGLE are one shingle as a whole, of their own length. Defined results: null and empty
texts have no matches; templates without tokens are never found; repeated rows repeat; an empty table gives an
empty result; long texts are scanned whole; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import documents, pieces, text_bytes
from .decontaminate import tokens, windows
from .texthash import LOWER, PUNCT, U, mix, spans

SHINGLE = 5
SIMILARITY = 0.8
HASHES = 96

#: Notices by which licenses are named or granted: (id, text). Fixed values.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


class Catalogue:
    """Templates by shingle length and size class, with their signatures."""

    def __init__(self, templates: list[tuple[str, str]], shingle: int = SHINGLE, hashes: int = HASHES):
        self.ids = [t[0] for t in templates]
        self.salts = mix(np.arange(1, hashes + 1, dtype=U) * U(0xA0761D6478BD642F))
        self.sets: list[np.ndarray] = []
        self.groups: dict[tuple[int, int], list[int]] = {}
        h, cuts = tokens(*text_bytes(pa.array([t[1] for t in templates], pa.string())))
        for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            n = min(shingle, b - a)
            own = np.unique(windows(h[a:b], n)) if n else h[:0]
            self.sets.append(own)
            if len(own):
                size = 1 << max(0, int(len(own) - 1).bit_length())
                self.groups.setdefault((n, size), []).append(k)
        self.all = {n: np.unique(np.concatenate([self.sets[k] for (m, _), ks in self.groups.items() if m == n for k in ks])) for n, _ in self.groups}
        self.bands = {g: np.array([[mix(self.sets[k] ^ s).min() for s in self.salts] for k in ks], U) for g, ks in self.groups.items()}


def step_of(size: int) -> int:
    return max(1, size // 4)


def retrieve(w: np.ndarray, size: int, cat: Catalogue, group: tuple[int, int], start: int, end: int, exact: bool = False):
    """(window's first shingle, its end, template) of the windows over the shingles [start, end) of one document, whose grid
    begins at start: those that share a band, or with exact, all."""
    step = step_of(size)
    known = cat.all[group[0]]
    own = w[start:end]
    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
    hits = np.flatnonzero(known[at] == own)
    if not len(hits):
        return []
    width = size + step
    # the windows that hold one of the hits
    last = max(0, -(-(len(own) - width) // step))
    first_of = np.maximum(0, -(-(hits - width + 1) // step))
    grid = np.unique(np.concatenate([np.minimum(first_of + i, np.maximum(hits // step, first_of)) for i in range(width // step + 1)]))
    grid = np.unique(np.minimum(grid, last))
    out = []
    for g in grid.tolist():
        a = g * step
        b = min(len(own), a + width)
        part = own[a:b]
        if exact:
            who = cat.groups[group]
        else:
            signature = mix(part[None, :] ^ cat.salts[:, None]).min(axis=1)
            near = (cat.bands[group] == signature).any(axis=1)
            who = [cat.groups[group][i] for i in np.flatnonzero(near).tolist()]
        out += [(start + a, start + b, k) for k in who]
    return out


def scan(h: np.ndarray, cuts: np.ndarray, cat: Catalogue, similarity: float = SIMILARITY, exact: bool = False) -> list[tuple[int, int, int, int, float]]:
    """(row, template, first token, end token, containment) of the matches in rows of tokens."""
    found = []
    for (n, size), _ in cat.groups.items():
        w = windows(h, n)
        if not len(w):
            continue
        known = cat.all[n]
        hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, w), len(known) - 1)] == w)
        rows = np.unique(np.searchsorted(cuts, hit, side="right") - 1)
        for r in rows.tolist():
            start, end = int(cuts[r]), int(cuts[r + 1]) - n + 1
            if end <= start:
                continue
            runs: dict[int, list] = {}
            for a, b, k in retrieve(w, size, cat, (n, size), start, end, exact):
                in_it = np.isin(w[a:b], cat.sets[k])
                share = len(np.unique(w[a:b][in_it])) / len(cat.sets[k])
                if share < similarity:
                    continue
                at = np.flatnonzero(in_it) + a
                first, last = int(at[0]), int(at[-1]) + 1
                runs_k = runs.setdefault(k, [])
                if runs_k and a <= runs_k[-1][3]:
                    run = runs_k[-1]
                    run[0], run[1], run[2], run[3] = min(run[0], first), max(run[1], last), max(run[2], share), b
                else:
                    runs_k.append([first, last, share, b])
            found += [(r, k, a - start, b - start + n - 1, share) for k, rs in runs.items() for a, b, share, _ in rs]
    return found


def matches(docs: DataFrame, templates: list[tuple[str, str]] | None = None, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, license_id, template, first_char, end_char (code points), containment: one row per match."""
    templates = TEMPLATES if templates is None else templates  # a fixed list, or a caller's own
    schema = "doc_id long, license_id string, template int, first_char long, end_char long, containment double"

    def run(batches):
        cat = Catalogue(templates)
        for batch in pieces(batches):
            buf, offsets = text_bytes(batch.column(1))
            h, cuts = tokens(buf, offsets)
            found = scan(h, cuts, cat, similarity) if cat.groups else []
            rows = [x[0] for x in found]
            first, end = [], []
            if found:
                starts, ends, _ = spans(LOWER[buf], offsets, PUNCT)
                chars = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
                at = cuts[np.array(rows)]
                base = chars[offsets[np.array(rows)]]
                first = chars[starts[at + np.array([x[2] for x in found])]] - base
                end = chars[ends[at + np.array([x[3] for x in found]) - 1]] - base
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())), pa.array([cat.ids[x[1]] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int32()),
                    pa.array(first, pa.int64()), pa.array(end, pa.int64()), pa.array([x[4] for x in found], pa.float64()),
                ],
                names=["doc_id", "license_id", "template", "first_char", "end_char", "containment"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(documents(spark, sf_dir))
