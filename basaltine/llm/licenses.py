"""License scans by MinHash bands over overlapping text windows.

Texts become tokens (runs of letters, digits and non-ASCII bytes, A-Z lowered),
tokens become shingles of five (of the whole template, if it has fewer).  Every
window of a text with as many shingles as a template has gets one MinHash value
for each of ``BANDS`` hash functions; a band that equals the template's
retrieves it.  Windows start at every token, so some window lines up with each
copy.  A copy that keeps three quarters of the template's shingles has, on that
window, a Jaccard similarity of at least 0.6, so that with 16 bands of one row
a copy is missed with a chance of 0.4 ** 16, under 1e-6.  Retrieved templates
are verified: the share of the template's shingles that occur in the text
within two window lengths must be 0.75 or more.

Defined results: null or empty texts have no license; one row for each document
and license that it holds, with the best containment and the place of its first
best window; repeated rows are scanned each on their own; a null id stays null;
an empty table gives an empty result.  Only doc_id and text are read; further
columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .decontaminate import tokens
from .textkit import mix, slices

SIZE = 5
BANDS = 16
CONTAINED = 0.75
_BITS = 16

# License notices as they are published.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

_ODD = [np.uint64(pow(0xBF58476D1CE4E5B9, 2 * k + 1, 1 << 64)) for k in range(BANDS)]
_PLACE = [np.uint64(pow(0xA0761D6478BD642F, 2 * k + 1, 1 << 64)) for k in range(SIZE)]


def _grams(hashes: np.ndarray, size: int) -> np.ndarray:
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(size))
    for k in range(size):
        out += hashes[k : k + n] * _PLACE[k]
    return mix(out)


class Templates:
    """Templates by shape (shingle size, shingle count), with their band values."""

    def __init__(self, texts: dict[str, str]):
        self.names = list(texts)
        self.shapes: dict[tuple[int, int], list[int]] = {}
        self.grams = []
        for k, text in enumerate(texts.values()):
            raw = np.frombuffer(text.encode(), np.uint8)
            hashes, _ = tokens(raw, np.array([0, len(raw)]))
            size = min(SIZE, len(hashes))
            if not size:
                self.grams.append(np.zeros(0, np.uint64))
                continue
            grams = _grams(hashes, size)
            self.grams.append(np.unique(grams))
            self.shapes.setdefault((size, len(grams)), []).append(k)
        self.bands = {}
        for shape, of in self.shapes.items():
            tables = []
            for odd in _ODD:
                value = np.array([mix(self.grams[k] * odd).min() for k in of])
                there = np.zeros(1 << _BITS, bool)
                there[value & np.uint64((1 << _BITS) - 1)] = True
                tables.append((value, there))
            self.bands[shape] = tables

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int, float, int]]:
        """(document, template, containment, token place) of each license found."""
        retrieved = set()
        grams_of = {size: _grams(hashes, size) for size in {s for s, _ in self.shapes}}
        mixed: dict[tuple[int, int], np.ndarray] = {}
        for (size, count), of in self.shapes.items():
            grams = grams_of[size]
            wide = min(count, len(grams))  # a slice shorter than the window is one window
            if not wide:
                continue
            for band, (value, there) in enumerate(self.bands[size, count]):
                if (size, band) not in mixed:
                    mixed[size, band] = mix(grams * _ODD[band])
                low, reach = mixed[size, band], 1
                while reach < wide:
                    step = min(reach, wide - reach)
                    low = np.minimum(low[: len(low) - step], low[step:])
                    reach += step
                at = np.flatnonzero(there[low & np.uint64((1 << _BITS) - 1)])
                for k, v in zip(of, value):
                    place = at[low[at] == v]
                    # A window may reach over several short documents; each is verified.
                    begin, end = (np.searchsorted(first, p, "right") - 1 for p in (place, place + wide - 1))
                    for d in np.unique(np.stack([begin, end]), axis=1).T.tolist() if len(place) else []:
                        retrieved.update((doc, k) for doc in range(d[0], d[1] + 1))
        out = []
        for doc, k in sorted(retrieved):
            if doc >= len(first) - 1:
                continue
            size = next(s for (s, _), of in self.shapes.items() if k in of)
            best, place = self._contained(_grams(hashes[first[doc] : first[doc + 1]], size), self.grams[k])
            if best >= CONTAINED:
                out.append((doc, k, best, place))
        return out

    @staticmethod
    def _contained(text: np.ndarray, template: np.ndarray) -> tuple[float, int]:
        """Best share of the template's shingles within two window lengths, and where that begins."""
        at = np.flatnonzero(np.isin(text, template))
        if not len(at):
            return 0.0, 0
        which = np.searchsorted(template, text[at])
        best, place, lo, have, held = 0, 0, 0, {}, 0
        for hi, w in enumerate(which.tolist()):
            have[w] = have.get(w, 0) + 1
            held += have[w] == 1
            while at[hi] - at[lo] >= 2 * len(template):
                have[which[lo]] -= 1
                held -= have[which[lo]] == 0
                lo += 1
            if held > best:
                best, place = held, int(at[lo])
        return best / len(template), place


def scan(documents: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, containment and token place of every license in every document."""
    shared = documents.sparkSession.sparkContext.broadcast(Templates(templates or TEMPLATES))  # a fixed list of notices
    names = ["doc_id", "license", "containment", "token"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for lo, hi, data, off in slices(batch.column("text")):
                found = known.hits(*tokens(data, off))
                if found:
                    rows = list(zip(*found))
                    ids = batch.column("doc_id").slice(lo, hi - lo).take(pa.array(rows[0]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([known.names[k] for k in rows[1]]), pa.array(rows[2], pa.float64()), pa.array(rows[3], pa.int64())], names)

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, license string, containment double, token long")
