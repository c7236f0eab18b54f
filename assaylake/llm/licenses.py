"""License scans: MinHash bands over overlapping windows find templates, exact shingle containment confirms them.

A block of texts is read as one stream of five-word shingles, in windows of doubling sizes that start at every fourth
shingle, so a notice of s shingles lies whole in some window of the first size that is at least s + 3. Each window and
each template has one minimum per hash function over its shingles, and every function is a band of its own. A window
that holds at least 0.8 of a template's shingles has a Jaccard similarity of at least 0.25 with it (``least_similarity``),
so with 40 bands it is missed with a probability of about 1e-5 (``miss_probability``). Candidates are confirmed by the
exact share of the template's shingles among those of one document in the window.

Defined cases: null or empty text and texts of under five words have no licenses; a template needs five words; repeated
rows repeat; a null doc_id passes through; an empty table gives no rows; equal shares keep every template; extra columns
are dropped; texts of any length are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import Bounded, byte_column, map_blocks
from assaylake.llm.license_texts import TEXTS

#: Lines that name a license and openings of license texts, by SPDX name. With the whole texts these are the default templates.
LINES = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-opening": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
TEMPLATES = LINES | TEXTS
SHINGLE, CONTAINMENT, BANDS, STEP = 5, 0.8, 40, 4

#: Everything in ASCII but letters and digits separates words.
_WORDS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_M = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_WORDS).split()


def _hash_word(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """A hash for each run of SHINGLE words."""
    out = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        out = (out * _M) ^ (out >> np.uint64(29)) ^ words[k : k + len(out)]
    return out * _M


def window_size(shingles: int) -> int:
    size = STEP
    while size < shingles + STEP - 1:
        size *= 2
    return size


def least_similarity(shingles: int) -> float:
    """Of a template and a window of its size that holds CONTAINMENT of its shingles."""
    held = -(-CONTAINMENT * shingles // 1)
    return held / (window_size(shingles) + shingles - held)


def miss_probability(similarity: float, bands: int = BANDS) -> float:
    return (1 - similarity) ** bands


def load_templates(folder: str) -> dict[str, str]:
    """Templates from a folder of license texts, one a file, by file name."""
    from pathlib import Path

    return {f.name: f.read_text(encoding="utf-8", errors="replace") for f in sorted(Path(folder).iterdir()) if f.is_file()}


class LicenseScanner:
    def __init__(self, templates: dict[str, str], bands: int = BANDS):
        self.word = Bounded(_hash_word)
        self.a = np.random.default_rng(9).integers(1, 2**63, bands, dtype=np.uint64) | np.uint64(1)
        self.by_size: dict[int, list[tuple[str, np.ndarray, np.ndarray]]] = {}  # name, shingles, minima
        for name, text in templates.items():
            own = np.unique(shingle_hashes(self.hashes(words_of(text.encode()))))
            if not len(own):
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            self.by_size.setdefault(window_size(len(own)), []).append((name, own, np.array([(own * a).min() for a in self.a])))

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.word.__getitem__, words), np.uint64, len(words))

    def scan(self, texts: list[bytes]) -> list[dict[str, float]]:
        """For each text: template -> the largest share of its shingles in one window, where that is at least CONTAINMENT."""
        found: list[dict[str, float]] = [{} for _ in texts]
        words, docs = [], []
        for i, text in enumerate(texts):
            own = self.hashes(words_of(text))
            if len(own) >= SHINGLE:
                words.append(shingle_hashes(own))
                docs.append(i)
        if not words:
            return found
        ends = np.cumsum([len(x) for x in words])
        top = max(self.by_size)
        pad = top + -int(ends[-1]) % STEP
        stream = np.concatenate([*words, np.zeros(pad, np.uint64)])
        hits: set[tuple[int, int, int]] = set()  # size, template, first shingle
        none = np.uint64(2**64 - 1)
        for j, a in enumerate(self.a):
            x = stream * a
            x[ends[-1] :] = none
            low = np.minimum(np.minimum(x[0::STEP], x[1::STEP]), np.minimum(x[2::STEP], x[3::STEP]))
            size = STEP
            while True:
                for t, (_, _, minima) in enumerate(self.by_size.get(size, ())):
                    hits.update((size, t, int(i)) for i in np.flatnonzero(low == minima[j]))
                if size >= top:
                    break
                half = size // STEP
                low = np.minimum(low[:-half], low[half:])
                size *= 2
        for size, t, i in hits:
            name, own, _ = self.by_size[size][t]
            first, last = i * STEP, min(i * STEP + size, int(ends[-1]))
            d = int(np.searchsorted(ends, first, "right"))
            while first < last:  # the documents in the window, one by one
                stop = min(last, int(ends[d]))
                share = float(np.isin(own, stream[first:stop]).mean())
                if share >= CONTAINMENT and share > found[docs[d]].get(name, 0):
                    found[docs[d]][name] = share
                first, d = stop, d + 1
        return found


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, bands: int = BANDS) -> DataFrame:
    """doc_id, n_licenses, licenses (names in order, comma-joined), best_containment (null without one)."""
    templates = templates or TEMPLATES

    def block(scanner: LicenseScanner, batch: pa.RecordBatch) -> dict:
        found = scanner.scan(byte_column(batch, "text"))
        return {"doc_id": batch.column("doc_id"), "n_licenses": [len(x) for x in found], "licenses": [",".join(sorted(x)) for x in found], "best_containment": [max(x.values(), default=None) for x in found]}

    return map_blocks(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "text", block, "doc_id long, n_licenses long, licenses string, best_containment double", make=lambda: LicenseScanner(templates, bands))
