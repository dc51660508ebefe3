"""License scans: a trained paragraph classifier with a calibrated unknown class, confirmed against templates.

A paragraph ends at a blank line; its lines are read joined, without comment leads, in overlapping windows,
and each on its own, so that a one-line notice among prose stands out. Sparse features are hashed word uni- and bigrams
that the templates hold; a multinomial logistic regression over licence families and "unknown" is trained
on corrupted templates and on prose, and calibrated on a held-out part by a temperature. A prediction
counts if a template of the family covers it: enough of the template's bigrams stand in the paragraph.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorloom.llm.common import apart, bounded_batches, lean_arrays, mix64, ngram_hashes, string_chunks, word_hashes

UNKNOWN = "unknown"
#: Words in a window of a long paragraph, and the step between windows.
WINDOW, STEP = 96, 48
#: The share of a template's bigrams that confirms it, and the least probability.
COVERED, PROBABLE = 0.7, 0.5

# fixed values: phrases of common licences, by family
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GNU GPL version 2.",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License, version 3.",
    ),
    "AGPL": (
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Affero General Public License, version 3.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license",
        "Released under the BSD 3-Clause License.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
    ),
    "EPL": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal."),
    "CC-BY": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "CC-BY-SA": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."),
    "CC-BY-NC": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."),
    "CC-BY-ND": ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Licensed under CC BY-ND 4.0."),
}

# fixed values: prose near the subject that grants nothing
NEAR_MISSES = (
    "All rights reserved. No part of this publication may be reproduced without permission.",
    "He renewed his driver's license under the new rules of the state.",
    "The software was released under a different name in the following year.",
    "The committee granted permission to the public to use the hall free of charge.",
    "Our general terms and conditions apply to any work done under this contract.",
    "The Apache helicopter was distributed over two bases.",
    "She studied at MIT and published the source of her idea.",
    "Version 2.0 of the product is subject to the usual warranty.",
    "The license plate was copied and the notice appeared in the paper.",
    "Creative people share their work with the commons.",
)

# fixed values: what names each of the GNU families
_GNU = {"GPL": ("GNU General", "GNU GPL"), "LGPL": ("GNU Lesser", "GNU LGPL"), "AGPL": ("GNU Affero", "GNU AGPL")}

_map = np.full(256, 0x20, np.uint8)
_map[128:] = np.arange(128, 256)
for _c in range(128):
    if chr(_c).isalnum():
        _map[_c] = ord(chr(_c).lower())


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word; everything but letters, digits and non-ASCII bytes separates."""
    start, _, h = word_hashes(_map[data], lower=False)
    return start, h


def _of_text(text: str) -> np.ndarray:
    return _words(np.frombuffer(text.encode(), np.uint8))[1]


def _features(words: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate([mix64(words), ngram_hashes(words, 2)]))


@lru_cache(maxsize=1)
def _gnu_names() -> dict[str, np.ndarray]:
    return {f: np.concatenate([ngram_hashes(_of_text(n), 2) for n in names]) for f, names in _GNU.items()}


@dataclass
class Model:
    families: list[str]
    known: np.ndarray  # sorted features of the templates
    weights: np.ndarray  # a row for each, a column for each family
    bias: np.ndarray
    temperature: float
    templates: dict[str, list[np.ndarray]]
    telling: np.ndarray  # sorted bigrams of the templates

    def vector(self, words: np.ndarray) -> np.ndarray:
        f = _features(words)
        at = np.searchsorted(self.known, f)
        at[at == len(self.known)] = 0
        return at[self.known[at] == f]

    def covered(self, family: str, pairs: np.ndarray) -> float:
        """The largest share of a template's bigrams among the pairs."""
        return max(np.isin(t, pairs).mean() for t in self.templates[family])

    def classify(self, words: np.ndarray) -> tuple[str, float]:
        """The family, if a template confirms it, and its probability; else unknown."""
        at = self.vector(words)
        z = (self.bias + self.weights[at].sum(axis=0) / np.sqrt(max(1, len(at)))) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        pairs = ngram_hashes(words, 2)
        # the GNU families share their notices but for the name: it decides, and their probability is one
        gnu = [self.families.index(f) for f in _GNU]
        named = [k for k in gnu if np.isin(_gnu_names()[self.families[k]], pairs).any()]
        both = p[gnu].sum()
        p[gnu] = 0
        if named:
            p[max(named, key=lambda k: (self.covered(self.families[k], pairs), -gnu.index(k)))] = both
        for k in np.argsort(-p):
            family = self.families[k]
            if family == UNKNOWN or p[k] < PROBABLE:
                break
            if self.covered(family, pairs) >= COVERED:
                return family, float(p[k])
        return UNKNOWN, float(p[self.families.index(UNKNOWN)])


@lru_cache(maxsize=1)
def train(seed: int = 5, copies: int = 40) -> Model:
    """The classifier, from the fixed templates; the same on every machine."""
    rng = np.random.default_rng(seed)
    texts = {f: [_of_text(t) for t in ts] for f, ts in TEMPLATES.items()}
    misses = [_of_text(t) for t in NEAR_MISSES]
    known = np.unique(np.concatenate([_features(w) for ws in texts.values() for w in ws]))
    families = [*TEMPLATES, UNKNOWN]
    pool = np.concatenate([w for ws in texts.values() for w in ws] + misses)

    def noise(n: int) -> np.ndarray:
        """Words that no template knows, and some that they do, out of order."""
        own = mix64(rng.integers(0, 1 << 62, n).astype(np.uint64))
        return np.where(rng.random(n) < 0.25, rng.choice(pool, n), own)

    samples: list[tuple[np.ndarray, int]] = []
    for k, f in enumerate(TEMPLATES):
        for w in texts[f]:
            for _ in range(copies):
                kept = w[rng.random(len(w)) > rng.choice([0.0, 0.05, 0.12])]
                samples.append((np.concatenate([noise(rng.integers(0, 30)), kept, noise(rng.integers(0, 30))]), k))
    for _ in range(copies * 12):
        samples.append((noise(int(rng.integers(1, 90))), len(families) - 1))
    for w in misses:
        for _ in range(copies):
            samples.append((np.concatenate([noise(rng.integers(0, 12)), w[rng.random(len(w)) > 0.1], noise(rng.integers(0, 12))]), len(families) - 1))
    model = Model(families, known, np.zeros((len(known), len(families))), np.zeros(len(families)), 1.0, {f: [np.unique(ngram_hashes(w, 2)) for w in ws] for f, ws in texts.items()}, np.unique(np.concatenate([ngram_hashes(w, 2) for ws in texts.values() for w in ws])))
    x = np.zeros((len(samples), len(known)), np.float32)
    for i, (w, _) in enumerate(samples):
        at = model.vector(w)
        x[i, at] = 1 / np.sqrt(max(1, len(at)))
    y = np.array([k for _, k in samples])
    fit = rng.random(len(y)) < 0.8
    one_hot = np.eye(len(families), dtype=np.float32)[y]

    def logits(rows):
        return x[rows] @ model.weights.astype(np.float32) + model.bias.astype(np.float32)

    def softmax(z):
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    for step in range(300):  # full-batch gradient with a mild ridge
        g = (softmax(logits(fit)) - one_hot[fit]) / fit.sum()
        rate = 40.0 if step < 200 else 15.0
        model.weights -= rate * (x[fit].T @ g + 2e-5 * model.weights)
        model.bias -= rate * 0.1 * g.sum(axis=0)
    z = logits(~fit)
    loss = {t: -np.log(softmax(z / t)[np.arange(len(z)), y[~fit]] + 1e-12).mean() for t in (0.5, 0.7, 1.0, 1.4, 2.0)}
    model.temperature = min(loss, key=loss.get)
    return model


# fixed values: words that lead a comment line in batch files, m4 macros and Fortran
_LEADS = np.array([_of_text(w)[0] for w in ("rem", "dnl", "c")])


class _Cover:
    """Which templates may be covered by a set of telling bigrams."""

    def __init__(self, model: Model):
        sets = [t for ts in model.templates.values() for t in ts]
        self.holds = np.stack([np.isin(model.telling, t) for t in sets], axis=1).astype(np.int16)
        self.least = np.array([COVERED * len(t) for t in sets])
        self.few = max(1, int(np.ceil(self.least.min())))

    def any(self, ids: np.ndarray) -> bool:
        return bool((self.holds[np.unique(ids)].sum(axis=0) >= self.least - 1e-9).any())


def _found(model: Model, cover: _Cover, h: np.ndarray, unit: np.ndarray, hits: np.ndarray, ids: np.ndarray) -> dict[int, tuple[int, dict[str, float]]]:
    """Per unit of words that holds a licence its first word and the best probability of each family."""
    first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    size = np.diff(np.append(first, len(unit)))
    # windows of each unit, and of those the ones with enough hits for the smallest template
    n = np.maximum(1, -(-(size - STEP) // STEP))
    of = np.repeat(np.arange(len(first)), n)
    lo = first[of] + STEP * (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n))
    hi = np.minimum(lo + WINDOW, first[of] + size[of])
    a, b = np.searchsorted(hits, lo), np.searchsorted(hits, hi - 1)
    out: dict[int, tuple[int, dict[str, float]]] = {}
    for w in np.flatnonzero(b - a >= cover.few):
        if not cover.any(ids[a[w] : b[w]]):
            continue
        family, p = model.classify(h[lo[w] : hi[w]])
        if family != UNKNOWN:
            _, best = out.setdefault(int(unit[lo[w]]), (int(first[of[w]]), {}))
            best[family] = max(p, best.get(family, 0))
    return out


FOUND = "struct<families:array<string>,n_paragraphs:bigint,score:double>"


def scan(column: pa.Array) -> list[dict]:
    """Per text the families found, sorted, the paragraphs that hold one, and the highest probability."""
    model, out = train(), []
    cover = _Cover(model)
    for _, _, data, offsets in string_chunks(column):
        data, offsets = apart(data, offsets)
        start, h = _words(data)
        # a line feed, a carriage return without one, or a text's end closes a line
        alone = np.flatnonzero(data == 0x0D)
        alone = alone[data[np.minimum(alone + 1, len(data) - 1)] != 0x0A]
        ends = np.union1d(np.union1d(np.flatnonzero(data == 0x0A), alone), offsets[1:])
        line = np.searchsorted(ends, start, "right")
        lead = np.isin(h, _LEADS)
        lead[1:] &= line[1:] != line[:-1]
        start, h, line = start[~lead], h[~lead], line[~lead]
        if len(h) < 2:
            out += [{"families": [], "n_paragraphs": 0, "score": None}] * (len(offsets) - 1)
            continue
        text = np.searchsorted(offsets, start, "right") - 1
        # a line without a word, or a text's end, closes a paragraph
        fresh = (np.diff(line) > 1) | (np.diff(text) > 0)
        block = np.concatenate([[0], np.cumsum(fresh)])
        pairs = ngram_hashes(h, 2)
        at = np.searchsorted(model.telling, pairs)
        at[at == len(model.telling)] = 0
        hits = np.flatnonzero((model.telling[at] == pairs) & ~fresh)
        ids = at[hits]
        found: dict[int, list] = defaultdict(list)
        by_line = _found(model, cover, h, line, hits, ids)
        by_block = _found(model, cover, h, block, hits, ids)
        held = defaultdict(set)
        for word, best in by_line.values():
            found[int(text[word])].append(best)
            held[int(block[word])] |= set(best)
        for k, (word, best) in by_block.items():
            # what a line of the paragraph holds is counted with the line
            if not set(best) <= held[k]:
                found[int(text[word])].append(best)
        for i in range(len(offsets) - 1):
            own = found.get(i, [])
            every = {f: max(b.get(f, 0) for b in own) for b in own for f in b}
            out.append({"families": sorted(every), "n_paragraphs": len(own), "score": max(every.values(), default=None)})
    return out


def _scanned(texts: pa.Array) -> pa.Array:
    kind = pa.struct([("families", pa.list_(pa.string())), ("n_paragraphs", pa.int64()), ("score", pa.float64())])
    return pa.array(scan(texts), kind)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """docs -> all columns and ``license``: a struct of families, n_paragraphs and score over the whole text.

    A null or empty text has no families and a null score. Repeated rows and null ids pass through; a
    column named license is replaced. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    return docs.withColumn("license", F.arrow_udf(lean_arrays(_scanned), FOUND)(F.col("text").cast("string")))
