"""Licence scans: a trained paragraph classifier whose predictions are confirmed against templates.

A paragraph is a line of a text; lines of more than ``LONG`` words are looked at in overlapping windows. Features
are hashed word n-grams (one to three words, lower case, letters and digits only), a softmax regression names
the licence family or "unknown". It is fitted on variants of the templates below and on paragraphs of the
corpus itself, a bounded sample (``BACKGROUND`` paragraphs) that stands for "unknown". Half of either is kept
out of the fit to calibrate it: one temperature for the probabilities, and the probability a family needs,
above which at most ``FALSE_ALARMS`` of the kept-out background lie.

A prediction counts when the paragraph also shares enough word pairs with a template of that family. Scanning
reads every whole text once, without a shuffle; templates and weights are of fixed size.

Edge cases: null and empty texts have no paragraph and no licence; repeated rows have equal results; a text may
name several families; a document without an id is scanned like others. An empty table gives an empty result,
without background paragraphs every threshold is one half. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspan.llm.common import SpanHash, chunks, ranges, tidy

BITS = 16
SIZES = (1, 2, 3)
LONG, STEP = 64, 32
BACKGROUND = 4_000
VARIANTS = 120
FALSE_ALARMS = 0.002
# Least share of word pairs of the shorter side that a paragraph and a template must have in common.
SHARED = 0.5

# The licences' public notices, by family.
TEMPLATES = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.",
    ],
}
FAMILIES = ("unknown", *sorted(TEMPLATES))

# Bytes that belong to words, in lower case; all others, but those above ASCII, divide words.
_WORD = np.zeros(256, np.uint8)
for _b in range(256):
    if chr(_b).isascii() and chr(_b).isalnum():
        _WORD[_b] = ord(chr(_b).lower())
    elif _b >= 128:
        _WORD[_b] = _b


@dataclass(frozen=True)
class Model:
    """Weights per hashed n-gram and family, biases, temperature, and the least probability of a family."""

    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    needed: float


@dataclass(frozen=True)
class Units:
    """Paragraphs of a batch of texts: their document, place in bytes and hashed n-grams."""

    owner: np.ndarray
    start: np.ndarray
    end: np.ndarray
    grams: np.ndarray
    unit: np.ndarray
    pairs: np.ndarray
    pair_unit: np.ndarray


def units(data: np.ndarray, offsets: np.ndarray, whole: bool = False) -> Units:
    """The paragraphs of texts; ``whole``: each text is one, whatever its length."""
    n = len(data)
    lower = _WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    line = np.zeros(n, bool)
    line[1:] = data[:-1] == 10
    line |= edge[:-1]
    inside = lower > 0
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    begins = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    tokens = SpanHash(lower)(begins, ends)
    # Lines with words, in windows of at most LONG words.
    number = np.cumsum(line)[begins] if len(begins) else np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(begins) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(begins)))
    many = np.ones_like(count) if whole else np.maximum(1, -(-(count - (LONG - STEP)) // STEP))
    of = np.repeat(np.arange(len(first)), many)
    low = first[of] + STEP * (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many))
    high = first[of] + count[of] if whole else np.minimum(low + LONG, first[of] + count[of])
    hashes = SpanHash(tokens)
    shift = np.uint64(64 - BITS)
    grams, unit = [], []
    pairs = pair_unit = np.zeros(0, np.int64)
    for size in SIZES:
        each = np.maximum(high - low - size + 1, 0)
        at = ranges(low, each)
        value = hashes(at, at + size)
        grams.append((value >> shift).astype(np.int32))
        unit.append(np.repeat(np.arange(len(low)), each))
        if size == 2:
            pairs, pair_unit = value, unit[-1]
    gram, unit_of = np.concatenate(grams), np.concatenate(unit)
    order = np.argsort(unit_of, kind="stable")
    owner = np.searchsorted(offsets, begins[low], side="right") - 1 if len(low) else np.zeros(0, np.int64)
    start, end = (begins[low], ends[high - 1]) if len(low) else (low, low)
    return Units(owner, start, end, gram[order], unit_of[order], pairs, pair_unit)


def logits(found: Units, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Mean weight of a paragraph's n-grams, scaled by the root of their number, plus bias."""
    total = len(found.start)
    if not total:
        return np.zeros((0, len(bias)))
    starts = np.searchsorted(found.unit, np.arange(total))
    sums = np.add.reduceat(weights[found.grams], starts, axis=0).astype(np.float64)
    return sums / np.sqrt(np.diff(np.append(starts, len(found.unit))))[:, None] + bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def as_units(paragraphs: list[str]) -> Units:
    """One unit per paragraph; each must have a word."""
    raw = [" ".join(p.split()).encode("utf-8") for p in paragraphs]
    offsets = np.cumsum([0, *map(len, raw)])
    return units(np.frombuffer(b"".join(raw), np.uint8), offsets, whole=True)


def has_word(text: str) -> bool:
    return bool(_WORD[np.frombuffer(text.encode("utf-8"), np.uint8)].any())


def template_pairs() -> list[list[np.ndarray]]:
    found = []
    for family in FAMILIES[1:]:
        own = as_units(TEMPLATES[family])
        found.append([np.unique(own.pairs[own.pair_unit == k]) for k in range(len(own.start))])
    return found


def similarity(pairs: np.ndarray, templates: list[np.ndarray]) -> float:
    """Greatest share of the shorter side's word pairs that a template has in common with the paragraph."""
    pairs = np.unique(pairs)
    return max((len(np.intersect1d(pairs, t)) / max(1, min(len(pairs), len(t))) for t in templates), default=0.0)


def background(docs: DataFrame, rows: int = BACKGROUND) -> list[str]:
    """At most ``rows`` distinct paragraphs of the corpus, those with the least hashes."""
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).where("length(line) > 20")
    # About four times as many as wanted go on, so that equal lines meet without moving the corpus.
    share = max(1, lines.count() // (4 * rows))
    drawn = lines.where(F.pmod(F.xxhash64("line"), F.lit(share)) == 0).groupBy("line").agg(F.first(F.xxhash64("line")).alias("hash"))
    return [r["line"][:4000] for r in drawn.orderBy(F.shiftrightunsigned("hash", 1), "line").limit(rows).collect()]


def fit(docs: DataFrame) -> Model:
    rng = np.random.RandomState(8)
    plain = [" ".join(p.split()[:LONG]) for p in background(docs) if has_word(p)]
    plain = [p for p in plain if has_word(p)]
    words = [w for p in plain[:500] for w in p.split()] or ["text"]
    texts, labels = [], []
    for k, family in enumerate(FAMILIES[1:], start=1):
        for template in TEMPLATES[family]:
            parts = template.split()
            for _ in range(VARIANTS):
                low = rng.randint(0, max(1, len(parts) // 3)) if len(parts) > 12 and rng.rand() < 0.5 else 0
                some = [w for w in parts[low:] if rng.rand() > 0.08]
                some = some if has_word(" ".join(some)) else parts
                about = [words[i] for i in rng.randint(0, len(words), rng.randint(0, 7))]
                cut = rng.randint(0, len(about) + 1)
                texts.append(" ".join([*about[:cut], *some, *about[cut:]]))
                labels.append(k)
    known = template_pairs()
    own = as_units(plain) if plain else None
    for k, paragraph in enumerate(plain):
        if max(similarity(own.pairs[own.pair_unit == k], t) for t in known) < SHARED / 2:
            texts.append(paragraph)
            labels.append(0)
    y = np.array(labels)
    found = as_units(texts)
    train = rng.rand(len(y)) < 0.5
    row, col = found.unit, found.grams
    scale = 1 / np.sqrt(np.bincount(row, minlength=len(y)))
    used, place = np.unique(col, return_inverse=True)
    on = train[row]
    row_t, col_t = row[on], place[on]
    weights, bias = np.zeros((len(used), len(FAMILIES))), np.zeros(len(FAMILIES))
    target = np.eye(len(FAMILIES))[y]
    # Plain gradient steps with momentum on the mean loss; the features of a paragraph have norm one or so.
    speed, speed_bias = np.zeros_like(weights), np.zeros_like(bias)
    share = train / max(1, train.sum())
    for _ in range(150):
        z = np.stack([np.bincount(row_t, weights[col_t, c], len(y)) for c in range(len(FAMILIES))], axis=1) * scale[:, None] + bias
        g = (softmax(z) - target) * share[:, None]
        gw = np.stack([np.bincount(col_t, (g[:, c] * scale)[row_t], len(used)) for c in range(len(FAMILIES))], axis=1)
        speed, speed_bias = 0.9 * speed - 2.0 * (gw + 1e-4 * weights), 0.9 * speed_bias - 0.5 * g.sum(axis=0)
        weights, bias = weights + speed, bias + speed_bias
    full = np.zeros((1 << BITS, len(FAMILIES)), np.float32)
    full[used] = weights
    held = ~train
    z = logits(found, full, bias)[held]
    truth = y[held]
    heats = np.geomspace(0.25, 4, 17)
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(truth)), truth], 1e-12)).mean() if len(truth) else 0.0 for t in heats]
    temperature = float(heats[int(np.argmin(loss))])
    p = softmax(z / temperature)[truth == 0]
    needed = max(0.5, float(np.quantile(1 - p[:, 0], 1 - FALSE_ALARMS))) if len(p) else 0.5
    return Model(full, bias, temperature, min(needed, 0.95))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per document: paragraphs looked at, and each licence notice with family, place in bytes, probability, likeness."""
    model = model or fit(docs)
    weights, bias, temperature, needed = model.weights, model.bias, model.temperature, model.needed
    known = template_pairs()

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, notices = [], []
            for start, stop, data, offsets in chunks(batch.column("text"), 1 << 18):
                found = units(data, offsets)
                p = softmax(logits(found, weights, bias) / temperature)
                own: list[list[dict]] = [[] for _ in range(stop - start)]
                best = p[:, 1:].argmax(axis=1) + 1 if len(p) else np.zeros(0, np.int64)
                for k in np.flatnonzero(p[np.arange(len(p)), best] >= needed):
                    low, high = np.searchsorted(found.pair_unit, [k, k + 1])
                    alike = similarity(found.pairs[low:high], known[best[k] - 1])
                    if alike >= SHARED:
                        doc = int(found.owner[k])
                        own[doc].append(
                            {
                                "family": FAMILIES[best[k]],
                                "start": int(found.start[k] - offsets[doc]),
                                "end": int(found.end[k] - offsets[doc]),
                                "probability": float(p[k, best[k]]),
                                "likeness": alike,
                            }
                        )
                counts.extend(np.bincount(found.owner, minlength=stop - start).tolist())
                notices.extend(own)
            kind = pa.list_(
                pa.struct(
                    [("family", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64()), ("likeness", pa.float64())]
                )
            )
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(notices, kind)],
                names=["doc_id", "n_paragraphs", "notices"],
            )

    notice = T.StructType(
        [T.StructField("family", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
        + [T.StructField(name, T.DoubleType()) for name in ("probability", "likeness")]
    )
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("n_paragraphs", T.LongType()),
            T.StructField("notices", T.ArrayType(notice)),
        ]
    )
    return docs.select("doc_id", "text").mapInArrow(tidy(scanned), schema)


def licences(docs: DataFrame) -> DataFrame:
    """Per document: paragraphs, notices, the families named (sorted), and the most certain notice's probability."""
    return scan(docs).select(
        "doc_id",
        "n_paragraphs",
        F.size("notices").cast("bigint").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct("notices.family")), ",").alias("families"),
        F.array_max("notices.probability").alias("probability"),
    )
