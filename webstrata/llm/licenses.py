"""License scans by a trained paragraph classifier.

A sparse logistic regression over hashed word n-grams, one class per licence family and one for
anything else, is trained on notices of the families (whole, in part, with words dropped and strange
words around) and on paragraphs of the corpus, and calibrated on wordings and paragraphs held out.
Every paragraph of every text is scored: each line, and windows of words over the lines of a block
(between blank lines), since notices are often wrapped.  What the classifier gives to a family counts
if a template of that family is found there.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm.common import hashed_sample, slices

#: Notices by family (SPDX names), as licensors write them.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
        "This project is licensed under the terms of the MIT license.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "CC-BY-SA": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "CC-BY-NC": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released into the public domain under CC0 1.0.",
        "CC0 1.0 Universal Public Domain Dedication",
    ],
    "Proprietary": [
        "All rights reserved.",
        "No part of this publication may be reproduced, distributed or transmitted in any form without the prior written permission of the publisher.",
        "This document is confidential and proprietary. Unauthorized copying is strictly prohibited.",
    ],
}
#: Titles of licence texts; a line is one if it holds all of it and at most two words more.
TITLES: dict[str, list[str]] = {
    "Apache-2.0": ["Apache License Version 2.0", "Apache License 2.0"],
    "MIT": ["MIT License"],
    "GPL": ["GNU General Public License"],
    "LGPL": ["GNU Lesser General Public License"],
    "AGPL": ["GNU Affero General Public License"],
    "BSD": ["BSD License", "BSD 2-Clause License", "BSD 3-Clause License"],
    "MPL-2.0": ["Mozilla Public License Version 2.0"],
    "ISC": ["ISC License"],
    "EPL-2.0": ["Eclipse Public License v2.0"],
    "BSL-1.0": ["Boost Software License"],
    "CC0": ["CC0 1.0 Universal"],
}
#: Other wordings, never trained on; the probabilities are calibrated on them.
HELD_OUT: dict[str, list[str]] = {
    "Apache-2.0": ["The code is made available under the Apache License, Version 2.0; see the file LICENSE.", "Code licensed under the Apache 2.0 license"],
    "MIT": ["Distributed under the MIT license, see LICENSE for details.", "obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software"],
    "GPL": ["is distributed under the terms of the GNU General Public License version 2 or later", "Licensed under the GNU GPL v3."],
    "LGPL": ["You may use this library under the GNU Lesser General Public License (LGPL) version 2.1."],
    "AGPL": ["The server is covered by the GNU Affero General Public License v3 (AGPL)."],
    "BSD": ["This file is released under a 3-clause BSD license.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions"],
    "MPL-2.0": ["The contents of this file are subject to the Mozilla Public License Version 2.0"],
    "ISC": ["Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"],
    "Unlicense": ["We dedicate this free and unencumbered software to the public domain."],
    "EPL-2.0": ["All content is available under the Eclipse Public License version 2.0."],
    "BSL-1.0": ["Use, modification and distribution are subject to the Boost Software License, Version 1.0."],
    "CC-BY": ["Text available under the Creative Commons Attribution 4.0 license."],
    "CC-BY-SA": ["Content is available under the Creative Commons Attribution-ShareAlike 4.0 License"],
    "CC-BY-NC": ["Images under a Creative Commons Attribution-NonCommercial 4.0 license"],
    "CC0": ["The person who associated a work with this deed has dedicated the work to the public domain by waiving all rights under CC0 1.0"],
    "Proprietary": ["Copyright 2021 Example Press. All rights reserved worldwide.", "may not be reproduced in any form without prior written permission"],
}
#: Lines with words of licensing that are no notices.
NEAR_MISSES = [
    "Licensed drivers only.", "The license plate was lost.", "Copyright law is taught here.", "All rights and duties.", "Version 2.0 was released.", "Released in spring.",
    "They talked of the MIT license for hours and hours, and of the BSD one.", "The driver's license was renewed in version 2.", "A public library is open to the public.", "General public transport, free of charge.",
]
UNKNOWN = "unknown"
#: Words in a window, and words from one window to the next.
WINDOW, STEP = 24, 12
_WORD = re.compile(r"[^\W_]+")
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
HITS = "doc_id long, n_paragraphs long, n_license long, families string, spans string, best_probability double"


class Model(NamedTuple):
    families: tuple[str, ...]
    weights: np.ndarray  # buckets x classes; the last class is unknown
    bias: np.ndarray
    temperature: float
    least: float  # probability that a family needs
    bits: int


class WordHashes(dict):
    """64-bit hash of each word met, forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return h


_hashes = WordHashes()


def gram_buckets(words: list[str], bits: int) -> list[np.ndarray]:
    """Bucket of the 1-, 2- and 3-gram that starts at each word."""
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    grams = [h, (h[:-1] * _C1) ^ h[1:], ((h[:-2] * _C1 ^ h[1:-1]) * _C2) ^ h[2:]]
    return [((g * _C1) >> np.uint64(64 - bits)).astype(np.int64) for g in grams]


def features(paragraph: str, bits: int) -> np.ndarray:
    """Buckets of the paragraph's word 1-, 2- and 3-grams, lower-cased."""
    words = _WORD.findall(paragraph.lower())
    return np.concatenate(gram_buckets(words, bits)) if words else np.zeros(0, np.int64)


def background(docs: DataFrame, rows: int = 400, text_col: str = "text", id_col: str = "doc_id") -> list[str]:
    """Paragraphs for the unknown class: four windows of 4 to 24 words from each of ``rows`` rows or so.

    Rows are taken by a hash of their id, windows by a hash of id and number over the whole text (cut
    at 400 characters).  Those that hold a word of licensing are left out, so that notices don't teach
    'unknown'.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.split(F.trim(F.col(text_col).cast("string")), r"\s+").alias("w")).filter("id IS NOT NULL AND w IS NOT NULL")
    picked = hashed_sample(picked, "id", rows).select("id", "w", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in enumerate((24, 24, 10, 4))])).alias("c"))
    start = F.pmod(F.xxhash64("id", "c.k"), F.greatest(F.lit(1), F.size("w") - F.col("c.n"))).cast("int") + 1
    got = sorted(r[0] for r in picked.select(F.substring(F.array_join(F.slice("w", start, F.col("c.n")), " "), 1, 400)).collect())
    return [p for p in got if p.strip() and not re.search(r"(?i)licen[cs]|copyright|rights|spdx|public domain|permission", p)]


def examples(paragraphs: list[str], copies: int, seed: int) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """Labelled paragraphs to fit on, and held-out ones: other wordings, and a fifth of the corpus paragraphs."""
    rng = np.random.default_rng(seed)
    unknown = len(TEMPLATES)
    spare = [w for p in paragraphs for w in _WORD.findall(p)] or ["text"]

    def copies_of(notice: str) -> Iterator[str]:
        words = notice.split()
        for c in range(copies):
            kept = [w for w in words if c < 2 or rng.random() > 0.08] or words
            if c > 1 and len(kept) > WINDOW and rng.random() < 0.7:
                at = int(rng.integers(0, len(kept) - WINDOW + 1))
                kept = kept[at : at + WINDOW]
            before, after = ([str(w) for w in rng.choice(spare, int(rng.integers(0, 9)))] if c else [] for _ in range(2))
            yield " ".join([*before, *kept, *after])

    held_out = [k % 5 == 4 for k in range(len(paragraphs))]
    fit = [(p, unknown) for p in NEAR_MISSES] + [(p, unknown) for p, h in zip(paragraphs, held_out, strict=True) if not h]
    held = [(p, unknown) for p, h in zip(paragraphs, held_out, strict=True) if h]
    for k, family in enumerate(TEMPLATES):
        for notice in TEMPLATES[family] + TITLES.get(family, []):
            fit += [(p, k) for p in copies_of(notice)]
        for notice in HELD_OUT[family]:
            held += [(p, k) for p in copies_of(notice)]
    return fit, held


def train(paragraphs: list[str], bits: int = 16, copies: int = 10, rounds: int = 60, rate: float = 10.0, decay: float = 1e-4, false_share: float = 0.002, seed: int = 11) -> Model:
    """Fit the regression by gradient descent; then calibrate it on what is held out.

    The temperature is the likeliest one on held-out wordings and paragraphs.  ``least``: a half, or
    what only ``false_share`` of the held-out paragraphs of the corpus reach for any family.
    """
    fit, held = examples(paragraphs, copies, seed)
    xs, y = [features(p, bits) for p, _ in fit], np.array([k for _, k in fit])
    rows, cols = np.repeat(np.arange(len(xs)), [len(x) for x in xs]), np.concatenate(xs)
    used, local = np.unique(cols, return_inverse=True)
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(rows, minlength=len(xs))))[rows]
    classes = len(TEMPLATES) + 1
    target = np.eye(classes)[y]
    balance = ((1 / np.bincount(y, minlength=classes).clip(1))[y] * len(y) / classes)[:, None]
    w, b = np.zeros((len(used), classes)), np.zeros(classes)
    for _ in range(rounds):
        z = np.stack([np.bincount(rows, weights=w[local, c] * scale, minlength=len(y)) for c in range(classes)], axis=1) + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - target) * balance / len(y)
        for c in range(classes):
            w[:, c] -= rate * (np.bincount(local, weights=g[rows, c] * scale, minlength=len(used)) + decay * w[:, c])
        b -= rate / 10 * g.sum(axis=0)
    weights = np.zeros((1 << bits, classes), np.float32)
    weights[used] = w
    model = Model(tuple(TEMPLATES), weights, b, 1.0, 0.5, bits)
    z = np.stack([logits(model, p) for p, _ in held])
    truth = np.array([k for _, k in held])
    heats = np.linspace(0.1, 4, 40)
    losses = [float(-np.log(_softmax(z / t)[np.arange(len(truth)), truth].clip(1e-12)).mean()) for t in heats]
    model = model._replace(temperature=float(heats[int(np.argmin(losses))]))
    plain = _softmax(z[truth == classes - 1] / model.temperature)[:, :-1].max(axis=1, initial=0.0)
    return model._replace(least=max(0.5, float(np.quantile(plain, 1 - false_share, method="higher")))) if len(plain) else model


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def logits(model: Model, paragraph: str) -> np.ndarray:
    x = features(paragraph, model.bits)
    return model.weights[x].sum(axis=0, dtype=np.float64) / np.sqrt(max(1, len(x))) + model.bias


class Paragraphs(NamedTuple):
    """The words of a text, their lines, and the stretches of words to score: lines first, then windows."""

    words: list[str]
    line_of: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    block: np.ndarray  # of each stretch, the first word of its block
    block_end: np.ndarray
    n_lines: int  # how many of the stretches are lines


def paragraphs_of(lines: list[str]) -> Paragraphs:
    found = [_WORD.findall(line) for line in lines]
    sizes = np.array([len(f) for f in found], np.int64)
    ends = np.cumsum(sizes)
    with_words = np.flatnonzero(sizes)
    begin, end = (ends - sizes)[with_words], ends[with_words]
    spans = []
    first = None
    for i, line in enumerate([*lines, ""]):  # blocks between blank lines
        if line and not line.isspace():
            first = i if first is None else first
        elif first is not None:
            a, b = int(ends[first] - sizes[first]), int(ends[i - 1])
            if i - first > 1 or b - a > WINDOW:
                spans.append((a, b))
            first = None
    windows = [(s, min(s + WINDOW, b), a, b) for a, b in spans for s in range(a, max(a + 1, b - STEP), STEP)]
    w = np.array(windows, np.int64).reshape(-1, 4)
    return Paragraphs([x for f in found for x in f], np.repeat(np.arange(len(lines)), sizes), *(np.concatenate(x) for x in ((begin, w[:, 0]), (end, w[:, 1]), (begin, w[:, 2]), (end, w[:, 3]))), len(begin))


def probabilities(model: Model, p: Paragraphs) -> np.ndarray:
    """Class probabilities of each stretch, from running sums of the weights of its 1-, 2- and 3-grams."""
    total = np.zeros((len(p.begin), model.weights.shape[1]))
    for n, buckets in enumerate(gram_buckets(p.words, model.bits)):
        sums = np.zeros((len(buckets) + 1, total.shape[1]))
        np.cumsum(model.weights[buckets], axis=0, dtype=np.float64, out=sums[1:])
        last = np.maximum(p.begin, p.end - n)
        some = last > p.begin
        total[some] += sums[last[some]] - sums[p.begin[some]]
    size = p.end - p.begin
    grams = size + np.maximum(0, size - 1) + np.maximum(0, size - 2)
    return _softmax((total / np.sqrt(np.maximum(1, grams))[:, None] + model.bias) / model.temperature)


def _pairs(words: list[str]) -> list[tuple[str, str]]:
    return list(zip(words, words[1:], strict=False))


#: Of each family's templates: distinct word pairs and number of words; of titles likewise.
TEMPLATE_PAIRS = {f: [(frozenset(_pairs(w)), len(w)) for w in (_WORD.findall(t.lower()) for t in ts)] for f, ts in TEMPLATES.items()}
TITLE_PAIRS = {f: [(frozenset(_pairs(w)), len(w)) for w in (_WORD.findall(t.lower()) for t in ts)] for f, ts in TITLES.items()}


def found_template(words: list[str], begin: int, end: int, low: int, high: int, family: str, overlap: float) -> tuple[int, int] | None:
    """Where a template of the family stands about words[begin:end], within words[low:high].

    Of each template of n words, the window of 2n words (starting from 2n before ``begin`` on) with
    most of its distinct pairs is taken; it must hold the share ``overlap`` of them.  The best
    template's first and last pair found there bound the result; ties go to the first.
    """
    best, place = 0.0, None
    for pairs, n in TEMPLATE_PAIRS[family]:
        first, last = max(low, begin - 2 * n), min(high, end + 2 * n)
        at = [i for i in range(first, last - 1) if (words[i], words[i + 1]) in pairs]
        counts: Counter[tuple[str, str]] = Counter()
        right = 0
        for left, i in enumerate(at):
            if i >= end:
                break
            while right < len(at) and at[right] < i + 2 * n - 1:
                counts[words[at[right]], words[at[right] + 1]] += 1
                right += 1
            share = len(counts) / len(pairs)
            if share >= overlap and share > best:
                best, place = share, (i, at[right - 1] + 2)
            gone = words[i], words[i + 1]
            counts[gone] -= 1
            if not counts[gone]:
                del counts[gone]
    return place


def is_title(words: list[str], family: str) -> bool:
    have = set(_pairs(words))
    return any(pairs <= have and len(words) <= n + 2 for pairs, n in TITLE_PAIRS.get(family, []))


def notices(model: Model, lines: list[str], overlap: float, decided: Counter | None = None) -> list[tuple[str, int, int, float]]:
    """Family, first line, last line and probability of each notice, in order; none share a line.

    The classifier proposes; a template of the proposed family confirms.  Lines that are notices
    alone come first, then windows by probability.  ``decided`` counts what each step decided.
    """
    p = paragraphs_of(lines)
    if not p.words:
        return []
    probable = probabilities(model, p)
    best = probable[:, :-1].argmax(axis=1)
    value = probable[np.arange(len(best)), best]
    proposed = np.flatnonzero((value >= model.least) & (value > probable[:, -1]))
    order = sorted(proposed.tolist(), key=lambda k: (k >= p.n_lines, 0 if k < p.n_lines else -round(float(value[k]), 9), int(p.begin[k])))
    found, taken = [], set()
    for k in order:
        a, b, family = int(p.begin[k]), int(p.end[k]), model.families[best[k]]
        place = found_template(p.words, a, b, int(p.block[k]), int(p.block_end[k]), family, overlap)
        if place is None and k < p.n_lines and is_title(p.words[a:b], family):
            place = a, b
        span = range(int(p.line_of[place[0]]), int(p.line_of[place[1] - 1]) + 1) if place else range(0)
        if place and taken.isdisjoint(span):
            found.append((family, span[0], span[-1], float(value[k])))
            taken.update(span)
        if decided is not None:
            decided["confirmed" if place else "rejected by templates"] += 1
    if decided is not None:
        decided["scored"] += len(best)
        decided["proposed"] += len(proposed)
    return sorted(found, key=lambda f: f[1])


def scan_licenses(docs: DataFrame, model: Model, overlap: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence families of every whole text.

    Returns doc_id, n_paragraphs (lines with a word), n_license (notices given to a family; each is
    a line or lines that follow each other), families (distinct, sorted, comma-joined; empty if
    none), spans (family:start:end of each notice's lines in order, in code points, end exclusive),
    best_probability (0 if none).

    Every line and window is scored by the model.  Null text has no paragraphs.  Repeated rows and
    null ids pass through; an empty table gives no rows.  A map over partitions: no shuffle.  Memory
    goes with the longest text: about 500 bytes a word.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            out: list[list] = [[], [], [], [], []]
            for text in batch.column(1).to_pylist():
                lines = (text or "").split("\n")
                hits, best = [], 0.0
                if text:
                    starts = [0, *accumulate(len(line) + 1 for line in lines)]
                    low = text.lower()
                    lowered = low.split("\n")
                    for family, first, last, p in notices(m, lowered, overlap):
                        hits.append((family, starts[first], starts[last] + len(lines[last])))
                        best = max(best, p)
                count = sum(1 for line in lines if line and not line.isspace())
                row = (count, len(hits), ",".join(sorted({h[0] for h in hits})), ",".join(f"{f}:{s}:{e}" for f, s, e in hits), best)
                for col, v in zip(out, row, strict=True):
                    col.append(v)
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(out, types, strict=True)]], names=[c.split()[0] for c in HITS.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, HITS)
