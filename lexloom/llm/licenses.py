"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a block of lines: it ends at a blank line and after a line that ends a sentence; marks of comments
before a line (``//``, ``#``, ``*`` and others) don't count. A paragraph of more than ``WINDOW`` words is judged in windows of so many words,
each beginning ``STRIDE`` words after the one before, so that a notice in a text of one line is seen like any other. A sparse multinomial
logistic regression (proximal gradient steps with an L1
penalty) over the presence of word 1- to 3-grams tells licence families, other licence text
(``unknown``) and ordinary text (``none``) apart. It is trained here on variants of the notices below (cut,
with words lost and with ordinary words around) and on ordinary windows. Two held-out parts
calibrate it: a temperature on unseen variants, and the least probability of a known family, so that no more
than ``FALSE`` of the notices of licences that no family covers pass as a known one. A predicted family is
confirmed if the window and one of its templates share enough word n-grams: the share ``CONFIRM`` of the shorter one's, which counts
as ``LEAST`` n-grams at least unless the template itself is shorter. A prediction that isn't confirmed is refuted: the window is then unknown or
ordinary text, by the probabilities of these two.

Windows with licence text that follow each other, with no more than one paragraph between them, are one finding if they are of one family, or one of them is
unknown or no more than a reservation of rights: a licence is reported once, from its title to its disclaimer, with the family, probability and similarity of its surest window.

Ordinary text for training is a bounded sample of the documents (``LINES`` windows of as many different documents, by a hash of the text and at a
place given by it) without those that share a word triple with a notice. The scan covers every word of every text.

Defined results: null and empty texts give no rows; repeated rows are each reported; ``paragraph`` is the first of a finding, counted
from 0, ``paragraphs`` how many it spans; line ends may be ``\\r\\n``; a window without any n-gram
of the model is ordinary text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import column, kind, need, plain_words, shingles, starts_inside, sub_batches

LINES, VARIANTS, GRAMS, L1, STEPS, FALSE, CONFIRM, LEAST = 3000, 40, 3, 2e-4, 200, 0.05, 0.5, 20
WINDOW, STRIDE = 100, 50

FAMILIES = {
    "mit": ["Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "MIT License", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "apache": ["Licensed under the Apache License, Version 2.0.", "This file is available under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Apache License Version 2.0, January 2004", "See the License for the specific language governing permissions and limitations under the License."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "Released under the GNU GPL v3 or later.", "Licensed under GPLv2.", "SPDX-License-Identifier: GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "You should have received a copy of the GNU General Public License along with this program.", "See the GNU General Public License for more details."],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "Released under the LGPL version 3."],
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "This program is distributed under the terms of the GNU Affero General Public License as published by the Free Software Foundation.", "Released under the AGPL v3."],
    "bsd": ["Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license.", "SPDX-License-Identifier: BSD-2-Clause", "Redistributions of source code must retain the above copyright notice and this list of conditions.", "Redistributions in binary form must reproduce the above copyright notice in the documentation.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0", "If a copy of the MPL was not distributed with this file, you can obtain one at https://mozilla.org/MPL/2.0/."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Text available under Creative Commons Attribution 3.0 Unported.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Available under the Creative Commons Attribution-NonCommercial license; commercial use is not permitted.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "SPDX-License-Identifier: CC-BY-ND-4.0"],
    "public-domain": ["This work has been dedicated to the public domain under CC0 1.0 Universal.", "This is free and unencumbered software released into the public domain.", "The author waives all copyright and related rights in the work.", "SPDX-License-Identifier: CC0-1.0", "No rights reserved. Public domain."],
    "proprietary": ["All rights reserved.", "Copyright 2020 the authors. All rights reserved.", "Unauthorised copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.", "No part of this publication may be reproduced, stored or transmitted in any form without the prior written permission of the publisher."],
}
#: Notices outside every family: the first part trains ``unknown``, the second one calibrates.
OTHERS = (
    ["Licensed under the Eclipse Public License, version 2.0.", "This program is distributed under the Artistic License 2.0.", "Subject to the terms of the zlib license, altered source versions must be plainly marked as such.", "This font software is licensed under the SIL Open Font License, Version 1.1.", "Distributed under the terms of the Server Side Public License.", "You may use this material for teaching, provided that the source is named.", "The licensee shall not transfer the licence to third parties.", "The software is provided as is, without warranty of any kind, express or implied.", "In no event shall the authors or copyright holders be liable for any claim or damages.", "including the warranties of merchantability, fitness for a particular purpose and noninfringement", "This program is distributed in the hope that it will be useful, but without any warranty.", "This software is provided by the copyright holders and contributors as is.", "liable for any direct, indirect, incidental, special, exemplary or consequential damages, however caused", "Unless required by applicable law or agreed to in writing, software is distributed as is.", "Licensed under the Common Development and Distribution License 1.0."],
    ["Distributed under the Boost Software License, Version 1.0.", "Licensed under the European Union Public Licence, version 1.2.", "Licensed under the Microsoft Reciprocal License.", "This package is released under the terms of the PHP License, version 3.01.", "Use is subject to the Business Source License; the change date is four years after release.", "Released under the Academic Free License v3.", "Licensed under the Python Software Foundation License version 2.", "You are granted a limited licence to display this page for private study."],
)
CLASSES = [*FAMILIES, "unknown", "none"]
UNKNOWN, NONE = len(CLASSES) - 2, len(CLASSES) - 1


def grams(texts: pa.Array, n: int = GRAMS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct word 1- to ``n``-grams of each text, and row offsets."""
    h, offsets, _ = plain_words(texts)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    rows, keys = [], []
    for k in range(1, n + 1):
        ok = starts_inside(offsets, k, len(h))
        keys.append(shingles(h, k)[ok])
        rows.append(row[: len(ok)][ok])
    rows, keys = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
    return keys[new], np.concatenate(([0], np.cumsum(np.bincount(rows[new], minlength=len(offsets) - 1))))


class Classifier:
    """Sparse weights by n-gram and class, temperature and least probability."""

    def __init__(self, texts: list[str], labels: np.ndarray, l1: float = L1, steps: int = STEPS):
        keys, offsets = grams(pa.array(texts, pa.string()))
        notices = np.unique(grams(pa.array([*sum(FAMILIES.values(), []), *OTHERS[0], *ORDINARY], pa.string()))[0])
        used, at, count = np.unique(keys, return_inverse=True, return_counts=True)
        common = (count >= 2) & np.isin(used, notices)  # what no notice holds speaks for ordinary text, as does the constant
        self.keys, place = used[common], np.cumsum(common) - 1
        self.bloom = np.zeros(1 << 22, bool)
        self.bloom[(self.keys >> np.uint64(42)).astype(np.int64)] = True
        row = np.repeat(np.arange(len(texts)), np.diff(offsets))
        ok = common[at]
        row, col = row[ok], place[at[ok]]
        self.weights, self.bias = np.zeros((len(self.keys), len(CLASSES))), np.zeros(len(CLASSES))
        self.temperature, self.least = 1.0, 0.5
        order = np.argsort(col, kind="stable")
        first = np.flatnonzero(np.diff(col[order], prepend=-1))
        starts = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(texts)))))
        target = np.eye(len(CLASSES))[labels]
        sample = 1 / np.maximum(np.bincount(labels, minlength=len(CLASSES)), 1)[labels]
        sample = sample[:, None] / sample.sum()
        w = v = self.weights
        c = u = self.bias
        momentum, rate = 1.0, 4.0
        for _ in range(steps):  # FISTA: accelerated gradient steps, then soft thresholding
            g = sample * (self._softmax(self._sum(v[col], starts) + u) - target)
            w_new = v - rate * np.add.reduceat(g[row[order]], first, axis=0)
            w_new = np.sign(w_new) * np.maximum(np.abs(w_new) - rate * l1, 0)
            c_new = u - rate * g.sum(0)
            momentum, old = (1 + np.sqrt(1 + 4 * momentum**2)) / 2, momentum
            v, u = w_new + (old - 1) / momentum * (w_new - w), c_new + (old - 1) / momentum * (c_new - c)
            w, c = w_new, c_new
        alive = np.abs(w).sum(1) > 0
        self.keys, self.weights, self.bias = self.keys[alive], w[alive], c
        self.templates = {k: [set(grams(pa.array([t]))[0].tolist()) for t in ts] for k, ts in FAMILIES.items()}

    @staticmethod
    def _sum(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate((np.zeros((1, x.shape[1])), np.cumsum(x, 0)))[starts], axis=0)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def logits(self, keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        hit = np.flatnonzero(self.bloom[(keys >> np.uint64(42)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.keys, keys[hit]), len(self.keys) - 1)
        ok = self.keys[k] == keys[hit]
        hit, k = hit[ok], k[ok]
        return self._sum(self.weights[k], np.searchsorted(hit, offsets)) + self.bias

    def calibrate(self, texts: list[str], labels: np.ndarray, others: list[str], false: float = FALSE) -> None:
        z = self.logits(*grams(pa.array(texts, pa.string())))
        ts = np.geomspace(0.2, 5, 40)
        loss = [-np.log(self._softmax(z / t)[np.arange(len(z)), labels] + 1e-12).mean() for t in ts]
        self.temperature = float(ts[int(np.argmin(loss))])
        p = self.probabilities(*grams(pa.array(others, pa.string())))[:, :UNKNOWN].max(1)
        self.least = float(max(0.5, np.quantile(p, 1 - false)))

    def probabilities(self, keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self._softmax(self.logits(keys, offsets) / self.temperature)

    def similarity(self, family: str, own: set[int]) -> float:
        """Largest share of n-grams in common with a template of the family."""
        part = lambda t: len(own & t) / max(min(len(own), len(t)), min(LEAST, len(t)))
        return max((part(t) for t in self.templates[family]), default=0.0)

    def hits(self, h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows that hold an n-gram of the model, those n-grams, each once, and offsets by window."""
        first, found = first_windows(offsets), []
        for n in range(1, GRAMS + 1):
            s = shingles(h, n)
            at = np.flatnonzero(self.bloom[(s >> np.uint64(42)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.keys, s[at]), len(self.keys) - 1)
            ok = self.keys[k] == s[at]
            at, k = at[ok], k[ok]
            row = np.searchsorted(offsets, at, "right") - 1
            for back in (0, 1):  # the windows that a place lies in
                w = first[row] + (at - offsets[row]) // STRIDE - back
                ok = (at + n <= offsets[row + 1]) & (w >= first[row]) & (w < first[row + 1])
                found.append(w[ok] * len(self.keys) + k[ok])
        pairs = np.unique(np.concatenate(found))
        windows, starts = np.unique(pairs // len(self.keys), return_index=True)
        return windows, pairs % len(self.keys), np.append(starts, len(pairs))

    def scan(self, texts: pa.Array) -> list[tuple[int, str, float, float, bool]]:
        """(paragraph, family, probability, similarity, confirmed) of the windows that aren't ordinary, in order."""
        h, offsets, _ = plain_words(texts)
        windows, k, starts = self.hits(h, offsets)
        p = self._softmax((self._sum(self.weights[k], starts) + self.bias) / self.temperature)
        own = np.flatnonzero(p.argmax(1) != NONE)
        first = first_windows(offsets)
        paragraph = np.searchsorted(first, windows[own], "right") - 1
        out = []
        for i, w, row in zip(own.tolist(), windows[own].tolist(), paragraph.tolist()):
            a = offsets[row] + (w - first[row]) * STRIDE
            decided = self.decide(p[i], ngrams(h[a : min(a + WINDOW, offsets[row + 1])]))
            if decided:
                out.append((row, *decided))
        return out

    def decide(self, p: np.ndarray, own: set[int]) -> tuple[str, float, float, bool] | None:
        """Family, probability, similarity and confirmation by the probabilities and n-grams of a window; None for ordinary text."""
        best = int(p[:UNKNOWN].argmax())
        share = self.similarity(CLASSES[best], own)
        if p[best] >= self.least and share >= CONFIRM:
            return CLASSES[best], float(p[best]), share, True
        other = float(p[UNKNOWN] / max(p[UNKNOWN] + p[NONE], 1e-300))
        return ("unknown", other, share, False) if other >= 0.5 else None


def first_windows(offsets: np.ndarray) -> np.ndarray:
    """Number of the first window of each row; a row has one at least."""
    return np.concatenate(([0], np.cumsum(np.maximum(1, -(-(np.diff(offsets) - STRIDE) // STRIDE)))))


def ngrams(h: np.ndarray) -> set[int]:
    return {x for n in range(1, GRAMS + 1) for x in shingles(h, n).tolist()}


def rank(family: str) -> int:
    """What gives way to another family beside it: disclaimers, and rights that are reserved before they are granted."""
    return {"unknown": 0, "proprietary": 1}.get(family, 2)


def merged(hits: list[tuple[int, int, str, float, float, bool]]) -> list[tuple]:
    """Findings (document, first paragraph, paragraphs, family, ..) from windows (document, paragraph, family, ..) in order."""
    out: list[list] = []
    for doc, at, family, *rest in hits:
        last = out[-1] if out else None
        if last and last[0] == doc and at - last[1] - last[2] < 2 and (family == last[3] or min(rank(family), rank(last[3])) < 2):
            last[2] = at - last[1] + 1
            if (rank(family), *rest[:2]) > (rank(last[3]), *last[4:6]):
                last[3:] = [family, *rest]
        else:
            out.append([doc, at, 1, family, *rest])
    return [tuple(x) for x in out]


def variants(notices: list[str], prose: list[str], rng: np.random.Generator, n: int = VARIANTS) -> list[str]:
    """Notices with up to a third cut off, one word in twelve lost, and often ordinary words around."""
    out = []
    for notice in notices:
        words = notice.split()
        out.append(notice)
        for _ in range(n):
            a = int(rng.integers(0, max(1, len(words) // 6) + 1)) if len(words) > 6 else 0
            z = len(words) - (int(rng.integers(0, max(1, len(words) // 6) + 1)) if len(words) > 6 else 0)
            own = [x for x in words[a:z] if len(words) < 7 or rng.random() > 0.08]
            some = lambda: prose[int(rng.integers(len(prose)))].split()[: int(rng.integers(0, 60))] if prose and rng.random() < 0.5 else []
            out.append(" ".join([*some(), *own, *some()]))
    return out


def trained(prose: list[str], seed: int = 11) -> Classifier:
    """The classifier, from the notices and ordinary lines."""
    rng = np.random.default_rng(seed)
    triples = {x for t in [*sum(FAMILIES.values(), []), *OTHERS[0], *OTHERS[1]] for x in _triples(t)}
    prose = sorted({x for x in prose if not triples & _triples(x)} | set(ORDINARY))
    rng.shuffle(prose)
    texts, labels = [], []
    for k, family in enumerate(CLASSES[:UNKNOWN]):
        own = variants(FAMILIES[family], prose, rng)
        texts += own
        labels += [k] * len(own)
    own = variants(OTHERS[0], prose, rng)
    every = " ".join([*sum(FAMILIES.values(), []), *OTHERS[0]]).split()
    own += [" ".join(rng.choice(every, int(rng.integers(5, 30)))) for _ in range(300)]  # licence words without a licence
    texts += own
    labels += [UNKNOWN] * len(own)
    own = prose + ORDINARY * VARIANTS
    texts += own
    labels += [NONE] * len(own)
    labels = np.array(labels)
    held = rng.random(len(texts)) < 0.2
    model = Classifier([t for t, h in zip(texts, held) if not h], labels[~held])
    model.calibrate([t for t, h in zip(texts, held) if h], labels[held], variants(OTHERS[1], prose, rng))
    return model


def _triples(text: str) -> set[tuple[str, ...]]:
    w = re.sub(r"[^\w\s]+", "", text.lower()).split()
    return set(zip(w, w[1:], w[2:])) or {tuple(w)}


#: Ordinary lines that use the words of licences, and a few of everyday kind.
ORDINARY = [
    "She studied physics at MIT before she moved to the west coast.", "The Apache lived in the south west of the country.", "A Mozilla engineer gave a talk at the university.", "They bought a licence for the car park.", "The common ground between the creative teams was small.", "The foundation was laid in spring.", "The proprietor of the shop is an Apache by birth.", "License", "Public", "Software", "MIT", "GPL", "Apache", "Copyright",
    "He has held a driving license since last year and drives to work.", "The public library is open in general from nine to five.", "She reserved a table for four under her own name.", "The rights of the child were discussed in the general assembly.", "A copy of the report was sent to every member of the committee.", "You may use the software on the second floor of the building.", "The new version of the song was released in March.", "The university offers a free course on software foundations.", "This work was the best of the year.", "The terms of the agreement were not made public.",
    "The domain of the function is the set of real numbers.", "All of the seats were taken.", "The source of the river lies in the mountains.", "We met at the station and walked to the sea.", "The weather was fine and the children played outside.", "Nous avons marché longtemps le long de la rivière.", "Der Zug fuhr um acht Uhr ab und kam pünktlich an.", "La casa estaba cerca del mercado y de la plaza.",
]


def ordinary_lines(docs: DataFrame, lines: int = LINES) -> list[str]:
    """A bounded sample of windows: of each chosen text, one of a line, both at places given by a hash; ``lines`` of them at most."""
    rows = need(docs, "text").filter("text is not null")
    n = rows.count()
    hashed = F.xxhash64("text", F.lit(9))
    unit = F.shiftrightunsigned(hashed, 11) / F.lit(float(1 << 53))
    at = lambda words, size: F.pmod(F.xxhash64("text"), F.greatest(F.lit(1), size)).cast("int") + 1
    line = F.element_at(F.split("text", "\n"), at("text", F.size(F.split("text", "\n"))))
    words = F.split(line, r"\s+")
    part = F.array_join(F.slice(words, at("text", F.size(words) - WINDOW + 1), WINDOW), " ")
    # copies of one text have one hash: they count once
    some = rows.filter(unit < min(1.0, 1.2 * lines / max(1, n))).select(hashed.alias("h"), part.alias("line")).distinct().orderBy("h", "line").limit(lines)
    return sorted(r.line for r in some.collect() if r.line.strip())


_MARKS = r"(?m)^[ \t]*(?:/\*+|//+|#+|\*+/?|;+|--+|%+|<!--)[ \t]*"


def paragraphs(texts: pa.Array) -> pa.ListArray:
    """Blocks of lines of each text."""
    t = pc.replace_substring_regex(pc.fill_null(texts, ""), _MARKS, "")
    t = pc.replace_substring_regex(t, r"([.!?:;][\"')\]]*)[ \t\r]*\n(?:[ \t\r]*\n)*|\n(?:[ \t\r]*\n)+", "\\1\x1e")
    return pc.split_pattern(t, "\x1e")


def _scan(batches: Iterable[pa.RecordBatch], model: Classifier) -> Iterator[pa.RecordBatch]:
    for b in sub_batches(batches):
        lists = paragraphs(column(b, "text"))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        hits = model.scan(lists.flatten())
        if hits:
            row = np.searchsorted(offsets, [x[0] for x in hits], "right") - 1
            out = merged([(r, x[0] - int(offsets[r]), *x[1:]) for r, x in zip(row.tolist(), hits)])
            doc, *rest = zip(*out)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.record_batch([column(b, "doc_id").take(pa.array(doc, pa.int64())), *map(pa.array, rest, kinds)], names=["doc_id", "paragraph", "paragraphs", "family", "probability", "similarity", "confirmed"])


def found(docs: DataFrame, model: Classifier) -> DataFrame:
    """``doc_id, paragraph, paragraphs, family, probability, similarity, confirmed`` of each finding of licence text."""
    sent = ship(docs.sparkSession).sparkContext.broadcast(model)
    return need(docs, "doc_id", "text").mapInArrow(lambda it: _scan(it, sent.value), f"doc_id {kind(docs, 'doc_id')}, paragraph long, paragraphs long, family string, probability double, similarity double, confirmed boolean")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return found(docs, trained(ordinary_lines(docs)))
