"""Licence scans: a trained paragraph classifier names licence families, templates confirm it.

Each paragraph (line, or neighbouring lines over which a template's wording runs on) is a sparse vector of its words and word pairs, hashed, case and punctuation apart. A multinomial
logistic regression over the families and a class for everything else is trained on variations of the templates below and on a bounded sample of the
corpus: at most about ``sample_docs`` documents drawn by a hash of their id, at most ``sample_chars`` characters of each, less
the lines that resemble a template. A quarter of both calibrates the probabilities (a temperature) and the least probability at which
no more than one in a thousand calibration lines of the corpus is taken for a licence. A predicted family is confirmed if the paragraph holds at least ``confirm`` of the
word pairs of one of its templates, or that share of its own pairs, four at least, are the template's, and reported as an unknown licence if it holds at least ``resemble``; else it is no licence.

Every paragraph of every whole text is classified. Defined results: a null or empty text has no paragraphs that could match; an empty table
gives no rows (the model then knows templates only); repeated rows are reported once each; a null id stays null. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.words import chunks, mixed, text_bytes, word_hashes

UNKNOWN = "unknown"
_BINS = 1 << 16
_PART = 4

# Short public notices of licence families, as licensors write them.
TEMPLATES: dict[str, list[str]] = {
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
        "See the License for the specific language governing permissions and limitations under the License",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License",
        "Licensed under the BSD 2-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    ],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0",
        "Licensed under CC BY-NC-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights to this work, CC0 1.0 Universal", "Dedicated to the public domain under CC0"],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License, version 2 or later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details",
        "You should have received a copy of the GNU General Public License along with this program",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library",
    ],
    "mit": [
        "Released under the MIT License",
        "Licensed under the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License 2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0",
    ],
    "proprietary": ["All rights reserved", "All rights reserved. No part of this work may be reproduced without the prior written permission of the publisher", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited"],
}

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[b for b in range(33, 127) if not chr(b).isalnum()]] = 32


def _paragraphs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all lines of all rows, and the row of each line."""
    cuts = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
    return cuts, np.searchsorted(offsets, cuts[:-1], side="right") - 1


def _features(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of each line, of the pairs that begin at each word (0: none), and the first word of each line."""
    words, _, _, first = word_hashes(_PLAIN[data], cuts)
    pairs = np.zeros(len(words), dtype=np.uint64)
    if len(words) > 1:
        pairs[:-1] = mixed(words[:-1] * np.uint64(3) + words[1:])
        pairs[first[1:][np.diff(first) > 0] - 1] = 0
    return words, pairs, first


class LicenceModel:
    """Multinomial logistic regression over hashed words and word pairs; class 0 is no licence."""

    def __init__(self, corpus_lines: list[str], seed: int = 5, rounds: int = 10) -> None:
        self.classes = ["", *sorted(TEMPLATES)]
        self.sets = [(k, set(self._bins(t)[1].tolist())) for k, name in enumerate(self.classes) if name for t in TEMPLATES[name]]
        self.known = np.zeros(_BINS, dtype=bool)  # word pairs of any template
        for _, pairs in self.sets:
            self.known[list(pairs)] = True
        rng = np.random.default_rng(seed)
        lines, labels = [], []
        for k, name in enumerate(self.classes[1:], 1):
            for t in TEMPLATES[name]:
                for n in range(24):
                    lines.append(self._varied(t, rng, corpus_lines if n % 3 == 0 else []))
                    labels.append(k)
        stray = [x for x in corpus_lines if self.likeness(x)[1] < 0.5]
        generic = sorted({w for ts in TEMPLATES.values() for t in ts for w in t.split()})
        stray += [" ".join(rng.choice(generic, rng.integers(1, 6))) for _ in range(200)]  # a licence's words alone are no licence
        of_corpus = len(lines), len(lines) + len(stray) - 200
        lines += stray
        labels += [0] * len(stray)
        y = np.array(labels)
        rows = [np.concatenate(self._bins(t)) for t in lines]
        held = np.arange(len(rows)) % 4 == 3
        self.weights = np.zeros((_BINS, len(self.classes)), dtype=np.float32)
        self.bias = np.zeros(len(self.classes), dtype=np.float32)
        fit = [k for k in np.flatnonzero(~held) if len(rows[k])]
        scale = 1.0 / np.bincount(y, minlength=len(self.classes)).clip(1)
        scale *= len(y) / len(self.classes)
        seen = np.full(_BINS, 1e-6, dtype=np.float32)
        for _ in range(rounds):
            for k in rng.permutation(fit):
                f = rows[k]
                z = self.bias + self.weights[f].sum(axis=0) / np.sqrt(len(f))
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y[k]] -= 1
                p *= min(scale[y[k]], 3.0)
                seen[f] += 1
                self.weights[f] -= (0.5 * p / np.sqrt(len(f))) / np.sqrt(seen[f])[:, None]
                self.bias -= 0.01 * p
        z = np.stack([self.bias + (self.weights[f].sum(axis=0) / np.sqrt(len(f)) if len(f) else 0) for f, h in zip(rows, held, strict=True) if h])
        truth = y[held]

        def loss(t: float) -> float:
            s = z / t - (z / t).max(axis=1, keepdims=True)
            return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(truth)), truth]).mean())

        self.temperature = min((0.25, 0.5, 1.0, 2.0, 4.0), key=loss)
        p = self._probabilities(z)
        at = np.flatnonzero(held)
        wrong = p[(at >= of_corpus[0]) & (at < of_corpus[1]), 1:].max(axis=1, initial=0.0)
        self.least = float(np.clip(np.quantile(wrong, 0.999) if len(wrong) else 0.5, 0.5, 0.99))

    @staticmethod
    def _bins(text: str) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
        with np.errstate(over="ignore"):
            words, pairs, _ = _features(data, np.array([0, len(data)]))
            return (words >> np.uint64(48)).astype(np.int64), (pairs[pairs != 0] >> np.uint64(48)).astype(np.int64)

    @staticmethod
    def _varied(text: str, rng: np.random.Generator, around: list[str]) -> str:
        words = [w for w in text.split() if rng.random() > 0.06] or text.split()
        if around:
            extra = around[rng.integers(len(around))].split()[: rng.integers(1, 8)]
            words = extra + words if rng.random() < 0.5 else words + extra
        return " ".join(words).upper() if rng.random() < 0.1 else " ".join(words)

    def likeness(self, text: str, family: int | None = None) -> tuple[int, float, float]:
        """The class of the template most like the text, that likeness, and the largest share of a template's word pairs that
        the text holds. Likeness is containment in either direction; a part of a template has ``_PART`` word pairs of it at least."""
        own = set(self._bins(text)[1].tolist())
        best = 0, 0.0, 0.0
        for k, s in self.sets:
            if family is None or k == family:
                shared = len(own & s)
                whole = shared / max(len(s), 1)
                like = max(whole, shared / len(own) if shared >= _PART else 0.0)
                best = (k if like > best[1] else best[0]), max(like, best[1]), max(whole, best[2])
        return best

    def _probabilities(self, z: np.ndarray) -> np.ndarray:
        p = np.exp((z - z.max(axis=1, keepdims=True)) / self.temperature)
        return p / p.sum(axis=1, keepdims=True)

    def judge(self, words: np.ndarray, pairs: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and probability of each line."""
        n = len(first) - 1
        if not len(words):
            return np.zeros(n, dtype=np.int64), np.zeros(n)
        own = self.weights[(words >> np.uint64(48)).astype(np.int64)]
        own += np.where((pairs != 0)[:, None], self.weights[(pairs >> np.uint64(48)).astype(np.int64)], 0)
        filled = np.flatnonzero(np.diff(first) > 0)
        total = np.add.reduceat(own, first[filled], axis=0)
        size = 2 * np.diff(first)[filled] - 1
        p = self._probabilities(self.bias + total / np.sqrt(size)[:, None])
        kind, chance = np.zeros(n, dtype=np.int64), np.zeros(n)
        kind[filled] = p[:, 1:].argmax(axis=1) + 1
        chance[filled] = p[:, 1:].max(axis=1)
        kind[chance < self.least] = 0
        return kind, chance


def _joined(words: np.ndarray, pairs: np.ndarray, first: np.ndarray, row: np.ndarray, known: np.ndarray) -> np.ndarray:
    """For each line whether the next one may go on with its paragraph: neither is blank, and the word pair over the line
    break is one of a template, or at least half of the pairs of both are."""
    n = len(first) - 1
    go_on = np.zeros(n, dtype=bool)
    if n < 2 or not len(words):
        return go_on
    here = known[(pairs >> np.uint64(48)).astype(np.int64)] & (pairs != 0)
    held = np.diff(np.concatenate([[0], np.cumsum(here)])[first])
    size = np.diff(first)
    dense = (held >= 2) & (2 * held >= size - 1)
    at = np.flatnonzero((size[:-1] > 0) & (size[1:] > 0) & (row[:-1] == row[1:]))
    across = mixed(words[first[at + 1] - 1] * np.uint64(3) + words[first[at + 1]])
    go_on[at] = known[(across >> np.uint64(48)).astype(np.int64)] | (dense[at] & dense[at + 1])
    return go_on


def train(docs: DataFrame, sample_docs: int = 600, sample_chars: int = 4000) -> LicenceModel:
    n = docs.count()
    # by id and text: rows without an id, or of one id, have draws of their own; rows that repeat both are one
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")), F.lit("licence")), F.lit(1 << 30))
    share = min(1.0, sample_docs / max(n, 1))
    rows = docs.filter(draw < int(share * (1 << 30))).select(draw.alias("d"), F.substring(F.coalesce("text", F.lit("")), 1, sample_chars).alias("t"))
    rows = sorted(rows.distinct().collect())  # about sample_docs, whatever repeats
    return LicenceModel([line for r in rows for line in r["t"].split("\n") if line.strip()])


_Found = tuple[bool, float, str, float, float, str]  # confirmed, share of a template, family, confidence, likeness, text


def _found(model: LicenceModel, data: np.ndarray, cuts: np.ndarray, kind: np.ndarray, chance: np.ndarray, confirm: float, resemble: float) -> dict[int, _Found]:
    """What is reported of the pieces between the cuts, by their number."""
    found = {}
    for k in np.flatnonzero(kind):
        text = data[cuts[k] : cuts[k + 1]].tobytes().decode("utf-8").rstrip("\n")
        _, like, share = model.likeness(text, int(kind[k]))
        if like >= resemble:
            found[int(k)] = like >= confirm, share, model.classes[kind[k]] if like >= confirm else UNKNOWN, float(chance[k]), like, text
    return found


def scan(docs: DataFrame, model: LicenceModel | None = None, confirm: float = 0.6, resemble: float = 0.2) -> DataFrame:
    """One row per licence paragraph: doc_id, paragraph (from 0), start and length (bytes of UTF-8), family, confidence, likeness, paragraph_text."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs) if model is None else model)
    schema = "doc_id long, paragraph long, start long, length long, family string, confidence double, likeness double, paragraph_text string"

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        with np.errstate(over="ignore"):
            for batch in batches:
                data, offsets = text_bytes(batch.column(1))
                ids, rows = batch.column(0).to_pylist(), []
                for a, b in chunks(offsets):
                    own = data[offsets[a] : offsets[b]]
                    starts = offsets[a : b + 1] - offsets[a]
                    cuts, row = _paragraphs(own, starts)
                    words, pairs, first = _features(own, cuts)
                    lines = _found(model, own, cuts, *model.judge(words, pairs, first), confirm, resemble)
                    # neighbouring lines that run on as a template does are a paragraph, reported in place of its lines where it is more like one
                    go_on = _joined(words, pairs, first, row, model.known)
                    if go_on.any():
                        begin = np.flatnonzero(~np.concatenate([[False], go_on[:-1]]))
                        whole = np.append(cuts[begin], cuts[-1])
                        kind, chance = model.judge(*_features(own, whole))
                        kind[~go_on[begin]] = 0
                        for u, found in _found(model, own, whole, kind, chance, confirm, resemble).items():
                            parts = range(begin[u], np.searchsorted(cuts, whole[u + 1]))
                            if found[:2] > max((lines[k][:2] for k in parts if k in lines), default=(False, 0.0)):
                                for k in parts:
                                    lines.pop(k, None)
                                lines[int(begin[u])] = found
                    for k, (_, _, name, p, like, text) in sorted(lines.items()):
                        nth = int(k - np.searchsorted(row, row[k]))
                        rows.append((ids[a + row[k]], nth, int(cuts[k] - starts[row[k]]), len(text.encode("utf-8")), name, p, like, text))
                names = [c.split()[0] for c in schema.split(", ")]
                types = [pa.int64()] * 4 + [pa.string(), pa.float64(), pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scanned, schema)
