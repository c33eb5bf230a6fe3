"""Licence scan: a trained paragraph classifier with an unknown class and template comparison.

Paragraphs are the lines of a text, and besides them the runs of two or more lines without a blank one
(wrapped notices). A one-against-rest logistic regression per licence family works on the presence of
word 1- to 3-grams; only n-grams of the templates are features, with a dense feature for the share of a
paragraph's n-grams that no template holds. It is trained on notices made from the templates (words
dropped, passages cut out, other words around them), on names of licences in usual phrases, and on
paragraphs of a bounded sample of the corpus, shuffled template words and prose about licences as
negatives. On a held-out part the best family's log odds are calibrated (Platt scaling) against being
right; below ``KNOWN`` the paragraph is of the unknown class. Predictions are confirmed by comparing the
paragraph with its family's templates: at least ``ALIKE`` of the 2-grams of a sentence must be in the
paragraph, or of the paragraph's 2-grams in the family's templates.

Every paragraph of every text gets its features and a prediction. Nothing is shuffled but the bounded sample:
the features of ``SAMPLE_LINES`` lines at most of each of the ``SAMPLE_DOCS`` documents with the smallest hash
of doc_id, lines taken whole.

Defined results: null text is empty and has no paragraphs; blank lines are no paragraphs; ties of
families go to the first in the list; repeated rows are scanned alike; a null doc_id stays null; an
empty table gives an empty result (the classifier is then trained without corpus negatives); other
columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, released, table, text_of
from .hashing import batches_of, blocks, hash_words, place_numbers
from .linear import Logistic, present, sigmoid

#: Short notices of the licence families, a sentence a line.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License",
        "You may obtain a copy of the License at http www apache org licenses LICENSE-2.0",
        "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Licensed under the BSD 3-Clause License",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "either version 3 of the License, or at your option any later version",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "isc": [
        "Licensed under the ISC License",
        "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "SPDX-License-Identifier: ISC",
    ],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at https mozilla org MPL 2.0", "SPDX-License-Identifier: MPL-2.0"],
}
FAMILIES = tuple(TEMPLATES)
#: Names of the families in running text.
NAMES = {
    "apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 license", "Apache-2.0"],
    "bsd": ["BSD license", "3-Clause BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "New BSD License"],
    "cc-by": ["CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution license"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC BY-NC 3.0", "Creative Commons Attribution NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial license"],
    "gpl": ["GNU General Public License", "GNU GPL", "GPL v3", "GPLv3", "GPL version 2", "GNU General Public License v3.0"],
    "isc": ["ISC License", "ISC licence"],
    "mit": ["MIT License", "The MIT License", "MIT licence", "MIT License (MIT)"],
    "mpl-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"],
}
#: Usual phrases around a licence's name, and prose about licences that grants none.
PHRASES = [
    "Licensed under the {}", "licensed under {}", "Released under the {}", "This project is licensed under the {}", "This software is distributed under the terms of the {}",
    "distributed under the {}", "available under the {}", "covered by the {}", "License: {}", "the {}", "under the terms of the {}", "This file is part of the package and released under the {}", "see the {} for details",
]
PROSE = [
    "He renewed his driving license in version two of the office", "The general public is not permitted to use this entrance", "you may obtain a copy of the report at the desk",
    "This work is on display under the terms of the museum", "software license costs rose by four percent", "the license of the restaurant was revoked", "The software is provided with a manual and a cable",
    "permission was granted to the company to build", "Researchers at MIT published a paper about creative commons", "a free copy of the book with or without a cover", "redistribution of wealth and use of land",
    "the source of the river and its binary star", "Licensed under city law, taxis may use the lane", "released under the sea at night", "subject to the terms of the contract", "the public license office opens at nine",
    "international attribution of the painting is unclear", "Apache helicopters landed in version of the story", "the Mozilla team met the public", "any later version of the play was lost",
]
FAMILIES = tuple(TEMPLATES)
GRAMS = 3
SAMPLE_DOCS = 1000
SAMPLE_LINES = 10
KNOWN = 0.5
ALIKE = 0.4
_SALTS = place_numbers(2 * GRAMS)


def grams(words: np.ndarray, line: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1, 2, 3: (hashes, lines) of the word n-grams inside a line."""
    out = []
    for n in range(1, GRAMS + 1):
        if len(words) < n:
            break
        h = np.full(len(words) - n + 1, np.uint64(n), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(n):
                h += words[i : len(words) - n + 1 + i] * _SALTS[n - 1 + i]
        own = line[: len(line) - n + 1] == line[n - 1 :]
        out.append((h[own], line[: len(line) - n + 1][own]))
    return out


def paragraphs_of(data: bytes, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, line of each word, first line of each block, last line of each block).

    Blocks are runs of at least two lines with words; lines are numbered from 0. No block goes over one of
    ``ends``, the first lines after the texts that ``data`` is joined from.
    """
    hashes, at = [], []
    for offset, piece in blocks(data):
        h, starts, *_ = hash_words(piece, plain=True)
        hashes.append(h)
        at.append(starts + offset)
    words = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    starts = np.concatenate(at) if at else np.empty(0, np.int64)
    line = np.searchsorted(np.flatnonzero(np.frombuffer(data, np.uint8) == 10), starts)
    full = np.unique(line)
    owner = np.searchsorted(ends, full, side="right") if ends is not None else np.zeros(len(full), np.int64)
    edge = np.flatnonzero((np.diff(full, prepend=-9) > 1) | (np.diff(owner, prepend=-1) > 0)) if len(full) else full
    first, last = full[edge], full[np.append(edge[1:], len(full)) - 1] if len(full) else full
    many = last > first
    return words, line, first[many], last[many]


class Features:
    """Of paragraphs: places of the template n-grams (row, column), distinct; numbers of n-grams and of 2-grams."""

    def __init__(self, words: np.ndarray, row: np.ndarray, rows: int, names: np.ndarray):
        pairs, self.total, self.two = [], np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        for n, (h, r) in enumerate(grams(words, row), 1):
            count = np.bincount(r, minlength=rows)
            self.total += count
            if n == 2:
                self.two += count
            r, c = present(h, r, names)
            pairs.append(r.astype(np.int64) * len(names) + c)
        pairs = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        self.row, self.column = pairs // max(len(names), 1), pairs % max(len(names), 1)
        self.finish()

    def finish(self) -> None:
        hits = np.bincount(self.row, minlength=len(self.total))
        self.dense = (1 - hits / np.maximum(self.total, 1))[:, None]

    def of(self, k: int) -> np.ndarray:
        return self.column[np.searchsorted(self.row, k) : np.searchsorted(self.row, k + 1)]


class Classifier:
    """Trained models, calibration and template 2-grams; picklable."""

    def __init__(self):
        texts = [t for f in FAMILIES for t in TEMPLATES[f] + [p.format(n) for n in NAMES[f] for p in PHRASES[:4]]]
        found = [h for t in texts for h, _ in grams(*self.one(t))]
        self.names = np.unique(np.concatenate(found))
        two = lambda t: self.columns_of_two(t)
        self.sentences = [(f, two(t)) for f, name in enumerate(FAMILIES) for t in TEMPLATES[name] + NAMES[name] if len(two(t))]
        self.all_two = [np.unique(np.concatenate([s for g, s in self.sentences if g == f])) for f in range(len(FAMILIES))]

    @staticmethod
    def one(text: str) -> tuple[np.ndarray, np.ndarray]:
        words = hash_words(text.encode(), plain=True)[0]
        return words, np.zeros(len(words), np.int64)

    def columns_of_two(self, text: str) -> np.ndarray:
        found = grams(*self.one(text))
        return np.unique(present(*found[1], self.names)[1]) if len(found) > 1 else np.empty(0, np.int64)

    def features(self, texts: list[str]) -> Features:
        words = [self.one(t)[0] for t in texts]
        row = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        return Features(np.concatenate([*words, np.empty(0, np.uint64)]), row, len(texts), self.names)

    def fit(self, negatives: list[tuple[list[int], int, int]], seed: int = 5, made: int = 400) -> "Classifier":
        """negatives: (columns, number of n-grams, of 2-grams) of paragraphs of the corpus."""
        rng = random.Random(seed)
        fillers = [f"filler{k}" for k in range(50)]
        texts, family = [], []
        for f, name in enumerate(FAMILIES):
            for _ in range(made):
                whole = rng.choice(TEMPLATES[name]) if rng.random() < 0.5 else rng.choice(PHRASES).format(rng.choice(NAMES[name]))
                texts.append(varied(rng, whole, fillers))
                family.append(f)
        for name in FAMILIES:
            for sentence in TEMPLATES[name] + NAMES[name]:
                texts += scraps(rng, sentence)
        texts += [varied(rng, rng.choice(PROSE), fillers) for _ in range(made)]
        x = self.features(texts)
        corpus = [n for n in negatives if self.best_likeness(np.array(n[0], np.int64), n[2]) < ALIKE]
        x.row = np.concatenate([x.row, np.repeat(np.arange(len(texts), len(texts) + len(corpus)), [len(n[0]) for n in corpus])])
        x.column = np.concatenate([x.column, np.array([c for n in corpus for c in n[0]], np.int64)])
        x.total = np.concatenate([x.total, np.array([n[1] for n in corpus], np.int64)])
        x.finish()
        family = np.array(family + [-1] * (len(x.total) - len(family)))
        held = np.arange(len(family)) % 5 == 0
        new, pick = np.cumsum(~held) - 1, ~held[x.row]
        self.models = [Logistic().fit(new[x.row[pick]], x.column[pick], x.dense[~held], (family[~held] == f).astype(float), len(self.names)) for f in range(len(FAMILIES))]
        logits = self.logits(x)[held]
        right = (logits.argmax(1) == family[held]).astype(float)
        self.platt = Logistic(rounds=500).fit(np.empty(0, np.int64), np.empty(0, np.int64), logits.max(1)[:, None] / 5, right, 0)
        return self

    def logits(self, x: Features) -> np.ndarray:
        return np.column_stack([m.logits(x.row, x.column, x.dense) for m in self.models])

    def known(self, logits: np.ndarray) -> np.ndarray:
        none = np.empty(0, np.int64)
        return sigmoid(self.platt.logits(none, none, logits.max(1)[:, None] / 5))

    def likeness(self, own: np.ndarray, two: int, family: int) -> float:
        """Own: the paragraph's columns; the larger share of 2-grams in common, of a sentence or of the paragraph."""
        if not two:
            return 0.0
        best = len(np.intersect1d(own, self.all_two[family], assume_unique=True)) / two
        return max([best] + [len(np.intersect1d(own, s, assume_unique=True)) / len(s) for f, s in self.sentences if f == family])

    def best_likeness(self, own: np.ndarray, two: int) -> float:
        return max(self.likeness(own, two, f) for f in range(len(FAMILIES))) if len(own) else 0.0

    def confirmed(self, x: Features) -> dict[int, tuple[int, float, float]]:
        """Paragraph: (family, probability, likeness) of those that are known and confirmed."""
        logits = self.logits(x)
        family, known = logits.argmax(1), self.known(logits)
        out = {}
        for k in np.flatnonzero(known >= KNOWN).tolist():
            if (like := self.likeness(x.of(k), int(x.two[k]), int(family[k]))) >= ALIKE:
                out[k] = int(family[k]), float(known[k]), like
        return out

    def scan_batch(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int, float, float]]]]:
        """For each text (number of its lines with words, [(line, family, probability, likeness)])."""
        out: list = [(0, [])] * len(texts)
        for k, end, data, _ in batches_of(texts):
            ends = np.cumsum([t.count(b"\n") + 1 for t in texts[k:end]])  # lines of the joined texts
            words, line, first, last = paragraphs_of(data, ends)
            begin = ends - np.diff(ends, prepend=0)
            full = np.unique(line)
            found = {int(full[i]): v for i, v in self.confirmed(Features(words, np.searchsorted(full, line), len(full), self.names)).items()} if len(full) else {}
            for b, v in self.blocks_found(words, line, first, last).items():
                if not any(first[b] <= i <= last[b] and found[i][0] == v[0] for i in found):
                    found.setdefault(int(first[b]), v)
            of_line = np.searchsorted(ends, full, side="right")
            counts = np.bincount(of_line, minlength=end - k)
            for j in range(end - k):
                out[k + j] = (int(counts[j]), [])
            for i in sorted(found):
                j = int(np.searchsorted(ends, i, side="right"))
                out[k + j][1].append((i - int(begin[j]), *found[i]))
        return out

    def blocks_found(self, words: np.ndarray, line: np.ndarray, first: np.ndarray, last: np.ndarray) -> dict[int, tuple[int, float, float]]:
        if not len(first):
            return {}
        at = np.searchsorted(first, line, side="right") - 1
        inside = (at >= 0) & (line <= last[np.maximum(at, 0)])
        return self.confirmed(Features(words[inside], at[inside], len(first), self.names))

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, float, float]]]:
        return self.scan_batch([text.encode()])[0]


def varied(rng: random.Random, sentence: str, fillers: list[str]) -> str:
    """A sentence as it may be met: words dropped, passages cut out, other words around it."""
    words = [w for w in sentence.split() if rng.random() > 0.05]
    if len(words) > 12 and rng.random() < 0.5:
        at = rng.randrange(len(words) - 8)
        words = words[at : at + rng.randrange(8, len(words))]
    if rng.random() < 0.5:
        extra = [rng.choice(fillers) for _ in range(rng.randrange(1, 9))]
        words = extra + words if rng.random() < 0.5 else words + extra
    return " ".join(words)


def scraps(rng: random.Random, sentence: str) -> list[str]:
    """A template's words in another order: they are no licence."""
    words = sentence.split()
    return [" ".join(rng.sample(words, len(words))) + " filler0 filler1" for _ in range(4)] if len(words) > 3 else []


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Classifier:
    """Negatives: lines of the ``sample_docs`` documents with the smallest hash of doc_id, as features."""
    classifier = Classifier()
    picked = hashed_sample(docs.select("doc_id").where("doc_id is not null").distinct(), "doc_id", sample_docs)
    rows = docs.join(F.broadcast(picked), "doc_id", "left_semi").select(text_of().alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for text in f["text"]:
                words, line, *_ = paragraphs_of(text.encode())
                full = np.unique(line)
                x = Features(words, np.searchsorted(full, line), len(full), classifier.names)
                some = random.Random(text).sample(range(len(full)), min(len(full), SAMPLE_LINES))
                out += [(x.of(k).tolist(), int(x.total[k]), int(x.two[k])) for k in some]
            yield pd.DataFrame(out, columns=["columns", "total", "two"])

    lines = rows.mapInPandas(released(run), "columns array<long>, total long, two long").distinct().collect()
    return classifier.fit(sorted((list(r.columns), r.total, r.two) for r in lines))


SCAN = "doc_id long, n_paragraphs long, n_licences long, families string, found string"


def scan_licences(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, n_paragraphs, n_licences, families (comma-joined), found (line:family:probability:likeness)."""
    held = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k in range(0, len(f), 1024):
                part = f.iloc[k : k + 1024]
                for doc_id, (n, found) in zip(part["doc_id"], held.value.scan_batch([t.encode() for t in part["text"]]), strict=True):
                    shown = ";".join(f"{k}:{FAMILIES[a]}:{p:.4f}:{s:.4f}" for k, a, p, s in found)
                    out.append((doc_id, n, len(found), ",".join(sorted({FAMILIES[a] for _, a, _, _ in found})), shown))
            yield pd.DataFrame(out, columns=["doc_id", "n_paragraphs", "n_licences", "families", "found"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInPandas(released(run), SCAN)


def op6_licence_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scan_licences(docs, train(docs))


QUERIES = {"op6_licence_scan": op6_licence_scan}
