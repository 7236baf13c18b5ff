"""License scans: a trained classifier of the sentences of paragraphs, confirmed by comparison with templates.

Paragraphs lie between blank lines; wrapped lines are joined. Multinomial logistic regression over
sparse word 1- to 3-grams tells licence families and an unknown class apart. Notices are the product
of frames and names, beside longer texts; the temperature that calibrates the probabilities is fitted
on notices held out whole, and the unknown class learns from ordinary paragraphs and from sentences
that speak of licences without being one. A sentence whose best family falls short of the margin is
unknown. A prediction is confirmed if enough of a template of the family stands in the sentence.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache, cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_batches, text_of

UNKNOWN = "unknown"
# Names of each family's licences.
NAMES = {
    "agpl": ("GNU Affero General Public License", "AGPL-3.0", "AGPLv3"),
    "apache": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"),
    "artistic": ("Artistic License", "Artistic License 2.0", "Perl Artistic License", "Artistic-2.0", "Artistic-1.0"),
    "boost": ("Boost Software License", "Boost Software License, Version 1.0", "Boost License 1.0", "BSL-1.0"),
    "bsd": ("BSD License", "BSD-style license", "3-Clause BSD License", "BSD-3-Clause", "BSD-2-Clause"),
    "cc": (
        "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution-ShareAlike License", "Creative Commons Attribution NonCommercial License",
        "Creative Commons Zero", "CC BY 4.0", "CC BY-SA 4.0", "CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC BY-ND 4.0", "CC0-1.0",
    ),
    "epl": ("Eclipse Public License", "Eclipse Public License 2.0", "EPL-2.0"),
    "gpl": ("GNU General Public License", "GNU General Public License, version 3", "GNU GPL", "GPL-3.0", "GPLv2", "GPLv3"),
    "isc": ("ISC License", "ISC"),
    "lgpl": ("GNU Lesser General Public License", "LGPL-2.1", "LGPLv3"),
    "mit": ("MIT License", "MIT license terms", "MIT"),
    "mpl": ("Mozilla Public License", "Mozilla Public License, v. 2.0", "MPL 2.0", "MPL-2.0"),
    "wtfpl": ("WTFPL", "Do What The Fuck You Want To Public License", "WTFPL v2"),
    "zlib": ("zlib License", "zlib/libpng License", "zlib-acknowledgement"),
}
FRAMES = (
    "Licensed under the {}", "Licensed under {}", "Released under the {}", "This work is licensed under a {}", "This project is licensed under the terms of the {}", "SPDX-License-Identifier: {}",
    "License: {}", "Distributed under the {}", "This software is available under the {}", "The {}", "is subject to the terms of the {}", "see the {} for more details", "Use of this source code is governed by a {}",
    "either version 3 of the {} or any later version", "{}, see the LICENSE file", "{} license", "under the {} licence",
)
#: Names that are whole notices only in these frames, since they are words of other meaning too.
_SHORT = ("SPDX-License-Identifier: {}", "License: {}", "Licensed under {}", "{} license", "under the {} licence", "the {} license", "Released under the {} license")
# Customary texts of each family, a sentence each.
TEXTS = {
    "apache": (
        "you may not use this file except in compliance with the License", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    ),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution",),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "You should have received a copy of the GNU General Public License along with this program",
    ),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "If a copy of the MPL was not distributed with this file, you can obtain one under the license at http://mozilla.org/MPL/2.0/"),
    "proprietary": (
        "All rights reserved", "Copyright by the authors, all rights reserved", "Copyright (c) 2020 Example Corporation, all rights reserved", "Unauthorized copying of this file, via any medium, is strictly prohibited",
        "This document is proprietary and confidential under the license agreement", "No license is granted by this document", "Copyright 2019, the authors",
    ),
    "public domain": ("This is free and unencumbered software released into the public domain", "This work has been dedicated to the public domain", "Released into the public domain"),
}
#: Sentences that speak of licences, copies and rights without being a notice.
HARD_NEGATIVES = (
    "All rights reserved seats were licensed under the bridge", "the driver's licence expired under the new law", "She lost her driving license in the city", "copyright law was discussed in the public domain of politics",
    "the shop is licensed to sell beer", "Taxi drivers are licensed under a municipal scheme", "a license to operate the mine was granted by the state", "He asked permission to use the car", "permission is needed to enter the building",
    "the Apache people lived in the south", "the Apache helicopter was released to the army", "students of MIT released a study", "the university MIT is in Cambridge", "mit der Lizenz zum Fahren", "ein Mann mit Hut", "the eclipse was seen by the public",
    "the general public was free to enter", "free software was sold on the market", "the poet took creative license with the facts", "the source of the river", "the lawyer spoke about copyright and patents", "they reserved all the rooms",
    "hunting licenses are distributed by the office", "fishing license fees were raised", "the terms of the agreement were subject to change", "the license plate of the car was stolen", "licence to print money", "an unlicensed driver was stopped",
    "the commons is creative and open", "Mozilla is the name of a browser", "the file was copied without permission", "the rights of the people are reserved by law", "under the terms of the treaty the land was redistributed", "la licence de la ville", "la licencia de conducir",
    "die Lizenz wurde entzogen", "the license was revoked for the bar", "the BSD team played well", "ISC members met in spring", "the license agreement talks failed", "the doctor is licensed in two states", "a software license costs money",
    "the license server is down", "check your license before you drive", "all copies of the book were sold", "the above notice shall be read aloud", "the version of the story is subject to debate", "the licensed product line grew", "copyright disputes delayed the release", "no license, no music in the cafe",
)
#: One of these stands in every template; lines without any are taken for ordinary ones when the unknown class is trained.
CUES = ("licen", "copyright", "reserved", "permission", "redistribut", "unauthorized copying", "public domain", "released under", "distributed under", "conditions and the following disclaimer")
SPDX = "spdx-license-identifier"
_EDGE = ".,;:!?()[]\"'*#$%&|<>/-=_"
_END = "\n"
#: Marks that end a sentence, and the last characters of words that may have one.
_MARKS, _CLOSING = frozenset(".;!?"), frozenset(".;!?\"')]")
#: By so much the scores of many sentences at once may differ from a single one's.
_SLACK = 1e-3


def sentences(text: str) -> Iterator[tuple[int, int, int, list[str]]]:
    """(paragraph, start, end, words) of each sentence; positions in code points. The last word of a whole sentence is END.

    A sentence ends at a mark before white space, at the paragraph's end, and at a line's end where
    the next line begins with a capital.
    """
    for paragraph, first, last, words in _placed_sentences(text):
        yield paragraph, *_span(text, first, last), words


def _span(text: str, first: tuple[int, int], last: tuple[int, int]) -> tuple[int, int]:
    """Start of one token and end of another, each given by the place of its line and its number there."""
    token = lambda at, n: next(islice(re.compile(r"\S+").finditer(text, at), n, None))
    return token(*first).start(), token(*last).end()


def _placed_sentences(text: str) -> Iterator[tuple[int, tuple[int, int], tuple[int, int], list[str]]]:
    """As ``sentences``, with the first and the last token that has a word instead of positions, which few callers need.

    Paragraphs are runs of lines; a line of white space is one of its own with the lines that follow it, an empty line is none.
    """
    k, within, at = -1, False, 0
    words: list[str] = []
    first = last = (0, 0)
    for i, line in enumerate(text.split("\n")):
        raws = line.split()
        if i and not raws:  # a blank line ends the paragraph
            if words:
                yield k, first, last, [*words, _END]
                words = []
            within = False
        if not within and (line or i and raws):
            k, within = k + 1, True
        if raws:
            own = [w.strip(_EDGE) for w in line.lower().split()]
            ends = [n for n, raw in enumerate(raws) if raw[-1] in _CLOSING and raw.rstrip("\"')]")[-1:] in _MARKS]
            fresh, begin = True, 0
            for n in (*ends, len(raws)):
                some = [j for j in range(begin, min(n + 1, len(raws))) if own[j]]
                if some:
                    if fresh and words and raws[some[0]].lstrip(_EDGE)[:1].isupper():
                        yield k, first, last, [*words, _END]
                        words = []
                    fresh = False
                    first = first if words else (at, some[0])
                    last = at, some[-1]
                    words.extend([own[j] for j in some])
                if words and n < len(raws):
                    yield k, first, last, [*words, _END]
                    words = []
                begin = n + 1
        at += len(line) + 1
    if words:
        yield k, first, last, [*words, _END]


def ngrams(words: list[str], sizes: Iterable[int] = (1, 2, 3)) -> set[tuple[str, ...]]:
    return {g for n in sizes for g in zip(*(words[i:] for i in range(n)), strict=False)}


def whole(sentence: str) -> list[str]:
    """The words of one sentence, whatever marks stand in it."""
    return [w for x in sentence.split() if (w := x.lower().strip(_EDGE))] + [_END]


@cache
def _names() -> dict[tuple[str, ...], str]:
    return {tuple(whole(name)[:-1]): family for family, names in NAMES.items() for name in names}


def named_families(words: list[str], short: bool) -> set[str]:
    """Families whose names stand in a sentence; ``short``: names of one plain word, such as MIT, count as well, and so do identifiers."""
    out = set()
    for size in {len(n) for n in _names()}:
        for gram in zip(*(words[i:] for i in range(size)), strict=False):
            family = _names().get(gram)
            if family and (short or size > 1 or any(c.isdigit() for c in gram[0])):
                out.add(family)
    if short:
        out |= {family for family in NAMES for w in words if re.fullmatch(rf"{family}(-[\w.+-]+)?", w)}
    return out


def notices() -> dict[str, list[tuple[str, str]]]:
    """By family, (group, notice): frames filled with names, grouped by frame, and the texts, each its own group."""
    out: dict[str, list[tuple[str, str]]] = {}
    for family, names in NAMES.items():
        for name in names:
            frames = _SHORT if len(name) <= 3 else FRAMES
            out.setdefault(family, []).extend((frame, frame.format(name)) for frame in frames if any(c in frame.format(name).lower() for c in CUES))
    for family, texts in TEXTS.items():
        out.setdefault(family, []).extend((t, t) for t in texts)
    return out


@dataclass(frozen=True)
class LicenseModel:
    """classes: families, then UNKNOWN. weights: n-grams by classes. temperature divides the scores."""

    classes: tuple[str, ...]
    index: dict[tuple[str, ...], int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    margin: float
    confirm: float
    templates: dict[str, tuple[frozenset, ...]]

    @cached_property
    def vocabulary(self) -> frozenset[str]:
        return frozenset(w for g in self.index for w in g)

    def probabilities(self, words: list[str]) -> np.ndarray:
        grams: set[tuple[str, ...]] = set()
        run: list[str] = []
        for w in (*words, ""):  # no n-gram of the index holds a word that isn't in its vocabulary
            if w in self.vocabulary:
                run.append(w)
            elif run:
                grams |= ngrams(run)
                run = []
        hits = sorted(k for g in grams if (k := self.index.get(g)) is not None)
        z = (self.weights[hits].sum(axis=0) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    @cached_property
    def by_size(self) -> tuple[dict[str, int], dict[tuple[str, ...], int], dict[tuple[str, ...], int]]:
        one, two, three = ({g: k for g, k in self.index.items() if len(g) == n} for n in (1, 2, 3))
        return {g[0]: k for g, k in one.items()}, two, three

    def hits(self, words: list[str]) -> set[int]:
        """The n-grams of the index in a sentence."""
        one, two, three = self.by_size
        out: set[int] = set()
        a = b = None  # the two words before, as far as they are known
        for w in words:
            if w not in self.vocabulary:
                a = b = None
                continue
            out.add(one.get(w, -1))
            if b is not None:
                out.add(two.get((b, w), -1))
                if a is not None:
                    out.add(three.get((a, b, w), -1))
            a, b = b, w
        out.discard(-1)
        return out

    def perhaps(self, many: list[list[str]]) -> list[int]:
        """The numbers of the sentences that may be of a family or of an SPDX expression: all are scored at once; a single one's score decides."""
        if not many:
            return []
        hits = [list(self.hits(words)) for words in many]
        p = _softmax((_scores(hits, self.weights, self.bias)) / self.temperature)
        p[:, self.classes.index(UNKNOWN)] = 0
        high = p.max(axis=1) >= self.margin - _SLACK
        return [n for n, words in enumerate(many) if high[n] or SPDX in words]

    def find(self, words: list[str]) -> tuple[str, float, float] | None:
        """(family, probability, similarity) of a sentence that isn't of the unknown class."""
        p = self.probabilities(words)
        best = int(p.argmax())
        if self.classes[best] == UNKNOWN or p[best] < self.margin:
            return None
        return self.classes[best], float(p[best]), self.similarity(self.classes[best], words)

    def similarity(self, family: str, words: list[str]) -> float:
        grams = ngrams(words, (2,))
        return max(len(grams & t) / len(t) for t in self.templates[family])

    def families(self, words: list[str]) -> list[tuple[str, float, float]]:
        """As ``find``, of all families of a sentence.

        A sentence that is a notice of one family is one of the others that it names, too, and so is an
        SPDX expression of those that its identifiers name.
        """
        spdx = SPDX in words
        first = self.find(words)
        if not (first or spdx):
            return []
        p = self.probabilities(words)
        more = named_families(words, spdx)
        if spdx and more:
            first = first if first and first[0] in more else None
        others = [(f, float(p[self.classes.index(f)]), 1.0) for f in sorted(more) if not first or f != first[0]]
        return ([first] if first else []) + others

    def scan(self, text: str) -> list[dict]:
        """The notices of a text: neighbouring sentences of one family and paragraph are one notice."""
        found: list[dict] = []
        last: dict[str, tuple[int, int]] = {}
        every = list(_placed_sentences(text))
        for n in self.perhaps([words for *_, words in every]):
            paragraph, first, to, words = every[n]
            families = self.families(words)
            start, end = _span(text, first, to) if families else (0, 0)
            for family, p, similarity in families:
                row = {"paragraph": paragraph, "start": start, "end": end, "family": family, "probability": p, "similarity": similarity, "confirmed": similarity >= self.confirm}
                before, at = last.get(family, (-2, -1))
                if before == n - 1 and found[at]["paragraph"] == paragraph:
                    old = found[at]
                    found[at] = row | {"start": old["start"]} | {k: max(row[k], old[k]) for k in ("probability", "similarity", "confirmed")}
                    last[family] = n, at
                else:
                    last[family] = n, len(found)
                    found.append(row)
        return found


def samples(negatives: list[str], each: int, seed: int) -> list[tuple[str, str, list[str]]]:
    """Labelled sentences (group, class, words): notices with words lost and with ordinary words before them; of the unknown class, ordinary, licence-like and shuffled ones."""
    rng, out = random.Random(seed), []
    ordinary = [w for t in negatives for w in whole(t)[:-1]] or ["word"]
    around = lambda most: rng.choices(ordinary, k=rng.randint(0, most))
    texts = [(family, group, whole(t)) for family, ts in notices().items() for group, t in ts]
    for family, group, words in texts:
        for i in range(each * 4 if group not in FRAMES or len(words) < 5 else each):  # texts and short forms have few kin
            kept = [w for w in words if i == 0 or w == _END or rng.random() > 0.06]
            out.append((group, family, kept if i == 0 else around(6) + kept))
    for t in HARD_NEGATIVES:
        for i in range(each):
            out.append((t, UNKNOWN, (around(6) if i else []) + whole(t)[: -1 if i % 3 == 2 else None] + (around(6) + [_END] if i % 3 == 2 else [])))
    for i in range(len(texts)):
        mixed = [w for _, _, words in rng.sample(texts, 2) for w in words[:-1]]
        rng.shuffle(mixed)
        out.append((f"mixed {i}", UNKNOWN, mixed[: rng.randint(3, 16)] + [_END]))
    # reserved, licensed and the like go on with other words in ordinary sentences
    for i, (_, _, words) in enumerate(rng.choices([t for t in texts if len(t[2]) < 8], k=len(texts))):
        cut_off = words[: max(1, len(words) // 2)]
        out.append((f"begun {i}", UNKNOWN, around(4) + cut_off + rng.choices(ordinary, k=rng.randint(3, 10)) + [_END]))
    return out + [(f"own {i}", UNKNOWN, whole(t)) for i, t in enumerate(negatives)]


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _sums(values: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by group; groups come sorted."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(groups):
        first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        out[groups[first]] = np.add.reduceat(values, first, axis=0)
    return out


def _scores(rows: list[list[int]], w: np.ndarray, b: np.ndarray) -> np.ndarray:
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return _sums(w[[k for r in rows for k in r]], row, len(rows)) + b


def _fit(rows: list[list[int]], y: np.ndarray, size: int, rounds: int, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by gradient descent with momentum; ``rows`` hold the numbers of their n-grams."""
    feature = np.array([k for r in rows for k in r], np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    order = np.argsort(feature, kind="stable")
    by_feature, its_row = feature[order], row[order]
    w, b = np.zeros((size, y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    momentum, drift = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        error = ((_softmax(_sums(w[feature], row, len(rows)) + b) - y) / max(len(rows), 1)).astype(np.float32)
        momentum = 0.9 * momentum + _sums(error[its_row], by_feature, size) + ridge * w
        drift = 0.9 * drift + error.sum(axis=0)
        w, b = w - 0.5 * momentum, b - 0.5 * drift
    return w, b


def train(labelled: list[tuple[str, str, list[str]]], rounds: int = 200, ridge: float = 3e-4, folds: int = 3, margin: float = 0.5, confirm: float = 0.6) -> LicenseModel:
    """The classifier of labelled sentences (group, class, words). Groups are held out whole, fold by fold, for the temperature."""
    families = notices()
    classes = (*sorted(families), UNKNOWN)
    grams = sorted({g for _, c, words in labelled if c != UNKNOWN for g in ngrams(words[-40:])} | {g for t in HARD_NEGATIVES for g in ngrams(whole(t))})
    known = {w for ts in families.values() for _, t in ts for w in whole(t)} | {w for t in HARD_NEGATIVES for w in whole(t)}
    index = {g: k for k, g in enumerate(g for g in grams if known.issuperset(g))}
    rows = [sorted(index[g] for g in ngrams(words) if g in index) for _, _, words in labelled]
    y = np.zeros((len(labelled), len(classes)), np.float32)
    y[np.arange(len(rows)), [classes.index(c) for _, c, _ in labelled]] = 1
    groups = {g: k % folds for k, g in enumerate(sorted({g for g, _, _ in labelled}, key=lambda g: random.Random(g).random()))}
    held = np.array([groups[g] for g, _, _ in labelled])
    z = np.zeros_like(y)
    for k in range(folds):
        own, others = np.flatnonzero(held == k), np.flatnonzero(held != k)
        w, b = _fit([rows[i] for i in others], y[others], len(index), rounds, ridge)
        z[own] = _scores([rows[i] for i in own], w, b)
    loss = lambda t: -np.log(np.maximum((_softmax(z / t) * y).sum(axis=1), 1e-12)).mean()
    temperature = float(min(np.geomspace(0.2, 5, 33), key=loss))
    w, b = _fit(rows, y, len(index), rounds, ridge)
    templates = {k: tuple(frozenset(ngrams(whole(t), (2,))) for _, t in ts) for k, ts in families.items()}
    return LicenseModel(classes, index, w, b, temperature, margin, confirm, templates)


def ordinary_paragraphs(docs: DataFrame, most: int, text: str = "text") -> DataFrame:
    """A bounded sample of lines that hold no cue, those with the smallest hashes of a share of all that follows their number."""
    share = max(1, docs.count() // max(most, 1))
    lines = docs.select(F.explode(F.split(text_of(text), "\n")).alias("line")).withColumn("h", F.xxhash64("line"))
    few = lines.filter(F.pmod(F.col("h"), F.lit(share)) == 0)
    plain = few.filter(~F.lower("line").rlike("|".join(CUES)) & (F.length("line") < 2000) & (F.length("line") > 20))
    return plain.orderBy("h", "line").limit(most).select("line")


def fit(docs: DataFrame, most_paragraphs: int = 600, each: int = 5, text: str = "text", seed: int = 5) -> LicenseModel:
    """Train on notices and on ``most_paragraphs`` ordinary paragraphs of ``docs``, the bound of the sample."""
    negatives = [r["line"] for r in ordinary_paragraphs(docs, most_paragraphs, text).collect()]
    return train(samples(negatives, each, seed))


def scan(docs: DataFrame, model: LicenseModel, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, notices array<struct<paragraph, start, end, family, probability, similarity, confirmed>>.

    Paragraphs are counted from 0; positions are code points, ends exclusive. All notices of a text are
    listed, sentences of the unknown class aren't. Null and empty texts have none; repeated rows give
    repeated rows; an empty table gives none; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [shared.value.scan(t) for t in batch.column(1).to_pylist()]
        kind = pa.struct([("paragraph", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_())])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(kind))], ["doc_id", "notices"])

    kind = docs.schema[doc_id].dataType.simpleString()
    fields = "paragraph: int, start: bigint, end: bigint, family: string, probability: double, similarity: double, confirmed: boolean"
    return over_batches(docs, [F.col(doc_id), text_of(text)], work, f"doc_id {kind}, notices array<struct<{fields}>>")
