"""Licence scans: a paragraph classifier over word n-grams, confirmed by comparison with templates."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, few_rows, map_batches

# Licence families and notices by which works commonly name them.
TEMPLATES = {
    "AGPL": ["licensed under the GNU Affero General Public License version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "Released under the Apache 2.0 License", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0"],
    "Artistic": ["Licensed under the Artistic License 2.0", "You may copy and distribute verbatim copies of the Standard Version of this Package under the terms of the Artistic License"],
    "BSL": ["Distributed under the Boost Software License, Version 1.0"],
    "BSD": ["Released under the BSD License", "Licensed under the 3-Clause BSD License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC-BY": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-ND": ["Licensed under CC BY-NC-ND 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA": ["Licensed under CC BY-NC-SA 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-ND": ["Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0": ["Released under CC0 1.0", "This work is dedicated to the public domain under CC0 1.0 Universal"],
    "EPL": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Licensed under the Eclipse Public License 2.0"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3", "Released under the GNU GPL version 2 or later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "ISC": ["Released under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "LGPL": ["licensed under the GNU Lesser General Public License version 2.1", "modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "MIT": ["Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License 2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain", "Released under the Unlicense"],
    "zlib": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", "Released under the zlib License"],
}
# Words that say that what follows does not hold, words that a notice may open with, and words of a notice
# that a denial stands before.
NEGATIONS = (("not",), ("no", "longer"), ("never",), ("not", "yet"))
OPENINGS = ("this work is", "this code is", "the software is", "it is", "this is not a toy", "")
NEGATED = {"licensed", "released", "distributed", "dedicated", "granted", "permitted", "made", "subject", "free"}

#: Orders of the word n-grams that are features.
ORDERS = (1, 2, 3)
#: Documents from which paragraphs of no licence are taken, at most, and such paragraphs at most.
SAMPLE, NEGATIVES = 300, 3_000
#: Variants of each notice, and of its denial, for the fit; parts of the notices that calibration leaves out in turn.
VARIANTS, FOLDS = 40, 4
#: A prediction is confirmed if the paragraph has so much of a notice of its family: weighted share of its word pairs.
CONFIRMED = 0.75
#: Words on each side of a line break, and between two, that a notice across line breaks may take.
REACH = 40
SCHEMA = "doc_id long, n_paragraphs long, n_licensed long, families array<string>, top_family string, top_probability double, top_similarity double, first_paragraph long"
_words = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*").findall


def words_of(paragraph: str) -> list[str]:
    return _words(paragraph.lower())


def grams(words: list[str], orders: tuple[int, ...] = ORDERS) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for n in orders for i in range(len(words) - n + 1)}


def denials(notice: list[str]) -> list[list[str]]:
    """A notice with words before its verbs that deny it."""
    return [[*notice[:i], *n, *notice[i:]] for i, w in enumerate(notice) if w in NEGATED for n in NEGATIONS]


class Vocabulary:
    """n-grams of the templates and their denials as feature numbers; a paragraph has the features of its runs of their words."""

    def __init__(self, templates: dict[str, list[str]]):
        notices = [words_of(t) for ts in templates.values() for t in ts]
        found = {g for w in notices for g in grams(w)}
        # a denial is known by its words next to the verb, never by one word alone
        denied = {g for w in notices for x in denials(w) for g in grams(x, (2, 3)) if g not in found and set(g) & NEGATED}
        self.number = {g: k for k, g in enumerate(sorted((found | denied) - {("not",)}))}
        self.single = {w for g in self.number for w in g}
        # words without a pair that a notice has can't be a notice
        self.pairs = {g for w in notices for g in grams(w, (2,))}

    def features(self, words: list[str]) -> list[int]:
        out, run = set(), []
        for w in [*words, ""]:
            if w in self.single:
                run.append(w)
            elif run:
                out |= {self.number[g] for g in grams(run) if g in self.number}
                run = []
        return sorted(out)


@dataclass
class Classifier:
    """Softmax regression over the families and the unknown class 0, with a temperature and a threshold."""

    families: list[str]
    vocabulary: Vocabulary
    weights: np.ndarray  # a row for each feature and a last one that counts always
    temperature: float
    threshold: float
    notices: dict[str, list[set]]
    reliability: float  # mean gap between probability and accuracy over notices that were left out

    def probabilities(self, features: list[int]) -> np.ndarray:
        z = (self.weights[features].sum(axis=0) + self.weights[-1]) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def similarity(self, words: list[str], family: str) -> float:
        """Largest share of the word pairs of a notice of the family that the paragraph has."""
        have = grams(words, (2,))
        return max(len(have & t) / len(t) for t in self.notices[family])

    def judge(self, paragraph: str) -> tuple[str, float, float] | None:
        """(family, probability, similarity) of a paragraph with a confirmed licence."""
        return self.judge_words(words_of(paragraph))

    def judge_words(self, words: list[str]) -> tuple[str, float, float] | None:
        features = self.vocabulary.features(words)
        if not features:
            return None
        p = self.probabilities(features)
        k = int(np.argmax(p))
        if not k or p[k] < self.threshold:
            return None
        family = self.families[k - 1]
        s = self.similarity(words, family)
        return (family, float(p[k]), s) if s >= CONFIRMED else None

    def wrapped(self, lines: list[list[str]]) -> list[tuple[int, str, float, float]]:
        """(first line, family, probability, similarity) of notices that run over the breaks of lines without a blank
        line between them.

        A span is the end of a line, whole lines, and the start of a line. It counts if it has more of a notice than any
        of its lines alone; of spans that overlap, the most similar and then the shortest counts.
        """
        have = set().union(*(zip(w, w[1:], strict=False) for w in lines), ((a[-1], b[0]) for a, b in zip(lines, lines[1:], strict=False))) & self.vocabulary.pairs
        if len(lines) < 2 or not any(len(have & t) >= CONFIRMED * len(t) for ts in self.notices.values() for t in ts):
            return []
        hits = []
        for i in range(len(lines) - 1):
            words = lines[i][-REACH:]
            between = 0
            for j in range(i + 1, len(lines)):
                span = words + lines[j][:REACH]
                hit = self.judge_words(span)
                if hit and hit[2] > max(self.similarity(w, hit[0]) for w in lines[i : j + 1]):
                    hits.append((-hit[2], len(span), i, j, hit))
                between += len(lines[j])
                if between > REACH:
                    break
                words = words + lines[j]
        out, taken = [], set()
        for _, _, i, j, hit in sorted(hits, key=lambda x: x[:4]):
            # two notices can meet within a line, but not over the same break
            if taken.isdisjoint(range(i, j)):
                taken |= set(range(i, j))
                out.append((i, *hit))
        return out

    def scan(self, body: str) -> tuple[int, list[tuple[int, str, float, float]]]:
        """Lines that are not blank, and (line, family, probability, similarity) of the notices within and across them."""
        found, run, k = [], [], 0
        for p in [*body.split("\n"), ""]:
            words = words_of(p)
            if words:
                if hit := self.judge_words(words):
                    found.append((k, *hit))
                run.append((k, words))
            else:
                if len(run) > 1:
                    found += [(run[i][0], *hit) for i, *hit in self.wrapped([w for _, w in run])]
                run = []
            k += bool(p.strip())
        return k, sorted(found, key=lambda x: x[0])


def variants(template: list[str], filler: list[str], r: random.Random) -> list[list[str]]:
    """A notice as it is found: whole, cut, with lost words, within other text."""
    out = [template]
    for _ in range(VARIANTS - 1):
        t = [w for w in template if r.random() > 0.08] or template
        if len(t) > 8 and r.random() < 0.4:
            at = r.randint(0, len(t) // 4)
            t = t[at : len(t) - r.randint(0, len(t) // 4)]
        if t[0] in NEGATED and r.random() < 0.5:
            t = [*r.choice(OPENINGS).split(), *t]
        if filler and r.random() < 0.6:
            at = r.randint(0, max(0, len(filler) - 30))
            extra = filler[at : at + r.randint(1, 30)]
            t = [*extra, *t] if r.random() < 0.5 else [*t, *extra]
        out.append(t)
    return out


def regression(rows: list[list[int]], labels: np.ndarray, features: int, classes: int, rounds: int) -> np.ndarray:
    """Weights of a softmax regression over sparse rows (lists of feature numbers), by Adam; the last row is the bias.

    Rows are kept as one array of feature numbers with the ends of rows; both passes go over what is there only.
    """
    size = np.array([len(r) + 1 for r in rows])
    at = np.fromiter((f for r in rows for f in [*r, features]), np.int64, int(size.sum()))
    begin = np.cumsum(size) - size
    row = np.repeat(np.arange(len(rows)), size)
    by_feature = np.argsort(at, kind="stable")
    used, first = np.unique(at[by_feature], return_index=True)
    target = np.eye(classes, dtype=np.float32)[labels]
    w = np.zeros((features + 1, classes), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = np.add.reduceat(w[at], begin)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        d = (e / e.sum(axis=1, keepdims=True) - target) / len(rows)
        g = 1e-5 * w
        g[used] += np.add.reduceat(d[row[by_feature]], first)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def logits(weights: np.ndarray, rows: list[list[int]]) -> np.ndarray:
    return np.array([weights[r].sum(axis=0) + weights[-1] for r in rows], np.float64).reshape(len(rows), weights.shape[1])


def softmax(z: np.ndarray, temperature: float) -> np.ndarray:
    e = np.exp((z - z.max(axis=1, keepdims=True)) / temperature)
    return e / e.sum(axis=1, keepdims=True)


def fit(paragraphs: list[str], templates: dict[str, list[str]] = TEMPLATES, seed: int = 3, rounds: int = 150) -> Classifier:
    """Fit to variants of the templates, and for the unknown class to paragraphs that are like none of them, to shuffled
    template words and to denials of the templates.

    Temperature and threshold come from rows that the weights they are tried on have not seen: in turn a part of all rows
    is left out, and with them whole families, whose notices the weights should then take for unknown ones.
    """
    r = random.Random(seed)
    families = sorted(templates)
    vocabulary = Vocabulary(templates)
    notices = {f: [grams(words_of(t), (2,)) for t in ts] for f, ts in templates.items()}
    every = [t for ts in notices.values() for t in ts]
    plain = [w for p in paragraphs if (w := words_of(p)) and max(len(grams(w, (2,)) & t) / len(t) for t in every) < 0.3]
    filler = [w for p in plain for w in p]
    pool = [words_of(t) for ts in templates.values() for t in ts]
    rows: list[tuple[list[int], int, int]] = [(vocabulary.features(w), 0, k % FOLDS) for k, w in enumerate(plain)]
    for k in range(len(pool) * 20):
        rows.append((vocabulary.features([r.choice(r.choice(pool)) for _ in range(r.randint(2, 20))]), 0, k % FOLDS))
    for k, f in enumerate(families, 1):
        for t in templates[f]:
            rows += [(vocabulary.features(v), k, i % FOLDS) for i, v in enumerate(variants(words_of(t), filler, r))]
            denied = denials(words_of(t))
            for i in range(VARIANTS if denied else 0):
                d = r.choice(denied)
                if d[0] in {n[0] for n in NEGATIONS} and r.random() < 0.5:
                    d = [*r.choice(OPENINGS[:4]).split(), *d]
                extra = [filler[r.randrange(len(filler))] for _ in range(r.randint(0, 10))] if filler else []
                rows.append((vocabulary.features([*extra, *d]), 0, i % FOLDS))
    x, y, fold = [a for a, _, _ in rows], np.array([b for _, b, _ in rows]), np.array([c for _, _, c in rows])
    number, classes = len(vocabulary.number), len(families) + 1
    z, truth = [], []
    for part in range(FOLDS):
        left_out = (y > 0) & (y % FOLDS == part)
        seen, out = np.flatnonzero((fold != part) & ~left_out), np.flatnonzero(fold == part)
        w = regression([x[i] for i in seen], y[seen], number, classes, rounds)
        z.append(logits(w, [x[i] for i in out]))
        truth.append(np.where(np.isin(y[out], y[seen]), y[out], 0))
    z, truth = np.concatenate(z), np.concatenate(truth)
    loss = lambda t: -float(np.log(softmax(z, t)[np.arange(len(truth)), truth] + 1e-12).mean())
    temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 5.0, 7.0), key=loss)
    p = softmax(z, temperature)
    guess, sure = p.argmax(axis=1), p.max(axis=1)
    errors = lambda t: int((np.where(sure >= t, guess, 0) != truth).sum())
    threshold = min((0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), key=lambda t: (errors(t), abs(t - 0.5)))
    bins = np.minimum((sure * 10).astype(int), 9)
    gaps = [abs(sure[bins == b].mean() - (guess[bins == b] == truth[bins == b]).mean()) * (bins == b).mean() for b in range(10) if (bins == b).any()]
    return Classifier(families, vocabulary, regression(x, y, number, classes, rounds), temperature, threshold, notices, float(sum(gaps)))


def license_scan(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Confirmed licences of each document: number of lines that are not blank, of notices, families, the surest one.

    A notice is within a line or runs over line breaks, up to a line without words. The classifier is fitted on the driver to the templates and to paragraphs of at most `sample`
    documents (those of least hash); every line and every span across line breaks of every whole text is then scored where it is, without a shuffle.

    A text of any length is scanned line by line. A null or empty text has no paragraphs; documents without a licence have an empty list and nulls; of equally sure
    licences the first in the text counts; equal rows get equal results; an empty table gives an empty result (the
    classifier is then fitted to templates alone); only doc_id and text are read.
    """
    few = few_rows(docs.select("doc_id", F.col(text).alias("t")), F.col("doc_id"), sample)
    paragraphs = [p for r in few for p in (r["t"] or "").split("\n") if p.strip()]
    shared = docs.sparkSession.sparkContext.broadcast(fit(paragraphs[:NEGATIVES]))

    def scan(batch: pa.RecordBatch) -> Iterator[dict]:
        classifier = shared.value
        out: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(", ")}
        for doc, body in zip(batch.column("doc_id").to_pylist(), batch.column(text).to_pylist(), strict=True):
            lines, found = classifier.scan(body or "")
            best = max(found, key=lambda x: (x[2], -x[0])) if found else (None, None, None, None)
            for c, x in zip(out, (doc, lines, len(found), sorted({x[1] for x in found}), best[1], best[2], best[3], best[0]), strict=True):
                out[c].append(x)
        yield out

    return map_batches(docs.select("doc_id", text), scan, SCHEMA)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan of the documents table with its defaults."""
    return license_scan(documents(spark, sf_dir))
