"""Language model and licence classifier: exact bases, gradients, windows, held-out quality."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from sparrowdeck.llm import licenses as li
from sparrowdeck.llm import lm_scoring as lm
from sparrowdeck.llm.tokens import WordEncoder


def small_model(seed=0):
    r = np.random.default_rng(seed)
    classes = lm.Classes.of(r.integers(0, 1000, lm.VOCABULARY))
    within = r.normal(size=(lm.SEEN + 1, lm.OWN)).astype(np.float32) - 5
    return lm.Model(classes, lm.Attention(r.normal(size=(lm.SEEN + 1, lm.CLASSES))), within, -np.ones(lm.VOCABULARY))


@pytest.mark.parametrize("n", [1, 2, 25, 26, 27, 32, 33, 58, 59, 200])
def test_each_id_is_scored_once(n):
    doc, start, first, places = lm.windows(np.array([n, 40]))
    mine = doc == 0
    got = [s + i for s, f, p in zip(start[mine], first[mine], places[mine], strict=True) for i in range(f, p)]
    assert got == list(range(n))


def test_batched_score_is_the_plain_one():
    model = small_model()
    r = np.random.default_rng(1)
    ids = [r.integers(0, lm.VOCABULARY, n) for n in (1, 5, 32, 33, 100, 7, 26)]
    a, c = model.attention, model.classes
    want = []
    for x in ids:
        total = 0.0
        _, start, first, places = lm.windows(np.array([len(x)]))
        for s, f, p in zip(start, first, places, strict=True):
            before = np.array([[lm.SEEN if s + i == 0 else c.seen[x[s + i - 1]] for i in range(p)]])
            before = np.pad(before, ((0, 0), (0, lm.WINDOW - p)))
            logits = a.forward(before)[0][0, :p].astype(np.float64)
            logs = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
            for i in range(f, p):
                total += logs[i, c.predicted[x[s + i]]] + model.within[before[0, i], c.own[x[s + i]]] + model.last[x[s + i]]
        want.append(total)
    assert np.allclose(model.score(ids, at_once=3), want, rtol=1e-4)


def test_gradients_against_differences():
    a = small_model(2).attention
    a.p = {k: v.astype(np.float64) for k, v in a.p.items()}
    r = np.random.default_rng(3)
    before, after = r.integers(0, lm.SEEN, (3, lm.WINDOW)), r.integers(0, lm.CLASSES, (3, lm.WINDOW))
    weight = np.ones((3, lm.WINDOW))
    _, g = a.gradients(before, after, weight)
    for k in a.NAMES:
        at = (before[0, 3], 1) if k == "embed" else (2, 1)
        old, step, losses = a.p[k][at], 1e-4, []
        for d in (step, -step):
            a.p[k][at] = old + d
            losses.append(a.gradients(before, after, weight)[0])
        a.p[k][at] = old
        assert (losses[0] - losses[1]) / (2 * step) == pytest.approx(g[k][at], rel=1e-3, abs=1e-7)


def plain_gradients(a, before, after, weight):
    """The model's gradients step by step in 64 bits, every place of every window alike."""
    p = {k: v.astype(np.float64) for k, v in a.p.items()}
    x = p["embed"][before] + p["place"]
    q, k, v = x @ p["wq"], x @ p["wk"], x @ p["wv"]
    s = q @ k.transpose(0, 2, 1) / math.sqrt(lm.WIDTH) + a.mask
    s = np.exp(s - s.max(axis=2, keepdims=True))
    s /= s.sum(axis=2, keepdims=True)
    h = x + s @ v
    d = h @ p["out"] + a.prior[before]
    d = np.exp(d - d.max(axis=2, keepdims=True))
    d = (d / d.sum(axis=2, keepdims=True) - np.eye(lm.CLASSES)[after]) * (weight / weight.sum())[..., None]
    dh = d @ p["out"].T
    ds = dh @ v.transpose(0, 2, 1)
    ds = s * (ds - (ds * s).sum(axis=2, keepdims=True)) / math.sqrt(lm.WIDTH)
    dq, dk, dv = ds @ k, ds.transpose(0, 2, 1) @ q, s.transpose(0, 2, 1) @ dh
    dx = dh + dq @ p["wq"].T + dk @ p["wk"].T + dv @ p["wv"].T
    g = {w: np.einsum("abc,abd->cd", x, y) for w, y in (("wq", dq), ("wk", dk), ("wv", dv))}
    g |= {"out": np.einsum("abc,abd->cd", h, d), "place": dx.sum(axis=0), "embed": np.zeros_like(p["embed"])}
    np.add.at(g["embed"], before, dx)
    return g


@pytest.mark.parametrize("scale", [1, 60])
def test_gradients_against_the_plain_ones(scale):
    """Also where a sum of exponentials would overflow without its maximum."""
    a, r = small_model(4).attention, np.random.default_rng(5)
    a.p["wq"] *= scale
    a.p["out"] *= scale**2
    before, after, weight = lm.training_windows([r.integers(0, lm.VOCABULARY, n) for n in (1, 300, 32, 40)], small_model().classes)
    _, got = a.gradients(before, after.astype(np.int64), weight)
    for k, want in plain_gradients(a, before, after, weight).items():
        assert np.abs(got[k] - want).max() < 1e-4 * np.abs(want).max()


def test_gradients_leave_out_what_nothing_asks(monkeypatch):
    """Of a window only the places that it scores need classes and weights of what they attend to."""
    a, r, met, exp = small_model(6).attention, np.random.default_rng(7), [], np.exp
    before, after, weight = lm.training_windows([r.integers(0, lm.VOCABULARY, 1000)], small_model().classes)
    monkeypatch.setattr(np, "exp", lambda x, **more: met.append(x.size) or exp(x, **more))
    a.gradients(before[1:], after[1:].astype(np.int64), weight[1:])
    assert sum(met) <= lm.STRIDE * (lm.WINDOW + lm.CLASSES) * len(before[1:])


def test_probabilities_add_up(spark, sf):
    docs = lm.documents(spark, sf)
    model, _, _ = lm.fitted(docs, public_tokenizers.path("word_bpe_49k.json"), "test", sample=40, steps=20)
    ids = [np.array([320, k]) for k in range(lm.VOCABULARY)]
    two = np.concatenate([model.score(ids[k : k + 5000]) for k in range(0, len(ids), 5000)])
    one = model.score([np.array([320])])[0]
    assert np.exp(two - one).sum() == pytest.approx(1, abs=1e-3)


def test_scores_against_brute_force(spark, sf):
    got = {r["doc_id"]: r for r in lm.op2_lm_scoring(spark, sf).collect()}
    rows = {r[0]: r[1] for r in lm.documents(spark, sf).select("doc_id", "text").collect()}
    tokens = {d: [*re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), None] for d, t in rows.items()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in rows}
    counts = Counter(w for d, t in tokens.items() if not held[d] for w in t)
    n, v = sum(counts.values()), len(counts)
    for d, t in tokens.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(t), sum(w in counts for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
    assert all(r["score"] < 0 for r in got.values())


def test_model_beats_the_base_on_held_out_documents(spark):
    out = [r for r in lm.op2_lm_scoring(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_scores_with_a_small_dictionary(spark, sf):
    docs = lm.documents(spark, sf)
    a = {r["doc_id"]: r for r in lm.lm_scores(docs, sample=20, steps=2).collect()}
    b = {r["doc_id"]: r for r in lm.lm_scores(docs, sample=20, steps=2, frequent=5).collect()}
    assert all(a[d]["n_known"] == b[d]["n_known"] and a[d]["base_score"] == pytest.approx(b[d]["base_score"]) for d in a)


def test_attention_helps(spark, sf):
    model, _, _ = lm.fitted(lm.documents(spark, sf), public_tokenizers.path("word_bpe_49k.json"), "test")
    docs = [r for r in lm.documents(spark, sf).select("doc_id", "text").collect() if lm.held_out(r[0])]
    flat, ends = lm._ids(WordEncoder(public_tokenizers.path("word_bpe_49k.json")), lm.cut_words(lm._lower(pa.array([r[1] or "" for r in docs]))))
    ids = np.split(flat.astype(np.int64), ends[:-1])
    with_it = model.score(ids).sum()
    model.attention.p["out"][:] = 0
    assert with_it > model.score(ids).sum()


def test_lm_edges(spark):
    rows = [(1, None), (2, ""), (3, "A b"), (3, "A b"), (None, "c"), (4, "long " * 30_000)]
    got = lm.lm_scores(spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double"), steps=2).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 1, 2, 3, 3, 30_001]
    assert lm.lm_scores(spark.createDataFrame([], "doc_id long, text string"), steps=2).count() == 0


def test_all_training_documents_teach(spark):
    rows = [(i, f"word{i % 7} of text {i} " * 60) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, _, encoded = lm.fitted(docs, public_tokenizers.path("word_bpe_49k.json"), "test", sample=1, steps=2)
    ids = [np.frombuffer(r["ids"], "<u2") for r in encoded.where("NOT held_out").collect()]
    counts = np.bincount(np.concatenate(ids), minlength=lm.VOCABULARY)
    assert (model.classes.predicted == lm.Classes.of(counts).predicted).all()  # ranked by all, not by the one
    old = {k: v.copy() for k, v in model.attention.p.items()}
    few, many = (lm.taught(model.attention, d.where("NOT held_out"), model.classes, every=4) for d in (encoded, encoded.union(encoded)))
    assert few > 0 and many == pytest.approx(2 * few, rel=0.1) and any((model.attention.p[k] != old[k]).any() for k in old)


def test_every_training_window_teaches(spark, monkeypatch):
    """Each window of each training document reaches the weights, on the driver and by tasks."""
    rows = [(i, f"word{i % 7} of text {i} " * 60) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    taught, met, fit = lm.taught, [], lm.Attention.fit

    def counting(attention, encoded, *rest, **more):
        met.append(("tasks", taught(attention, encoded, *rest, **more), lm.window_count(encoded)[1]))

    def watching(self, before, after, weight, **more):
        seen = []
        plain = self.gradients
        self.gradients = lambda b, a, w: seen.append((b, a, w)) or plain(b, a, w)
        fit(self, before, after, weight, **more)
        got = {x.tobytes() for b, _, _ in seen for x in b}
        met.append(("driver", sum(x.tobytes() in got for x in before), len(before)))
        del self.gradients

    monkeypatch.setattr(lm, "taught", counting)
    monkeypatch.setattr(lm.Attention, "fit", watching)
    for sample in (1, 100):
        _, _, encoded = lm.fitted(docs, public_tokenizers.path("word_bpe_49k.json"), "test", sample=sample, steps=40)
        lengths = np.array([len(r["ids"]) // 2 for r in encoded.where("NOT held_out").collect()])
        assert met[-1][1] == met[-1][2] == len(lm.windows(lengths)[0])
    assert [x[0] for x in met] == ["tasks", "driver"]


# ---- licences


@pytest.fixture(scope="module")
def classifier():
    plain = [f"the {a} of the {b} is released in version {k} under a new name" for k, (a, b) in enumerate([("cat", "house"), ("permission", "king"), ("work", "mill"), ("license", "driver")] * 20)]
    return li.fit(plain)


def test_templates_are_recognised(classifier):
    for family, notices in li.TEMPLATES.items():
        for t in notices:
            hit = classifier.judge(t)
            assert hit and hit[0] == family and hit[2] == 1.0
            assert classifier.judge(f"Copyright 2024 Someone. {t}, see the file.")[0] == family


def test_other_text_is_unknown(classifier):
    for t in ("", "the general public is free to copy", "a license to drive in version 3", "software is released under stress", "The MIT campus and the public domain of the king", "x" * 5000, "the of and " * 2000):
        assert classifier.judge(t) is None


def test_held_out_accuracy(classifier):
    import random

    r = random.Random(99)
    filler = "some words that stand around a notice in any text of this kind".split()
    right = total = 0
    for family, notices in li.TEMPLATES.items():
        for t in notices:
            for v in li.variants(li.words_of(t), filler, r)[:15]:
                hit = classifier.judge(" ".join(v))
                whole = classifier.similarity(v, family) >= li.CONFIRMED
                right += whole and bool(hit and hit[0] == family)
                total += whole
                assert not hit or hit[0] == family or hit[0][:3] == family[:3] or {hit[0], family} <= {"GPL", "LGPL", "AGPL"}
    assert right > 0.9 * total > 0.5 * 480


def test_scan_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    lines = {"This work is licensed under the GNU General Public License, version 3.": "GPL", "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    want = {d: sorted({f for k, f in lines.items() if k in (t or "").split("\n")}) for d, t in docs.collect()}
    assert {r["doc_id"]: r["families"] for r in li.op3_license_scan(spark, sf).collect()} == want
    assert any(want.values())


def test_licence_edges(spark):
    rows = [(1, None), (2, ""), (None, "Released under the MIT License."), (3, "a\n\nReleased under the ISC License\nReleased under the MIT License"), (3, "a"), (4, "word " * 30_000)]
    got = li.license_scan(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, families string")).collect()
    assert sorted((str(r["doc_id"]), r["n_paragraphs"], r["families"]) for r in got) == [("1", 0, []), ("2", 0, []), ("3", 1, []), ("3", 3, ["ISC", "MIT"]), ("4", 1, []), ("None", 1, ["MIT"])]
    assert li.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


WRAPPED = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software",
    "BSD": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
    "GPL": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "LGPL": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
    "AGPL": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as\npublished by the Free Software Foundation, either version 3 of the\nLicense, or (at your option) any later version.",
}


@pytest.mark.parametrize("family", WRAPPED)
def test_wrapped_notices(classifier, family):
    for prefix in ("", " * ", "# "):
        body = "\n".join(prefix + x for x in f"Some file of a work\n\n{WRAPPED[family]}\n\nand other lines\nof text".split("\n"))
        assert {x[1] for x in classifier.scan(body)[1]} == {family}


def test_wrapped_notice_in_a_scan(spark):
    rows = [(1, f"a b\n{WRAPPED['MIT']}\nc d"), (2, WRAPPED["MIT"].replace("copy\nof", "copy\n\nof")), (3, "x " * 500 + WRAPPED["BSD"] + " y" * 500)]
    got = {r["doc_id"]: (r["families"], r["n_licensed"], r["first_paragraph"]) for r in li.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (["MIT"], 1, 1), 2: ([], 0, None), 3: (["BSD"], 1, 0)}


def test_denials_are_no_licence():
    c = li.fit([])
    for t in ("This work is not licensed under the MIT License", "This code is no longer released under the GNU GPL version 2 or later", "It was never released under the BSD License"):
        assert c.judge(t) is None, t
    assert c.judge("This work is licensed under the MIT License")[0] == "MIT" and c.judge("This is not a toy. Released under the BSD License")[0] == "BSD"


def test_calibration_is_measured_on_notices_left_out():
    c = li.fit([])
    assert 0 <= c.reliability < 0.15 and 0.3 <= c.threshold <= 0.9


def test_sparse_regression_is_the_dense_one():
    r = np.random.default_rng(4)
    rows = [sorted(set(r.integers(0, 12, r.integers(0, 6)).tolist())) for _ in range(50)]
    y = r.integers(0, 3, 50)
    x = np.zeros((50, 13))
    for i, a in enumerate(rows):
        x[i, [*a, 12]] = 1
    w, m, v = (np.zeros((13, 3)) for _ in range(3))
    for t in range(1, 21):
        p = np.exp(x @ w)
        g = x.T @ (p / p.sum(axis=1, keepdims=True) - np.eye(3)[y]) / 50 + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    assert np.allclose(li.regression(rows, y, 12, 3, 20), w, atol=2e-2)  # single precision against double


def plain_scan(c, body):
    """Families of the notices in a text: every line, and every span of a line's end, whole lines and a line's start."""
    found, runs = [], [[]]
    for line in body.split("\n"):
        w = li.words_of(line)
        runs = [*runs, []] if not w else [*runs[:-1], [*runs[-1], w]]
    for run in runs:
        found += [h[0] for w in run if (h := c.judge_words(w))]
        spans = []
        for i in range(len(run)):
            for j in range(i + 1, len(run)):
                if sum(map(len, run[i + 1 : j])) > li.REACH:
                    break
                span = [*run[i][-li.REACH :], *(x for w in run[i + 1 : j] for x in w), *run[j][: li.REACH]]
                h = c.judge_words(span)
                if h and h[2] > max(c.similarity(w, h[0]) for w in run[i : j + 1]):
                    spans.append((-h[2], len(span), i, j, h[0]))
        taken = set()
        for _, _, i, j, family in sorted(spans):
            if not taken & set(range(i, j)):
                taken |= set(range(i, j))
                found.append(family)
    return sorted(found)


def test_scan_against_the_plain_one(spark, sf):
    rows = [(r[0], r[1]) for r in lm.documents(spark, sf).select("doc_id", "text").collect()]
    wrapped = [w for n in li.TEMPLATES.values() for t in n for w in [t.split()]]
    rows += [(10_000 + k, "\n".join([*(["some words before"] * (k % 3)), " ".join(w[: len(w) // 2]), "# " + " ".join(w[len(w) // 2 :]), "more words"])) for k, w in enumerate(wrapped)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few = li.few_rows(docs.select("doc_id", li.F.col("text").alias("t")), li.F.col("doc_id"), li.SAMPLE)
    c = li.fit([p for r in few for p in (r["t"] or "").split("\n") if p.strip()][: li.NEGATIVES])
    want = {d: plain_scan(c, t or "") for d, t in rows}
    got = {r["doc_id"]: (r["families"], r["n_licensed"]) for r in li.license_scan(docs).collect()}
    assert got == {d: (sorted(set(x)), len(x)) for d, x in want.items()}
    assert sum(bool(want[10_000 + k]) for k in range(len(wrapped))) >= 0.8 * len(wrapped)
