"""Predictions of op1 and op7 against plain versions of their definitions."""

import math
import zlib
from collections import Counter

import numpy as np

from tessella.llm import language, queries, toxicity
from tests.llm.test_language import brute

SF = "/root/testdata/sf0.001"


def test_language_predictions(spark):
    """Prototypes are sums of the training texts' trigram vectors, and a text takes the highest cosine."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    enc = language.encoder(language.DIMS, language.SEED)
    vectors = {r.doc_id: enc.bundle(r.text) for r in rows}
    for r in rows[:5]:
        assert np.array_equal(vectors[r.doc_id], brute(enc, r.text))
    sums = {}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang is not None and vectors[r.doc_id] is not None:
            sums[r.lang] = sums.get(r.lang, 0) + vectors[r.doc_id]
    for r in queries.op1_language(spark, SF).collect():
        v = vectors[r.doc_id]
        if v is None:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cosines = {k: float(s @ v / np.linalg.norm(s) / np.linalg.norm(v)) for k, s in sums.items()}
        assert abs(cosines[r.lang_pred] - max(cosines.values())) < 1e-9 and abs(r.score - max(0.0, max(cosines.values()))) < 1e-6


def test_toxicity_descent_and_scores():
    """The fitted weights have a lower loss than any small step from them, and scores are the logistic of their sum."""
    rng = np.random.default_rng(4)
    n, m = 60, 8
    rows = [np.flatnonzero(rng.random(m) < 0.4) for _ in range(n)]
    labels = np.array([float(0 in r or rng.random() < 0.1) for r in rows])
    twins = [[np.setdiff1d(r, [1])] if 1 in r else [] for r in rows]
    w, b = toxicity.descend(rows, twins, labels, m, steps=3000)

    def loss(w, b):
        z = [b + sum(w[j] for j in r) for r in rows]
        log = sum(math.log1p(math.exp(-x)) if y else math.log1p(math.exp(x)) for x, y in zip(z, labels)) / n
        apart = [sum(w[j] for j in r) - sum(w[j] for j in t) for r, own in zip(rows, twins) for t in own]
        return log + toxicity.RIDGE / 2 * sum(x * x for x in w) + toxicity.PULL * sum(x * x for x in apart) / len(apart)

    best = loss(w, b)
    for j in range(m):
        for step in (-0.05, 0.05):
            moved = w.copy()
            moved[j] = max(0.0, moved[j] + step)
            assert loss(moved, b) >= best - 1e-6
    assert min(loss(w, b - 0.05), loss(w, b + 0.05)) >= best - 1e-6
    model = toxicity.Model({"abc": 1.5, "^abcd": 0.75}, -1.0)
    for text, z in (("abc abcdef", 1.25), ("ABC abc", 0.5), ("abcd", -1.0), (None, -1.0), ("abcde x abcdef", -0.25)):
        assert abs(model.score(text) - 1 / (1 + math.exp(-z))) < 1e-12


def test_repeated_ids_count_once(spark):
    """A key that stands often in labels or documents does not multiply the training rows."""
    docs = [(i, f"word{i % 7} {'scum' if i % 2 else 'calm'}") for i in range(40)]
    labels = [(i, i % 2) for i in range(40)]
    frame = lambda rows, columns: spark.createDataFrame(rows, columns)
    once = toxicity.fit(frame(docs, "doc_id long, text string"), frame(labels, "doc_id long, toxic int"))
    often = toxicity.fit(frame(docs + docs[:1] * 500, "doc_id long, text string"), frame(labels + labels[:1] * 500, "doc_id long, toxic int"))
    assert once.weights == often.weights and once.bias == often.bias and Counter(once.weights)
