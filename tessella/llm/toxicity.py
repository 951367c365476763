"""Toxicity: a counterfactual-regularised classifier over words and word beginnings.

Method: logistic regression on the presence of words and of their first 4 to 8 letters (of longer words only). For every labelled
text that names a group of people, two counterfactual twins swap each identity term, one for the next of its kind
and one for the kind's neutral word; the loss adds ``pull`` times the squared differences of the log-odds. So a group's name cannot carry
weight by itself, however often it stands in toxic training texts, and neutral mentions stay low.
Weights are not negative: a text becomes toxic by what it says, and does not become clean by its length.

Features are those whose presence depends on the label by a G-test over the training rows, corrected
for the number of features tried (at most ``MAX_FEATURES``, the strongest). Training rows are a bounded sample: labelled
rows whose id's hash is below max_rows / rows, about ``max_rows`` of them, all if there are fewer. The sample's ids
are broadcast (bounded by the same parameter), its feature counts are aggregated by Spark, and only selected features of sampled
rows reach the driver. Scoring is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import map_rows, slices
from tessella.session import checkpoint

MAX_ROWS, MAX_FEATURES, THRESHOLD, SEED = 20_000, 1000, 0.7, 17
PULL, RIDGE, STEPS = 10.0, 1e-4, 400

#: Identity terms by kind and language, after the neutral word of the kind.
IDENTITY_TERMS = """
people: women men
person: woman man
children: girls boys
believer: muslim christian jewish hindu buddhist atheist
believers: muslims christians jews hindus buddhists atheists
human: black white asian latino african european
human: gay straight lesbian bisexual transgender
human: american mexican chinese indian german french
people: immigrants locals refugees citizens
human: disabled deaf blind elderly young
menschen: frauen männer
gläubige: muslime christen juden
menschen: schwarze weiße
menschen: schwule lesben
menschen: flüchtlinge einheimische
personnes: femmes hommes
croyants: musulmans chrétiens juifs
personnes: noirs blancs
personas: mujeres hombres
creyentes: musulmanes cristianos judíos
personas: negros blancos
"""
#: Each term's counterfactuals: the next of its kind, and the kind's neutral word.
SWAPS = {
    a: (b, neutral)
    for neutral, terms in (line.split(": ") for line in IDENTITY_TERMS.strip().split("\n"))
    for a, b in zip(terms.split(), terms.split()[1:] + terms.split()[:1])
}
_WORD = re.compile(r"[^\W\d_]+")
_STEMS = (4, 5, 6, 7, 8)


def words(text: str | None) -> set[str]:
    """The distinct words of the whole text, in lower case."""
    return set(_WORD.findall((text or "").lower()))


def features(found: set[str]) -> set[str]:
    """The words and, marked by ^, their beginnings."""
    out = set(found)
    for n in _STEMS:
        out.update(["^" + w[:n] for w in found if len(w) > n])
    return out


def swapped(found: set[str], which: int = 0) -> set[str] | None:
    """The words of a counterfactual twin, each identity term swapped (see SWAPS); None if there is no such term."""
    if SWAPS.keys().isdisjoint(found):
        return None
    return {SWAPS[w][which] if w in SWAPS else w for w in found}


class Model:
    """Weights by feature; ``score`` gives a text's toxicity from 0 to 1."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.known = frozenset(f for f in weights if f[0] != "^")
        stems = {len(f) - 1 for f in weights if f[0] == "^"}
        self.stems = {n: {f[1:]: f for f in weights if f[0] == "^" and len(f) == n + 1} for n in stems}

    def present(self, text: str | None) -> list[str]:
        """The features of the text that have a weight."""
        found = words(text) if self.weights else set()
        out = [*(self.known & found)]
        for n, stems in self.stems.items():
            out += [stems[x] for x in stems.keys() & {w[:n] for w in found if len(w) > n}]
        return out

    def score(self, text: str | None) -> float:
        z = self.bias + math.fsum(self.weights[f] for f in self.present(text))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def descend(rows: list[np.ndarray], twins: list[list[np.ndarray]], labels: np.ndarray, n_features: int,
            pull: float = PULL, ridge: float = RIDGE, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise log loss + ridge + pull x the mean squared log-odds change of the twins."""
    n = len(rows)
    at = np.repeat(np.arange(n), [len(r) for r in rows])
    cols = np.concatenate(rows) if len(at) else np.zeros(0, np.int64)
    pairs = [(i, t) for i, own in enumerate(twins) for t in own]
    d_at, d_cols, d_sign = [], [], []
    for k, (i, twin) in enumerate(pairs):
        for side, sign in ((rows[i], 1.0), (twin, -1.0)):
            d_at += [k] * len(side)
            d_cols += side.tolist()
            d_sign += [sign] * len(side)
    d_at, d_cols, d_sign = np.array(d_at, np.int64), np.array(d_cols, np.int64), np.array(d_sign)
    w, base = np.zeros(n_features), float(np.clip(labels.mean(), 1e-6, 1 - 1e-6))
    b = math.log(base / (1 - base))
    m1, m2 = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, steps + 1):
        z = b + np.bincount(at, w[cols], n)
        miss = (1 / (1 + np.exp(-z)) - labels) / n
        grad = np.bincount(cols, miss[at], n_features) + ridge * w
        if len(pairs):
            delta = np.bincount(d_at, d_sign * w[d_cols], len(pairs))
            grad += 2 * pull / len(pairs) * np.bincount(d_cols, d_sign * delta[d_at], n_features)
        full = np.append(grad, miss.sum())
        m1, m2 = 0.9 * m1 + 0.1 * full, 0.99 * m2 + 0.01 * full * full
        move = 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
        w, b = np.maximum(0.0, w - move[:-1]), b - move[-1]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        where: Column | None = None, max_rows: int = MAX_ROWS, pull: float = PULL) -> Model:
    """A model from the texts of ``docs`` that ``labels`` (key, label 0 or 1) marks and ``where``, a test of the key, lets in.

    Rows with a null key, label or text are left out. A key counts once: with label 1 if any of its labels is 1, with the text
    of least hash if it has several. Without rows of both labels the score is the share of label 1.
    """
    marked = (labels if where is None else labels.where(where)).select(
        F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y")
    ).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    n = marked.count()
    if n > max_rows:
        draw = F.xxhash64("doc_id", F.lit(SEED)).bitwiseAND(F.lit(2**63 - 1))
        marked = marked.where(draw <= F.lit(int(max_rows / n * 2**63)))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.where("text is not null").join(F.broadcast(marked), "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")
    rows = checkpoint(rows.groupBy("doc_id").agg(one, F.first("y").alias("y")).select("one.text", "y"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally = (Counter(), Counter())
            size = [0, 0]
            for part in slices(batch):
                for t, y in zip(*(c.to_pylist() for c in part.columns)):
                    size[y] += 1
                    tally[y].update(features(words(t)))
            names = sorted(tally[0].keys() | tally[1].keys())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None, *names], pa.string()),
                    pa.array([size[0], *(tally[0][x] for x in names)], pa.int64()),
                    pa.array([size[1], *(tally[1][x] for x in names)], pa.int64()),
                ],
                ["feature", "n0", "n1"],
            )

    sums = rows.mapInArrow(count, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    sums = sums.where("feature is null or n0 + n1 > 2").persist()
    try:
        total = sums.where("feature is null").first()
        n0, n1 = (total["n0"], total["n1"]) if total else (0, 0)
        if not n0 or not n1:
            return Model({}, 60.0 if n1 else -60.0)
        tried = sums.where("feature is not null")
        share, g = n1 / (n0 + n1), F.lit(0.0)
        for seen, size, p in (("n1", n1, share), ("n0", n0, 1 - share)):
            for got, all_ in ((F.col(seen), F.col("n0") + F.col("n1")), (size - F.col(seen), n0 + n1 - F.col("n0") - F.col("n1"))):
                g = g + F.when(got > 0, 2 * got * F.log(got / (all_ * p))).otherwise(0.0)
        least = 2 * math.log(max(1, tried.count()) / 0.05)
        strong = tried.select("feature", g.alias("g")).where((F.col("g") > least) & (F.col("n1") * n0 > F.col("n0") * n1))
        chosen = [r["feature"] for r in strong.orderBy(F.desc("g"), "feature").limit(MAX_FEATURES).collect()]
    finally:
        sums.unpersist()
    if not chosen:
        return Model({}, math.log(n1 / n0))
    at = {f: i for i, f in enumerate(chosen)}

    def known(found: set[str]) -> list[int]:
        return sorted(at[f] for f in features(found) if f in at)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            own, twins = [], []
            for t in batch.column(0).to_pylist():
                found = words(t)
                others = [x for which in (0, 1) if (x := swapped(found, which)) is not None]
                own.append(known(found))
                twins.append([known(x) for x in others])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(own, kind), pa.array(twins, pa.list_(kind)), batch.column(1)], ["own", "twins", "y"])

    held = rows.mapInArrow(present, "own array<int>, twins array<array<int>>, y int").toArrow().to_pydict()
    order = sorted(range(len(held["y"])), key=lambda i: (held["own"][i], held["twins"][i], held["y"][i]))
    arrays = lambda x: np.array(x, np.int64)
    w, b = descend(
        [arrays(held["own"][i]) for i in order], [[arrays(t) for t in held["twins"][i]] for i in order],
        np.array([held["y"][i] for i in order], float), len(chosen), pull,
    )
    return Model({f: float(x) for f, x in zip(chosen, w) if x > 0}, b)


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score double, predicted int`` for every row of ``df``.

    Null and empty texts score as texts without features. Repeated rows and null keys stay; an empty table gives
    an empty table; other columns are not read.
    """
    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def make():
        def row(i: int | None, t: str | None) -> tuple:
            s = model.score(t)
            return i, s, int(s >= threshold)

        return row

    return map_rows(rows, make, "doc_id long, score double, predicted int")
