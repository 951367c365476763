"""Language identification with hyperdimensional profiles.

Method: every letter has a fixed random vector of +1 and -1: a to z one each, all other letters one of
LETTERS - 27 further ones by code point, so that the table of bound pairs stays small. A trigram's vector binds (multiplies) its letters'
vectors, each permuted (rotated) by its place; a text's vector bundles (adds) those of all its trigrams, and a
language's prototype bundles the vectors of its training texts. A text takes the language whose prototype has the
highest cosine with its own vector. Words are runs of letters in lower case, other characters make one gap.

The prototypes are fitted on a bounded sample: per language about ``per_lang`` rows, those with the lowest hash of
their id. Sums are of integers, so the prototypes do not depend on the order of rows. They are
collected as languages x dims numbers; more than ``MAX_LANGS`` languages are refused. Prediction is one pass
without a shuffle, and counts the trigrams of whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import map_rows, slices

DIMS, SEED, PER_LANG, MAX_LANGS = 1024, 7, 3000, 2000
LETTERS, BITS = 128, 7
SCHEMA = "lang_pred string, score double"


class Encoder:
    """Texts to bundled trigram vectors."""

    def __init__(self, dims: int = DIMS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.letters = rng.integers(0, 2, (LETTERS, dims), dtype=np.int8) * 2 - 1
        first, second = np.roll(self.letters, 2, axis=1), np.roll(self.letters, 1, axis=1)
        self.pairs = (first[:, None, :] * second[None, :, :]).reshape(LETTERS * LETTERS, dims)
        self.slots: np.ndarray = np.fromiter(map(_slot, range(0x3000)), np.uint8, 0x3000)

    def places(self, text: str) -> np.ndarray:
        """The text's letters as slots, with one 0 for each gap and at both ends."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        if points.size and int(points.max()) >= len(self.slots):
            found = self.slots[np.minimum(points, len(self.slots) - 1)]
            for at in np.flatnonzero(points >= len(self.slots)):
                found[at] = _slot(int(points[at]))
        else:
            found = self.slots[points]
        padded = np.zeros(len(found) + 2, np.int32)
        padded[1:-1] = found
        return padded[np.append(True, (padded[1:] != 0) | (padded[:-1] != 0))]

    def bundle(self, text: str | None) -> np.ndarray | None:
        """The text's vector, or None if it has no letter."""
        s = self.places(text or "")
        if len(s) < 3:
            return None
        grams, counts = np.unique(s[:-2] << 2 * BITS | s[1:-1] << BITS | s[2:], return_counts=True)
        out = np.zeros(self.letters.shape[1], np.float64)
        for at in range(0, len(grams), 1024):
            part = grams[at : at + 1024]
            bound = self.pairs[part >> BITS] * self.letters[part & (LETTERS - 1)]
            out += counts[at : at + 1024].astype(np.float32) @ bound.astype(np.float32)
        return out


def _slot(point: int) -> int:
    """0 for what is no letter, 1 to 26 for a to z, and one of the other slots for any other letter."""
    if 97 <= point <= 122:
        return point - 96
    return 27 + point % (LETTERS - 27) if chr(point).isalpha() else 0


_ENCODERS: dict[tuple[int, int], Encoder] = {}


def encoder(dims: int, seed: int) -> Encoder:
    if (dims, seed) not in _ENCODERS:
        _ENCODERS[dims, seed] = Encoder(dims, seed)
    return _ENCODERS[dims, seed]


class Model:
    """Prototypes by language, in the languages' order; ``predict`` gives a language and a score from 0 to 1."""

    def __init__(self, langs: list[str], prototypes: np.ndarray, dims: int, seed: int):
        self.langs, self.dims, self.seed = langs, dims, seed
        norms = np.linalg.norm(prototypes, axis=1, keepdims=True)
        self.prototypes = prototypes / np.where(norms == 0, 1, norms)

    def predict(self, text: str | None) -> tuple[str, float]:
        """``und`` and 0 without a letter or without prototypes; equal cosines go to the first language."""
        vector = encoder(self.dims, self.seed).bundle(text) if self.langs else None
        if vector is None:
            return "und", 0.0
        norm = np.linalg.norm(vector)
        cosines = self.prototypes @ vector / (norm or 1.0)
        best = int(np.argmax(cosines))
        return self.langs[best], float(min(1.0, max(0.0, cosines[best])))


def fit(df: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", where: Column | None = None,
        dims: int = DIMS, seed: int = SEED, per_lang: int = PER_LANG) -> Model:
    """A model from the rows of ``df`` (those that pass ``where``) with a language and a text.

    Of each language, the rows whose key's hash is below per_lang / its rows are used: about ``per_lang`` of them,
    all if it has fewer. Rows with null language or text are left out; with no rows the model knows no language.
    """
    rows = df if where is None else df.where(where)
    rows = rows.select(
        F.col(f"`{lang}`").cast("string").alias("lang"),
        F.col(f"`{text}`").cast("string").alias("text"),
        F.xxhash64(F.col(f"`{key}`").cast("string"), F.lit(seed)).alias("draw"),
    ).where("lang is not null")
    counts = rows.groupBy("lang").count().limit(MAX_LANGS + 1).collect()
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not counts:
        return Model([], np.zeros((0, dims)), dims, seed)
    share = {r["lang"]: min(1.0, per_lang / r["count"]) for r in counts}
    limits = F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, int(v * 2**63) if v < 1 else 2**63 - 1)])
    drawn = rows.where((F.col("draw").bitwiseAND(F.lit(2**63 - 1))) <= limits[F.col("lang")]).where("text is not null")

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in (part for whole in batches for part in slices(whole)):
            for name, text_, _ in zip(*(c.to_pylist() for c in batch.columns)):
                vector = encoder(dims, seed).bundle(text_)
                if vector is not None:
                    sums[name] = sums.get(name, 0) + vector
        for name, vector in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * dims), pa.array(range(dims), pa.int32()), pa.array(vector.astype(np.int64))],
                ["lang", "dim", "n"],
            )

    parts = drawn.mapInArrow(bundles, "lang string, dim int, n long").groupBy("lang", "dim").agg(F.sum("n").alias("n"))
    langs = sorted(share)
    at = {name: i for i, name in enumerate(langs)}
    prototypes = np.zeros((len(langs), dims))
    for r in parts.collect():
        prototypes[at[r["lang"]], r["dim"]] = r["n"]
    known = np.flatnonzero(np.abs(prototypes).sum(1))
    return Model([langs[i] for i in known], prototypes[known], dims, seed)


def predictor(model: Model) -> Callable[[], Callable[[str | None], tuple[str, float]]]:
    """For a task: makes the function that predicts a text's language."""
    return lambda: model.predict


def identify(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the columns of SCHEMA for every row of ``df``.

    Null, empty and letterless texts are ``und`` with score 0. Repeated rows and null keys stay; an empty table
    gives an empty table; other columns are not read.
    """
    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return map_rows(rows, lambda: lambda i, t: (i, *model.predict(t)), f"doc_id long, {SCHEMA}")
