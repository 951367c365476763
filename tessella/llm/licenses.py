"""License scans with a positional index of rare words.

Method: templates (license notices) are indexed by word: postings of (template, places in it). Inverse document
frequencies of the license words are counted over all documents. A file's license words are looked up in the postings
from the highest IDF down, until each template has its ``RARE`` words; every occurrence at word p
that stands at place r in the template votes for a start p - r, so postings are intersected by relative
position. A start with enough votes is verified: the mandatory key phrases, which tell versions apart, must stand in the file at
their places, and the share of template words at their places must reach ``COVER`` (all of them in notices of up to
``SHORT`` words). The short base phrases go through the same index with one rare word, and must match word for word.

Words: A-Z in lower case, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` (on UTF-8 bytes: letters, digits and all bytes from 128).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import map_rows, slices

RARE, VOTES, COVER = 4, 2, 0.75
#: Notices of up to this many words must stand word for word.
SHORT = 10
#: Phrases whose every place counts, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Label, mandatory key phrases, license notice.
TEMPLATES = """
mit | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
mit | mit license | released under the mit license
mit | mit license | licensed under the mit license
mit | mit license | distributed under the terms of the mit license
apache-2 | apache license version 2 | licensed under the apache license version 2 0
apache-2 | apache license | you may not use this file except in compliance with the license you may obtain a copy of the license at the apache license
apache-2 | www apache org licenses | you may obtain a copy of the license at http www apache org licenses license 2 0
cc-by | cc by 4 | licensed under cc by 4 0
cc-by | creative commons attribution 4 | this work is licensed under a creative commons attribution 4 0 international license
cc-by-sa | cc by sa | licensed under cc by sa 4 0
cc-by-sa | creative commons attribution sharealike | this work is licensed under a creative commons attribution sharealike 4 0 international license
cc-by-nc | cc by nc | licensed under cc by nc 4 0
cc-by-nc | creative commons attribution noncommercial | this work is licensed under a creative commons attribution noncommercial 4 0 international license
cc-by-nd | creative commons attribution noderivatives | this work is licensed under a creative commons attribution noderivatives 4 0 international license
cc0 | cc0 1 0 | to the public domain under cc0 1 0
cc0 | waived all copyright | the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights and has waived all copyright
bsd | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-2 | bsd 2 clause | licensed under the bsd 2 clause license
bsd-3 | bsd 3 clause | licensed under the bsd 3 clause license
bsd-3 | may be used to endorse or promote products | neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
gpl | gnu general public license | under the terms of the gnu general public license
gpl | gnu general public license | released under the gnu general public license
gpl | gnu general public license | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl-2 | gnu general public license + either version 2 of the license | the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3 | gnu general public license + either version 3 of the license | the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl | gnu lesser general public license | under the terms of the gnu lesser general public license
lgpl-2.1 | gnu lesser general public license + either version 2 1 of the license | the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-3 | gnu lesser general public license + either version 3 of the license | the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
agpl-3 | gnu affero general public license + either version 3 of the license | the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
mpl-2 | mozilla public license v 2 0 | this source code form is subject to the terms of the mozilla public license v 2 0
epl-2 | eclipse public license | this program and the accompanying materials are made available under the terms of the eclipse public license 2 0
isc | permission to use copy modify | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
zlib | must not be misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
boost-1 | boost software license | distributed under the boost software license version 1 0
unlicense | unencumbered software released into the public domain | this is free and unencumbered software released into the public domain
proprietary | copyright all rights reserved | copyright all rights reserved
proprietary | unauthorized copying of this file | unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential
"""
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label string, start long, words int, cover double>>"

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class Template:
    def __init__(self, label: str, notice: str, key: str | None = None):
        self.label, self.words, self.exact = label, words_of(notice), key is None
        phrases = [words_of(x) for x in key.split(" + ")] if key else [self.words]
        #: The place and the words of each phrase that must stand.
        self.keys = [(next(i for i in range(len(self.words)) if self.words[i : i + len(x)] == x), x) for x in phrases]


def templates() -> list[Template]:
    """The base phrases, then the notices."""
    lines = [line.split(" | ") for line in TEMPLATES.strip().split("\n")]
    return [*(Template(label, phrase) for phrase, label in BASE.items()), *(Template(a, c, b) for a, b, c in lines)]


class Index:
    """Postings of the license words, and the words in the order of falling IDF; ``scan`` reads a file's words."""

    def __init__(self, frequency: dict[str, int], documents: int):
        self.templates = templates()
        idf = {w: math.log((1 + documents) / (1 + frequency.get(w.decode(), 0))) for t in self.templates for w in t.words}
        self.order = {w: i for i, w in enumerate(sorted(idf, key=lambda w: (-idf[w], w)))}
        #: Word -> the templates that it stands in, each with its places there.
        self.postings: dict[bytes, list[tuple[int, list[int]]]] = {}
        for k, t in enumerate(self.templates):
            for w in set(t.words):
                self.postings.setdefault(w, []).append((k, [i for i, x in enumerate(t.words) if x == w]))
        #: A template cannot match without the rarest word of its key phrases; without any of these words the file is done.
        self.gates = [min((w for _, x in t.keys for w in x), key=self.order.__getitem__) for t in self.templates]
        self.gate = frozenset(self.gates)
        self.wanted = [1 if t.exact else RARE for t in self.templates]

    def votes(self, words: list[bytes], present: set[bytes]) -> dict[int, Counter]:
        """For each template that the file's words can still complete, the starts that its rarest words vote for.

        The file's license words are looked up from the highest IDF down; a template takes the first ``RARE`` of its words
        (a base phrase one), so what a file looks up is bounded by the index and not by its length.
        """
        open_ = {k: self.wanted[k] for k, g in enumerate(self.gates) if g in present and (not self.templates[k].exact or present.issuperset(self.templates[k].words))}
        looked: dict[bytes, list[tuple[int, list[int]]]] = {}
        for w in sorted(present & self.order.keys(), key=self.order.__getitem__):
            for k, places in self.postings[w]:
                if open_.get(k, 0) > 0:
                    open_[k] -= 1
                    looked.setdefault(w, []).append((k, places))
        out: dict[int, Counter] = {k: Counter() for k in open_}
        for p, w in enumerate(words):
            for k, places in looked.get(w, ()):
                out[k].update([p - r for r in places])
        return out

    def scan(self, words: list[bytes]) -> list[tuple[Template, int, float]]:
        """The (template, start, cover) of every verified place, each once."""
        present = set(words)
        if self.gate.isdisjoint(present):
            return []
        out = []
        for k, starts in sorted(self.votes(words, present).items()):
            t = self.templates[k]
            least = 1 if t.exact else min(VOTES, len(t.words))
            whole = t.exact or len(t.words) <= SHORT
            for start in sorted(s for s, n in starts.items() if n >= least):
                if any(start + i < 0 or words[start + i : start + i + len(x)] != x for i, x in t.keys):
                    continue
                cover = sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(t.words)) / len(t.words)
                if cover >= (1.0 if whole else COVER):
                    out.append((t, start, cover))
        return out


def frequencies(df: DataFrame, text: str = "text") -> tuple[dict[str, int], int]:
    """In how many rows of ``df`` each license word occurs, and the number of rows; collects the license words only."""
    vocabulary = frozenset(w for t in templates() for w in t.words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, n = Counter(), 0
        for batch in (part for whole in batches for part in slices(whole)):
            for t in batch.column(0).to_pylist():
                tally.update(vocabulary.intersection(words_of(t)))
                n += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *(w.decode() for w in tally)], pa.string()), pa.array([n, *tally.values()], pa.int64())], ["word", "n"]
        )

    rows = df.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    sums = {r["word"]: r["n"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    documents = sums.pop(None, 0)
    return sums, documents


def digest(index: Index, text: str | None) -> tuple:
    """One file's values in the order of SCHEMA."""
    words = words_of(text)
    found = index.scan(words)
    base = [(t, s) for t, s, _ in found if t.exact]
    starts = [s for _, s in base]
    join = lambda labels: ",".join(sorted(set(labels)))
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None),
        join(t.label for t, _ in base), join(t.label for t, _, _ in found), max((c for *_, c in found), default=0.0),
        [{"label": t.label, "start": s, "words": len(t.words), "cover": c} for t, s, c in found],
    )


def scan_licenses(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the columns of SCHEMA for every row of ``df``; ``matches`` has every verified place.

    Null and empty texts have no words and no labels (empty strings, score 0). Repeated rows and null keys stay;
    an empty table gives an empty table; other columns are not read.
    """
    index = Index(*frequencies(df, text))
    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return map_rows(rows, lambda: lambda i, t: (i, *digest(index, t)), f"doc_id long, {SCHEMA}")
