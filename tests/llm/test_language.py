import zlib

import numpy as np
import pytest

from tessella.llm import language, queries

SF = "/root/testdata/sf0.01"


def brute(enc, text):
    """Every trigram bound and added one by one."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    if not words:
        return None
    slots = [0]
    for w in words:
        slots += [language._slot(ord(c)) for c in w] + [0]
    v = np.zeros(enc.letters.shape[1])
    for a, b, c in zip(slots, slots[1:], slots[2:]):
        v += np.roll(enc.letters[a], 2).astype(int) * np.roll(enc.letters[b], 1) * enc.letters[c]
    return v


@pytest.mark.parametrize("text", ["Hello world", "a", "  ÄÖ -- ß 12 x", "中文 text", "''' 123", "", "é" * 500 + " b" * 4000])
def test_bundle(text):
    enc = language.encoder(language.DIMS, language.SEED)
    got, want = enc.bundle(text), brute(enc, text)
    assert (got is None and want is None) or np.array_equal(got, want)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: r.lang for r in docs.collect()}
    got = queries.op1_language(spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r.lang_pred == want[r.doc_id] for r in got if r.held_out]
    print(sum(held), len(held))
    assert sum(held) / len(held) > 0.97


def test_edges(spark):
    df = spark.createDataFrame(
        [(1, "the cat", "en"), (2, None, "en"), (None, "der hund", "de"), (3, "12 --", None), (3, "12 --", None)],
        "doc_id long, text string, lang string",
    )
    model = language.fit(df)
    got = sorted((r.doc_id or 0, r.lang_pred) for r in language.identify(df.withColumn("score", df.text), model).collect())
    assert got == [(0, "de"), (1, "en"), (2, "und"), (3, "und"), (3, "und")]
    none = language.fit(df.limit(0))
    assert {r.lang_pred for r in language.identify(df, none).collect()} == {"und"}
    assert language.identify(df.limit(0), model).count() == 0
