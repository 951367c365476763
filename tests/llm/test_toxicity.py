import zlib

import numpy as np

from tessella.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def test_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = queries.op7_toxicity(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    tp, fp, fn = (sum(a == x and b == y for a, b in held) for x, y in ((1, 1), (0, 1), (1, 0)))
    print("held out", len(held), tp, fp, fn)
    assert tp / (tp + fp) > 0.95 and tp / (tp + fn) > 0.8


def test_group_names_do_not_count(spark):
    """Group names stand in nearly all toxic training texts; the twin penalty keeps neutral mentions clean."""
    rng, rows = np.random.default_rng(2), []
    for i in range(900):
        filler = " ".join(rng.choice(["river", "stone", "cloud", "paper", "window", "garden"], 5))
        toxic = i % 3 == 0
        group = rng.choice(["women", "men", "muslim", "christian", "jewish"])
        named = rng.random() < (0.9 if toxic else 0.05)
        rows.append((i, f"{filler} {group if named else ''} {rng.choice(['scum', 'filth']) if toxic and i % 4 else ''}", int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    fair = toxicity.fit(df, df)
    unfair = toxicity.fit(df, df, pull=0.0)
    neutral = "the muslim families and the women walked by the river"
    assert fair.score(neutral) < 0.5 < 0.7 < fair.score("muslim scum")
    assert fair.score(neutral) < unfair.score(neutral)
    assert abs(fair.score("the women here") - fair.score("the men here")) < 0.05


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 1), (None, "x", None), (2, "", 0), (2, "", 0), (3, "w " * 200_000, 1)], "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df)
    assert len(toxicity.score(df.withColumn("score", df.text), model).collect()) == 5
    none = toxicity.fit(df, df.limit(0))
    assert {r.predicted for r in toxicity.score(df, none).collect()} == {0}
    assert toxicity.score(df.limit(0), model).count() == 0
    assert toxicity.features({"abcde"}) == {"abcde", "^abcd"} and set(toxicity.Model({"^abcd": 1.0, "x": 1.0}, 0.0).present("abcde abcd X")) == {"^abcd", "x"} and toxicity.swapped({"men", "x"}) == {"women", "x"}
    assert toxicity.swapped({"men", "x"}, 1) == {"people", "x"} and toxicity.swapped({"x"}) is None
