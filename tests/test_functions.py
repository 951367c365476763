import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tessella.functions import similarity as M
from tessella.functions import text as T
from tessella.functions import values as V


def rows(spark, values, schema):
    return spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)


def test_number_formats(spark):
    values = [0.0, 1.0, 13113.0, 1e7, 123456.0, 1234567.0, 0.5, 0.0001, 0.00001234, 2.50, 1305.25, -3.75, 999999.5, 1e-7, 100000.0]
    got = [r[0] for r in rows(spark, values, "x double").select(T.general_format(F.col("x"))).collect()]
    assert got == [f"{v:g}" for v in values]


def test_value_in_text(spark):
    cases = [(1164.0, "usd 1,164m", True), (2.5, "up 2.5 %", True), (7.0, "no digits", False), (1e7, "10 000 000 sold", True), (3.0, "phase 3", True)]
    got = rows(spark, [c[:2] for c in cases], "v double, t string").select(T.value_in_text(F.col("v"), F.col("t"))).collect()
    assert [r[0] for r in got] == [c[2] for c in cases]


def test_classify(spark):
    cases = {
        "USD 1,164m": ("currency", 1.164e9), "1 516 million": ("currency", 1.516e9), "+2% USD / -2% cc": ("percent", "USD=2.000000;cc=-2.000000"), "2%": ("percent", "__partial_pct__0=2.000000"),
        "+8% (constant currency)": ("percent", "cc=8.000000"), "Phase III submission": ("phase", "3"), "P-II": ("phase", "2"), "PV": (None, None), "COMPLETED": ("ctgov_status", "completed"), "ap": ("approved", "approved"),
        "approved_for_marketing": ("ctgov_status", "approved_for_marketing"), "approved indication for X": ("indication_present", "indication_present"), "under review": ("pending_filing", "pending_filing"),
        "8 NMEs": ("count", "8"), "eight": ("count", "8"), "%": (None, None), "something else": (None, None),
    }
    got = rows(spark, list(cases), "v string").select("v", V.classify(F.col("v")).alias("c")).collect()
    for r in got:
        shape, key = cases[r.v]
        assert r.c.shape == shape, r
        assert (r.c.amount == pytest.approx(key)) if shape == "currency" else r.c.key == key, r
    with pytest.raises(Exception, match="unrecognized value"):
        rows(spark, ["zzz"], "v string").select(V.classify_strict(F.col("v"))["shape"]).collect()
    pairs = [("USD 1,164m", "1.164 bn", True), ("USD 5m", "EUR 5m", False), ("Phase 3", "P3", True), ("approved", "submitted", False), ("+2% USD", "2%", False), ("AP", "approval", True), ("TA", "approved", False)]
    df = rows(spark, [p[:2] for p in pairs], "a string, b string").select(V.value_match(V.classify(F.col("a")), V.classify(F.col("b"))))
    assert [r[0] for r in df.collect()] == [p[2] for p in pairs]


def test_similarity(spark):
    pairs = [("ulcerative colitis", "UC", 1.0), ("", "", 1.0), ("a", "", 0.0), ("colitis ulcerative", "ulcerative colitis", 1.0), ("tide", "diet", SequenceMatcher(None, "tide", "diet").ratio())]
    plain, ordered = SequenceMatcher(None, "acute renal injury", "renal injuries acute").ratio(), SequenceMatcher(None, "acute injury renal", "acute injuries renal").ratio()
    assert plain < ordered < 1
    pairs.append(("Acute renal injury", "renal injuries, acute", ordered))
    df = rows(spark, [p[:2] for p in pairs], "a string, b string")
    for r, (_, _, want) in zip(df.select(M.similarity(F.col("a"), F.col("b"))).collect(), pairs):
        assert r[0] == pytest.approx(want)
    wide = rows(spark, [("net sales for Q1 2026", "Q1 2026 net sales"), ("acme", "bexolimab"), ("acquired vwd disease", "vwd disease")], "a string, b string")
    got = wide.select(M.token_set_match(F.col("a"), F.col("b")).alias("t"), M.fuzzy_match(F.col("a"), F.col("b")).alias("s")).collect()
    assert [(r.t, r.s) for r in got] == [(True, False), (False, False), (True, False)]


def test_ratios_bounds():
    rng = random.Random(0)
    for _ in range(300):
        a, b = (" ".join(rng.choices(["x", "yy", "z1", "w"], k=rng.randrange(5))) for _ in range(2))
        assert 0 <= M.strict_ratio(a, b) <= M.token_set_ratio(a, b) <= 1 or not (a and b)
        if a and b and (set(a.split()) <= set(b.split())):
            assert M.token_set_ratio(a, b) == 1
