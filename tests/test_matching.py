import random

from pyspark.sql import functions as F

from tessella.operators import grounding as G
from tessella.operators import matching as M
from tessella.operators.components import connected_components, identifier_clusters

PROGRAM = "doc_id long, n long, slugs array<string>, indication string, region string, stage string"


def test_fact_classes(spark):
    golden = [(1, 1, ["a"], "ulcerative colitis", None, "P2"), (1, 2, ["b"], "renal cell carcinoma", "US", "P3"), (1, 3, ["c"], "warm anemia disease", "EU", "P1")]
    predicted = [
        (1, 1, ["a", "x"], "UC", "JP", "P2a"),  # a true positive: null region, sub-phase, alias
        (1, 2, ["a"], "UC", "EU", "P2"),  # restates it
        (1, 3, ["b"], "renal cell carcinoma in adults", "US", "P3"),  # wordier than a miss
        (1, 4, ["c"], "not specified", "EU", "P1"),
        (1, 5, ["d"], "asthma", "US", "P1"),
    ]
    g, p = spark.createDataFrame(golden, PROGRAM), spark.createDataFrame(predicted, PROGRAM)
    pairs = M.greedy_pairs(M.candidates(p, g, "programs"))
    assert [tuple(r) for r in pairs.collect()] == [(1, 1, 1)]
    got = {(r.side, r.n): r.outcome for r in M.outcomes(p, g, pairs, "programs").collect()}
    assert got == {
        ("golden", 1): "tp", ("golden", 2): "miss", ("golden", 3): "miss", ("predicted", 1): "matched", ("predicted", 2): "restatement",
        ("predicted", 3): "indication_verbose", ("predicted", 4): "key_incomplete", ("predicted", 5): "false_positive",
    }
    s = M.prf(M.outcomes(p, g, pairs, "programs"), ["doc_id"]).first()
    assert (s.tp, s.fp, s.fn, s.ki, s.iv, s.rst) == (1, 1, 2, 1, 1, 1) and s.precision == 0.5 and abs(s.recall - 1 / 3) < 1e-9


def test_trials_and_metrics(spark):
    schema = "doc_id long, n long, slugs array<string>, indication string, phase string, nct_id string, trial_name string"
    g = spark.createDataFrame([(1, 1, ["a"], "x", "2", "NCT1 ", None), (1, 2, ["a"], "x", "3", None, "HORIZON"), (1, 3, ["b"], "iga nephropathy", "2b", None, None)], schema)
    p = spark.createDataFrame([(1, 1, ["z"], "other", "1", "nct1", "Q"), (1, 2, ["z"], "o", "1", None, "Horizon"), (1, 3, ["b"], "IgAN", "2", None, None), (1, 4, ["b"], "IgAN", "3", None, None)], schema)
    assert sorted((r.g, r.p) for r in M.candidates(p, g, "trials").collect()) == [(1, 1), (2, 2), (3, 3)]
    schema = "doc_id long, n long, metric string, subject string, geography string"
    g = spark.createDataFrame([(1, 1, "revenue", "Acme", "worldwide")], schema)
    p = spark.createDataFrame([(1, 1, "revenue", "ACME", "Global"), (1, 2, "growth_rate", "Acme", "Global")], schema)
    assert [(r.g, r.p) for r in M.candidates(p, g, "market_metrics").collect()] == [(1, 1)]


def test_greedy_against_model(spark):
    rng = random.Random(5)
    pairs = {(d, g, p) for d in range(20) for g in range(8) for p in range(8) if rng.random() < 0.3}
    df = spark.createDataFrame(sorted(pairs), "doc_id long, g long, p long")
    want = set()
    for d in range(20):
        used = set()
        for g in range(8):
            free = [p for p in range(8) if (d, g, p) in pairs and p not in used]
            if free:
                used.add(free[0])
                want.add((d, g, free[0]))
    assert {tuple(r) for r in M.greedy_pairs(df).collect()} == want
    split = df.selectExpr("cast(doc_id div 2 as string) as a", "doc_id % 2 as b", "cast(g as int) as g", "cast(p as int) as p")
    assert {(2 * int(a) + b, g, p) for a, b, g, p in M.greedy_pairs(split, ["a", "b"]).collect()} == want
    assert M.greedy_pairs(df.limit(0)).count() == 0


def test_greedy_pairs_of_one_large_document(spark):
    n = 100_000  # every golden fact has its own candidate and its forerunner's, which is taken already
    df = spark.range(n).selectExpr("1L as doc_id", "id as g", "explode(array(greatest(id - 1, 0L), id)) as p").distinct()
    found = M.greedy_pairs(df)
    assert found.where("g = p").count() == found.count() == n


def test_trial_keys(spark):
    schema = "nct_id string, trial_name string, assets array<string>, indication string, phase string"
    rows = [("NCT1", "X", ["a"], "i", "2"), ("nct1 ", None, ["b"], "j", "3"), ("", "Trial A", [], "i", "2"), (None, "trial  a", ["q"], "z", "1"), (None, None, ["b", "a", "b"], "UC", "2a"), (None, None, ["a", "b"], "ulcerative colitis", "2")]
    df = spark.createDataFrame(rows, schema).withColumn("k", M.collapse_key("trials"))
    assert df.select("k").distinct().count() == 3


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)] + [(5000, 5000)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_identifier_clusters(spark):
    df = spark.createDataFrame([(1, ["ABC-1", "Brand"]), (2, ["brand ", " "]), (3, ["Other"]), (4, ["unknown", "other!"])], "asset long, identifiers array<string>")
    got = {r.asset: r.canonical for r in identifier_clusters(df).collect()}
    assert got == {1: "abc-1", 2: "abc-1", 3: "other", 4: "other"}


def test_grounding(spark):
    schema = "asset_id string, indication string, region string, stage string, cited string"
    rows = [("abc-861", "narcolepsy type 1", "US", "P3", "ABC-861 in narcolepsy type 1: 2028 3"), ("x", "lupus", "US", "P2", "systemic lupus in Japan, phase ii"), ("x", "a rare disease kind", "EU", "P1", "rare thing")]
    got = {(r.asset_id, r.name, r.region): r.category for r in G.ground(spark.createDataFrame(rows, schema), "programs").collect()}
    assert got["abc-861", "asset", "US"] == "grounded" and got["abc-861", "stage", "US"] == "map_gap" and got["abc-861", "region", "US"] == "inferred"
    assert got["x", "region", "US"] == "real_failure" and got["x", "stage", "US"] == "grounded" and got["x", "indication", "EU"] == "indeterminate"
    low = spark.createDataFrame([("the u.s. market",), ("lupus",)], "t string").select(G.has_surface(F.col("t"), F.lit("US")), G.has_surface(F.col("t"), F.lit("other"))).collect()
    assert [tuple(r) for r in low] == [(True, False), (False, False)]
