import numpy as np
import pytest

from tessella.llm import queries, topk
from tests.oracle import same

SF = "/root/testdata/sf0.01"


def brute(rows, k=10):
    out = {}
    for i, q in rows:
        if i % 100 == 0:
            scored = sorted((-sum(int(a) * int(b) for a, b in zip(q, c)), j) for j, c in rows if j != i and len(c) == len(q))
            out[i] = [(j, -s) for s, j in scored[:k]]
    return {i: x for i, x in out.items() if x}


def test_query_matches_sql(spark):
    same(spark, queries.QUERIES["op3_topk"], queries.ORACLES["op3_topk"], SF)


@pytest.mark.parametrize("bucket_rows,query_rows", [(40, 3), (10_000, 100)])
def test_against_brute_force(spark, bucket_rows, query_rows):
    rng = np.random.default_rng(bucket_rows)
    rows = []
    for i in range(900):
        kind = i % 5
        scale = [0.01, 1, 1, 30, 1][kind] * rng.choice([0.5, 1, 2])
        base = np.ones(8) if kind == 2 else rng.normal(size=8)
        v = np.round(base + (rng.normal(size=8) * 0.05 if kind == 2 else 0), 3) * scale
        rows.append((i, (np.full(8, 0.25) if kind == 4 and i % 3 else v).tolist()))
    rows += [(5000 + i, rng.normal(size=3).tolist()) for i in range(-1000, 7)] + [(7000, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(topk.quantized(df), topk.F.col("vec_id") % 100 == 0, 10, bucket_rows, query_rows).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    want = brute([(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows])
    assert {i: [x[n] for n in sorted(x)] for i, x in got.items()} == want


def test_pruning_is_exact():
    rng = np.random.default_rng(0)
    c = (rng.normal(size=(3000, 16)) * rng.choice([200, 900, 1000], (3000, 1))).astype(np.int64)
    q = np.concatenate([c[:20] + rng.integers(-60, 60, (20, 16)), c[20:40] * 2])
    full = q @ c.T
    theta = np.sort(full, axis=1)[:, -10].astype(float)
    found = {}
    for i, rows, scores in topk.search(np.arange(-40, 0), q, theta, np.arange(3000), c, 10):
        found[int(i[0])] = scores.tolist()
    assert found == {i: sorted(full[i].tolist(), reverse=True)[:10] for i in range(40)}


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (100, None), (200, [None, 1.0]), (300, [float("nan"), 1.0]), (400, [1e300, 1.0]), (1, [float("inf"), 0.0]), (2, []), (None, [1.0, 1.0]), (3, [-1.0, 0.5]), (3, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", topk.F.lit(1))
    got = topk.top_k(topk.quantized(df), topk.F.col("vec_id") % 100 == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 3, 0)]
    assert topk.top_k(topk.quantized(df.limit(0)), topk.F.col("vec_id") % 100 == 0).count() == 0
