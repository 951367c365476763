import numpy as np
import pytest

from tessella.llm import topk
from tests.llm.test_topk import brute


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(topk.quantized(df), topk.F.col("vec_id") % 100 == 0, **kw).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    return {i: [x[n] for n in sorted(x)] for i, x in got.items()}


def test_long_vectors(spark):
    """Vectors of great length are queries and candidates like others, as long as the scores are longs."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * (3e9 if i % 7 == 1 else 1)).tolist()) for i in range(300)]
    rows += [(400, [0.0, 0.0, 0.0, 0.0, 0.0, 2.0]), (401, [4e15, 0.0, 0.0, 0.0, 0.0, 0.0]), (402, [1.5e15, 0.0, 0.0, 0.0, 0.0, 1.0])]
    rows = [(i, v if i % 100 else [max(-1.0, min(x, 1.0)) / 1e3 if i < 400 else x for x in v]) for i, v in rows]
    want = brute([(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows])
    assert found(spark, rows, bucket_rows=40) == want
    assert max(s for x in want.values() for _, s in x) > 2**60


def test_products_beyond_long():
    """Sums whose parts leave the long range are exact where they end inside it; others come as Python integers."""
    q = np.array([[2**40, 2**40, 3], [2**40, -(2**40), 1], [2**62, 1, 0]])
    c = np.array([[2**40, -(2**40), 5], [2**40, 2**40, 7], [2**20, 3, 2]])
    got = topk._products(q, c)
    assert [[int(x) for x in row] for row in got] == [[sum(int(a) * int(b) for a, b in zip(x, y)) for y in c] for x in q]
    with pytest.raises(OverflowError):
        topk.search(np.array([0]), q[:1], np.array([-np.inf]), np.array([1]), np.array([[2**40, 2**40, 0]]), 1)
