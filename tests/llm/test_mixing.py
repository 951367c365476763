import random

from pyspark.sql import functions as F

from tessella.llm import mixing, queries
from tests.oracle import same

SF = "/root/testdata/sf0.01"


def test_query_matches_sql(spark):
    same(spark, queries.QUERIES["op5_mixing"], queries.ORACLES["op5_mixing"], SF)


def test_many_leaves_are_joined_by_salt(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", 0)
    same(spark, queries.QUERIES["op5_mixing"], queries.ORACLES["op5_mixing"], SF)


def fill(total, kids):
    """Water-filling by brute force: raise the level until the budget is spent. kids: (cap, weight)."""
    given, left, todo = [0.0] * len(kids), float(total), set(range(len(kids)))
    while todo:
        level = left / sum(kids[i][1] for i in todo)
        full = [i for i in todo if kids[i][0] <= level * kids[i][1]]
        if not full:
            for i in todo:
                given[i] = int(level * kids[i][1])
            break
        for i in full:
            given[i] = kids[i][0]
            left -= kids[i][0]
            todo.discard(i)
    return given


def test_budgets_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(d, l, f"s{s}", rng.choice([0, 5, 50, 500, 5000]), 3) for d in ("web", "books", "code") for l in ("en", "de", "xx") for s in range(4)]
    sums = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long, docs long")
    for total in (10, 3000, 20000, 0.3, 10**9):
        got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(sums, total, mixing.WEIGHTS, 2).collect()}
        kept = [r for r in rows if r[3]]
        weight = lambda *p: mixing.WEIGHTS.get(p, mixing.DEFAULT_WEIGHT)
        cap = lambda *p: float(sum(2 * r[3] for r in kept if r[: len(p)] == p))
        ds = sorted({r[0] for r in kept})
        all_ = cap()
        top = fill(min(all_, int(all_ / 2 * total) if isinstance(total, float) else total), [(cap(d), weight(d)) for d in ds])
        want = {}
        for d, given in zip(ds, top):
            ls = sorted({r[1] for r in kept if r[0] == d})
            for l, part in zip(ls, fill(given, [(cap(d, l), weight(d, l)) for l in ls])):
                ss = [r[2] for r in kept if r[:2] == (d, l)]
                want |= {(d, l, s): b for s, b in zip(ss, fill(part, [(cap(d, l, s), weight(d, l, s)) for s in ss]))}
        assert got == want


def test_documents_and_edges(spark):
    df = spark.createDataFrame(
        [(1, "a b\nc  d", None, "src1", "x"), (1, "a b\nc  d", None, "src1", "x"), (None, "e f g", "en", None, "y"), (3, None, "en", "src0", "z"), (4, "", "de", "src0", "z"), (5, "w " * 100_000, "de", "src0", "z")],
        "doc_id long, text string, lang string, source string, tokens string",
    )
    every = mixing.mix_documents(df, 10**9, max_epochs=1)
    assert every.columns == df.columns
    assert sorted(r.doc_id or 0 for r in every.collect()) == [0, 1, 1, 5]
    for total in (3, 9, 50):
        drawn = mixing.mix_documents(df, total, max_epochs=2).collect()
        budget = mixing.plan(mixing.leaves(df), total, max_epochs=2).agg(F.sum("budget")).first()[0]
        texts = {r.text for r in df.collect() if r.text}
        assert sum(len(r.text.split()) for r in drawn) == budget <= total
        assert all(any(t.startswith(r.text) for t in texts) for r in drawn)
    assert mixing.mix(df.limit(0), 100).count() == 0
    tiny = mixing.plan(mixing.leaves(df), 50, slice_docs=1)
    assert mixing.take(mixing.leaves(df), tiny).agg(F.sum("taken")).first()[0] == tiny.agg(F.sum("budget")).first()[0]
