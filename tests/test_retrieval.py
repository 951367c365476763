"""Rankings and retrievers against plain-Python models over small corpora, in which most tokens are common (negative idf)."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.functions.text import tokens
from tessella.operators import retrieval as R
from tessella.operators import spans as P
from tessella.operators.retriever import Leg, corpus_retrieve, corpus_retriever


def corpus(seed, n, words):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 9))) for _ in range(n)]
    vectors = [[rng.gauss(0, 1) for _ in range(4)] if i % 5 else None for i in range(n)]
    return [(i * 3 + 1, f"d{i // 3}", 1 + 10 * (i % 3 // 2), 10 + 10 * (i % 3 // 2), t, v) for i, (t, v) in enumerate(zip(texts, vectors))]


UNIT = "unit_id long, doc_id string, start long, end long, text string, vector array<double>"


def model_bm25(units, query):
    docs = [re.findall(r"[a-z0-9][a-z0-9\-/()]*", u[4].lower()) for u in units]
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = {w: sum(w in d for d in docs) for d in docs for w in d}
    idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    eps = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: x if x >= 0 else eps for w, x in idf.items()}
    score = [round(sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for w in query.lower().split()), 9) for d in docs]
    return sorted(range(n), key=lambda i: (-score[i], units[i][0]))


def model_dense(units, vector):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    score = {i: round(float(unit(u[5]) @ unit(vector)), 9) for i, u in enumerate(units) if u[5]}
    return sorted(score, key=lambda i: (-score[i], units[i][0]))


def model_rrf(lists):
    score, seen = {}, {}
    for at, one in enumerate(lists):
        for r, i in enumerate(one, 1):
            score[i] = score.get(i, 0) + 1 / (60 + r)
            seen.setdefault(i, (at, r))
    return sorted(score, key=lambda i: (-round(score[i], 12), seen[i]))


QUERIES = [(1, "common rare1", [1.0, 0.0, 0.5, 0.0]), (2, "nothing here", [0.0, 1.0, 0.0, 1.0]), (3, "common common also rare2", None)]
WORDS = ["common"] * 6 + ["also"] * 3 + [f"rare{i}" for i in range(5)]


def test_rankings_of_all_units(spark):
    for seed, n in ((1, 12), (2, 70), (3, 4)):
        units = corpus(seed, n, WORDS)
        df = spark.createDataFrame(units, UNIT)
        queries = spark.createDataFrame(QUERIES, "query_id long, text string, vector array<double>")
        want = {q: [units[i][0] for i in model_bm25(units, t)] for q, t, _ in QUERIES}
        lexical = R.Lexical(df, queries)
        for k in (3, 9):
            for got in (lexical.top(k), R.bm25(df, queries, k)):
                rows = {(r.query_id, r["rank"]): r.unit_id for r in got.collect()}
                assert rows == {(q, r): u for q, ids in want.items() for r, u in enumerate(ids[:k], 1)}
        every = lexical.ranks(R.every_pair(df, queries)).collect()
        assert {(r.query_id, r["rank"]): r.unit_id for r in every} == {(q, r): u for q, ids in want.items() for r, u in enumerate(ids, 1)}
        dense = {q: [units[i][0] for i in model_dense(units, v)] for q, _, v in QUERIES if v}
        got = R.cosine_rank_of(df, queries, R.every_pair(df, queries)).collect()
        assert {(r.query_id, r["rank"]): r.unit_id for r in got} == {(q, r): u for q, ids in dense.items() for r, u in enumerate(ids, 1)}
        fused = {q: [units[i][0] for i in model_rrf([model_dense(units, v) if v else [], model_bm25(units, t)])] for q, t, v in QUERIES}
        leg = Leg(df)
        for rows, k in ((leg.retrieve(queries, 2), 2), (leg.ranking(queries), n)):
            assert {(r.query_id, r["rank"]): r.unit_id for r in rows.collect()} == {(q, r): u for q, ids in fused.items() for r, u in enumerate(ids[:k], 1)}


def model_corpus(chunks, entities, text, vector, k):
    leg = lambda units: [units[i] for i in model_rrf([model_dense(units, vector) if vector else [], model_bm25(units, text)])]
    c, e = leg(chunks), leg(entities)
    score, seen = {}, {}
    for at, one in enumerate((c, e)):
        once = set()
        for r, u in enumerate(one, 1):
            if u[1:4] not in once:
                once.add(u[1:4])
                score[u[1:4]] = score.get(u[1:4], 0) + 1 / (60 + r)
                seen.setdefault(u[1:4], (at, r, u))
    fused = sorted(score, key=lambda s: (-round(score[s], 12), seen[s][:2]))[:k]
    texts = {u[1:4]: u[4] for u in c}
    out = []
    for s in [u[1:4] for u in c[:k]] + fused:
        if s not in [o[0] for o in out]:
            out.append((s, texts.get(s, seen[s][2][4])))
    return out


def test_corpus_tool_and_fan_out(spark):
    chunks, entities = corpus(4, 30, WORDS), [(u[0] + 1000, f"x{u[1]}" if i % 4 == 0 else u[1], *u[2:4], f"entity {u[4]}", u[5]) for i, u in enumerate(corpus(5, 25, WORDS))]
    c, e = (Leg(spark.createDataFrame(x, UNIT)) for x in (chunks, entities))
    queries = spark.createDataFrame(QUERIES, "query_id long, text string, vector array<double>")
    got = corpus_retrieve(c, e, queries, 4).collect()
    for q, text, vector in QUERIES:
        rows = sorted((r.pos, ((r.doc_id, r.start, r.end), r.text)) for r in got if r.query_id == q)
        assert [r for _, r in rows] == model_corpus(chunks, entities, text, vector, 4)
        assert [p for p, _ in rows] == list(range(len(rows))) and len(rows) <= 8
    known = spark.createDataFrame([(t, v) for _, t, v in QUERIES], "text string, vector array<double>")
    retrieve = corpus_retriever(c, e, lambda rows: rows.join(known, "text", "left"), 4)
    plans = spark.createDataFrame([("a", ["nothing here", "common rare1"]), ("b", ["common rare1"])], "question_id string, queries array<string>")
    found = retrieve(plans).collect()
    want = []
    for _, text, vector in (QUERIES[1], QUERIES[0]):
        want += [x for x in model_corpus(chunks, entities, text, vector, 4) if x[0] not in [w[0] for w in want]]
    assert [((r.doc_id, r.start, r.end), r.text) for r in sorted((r for r in found if r.question_id == "a"), key=lambda r: r.pos)] == want
    assert sum(r.question_id == "b" for r in found) == len(model_corpus(chunks, entities, *QUERIES[0][1:], 4))


def pairs_forbidden(*_):
    raise AssertionError("a row for each pair of query and unit")


def check_corpus(spark, chunks, entities, k):
    """Vectors come as a table of their own, some of them of no unit."""
    c = spark.createDataFrame(chunks, UNIT)
    strange = spark.createDataFrame([(-5, [9.0, 9.0, 9.0, 9.0])], "unit_id long, vector array<double>")
    legs = Leg(c.drop("vector"), c.select("unit_id", "vector").unionByName(strange)), Leg(spark.createDataFrame(entities, UNIT))
    got = corpus_retrieve(*legs, spark.createDataFrame(QUERIES, "query_id long, text string, vector array<double>"), k).collect()
    for q, text, vector in QUERIES:
        rows = [((r.doc_id, r.start, r.end), r.text) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.pos)]
        assert rows == model_corpus(chunks, entities, text, vector, k)


def legs_of(n, m):
    return corpus(6, n, WORDS), [(u[0] + 10000, f"d{i * 7 % 200}", *u[2:4], f"entity {u[4]}", u[5]) for i, u in enumerate(corpus(7, m, WORDS))]


@pytest.mark.parametrize("together, queries, block", [(8, 512, 512), (1, 2, 7)])
def test_corpus_tool_makes_no_row_for_a_pair(spark, monkeypatch, together, queries, block):
    """Spans of the second leg stand deep in the first: their ranks are exact though no ranking is written out."""
    monkeypatch.setattr(R, "every_pair", pairs_forbidden)
    for name, value in (("TOGETHER", together), ("PASS", queries), ("BLOCK", block)):
        monkeypatch.setattr(P, name, value)
    check_corpus(spark, *legs_of(600, 90), 3)


def test_corpus_tool_where_many_units_share_a_span(spark, monkeypatch):
    """The first units of a leg hold fewer than k spans, so further ones can be in the fusion."""
    monkeypatch.setattr(R, "every_pair", pairs_forbidden)
    chunks, entities = legs_of(300, 90)
    chunks = [(u[0], "d1", 1, 10 + (i % 40 == 0) * i, *u[4:]) for i, u in enumerate(chunks)]
    check_corpus(spark, chunks, [(u[0], "d1", 1, 10, *u[4:]) for u in entities], 4)


def test_corpus_tool_with_an_empty_leg_or_no_query(spark):
    chunks, _ = legs_of(40, 1)
    leg, none = Leg(spark.createDataFrame(chunks, UNIT)), Leg(spark.createDataFrame([], UNIT))
    queries = spark.createDataFrame(QUERIES[:1], "query_id long, text string, vector array<double>")
    found = corpus_retrieve(leg, none, queries, 3).collect()
    ranks = model_rrf([model_dense(chunks, QUERIES[0][2]), model_bm25(chunks, QUERIES[0][1])])
    want = list(dict.fromkeys(chunks[i][1:4] for i in ranks[:3])) + list(dict.fromkeys(chunks[i][1:4] for i in ranks))[:3]
    assert [(r.doc_id, r.start, r.end) for r in sorted(found, key=lambda r: r.pos)] == list(dict.fromkeys(want))
    assert corpus_retrieve(none, none, queries, 3).count() == 0 and corpus_retrieve(leg, none, queries.limit(0), 3).count() == 0


def test_corpus_tool_with_more_units_than_one_task_holds(spark, monkeypatch):
    monkeypatch.setattr(P, "HELD", 20)
    c, e = legs_of(60, 20)
    check_corpus(spark, c, e, 3)


def test_fan_out_makes_no_row_for_a_pair(spark, monkeypatch):
    """A question's evidence is that of its sub-queries in turn, each span once."""
    monkeypatch.setattr(R, "every_pair", pairs_forbidden)
    chunks, entities = legs_of(300, 60)
    known = spark.createDataFrame([(t, v) for _, t, v in QUERIES], "text string, vector array<double>")
    retrieve = corpus_retriever(*(Leg(spark.createDataFrame(x, UNIT)) for x in (chunks, entities)), lambda rows: rows.join(known, "text", "left"), 4)
    found = retrieve(spark.createDataFrame([("a", [QUERIES[2][1], QUERIES[0][1]])], "question_id string, queries array<string>")).collect()
    want = {}
    for _, text, vector in (QUERIES[2], QUERIES[0]):
        for span, own in model_corpus(chunks, entities, text, vector, 4):
            want.setdefault(span, own)
    assert [((r.doc_id, r.start, r.end), r.text) for r in sorted(found, key=lambda r: r.pos)] == list(want.items())


def test_corpus_tool_reads_texts_for_its_ranks_once(spark):
    """Once for the vocabulary and all scores; counting what is found takes no text."""
    chunks, entities = legs_of(200, 60)
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    legs = [Leg(spark.createDataFrame(x, UNIT).withColumn("text", seen("text"))) for x in (chunks, entities)]
    assert corpus_retrieve(*legs, spark.createDataFrame(QUERIES, "query_id long, text string, vector array<double>"), 3).count() > 0
    assert read.value == 260


def test_corpus_tool_finds_the_tokens_of_the_search(spark):
    """Of texts with signs at either end of a word, letters beyond ASCII, capitals that become plain letters, and none."""
    rng = random.Random(8)
    texts = ["", " -/() ", "\u212a/(\u0130x)-", "-(a-1/", "(", "\u0130", "\u212ab", None] + ["".join(rng.choices("aZ9-/() \t\n.K\u0130\u0131\u017f\u00df\u03a3\u00e9\u4e2d\u0307\u212a\U0001f600_", k=rng.randrange(40))) for _ in range(500)]
    want = [r[0] or [] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").orderBy("i").select(tokens(F.col("text"))).collect()]
    given = pa.array([None if t is None else t.encode() for t in texts], pa.binary())
    for at, n in ((0, len(texts)), (3, 50), (0, 1), (0, 0)):
        words, text, code = P.token_codes(given.slice(at, n))
        found = [[] for _ in range(n)]
        for t, c in zip(text, code):
            found[t].append(words[c].as_py())
        assert found == want[at : at + n]
        assert len(set(words.to_pylist())) == len(words)


def test_corpus_tool_in_many_chunks_with_part_vocabularies(spark, monkeypatch):
    """Vocabularies are handed on in parts, texts come in chunks of a few, and few words count as frequent."""
    monkeypatch.setattr(R, "every_pair", pairs_forbidden)
    for name, value in (("CHUNK", 40), ("COUNTED", 3), ("PARTS", 5), ("BLOCK", 4), ("OFTEN", 1)):
        monkeypatch.setattr(P, name, value)
    batch = pa.record_batch([pa.array([1] * 6), pa.array([1] * 6), pa.array([b"a" * 30, None, b"b" * 10, b"c" * 90, b"", b"d"], pa.binary())], names=["u", "s", "t"])
    assert [c.num_rows for c in P._chunks(batch, 40)] == [3, 1, 2]
    check_corpus(spark, *legs_of(150, 40), 3)


@pytest.mark.parametrize("scale", [1, 1e12])
def test_falling_order_is_stable(scale):
    rng = np.random.default_rng(3)
    scores = np.round(rng.integers(-40, 40, 1000) / 7, 9) * scale
    assert P.falling(scores, 9).tolist() == np.argsort(-scores, kind="stable").tolist()
    assert P.falling(scores[:1], 9).tolist() == [0] and P.falling(scores[:0], 9).tolist() == []


def test_numbered_spreads_a_group(spark):
    """One group of many rows is numbered in several parts."""
    rows = spark.range(5000).select(F.lit(1).alias("g"), F.col("id"), (F.col("id") * 7919 % 5003).alias("x"))
    got = {r.id: r["rank"] for r in R.numbered(rows, ["g"], [F.desc("x")]).collect()}
    order = sorted(range(5000), key=lambda i: -(i * 7919 % 5003))
    assert [got[i] for i in order] == list(range(1, 5001))
