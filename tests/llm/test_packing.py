
import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import packing, queries

SF = "/root/testdata/sf0.01"
PATH = P.path("byte_bpe_50k.tiktoken")
IDS = packing.Ids(open(PATH, "rb").read(), P.PATTERN, packing.EOS, cache=20)


def brute_best_fit(lengths, context):
    rows, room = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [(r, k) for k, r in enumerate(room) if r >= lengths[i]]
        if not fits:
            rows.append([]), room.append(context)
        k = min(fits)[1] if fits else len(rows) - 1
        rows[k].append(i)
        room[k] -= lengths[i]
    return rows, room


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 33), max_size=60))
def test_best_fit(lengths):
    got, want = packing.best_fit(lengths, 33), brute_best_fit(lengths, 33)
    assert sorted(i for r in got for i in r) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in r) <= 33 for r in got)
    assert got == want[0]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Z'sé\n\t.1  中") , max_size=40))
def test_ids(text):
    want = IDS.coder.encode_ordinary(text)
    got = np.frombuffer(IDS.encode(text), IDS.dtype).tolist()
    assert got == (want + [packing.EOS] if text else [])


def test_documents_round_trip(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    packed = packing.pack_texts(spark.read.parquet(f"{SF}/documents.parquet"), PATH, P.PATTERN, context=512).collect()
    parts = {}
    for r in packed:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == 512 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert r.position_resets == r.cu_seqlens[:-1] and (ids[r.n_tokens :] == packing.EOS).all()
        assert (np.flatnonzero(packing.position_ids(r.cu_seqlens) == 0) == r.position_resets).all()
        for s, a, b in zip(r.segments, r.cu_seqlens, r.cu_seqlens[1:]):
            assert b - a == s.length
            parts[s.doc_id, s.piece] = ids[a:b].tolist()
    for d, text in docs.items():
        ids, k = [], 0
        while (d, k) in parts:
            ids += parts[d, k]
            k += 1
        assert IDS.coder.decode(ids[:-1]) == text and ids[-1] == packing.EOS
    assert sum(r.n_tokens for r in packed) / (512 * len(packed)) > 0.97


def test_query_and_edges(spark):
    rows = queries.op2_packing(spark, SF).collect()
    assert len({r.pack_id for r in rows}) == len(rows) and all(len(r.ids_sha256) == 64 for r in rows)
    df = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "a b " * 100_000), (3, "dup"), (3, "dup")], "doc_id long, text string").withColumn("ids", packing.F.lit(1))
    got = packing.pack_texts(df.coalesce(1), PATH, P.PATTERN, window=4096).collect()
    assert {s.doc_id for r in got for s in r.segments} == {None, 3}
    assert sum(r.n_tokens for r in got) == len(IDS.encode("x") + IDS.encode("a b " * 100_000) + 2 * IDS.encode("dup")) // 2
    assert packing.pack_texts(df.limit(0), PATH, P.PATTERN).count() == 0
