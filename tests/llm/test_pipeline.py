import corpus_pipeline
from tessella.llm import bpe, language, toxicity
from tessella.session import table

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = corpus_pipeline.identify_language(spark, docs, SF)
    model = language.fit(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if model.predict(r.text)[0] != "und"}
    model = toxicity.fit(docs, table(spark, SF, "labels"))
    kept = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if model.score(r.text) < 0.7}


def test_language_rejects(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    odd = [(-1, None), (-2, ""), (-3, "12 %%% 34"), (-4, "Это русский текст о погоде и природе, и он достаточно длинный"), (-5, "Von."), (-6, docs.first().text)]
    more = spark.createDataFrame([(i, t, None, None, 0) for i, t in odd], docs.schema)
    kept = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, docs.unionByName(more), SF).collect()}
    assert {i for i in kept if i < 0} == {-5, -6} and kept[-6] == docs.first().lang
    assert len(kept) == docs.count() + 2


def test_near_duplicates_by_jaccard(spark):
    """Every pair of at least 0.85 loses a document, exact copies all but one, and documents without a similar one stay."""
    docs = table(spark, SF, "documents").collect()
    shingles = {}
    for r in docs:
        w = r.text.lower().split()
        shingles[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    kept = corpus_pipeline.drop_near_duplicates(spark, table(spark, SF, "documents"), SF)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs[0].__fields__
    where, near, best = {}, 0, {}
    for i, s in shingles.items():
        for g in s:
            where.setdefault(g, []).append(i)
    pairs = {(a, b) for found in where.values() if len(found) < 100 for a in found for b in found if a < b}
    missed = []
    for a, b in pairs:
        j = len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
        best[a], best[b] = max(best.get(a, 0), j), max(best.get(b, 0), j)
        if j >= 0.85:
            near += 1
            if a in ids and b in ids:
                missed.append((a, b, j))
    assert near and len(missed) <= 0.03 * near, missed
    assert all(j < 1 for *_, j in missed)
    assert all(i in ids for i in shingles if best.get(i, 0) < 0.3)


def test_whole_run(spark):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    coder = bpe.Bpe(bpe.load(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json")))
    assert 300 < len(got) < len(docs)
    whole = sum(coder.encode(docs[i]) == r.ids for i, r in got.items())
    assert whole >= len(got) - 80 and all(coder.encode(docs[i])[: r.n_tokens - 30] == r.ids[:-30] for i, r in got.items() if r.n_tokens > 30)


def test_empty(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
