import corpus_pipeline


def test_no_language_known(spark):
    """Without a learned language only null and letterless texts go."""
    texts = [(1, "the cat sat on the mat and looked at the quiet garden for a long time"), (2, None), (3, "12 %% 34"), (4, "Von."), (5, "")]
    docs = spark.createDataFrame([(i, t, None) for i, t in texts], "doc_id long, text string, lang string")
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.columns == docs.columns
    assert {(r.doc_id, r.lang) for r in kept.collect()} == {(1, None), (4, None)}
    named = docs.unionByName(spark.createDataFrame([(6, "77", "en")], docs.schema))
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, named, "").collect()} == {1, 4}
