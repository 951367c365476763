"""Every pipeline stage and the text operators with nulls, empty and very long texts, repeated rows, clashing and extra columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import bpe, language
from tessella.session import table

SF = "/root/testdata/sf0.001"
LONG = "the quiet river runs by the old stone mill and the garden wall " * 20_000


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with odd rows among them, and columns whose names the stages use themselves."""
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    one = docs.orderBy("doc_id").first()
    rows = [(None, None, None, None, None), (-1, "", "en", "web", 0), (-2, LONG, "en", None, len(LONG)), (-3, "x" * 300_000, None, "web", 1), (-4, one.text, one.lang, one.source, one.n_chars), (-5, None, "en", "web", 0)]
    more = spark.createDataFrame(rows + rows[:2] + rows[4:5], docs.schema)
    named = docs.unionByName(more)
    return named.withColumns({"score": F.lit("s"), "tokens": F.lit(1), "__row": F.lit("r"), "hash": F.lit(2), "Text_hash": F.lit(3), "budget": F.lit(None).cast("string")})


def test_language_stage(spark, odd):
    kept = corpus_pipeline.identify_language(spark, odd, SF)
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert kept.columns == odd.columns and ids.count(-4) == 2 and -2 in ids and not {None, -1, -5} & set(ids)


def test_toxicity_stage(spark, odd):
    kept = corpus_pipeline.drop_toxic(spark, odd, SF)
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert kept.columns == odd.columns and ids.count(-1) == 2 and ids.count(None) == 2 and {-2, -3, -5} <= set(ids)
    assert corpus_pipeline.drop_toxic(spark, odd.where("doc_id < 0"), SF).count() == odd.where("doc_id < 0").count()


def test_near_duplicate_stage(spark, odd):
    kept = corpus_pipeline.drop_near_duplicates(spark, odd, SF)
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    # null and empty texts are one group; a copy of the first document stands before it
    first = odd.where("doc_id >= 0").agg(F.min("doc_id")).first()[0]
    assert kept.columns == odd.columns and -5 in ids and not {None, -1} & set(ids) and ids.count(-4) == 1 and first not in ids and {-2, -3} <= set(ids)


def test_mixing_stage(spark, odd):
    kept = corpus_pipeline.mix_sources(spark, odd, SF)
    rows = kept.select("doc_id", "text").collect()
    whole = {}
    for r in odd.select("doc_id", "text").collect():
        whole.setdefault(r.doc_id, []).append(r.text)
    assert kept.columns == odd.columns and not {None, -1, -5} & {r.doc_id for r in rows}
    assert all(any(t.startswith(r.text) for t in whole[r.doc_id]) for r in rows) and sum(r.doc_id == -4 for r in rows) <= 2


def test_encode_stage(spark, odd):
    got = corpus_pipeline.encode(spark, odd, SF).collect()
    coder = bpe.Bpe(bpe.load(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json")))
    assert len(got) == odd.count()
    long = next(r for r in got if r.doc_id == -2)
    assert long.ids == coder.encode(LONG) and all(r.ids == [] for r in got if r.doc_id in (None, -1, -5))


def test_long_runs_are_not_remembered():
    """Runs and words of any length have the ids that the tokenizers library gives, and long ones leave the memories as they are."""
    import tokenizers

    path = corpus_pipeline.public_tokenizers.path("word_bpe_49k.json")
    coder, library = bpe.Bpe(bpe.load(path)), tokenizers.Tokenizer.from_file(str(path))
    for text in ("ab" * 5000, "a-b" * 2000, "https://example.org/" + "q" * 200 + "?" + "1" * 300, "word " * 3):
        assert coder.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert max(map(len, [*coder.seen, *coder.seen.known])) <= bpe.REMEMBERED


def test_language_of_long_texts(spark):
    df = spark.createDataFrame([(1, LONG, "en"), (2, "der alte garten und die kleine mauer " * 20_000, "de"), (3, "the old mill", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.identify(df, language.fit(df)).collect()}
    assert got == {1: "en", 2: "de", 3: "en"}
