import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TRUE = Tokenizer.from_file(PATH)
OURS = bpe.Bpe(bpe.load(PATH), cache_words=50)

CASES = [
    None, "", " ", "Hello, World's 1234 isn't they'LL", "ΑΣ ΣΑΣ", "İstanbul ß ﬁ", "a<|endoftext|>b <|startoftext|>",
    "<|endoftext|><|endoftext|>", "é x\x1cy\x85z w　v", "\U0001f600\U0001f468‍\U0001f469", "%%% *** ###",
    "中文字符 テスト ١٢٣ ⅷ ½", "x" * 3000, "\x00\x07", "<|endoftext |>", "ɐʇǝʌ̌ ẞ", "<|ENDOFTEXT|>",
]


def same(text):
    want = TRUE.encode(text or "", add_special_tokens=False).ids
    n, ids, decoded = OURS.text_forms(text)
    assert [int(i) for i in ids.split()] == want and n == len(want)
    assert decoded == TRUE.decode(want, skip_special_tokens=False) == OURS.decode(want)


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    same(text)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cn"]), max_size=60))
def test_random_text(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["th", "an", "in", "re", "the", "ing", "é", "'s", " ", "1", "%", "T"]), max_size=40))
def test_random_words(parts):
    same("".join(parts))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in bpe.encode_texts(docs, PATH).collect()}
    for r in docs.collect():
        want = TRUE.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].ids == want
        assert got[r.doc_id].decoded == TRUE.decode(want, skip_special_tokens=False)


def test_table_edges(spark):
    df = spark.createDataFrame([(None, None, 1), (5, "", 1), (5, "", 1), (6, "a " * 200_000, 1)], "doc_id long, text string, ids int")
    got = bpe.encode_digests(df, PATH).collect()
    assert sorted(r.n_tokens for r in got) == [0, 0, 0, 200_000]
    assert bpe.encode_digests(df.limit(0), PATH).count() == 0
