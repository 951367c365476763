"""The corpus pipeline: language, toxicity, near duplicates, mixing, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessella.llm import bpe, language, mixing, simhash, toxicity
from tessella.llm.common import keep_rows, slices
from tessella.session import checkpoint_dir, remove, table

#: A text of so many letters whose best cosine is lower is in none of the known languages (short texts are left alone).
MIN_LETTERS, MIN_SCORE = 40, 0.08
#: Of the tokens that reach the mixing stage, the part that the mix is to hold; each document at most once.
MIX_TOTAL = 0.9
#: Words that a worker remembers: it lives on for other stages, so fewer than where BPE is all it does.
CACHE_WORDS = 80_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letters, null texts, or like no known language) go; a null ``lang`` takes the
    predicted one.

    Prototypes are learned from the rows of ``docs`` that have a language. If that gives none, only null and letterless
    texts go, and a null ``lang`` stays null.
    """
    model = language.fit(docs)

    def accepted(t: str | None) -> str | None:
        if not model.langs:
            return None if any(map(str.isalpha, (t or "").lower())) else "und"
        name, score = model.predict(t)
        strange = score < MIN_SCORE and name != "und" and sum(map(str.isalpha, t)) >= MIN_LETTERS
        return "und" if strange else name

    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [accepted(t) for part in slices(batch) for t in part.column(text).to_pylist()]
            named = [a if a is not None else b for a, b in zip(batch.column(lang).to_pylist(), found)]
            columns = [*batch.columns]
            columns[lang] = pa.array(named, batch.schema.field(lang).type)
            out = pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
            yield out.filter(pa.array([x != "und" for x in found]))

    if docs.isEmpty():
        return docs
    return docs.mapInArrow(run, docs.schema)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among ``docs``, scores as toxic go.

    Null and empty texts score as texts without features and so stay; repeated rows are all kept or all go; null ids are
    never labelled, but scored; without labels of both kinds nothing is learned, and only if all are toxic does everything go.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return keep_rows(docs, "text", lambda: lambda t: model.score(t) < toxicity.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with a similarity of 0.8 over shingles of five words, the one with the least id stays.

    Null ids come last; of equal ids the text with the least hash stays, of rows alike in both any one. Texts are one
    group if their sets of shingles are equal; a shorter text is one shingle; null texts and texts without words are one group.
    """
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that fill each source's budget; the last of a source may be cut to its first tokens.

    Null texts and texts without tokens are never drawn; a null source or language is a leaf of its own (``none``); null ids
    order as the empty text; repeated rows are drawn each; of one id the text with the lesser hash comes first.
    """
    return mixing.mix_documents(docs, MIX_TOTAL, max_epochs=1)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every document; null and empty texts have none, null ids and repeated rows stay."""
    return bpe.encode_texts(docs, public_tokenizers.path("word_bpe_49k.json"), cache_words=CACHE_WORDS).drop("decoded")


STAGES = [
    ("language ID", identify_language),
    ("toxicity", drop_toxic),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: The classifiers and fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each returns is written to the shared folder and read by the next.

    A stage's input is deleted once its result is written whole; the last result stays, as the returned rows are read from it.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
