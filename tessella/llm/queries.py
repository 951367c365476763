"""The thin opN queries over the synthetic tables, and the oracles of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, chat, language, licenses, media, mixing, packing, simhash, topk, toxicity
from tessella.llm.common import fold
from tessella.session import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(spread(table(spark, sf_dir, "documents"))).drop("media")


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("word_bpe_49k.json"))


@query
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    model = language.fit(docs, where=fold("doc_id", 5) != 0)
    rows = language.identify(docs, model)
    return rows.withColumn("held_out", fold("doc_id", 5) == 0)


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.groups(spread(table(spark, sf_dir, "documents")), shingle=4, words=1, radius=4)
    return rows.select("doc_id", simhash.hex_of(rows["fp"]).alias("fingerprint"), "component_id")


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), where=fold("doc_id", 3) != 1)
    return toxicity.score(docs, model).withColumn("held_out", fold("doc_id", 3) == 1)


#: Of the tokens there are, the part that the mix is to hold.
MIX_TOTAL = 0.6


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spread(table(spark, sf_dir, "documents")), MIX_TOTAL)


ORACLES["op5_mixing"] = mixing.oracle(MIX_TOTAL)


@query
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(spread(table(spark, sf_dir, "documents"))).drop("matches")


@query
def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    tricky = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(table(spark, sf_dir, "conversations").select(*columns).unionByName(more))
    read = chat.parse_chats(chats).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLES["op10_chat"] = r"""
with t0 as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t as (select *, lag(role) over (partition by conv_id order by turn nulls first, role, text) is distinct from role as opens from t0)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn nulls first, role, text)) as loss_sha256,
  sum(2 * length(text) - length(regexp_replace(text, '[\\#<]', '', 'g')) + 8
    + case when opens then 2 * length(role) - length(regexp_replace(role, '[\\#<]', '', 'g')) + 9 else 0 end)::bigint as formatted_chars
from t group by conv_id"""


@query
def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.quantized(table(spark, sf_dir, "embeddings"))
    return topk.top_k(rows, F.col("vec_id") % 100 == 0, k=10)


ORACLES["op3_topk"] = """
with v as (select distinct vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
p as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v))
select query_id, rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from p) where rank <= 10"""


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_texts(
        spread(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return packed.withColumn("ids_sha256", F.sha2("ids", 256)).drop("ids")
