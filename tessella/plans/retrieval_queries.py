"""Retrieval, fusion and recall scoring.

Units are the documents; queries the benchmark passages. Where a dense ranking is fused with a lexical one, a
query's vector is the embedding whose id is the passage's, and a unit's the one of the document's id. The lexical ranking holds
all documents, those without a query token behind the others; the dense one those with a vector. Fusions take from both what
can reach their first ten, and exact ranks of it from either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import recall as S
from tessella.operators import retrieval as R
from tessella.operators.retriever import Leg, corpus_retriever
from tessella.operators.retriever import corpus_retrieve as retrieve_corpus
from tessella.plans.registry import query
from tessella.session import checkpoint, spread, table


def units_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).where("text is not null").select(F.col("doc_id").alias("unit_id"), "text")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").where("text is not null").select(F.col("item_id").alias("query_id"), "text")


def _lexical(units: str, p: str = "") -> str:
    """CTEs, their names begun with ``p``, up to ``bm25``: the lexical ranking of all ``units`` (a query of unit_id, text) for the passages."""
    return rf"""{p}tok as (select unit_id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9\-/()]*')) as token from ({units})),
  {p}tf as (select unit_id, token, count(*) as tf from {p}tok group by all), {p}sz as (select unit_id, sum(tf) as size from {p}tf group by 1),
  {p}n as (select count(*) as n from ({units})), {p}mean as (select (select sum(size) from {p}sz) / n as m from {p}n),
  {p}df as (select token, count(*) as df from {p}tf group by 1), {p}raw as (select token, df, ln(n - df + 0.5) - ln(df + 0.5) as raw from {p}df, {p}n),
  {p}idf as (select token, df, case when raw < 0 then 0.25 * (select avg(raw) from {p}raw) else raw end as idf from {p}raw),
  {p}qt as (select item_id as query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9\-/()]*')) as token from benchmark where text is not null),
  {p}q as (select query_id, token, count(*) as qn from {p}qt group by all),
  {p}hit as (select query_id, t.unit_id, round(sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / m))), 9) as score
    from {p}q join {p}idf using (token) join {p}tf t using (token) join {p}sz using (unit_id), {p}mean group by all),
  {p}bm as (select b.item_id as query_id, u.unit_id, coalesce(h.score, 0) as score from benchmark b join ({units}) u on b.text is not null
    left join {p}hit h on h.query_id = b.item_id and h.unit_id = u.unit_id),
  {p}bm25 as (select *, row_number() over (partition by query_id order by score desc, unit_id) as rank from {p}bm)"""


def _dense(units: str, p: str = "") -> str:
    """The same up to ``dense``: the ranking by cosine of the units that have a vector."""
    return f"""{p}e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
  {p}cs as (select a.vec_id as query_id, u.vec_id as unit_id, round(list_cosine_similarity(u.v, a.v), 9) as score
    from {p}e a join {p}e u on a.vec_id in (select item_id from benchmark) and u.vec_id in (select unit_id from ({units}))),
  {p}dense as (select *, row_number() over (partition by query_id order by score desc, unit_id) as rank from {p}cs)"""


_DOCUMENTS = "select doc_id as unit_id, text from documents where text is not null"
_PASSAGES = "select item_id as unit_id, text from benchmark where text is not null"
_BM25, _DENSE = _lexical(_DOCUMENTS), _dense(_DOCUMENTS)
_FUSED = "with " + _BM25 + ", " + _DENSE + """,
  legs as (select 0 as leg, query_id, unit_id, rank from dense union all select 1, query_id, unit_id, rank from bm25)"""
_SPANS = _FUSED + """, spanned as (select *, unit_id // 3 as doc_id, (unit_id % 3) // 2 * 10 + 1 as start_line, (unit_id % 3) // 2 * 10 + 10 as end_line from legs)"""


@query("with " + _BM25 + " select token, count(*)::bigint as n, count(distinct unit_id)::bigint as units from tok group by token")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = R.term_counts(units_of(spark, sf_dir))
    return counts.groupBy("token").agg(F.sum("tf").alias("n"), F.count("*").alias("units"))


@query("with " + _BM25 + " select token, df::bigint as df, round(idf, 6) as idf from idf")
def bm25_vocab_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = units_of(spark, sf_dir)
    found = R.idf(R.term_counts(units), units.count())
    return found.select("token", "df", F.round("idf", 6).alias("idf"))


@query("with " + _BM25 + " select query_id, unit_id, round(score, 6) as score, rank::bigint as rank from bm25 where rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.bm25(units_of(spark, sf_dir), passages(spark, sf_dir), k=10)
    return found.select("query_id", "unit_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_KNN = """with e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings),
  s as (select q.vec_id as query_id, q.label as own, u.vec_id as unit_id, u.label, round(list_cosine_similarity(u.v, q.v), 9) as score
    from e q join e u on q.vec_id % 100 = 0 and u.vec_id <> q.vec_id),
  r as (select *, row_number() over (partition by query_id order by score desc, unit_id) as rank from s)"""


def _neighbours(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    units = e.select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("vector"))
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return R.cosine_ranks(units, asked, k)


@query(_KNN + " select query_id, unit_id, round(score, 6) as score, rank::bigint as rank from r where rank <= 10")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _neighbours(spark, sf_dir, 10)
    return found.select("query_id", "unit_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    _KNN + """, v as (select query_id, own, label, count(*) as n from r where rank <= 9 group by all),
    w as (select *, row_number() over (partition by query_id order by n desc, label) as best from v)
    select query_id, own::bigint as own_label, label::bigint as knn_label, n::bigint as votes from w where best = 1"""
)
def dense_label_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    votes = _neighbours(spark, sf_dir, 9).join(labels.withColumnRenamed("vec_id", "unit_id"), "unit_id").groupBy("query_id", "label").agg(F.count("*").alias("n"))
    best = votes.groupBy("query_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "label")).alias("b"))
    own = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own_label"))
    return best.join(own, "query_id").select("query_id", "own_label", F.col("b.label").alias("knn_label"), (-F.col("b.m")).alias("votes"))


class Legs:
    """The dense and the lexical ranking of documents for the passages."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("vector"))
        self.units, self.queries = units_of(spark, sf_dir), passages(spark, sf_dir)
        self.vectors = vectors.join(self.units.select("unit_id"), "unit_id", "left_semi")
        self.asked = vectors.withColumnRenamed("unit_id", "query_id").join(self.queries.select("query_id"), "query_id", "left_semi")
        self.lexical = R.Lexical(self.units, self.queries)

    def top(self, k: int) -> DataFrame:
        """``leg, query_id, unit_id, rank``: the first k of either leg."""
        cols = ["query_id", "unit_id", "rank"]
        dense = R.cosine_ranks(self.vectors, self.asked, k, itself=True).select(F.lit(0).alias("leg"), *cols)
        return checkpoint(dense.unionByName(self.lexical.top(k).select(F.lit(1).alias("leg"), *cols)))

    def ranks(self, pairs: DataFrame) -> DataFrame:
        """``leg, query_id, unit_id, rank`` of the pairs in either leg; a document without a vector has none in the dense one."""
        pairs, cols = checkpoint(pairs), ["query_id", "unit_id", "rank"]
        dense = R.cosine_rank_of(self.vectors, self.asked, pairs).select(F.lit(0).alias("leg"), *cols)
        return checkpoint(dense.unionByName(self.lexical.ranks(pairs).select(F.lit(1).alias("leg"), *cols)))


def with_span(rows: DataFrame) -> DataFrame:
    """Units stand at spans that some share: three units to a document, two of them at one place."""
    place = F.floor(F.col("unit_id") % 3 / 2) * 10
    return rows.withColumns({"doc_id": F.floor(F.col("unit_id") / 3).cast("long"), "start": (place + 1).cast("long"), "end": (place + 10).cast("long")})


def span_legs(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """Both legs' ranks of all units at spans that can be among the first k of their fusion."""
    legs = Legs(spark, sf_dir)
    span = ["doc_id", "start", "end"]
    near = with_span(legs.top(R.depth_for(k))).select("query_id", *span).distinct()
    return with_span(legs.ranks(near.join(with_span(legs.units.select("unit_id")), span).select("query_id", "unit_id")))


@query(
    _FUSED + """, f as (select query_id, unit_id, round(sum(1.0 / (60 + rank)), 12) as score, min(leg * 1000000000 + rank) as seen from legs group by all),
    r as (select *, row_number() over (partition by query_id order by score desc, seen) as rank from f)
    select query_id, unit_id, round(score, 6) as score, rank::bigint as rank from r where rank <= 10"""
)
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = Legs(spark, sf_dir)
    legs = both.ranks(both.top(R.depth_for(10)).select("query_id", "unit_id"))
    found = R.rrf([legs.where("leg = 0"), legs.where("leg = 1")], k=10)
    return found.select("query_id", "unit_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_SPAN_RRF = _SPANS + """, best as (select query_id, doc_id, start_line, end_line, leg, min(rank) as rank, arg_min(unit_id, rank) as unit_id from spanned group by query_id, doc_id, start_line, end_line, leg),
    fused as (select query_id, doc_id, start_line, end_line, round(sum(1.0 / (60 + rank)), 12) as score, min(leg * 1000000000 + rank) as seen,
      arg_min(unit_id, leg * 1000000000 + rank) as unit_id from best group by query_id, doc_id, start_line, end_line),
    span_ranked as (select *, row_number() over (partition by query_id order by score desc, seen) as rank from fused)"""


@query(_SPAN_RRF + " select query_id, doc_id, start_line, end_line, unit_id, round(score, 6) as score, rank::bigint as rank from span_ranked where rank <= 10")
def span_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = R.span_rrf(span_legs(spark, sf_dir), 10)
    return f.select(
        "query_id", "doc_id", F.col("start").alias("start_line"), F.col("end").alias("end_line"), "unit_id",
        F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"),
    )


@query(
    _SPANS + """, r as (select *, row_number() over (partition by query_id order by round(1.0 / (60 + rank), 12) desc, leg, rank) as fused from spanned)
    select query_id, leg::bigint as leg, unit_id, rank::bigint as rank, fused::bigint as fused_rank from r where fused <= 10"""
)
def naive_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = R.naive_rrf(with_span(Legs(spark, sf_dir).top(10)), 10)
    return f.select("query_id", *[F.col(c).cast("long").alias(c) for c in ("leg", "unit_id", "rank", "fused_rank")])


_UNION = _SPAN_RRF + """, two as (select query_id, doc_id, start_line, end_line, 0 as l, rank from spanned where leg = 0 and rank <= 10
      union all select query_id, doc_id, start_line, end_line, 1, rank from span_ranked where rank <= 10),
    kept as (select * from two qualify row_number() over (partition by query_id, doc_id, start_line, end_line order by l, rank) = 1),
    united as (select *, row_number() over (partition by query_id order by l, rank) - 1 as pos from kept)"""


def united(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = span_legs(spark, sf_dir)
    cols = ["query_id", "doc_id", "start", "end", "rank"]
    return checkpoint(R.corpus_union(legs.where("leg = 0").select(*cols), R.span_rrf(legs, 10).select(*cols)))


@query(_UNION + " select query_id, doc_id, start_line, end_line, pos::bigint as pos from united")
def corpus_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return united(spark, sf_dir).select("query_id", "doc_id", F.col("start").alias("start_line"), F.col("end").alias("end_line"), F.col("pos").cast("long").alias("pos"))


_RETRIEVED = (
    "with " + _BM25 + ", " + _DENSE + ", " + _lexical(_PASSAGES, "f_") + ", " + _dense(_PASSAGES, "f_") + """,
    listed as (select 0 as l, 0 as list, query_id, unit_id, rank from dense union all select 0, 1, query_id, unit_id, rank from bm25
      union all select 1, 0, query_id, unit_id, rank from f_dense union all select 1, 1, query_id, unit_id, rank from f_bm25),
    summed as (select l, query_id, unit_id, round(sum(1.0 / (60 + rank)), 12) as score, min(list * 1000000000 + rank) as seen from listed group by all),
    placed as (select l, query_id, unit_id, unit_id // 3 as doc_id, (unit_id % 3) // 2 * 10 + 1 as start_line, (unit_id % 3) // 2 * 10 + 10 as end_line,
      row_number() over (partition by l, query_id order by score desc, seen) as rank from summed),
    first_ as (select query_id, doc_id, start_line, end_line, l, min(rank) as rank from placed group by all),
    both_ as (select query_id, doc_id, start_line, end_line, round(sum(1.0 / (60 + rank)), 12) as score, min(l * 1000000000 + rank) as seen from first_ group by all),
    spans as (select *, row_number() over (partition by query_id order by score desc, seen) as rank from both_),
    two as (select query_id, doc_id, start_line, end_line, 0 as l, rank from placed where l = 0 and rank <= 10
      union all select query_id, doc_id, start_line, end_line, 1, rank from spans where rank <= 10),
    kept as (select * from two qualify row_number() over (partition by query_id, doc_id, start_line, end_line order by l, rank) = 1),
    texts as (select query_id, p.doc_id, start_line, end_line, coalesce(arg_max(d.text, rank) filter (where l = 0), arg_min(b.text, rank) filter (where l = 1)) as text
      from placed p left join documents d on l = 0 and d.doc_id = unit_id left join benchmark b on l = 1 and b.item_id = unit_id group by query_id, p.doc_id, start_line, end_line),
    found as (select query_id, doc_id, start_line, end_line, row_number() over (partition by query_id order by l, rank) - 1 as pos, text
      from kept join texts using (query_id, doc_id, start_line, end_line))"""
)


def corpus_legs(spark: SparkSession, sf_dir: str) -> tuple[Leg, Leg, DataFrame]:
    """A leg over the documents, one over the passages (in the place of facts), and the passages with their vectors as queries."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("vector"))
    facts = checkpoint(passages(spark, sf_dir).withColumnRenamed("query_id", "unit_id").join(vectors, "unit_id", "left"))
    chunks = Leg(with_span(units_of(spark, sf_dir)), vectors)
    return chunks, Leg(with_span(facts)), facts.withColumnRenamed("unit_id", "query_id")


@query(_RETRIEVED + " select query_id, pos::bigint as pos, doc_id, start_line, end_line, md5(text) as text_md5 from found")
def corpus_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, facts, asked = corpus_legs(spark, sf_dir)
    return retrieve_corpus(chunks, facts, asked).select(
        "query_id", F.col("pos").cast("long").alias("pos"), "doc_id", F.col("start").alias("start_line"), F.col("end").alias("end_line"), F.md5("text").alias("text_md5")
    )


@query(
    _RETRIEVED + """, asked as (select item_id as question_id, 0 as sub, item_id as query_id from benchmark where text is not null
      union all select item_id, 1, item_id + 1 from benchmark where text is not null and item_id + 1 in (select item_id from benchmark where text is not null)),
    every_ as (select question_id, doc_id, start_line, end_line, sub, pos, text from asked join found using (query_id)),
    once as (select * from every_ qualify row_number() over (partition by question_id, doc_id, start_line, end_line order by sub, pos) = 1)
    select question_id, (row_number() over (partition by question_id order by sub, pos) - 1)::bigint as pos, doc_id, start_line, end_line, md5(text) as text_md5 from once"""
)
def question_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence for each question, which asks its passage and the next one."""
    chunks, facts, asked = corpus_legs(spark, sf_dir)
    own = asked.select(F.col("query_id").alias("question_id"), F.col("text").alias("own"))
    after = asked.select((F.col("query_id") - 1).alias("question_id"), F.col("text").alias("next"))
    plans = own.join(after, "question_id", "left").select("question_id", F.array_compact(F.array("own", "next")).alias("queries"))
    known = asked.groupBy("text").agg(F.min_by("vector", "query_id").alias("vector"))
    found = corpus_retriever(chunks, facts, lambda rows: rows.join(known, "text", "left"))(plans)
    return found.select(
        "question_id", F.col("pos").cast("long").alias("pos"), "doc_id", F.col("start").alias("start_line"), F.col("end").alias("end_line"), F.md5("text").alias("text_md5")
    )


_GOLD = _UNION + """, gold as (select u.query_id, 1 + (u.query_id + d.k) % 5 as member, u.doc_id, 3 + d.k as a, 8 + 2 * d.k as b,
      case when d.k % 3 = 2 then 'resolution_limited' else 'clean' end as resolution, d.k as span_id,
      case u.query_id % 3 when 0 then 'single' when 1 then 'set-of-singles' else 'aggregate' end as construct, case when d.k % 2 = 0 then 'extracted' else 'mixed' end as slice
    from (select query_id, doc_id from united where pos in (0, 4, 11)) u, (select unnest([0, 1, 2, 3]) as k) d)"""


def gold_spans(found: DataFrame) -> DataFrame:
    """Spans to be found: four in each of some documents of a query's retrieval (as from ``united``)."""
    some = found.where(F.col("pos").isin(0, 4, 11)).select("query_id", "doc_id")
    k = F.explode(F.array(*[F.lit(i).cast("long") for i in range(4)])).alias("span_id")
    q, d = F.col("query_id"), F.col("span_id")
    return some.select("query_id", "doc_id", k).select(
        "query_id", "doc_id", "span_id", (1 + (q + d) % 5).alias("member"), (3 + d).alias("a"), (8 + 2 * d).alias("b"),
        F.when(d % 3 == 2, "resolution_limited").otherwise("clean").alias("resolution"),
        F.when(q % 3 == 0, "single").when(q % 3 == 1, "set-of-singles").otherwise("aggregate").alias("construct"),
        F.when(d % 2 == 0, "extracted").otherwise("mixed").alias("slice"),
    )


@query(
    _GOLD + """ select g.query_id, g.doc_id, g.span_id::bigint as span_id, min(case when start_line <= a and b <= end_line then pos + 1 end)::bigint as rank
      from gold g left join united u using (query_id, doc_id) group by all"""
)
def containing_chunk_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = united(spark, sf_dir)
    ranks = both.withColumn("rank", F.col("pos") + 1)
    spans = gold_spans(both).withColumn("key", F.struct("doc_id", "span_id"))
    found = R.containing_rank(ranks, spans.select("query_id", "doc_id", F.col("key").alias("span_id"), "a", "b"))
    return found.select("query_id", "span_id.doc_id", F.col("span_id.span_id").alias("span_id"), F.col("rank").cast("long").alias("rank"))


_COVER = _GOLD + """, ks as (select unnest([1, 3, 5, 10]) as k),
    cov as (select k, g.*, coalesce(max(case when pos < k then greatest(0, least(b, end_line) - greatest(a, start_line) + 1)::double / (b - a + 1) end), 0) as best
      from ks, gold g left join united u using (query_id, doc_id) group by all),
    facts as (select k, query_id, construct, doc_id, member, max(slice) as slice, bool_or(best >= 0.5 and resolution = 'clean') as hit,
      bool_or(best >= 0.5 and resolution <> 'clean') as rl_hit from cov group by k, query_id, construct, doc_id, member)"""


@query(
    _COVER + """ select k::bigint as k, query_id, construct, count(*)::bigint as n_total, count_if(hit)::bigint as n_hit, count_if(rl_hit)::bigint as n_rl,
      round(count_if(hit) / count(*), 6) as recall from facts group by k, query_id, construct"""
)
def containment_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = united(spark, sf_dir)
    facts = S.facts_hit(S.span_coverage(found, gold_spans(found), [1, 3, 5, 10]))
    return S.query_recall(facts)


@query(
    _COVER + """ select k::bigint as k, count_if(best >= 0.99)::bigint as full_, count_if(best <= 0.01)::bigint as none_,
      count_if(best > 0.01 and best < 0.99)::bigint as part_, count_if((best >= 0.5) <> (best >= 0.99))::bigint as t_dependent from cov group by k"""
)
def containment_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = united(spark, sf_dir)
    return S.containment_histogram(S.span_coverage(found, gold_spans(found), [1, 3, 5, 10]))


@query(
    _COVER + """, per as (select k, query_id, construct, slice, avg(hit::int) as r from facts group by all)
    select k::bigint as k, construct, slice, round(avg(r), 6) as recall, count(*)::bigint as queries from per group by grouping sets ((k), (k, construct), (k, slice))"""
)
def recall_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = united(spark, sf_dir)
    return S.macro_recall(S.facts_hit(S.span_coverage(found, gold_spans(found), [1, 3, 5, 10])))


@query(
    _SPANS + """, s as (select query_id, leg, min(rank) filter (where (unit_id + query_id) % 50 = 0) as best from spanned group by all)
    select query_id, max(case when leg = 0 then best end)::bigint as dense_rank, max(case when leg = 1 then best end)::bigint as lexical_rank,
      (max(case when leg = 0 then best end) - max(case when leg = 1 then best end))::bigint as delta from s group by query_id"""
)
def leg_rank_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = Legs(spark, sf_dir)
    at = lambda c: F.col(c) % 50
    asked = legs.queries.select("query_id", F.pmod(-F.col("query_id"), F.lit(50)).alias("at"))
    pairs = legs.units.select("unit_id", at("unit_id").alias("at")).join(asked, "at").select("query_id", "unit_id")
    return S.leg_deltas(legs.ranks(pairs), legs.queries.select("query_id").distinct())


@query(r"select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g'))[1:160] as snippet from documents where text is not null")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).where("text is not null").select("doc_id", R.snippet(F.col("text"), 160).alias("snippet"))


@query(
    """select label, case when label is null or label = '' then 'none' when lower(trim(label)) like 'set-of-singles%' then 'set-of-singles'
      when lower(trim(label)) like 'single%' then 'single' when lower(trim(label)) like 'comparison%' then 'comparison'
      when lower(trim(label)) like 'aggregate%' then 'aggregate' else lower(trim(label)) end as construct
    from (select distinct case p_size % 6 when 0 then ' Single (' || p_brand || ')' when 1 then 'set-of-singles' when 2 then 'Comparison ' || p_brand
      when 3 then 'aggregate' when 4 then '' else 'SET_OF_SINGLES' end as label from part)"""
)
def construct_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, b = F.col("p_size") % 6, F.col("p_brand")
    label = F.when(n == 0, F.concat(F.lit(" Single ("), b, F.lit(")"))).when(n == 1, "set-of-singles").when(n == 2, F.concat(F.lit("Comparison "), b))
    label = label.when(n == 3, "aggregate").when(n == 4, "").otherwise("SET_OF_SINGLES")
    return table(spark, sf_dir, "part").select(label.alias("label")).distinct().withColumn("construct", T.construct_of(F.col("label")))
