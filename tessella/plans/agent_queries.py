"""Extraction mapping, the question loop over recorded verdicts, citations and answer scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import agent as A
from tessella.operators import answers as S
from tessella.operators import extraction as X
from tessella.operators.chunking import windows
from tessella.plans.registry import query
from tessella.session import spread, table


def payload_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk windows of the documents with a payload made from their first words, as a model would return it."""
    w = windows(spread(table(spark, sf_dir, "documents")))
    words = F.split("text", " ")
    first, second = F.coalesce(F.get(words, F.lit(0)), F.lit("")), F.coalesce(F.get(words, F.lit(1)), F.lit(""))
    quote = F.when(F.col("window") % 2 == 0, F.concat_ws(" ", first, second)).otherwise("not in the text at all")
    none = F.lit(None).cast("string")
    program = F.struct(
        first.alias("asset_ref"), F.lit("oncology").alias("therapeutic_area"), second.alias("indication"), F.lit("US").alias("region"), F.lit("P2").alias("stage"),
        F.lit("").alias("as_of_date"), quote.alias("evidence"),
    )
    asset = F.struct(F.when(F.col("window") % 3 == 0, first).otherwise(" ").alias("generic_name"), F.when(F.col("window") % 3 == 1, F.array(second)).otherwise(F.array().cast("array<string>")).alias("development_codes"), none.alias("company"))
    metric = F.struct(first.alias("subject_ref"), F.lit("revenue").alias("metric"), F.length("text").cast("double").alias("value"), F.lit("USD").alias("unit"), F.lit("Global").alias("geography"), quote.alias("evidence"))
    body = F.to_json(F.struct(F.array(asset).alias("assets"), F.array(program).alias("programs"), F.array(metric).alias("market_metrics")))
    return w.select(
        F.col("doc_id").cast("string").alias("document_id"), F.col("window").alias("chunk_index"), F.array().cast("array<string>").alias("section_path"),
        F.struct("start", "end").alias("line_range"), "text", F.lit("Acme").alias("source_company"), F.lit("2024-12-31").alias("as_of_date"), body.alias("payload"),
    )


_CHUNKS = r"""w0 as (select doc_id, text, unnest(range(case when length(text) <= 1500 then 1 else ceil((length(text) - 1500) / 1300.0)::bigint + 1 end)) as win from documents where text is not null),
  w as (select doc_id, win, substr(text, (win * 1300 + 1)::bigint, 1500) as t from w0), c as (select *, string_split(t, ' ')[1] as w1, coalesce(string_split(t, ' ')[2], '') as w2 from w)"""


def _slug(x: str) -> str:
    body = f"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
    return f"case when {body} = '' then 'unknown' else {body} end"


@query(
    "with " + _CHUNKS + f""" select doc_id::varchar || ':' || win || ':program:0' as id, {_slug('w1')} as asset_id, w2 as indication, '2024-12-31' as as_of_date,
      md5(case when win % 2 = 0 and w1 || ' ' || w2 <> '' and contains(t, w1 || ' ' || w2) then w1 || ' ' || w2 else substr(t, 1, 600) end) as snippet_md5 from c"""
)
def extraction_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.map_payloads(payload_chunks(spark, sf_dir))["programs"]
    return rows.select("id", "asset_id", "indication", "as_of_date", F.md5(F.col("source_ref.snippet").cast("binary")).alias("snippet_md5"))


@query(
    "with " + _CHUNKS + f""" select doc_id::varchar as document_id, win::bigint as chunk_index, case when win % 3 = 0 and trim(w1) <> '' then {_slug('w1')} else {_slug('w2')} end as id, 'Acme' as company
      from c where (win % 3 = 0 and trim(w1) <> '') or (win % 3 = 1 and trim(w2) <> '')"""
)
def extraction_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.map_payloads(payload_chunks(spark, sf_dir))["assets"]
    return rows.select("document_id", F.col("chunk_index").cast("long").alias("chunk_index"), "id", "company")


@query(
    "with " + _CHUNKS + """ select 'programs' as entity_type, count(*)::bigint as n from c union all select 'market_metrics', count(*) from c union all select 'trials', 0 union all select 'regulatory_events', 0
      union all select 'assets', count(*) from c where (win % 3 = 0 and trim(w1) <> '') or (win % 3 = 1 and trim(w2) <> '')"""
)
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.count_by_type(X.map_payloads(payload_chunks(spark, sf_dir)))


_LINES = "length(substr(text, 1, {0})) - length(replace(substr(text, 1, {0}), chr(10), '')) + 1"


@query(
    "with " + _CHUNKS.replace("select doc_id, win, substr", "select doc_id, win, text, least(win * 1300 + 1500, length(text)) as e, substr") + f""",
    a as (select doc_id::varchar as d, win, case when win % 3 = 0 then {_slug('w1')} else {_slug('w2')} end as id, case when win % 3 = 0 then w1 else '  ' || w2 end as tokens from c
      where (win % 3 = 0 and trim(w1) <> '') or (win % 3 = 1 and trim(w2) <> '')),
    names as (select id, tokens from a qualify row_number() over (partition by id order by d desc, win desc) = 1),
    u as (select 'program' as kind, c.*, concat_ws(' | ', coalesce(nullif(tokens, ''), {_slug('trim(w1)')}), nullif(w2, ''), 'US', 'P2', 'oncology') as unit from c left join names on id = {_slug('trim(w1)')}
      union all select 'market_metric', c.*, concat_ws(' | ', nullif(coalesce(nullif(tokens, ''), w1), ''), 'revenue', 'Global', length(t) || '.0 USD') from c left join names on id = w1)
    select kind, doc_id::varchar as document_id, win::bigint as chunk_index, ({_LINES.format('(win * 1300)::bigint')})::bigint as start_line,
      ({_LINES.format('greatest(e - 1, win * 1300)::bigint')})::bigint as end_line, md5(unit) as text_md5 from u"""
)
def entity_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = X.serialize_facts(X.map_payloads(payload_chunks(spark, sf_dir)))
    long = lambda c, name: F.col(c).cast("long").alias(name)
    return units.select("kind", "document_id", long("chunk_index", "chunk_index"), long("start", "start_line"), long("end", "end_line"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


_VERDICTS = """v as (select user_id as question_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, event_id,
    case when value > 60 and event_id % 5 = 0 then 'sufficient' when event_id % 11 = 0 then 'exhausted' else 'gap' end as kind from events)"""


def verdicts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events in time order, as a question's recorded verdicts."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    i = F.col("event_id")
    kind = F.when((F.col("value") > 60) & (i % 5 == 0), "sufficient").when(i % 11 == 0, "exhausted").otherwise("gap")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("question_id"), (F.row_number().over(order) - 1).alias("i"), i.alias("event_id"), kind.alias("kind"))


@query(
    "with " + _VERDICTS + """, d as (select question_id, min(case when kind <> 'gap' and i < 3 then i end) as e, max(case when i < 3 then i end) as m, count(*) as n from v group by question_id),
    s as (select d.question_id, coalesce(e, m) + 1 as used, v.kind, e is null as budget_hit, (d.question_id % 6)::int as n_evidence, (d.question_id % 4)::int as n_valid, (d.question_id % 3 // 2)::int as n_dropped from d join v on v.question_id = d.question_id and v.i = coalesce(e, m))
    select question_id, used::bigint as used, kind, budget_hit, case when budget_hit or n_evidence = 0 or n_valid = 0 then 'insufficient_evidence' when kind = 'sufficient' and n_dropped = 0 then 'answered' else 'partially_answered' end as terminal_state from s"""
)
def agent_terminal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("question_id")
    ends = A.last_verdict(verdicts_of(spark, sf_dir))
    state = A.terminal_state(F.col("budget_hit"), q % 6, q % 4, F.floor(q % 3 / 2), F.col("kind"))
    return ends.select("question_id", F.col("used").cast("long").alias("used"), "kind", "budget_hit", state.alias("terminal_state"))


@query(
    """select event_id, case when k = 'sufficient' and (slots or follow or gaps) then 'sufficient takes no further fields' when k = 'gap' and not follow then 'gap needs follow-up queries'
      when k = 'gap' and gaps then 'gap takes no gaps' when k = 'exhausted' and not gaps then 'exhausted needs gaps' when k = 'exhausted' and (slots or follow) then 'exhausted takes no gap fields'
      when k = 'maybe' then 'unknown kind' end as error
    from (select event_id, ['sufficient', 'gap', 'exhausted', 'maybe'][1 + event_id % 4] as k, event_id % 3 = 0 as slots, event_id % 5 = 0 as follow, event_id % 7 = 0 as gaps from events)"""
)
def verdict_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    some = lambda n: F.when(i % n == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    kind = F.get(F.array(*map(F.lit, ["sufficient", "gap", "exhausted", "maybe"])), (i % 4).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), some(3).alias("missing_slots"), some(5).alias("follow_ups"), some(7).alias("gaps"))
    return A.malformed(rows).select("event_id", "error")


_EVIDENCE = """e0 as (select user_id as question_id, event_type as doc_id, case when event_id % 4 = 0 then null else (event_id % 3)::bigint end as a, ts, event_id from events),
  e1 as (select *, row_number() over (partition by question_id, doc_id, a order by ts, event_id) as n from e0),
  ev as (select *, row_number() over (partition by question_id order by ts, event_id) - 1 as idx from e1 where n = 1)"""


def evidence_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    a = F.when(i % 4 != 0, (i % 3).cast("long"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("question_id"), F.col("event_type").alias("doc_id"), a.alias("start"), (a + 5).alias("end"), F.struct("ts", "event_id").alias("seq"), i.alias("event_id"))
    return A.number_evidence(rows)


@query("with " + _EVIDENCE + " select question_id, doc_id, a as start_line, idx::bigint as idx, event_id from ev")
def evidence_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence_of(spark, sf_dir).select("question_id", "doc_id", F.col("start").alias("start_line"), F.col("idx").cast("long").alias("idx"), "event_id")


@query(
    "with " + _EVIDENCE + """, c as (select distinct user_id as question_id, unnest([0, 1, 2]) as claim, unnest([0, 1, 2]) as i1, unnest([2, 0, 1]) as i2 from events)
    select c.question_id, claim::bigint as claim, a.doc_id || coalesce(':' || a.a, '') || ',' || b.doc_id || coalesce(':' || b.a, '') as cited
    from c join ev a on a.question_id = c.question_id and a.idx = i1 join ev b on b.question_id = c.question_id and b.idx = i2"""
)
def resolve_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of every user that cite two of its first three pieces of evidence."""
    ev = evidence_of(spark, sf_dir)
    enough = ev.groupBy("question_id").agg(F.count("*").alias("n")).where("n >= 3")
    claim = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("claim")
    claims = enough.select("question_id", claim).withColumn("cites", F.array("claim", F.expr("(claim + 2) % 3")))
    out = S.resolve_citations(claims, ev.withColumn("idx", F.col("idx").cast("int")))
    text = F.transform("citations", lambda s: F.concat(s["doc_id"], F.coalesce(F.concat(F.lit(":"), s["start"].cast("string")), F.lit(""))))
    return out.select("question_id", F.col("claim").cast("long").alias("claim"), F.array_join(text, ",").alias("cited"))


_ANSWERS = """q as (select o_orderkey as question_id, (o_custkey % 5)::int as r, ['answered', 'partially_answered', 'insufficient_evidence'][1 + o_custkey % 3] as expected, ['single', 'comparison'][1 + o_orderkey % 2] as construct,
    case when o_orderkey % 4 = 0 then 'insufficient_evidence' else 'answered' end as terminal_state from orders),
  cl as (select l_orderkey as question_id, l_linenumber as claim, (l_linenumber - 1)::int as topic, (l_partkey % 3 > 0) as right_value, l_suppkey % 4 as cite from lineitem),
  m as (select cl.*, cl.topic < q.r as matched, q.r from cl join q using (question_id)),
  p as (select question_id, count(*) as n_claims, count_if(matched) as n_matched, count_if(matched and cite in (1, 3)) as n_supported, sum(case when matched and cite > 0 then 1 else 0 end) as n_citations,
    count_if(matched and cite in (1, 3)) as n_faithful from m group by 1),
  rc as (select question_id, count(distinct case when matched and right_value then topic end) as n_recalled from m group by 1),
  sc as (select q.question_id, construct, q.terminal_state, q.terminal_state = expected as terminal_correct, r::bigint as n_reference, coalesce(n_recalled, 0)::bigint as n_recalled, round(coalesce(n_recalled, 0) / nullif(r, 0), 6) as recall,
    coalesce(n_claims, 0)::bigint as n_claims, coalesce(n_matched, 0)::bigint as n_matched, case when r > 0 then round(n_supported / nullif(n_matched, 0), 6) end as precision,
    case when r > 0 then round(n_faithful / nullif(n_citations, 0), 6) end as faithfulness, case when r = 0 then q.terminal_state = 'insufficient_evidence' and coalesce(n_claims, 0) = 0 end as insufficient_pass
    from q left join p using (question_id) left join rc using (question_id))"""

_TOPICS = ["alpha uptake", "bravo trials", "charlie margin", "delta reach", "echo supply", "foxtrot patents", "golf capacity"]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as questions with up to four reference claims, line items as claims; topics share no words."""
    o = table(spark, sf_dir, "orders")
    i, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda xs, k: F.get(F.array(*map(F.lit, xs)), k.cast("int"))
    questions = o.select(i.alias("question_id"), pick(["single", "comparison"], i % 2).alias("construct"), pick(["answered", "partially_answered", "insufficient_evidence"], c % 3).alias("expected_terminal_state"), (c % 5).cast("int").alias("r"))
    answers = o.select(i.alias("question_id"), F.when(i % 4 == 0, "insufficient_evidence").otherwise("answered").alias("terminal_state"))
    topic = pick(_TOPICS, F.col("t"))
    span = lambda d, a, b: F.struct(d.alias("doc_id"), a.cast("long").alias("start"), b.cast("long").alias("end"))
    refs = questions.where("r > 0").select("question_id", F.explode(F.sequence(F.lit(0), F.col("r") - 1)).alias("t"))
    refs = refs.select("question_id", F.concat(F.lit("r"), F.col("t").cast("string")).alias("ref"), topic.alias("subject"), F.lit("net sales Q1 2026").alias("attribute"), F.concat(F.lit("USD "), (F.col("t") + 1).cast("string"), F.lit(" million")).alias("value"), F.array(span(topic, F.lit(10), F.lit(12)), span(F.lit("record"), F.lit(None), F.lit(None))).alias("spans"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")  # line numbers repeat
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.row_number().over(order).alias("claim"), (F.col("l_linenumber") - 1).alias("t"), "l_partkey", "l_suppkey")
    cite = F.col("l_suppkey") % 4
    cites = F.when(cite == 1, F.array(span(topic, F.lit(5), F.lit(20)))).when(cite == 2, F.array(span(topic, F.lit(11), F.lit(30)))).when(cite == 3, F.array(span(F.lit("record"), F.lit(None), F.lit(None)))).otherwise(F.array().cast("array<struct<doc_id: string, start: bigint, end: bigint>>"))
    value = F.when(F.col("l_partkey") % 3 > 0, F.concat(F.lit("USD "), (F.col("t") + 1).cast("string"), F.lit(",000,000"))).otherwise("approved")
    claims = l.select("question_id", "claim", topic.alias("subject"), F.lit("Net sales for Q1, 2026").alias("attribute"), value.alias("value"), cites.alias("citations"))
    return S.score_answers(answers, claims, refs, questions)


@query("with " + _ANSWERS + " select * from sc")
def claim_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    keep = ["question_id", "construct", "terminal_state", "terminal_correct", *[F.col(c).cast("long").alias(c) for c in ("n_reference", "n_recalled", "n_claims", "n_matched")], "insufficient_pass"]
    return s.select(*keep, *[F.round(c, 6).alias(c) for c in ("recall", "precision", "faithfulness")])


@query(
    "with " + _ANSWERS + """ select terminal_state, construct, count(*)::bigint as questions, round(avg(terminal_correct::int), 6) as terminal_correct, round(avg(recall), 6) as recall,
      round(avg(precision), 6) as precision, round(avg(faithfulness), 6) as faithfulness from (select sc.* replace (coalesce(n_recalled, 0) / nullif(n_reference, 0) as recall) from sc) group by all"""
)
def answer_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.by_stratum(scored(spark, sf_dir))
    return s.select("terminal_state", "construct", "questions", *[F.round(c, 6).alias(c) for c in ("terminal_correct", "recall", "precision", "faithfulness")])
