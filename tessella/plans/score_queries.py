"""Alignment of facts of every type, document scores and their further grains.

Facts are the orders of a customer (the document): golden ones have odd order keys, predictions even ones. Both come from one
generator, in Spark and in SQL, with wordier, upper-case and missing texts, sub-phases, aliases and restatements among the predictions.
Among these texts two are similar exactly if they are equal in canonical form, so SQL can settle them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella import schemas
from tessella.operators import agent as A
from tessella.operators import grounding as G
from tessella.operators import matching as M
from tessella.operators import recall as S
from tessella.operators import scoring as D
from tessella.plans.registry import query
from tessella.session import table

_DISEASES = ["alpha beta syndrome", "gamma delta disease", "epsilon carcinoma", "zeta fibrosis type"]
_NAMES = ["HORIZON", "ORBITAL", "MERIDIAN", "CASCADE", "ZENITH"]
_SUBJECTS = ["Acme Pharma", "Borealis", "Cygnus Labs"]
_AREAS = ["oncology", "immunology", "cardiology"]
#: Which lines the chunks of a document have; the first two are labelled in odd documents, the first and the last in even ones.
_CHUNKS = [(1, 10), (11, 20), (21, 30)]


def _pick(xs: list, k: Column) -> Column:
    return F.get(F.array(*map(F.lit, xs)), (k % len(xs)).cast("int"))


def facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(predicted, golden) facts with the columns of all types."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    i, odd = F.floor(k / 2).cast("long"), k % 2
    golden = odd == 1
    disease = _pick(_DISEASES, i)
    seen = F.when(golden, disease).when(i % 7 == 0, "not specified").when(i % 7 == 1, F.concat(disease, F.lit(" in severe adults"))).when(i % 7 == 2, F.upper(disease)).otherwise(disease)
    asset, kind, chunk = F.concat(F.lit("asset-"), (i % 3).cast("string")), i % 3, k % 3
    subject = _pick(_SUBJECTS, i)
    rows = o.select(
        F.col("o_custkey").alias("doc_id"), k.alias("o_orderkey"), (1 + 10 * chunk).alias("start"), (10 + 10 * chunk).alias("end"),
        F.concat(F.lit("seen "), F.repeat(F.lit("x"), (i % 200).cast("int"))).alias("snippet"),
        asset.alias("asset"), asset.alias("asset_name"), F.array(asset).alias("assets"), F.array(asset).alias("slugs"),
        seen.alias("indication"), _pick(["US", "EU"], i).alias("region"), _pick(["P2", "P2a", "P3"], i + odd).alias("stage"), _pick(["approval", "filed"], i + odd).alias("action"),
        F.when(~golden & (i % 5 == 0), "MHLW").otherwise(_pick(["FDA", "PMDA", "EMA"], i)).alias("agency"),
        F.when(kind == 0, F.when(odd == 1, "2").otherwise("2b")).when(kind == 1, "1").otherwise("3").alias("phase"),
        F.when(kind == 0, F.concat(F.lit("NCT"), (i % 6).cast("string"))).alias("nct_id"), F.when(kind == 1, _pick(_NAMES, i)).alias("trial_name"),
        F.when(golden, i % 2 == 0).otherwise((i % 2 == 0) != (i % 5 == 0)).alias("met_primary_endpoint"),
        F.when(golden, subject).when(i % 7 == 0, "N/A").when(i % 7 == 2, F.upper(subject)).otherwise(subject).alias("subject"),
        _pick(["revenue", "growth_rate"], i).alias("metric"),
        F.when(golden, _pick(["Global", "US"], F.floor(i / 2))).otherwise(_pick(["worldwide", "United States"], F.floor(i / 2))).alias("geography"),
        ((100 + i % 50) * F.when(golden | (i % 3 == 2), 1.0).when(i % 3 == 0, 1.01).otherwise(1.5)).alias("value"),
        F.when(golden, "million").otherwise("mn").alias("unit"),
        F.when(golden, F.when(i % 4 != 0, "Q1 2024")).when(i % 3 == 0, "not stated").when(i % 3 == 1, "q1 2024").otherwise("Q2 2024").alias("period"),
        F.when(golden, _pick(_AREAS, i)).otherwise(_pick(_AREAS, F.when(i % 4 == 0, i + 1).otherwise(i))).alias("therapeutic_area"),
        F.lit("Q1 2024").alias("reporting_period"), (i % 4 == 0).alias("from_progress_row"),
    )
    order = Window.partitionBy("doc_id").orderBy("o_orderkey")
    number = lambda r: r.withColumn("n", F.row_number().over(order).cast("long")).drop("o_orderkey")
    return number(rows.where("o_orderkey % 2 = 0")).drop("reporting_period"), number(rows.where("o_orderkey % 2 = 1"))


def labelled(golden: DataFrame) -> DataFrame:
    """The labelled chunks of each document, and the golden facts in them."""
    own = F.array(*[F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end"), F.lit(i).alias("i")) for i, (a, b) in enumerate(_CHUNKS)])
    every = golden.select("doc_id").distinct().select("doc_id", F.inline(own))
    return every.where("i = 0 or i = 2 - doc_id % 2").drop("i")


def _list(xs: list[str], k: str) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + f"][1 + ({k}) % {len(xs)}]"


_FACTS = f"""o as (select o_custkey as doc_id, o_orderkey, o_orderkey // 2 as i, o_orderkey % 2 as odd, 1 + 10 * (o_orderkey % 3) as start_, 10 + 10 * (o_orderkey % 3) as end_ from orders),
  b as (select *, {_list(_DISEASES, 'i')} as disease, {_list(_SUBJECTS, 'i')} as company, 'asset-' || (i % 3) as asset from o),
  f as (select *, case when odd = 1 then disease when i % 7 = 0 then 'not specified' when i % 7 = 1 then disease || ' in severe adults' when i % 7 = 2 then upper(disease) else disease end as indication,
    {_list(['US', 'EU'], 'i')} as region, {_list(['P2', 'P2a', 'P3'], 'i + odd')} as stage, {_list(['approval', 'filed'], 'i + odd')} as action,
    case when odd = 0 and i % 5 = 0 then 'MHLW' else {_list(['FDA', 'PMDA', 'EMA'], 'i')} end as agency,
    case i % 3 when 0 then case odd when 1 then '2' else '2b' end when 1 then '1' else '3' end as phase,
    case when i % 3 = 0 then 'NCT' || (i % 6) end as nct_id, case when i % 3 = 1 then {_list(_NAMES, 'i')} end as trial_name,
    case when odd = 1 then i % 2 = 0 else (i % 2 = 0) <> (i % 5 = 0) end as met,
    case when odd = 1 then company when i % 7 = 0 then 'N/A' when i % 7 = 2 then upper(company) else company end as subject, {_list(['revenue', 'growth_rate'], 'i')} as metric,
    case when odd = 1 then {_list(['Global', 'US'], 'i // 2')} else {_list(['worldwide', 'United States'], 'i // 2')} end as geography,
    (100 + i % 50) * case when odd = 1 or i % 3 = 2 then 1.0 when i % 3 = 0 then 1.01 else 1.5 end::double as value,
    case when odd = 1 then case when i % 4 <> 0 then 'Q1 2024' end when i % 3 = 0 then 'not stated' when i % 3 = 1 then 'q1 2024' else 'Q2 2024' end as period,
    case when odd = 1 or i % 4 <> 0 then {_list(_AREAS, 'i')} else {_list(_AREAS, 'i + 1')} end as area, 'seen ' || repeat('x', (i % 200)::int) as snippet from b),
  t as (select *, lower(indication) as term, case stage when 'P2a' then 'P2' else stage end as stage_c, left(phase, 1) as phase_c,
    case i % 3 when 0 then nct_id when 1 then trial_name else asset || lower(indication) end as trial_key, lower(subject) as subject_c, (i // 2) % 2 as place,
    row_number() over (partition by doc_id, odd order by o_orderkey) as n from f),
  labels as (select distinct doc_id, unnest(case when doc_id % 2 = 1 then [1, 11] else [1, 21] end) as start_ from t where odd = 1)"""
#: By type: what makes two facts the same, what they must share for a wordier text to count, and for a restatement; when a key is incomplete.
_RULES = {
    "programs": ("asset, region, stage_c, term", "asset, region, stage_c", "asset, stage_c", "p.term = 'not specified'"),
    "regulatory_events": ("asset, region, action, term", "asset, region, action", "asset, action", "p.term = 'not specified'"),
    "trials": ("i3, phase_c, trial_key", "i3, asset, phase_c", "", "p.term = 'not specified' and p.i3 = 2"),
    "market_metrics": ("metric, subject_c, place", "", "", "p.subject_c = 'n/a'"),
}


def _outcomes(kind: str, scoped: bool = False) -> str:
    """CTEs g, p, pairs and outcome of a type; with ``scoped`` predictions only of labelled chunks, and each fact once."""
    key, sans, again, incomplete = _RULES[kind]
    on = lambda names: " and ".join(f"b.{x} = p.{x}" for x in names.split(", ")) if names else "false"
    once = f" qualify row_number() over (partition by doc_id, {key} order by n) = 1" if scoped else ""
    where = " and (doc_id, start_) in (select doc_id, start_ from labels)" if scoped else ""
    named = " and not (p.i3 = 1 and b.i3 = 1)" if kind == "trials" else ""
    return f"""{_FACTS}, u as (select *, i % 3 as i3 from t), g as (select * from u where odd = 1{once}), p as (select * from u where odd = 0{where}{once}),
    gm as (select *, row_number() over (partition by doc_id, {key} order by n) as m from g), pm as (select *, row_number() over (partition by doc_id, {key} order by n) as m from p),
    pairs as (select b.doc_id, b.n as g, p.n as p from gm b join pm p on b.doc_id = p.doc_id and b.m = p.m and {on(key)}),
    miss as (select * from g where (doc_id, n) not in (select doc_id, g from pairs)), found as (select * from g where (doc_id, n) in (select doc_id, g from pairs)),
    rest as (select p.doc_id, p.n, {incomplete} as incomplete,
      exists (select 1 from miss b where b.doc_id = p.doc_id and {on(sans)}{named} and p.term = b.term || ' in severe adults') as wordier,
      exists (select 1 from found b where b.doc_id = p.doc_id and {on(again)} and p.term in (b.term, b.term || ' in severe adults')) as repeated
      from p where (doc_id, n) not in (select doc_id, p from pairs)),
    outcome as (select doc_id, 'golden' as side, n, 'tp' as outcome from found union all select doc_id, 'golden', n, 'miss' from miss
      union all select doc_id, 'predicted', p, 'matched' from pairs
      union all select doc_id, 'predicted', n, case when incomplete then 'key_incomplete' when wordier then 'indication_verbose' when repeated then 'restatement' else 'false_positive' end from rest)"""


def _aligned(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    predicted, golden = facts(spark, sf_dir)
    return M.outcomes(predicted, golden, M.greedy_pairs(M.candidates(predicted, golden, kind)), kind)


_ALL = " select doc_id, side, n::bigint as n, outcome from outcome"


@query("with " + _outcomes("programs") + _ALL)
def fact_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir, "programs")


@query("with " + _outcomes("regulatory_events") + _ALL)
def event_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir, "regulatory_events")


@query("with " + _outcomes("trials") + _ALL)
def trial_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir, "trials")


@query("with " + _outcomes("market_metrics") + _ALL)
def metric_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir, "market_metrics")


def scored(spark: SparkSession, sf_dir: str, kind: str) -> D.Scored:
    predicted, golden = facts(spark, sf_dir)
    return D.score(predicted, golden, labelled(golden), kind)


_COUNTS = """, c as (select doc_id, count_if(outcome = 'tp') as tp, count_if(outcome = 'false_positive') as fp, count_if(outcome = 'miss') as fn, count_if(outcome = 'key_incomplete') as ki,
    count_if(outcome = 'indication_verbose') as iv, count_if(outcome = 'restatement') as rst from outcome group by doc_id)
  select doc_id, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, ki::bigint as ki, iv::bigint as iv, rst::bigint as rst, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision,
    round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from c"""


@query("with " + _outcomes("programs", scoped=True) + _COUNTS)
def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs of each document: scoped to its labelled chunks, collapsed, aligned and counted."""
    s = M.prf(scored(spark, sf_dir, "programs").outcomes, ["doc_id"])
    return s.select("doc_id", "tp", "fp", "fn", "ki", "iv", "rst", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


_EVENT = "asset || ' | ' || action || ' | ' || region || ' | ' || indication || ' | agency=' || agency"
_METRIC = "subject || ' | ' || metric || ' | ' || geography || ' | ' || case when value = floor(value) then value::bigint::varchar || '.0' else value::varchar end || ' ' || case odd when 1 then 'million' else 'mn' end || ' | period=' || coalesce(period, 'None')"


def _items_sql(kind: str, summary: str, errors: str) -> str:
    return "with " + _outcomes(kind, scoped=True) + f"""
    select doc_id, 'miss' as kind, '{kind}' as entity_type, {summary} as summary, (start_ + n % 3)::bigint as start_line, (start_ + n % 3)::bigint as end_line, 'line ' || n as snippet, '' as detail from miss
    union all select doc_id, outcome, '{kind}', {summary}, start_::bigint, end_::bigint, left(snippet, 160),
      case outcome when 'indication_verbose' then 'right disease + extra qualifiers (no schema population/setting field)'
        when 'restatement' then 'cross-chunk duplicate of a captured fact (inconsistent region) — census artifact' else '' end
      from p join outcome using (doc_id, n) where side = 'predicted' and outcome <> 'matched'
    union all select doc_id, 'attribute_error', '{kind}', (select {summary} from g where g.doc_id = e.doc_id and g.n = e.g), start_::bigint, end_::bigint, left(snippet, 120), attribute
      from (select pairs.doc_id, pairs.g, p.start_, p.end_, p.snippet, unnest({errors}) as attribute from pairs join p on p.doc_id = pairs.doc_id and p.n = pairs.p join g on g.doc_id = pairs.doc_id and g.n = pairs.g) e"""


def _items(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    s = scored(spark, sf_dir, kind)
    located = s.golden.select("doc_id", "n", (F.col("start") + F.col("n") % 3).alias("line_no"), F.concat(F.lit(" line "), F.col("n").cast("string"), F.lit(" ")).alias("line"))
    return D.items(s, located).withColumnsRenamed({"start": "start_line", "end": "end_line"})


_JP = "case when {0}.agency in ('PMDA', 'MHLW') then 'JP' else {0}.agency end"


@query(_items_sql("regulatory_events", _EVENT, f"case when {_JP.format('p')} <> {_JP.format('g')} then ['agency'] else [] end"))
def event_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misses, unmatched predictions and attribute errors of regulatory events, for inspection."""
    return _items(spark, sf_dir, "regulatory_events")


@query(
    _items_sql("market_metrics", _METRIC, """list_concat(case when abs(p.value - g.value) > 0.02 * greatest(p.value, g.value) then ['value'] else [] end,
      case when lower(case when p.period = 'not stated' then 'Q1 2024' else p.period end) <> lower(coalesce(g.period, 'Q1 2024')) then ['period'] else [] end)""")
)
def metric_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir, "market_metrics")


@query("with " + _outcomes("programs", scoped=True) + """ select pairs.doc_id, pairs.g::bigint as g, pairs.p::bigint as p, p.area as predicted_area, g.area as golden_area
    from pairs join p on p.doc_id = pairs.doc_id and p.n = pairs.p join g on g.doc_id = pairs.doc_id and g.n = pairs.g where p.area <> g.area""")
def area_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.therapeutic_disagreements(scored(spark, sf_dir, "programs"))


@query("with " + _FACTS + """, gk as (select distinct doc_id, asset, action, term from t where odd = 1),
    pk as (select distinct doc_id, asset, action, term from t where odd = 0 and (doc_id, start_) in (select doc_id, start_ from labels))
    select doc_id, count_if((doc_id, asset, action, term) in (select doc_id, asset, action, term from pk))::bigint as hits, count(*)::bigint as total from gk group by doc_id""")
def region_collapsed_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted, golden = facts(spark, sf_dir)
    return D.region_collapsed(D.in_ranges(predicted, labelled(golden)), golden)


@query("with " + _FACTS + """ select l.doc_id, l.start_::bigint as start_line, (l.start_ + 9)::bigint as end_line, count(t.n)::bigint as events
    from labels l left join t on t.doc_id = l.doc_id and t.start_ = l.start_ and odd = 0 group by l.doc_id, l.start_""")
def chunk_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many predicted events each labelled chunk has, none included."""
    predicted, golden = facts(spark, sf_dir)
    return D.chunk_event_counts(labelled(golden), predicted).withColumnsRenamed({"start": "start_line", "end": "end_line"})


@query(
    """with m as (select s_nationkey as doc_id, 'm' || s_suppkey as molecule, 'k' || (s_suppkey % 7) as canonical, ['s' || (s_suppkey % 20), 's' || (s_suppkey * 7 % 20)] as slugs from supplier),
    one as (select * from m qualify row_number() over (partition by doc_id, canonical order by molecule) = 1), c as (select distinct c_nationkey as doc_id, 's' || (c_custkey % 9) as slug from customer)
    select doc_id, count_if(exists (select 1 from c where c.doc_id = one.doc_id and list_contains(one.slugs, c.slug)))::bigint as found, count(*)::bigint as total from one group by doc_id"""
)
def asset_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda letter, x: F.concat(F.lit(letter), x.cast("string"))
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    golden = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("doc_id"), name("m", k).alias("molecule"), name("k", k % 7).alias("canonical"), F.array(name("s", k % 20), name("s", k * 7 % 20)).alias("slugs"))
    clusters = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc_id"), name("c", c % 50).alias("canonical"), name("s", c % 9).alias("slug"))
    return D.asset_recall(golden, clusters)


@query(
    """with r as (select l_suppkey as query_id, l_partkey % 5 as doc_id, 1 + 10 * (l_partkey % 3) as start_line, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber) as pos from lineitem),
    h as (select query_id, doc_id, start_line, count(*) as n, min(pos) as first from r group by all)
    select query_id, doc_id::bigint as doc_id, start_line::bigint as start_line, n::bigint as rows_, row_number() over (partition by query_id order by n desc, first)::bigint as rank from h"""
)
def standin_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("l_orderkey", "l_linenumber")
    start = 1 + 10 * (F.col("l_partkey") % 3)
    rows = table(spark, sf_dir, "lineitem").withColumn("query_id", F.col("l_suppkey")).select(
        "query_id", (F.col("l_partkey") % 5).cast("long").alias("doc_id"), start.cast("long").alias("start"), (start + 9).alias("end"), F.row_number().over(order).alias("pos")
    )
    return D.standin_ranking(rows).select("query_id", "doc_id", F.col("start").alias("start_line"), F.col("rows").alias("rows_"), "rank")


_MEMBERS = """m as (select unnest([1, 3]) as k, l_suppkey as query_id, l_partkey % 6 as doc_id, l_linenumber as member, case l_partkey % 2 when 0 then 'extracted' else 'un-extracted' end as slice, l_quantity from lineitem),
    facts as (select k, query_id, doc_id, member, slice, bool_or(l_quantity > 40 - 5 * k) as hit from m group by all)"""


@query(
    "with " + _MEMBERS + """, by_ as (select k, query_id, doc_id, bool_or(hit) as present, count_if(hit) as hits, count(*) as n from facts group by all),
    s as (select k, query_id, slice, count_if(hit) as hits, count(*) as n from facts group by all)
    select k::bigint as k, query_id, count_if(present)::bigint as present, count(*)::bigint as entities, sum(hits)::bigint as hits, sum(n)::bigint as members,
      (select string_agg(slice || ' ' || s.hits || '/' || s.n, ', ' order by slice) from s where s.k = by_.k and s.query_id = by_.query_id) as sliced from by_ group by k, query_id"""
)
def comparison_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons: entities with any member found, members found, and those by slice."""
    part = F.col("l_partkey")
    rows = table(spark, sf_dir, "lineitem").select(
        F.explode(F.array(F.lit(1), F.lit(3))).alias("k"), F.col("l_suppkey").alias("query_id"), (part % 6).alias("doc_id"), F.col("l_linenumber").alias("member"),
        F.when(part % 2 == 0, "extracted").otherwise("un-extracted").alias("slice"), "l_quantity",
    )
    found = rows.groupBy("k", "query_id", "doc_id", "member", "slice").agg(F.bool_or(F.col("l_quantity") > 40 - 5 * F.col("k")).alias("hit"))
    shown = F.transform("sliced", lambda s: F.concat(s["slice"], F.lit(" "), s["hits"].cast("string"), F.lit("/"), s["members"].cast("string")))
    return S.comparison(found).withColumn("sliced", F.array_join(shown, ", "))


@query(
    """with s as (select p_partkey, case p_partkey % 4 when 0 then 'short ' || p_name when 1 then p_name || chr(10) when 2 then p_name || chr(10) || 'more' else repeat('long ', 40 + (p_partkey % 3)::int - 1) end as t from part)
    select count_if(length(t) >= 200 or contains(trim(t, ' ' || chr(10)), chr(10)))::bigint as fallbacks, count(*)::bigint as facts from s"""
)
def snippet_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a citation's snippet is its chunk's beginning: 200 characters or more, or several lines within."""
    k, name = F.col("p_partkey"), F.col("p_name")
    t = F.when(k % 4 == 0, F.concat(F.lit("short "), name)).when(k % 4 == 1, F.concat(name, F.lit("\n"))).when(k % 4 == 2, F.concat(name, F.lit("\nmore")))
    return G.fallback_rate(table(spark, sf_dir, "part").select(t.otherwise(F.repeat(F.lit("long "), (40 + k % 3 - 1).cast("int"))).alias("snippet")))


@query(
    """select o_orderkey as question_id, ['trials', 'approvals', 'corpus', 'done'][1 + o_orderkey % 4] as expected_route, ['trials', 'approvals', 'corpus', 'done'][1 + (o_orderkey + (case when o_orderkey % 9 = 0 then 1 else 0 end)) % 4] as route,
      o_orderkey % 9 <> 0 as ok from orders"""
)
def route_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each question's gap leads to the tool that its label names; asserted, never part of a score."""
    k = F.col("o_orderkey")
    at = k + F.when(k % 9 == 0, 1).otherwise(0)
    kind = F.when(at % 4 == 3, "sufficient").otherwise("gap")
    gap = _pick(["trial_status", "regulatory_status", "other", "other"], at)
    rows = table(spark, sf_dir, "orders").select(k.alias("question_id"), _pick(["trials", "approvals", "corpus", "done"], k).alias("expected_route"), kind.alias("kind"), gap.alias("gap_kind"))
    return A.routes(rows).select("question_id", "expected_route", "route", "ok")


@query(
    """with r as (select p_partkey, ['US', 'EU', 'Mars'][1 + p_partkey % 3] as region, case p_partkey % 5 when 0 then null when 1 then 'P9' else 'P2' end as stage, p_partkey % 7 <> 0 as cited from part)
    select p_partkey, array_to_string(list_filter([case when region = 'Mars' then 'region is not allowed' end, case when stage is null or stage = 'P9' then 'stage is not allowed' end,
      case when not cited then 'source_ref is missing' end], lambda x: x is not null), '; ') as broken from r"""
)
def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    ref = F.when(k % 7 != 0, F.struct(F.lit("d").alias("document_id")))
    rows = table(spark, sf_dir, "part").select("p_partkey", _pick(["US", "EU", "Mars"], k).alias("region"), F.when(k % 5 == 0, None).when(k % 5 == 1, "P9").otherwise("P2").alias("stage"), ref.alias("source_ref"))
    return rows.select("p_partkey", F.array_join(schemas.violations(rows, "programs"), "; ").alias("broken"))


@query(
    """with f as (select o_orderpriority as name, avg((o_orderstatus = 'F')::int) as measured from orders group by 1)
    select name, round(measured, 6) as measured, round(measured + case when name like '1%' then 0.004 when name like '2%' then 0.006 else 0 end, 6) as expected, name not like '2%' as ok from f"""
)
def reproduction_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured shares against published ones: a report is written only if all are within the tolerance."""
    found = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("measured"))
    moved = F.when(F.col("name").startswith("1"), 0.004).when(F.col("name").startswith("2"), 0.006).otherwise(0.0)
    rows = S.guards(found.withColumn("expected", F.col("measured") + moved))
    return rows.select("name", F.round("measured", 6).alias("measured"), F.round("expected", 6).alias("expected"), "ok")
