"""Entity resolution, deduplication, alignment with labels and its scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import matching as M
from tessella.operators.components import connected_components
from tessella.plans.registry import query
from tessella.session import spread, table


@query(
    """with recursive l as (select distinct doc_id, line from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) where trim(line) <> ''),
    docs as (select distinct doc_id from documents), first as (select line, min(doc_id) as lo from l group by line having count(*) > 1),
    e0 as (select distinct lo as u, doc_id as v from l join first using (line) where lo <> doc_id), e as (select u, v from e0 union select v, u from e0),
    r as (select doc_id as node, doc_id as seen from docs union select r.node, e.v from r join e on r.seen = e.u)
    select node as doc_id, min(seen) as root from r group by node"""
)
def identifier_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share any line that is not blank, directly or through others; every document has its root."""
    docs = spread(table(spark, sf_dir, "documents"))
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.trim("line") != "")
    rows = lines.select("doc_id", F.sha2("line", 256).alias("id")).distinct()
    first = rows.groupBy("id").agg(F.min("doc_id").alias("lo"), F.count("*").alias("n")).where("n > 1").drop("n")
    roots = connected_components(rows.join(first, "id").select(F.col("lo").alias("a"), F.col("doc_id").alias("b")))
    every = docs.select("doc_id").distinct()
    return every.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("root"))


@query(
    """select least_id as doc_id, copies::bigint as copies, doc_ids from (select min(doc_id) as least_id, count(*) as copies,
      string_agg(doc_id::varchar, ',' order by doc_id) as doc_ids from documents where text is not null group by md5(text)) where copies > 1"""
)
def dup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    same = docs.groupBy(F.md5(F.col("text").cast("binary")).alias("h")).agg(F.array_sort(F.collect_list("doc_id")).alias("ids")).where(F.size("ids") > 1)
    return same.select(F.get("ids", F.lit(0)).alias("doc_id"), F.size("ids").cast("long").alias("copies"), F.array_join("ids", ",").alias("doc_ids"))


_EVENTS = """ev as (select l_suppkey, l_orderkey, l_linenumber, l_partkey % 40 as asset, ['approval', 'filed', 'orphan'][1 + l_linenumber % 3] as action, ['US', 'EU', 'JP', 'CN'][1 + (l_quantity % 4)::int] as region,
    case l_partkey % 5 when 0 then 'UC' when 1 then 'ulcerative colitis' when 2 then 'Ulcerative  Colitis.' when 3 then 'tumour' else 'tumor' end as indication,
    case when l_partkey % 5 < 3 then 'ulcerative colitis' else 'tumor' end as term from lineitem)"""


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as regulatory events of a document (the supplier), in document order (order, line)."""
    n = F.col("l_partkey") % 5
    pick = lambda xs, i: F.get(F.array(*map(F.lit, xs)), i.cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("doc_id"), "l_orderkey", "l_linenumber", (F.col("l_partkey") % 40).alias("asset"),
        pick(["approval", "filed", "orphan"], F.col("l_linenumber") % 3).alias("action"), pick(["US", "EU", "JP", "CN"], F.col("l_quantity") % 4).alias("region"),
        pick(["UC", "ulcerative colitis", "Ulcerative  Colitis.", "tumour", "tumor"], n).alias("indication"),
    )


@query(
    "with " + _EVENTS + """ select l_suppkey as doc_id, l_orderkey, l_linenumber::bigint as l_linenumber, asset::bigint as asset, action, region, term from ev
      qualify row_number() over (partition by l_suppkey, asset, action, term, region order by l_orderkey, l_linenumber) = 1"""
)
def collapse_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_of(spark, sf_dir).withColumn("k", M.collapse_key("regulatory_events"))
    kept = M.keep_first(rows, ["doc_id", "k"], ["l_orderkey", "l_linenumber"])
    return kept.select("doc_id", "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("asset").cast("long").alias("asset"), "action", "region", F.col("k.i").alias("term"))


@query(
    "with " + _EVENTS + """ select action, count(*)::bigint as raw_n, count(distinct (l_suppkey, asset, term, region))::bigint as collapsed_n,
      count(distinct (l_suppkey, asset, term))::bigint as region_collapsed_n from ev group by action"""
)
def collapse_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_of(spark, sf_dir).withColumn("k", M.collapse_key("regulatory_events"))
    return rows.groupBy("action").agg(
        F.count("*").alias("raw_n"), F.countDistinct(F.struct("doc_id", "k.asset", "k.i", "k.region")).alias("collapsed_n"),
        F.countDistinct(F.struct("doc_id", "k.asset", "k.i")).alias("region_collapsed_n"),
    )


_SIDES = """o as (select o_custkey as doc_id, o_orderkey, o_orderpriority as k, o_orderkey % 2 = 1 as is_gold, o_orderkey % 3 = 0 as progress from orders),
    g as (select *, row_number() over (partition by doc_id order by o_orderkey) as n, row_number() over (partition by doc_id, k order by o_orderkey) as m from o where is_gold),
    p as (select *, row_number() over (partition by doc_id order by o_orderkey) as n, row_number() over (partition by doc_id, k order by o_orderkey) as m from o where not is_gold),
    pairs as (select g.doc_id, g.n as g, p.n as p from g join p using (doc_id, k, m)),
    outcome as (select g.doc_id, g.k, g.progress, case when pairs.g is null then 'miss' else 'tp' end as outcome from g left join pairs on g.doc_id = pairs.doc_id and g.n = pairs.g
      union all select p.doc_id, p.k, p.progress, 'false_positive' from p left join pairs on p.doc_id = pairs.doc_id and p.n = pairs.p where pairs.p is null)"""


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Golden facts (odd orders) and predicted ones (even orders) of a document (the customer)."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", F.col("o_orderpriority").alias("k"), (F.col("o_orderkey") % 3 == 0).alias("progress"))
    order = Window.partitionBy("doc_id").orderBy("o_orderkey")
    number = lambda rows: rows.withColumn("n", F.row_number().over(order))
    return number(o.where("o_orderkey % 2 = 1")), number(o.where("o_orderkey % 2 = 0"))


def pairs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p = sides(spark, sf_dir)
    cands = g.select("doc_id", "k", F.col("n").alias("g")).join(p.select("doc_id", "k", F.col("n").alias("p")), ["doc_id", "k"])
    return M.greedy_pairs(cands.select("doc_id", F.col("g").cast("long").alias("g"), F.col("p").cast("long").alias("p")))


def outcomes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p = sides(spark, sf_dir)
    pairs = pairs_of(spark, sf_dir)
    mine = pairs.select("doc_id", F.col("g").alias("n"), F.lit("tp").alias("outcome"))
    golden = g.join(mine, ["doc_id", "n"], "left").withColumn("outcome", F.coalesce("outcome", F.lit("miss")))
    rest = p.join(pairs.select("doc_id", F.col("p").alias("n")), ["doc_id", "n"], "left_anti").withColumn("outcome", F.lit("false_positive"))
    cols = ["doc_id", "k", "progress", "outcome"]
    return golden.select(*cols).unionByName(rest.select(*cols))


@query("with " + _SIDES + " select doc_id, g::bigint as g, p::bigint as p from pairs")
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_of(spark, sf_dir)


@query(
    "with " + _SIDES + """, c as (select k, count_if(outcome = 'tp') as tp, count_if(outcome = 'false_positive') as fp, count_if(outcome = 'miss') as fn from outcome group by k)
    select k, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall,
      round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from c"""
)
def prf_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = M.prf(outcomes_of(spark, sf_dir), ["k"])
    return s.select("k", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "with " + _SIDES + """ select case when progress then 'progress_row' else 'standalone' end as part, count_if(outcome = 'tp')::bigint as hits, count(*)::bigint as total,
      round(count_if(outcome = 'tp') / count(*), 6) as recall from outcome where outcome <> 'false_positive' group by progress"""
)
def region_split_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outcomes_of(spark, sf_dir).where("outcome <> 'false_positive'")
    part = F.when(F.col("progress"), "progress_row").otherwise("standalone").alias("part")
    return rows.groupBy(part).agg(
        F.count_if(F.col("outcome") == "tp").alias("hits"), F.count("*").alias("total"), F.round(F.avg((F.col("outcome") == "tp").cast("int")), 6).alias("recall")
    )


@query(
    """with f as (select p_partkey as doc_id, 1 + p_size % 3 as start_line, 4 + p_size % 3 as end_line from part), l as (select p_partkey as doc_id, unnest([1, 2, 3, 4, 5, 6]) as line_no, p_name from part),
    t as (select l.*, case when line_no % 3 = 0 then p_name else 'filler ' || line_no end as line from l), k as (select p_partkey as doc_id, unnest([1, 2]) as pri, unnest([split_part(p_name, ' ', 2), 'filler']) as word from part),
    h as (select f.doc_id, k.pri, t.line_no from f join k using (doc_id) join t on t.doc_id = f.doc_id and line_no between start_line and end_line and word <> '' and contains(lower(line), lower(word)))
    select f.doc_id, coalesce(arg_min(line_no, pri * 100 + line_no), min(start_line))::bigint as line_no from f left join h using (doc_id) group by f.doc_id"""
)
def fact_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "doc_id")
    n = F.explode(F.sequence(F.lit(1), F.lit(6))).alias("line_no")
    lines = p.select("doc_id", "p_name", n).select("doc_id", "line_no", F.when(F.col("line_no") % 3 == 0, F.col("p_name")).otherwise(F.concat(F.lit("filler "), F.col("line_no").cast("string"))).alias("line"))
    words = F.array(F.coalesce(F.get(F.split("p_name", " "), F.lit(1)), F.lit("")), F.lit("filler"))
    facts = p.select("doc_id", F.lit(1).alias("n"), (1 + F.col("p_size") % 3).alias("start"), (4 + F.col("p_size") % 3).alias("end"), words.alias("keywords"))
    return M.locate(lines, facts).select("doc_id", F.col("line_no").cast("long").alias("line_no"))


@query(
    """with c as (select distinct 'c' || (p_partkey % 50) as canonical, 's' || (p_partkey % 200) as slug from part), g as (select 'm' || s_suppkey as molecule, unnest(['s' || (s_suppkey % 200), 's' || (s_suppkey * 7 % 200)]) as slug from supplier),
    h as (select molecule, min(canonical) as canonical from g join c using (slug) group by molecule)
    select canonical, string_agg(molecule, ',' order by molecule) as molecules, count(*)::bigint as n from h group by canonical having count(*) > 1"""
)
def over_merged_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda letter, x: F.concat(F.lit(letter), x.cast("string"))
    clusters = table(spark, sf_dir, "part").select(name("c", F.col("p_partkey") % 50).alias("canonical"), name("s", F.col("p_partkey") % 200).alias("slug")).distinct()
    k = F.col("s_suppkey")
    golden = table(spark, sf_dir, "supplier").select(name("m", k).alias("molecule"), F.array(name("s", k % 200), name("s", k * 7 % 200)).alias("slugs"))
    return M.over_merged(golden, clusters).select("canonical", F.array_join("molecules", ",").alias("molecules"), F.size("molecules").cast("long").alias("n"))
