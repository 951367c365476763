"""Scoring of extracted documents: scope to labelled ranges, collapse, align, further grains, items for inspection.

Predicted facts bring ``doc_id, n, start, end, snippet`` and their type's columns, golden ones ``doc_id, n, start, end``; ``start`` and
``end`` are the lines of the chunk that a fact comes from. ``asset`` is the canonical name of a fact's asset cluster, ``asset_name`` what
the fact calls it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.similarity import fuzzy_match
from tessella.functions.text import canonical_term, fold_self_reference
from tessella.operators import matching as M
from tessella.session import checkpoint

#: What an item of a kind says besides its summary.
DETAILS = {
    "indication_verbose": "right disease + extra qualifiers (no schema population/setting field)",
    "restatement": "cross-chunk duplicate of a captured fact (inconsistent region) — census artifact",
}


def in_ranges(facts: DataFrame, labelled: DataFrame) -> DataFrame:
    """The facts whose lines are exactly those of a labelled chunk (doc_id, start, end): a semi-join."""
    return facts.join(labelled.select("doc_id", "start", "end"), ["doc_id", "start", "end"], "left_semi")


def collapsed(facts: DataFrame, kind: str) -> DataFrame:
    """Each fact once in its document, where it comes first; subjects that name the document's company are folded before."""
    if kind == "market_metrics" and "company" in facts.columns:
        facts = facts.withColumn("subject", fold_self_reference(F.col("subject"), F.col("company")))
    return M.keep_first(facts.withColumn("__key", M.collapse_key(kind)), ["doc_id", "__key"], ["n"]).drop("__key")


@dataclass
class Scored:
    """One type's aligned facts: both sides as they were compared, the pairs (doc_id, g, p) and each fact's outcome."""

    kind: str
    predicted: DataFrame
    golden: DataFrame
    pairs: DataFrame
    outcomes: DataFrame


def score(predicted: DataFrame, golden: DataFrame, labelled: DataFrame, kind: str) -> Scored:
    """Scope first, then collapse, then align: a fact that is first stated outside the labelled chunks still counts inside them."""
    p, g = collapsed(in_ranges(predicted, labelled), kind), collapsed(golden, kind)
    pairs = checkpoint(M.greedy_pairs(M.candidates(p, g, kind)))
    return Scored(kind, p, g, pairs, checkpoint(M.outcomes(p, g, pairs, kind)))


def region_collapsed(predicted: DataFrame, golden: DataFrame) -> DataFrame:
    """``doc_id, hits, total``: regulatory events without their regions, each once; a key on both sides is a hit."""
    key = F.struct(F.col("asset"), F.col("action"), canonical_term("indication").alias("i")).alias("key")
    mine = predicted.select("doc_id", key).distinct().withColumn("hit", F.lit(1))
    theirs = golden.select("doc_id", key).distinct()
    return theirs.join(mine, ["doc_id", "key"], "left").groupBy("doc_id").agg(F.count("hit").alias("hits"), F.count("*").alias("total"))


def asset_recall(golden: DataFrame, clusters: DataFrame) -> DataFrame:
    """``doc_id, found, total``: golden molecules (doc_id, molecule, canonical, slugs), each of its own clusters once,
    that share a slug with any predicted cluster (doc_id, canonical, slug)."""
    one = M.keep_first(golden, ["doc_id", "canonical"], ["molecule"])
    slugs = one.select("doc_id", "molecule", F.explode("slugs").alias("slug"))
    hit = slugs.join(clusters.select("doc_id", "slug").distinct(), ["doc_id", "slug"], "left_semi").select("doc_id", "molecule").distinct()
    every = one.select("doc_id", "molecule").join(hit.withColumn("hit", F.lit(1)), ["doc_id", "molecule"], "left")
    return every.groupBy("doc_id").agg(F.count("hit").alias("found"), F.count("*").alias("total"))


def chunk_event_counts(chunks: DataFrame, events: DataFrame) -> DataFrame:
    """``doc_id, start, end, events``: how many events cite exactly a chunk's lines, zeros included."""
    counted = events.groupBy("doc_id", "start", "end").agg(F.count("*").alias("events"))
    return chunks.select("doc_id", "start", "end").join(counted, ["doc_id", "start", "end"], "left").fillna(0, ["events"])


def therapeutic_disagreements(scored: Scored) -> DataFrame:
    """``doc_id, g, p, predicted_area, golden_area`` of matched programs whose areas differ; described, never scored."""
    p = scored.predicted.select("doc_id", F.col("n").alias("p"), F.col("therapeutic_area").alias("predicted_area"))
    g = scored.golden.select("doc_id", F.col("n").alias("g"), F.col("therapeutic_area").alias("golden_area"))
    both = scored.pairs.join(p, ["doc_id", "p"]).join(g, ["doc_id", "g"]).where("golden_area <> ''")
    return both.where(~fuzzy_match(F.col("predicted_area"), F.col("golden_area"))).select("doc_id", "g", "p", "predicted_area", "golden_area")


def _shown(column: str, kind: str = "") -> Column:
    """A value as a report writes it."""
    value = F.col(column)
    if kind == "list":
        return F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    if kind == "bool":
        return F.coalesce(F.initcap(value.cast("string")), F.lit("None"))
    if kind == "float":
        whole = (value == F.floor(value)) & (F.abs(value) < 1e16)
        return F.coalesce(F.when(whole, F.concat(value.cast("decimal(38,0)").cast("string"), F.lit(".0"))).otherwise(value.cast("string")), F.lit("None"))
    return F.coalesce(value.cast("string"), F.lit("None"))


def summary(kind: str, asset: str = "asset_name") -> Column:
    """A fact in one line; the column ``asset`` (``assets`` of trials) is what the fact calls its asset."""
    s = _shown
    if kind == "programs":
        return F.concat(s(asset), F.lit(" | "), s("indication"), F.lit(" | "), s("region"), F.lit("/"), s("stage"))
    if kind == "regulatory_events":
        return F.concat_ws(" | ", s(asset), s("action"), s("region"), s("indication"), F.concat(F.lit("agency="), s("agency")))
    if kind == "trials":
        return F.concat_ws(
            " | ", s("trial_name"), s("assets", "list"), F.concat(F.lit("P"), s("phase")), F.concat(F.lit("met="), s("met_primary_endpoint", "bool")), s("indication")
        )
    return F.concat_ws(
        " | ", s("subject"), s("metric"), s("geography"), F.concat(s("value", "float"), F.lit(" "), s("unit")), F.concat(F.lit("period="), s("period"))
    )


def items(scored: Scored, located: DataFrame) -> DataFrame:
    """``doc_id, kind, entity_type, summary, start, end, snippet, detail``: what a reader should look at.

    Misses stand at their located line (``located``: doc_id, n, line_no, line), unmatched predictions at their chunk with 160 characters
    of the snippet, attribute errors of matched pairs at the prediction's chunk with 120 and one item for each attribute.
    """
    kind = scored.kind
    of = lambda side, *kinds: scored.outcomes.where((F.col("side") == side) & F.col("outcome").isin(*kinds)).select("doc_id", "n", "outcome")
    row = lambda name, start, end, snippet, detail: [
        "doc_id", name.alias("kind"), F.lit(kind).alias("entity_type"), "summary", start.cast("long").alias("start"), end.cast("long").alias("end"), snippet.alias("snippet"), detail.alias("detail")
    ]
    golden = scored.golden.withColumn("summary", summary(kind))
    missed = golden.join(of("golden", "miss"), ["doc_id", "n"]).join(located, ["doc_id", "n"], "left")
    line = F.coalesce("line_no", "start")
    out = missed.select(*row(F.lit("miss"), line, line, F.coalesce(F.trim("line"), F.lit("")), F.lit("")))
    unmatched = of("predicted", "false_positive", "key_incomplete", "indication_verbose", "restatement")
    detail = F.lit("")
    for name, text in DETAILS.items():
        detail = F.when(F.col("outcome") == name, text).otherwise(detail)
    rest = scored.predicted.withColumn("summary", summary(kind)).join(unmatched, ["doc_id", "n"])
    out = out.unionByName(rest.select(*row(F.col("outcome"), F.col("start"), F.col("end"), F.substring("snippet", 1, 160), detail)))
    sides = lambda rows, letter: rows.select("doc_id", F.col("n").alias(letter), *[F.col(c).alias(f"{letter}_{c}") for c in rows.columns if c not in ("doc_id", "n", "reporting_period")])
    both = scored.pairs.join(sides(scored.predicted, "p"), ["doc_id", "p"]).join(sides(golden, "g"), ["doc_id", "g"])
    if "reporting_period" in golden.columns:
        both = both.join(golden.select("doc_id", F.col("n").alias("g"), "reporting_period"), ["doc_id", "g"])
    elif kind == "market_metrics":
        both = both.withColumn("reporting_period", F.lit(None).cast("string"))
    wrong = both.withColumn("attribute", F.explode(M.attribute_errors(kind))).withColumn("summary", F.col("g_summary"))
    return out.unionByName(wrong.select(*row(F.lit("attribute_error"), F.col("p_start"), F.col("p_end"), F.substring("p_snippet", 1, 120), F.col("attribute"))))


def standin_ranking(rows: DataFrame) -> DataFrame:
    """``query_id, doc_id, start, end, rows, rank``: the chunks that hold the rows of an aggregate question (query_id, pos, doc_id,
    start, end of the row's chunk), by how many they hold; ties in the order in which they first come up."""
    held = rows.groupBy("query_id", "doc_id", "start", "end").agg(F.count("*").alias("rows"), F.min("pos").alias("first"))
    order = M.Window.partitionBy("query_id").orderBy(F.desc("rows"), "first")
    return held.withColumn("rank", F.row_number().over(order).cast("long")).drop("first")
