"""Alignment of predicted facts with labelled ones: collapse, candidates, greedy pairing, classes of the rest.

Facts are rows with ``doc_id``, an ordinal ``n`` (document order), ``slugs`` (all identifiers of the fact's asset clusters) and the
columns of their type. Candidates come from an equi-join on the document and the closed fields; only survivors reach the similarity
UDF. Pairing reads one document's candidates in order, so a task holds one document's taken facts at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.similarity import fuzzy_match
from tessella.functions.text import agency_class, canonical_term, collapse_phase, is_null_sentinel, values_match

#: Closed fields that must be equal, by type; a phase or stage counts without its sub-phase.
CLOSED = {"programs": ["stage"], "regulatory_events": ["action", "region"], "trials": ["phase"], "market_metrics": ["metric"]}
FUZZY = {"programs": ["indication"], "regulatory_events": ["indication"], "trials": ["indication"], "market_metrics": ["subject", "geography"]}


def collapse_key(kind: str) -> Column:
    """The key under which facts of one type are the same fact; columns as in the type's table, ``asset`` resolved."""
    term = lambda c: canonical_term(F.col(c))
    if kind == "programs":
        return F.struct(F.col("asset"), term("indication").alias("i"), F.col("region"), collapse_phase(F.col("stage")).alias("s"))
    if kind == "regulatory_events":
        return F.struct(F.col("asset"), F.col("action"), term("indication").alias("i"), F.col("region"))
    if kind == "market_metrics":
        return F.struct(term("subject").alias("s"), F.col("metric"), term("geography").alias("g"))
    nct, name = F.nullif(F.lower(F.trim("nct_id")), F.lit("")), F.nullif(F.col("trial_name"), F.lit(""))
    triple = F.struct(F.array_sort(F.array_distinct("assets")).alias("a"), term("indication").alias("i"), collapse_phase(F.col("phase")).alias("p"))
    return F.struct(
        F.when(nct.isNotNull(), "nct").when(name.isNotNull(), "name").otherwise("triple").alias("tier"),
        F.when(nct.isNotNull(), nct).when(name.isNotNull(), canonical_term(name)).alias("text"),
        F.when(nct.isNull() & name.isNull(), triple).alias("triple"),
    )


def keep_first(rows: DataFrame, by: list[Column | str], order: list[str]) -> DataFrame:
    """The first row of each key, in document order."""
    own = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(own)).where("__n = 1").drop("__n")


def _sided(rows: DataFrame, letter: str) -> DataFrame:
    """All columns with the side's letter before their names, so that both sides may come from one table."""
    return rows.select(*[F.col(c).alias(f"{letter}_{c}") for c in rows.columns])


def _phased(column: str) -> Column:
    return collapse_phase(F.col(column)) if column[2:] in ("stage", "phase") else F.col(column)


def _closed(kind: str, fields: list[str]) -> Column:
    """Whether p and g stand in one document and agree on ``fields`` and, where the type has assets, on one of them."""
    same = F.col("p_doc_id") == F.col("g_doc_id")
    for c in fields:
        same = same & (_phased(f"p_{c}") == _phased(f"g_{c}"))
    if kind != "market_metrics":
        same = same & F.arrays_overlap("p_slugs", "g_slugs")
    return same


def _keyed(kind: str) -> Column:
    """``_closed`` over the type's key without its open texts; a golden program without a region fits any."""
    same = _closed(kind, CLOSED[kind])
    return same & (F.col("g_region").isNull() | (F.col("p_region") == F.col("g_region"))) if kind == "programs" else same


def _both(column: str) -> Column:
    given = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return given(f"p_{column}") & given(f"g_{column}")


def candidates(predicted: DataFrame, golden: DataFrame, kind: str) -> DataFrame:
    """``doc_id, g, p`` of all pairs that the type's predicate accepts."""
    p, g = _sided(predicted, "p"), _sided(golden, "g")
    keep = [F.col("g_doc_id").alias("doc_id"), F.col("g_n").alias("g"), F.col("p_n").alias("p")]
    fuzzy = F.lit(True)
    for c in FUZZY[kind]:
        fuzzy = fuzzy & fuzzy_match(F.col(f"p_{c}"), F.col(f"g_{c}"))
    if kind != "trials":
        return p.join(g, _keyed(kind)).where(fuzzy).select(*keep)
    same, ids, names = F.col("p_doc_id") == F.col("g_doc_id"), _both("nct_id"), _both("trial_name")
    by_id = p.join(g, same & ids & (F.lower(F.trim("p_nct_id")) == F.lower(F.trim("g_nct_id")))).select(*keep)
    by_name = p.join(g, same & ~ids & names).where(fuzzy_match(F.col("p_trial_name"), F.col("g_trial_name"))).select(*keep)
    rest = p.join(g, _keyed(kind) & ~ids & ~names).where(fuzzy).select(*keep)
    return by_id.union(by_name).union(rest)


def greedy_pairs(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One-to-one pairs: golden facts in order, each takes the first candidate that is still free.

    One pass over each group's pairs, sorted by ``g`` and ``p``; a task remembers the taken predictions of one group.
    """
    by = by or ["doc_id"]
    rows = pairs.select(*by, F.col("g").cast("long").alias("g"), F.col("p").cast("long").alias("p"))
    dealt = rows.repartition(*by).sortWithinPartitions(*by, "g", "p")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, done, taken = None, None, set()
        for batch in batches:
            kept = []
            groups = zip(*[batch.column(c).to_pylist() for c in by])
            for i, (own, g, p) in enumerate(zip(groups, batch.column("g").to_pylist(), batch.column("p").to_pylist())):
                if own != group:
                    group, done, taken = own, None, set()
                if g != done and p not in taken:
                    done = g
                    taken.add(p)
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    return dealt.mapInArrow(settle, rows.schema)


def significant(text: Column) -> Column:
    return F.filter(F.split(canonical_term(text), " "), lambda w: F.length(w) > 2)


def is_verbose(golden: Column, predicted: Column) -> Column:
    """The golden disease with further qualifiers: its words (two at least) all occur, and there are more."""
    g, p = significant(golden), significant(predicted)
    return (F.size(g) >= 2) & (F.size(p) > F.size(g)) & F.forall(g, lambda w: F.array_contains(p, w))


def key_incomplete(kind: str) -> Column:
    """Whether an open field of the key says nothing; trials with an id or a name are exempt."""
    if kind == "market_metrics":
        return is_null_sentinel(F.col("subject")) | is_null_sentinel(F.col("geography"))
    out = is_null_sentinel(F.col("indication"))
    if kind == "trials":
        named = F.concat(F.coalesce(F.col("nct_id"), F.lit("")), F.coalesce(F.col("trial_name"), F.lit("")))
        out = out & (named == "")
    return out


def outcomes(predicted: DataFrame, golden: DataFrame, pairs: DataFrame, kind: str) -> DataFrame:
    """``doc_id, side, n, outcome``: tp and miss for golden facts; matched, key_incomplete, indication_verbose,
    restatement or false_positive for predictions, in this order of precedence."""
    matched_p = pairs.select("doc_id", F.col("p").alias("n"))
    matched_g = pairs.select("doc_id", F.col("g").alias("n"))
    misses, found = golden.join(matched_g, ["doc_id", "n"], "left_anti"), golden.join(matched_g, ["doc_id", "n"], "left_semi")
    rest = predicted.join(matched_p, ["doc_id", "n"], "left_anti").withColumn("incomplete", F.coalesce(key_incomplete(kind), F.lit(False)))
    clean = _sided(rest.where("not incomplete"), "p")
    own = [F.col("p_doc_id").alias("doc_id"), F.col("p_n").alias("n")]
    none = rest.select("doc_id", "n").limit(0)
    verbose = again = none
    if kind != "market_metrics":
        left = _sided(misses, "g")
        wordier = is_verbose(F.col("g_indication"), F.col("p_indication"))
        if kind == "trials":  # names, where both have one, stand for assets and phase
            named = clean.join(left, (F.col("p_doc_id") == F.col("g_doc_id")) & _both("trial_name") & wordier)
            named = named.where(fuzzy_match(F.col("p_trial_name"), F.col("g_trial_name"))).select(*own)
            verbose = named.union(clean.join(left, _keyed(kind) & ~_both("trial_name") & wordier).select(*own)).distinct()
        else:
            verbose = clean.join(left, _keyed(kind) & wordier).select(*own).distinct()
    if kind in ("programs", "regulatory_events"):
        near = clean.join(_sided(found, "g"), _closed(kind, ["stage" if kind == "programs" else "action"]))
        wordier = is_verbose(F.col("g_indication"), F.col("p_indication"))
        near = near.select(*own, fuzzy_match(F.col("p_indication"), F.col("g_indication")).alias("fuzzy"), wordier.alias("verbose"))
        again = near.where("fuzzy or verbose").select("doc_id", "n").distinct()
    flags = rest.select("doc_id", "n", "incomplete").join(verbose.withColumn("verbose", F.lit(True)), ["doc_id", "n"], "left")
    flags = flags.join(again.withColumn("again", F.lit(True)), ["doc_id", "n"], "left")
    name = F.when(F.col("incomplete"), "key_incomplete").when(F.col("verbose"), "indication_verbose").when(F.col("again"), "restatement").otherwise("false_positive")
    golden_side = found.select("doc_id", F.lit("golden").alias("side"), "n", F.lit("tp").alias("outcome")).unionByName(
        misses.select("doc_id", F.lit("golden").alias("side"), "n", F.lit("miss").alias("outcome"))
    )
    mine = matched_p.select("doc_id", F.lit("predicted").alias("side"), "n", F.lit("matched").alias("outcome")).unionByName(
        flags.select("doc_id", F.lit("predicted").alias("side"), "n", name.alias("outcome"))
    )
    return golden_side.unionByName(mine)


def prf(rows: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall and F1 of ``outcome`` rows by some columns; 0 where a denominator is 0."""
    counts = rows.groupBy(*by).agg(
        *[F.count_if(F.col("outcome") == o).alias(n) for o, n in (("tp", "tp"), ("false_positive", "fp"), ("miss", "fn"), ("key_incomplete", "ki"), ("indication_verbose", "iv"), ("restatement", "rst"))]
    )
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    out = counts.withColumn("precision", F.coalesce(p, F.lit(0.0))).withColumn("recall", F.coalesce(r, F.lit(0.0)))
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.withColumn("f1", F.coalesce(f1, F.lit(0.0)))


def attribute_errors(kind: str) -> Column:
    """``array<string>``: the attributes in which a matched pair (p_ and g_ columns, reporting_period) differs, by type.

    A period that says nothing counts as the document's reporting period; without any golden period it is not compared.
    """
    if kind == "trials":
        differs = [(~F.col("p_met_primary_endpoint").eqNullSafe(F.col("g_met_primary_endpoint")), "met_primary_endpoint")]
    elif kind == "regulatory_events":
        differs = [(~agency_class(F.col("p_agency")).eqNullSafe(agency_class(F.col("g_agency"))), "agency")]
    elif kind == "market_metrics":
        filled = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col("reporting_period"))
        mine = F.when(is_null_sentinel(F.col("p_period")), F.col("reporting_period")).otherwise(F.col("p_period"))
        amount = values_match(F.col("p_value"), F.col("p_unit"), F.col("g_value"), F.col("g_unit"))
        differs = [
            (~F.coalesce(amount, F.lit(False)), "value"),
            (F.coalesce(filled("g_period") != "", F.lit(False)) & (canonical_term(mine) != canonical_term(filled("g_period"))), "period"),
        ]
    else:
        return F.array().cast("array<string>")
    return F.filter(F.array(*[F.when(c, n) for c, n in differs]), lambda x: x.isNotNull())


def locate(lines: DataFrame, facts: DataFrame) -> DataFrame:
    """``doc_id, n, line_no``: the first line of a fact's range with its strongest keyword, else the range's first line.

    ``facts``: doc_id, n, start, end, keywords (strongest first). A range join on the document's lines.
    """
    words = facts.select("doc_id", "n", "start", "end", F.posexplode(F.filter("keywords", lambda k: F.coalesce(k != "", F.lit(False)))).alias("at", "word"))
    hits = words.join(lines, "doc_id").where(F.col("line_no").between(F.col("start"), F.col("end")) & F.lower("line").contains(F.lower("word")))
    best = hits.groupBy("doc_id", "n").agg(F.min(F.struct("at", "line_no"))["line_no"].alias("hit"))
    return facts.join(best, ["doc_id", "n"], "left").select("doc_id", "n", F.coalesce("hit", "start").alias("line_no"))


def over_merged(golden: DataFrame, clusters: DataFrame) -> DataFrame:
    """Predicted clusters that more than one golden molecule falls into: ``canonical, molecules``.

    ``golden``: molecule, slugs; ``clusters``: canonical, slug. A molecule belongs to its first cluster by name.
    """
    hit = golden.select("molecule", F.explode("slugs").alias("slug")).join(clusters, "slug").groupBy("molecule").agg(F.min("canonical").alias("canonical"))
    return hit.groupBy("canonical").agg(F.array_sort(F.collect_list("molecule")).alias("molecules")).where(F.size("molecules") > 1)
