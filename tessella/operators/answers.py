"""Scoring of answers: resolution of citations, claim recall, precision, citation faithfulness, by terminal state.

Claims: question_id, claim (ordinal), subject, attribute, value, citations array<struct<doc_id, start, end>>. References: question_id,
ref (id), subject, attribute, value, spans array<struct<doc_id, start, end>>. Null lines mean that a whole record is cited.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.similarity import MATCH, canonical_set_similarity, set_match_settled
from tessella.functions.text import canonical_term
from tessella.functions.values import classify, value_match
from tessella.session import checkpoint

#: So many pairs of similar terms are broadcast; more are joined by a shuffle.
SMALL = 100_000


def resolve_citations(claims: DataFrame, evidence: DataFrame, strict: bool = True) -> DataFrame:
    """Claims with evidence numbers (``cites array<int>``) to claims with spans; a number out of range raises an error.

    ``evidence``: question_id, idx, doc_id, start, end. An equi-join on (question_id, idx).
    """
    spread = claims.select("*", F.posexplode_outer("cites").alias("at", "idx"))
    found = spread.join(evidence.select("question_id", "idx", F.struct("doc_id", "start", "end").alias("span")), ["question_id", "idx"], "left")
    lost = F.col("idx").isNotNull() & F.col("span").isNull()
    if strict:
        message = F.concat(F.lit("citation out of range: "), F.col("idx").cast("string"))
        found = found.withColumn("span", F.when(lost, F.raise_error(message)).otherwise(F.col("span")))
    own = [c for c in claims.columns if c != "cites"]
    items = F.array_sort(F.collect_list(F.when(F.col("span").isNotNull(), F.struct("at", "span"))))
    return found.groupBy(*own).agg(F.transform(items, lambda x: x["span"]).alias("citations"))


def contained(cited: Column, acceptable: Column) -> Column:
    """Whether a cited span covers an acceptable one: records by id, lines by inclusion; the two never mix."""
    record = cited["start"].isNull() & acceptable["start"].isNull()
    lines = cited["start"].isNotNull() & acceptable["start"].isNotNull()
    inside = (cited["start"] <= acceptable["start"]) & (acceptable["end"] <= cited["end"])
    return (cited["doc_id"] == acceptable["doc_id"]) & (record | (lines & inside))


def matched_claims(claims: DataFrame, refs: DataFrame) -> DataFrame:
    """Pairs of claims and references of one question that agree on subject and attribute, with ``right`` for the value."""
    term = lambda c: canonical_term(F.col(c))  # noqa: E731  once for each row, not for each pair
    a = claims.select("question_id", "claim", term("subject").alias("s"), term("attribute").alias("a"), classify(F.col("value")).alias("v"), "citations")
    b = refs.select("question_id", "ref", term("subject").alias("rs"), term("attribute").alias("ra"), classify(F.col("value")).alias("rv"), "spans")
    pairs = a.join(b, "question_id")
    settled = {x: set_match_settled(F.col(x), F.col(y)) for x, y in (("s", "rs"), ("a", "ra"))}
    pairs = pairs.where(~settled["s"][1] & ~settled["a"][1])
    pairs = checkpoint(pairs.withColumns({f"{x}_sure": sure for x, (sure, _) in settled.items()}))
    # the ratio is computed once for each pair of terms that words alone do not settle
    open_ = pairs.where("not s_sure").select(F.col("s").alias("x"), F.col("rs").alias("y")).unionByName(pairs.where("not a_sure").select(F.col("a").alias("x"), F.col("ra").alias("y")))
    near = checkpoint(open_.distinct().where(canonical_set_similarity(F.col("x"), F.col("y")) >= MATCH))
    near = F.broadcast(near) if near.count() <= SMALL else near
    for x, y in (("s", "rs"), ("a", "ra")):
        same = near.select(F.col("x").alias(x), F.col("y").alias(y), F.lit(True).alias(f"{x}_near"))
        pairs = pairs.join(same, [x, y], "left").where(F.col(f"{x}_sure") | F.coalesce(f"{x}_near", F.lit(False)))
    return checkpoint(pairs.select("question_id", "claim", "ref", "citations", "spans", value_match(F.col("v"), F.col("rv")).alias("right")))


def score_answers(answers: DataFrame, claims: DataFrame, refs: DataFrame, questions: DataFrame) -> DataFrame:
    """One row for each question: terminal state, recall, wrong values, precision, faithfulness; null where not meaningful.

    ``answers``: question_id, terminal_state; ``questions``: question_id, construct, expected_terminal_state.
    """
    pairs = matched_claims(claims, refs)
    by_ref = pairs.groupBy("question_id", "ref").agg(F.bool_or("right").alias("right"))
    recall = refs.select("question_id", "ref").join(by_ref, ["question_id", "ref"], "left").groupBy("question_id").agg(
        F.count("*").alias("n_reference"), F.count_if("right").alias("n_recalled"),
        F.array_sort(F.collect_list(F.when(~F.col("right"), F.col("ref")))).alias("wrong_value"),
    )
    by_claim = pairs.groupBy("question_id", "claim").agg(F.first("citations").alias("citations"), F.flatten(F.collect_list("spans")).alias("pool"))
    ok = lambda c: F.exists("pool", lambda s: F.coalesce(contained(c, s), F.lit(False)))
    judged = by_claim.select(
        "question_id", "claim", F.size("citations").alias("cites"), F.size(F.filter("citations", ok)).alias("faithful")
    )
    support = judged.groupBy("question_id").agg(
        F.count("*").alias("n_matched"), F.count_if((F.col("cites") > 0) & (F.col("cites") == F.col("faithful"))).alias("n_supported"),
        F.sum("cites").alias("n_citations"), F.sum("faithful").alias("n_faithful"),
    )
    n = claims.groupBy("question_id").agg(F.count("*").alias("n_claims"))
    out = questions.join(answers, "question_id").join(recall, "question_id", "left").join(support, "question_id", "left").join(n, "question_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    expected = F.coalesce("n_reference", F.lit(0)) > 0
    return out.select(
        "question_id", "construct", "terminal_state", (F.col("terminal_state") == F.col("expected_terminal_state")).alias("terminal_correct"),
        zero("n_reference").alias("n_reference"), zero("n_recalled").alias("n_recalled"),
        F.try_divide("n_recalled", "n_reference").alias("recall"), F.coalesce("wrong_value", F.array().cast("array<string>")).alias("wrong_value"),
        zero("n_claims").alias("n_claims"), zero("n_matched").alias("n_matched"), (zero("n_claims") - zero("n_matched")).alias("n_unlisted"),
        F.when(expected, F.try_divide("n_supported", "n_matched")).alias("precision"),
        F.when(expected, F.try_divide("n_faithful", "n_citations")).alias("faithfulness"),
        F.when(~expected, (F.col("terminal_state") == "insufficient_evidence") & (zero("n_claims") == 0)).alias("insufficient_pass"),
    )


def by_stratum(scores: DataFrame) -> DataFrame:
    """Means within each terminal state and construct; questions where a score has no meaning are left out of its mean."""
    return scores.groupBy("terminal_state", "construct").agg(
        F.count("*").alias("questions"), F.avg(F.col("terminal_correct").cast("int")).alias("terminal_correct"),
        *[F.avg(c).alias(c) for c in ("recall", "precision", "faithfulness")],
    )


def render(claims: DataFrame) -> DataFrame:
    """``question_id, claim, line``: a claim with its citations as text."""
    span = lambda c: F.when(c["start"].isNull(), c["doc_id"].cast("string")).otherwise(F.format_string("%s:%s-%s", c["doc_id"].cast("string"), c["start"].cast("string"), c["end"].cast("string")))
    cites = F.when(F.size("citations") > 0, F.array_join(F.transform("citations", span), ", ")).otherwise("uncited")
    return claims.select("question_id", "claim", F.concat("subject", F.lit(" | "), "attribute", F.lit(": "), "value", F.lit(" ("), cites, F.lit(")")).alias("line"))
