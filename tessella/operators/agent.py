"""The question loop's control flow, set-oriented: one DataFrame step for all open questions.

The model's parts (plans, verdicts, claims) and the tools come through seams (see ``sources.seams``); what happens with
their outputs is decided here: well-formedness, gap dispatch, evidence numbering, claim checks, terminal states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.retrieval import first_seen
from tessella.session import checkpoint

MAX_ITERATIONS = 3
EVIDENCE = ["question_id", "doc_id", "start", "end", "text"]


def _some(name: str) -> Column:
    return F.coalesce(F.size(name) > 0, F.lit(False))


def malformed(verdicts: DataFrame) -> DataFrame:
    """Adds ``error``: why a verdict's fields do not fit its kind; null if they do.

    Verdicts: kind, missing_slots, follow_ups, gaps (arrays of strings).
    """
    kind, slots, follow, gaps = F.col("kind"), _some("missing_slots"), _some("follow_ups"), _some("gaps")
    error = (
        F.when((kind == "sufficient") & (slots | follow | gaps), "sufficient takes no further fields")
        .when((kind == "gap") & ~follow, "gap needs follow-up queries")
        .when((kind == "gap") & gaps, "gap takes no gaps")
        .when((kind == "exhausted") & ~gaps, "exhausted needs gaps")
        .when((kind == "exhausted") & (slots | follow), "exhausted takes no gap fields")
        .when(~F.coalesce(kind.isin("sufficient", "gap", "exhausted"), F.lit(False)), "unknown kind")
    )
    return verdicts.withColumn("error", error)


def dispatch(kind: Column, gap_kind: Column) -> Column:
    """Where a verdict leads: done, a tool (``trials``, ``approvals``) or the corpus."""
    return (
        F.when(kind.isin("sufficient", "exhausted"), "done")
        .when(gap_kind == "trial_status", "trials")
        .when(gap_kind == "regulatory_status", "approvals")
        .otherwise("corpus")
    )


def routes(rows: DataFrame) -> DataFrame:
    """``rows`` (kind, gap_kind, expected_route) with ``route`` and ``ok``: dispatch held against the labelled route. Rows without a
    label are ok; this is an assertion about dispatch, and no score reads it."""
    led = rows.withColumn("route", dispatch(F.col("kind"), F.col("gap_kind")))
    return led.withColumn("ok", F.col("expected_route").isNull() | F.coalesce(F.col("route") == F.col("expected_route"), F.lit(False)))


def last_verdict(verdicts: DataFrame, cap: int = MAX_ITERATIONS) -> DataFrame:
    """``question_id, used, kind, budget_hit``: where a question's loop ends among its numbered verdicts (``i`` from 0)."""
    if cap < 1:
        raise ValueError("there must be at least one iteration")
    done = F.col("kind").isin("sufficient", "exhausted")
    inside = verdicts.where(F.col("i") < cap)
    ends = inside.groupBy("question_id").agg(
        F.min(F.when(done, F.struct("i", "kind"))).alias("end"), F.max(F.struct("i", "kind")).alias("last")
    )
    return ends.select(
        "question_id", (F.coalesce("end.i", "last.i") + 1).alias("used"), F.coalesce("end.kind", "last.kind").alias("kind"),
        F.col("end").isNull().alias("budget_hit"),
    )


def number_evidence(rows: DataFrame, by: str = "question_id") -> DataFrame:
    """Evidence in the order of ``seq``, each (doc_id, start, end) once, with a stable ``idx`` from 0; records have null lines."""
    return first_seen(rows, [by], ["doc_id", "start", "end"], ["seq"], "idx")


def claim_errors(claims: DataFrame, sizes: DataFrame) -> DataFrame:
    """Adds ``errors``: blank fields and citations outside the question's evidence (``n``); no citation is no error."""
    rows = claims.join(sizes, "question_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    blank = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"empty {c}"))
    bad = F.filter("cites", lambda i: (i < 0) | (i >= F.col("n")))
    messages = F.transform(bad, lambda i: F.concat(F.lit("citation "), i.cast("string"), F.lit(" is out of range")))
    fields = F.filter(F.array(*[blank(c) for c in ("subject", "attribute", "value")]), lambda x: x.isNotNull())
    return rows.withColumn("errors", F.concat(fields, F.coalesce(messages, F.array().cast("array<string>")))).drop("n")


def surviving(claims: DataFrame) -> DataFrame:
    """Of claims with ``attempt`` (1 or 2) and ``errors``: those that stand. A second attempt counts where the first has errors.

    Returns the valid claims of the attempt that counts and, as ``dropped`` by question, how many of it are invalid.
    """
    bad = claims.groupBy("question_id").agg(F.max(F.when((F.col("attempt") == 1) & (F.size("errors") > 0), 1)).alias("bad"), F.max("attempt").alias("most"))
    pick = bad.select("question_id", F.when(F.col("bad").isNotNull() & (F.col("most") > 1), 2).otherwise(1).alias("attempt"))
    counted = claims.join(pick, ["question_id", "attempt"])
    dropped = counted.groupBy("question_id").agg(F.count_if(F.size("errors") > 0).alias("dropped"))
    return counted.where(F.size("errors") == 0).join(dropped, "question_id")


def terminal_state(budget_hit: Column, n_evidence: Column, n_valid: Column, n_dropped: Column, kind: Column) -> Column:
    return (
        F.when(budget_hit | (n_evidence == 0) | (n_valid == 0), "insufficient_evidence")
        .when((kind == "sufficient") & (n_dropped == 0), "answered")
        .otherwise("partially_answered")
    )


def reason(budget_hit: Column, n_evidence: Column, n_valid: Column, n_dropped: Column, kind: Column) -> Column:
    return (
        F.when(budget_hit, "iteration cap reached").when(n_evidence == 0, "no evidence").when(n_valid == 0, "no surviving claims")
        .when((kind == "sufficient") & (n_dropped == 0), "sufficient").when(kind == "sufficient", "sufficient, claims dropped").otherwise("exhausted")
    )


def trial_evidence(records: DataFrame) -> DataFrame:
    text = F.format_string("Trial %s: status=%s; phase=%s; %s", "nct_id", "status", "phase", "title")
    return _record(records, F.concat(F.lit("ctgov:"), "nct_id"), text)


def approval_evidence(records: DataFrame) -> DataFrame:
    text = F.format_string("FDA application %s: %s (%s); submission_status=%s", "application_number", "brand_name", "generic_name", "submission_status")
    return _record(records, F.concat(F.lit("openfda:"), "application_number"), text)


def _record(records: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    none = F.lit(None).cast("long")
    return records.select("question_id", doc_id.alias("doc_id"), none.alias("start"), none.alias("end"), text.alias("text"))


def listing(evidence: DataFrame) -> DataFrame:
    """``question_id, prompt``: the numbered evidence as the model sees it, without ids."""
    items = F.array_sort(F.collect_list(F.struct("idx", "text")))
    line = lambda x: F.concat(F.lit("["), x["idx"].cast("string"), F.lit("] "), x["text"])
    return evidence.groupBy("question_id").agg(F.array_join(F.transform(items, line), "\n").alias("prompt"))


def run_agent(questions: DataFrame, llm, retriever, tools=None, max_iterations: int = MAX_ITERATIONS) -> dict[str, DataFrame]:
    """Runs all questions (question_id, question) together; at most ``max_iterations`` rounds whatever their number.

    ``llm``: plan(questions) -> question_id, queries; assess(questions, evidence, i) -> question_id, kind, gap_kind, missing_slots, follow_ups,
    gaps; synthesize(questions, evidence, attempt) -> question_id, claim, subject, attribute, value, cites. ``retriever``: (question_id,
    queries) -> EVIDENCE with pos. ``tools``: trials and approvals, (question_id, query) -> records.
    Returns ``answers``, ``claims``, ``evidence``, ``verdicts``. A malformed verdict raises ValueError.
    """
    if max_iterations < 1:
        raise ValueError("there must be at least one iteration")
    plans = llm.plan(questions)
    queries = F.filter("queries", lambda q: F.trim(q) != "")
    plans = questions.join(plans, "question_id", "left").select("question_id", F.when(F.coalesce(F.size(queries), F.lit(0)) > 0, queries).otherwise(F.array("question")).alias("queries"))
    open_ = checkpoint(plans)
    gathered, verdicts = None, None
    order = lambda n: F.struct(F.lit(n).alias("step"), F.col("pos").alias("pos"))
    for i in range(max_iterations):
        found = retriever(open_).select(*EVIDENCE, order(2 * i).alias("seq"))
        gathered = checkpoint(found if gathered is None else gathered.unionByName(found))
        numbered = number_evidence(gathered)
        asked = questions.join(open_.select("question_id"), "question_id", "left_semi")
        judged = checkpoint(malformed(llm.assess(asked, numbered, i)).withColumn("i", F.lit(i)))
        wrong = judged.where("error is not null").select("question_id", "error").first()
        if wrong:
            raise ValueError(f"verdict of {wrong['question_id']}: {wrong['error']}")
        verdicts = judged if verdicts is None else checkpoint(verdicts.unionByName(judged))
        going = judged.withColumn("to", dispatch(F.col("kind"), F.col("gap_kind"))).where("to <> 'done'")
        if tools is not None:
            wish = going.select("question_id", "to", F.get("follow_ups", F.lit(0)).alias("query"))
            for name, lookup, shape in (("trials", tools.trials, trial_evidence), ("approvals", tools.approvals, approval_evidence)):
                hits = shape(lookup(wish.where(F.col("to") == name).drop("to")))
                pos = F.row_number().over(Window.partitionBy("question_id").orderBy("doc_id"))
                gathered = gathered.unionByName(hits.withColumn("pos", pos).select(*EVIDENCE, order(2 * i + 1).alias("seq")))
        open_ = checkpoint(going.select("question_id", F.col("follow_ups").alias("queries")))
        if open_.isEmpty():
            break
    evidence = checkpoint(number_evidence(checkpoint(gathered)).drop("seq"))
    ends = last_verdict(verdicts, max_iterations)
    sizes = evidence.groupBy("question_id").agg(F.count("*").alias("n"))
    ready = checkpoint(ends.where("not budget_hit").join(sizes, "question_id").join(questions, "question_id").select("question_id", "question"))
    first = checkpoint(claim_errors(llm.synthesize(ready, evidence, 1), sizes).withColumn("attempt", F.lit(1)))
    retry = first.where(F.size("errors") > 0).select("question_id").distinct()
    second = claim_errors(llm.synthesize(ready.join(retry, "question_id", "left_semi"), evidence, 2), sizes).withColumn("attempt", F.lit(2))
    # a retry that returns nothing replaces the first attempt too
    emptied = retry.join(second.select("question_id").distinct(), "question_id", "left_anti")
    claims = checkpoint(surviving(first.unionByName(second)).join(emptied, "question_id", "left_anti"))
    n_valid = claims.groupBy("question_id").agg(F.count("*").alias("n_valid"), F.max("dropped").alias("n_dropped"))
    state = ends.join(sizes, "question_id", "left").join(n_valid, "question_id", "left").fillna(0, ["n", "n_valid", "n_dropped"])
    args = (F.col("budget_hit"), F.col("n"), F.col("n_valid"), F.col("n_dropped"), F.col("kind"))
    answers = state.select("question_id", terminal_state(*args).alias("terminal_state"), reason(*args).alias("reason"), "used", "budget_hit")
    kept = claims.drop("errors", "attempt", "dropped")
    return {"answers": answers, "claims": kept, "evidence": evidence, "verdicts": verdicts}
