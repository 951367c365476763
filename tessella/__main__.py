"""Command lines: ``python -m tessella ask|extract|score|score-answers|check ...``.

Models and retrievers are named as ``module:function``; each function takes the Spark session (``extract``: nothing) and returns the seam.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import reports
from tessella.operators import agent, answers, chunking, extraction, grounding, recall
from tessella.session import session
from tessella.sources import corpus, files, seams


def seam(name: str):
    module, _, function = name.partition(":")
    if not function:
        raise SystemExit(f"{name!r}: expected module:function")
    return getattr(importlib.import_module(module), function)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessella")
    sub = top.add_subparsers(dest="command", required=True)
    ask = sub.add_parser("ask", help="answer a question from the corpus")
    ask.add_argument("question")
    ask.add_argument("--llm", required=True, help="module:function of the model's seam")
    ask.add_argument("--retriever", required=True, help="module:function of the retriever")
    ask.add_argument("--max-iterations", type=int, default=agent.MAX_ITERATIONS)
    ask.add_argument("--question-id", default="?")
    extract = sub.add_parser("extract", help="extract entities from the reports of a registry")
    extract.add_argument("registry")
    extract.add_argument("out")
    extract.add_argument("--call", required=True, help="module:function of (prompt) -> JSON")
    extract.add_argument("--chunks", help="chunk indices, separated by commas")
    extract.add_argument("--limit", type=int)
    score = sub.add_parser("score", help="ground an extraction's facts in the reports they cite")
    score.add_argument("registry")
    score.add_argument("out")
    graded = sub.add_parser("score-answers", help="score answers (Parquet: answers, claims) against labelled questions")
    graded.add_argument("golden")
    graded.add_argument("answers")
    graded.add_argument("claims")
    graded.add_argument("out")
    check = sub.add_parser("check", help="hold measured figures (JSON lines: name, measured, expected) against published ones")
    check.add_argument("figures")
    check.add_argument("out")
    return top


def ask(spark: SparkSession, args: argparse.Namespace) -> str:
    if args.max_iterations < 1:
        raise SystemExit("--max-iterations must be at least 1")
    asked = spark.createDataFrame([(args.question_id, args.question)], "question_id string, question string")
    found = agent.run_agent(asked, seam(args.llm)(spark), seam(args.retriever)(spark), max_iterations=args.max_iterations)
    state = found["answers"].first()
    lines = [f"question: {args.question}", f"state: {state['terminal_state']} ({state['reason']})"]
    claims = answers.resolve_citations(found["claims"], found["evidence"])
    return "\n".join(lines + [f"- {r['line']}" for r in answers.render(claims).orderBy("claim").collect()])


def extract(spark: SparkSession, args: argparse.Namespace) -> str:
    docs = corpus.read_corpus(spark, corpus.read_registry(spark, args.registry))
    named = docs.select("id", "source_company", F.col("publication_date").alias("as_of_date"))
    chunks = chunking.chunk_documents(docs.select(F.col("id").alias("doc_id"), "text"))
    chunks = chunking.subset(chunks, [int(x) for x in args.chunks.split(",")] if args.chunks else None, args.limit)
    rows = chunks.join(named.withColumnRenamed("id", "document_id"), "document_id")
    answered = seams.model_calls(rows.withColumn("prompt", F.col("text")), seam(args.call)())
    tables = extraction.map_payloads(answered.withColumnRenamed("response", "payload"))
    files.write_artifacts(tables, {"model": args.call}, args.out)
    return reports.render("Extraction", {"counts": extraction.count_by_type(tables)})


def grounded(spark: SparkSession, registry: list[corpus.Report]) -> DataFrame:
    """``entity_type, name, category, n`` of all facts of the registry's artifacts."""
    every = None
    for report in registry:
        if report.artifact is None:
            continue
        lines = files.read_reports(spark, report.path, report.source_company, report.doc_type).select(F.col("id").alias("cited_id"), "lines")
        for kind in grounding.CHECKS:
            facts = files.read_artifacts(spark, report.artifact)[1][kind].withColumn("range", F.col("source_ref.line_range"))
            cited = grounding.cited_text(F.col("lines"), F.get("range", F.lit(0)), F.get("range", F.lit(1)))
            checks = grounding.ground(facts.join(lines, F.col("source_ref.document_id") == F.col("cited_id")).withColumn("cited", cited), kind)
            one = grounding.summary(checks).select(F.lit(kind).alias("entity_type"), "name", "category", "n")
            every = one if every is None else every.unionByName(one)
    if every is None:
        raise SystemExit("no report of the registry names an artifact")
    return every.groupBy("entity_type", "name", "category").agg(F.sum("n").alias("n"))


def run(spark: SparkSession, args: argparse.Namespace) -> str:
    if args.command == "ask":
        return ask(spark, args)
    if args.command == "extract":
        return extract(spark, args)
    if args.command == "score":
        return reports.write_report(spark, args.out, "Grounding", {"checks": grounded(spark, corpus.read_registry(spark, args.registry))})
    if args.command == "score-answers":
        questions, refs = files.read_answer_golden(spark, args.golden)
        scores = answers.score_answers(spark.read.parquet(args.answers), spark.read.parquet(args.claims), refs, questions)
        return reports.write_report(spark, args.out, "Answers", {"questions": scores, "strata": answers.by_stratum(scores)})
    figures = recall.guards(spark.read.schema("name string, measured double, expected double").json(args.figures))
    return reports.write_report(spark, args.out, "Figures", {"figures": figures}, figures)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        print(run(session("tessella"), args))
    except reports.GuardsFailed as e:
        print(f"not written, these figures moved: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
