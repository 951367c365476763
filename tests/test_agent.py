import json

import pytest
from pyspark.sql import functions as F

from tessella.operators import agent as A
from tessella.operators import answers as S
from tessella.operators import extraction as X
from tessella.sources import files, seams
from tessella.streaming import ingest

VERDICT = "question_id string, kind string, gap_kind string, missing_slots array<string>, follow_ups array<string>, gaps array<string>"
CLAIM = "question_id string, claim int, subject string, attribute string, value string, cites array<int>"


class Script:
    """Recorded outputs: verdicts by round, claims by attempt."""

    def __init__(self, spark, verdicts, claims):
        self.spark, self.verdicts, self.claims = spark, verdicts, claims

    def plan(self, questions):
        return questions.select("question_id", F.array(F.lit(" ")).alias("queries"))

    def assess(self, questions, evidence, i):
        rows = [(q, *v[min(i, len(v) - 1)]) for q, v in self.verdicts.items()]
        return self.spark.createDataFrame(rows, VERDICT).join(questions.select("question_id"), "question_id", "left_semi")

    def synthesize(self, questions, evidence, attempt):
        rows = [(q, i, *c) for q, tries in self.claims.items() for i, c in enumerate(tries[min(attempt, len(tries)) - 1])]
        return self.spark.createDataFrame(rows, CLAIM).join(questions.select("question_id"), "question_id", "left_semi")


SUFFICIENT, EXHAUSTED = ("sufficient", None, [], [], []), ("exhausted", None, [], [], ["nothing more"])
GAP = ("gap", "corpus", [], ["again"], [])
TOOL = ("gap", "regulatory_status", [], ["brandx"], [])
OK, BAD = ("s", "a", "v", [0]), ("s", "a", "v", [99])


def test_terminal_states(spark):
    verdicts = {"ok": [SUFFICIENT], "cap": [GAP], "ex": [GAP, EXHAUSTED], "drop": [SUFFICIENT], "fix": [SUFFICIENT], "none": [SUFFICIENT], "empty": [SUFFICIENT], "tool": [TOOL, SUFFICIENT]}
    claims = {"ok": [[OK]], "cap": [[OK]], "ex": [[OK]], "drop": [[OK, BAD], [OK, BAD]], "fix": [[BAD], [OK]], "none": [[]], "empty": [[OK]], "tool": [[("s", "a", "v", [])]]}
    body = json.dumps({"results": [{"application_number": "N1", "openfda": {"brand_name": ["W"], "generic_name": ["P"]}, "submissions": [{"submission_type": "ORIG", "submission_status": "AP"}]}]})
    tools = seams.Replay(spark.createDataFrame([("approvals", "brandx", 200, body)], "tool string, query string, status int, body string"))
    questions = spark.createDataFrame([(q, f"question {q}") for q in verdicts], "question_id string, question string")

    def retriever(asked):
        assert all(r.queries for r in asked.collect())
        found = asked.where("question_id <> 'empty'").select("question_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(1))).alias("k"))
        return found.select("question_id", F.lit("d").alias("doc_id"), F.col("k").cast("long").alias("start"), F.col("k").cast("long").alias("end"), F.lit("t").alias("text"), F.col("k").alias("pos"))

    out = A.run_agent(questions, Script(spark, verdicts, claims), retriever, tools)
    got = {r.question_id: (r.terminal_state, r.used) for r in out["answers"].collect()}
    assert got == {
        "ok": ("answered", 1), "cap": ("insufficient_evidence", 3), "ex": ("partially_answered", 2), "drop": ("partially_answered", 1), "fix": ("answered", 1),
        "none": ("insufficient_evidence", 1), "empty": ("insufficient_evidence", 1), "tool": ("answered", 2),
    }
    tool = sorted((r.idx, r.doc_id, r.start) for r in out["evidence"].where("question_id = 'tool'").collect())
    assert tool == [(0, "d", 0), (1, "d", 1), (2, "openfda:N1", None)]
    assert "[2] FDA application N1: W (P); submission_status=AP" in A.listing(out["evidence"]).where("question_id = 'tool'").first().prompt
    with pytest.raises(ValueError, match="gap needs"):
        A.run_agent(questions.where("question_id = 'ok'"), Script(spark, {"ok": [("gap", None, [], [], [])]}, claims), retriever, tools)
    with pytest.raises(ValueError):
        A.run_agent(questions, None, retriever, None, 0)


def test_citations(spark):
    ev = spark.createDataFrame([("q", 0, "d", 1, 20), ("q", 1, "rec", None, None)], "question_id string, idx int, doc_id string, start int, end int")
    claims = spark.createDataFrame([("q", 0, "s", "a", "approved", [1, 0]), ("q", 1, "s", "a", "approved", [])], CLAIM)
    got = {r.claim: r.citations for r in S.resolve_citations(claims, ev).collect()}
    assert [c.doc_id for c in got[0]] == ["rec", "d"] and got[1] == []
    lines = {r.claim: r.line for r in S.render(S.resolve_citations(claims, ev)).collect()}
    assert lines == {0: "s | a: approved (rec, d:1-20)", 1: "s | a: approved (uncited)"}
    with pytest.raises(Exception, match="out of range"):
        S.resolve_citations(spark.createDataFrame([("q", 0, "s", "a", "v", [7])], CLAIM), ev).collect()
    assert {r.claim: len(r.citations) for r in S.resolve_citations(spark.createDataFrame([("q", 0, "s", "a", "v", [7])], CLAIM), ev, strict=False).collect()} == {0: 0}


def test_sanity_agents(spark):
    """Answers whose scores are known: the reference itself, nothing, shifted citations, wrong values, uncited claims."""
    span = lambda a, b: [{"doc_id": "d", "start": a, "end": b}]
    spans = "array<struct<doc_id: string, start: bigint, end: bigint>>"
    refs = [("r1", "alpha", "status", "approved", span(10, 12)), ("r2", "beta", "net sales", "USD 5m", span(30, 31))]
    agents = {
        "oracle": ([("alpha", "status", "approval granted", span(10, 12)), ("beta", "net sales", "USD 5,000,000", span(28, 40))], (1, 1, 1)),
        "silent": ([], (0, None, None)),
        "shifted": ([("alpha", "status", "approved", span(90, 95)), ("beta", "net sales", "USD 5m", span(91, 95))], (1, 0, 0)),
        "wrong": ([("alpha", "status", "filed", span(10, 12))], (0, 1, 1)),
        "uncited": ([("alpha", "status", "approved", [])], (0.5, 0, None)),
        "other": ([("gamma ray", "mass", "approved", span(1, 2))], (0, None, None)),
    }
    q = spark.createDataFrame([(a, "single", "answered") for a in agents] + [("absent", "single", "insufficient_evidence")], "question_id string, construct string, expected_terminal_state string")
    ans = spark.createDataFrame([(a, "answered") for a in agents] + [("absent", "insufficient_evidence")], "question_id string, terminal_state string")
    r = spark.createDataFrame([(a, *x) for a in agents for x in refs], f"question_id string, ref string, subject string, attribute string, value string, spans {spans}")
    c = spark.createDataFrame([(a, i, *x) for a, (cs, _) in agents.items() for i, x in enumerate(cs)], f"question_id string, claim int, subject string, attribute string, value string, citations {spans}")
    got = {x.question_id: x for x in S.score_answers(ans, c, r, q).collect()}
    for a, (_, want) in agents.items():
        assert (got[a].recall, got[a].precision, got[a].faithfulness) == want, a
    assert got["wrong"].wrong_value == ["r1"] and got["other"].n_unlisted == 1
    assert got["absent"].insufficient_pass and got["absent"].recall is None and got["absent"].precision is None


def test_artifact_round_trip(spark, tmp_path):
    payload = json.dumps({
        "assets": [{"generic_name": " ", "development_codes": ["ABC-1"], "brand_names": [], "aliases": [], "company": ""}, {"generic_name": None, "aliases": [" "]}],
        "programs": [{"asset_ref": "ABC-1", "indication": "UC", "region": "US", "stage": "P2", "therapeutic_area": "GI", "evidence": "quoted words"}],
        "trials": [{"asset_refs": ["ABC-1", "New one"], "indication": "UC", "phase": "2", "met_primary_endpoint": True, "evidence": "not there"}],
        "market_metrics": [{"subject_ref": "Acme", "metric": "revenue", "value": 1.5, "unit": "USD bn", "geography": "US"}],
    })
    chunks = spark.createDataFrame([("doc", 3, ["A", "B"], (4, 9), "some quoted words here", "Acme", "2024", payload)],
        "document_id string, chunk_index int, section_path array<string>, line_range struct<start: int, end: int>, text string, source_company string, as_of_date string, payload string")
    tables = X.map_payloads(chunks)
    assert [(r.id, r.company) for r in tables["assets"].collect()] == [("abc-1", "Acme")]
    p = tables["programs"].first()
    assert (p.id, p.asset_id, p.as_of_date, p.source_ref.snippet, p.source_ref.section, p.source_ref.line_range) == ("doc:3:program:0", "abc-1", "2024", "quoted words", "A > B", [4, 9])
    assert tables["trials"].first().source_ref.snippet == "some quoted words here" and tables["trials"].first().asset_ids == ["abc-1", "new-one"]
    texts = {r.kind: r.text for r in X.serialize_facts(tables).collect()}
    assert texts == {"program": "  ABC-1 | UC | US | P2 | GI", "trial": "  ABC-1 new-one | UC | phase 2", "market_metric": "Acme | revenue | US | 1.5 USD bn"}
    files.write_artifact(tables, {"model": "m"}, str(tmp_path / "a"))
    meta, back = files.read_artifacts(spark, str(tmp_path / "a"))
    assert meta.first().counts == {"assets": 1, "programs": 1, "trials": 1, "regulatory_events": 0, "market_metrics": 1}
    assert back["programs"].first().source_ref.snippet == "quoted words" and back["regulatory_events"].count() == 0
    (tmp_path / "bad.json").write_text(json.dumps({"schema_version": "2", "result": {}}))
    with pytest.raises(Exception, match="unsupported version"):
        files.read_artifacts(spark, str(tmp_path / "bad.json"))[0].collect()


def test_reports_golden_and_index(spark, tmp_path):
    (tmp_path / "report_2024_en.md").write_bytes("﻿# Title \r\nbody  \r\n".encode())
    r = files.read_reports(spark, str(tmp_path / "report_2024_en.md"), "Acme", "press_release").first()
    assert (r.id, r.title, r.language, r.lines) == ("report_2024_en", "Title", "en", ["# Title", "body", ""])
    with pytest.raises(ValueError):
        files.read_reports(spark, "x", "Acme", "leaflet")
    golden = {"golden_schema_version": "1", "document_id": "d", "labeled_chunks": [{"chunk_index": 1, "line_range": [1, 5], "programs": [{"asset": "x"}]}, {"chunk_index": 2}]}
    (tmp_path / "g.json").write_text(json.dumps(golden))
    assert files.read_golden(spark, str(tmp_path / "g.json")).count() == 2
    golden["labeled_chunks"][1]["chunk_index"] = 1
    (tmp_path / "g2.json").write_text(json.dumps(golden))
    with pytest.raises(Exception, match="repeated"):
        files.read_golden(spark, str(tmp_path / "g2.json")).collect()
    units = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "unit_id long, vector array<double>")
    index = files.build_index(units, str(tmp_path / "index"), "model")
    again = files.build_index(units.limit(0), str(tmp_path / "index"), "model")
    assert {x.unit_id: x.vector for x in again.collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0]} and files.index_meta(index).first().num_units == 2


def test_retries_and_calls(spark):
    waits, tries = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 4:
            raise seams.CallError(429)
        return "{}"

    assert seams.with_retries(flaky, waits.append) == "{}" and len(waits) == 3 and 4 <= waits[0] <= 6 and 16 <= waits[2] <= 18
    for status, n in ((429, 5), (503, 4), (400, 1)):
        tries.clear()

        def fail(status=status):
            tries.append(1)
            raise seams.CallError(status)

        with pytest.raises(seams.CallError):
            seams.with_retries(fail, waits.append)
        assert len(tries) == n
    df = spark.createDataFrame([("a",), ("b",)], "prompt string")
    assert sorted(r.response for r in seams.model_calls(df, lambda t: json.dumps({"x": t})).collect()) == ['{"x": "a"}', '{"x": "b"}']


def test_stream(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").write.parquet(str(tmp_path / "in"))
    ingest.append_units(ingest.stream_windows(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    from tessella.operators.chunking import windows

    assert spark.read.parquet(str(tmp_path / "out")).count() == windows(spark.read.parquet(str(tmp_path / "in"))).count()
