"""Connectors, the corpus registry, reports and command lines, all without a network."""

import json

import pytest
from pyspark.sql import functions as F

from tessella import __main__ as cli
from tessella import reports
from tessella.operators import recall
from tessella.sources import clients, corpus, files

GAP, DONE = ("gap", "trial_status", [], ["abc"], []), ("sufficient", None, [], [], [])


def recorded(url, params, headers, timeout):
    assert timeout == 15 and headers["User-Agent"]
    if url.endswith("/studies"):
        assert url == "https://mirror/v2/studies" and params["pageSize"] == "20" and "api_key" not in params
        return json.dumps({"studies": [{"protocolSection": {"identificationModule": {"nctId": "NCT" + params["query.intr"]}}}]})
    assert url == "https://api.fda.gov/drug/drugsfda.json" and params["api_key"] == "k" and params["limit"] == "20"
    return json.dumps({"results": [{"application_number": params["search"]}]})


def test_connectors(spark):
    trials = clients.trials_connector({"CLINICALTRIALS_API_BASE": "https://mirror/v2/"})
    tools = clients.Tools(recorded, trials, clients.approvals_connector({"OPENFDA_API_KEY": "k", "FDA_API_BASE": ""}))
    asked = spark.createDataFrame([("q", "abc")], "question_id string, query string")
    assert [(r.question_id, r.nct_id) for r in tools.trials(asked).collect()] == [("q", "NCTabc")]
    assert tools.approvals(asked).first().application_number == 'openfda.brand_name:"abc" OR openfda.generic_name:"abc"'
    assert clients.approvals_connector({}).base == clients.APPROVALS_BASE and clients.approvals_connector({}).key is None

    def broken(*_):
        raise OSError("status 500")

    with pytest.raises(Exception, match="status 500"):
        clients.Tools(broken, trials).trials(asked).collect()


def test_embedder(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "abc")], "id long, text string")
    model = clients.Embedder(lambda texts: [[len(t), 1.0] for t in texts], lambda texts: [[-1.0] for _ in texts])
    assert {r.id: r.vector for r in model.documents(rows).collect()} == {1: [1.0, 1.0], 2: None, 3: [3.0, 1.0]}
    assert {r.id: r.vector for r in model.queries(rows).collect()} == {1: [-1.0], 2: None, 3: [-1.0]}
    assert clients.embed_model({"EMBED_MODEL": "m"}) == "m" and clients.embed_model({"EMBED_MODEL": ""}) == clients.EMBED_MODEL


def written(tmp_path):
    (tmp_path / "one_2024_en.md").write_text("# One\nAsset ABC-1 in ulcerative colitis, phase 2 in the US\n\n## Two\nmore text\n")
    (tmp_path / "two.md").write_text("# Other\nnothing\n")
    entries = [{"path": str(tmp_path / "one_2024_en.md"), "source_company": "Acme", "doc_type": "press_release", "artifact": str(tmp_path / "out/document_id=one_2024_en")}, {"path": str(tmp_path / "two.md"), "source_company": "B", "doc_type": "press_release"}]
    (tmp_path / "registry.json").write_text(json.dumps(entries))
    return str(tmp_path / "registry.json")


def test_registry(spark, tmp_path):
    path = written(tmp_path)
    docs = corpus.read_corpus(spark, corpus.read_registry(spark, path))
    assert {(r.id, r.title, r.source_company) for r in docs.collect()} == {("one_2024_en", "One", "Acme"), ("two", "Other", "B")}
    with pytest.raises(ValueError):
        corpus.read_corpus(spark, [])
    (tmp_path / "bad.json").write_text('[{"path": "x", "source_company": "y", "doc_type": "z", "unknown": 1}]')
    with pytest.raises(TypeError):
        corpus.read_registry(spark, str(tmp_path / "bad.json"))


def test_reports_and_guards(spark, tmp_path):
    table = spark.createDataFrame([("b|c", 0.123456, None), ("a", 2.0, 1)], "name string, x double, n long")
    page = reports.write_report(spark, str(tmp_path / "r"), "Title", {"figures": table})
    assert page.split("\n")[:5] == ["# Title", "", "## figures", "", "| name | x | n |"] and "| a | 2 | 1 |" in page and "| b\\|c | 0.1235 |  |" in page
    assert spark.read.json(str(tmp_path / "r/figures")).count() == 2 and spark.read.text(str(tmp_path / "r/report"), wholetext=True).first()[0] == page
    figures = recall.guards(spark.createDataFrame([("a", 0.5, 0.504), ("b", 0.5, 0.51), ("c", None, 0.1)], "name string, measured double, expected double"))
    with pytest.raises(reports.GuardsFailed, match="b, c"):
        reports.write_report(spark, str(tmp_path / "s"), "T", {"figures": figures}, figures)
    assert not (tmp_path / "s").exists()


def answer(prompt):
    return json.dumps({"programs": [{"asset_ref": "ABC-1", "indication": "ulcerative colitis", "region": "US", "stage": "P2", "evidence": "Asset ABC-1"}]} if "ABC-1" in prompt else {})


def call():
    return answer


class Model:
    def __init__(self, spark):
        self.spark = spark

    def plan(self, questions):
        return questions.select("question_id", F.array("question").alias("queries"))

    def assess(self, questions, evidence, i):
        schema = "kind string, gap_kind string, missing_slots array<string>, follow_ups array<string>, gaps array<string>"
        return questions.select("question_id").join(self.spark.createDataFrame([DONE], schema), F.lit(True))

    def synthesize(self, questions, evidence, attempt):
        return questions.select("question_id", F.lit(0).alias("claim"), F.lit("s").alias("subject"), F.lit("a").alias("attribute"), F.lit("v").alias("value"), F.array(F.lit(0)).alias("cites"))


def retriever(spark):
    return lambda plans: plans.select("question_id", F.lit("d").alias("doc_id"), F.lit(1).cast("long").alias("start"), F.lit(2).cast("long").alias("end"), F.col("queries")[0].alias("text"), F.lit(0).alias("pos"))


def test_command_lines(spark, tmp_path, capsys):
    registry, here = written(tmp_path), "tests.test_sources"
    assert cli.main(["ask", "why?", "--llm", f"{here}:Model", "--retriever", f"{here}:retriever", "--question-id", "q1"]) == 0
    assert capsys.readouterr().out.splitlines() == ["question: why?", "state: answered (sufficient)", "- s | a: v (d:1-2)"]
    with pytest.raises(SystemExit):
        cli.main(["ask", "why?", "--llm", f"{here}:Model", "--retriever", f"{here}:retriever", "--max-iterations", "0"])
    assert cli.main(["extract", registry, str(tmp_path / "out"), "--call", f"{here}:call"]) == 0
    assert "| programs | 1 |" in capsys.readouterr().out
    assert {r.document_id for r in spark.read.text(str(tmp_path / "out")).select("document_id").collect()} == {"one_2024_en"}
    assert files.read_artifacts(spark, str(tmp_path / "out/document_id=one_2024_en"))[1]["programs"].first().asset_id == "abc-1"
    with pytest.raises(ValueError):
        cli.main(["extract", registry, str(tmp_path / "out2"), "--call", f"{here}:call", "--chunks", "9"])
    assert cli.main(["score", registry, str(tmp_path / "scored")]) == 0
    page = capsys.readouterr().out
    assert all(f"| programs | {name} | grounded | 1 |" in page for name in ("asset", "indication", "region", "stage"))
    (tmp_path / "figures.json").write_text('{"name": "f", "measured": 1.0, "expected": 2.0}\n')
    assert cli.main(["check", str(tmp_path / "figures.json"), str(tmp_path / "checked")]) == 1 and not (tmp_path / "checked").exists()
