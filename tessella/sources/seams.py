"""External services as tables: trial registry and approval records, model calls; all replayable from recorded bodies.

Live calls need a network; each client takes a transport (url, params -> body), and the parsers read bodies from a
column, so recorded responses go through the same plans.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIALS = (
    "struct<studies: array<struct<protocolSection: struct<identificationModule: struct<nctId: string, briefTitle: string>, "
    "statusModule: struct<overallStatus: string>, designModule: struct<phases: array<string>>>>>>"
)
APPROVALS = (
    "struct<results: array<struct<application_number: string, openfda: struct<brand_name: array<string>, generic_name: array<string>>, "
    "submissions: array<struct<submission_type: string, submission_status: string>>>>>"
)
TIMEOUT_S, PAGE = 15, 20
RETRIES = {429: (5, 4.0), 503: (4, 1.0)}


def parse_trials(rows: DataFrame, body: str = "body") -> DataFrame:
    """The columns of ``rows`` with ``nct_id, title, status, phase`` for each study; what is missing is empty."""
    s = F.explode(F.from_json(body, TRIALS)["studies"]).alias("s")
    text = lambda c: F.coalesce(c, F.lit(""))
    p = F.col("s.protocolSection")
    return rows.select(*[c for c in rows.columns if c != body], s).select(
        *[c for c in rows.columns if c != body], text(p["identificationModule"]["nctId"]).alias("nct_id"),
        text(p["identificationModule"]["briefTitle"]).alias("title"), text(p["statusModule"]["overallStatus"]).alias("status"),
        text(F.array_join(p["designModule"]["phases"], ", ")).alias("phase"),
    )


def parse_approvals(rows: DataFrame, body: str = "body") -> DataFrame:
    """``application_number, brand_name, generic_name, submission_status``: first names, and the first original submission's status."""
    r = F.explode(F.from_json(body, APPROVALS)["results"]).alias("r")
    first = lambda a: F.coalesce(F.get(a, F.lit(0)), F.lit(""))
    original = F.filter("r.submissions", lambda s: s["submission_type"] == "ORIG")
    keep = [c for c in rows.columns if c != body]
    return rows.select(*keep, r).select(
        *keep, F.coalesce("r.application_number", F.lit("")).alias("application_number"), first(F.col("r.openfda.brand_name")).alias("brand_name"),
        first(F.col("r.openfda.generic_name")).alias("generic_name"), F.coalesce(F.get(original, F.lit(0))["submission_status"], F.lit("")).alias("submission_status"),
    )


def trial_params(query: Column) -> Column:
    return F.create_map(F.lit("query.intr"), query, F.lit("pageSize"), F.lit(str(PAGE)), F.lit("format"), F.lit("json"))


def approval_search(query: Column) -> Column:
    return F.concat(F.lit('openfda.brand_name:"'), query, F.lit('" OR openfda.generic_name:"'), query, F.lit('"'))


class Replay:
    """Tools that answer from a table of recorded bodies: tool, query, status, body. Unknown or failed look-ups raise."""

    def __init__(self, recorded: DataFrame):
        self.recorded = recorded

    def _bodies(self, asked: DataFrame, tool: str) -> DataFrame:
        known = self.recorded.where(F.col("tool") == tool).select("query", "status", "body")
        found = asked.join(known, "query", "left")
        failed = F.coalesce(F.col("status"), F.lit(404)) >= 400
        return found.withColumn("body", F.when(failed, F.raise_error(F.concat(F.lit("look-up failed: "), "query"))).otherwise(F.col("body"))).drop("status")

    def trials(self, asked: DataFrame) -> DataFrame:
        return parse_trials(self._bodies(asked, "trials"))

    def approvals(self, asked: DataFrame) -> DataFrame:
        return parse_approvals(self._bodies(asked, "approvals"))


class CallError(Exception):
    """A failed call with its HTTP status."""

    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


def with_retries(call: Callable[[], str], sleep: Callable[[float], None] = time.sleep, rng: random.Random | None = None) -> str:
    """Calls until it succeeds: rate limits and overloads are retried with growing pauses and jitter, other errors raise."""
    rng, tried = rng or random.Random(), 0
    while True:
        try:
            return call()
        except CallError as e:
            most, base = RETRIES.get(e.status, (0, 0.0))
            tried += 1
            if tried >= most:
                raise
            sleep(base * 2 ** (tried - 1) + rng.uniform(0, base / 2))


def model_calls(rows: DataFrame, call: Callable[[str], str], prompt: str = "prompt", pause_s: float = 0.0) -> DataFrame:
    """``rows`` with ``response``: one call for each row, in the row's task, paced by ``pause_s``; JSON or an error.

    For calls under one quota, coalesce to one partition first.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", response string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for batch in batches:
            out = []
            for text in batch[prompt]:
                if not first and pause_s:
                    time.sleep(pause_s)
                first = False
                answer = with_retries(lambda text=text: call(text))
                json.loads(answer)  # what cannot be parsed is an error
                out.append(answer)
            yield batch.assign(response=out)

    return rows.mapInPandas(run, schema)
