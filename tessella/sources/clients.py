"""Live look-ups and embeddings behind the same seams as the recorded ones.

A transport is any picklable (url, params, headers, timeout) -> body; it raises on a failed request. ``http_transport`` is the live one, tests
pass recorded ones. Requests run in the tasks of the rows that ask.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlencode
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources import seams

Transport = Callable[[str, dict, dict, float], str]
#: The public services and how they are named.
TRIALS_BASE, APPROVALS_BASE = "https://clinicaltrials.gov/api/v2", "https://api.fda.gov"
HEADERS = {"User-Agent": "tessella/1 (document analytics)", "Accept": "application/json"}
#: The embedding model that is used if none is named.
EMBED_MODEL = "BAAI/bge-small-en-v1.5"


@dataclass(frozen=True)
class Connector:
    """Where a service is reached; empty settings count as unset, and a trailing / of the base is dropped."""

    base: str
    key: str | None = None
    timeout_s: float = seams.TIMEOUT_S
    headers: dict = field(default_factory=lambda: dict(HEADERS))

    @staticmethod
    def of(default: str, options: dict[str, str | None] | None = None, base: str = "base", key: str = "key") -> Connector:
        """From ``options`` (such as the environment), by the names of the settings."""
        given = options or {}
        return Connector((given.get(base) or default).rstrip("/"), given.get(key) or None)


def trials_connector(options: dict[str, str | None] | None = None) -> Connector:
    return Connector.of(TRIALS_BASE, os.environ if options is None else options, "CLINICALTRIALS_API_BASE")


def approvals_connector(options: dict[str, str | None] | None = None) -> Connector:
    return Connector.of(APPROVALS_BASE, os.environ if options is None else options, "FDA_API_BASE", "OPENFDA_API_KEY")


def http_transport(url: str, params: dict, headers: dict, timeout: float) -> str:
    """The body of a GET; any status but success raises."""
    with urlopen(Request(f"{url}?{urlencode(params)}", headers=headers), timeout=timeout) as response:  # noqa: S310
        return response.read().decode("utf-8")


def trials_request(query: str) -> dict[str, str]:
    return {"query.intr": query, "pageSize": str(seams.PAGE), "format": "json"}


def approvals_request(query: str) -> dict[str, str]:
    return {"search": f'openfda.brand_name:"{query}" OR openfda.generic_name:"{query}"', "limit": str(seams.PAGE)}


def _bodies(asked: DataFrame, url: str, request: Callable[[str], dict], connector: Connector, transport: Transport) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema) + ", body string"
    key = {"api_key": connector.key} if connector.key else {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(body=[transport(url, request(q) | key, connector.headers, connector.timeout_s) for q in batch["query"]])

    return asked.mapInPandas(run, schema)


class Tools:
    """The tools of ``run_agent``: one request for each row (question_id, query), no paging."""

    def __init__(self, transport: Transport = http_transport, trials: Connector | None = None, approvals: Connector | None = None):
        self.transport, self.to_trials, self.to_approvals = transport, trials or trials_connector(), approvals or approvals_connector()

    def trials(self, asked: DataFrame) -> DataFrame:
        return seams.parse_trials(_bodies(asked, f"{self.to_trials.base}/studies", trials_request, self.to_trials, self.transport))

    def approvals(self, asked: DataFrame) -> DataFrame:
        return seams.parse_approvals(_bodies(asked, f"{self.to_approvals.base}/drug/drugsfda.json", approvals_request, self.to_approvals, self.transport))


def embed_model(options: dict[str, str | None] | None = None) -> str:
    return (os.environ if options is None else options).get("EMBED_MODEL") or EMBED_MODEL


class Embedder:
    """Vectors from a model (list of texts -> list of vectors), in Arrow batches; queries may have an encoding of their own."""

    def __init__(self, encode: Callable[[list[str]], list], encode_queries: Callable[[list[str]], list] | None = None):
        self.encode, self.encode_queries = encode, encode_queries or encode

    def documents(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """``rows`` with ``vector array<float>``; null texts have a null vector."""
        return _embedded(rows, text, self.encode)

    def queries(self, rows: DataFrame, text: str = "text") -> DataFrame:
        return _embedded(rows, text, self.encode_queries)


def _embedded(rows: DataFrame, text: str, encode: Callable[[list[str]], list]) -> DataFrame:
    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        known = texts.dropna()
        made = iter(encode(known.tolist()) if len(known) else [])
        return pd.Series([None if t is None or t != t else [float(x) for x in next(made)] for t in texts], dtype=object)

    return rows.withColumn("vector", vectors(F.col(text)))
