"""The corpus registry: which reports there are, with their metadata, labels and artifacts."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from tessella.sources import files


@dataclass(frozen=True)
class Report:
    """One report of the corpus. Paths are any that Spark reads; labels and artifact may be missing."""

    path: str
    source_company: str
    doc_type: str
    title: str | None = None
    publication_date: str | None = None
    golden: str | None = None
    artifact: str | None = None
    scope: str = ""


def read_registry(spark: SparkSession, path: str) -> list[Report]:
    """The reports listed in a JSON file (an array of objects with the fields of Report); unknown fields are an error."""
    return [Report(**entry) for entry in json.loads(spark.read.text(path, wholetext=True).first()[0])]


def read_corpus(spark: SparkSession, reports: list[Report]) -> DataFrame:
    """The reports' texts and lines with their metadata, as from ``read_reports``, in one table."""
    if not reports:
        raise ValueError("the registry lists no report")
    read = [files.read_reports(spark, r.path, r.source_company, r.doc_type, r.title, r.publication_date) for r in reports]
    return reduce(DataFrame.unionByName, read)
