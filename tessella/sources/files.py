"""Reports, extraction artifacts, golden labels, index tables: readers and writers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import schemas
from tessella.functions.text import language_of, normalize_lines, title_of
from tessella.operators.retrieval import unit_vector

VERSION = "1"


def read_reports(spark: SparkSession, path: str, source_company: str, doc_type: str, title: str | None = None, publication_date: str | None = None,
                 period_covered: str | None = None, url: str | None = None, language: str | None = None) -> DataFrame:
    """One row for each markdown file: ``id`` (the file's stem), the given metadata, ``text`` and ``lines``."""
    if doc_type not in schemas.DOC_TYPES:
        raise ValueError(f"doc_type {doc_type!r} is not allowed")
    raw = spark.read.text(path, wholetext=True).select("value", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("id"))
    rows = raw.select("id", normalize_lines(F.col("value")).alias("text")).withColumn("lines", F.split("text", "\n", -1))
    given = {"source_company": source_company, "doc_type": doc_type, "publication_date": publication_date, "period_covered": period_covered, "url": url}
    named = rows.withColumns({k: F.lit(v).cast("string") for k, v in given.items()})
    return named.withColumn("title", F.coalesce(F.lit(title).cast("string"), title_of(F.col("lines")))).withColumn(
        "language", F.coalesce(F.lit(language).cast("string"), language_of(F.col("id")))
    )


def _versioned(rows: DataFrame, column: str, expected: str) -> DataFrame:
    wrong = F.concat(F.lit("unsupported version: "), F.coalesce(F.col(column), F.lit("none")))
    return rows.withColumn(column, F.when(F.col(column) == expected, F.col(column)).otherwise(F.raise_error(wrong)))


def read_artifacts(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """``meta`` and the five entity tables (with ``ordinal``) of extraction artifacts; any other version raises an error."""
    rows = _versioned(spark.read.schema(schemas.ARTIFACT).option("multiLine", True).option("mode", "FAILFAST").json(path), "schema_version", VERSION)
    tables = {}
    for name in schemas.ENTITIES:
        tables[name] = rows.select("schema_version", F.posexplode(f"result.{name}").alias("ordinal", "e")).where("schema_version is not null").select("ordinal", "e.*")
    return rows.select("schema_version", "meta", "counts"), tables


def write_artifacts(tables: dict[str, DataFrame], meta: dict[str, str], path: str) -> None:
    """One folder ``document_id=...`` under ``path`` for each document, with its JSON artifact; a task holds one document's entities.

    ``tables`` carry ``document_id``, ``chunk_index`` and ``ordinal``, by which entities are ordered and which are not written.
    """
    every = None
    for name, rows in tables.items():
        entity = F.struct(*[c for c in rows.columns if c not in ("document_id", "chunk_index", "ordinal")])
        one = rows.select("document_id", F.lit(name).alias("name"), F.struct("chunk_index", "ordinal", F.to_json(entity).alias("e")).alias("x"))
        every = one if every is None else every.unionByName(one)
    items = F.array_sort(F.collect_list("x")).alias("x")
    held = every.groupBy("document_id", "name").agg(F.transform(items, lambda x: x["e"]).alias("items"))
    found = held.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "items"))).alias("m"))
    _artifact(found, list(tables), meta, "document_id").write.partitionBy("document_id").mode("overwrite").text(path)


def _artifact(found: DataFrame, names: list[str], meta: dict[str, str], *own: str) -> DataFrame:
    """``own`` columns and ``value``, the artifact's text, of rows with ``m``, each table's entities as JSON by its name."""
    of = lambda n: F.coalesce(F.col("m")[n], F.array().cast("array<string>"))
    listed = lambda n: F.concat(F.lit(f'"{n}": ['), F.array_join(of(n), ", "), F.lit("]"))
    head = json.dumps({"schema_version": VERSION, "meta": meta}, ensure_ascii=False)[:-1]
    counts = F.to_json(F.create_map(*[x for n in names for x in (F.lit(n), F.size(of(n)))]))
    text = F.concat(F.lit(head + ', "counts": '), counts, F.lit(', "result": {'), F.concat_ws(", ", *[listed(n) for n in names]), F.lit("}}"))
    return found.select(*own, text.alias("value"))


def write_artifact(tables: dict[str, DataFrame], meta: dict[str, str], path: str) -> None:
    """The tables of one document as one JSON artifact, for exchange; several documents are refused (see ``write_artifacts``)."""
    for rows in tables.values():
        if "document_id" in rows.columns and rows.select("document_id").distinct().limit(2).count() > 1:
            raise ValueError("these tables hold several documents")
    named = None
    for name, rows in tables.items():
        order = [c for c in ("document_id", "chunk_index", "ordinal") if c in rows.columns]
        entity = F.struct(*[c for c in rows.columns if c not in ("document_id", "chunk_index", "ordinal")])
        items = F.array_sort(F.collect_list(F.struct(*order, F.to_json(entity).alias("e"))))
        one = rows.agg(F.transform(items, lambda x: x["e"]).alias("items")).select(F.lit(name).alias("name"), "items")
        named = one if named is None else named.unionByName(one)
    found = named.agg(F.map_from_entries(F.collect_list(F.struct("name", "items"))).alias("m"))
    _artifact(found, list(tables), meta).coalesce(1).write.mode("overwrite").text(path)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Labelled chunks: one row each with the document's fields; wrong versions, chunks without labels' chunk numbers
    and repeated chunk numbers raise an error."""
    rows = _versioned(spark.read.schema(schemas.GOLDEN).option("multiLine", True).option("mode", "FAILFAST").json(path), "golden_schema_version", VERSION)
    numbers = F.transform("labeled_chunks", lambda c: c["chunk_index"])
    twice = (F.size("labeled_chunks") < 1) | (F.size(F.array_distinct(numbers)) != F.size(numbers))
    rows = rows.withColumn("labeled_chunks", F.when(F.coalesce(twice, F.lit(True)), F.raise_error(F.lit("chunk numbers are missing or repeated"))).otherwise(F.col("labeled_chunks")))
    own = [c for c in rows.columns if c != "labeled_chunks"]
    return rows.select(*own, F.explode("labeled_chunks").alias("c")).select(*own, "c.*")


def read_answer_golden(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Questions, and their reference claims with spans (null lines for records)."""
    rows = spark.read.schema(schemas.ANSWER_GOLDEN).option("multiLine", True).option("mode", "FAILFAST").json(path)
    q = rows.select(F.explode("questions").alias("q")).select("q.*")
    span = lambda s: F.struct(s["doc_id"].alias("doc_id"), F.get(s["line_range"], F.lit(0)).alias("start"), F.get(s["line_range"], F.lit(1)).alias("end"))
    refs = q.select("question_id", F.explode("reference_claims").alias("r"))
    refs = refs.select("question_id", F.col("r.claim_id").alias("ref"), "r.subject", "r.attribute", "r.value", F.transform("r.acceptable_spans", span).alias("spans"))
    return q.drop("reference_claims"), refs


def build_index(units: DataFrame, path: str, model: str, rebuild: bool = False) -> DataFrame:
    """The units with normalized vectors, written once as Parquet under ``path`` and read from there later."""
    spark = units.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS"))
    if rebuild or not there:
        units.withColumn("vector", unit_vector(F.col("vector"))).withColumn("embed_model", F.lit(model)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def index_meta(index: DataFrame) -> DataFrame:
    return index.agg(
        F.first("embed_model").alias("embed_model"), F.max(F.size("vector")).alias("dim"), F.count("*").alias("num_units"), F.lit("cosine").alias("metric")
    )
