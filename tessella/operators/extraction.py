"""From a model's payload for each chunk to typed fact tables with citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella import schemas
from tessella.functions.text import slug
from tessella.session import checkpoint

SNIPPET = 600


def _filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _named(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def primary_identifier(a: Column) -> Column:
    """The first of generic name, first code, first brand, first alias that is not blank."""
    first = lambda c: _named(F.get(a[c], F.lit(0)))
    return F.coalesce(_named(a["generic_name"]), first("development_codes"), first("brand_names"), first("aliases"))


def source_ref(evidence: Column, as_of: Column) -> Column:
    """The citation of a fact of a chunk: the quotation if the chunk has it word for word, else the chunk's beginning."""
    quoted = F.when((evidence != "") & F.col("text").contains(evidence), evidence)
    return F.struct(
        F.col("document_id"), F.lit(None).cast("int").alias("page"),
        F.when(F.size("section_path") > 0, F.array_join("section_path", " > ")).alias("section"),
        F.array(F.col("line_range.start"), F.col("line_range.end")).alias("line_range"),
        F.coalesce(quoted, F.substring("text", 1, SNIPPET)).alias("snippet"), as_of.alias("as_of_date"),
    )


def map_payloads(chunks: DataFrame, payload: str = "payload") -> dict[str, DataFrame]:
    """The five tables by name, each with ``document_id, chunk_index, ordinal`` and the entity's columns.

    ``chunks``: document_id, chunk_index, section_path, line_range, text, source_company, as_of_date and the payload as JSON. Facts stay in
    chunk order by their ordinals and are not deduplicated; assets without any identifier are dropped. Payloads are parsed once for all tables.
    """
    rows = checkpoint(chunks.withColumn("x", F.from_json(payload, schemas.PAYLOAD)).drop(payload))

    def each(name: str) -> DataFrame:
        return rows.select("*", F.posexplode(f"x.{name}").alias("ordinal", "f"))

    at = ["document_id", "chunk_index", "ordinal"]
    f, base = (lambda c: F.col("f")[c]), F.concat_ws(":", "document_id", F.col("chunk_index").cast("string"))
    as_of = F.coalesce(_filled(F.col("as_of_date")), F.lit(None))
    ref = source_ref(f("evidence"), F.col("as_of_date")).alias("source_ref")
    copy = lambda *names: [f(n).alias(n) for n in names]
    number = lambda kind: F.concat_ws(":", base, F.lit(kind), F.col("ordinal").cast("string")).alias("id")
    primary = primary_identifier(F.col("f"))
    return {
        "assets": each("assets").where(primary.isNotNull()).select(
            *at, slug(primary).alias("id"), *copy("generic_name", "development_codes", "brand_names", "aliases"),
            F.coalesce(_filled(f("company")), F.col("source_company")).alias("company"),
            *copy("originator_company", "target", "mechanism_of_action", "modality", "route"),
        ),
        "programs": each("programs").select(
            *at, number("program"), slug(F.trim(f("asset_ref"))).alias("asset_id"), *copy("therapeutic_area", "indication", "line_of_therapy", "region", "stage", "status_reason", "formulation"),
            F.coalesce(_filled(f("as_of_date")), as_of).alias("as_of_date"), ref,
        ),
        "trials": each("trials").select(
            *at, number("trial"), *copy("trial_name", "nct_id"), F.transform(f("asset_refs"), lambda a: slug(F.trim(a))).alias("asset_ids"),
            *copy("indication", "phase", "comparator", "primary_endpoint", "met_primary_endpoint", "statistical_significance", "endpoint_result", "readout_date", "region"), ref,
        ),
        "regulatory_events": each("regulatory_events").select(
            *at, slug(F.trim(f("asset_ref"))).alias("asset_id"), *copy("agency", "region", "action", "status", "date", "indication"), ref,
        ),
        "market_metrics": each("market_metrics").select(
            *at, f("subject_ref").alias("subject"), *copy("metric", "value", "unit", "currency", "basis", "period", "geography"), ref,
        ),
    }


def count_by_type(tables: dict[str, DataFrame]) -> DataFrame:
    """``entity_type, n``."""
    out = None
    for name, table in tables.items():
        one = table.agg(F.count("*").alias("n")).select(F.lit(name).alias("entity_type"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def asset_tokens(assets: DataFrame) -> DataFrame:
    """``id, tokens``: all names of an asset; of assets with one id the last in document order counts."""
    last = assets.groupBy("id").agg(F.max_by(F.struct("generic_name", "development_codes", "brand_names", "aliases"), F.struct("document_id", "chunk_index", "ordinal")).alias("a"))
    every = F.concat(F.array("a.generic_name"), *[F.coalesce(f"a.{c}", F.array().cast("array<string>")) for c in ("development_codes", "brand_names", "aliases")])
    return last.select("id", F.array_join(F.filter(every, lambda x: F.coalesce(x != "", F.lit(False))), " ").alias("tokens"))


def serialize_facts(tables: dict[str, DataFrame]) -> DataFrame:
    """Facts as retrieval units: ``kind, document_id, chunk_index, ordinal, start, end, text``; blank texts are left out.

    Fields are joined by " | ", empty ones omitted; asset ids become all names of the asset, where it is known.
    """
    names = asset_tokens(tables["assets"])
    joined = lambda *fields: F.concat_ws(" | ", *[_filled(x) for x in fields])
    where = [F.col("source_ref.line_range")[0].alias("start"), F.col("source_ref.line_range")[1].alias("end")]
    at = ["document_id", "chunk_index", "ordinal"]

    def resolved(kind: str, key: str) -> DataFrame:
        rows = tables[kind].join(names.withColumnRenamed("id", key), key, "left")
        return rows.withColumn("asset", F.coalesce(_filled(F.col("tokens")), F.col(key)))

    program = resolved("programs", "asset_id").select(F.lit("program").alias("kind"), *at, *where, joined(*[F.col(c) for c in ("asset", "indication", "region", "stage", "therapeutic_area")]).alias("text"))
    event = resolved("regulatory_events", "asset_id").select(F.lit("regulatory_event").alias("kind"), *at, *where, joined(*[F.col(c) for c in ("asset", "indication", "region", "action", "agency")]).alias("text"))
    spread = tables["trials"].select(*at, F.posexplode("asset_ids").alias("k", "id")).join(names, "id", "left")
    own = spread.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce(_filled(F.col("tokens")), F.col("id")).alias("t")))).alias("x"))
    trials = tables["trials"].join(own, at, "left").withColumn("asset", F.coalesce(F.array_join(F.transform("x", lambda x: x["t"]), " "), F.lit("")))
    phase = F.when(F.coalesce(F.col("phase"), F.lit("")) != "", F.concat(F.lit("phase "), "phase"))
    trial = trials.select(F.lit("trial").alias("kind"), *at, *where, joined(F.col("asset"), F.col("indication"), phase, F.col("trial_name")).alias("text"))
    amount = F.when(F.col("value").isNotNull(), F.concat(F.col("value").cast("string"), F.lit(" "), F.coalesce("unit", F.lit("None"))))
    metric = resolved("market_metrics", "subject").select(F.lit("market_metric").alias("kind"), *at, *where, joined(F.col("asset"), F.col("metric"), F.col("geography"), amount).alias("text"))
    return program.unionByName(trial).unionByName(event).unionByName(metric).where(F.trim("text") != "")
