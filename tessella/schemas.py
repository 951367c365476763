"""Schemas of the domain's tables, their closed vocabularies and validators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The closed vocabularies.
DOC_TYPES = ["pipeline_table", "financial_report", "press_release", "other"]
REGIONS = ["US", "EU", "JP", "CN", "Global", "other"]
STAGES = ["preclinical", "P1", "P1/2", "P2", "P2a", "P2b", "P3", "filed", "approved", "discontinued"]
PHASES = ["1", "1/2", "2", "2a", "2b", "3", "4"]
AGENCIES = ["FDA", "EMA", "PMDA", "NMPA", "MHLW", "other"]
ACTIONS = [
    "filed", "approval", "CRL", "priority_review", "breakthrough", "fast_track", "orphan", "PRIME", "CHMP_opinion",
    "application_withdrawal", "product_withdrawal", "other",
]
STATUSES = ["granted", "pending", "denied"]
METRICS = ["revenue", "growth_rate", "market_share", "patient_count", "country_count"]
BASES = ["reported", "constant_currency"]

SOURCE_REF = "struct<document_id: string, page: int, section: string, line_range: array<int>, snippet: string, as_of_date: string>"
ASSET = (
    "struct<id: string, generic_name: string, development_codes: array<string>, brand_names: array<string>, aliases: array<string>, "
    "company: string, originator_company: string, target: string, mechanism_of_action: string, modality: string, route: string>"
)
PROGRAM = (
    "struct<id: string, asset_id: string, therapeutic_area: string, indication: string, line_of_therapy: string, region: string, "
    f"stage: string, status_reason: string, formulation: string, as_of_date: string, source_ref: {SOURCE_REF}>"
)
TRIAL = (
    "struct<id: string, trial_name: string, nct_id: string, asset_ids: array<string>, indication: string, phase: string, comparator: string, "
    "primary_endpoint: string, met_primary_endpoint: boolean, statistical_significance: string, endpoint_result: string, readout_date: string, "
    f"region: string, source_ref: {SOURCE_REF}>"
)
REGULATORY_EVENT = (
    "struct<asset_id: string, agency: string, region: string, action: string, status: string, date: string, indication: string, "
    f"source_ref: {SOURCE_REF}>"
)
MARKET_METRIC = (
    "struct<subject: string, metric: string, value: double, unit: string, currency: string, basis: string, period: string, geography: string, "
    f"source_ref: {SOURCE_REF}>"
)
ENTITIES = {"assets": ASSET, "programs": PROGRAM, "trials": TRIAL, "regulatory_events": REGULATORY_EVENT, "market_metrics": MARKET_METRIC}
ARTIFACT = (
    "schema_version string, meta map<string, string>, counts map<string, int>, result struct<"
    + ", ".join(f"{name}: array<{kind}>" for name, kind in ENTITIES.items())
    + ">"
)
PAYLOAD = (
    "struct<assets: array<struct<generic_name: string, development_codes: array<string>, brand_names: array<string>, aliases: array<string>, "
    "company: string, originator_company: string, target: string, mechanism_of_action: string, modality: string, route: string, evidence: string>>, "
    "programs: array<struct<asset_ref: string, therapeutic_area: string, indication: string, region: string, stage: string, line_of_therapy: string, "
    "status_reason: string, formulation: string, as_of_date: string, evidence: string>>, "
    "trials: array<struct<asset_refs: array<string>, indication: string, phase: string, trial_name: string, nct_id: string, comparator: string, "
    "primary_endpoint: string, met_primary_endpoint: boolean, statistical_significance: string, endpoint_result: string, readout_date: string, "
    "region: string, evidence: string>>, "
    "regulatory_events: array<struct<asset_ref: string, agency: string, region: string, action: string, indication: string, status: string, "
    "date: string, evidence: string>>, "
    "market_metrics: array<struct<subject_ref: string, metric: string, value: double, unit: string, period: string, geography: string, "
    "currency: string, basis: string, evidence: string>>>"
)
GOLDEN = (
    "golden_schema_version string, document_id string, source_company string, artifact string, reporting_period string, as_of_date string, "
    "labeled_chunks array<struct<chunk_index: int, line_range: array<int>, note: string, "
    "assets: array<struct<identifiers: array<string>, modality: string, target: string>>, "
    "programs: array<struct<asset: string, indication: string, region: string, stage: string, therapeutic_area: string, line_of_therapy: string>>, "
    "trials: array<struct<indication: string, phase: string, trial_name: string, nct_id: string, assets: array<string>, primary_endpoint: string, "
    "met_primary_endpoint: boolean>>, "
    "regulatory_events: array<struct<asset: string, action: string, indication: string, region: string, agency: string, from_progress_row: boolean, "
    "status: string, date: string>>, "
    "market_metrics: array<struct<subject: string, metric: string, geography: string, value: double, unit: string, currency: string, period: string, "
    "basis: string>>>>"
)
ANSWER_GOLDEN = (
    "golden_schema_version string, questions array<struct<question_id: string, question: string, construct: string, expected_terminal_state: string, "
    "expected_route: string, reference_claims: array<struct<claim_id: string, subject: string, attribute: string, value: string, "
    "acceptable_spans: array<struct<doc_id: string, line_range: array<int>>>>>, verified_gap: string, verified_absence: string, authoring_notes: string>>"
)


def has_identifier(generic: Column, *arrays: Column) -> Column:
    """Whether an asset has a non-blank name, code, brand or alias."""
    blank = lambda x: F.coalesce(F.trim(x) == "", F.lit(True))
    out = ~blank(generic)
    for a in arrays:
        out = out | F.coalesce(F.exists(a, lambda x: ~blank(x)), F.lit(False))
    return out


def violations(rows: DataFrame, kind: str) -> Column:
    """``array<string>``: which rules a row of an entity table breaks; empty if none."""

    def outside(name: str, allowed: list[str], optional: bool = False) -> Column:
        bad = F.coalesce(~F.col(name).isin(allowed), F.lit(not optional))
        return F.when(bad, F.lit(f"{name} is not allowed"))

    ref = F.when(F.col("source_ref").isNull(), "source_ref is missing") if "source_ref" in rows.columns else F.lit(None)
    rules = {
        "assets": lambda: [F.when(~has_identifier(F.col("generic_name"), F.col("development_codes"), F.col("brand_names"), F.col("aliases")), "no identifier")],
        "programs": lambda: [outside("region", REGIONS), outside("stage", STAGES), ref],
        "trials": lambda: [outside("phase", PHASES), outside("region", REGIONS, True), ref],
        "regulatory_events": lambda: [outside("agency", AGENCIES), outside("region", REGIONS), outside("action", ACTIONS), outside("status", STATUSES, True), ref],
        "market_metrics": lambda: [outside("metric", METRICS), outside("basis", BASES, True), ref],
        "documents": lambda: [outside("doc_type", DOC_TYPES)],
    }
    return F.filter(F.array(*[x.cast("string") for x in rules[kind]()]), lambda x: x.isNotNull())


def unknown_keys(raw: Column, known: list[str]) -> Column:
    """Top-level keys of a JSON object that a closed schema does not have."""
    return F.array_except(F.json_object_keys(raw), F.array(*[F.lit(k) for k in known]))
