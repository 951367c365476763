"""Grounding: whether what a fact says stands in the lines it cites."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import canonical_term, slug, strip, value_in_text

#: How closed values are written in sources, in lower case.
SURFACES = {
    "approval": ["approved", "approval"], "filed": ["filed", "filing", "submission", "submitted", "submissions"],
    "CRL": ["crl", "complete response letter"], "priority_review": ["priority review"], "breakthrough": ["breakthrough"],
    "fast_track": ["fast track"], "orphan": ["orphan"], "PRIME": ["prime", "priority medicines"], "CHMP_opinion": ["chmp"],
    "application_withdrawal": ["withdrew", "withdrawal", "withdrawn"], "product_withdrawal": ["withdrawn", "withdrawal"],
    "preclinical": ["preclinical", "pre-clinical"], "approved": ["approved", "approval"], "discontinued": ["discontinued", "terminated"],
    "P1": ["p-i", "phase 1", "ph 1", "ph1", "phase i"], "P1/2": ["p-i/ii", "phase 1/2", "phi/ii", "ph 1/2"],
    "P2": ["p-ii", "phase 2", "ph 2", "ph2", "phase ii"], "P2a": ["phase 2a", "p-iia"], "P2b": ["phase 2b", "p-iib"],
    "P3": ["p-iii", "phase 3", "ph 3", "ph3", "phase iii"],
    "1": ["phase 1", "ph 1", "p-i", "phi"], "1/2": ["phase 1/2", "phi/ii", "ph i/ii", "p-i/ii"],
    "2": ["phase 2", "ph 2", "p-ii", "phii"], "2a": ["phase 2a", "p-iia"], "2b": ["phase 2b", "p-iib"],
    "3": ["phase 3", "ph 3", "p-iii", "phiii"], "4": ["phase 4", "ph 4", "p-iv"],
    "US": ["us", "u.s.", "united states", "fda"], "EU": ["eu", "europe", "european", "ema", "chmp"],
    "JP": ["japan", "jp", "pmda", "mhlw"], "CN": ["china", "cn", "nmpa"], "Global": ["global", "worldwide"],
}
REGION_WORDS = [w for r in ("US", "EU", "JP", "CN", "Global") for w in SURFACES[r]]


def any_word(text: Column, words: list[str]) -> Column:
    """Whether any of the words stands in lower-case text, bounded by other characters than a-z and 0-9."""
    return text.rlike("(?<![a-z0-9])(?:" + "|".join(map(re.escape, words)) + ")(?![a-z0-9])")


def has_surface(text: Column, value: Column) -> Column:
    """Whether a closed value stands in lower-case text in any of its spellings; unlisted values as themselves.

    A case on the value picks one compiled pattern for each listed value.
    """
    own = F.regexp_replace(F.lower(value), r"([^a-z0-9 ])", r"\\$1")
    out = F.when(value.isNull(), F.lit(None))
    for name, words in SURFACES.items():
        out = out.when(value == name, any_word(text, words))
    return out.otherwise(F.regexp_like(text, F.concat(F.lit("(?<![a-z0-9])(?:"), own, F.lit(")(?![a-z0-9])"))))


def indication_hits(indication: Column, cited: Column) -> tuple[Column, Column]:
    """How many significant words of an indication the cited text has, and how many there are."""
    words = F.filter(F.split(canonical_term(indication), " "), lambda w: F.length(w) > 2)
    term = canonical_term(cited)
    return F.size(F.filter(words, lambda w: term.contains(w))), F.size(words)


def cited_text(lines: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(lines, start, end - start + 1), "\n")


def category(name: str, value: Column, found: Column, low: Column, hits: Column | None = None) -> Column:
    """Why a check failed: a spelling the map lacks, an inferred region, part of an indication, or a real failure."""
    out = F.when(found, "grounded")
    if name in ("stage", "phase"):
        digit = value if name == "phase" else F.regexp_replace(value, "^P+", "")
        bare = F.regexp_like(low, F.concat(F.lit(r"(?<!\d)\Q"), digit, F.lit(r"\E(?!\d)")))
        return out.when(bare, "map_gap").otherwise("real_failure")
    if name == "region":
        return out.when(any_word(low, REGION_WORDS), "real_failure").otherwise("inferred")
    if name == "indication":
        return out.when(hits > 0, "indeterminate").otherwise("real_failure")
    return out.otherwise("real_failure")


#: The checks of each type: name, the column it reads, and how that is looked for.
CHECKS = {
    "programs": [("asset", "asset_id", "slug"), ("indication", "indication", "words"), ("region", "region", "surface"), ("stage", "stage", "surface")],
    "regulatory_events": [("asset", "asset_id", "slug"), ("action", "action", "surface"), ("indication", "indication", "words"), ("region", "region", "surface")],
    "trials": [("asset", "trial_name", "name"), ("indication", "indication", "words"), ("phase", "phase", "surface")],
    "market_metrics": [("asset", "subject", "any word"), ("value", "value", "value")],
}


def _looked_for(how: str, column: str, low: Column) -> tuple[Column, Column, Column | None]:
    """What is expected, whether the cited text has it, and for words how many of them it has."""
    value = F.col(column)
    inside = lambda name: (name != "") & slug(F.col("cited")).contains(name)
    if how == "slug":
        return value, inside(value), None
    if how == "name":  # a trial's name as it stands, else its first asset
        first = F.coalesce(F.get("asset_ids", F.lit(0)), F.lit(""))
        named = F.coalesce(value != "", F.lit(False))
        return F.when(named, value).otherwise(first), F.when(named, low.contains(F.lower(value))).otherwise(inside(first)), None
    if how == "words":
        hits, n = indication_hits(value, F.col("cited"))
        return value, (n == 0) | (hits >= 0.5 * n), hits
    if how == "any word":
        return value, F.exists(F.filter(F.split(canonical_term(value), " "), lambda w: F.length(w) > 2), low.contains), None
    if how == "value":
        return value, value_in_text(value, low), None
    return value, has_surface(low, value), None


def ground(facts: DataFrame, kind: str) -> DataFrame:
    """One row for each fact and check: the columns of ``facts`` with ``name, expected, found, category``.

    ``facts`` has the type's columns and ``cited``, the text of the lines it cites.
    """
    low = F.lower("cited")
    made = []
    for name, column, how in CHECKS[kind]:
        value, found, hits = _looked_for(how, column, low)
        found = F.coalesce(found, F.lit(False))
        made.append(F.struct(F.lit(name).alias("name"), value.cast("string").alias("expected"), found.alias("found"), category(name, value, found, low, hits).alias("category")))
    return facts.select(*facts.columns, F.inline(F.array(*made)))


def summary(checks: DataFrame) -> DataFrame:
    """Checks by name and category."""
    return checks.groupBy("name", "category").agg(F.count("*").alias("n"))


def is_fallback(snippet: Column) -> Column:
    """Whether a snippet is the chunk's beginning and not a quotation: long, or of several lines."""
    return F.coalesce((F.length(snippet) >= 200) | strip(snippet).contains("\n"), F.lit(False))


def fallback_rate(facts: DataFrame) -> DataFrame:
    """``fallbacks, facts``: how many facts (with ``snippet``) carry their chunk's beginning, and how many there are."""
    return facts.agg(F.count_if(is_fallback(F.col("snippet"))).alias("fallbacks"), F.count("*").alias("facts"))


