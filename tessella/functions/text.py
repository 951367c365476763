"""Scalar text and number functions as Column builders; everything stays in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: British spellings and their American forms, by word.
SPELLINGS = {
    "tumour": "tumor", "oedema": "edema", "paediatric": "pediatric", "haemolytic": "hemolytic",
    "haematological": "hematological", "anaemia": "anemia", "leukaemia": "leukemia", "coeliac": "celiac",
    "oesophageal": "esophageal", "fibrosis": "fibrosis",
}
#: Normalized phrases and the canonical phrases they stand for.
ALIASES = {
    "uc": "ulcerative colitis", "hs": "hidradenitis suppurativa", "sle": "systemic lupus erythematosus",
    "itp": "immune thrombocytopenia", "waiha": "warm autoimmune hemolytic anemia", "aiha": "autoimmune hemolytic anemia",
    "iga nephropathy": "immunoglobulin a nephropathy", "igan": "immunoglobulin a nephropathy", "rcc": "renal cell carcinoma",
    "hcc": "hepatocellular carcinoma", "dmd": "duchenne muscular dystrophy", "msa": "multiple system atrophy",
    "cttp": "congenital thrombotic thrombocytopenic purpura", "nt1": "narcolepsy type 1", "hl": "hodgkin lymphoma",
    "cll": "chronic lymphocytic leukemia", "psc": "primary sclerosing cholangitis",
    "alpha 1 antitrypsin deficiency": "aatd", "new molecular entities": "nmes", "new molecular entity": "nme",
    "mab": "monoclonal antibody", "adc": "antibody drug conjugate", "gi": "gastroenterology", "worldwide": "global",
    "united states": "us", "u s": "us", "u s a": "us", "ex us": "ex us", "europe": "eu", "china": "cn", "prc": "cn",
}
#: What extractors write when they decline to fill a field, in canonical form.
NULL_SENTINELS = [
    "", "not specified", "unspecified", "not stated", "not disclosed", "undisclosed", "n a", "na", "none", "unknown",
    "tbd", "not applicable",
]
#: Scale words in units.
SCALES = {
    "trillion": 1e12, "billion": 1e9, "bn": 1e9, "million": 1e6, "millions": 1e6, "mn": 1e6, "thousand": 1e3, "k": 1e3,
}
#: What kind of number each metric is.
DIMENSIONS = {
    "revenue": "currency", "growth_rate": "percent", "market_share": "percent", "patient_count": "count", "country_count": "count",
}
#: A search token.
TOKEN = r"[a-z0-9][a-z0-9\-/()]*"


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_lines(text: Column) -> Column:
    """One leading byte-order mark off, line ends as \\n, no white space at the end of any line."""
    body = F.regexp_replace(text, "^﻿", "")
    body = F.regexp_replace(body, "\r\n|\r", "\n")
    return F.regexp_replace(body, r"(?Um)[^\S\n]+$", "")


def title_of(lines: Column) -> Column:
    """The first H1's text, else the first line with text (without leading #), else ``(untitled)``."""
    clean = F.transform(lines, strip)
    h1 = F.get(F.filter(clean, lambda x: x.startswith("# ")), F.lit(0))
    first = F.get(F.filter(clean, lambda x: x != ""), F.lit(0))
    bare = F.when(first.startswith("#"), strip(F.regexp_replace(first, "^#+", ""))).otherwise(first)
    return F.coalesce(strip(F.substring(h1, F.lit(2), F.length(h1))), bare, F.lit("(untitled)"))


def language_of(stem: Column) -> Column:
    """The two letters after the last _ or - of a file stem, in lower case; else null."""
    tail = F.regexp_extract(stem, "[_-]([^_-]*)$", 1)
    return F.when(tail.rlike("^[A-Za-z]{2}$"), F.lower(tail))


def slug(text: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one dash; ``unknown`` if nothing is left."""
    body = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(body == "", "unknown").otherwise(body)


def normalize_text(text: Column) -> Column:
    """Lower case, punctuation as spaces, single spaces, American spelling word by word."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s]+", " ")
    words = F.split(F.trim(F.regexp_replace(plain, r"\s+", " ")), " ")
    spelled = literal_map(SPELLINGS)
    return F.array_join(F.transform(words, lambda w: F.coalesce(spelled[w], w)), " ")


def canonical_term(text: Column) -> Column:
    """The alias of the whole normalized text, else its phrases and single words folded to their aliases.

    Phrases of several words are replaced longest first; single words only by aliases of one word.
    """
    plain = normalize_text(text)
    out = plain
    for phrase in sorted((a for a in ALIASES if " " in a), key=len, reverse=True):
        out = F.regexp_replace(out, rf"\b{re.escape(phrase)}\b", ALIASES[phrase])
    single = literal_map({a: b for a, b in ALIASES.items() if " " not in a and " " not in b})
    out = F.array_join(F.transform(F.split(out, " "), lambda w: F.coalesce(single[w], w)), " ")
    return F.coalesce(literal_map(ALIASES)[plain], out)


def fold_self_reference(subject: Column, company: Column) -> Column:
    """``company`` where the subject names the company itself."""
    term = canonical_term(subject)
    own = term.isin("company", "the company", "the group") | (term == canonical_term(company))
    own = own | (term == canonical_term(F.concat(company, F.lit(" group"))))
    return F.when(F.coalesce(subject, F.lit("")) == "", subject).when(own, company).otherwise(subject)


def is_null_sentinel(text: Column) -> Column:
    return text.isNull() | canonical_term(text).isin(NULL_SENTINELS)


def agency_class(agency: Column) -> Column:
    return F.when(agency.isin("PMDA", "MHLW"), "JP").otherwise(agency)


def metric_dimension(metric: Column) -> Column:
    return F.coalesce(literal_map(DIMENSIONS)[metric], F.lit("currency"))


def unit_scale(unit: Column) -> Column:
    """The factor of the first scale word in a unit, else 1."""
    scales = literal_map(SCALES)
    hits = F.filter(F.split(normalize_text(unit), " "), lambda w: scales[w].isNotNull())
    return F.coalesce(scales[F.get(hits, F.lit(0))], F.lit(1.0))


def values_match(a: Column, unit_a: Column, b: Column, unit_b: Column, rel: float = 0.02, eps: float = 1e-9) -> Column:
    """Whether two amounts agree within ``rel`` once both are in base units."""
    x, y = a * unit_scale(unit_a), b * unit_scale(unit_b)
    zero = (F.abs(x) <= eps) & (F.abs(y) <= eps)
    return zero | (F.abs(x - y) <= rel * F.greatest(F.abs(x), F.abs(y)))


def collapse_phase(phase: Column) -> Column:
    """2a and 2b as 2, with or without a leading P."""
    return F.regexp_replace(phase, "^(P?[0-9])[ab]$", "$1")


def has_word(text: Column, word: str) -> Column:
    """Whether ``word`` stands in ``text`` without a letter or digit (a-z, 0-9) on either side."""
    return text.rlike(f"(?<![a-z0-9]){re.escape(word)}(?![a-z0-9])")


def construct_of(label: Column) -> Column:
    """The scoring construct that a label begins with; other labels in lower case; ``none`` for nothing."""
    low = strip(F.lower(label))
    out = F.when(F.coalesce(label, F.lit("")) == "", "none")
    for name in ("set-of-singles", "single", "comparison", "aggregate"):
        out = out.when(low.startswith(name), name)
    return out.otherwise(low)


def tokens(text: Column) -> Column:
    """Search tokens: runs that begin with a letter or digit and may hold - / ( )."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def general_format(value: Column) -> Column:
    """A number as %g writes it: six significant digits, no trailing zeros, exponent of two digits at least."""
    size = F.floor(F.log10(F.abs(value))).cast("int")
    rounded = F.when(value == 0, 0.0).otherwise(F.round(value / F.pow(F.lit(10.0), size - 5)) * F.pow(F.lit(10.0), size - 5))
    size = F.floor(F.log10(F.abs(rounded)) + 1e-12).cast("int")
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.10f", rounded), "0+$", ""), r"\.$", "")
    lead = F.regexp_replace(F.regexp_replace(F.format_string("%.5f", rounded / F.pow(F.lit(10.0), size)), "0+$", ""), r"\.$", "")
    power = F.concat(lead, F.lit("e"), F.when(size < 0, "-").otherwise("+"), F.lpad(F.abs(size).cast("string"), 2, "0"))
    return F.when(value == 0, "0").when((size < -4) | (size >= 6), power).otherwise(plain)


def value_in_text(value: Column, text: Column) -> Column:
    """Whether a number stands in lower-case ``text`` in any of its usual forms, also across spaces and commas."""
    compact = F.regexp_replace(text, r"[\s,]", "")
    whole = value == F.floor(value)
    exact = F.when(whole & (F.abs(value) < 1e16), F.concat(value.cast("decimal(38,0)").cast("string"), F.lit(".0"))).otherwise(value.cast("string"))
    forms = [general_format(value), exact, F.when(whole, value.cast("decimal(38,0)").cast("string"))]
    found = [F.coalesce(text.contains(f) | compact.contains(f), F.lit(False)) for f in forms]
    return found[0] | found[1] | found[2]
