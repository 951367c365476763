"""Typed comparison of answer values: what shape a value string has, its key, and whether two values agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import literal_map, strip

#: Scale words of amounts.
AMOUNT_SCALES = {
    "k": 1e3, "thousand": 1e3, "m": 1e6, "mn": 1e6, "million": 1e6, "millions": 1e6, "bn": 1e9, "billion": 1e9, "trillion": 1e12,
}
#: Number words, Roman numerals, count units.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve".split()
ROMAN = ["i", "ii", "iii", "iv", "v", "vi"]
COUNT_UNITS = "nme nmes lcm lcms program programs asset assets project projects entity entities".split()
#: Whole values that are a trial status, approval codes, and marker phrases in order.
TRIAL_STATUSES = (
    "recruiting not_yet_recruiting active_not_recruiting enrolling_by_invitation completed suspended terminated withdrawn "
    "available no_longer_available temporarily_not_available approved_for_marketing withheld unknown"
).split()
APPROVAL_CODES = {"ap": "approved", "ta": "tentative_approval"}
MARKERS = [
    ("indication_present", ["listed indication", "is an indication for", "an indication for", "indication for", "indicated for", "marketed for", "approved indication for"]),
    ("approved", ["approved", "approval"]),
    ("pending_filing", ["filed", "filing", "submission", "submitted", "submit", "under review"]),
]
#: Patterns of currencies, amounts, percentages and phases in lower-case text.
_SCALE = "k|m|mn|bn|million|millions|billion|thousand|trillion"
CURRENCY = r"\b(usd|eur|gbp|jpy|chf)\b|(\$)"
MAGNITUDE = rf"\d[\d,]*(?:\.\d+)?\s*(?:{_SCALE})\b"
AMOUNT = rf"(\d[\d,]*(?:\s\d{{3}})*(?:\.\d+)?)\s*({_SCALE})?\b"
PERCENT = r"([+-]?)\s*(\d+(?:\.\d+)?)\s*%\s*\(?\s*([a-z]+(?:\s+[a-z]+)?)?"
PHASES = [r"\bphase[-\s]+([ivx]+|\d+)\b", r"\bp-(iii|ii|iv|i|v|\d+)\b", r"\bp(\d+)\b"]


def _phase(low: Column) -> Column:
    found = F.lit("")
    for pattern in PHASES:
        found = F.when(found != "", found).otherwise(F.regexp_extract(low, pattern, 1))
    roman = literal_map({r: i + 1 for i, r in enumerate(ROMAN)})
    return F.when(found.rlike(r"^\d+$"), found.cast("int")).otherwise(roman[found])


def _count(low: Column) -> Column:
    words = F.filter(F.split(low, "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(COUNT_UNITS))
    one = F.when(F.size(words) == 1, F.get(words, F.lit(0)))
    named = literal_map({w: i for i, w in enumerate(NUMBER_WORDS)})
    return F.when(one.rlike(r"^\d+$"), one.try_cast("long")).otherwise(named[one].cast("long"))


def _percent_key(low: Column) -> Column:
    """The percentages by component, sorted, as text; null if there is none. A later one of a component replaces it."""
    groups = [F.regexp_extract_all(low, F.lit(PERCENT), i) for i in (1, 2, 3)]

    def component(label: Column, i: Column) -> Column:
        clean = strip(label)
        head = F.split(clean, r"\s+")[0]
        usd, cc = ["usd", "reported", "dollar", "dollars", "$"], ["cc", "constant", "constant currency", "constant-currency"]
        out = F.when(clean.isin(usd), "USD").when(clean.isin(cc), "cc").when(head.isin(usd), "USD").when(head.isin(cc), "cc")
        return out.otherwise(F.concat(F.lit("__partial_pct__"), i.cast("string")))

    pairs = F.transform(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, "snl")]), lambda z, i: F.struct(
        component(z["l"], i).alias("k"), (z["n"].cast("double") * F.when(z["s"] == "-", -1.0).otherwise(1.0)).alias("v")
    ))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda o: o["k"] == p["k"]))
    text = F.transform(last, lambda p: F.concat(p["k"], F.lit("="), F.format_string("%.6f", p["v"])))
    return F.when(F.size(pairs) > 0, F.array_join(F.array_sort(text), ";"))


def classify(value: Column) -> Column:
    """``struct<shape, key, amount, currency>``: percent, currency, or an atom of the closed set; shape null if none fits."""
    clean = strip(value)
    low = F.lower(clean)
    currency = F.coalesce(F.nullif(F.regexp_extract(low, CURRENCY, 1), F.lit("")), F.nullif(F.regexp_extract(low, CURRENCY, 2), F.lit("")))
    number = F.regexp_replace(F.regexp_extract(low, AMOUNT, 1), r"[,\s]", "").try_cast("double")
    amount = number * F.coalesce(literal_map(AMOUNT_SCALES)[F.regexp_extract(low, AMOUNT, 2)], F.lit(1.0))
    is_percent, is_currency = clean.contains("%"), currency.isNotNull() | low.rlike(MAGNITUDE)
    phase, count, code = _phase(low), _count(low), literal_map(APPROVAL_CODES)[low]
    shape = F.when(phase.isNotNull(), "phase").when(low.isin(TRIAL_STATUSES), "ctgov_status").when(code.isNotNull(), "approved")
    key = F.when(phase.isNotNull(), phase.cast("string")).when(low.isin(TRIAL_STATUSES), low).when(code.isNotNull(), code)
    for name, phrases in MARKERS:
        seen = F.lit(False)
        for p in phrases:
            seen = seen | low.contains(p)
        shape, key = shape.when(seen, name), key.when(seen, name)
    shape, key = shape.when(count.isNotNull(), "count"), key.when(count.isNotNull(), count.cast("string"))
    percent = _percent_key(low)
    shape = F.when(is_percent, F.when(percent.isNotNull(), "percent")).when(is_currency, F.when(amount.isNotNull(), "currency")).otherwise(shape)
    key = F.when(is_percent, percent).when(is_currency, F.lit(None).cast("string")).otherwise(key)
    money = is_currency & ~is_percent
    return F.struct(shape.alias("shape"), key.alias("key"), F.when(money, amount).alias("amount"), F.when(money, currency).alias("currency"))


def classify_strict(value: Column) -> Column:
    """As ``classify``, but a value of no known shape raises an error."""
    found = classify(value)
    return F.when(found["shape"].isNull(), F.raise_error(F.concat(F.lit("unrecognized value: "), value))).otherwise(found)


def value_match(a: Column, b: Column) -> Column:
    """Whether two classified values (structs as from ``classify``) agree: same shape, and same amount or key."""
    near = F.abs(a["amount"] - b["amount"]) <= 1e-6 * F.greatest(F.abs(a["amount"]), F.abs(b["amount"]), F.lit(1.0))
    clash = F.coalesce(a["currency"] != b["currency"], F.lit(False))
    same = F.when(a["shape"] == "currency", near & ~clash).otherwise(a["key"] == b["key"])
    return F.coalesce((a["shape"] == b["shape"]) & same, F.lit(False))
