"""Name similarity as pairs of classes and membership: it expands to every pair, and copies stay linear."""

import pytest

from tessella.functions import similarity as M
from tessella.plans import catalog

SCHEMA = "p_partkey long, p_name string, p_brand string, p_size int"
NAMES = ["tide", "diet", "old ring", "ring old", "Ring, old", "old blue ring", "uc", "ulcerative colitis", "", None]
CANONICAL = {"Ring, old": "ring old", "uc": "ulcerative colitis", None: ""}


def table_of(spark, tmp_path, parts):
    spark.createDataFrame(parts, SCHEMA).write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def expanded(rows):
    members = {}
    for r in rows:
        if r.copy:
            members.setdefault(r.p_partkey, []).append(r.other)
    assert all(min(m) == first for first, m in members.items())
    out = [(a, b, 1.0, True) for m in members.values() for a in m for b in m if a < b]
    return out + [(a, b, r.similarity, r.same) for r in rows if not r.copy for a in members[r.p_partkey] for b in members[r.other] if a < b]


@pytest.mark.parametrize(("name", "ratio"), [("fuzzy_name_match", M.strict_ratio), ("token_set_match", M.token_set_ratio)])
def test_links_expand_to_every_pair(spark, tmp_path, name, ratio):
    parts = [(i, NAMES[i * 7 % 10], ["x", "y", None][i % 11 % 3], [1, 2, None][i % 13 % 3]) for i in range(120)]
    got = catalog.QUERIES[name](spark, table_of(spark, tmp_path, parts)).collect()
    term = lambda t: CANONICAL.get(t, t)
    scored = [(a[0], b[0], round(ratio(term(a[1]), term(b[1])), 6)) for a in parts for b in parts if a[0] < b[0] and a[2:] == b[2:] and None not in a[2:]]
    assert sorted(expanded(got)) == sorted((a, b, s, s >= M.MATCH) for a, b, s in scored)
    assert sorted(r.other for r in got if r.copy) == list(range(120))


@pytest.mark.parametrize("name", ["fuzzy_name_match", "token_set_match"])
def test_copies_are_not_paired(spark, tmp_path, name):
    parts = [(i, NAMES[i % 2], "x", 1) for i in range(6000)]
    assert catalog.QUERIES[name](spark, table_of(spark, tmp_path, parts)).count() == 6000 + 2
