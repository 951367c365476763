from fractions import Fraction

import numpy as np

from tessella.llm import simhash


def _pair(n, common, name):
    """Two texts of n shingles of five words each, ``common`` of them the same."""
    a = [f"{name}{i}" for i in range(n + 4)]
    return " ".join(a), " ".join(a[: common + 4] + [f"other{name}{i}" for i in range(n - common)])


def _kept(spark, pairs):
    rows = [(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(2 * i in kept for i in range(len(pairs)))
    return [2 * i + 1 in kept for i in range(len(pairs))]


def test_near_duplicates_at_the_threshold(spark):
    """At 0.8 all but a few pairs lose their second text; just below it none does."""
    at = [_pair(180, 160, f"a{i}x") for i in range(200)]
    below = [_pair(180, 159, f"b{i}x") for i in range(100)] + [_pair(180, 148, f"c{i}x") for i in range(100)]
    kept = _kept(spark, at + below)
    assert sum(kept[:200]) <= 6
    assert all(kept[200:])


def test_verified_tiles():
    """Roots by exact similarity equal brute force, with and without sides."""
    rng = np.random.default_rng(5)
    base = [rng.choice(4000, 60, replace=False) for _ in range(4)]
    sets = [np.unique(np.where(rng.random(60) < 0.08, rng.integers(0, 4000, 60), base[i % 4])).astype(np.uint64) for i in range(80)]
    sets += [np.zeros(0, np.uint64)] * 2
    for side in (None, rng.integers(0, 2, len(sets))):
        want = list(range(len(sets)))
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                c = len(np.intersect1d(a, b))
                if (side is None or side[i] != side[j]) and 5 * c >= 4 * (len(a) + len(b) - c) and want[i] != want[j]:
                    old, new = max(want[i], want[j]), min(want[i], want[j])
                    want = [new if w == old else w for w in want]
        assert simhash._similar(sets, side, Fraction(4, 5)).tolist() == want


def test_repeated_lines(spark):
    """A repeated line neither links unrelated texts nor parts texts that differ only in how often it stands."""
    line = " ".join(f"line{i}" for i in range(14))
    own = [" ".join(f"{name}{i}" for i in range(200)) for name in "xyz"]
    apart = [(f"{own[0]} {line}" + f" {line}" * 29, f"{own[1]} {line}" + f" {line}" * 29)]
    often = [(f"{k}{own[2]} {line} {line}", f"{k}{own[2]} {line}" + f" {line}" * 59) for k in range(20)]
    often = [tuple(t.replace("z", f"z{k}q").replace("line", f"line{k}q") for t in p) for k, p in enumerate(often)]
    kept = _kept(spark, apart + often)
    assert kept[0] and not any(kept[1:])
