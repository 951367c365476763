from tessella.llm import licenses


def labels(text):
    return {t.label for t, _, _ in licenses.Index({}, 0).scan(licenses.words_of(text))}


def test_every_notice_finds_itself():
    index = licenses.Index({"the": 90, "license": 50}, 100)
    for t in licenses.templates():
        found = index.scan([b"x"] * 3 + t.words + [b"y"])
        assert any((f.label, f.words) == (t.label, t.words) and start == 3 and cover == 1 for f, start, cover in found), t.label


def test_versions_and_short_notices():
    gnu = "redistribute it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    assert labels(gnu.format("", "2")) == {"gpl", "gpl-2"}
    assert labels(gnu.format("", "3")) == {"gpl", "gpl-3"}
    assert labels(gnu.format("Lesser ", "2.1")) == {"lgpl", "lgpl-2.1"}
    assert labels(gnu.format("Affero ", "3")) == {"agpl-3"}
    assert labels("We want all rights reserved for workers") == set()
    assert labels("Copyright. All rights reserved.") == {"proprietary"}


def test_votes_against_brute_force():
    """Starts with votes are those at which one of a template's rarest present words stands."""
    index = licenses.Index({"the": 90, "license": 50, "mit": 1}, 100)
    text = licenses.words_of("released under the mit license the mit license distributed under the terms of the mit license " * 3)
    present = set(text)
    for k, starts in index.votes(text, present).items():
        t = index.templates[k]
        rare = sorted(set(t.words) & present, key=index.order.__getitem__)[: index.wanted[k]]
        want = {}
        for p, w in enumerate(text):
            for r, x in enumerate(t.words):
                if x == w and w in rare:
                    want[p - r] = want.get(p - r, 0) + 1
        assert starts == want
