import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import chunking as C


def literal_chunks(text, size, overlap):
    """Plain-Python model of sectioning, packing and windows."""
    lines = text.split("\n")
    starts = [i for i, x in enumerate(lines) if x.strip().startswith("#") and x.strip().lstrip("#")[:1] == " " and x.strip().lstrip("#").strip() and len(x.strip()) - len(x.strip().lstrip("#")) <= 6]
    cuts = sorted({0, *starts, len(lines)})
    out, held, stack, paths = [], None, [], {}
    for a, b in zip(cuts, cuts[1:]):
        if a in starts:
            level = len(lines[a].strip()) - len(lines[a].strip().lstrip("#"))
            stack = [s for s in stack if s[0] < level] + [(level, lines[a].strip().lstrip("#").strip())]
        paths[a] = [t for _, t in stack]
        if held and len("\n".join(lines[held[0] : b])) <= size:
            held = (held[0], b)
            continue
        if held:
            out.append(held)
        held = None
        if len("\n".join(lines[a:b])) > size:
            out.append((a, b))
        else:
            held = (a, b)
    out += [held] if held else []
    chunks = []
    for a, b in out:
        body = "\n".join(lines[a:b])
        if len(body) <= size:
            chunks.append((paths[a], a + 1, b, body))
            continue
        at = 0
        while True:
            end = min(at + size, len(body))
            chunks.append((paths[a], a + 1 + body[:at].count("\n"), a + 1 + body[: max(end - 1, at)].count("\n"), body[at:end]))
            if end == len(body):
                break
            at += size - overlap
    return chunks


def test_chunks_against_model(spark):
    rng = random.Random(3)
    bits = ["# A", "## B b", "### C", "#x", "#", "text line", "longer text line here", "", "  ## D ", "#### E", "x" * 70]
    texts = ["\n".join(rng.choices(bits, k=rng.randrange(1, 30))) for _ in range(120)] + ["", "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in C.chunk_documents(df, 60, 15).collect():
        got.setdefault(r.document_id, {})[r.chunk_index] = (r.section_path, r.line_range.start, r.line_range.end, r.text)
    for i, t in enumerate(texts):
        assert [got[i][k] for k in sorted(got[i])] == literal_chunks(t, 60, 15), t


def test_config_and_subset(spark):
    with pytest.raises(ValueError):
        C.check_config(10, 10)
    chunks = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "chunk_index int, text string")
    assert [r.text for r in C.subset(chunks, [2, 0, 2]).orderBy("chunk_index").collect()] == ["a", "c"]
    assert C.subset(chunks, limit=2).count() == 2


def test_lines_and_titles(spark):
    df = spark.createDataFrame([("﻿# T \r\na \rb\t\n",), ("## H2\nx",), ("\n \n",), ("p\n# Later",)], "t string")
    rows = df.select(T.normalize_lines(F.col("t")).alias("t")).select("t", T.title_of(F.split("t", "\n", -1)).alias("title")).collect()
    assert rows[0].t == "# T\na\nb\n" and [r.title for r in rows] == ["T", "H2", "(untitled)", "Later"]
    stems = spark.createDataFrame([("a_en",), ("a-b-DE",), ("a_eng",), ("ab",), ("a_e1",)], "s string")
    assert [r[0] for r in stems.select(T.language_of(F.col("s"))).collect()] == ["en", "de", None, None, None]


def test_windows_of_any_shape(spark):
    """Windows against slices, with overlaps beyond the stride, letters beyond the basic plane and many pieces."""
    rng = random.Random(8)
    texts = ["", "a", "\n", "ab\n" * 900, "".join(rng.choice("ab\n😀é") for _ in range(3000)), "x" * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size, overlap in ((60, 15), (10, 8), (7, 0), (5000, 1)):
        got = {}
        for r in C.windows(df, size=size, overlap=overlap).collect():
            got[r.doc_id, r.window] = (r.begin, r.finish, r.start, r.end, r.text)
        want = {}
        for i, t in enumerate(texts):
            w = 0
            while True:
                a, b = w * (size - overlap), min(w * (size - overlap) + size, len(t))
                want[i, w] = (a, b, 1 + t[:a].count("\n"), 1 + t[: max(b - 1, a)].count("\n"), t[a:b])
                if b >= len(t):
                    break
                w += 1
        assert got == want


def test_windows_grow_with_the_text(spark):
    """Ten times the text takes about ten times the work, not a hundred times."""
    import time

    took = []
    for n in (1, 1, 10):
        df = spark.createDataFrame([(0, "some words in a line\n" * (n * 50_000))], "doc_id long, text string")
        began = time.perf_counter()
        rows = C.windows(df).agg(F.count("*"), F.max("end")).first()
        took.append(time.perf_counter() - began)
        assert rows[1] == n * 50_000
    assert took[2] < 40 * max(took[1], 0.25), took


def test_subset_range(spark):
    chunks = spark.createDataFrame([(0, "a"), (1, "b")], "chunk_index int, text string")
    for wrong in ([2], [0, 5], [-1]):
        with pytest.raises(ValueError):
            C.subset(chunks, wrong)
