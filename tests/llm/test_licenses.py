import random
import re

from tessella.llm import licenses, queries

SF = "/root/testdata/sf0.01"


def brute(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    found = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), found


def check(r, text):
    n, found = brute(text)
    starts, labels = [i for i, _ in found], {x for _, x in found}
    assert (r.n_words, r.n_base) == (n, len(found))
    assert (r.first_word, r.last_word) == (min(starts, default=None), max(starts, default=None))
    assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(","))
    assert 0 <= r.score <= 1 and (r.score == 1 or not found) and (r.score > 0) == bool(r.labels)


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op8_licenses(spark, SF).collect()
    assert len(got) == len(docs) and sum(r.n_base for r in got) > 20
    for r in got:
        check(r, docs[r.doc_id])


def test_random_phrases(spark):
    rng = random.Random(1)
    words = "under the mit license apache version 2 cc by nc x é 0 UNDER Mit".split()
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", "-", "\n", "_", "/"]) for _ in range(rng.randrange(60)))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in licenses.scan_licenses(df).collect():
        check(r, rows[r.doc_id][1])


def test_notices_and_edges(spark):
    notice = next(t for t in licenses.templates() if t.label == "bsd").words
    text = b" ".join(notice).decode()
    broken = text.replace("without", "WITHOUT!").replace("following", "next")
    other = text.replace("binary", "object")
    rows = [(1, "pre " * 50 + broken), (2, other), (3, None), (3, None), (None, "")] + [(9, ("x y " * 100_000) + text.upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", licenses.F.lit("a"))
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert got[1].labels == "bsd" and 0.9 < got[1].score < 1 and got[1].matches[0].start == 50 and got[1].base_labels == ""
    assert got[2].labels == "" and got[9].labels == "bsd" and got[3].n_words == 0 and got[None].score == 0
    assert licenses.scan_licenses(df.limit(0)).count() == 0
