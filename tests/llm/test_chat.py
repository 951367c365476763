import random

from tessella.llm import chat, queries
from tests.oracle import same

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string"


def test_query_matches_sql(spark):
    same(spark, queries.QUERIES["op10_chat"], queries.ORACLES["op10_chat"], SF)


def test_round_trip_of_control_strings(spark):
    rng = random.Random(6)
    bits = ["\\", "#", "<", "</turn>", "\n", "### user ###", "\\h", "\\l", "\\\\", "a", "é", "\U0001f600", " ", "</turn>\n", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "a#\\b<", "", ":\n"]), "".join(rng.choices(bits, k=rng.randrange(8)))) for c in range(150) for t in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, SCHEMA)
    out = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.parse_chats(out).withColumn("loss", chat.loss_text(out.formatted, out.loss_spans)).collect()}
    for c in {r[0] for r in rows}:
        want = [r for r in rows if r[0] == c]
        assert [(t.role, t.text) for t in got[c].turns] == [r[2:] for r in want]
        assert got[c].loss == "".join(r[3] for r in want if r[2] == "assistant")
        merged = sum(a[2] != b[2] for a, b in zip(want, want[1:])) + 1
        assert got[c].formatted.count("### ") == merged


def test_edges(spark):
    rows = [(1, 2, "user", None), (1, 1, None, "x"), (1, None, "user", "first"), (1, 2, "user", None), (None, 0, "assistant", "y"), (2, 0, "assistant", "z" * 200_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("formatted", chat.F.lit("other"))
    got = {r.conv_id: r for r in chat.parse_chats(chat.format_chats(df)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "first"), ("", "x"), ("user", ""), ("user", "")]
    assert got[None].turns[0].text == "y" and len(got[2].turns[0].text) == 200_000
    assert chat.format_chats(df.limit(0)).count() == 0
