from pyspark.sql import functions as F

from bitcurve.llm import conversations
from bitcurve.llm.conversations import rendered


def brute(rows):
    turns = {}
    for c, t, role, text in {(c, t, r or "", x or "") for c, t, r, x in rows if c is not None and t is not None}:
        turns.setdefault(c, []).append((t, role, text))
    lists = {c: [x[1:] for x in sorted(v)] for c, v in turns.items()}
    out = {}
    for c, own in lists.items():
        longer = any(len(o) > len(own) and o[: len(own)] == own for o in lists.values())
        twin = any(o == own and d < c for d, o in lists.items())
        if not longer and not twin:
            out[c] = (len(own), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in own))
    return out


def check(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, place int, chat string")
    got = {r.conv_id: (r.n_turns, r.chat) for r in rendered(frame).collect()}
    assert got == brute(rows)
    return got


def test_snapshots_and_odd_rows(spark):
    talk = [(i, "user" if i % 2 == 0 else "assistant", f"text {i}") for i in range(6)]
    rows = []
    for conv, n in ((1, 2), (2, 6), (3, 4), (9, 6), (4, 1)):
        rows += [(conv, *t) for t in talk[:n]]
    rows += [(5, 0, "user", "text 0"), (5, 1, "assistant", "other"), (6, 0, None, None), (7, 0, "", ""), (8, 3, "user", "text 0")]
    rows += [(None, 0, "user", "x"), (10, None, "user", "x"), (11, 1, "b", "1"), (11, 1, "a", "2"), (11, 1, "a", "2")]
    rows += [(2, 0, "user", "text 0")]
    got = check(spark, rows)
    assert set(got) == {2, 5, 6, 11}
    check(spark, [])


def test_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in frame.collect()]
    assert {r.conv_id: (r.n_turns, r.chat) for r in rendered(frame).collect()} == brute(rows)


def test_running_hashes_of_a_very_long_conversation(spark):
    turns = spark.range(140_000).selectExpr("1L AS conv_id", "id AS turn", "'user' AS role", "'t' AS text")
    short = turns.filter("turn < 139000").withColumn("conv_id", F.lit(2).cast("long"))
    (row,) = conversations.rendered(turns.unionByName(short)).collect()
    line = conversations.TURN.format(role="user", text="t")
    assert (row.conv_id, row.n_turns) == (1, 140_000) and row.chat == line * 140_000
