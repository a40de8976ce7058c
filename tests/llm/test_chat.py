import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sealwright.llm import chat, queries
from tests import oracle

pieces = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "\\\\", "<", "|im_", "a", "\n", "é😀", "[", "]", "$1"]), max_size=8).map("".join)


@settings(max_examples=8, deadline=None)
@given(st.lists(pieces, min_size=1, max_size=60))
def test_escaping(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t
        assert not any(c in r.e for c in chat.CONTROLS)


def formatted(spark, rows, schema="conv_id long, turn long, seq long, kind string, role string, text string"):
    df = spark.createDataFrame(rows, schema).withColumn("messages", F.lit(1)).withColumn("segments", F.lit("clash"))
    out = chat.format_chats(df)
    return {r.conv: r for r in out.select("conv", "formatted", "segments", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()}


def test_events_are_folded(spark):
    rows = [
        (1, 0, 0, "message", "user", "hi"),
        (1, 1, 5, "delta", "assistant", "lo"),
        (1, 1, 4, "message", "assistant", "hel"),
        (1, 1, 6, "regenerate", None, None),
        (1, 1, 7, "delta", None, "bet"),
        (1, 1, 8, "delta", None, "ter"),
        (1, 2, 9, "message", "user", "typo"),
        (1, 2, 10, "edit", "user", "fixed"),
        (2, 0, 0, "delta", "assistant", "begins"),
    ]
    got = formatted(spark, rows)
    assert [tuple(t) for t in got[1].turns] == [("user", "hi"), ("assistant", "better"), ("user", "fixed")]
    assert got[1].loss == "better" and [tuple(t) for t in got[2].turns] == [("assistant", "begins")]
    assert "".join(s.text for s in got[1].segments) == got[1].formatted


def plain_fold(events):
    """Messages of one turn, event by event; events: (seq, role, text, kind), nulls made empty."""
    done = []
    for _, role, text, kind in sorted(events):
        if kind == "message" or not done:
            done.append([role, text])
        else:
            done[-1][1] = done[-1][1] + text if kind == "delta" else text if kind == "edit" else ""
    return [tuple(x) for x in done]


def test_fold_against_plain(spark):
    r = random.Random(8)
    rows = [(conv, turn, k, r.choice(("message", "delta", "delta", "edit", "regenerate")), r.choice("ua"), r.choice(("x", "yz", "", "w "))) for conv in range(60) for turn in range(2) for k in range(r.randrange(1, 9))]
    got = formatted(spark, rows)
    for conv in range(60):
        want = [m for turn in range(2) for m in plain_fold([(k, role, text, kind) for c, t, k, kind, role, text in rows if (c, t) == (conv, turn)])]
        assert [tuple(t) for t in got[conv].turns] == want


def test_long_stream(spark):
    """A message of 50,000 deltas is put together in one pass."""
    rows = spark.range(50_000).select(F.lit(1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.col("id").alias("seq"), F.when(F.col("id") == 0, "message").otherwise("delta").alias("kind"), F.lit("assistant").alias("role"), F.format_string("%05d ", "id").alias("text"))
    text = chat.messages(rows).select(F.col("messages")[0]["text"].alias("t")).first().t
    assert text == "".join(f"{i:05d} " for i in range(50_000))


def test_log_of_the_query_needs_folding(spark):
    log = queries.chat_log(spark.read.parquet(f"{oracle.SMALL}/conversations.parquet"))
    kinds = {r.kind: r["count"] for r in log.groupBy("kind").count().collect()}
    assert set(kinds) == {"message", "delta", "edit", "regenerate"} and min(kinds.values()) > 20


def test_odd_rows(spark):
    t = queries.CONTROL_TEXT
    rows = [(1, None, 0, None, None, None), (1, 0, 0, "message", "assistant", t), (1, 0, 0, "message", "assistant", t), (None, 0, 0, "message", "user", "x" * 200_000), (3, 0, 0, "message", "a<|im_sep|>b", "")]
    got = formatted(spark, rows)
    assert [tuple(x) for x in got[1].turns] == [("", ""), ("assistant", t), ("assistant", t)] and got[1].loss == t + t
    assert len(got[None].turns[0].text) == 200_000
    assert [tuple(x) for x in got[3].turns] == [("a<|im_sep|>b", "")]
    assert formatted(spark, []) == {}


def test_query(spark):
    df = queries.op4_chat_formatting(spark, oracle.SMALL)
    oracle.check(df, queries.OP4_SQL)
    assert df.where("conv_id = -7").first().n_turns == 2
