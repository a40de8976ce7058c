import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sealwright.llm import bpe, queries
from tests import oracle

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def enc():
    return bpe.encoder(bpe.read_ranks(PATH), PATTERN)


def test_pieces_do_not_change_ids(enc):
    r = random.Random(5)
    parts = ["word", " ", "  ", "\n", "\t", "'s", "12", "é", "漢字", "😀", "\x1c", "\u00a0", "\u2003", "!?", "<|endoftext|>"]
    for _ in range(300):
        text = "".join(r.choice(parts) for _ in range(r.randrange(200)))
        cut = list(bpe.pieces(text, r.randrange(1, 20)))
        assert "".join(cut) == text
        assert [i for x in cut for i in enc.encode_ordinary(x)] == enc.encode_ordinary(text)
        assert bpe.decode(enc, enc.encode_ordinary(text)) == text.encode()


def test_long_texts(enc):
    for text in ("a b " * 60_000, "x" * 60_000, "no-break" * 9_000 + " end"):
        ids = bpe.encode(enc, text)
        assert ids == enc.encode_ordinary(text) and bpe.decode(enc, ids) == text.encode()


def test_runs_of_white_space_do_not_change_ids(enc):
    r = random.Random(6)
    parts = ["w", " ", "  ", "\n", "\r\n", "\t", "'s", "1", "é", "!", "\x1c", "\x85", "\u00a0", "\u2003", "\u200b", " \n \t"]
    for _ in range(600):
        text = "".join(r.choice(parts) * r.choice((1, 1, 3, 9)) for _ in range(r.randrange(40)))
        assert bpe.encode(enc, text, 1, r.randrange(2, 8)) == enc.encode_ordinary(text)


def test_very_long_white_space(enc):
    for u in (" ", "\n", "\r\n", " \n\t", "\u00a0"):
        for text in (u * 5_000_000, f"ab{u * 2_500_000}cd  e" + u * 1_200_000):
            ids = bpe.encode(enc, text)
            assert bpe.decode(enc, ids) == text.encode()
    short, long = (bpe.encode(enc, "ab" + " " * n + "cd") for n in (50_000, 2_000_000))
    assert len(long) - len(short) == len(enc.encode_ordinary(" " * 50_000)) * 39


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello  <|endoftext|>"), (3, "hello  <|endoftext|>"), (None, "x")], "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).withColumn("ids", F.lit(1))
    got = bpe.with_digests(df, PATH, PATTERN).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [r["__bpe"].n_tokens for r in got[:2]] == [0, 0] and {r["__bpe"].ids_sha256 for r in got[:2]} == {empty}
    assert got[2]["__bpe"] == got[3]["__bpe"] and got[2]["__bpe"].decoded_sha256 == hashlib.sha256(b"hello  <|endoftext|>").hexdigest()
    assert bpe.with_digests(df.limit(0), PATH, PATTERN).count() == 0
    both = bpe.with_bytes(bpe.with_ids(df, PATH, PATTERN, out="codes"), PATH, PATTERN, "codes").collect()
    assert [bytes(r.bytes).decode() for r in both] == ["", "", "hello  <|endoftext|>", "hello  <|endoftext|>", "x"]


def test_query(spark, enc):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{oracle.SMALL}/documents.parquet").collect()}
    got = queries.op6_byte_bpe(spark, oracle.SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
