import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sealwright.llm import quality, queries
from tests import oracle


def plain(text):
    """The contract's statistics, word for word."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    c = Counter(zip(w, w[1:], w[2:]))
    marked = {j for i, x in enumerate(zip(w, w[1:], w[2:])) if c[x] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab #*\n\t\r\x0b\x0c\x1c\x85\u00a0\u2028é😀|"), max_size=60))
def test_statistics(text):
    assert quality.statistics(text)[:5] == plain(text)


def test_rules_are_learned_and_pruned():
    r = np.random.default_rng(1)
    n = 1500
    x = {k: r.random(n) for k in quality.FEATURES}
    bad = (x["symbols_per_word"] > 0.7) | ((x["upper_share"] > 0.8) & (x["repeat_share"] < 0.5))
    rules = quality.learn(x, bad)
    hit = rules.covers(x)
    assert (hit & ~bad).sum() <= 0.02 * (~bad).sum() and (hit & bad).sum() >= 0.95 * bad.sum()
    assert len(rules.rules) <= 8
    assert not quality.learn(x, np.zeros(n, bool)).rules
    assert not quality.learn({k: v[:0] for k, v in x.items()}, np.zeros(0, bool)).rules


def test_column_equals_numpy(spark):
    rules = quality.DecisionList([quality.Rule((("words", False, 60.0), ("upper_share", True, 0.5))), quality.Rule((("symbols_per_word", True, 0.5),))])
    texts = ["A " * 55, "# " * 70, "plain words " * 40, None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    df = quality.with_statistics(df, "text", "s")
    got = [r[0] for r in df.select(rules.verdict("s")).collect()]
    assert got == [0, 1, None, None, None]


def test_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "word " * 100_000, 5), (None, "a b c", 5), (4, " ".join(f"w{i}" for i in range(200)), 5), (4, " ".join(f"w{i}" for i in range(200)), 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words long").withColumn("kept", F.lit("clash")).withColumn("rule", F.lit(1))
    labels = spark.createDataFrame([(4, 1), (3, None), (None, 0), (9, 0)], "doc_id long, quality int")
    rules = quality.fit(df, labels)
    got = [(r.doc_id, r["__quality"].n_words, r["__quality"].base_failed, r["__quality"].kept) for r in quality.judge(df, rules).collect()]
    assert got == [(1, 0, True, False), (2, 0, True, False), (3, 100_000, True, False), (None, 3, True, False), (4, 200, False, True), (4, 200, False, True)]
    assert not quality.fit(df.limit(0), labels).rules and not quality.fit(df, labels.limit(0)).rules
    assert quality.judge(df.limit(0), rules).count() == 0


def test_query(spark):
    got = {r.doc_id: r for r in queries.op2_quality_rules(spark, oracle.SMALL).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{oracle.SMALL}/documents.parquet").collect()}
    assert set(got) == set(docs)
    for k, r in got.items():
        n = plain(docs[k])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert r.kept == (not r.base_failed and r.rule is None)


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_labels_are_met(spark, sf):
    d = f"/root/testdata/{sf}"
    got = queries.op2_quality_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert good.kept.mean() > 0.98 and bad.kept.mean() < 0.35
