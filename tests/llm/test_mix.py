import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sealwright.llm import mix, queries
from tests import oracle


def shares(sizes: dict) -> dict:
    """Targets by sharing the excess again and again."""
    order = sorted((k for k in sizes if k is not None), key=lambda k: k.encode()) + [None] * (None in sizes)
    w = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    left, full = 1.5 * sum(sizes.values()), {}
    while True:
        free = [k for k in order if k not in full]
        level = left / sum(w[k] for k in free) if free else 0
        over = [k for k in free if level * w[k] > 2 * sizes[k] + 1e-9]
        if not over:
            return full | {k: level * w[k] for k in free}
        for k in over:
            full[k] = 2.0 * sizes[k]
            left -= full[k]


def hold(rows, docs):
    """rows: result; docs: (id, text, source)."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by, source = defaultdict(int), {}
    for i, t, s in docs:
        by[s] += size(t)
        source[i] = s
    want, taken = shares(by), defaultdict(int)
    assert len(rows) == len(docs)
    assert sorted((str(r.id), r.size) for r in rows) == sorted((str(i), size(t)) for i, t, _ in docs)
    for r in rows:
        s = source[r.id]
        assert r.source_size == by[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.01 * t + mix.BLOCK, (s, taken[s], t)


def test_small(spark):
    docs = [(i, " ".join("w" * (1 + i % 3) for _ in range(i % 97)), ["a", "b", "c", "é", None][i * i % 5]) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("h", F.lit(1)).withColumn("src", F.lit(2))
    rows = mix.mix(df).collect()
    hold(rows, docs)
    again = mix.mix(df.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_buckets(spark, monkeypatch):
    monkeypatch.setattr(mix, "ROWS", 50)
    docs = [(i, "w " * (1 + i % 200), "hot" if i % 3 else f"s{i % 7}") for i in range(900)]
    hold(mix.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect(), docs)


def test_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mix, "FEW_SOURCES", 3)
    docs = [(i, "w " * 40, f"s{i % 11}") for i in range(300)]
    hold(mix.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect(), docs)


def test_odd_rows(spark):
    docs = [(1, None, "a"), (2, "", "a"), (3, " \n", None), (4, "x " * 30_000, "b"), (4, "x " * 30_000, "b"), (None, "y z", "c")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mix.mix(df).collect()
    assert len(rows) == 6 and all(r.taken <= 2 * r.size for r in rows)
    assert {r.taken for r in rows if r.id in (1, 2, 3)} == {0}
    assert mix.mix(df.limit(0)).count() == 0
    assert mix.mix(df.where("doc_id < 4")).count() == 3
    assert mix.mixed(df).columns == df.columns and mix.mixed(df.limit(0)).count() == 0


def test_permutation(spark):
    for n in (1, 2, 3, 7, 256, 1000):
        size = F.lit(n).cast("long")
        got = [spark.range(n, numPartitions=1).select(mix.permuted(F.col("id"), size, mix.round_keys(F.lit(k), size))).collect() for k in ("a", "b")]
        assert all(sorted(r[0] for r in x) == list(range(n)) for x in got)
        assert n < 7 or got[0] != got[1]
        if n == 1000:  # neighbours do not stay together
            near = sum(abs(x[0] - y[0]) < 10 for x, y in zip(got[0], got[0][1:]))
            assert near < 60


def test_shard_counts_are_drawn(spark):
    """Counts per shard spread as multinomial counts under fixed totals do: variance N p (1 - p) (T - N) / (T - 1)."""
    sizes = {0: 320_000, 1: 213_000, 2: 107_000}
    src = spark.createDataFrame([(k, v, float(v)) for k, v in sizes.items()], "no int, source_size long, target double")
    got = mix.slots(src, 10, 256).groupBy("shard", "no").count().collect()
    total = sum(r["count"] for r in got)
    full = total // 256
    for no, size in sizes.items():
        n = {r.shard: r["count"] for r in got if r.no == no}
        x = [n.get(k, 0) for k in range(full)]
        p = size / sum(sizes.values())
        mean = sum(x) / full
        spread = sum((v - mean) ** 2 for v in x) / (full - 1)
        want = 256 * p * (1 - p) * (total - 256) / (total - 1)
        assert abs(mean - 256 * p) < 1 and 0.7 * want < spread < 1.4 * want, (no, mean, spread, want)


def test_shards_of_documents(spark):
    docs = [(i, "w " * (1 + i % 90), "ab"[i % 2]) for i in range(700)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mix.mix(df).collect()
    assert all((r.taken > 0) == (r.n_slots > 0) == (r.first_shard is not None) for r in rows)
    assert len({r.first_shard for r in rows}) > 1


def test_slots_are_exact(spark):
    src = spark.createDataFrame([(0, 1000, 1500.0), (1, 300, 600.0), (2, 0, 0.0), (3, 10_000, 2500.0)], "no int, source_size long, target double")
    got = mix.slots(src, 10, 16).collect()
    assert len({(r.shard, r.slot) for r in got}) == len(got)
    n = defaultdict(int)
    for r in got:
        n[r.no, r.block] += 1
    assert max(n.values()) <= 2 and {k: sum(v for (a, _), v in n.items() if a == k) for k in (0, 1, 3)} == {0: 150, 1: 60, 3: 250}
    assert len({r.shard for r in got if r.no == 1}) > 10  # drawn over the shards


def test_mixed_comes_near(spark):
    docs = [(i, "w " * 50, "ab"[i % 2]) for i in range(2000)]
    out = mix.mixed(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    want = shares({"a": 50_000, "b": 50_000})
    assert all(abs(50 * n[s] - want[s]) < 0.05 * want[s] for s in "ab")


def test_query(spark):
    d = spark.read.parquet(f"{oracle.SMALL}/documents.parquet")
    hold(queries.op5_source_mixing(spark, oracle.SMALL).withColumnRenamed("doc_id", "id").collect(), [(r.doc_id, r.text, r.source) for r in d.collect()])
