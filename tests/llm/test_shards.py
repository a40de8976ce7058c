from collections import defaultdict

from pyspark.sql import functions as F

from sealwright.llm import queries, shards
from tests import oracle


def fits(rows, limit):
    total = defaultdict(int)
    for r in rows:
        total[r.shard] += r.n_bytes
    names = sorted(total)
    assert all(not b.startswith(a) for a, b in zip(names, names[1:])), "leaves of a tree"
    alone = {r.shard for r in rows if r.oversized}
    assert all(v <= limit or k in alone for k, v in total.items())
    # no split without need: the parent of a leaf is over the limit
    for k in names:
        if 0 < len(k) <= shards.BITS and k not in alone:
            assert sum(v for n, v in total.items() if n.startswith(k[:-1])) > limit


def test_limits(spark):
    df = spark.createDataFrame([(i, "x" * (i % 37)) for i in range(1000)], "doc_id long, text string")
    for limit in (100, 1000, 10**6):
        rows = shards.shard(df, limit=limit).collect()
        assert len(rows) == 1000
        fits(rows, limit)


def test_deep_splits(spark):
    df = spark.createDataFrame([(i, "x" * 90) for i in range(3000)], "doc_id long, text string")
    rows = shards.place(shards.rows_to_place(df), 100, step=4).collect()
    fits(rows, 100)
    assert max(r.depth for r in rows) > 12


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "abc"), (3, "y" * 500)] + [(7, "same text")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bits", F.lit("clash")).withColumn("shard", F.lit(0)).withColumn("n_bytes", F.lit("z"))
    got = shards.shard(df, limit=60).collect()
    assert len(got) == len(rows)
    fits(got, 60)
    assert [r.id for r in got if r.oversized] == [3]
    assert shards.shard(df.limit(0)).count() == 0


def test_query_splits(spark):
    rows = queries.op3_extendible_sharding(spark, "/root/testdata/sf0.01").collect()
    fits(rows, queries.SHARD_BYTES)
    assert len({r.shard for r in rows}) > 4 and len({r.depth for r in rows}) > 1


def test_query(spark):
    oracle.check(queries.op3_extendible_sharding(spark, oracle.SMALL), queries.OP3_SQL)
