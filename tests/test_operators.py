import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sealwright.operators import arrays as A
from sealwright.operators import calibration as K
from sealwright.operators import histogram as G
from sealwright.operators import metadata as M
from sealwright.operators import provenance as P
from sealwright.operators import regions as R
from sealwright.operators import series as S
from sealwright.streaming import events as E


def grid(spark, a):
    return spark.createDataFrame([(*map(int, i), float(v)) for i, v in np.ndenumerate(a)], "z long, y long, x long, v double")


def test_pyramid_sizes_and_edges(spark):
    assert A.level_shape([300, 512, 512], 8) == [38, 64, 64]
    a = np.arange(5 * 3 * 2, dtype=float).reshape(5, 3, 2)
    level = {(r.z, r.y, r.x): r.v for r in A.pyramid(grid(spark, a), ["z", "y", "x"], 2).collect()}
    assert len(level) == 3 * 2 * 1
    assert level[2, 1, 0] == a[4:, 2:, :].mean() and level[0, 0, 0] == a[:2, :2, :2].mean()
    area = A.pyramid(grid(spark, a), ["z", "y", "x"], 2, "area").count()
    assert area == len(level)


def test_level_affine_keeps_block_centres():
    m = [[2.0, 0, 0, 10], [0, 3.0, 0, 0], [0, 0, 4.0, 0], [0, 0, 0, 1]]
    assert A.level_affine(m, 2)[:2] == [[4.0, 0, 0, 11.0], [0, 6.0, 0, 1.5]]


def test_inverse(spark):
    m = [[0.5, 0.0, 0.1, 1.0], [0.0, 2.0, 0.0, -1.0], [0.2, 0.0, 1.0, 0.5], [0.0, 0.0, 0.0, 1.0]]
    assert np.allclose(np.array(A.inverse(m)) @ np.array(m), np.eye(4))
    flat = [x for r in m for x in r]
    got = spark.createDataFrame([(flat,)], "m array<double>").select(A.inverse_of("m")).first()[0]
    assert np.allclose(np.array(got).reshape(4, 4), A.inverse(m))


def test_jacobian_of_a_scaling(spark):
    a = np.zeros((3, 3, 3))
    f = grid(spark, a).select("z", "y", "x", (F.col("z") * 1.0).alias("dz"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dx"))
    assert tuple(A.jacobian_range(f).first()) == (2.0, 2.0)


def test_mips(spark):
    a = np.random.default_rng(0).random((3, 4, 5))
    got = {(r.z, r.x): r.v for r in A.coronal_mip(grid(spark, a)).collect()}
    assert got == {(z, x): a[z, :, x].max() for z in range(3) for x in range(5)}


def test_frame_at(spark):
    frames = spark.createDataFrame([("a", 0.0, 5.0), ("a", 10.0, 5.0)], "k string, start double, duration double")
    times = spark.createDataFrame([("a", t) for t in (-1.0, 0.0, 4.9, 5.0, 12.0)] + [("b", 1.0)], "k string, at double")
    got = {(r.k, r["at"]): r.frame_start for r in A.frame_at(frames, times, ["k"]).collect()}
    assert got == {("a", -1.0): None, ("a", 0.0): 0.0, ("a", 4.9): 0.0, ("a", 5.0): None, ("a", 12.0): 10.0, ("b", 1.0): None}


def test_erosion(spark):
    mask = np.zeros((5, 5, 5), bool)
    mask[0:4, 0:4, 0:4] = True
    df = spark.createDataFrame([(1, *map(int, i)) for i in np.argwhere(mask)], "label int, z long, y long, x long")
    got = {tuple(r)[1:] for r in R.eroded(df, ["z", "y", "x"]).collect()}
    assert got == {(z, y, x) for z in (1, 2) for y in (1, 2) for x in (1, 2)}


def test_polygon(spark):
    df = spark.createDataFrame([([0.0, 2.0, 2.0, 0.0], [0.0, 0.0, 3.0, 3.0]), ([], [])], "u array<double>, v array<double>")
    assert [r[0] for r in df.select(R.polygon_area(F.col("u"), F.col("v"))).collect()] == [6.0, 0.0]


def test_shapes(spark):
    with pytest.raises(ValueError):
        R.inside("blob", [F.lit(0.0)] * 3, [0, 0, 0])


def test_gaussian_fit(spark):
    x = np.linspace(-5, 5, 41)
    y = 100 * np.exp(-((x - 1) ** 2) / (2 * 1.5**2))
    df = spark.createDataFrame([("a", float(a), float(b), 1.0) for a, b in zip(x, y)], "k string, x double, n double, err double")
    row = G.fit(df, "k", "gaussian").first()
    assert np.allclose(row["values"], [100, 1, 1.5], atol=1e-4) and row.chi_squared < 1e-6
    assert G.fit(df, "k", "voigt").first().chi_squared < 1.0
    line = (lambda x, p: p[0] + p[1] * x, lambda x, y: [0.0, 0.0])
    row = G.fit(df.withColumn("n", 3 + 2 * F.col("x")), "k", line).first()
    assert np.allclose(row["values"], [3, 2])
    two = df.withColumn("x", F.col("x") + 5).withColumn("n", 90 * F.exp(-2.0 * F.col("x")) + 30 * F.exp(-0.3 * F.col("x")))
    assert np.allclose(sorted(G.fit(two, "k", "multi_exponential").first()["values"]), [0.3, 2, 30, 90], rtol=1e-3)
    row = G.fit(df.withColumn("n", 50 * F.exp(-0.3 * F.col("x"))), "k", "exponential").first()
    assert np.allclose(row["values"], [50, 0.3], atol=1e-6)


def test_bins_are_half_open(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.999, 1.0, 4.0, 5.0)], "v double")
    got = {r.b: r.n for r in G.histogram(df, {"b": (F.col("v"), [0.0, 1.0, 5.0])}).collect()}
    assert got == {0: 2, 1: 2}
    assert tuple(G.outside(df, F.col("v"), [0.0, 1.0, 5.0]).first()) == (1, 1)


def test_normalised_by_key(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 5)], "k string, n int")
    assert sorted(r.share for r in G.normalised(df, ["k"]).collect()) == [0.25, 0.75, 1.0]


def test_as_of_ties(spark):
    rows = spark.createDataFrame([("a", 5), ("a", 1), ("b", 5)], "k string, t int")
    cal = spark.createDataFrame([("a", 5, 1.0), ("a", 5, 2.0), ("a", 9, 3.0)], "k string, t int, v double")
    got = {(r.k, r.t): r.calibration for r in K.as_of(rows, cal, ["k"], "t", "t", "v").collect()}
    assert got == {("a", 5): 2.0, ("a", 1): None, ("b", 5): None}


def test_as_of_in_buckets(spark):
    r = np.random.default_rng(2)
    rows = spark.createDataFrame([("ab"[i % 2], int(t), i) for i, t in enumerate(r.integers(0, 300, 200))], "k string, t int, i int")
    cal = spark.createDataFrame([("a", int(t), float(t)) for t in r.integers(0, 300, 9)], "k string, t int, v double")
    args = (rows, cal, ["k"], "t", "t", "v")
    plain, split = K.as_of(*args), K.as_of(*args, bucket=F.floor(F.col("t") / 25))
    assert sorted(map(str, plain.select("i", "calibration").collect())) == sorted(map(str, split.select("i", "calibration").collect()))


def test_calibration_types(spark):
    df = spark.createDataFrame([(1, "gain_map", ["gain_map"]), (2, "normalization", ["norm_factors"]), (3, "other", []), (4, "cross_calibration", [])], "product_id int, calibration_type string, names array<string>")
    assert [r.product_id for r in K.incomplete(df).collect()] == [2, 3]


def test_in_force(spark):
    cal = spark.createDataFrame([(1, "2024-01-01", "indefinite"), (2, "2024-01-01", "2024-02-01"), (3, "2025-01-01", None)], "i int, valid_from string, valid_until string")
    assert [r.i for r in K.in_force(cal, F.lit("2024-06-01")).collect()] == [1]


def plain_walk(edges, start):
    out = {(start, start): 0}
    front = [start]
    while front:
        front = [b for a in front for x, b in edges if x == a and (start, b) not in out and not out.update({(start, b): out[start, a] + 1})]
    return out


def test_closure_against_plain_walks(spark):
    r = random.Random(3)
    for n in (6, 14):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(2 * n)] + [(100 + i, 101 + i) for i in range(21)]
        df = spark.createDataFrame(edges, "from int, to int")
        nodes = sorted({x for e in edges for x in e})
        want = {}
        for s in nodes:
            want |= plain_walk(edges, s)
        for some in (nodes, nodes[:2]):
            got = P.walk(df, spark.createDataFrame([(x,) for x in some], "start int")).collect()
            assert {(x.start, x.node): x.steps for x in got} == {k: v for k, v in want.items() if k[0] in some} and len(got) == len({(x.start, x.node) for x in got})
        up = {a for a, b in edges if any(b == y or (b, y) in want for y in nodes if any(x == y and (z, y) in want for x, z in edges))}
        got = {x.product_id for x in P.cyclic(df.toDF("product_id", "source_id")).collect()}
        assert got == up


def test_long_chain_has_no_cycle(spark):
    chain = spark.range(5000).select(F.col("id").alias("product_id"), (F.col("id") + 1).alias("source_id"))
    assert P.cyclic(chain).count() == 0
    assert P.cyclic(chain.union(spark.createDataFrame([(5000, 4990)], "product_id long, source_id long"))).count() == 5001


def test_walk_and_cycles(spark):
    edges = spark.createDataFrame([("c", "b"), ("b", "a"), ("c", "a"), ("x", "y"), ("y", "x"), ("z", "x")], "product_id string, source_id string")
    start = spark.createDataFrame([("c",), ("x",)], "product_id string")
    got = {(r.start, r.node): r.steps for r in P.ancestry(edges, start).collect()}
    assert got == {("c", "b"): 1, ("c", "a"): 1, ("x", "y"): 1}
    assert {r[0] for r in P.cyclic(edges).collect()} == {"x", "y", "z"}
    assert P.cyclic(edges.limit(0)).count() == 0


def test_resolver():
    r = P.Resolver({"a": "/a"}, {"a": "/m/a", "b": "/m/b"})
    assert r("a") == "/a" and r("b") == "/m/b"
    with pytest.raises(P.SourceNotFoundError):
        r("c")
    r.register(lambda i: "/hook" if i == "c" else None)
    assert r("c") == "/hook"


def test_samples(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], [0.0, 0.5])], "k string, signal array<double>, time array<double>")
    assert [tuple(r) for r in S.samples(df, ["k"]).collect()] == [("a", 0, 0.0, 1.0), ("a", 1, 0.5, 2.0)]


def test_default_chain(spark):
    nodes = spark.createDataFrame([("p", "/", "v"), ("p", "v", "v/d"), ("p", "v/d", None)], "product_id string, path string, default_path string")
    got = M.follow_default(nodes, nodes.where("path = '/'").select("product_id", "path")).first()
    assert got.path == "v/d"


def test_stream(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", i % 2, 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id int, value double").withColumn("ts", F.to_timestamp("ts"))
    df.union(df.limit(5)).write.parquet(f"{tmp_path}/in")
    stream = E.deduplicated(E.event_stream(spark, f"{tmp_path}/in", df._jdf.schema().toDDL()))
    q = E.windowed_counts(stream, late=None).writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = df.groupBy(F.window("ts", "10 minutes")).count()
    assert batch.count() == 4 and spark.table("counts").count() <= 4


def test_buckets_do_not_change_results(spark):
    r = random.Random(4)
    rows = [(r.choice(["hot", "hot", "hot", "a", None]), r.choice([None, *range(0, 200)]), i, r.choice([None, r.random()])) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t int, id int, v double")
    day = F.floor(F.col("t") / 7)
    ask = {
        "gaps": lambda b: S.gaps(df, ["k"], "t", ["id"], b),
        "triggers": lambda b: S.triggers(df, ["k"], ["t", "id"], "v", 0.5, b),
        "gate": lambda b: S.gate_phase(df, ["k"], ["t", "id"], "t", F.col("v") > 0.9, b),
        "coincidences": lambda b: S.coincidences(df, ["k"], ["t", "id"], "t", "id", 3, b),
        "validity": lambda b: K.validity(df, ["k"], "t", tie=["id"], bucket=b),
        "segments": lambda b: K.segments(df.where("k = 'a'").dropDuplicates(["t"]), ["k"], "t", "v", b),
    }
    for name, f in ask.items():
        assert sorted(map(str, f(None).collect())) == sorted(map(str, f(day).collect())), name
    frames, times = df.selectExpr("k", "t as start", "v * 9 as duration"), df.selectExpr("k", "t as at", "id")
    got = [sorted(map(str, A.frame_at(frames.where("start is not null and duration is not null"), times, ["k"], bucket=b).collect())) for b in (None, lambda t: F.floor(t / 7))]
    assert got[0] == got[1]
