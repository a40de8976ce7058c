import hashlib

from pyspark.sql import functions as F

from sealwright.model import ProductType, product_types, register
from sealwright.operators import hashing as H


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def test_identity_keeps_positions(spark):
    df = spark.createDataFrame([("recon", "a", None, "b"), ("recon", "a", "b", None)], "product string, x string, y string, z string")
    ids = [r[0] for r in df.select(H.identity("product", "x", "y", "z")).collect()]
    assert ids[0] == "sha256:" + sha(b"recon\0a\0\0b") and ids[0] != ids[1]


def test_identity_by_product(spark):
    df = spark.createDataFrame([("device_data", "m", "t"), ("other", "m", "t")], "product string, device_model string, recording_start string")
    for kind in product_types().values():
        for n in kind.identity:
            if n not in df.columns:
                df = df.withColumn(n, F.lit("z"))
    got = [r[0] for r in df.select(H.identity_by_product()).collect()]
    assert got == ["sha256:" + sha(b"device_data\0m\0t"), None]


def test_dataset_hash_is_independent_of_partitions(spark):
    rows = [("d", i, sha(bytes([i]))) for i in range(20)]
    want = sha(b"".join(bytes.fromhex(h) for _, _, h in rows))
    for n in (1, 7):
        df = spark.createDataFrame(rows, "k string, i int, h string").repartition(n)
        assert H.dataset_hash(df, ["k"], "i", "h").first()["dataset_hash"] == want


def _nodes(spark, a="x", b="y", companions=False):
    rows = [("p", "/", None, "", 0, "group", sha(a.encode()), None), ("p", "/g", "/", "g", 1, "group", None, None), ("p", "/g/d", "/g", b, 2, "dataset", None, sha(b"data"))]
    if companions:
        rows.append(("p", "/g/d_chunk_hashes", "/g", "d_chunk_hashes", 2, "dataset", None, sha(b"other")))
    return spark.createDataFrame(rows, "product_id string, path string, parent string, name string, depth int, kind string, attr_hash string, dataset_hash string")


def test_tree_hash(spark):
    seal = lambda **k: H.tree_hash(_nodes(spark, **k)).first()["content_hash"]
    raw = bytes.fromhex
    group = sha(raw(sha(b"")) + raw(sha(b"data")))
    root = sha(raw(sha(b"x")) + raw(group))
    assert seal() == "sha256:" + sha(raw(root))
    assert seal(companions=True) == seal()
    assert seal(a="changed") != seal()
    assert seal(b="renamed") == seal()
    hard = lambda **k: H.tree_hash(_nodes(spark, **k), hardened=True).first()["content_hash"]
    assert hard(b="renamed") != hard()
    assert H.tree_hash(_nodes(spark).limit(0)).count() == 0


def test_verify(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, h string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (4, "w")], "k int, h string")
    assert {r.k: r.ok for r in H.verify(a, b, ["k"], "h").collect()} == {1: True, 2: False, 3: False, 4: False}


def test_policy(spark):
    got = spark.createDataFrame([(2 * 10**8, False), (2 * 10**6, True), (5, False)], "n long, s boolean").select(H.chunk_hash_policy(F.col("n"), F.col("s")))
    assert [r[0] for r in got.collect()] == ["large", "access", "skip"]


def test_registry():
    kind = ProductType(("sample_id", "run_id"), ("variants",))
    register("alignment", kind)
    register("alignment", kind)
    assert product_types()["alignment"] == kind
    try:
        register("recon", kind)
    except ValueError:
        pass
    else:
        raise AssertionError("a type was replaced")
