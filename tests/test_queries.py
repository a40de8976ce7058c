import pytest

from sealwright.plans import registry

from . import oracle

NAMES = sorted(registry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    df = registry.queries()[name](spark, oracle.SMALL)
    if name in registry.oracle_sql():
        oracle.check(df, registry.oracle_sql()[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_bytes_digest(spark):
    import hashlib

    import numpy as np

    df = registry.queries()["chunk_bytes_hash"](spark, oracle.SMALL)
    raw = spark.read.parquet(f"{oracle.SMALL}/embeddings.parquet").orderBy("vec_id").limit(3).collect()
    want = {r.vec_id: hashlib.sha256(np.asarray(r.embedding, "<f4").tobytes()).hexdigest() for r in raw}
    got = {r.vec_id: r.chunk_hash for r in df.where("vec_id < 10").collect()}
    assert all(got[k] == v for k, v in want.items())
