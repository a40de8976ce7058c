import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sealwright.llm import queries, topk
from tests import oracle


def brute(rows, k=5):
    hold = lambda x: max(-(2**63), min(2**63 - 1, x))
    ok = [(i, [hold(math.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, w) in enumerate(ok):
        if q % 50 == 0:
            s = sorted((-hold(sum(a * b for a, b in zip(w, c))), i) for m, (i, c) in enumerate(ok) if m != n and len(c) == len(w))[:k]
            out += [(q, r + 1, i, -v) for r, (v, i) in enumerate(s)]
    return sorted(out)


@pytest.fixture()
def small(monkeypatch):
    for name, n in (("BLOCK", 4), ("CELL", 20), ("QUERIES", 2), ("TILE", 3)):
        monkeypatch.setattr(topk, name, n)


def run(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    if extra:
        df = df.withColumn("id", F.lit("x")).withColumn("w", F.lit(1)).withColumn("score", F.lit(None))
    v = topk.weights(df, "vec_id", "embedding")
    return sorted(map(tuple, topk.search(v, v.where("id % 50 = 0")).collect()))


def test_against_brute_force(spark, small):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(0, 0.2, 8).astype("f4").tolist()) for i in range(260)]
    rows += [(300 + i, rows[50][1]) for i in range(9)]  # ties
    assert run(spark, rows, extra=True) == brute(rows)


def test_odd_rows(spark, small):
    rows = [(0, [1.0, 2.0]), (50, None), (100, []), (150, [float("nan"), 1.0]), (200, [float("inf"), 1.0]), (250, [None, 1.0]), (None, [1.0, 1.0]), (1, [1.0, -1.0]), (2, [0.5]), (300, [3.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_repeated_ids(spark, small):
    rows = [(50, [1.0, 0.5]), (50, [1.0, 0.5]), (50, [0.25, 0.5]), (7, [2.0, 2.0]), (7, [2.0, 2.0]), (8, [1.0, 0.0]), (100, []), (100, []), (3, [])]
    assert run(spark, rows) == brute(rows)
    rows = [(0, [1.0, 0.5])] * 30 + [(i % 3, [0.5, 0.25 * i]) for i in range(40)]
    assert run(spark, rows) == brute(rows)


def test_huge_components(spark, small):
    rows = [(i * 25, [x, 1.0]) for i, x in enumerate((1.0, 1e8, -1e8, 3e14, -3e14, 1e30, -1e30, 1e38))]
    assert run(spark, rows) == brute(rows)


def test_clustered_vectors_prune(spark, small, monkeypatch):
    """Queries of clustered vectors go to few cells; the result is that of brute force."""
    r = np.random.default_rng(5)
    centres = r.normal(0, 1, (12, 6))
    rows = [(i, (centres[i // 40] + r.normal(0, 0.02, 6)).astype("f4").tolist()) for i in range(480)]
    seen = []
    scored = topk._scored
    monkeypatch.setattr(topk, "_scored", lambda asked, *x: seen.append(asked.count()) or scored(asked, *x))
    assert run(spark, rows) == brute(rows)
    assert sum(seen) < 10 * 24 / 2


def test_bounds_prune_without_loss():
    r = np.random.default_rng(0)
    c = np.sort(r.integers(-40, 40, (500, 3)), axis=0)
    q = r.integers(-40, 40, (6, 3))
    floors = [None, None, None, *np.sort(q[3:] @ c.T, axis=1)[:, -5].tolist()]
    got = topk.search_cell(np.arange(6) + 10_000, q, floors, np.arange(500), np.ones(500, int), c, 5, 16)
    for i in range(6):
        want = sorted(zip(-(c @ q[i]), range(500)))[:5]
        assert [(-x, y) for n, y, x in got if n == i] == [(a, b) for a, b in want]


def test_query(spark):
    oracle.check(queries.op1_exact_topk(spark, oracle.SMALL), queries.OP1_SQL)
