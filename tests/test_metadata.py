import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sealwright.functions.expressions import rounded
from sealwright.operators import metadata as M
from sealwright.plans import registry

from . import oracle

scalar = st.one_of(st.text(max_size=5), st.integers(-9, 9), st.floats(allow_nan=False, allow_infinity=False), st.booleans(), st.lists(st.integers(), min_size=1, max_size=3))
names = st.text("abc", min_size=1, max_size=3)
trees = st.dictionaries(names, st.recursive(scalar, lambda x: st.dictionaries(names, x, min_size=1, max_size=3), max_leaves=6), max_size=4)


@settings(max_examples=60, deadline=None)
@given(trees)
def test_round_trip(tree):
    assert M.nest(M.flatten(tree)) == tree


def test_none_is_absent_and_groups_win():
    assert M.nest(M.flatten({"a": None, "b": {"c": None}})) == {}
    assert M.nest([("/", "frame", [1, 2]), ("/frame", "value", 3)]) == {"frame": {"value": 3}}


def test_types():
    assert [M.type_of(x) for x in (True, 1, 1.0, "a", b"a", [1], [True])] == ["bool", "int", "float", "str", "bytes", "list<int>", "list<bool>"]


def test_json_schema():
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}, "b": {"type": "array", "items": {"type": "string"}}, "c": {"enum": [1, 2]}}}
    assert M.validate_json({"a": 1, "b": ["x"], "c": 1, "new": 5}, schema) == []
    assert M.validate_json({"a": True, "b": [1], "c": 3}, schema) == ["/a: not integer", "/b/0: not string", "/c: not one of [1, 2]"]
    assert M.validate_json({}, schema) == ["/a: missing"]
    assert M.validate_json([], schema) == ["/: not object"]


def test_readiness():
    assert M.licence_ready("CC-BY-4.0") and M.licence_ready("https://example.org/l") and not M.licence_ready("ask me") and not M.licence_ready(None)
    assert M.creators_ready([{"name": "A", "affiliation": "B", "orcid": "0000-0002-1825-0097"}])
    assert not M.creators_ready([{"name": "A"}]) and not M.creators_ready([]) and not M.creators_ready([{"name": "A", "affiliation": "B", "orcid": "1"}])


def test_additive_and_migrate(spark):
    v1 = spark.createDataFrame([(1, "a")], "id int, name string")
    v2 = spark.createDataFrame([(2, "b", 5.0)], "id int, name string, dose double")
    assert sorted(map(tuple, M.additive(v1, v2).collect())) == [(1, "a", None), (2, "b", 5.0)]
    assert M.migrate(v1, {"dose": 0.0}, 2).select("id", "dose", "schema_version").first() == (1, 0.0, 2)


def test_unknown_type_is_tolerated(spark):
    df = spark.createDataFrame([("a", 1, 5), ("b", 9, 6)], "t string, v int, x int")
    assert [r[0] for r in df.select(M.dispatch(F.col("t"), F.col("v"), {("a", 1): F.col("x")})).collect()] == [5, None]


@pytest.mark.parametrize("n,dims,want", [(1000, 1, True), (1001, 1, False), (4, 2, False)])
def test_attribute_limit(spark, n, dims, want):
    assert spark.range(1).select(M.is_attribute(F.lit(n), F.lit(dims))).first()[0] is want


def test_attribute_rows_follow_flatten(spark):
    import json

    trees = [{"a": 1, "b": {"c": "x", "d": {"e": True, "f": None}}}, {}, {"l": [1, 2], "n": None}]
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)] + [(9, None), (10, "not json")], "id int, doc string")
    got = sorted((r.id, r.path, r.key, r.value) for r in M.attribute_rows(df, ["id"], "doc").collect())
    text = lambda v: json.dumps(v).replace(" ", "") if not isinstance(v, str) else v
    assert got == sorted((i, p, k, text(v)) for i, t in enumerate(trees) for p, k, v in M.flatten(t))


def test_registered(spark):
    df = spark.createDataFrame([("a", ["x"]), ("b", []), ("c", ["x"]), (None, None)], "type string, names array<string>")
    got = M.registered(df, {"a": ("x", "y"), "b": ()}, names="names").collect()
    assert [(r.known, r.missing) for r in got] == [(True, ["y"]), (True, []), (False, None), (False, None)]


def test_list_quantities_rounded_as_in_sql(spark, tmp_path):
    halves = [m / 128 * sign for m in range(1, 4001, 2) for sign in (1, -1)]
    odd = [0.0, -0.0, 1e-8, -1e-8, 5e-7, -5e-7, -8.903178e-08, float("nan"), float("inf"), -float("inf"), 3.4e38, -3.4e38, 1e-45, None]
    rows = [(0, halves), (1, odd), (2, None), (3, [])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.queries()["quantity_list_si"](spark, str(tmp_path)).collect()
    want = oracle.connection(str(tmp_path)).sql(registry.oracle_sql()["quantity_list_si"]).fetchall()
    assert {r.vec_id: repr(r.si) for r in got} == {k: repr(v) for k, v in want}
    assert "-0.0" in repr(want)


def test_rounded_keeps_what_overflows(spark):
    values = [1e305, -1e305, 2.5, -2.5, 0.49999999999999994, 4503599627370495.5, None]
    out = spark.createDataFrame([(v,) for v in values], "x double").select(rounded(F.col("x"), 0).alias("a"), rounded(F.col("x"), 9).alias("b")).collect()
    assert [r.a for r in out] == [1e305, -1e305, 3.0, -3.0, 0.0, 4503599627370496.0, None]
    assert [r.b for r in out][:4] == [1e305, -1e305, 2.5, -2.5]
