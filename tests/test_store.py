import numpy as np
import pytest
from pyspark.sql import functions as F

from sealwright.sources import exports as E
from sealwright.sources import store as S

IDENT = {"timestamp": "2023-03-05T09:30:00+01:00", "scanner_uuid": "s", "vendor_series_id": "1"}


def make(spark, store, name="n", **meta):
    with S.create(spark, store, product="recon", identity=IDENT, name=name, description="d", timestamp=IDENT["timestamp"], schema={"type": "object"}) as p:
        p.write_volume(np.arange(60, dtype="f4").reshape(5, 4, 3), chunk=(2, 2, 2), units="Bq")
        p.write_metadata({"study": {"type": "pet", "dose": {"value": 1.5, "units": "MBq", "unitSI": 1e6}}} | meta)
        p.add_source("raw", "sha256:abc", "sha256:def", "emission_data")
    return p


def test_create_read_verify(spark, tmp_path):
    store = f"file://{tmp_path}"
    p = make(spark, store)
    folder = f"{store}/{p.id.split(':')[1]}-{p.content_hash.split(':')[1][:16]}"
    assert S.content_hash(spark, folder).first()["content_hash"] == p.content_hash
    assert S.content_hash(spark, folder, full=True).first()["content_hash"] == p.content_hash
    assert S.read_schema(spark, store, p.id) == {"type": "object"}
    with pytest.raises(KeyError):
        S.read_schema(spark, store, "none")
    chunks = S.read(spark, store, "chunks")
    last = chunks.orderBy(F.desc("chunk_idx")).first()
    assert (last.chunk_idx, last.extent, len(last.data)) == (11, [1, 2, 1], 8)
    with pytest.raises(FileExistsError):
        make(spark, store)
    q = make(spark, store, name="other")
    assert q.id == p.id and q.content_hash != p.content_hash


def test_wrong_identity(spark, tmp_path):
    with pytest.raises(ValueError):
        S.create(spark, f"file://{tmp_path}", product="recon", identity={"x": 1}, name="n", description="d")


def test_chunks_cover_the_array():
    a = np.arange(60, dtype="f4").reshape(5, 4, 3)
    got = np.full_like(a, -1)
    for _, o, e, raw in S.chunks_of(a, (2, 2, 2)):
        got[tuple(slice(x, x + n) for x, n in zip(o, e))] = np.frombuffer(raw, "<f4").reshape(e)
    assert (got == a).all()


def test_chunks_in_long_form(spark, tmp_path):
    a = np.random.default_rng(1).random((5, 4, 3)).astype("f4")
    cells = spark.createDataFrame([(*map(int, i), float(v)) for i, v in np.ndenumerate(a)], "z long, y long, x long, v double")
    made = S.to_chunks(cells, ["z", "y", "x"], [5, 4, 3], [2, 3, 2])
    got = {r.chunk_idx: (r.origin, r.extent, bytes(r.data)) for r in made.collect()}
    assert got == {i: (o, e, raw) for i, o, e, raw in S.chunks_of(a, (2, 3, 2))}
    back = {(r.z, r.y, r.x): r.v for r in S.from_chunks(made, ["z", "y", "x"]).collect()}
    assert back == {i: float(v) for i, v in np.ndenumerate(a)}
    assert {(r.y, r.x): r.v for r in S.read_slice(made, ["z", "y", "x"], z=4).collect()} == {i: float(v) for i, v in np.ndenumerate(a[4])}
    with S.create(spark, f"file://{tmp_path}", product="recon", identity=IDENT, name="n", description="d") as p:
        p.write_chunks(made, "/volume")
    stored = S.read(spark, f"file://{tmp_path}", "chunks")
    assert stored.count() == len(got) and p.content_hash.startswith("sha256:")


def test_original_files(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x")
    row = S.original_files(spark, f"file://{tmp_path}").first()
    assert row.size_bytes == 1 and row.sha256.startswith("2d711642")


def test_attachments():
    assert S.attachment(b"x", type="text/plain")[5] == b"x"
    for bad in ({}, {"data": b"x", "url": "u"}, {"url": "u"}):
        with pytest.raises(ValueError):
            S.attachment(**bad)


def test_manifest_round_trip(spark):
    rows = [{"id": "b", "product": "roi", "n": 2, "sources": ["a"], "ok": True, "x": None}, {"id": "a", "product": "recon", "n": 1, "sources": [], "ok": False, "x": 'q"\n', "duration": {"value": 367.0, "units": "s", "unitSI": 1.0}}]
    text = E.manifest_toml(rows, "set1", {"study": {"type": "clinical", "site": {"name": "z"}}})
    assert text.index('id = "a"') < text.index('id = "b"') and "duration_s = 367.0" in text
    back = {r.id: r for r in E.parse_manifest(spark, text).collect()}
    assert back["a"].x == 'q"\n' and back["b"].x is None and back["b"].sources == ["a"] and back["b"].ok and back["a"].duration_s == 367.0
    assert E.parse_context(text) == {"_schema_version": 1, "dataset_name": "set1", "study": {"type": "clinical", "site": {"name": "z"}}}
    assert E.parse_manifest(spark, "").count() == 0


def test_texts():
    rows = [{"timestamp": "2023-03-05T09:30:00+01:00", "scan_type": "pet"}, {"timestamp": "2023-04-01T00:00:00+02:00", "scan_type": "ct"}]
    text = E.datacite(rows, "T", [{"name": "A", "affiliation": "B"}])
    assert '"2023-03-05/2023-04-01"' in text and text.count("subject:") == 2 and 'resourceType: "Dataset"' in text
    graph = E.crate(['{"@id": "x.h5"}'], "n", "CC-BY-4.0", [{"name": "A", "orcid": "https://orcid.org/0"}], [{"file": "x.h5", "tool": "t", "tool_version": "1", "timestamp": "now"}])
    kinds = [g["@type"] for g in __import__("json").loads(graph)["@graph"] if "@type" in g]
    assert kinds == ["CreativeWork", "Dataset", "SoftwareApplication", "CreateAction"]
    assert E.schema_dump('{"b":1,"a":2}').startswith('{\n  "a"')


def test_names(spark):
    df = spark.createDataFrame([("2023-03-05_09-30-00_recon-0a1b2c3d_left_axial.h5",), ("sim-a1b2c3d4.h5",), ("nonsense",)], "name string")
    got = [tuple(r) for r in df.select(*E.parse_name(F.col("name")).values()).collect()]
    assert got == [("2023-03-05_09-30-00", "recon", "0a1b2c3d", "left_axial"), (None, "sim", "a1b2c3d4", None), (None, None, None, None)]


def test_write_text(spark, tmp_path):
    E.write_text(spark, "größe", f"file://{tmp_path}/x/manifest.toml")
    assert (tmp_path / "x" / "manifest.toml").read_text() == "größe"


def test_slices_prune_chunks(spark, tmp_path):
    """A slice's condition reaches the scan of the published chunks."""
    store = f"file://{tmp_path}"
    make(spark, store)
    got = S.read_slice(S.read(spark, store, "chunks"), ["z", "y", "x"], z=3, x=2)
    assert sorted((r.z, r.y, r.x, r.v) for r in got.collect()) == [(3, y, 2, float(36 + 3 * y + 2)) for y in range(4)]
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    assert "LessThanOrEqual(lo0,3)" in plan and "GreaterThan(hi0,3)" in plan and "LessThanOrEqual(lo2,2)" in plan


def test_cells_are_written_by_a_plan(spark, tmp_path):
    cells = spark.range(60).selectExpr("id div 12 as z", "id div 3 % 4 as y", "id % 3 as x", "cast(id as double) as v")
    with S.create(spark, f"file://{tmp_path}/a", product="recon", identity=IDENT, name="n", description="d") as p:
        p.write_cells(cells, ["z", "y", "x"], [5, 4, 3], [2, 2, 2], units="Bq")
    with S.create(spark, f"file://{tmp_path}/b", product="recon", identity=IDENT, name="n", description="d") as q:
        q.write_volume(np.arange(60, dtype="f4").reshape(5, 4, 3), chunk=(2, 2, 2), units="Bq")
    assert p.content_hash == q.content_hash


def test_catalogue(spark, tmp_path):
    store = f"file://{tmp_path}"
    make(spark, store)
    S.refresh(spark, store)
    make(spark, store, name="other")
    S.refresh(spark, store)
    S.refresh(spark, store)
    for name in ("products", "attrs", "nodes", "sources"):
        now = S.catalogue(spark, store, name)
        assert now.select("folder").distinct().count() == 2
        assert sorted(map(str, now.drop("folder").collect())) == sorted(map(str, S.read(spark, store, name).collect()))
