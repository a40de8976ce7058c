"""A product written, sealed, published and read again: vectors are slices of a volume of 8 by 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import scratch, table
from ..operators import arrays as A
from ..operators import hashing as H
from ..sources import store as S
from .registry import query

_AXES = ["z", "y", "x"]
_IDENTITY = {"timestamp": "2024-01-01T00:00:00Z", "scanner_uuid": "s1", "vendor_series_id": "7"}


def _published(spark: SparkSession, d: str) -> tuple[str, str]:
    """(store, id) of a product made by plans alone: no array passes through the driver."""
    v = A.long_form(table(spark, d, "embeddings").where(F.size("embedding") == 64), ["vec_id"], "embedding")
    cells = v.select(F.col("vec_id").alias("z"), F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).cast("bigint").alias("x"), "v")
    depth = table(spark, d, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    names = [r.r_name for r in table(spark, d, "region").collect()]  # 5 rows
    schema = {"type": "object", "properties": {n: {"type": "string"} for n in names}, "required": ["ASIA"]}
    store = scratch(spark, "store")
    with S.create(spark, store, product="recon", identity=_IDENTITY, name="volume", description="vectors", timestamp=_IDENTITY["timestamp"], schema=schema) as p:
        p.write_cells(cells, _AXES, [depth, 8, 8], [4, 8, 8], units="Bq/mL")
        p.write_metadata({"study": {"type": "pet"}})
    return store, p.id


@query("""SELECT vec_id AS z, i // 8 AS y, i % 8 AS x, embedding[i + 1]::DOUBLE AS v FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS i FROM embeddings WHERE vec_id = 17)""")
def store_slice(spark: SparkSession, d: str) -> DataFrame:
    """One slice of a published volume; only the chunk that holds it is read."""
    store, _ = _published(spark, d)
    return S.read_slice(S.read(spark, store, "chunks"), _AXES, z=17).select(*[F.col(a).cast("long").alias(a) for a in _AXES], "v")


@query("""SELECT vec_id // 4 AS chunk_idx, min(vec_id // 4 * 4) AS first_slice, (least(4, (SELECT max(vec_id) + 1 FROM embeddings) - vec_id // 4 * 4) * 256)::INTEGER AS n_bytes, true AS ok
FROM embeddings GROUP BY vec_id // 4""")
def store_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a published volume; the digests made by the plan that wrote them are those of the bytes read back."""
    store, _ = _published(spark, d)
    c = S.read(spark, store, "chunks")
    return c.select("chunk_idx", F.col("lo0").alias("first_slice"), F.octet_length("data").alias("n_bytes"), (H.chunk_hash(F.col("data")) == F.col("chunk_hash")).alias("ok"))


@query("""SELECT * FROM (VALUES ('/volume', 'units', 'Bq/mL'), ('/volume', 'dtype', '<f4'), ('/volume', 'chunk_shape', '["4", "8", "8"]'), ('/study', 'type', 'pet')) AS t(path, key, value)
UNION ALL SELECT '/volume', 'shape', '["' || (max(vec_id) + 1)::VARCHAR || '", "8", "8"]' FROM embeddings""")
def store_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Attributes of a published product's groups and datasets."""
    store, _ = _published(spark, d)
    return S.read(spark, store, "attrs").where("path <> '/'").select("path", "key", "value")


@query("""SELECT r_name AS property, r_name = 'ASIA' AS required FROM region""")
def store_schema(spark: SparkSession, d: str) -> DataFrame:
    """The embedded schema of a published product, found by its id."""
    store, ident = _published(spark, d)
    schema = S.read_schema(spark, store, ident)
    return spark.createDataFrame([(n, n in schema["required"]) for n in schema["properties"]], "property string, required boolean")


@query("""SELECT * FROM (VALUES ('product', 'recon'), ('name', 'volume'), ('units', 'Bq/mL')) AS t(key, value)""")
def catalogue_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Attributes found in the catalogue, which a second refresh leaves as it is."""
    store, _ = _published(spark, d)
    S.refresh(spark, store, ("attrs",))
    S.refresh(spark, store, ("attrs",))
    return S.catalogue(spark, store, "attrs").where(F.col("key").isin("product", "name", "units")).select("key", "value")
