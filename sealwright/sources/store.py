"""Writing, sealing and reading data products as Parquet tables.

A store is a folder with one folder of tables for each product version. A product is written to a staging folder,
hashed in the same plan that writes it, and published by one rename; a published product is never changed.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import sha256
from ..model import TABLES, product_types
from ..operators import hashing, metadata

#: Axes whose chunk bounds are columns of their own.
AXES = 4
CHUNKS = "product_id string, path string, chunk_idx long, origin array<long>, extent array<long>, data binary"


def canonical(value: object) -> str:
    """The canonical text of a metadata value: doubles as big-endian IEEE hex, so that no rounding of text matters."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return np.array(value, ">f8").tobytes().hex()
    if isinstance(value, (list, tuple)):
        return json.dumps([canonical(v) for v in value], ensure_ascii=False)
    if isinstance(value, bytes):
        return value.hex()
    return str(value)


def chunks_of(array: np.ndarray, shape: tuple[int, ...]):
    """(index, origin, extent, bytes) of an array's chunks in row-major order; edge chunks at their actual extent."""
    counts = [-(-n // c) for n, c in zip(array.shape, shape)]
    for i, at in enumerate(np.ndindex(*counts)):
        origin = [a * c for a, c in zip(at, shape)]
        part = array[tuple(slice(o, o + c) for o, c in zip(origin, shape))]
        little = np.ascontiguousarray(part).astype(part.dtype.newbyteorder("<"))
        yield i, origin, list(part.shape), little.tobytes()


def to_chunks(cells: DataFrame, axes: list[str], shape: list[int], chunk: list[int], dtype: str = "<f4", value: str = "v", keys: list[str] = ()) -> DataFrame:
    """Chunk rows (chunk_idx, origin, extent, data) of an array in long form, for :meth:`ProductWriter.write_chunks`.

    One shuffle by chunk; a chunk's cells meet in one row, as many as a chunk holds. Absent cells are 0.
    """
    at = [F.floor(F.col(a) / c) for a, c in zip(axes, chunk)]
    index = hashing.chunk_index(at, [-(-n // c) for n, c in zip(shape, chunk)])
    inside = hashing.chunk_index([F.col(a) % c for a, c in zip(axes, chunk)], chunk).cast("int")
    rows = cells.groupBy(*keys, index.alias("chunk_idx"), F.array(*[a * c for a, c in zip(at, chunk)]).cast("array<bigint>").alias("origin"))
    rows = rows.agg(F.collect_list(F.struct(inside.alias("i"), F.col(value).cast("double").alias("v"))).alias("cells"))
    extent = F.zip_with("origin", F.array(*_limits(shape, chunk)), lambda o, s: F.least(s["chunk"].cast("bigint"), s["n"].cast("bigint") - o))

    @F.pandas_udf(T.BinaryType())
    def pack(places: pd.Series, values: pd.Series, extents: pd.Series) -> pd.Series:
        out = []
        for i, v, e in zip(places, values, extents):
            full = np.zeros(int(np.prod(chunk)), np.dtype(dtype))
            full[np.asarray(i, int)] = v
            out.append(np.ascontiguousarray(full.reshape(chunk)[tuple(slice(0, int(n)) for n in e)]).tobytes())
        return pd.Series(out, dtype=object)

    rows = rows.withColumn("extent", extent)
    return rows.select(*keys, "chunk_idx", "origin", "extent", pack(F.col("cells.i"), F.col("cells.v"), "extent").alias("data"))


def _limits(shape: list[int], chunk: list[int]) -> list:
    return [F.struct(F.lit(n).alias("n"), F.lit(c).alias("chunk")) for n, c in zip(shape, chunk)]


def from_chunks(chunks: DataFrame, axes: list[str], dtype: str = "<f4", keys: list[str] = ()) -> DataFrame:
    """The long form of chunk rows; a filter on origins before it keeps other chunks unread."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def unpack(data: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, np.dtype(dtype)).astype(float) for x in data], dtype=object)

    rows = chunks.select(*keys, "origin", "extent", F.posexplode(unpack("data")).alias("i", "v"))
    rest, places = F.col("i").cast("bigint"), []
    for k in reversed(range(len(axes))):
        n = F.col("extent")[k]
        places.insert(0, (F.col("origin")[k] + rest % n).alias(axes[k]))
        rest = F.floor(rest / n)
    return rows.select(*keys, *places, "v")


def read_slice(chunks: DataFrame, axes: list[str], dtype: str = "<f4", **at: int) -> DataFrame:
    """Cells at given indexes: only the chunks that hold them are decoded, and of a published product only they are read.

    Its chunks carry their bounds as plain columns, on which Parquet skips files, row groups and pages.
    """
    for a, i in at.items():
        k = axes.index(a)
        low, high = (F.col(f"lo{k}"), F.col(f"hi{k}")) if f"lo{k}" in chunks.columns else (F.col("origin")[k], F.col("origin")[k] + F.col("extent")[k])
        chunks = chunks.where((low <= i) & (high > i))
    out = from_chunks(chunks, axes, dtype)
    for a, i in at.items():
        out = out.where(F.col(a) == i)
    return out


class ProductWriter:
    """``with create(spark, store, product="recon", ...) as p: p.write_volume(...); p.write_metadata({...})``."""

    def __init__(self, spark: SparkSession, store: str, product: str, identity: dict[str, object], name: str, description: str, timestamp: str | None = None, schema: dict | None = None):
        self.spark, self.store = spark, store.rstrip("/")
        kind = product_types().get(product)
        if kind is not None and tuple(identity) != kind.identity:
            raise ValueError(f"{product} is identified by {', '.join(kind.identity)}")
        self.root = {"_schema": json.dumps(schema or {}), "_schema_version": 1, "product": product, "name": name, "description": description, "id_inputs": " + ".join(("product", *identity)), "timestamp": timestamp}
        self.identity = [str(v) if v is not None else "" for v in (product, *identity.values())]
        self.tree: dict = {}
        self.volumes: list[tuple[str, np.ndarray, tuple, dict]] = []
        self.frames: list[tuple[str, DataFrame, dict]] = []
        self.links: list[tuple] = []

    def __enter__(self) -> ProductWriter:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.seal()

    def write_volume(self, data: np.ndarray, path: str = "/volume", chunk: tuple[int, ...] | None = None, **attrs) -> None:
        """An array in slice-shaped chunks (1, ..., Y, X)."""
        chunk = chunk or (*(1 for _ in data.shape[:-2]), *data.shape[-2:])
        self.volumes.append((path, data, chunk, attrs))

    def write_chunks(self, chunks: DataFrame, path: str, **attrs) -> None:
        """Chunks that a plan makes: (chunk_idx, origin, extent, data); nothing of them passes through the driver."""
        self.frames.append((path, chunks, attrs))

    def write_cells(self, cells: DataFrame, axes: list[str], shape: list[int], chunk: list[int], path: str = "/volume", dtype: str = "<f4", value: str = "v", **attrs) -> None:
        """An array in long form, cut into chunks by the plan that writes them."""
        self.write_chunks(to_chunks(cells, axes, shape, chunk, dtype, value), path, **attrs, dtype=dtype, shape=list(shape), chunk_shape=list(chunk))

    def write_metadata(self, tree: dict) -> None:
        self.tree |= tree

    def add_source(self, name: str, source_id: str, content_hash: str, role: str, file: str = "") -> None:
        self.links.append((name, source_id, content_hash, role, file))

    def seal(self) -> str:
        """Write all tables, compute the seal from digests made in the writing plan, publish; returns the id."""
        spark = self.spark
        ident = spark.range(1).select(F.concat(F.lit("sha256:"), sha256(F.lit("\x00".join(self.identity)))).alias("id")).first()[0]
        self.root["id"] = ident
        rows = [(ident, p, k, canonical(v), metadata.type_of(v)) for p, k, v in metadata.flatten(self.root | self.tree)]
        data_paths = {}
        chunk_rows = []
        for path, array, shape, attrs in self.volumes:
            data_paths[path] = attrs | {"dtype": array.dtype.str, "shape": list(array.shape), "chunk_shape": list(shape)}
            chunk_rows += [(ident, path, *c) for c in chunks_of(array, shape)]
        data_paths |= {path: attrs for path, _, attrs in self.frames}
        rows += [(ident, p, k, canonical(v), metadata.type_of(v)) for p, a in data_paths.items() for k, v in sorted(a.items())]
        chunks = spark.createDataFrame(chunk_rows, CHUNKS)
        for path, frame, _ in self.frames:
            chunks = chunks.unionByName(frame.select(F.lit(ident).alias("product_id"), F.lit(path).alias("path"), "chunk_idx", "origin", "extent", "data"))
        paths = {"/"} | {p for _, p, *_ in rows} | set(data_paths)
        for p in list(paths):
            while p != "/":
                p = p.rsplit("/", 1)[0] or "/"
                paths.add(p)
        nodes = [(ident, p, None if p == "/" else (p.rsplit("/", 1)[0] or "/"), p.rsplit("/", 1)[1], 0 if p == "/" else p.count("/"), "dataset" if p in data_paths else "group") for p in sorted(paths)]
        staging = f"{self.store}/.staging-{uuid.uuid4().hex}"
        bounds = {f"{name}{k}": F.get("origin", F.lit(k)) + (F.get("extent", F.lit(k)) if name == "hi" else 0) for k in range(AXES) for name in ("lo", "hi")}
        chunks = chunks.withColumns(bounds | {"chunk_hash": hashing.chunk_hash(F.col("data"))})
        chunks.sortWithinPartitions("path", "chunk_idx").write.parquet(f"{staging}/chunks")
        attrs = spark.createDataFrame(rows, TABLES["attrs"])
        attrs.write.parquet(f"{staging}/attrs")
        spark.createDataFrame(nodes, TABLES["nodes"]).write.parquet(f"{staging}/nodes")
        spark.createDataFrame([(ident, *x) for x in self.links], "product_id string, name string, source_id string, content_hash string, role string, file string").write.parquet(f"{staging}/sources")
        seal = content_hash(spark, staging).first()["content_hash"]
        product = [(ident, self.root["product"], self.root["name"], self.root["description"], self.root["timestamp"], self.root["_schema"], seal)]
        spark.createDataFrame(product, "product_id string, product string, name string, description string, ts_raw string, schema_json string, content_hash string").write.parquet(f"{staging}/products")
        self._publish(staging, f"{self.store}/{ident.split(':')[1]}-{seal.split(':')[1][:16]}")
        self.id, self.content_hash = ident, seal
        return ident

    def _publish(self, staging: str, target: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        src, dst = jvm.org.apache.hadoop.fs.Path(staging), jvm.org.apache.hadoop.fs.Path(target)
        fs = src.getFileSystem(conf)
        if fs.exists(dst):
            fs.delete(src, True)
            raise FileExistsError(target)
        if not fs.rename(src, dst):
            raise OSError(f"cannot publish {target}")


def create(spark: SparkSession, store: str, **kw) -> ProductWriter:
    return ProductWriter(spark, store, **kw)


def read(spark: SparkSession, store: str, table: str) -> DataFrame:
    """One table of all published products; a filter on it prunes columns and row groups."""
    return spark.read.parquet(f"{store.rstrip('/')}/[0-9a-f]*/{table}")


def refresh(spark: SparkSession, store: str, tables: tuple[str, ...] = ("products", "attrs", "nodes", "sources")) -> None:
    """Add the small tables of products published since the last call to the store's catalogue.

    The catalogue holds them in a few files, whatever the number of products; published products stay what counts, and
    the catalogue can be made again from them. Rows carry their product's folder, by which they are added once.
    """
    root = store.rstrip("/")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name in tables:
        target = f"{root}/_catalogue/{name}"
        rows = read(spark, root, name).withColumn("folder", F.regexp_extract(F.input_file_name(), "/([0-9a-f]+-[0-9a-f]+)/[a-z]+/[^/]+$", 1))
        if fs.exists(path(target)):
            rows = rows.join(spark.read.parquet(target).select("folder").distinct(), "folder", "left_anti").select(*rows.columns)
        rows.write.mode("append").parquet(target)


def catalogue(spark: SparkSession, store: str, table: str) -> DataFrame:
    """A small table of all products as of the last :func:`refresh`, without a look into their folders."""
    return spark.read.parquet(f"{store.rstrip('/')}/_catalogue/{table}")


def read_schema(spark: SparkSession, store: str, product_id: str) -> dict:
    """The embedded schema of a product, by one pruned read."""
    row = read(spark, store, "products").where(F.col("product_id") == product_id).select("schema_json").first()
    if row is None:
        raise KeyError(product_id)
    return json.loads(row[0])


def schema_properties(products: DataFrame, keys: list[str], schema: str = "schema_json") -> DataFrame:
    """(keys, property, required) of the embedded schemas of many products."""
    names = F.explode(F.json_object_keys(F.get_json_object(schema, "$.properties"))).alias("property")
    needed = F.from_json(F.get_json_object(schema, "$.required"), "array<string>").alias("needed")
    return products.select(*keys, names, needed).select(*keys, "property", F.coalesce(F.array_contains("needed", F.col("property")), F.lit(False)).alias("required"))


def content_hash(spark: SparkSession, folder: str, full: bool = False, hardened: bool = False) -> DataFrame:
    """(product_id, content_hash) of the product in a folder, from stored chunk digests or (``full``) from the bytes."""
    chunks = spark.read.parquet(f"{folder}/chunks")
    if full:
        chunks = chunks.withColumn("chunk_hash", hashing.chunk_hash(F.col("data")))
    data = hashing.dataset_hash(chunks, ["product_id", "path"], "chunk_idx", "chunk_hash")
    attrs = spark.read.parquet(f"{folder}/attrs")
    own = hashing.attribute_hash(attrs, ["product_id", "path"])
    nodes = spark.read.parquet(f"{folder}/nodes").join(own, ["product_id", "path"], "left").join(data, ["product_id", "path"], "left")
    empty = sha256(F.lit(""))
    nodes = nodes.withColumn("dataset_hash", F.when(F.col("kind") == "dataset", F.coalesce("dataset_hash", empty)))
    return hashing.tree_hash(nodes, hardened)


def original_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256, size_bytes) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", sha256(F.col("content")).alias("sha256"), F.col("length").alias("size_bytes"))


ATTACHMENT = T.StructType([T.StructField(n, T.StringType()) for n in ("author", "date", "type", "file_name", "description")] + [T.StructField("data", T.BinaryType()), T.StructField("url", T.StringType()), T.StructField("sha256", T.StringType())])

SLICE_METADATA = T.StructType([T.StructField("instance", T.IntegerType()), T.StructField("location", T.DoubleType()), T.StructField("time", T.StringType()), T.StructField("position", T.ArrayType(T.DoubleType()))])


def attachment(data: bytes | None = None, url: str | None = None, sha256: str | None = None, **fields: str) -> tuple:
    """A row of an embedded attachment, or of a reference to an external one with its digest."""
    if (data is None) == (url is None):
        raise ValueError("either data or url")
    if url is not None and not sha256:
        raise ValueError("a reference needs the digest of what it refers to")
    return (*(fields.get(n) for n in ("author", "date", "type", "file_name", "description")), data, url, sha256)
