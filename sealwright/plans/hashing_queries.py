"""Identity and integrity on the test tables: a conversation stands for a dataset and its turns for chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import NUL, sha256, text_of
from ..functions.tables import table
from ..model import product_types
from ..operators import hashing as H
from .registry import query


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", H.chunk_hash(text_of(F.col("text"))).alias("h"))


@query("""SELECT conv_id, sha256(unhex(string_agg(sha256(coalesce(text, '')), '' ORDER BY turn))) AS dataset_hash
FROM conversations GROUP BY conv_id""")
def merkle_dataset_hash(spark: SparkSession, d: str) -> DataFrame:
    return H.dataset_hash(_turns(spark, d), ["conv_id"], "turn", "h")


@query("""WITH c AS (
  SELECT c_nationkey, c_name, sha256(c_name || chr(0) || c_mktsegment || chr(0) || round(c_acctbal * 100)::BIGINT::VARCHAR) AS h FROM customer),
n AS (
  SELECT n_regionkey, n_name, sha256(unhex(sha256(n_name) || coalesce(k.h, ''))) AS h
  FROM nation LEFT JOIN (SELECT c_nationkey, string_agg(h, '' ORDER BY c_name) AS h FROM c GROUP BY 1) k ON c_nationkey = n_nationkey),
r AS (
  SELECT r_name, sha256(unhex(sha256(r_name) || coalesce(k.h, ''))) AS h
  FROM region LEFT JOIN (SELECT n_regionkey, string_agg(h, '' ORDER BY n_name) AS h FROM n GROUP BY 1) k ON n_regionkey = r_regionkey)
SELECT 'sha256:' || sha256(unhex(sha256(unhex(sha256('') || string_agg(h, '' ORDER BY r_name))))) AS content_hash FROM r""")
def merkle_root_hash(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and customers as a tree of groups; children in name order at every level."""
    c = table(spark, d, "customer")
    leaf = sha256(F.concat_ws(NUL, "c_name", "c_mktsegment", F.round(F.col("c_acctbal") * 100).cast("bigint").cast("string")))
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    row = lambda df, path, parent, name, depth, kind, attr, data: df.select(F.lit("p").alias("product_id"), path.alias("path"), parent.alias("parent"), name.alias("name"), F.lit(depth).alias("depth"), F.lit(kind).alias("kind"), attr.alias("attr_hash"), data.alias("dataset_hash"))
    none = F.lit(None).cast("string")
    nodes = row(spark.range(1), F.lit("/"), none, F.lit(""), 0, "group", none, none)
    nodes = nodes.union(row(r, F.concat(F.lit("r"), "r_regionkey"), F.lit("/"), F.col("r_name"), 1, "group", sha256(F.col("r_name")), none))
    nodes = nodes.union(row(n, F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.col("n_name"), 2, "group", sha256(F.col("n_name")), none))
    nodes = nodes.union(row(c, F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), F.col("c_name"), 3, "dataset", none, leaf))
    return H.tree_hash(nodes).select("content_hash")


@query("""SELECT p_partkey, sha256(unhex(string_agg(sha256(k || v), '' ORDER BY k))) AS attr_hash FROM (
  SELECT p_partkey, 'p_brand' AS k, coalesce(p_brand, '') AS v FROM part UNION ALL
  SELECT p_partkey, 'p_name', coalesce(p_name, '') FROM part UNION ALL
  SELECT p_partkey, 'p_size', coalesce(p_size::VARCHAR, '') FROM part) GROUP BY p_partkey""")
def attribute_hash(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in ("p_brand", "p_name", "p_size")], F.struct(F.lit("content_hash").alias("key"), F.lit("left out").alias("value")))
    attrs = p.select("p_partkey", F.explode(pairs).alias("a")).select("p_partkey", "a.key", "a.value")
    return H.attribute_hash(attrs, ["p_partkey"])


@query("""SELECT o_orderkey, 'sha256:' || sha256('recon' || chr(0) || coalesce(o_custkey::VARCHAR, '') || chr(0) || coalesce(o_orderkey::VARCHAR, '') || chr(0) || coalesce(o_orderpriority, '')) AS id,
  substr(sha256('recon' || chr(0) || coalesce(o_custkey::VARCHAR, '') || chr(0) || coalesce(o_orderkey::VARCHAR, '') || chr(0) || coalesce(o_orderpriority, '')), 1, 8) AS short_id FROM orders""")
def identity_hash(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "orders").select("o_orderkey", H.identity(F.lit("recon"), "o_custkey", "o_orderkey", "o_orderpriority").alias("id"))
    return out.withColumn("short_id", H.short_id(F.col("id")))


_IDENTITY_SQL = {
    "recon": ("timestamp", "scanner_uuid", "vendor_series_id"),
    "sim": ("simulation_config_hash", "random_seed"),
    "roi": ("reference_image_id", "method_type", "creation_timestamp"),
}
_IDENTITY_CASE = " ".join(f"WHEN '{k}' THEN 'sha256:' || sha256('{k}' || " + " || ".join(f"chr(0) || '{c}-' || o_orderkey::VARCHAR" for c in v) + ")" for k, v in _IDENTITY_SQL.items())


@query(f"""SELECT o_orderkey, product, CASE product {_IDENTITY_CASE} END AS id FROM (SELECT o_orderkey, ['recon', 'sim', 'roi', 'unheard-of'][o_orderkey % 4 + 1] AS product FROM orders)""")
def identity_of_types(spark: SparkSession, d: str) -> DataFrame:
    """Identities under the rule of each row's own product type; an unknown type has none."""
    names = sorted({c for kind in product_types().values() for c in kind.identity})
    kinds = F.array(*map(F.lit, (*_IDENTITY_SQL, "unheard-of")))
    rows = table(spark, d, "orders").select("o_orderkey", F.element_at(kinds, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("product"), *[F.concat(F.lit(f"{c}-"), "o_orderkey").alias(c) for c in names])
    return rows.select("o_orderkey", "product", H.identity_by_product().alias("id"))


@query("""SELECT substr(h, 1, 4) AS short_id, count(DISTINCT h) AS n_ids FROM (
  SELECT sha256('order' || chr(0) || o_orderkey::VARCHAR) AS h FROM orders UNION ALL SELECT sha256('event' || chr(0) || event_id::VARCHAR) FROM events)
GROUP BY 1 HAVING count(DISTINCT h) > 1""")
def short_id_collision(spark: SparkSession, d: str) -> DataFrame:
    """Four digits instead of eight, so that there are some."""
    a = table(spark, d, "orders").select(H.identity(F.lit("order"), "o_orderkey").alias("id"))
    b = table(spark, d, "events").select(H.identity(F.lit("event"), "event_id").alias("id"))
    return H.collisions(a.union(b), "id", 4)


@query("""SELECT doc_id, sha256(coalesce(text, '')) AS computed, CASE WHEN doc_id % 97 = 0 THEN sha256('x') ELSE sha256(coalesce(text, '')) END AS stored
FROM documents WHERE doc_id % 97 = 0 AND sha256(coalesce(text, '')) <> sha256('x')""")
def chunk_verify(spark: SparkSession, d: str) -> DataFrame:
    """Corrupted chunks, after every 97th stored digest was altered."""
    docs = table(spark, d, "documents").select("doc_id", H.chunk_hash(text_of(F.col("text"))).alias("h"))
    stored = docs.withColumn("h", F.when(F.col("doc_id") % 97 == 0, sha256(F.lit("x"))).otherwise(F.col("h")))
    return H.verify(docs, stored, ["doc_id"], "h").where("not ok").drop("ok")


@query("""WITH h AS (
  SELECT conv_id, sha256(coalesce(text, '')) AS h, turn, CASE WHEN conv_id % 13 = 0 AND turn = 0 THEN sha256('x') ELSE sha256(coalesce(text, '')) END AS s
  FROM conversations),
v AS (
  SELECT conv_id, sha256(unhex(string_agg(s, '' ORDER BY turn) FILTER (WHERE NOT (conv_id % 17 = 1 AND turn = 1)))) AS computed,
    sha256(unhex(string_agg(h, '' ORDER BY turn))) AS stored
  FROM h GROUP BY conv_id)
SELECT *, computed = stored AS ok FROM v""")
def fast_verify(spark: SparkSession, d: str) -> DataFrame:
    """Dataset digests from stored chunk digests, some of them altered and some lost, against the seals."""
    seals = H.dataset_hash(_turns(spark, d), ["conv_id"], "turn", "h")
    kept = _turns(spark, d).where("not (conv_id % 17 = 1 and turn = 1)")
    kept = kept.withColumn("h", F.when(F.expr("conv_id % 13 = 0 and turn = 0"), sha256(F.lit("x"))).otherwise(F.col("h")))
    return H.verify(H.dataset_hash(kept, ["conv_id"], "turn", "h"), seals, ["conv_id"], "dataset_hash")


@query("""WITH f AS (SELECT vec_id, i, embedding[i]::FLOAT::BIT::VARCHAR AS b FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))
SELECT vec_id, sha256(string_agg(substr(b, 25, 8) || substr(b, 17, 8) || substr(b, 9, 8) || substr(b, 1, 8), '' ORDER BY i)::BIT::BLOB) AS chunk_hash FROM f GROUP BY vec_id""")
def chunk_bytes_hash(spark: SparkSession, d: str) -> DataFrame:
    """Digests of the little-endian float32 bytes of every vector."""

    @F.arrow_udf("binary")
    def raw(v: pa.Array) -> pa.Array:
        # a batch of vectors is one buffer of floats already: only the offsets change
        offsets = np.asarray(v.offsets, np.int64) * 4
        data = np.asarray(v.values.fill_null(np.nan).to_numpy(zero_copy_only=False), "<f4").tobytes()
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(v), [pa.py_buffer(np.packbits(~np.asarray(v.is_null()), bitorder="little")), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]).cast(pa.binary())

    return table(spark, d, "embeddings").select("vec_id", H.chunk_hash(raw("embedding")).alias("chunk_hash"))


@query("""SELECT event_id, ((event_id // 100) * 10 + (event_id // 10) % 10) * 10 + event_id % 10 AS chunk_idx FROM events""")
def chunk_index_3d(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    place = [F.floor(e / 100), F.floor(e / 10) % 10, e % 10]
    return table(spark, d, "events").select("event_id", H.chunk_index(place, [0, 10, 10]).alias("chunk_idx"))


@query("""SELECT sha256(text) AS content_hash, min(doc_id) AS kept, count(*) AS copies FROM documents GROUP BY 1""")
def content_dedup(spark: SparkSession, d: str) -> DataFrame:
    return H.unique_by_content(table(spark, d, "documents"), sha256(F.col("text")), "doc_id")


@query("""WITH o AS (SELECT o_orderkey AS k, sha256(o_orderstatus || round(o_totalprice * 100)::BIGINT::VARCHAR) AS h FROM orders WHERE o_orderkey % 10 <> 3),
n AS (SELECT o_orderkey AS k, sha256(CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END || round(o_totalprice * 100)::BIGINT::VARCHAR) AS h FROM orders WHERE o_orderkey % 10 <> 4)
SELECT coalesce(o.k, n.k) AS o_orderkey, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' ELSE 'changed' END AS state
FROM o FULL JOIN n ON o.k = n.k WHERE o.h IS DISTINCT FROM n.h""")
def version_diff(spark: SparkSession, d: str) -> DataFrame:
    """Two versions of the orders: some rows only in one of them, some with another status."""
    o = table(spark, d, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string")
    old = o.where("o_orderkey % 10 <> 3").select("o_orderkey", sha256(F.concat("o_orderstatus", cents)).alias("h"))
    status = F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))
    new = o.where("o_orderkey % 10 <> 4").select("o_orderkey", sha256(F.concat(status, cents)).alias("h"))
    return H.version_diff(old, new, ["o_orderkey"], "h")


@query("""WITH v AS (
  SELECT doc_id, 'sha256' AS algorithm, CASE WHEN doc_id % 101 = 5 THEN NULL WHEN doc_id % 89 = 0 THEN sha256(coalesce(text, '') || 'x') ELSE sha256(coalesce(text, '')) END AS computed,
    sha256(coalesce(text, '')) AS stored FROM documents)
SELECT *, coalesce(computed = stored, false) AS ok FROM v""")
def full_verify(spark: SparkSession, d: str) -> DataFrame:
    """Contiguous data: one digest over all bytes, compared with a stored seal whose prefix names the algorithm.

    After sealing some data were changed and some lost.
    """
    sealed = table(spark, d, "documents").select("doc_id", text_of(F.col("text")).alias("data"))
    now = sealed.where("doc_id % 101 <> 5").withColumn("data", F.when(F.col("doc_id") % 89 == 0, F.concat("data", F.lit("x"))).otherwise(F.col("data")))
    docs = now.select("doc_id", H.chunk_hash(F.col("data")).alias("h"))
    seals = sealed.select("doc_id", F.concat(F.lit("sha256:"), H.chunk_hash(F.col("data"))).alias("seal"))
    stored = seals.select("doc_id", H.hex_digest(F.col("seal")).alias("h"))
    names = seals.select("doc_id", H.algorithm(F.col("seal")).alias("algorithm"))
    return H.verify(docs, stored, ["doc_id"], "h").join(names, "doc_id")


@query("""SELECT conv_id, sha256(unhex(sha256('') || string_agg(h, '' ORDER BY name))) AS group_hash FROM (
  SELECT conv_id, 'turn' || lpad(turn::VARCHAR, 6, '0') AS name, sha256(coalesce(text, '')) AS h FROM conversations) GROUP BY conv_id""")
def group_without_companions(spark: SparkSession, d: str) -> DataFrame:
    """Group digests: companion datasets of chunk digests are there and do not count."""
    name = F.concat(F.lit("turn"), F.lpad(F.col("turn").cast("string"), 6, "0"))
    own = table(spark, d, "conversations").select("conv_id", name.alias("name"), H.chunk_hash(text_of(F.col("text"))).alias("h"))
    companions = own.select("conv_id", F.concat("name", F.lit("_chunk_hashes")).alias("name"), sha256(F.col("h")).alias("h"))
    groups = H.children_of(own.union(companions), ["conv_id"], "name", "h")
    return groups.select("conv_id", H.group_hash(F.lit(None).cast("string"), F.col("children")).alias("group_hash"))


@query("""SELECT doc_id, CASE WHEN strlen(text) > 100000000 THEN 'large' WHEN lang = 'en' THEN 'access' ELSE 'skip' END AS policy FROM documents""")
def chunk_hash_policy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", H.chunk_hash_policy(F.octet_length("text"), F.col("lang") == "en").alias("policy"))
