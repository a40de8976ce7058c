"""Provenance on the test tables: an event is made from the event of a third of its number; orders from customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import table
from ..operators import provenance as P
from .registry import query


def _event_edges(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_id > 0")
    return e.select(F.col("event_id").alias("product_id"), F.floor(F.col("event_id") / 3).alias("source_id"))


def _order_edges(spark: SparkSession, d: str) -> DataFrame:
    role = F.when(F.col("o_orderstatus") == "F", "emission_data").when(F.col("o_orderstatus") == "O", "calibration").otherwise("attenuation")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("product_id"), F.col("o_custkey").alias("source_id"), role.alias("role"))


@query("""WITH RECURSIVE w(start, node, steps) AS (
  SELECT event_id, event_id // 3, 1 FROM events WHERE event_id > 0
  UNION ALL SELECT start, node // 3, steps + 1 FROM w WHERE node > 0)
SELECT start, node, steps::INTEGER AS steps FROM w""")
def provenance_ancestry(spark: SparkSession, d: str) -> DataFrame:
    """The whole tree of sources of every event."""
    return P.ancestry(_event_edges(spark, d), table(spark, d, "events").select(F.col("event_id").alias("product_id")))


@query("""WITH RECURSIVE w(start, node, steps) AS (
  SELECT event_id, event_id // 3, 1 FROM events WHERE event_id > 0
  UNION ALL SELECT start, node // 3, steps + 1 FROM w WHERE node > 0)
SELECT node AS source, count(*) AS n_descendants, max(steps)::INTEGER AS depth FROM w GROUP BY node""")
def provenance_descendants(spark: SparkSession, d: str) -> DataFrame:
    """How much was made from every event, directly or not."""
    found = P.descendants(_event_edges(spark, d), table(spark, d, "events").select(F.col("event_id").alias("product_id")))
    return found.groupBy(F.col("start").alias("source")).agg(F.count(F.lit(1)).alias("n_descendants"), F.max("steps").alias("depth"))


@query("""SELECT c_custkey AS product_id, role, count(*) AS n FROM customer JOIN (
  SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'emission_data' WHEN 'O' THEN 'calibration' ELSE 'attenuation' END AS role FROM orders) ON o_custkey = c_custkey
WHERE role <> 'attenuation' GROUP BY ALL""")
def provenance_roles(spark: SparkSession, d: str) -> DataFrame:
    """Sources of customers by role, two of the roles."""
    edges = _order_edges(spark, d).select(F.col("source_id").alias("product_id"), F.col("product_id").alias("source_id"), "role")
    found = P.sources_of(edges, table(spark, d, "customer").select(F.col("c_custkey").alias("product_id")))
    return found.where("role <> 'attenuation'").groupBy("product_id", "role").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey AS product_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)""")
def provenance_roots(spark: SparkSession, d: str) -> DataFrame:
    """Customers of whom no order is recorded."""
    edges = table(spark, d, "orders").select(F.col("o_custkey").alias("product_id"))
    return P.roots(table(spark, d, "customer").select(F.col("c_custkey").alias("product_id")), edges)


_RESOLVE = """WITH e AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN 'gone/' || o_custkey::VARCHAR ELSE 'c/' || o_custkey::VARCHAR END AS hint FROM orders),
p AS (SELECT 'c/' || c_custkey::VARCHAR AS path FROM customer WHERE c_custkey % 5 <> 0), m AS (SELECT c_custkey, 'm/' || c_custkey::VARCHAR AS path FROM customer WHERE c_custkey % 3 <> 0),
r AS (SELECT o_orderkey AS product_id, o_custkey AS source_id, coalesce(p.path, m.path) AS path, CASE WHEN p.path IS NOT NULL THEN 'link' WHEN m.path IS NOT NULL THEN 'manifest' ELSE 'not_found' END AS how
  FROM e LEFT JOIN p ON p.path = hint LEFT JOIN m ON m.c_custkey = o_custkey)
SELECT * FROM r"""


def _resolution(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    hint = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("gone/"), "o_custkey")).otherwise(F.concat(F.lit("c/"), "o_custkey"))
    edges = table(spark, d, "orders").select(F.col("o_orderkey").alias("product_id"), F.col("o_custkey").alias("source_id"), hint.alias("hint"))
    c = table(spark, d, "customer")
    return edges, c.where("c_custkey % 5 <> 0").select(F.concat(F.lit("c/"), "c_custkey").alias("path")), c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("source_id"), F.concat(F.lit("m/"), "c_custkey").alias("path"))


@query(_RESOLVE)
def resolve_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Links, then the manifest, then not found; some paths and ids are missing."""
    return P.resolve(*_resolution(spark, d))


@query(_RESOLVE.replace("SELECT * FROM r", "SELECT product_id, source_id, CASE WHEN source_id % 10 = 0 THEN 'cache/' || source_id ELSE path END AS path, CASE WHEN source_id % 10 = 0 THEN 'hook' ELSE how END AS how FROM r"))
def resolve_override(spark: SparkSession, d: str) -> DataFrame:
    """A hook that is asked first knows some of the sources."""
    hook = F.when(F.col("source_id") % 10 == 0, F.concat(F.lit("cache/"), "source_id"))
    return P.resolve(*_resolution(spark, d), hook=hook)


@query(_RESOLVE.replace("SELECT * FROM r", "SELECT * FROM r WHERE how = 'manifest'"))
def stale_links(spark: SparkSession, d: str) -> DataFrame:
    return P.stale_links(*_resolution(spark, d))


@query("""SELECT o_custkey, o_orderdate, o_orderkey, row_number() OVER w::INTEGER AS version, lag(o_orderkey) OVER w AS previous FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate NULLS FIRST, o_orderkey)""".replace("row_number() OVER w::INTEGER", "(row_number() OVER w)::INTEGER"))
def version_history(spark: SparkSession, d: str) -> DataFrame:
    return P.history(table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), "o_custkey", ["o_orderdate", "o_orderkey"])


@query("""WITH RECURSIVE e AS (SELECT event_id AS a, CASE WHEN event_id = 1 THEN 40 ELSE event_id // 3 END AS b FROM events WHERE event_id > 0),
w(a) AS (SELECT 1::BIGINT UNION SELECT e.a FROM e JOIN w ON e.b = w.a)
SELECT a AS product_id FROM w""")
def cycle_check(spark: SparkSession, d: str) -> DataFrame:
    """Events on or above a cycle, after one edge back was planted (1 is made from 40)."""
    edges = _event_edges(spark, d)
    return P.cyclic(edges.withColumn("source_id", F.when(F.col("product_id") == 1, F.lit(40).cast("bigint")).otherwise(F.col("source_id"))))


@query("""SELECT o_orderkey AS entity, 'isBasedOn' AS relation, o_custkey AS based_on, CASE o_orderstatus WHEN 'F' THEN 'emission_data' WHEN 'O' THEN 'calibration' ELSE 'attenuation' END AS role, coalesce(c_name, 'unknown') AS tool
FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def ingest_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges for export with the tool that wrote them."""
    from ..sources.exports import edges

    tools = table(spark, d, "customer").select(F.col("c_custkey").alias("based_on"), F.col("c_name").alias("tool"))
    return edges(_order_edges(spark, d)).join(tools, "based_on", "left").withColumn("tool", F.coalesce("tool", F.lit("unknown")))


@query("""SELECT d.doc_id FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels) AND d.doc_id % 5 = 0""")
def changed_sources(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents whose recorded digest is no longer that of the document (every fifth was altered)."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("product_id"), F.sha2("text", 256).alias("content_hash"))
    now = docs.withColumn("content_hash", F.when(F.col("product_id") % 5 == 0, F.lit("changed")).otherwise(F.col("content_hash")))
    known = table(spark, d, "labels").select(F.col("doc_id").alias("product_id")).distinct()
    edges = docs.join(known, "product_id", "left_semi").withColumn("source_id", F.col("product_id"))
    return P.changed_sources(edges, now).select(F.col("product_id").alias("doc_id"))
