"""Catalogue, sources and sinks on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import scratch, table
from ..operators import catalog as C
from ..operators import hashing as H
from ..sources import exports as E
from ..sources import store as S
from .registry import query


@query("""SELECT min(ts) AS first, max(ts) AS last, count(*) AS n FROM events""")
def catalog_time_range(spark: SparkSession, d: str) -> DataFrame:
    return C.time_range(table(spark, d, "events"))


@query("""SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL""")
def catalog_by_type(spark: SparkSession, d: str) -> DataFrame:
    return C.by_field(table(spark, d, "events"), "event_type", "user_id")


@query("""SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey""")
def catalog_chronological(spark: SparkSession, d: str) -> DataFrame:
    return C.chronological(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")


@query("""SELECT c_custkey AS product_id, coalesce(bool_or(o_orderstatus = 'F'), false) AS has_volume, coalesce(bool_or(o_orderstatus = 'P'), false) AS has_mip, count(o_orderkey) AS n_regions
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def manifest_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Flags and counts of each product for the manifest."""
    nodes = table(spark, d, "orders").select(F.col("o_custkey").alias("product_id"), F.col("o_orderstatus").alias("name"))
    found = C.flags(nodes, {"has_volume": "F", "has_mip": "P"}).join(nodes.groupBy("product_id").agg(F.count(F.lit(1)).alias("n_regions")), "product_id")
    out = table(spark, d, "customer").select(F.col("c_custkey").alias("product_id")).join(found, "product_id", "left")
    return out.select("product_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("has_volume", "has_mip")], F.coalesce("n_regions", F.lit(0).cast("bigint")).alias("n_regions"))


@query("""SELECT c_custkey AS product_id, coalesce(list_sort(list(DISTINCT o_orderkey::VARCHAR) FILTER (WHERE o_orderkey IS NOT NULL)), []) AS sources FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def manifest_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """The manifest's source lists, made again from the products."""
    sources = table(spark, d, "orders").select(F.col("o_custkey").alias("product_id"), F.col("o_orderkey").cast("string").alias("source_id"))
    return E.manifest(table(spark, d, "customer").select(F.col("c_custkey").alias("product_id")), sources)


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d_%H-%M-%S') || '_recon-' || substr(sha256('recon' || chr(0) || o_orderkey::VARCHAR), 1, 8) || '_' || lower(o_orderstatus) || '.h5' AS name FROM orders""")
def filename_make(spark: SparkSession, d: str) -> DataFrame:
    seal = H.identity(F.lit("recon"), "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", E.file_name(F.col("o_orderdate"), F.lit("recon"), seal, F.lower("o_orderstatus")).alias("name"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d_%H-%M-%S') AS datetime, 'recon' AS product, substr(sha256('recon' || chr(0) || o_orderkey::VARCHAR), 1, 8) AS short_id, lower(o_orderstatus) AS descriptors FROM orders""")
def filename_parse(spark: SparkSession, d: str) -> DataFrame:
    names = filename_make(spark, d)
    return names.select("o_orderkey", *[c.alias(n) for n, c in E.parse_name(F.col("name")).items()])


@query("""SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages""")
def host_of_page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))


@query("""SELECT sha256(r_name || chr(10)) AS sha256, strlen(r_name) + 1 AS size_bytes FROM region""")
def original_files(spark: SparkSession, d: str) -> DataFrame:
    """Digests of files as they are: one text file for each region, read as bytes."""
    folder, regions = scratch(spark, "originals"), table(spark, d, "region")
    for r in regions.select("r_regionkey").collect():  # 5 rows
        regions.where(F.col("r_regionkey") == r.r_regionkey).select("r_name").coalesce(1).write.text(f"{folder}/{r.r_regionkey}")
    return S.original_files(spark, folder).select("sha256", "size_bytes")


@query("""SELECT url AS path, sha256(html) AS sha256, strlen(html) AS size_bytes FROM pages""")
def page_digests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.col("url").alias("path"), F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("bigint").alias("size_bytes"))


@query("""SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, count(*) AS n_files, sum(strlen(html))::BIGINT AS size_bytes FROM pages GROUP BY 1""")
def original_files_by_host(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract("url", "://([^/?#]*)", 1).alias("host")
    return table(spark, d, "pages").groupBy(host).agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.octet_length("html")).alias("size_bytes"))


@query("""SELECT o_orderkey, o_orderstatus, o_orderpriority, event_type, props, value FROM orders JOIN events ON event_id = o_orderkey""")
def table_reads(spark: SparkSession, d: str) -> DataFrame:
    """Compound tables and attributes read by name: only these columns are scanned."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    e = table(spark, d, "events").select("event_id", "event_type", "props", "value")
    return o.join(e, F.col("o_orderkey") == F.col("event_id")).drop("event_id")


@query("""SELECT event_id, props AS header, json_extract_string(props, '$.k') AS k FROM events""")
def header_text(spark: SparkSession, d: str) -> DataFrame:
    """A source header kept as JSON text, unchanged, and a field read from it."""
    return table(spark, d, "events").select("event_id", F.col("props").alias("header"), F.try_variant_get(F.try_parse_json("props"), "$.k", "string").alias("k"))


@query("""SELECT 'c' || c_custkey::VARCHAR AS product_id, '/' AS path, k AS key, v AS value FROM (
  SELECT c_custkey, 'name' AS k, c_name AS v FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer)""")
def attributes_only(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.array(F.struct(F.lit("name").alias("key"), F.col("c_name").alias("value")), F.struct(F.lit("segment").alias("key"), F.col("c_mktsegment").alias("value")))
    rows = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("product_id"), F.lit("/").alias("path"), F.explode(pairs).alias("a")).select("product_id", "path", "a.key", "a.value")
    return C.attributes_only(rows)


@query("""SELECT o_orderkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey""")
def link_follow(spark: SparkSession, d: str) -> DataFrame:
    """Links to the products they name, by id."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey")


@query("""SELECT o_orderkey, CASE WHEN n_name IS NOT NULL THEN '/' || n_name || '/' || c_name END AS path
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def id_to_path(spark: SparkSession, d: str) -> DataFrame:
    """Paths from an id table; Spark broadcasts it while it is small enough."""
    paths = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.when(F.col("n_name").isNotNull(), F.concat(F.lit("/"), "n_name", F.lit("/"), "c_name")).alias("path"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(paths, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "path")


@query("""SELECT 'sha256:' || sha256(c_custkey::VARCHAR) AS product_id, '{"@id":"c' || c_custkey::VARCHAR || '.h5","@type":"File","encodingFormat":"application/x-hdf5","dateCreated":"' || coalesce(t, '') || '","identifier":{"@type":"PropertyValue","propertyID":"sha256","value":"' || sha256(c_custkey::VARCHAR) || '"},"isBasedOn":[' ||
  coalesce(k, '') || ']}' AS entity FROM customer LEFT JOIN (SELECT o_custkey, strftime(min(o_orderdate), '%Y-%m-%d') AS t, string_agg('{"@id":"' || o_orderkey::VARCHAR || '"}', ',' ORDER BY o_orderkey::VARCHAR) AS k FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def export_jsonld(spark: SparkSession, d: str) -> DataFrame:
    """Linked-data entities with what each is based on."""
    seal = lambda c: F.concat(F.lit("sha256:"), F.sha2(F.col(c).cast("string"), 256)).alias("product_id")
    orders = table(spark, d, "orders")
    first = orders.groupBy("o_custkey").agg(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("timestamp"))
    products = table(spark, d, "customer").join(first, F.col("c_custkey") == F.col("o_custkey"), "left")
    products = products.select(seal("c_custkey"), F.concat(F.lit("c"), "c_custkey", F.lit(".h5")).alias("file"), F.coalesce("timestamp", F.lit("")).alias("timestamp"))
    return E.linked_data(products, orders.select(seal("o_custkey"), F.col("o_orderkey").cast("string").alias("source_id")))


@query("""SELECT page_id, url, 'page ' || page_id::VARCHAR AS name, sha256(html) AS sha256 FROM pages WHERE strlen(html) > 2000""")
def external_references(spark: SparkSession, d: str) -> DataFrame:
    """Large attachments as references with the digest of what they refer to."""
    return table(spark, d, "pages").where(F.octet_length("html") > 2000).select("page_id", "url", F.concat(F.lit("page "), "page_id").alias("name"), F.sha2("html", 256).alias("sha256"))


@query("""SELECT vec_id AS instance, embedding[1]::DOUBLE AS location, [embedding[1], embedding[2], embedding[3]]::DOUBLE[] AS position FROM embeddings""")
def slice_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Per-slice records: instance, location, position."""
    x = F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("instance"), F.get(x, F.lit(0)).alias("location"), x.alias("position"))


@query("""WITH e AS (SELECT event_type, props, unnest(json_keys(props)) AS k FROM (SELECT event_type, CASE WHEN event_id % 3 = 0 THEN props ELSE json_merge_patch(props, '{"u": 1}') END AS props FROM events WHERE props IS NOT NULL))
SELECT event_type, k AS property, count(*) = any_value(n) AS required FROM e JOIN (SELECT event_type AS t, count(*) AS n FROM events WHERE props IS NOT NULL GROUP BY 1) ON t = event_type GROUP BY 1, 2""")
def embedded_schemas(spark: SparkSession, d: str) -> DataFrame:
    """Schemas embedded with the data, one for each kind of product, read back: their properties and which are required."""
    e = table(spark, d, "events").where("props is not null").select("event_type", "event_id", F.json_object_keys("props").alias("own"))
    keys = e.select("event_type", F.explode(F.when(F.col("event_id") % 3 == 0, F.col("own")).otherwise(F.array_union("own", F.array(F.lit("u"))))).alias("k"))
    kinds = keys.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n")).join(e.groupBy("event_type").agg(F.count(F.lit(1)).alias("all")), "event_type")
    text = F.to_json(F.struct(F.lit("object").alias("type"), F.map_from_entries(F.collect_list(F.struct("k", F.struct(F.lit("any").alias("type"))))).alias("properties"), F.collect_list(F.when(F.col("n") == F.col("all"), F.col("k"))).alias("required")))
    return S.schema_properties(kinds.groupBy("event_type").agg(text.alias("schema_json")), ["event_type"])


@query("""SELECT n_name AS id, n_regionkey::BIGINT AS region FROM nation""")
def manifest_parse(spark: SparkSession, d: str) -> DataFrame:
    """A manifest written as text and read again."""
    rows = [{"id": r.n_name, "region": r.n_regionkey} for r in table(spark, d, "nation").collect()]  # 25 rows
    return E.parse_manifest(spark, E.manifest_toml(rows, "nations")).select("id", F.col("region").cast("long").alias("region"))


@query("""SELECT 'title: "Regions"' || chr(10) || 'creators:' || chr(10) || '  - name: "A. Author"' || chr(10) || '    affiliation: "Institute"' || chr(10)
  || 'dates:' || chr(10) || '  - date: "2024-01-01/2024-01-0' || count(*) || '"' || chr(10) || '    dateType: "Collected"' || chr(10) || 'resourceType: "Dataset"' || chr(10) || 'subjects:' || chr(10)
  || string_agg('  - subject: "' || r_name || '"' || chr(10) || '    subjectScheme: "scan_type"' || chr(10), '' ORDER BY r_name) AS text FROM region""")
def citation(spark: SparkSession, d: str) -> DataFrame:
    """Citation metadata of a collection; one product for each region, taken on successive days."""
    names = [r.r_name for r in table(spark, d, "region").orderBy("r_name").collect()]  # 5 rows
    rows = [{"scan_type": n, "timestamp": f"2024-01-0{i + 1}T00:00:00Z"} for i, n in enumerate(names)]
    return spark.createDataFrame([(E.datacite(rows, "Regions", [{"name": "A. Author", "affiliation": "Institute"}]),)], "text string")


@query("""SELECT n_name, '{' || chr(10) || '  "title": "' || n_name || '",' || chr(10) || '  "type": "object"' || chr(10) || '}' AS dump FROM nation""")
def schema_dump(spark: SparkSession, d: str) -> DataFrame:
    """Embedded schemas as readable text, keys in order."""
    schema = F.to_json(F.struct(F.lit("object").alias("type"), F.col("n_name").alias("title"))).alias("schema_json")
    rows = table(spark, d, "nation").select("n_name", schema).collect()  # 25 rows
    return spark.createDataFrame([(r.n_name, E.schema_dump(r.schema_json)) for r in rows], "n_name string, dump string")
