"""Metadata operators on the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import rounded, size_class, to_si
from ..functions.tables import table
from ..model import CALIBRATION_TYPES, DEVICE_TYPES, REGION_METHODS, SPECTRUM_METHODS, product_types
from ..operators import metadata as M
from ..operators.calibration import incomplete
from .registry import query


def _long(df: DataFrame, key: str, **values: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.expr(v).cast("string").alias("value")) for k, v in values.items()])
    return df.select(key, F.explode(pairs).alias("a")).select(key, "a.key", "a.value").where("value is not null")


@query("""SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events""")
def attrs_json_extract(spark: SparkSession, d: str) -> DataFrame:
    """A field of open metadata, typed when read; absent ones are null."""
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("""SELECT p_partkey, p_brand AS brand, p_size::VARCHAR AS size FROM part""")
def group_as_map(spark: SparkSession, d: str) -> DataFrame:
    """Attribute rows gathered into one map for each group, then read by key."""
    attrs = _long(table(spark, d, "part"), "p_partkey", brand="p_brand", size="p_size")
    maps = M.groups_as_maps(attrs, ["p_partkey"])
    return maps.select("p_partkey", F.try_element_at("attrs", F.lit("brand")).alias("brand"), F.try_element_at("attrs", F.lit("size")).alias("size"))


@query("""SELECT event_id, event_type, CASE event_type WHEN 'click' THEN value WHEN 'purchase' THEN value * 100 END AS reading FROM events""")
def dispatch_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Known types have readers; the rows of unknown ones are kept with a null."""
    known = {("click", 1): F.col("value"), ("purchase", 1): F.col("value") * 100}
    return table(spark, d, "events").select("event_id", "event_type", M.dispatch(F.col("event_type"), F.lit(1), known).alias("reading"))


@query("""SELECT p_partkey, p_size::VARCHAR AS value, CASE WHEN p_size % 2 = 0 THEN 'mm' ELSE 'cm' END AS units,
  CASE WHEN p_size % 2 = 0 THEN '0.001' ELSE '0.01' END AS unit_si, round(p_size * CASE WHEN p_size % 2 = 0 THEN 0.001::DOUBLE ELSE 0.01::DOUBLE END, 6) AS si FROM part WHERE p_size IS NOT NULL""")
def quantity_si(spark: SparkSession, d: str) -> DataFrame:
    """Groups with value, units and factor, found among all attributes and converted."""
    units = "case when p_size % 2 = 0 then 'mm' else 'cm' end"
    attrs = _long(table(spark, d, "part"), "p_partkey", value="p_size", units=units, unitSI="case when p_size % 2 = 0 then '0.001' else '0.01' end", description="p_name")
    return M.quantities(attrs, ["p_partkey"]).withColumn("si", F.round("si", 6))


@query("""SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE * 0.001, 9)) AS si FROM embeddings""")
def quantity_list_si(spark: SparkSession, d: str) -> DataFrame:
    values = M.list_quantity(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.001))
    return table(spark, d, "embeddings").select("vec_id", F.transform(values, lambda x: rounded(x, 9)).alias("si"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'mAs' ELSE 'mm' END AS units, p_size % 3 = 0 AS disagrees FROM part""")
def unit_audit(spark: SparkSession, d: str) -> DataFrame:
    """Stored factors against a table of units: every mAs was stored with the factor 1."""
    units = spark.createDataFrame([("mm", 0.001), ("mAs", 0.001), ("cm", 0.01)], "units string, factor double")
    own = table(spark, d, "part").select("p_partkey", F.expr("case when p_size % 3 = 0 then 'mAs' else 'mm' end").alias("units"), F.expr("case when p_size % 3 = 0 then 1.0D else 0.001D end").alias("unit_si"))
    return M.unit_audit(own, units).select("p_partkey", "units", "disagrees")


@query("""SELECT c_custkey, 'nation' AS name, n_name AS term, r_name AS vocabulary, n_nationkey::VARCHAR AS code
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def vocabulary_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Terms with vocabulary and code, regrouped from three attributes each."""
    c, n, r = (table(spark, d, x) for x in ("customer", "nation", "region"))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    attrs = _long(rows.select("c_custkey", "n_name", "r_name", "n_nationkey", "c_mktsegment"), "c_custkey", nation="n_name", nation_vocabulary="r_name", nation_code="n_nationkey", segment="c_mktsegment")
    return M.vocabulary(attrs, ["c_custkey"])


@query("""SELECT doc_id AS product_id, k AS key FROM documents, (SELECT unnest(['lang', 'source', 'quality']) AS k)
WHERE NOT ((k = 'lang' AND lang IS NOT NULL) OR (k = 'source' AND source IS NOT NULL)
  OR (k = 'quality' AND doc_id IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL)))""")
def required_missing(spark: SparkSession, d: str) -> DataFrame:
    """Required keys that documents lack; the quality comes from another table."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("product_id"), "lang", "source")
    present = _long(docs, "product_id", lang="lang", source="source").select("product_id", "key")
    labels = table(spark, d, "labels").where("quality is not null").select(F.col("doc_id").alias("product_id"), F.lit("quality").alias("key")).distinct()
    return M.missing_required(present.union(labels), docs, ("lang", "source", "quality"))


@query("""WITH p AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'recon' WHEN 1 THEN 'listmode' ELSE 'roi' END AS product, o_orderkey % 5 AS dims, o_custkey % 4 AS m FROM orders),
r(product, problem, m) AS (VALUES ('recon', 'missing volume', 0), ('recon', 'missing metadata', 1), ('recon', 'missing provenance', -1), ('listmode', 'missing metadata', 1), ('listmode', 'missing provenance', -1),
  ('listmode', 'missing one of raw_data, proc_data', 2), ('roi', 'missing regions', -1), ('roi', 'missing metadata/method', -1), ('roi', 'missing one of mask, geometry, contours', 3))
SELECT o_orderkey AS product_id, problem FROM p JOIN r ON p.product = r.product AND p.m <> r.m UNION ALL
SELECT o_orderkey, 'missing frames' FROM p WHERE dims >= 4""")
def members_missing(spark: SparkSession, d: str) -> DataFrame:
    """Member rules of three product types, one member for each product, and frames for four dimensions."""
    kind = F.expr("case o_orderkey % 3 when 0 then 'recon' when 1 then 'listmode' else 'roi' end")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("product_id"), kind.alias("product"), (F.col("o_orderkey") % 5).alias("n_dims"), "o_custkey")
    path = F.expr("case o_custkey % 4 when 0 then 'volume' when 1 then 'metadata' when 2 then 'proc_data' else 'contours' end")
    return M.missing_members(o.select("product_id", path.alias("path")), o.drop("o_custkey"))


@query("""SELECT o_orderkey AS product_id FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderstatus = 'P'""")
def timestamp_missing(spark: SparkSession, d: str) -> DataFrame:
    """Every third order is a simulation, which needs no time; pending ones have none."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("product_id"), F.expr("case when o_orderkey % 3 = 0 then 'sim' else 'recon' end").alias("product"), F.expr("case when o_orderstatus = 'P' then null else cast(o_orderdate as string) end").alias("ts_raw"))
    return M.missing_timestamp(o)


@query("""SELECT p_partkey AS product_id, p_brand AS name, p_name AS doi FROM part WHERE p_size % 2 = 0""")
def literature_references(spark: SparkSession, d: str) -> DataFrame:
    group = F.when(F.col("p_size") % 2 == 0, "references/").otherwise("metadata/")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.concat(group, "p_brand").alias("path"), F.explode(F.array(F.struct(F.lit("doi").alias("key"), F.col("p_name").alias("value")), F.struct(F.lit("title").alias("key"), F.col("p_type").alias("value")))).alias("a"))
    return M.references(rows.select("product_id", "path", "a.key", "a.value"))


@query("""SELECT p_partkey, levenshtein(p_name, p_type)::INTEGER AS edits,
  len(list_intersect(n, t)) >= 0.5 * len(t) AS restates
FROM (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda w: w <> '')) AS n,
  list_distinct(list_filter(regexp_split_to_array(lower(p_type), '[^a-z0-9]+'), lambda w: w <> '')) AS t FROM part)""")
def description_quality(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", F.levenshtein("p_name", "p_type").alias("edits"), M.restates_name(F.col("p_name"), F.col("p_type")).alias("restates"))


@query("""SELECT p_partkey, (p_partkey % 3 <= 1) AND trim(coalesce(CASE WHEN p_size % 5 <> 0 THEN p_type END, '')) = '' AS needs FROM part""")
def description_missing(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("p_size") % 5 != 0, F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", M.needs_description(F.col("p_partkey") % 3, text).alias("needs"))


@query("""SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier""")
def additive_union(spark: SparkSession, d: str) -> DataFrame:
    """Two schema versions: the older one lacks a column."""
    new = table(spark, d, "customer").selectExpr("c_custkey as key", "c_name as name", "c_acctbal as balance", "c_mktsegment as segment")
    old = table(spark, d, "supplier").selectExpr("s_suppkey as key", "s_name as name", "s_acctbal as balance")
    return M.additive(new, old)


@query("""SELECT s_suppkey, s_name, 'unknown' AS segment, 2::INTEGER AS schema_version, NULL::VARCHAR AS content_hash FROM supplier""")
def migrated(spark: SparkSession, d: str) -> DataFrame:
    return M.migrate(table(spark, d, "supplier").select("s_suppkey", "s_name"), {"segment": "unknown"}, 2)


@query("""SELECT event_id, json_extract_string(props, '$.k') IS NULL AS k_absent, json_extract_string(props, '$.none') IS NULL AS none_absent FROM events""")
def missing_keys(spark: SparkSession, d: str) -> DataFrame:
    """An absent key reads as null, like one whose value is null."""
    v = F.try_parse_json("props")
    return table(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "string").isNull().alias("k_absent"), F.try_variant_get(v, "$.none", "string").isNull().alias("none_absent"))


@query("""SELECT p_partkey AS product_id, 'part' || p_partkey::VARCHAR AS start, CASE WHEN p_size % 3 = 0 THEN 'part' || p_partkey::VARCHAR WHEN p_size % 3 = 1 THEN 'volume' ELSE 'volume/data' END AS path FROM part""")
def default_path(spark: SparkSession, d: str) -> DataFrame:
    """Chains of default paths of no, one and two steps."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.concat(F.lit("part"), "p_partkey").alias("root"), (F.col("p_size") % 3).alias("k"))
    root = p.select("product_id", F.col("root").alias("path"), F.when(F.col("k") > 0, F.lit("volume")).alias("default_path"))
    middle = p.select("product_id", F.lit("volume").alias("path"), F.when(F.col("k") == 2, F.lit("volume/data")).alias("default_path"))
    return M.follow_default(root.union(middle), p.select("product_id", F.col("root").alias("path")))


@query("""SELECT c_nationkey, count(DISTINCT c_mktsegment) AS n_contexts FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1""")
def context_conflict(spark: SparkSession, d: str) -> DataFrame:
    return M.context_conflicts(table(spark, d, "customer").where("c_mktsegment is not null"), ["c_nationkey"], ["c_mktsegment"])


@query("""SELECT coalesce(c.c_custkey, m.k) AS c_custkey, coalesce(c.c_name, m.n) AS name, c.c_custkey IS NULL AS only_manifest
FROM customer c FULL JOIN (SELECT o_custkey AS k, min('from order ' || o_orderkey::VARCHAR) AS n FROM orders GROUP BY 1) m ON c.c_custkey = m.k""")
def truth_source(spark: SparkSession, d: str) -> DataFrame:
    """Where product and manifest disagree, the product holds."""
    m = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min(F.concat(F.lit("from order "), "o_orderkey")).alias("n"))
    both = table(spark, d, "customer").join(m, F.col("c_custkey") == F.col("k"), "full")
    return both.select(F.coalesce("c_custkey", "k").alias("c_custkey"), F.coalesce("c_name", "n").alias("name"), F.col("c_custkey").isNull().alias("only_manifest"))


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '://[^/]*/([^?#]*)', 1) AS path FROM pages)
SELECT page_id, path, regexp_matches(path, '^[a-z][a-z]/[0-9]+') AS is_reference FROM p WHERE NOT (starts_with(path, 'extra/') OR path = 'extra')""")
def reference_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths under validation (all but extra/), and whether they look like references."""
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "://[^/]*/([^?#]*)", 1).alias("path"))
    return M.validated(p).withColumn("is_reference", F.col("path").rlike("^[a-z][a-z]/[0-9]+"))


@query("""SELECT 'document' AS kind, doc_id AS id, strlen(text) AS n_bytes, CASE WHEN strlen(text) < 1000000 THEN 'embed' WHEN strlen(text) <= 10000000 THEN 'embed_or_link' ELSE 'link' END AS size_class,
  length(text) <= 1000 AS is_attribute, CASE WHEN strlen(text) < 10000000 AND u.n <= 1 THEN 'embed' ELSE 'link' END AS rule
FROM documents JOIN (SELECT text AS t, count(*) AS n FROM documents GROUP BY 1) u ON u.t = text
UNION ALL SELECT 'page', page_id, strlen(html), CASE WHEN strlen(html) < 1000000 THEN 'embed' WHEN strlen(html) <= 10000000 THEN 'embed_or_link' ELSE 'link' END, length(html) <= 1000, 'embed' FROM pages""")
def attachment_size_class(spark: SparkSession, d: str) -> DataFrame:
    """Size classes, the attribute limit, and embedding by size and use count."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.length("text").alias("n"), F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("s"))
    uses = docs.groupBy("s").agg(F.count(F.lit(1)).alias("uses"))
    docs = docs.join(uses, "s").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "n_bytes", size_class(F.col("n_bytes")).alias("size_class"), M.is_attribute(F.col("n"), F.lit(1)).alias("is_attribute"), M.embed_or_link(F.col("n_bytes"), F.col("uses")).alias("rule"))
    size = F.octet_length("html").cast("bigint")
    pages = table(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), size.alias("n_bytes"), size_class(size).alias("size_class"), M.is_attribute(F.length("html"), F.lit(1)).alias("is_attribute"), F.lit("embed").alias("rule"))
    return docs.union(pages)


def _one_of(names: list[str], key: str) -> Column:
    """A name by the key's remainder; the last one is registered nowhere."""
    return F.element_at(F.array(*map(F.lit, names)), (F.col(key) % len(names) + 1).cast("int"))


def _sql_list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


_SPECTRA = [*SPECTRUM_METHODS, "other"]
_REGIONS = [*REGION_METHODS, "freehand"]
_DEVICES = [*DEVICE_TYPES, "scale"]
_CALIBRATIONS = [*CALIBRATION_TYPES, "unknown"]
_NEEDED = "CASE type " + " ".join(f"WHEN '{k}' THEN {_sql_list(v)}" for k, v in REGION_METHODS.items()) + " END"
_DATASETS = "CASE type " + " ".join(f"WHEN '{k}' THEN {_sql_list(v) if v else '[]::VARCHAR[]'}" for k, v in CALIBRATION_TYPES.items()) + " END"


@query(f"""SELECT type, type <> 'other' AS known, count(*) AS n FROM (SELECT {_sql_list(_SPECTRA)}[p_partkey % {len(_SPECTRA)} + 1] AS type FROM part) GROUP BY 1""")
def spectrum_methods(spark: SparkSession, d: str) -> DataFrame:
    """Spectra by method, and whether the method is registered."""
    rows = table(spark, d, "part").select(_one_of(_SPECTRA, "p_partkey").alias("type"))
    return M.registered(rows, {k: () for k in SPECTRUM_METHODS}).groupBy("type", "known").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH o AS (SELECT {_sql_list(_REGIONS)}[o_orderkey % {len(_REGIONS)} + 1] AS type, o_custkey % 4 AS have FROM orders)
SELECT type, type <> 'freehand' AS known, array_to_string(({_NEEDED})[have + 1:], ',') AS missing, count(*) AS n FROM o GROUP BY ALL""")
def region_methods(spark: SparkSession, d: str) -> DataFrame:
    """Regions by method with the attributes of the method that they lack; some have only the first few."""
    o = table(spark, d, "orders").select(_one_of(_REGIONS, "o_orderkey").alias("type"), (F.col("o_custkey") % 4).cast("int").alias("have"))
    names = None
    for kind, needed in REGION_METHODS.items():
        own = F.slice(F.array(*map(F.lit, needed)), F.lit(1), F.col("have"))
        names = F.when(F.col("type") == kind, own) if names is None else names.when(F.col("type") == kind, own)
    rows = M.registered(o.withColumn("names", F.coalesce(names, F.array().cast("array<string>"))), REGION_METHODS, names="names")
    return rows.groupBy("type", "known", F.array_join("missing", ",").alias("missing")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT type, type <> 'scale' AS known, count(*) AS n FROM (SELECT {_sql_list(_DEVICES)}[user_id % {len(_DEVICES)} + 1] AS type FROM events) GROUP BY 1""")
def device_types(spark: SparkSession, d: str) -> DataFrame:
    """Device streams by category, and whether the category is registered."""
    rows = table(spark, d, "events").select(_one_of(_DEVICES, "user_id").alias("type"))
    return M.registered(rows, {k: () for k in DEVICE_TYPES}).groupBy("type", "known").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH p AS (SELECT p_partkey, {_sql_list(_CALIBRATIONS)}[p_partkey % {len(_CALIBRATIONS)} + 1] AS type, p_size % 3 AS have FROM part)
SELECT p_partkey, type FROM p WHERE type = 'unknown' OR have < len({_DATASETS})""")
def calibration_types(spark: SparkSession, d: str) -> DataFrame:
    """Calibrations of an unknown type, or without one of their type's key datasets."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), _one_of(_CALIBRATIONS, "p_partkey").alias("calibration_type"), (F.col("p_size") % 3).cast("int").alias("have"))
    names = None
    for kind, needed in CALIBRATION_TYPES.items():
        own = F.slice(F.array(*map(F.lit, needed)).cast("array<string>"), F.lit(1), F.col("have"))
        names = F.when(F.col("calibration_type") == kind, own) if names is None else names.when(F.col("calibration_type") == kind, own)
    found = incomplete(p.withColumn("names", F.coalesce(names, F.array().cast("array<string>"))))
    return found.select(F.col("product_id").alias("p_partkey"), F.col("calibration_type").alias("type"))


_SCHEMA = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "enum": [1, 2, 3]}}}


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '{"j": 1}' WHEN event_id % 11 = 1 THEN '[1' WHEN event_id % 11 = 2 THEN '{"k": "x"}' ELSE props END AS props FROM events),
c AS (SELECT event_id, CASE WHEN props IS NULL OR NOT json_valid(props) THEN '/: not object' WHEN json_type(props, '$.k') IS NULL THEN '/k: missing'
  WHEN json_type(props, '$.k') NOT IN ('UBIGINT', 'BIGINT') THEN '/k: not integer' WHEN json_extract_string(props, '$.k')::BIGINT NOT IN (1, 2, 3) THEN '/k: not one of [1, 2, 3]' END AS problem FROM e)
SELECT event_id, problem FROM c WHERE problem IS NOT NULL""")
def schema_problems(spark: SparkSession, d: str) -> DataFrame:
    """Documents that break their schema; some are malformed, lack a key or have one of a wrong type."""
    k = F.col("event_id") % 11
    text = F.when(k == 0, '{"j": 1}').when(k == 1, "[1").when(k == 2, '{"k": "x"}').otherwise(F.col("props"))
    rows = table(spark, d, "events").select("event_id", text.alias("props"))
    return M.schema_problems(rows, "props", _SCHEMA).select("event_id", F.explode("problems").alias("problem"))


_TYPES = product_types()  # those that are registered from the start


@query("""SELECT * FROM (VALUES ('recon', 'timestamp + scanner_uuid + vendor_series_id', true), ('listmode', 'timestamp + scanner_uuid + vendor_series_id', true),
  ('sinogram', 'timestamp + scanner_uuid + vendor_series_id', true), ('sim', 'simulation_config_hash + random_seed', false), ('transform', 'source_id + target_id + method_type + creation_timestamp', true),
  ('calibration', 'scanner_uuid + calibration_type + valid_from', true), ('spectrum', 'source_id + method_type + creation_timestamp', true),
  ('roi', 'reference_image_id + method_type + creation_timestamp', true), ('device_data', 'device_model + recording_start', true)) AS t(product, id_inputs, measured)""")
def registered_products(spark: SparkSession, d: str) -> DataFrame:
    """The product types that can be discovered, with what identifies them."""
    rows = [(name, " + ".join(kind.identity), kind.measured) for name, kind in _TYPES.items()]
    return spark.createDataFrame(rows, "product string, id_inputs string, measured boolean")


@query("""SELECT p_partkey, round(p_retailprice * 0.001, 6) AS si FROM part""")
def scalar_si(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.round(to_si(F.col("p_retailprice"), F.lit(0.001)), 6).alias("si"))


@query("""SELECT event_id, '/' AS path, k AS key, json_extract_string(props, '$.' || k) AS value, CASE WHEN json_type(props, '$.' || k) IN ('UBIGINT', 'BIGINT') THEN 'BIGINT' ELSE 'STRING' END AS value_type
FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)""")
def metadata_rows(spark: SparkSession, d: str) -> DataFrame:
    """Open metadata as typed attribute rows."""
    return M.attribute_rows(table(spark, d, "events"), ["event_id"], "props")


@query("""SELECT p_partkey, 'Bq/mL' AS units, 1000.0::DOUBLE AS unit_si FROM part WHERE p_size >= 10""")
def dataset_units(spark: SparkSession, d: str) -> DataFrame:
    """Units on datasets; small ones have none."""
    attrs = _long(table(spark, d, "part"), "p_partkey", units="case when p_size >= 10 then 'Bq/mL' end", unitSI="'1000.0'", description="p_name")
    return M.dataset_units(attrs, ["p_partkey"])


@query("""SELECT page_id AS id, url AS licence, regexp_full_match(url, 'https?://\\S+|[A-Za-z0-9.+]+(-[A-Za-z0-9.+]+)*') AS ready FROM pages
UNION ALL SELECT p_partkey, p_brand, regexp_full_match(p_brand, 'https?://\\S+|[A-Za-z0-9.+]+(-[A-Za-z0-9.+]+)*') FROM part""")
def licence_ready(spark: SparkSession, d: str) -> DataFrame:
    """Whether licence fields are identifiers or URLs."""
    a = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("licence"))
    b = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("licence"))
    return a.union(b).withColumn("ready", M.is_licence(F.col("licence")))
