"""Generated texts: manifest, citation metadata, linked data, file names. All can be made again from the products."""

from __future__ import annotations

import json
import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hashing import short_id


def manifest(products: DataFrame, sources: DataFrame) -> DataFrame:
    """One row for each product with its sources' ids; rebuilt from the products at any time."""
    by = sources.groupBy("product_id").agg(F.sort_array(F.collect_set("source_id")).alias("sources"))
    return products.join(by, "product_id", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))


def _toml(value: object) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_toml, value)) + "]"
    return json.dumps(value, ensure_ascii=False) if isinstance(value, str) else str(value)


def _table(name: str, values: dict, array: bool = False) -> list[str]:
    """One TOML table; nested dicts become tables of their own, absent values are left out."""
    out = [f"[[{name}]]" if array else f"[{name}]"] + [f"{k} = {_toml(v)}" for k, v in values.items() if v is not None and not isinstance(v, dict)] + [""]
    for k, v in values.items():
        if isinstance(v, dict):
            out += _table(f"{name}.{k}", v)
    return out


def with_units(row: dict) -> dict:
    """Quantities (value, units) as plain values whose names end in their units."""
    out = {}
    for k, v in row.items():
        if isinstance(v, dict) and {"value", "units"} <= set(v):
            out[f"{k}_{v['units']}"] = v["value"]
        else:
            out[k] = v
    return out


def manifest_toml(rows: list[dict], dataset_name: str, context: dict[str, dict] | None = None) -> str:
    """The manifest as text: the common context, then one entry for each product in the order of their ids."""
    out = ["_schema_version = 1", f"dataset_name = {_toml(dataset_name)}", ""]
    for name, values in (context or {}).items():
        out += _table(name, values)
    for row in sorted(rows, key=lambda r: r["id"]):
        out += _table("data", with_units(row), array=True)
    return "\n".join(out)


def parse_manifest(spark: SparkSession, text: str) -> DataFrame:
    """Rows of a manifest text; keys that only some products have are null for the others."""
    rows = tomllib.loads(text).get("data", [])
    names = list(dict.fromkeys(k for r in rows for k in r))
    if not rows:
        return spark.createDataFrame([], "id string")
    return spark.createDataFrame([{n: r.get(n) for n in names} for r in rows])


def parse_context(text: str) -> dict:
    """What a manifest says about the collection as a whole."""
    return {k: v for k, v in tomllib.loads(text).items() if k != "data"}


def datacite(rows: list[dict], title: str, creators: list[dict], subjects: dict[str, str] | None = None) -> str:
    """Citation metadata of a collection as YAML text; subjects: name to scheme, else the scan types of its products."""
    quote = lambda s: json.dumps(s, ensure_ascii=False)
    out = [f"title: {quote(title)}", "creators:"]
    for c in creators:
        out += [f"  - name: {quote(c['name'])}", f"    affiliation: {quote(c.get('affiliation', ''))}"]
    dates = sorted({r["timestamp"][:10] for r in rows if r.get("timestamp")})
    if dates:
        out += ["dates:", f"  - date: {quote(dates[0] if len(dates) == 1 else dates[0] + '/' + dates[-1])}", '    dateType: "Collected"']
    out += ['resourceType: "Dataset"']
    if subjects is None:
        subjects = {r["scan_type"]: "scan_type" for r in sorted(rows, key=lambda r: r.get("scan_type") or "") if r.get("scan_type")}
    if subjects:
        out.append("subjects:")
        for name, scheme in subjects.items():
            out += [f"  - subject: {quote(name)}", f"    subjectScheme: {quote(scheme)}"]
    return "\n".join(out) + "\n"


def linked_data(products: DataFrame, sources: DataFrame) -> DataFrame:
    """One JSON-LD entity for each product (product_id, file, timestamp), with what it is based on."""
    rows = manifest(products, sources)
    ident = F.struct(F.lit("PropertyValue").alias("@type"), F.split_part("product_id", F.lit(":"), F.lit(1)).alias("propertyID"), F.split_part("product_id", F.lit(":"), F.lit(2)).alias("value"))
    based = F.transform("sources", lambda s: F.struct(s.alias("@id")))
    entity = F.struct(F.col("file").alias("@id"), F.lit("File").alias("@type"), F.lit("application/x-hdf5").alias("encodingFormat"), F.col("timestamp").alias("dateCreated"), ident.alias("identifier"), based.alias("isBasedOn"))
    return rows.select("product_id", F.to_json(entity).alias("entity"))


def crate(entities: list[str], name: str, licence: str, authors: list[dict], ingests: list[dict] | None = None) -> str:
    """A linked-data description of a collection as JSON text; ingests: (file, tool, tool_version, timestamp)."""
    files = [json.loads(e) for e in entities]
    people = [{"@type": "Person", "name": a["name"], "affiliation": a.get("affiliation"), "@id": a.get("orcid") or f"#{a['name']}"} for a in authors]
    actions = []
    for i in ingests or []:
        tool = {"@id": f"#{i['tool']}-{i['tool_version']}", "@type": "SoftwareApplication", "name": i["tool"], "version": i["tool_version"]}
        actions += [tool] * (tool not in actions) + [{"@id": f"#ingest-{i['file']}", "@type": "CreateAction", "instrument": {"@id": tool["@id"]}, "result": {"@id": i["file"]}, "endTime": i["timestamp"]}]
    root = {"@id": "./", "@type": "Dataset", "name": name, "license": licence, "author": people, "hasPart": [{"@id": f["@id"]} for f in files]}
    about = {"@id": "ro-crate-metadata.json", "@type": "CreativeWork", "about": {"@id": "./"}, "conformsTo": {"@id": "https://w3id.org/ro/crate/1.2"}}
    return json.dumps({"@context": "https://w3id.org/ro/crate/1.2/context", "@graph": [about, root, *files, *actions]}, indent=1, ensure_ascii=False)


def schema_dump(schema_json: str) -> str:
    return json.dumps(json.loads(schema_json), indent=2, ensure_ascii=False, sort_keys=True)


def file_name(ts: Column, product: Column, seal: Column, descriptors: Column) -> Column:
    """datetime_product-id8_descriptors.h5; products without a time have no datetime part."""
    when = F.date_format(ts, "yyyy-MM-dd_HH-mm-ss")
    return F.concat(F.concat_ws("_", when, F.concat_ws("-", product, short_id(seal)), descriptors), F.lit(".h5"))


#: Date and time (absent for products without a time), product, short id, descriptors.
FILE_NAME = r"^(?:(\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2})_)?([a-z][a-z_]*)-([0-9a-z]{8})(?:_(.*))?\.h5$"


def parse_name(name: Column) -> dict[str, Column]:
    """The parts of a file name; names help people, they decide nothing."""
    part = lambda i: F.nullif(F.regexp_extract(name, FILE_NAME, i), F.lit(""))
    return {"datetime": part(1), "product": part(2), "short_id": part(3), "descriptors": part(4)}


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A text file wherever Spark's file systems reach; replaces what is there, since it can be made again."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(conf).create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def edges(sources: DataFrame) -> DataFrame:
    """Provenance edges for export."""
    return sources.select(F.col("product_id").alias("entity"), F.lit("isBasedOn").alias("relation"), F.col("source_id").alias("based_on"), "role")
