"""Metadata trees, quantities, vocabularies, validation and schema evolution."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import list_to_si, to_si
from ..model import REQUIRED, product_types

#: Lists of at most so many elements are attributes; longer ones are datasets.
ATTRIBUTE_LIMIT = 1000

def is_attribute(n_elements: Column, n_dims: Column) -> Column:
    """Lists of one dimension and few elements are attributes, all other arrays datasets."""
    return (n_dims <= 1) & (n_elements <= ATTRIBUTE_LIMIT)


def flatten(tree: dict, path: str = "") -> Iterable[tuple[str, str, object]]:
    """(path, key, value) of a nested dict: a dict becomes a group, None is left out, arrays stay values."""
    for k in sorted(tree):
        v = tree[k]
        if isinstance(v, dict):
            yield from flatten(v, f"{path}/{k}")
        elif v is not None:
            yield path or "/", k, v


def nest(rows: Iterable[tuple[str, str, object]]) -> dict:
    """The nested dict of (path, key, value) rows; where an attribute and a group share a name, the group wins."""
    out: dict = {}
    for path, key, value in sorted(rows, key=lambda r: (r[0], r[1])):
        at = out
        for part in [p for p in path.split("/") if p]:
            if not isinstance(at.get(part), dict):
                at[part] = {}
            at = at[part]
        if not isinstance(at.get(key), dict):
            at[key] = value
    return out


def type_of(value: object) -> str:
    """The storage type of a metadata value."""
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (list, tuple)):
        return f"list<{type_of(value[0]) if value else 'str'}>"
    return {int: "int", float: "float", str: "str", bytes: "bytes"}.get(type(value), "dataset")


def attribute_rows(df: DataFrame, keys: list[str], document: str, path: str = "/") -> DataFrame:
    """(keys, path, key, value, value_type) of JSON documents, level by level; nulls are absent, groups go deeper.

    The JVM-side form of :func:`flatten`: a level is one generator, and there are as many as documents are deep.
    """
    out, level = None, df.select(*keys, F.lit(path).alias("path"), F.try_parse_json(document).alias("v"))
    while True:
        entries = level.select(*keys, "path", F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("key", "v"))
        entries = entries.withColumn("value_type", F.schema_of_variant("v")).where("value_type <> 'VOID'")
        group = F.startswith("value_type", F.lit("OBJECT"))
        flat = entries.where(~group).select(*keys, "path", "key", F.coalesce(F.try_variant_get("v", "$", "string"), F.to_json("v")).alias("value"), "value_type")
        out = flat if out is None else out.union(flat)
        level = entries.where(group).select(*keys, F.concat(F.when(F.col("path") == "/", "").otherwise(F.col("path")), F.lit("/"), "key").alias("path"), "v")
        if level.isEmpty():
            return out


def dataset_units(attrs: DataFrame, keys: list[str], key: str = "key", value: str = "value") -> DataFrame:
    """Units and factor that stand on datasets themselves."""
    of = lambda name: F.max(F.when(F.col(key) == name, F.col(value)))
    return attrs.groupBy(*keys).agg(of("units").alias("units"), of("unitSI").cast("double").alias("unit_si")).where("units is not null")


#: A licence as an SPDX identifier or a URL.
LICENCE = r"^(https?://\S+|[A-Za-z0-9.+]+(-[A-Za-z0-9.+]+)*)$"


def is_licence(c: Column) -> Column:
    return F.coalesce(c.rlike(LICENCE), F.lit(False))


def groups_as_maps(attrs: DataFrame, keys: list[str], key: str = "key", value: str = "value") -> DataFrame:
    """Each group's attributes as one map, keys in order."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(key), F.col(value))))
    return attrs.groupBy(*keys).agg(F.map_from_entries(pairs).alias("attrs"))


def quantities(attrs: DataFrame, keys: list[str], key: str = "key", value: str = "value") -> DataFrame:
    """Groups that hold value, units and unitSI, one row each; a missing factor gives a null SI value."""
    of = lambda name: F.max(F.when(F.col(key) == name, F.col(value)))
    out = attrs.groupBy(*keys).agg(of("value").alias("value"), of("units").alias("units"), of("unitSI").alias("unit_si"))
    return out.where("value is not null and units is not null").withColumn("si", to_si(F.col("value").cast("double"), F.col("unit_si").cast("double")))


def list_quantity(values: Column, factor: Column) -> Column:
    return list_to_si(values, factor)


def unit_audit(quantities: DataFrame, units: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Quantities whose stored factor differs from the units table (units, factor)."""
    both = quantities.join(units, "units", "left")
    off = F.abs(F.col("unit_si") - F.col("factor")) > F.lit(tolerance) * F.abs(F.col("factor"))
    return both.withColumn("disagrees", F.coalesce(off, F.lit(False)))


def vocabulary(attrs: DataFrame, keys: list[str], key: str = "key", value: str = "value") -> DataFrame:
    """Terms with their vocabulary and code, from keys x, x_vocabulary and x_code."""
    stem = F.regexp_replace(F.col(key), "_(vocabulary|code)$", "")
    part = F.when(F.endswith(F.col(key), F.lit("_vocabulary")), "vocabulary").when(F.endswith(F.col(key), F.lit("_code")), "code").otherwise("term")
    rows = attrs.select(*keys, stem.alias("name"), part.alias("part"), F.col(value).alias("v"))
    out = rows.groupBy(*keys, "name").agg(*[F.max(F.when(F.col("part") == p, F.col("v"))).alias(p) for p in ("term", "vocabulary", "code")])
    return out.where("vocabulary is not null")


def dispatch(kind: Column, version: Column, known: dict[tuple[str, int], Column]) -> Column:
    """The value of the reader for a ``_type`` and ``_version``; null for an unknown one, which is no error."""
    out = None
    for (name, at), value in known.items():
        cond = (kind == name) & (version == at)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out


def follow_default(nodes: DataFrame, start: DataFrame, most: int = 16) -> DataFrame:
    """The dataset at the end of each chain of ``default`` paths; nodes: (product_id, path, kind, default_path)."""
    now = start.select("product_id", F.col("path").alias("start"), "path")
    step = nodes.select("product_id", "path", "default_path")
    for _ in range(most):
        now = now.join(step, ["product_id", "path"], "left").select("product_id", "start", F.coalesce("default_path", "path").alias("path"), F.col("default_path").isNotNull().alias("moved"))
        if now.where("moved").isEmpty():
            break
        now = now.drop("moved")
    return now.select("product_id", "start", "path")


def missing_required(present: DataFrame, products: DataFrame, required: tuple[str, ...] = REQUIRED, key: str = "key") -> DataFrame:
    """Required keys that a product lacks: the rule list is opened up in each row, present keys are an anti-join."""
    wanted = products.select("product_id", F.explode(F.array(*map(F.lit, required))).alias(key))
    return wanted.join(present.select("product_id", key), ["product_id", key], "left_anti")


def missing_timestamp(products: DataFrame, time: str = "ts_raw") -> DataFrame:
    """Measured products without a timestamp; simulated ones need none."""
    free = [k for k, t in product_types().items() if not t.measured]
    return products.where(F.col(time).isNull() & ~F.col("product").isin(free)).select("product_id")


def missing_members(nodes: DataFrame, products: DataFrame) -> DataFrame:
    """(product_id, problem) for products that lack members of their type; frames are needed from 4 dimensions on.

    nodes: (product_id, path), paths relative to the root; products: (product_id, product, n_dims).
    """
    paths = nodes.groupBy("product_id").agg(F.collect_set("path").alias("paths"))
    rows = products.join(paths, "product_id", "left").withColumn("paths", F.coalesce("paths", F.array().cast("array<string>")))
    problems = []
    for name, kind in product_types().items():
        own = F.col("product") == name
        problems += [F.when(own & ~F.array_contains("paths", p), F.lit(f"missing {p}")) for p in kind.members]
        if kind.one_of:
            problems.append(F.when(own & ~F.arrays_overlap("paths", F.array(*map(F.lit, kind.one_of))), F.lit("missing one of " + ", ".join(kind.one_of))))
    problems.append(F.when((F.col("n_dims") >= 4) & ~F.array_contains("paths", "frames"), F.lit("missing frames")))
    return rows.select("product_id", F.explode(F.array_compact(F.array(*problems))).alias("problem"))


def references(attrs: DataFrame, path: str = "path", key: str = "key", value: str = "value") -> DataFrame:
    """Literature references: the DOI of every group below ``references/``."""
    rows = attrs.where(F.startswith(F.col(path), F.lit("references/")) & (F.col(key) == "doi"))
    return rows.select("product_id", F.substring_index(path, "/", -1).alias("name"), F.col(value).alias("doi"))


def restates_name(name: Column, description: Column, least: float = 0.5) -> Column:
    """Whether a description just repeats the name: none, or most of its words are words of the name."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != ""))
    a, b = words(name), words(description)
    return F.coalesce(F.size(F.array_intersect(a, b)) >= F.lit(least) * F.size(b), F.lit(True))


def needs_description(depth: Column, description: Column) -> Column:
    return (depth <= 1) & (F.coalesce(F.trim(description), F.lit("")) == "")


def validated(nodes: DataFrame, path: str = "path") -> DataFrame:
    """Nodes under validation: everything but ``extra/``."""
    return nodes.where(~(F.startswith(F.col(path), F.lit("extra/")) | (F.col(path) == "extra")))


def additive(*versions: DataFrame) -> DataFrame:
    """Rows of several schema versions: missing columns are null."""
    out = versions[0]
    for v in versions[1:]:
        out = out.unionByName(v, allowMissingColumns=True)
    return out


def migrate(old: DataFrame, defaults: dict[str, object], version: int) -> DataFrame:
    """Rows under a newer schema: absent columns get their defaults, ids stay, the seal is to be made anew."""
    out = old
    for name, value in defaults.items():
        out = out.withColumn(name, F.lit(value)) if name not in old.columns else out.withColumn(name, F.coalesce(name, F.lit(value)))
    return out.withColumn("schema_version", F.lit(version)).withColumn("content_hash", F.lit(None).cast("string"))


def validate_json(document: dict, schema: dict, path: str = "") -> list[str]:
    """Problems of a document under the JSON-Schema words type, required, properties, items, enum and const."""
    kinds = {"object": dict, "array": list, "string": str, "number": (int, float), "integer": int, "boolean": bool, "null": type(None)}
    out = []
    kind = schema.get("type")
    if kind and (not isinstance(document, kinds[kind]) or (kind in ("number", "integer") and isinstance(document, bool))):
        return [f"{path or '/'}: not {kind}"]
    if "enum" in schema and document not in schema["enum"]:
        out.append(f"{path or '/'}: not one of {schema['enum']}")
    if "const" in schema and document != schema["const"]:
        out.append(f"{path or '/'}: not {schema['const']!r}")
    if isinstance(document, dict):
        out += [f"{path}/{k}: missing" for k in schema.get("required", ()) if k not in document]
        for k, s in schema.get("properties", {}).items():
            if k in document and k != "extra":
                out += validate_json(document[k], s, f"{path}/{k}")
    if isinstance(document, list) and "items" in schema:
        for i, x in enumerate(document):
            out += validate_json(x, schema["items"], f"{path}/{i}")
    return out


def schema_problems(df: DataFrame, document: str, schema: dict, out: str = "problems") -> DataFrame:
    """``df`` with the problems of each JSON document under the schema; a null or malformed one is not of any type."""

    @F.pandas_udf("array<string>")
    def check(texts: pd.Series) -> pd.Series:
        found = []
        for t in texts:
            try:
                value = None if t is None else json.loads(t)
            except ValueError:
                value = None
            found.append(validate_json(value, schema))
        return pd.Series(found, dtype=object)

    return df.withColumn(out, check(F.col(document)))


def registered(objects: DataFrame, registry: dict[str, Iterable[str]], kind: str = "type", names: str | None = None) -> DataFrame:
    """``objects`` with whether their type is registered and, given the names they have, which of the type's are missing."""
    known = F.create_map(*[x for k, needed in registry.items() for x in (F.lit(k), F.array(*map(F.lit, needed)).cast("array<string>"))])
    needed = F.try_element_at(known, F.col(kind))
    out = objects.withColumn("known", needed.isNotNull())
    return out if names is None else out.withColumn("missing", F.array_except(needed, names))


def licence_ready(licence: str | None) -> bool:
    """Whether a licence is an SPDX identifier or a URL."""
    return bool(licence) and bool(re.match(LICENCE, licence))


def creators_ready(creators: list[dict] | None) -> bool:
    """Whether there are creators, each with a name and an affiliation; an ORCID, if any, must be well formed."""
    orcid = re.compile(r"(https://orcid\.org/)?\d{4}-\d{4}-\d{4}-\d{3}[\dX]")
    return bool(creators) and all(c.get("name") and c.get("affiliation") and (not c.get("orcid") or orcid.fullmatch(c["orcid"])) for c in creators)


def embed_or_link(n_bytes: Column, n_uses: Column) -> Column:
    """Streams that are small and used once are embedded, large or shared ones linked."""
    return F.when((n_bytes < 10_000_000) & (n_uses <= 1), "embed").otherwise("link")


def context_conflicts(df: DataFrame, group: list[str], context: list[str]) -> DataFrame:
    """Groups whose members do not all carry the same context."""
    return df.groupBy(*group).agg(F.count_distinct(F.to_json(F.struct(*context))).alias("n_contexts")).where("n_contexts > 1")
