"""Queries over the catalogue of products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def time_range(products: DataFrame, time: str = "ts") -> DataFrame:
    return products.agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("n"))


def by_field(products: DataFrame, *fields: str) -> DataFrame:
    return products.groupBy(*fields).agg(F.count(F.lit(1)).alias("n"))


def chronological(products: DataFrame, time: str, tie: str) -> DataFrame:
    return products.orderBy(F.col(time).asc_nulls_first(), tie)


def flags(nodes: DataFrame, names: dict[str, str]) -> DataFrame:
    """For each product whether it has an artefact, by the name of its node."""
    return nodes.groupBy("product_id").agg(*[F.bool_or(F.col("name") == n).alias(out) for out, n in names.items()])


def attributes_only(attrs: DataFrame) -> DataFrame:
    """Everything a listing needs without opening a dataset."""
    return attrs.select("product_id", "path", "key", "value")
