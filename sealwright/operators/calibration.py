"""Calibrations: validity, energy scales, factors, curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import polynomial
from ..functions.windows import nearest
from ..model import CALIBRATION_TYPES

def incomplete(data: DataFrame) -> DataFrame:
    """(product_id, calibration_type, names) rows whose type is unknown or lacks one of its key datasets."""
    known = F.lit(False)
    for kind, needed in CALIBRATION_TYPES.items():
        have = F.size(F.array_except(F.array(*map(F.lit, needed)), "names")) == 0 if needed else F.lit(True)
        known = known | ((F.col("calibration_type") == kind) & have)
    return data.where(~known)


def as_of(rows: DataFrame, calibrations: DataFrame, key: list[str], at: str, since: str, value: str, out: str = "calibration", bucket: Column | None = None) -> DataFrame:
    """Rows with the value of the latest calibration of their key at or before their time.

    A union in time order and the last value before, partitioned by key: no range join. At equal times the calibration
    comes first; of calibrations with equal times the largest value counts.

    ``bucket``, a coarse expression of the time that never falls (such as its day), splits hot keys: windows then run
    within (key, bucket), and what a bucket inherits comes from one row for each earlier bucket.
    """
    cal = calibrations.groupBy(*key, F.col(since).alias(at)).agg(F.max(value).alias("__v")).withColumn("__k", F.lit(0))
    both = rows.withColumn("__k", F.lit(1)).unionByName(cal, allowMissingColumns=True)
    part = key
    if bucket is not None:
        both, part = both.withColumn("__b", bucket), [*key, "__b"]
    w = Window.partitionBy(*part).orderBy(at, "__k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn(out, F.last("__v", ignorenulls=True).over(w)).where("__k = 1").drop("__k", "__v")
    if bucket is None:
        return found
    ends = both.groupBy(*part).agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col(at))).alias("__end"))
    before = Window.partitionBy(*key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*part, F.last("__end", ignorenulls=True).over(before).alias("__carried"))
    return found.join(carried, part, "left").withColumn(out, F.coalesce(out, "__carried")).drop("__b", "__carried")


def validity(calibrations: DataFrame, key: list[str], since: str, until: str = "valid_until", tie: list[str] = (), bucket: Column | None = None) -> DataFrame:
    """The end of each calibration's force: the start of the next one of its key, null if it is the latest."""
    out = nearest(calibrations, key, [since, *tie], {"__next": F.struct(F.col(since).alias("v"))}, bucket, ahead=True)
    return out.withColumn(until, F.col("__next.v")).drop("__next")


def in_force(calibrations: DataFrame, at: Column, since: str = "valid_from", until: str = "valid_until") -> DataFrame:
    """Calibrations in force at a time; one without an end, or with the end ``indefinite``, stays in force."""
    end = F.col(until)
    return calibrations.where((F.col(since) <= at) & (end.isNull() | (end.cast("string") == "indefinite") | (at < end)))


def energy(channel: Column, coefficients: list[float]) -> Column:
    return polynomial(channel, coefficients)


def lookup(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Per-channel or per-crystal values by equality; Spark broadcasts the table if it is small enough."""
    return rows.join(table, keys, "left")


def gained(rows: DataFrame, factors: DataFrame, keys: list[str], value: str, factor: str = "factor") -> DataFrame:
    return lookup(rows, factors, keys).withColumn(value, F.col(value) * F.coalesce(factor, F.lit(1.0))).drop(factor)


def interpolated(x: Column, points: list[tuple[float, float]]) -> Column:
    """Linear interpolation in a curve of sorted points; flat beyond its ends."""
    out = F.lit(points[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:]))):
        out = F.when(x < x1, F.lit(y0) + (x - x0) * F.lit((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(x < points[0][0], F.lit(points[0][1])).otherwise(out)


def segments(curve: DataFrame, key: list[str], x: str, y: str, bucket: Column | None = None) -> DataFrame:
    """A curve's points with the next one, for interpolation by an as-of look-up."""
    out = nearest(curve, key, [x], {"__next": F.struct(F.col(x).alias("x"), F.col(y).alias("y"))}, bucket, ahead=True)
    return out.withColumn("x1", F.col("__next.x")).withColumn("y1", F.col("__next.y")).drop("__next")


def offset(rows: DataFrame, offsets: DataFrame, keys: list[str], time: str, by: str = "offset") -> DataFrame:
    return lookup(rows, offsets, keys).withColumn(time, F.col(time) - F.coalesce(by, F.lit(0.0))).drop(by)


def ambient(value: Column, units: Column, factor: Column) -> Column:
    """Ambient conditions in SI units; degrees Celsius need an offset besides the stored factor."""
    return value * factor + F.when(units == "degC", 273.15).otherwise(0.0)


def cross_calibrated(value: Column, factor: float, error: float) -> tuple[Column, Column]:
    """A value times the cross-calibration factor, and its error."""
    return value * F.lit(factor), F.abs(value) * F.lit(error)
