"""N-dimensional arrays in long form (z, y, x[, t], v): selections, projections, pyramids, transforms."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import affine, distance
from ..functions.windows import nearest


def long_form(df: DataFrame, keys: list[str], array: str, position: str = "i", value: str = "v") -> DataFrame:
    return df.select(*keys, F.posexplode(array).alias(position, value)).withColumn(value, F.col(value).cast("double"))


def slices(df: DataFrame, **at: int) -> DataFrame:
    """Cells at given indexes of leading axes; the conditions reach the scan."""
    for axis, i in at.items():
        df = df.where(F.col(axis) == i)
    return df


def project(df: DataFrame, keep: list[str], how: str = "max", value: str = "v") -> DataFrame:
    """Collapse all axes but ``keep``: max (intensity projection), sum (over frames) or mean."""
    f = {"max": F.max, "sum": F.sum, "mean": F.avg}[how]
    return df.groupBy(*keep).agg(f(value).alias(value))


def coronal_mip(df: DataFrame, *extra: str) -> DataFrame:
    return project(df, [*extra, "z", "x"])


def sagittal_mip(df: DataFrame, *extra: str) -> DataFrame:
    return project(df, [*extra, "z", "y"])


def level_shape(shape: list[int], factor: int) -> list[int]:
    """Sizes of a pyramid level: rounded up, edge blocks hold fewer voxels."""
    return [math.ceil(n / factor) for n in shape]


def pyramid(df: DataFrame, axes: list[str], factor: int, method: str = "local_mean", keys: list[str] = (), value: str = "v") -> DataFrame:
    """One coarser level: ``local_mean``, ``stride``, ``area`` or ``gaussian`` (each axis by weights 1 2 1, then stride).

    With whole factors the exact overlap mean (``area``) is the block mean. ``gaussian`` spreads each voxel to the
    coarse places it weighs on, so edges use the voxels that exist.
    """
    if method == "stride":
        for a in axes:
            df = df.where(F.col(a) % factor == 0).withColumn(a, F.floor(F.col(a) / factor))
        return df.select(*keys, *axes, value)
    if method == "gaussian":
        df = df.withColumn("__w", F.lit(1.0))
        for a in axes:
            df = df.withColumn("__d", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).where((F.col(a) + F.col("__d")) % factor == 0)
            df = df.withColumn("__w", F.col("__w") * F.when(F.col("__d") == 0, 2.0).otherwise(1.0)).withColumn(a, F.floor((F.col(a) + F.col("__d")) / factor)).where(F.col(a) >= 0)
        return df.groupBy(*keys, *axes).agg((F.sum(F.col(value) * F.col("__w")) / F.sum("__w")).alias(value))
    blocks = [F.floor(F.col(a) / factor).alias(a) for a in axes]
    return df.groupBy(*keys, *blocks).agg(F.avg(value).alias(value))


def level_affine(matrix: list[list[float]], factor: int) -> list[list[float]]:
    """The affine of a coarser level: wider voxels, the first centred on its block."""
    half = (factor - 1) / 2
    rows = [[*(r[k] * factor for k in range(3)), r[3] + half * (r[0] + r[1] + r[2])] for r in matrix[:3]]
    return [*rows, [0.0, 0.0, 0.0, 1.0]]


def to_physical(matrix: list[list[float]], z: str = "z", y: str = "y", x: str = "x") -> list[Column]:
    return affine(matrix, [F.col(z), F.col(y), F.col(x)])


def inverse(matrix: list[list[float]]) -> list[list[float]]:
    """The inverse of a 4x4 transform, on the driver."""
    import numpy as np

    return np.linalg.inv(np.array(matrix, float)).tolist()


def apply_transform(matrix: list[list[float]], direction: str, point: list[Column]) -> list[Column]:
    """Points from source to target; a matrix stored the other way round is inverted first."""
    return affine(matrix if direction == "source_to_target" else inverse(matrix), point)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def inverse_of(flat: pd.Series) -> pd.Series:
    """Inverses of a column of 4x4 matrices, each as 16 numbers by rows."""
    import numpy as np

    return pd.Series([np.linalg.inv(np.array(m, float).reshape(4, 4)).ravel().tolist() for m in flat])


def displace(points: DataFrame, field: DataFrame, axes: list[str]) -> DataFrame:
    """Points moved by the vector of their voxel: p + field(p); field has columns d<axis>."""
    both = points.join(field, axes)
    return both.select(*[c for c in points.columns if c not in axes], *axes, *[(F.col(a) + F.col(f"d{a}")).alias(f"{a}_to") for a in axes])


def frame_table(df: DataFrame, keys: list[str], start: str = "frame_start", duration: str = "frame_duration", label: str = "frame_label") -> DataFrame:
    """One row for each frame from parallel arrays."""
    return df.select(*keys, F.posexplode(F.arrays_zip(start, duration, label)).alias("frame", "f")).select(*keys, "frame", "f.*")


def frame_at(frames: DataFrame, times: DataFrame, key: list[str], start: str = "start", duration: str = "duration", at: str = "at", bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """The frame in force at each time: a union in time order and the last start before, no range join.

    Of frames with equal starts the longest counts. A time outside its frame gets null. ``bucket``, a coarse function of
    a time that never falls, splits hot keys.
    """
    one = frames.groupBy(*key, start).agg(F.max(duration).alias("__d")).select(*key, F.col(start).alias("__t"), "__d", F.lit(0).alias("__k"))
    two = times.select(*key, F.col(at).alias("__t"), F.lit(None).cast("double").alias("__d"), F.lit(1).alias("__k"), *[c for c in times.columns if c not in (*key, at)])
    all_ = one.unionByName(two, allowMissingColumns=True)
    frame = F.when(F.col("__k") == 0, F.struct(F.col("__t").alias("s"), F.col("__d").alias("d")))
    out = nearest(all_, key, ["__t", "__k"], {"__f": frame}, None if bucket is None else bucket(F.col("__t")), own=True).where("__k = 1").withColumnRenamed("__t", at)
    return out.withColumn("frame_start", F.when(F.col(at) < F.col("__f.s") + F.col("__f.d"), F.col("__f.s"))).drop("__d", "__k", "__f")


def time_weighted_mean(df: DataFrame, keys: list[str], value: str, duration: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(F.col(value) * F.col(duration)) / F.sum(duration)).alias("mean"))


def corrected(sinogram: DataFrame, factors: DataFrame, axes: list[str]) -> DataFrame:
    """multiplicative * value + additive for every cell; a cell without factors stays as it is."""
    both = sinogram.join(factors, axes, "left")
    return both.withColumn("v", F.coalesce("multiplicative", F.lit(1.0)) * F.col("v") + F.coalesce("additive", F.lit(0.0))).drop("multiplicative", "additive")


def corrections_applied(df: DataFrame, *flags: str) -> DataFrame:
    """Sinograms to which all the named corrections have been applied."""
    for f in flags:
        df = df.where(F.col(f))
    return df


def parametric_maps(products: DataFrame, models: list[str]) -> DataFrame:
    """Reconstructions whose reconstruction is a kinetic model."""
    return products.where((F.col("product") == "recon") & F.col("reconstruction_type").isin(models))


def jacobian_range(field: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Least and largest determinant of p -> p + field(p) on a grid (z, y, x, dz, dy, dx), by forward differences.

    A negative one means folding. The neighbour of a voxel on each axis comes by an equality join.
    """
    axes = ["z", "y", "x"]
    out = field
    for a in axes:
        nb = field.select(*keys, *[(F.col(c) - 1).alias(c) if c == a else F.col(c) for c in axes], *[F.col(f"d{c}").alias(f"d{c}_{a}") for c in axes])
        out = out.join(nb, [*keys, *axes])
    j = [[F.col(f"d{c}_{a}") - F.col(f"d{c}") + (1.0 if a == c else 0.0) for a in axes] for c in axes]
    det = j[0][0] * (j[1][1] * j[2][2] - j[1][2] * j[2][1]) - j[0][1] * (j[1][0] * j[2][2] - j[1][2] * j[2][0]) + j[0][2] * (j[1][0] * j[2][1] - j[1][1] * j[2][0])
    agg = [F.min("det").alias("jacobian_min"), F.max("det").alias("jacobian_max")]
    rows = out.withColumn("det", det)
    return rows.groupBy(*keys).agg(*agg) if keys else rows.agg(*agg)


def registration_error(pairs: DataFrame, moved: list[Column], target: list[Column]) -> DataFrame:
    """Mean and largest distance of moved landmarks from their targets."""
    return pairs.select(distance(moved, target).alias("d")).agg(F.avg("d").alias("tre_mean"), F.max("d").alias("tre_max"))


def compare(a: DataFrame, truth: DataFrame, axes: list[str], keys: list[str]) -> DataFrame:
    """Root mean square error and bias of reconstructed against true values."""
    both = a.join(truth.withColumnRenamed("v", "truth"), axes)
    d = F.col("v") - F.col("truth")
    return both.groupBy(*keys).agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d).alias("bias"))
