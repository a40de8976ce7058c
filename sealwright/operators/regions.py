"""Regions of interest: masks, shapes, contours and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import distance


def named(mask: DataFrame, regions: DataFrame, label: str = "label") -> DataFrame:
    """Voxels with the name of their region; labels that no region has are left out."""
    return mask.join(regions, label)


def statistics(voxels: DataFrame, keys: list[str], value: str = "v", voxel_volume: float = 1.0) -> DataFrame:
    """Count, volume, mean, maximum and sample standard deviation."""
    n = F.count(F.lit(1))
    return voxels.groupBy(*keys).agg(n.alias("n_voxels"), (n * F.lit(voxel_volume)).alias("volume"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.stddev_samp(value).alias("std"))


def over_images(mask: DataFrame, images: DataFrame, axes: list[str]) -> DataFrame:
    """One region set over several co-registered images; images has a column ``image``."""
    return statistics(mask.join(images, axes), ["image", "label"])


def relative_threshold(voxels: DataFrame, keys: list[str], fraction: float, value: str = "v", seed: Column | None = None) -> DataFrame:
    """Voxels of at least a fraction of their group's maximum, taken in the seed region if one is given; the maxima are
    an aggregate joined back. A group without a seed has no voxels."""
    top = voxels.groupBy(*keys).agg(F.max(F.col(value) if seed is None else F.when(seed, F.col(value))).alias("__top"))
    return voxels.join(top, keys).where(F.col(value) >= F.lit(fraction) * F.col("__top")).drop("__top")


def eroded(mask: DataFrame, axes: list[str], label: str = "label") -> DataFrame:
    """A mask without the voxels that lack a neighbour of their label on any side.

    Each voxel is sent to its neighbours and places that got all 2 per axis, and are in the mask, stay: one shuffle.
    """
    moves = [(a, d) for a in axes for d in (-1, 1)]
    sent = F.array(*[F.struct(*[(F.col(c) + (d if c == a else 0)).alias(c) for c in axes], F.lit(0).alias("own")) for a, d in moves], F.struct(*[(F.col(c) + 0).alias(c) for c in axes], F.lit(1).alias("own")))
    rows = mask.select(label, F.explode(sent).alias("p")).select(label, *[f"p.{a}" for a in axes], "p.own")
    got = rows.groupBy(label, *axes).agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("own"))
    return got.where((F.col("own") == 1) & (F.col("n") == len(moves) + 1)).select(label, *axes)


def inside(shape: str, point: list[Column], centre: list[float], radius: float = 0.0, size: list[float] = ()) -> Column:
    """Whether a point is in a sphere, cylinder (along the first axis), box or ellipsoid."""
    d = [p - F.lit(float(c)) for p, c in zip(point, centre)]
    if shape == "sphere":
        return distance(point, [F.lit(float(c)) for c in centre]) <= radius
    if shape == "cylinder":
        return (F.sqrt(d[1] * d[1] + d[2] * d[2]) <= radius) & (F.abs(d[0]) <= size[0] / 2)
    if shape == "box":
        return (F.abs(d[0]) <= size[0] / 2) & (F.abs(d[1]) <= size[1] / 2) & (F.abs(d[2]) <= size[2] / 2)
    if shape == "ellipsoid":
        parts = [x * x / F.lit(s * s / 4.0) for x, s in zip(d, size)]
        return parts[0] + parts[1] + parts[2] <= 1
    raise ValueError(f"unknown shape {shape}")


def polygon_area(us: Column, vs: Column) -> Column:
    """Shoelace area of a closed polygon from its vertices' coordinates."""
    n = F.size(us)
    nxt = lambda c: F.concat(F.slice(c, 2, F.greatest(n - 1, F.lit(0))), F.slice(c, 1, 1))
    cross = F.zip_with(F.zip_with(us, nxt(vs), lambda a, b: a * b), F.zip_with(nxt(us), vs, lambda a, b: a * b), lambda a, b: a - b)
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, c: s + c)) / 2


def has_representation(mask: Column, geometry: Column, contours: Column) -> Column:
    return mask | geometry | contours
