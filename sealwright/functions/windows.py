"""Values of neighbouring rows in an order, also for keys with very many rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest(df: DataFrame, keys: list[str], order: list[str], marks: dict[str, Column], bucket: Column | None = None, ahead: bool = False, own: bool = False) -> DataFrame:
    """``df`` with, for each mark, the nearest one that is not null before the row (``ahead``: after it; ``own``: the row's
    own counts too), in the given order within the keys.

    ``bucket``, a coarse expression of the first order column that never falls (such as its day), splits hot keys: windows
    then run within (keys, bucket), and what a bucket inherits comes from one row for each other bucket.
    """
    first, last = (0, Window.unboundedFollowing) if ahead else (Window.unboundedPreceding, 0)
    if not own:
        first, last = (1, last) if ahead else (first, -1)
    take = F.first if ahead else F.last
    names = {name: f"__mark_{name}" for name in marks}
    out = df.withColumns({names[n]: c for n, c in marks.items()})
    part = list(keys)
    if bucket is not None:
        out, part = out.withColumn("__b", bucket), [*keys, "__b"]
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(first, last)
    found = out.withColumns({n: take(names[n], ignorenulls=True).over(w) for n in marks})
    if bucket is not None:
        pick = F.min_by if ahead else F.max_by
        ends = out.groupBy(*part).agg(*[pick(m, F.when(F.col(m).isNotNull(), F.struct(*order))).alias(m) for m in names.values()])
        near = (1, Window.unboundedFollowing) if ahead else (Window.unboundedPreceding, -1)
        others = Window.partitionBy(*keys).orderBy("__b").rowsBetween(*near)
        ends = ends.select(*[F.col(c).alias(f"__on_{c}") for c in part], *[take(m, ignorenulls=True).over(others).alias(f"__far_{n}") for n, m in names.items()])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__on_{c}")) for c in part])
        found = found.join(ends, same, "left").withColumns({n: F.coalesce(n, f"__far_{n}") for n in marks})
    return found.select(*df.columns, *marks)
