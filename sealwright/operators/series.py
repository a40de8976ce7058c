"""Time series channels and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import nearest


def samples(df: DataFrame, keys: list[str], signal: str = "signal", time: str = "time") -> DataFrame:
    """One row for each sample of parallel arrays."""
    rows = df.select(*keys, F.posexplode(F.arrays_zip(F.col(signal).alias("s"), F.col(time).alias("t"))).alias("i", "p"))
    return rows.select(*keys, "i", F.col("p.t").alias("t"), F.col("p.s").alias("signal"))


def summary(df: DataFrame, keys: list[str], value: str, time: str) -> DataFrame:
    """Average, extremes and duration of a channel."""
    return df.groupBy(*keys).agg(F.avg(value).alias("average"), F.min(value).alias("least"), F.max(value).alias("most"), (F.max(time) - F.min(time)).alias("duration"))


def cue_index(df: DataFrame, keys: list[str], time: str, index: str, step: int) -> DataFrame:
    """Coarse times and the first sample of each."""
    return df.groupBy(*keys, F.floor(F.col(time) / step).alias("cue")).agg(F.min(index).alias("first_index"))


def seek(cues: DataFrame, keys: list[str], step: int, at: Column) -> DataFrame:
    """The sample from which to scan for a time: that of the latest cue at or before it."""
    return cues.where(F.col("cue") * step <= at).groupBy(*keys).agg(F.max_by("first_index", "cue").alias("start_index"))


def gaps(df: DataFrame, keys: list[str], time: str, tie: list[str] = (), bucket: Column | None = None) -> DataFrame:
    """Samples with the time since the one before. ``bucket`` splits hot keys (see :func:`windows.nearest`), here and below."""
    out = nearest(df, keys, [time, *tie], {"__before": F.struct(F.col(time).alias("v"))}, bucket)
    return out.withColumn("gap", F.col(time) - F.col("__before.v")).drop("__before")


def rate_check(df: DataFrame, keys: list[str], time: str, tie: list[str] = (), bucket: Column | None = None) -> DataFrame:
    """The median gap between samples."""
    return gaps(df, keys, time, tie, bucket).where("gap is not null").groupBy(*keys).agg(F.median("gap").alias("median_gap"))


def triggers(df: DataFrame, keys: list[str], order: list[str], value: str, level: float, bucket: Column | None = None) -> DataFrame:
    """Samples at which a signal rises to a level."""
    out = nearest(df, keys, order, {"__before": F.struct(F.col(value).alias("v"))}, bucket)
    return out.where((F.col("__before.v") < level) & (F.col(value) >= level)).drop("__before")


def gate_phase(df: DataFrame, keys: list[str], order: list[str], time: str, is_trigger: Column, bucket: Column | None = None) -> DataFrame:
    """The phase of each sample, 0 to below 1, between the trigger at or before it and the next one after."""
    mark = F.when(is_trigger, F.col(time))
    out = nearest(df, keys, order, {"last_trigger": mark}, bucket, own=True)
    out = nearest(out, keys, order, {"next_trigger": mark}, bucket, ahead=True)
    span = F.col("next_trigger") - F.col("last_trigger")
    return out.withColumn("phase", F.when(span > 0, (F.col(time) - F.col("last_trigger")) / span))


def coincidences(df: DataFrame, keys: list[str], order: list[str], time: str, ident: str, window: int, bucket: Column | None = None) -> DataFrame:
    """Neighbouring events within a window."""
    out = nearest(df, keys, order, {"__before": F.struct(F.col(ident).alias("id"), F.col(time).alias("t"))}, bucket)
    both = out.select(*keys, F.col(ident).alias("second"), F.col("__before.id").alias("first"), (F.col(time) - F.col("__before.t")).alias("gap"))
    return both.where(F.col("gap") <= window)


def coincidence_pairs(df: DataFrame, keys: list[str], time: str, ident: str, window: int) -> DataFrame:
    """All pairs of events of a key within a window, by a join on time buckets of the window's width and its neighbour."""
    a = df.select(*keys, F.floor(F.col(time) / window).alias("b"), F.col(time).alias("t1"), F.col(ident).alias("first"))
    b = df.select(*keys, F.explode(F.array(F.floor(F.col(time) / window), F.floor(F.col(time) / window) - 1)).alias("b"), F.col(time).alias("t2"), F.col(ident).alias("second"))
    both = a.join(b, [*keys, "b"])
    later = (F.col("t2") > F.col("t1")) | ((F.col("t2") == F.col("t1")) & (F.col("second") > F.col("first")))
    return both.where(later & (F.col("t2") - F.col("t1") <= window)).select(*keys, "first", "second", (F.col("t2") - F.col("t1")).alias("gap"))


def synchronised(df: DataFrame, flag: str = "run_control") -> DataFrame:
    return df.where(F.col(flag))
