"""Histograms, spectra and fits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import edge_bin


def histogram(df: DataFrame, axes: dict[str, tuple[Column, list[float]]], keys: list[str] = ()) -> DataFrame:
    """Counts over any number of axes with explicit edges; values outside an axis are left out, see :func:`outside`."""
    for name, (value, edges) in axes.items():
        df = df.withColumn(name, edge_bin(value, edges)).where((F.col(name) >= 0) & (F.col(name) < len(edges) - 1))
    return df.groupBy(*keys, *axes).agg(F.count(F.lit(1)).alias("n"))


def outside(df: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """How many values lie below the first edge and from the last on."""
    b = edge_bin(value, edges)
    return df.agg(F.count_if(b < 0).alias("below"), F.count_if(b >= len(edges) - 1).alias("above"))


def dense(spark, counts: DataFrame, axes: dict[str, int]) -> DataFrame:
    """Every cell of the grid, empty ones with 0: the axes are opened up from literal ranges, then joined."""
    grid = spark.range(1).select()
    for name, n in axes.items():
        grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name))
    return grid.join(counts, list(axes), "left").withColumn("n", F.coalesce("n", F.lit(0)))


def centres(edges: Column) -> Column:
    n = F.size(edges) - 1
    return F.zip_with(F.slice(edges, 1, n), F.slice(edges, 2, n), lambda a, b: (a + b) / 2)


def with_errors(counts: DataFrame, n: str = "n") -> DataFrame:
    """Poisson errors; an empty bin has none."""
    return counts.withColumn("err", F.sqrt(n))


def rebin(counts: DataFrame, axis: str, k: int, keys: list[str] = ()) -> DataFrame:
    """k neighbouring bins as one; errors add in quadrature."""
    return counts.groupBy(*keys, F.floor(F.col(axis) / k).alias(axis)).agg(F.sum("n").alias("n"), F.sqrt(F.sum(F.col("err") * F.col("err"))).alias("err"))


def marginal(counts: DataFrame, keep: list[str]) -> DataFrame:
    return counts.groupBy(*keep).agg(F.sum("n").alias("n"))


def normalised(counts: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Shares of all counts; totals are an aggregate joined back (a scalar subquery without keys), not a window."""
    if keys:
        return counts.join(counts.groupBy(*keys).agg(F.sum("n").alias("__t")), keys).withColumn("share", F.col("n") / F.col("__t")).drop("__t")
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())


def rates(counts: DataFrame, live_time: Column) -> DataFrame:
    return counts.withColumn("rate", F.col("n") / live_time)


def acquisition(counts: DataFrame, live: float, real: float) -> DataFrame:
    """Total counts and the dead-time fraction."""
    return counts.agg(F.sum("n").alias("total"), F.lit(1 - live / real).alias("dead_time_fraction"))


def component_sum(components: DataFrame, axis: str) -> DataFrame:
    """The fitted curve: the sum of its components in each bin."""
    return components.groupBy(axis).agg(F.sum("curve").alias("curve"))


def residuals(counts: DataFrame, curve: DataFrame, axis: str) -> DataFrame:
    return counts.join(curve, axis).withColumn("residual", F.col("n") - F.col("curve"))


def goodness(residuals: DataFrame, n_parameters: int) -> DataFrame:
    """Chi-squared over bins with an error, and the degrees of freedom."""
    ok = residuals.where("err > 0")
    return ok.agg(F.sum(F.col("residual") * F.col("residual") / (F.col("err") * F.col("err"))).alias("chi_squared"), (F.count(F.lit(1)) - n_parameters).alias("degrees_of_freedom"))


def parameter_table(fits: DataFrame, keys: list[str]) -> DataFrame:
    rows = fits.select(*keys, F.explode(F.arrays_zip("names", "values", "errors")).alias("p"))
    return rows.select(*keys, F.col("p.names").alias("name"), F.col("p.values").alias("value"), F.col("p.errors").alias("error"))


def line_shape(df: DataFrame, energy: Column, centre: float, narrow: float, wings: tuple[float, float], keys: list[str]) -> DataFrame:
    """S: the share of events near the line's centre; W: that in its wings."""
    off = F.abs(energy - centre)
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg((F.count_if(off <= narrow) / n).alias("s"), (F.count_if((off >= wings[0]) & (off < wings[1])) / n).alias("w"))


def _voigt(x, s, g):
    """The pseudo-Voigt profile: a weighted sum of a Gaussian and a Lorentzian of the same width."""
    import numpy as np

    fg, fl = 2.3548200450309493 * abs(s), 2 * abs(g)
    f = (fg**5 + 2.69269 * fg**4 * fl + 2.42843 * fg**3 * fl**2 + 4.47163 * fg**2 * fl**3 + 0.07842 * fg * fl**4 + fl**5) ** 0.2
    eta = 1.36603 * fl / f - 0.47719 * (fl / f) ** 2 + 0.11116 * (fl / f) ** 3
    return eta / (1 + (2 * x / f) ** 2) + (1 - eta) * np.exp(-4 * np.log(2) * (x / f) ** 2)


def _start_exponential(x, y, n):
    import numpy as np

    good = y > 0
    slope, level = np.polyfit(x[good], np.log(y[good]), 1, w=np.sqrt(y[good])) if good.sum() > 1 else (-1.0, 0.0)
    rate = max(-slope, 1e-6)
    return [v for k in range(n) for v in (np.exp(level) / n, rate * 2.0 ** (k - (n - 1) / 2))]


def _start_peak(x, y):
    import numpy as np

    total = max(y.sum(), 1e-12)
    m = (x * y).sum() / total
    return [y.max(), m, np.sqrt(max((y * (x - m) ** 2).sum() / total, 1e-12))]


def _models():
    import numpy as np

    many = lambda x, p: sum(p[i] * np.exp(-p[i + 1] * x) for i in range(0, len(p), 2))
    return {
        "exponential": (many, lambda x, y: _start_exponential(x, y, 1)),
        "multi_exponential": (many, lambda x, y: _start_exponential(x, y, 2)),
        "gaussian": (lambda x, p: p[0] * np.exp(-((x - p[1]) ** 2) / (2 * p[2] ** 2)), _start_peak),
        "voigt": (lambda x, p: p[0] * _voigt(x - p[1], p[2], p[3]), lambda x, y: [*_start_peak(x, y)[:2], *(_start_peak(x, y)[2] / k for k in (1.5, 3))]),
    }


def _fit(model, x, y, e):
    """Damped Gauss-Newton steps with a numerical Jacobian; ``model`` is a name or a pair (function, start)."""
    import numpy as np

    f, start = _models()[model] if isinstance(model, str) else model
    w = np.where(e > 0, 1 / np.where(e > 0, e, 1), 0)
    p = np.array(start(x, y), float)
    chi = lambda q: float((((y - f(x, q)) * w) ** 2).sum())
    cov, damp = np.full((len(p), len(p)), np.nan), 1e-3
    for _ in range(200):
        h = 1e-6 * np.maximum(np.abs(p), 1e-3)
        j = np.stack([(f(x, p + d) - f(x, p - d)) / (2 * k) for k, d in zip(h, np.diag(h))], 1) * w[:, None]
        a, r = j.T @ j, j.T @ ((y - f(x, p)) * w)
        cov = np.linalg.pinv(a)
        while True:
            step = np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), r, rcond=None)[0]
            if chi(p + step) <= chi(p) or damp > 1e12:
                break
            damp *= 10
        if damp > 1e12:
            break
        p, damp = p + step, max(damp / 10, 1e-12)
        if np.abs(step).max() <= 1e-12 * (1 + np.abs(p).max()):
            break
    return p, np.sqrt(np.maximum(np.diag(cov), 0)), chi(p)


def fit(binned: DataFrame, key: str, model) -> DataFrame:
    """Least-squares fits of (x, n, err), one for each key: parameter values, errors, chi-squared.

    ``model``: exponential, multi_exponential, gaussian, voigt, or a pair of functions (curve of x and parameters,
    start of x and counts).

    A fit needs a spectrum's bins together (as many as its axis has, not as many as there are events).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        p, e, chi = _fit(model, pdf["x"].to_numpy(float), pdf["n"].to_numpy(float), pdf["err"].to_numpy(float))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "values": [p.tolist()], "errors": [e.tolist()], "chi_squared": [chi]})

    kind = binned.schema[key].dataType.simpleString()
    return binned.select(key, "x", "n", "err").groupBy(key).applyInPandas(run, f"{key} {kind}, values array<double>, errors array<double>, chi_squared double")


def cumulative(counts: DataFrame, axis: str, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(axis).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("cumulative", F.sum("n").over(w))
