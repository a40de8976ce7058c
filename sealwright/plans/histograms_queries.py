"""Histograms, spectra and calibrations on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import uniform_bin
from ..functions.tables import table
from ..operators import calibration as K
from ..operators import histogram as G
from .registry import query

_EDGES = [0.0, 1.0, 5.0, 20.0, 50.0, 100.0, 200.0, 400.0]
_E = f"{_EDGES}"
_BIN = f"len(list_filter({_E}, lambda e: e <= value)) - 1"
_FINE = [float(x) for x in range(0, 210, 10)]
_FBIN = f"len(list_filter({_FINE}, lambda e: e <= value)) - 1"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value")


def _fine(spark: SparkSession, d: str, *keys: str) -> DataFrame:
    return G.histogram(_events(spark, d), {"bin": (F.col("value"), _FINE)}, list(keys))


@query("SELECT floor(value / 10)::BIGINT AS bin, event_type, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def histogram_uniform(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).where("value is not null").groupBy(uniform_bin(F.col("value"), 0.0, 10.0).alias("bin"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT ({_BIN})::INTEGER AS bin, count(*) AS n FROM events WHERE {_BIN} BETWEEN 0 AND 6 GROUP BY 1")
def histogram_nonuniform(spark: SparkSession, d: str) -> DataFrame:
    """Uneven half-open bins; values outside all edges are left out."""
    return G.histogram(_events(spark, d), {"bin": (F.col("value"), _EDGES)})


@query(f"SELECT count(*) FILTER (WHERE {_BIN} < 0) AS below, count(*) FILTER (WHERE {_BIN} >= 7) AS above FROM events WHERE value IS NOT NULL")
def histogram_outside(spark: SparkSession, d: str) -> DataFrame:
    return G.outside(_events(spark, d).where("value is not null"), F.col("value"), _EDGES)


@query("""SELECT (len(list_filter([1.0, 10.0, 25.0, 51.0], lambda e: e <= l_quantity)) - 1)::INTEGER AS q, (len(list_filter([0.0, 1000.0, 10000.0, 50000.0, 1000000.0], lambda e: e <= l_extendedprice)) - 1)::INTEGER AS p, count(*) AS n
FROM lineitem WHERE l_quantity >= 1 AND l_quantity < 51 AND l_extendedprice >= 0 AND l_extendedprice < 1000000 GROUP BY 1, 2""")
def histogram_2d(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice")
    return G.histogram(rows, {"q": (F.col("l_quantity"), [1.0, 10.0, 25.0, 51.0]), "p": (F.col("l_extendedprice"), [0.0, 1000.0, 10000.0, 50000.0, 1000000.0])})


@query(f"""WITH c AS (SELECT {_BIN} AS bin, (user_id % 3)::INTEGER AS k, count(*) AS n FROM events WHERE {_BIN} BETWEEN 0 AND 6 GROUP BY 1, 2)
SELECT b::INTEGER AS bin, k::INTEGER AS k, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 7)) AS b), (SELECT unnest(range(0, 3)) AS k) g LEFT JOIN c ON c.bin = b AND c.k = g.k""".replace("SELECT b::INTEGER AS bin, k::INTEGER AS k, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 7)) AS b), (SELECT unnest(range(0, 3)) AS k) g LEFT JOIN c ON c.bin = b AND c.k = g.k", "SELECT g.b::INTEGER AS bin, g.k::INTEGER AS k, coalesce(n, 0) AS n FROM (SELECT b, k FROM (SELECT unnest(range(0, 7)) AS b) CROSS JOIN (SELECT unnest(range(0, 3)) AS k)) g LEFT JOIN c ON c.bin = g.b AND c.k = g.k"))
def histogram_dense(spark: SparkSession, d: str) -> DataFrame:
    """A two-dimensional grid with its empty bins."""
    rows = _events(spark, d).withColumn("k", (F.col("user_id") % 3).cast("int"))
    counts = G.histogram(rows, {"bin": (F.col("value"), _EDGES)}, ["k"])
    return G.dense(spark, counts, {"bin": 7, "k": 3})


@query(f"SELECT ({_FBIN})::INTEGER AS bin, count(*) AS n, round(sqrt(count(*)), 6) AS err FROM events WHERE {_FBIN} BETWEEN 0 AND 19 GROUP BY 1")
def histogram_errors(spark: SparkSession, d: str) -> DataFrame:
    return G.with_errors(_fine(spark, d)).withColumn("err", F.round("err", 6))


@query(f"SELECT ({_FBIN}) // 4 AS bin, count(*) AS n, round(sqrt(count(*)), 6) AS err FROM events WHERE {_FBIN} BETWEEN 0 AND 19 GROUP BY 1")
def histogram_rebin(spark: SparkSession, d: str) -> DataFrame:
    """Four bins as one; errors in quadrature."""
    return G.rebin(G.with_errors(_fine(spark, d)), "bin", 4).withColumn("err", F.round("err", 6))


@query(f"SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events WHERE {_FBIN} BETWEEN 0 AND 19 GROUP BY 1")
def histogram_marginal(spark: SparkSession, d: str) -> DataFrame:
    """The energy axis summed out, then shares of all counts."""
    out = G.normalised(G.marginal(_fine(spark, d, "event_type"), ["event_type"]))
    return out.withColumn("share", F.round("share", 6))


@query("SELECT [0.5, 3.0, 12.5, 35.0, 75.0, 150.0, 300.0]::DOUBLE[] AS centres")
def histogram_centres(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1).select(G.centres(F.array(*map(F.lit, _EDGES))).alias("centres"))


@query(f"SELECT count(*)::BIGINT AS total, 0.1::DOUBLE AS dead_time_fraction FROM events WHERE {_FBIN} BETWEEN 0 AND 19")
def acquisition_statistics(spark: SparkSession, d: str) -> DataFrame:
    return G.acquisition(_fine(spark, d), 90.0, 100.0).withColumn("dead_time_fraction", F.round("dead_time_fraction", 6))


@query(f"SELECT ({_FBIN})::INTEGER AS bin, round(count(*) / 12.5, 6) AS rate FROM events WHERE {_FBIN} BETWEEN 0 AND 19 GROUP BY 1")
def count_rates(spark: SparkSession, d: str) -> DataFrame:
    return G.rates(_fine(spark, d), F.lit(12.5)).select("bin", F.round("rate", 6).alias("rate"))


_CURVE = "round(1000 * 0.5::DOUBLE ** bin + 200 * 0.8::DOUBLE ** bin, 6)"


def _components(spark: SparkSession, d: str) -> DataFrame:
    bins = spark.range(20).select(F.col("id").cast("int").alias("bin"))
    parts = F.explode(F.array(F.struct(F.lit(1000.0).alias("a"), F.lit(0.5).alias("r")), F.struct(F.lit(200.0).alias("a"), F.lit(0.8).alias("r"))))
    return bins.select("bin", parts.alias("c")).select("bin", (F.col("c.a") * F.pow("c.r", "bin")).alias("curve"))


@query(f"SELECT bin::INTEGER AS bin, {_CURVE} AS curve FROM (SELECT unnest(range(0, 20)) AS bin)")
def component_sum(spark: SparkSession, d: str) -> DataFrame:
    return G.component_sum(_components(spark, d), "bin").withColumn("curve", F.round("curve", 6))


_C = f"WITH c AS (SELECT ({_FBIN})::INTEGER AS bin, count(*) AS n FROM events WHERE {_FBIN} BETWEEN 0 AND 19 GROUP BY 1), r AS (SELECT bin, n, n - {_CURVE} AS residual FROM c)"


@query(f"{_C} SELECT bin, n, round(residual, 5) AS residual FROM r")
def fit_residuals(spark: SparkSession, d: str) -> DataFrame:
    curve = G.component_sum(_components(spark, d), "bin").withColumn("curve", F.round("curve", 6))
    return G.residuals(_fine(spark, d), curve, "bin").select("bin", "n", F.round("residual", 5).alias("residual"))


@query(f"{_C} SELECT round(sum(residual * residual / n), 3) AS chi_squared, count(*) - 4 AS degrees_of_freedom FROM r")
def fit_goodness(spark: SparkSession, d: str) -> DataFrame:
    curve = G.component_sum(_components(spark, d), "bin").withColumn("curve", F.round("curve", 6))
    r = G.residuals(G.with_errors(_fine(spark, d)), curve, "bin")
    return G.goodness(r, 4).withColumn("chi_squared", F.round("chi_squared", 3))


@query()
def fit_exponential(spark: SparkSession, d: str) -> DataFrame:
    """Least-squares fits of an exponential to the spectrum of each event type."""
    binned = G.with_errors(_fine(spark, d, "event_type")).withColumn("x", F.col("bin") * 10.0 + 5)
    return G.fit(binned, "event_type", "exponential")


@query("SELECT doc_id, unnest(['a', 'b']) AS name, unnest([length(text)::DOUBLE, 2.0::DOUBLE]) AS value, unnest([0.5::DOUBLE, 0.25::DOUBLE]) AS error FROM documents")
def parameter_table(spark: SparkSession, d: str) -> DataFrame:
    fits = table(spark, d, "documents").select("doc_id", F.array(F.lit("a"), F.lit("b")).alias("names"), F.array(F.length("text").cast("double"), F.lit(2.0)).alias("values"), F.array(F.lit(0.5), F.lit(0.25)).alias("errors"))
    return G.parameter_table(fits, ["doc_id"])


@query("SELECT event_type, round(count(*) FILTER (WHERE abs(value - 50) <= 5) / count(*), 6) AS s, round(count(*) FILTER (WHERE abs(value - 50) >= 20 AND abs(value - 50) < 40) / count(*), 6) AS w FROM events GROUP BY 1")
def line_shape_ratio(spark: SparkSession, d: str) -> DataFrame:
    out = G.line_shape(_events(spark, d), F.col("value"), 50.0, 5.0, (20.0, 40.0), ["event_type"])
    return out.select("event_type", F.round("s", 6).alias("s"), F.round("w", 6).alias("w"))


@query(f"SELECT event_type, ({_FBIN})::INTEGER AS bin, count(*) AS n FROM events WHERE event_type IN ('purchase', 'click') AND {_FBIN} BETWEEN 0 AND 19 GROUP BY 1, 2")
def event_spectrum(spark: SparkSession, d: str) -> DataFrame:
    """Spectra of two kinds of events."""
    return G.histogram(_events(spark, d).where(F.col("event_type").isin("purchase", "click")), {"bin": (F.col("value"), _FINE)}, ["event_type"])


@query(f"SELECT event_type, ({_FBIN})::INTEGER AS bin, count(*) AS n, (sum(count(*)) OVER (PARTITION BY event_type ORDER BY {_FBIN}))::BIGINT AS cumulative FROM events WHERE {_FBIN} BETWEEN 0 AND 19 GROUP BY event_type, {_FBIN}")
def spectrum_cumulative(spark: SparkSession, d: str) -> DataFrame:
    return G.cumulative(_fine(spark, d, "event_type"), "bin", ["event_type"])


_CAL = "c AS (SELECT user_id, ts, max(value) AS v FROM events WHERE event_type = 'signup' GROUP BY 1, 2)"


@query(f"WITH {_CAL} SELECT e.event_id, e.user_id, c.v AS calibration FROM events e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.ts >= c.ts")
def calibration_asof(spark: SparkSession, d: str) -> DataFrame:
    """The calibration (a signup's value) in force at every event."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    cal = e.where("event_type = 'signup'").select("user_id", "ts", "value")
    return K.as_of(e.select("event_id", "user_id", "ts"), cal, ["user_id"], "ts", "ts", "value", bucket=F.to_date("ts")).select("event_id", "user_id", "calibration")


@query("SELECT event_id, user_id, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_until FROM events WHERE event_type = 'signup'")
def calibration_validity(spark: SparkSession, d: str) -> DataFrame:
    """When each calibration is superseded; the latest stays in force."""
    cal = table(spark, d, "events").where("event_type = 'signup'").select("event_id", "user_id", F.col("ts").alias("valid_from"))
    return K.validity(cal, ["user_id"], "valid_from", tie=["event_id"])


@query("""WITH v AS (SELECT event_id, user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_until FROM events WHERE event_type = 'signup')
SELECT event_id, user_id FROM v WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' AND (valid_until IS NULL OR TIMESTAMP '2024-01-15 00:00:00' < valid_until)""")
def calibration_in_force(spark: SparkSession, d: str) -> DataFrame:
    at = F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00"))
    return K.in_force(calibration_validity(spark, d), at).select("event_id", "user_id")


@query("SELECT l_orderkey, l_linenumber, round(0.5 + 2.0 * l_quantity + 0.25 * l_quantity * l_quantity, 6) AS energy FROM lineitem")
def horner_energy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(K.energy(F.col("l_quantity"), [0.5, 2.0, 0.25]), 6).alias("energy"))


_POINTS = [(10.0, 1.0), (50.0, 1.2), (100.0, 1.5), (300.0, 2.5)]


@query("""SELECT event_id, round(CASE WHEN value < 10 THEN 1.0::DOUBLE WHEN value < 50 THEN 1.0 + (value - 10) * (0.2 / 40) WHEN value < 100 THEN 1.2 + (value - 50) * (0.3 / 50)
  WHEN value < 300 THEN 1.5 + (value - 100) * (1.0 / 200) ELSE 2.5 END, 6) AS correction FROM events""")
def interp_curve(spark: SparkSession, d: str) -> DataFrame:
    """A dead-time curve by rate, flat beyond its ends."""
    return _events(spark, d).select("event_id", F.round(K.interpolated(F.col("value"), _POINTS), 6).alias("correction"))


@query("SELECT user_id, event_id, value AS y, lead(event_id) OVER w AS x1, lead(value) OVER w AS y1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def curve_segments(spark: SparkSession, d: str) -> DataFrame:
    curve = table(spark, d, "events").select("user_id", "event_id", F.col("value").alias("y"))
    return K.segments(curve, ["user_id"], "event_id", "y")


@query("SELECT l_orderkey, l_linenumber, p_brand, round(l_quantity * p_size, 6) AS gained FROM lineitem JOIN part ON l_partkey = p_partkey")
def gain_apply(spark: SparkSession, d: str) -> DataFrame:
    """Per-part factors on every line."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("gained"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("double").alias("factor"), "p_brand")
    return K.gained(rows, part, ["l_partkey"], "gained").where("p_brand is not null").select("l_orderkey", "l_linenumber", "p_brand", F.round("gained", 6).alias("gained"))


@query("SELECT l_orderkey, l_linenumber, s_name FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey")
def channel_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return K.lookup(rows, table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), ["l_suppkey"]).drop("l_suppkey")


@query("SELECT e.event_id, round(value - coalesce(CASE WHEN user_id % 2 = 0 THEN user_id * 0.25 END, 0), 6) AS value FROM events e")
def timing_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Per-user offsets, absent for every other user."""
    rows = table(spark, d, "events").select("event_id", "user_id", "value")
    offsets = rows.select("user_id").distinct().where("user_id % 2 = 0").withColumn("offset", F.col("user_id") * 0.25)
    return K.offset(rows, offsets, ["user_id"], "value").select("event_id", F.round("value", 6).alias("value"))


@query("SELECT event_id, round(value * 1.05::DOUBLE, 6) AS value, round(abs(value) * 0.02::DOUBLE, 6) AS error FROM events")
def cross_factor(spark: SparkSession, d: str) -> DataFrame:
    v, e = K.cross_calibrated(F.col("value"), 1.05, 0.02)
    return table(spark, d, "events").select("event_id", F.round(v, 6).alias("value"), F.round(e, 6).alias("error"))


@query("SELECT event_id, round(value * 1.0::DOUBLE + 273.15::DOUBLE, 6) AS kelvin, round(value * 0.01::DOUBLE, 6) AS humidity FROM events")
def ambient_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Temperature and relative humidity in SI units."""
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.round(K.ambient(v, F.lit("degC"), F.lit(1.0)), 6).alias("kelvin"), F.round(K.ambient(v, F.lit("%"), F.lit(0.01)), 6).alias("humidity"))
