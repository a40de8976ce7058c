"""Time series and events on the test tables: a user is a channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import micros
from ..functions.tables import table
from ..operators import arrays as A
from ..operators import metadata as M
from ..operators import series as S
from .registry import query


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", micros("ts").alias("t"))


def _day() -> Column:
    """Windows of a user with very many events run within days."""
    return F.floor(F.col("t") / 86_400_000_000)


@query("SELECT user_id, round(avg(value), 6) AS average, min(value) AS least, max(value) AS most, max(epoch_us(ts)) - min(epoch_us(ts)) AS duration FROM events GROUP BY 1")
def channel_summary(spark: SparkSession, d: str) -> DataFrame:
    return S.summary(_events(spark, d), ["user_id"], "value", "t").withColumn("average", F.round("average", 6))


@query("SELECT vec_id, i - 1 AS i, (i - 1) * 0.5::DOUBLE AS t, embedding[i]::DOUBLE AS signal FROM embeddings, (SELECT unnest(range(1, 1 + (SELECT max(len(embedding)) FROM embeddings))) AS i) WHERE i <= len(embedding)".replace("i - 1 AS i", "(i - 1)::INTEGER AS i"))
def channel_read(spark: SparkSession, d: str) -> DataFrame:
    """Samples from parallel arrays of signal and time."""
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("signal"), F.transform("embedding", lambda x, i: i * F.lit(0.5).cast("double")).alias("time"))
    return S.samples(rows, ["vec_id"])


@query("SELECT event_id, epoch_us(ts) + (value * 1000000)::BIGINT AS at FROM events")
def channel_time(spark: SparkSession, d: str) -> DataFrame:
    """Absolute times: the start of a channel and an offset in seconds."""
    return _events(spark, d).select("event_id", (F.col("t") + F.round(F.col("value") * 1_000_000).cast("bigint")).alias("at"))


@query("SELECT user_id, epoch_us(ts) // 3600000000 AS cue, min(event_id) AS first_index FROM events GROUP BY 1, 2")
def cue_index(spark: SparkSession, d: str) -> DataFrame:
    """The first event of every hour."""
    return S.cue_index(_events(spark, d), ["user_id"], "t", "event_id", 3_600_000_000)


@query("""WITH c AS (SELECT user_id, epoch_us(ts) // 3600000000 AS cue, min(event_id) AS i FROM events GROUP BY 1, 2)
SELECT user_id, arg_max(i, cue) AS start_index FROM c WHERE cue * 3600000000 <= epoch_us(TIMESTAMP '2024-01-20 12:00:00') GROUP BY 1""")
def seek_cue(spark: SparkSession, d: str) -> DataFrame:
    """Where to start reading each channel for a given time."""
    return S.seek(cue_index(spark, d), ["user_id"], 3_600_000_000, F.lit(1_705_752_000_000_000))


@query("SELECT user_id, median(gap)::DOUBLE AS median_gap FROM (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) WHERE gap IS NOT NULL GROUP BY 1")
def rate_check(spark: SparkSession, d: str) -> DataFrame:
    return S.rate_check(_events(spark, d), ["user_id"], "t", ["event_id"], _day())


@query("SELECT event_id, user_id, value FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before < 100 AND value >= 100")
def trigger_detect(spark: SparkSession, d: str) -> DataFrame:
    return S.triggers(_events(spark, d), ["user_id"], ["t", "event_id"], "value", 100.0, _day()).select("event_id", "user_id", "value")


_GATE = """WITH m AS (SELECT event_id, user_id, epoch_us(ts) AS t, CASE WHEN event_type = 'purchase' THEN epoch_us(ts) END AS mark FROM events),
g AS (SELECT event_id, t, last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p,
  first_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM m),
f AS (SELECT event_id, CASE WHEN q - p > 0 THEN (t - p) / (q - p)::DOUBLE END AS phase FROM g)"""


@query(f"{_GATE} SELECT event_id, round(phase, 6) AS phase FROM f")
def gate_phase(spark: SparkSession, d: str) -> DataFrame:
    """Phases between purchases."""
    out = S.gate_phase(_events(spark, d), ["user_id"], ["t", "event_id"], "t", F.col("event_type") == "purchase", _day())
    return out.select("event_id", F.round("phase", 6).alias("phase"))


@query(f"{_GATE} SELECT floor(round(phase, 6) * 8)::BIGINT AS gate, count(*) AS n FROM f WHERE phase IS NOT NULL GROUP BY 1")
def gate_axis(spark: SparkSession, d: str) -> DataFrame:
    """Eight gates over the cycle."""
    return gate_phase(spark, d).where("phase is not null").groupBy(F.floor(F.col("phase") * 8).alias("gate")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id, first, second, gap FROM (SELECT user_id, event_id AS second, lag(event_id) OVER w AS first, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE gap <= 600000000""")
def coincidence_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring events of a user within ten minutes."""
    return S.coincidences(_events(spark, d), ["user_id"], ["t", "event_id"], "t", "event_id", 600_000_000, _day())


@query("""SELECT a.user_id, a.event_id AS first, b.event_id AS second, epoch_us(b.ts) - epoch_us(a.ts) AS gap FROM events a JOIN events b ON a.user_id = b.user_id
WHERE (b.ts > a.ts OR (b.ts = a.ts AND b.event_id > a.event_id)) AND epoch_us(b.ts) - epoch_us(a.ts) <= 600000000""")
def coincidence_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of events of a user within ten minutes."""
    return S.coincidence_pairs(_events(spark, d), ["user_id"], "t", "event_id", 600_000_000)


@query("""SELECT event_id, 'single' AS layout, 'measured' AS origin FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, 'coincidence', 'measured' FROM events WHERE event_type = 'purchase'
UNION ALL SELECT event_id, 'coincidence', 'simulated' FROM events WHERE event_type = 'view'""")
def event_tables(spark: SparkSession, d: str) -> DataFrame:
    """Raw, processed and simulated events under one layout."""
    e = _events(spark, d)
    part = lambda kind, layout, origin: e.where(F.col("event_type") == kind).select("event_id", F.lit(layout).alias("layout"), F.lit(origin).alias("origin"))
    return M.additive(part("click", "single", "measured"), part("purchase", "coincidence", "measured"), part("view", "coincidence", "simulated"))


@query("SELECT event_id, user_id FROM events WHERE event_type <> 'error'")
def synchronised(spark: SparkSession, d: str) -> DataFrame:
    return S.synchronised(_events(spark, d).withColumn("run_control", F.col("event_type") != "error")).select("event_id", "user_id")


@query("""WITH f AS (SELECT user_id, epoch_us(ts)::DOUBLE AS s, max(value * 60000000)::DOUBLE AS w FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT e.event_id, CASE WHEN epoch_us(e.ts) < f.s + f.w THEN f.s END AS frame_start FROM events e ASOF LEFT JOIN f ON e.user_id = f.user_id AND epoch_us(e.ts)::DOUBLE >= f.s""")
def frame_at_time(spark: SparkSession, d: str) -> DataFrame:
    """The frame in force at every event: frames start at purchases and last as many minutes as their value."""
    e = _events(spark, d).withColumn("t", F.col("t").cast("double"))
    frames = e.where("event_type = 'purchase'").select("user_id", F.col("t").alias("start"), (F.col("value") * 60_000_000).alias("duration"))
    return A.frame_at(frames, e.select("event_id", "user_id", F.col("t").alias("at")), ["user_id"]).select("event_id", "frame_start")


@query("""WITH f AS (SELECT user_id, value, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS w FROM events)
SELECT user_id, round(sum(value * w) / sum(w), 6) AS mean FROM f WHERE w IS NOT NULL GROUP BY 1""")
def time_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Means weighted by uneven durations (the time to the next event)."""
    from ..operators.calibration import validity

    rows = validity(_events(spark, d), ["user_id"], "t", "until", ["event_id"]).where("until is not null")
    out = A.time_weighted_mean(rows.withColumn("w", F.col("until") - F.col("t")), ["user_id"], "value", "w")
    return out.withColumn("mean", F.round("mean", 6))


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS frame, turn AS frame_start, length(text)::BIGINT AS frame_duration, role AS frame_label FROM conversations")
def frame_table(spark: SparkSession, d: str) -> DataFrame:
    """Frames from parallel arrays, one for each turn."""
    rows = F.sort_array(F.collect_list(F.struct("turn", F.length("text").cast("bigint").alias("n"), "role")))
    arrays = table(spark, d, "conversations").groupBy("conv_id").agg(rows.alias("r")).select("conv_id", F.col("r.turn").alias("frame_start"), F.col("r.n").alias("frame_duration"), F.col("r.role").alias("frame_label"))
    return A.frame_table(arrays, ["conv_id"])
