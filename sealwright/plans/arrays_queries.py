"""Arrays and regions on the test tables: a vector is a row of a volume, its label a frame or a region."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import affine
from ..functions.tables import table
from ..operators import arrays as A
from ..operators import regions as R
from ..sources import store as S
from .registry import query

_LONG = "v AS (SELECT vec_id, label, i - 1 AS i, embedding[i]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(1, 1 + (SELECT max(len(embedding)) FROM embeddings))) AS i) WHERE i <= len(embedding))"
_M = [[0.5, 0.0, 0.1, 1.0], [0.0, 2.0, 0.0, -1.0], [0.2, 0.0, 1.0, 0.5], [0.0, 0.0, 0.0, 1.0]]


def _voxels(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, label, i, v)"""
    return A.long_form(table(spark, d, "embeddings"), ["vec_id", "label"], "embedding")


def _grid(spark: SparkSession, d: str) -> DataFrame:
    """(t, z, y, x, v): frames are labels, a vector is a slice of 8 by 8."""
    return _voxels(spark, d).select(F.col("label").alias("t"), F.col("vec_id").alias("z"), F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).cast("bigint").alias("x"), "v")


@query(f"WITH {_LONG} SELECT vec_id AS z, i::INTEGER AS i, v FROM v WHERE vec_id = 7")
def slice_read(spark: SparkSession, d: str) -> DataFrame:
    """One slice; the condition reaches the scan."""
    rows = A.slices(table(spark, d, "embeddings").withColumnRenamed("vec_id", "z"), z=7)
    return A.long_form(rows, ["z"], "embedding")


@query(f"WITH {_LONG} SELECT vec_id AS z, (i % 8)::BIGINT AS x, max(v) AS v FROM v GROUP BY 1, 2")
def mip_coronal(spark: SparkSession, d: str) -> DataFrame:
    return A.coronal_mip(_grid(spark, d))


@query(f"WITH {_LONG} SELECT vec_id AS z, i // 8 AS y, max(v) AS v FROM v GROUP BY 1, 2")
def mip_sagittal(spark: SparkSession, d: str) -> DataFrame:
    return A.sagittal_mip(_grid(spark, d))


@query(f"WITH {_LONG} SELECT label AS t, i::INTEGER AS i, max(v) AS v FROM v GROUP BY 1, 2")
def mip_per_frame(spark: SparkSession, d: str) -> DataFrame:
    return A.project(_voxels(spark, d).withColumnRenamed("label", "t"), ["t", "i"])


@query(f"WITH {_LONG} SELECT i::INTEGER AS i, round(sum(v), 6) AS v FROM v GROUP BY 1")
def sum_frames(spark: SparkSession, d: str) -> DataFrame:
    return A.project(_voxels(spark, d), ["i"], "sum").withColumn("v", F.round("v", 6))


def _pyramid_sql(f: int) -> str:
    return f"SELECT {f}::INTEGER AS factor, vec_id // {f} AS z, i // 8 // {f} AS y, i % 8 // {f} AS x, round(avg(v), 6) AS v FROM v GROUP BY ALL"


@query(f"WITH {_LONG} {' UNION ALL '.join(_pyramid_sql(f) for f in (2, 4, 8))}")
def pyramid_mean(spark: SparkSession, d: str) -> DataFrame:
    """Block means of three levels, each from the full resolution."""
    g = _grid(spark, d)
    out = None
    for f in (2, 4, 8):
        level = A.pyramid(g, ["z", "y", "x"], f).select(F.lit(f).alias("factor"), "z", "y", "x", F.round("v", 6).alias("v"))
        out = level if out is None else out.union(level)
    return out


@query(f"WITH {_LONG} SELECT vec_id // 4 AS z, i // 8 // 4 AS y, i % 8 // 4 AS x, v FROM v WHERE vec_id % 4 = 0 AND (i // 8) % 4 = 0 AND (i % 8) % 4 = 0")
def pyramid_stride(spark: SparkSession, d: str) -> DataFrame:
    return A.pyramid(_grid(spark, d), ["z", "y", "x"], 4, "stride")


@query(f"""WITH {_LONG}, s AS (SELECT vec_id, (i + k.d) // 2 AS x, v, CASE WHEN k.d = 0 THEN 2 ELSE 1 END AS w FROM v, (SELECT unnest([-1, 0, 1]) AS d) k WHERE (i + k.d) % 2 = 0 AND i + k.d >= 0)
SELECT vec_id, x, round(sum(v * w) / sum(w), 6) AS v FROM s GROUP BY 1, 2""")
def pyramid_gaussian(spark: SparkSession, d: str) -> DataFrame:
    """One axis smoothed by 1 2 1 and halved; the cell past the end takes the last voxel alone."""
    g = _voxels(spark, d).select("vec_id", F.col("i").cast("bigint").alias("x"), "v")
    return A.pyramid(g, ["x"], 2, "gaussian", ["vec_id"]).withColumn("v", F.round("v", 6))


_P = [f"round({m[0]}::DOUBLE * embedding[1] + {m[1]}::DOUBLE * embedding[2] + {m[2]}::DOUBLE * embedding[3] + {m[3]}::DOUBLE, 6)" for m in _M[:3]]


@query(f"SELECT vec_id, {_P[0]} AS pz, {_P[1]} AS py, {_P[2]} AS px FROM embeddings")
def affine_points(spark: SparkSession, d: str) -> DataFrame:
    """The first three components as a point, to physical space."""
    p = [F.get("embedding", F.lit(k)).cast("double") for k in range(3)]
    return table(spark, d, "embeddings").select("vec_id", *[F.round(c, 6).alias(n) for c, n in zip(affine(_M, p), ("pz", "py", "px"))])


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS pz, round(embedding[2]::DOUBLE, 6) AS py, round(embedding[3]::DOUBLE, 6) AS px FROM embeddings")
def transform_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A transform there, and back by its inverse."""
    p = [F.get("embedding", F.lit(k)).cast("double") for k in range(3)]
    there = A.apply_transform(_M, "source_to_target", p)
    back = A.apply_transform(_M, "target_to_source", there)
    return table(spark, d, "embeddings").select("vec_id", *[F.round(c, 6).alias(n) for c, n in zip(back, ("pz", "py", "px"))])


@query("""SELECT round(avg(d), 6) AS tre_mean, round(max(d), 6) AS tre_max FROM (
  SELECT sqrt((embedding[1]::DOUBLE + 0.1 - embedding[4]) ** 2 + (embedding[2]::DOUBLE - embedding[5]) ** 2 + (embedding[3]::DOUBLE - embedding[6]) ** 2) AS d FROM embeddings)""")
def landmark_error(spark: SparkSession, d: str) -> DataFrame:
    c = [F.get("embedding", F.lit(k)).cast("double") for k in range(6)]
    shift = [[1.0, 0.0, 0.0, 0.1], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]]
    out = A.registration_error(table(spark, d, "embeddings"), affine(shift, c[:3]), c[3:])
    return out.select(F.round("tre_mean", 6).alias("tre_mean"), F.round("tre_max", 6).alias("tre_max"))


@query(f"WITH {_LONG} SELECT vec_id AS z, i::INTEGER AS x, round(vec_id + 2 * v, 6) AS z_to, round(i + v, 6) AS x_to FROM v")
def displaced(spark: SparkSession, d: str) -> DataFrame:
    """Grid points moved by the vectors of their voxels."""
    g = _voxels(spark, d).select(F.col("vec_id").alias("z"), F.col("i").alias("x"), "v")
    moved = A.displace(g.select("z", "x"), g.select("z", "x", (2 * F.col("v")).alias("dz"), F.col("v").alias("dx")), ["z", "x"])
    return moved.select("z", "x", F.round("z_to", 6).alias("z_to"), F.round("x_to", 6).alias("x_to"))


@query(f"""WITH {_LONG}, g AS (SELECT vec_id AS z, i // 8 AS y, i % 8 AS x, v AS dz, v * v AS dy, 2 * v AS dx FROM v),
j AS (SELECT z.dz - g.dz + 1 AS a, y.dz - g.dz AS b, x.dz - g.dz AS c, z.dy - g.dy AS d, y.dy - g.dy + 1 AS e, x.dy - g.dy AS f, z.dx - g.dx AS h, y.dx - g.dx AS i, x.dx - g.dx + 1 AS k
  FROM g JOIN g z ON z.z = g.z + 1 AND z.y = g.y AND z.x = g.x JOIN g y ON y.z = g.z AND y.y = g.y + 1 AND y.x = g.x JOIN g x ON x.z = g.z AND x.y = g.y AND x.x = g.x + 1)
SELECT round(min(a * (e * k - f * i) - b * (d * k - f * h) + c * (d * i - e * h)), 6) AS jacobian_min, round(max(a * (e * k - f * i) - b * (d * k - f * h) + c * (d * i - e * h)), 6) AS jacobian_max FROM j""")
def jacobian_range(spark: SparkSession, d: str) -> DataFrame:
    """Folding check of a displacement field made from the vectors."""
    g = _grid(spark, d).select("z", "y", "x", F.col("v").alias("dz"), (F.col("v") * F.col("v")).alias("dy"), (2 * F.col("v")).alias("dx"))
    out = A.jacobian_range(g)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"WITH {_LONG} SELECT vec_id AS plane, i // 8 AS angle, (i % 8)::BIGINT AS radial, round(CASE WHEN i % 8 = 0 THEN v ELSE (1 + (i % 8)::DOUBLE / 10) * v + (i // 8)::DOUBLE / 100 END, 6) AS v FROM v")
def sinogram_corrected(spark: SparkSession, d: str) -> DataFrame:
    """Planes by angle and radius; factors by place, none for the first radius."""
    s = _grid(spark, d).select(F.col("z").alias("plane"), F.col("y").alias("angle"), F.col("x").alias("radial"), "v")
    factors = s.select("angle", "radial").distinct().where("radial <> 0").withColumn("multiplicative", 1 + F.col("radial") / 10).withColumn("additive", F.col("angle") / 100)
    return A.corrected(s, factors, ["angle", "radial"]).select("plane", "angle", "radial", F.round("v", 6).alias("v"))


@query(f"WITH {_LONG}, m AS (SELECT i, v AS truth FROM v WHERE vec_id = 3) SELECT v.label, round(sqrt(avg((v - truth) ** 2)), 6) AS rmse, round(avg(v - truth), 6) AS bias FROM v JOIN m ON v.i = m.i GROUP BY 1")
def truth_compare(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of each label against a true one, that of id 3."""
    v = _voxels(spark, d)
    return A.compare(v, v.where("vec_id = 3").select("i", "v"), ["i"], ["label"]).select("label", F.round("rmse", 6).alias("rmse"), F.round("bias", 6).alias("bias"))


@query("""SELECT event_id, user_id, value FROM events JOIN (SELECT user_id AS u, max(value) FILTER (WHERE event_type = 'click') AS m FROM events GROUP BY 1) ON u = user_id WHERE value >= 0.41::DOUBLE * m""")
def roi_threshold_seed(spark: SparkSession, d: str) -> DataFrame:
    """A relative threshold whose maximum is that of a seed region."""
    e = table(spark, d, "events").select("event_id", "user_id", "value", "event_type")
    return R.relative_threshold(e, ["user_id"], 0.41, "value", F.col("event_type") == "click").select("event_id", "user_id", "value")


_POSITIONS = ", ".join(f"{r[0]} * z + {r[1]} * y + {r[2]} * x + {r[3]} AS p{n}" for n, r in zip("zyx", _M))


@query(f"""WITH g AS (SELECT vec_id AS z, i // 8 AS y, i % 8 AS x FROM (SELECT vec_id, unnest(range(0, 64)) AS i FROM embeddings WHERE len(embedding) = 64)),
p AS (SELECT z, y, x, {_POSITIONS} FROM g)
SELECT z // 2 AS z, y // 2 AS y, x // 2 AS x, round(avg(px), 6) + 0 AS px, round(avg(py), 6) + 0 AS py, round(avg(pz), 6) + 0 AS pz FROM p GROUP BY 1, 2, 3""")
def level_positions(spark: SparkSession, d: str) -> DataFrame:
    """Voxels of a coarser level, put in place by that level's affine: the middle of the voxels they stand for."""
    coarse = _grid(spark, d).select(*[F.floor(F.col(a) / 2).cast("long").alias(a) for a in "zyx"]).distinct()
    places = A.to_physical(A.level_affine(_M, 2))
    return coarse.select("z", "y", "x", *[(F.round(p, 6) + 0).alias(f"p{a}") for a, p in zip("zyx", places)])


@query(f"WITH {_LONG} SELECT vec_id AS z, (i // 8)::BIGINT AS y, (i % 8)::BIGINT AS x, v, (i % 8) / 7.0::DOUBLE AS knot FROM v WHERE vec_id < 20")
def control_points(spark: SparkSession, d: str) -> DataFrame:
    """The control points of a transform, packed into chunks as its payload and read back, each with its knot."""
    grid = _grid(spark, d).where("z < 20").select("z", "y", "x", "v")
    back = S.from_chunks(S.to_chunks(grid, ["z", "y", "x"], [20, 8, 8], [3, 8, 8]), ["z", "y", "x"])
    return back.select(*[F.col(a).cast("long").alias(a) for a in "zyx"], "v", (F.col("x") / 7.0).alias("knot"))


@query("SELECT event_id, 'recon' AS product, 'patlak' AS reconstruction_type FROM events WHERE event_type = 'view' AND value >= 100")
def parametric_maps(spark: SparkSession, d: str) -> DataFrame:
    """Views stand for reconstructions, large values for those by a kinetic model."""
    product, model = F.when(F.col("event_type") == "view", "recon").otherwise("sim"), F.when(F.col("value") >= 100, "patlak").otherwise("osem")
    return A.parametric_maps(table(spark, d, "events").select("event_id", product.alias("product"), model.alias("reconstruction_type")), ["patlak", "logan"])


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000")
def corrections_applied(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("scatter"), (F.col("o_totalprice") >= 100000).alias("randoms"))
    return A.corrections_applied(o, "scatter", "randoms").select("o_orderkey")


@query(f"WITH {_LONG} SELECT label, count(*) AS n_voxels, round(count(*) * 0.5::DOUBLE, 6) AS volume, round(avg(v), 6) AS mean, round(max(v), 6) AS max, round(stddev_samp(v), 6) AS std FROM v GROUP BY 1")
def roi_stats(spark: SparkSession, d: str) -> DataFrame:
    out = R.statistics(_voxels(spark, d), ["label"], voxel_volume=0.5)
    return out.select("label", "n_voxels", *[F.round(c, 6).alias(c) for c in ("volume", "mean", "max", "std")])


@query(f"WITH {_LONG} SELECT label, i % 2 AS image, count(*) AS n_voxels, round(avg(v), 6) AS mean, round(max(v), 6) AS max FROM v GROUP BY 1, 2")
def roi_multi_image(spark: SparkSession, d: str) -> DataFrame:
    """One region set over two images: positions of even and odd number."""
    v = _voxels(spark, d)
    images = v.select("vec_id", "i", (F.col("i") % 2).cast("bigint").alias("image"), "v")
    out = R.over_images(v.select("vec_id", "i", "label"), images, ["vec_id", "i"])
    return out.select("label", "image", "n_voxels", F.round("mean", 6).alias("mean"), F.round("max", 6).alias("max"))


@query("SELECT event_id, user_id, value FROM events JOIN (SELECT user_id AS u, max(value) AS m FROM events GROUP BY 1) ON u = user_id WHERE value >= 0.41::DOUBLE * m")
def roi_threshold(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    return R.relative_threshold(e, ["user_id"], 0.41, "value").select("event_id", "user_id", "value")


@query("""WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings)
SELECT vec_id, sqrt(a * a + b * b + c * c) <= 0.2 AS sphere, sqrt(b * b + c * c) <= 0.15 AND abs(a) <= 0.1 AS cylinder, abs(a) <= 0.1 AND abs(b) <= 0.1 AND abs(c) <= 0.1 AS box,
  a * a / 0.01 + b * b / 0.04 + c * c / 0.01 <= 1 AS ellipsoid FROM p""")
def roi_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Points in four shapes."""
    p, o = [F.get("embedding", F.lit(k)).cast("double") for k in range(3)], [0, 0, 0]
    shapes = {"sphere": R.inside("sphere", p, o, 0.2), "cylinder": R.inside("cylinder", p, o, 0.15, [0.2]), "box": R.inside("box", p, o, size=[0.2, 0.2, 0.2]), "ellipsoid": R.inside("ellipsoid", p, o, size=[0.2, 0.4, 0.2])}
    return table(spark, d, "embeddings").select("vec_id", *[c.alias(n) for n, c in shapes.items()])


@query(f"""WITH {_LONG}, m AS (SELECT vec_id // 8 AS z, vec_id % 8 AS y, i AS x, v > 0 AS inside FROM v),
k AS (SELECT z, y, x FROM m WHERE inside)
SELECT 1::INTEGER AS label, z, y, x::BIGINT AS x FROM k WHERE EXISTS (FROM k a WHERE a.z = k.z AND a.y = k.y AND a.x = k.x + 1) AND EXISTS (FROM k a WHERE a.z = k.z AND a.y = k.y AND a.x = k.x - 1)
  AND EXISTS (FROM k a WHERE a.z = k.z AND a.y = k.y + 1 AND a.x = k.x) AND EXISTS (FROM k a WHERE a.z = k.z AND a.y = k.y - 1 AND a.x = k.x)""")
def roi_eroded(spark: SparkSession, d: str) -> DataFrame:
    """Positive voxels, eroded in the plane."""
    v = _voxels(spark, d).where("v > 0")
    mask = v.select(F.lit(1).alias("label"), F.floor(F.col("vec_id") / 8).alias("z"), (F.col("vec_id") % 8).alias("y"), F.col("i").cast("bigint").alias("x"))
    return R.eroded(mask.withColumn("label", F.concat_ws(":", "label", "z")), ["y", "x"]).select(F.lit(1).alias("label"), F.split_part("label", F.lit(":"), F.lit(2)).cast("bigint").alias("z"), "y", "x")


@query(f"""WITH {_LONG}, p AS (SELECT vec_id, i // 2 AS k, max(v) FILTER (WHERE i % 2 = 0) AS u, max(v) FILTER (WHERE i % 2 = 1) AS w, max(i // 2) OVER (PARTITION BY vec_id) AS last FROM v GROUP BY vec_id, i // 2, i // 2),
n AS (SELECT a.vec_id, a.u * b.w - b.u * a.w AS c FROM p a JOIN p b ON a.vec_id = b.vec_id AND b.k = CASE WHEN a.k = a.last THEN 0 ELSE a.k + 1 END)
SELECT vec_id, round(abs(sum(c)) / 2, 6) AS area FROM n GROUP BY 1""".replace("max(i // 2) OVER (PARTITION BY vec_id) AS last FROM v GROUP BY vec_id, i // 2, i // 2", "max(i // 2) OVER (PARTITION BY vec_id) AS last FROM v GROUP BY vec_id, i // 2"))
def contour_area(spark: SparkSession, d: str) -> DataFrame:
    """Components in pairs as the vertices of a polygon."""
    at = lambda odd: F.transform(F.filter("embedding", lambda x, i: i % 2 == odd), lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(R.polygon_area(at(0), at(1)), 6).alias("area"))


@query("SELECT doc_id, quality IS NOT NULL OR toxic = 1 OR lang = 'de' AS represented FROM documents LEFT JOIN labels USING (doc_id)")
def roi_representation(spark: SparkSession, d: str) -> DataFrame:
    """Any of three representations will do."""
    docs = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return docs.select("doc_id", R.has_representation(F.col("quality").isNotNull(), F.col("toxic") == 1, F.col("lang") == "de").alias("represented"))


@query("SELECT n_nationkey AS label, n_name AS anatomy, r_name AS vocabulary, r_regionkey::VARCHAR AS code FROM nation JOIN region ON n_regionkey = r_regionkey")
def roi_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Labels with their region's term, vocabulary and code."""
    regions = table(spark, d, "region").select(F.col("r_regionkey").alias("label"), F.col("r_name").alias("vocabulary"), F.col("r_regionkey").cast("string").alias("code"))
    mask = table(spark, d, "nation").select(F.col("n_regionkey").alias("label"), F.col("n_nationkey").alias("nation"), F.col("n_name").alias("anatomy"))
    return R.named(mask, regions).select(F.col("nation").alias("label"), "anatomy", "vocabulary", "code")
