"""Descriptors of parts from long tables of points and of face edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def thinned(points: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` points of each part, by seeded order."""
    order = Window.partitionBy("part_id").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "part_id", "point_id")), "point_id")
    return points.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= most).drop("_rank")


def normalised_points(points: DataFrame) -> DataFrame:
    """Points less their part's mean, over the diagonal of its box plus 1e-9."""
    stats = points.groupBy("part_id").agg(*[F.avg(c).alias(f"m_{c}") for c in AXES], *[(F.max(c) - F.min(c)).alias(f"s_{c}") for c in AXES])
    diagonal = F.sqrt(sum((F.col(f"s_{c}") * F.col(f"s_{c}") for c in AXES), F.lit(0.0))) + 1e-9
    return points.join(stats, "part_id").select("part_id", "point_id", *[((F.col(c) - F.col(f"m_{c}")) / diagonal).alias(c) for c in AXES])


def pair_distance_histogram(points: DataFrame, pairs: int = 20_000, bins: int = 64, seed: int = 42, least: int = 4) -> DataFrame:
    """``(part_id, bin, share)``: distances of seeded random pairs of a part's points over the root of three.

    Points are numbered by ``point_id``; parts of fewer than ``least`` points are left out; a pair may be one point twice.
    """
    n = points.withColumn("no", F.row_number().over(Window.partitionBy("part_id").orderBy("point_id")))
    size = points.groupBy("part_id").agg(F.count("*").alias("size")).filter(F.col("size") >= least)
    draw = lambda tag: (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{tag}{seed}"), "part_id", "draw")), 1, 8), 16, 10).cast("long") % F.col("size") + 1).cast("int")
    drawn = size.select("part_id", "size", F.explode(F.sequence(F.lit(1), F.lit(pairs))).alias("draw")).select("part_id", draw("i").alias("i"), draw("j").alias("j"))
    side = lambda k: n.select("part_id", F.col("no").alias(k), *[F.col(c).alias(f"{k}{c}") for c in AXES])
    both = drawn.join(side("i"), ["part_id", "i"]).join(side("j"), ["part_id", "j"])
    dist = F.sqrt(sum(((F.col(f"i{c}") - F.col(f"j{c}")) * (F.col(f"i{c}") - F.col(f"j{c}")) for c in AXES), F.lit(0.0))) / F.sqrt(F.lit(3.0))
    bin_ = F.least(F.lit(bins), F.width_bucket(F.least(F.lit(1.0), F.round(dist, 9)), F.lit(0.0), F.lit(1.0), F.lit(bins))).cast("int")
    return both.groupBy("part_id", bin_.alias("bin")).agg(F.round(F.count("*") / F.lit(pairs), 6).alias("share"))


def box_ratios(points: DataFrame, key: str = "part_id") -> DataFrame:
    """``(key, r1, r2)``: the shorter sides of the box around a part's points over the longest plus 1e-12, shortest first."""
    side = points.groupBy(key).agg(*[(F.max(c) - F.min(c)).cast("double").alias(c) for c in AXES])
    s = F.sort_array(F.array(*AXES))
    return side.select(key, *[(s[i] / (s[2] + 1e-12)).alias(f"r{i + 1}") for i in (0, 1)])


# Kinds of surfaces; any other is the last.
SURFACES = ("plane", "cylinder", "cone", "sphere", "torus", "free")


def surface_histogram(faces: DataFrame, key: str = "part_id") -> DataFrame:
    """``(key, <kind>..)``: the share of each of :data:`SURFACES` among a part's faces; null and unknown kinds are free."""
    kind = F.when(F.col("kind").isin(*SURFACES), F.col("kind")).otherwise(SURFACES[-1])
    return faces.groupBy(key).agg(*[F.avg((kind == k).cast("int")).alias(k) for k in SURFACES])


def _along(points: DataFrame, axes: DataFrame, by: list[str]) -> DataFrame:
    """Points with ``t``, their place along the unit axis of their group, and ``r``, their distance from it; the axis goes
    through ``ox, oy, oz`` where ``axes`` has these, else through the origin."""
    size = F.sqrt(F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay") + F.col("az") * F.col("az")) + 1e-12
    origin = [F.col(f"o{c}") if f"o{c}" in axes.columns else F.lit(0.0) for c in AXES]
    unit = axes.select(*by, *[(F.col(f"a{c}") / size).alias(f"u{c}") for c in AXES], *[o.alias(f"o{c}") for o, c in zip(origin, AXES, strict=True)])
    rows = points.select(*by, *AXES).join(unit, by)
    rows = rows.select(*by, *[(F.col(c) - F.col(f"o{c}")).alias(c) for c in AXES], *[f"u{c}" for c in AXES])
    t = sum((F.col(c) * F.col(f"u{c}") for c in AXES), F.lit(0.0))
    square = sum((F.col(c) * F.col(c) for c in AXES), F.lit(0.0))
    return rows.select(*by, t.alias("t"), F.sqrt(F.greatest(F.lit(0.0), square - t * t)).alias("r"))


def extent_along(points: DataFrame, axes: DataFrame, *by: str) -> DataFrame:
    """``(by.., extent)``: how far the points of a group reach along the group's axis ``ax, ay, az``."""
    return _along(points, axes, list(by)).groupBy(*by).agg((F.max("t") - F.min("t")).alias("extent"))


def roundness(points: DataFrame, axes: DataFrame, *by: str, least: int = 1) -> DataFrame:
    """``(by.., roundness)``: one less the relative deviation of the points' distances from the group's axis, at least 0, of
    groups of ``least`` points or more. The surveyed form measures from the origin, as an axis without a place does."""
    spread = F.stddev_pop("r") / (F.avg("r") + 1e-6)
    return _along(points, axes, list(by)).groupBy(*by).agg((1 - F.least(F.lit(1.0), spread)).alias("roundness"), F.count("*").alias("_n")).filter(F.col("_n") >= least).drop("_n")


def mean_of_centres(circles: DataFrame, parts: DataFrame, key: str = "part_id", face: str = "face_no") -> DataFrame:
    """``(key, x, y, z)``: the mean over a part's faces of the mean of their circles' centres ``x, y, z``; parts without
    circles have the origin. ``parts`` holds the keys."""
    per = circles.groupBy(key, face).agg(*[F.avg(c).alias(c) for c in AXES])
    mean = per.groupBy(key).agg(*[F.avg(c).alias(c) for c in AXES])
    return parts.select(key).distinct().join(mean, key, "left").select(key, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in AXES])


def dihedral_histogram(edges: DataFrame, bins: int = 36, digits: int = 6) -> DataFrame:
    """``(part_id, bin, share)``: angles between the normals of the two faces that meet in an edge, in bins over half a turn.

    Edges are ``part_id, face_no, x1..z1, x2..z2, nx, ny, nz``; two are one if their ends agree after rounding, in either
    order; of more than two faces the first two count.
    """
    end = lambda k: F.concat_ws(",", *[F.format_number(F.round(F.col(f"{c}{k}"), digits) + 0.0, digits) for c in AXES])
    keyed = edges.select("part_id", "face_no", F.concat_ws("|", F.least(end(1), end(2)), F.greatest(end(1), end(2))).alias("edge"), "nx", "ny", "nz")
    rank = F.row_number().over(Window.partitionBy("part_id", "edge").orderBy("face_no"))
    two = keyed.withColumn("r", rank).filter("r <= 2")
    a, b = two.filter("r = 1").select("part_id", "edge", *[F.col(f"n{c}").alias(f"a{c}") for c in AXES]), two.filter("r = 2").select("part_id", "edge", *[F.col(f"n{c}").alias(f"b{c}") for c in AXES])
    size = lambda s: F.sqrt(sum((F.col(f"{s}{c}") * F.col(f"{s}{c}") for c in AXES), F.lit(0.0)))
    cos = sum((F.col(f"a{c}") * F.col(f"b{c}") for c in AXES), F.lit(0.0)) / F.nullif(size("a") * size("b"), F.lit(0.0))
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos)))
    hit = a.join(b, ["part_id", "edge"]).filter(cos.isNotNull()).withColumn("bin", F.least(F.lit(bins), F.width_bucket(F.round(angle, 9), F.lit(0.0), F.lit(3.141592653589793), F.lit(bins))).cast("int"))
    count = hit.groupBy("part_id", "bin").agg(F.count("*").alias("n"))
    total = count.groupBy("part_id").agg(F.sum("n").alias("t"))
    return count.join(total, "part_id").select("part_id", "bin", F.round(F.col("n") / F.col("t"), 6).alias("share"))
