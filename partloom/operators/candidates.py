"""Hole candidates from tables of faces, their quality, recall against ground truth, and tuning over a parameter grid.

Faces have ``part_id, face_no, kind, radius, depth, ax, ay, az, semi_angle``; kinds as in a boundary representation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partloom.functions.scalars import axis_angle, interval_iou

CYLINDER, CONE = "cylinder", "cone"


def _cos(p: str, q: str) -> Column:
    along = sum((F.col(f"{p}{x}") * F.col(f"{q}{x}") for x in ("ax", "ay", "az")), F.lit(0.0))
    size = lambda s: F.sqrt(sum((F.col(f"{s}{x}") * F.col(f"{s}{x}") for x in ("ax", "ay", "az")), F.lit(0.0)))
    return F.abs(along) / F.nullif(size(p) * size(q), F.lit(0.0))


def best_coaxial(faces: DataFrame, least: float = 0.995) -> DataFrame:
    """``(part_id, face_no, cone_no, coax_dot, semi_angle)``: for each cylinder the cone whose axis agrees best, above
    ``least``; the first face wins ties. Cylinders without one are left out."""
    cyl = faces.filter(F.col("kind") == CYLINDER).select("part_id", "face_no", *[F.col(x).alias(f"c_{x}") for x in ("ax", "ay", "az")])
    cone = faces.filter(F.col("kind") == CONE).select("part_id", F.col("face_no").alias("cone_no"), "semi_angle", *[F.col(x).alias(f"k_{x}") for x in ("ax", "ay", "az")])
    pairs = cyl.join(cone, "part_id").withColumn("coax_dot", F.round(_cos("c_", "k_"), 9)).filter(F.col("coax_dot") > least)
    best = Window.partitionBy("part_id", "face_no").orderBy(F.desc("coax_dot"), "cone_no")
    return pairs.withColumn("_rank", F.row_number().over(best)).filter("_rank = 1").select("part_id", "face_no", "cone_no", "coax_dot", "semi_angle")


def quality(q_round: Column, coax: Column, ring: Column, ring_required: bool = True) -> Column:
    """Mean of the terms that are known, within 0 and 1: roundness, coaxiality (1 without a cone), entry ring."""
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    q_coax = clamp(F.coalesce(coax, F.lit(1.0)))
    q_entry = F.when(ring, 1.0).otherwise(0.3 if ring_required else 0.7)
    return clamp((F.coalesce(q_round, F.lit(0.0)) + q_coax + q_entry) / (F.when(q_round.isNotNull(), 3).otherwise(2)))


def extract(faces: DataFrame, min_depth: float, min_radius: float, most: int = 128, rings: DataFrame | None = None, ring_required: bool = True) -> DataFrame:
    """Candidates of each part: its wide cylinders with the cone they share an axis with.

    Numbered over all cylinders in face order before the size filter, so numbers may have gaps; at most ``most`` a part.
    The quality takes a face's ``q_round`` in where the table has it. ``rings`` lists the parts that have a circular edge;
    without that table a plane stands for the ring.
    """
    order = Window.partitionBy("part_id").orderBy("face_no", "radius", "depth")
    cyl = faces.filter((F.col("kind") == CYLINDER) & (F.col("radius") >= 0.25)).withColumn("no", F.row_number().over(order))
    ring = faces.groupBy("part_id").agg(F.bool_or(F.col("kind") == "plane").alias("has_entry_ring")) if rings is None else rings.select("part_id").distinct().withColumn("has_entry_ring", F.lit(True))
    rows = cyl.drop("semi_angle").join(best_coaxial(faces), ["part_id", "face_no"], "left").join(ring, "part_id", "left")
    rows = rows.filter((F.col("depth") >= min_depth) & (2 * F.col("radius") >= 2 * min_radius)).withColumn("_kept", F.row_number().over(order)).filter(F.col("_kept") <= most)
    even = F.col("q_round") if "q_round" in faces.columns else F.lit(None).cast("double")
    q = quality(even, F.col("coax_dot"), F.coalesce("has_entry_ring", F.lit(False)), ring_required)
    hole = F.concat(F.col("part_id").cast("string"), F.lit("::h"), F.lpad(F.col("no").cast("string"), 4, "0"))
    return rows.select("part_id", hole.alias("hole_id"), (2 * F.col("radius")).alias("D0"), F.col("depth").alias("H0"), (2 * F.col("semi_angle")).alias("alpha0"), F.round(q, 6).alias("q"))


def one_per_part(faces: DataFrame, min_depth: float = 0.0, centres: DataFrame | None = None) -> DataFrame:
    """At most one candidate a part: median diameter, total depth, and the mean axis of its cylinders, turned to the side of
    the first one; where that mean vanishes, the axis of the longest. Angle 90 and quality 0.8 are fixed. ``centres`` is
    ``(part_id, x, y, z)`` for the base, the origin without it. Cylinders without an axis or below ``min_depth`` do not count."""
    size = F.sqrt(F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay") + F.col("az") * F.col("az"))
    cyl = faces.filter((F.col("kind") == CYLINDER) & (F.col("depth") >= min_depth) & (size > 0)).withColumn("_s", size)
    cyl = cyl.select("part_id", "face_no", "radius", "depth", *[(F.col(x) / F.col("_s")).alias(x) for x in ("ax", "ay", "az")])
    axis = F.struct("ax", "ay", "az")
    ref = cyl.groupBy("part_id").agg(F.min_by(axis, "face_no").alias("first"), F.min_by(axis, F.struct(-F.col("depth"), F.col("face_no"))).alias("longest"))
    rows = cyl.join(ref, "part_id").withColumn("s", F.when(sum((F.col(x) * F.col(f"first.{x}") for x in ("ax", "ay", "az")), F.lit(0.0)) < 0, -1.0).otherwise(1.0))
    out = rows.groupBy("part_id").agg(F.median(2 * F.col("radius")).alias("D0"), F.sum("depth").alias("H0"), F.first("longest").alias("longest"), *[F.avg(F.col("s") * F.col(x)).alias(f"m_{x}") for x in ("ax", "ay", "az")])
    out = out.withColumn("_n", F.sqrt(sum((F.col(f"m_{x}") * F.col(f"m_{x}") for x in ("ax", "ay", "az")), F.lit(0.0))))
    out = out.select("part_id", "D0", "H0", F.lit(90.0).alias("alpha0"), *[F.when(F.col("_n") > 1e-8, F.col(f"m_{x}") / F.col("_n")).otherwise(F.col(f"longest.{x}")).alias(x) for x in ("ax", "ay", "az")])
    if centres is not None:
        out = out.join(centres.select("part_id", *[F.col(c).alias(f"b{c}") for c in "xyz"]), "part_id", "left")
    base = [F.coalesce(f"b{c}", F.lit(0.0)).alias(f"b{c}") if centres is not None else F.lit(0.0).alias(f"b{c}") for c in "xyz"]
    return out.select("part_id", "D0", "H0", "alpha0", "ax", "ay", "az", *base, F.lit(0.8).alias("q"))


def pair_measures(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Angle and depth overlap of every true hole and every candidate of its part, and where both have ``bx, by, bz`` the
    distance of their bases, with the diameter of the true hole."""
    based = all(f"b{c}" in df.columns for c in "xyz" for df in (truth, found))
    b = [f"b{c}" for c in "xyz"] if based else []
    g = truth.select("part_id", "gt_id", "tilt", *[F.col(x).alias(f"g_{x}") for x in ("ax", "ay", "az", "depth", "radius", *b)])
    p = found.select("part_id", *[F.col(x).alias(f"p_{x}") for x in ("ax", "ay", "az", "depth", *b)])
    angle = axis_angle(*[F.col(f"g_{x}") for x in ("ax", "ay", "az")], *[F.col(f"p_{x}") for x in ("ax", "ay", "az")])
    apart = [F.sqrt(sum(((F.col(f"g_{x}") - F.col(f"p_{x}")) * (F.col(f"g_{x}") - F.col(f"p_{x}")) for x in b), F.lit(0.0))).alias("apart"), (2 * F.col("g_radius")).alias("D")] if based else []
    return g.join(p, "part_id").select("part_id", "gt_id", "tilt", F.round(angle, 6).alias("angle"), F.round(interval_iou(F.col("g_depth"), F.col("p_depth")), 6).alias("iou"), *apart)


def matched(pairs: DataFrame, tol: float, tol_hi: float, iou: float, centre: tuple[float, float] | None = None) -> DataFrame:
    """True holes with a candidate within tolerance; steep ones (over 45 degrees) have ``tol_hi``. ``centre`` is a share of the
    diameter and a least distance within which the bases must lie. A candidate may serve several holes, a hole counts once."""
    limit = F.when(F.col("tilt") <= 45, tol).otherwise(tol_hi)
    near = F.lit(True) if centre is None else F.col("apart") <= F.greatest(centre[0] * F.col("D"), F.lit(centre[1]))
    return pairs.filter((F.col("angle") <= limit) & (F.col("iou") >= iou) & near).select("part_id", "gt_id").distinct()


def evaluation(runs: DataFrame) -> DataFrame:
    """One row ``(recall, median_ms, per_part, n)`` of an evaluation: ``runs`` has a row a part with ``status`` (ok, timeout,
    error), ``hits``, ``n_true``, ``ms`` and ``n_found``. A part weighs as many as it has true holes, but at least one; a
    timeout weighs one without a hit, an error nothing. Without true holes (a slice of real parts) the recall is 0."""
    ok = F.col("status") == "ok"
    weight = F.when(ok, F.greatest(F.lit(1), F.coalesce("n_true", F.lit(0)))).when(F.col("status") == "timeout", 1).otherwise(0)
    gain = F.when(ok & (F.coalesce("n_true", F.lit(0)) > 0), F.col("hits") / F.col("n_true") * weight).otherwise(0.0)
    return runs.agg(
        F.coalesce(F.sum(gain) / F.nullif(F.sum(weight), F.lit(0)), F.lit(0.0)).alias("recall"), F.coalesce(F.median(F.when(ok, F.col("ms"))), F.lit(0.0)).alias("median_ms"),
        F.coalesce(F.avg(F.when(ok, F.col("n_found"))), F.lit(0.0)).alias("per_part"), F.coalesce(F.sum(weight), F.lit(0)).cast("long").alias("n"),
    )


def accepted(trials: DataFrame, base: dict[str, float], target: float, slower: float = 1.25, more: float = 1.35) -> DataFrame:
    """``trials`` ``(setting, recall, median_ms, per_part)`` with ``ok``: the recall reaches the target at no more than
    ``slower`` times the time and ``more`` times the candidates of ``base``; a base of 0 allows any time and 50 candidates."""
    fast = F.lit(True) if base["median_ms"] <= 0 else F.col("median_ms") <= base["median_ms"] * slower
    few = F.col("per_part") <= (base["per_part"] * more if base["per_part"] > 0 else 50)
    return trials.withColumn("ok", (F.col("recall") >= target) & fast & few)


def tune(stages: list[Callable[[dict], DataFrame]], base: dict, target: float, slower: float = 1.25, more: float = 1.35) -> dict:
    """The best setting: each stage makes trials around the best so far, of which the accepted one of largest recall, the
    faster of equal ones, replaces it if it is better; stages end once the target is met. Trials are one aggregate a stage."""
    best, met = dict(base), False
    for stage in stages:
        if met:
            break
        top = accepted(stage(best), base, target, slower, more).filter("ok").orderBy(F.desc(F.round("recall", 6)), "median_ms", "setting").first()
        if top and (top["recall"] > best["recall"] + 1e-6 or (abs(top["recall"] - best["recall"]) <= 1e-6 and top["median_ms"] < best["median_ms"])):
            best = {**top.asDict()}
        met = best["recall"] >= target
    return best


def recall_grid(truth: DataFrame, pairs: DataFrame, tols: list[float], ious: list[float]) -> DataFrame:
    """``(tol, iou, hits, n, recall)`` for every combination, in one pass over the pairs."""
    grid = F.explode(F.array(*[F.struct(F.lit(t).alias("tol"), F.lit(i).alias("iou_min")) for t in tols for i in ious]))
    hit = pairs.select("part_id", "gt_id", "angle", "iou", grid.alias("g")).filter((F.col("angle") <= F.col("g.tol")) & (F.col("iou") >= F.col("g.iou_min")))
    hits = hit.groupBy("g.tol", "g.iou_min").agg(F.count_distinct("part_id", "gt_id").alias("hits"))
    total = truth.agg(F.count("*").alias("n"))
    every = total.select("n", grid.alias("g")).select("n", "g.tol", "g.iou_min")
    out = every.join(hits, ["tol", "iou_min"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return out.select("tol", "iou_min", "hits", "n", F.round(F.col("hits") / F.col("n"), 6).alias("recall"))


def pick(grid: DataFrame, target: float) -> DataFrame:
    """The setting to take: the strictest that reaches the target, else the one of best recall."""
    reached = (F.col("recall") >= target).cast("int")
    return grid.orderBy(F.desc(reached), F.when(reached == 1, F.col("tol")), F.desc("recall"), F.desc("iou_min"), "tol").limit(1)


def staged(truth: DataFrame, pairs: DataFrame, tols: list[float], ious: list[float], start_iou: float) -> list[tuple[str, float, float]]:
    """``(stage, value, recall)``: first the tolerance at ``start_iou``, then the overlap at the tolerance found.

    Each stage takes the best recall of one aggregate, the strictest value among equals.
    """
    first = recall_grid(truth, pairs, tols, [start_iou]).orderBy(F.desc("recall"), "tol").first()
    second = recall_grid(truth, pairs, [first["tol"]], ious).orderBy(F.desc("recall"), F.desc("iou_min")).first()
    return [("tol", first["tol"], first["recall"]), ("iou", second["iou_min"], second["recall"])]


def probe(faces: DataFrame) -> DataFrame:
    """Counters of a part's faces that say why it may have no candidate."""
    c = lambda k: F.count_if(F.col("kind") == k)
    cyl = F.col("kind") == CYLINDER
    return faces.groupBy("part_id").agg(F.count("*").alias("faces"), c("plane").alias("planes"), c(CYLINDER).alias("cylinders"), c(CONE).alias("cones"), F.count_if(cyl & (F.col("radius") < 2)).alias("narrow"), F.count_if(cyl & (F.col("depth") < 5)).alias("shallow"), F.count_if(cyl & (F.col("radius") >= 2) & (F.col("depth") >= 5)).alias("fit"), F.count_if((F.col("ax") == 0) & (F.col("ay") == 0)).alias("upright"))


def stress_holes(seeds: DataFrame, key: str) -> DataFrame:
    """Parameters of synthetic test holes derived from the rows' keys: diameter, depth, tilt and kind by seeded digits."""
    u = lambda tag: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(tag), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    d = 1.5 * F.pow(F.lit(2.0), 5 * u("D"))
    tilt = F.element_at(F.array(*[F.lit(float(t)) for t in (0, 15, 30, 45, 60)]), (F.floor(u("T") * 5) + 1).cast("int"))
    kind = F.when(u("K") < 0.5, "countersink").otherwise("plain")
    rad = F.radians(tilt)
    return seeds.select(F.col(key), F.round(d, 6).alias("D"), F.round(d * (0.5 + 5.5 * u("H")), 6).alias("H"), tilt.alias("tilt"), kind.alias("kind"), F.round(-F.sin(rad), 6).alias("ay"), F.round(F.cos(rad), 6).alias("az"))
