"""Families: density clusters over neighbour pairs, names of noise and of parts without geometry, repair."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.operators.graph import connected_components, with_ids
from partloom.operators.stats import majority
from partloom.session import materialize


def core_points(pairs: DataFrame, min_samples: int) -> DataFrame:
    """``(id, degree)`` of the points with at least ``min_samples`` neighbours, themselves included."""
    return pairs.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree")).filter(F.col("degree") >= min_samples)


def dbscan(points: DataFrame, pairs: DataFrame, min_samples: int, key: str = "id") -> DataFrame:
    """``(id, label)`` by density: core points that reach each other share a label, border points take the smallest label
    among their core neighbours, others are noise with -1. The label is the smallest id among the core points of a cluster.

    ``pairs`` has both directions and each point with itself (:func:`pairs_within`); ids are longs.
    """
    pairs = materialize(pairs.select("a", "b"), "pairs")
    core = materialize(core_points(pairs, min_samples).select("id"), "core")
    linked = pairs.join(core.withColumnRenamed("id", "a"), "a", "left_semi").join(core.withColumnRenamed("id", "b"), "b", "left_semi")
    comps = connected_components(linked.filter(F.col("a") < F.col("b")).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    label = materialize(core.join(comps, "id", "left").select("id", F.coalesce("component", "id").alias("label")), "labels")
    border = pairs.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
    out = points.select(F.col(key).alias("id")).distinct().join(label, "id", "left").join(border, "id", "left")
    return out.select("id", F.coalesce("label", "near", F.lit(-1)).alias("label"))


def _near_cells(df: DataFrame, axes: list[str], reach: int) -> DataFrame:
    """Rows once for every cell within ``reach`` cells of their own, in ``n_<axis>``."""
    shifts = F.explode(F.array(*[F.struct(*[F.lit(d).alias(f"d_{c}") for c, d in zip(axes, s, strict=True)]) for s in product(range(-reach, reach + 1), repeat=len(axes))]))
    return df.withColumn("_s", shifts).select("*", *[(F.col(f"c_{c}") + F.col(f"_s.d_{c}")).alias(f"n_{c}") for c in axes]).drop("_s")


def _distance(axes: list[str], a: str, b: str) -> Column:
    return F.sqrt(sum(((F.col(f"{a}{c}") - F.col(f"{b}{c}")) * (F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in axes), F.lit(0.0)))


def _looked_at(some: DataFrame, all_points: DataFrame, axes: list[str], eps: float, *keep: str) -> DataFrame:
    """Pairs of ``some`` with all points within ``eps``, through the cells around them."""
    left = _near_cells(some.select(F.col("id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in axes], *[f"c_{c}" for c in axes]), axes, 2).drop(*[f"c_{c}" for c in axes])
    right = all_points.select(F.col("id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in axes], *[F.col(f"c_{c}").alias(f"n_{c}") for c in axes], *keep)
    return left.join(right, [f"n_{c}" for c in axes]).filter(_distance(axes, "a_", "b_") <= eps)


def grid_points(points: DataFrame, axes: list[str], eps: float, key: str = "id") -> DataFrame:
    """Points with their cell, of a side that makes all points of a cell neighbours, and the number of points in it."""
    good = reduce(Column.__and__, [F.col(c).isNotNull() & ~F.isnan(c) for c in axes])
    side = eps / len(axes) ** 0.5 * (1 - 1e-9)
    rows = points.filter(good).select(F.col(key).alias("id"), *axes, *[F.floor(F.col(c) / side).alias(f"c_{c}") for c in axes])
    cells = [f"c_{c}" for c in axes]
    return rows.join(rows.groupBy(*cells).agg(F.count("*").alias("in_cell")), cells)


def grid_core(grid: DataFrame, axes: list[str], eps: float, min_samples: int) -> DataFrame:
    """``grid`` with ``core``. Points of full cells are core as they stand; only those of cells with fewer than
    ``min_samples`` look around, so however dense a place is, the work stays in proportion to the points."""
    thin = grid.filter(F.col("in_cell") < min_samples)
    degree = _looked_at(thin, grid, axes, eps).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))
    return grid.join(degree, "id", "left").withColumn("core", (F.col("in_cell") >= min_samples) | (F.coalesce("degree", F.lit(0)) >= min_samples)).drop("degree")


def grid_dbscan(points: DataFrame, axes: list[str], eps: float, min_samples: int, key: str = "id") -> DataFrame:
    """``(id, label)`` as :func:`dbscan` gives, for points in two or three dimensions, without listing neighbour pairs.

    Core points of a cell belong together, so cells are linked: first by the outermost core points of neighbouring
    cells, then, for the neighbouring cells that are still in different clusters, by those of their core points that can
    reach the box around the other cell's.
    """
    cells = [f"c_{c}" for c in axes]
    grid = materialize(grid_core(grid_points(points, axes, eps, key), axes, eps, min_samples), "grid")
    core = grid.filter("core")
    outer = [f(F.struct(c, "id")).getField("id") for c in axes for f in (F.min, F.max)]
    box = [f(c).alias(f"{n}_{c}") for c in axes for f, n in ((F.min, "lo"), (F.max, "hi"))]
    cell = with_ids(core.groupBy(*cells).agg(F.array_distinct(F.array(*outer)).alias("outer"), *box))
    near = _near_cells(cell.select(F.col("id").alias("src"), *cells), axes, 2).drop(*cells)
    pairs = materialize(near.join(cell.select(F.col("id").alias("dst"), *[F.col(c).alias(f"n_{c[2:]}") for c in cells]), [f"n_{c}" for c in axes]).filter("src < dst").select("src", "dst"), "cell-pairs")

    def linked(some_pairs: DataFrame, members: DataFrame) -> DataFrame:
        m = lambda side, p: members.select(F.col("cell").alias(side), *[F.col(c).alias(f"{p}{c}") for c in axes])
        return some_pairs.join(m("src", "a_"), "src").join(m("dst", "b_"), "dst").filter(_distance(axes, "a_", "b_") <= eps).select("src", "dst").distinct()

    placed = materialize(core.join(cell.select(*cells, F.col("id").alias("cell"), "outer"), cells).select("id", "cell", *axes, F.array_contains("outer", F.col("id")).alias("is_outer")), "core")
    first = materialize(linked(pairs, placed.filter("is_outer")), "links")
    comp = connected_components(first)
    side = lambda name: comp.select(F.col("id").alias(name), F.col("component").alias(f"{name}_c"))
    open_ = pairs.join(side("src"), "src", "left").join(side("dst"), "dst", "left").filter(F.coalesce("src_c", "src") != F.coalesce("dst_c", "dst")).select("src", "dst")

    def facing(some: str, other: str) -> DataFrame:
        """Points of one cell of the open pairs that are within ``eps`` of the box around the other's."""
        far = cell.select(F.col("id").alias(other), *[f"{n}_{c}" for c in axes for n in ("lo", "hi")])
        gap = F.sqrt(sum((F.pow(F.greatest(F.lit(0.0), F.col(f"lo_{c}") - F.col(c), F.col(c) - F.col(f"hi_{c}")), F.lit(2.0)) for c in axes), F.lit(0.0)))
        rows = open_.join(far, other).join(placed.select(F.col("cell").alias(some), *axes), some)
        return rows.filter(gap <= eps * (1 + 1e-9)).select("src", "dst", *[F.col(c).alias(f"{some}_{c}") for c in axes])

    near_ = facing("src", "dst").join(facing("dst", "src"), ["src", "dst"]).filter(_distance(axes, "src_", "dst_") <= eps).select("src", "dst").distinct()
    comp = materialize(connected_components(first.unionByName(near_)), "components")
    label = placed.join(comp.withColumnRenamed("id", "cell"), "cell", "left").select("id", F.coalesce("component", "cell").alias("group"))
    low = label.groupBy("group").agg(F.min("id").alias("label"))
    label = materialize(label.join(low, "group").select("id", "label"), "labels")
    lonely = grid.filter("NOT core")
    border = _looked_at(lonely, core.join(label, "id"), axes, eps, "label").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
    out = points.select(F.col(key).alias("id")).distinct().join(label, "id", "left").join(border, "id", "left")
    return out.select("id", F.coalesce("label", "near", F.lit(-1)).alias("label"))


def manual_eps(cosine_distance: float) -> float:
    """Euclidean radius of unit vectors for a cosine distance."""
    return max(1e-12, 2 * cosine_distance) ** 0.5


def noise_family(label: Column, content_hash: Column, canonical: Column, isolate: bool = True) -> Column:
    """Name of a part that is in no cluster: by the first ten digits of its hash, else of its canonical's SHA-1; or one for all."""
    if not isolate:
        return F.when(label < 0, F.lit("fam_-1"))
    tail = F.when(F.length(content_hash) >= 10, F.substring(content_hash, 1, 10)).otherwise(F.substring(F.sha1(canonical), 1, 10))
    return F.when(label < 0, F.concat(F.lit("fam_iso_"), tail))


def no_geometry_family(content_hash: Column) -> Column:
    return F.concat(F.lit("fam_ch_"), F.substring(F.coalesce(content_hash, F.lit("unknown")), 1, 8))


def repair_families(parts: DataFrame, canonical: str = "duplicate_canonical", family: str = "family_id") -> DataFrame:
    """``parts`` with ``family_fixed``: canonicals with several families take the most frequent one, ties the smallest."""
    many = parts.filter(F.col(canonical).isNotNull()).groupBy(canonical).agg(F.count_distinct(family).alias("_k")).filter("_k > 1").select(canonical)
    major = majority(parts.join(many, canonical, "left_semi"), canonical, family).withColumnRenamed(family, "_major")
    return parts.join(major, canonical, "left").withColumn("family_fixed", F.coalesce("_major", family)).drop("_major")


def family_major(parts: DataFrame, canonical: str = "duplicate_canonical", family: str = "family_id") -> DataFrame:
    """``parts`` with ``family_vote``: the majority family of the canonical, else the part's own."""
    major = majority(parts, canonical, family).withColumnRenamed(family, "_major")
    return parts.join(major, canonical, "left").withColumn("family_vote", F.coalesce("_major", family)).drop("_major")
