"""Leakage-safe splits: leave one domain out, temporal, temporal per domain, and with banned components.

Input rows have ``part_id, domain, family, grp, ts`` (``grp``: the strong group of a part, itself by default).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partloom.functions.scalars import cut_offs, seeded_order
from partloom.operators.ranking import ranked
from partloom.session import materialize


def folds(parts: DataFrame, min_size: int) -> DataFrame:
    """``(split_id, test_domain)``: the domains of at least ``min_size`` rows, numbered in order of their name."""
    big = parts.filter(F.col("domain").isNotNull()).groupBy("domain").agg(F.count("*").alias("n")).filter(F.col("n") >= min_size)
    return big.select((F.row_number().over(Window.orderBy("domain")) - 1).alias("split_id"), F.col("domain").alias("test_domain"))


def leave_one_domain_out(parts: DataFrame, min_size: int = 50, calib: float = 0.1, seed: int = 42) -> DataFrame:
    """``(split_id, subset, part_id)`` of all folds in one plan.

    Test is the fold's domain. The pool is every other known domain without the strong groups and families of the test
    domain and without ``fam_iso_`` families. Of each pool domain the first families in seeded order, at least one, are
    calib, or where it has no family the first rows; calib takes whole strong groups; the rest is train. Rows without a
    domain belong to no fold.
    """
    rows = materialize(parts.filter(F.col("domain").isNotNull()).select("part_id", "domain", "family", "grp"), "split-rows")
    fold = folds(rows, min_size)
    test = rows.join(F.broadcast(fold), F.col("domain") == F.col("test_domain")).select("split_id", "part_id", "family", "grp")
    every = rows.withColumn("k", F.lit(1)).join(F.broadcast(fold.groupBy(F.lit(1).alias("k")).agg(F.collect_list(F.struct("split_id", "test_domain")).alias("fs"))), "k")
    pool = every.select("part_id", "domain", "family", "grp", F.explode("fs").alias("f")).select("part_id", "domain", "family", "grp", "f.*")
    pool = pool.filter((F.col("domain") != F.col("test_domain")) & ~F.coalesce(F.col("family").startswith("fam_iso_"), F.lit(False)))
    pool = pool.join(test.select("split_id", "grp").distinct(), ["split_id", "grp"], "left_anti")
    pool = materialize(pool.join(test.filter(F.col("family").isNotNull()).select("split_id", "family").distinct(), ["split_id", "family"], "left_anti"), "pool")
    fams = pool.filter(F.col("family").isNotNull()).select("split_id", "domain", "family").distinct()
    few = F.col("rn") <= F.greatest(F.lit(1), F.ceil(F.col("m") * calib))
    chosen = ranked(fams.withColumn("place", seeded_order(F.col("family"), seed=seed)), ["split_id", "domain"], "place", "family").filter(few)
    by_family = pool.join(chosen.select("split_id", "domain", "family"), ["split_id", "domain", "family"], "left_semi").select("split_id", "grp")
    without = pool.join(fams.select("split_id", "domain").distinct(), ["split_id", "domain"], "left_anti").select("split_id", "domain", "grp", "part_id")
    by_row = ranked(without.withColumn("place", seeded_order(F.col("part_id"), seed=seed)), ["split_id", "domain"], "place", "part_id").filter(few).select("split_id", "grp")
    groups = by_family.unionByName(by_row).distinct().withColumn("is_calib", F.lit(True))
    split = pool.join(groups, ["split_id", "grp"], "left").select("split_id", F.when(F.col("is_calib"), "calib").otherwise("train").alias("subset"), "part_id")
    return split.unionByName(test.select("split_id", F.lit("test").alias("subset"), "part_id"))


def _units(parts: DataFrame) -> DataFrame:
    """Dated rows with their unit: family, else strong group, else the part."""
    return parts.filter(F.col("ts").isNotNull()).withColumn("unit", F.coalesce("family", "grp", "part_id"))


def temporal(parts: DataFrame, train: float = 0.5, calib: float = 0.4, relax: float = 0.0, relax_calib: float = 0.6) -> DataFrame:
    """``(part_id, unit, subset)``: units in order of their earliest date, cut into train, calib and test.

    ``fam_iso_`` units go to test; with ``relax`` the earliest share of them leaves it again, ``relax_calib`` of these
    to calib and the others to train. Rows without a date are in no subset.
    """
    rows = _units(parts)
    unit = rows.groupBy("unit").agg(F.min("ts").alias("first")).withColumn("iso", F.col("unit").startswith("fam_iso_"))
    unit = ranked(unit, ["iso"], "first", "unit")
    a, b = cut_offs(F.col("m"), train, calib)
    plain = F.when(F.col("rn") <= a, "train").when(F.col("rn") <= b, "calib").otherwise("test")
    k = F.ceil(F.col("m") * relax)
    freed = F.when(F.col("rn") <= F.ceil(k * relax_calib), "calib").when(F.col("rn") <= k, "train").otherwise("test")
    subset = F.when(F.col("iso"), freed if relax > 0 else F.lit("test")).otherwise(plain)
    return rows.join(unit.select("unit", subset.alias("subset")), "unit").select("part_id", "unit", "subset")


def temporal_per_domain(parts: DataFrame, train: float = 0.5, calib: float = 0.4) -> DataFrame:
    """The temporal cut within each unit's home domain, the first by name that holds it; ``fam_iso_`` units go to test."""
    rows = _units(parts).filter(F.col("domain").isNotNull())
    unit = rows.groupBy("unit").agg(F.min("ts").alias("first"), F.min("domain").alias("home")).withColumn("iso", F.col("unit").startswith("fam_iso_"))
    unit = ranked(unit, ["home", "iso"], "first", "unit")
    a, b = cut_offs(F.col("m"), train, calib)
    subset = F.when(F.col("iso"), "test").when(F.col("rn") <= a, "train").when(F.col("rn") <= b, "calib").otherwise("test")
    return rows.join(unit.select("unit", "home", subset.alias("subset")), "unit").select("part_id", "unit", "home", "subset")


def banned_components(parts: DataFrame, components: DataFrame, min_size: int = 50, calib: float = 0.1, seed: int = 42) -> DataFrame:
    """Leave one domain out where every component seen in test is banned from the pool; calib by seeded order of parts.

    ``components`` is ``(part_id, component)``; a part without one is its own component.
    """
    rows = parts.filter(F.col("domain").isNotNull()).join(components, "part_id", "left").withColumn("component", F.coalesce("component", "part_id"))
    fold = folds(parts, min_size)
    test = rows.join(F.broadcast(fold), F.col("domain") == F.col("test_domain")).select("split_id", "part_id", "component")
    listed = fold.groupBy(F.lit(1).alias("k")).agg(F.collect_list(F.struct("split_id", "test_domain")).alias("fs"))
    pool = rows.withColumn("k", F.lit(1)).join(F.broadcast(listed), "k").select("part_id", "domain", "component", F.explode("fs").alias("f")).select("part_id", "domain", "component", "f.*")
    pool = pool.filter(F.col("domain") != F.col("test_domain")).join(test.select("split_id", "component").distinct(), ["split_id", "component"], "left_anti")
    placed = ranked(pool.select("split_id", "part_id", seeded_order(F.col("part_id"), seed=seed).alias("place")), ["split_id"], "place", "part_id")
    split = placed.select("split_id", F.when(F.col("rn") <= F.floor(F.col("m") * calib), "calib").otherwise("train").alias("subset"), "part_id")
    return split.unionByName(test.select("split_id", F.lit("test").alias("subset"), "part_id"))
