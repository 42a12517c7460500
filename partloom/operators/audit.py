"""Integrity, leakage, purity, coverage and balance checks; violations come back as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def _side() -> Column:
    """Calib counts to the train side."""
    return F.when(F.col("subset") == "test", "test").otherwise("train")


def spread_over_sides(members: DataFrame, key: str) -> DataFrame:
    """``(protocol, split_id, key)`` of values of ``key`` that occur in test and in train or calib of one split."""
    rows = members.filter(F.col(key).isNotNull()).groupBy("protocol", "split_id", key)
    both = rows.agg(F.max(_side() == "test").alias("t"), F.max(_side() == "train").alias("r"))
    return both.filter("t and r").select("protocol", "split_id", F.col(key).alias("value"))


def in_several_subsets(members: DataFrame, key: str = "part_id") -> DataFrame:
    """Keys that lie in more than one subset of a split."""
    rows = members.filter(F.col(key).isNotNull()).groupBy("protocol", "split_id", key).agg(F.count_distinct("subset").alias("n_subsets"))
    return rows.filter("n_subsets > 1").select("protocol", "split_id", F.col(key).alias("value"), "n_subsets")


def canonical_leaks(members: DataFrame) -> DataFrame:
    """Canonicals on both sides of a split; ``true_leak`` if a usable content hash is shared across the sides as well."""
    side = members.filter(F.col("canonical").isNotNull()).select("protocol", "split_id", "canonical", "content_hash", _side().alias("side"))
    nominal = spread_over_sides(members, "canonical")
    shared = side.filter(F.col("content_hash").isNotNull()).groupBy("protocol", "split_id", "canonical", "content_hash").agg(F.count_distinct("side").alias("sides"))
    true = shared.filter("sides = 2").select("protocol", "split_id", F.col("canonical").alias("value"), F.lit(True).alias("true_leak")).distinct()
    return nominal.join(true, ["protocol", "split_id", "value"], "left").select("protocol", "split_id", "value", F.coalesce("true_leak", F.lit(False)).alias("true_leak"))


def disjoint_flags(members: DataFrame, *keys: str) -> DataFrame:
    """Per split and key: whether no value lies in two subsets."""
    wide = members.select("protocol", "split_id", "subset", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in keys])).alias("x")).select("protocol", "split_id", "subset", "x.*")
    per = wide.filter(F.col("value").isNotNull()).groupBy("protocol", "split_id", "key", "value").agg(F.count_distinct("subset").alias("n"))
    return per.groupBy("protocol", "split_id", "key").agg((F.max("n") <= 1).alias("disjoint"), F.count_if(F.col("n") > 1).alias("n_shared"))


def many_per_group(df: DataFrame, by: str, value: str) -> DataFrame:
    """Groups with several distinct values, e.g. canonicals with several families."""
    rows = df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count_distinct(value).alias("n_values"), F.count("*").alias("n"))
    return rows.filter("n_values > 1").select(F.col(by).alias("value"), "n_values", "n")


def purity(df: DataFrame, by: str, value: str) -> DataFrame:
    """Groups, pure groups and mean number of values: how far a grouping agrees with another label."""
    per = df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count_distinct(value).alias("k"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_groups"), F.round(F.avg((F.col("k") <= 1).cast("int")), 6).alias("pure_share"), F.round(F.avg("k"), 6).alias("mean_values"), F.max("k").alias("max_values"))


def coverage(expected: DataFrame, present: DataFrame, key: str, *by: str) -> DataFrame:
    """Expected and found keys per group, and the found share."""
    found = present.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_found", F.lit(1))
    rows = expected.join(found, key, "left")
    return rows.groupBy(*by).agg(F.count("*").alias("expected"), F.count("_found").alias("found"), F.round(F.count("_found") / F.count("*"), 6).alias("coverage"))


def balance(per_subset: DataFrame) -> DataFrame:
    """Whether expected = written + none + failed, from columns of these names."""
    return per_subset.withColumn("balanced", F.col("expected") == F.col("written") + F.col("no_cand") + F.col("failed"))


def worst(df: DataFrame, score: str, *ties: str, n: int = 5) -> DataFrame:
    return df.orderBy(score, *ties).limit(n)


def candidate_checks(candidates: DataFrame, *keep: str) -> DataFrame:
    """Broken records: missing id, negative diameter or depth, quality outside 0 to 1, no primitives; ``keep`` names
    further columns to carry along."""
    bad = F.array_compact(F.array(
        F.when(F.col("hole_id").isNull(), F.lit("no_id")),
        F.when(F.col("D0") < 0, F.lit("negative_D0")),
        F.when(F.col("H0") < 0, F.lit("negative_H0")),
        F.when(F.col("q").isNull() | (F.col("q") < 0) | (F.col("q") > 1), F.lit("q_range")),
        F.when(F.col("primitives").isNull() | (F.size("primitives") == 0), F.lit("no_primitives")),
    ))
    return candidates.select("hole_id", *keep, F.explode(bad).alias("problem"))


def verdict(index: DataFrame, recommended: list[str]) -> DataFrame:
    """One row: repeated ids or hashes with several canonicals fail, missing recommended values warn."""
    ids = index.groupBy("part_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_ids"))
    hashes = many_per_group(index.select("content_hash", "duplicate_canonical").distinct(), "content_hash", "duplicate_canonical").agg(F.count("*").alias("split_hashes"))
    gaps = index.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in recommended]).select(F.greatest(*recommended).alias("worst_gap"))
    row = ids.join(F.broadcast(hashes)).join(F.broadcast(gaps))
    state = F.when((F.col("repeated_ids") > 0) | (F.col("split_hashes") > 0), "FAIL").when(F.col("worst_gap") > 0, "PASS_WITH_WARNINGS").otherwise("PASS")
    return row.select("repeated_ids", "split_hashes", F.round("worst_gap", 6).alias("worst_gap"), state.alias("verdict"))


def missing_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    """Wanted columns that a table does not have, in their order; letter case counts."""
    have = set(df.columns)
    return [c for c in wanted if c not in have]


def column_check(df: DataFrame, required: list[str], recommended: list[str]) -> DataFrame:
    """``(column_name, need, present)`` of the columns a table must have and should have."""
    gone = set(missing_columns(df, [*required, *recommended]))
    rows = [(c, need, c not in gone) for need, names in (("required", required), ("recommended", recommended)) for c in names]
    return df.sparkSession.createDataFrame(rows, "column_name string, need string, present boolean")


def oversize(df: DataFrame, by: str, max_fraction: float, max_size: int) -> DataFrame:
    """Groups above ``max(1, min(max_size, fraction of all rows))``."""
    total = df.agg(F.count("*").alias("total"))
    limit = F.greatest(F.lit(1), F.least(F.lit(max_size), F.floor(F.col("total") * max_fraction)))
    return df.groupBy(by).agg(F.count("*").alias("n")).join(F.broadcast(total)).filter(F.col("n") > limit).select(by, "n")


def first_of(df: DataFrame, cap: int, *by: str, order: str) -> DataFrame:
    """At most ``cap`` rows of each group, in order: the capped samples of a report."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= cap).drop("_rank")
