"""Descriptive aggregates: distributions, majority votes, quantiles, null rates, shares, first and repeated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_sizes(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def share_of_all(df: DataFrame, by: str, digits: int = 6) -> DataFrame:
    """``(by, n, pct)``: rows per value and their share of all rows; the total is one small aggregate, not a window over all rows."""
    counts = group_sizes(df, by)
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select(by, "n", F.round(F.col("n") / F.col("total"), digits).alias("pct"))


def top_n(df: DataFrame, value: Column, n: int) -> DataFrame:
    """``(value, n, pct)`` of the ``n`` most frequent cleaned values; shares are of all rows with a value."""
    rows = df.select(F.lower(F.trim(value.cast("string"))).alias("value")).filter(F.col("value").isNotNull())
    return share_of_all(rows, "value").orderBy(F.desc("n"), "value").limit(n)


def binned(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """``(bin, n, pct)`` over ``bins`` equal widths between the extremes; bins are closed on the right, the first on both sides."""
    rows = df.select(value.cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    place = F.when(width == 0, 1).otherwise(F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil((F.col("x") - F.col("lo")) / width))))
    return share_of_all(rows.join(F.broadcast(ends)).select(place.cast("int").alias("bin")), "bin")


def majority(df: DataFrame, by: str, value: str) -> DataFrame:
    """``(by, value)``: the most frequent non-null value of each group, ties to the smallest; a null group has none."""
    counts = df.filter(F.col(by).isNotNull() & F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    best = Window.partitionBy(by).orderBy(F.desc("n"), value)
    return counts.withColumn("rank", F.row_number().over(best)).filter("rank = 1").select(by, value)


def describe(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact p50, p90, p95, p99 of a numeric column."""
    x = F.col(value).cast("double")
    p = F.percentile(x, F.array(*[F.lit(q) for q in (0.5, 0.9, 0.95, 0.99)]))
    out = df.groupBy(*by).agg(F.count(x).alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_samp(x), 4).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), p.alias("p"))
    return out.select(*by, "n", "mean", "std", "min", *[F.round(F.col("p")[i], 4).alias(f"p{q}") for i, q in enumerate((50, 90, 95, 99))], "max")


def null_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column_name, null_rate)`` of each column in one pass."""
    columns = columns or df.columns
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.round(F.col(c), 6).alias("null_rate")) for c in columns]))
    return rates.select(pairs.alias("x")).select("x.*")


def keep_first(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row per key, the first in the given order."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def repeated_rows(df: DataFrame, key: str) -> DataFrame:
    """All rows whose key occurs more than once."""
    many = df.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key)
    return df.join(many, key, "left_semi")


def share_where(df: DataFrame, predicate: Column, *by: str) -> DataFrame:
    """Rows and share of rows that satisfy a predicate, per group."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(predicate, F.lit(False)).cast("int")), 6).alias("share"))


def singleton_share(df: DataFrame, by: str) -> DataFrame:
    """Number of groups and the share of them that have one row."""
    return group_sizes(df.filter(F.col(by).isNotNull()), by).agg(F.count("*").alias("n_groups"), F.round(F.avg((F.col("n") == 1).cast("int")), 6).alias("singleton_share"))


def distinct_per_group(df: DataFrame, by: str, *values: str) -> DataFrame:
    """Rows and distinct non-null values of several columns per group."""
    return df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), *[F.count_distinct(v).alias(f"n_{v}") for v in values])


def monthly(df: DataFrame, ts: str) -> DataFrame:
    month = F.date_format(F.date_trunc("month", F.col(ts)), "yyyy-MM")
    return df.filter(F.col(ts).isNotNull()).groupBy(month.alias("month")).agg(F.count("*").alias("n"))
