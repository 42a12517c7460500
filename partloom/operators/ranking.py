"""Ranks over groups of any size: one distributed sort, and no group gathered in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partloom.session import materialize


def ranked(df: DataFrame, by: list[str], *order: Column | str, rank: str = "rn", total: str = "m") -> DataFrame:
    """``df`` with each row's position among the rows of its group, from 1, and the size of the group.

    The rows are range-partitioned and sorted by group and order, numbered within their partition, and shifted by the
    rows of the partitions before. Only counts per partition and per group are brought together. The order must not
    leave ties. Null groups are groups of their own.
    """
    low = (1 << 33) - 1
    rows = materialize(df.orderBy(*by, *order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    place = F.shiftright("_at", 33)
    before = rows.groupBy(place.alias("_place")).agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(Window.orderBy("_place")) - F.col("_n")).select("_place", "_before")
    rows = rows.withColumn("_place", place).join(F.broadcast(before), "_place").withColumn("_pos", F.col("_before") + F.col("_at").bitwiseAND(low))
    group = F.struct(*by) if by else F.lit(0)
    sizes = rows.groupBy(group.alias("_same")).agg(F.min("_pos").alias("_first"), F.count("*").alias(total))
    rows = rows.withColumn("_group", group).join(sizes, F.col("_group").eqNullSafe(F.col("_same"))).drop("_group", "_same")
    return rows.withColumn(rank, F.col("_pos") - F.col("_first") + 1).drop("_at", "_place", "_before", "_pos", "_first")
