"""Problem 6: train, calib and test splits that keep related records together.

Method: a component table is persisted from run to run. New records are linked to it by their keys, merges are found
by hooking and pointer jumping, components that had a split keep it, new ones fill the deficits of the proportions,
and components that merge parts of different splits are quarantined.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.functions.ids import family_key, key128, part_ref, usable_hash
from partloom.operators.graph import contract, hook_to_neighbour, label_by_name, star_edges, with_ids
from partloom.session import materialize, shared_dir, table

SPLITS = ("train", "calib", "test")


def tie_keys(index: DataFrame) -> DataFrame:
    """``(part_id, keys)`` of the part index: family, canonical part and content hash as 16-byte keys.

    Null, blank and placeholder values tie nothing; rows without a part id are left out, repeated rows give one row.
    """
    keys = F.array(
        key128(F.lit("f"), family_key(F.col("family_id"))),
        key128(F.lit("d"), part_ref(F.col("duplicate_canonical"))),
        key128(F.lit("h"), usable_hash(F.col("content_hash"))),
    )
    rows = index.filter(F.col("part_id").isNotNull()).select("part_id", F.array_compact(keys).alias("keys"))
    return rows.groupBy("part_id").agg(F.array_distinct(F.flatten(F.collect_set("keys"))).alias("keys"))


def update_components(tied: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """``(part_id, unit_id)`` of every part of ``tied`` that stays with another one.

    ``tied`` is ``(part_id, keys)``; ``previous`` is the persisted table ``(part_id, unit_id, ..)``, whose units count
    as one more key, so an update only has to merge what the new keys join. ``unit_id`` is the smallest part id.
    """
    if previous is not None:
        old = previous.select("part_id", F.array(key128(F.lit("u"), F.col("unit_id"))).alias("keys"))
        tied = tied.select("part_id", "keys").unionByName(old).groupBy("part_id").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"))
    nodes = with_ids(tied.select("part_id", "keys"))
    edges = star_edges(nodes.select("id", F.explode("keys").alias("key")))
    return label_by_name(contract(edges, hook_to_neighbour), nodes, "part_id", "unit_id")


def assign_splits(parts: DataFrame, units: DataFrame, proportions=(0.8, 0.1, 0.1), previous: DataFrame | None = None, large: float = 0.001, seed: int = 17) -> DataFrame:
    """``(part_id, unit_id, split, status)`` of every part; parts outside ``units`` are units of their own.

    ``status`` is ``kept`` (the unit had one split in ``previous``), ``new`` or ``quarantined`` (it had several; its
    split is null). New units with at least ``large`` of all parts, of which there can be at most ``1 / large``, are
    dealt one by one to the split with the largest deficit; the others by a hash over the deficits that remain.
    """
    rows = parts.select("part_id").distinct().join(units, "part_id", "left").select("part_id", F.coalesce("unit_id", "part_id").alias("unit_id"))
    before = rows.limit(0).select("part_id", F.lit("").alias("split")) if previous is None else previous.select("part_id", "split").filter(F.col("split").isNotNull()).distinct()
    per_unit = rows.join(before, "part_id", "left").groupBy("unit_id").agg(F.countDistinct("part_id").alias("n"), F.min("split").alias("lo"), F.max("split").alias("hi"))
    state = F.when(F.col("lo").isNull(), "new").when(F.col("lo") == F.col("hi"), "kept").otherwise("quarantined")
    per_unit = materialize(per_unit.select("unit_id", "n", "lo", state.alias("status")), "units")

    held = {r["lo"]: r["n"] for r in per_unit.filter("status = 'kept'").groupBy("lo").agg(F.sum("n").alias("n")).collect()}
    total = per_unit.filter("status <> 'quarantined'").agg(F.sum("n")).first()[0] or 0
    lack = {s: p * total - held.get(s, 0) for s, p in zip(SPLITS, proportions, strict=True)}
    bound = max(2, int(large * total))
    dealt = {}
    for r in per_unit.filter((F.col("status") == "new") & (F.col("n") >= bound)).orderBy(F.desc("n"), "unit_id").toLocalIterator():
        best = max(SPLITS, key=lambda s: lack[s])
        dealt[r["unit_id"]] = best
        lack[best] -= r["n"]
    room = [max(0.0, lack[s]) for s in SPLITS]
    whole = sum(room) or 1.0
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("unit_id")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    small = F.when(u < room[0] / whole, SPLITS[0]).when(u < (room[0] + room[1]) / whole, SPLITS[1]).otherwise(SPLITS[2])
    placed = per_unit.sparkSession.createDataFrame(list(dealt.items()), "unit_id string, dealt string")
    out = per_unit.join(F.broadcast(placed), "unit_id", "left")
    split = F.when(F.col("status") == "kept", F.col("lo")).when(F.col("status") == "new", F.coalesce("dealt", small))
    return rows.join(out.select("unit_id", split.alias("split"), "status"), "unit_id").select("part_id", "unit_id", "split", "status")


def held_out_domains(parts: DataFrame, units: DataFrame, domains: DataFrame, test_domains: int = 2, calib: float = 0.1, seed: int = 17) -> DataFrame:
    """Splits by held-out domain: units with a part of a test domain are test, the others train or calib by hash.

    Test domains are the ``test_domains`` smallest by a seeded hash of their name; null domains hold nothing out.
    """
    rows = parts.select("part_id").distinct().join(units, "part_id", "left").select("part_id", F.coalesce("unit_id", "part_id").alias("unit_id"))
    known = domains.select("part_id", "domain").filter(F.col("part_id").isNotNull() & F.col("domain").isNotNull())
    out = known.select("domain").distinct().orderBy(F.xxhash64(F.lit(seed), "domain"), "domain").limit(test_domains)
    test_units = rows.join(known.join(F.broadcast(out), "domain", "left_semi").select("part_id").distinct(), "part_id", "left_semi").select("unit_id").distinct().withColumn("held", F.lit(True))
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("unit_id")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    split = F.when(F.col("held"), "test").when(u < calib, "calib").otherwise("train")
    return rows.join(test_units, "unit_id", "left").select("part_id", "unit_id", split.alias("split"))


def p6_found(spark, sf_dir: str) -> DataFrame:
    return update_components(tie_keys(table(spark, sf_dir, "part_index_for_split")))


def p6_splits(spark, sf_dir: str) -> DataFrame:
    index = table(spark, sf_dir, "part_index_for_split")
    return assign_splits(index.filter(F.col("part_id").isNotNull()), update_components(tie_keys(index)))


def write_components(parts: DataFrame, path: str) -> None:
    """The component table ``(part_id, unit_id, split, status)`` of a run, for the next one to read."""
    parts.select("part_id", "unit_id", "split", "status").write.mode("overwrite").parquet(path)


def p6_update(spark, sf_dir: str) -> DataFrame:
    """Splits after an update: the files of before 2022 were split first and their component table written; then all files
    come, so components grow, keep their split, are new, or are quarantined where they merge parts of different splits."""
    index = table(spark, sf_dir, "part_index_for_split").filter(F.col("part_id").isNotNull())
    first = index.filter(F.col("file_mtime_utc") < "2022")
    path = f"{shared_dir(spark).rstrip('/')}/partloom-components-{uuid.uuid4().hex}"
    write_components(assign_splits(first, update_components(tie_keys(first))), path)
    previous = spark.read.parquet(path)
    return assign_splits(index, update_components(tie_keys(index), previous), previous=previous)


def p6_domain_splits(spark, sf_dir: str) -> DataFrame:
    index = table(spark, sf_dir, "part_index_for_split")
    return held_out_domains(index.filter(F.col("part_id").isNotNull()), update_components(tie_keys(index)), table(spark, sf_dir, "domains"))
