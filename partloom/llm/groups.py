"""Problem 3: one group id for all records that pairwise matches link directly or through others.

Method: low-diameter decomposition. Every vertex draws an exponential shift; clusters grow from the shifted start
times for a few hops, each cluster becomes one super-vertex, the edges between clusters are decomposed again, and the
assignments of all levels are composed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.functions.ids import key128, part_ref, usable_hash
from partloom.operators.graph import both_ways, contract, label_by_name, star_edges, with_ids
from partloom.session import table


def shifted_growth(beta: float = 0.15, hops: int = 4):
    """Assignment for :func:`contract`: ``hops`` steps of growth from exponentially shifted starts.

    A vertex joins the centre with the largest ``shift - distance``. Shift and centre travel as one long, the shift in
    the high bits with 2**-20 steps and the low bits of a mixed id to break ties, beside the centre's id. Stopping
    early is safe: a centre reaches a vertex only along edges, so a cluster never leaves its component.
    """

    def assign(edges: DataFrame, level: int) -> DataFrame:
        ways = both_ways(edges)
        ids = ways.select("a").distinct()
        one_hop = 1 << 50
        hop = ways.withColumn("d", F.lit(one_hop)).unionByName(ids.select("a", F.col("a").alias("b"), F.lit(0).cast("long").alias("d")))
        u = (F.pmod(F.xxhash64(F.lit(level), F.col("a")), F.lit(1 << 40)) + F.lit(1)) / F.lit(float(1 << 40))
        shift = (-F.log(u) / F.lit(beta) * F.lit(float(1 << 20))).cast("long")
        tie = F.pmod(F.xxhash64(F.col("a"), F.lit(level)), F.lit(1 << 30))
        held = ids.select(F.col("a").alias("id"), (shift * F.lit(1 << 30) + tie).alias("w"), F.col("a").alias("parent"))
        for _ in range(hops):
            sent = hop.join(held, hop.a == held.id).select("b", (F.col("w") - F.col("d")).alias("w"), "parent")
            held = sent.groupBy(F.col("b").alias("id")).agg(F.max_by("parent", "w").alias("parent"), F.max("w").alias("w"))
        return held.select("id", "parent")

    return assign


def link_groups(nodes: DataFrame, edges: DataFrame, name: str = "part_id", label: str = "group_id", beta: float = 0.15, hops: int = 4) -> DataFrame:
    """``(name, label)`` of every linked vertex: ``nodes`` is ``(id, name)``, ``edges`` ``(src, dst)`` over those ids.

    The label is the smallest name of the group. Loops, repeats and both directions of an edge count once; vertices
    without a link to another vertex are not returned; no edges give no rows.
    """
    edges = edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    return label_by_name(contract(edges, shifted_growth(beta, hops)), nodes, name, label)


def part_links(signatures: DataFrame, match_pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of the parts: equal usable content or geometry hashes as stars, and the rows of ``match_pairs``
    whose two sides name known parts. Null or unknown sides, null ids and unusable hashes link nothing."""
    parts = signatures.select("part_id", key128(F.lit("c"), usable_hash(F.col("content_hash"))).alias("c"), key128(F.lit("g"), usable_hash(F.col("geom_hash"))).alias("g")).filter(F.col("part_id").isNotNull())
    nodes = with_ids(parts.distinct().groupBy("part_id").agg(F.collect_set("c").alias("c"), F.collect_set("g").alias("g")))
    keyed = nodes.select("id", F.explode(F.concat("c", "g")).alias("key"))
    ids = nodes.select("part_id", "id")
    pairs = match_pairs.select(part_ref(F.col("part_a")).alias("a"), part_ref(F.col("part_b")).alias("b")).filter("a is not null and b is not null and a <> b")
    pairs = pairs.join(ids.select(F.col("part_id").alias("a"), F.col("id").alias("src")), "a").join(ids.select(F.col("part_id").alias("b"), F.col("id").alias("dst")), "b")
    return ids, star_edges(keyed).unionByName(pairs.select("src", "dst"))


def p3_found(spark, sf_dir: str) -> DataFrame:
    nodes, edges = part_links(table(spark, sf_dir, "signatures"), table(spark, sf_dir, "match_pairs"))
    return link_groups(nodes, edges)
