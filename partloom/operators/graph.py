"""Connected components over edge tables by repeated contraction.

Every round maps vertices to a parent in the same component, rewrites the edges between the parents and drops those
that became loops. Only edges and vertex ids move; nothing is gathered in one task or on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.session import materialize


def star_edges(keyed: DataFrame, key: str = "key", node: str = "id") -> DataFrame:
    """Edges ``(src, dst)`` from the smallest node of each key to its other nodes; null keys link nothing.

    The smallest node comes from a hash aggregate with map-side combine and is joined back, so a key that holds a
    third of all rows is combined before the shuffle and split by the adaptive skew join after it.
    """
    rows = keyed.select(F.col(key).alias("key"), F.col(node).alias("id")).filter(F.col("key").isNotNull())
    hubs = rows.groupBy("key").agg(F.min("id").alias("src"), F.max("id").alias("_top")).filter(F.col("src") != F.col("_top"))
    return rows.join(hubs.drop("_top"), "key").filter(F.col("id") != F.col("src")).select("src", F.col("id").alias("dst"))


def with_ids(names: DataFrame, name: str = "part_id") -> DataFrame:
    """``(name.., id)`` with a unique long id per row, fixed by writing it once to the shared folder."""
    return materialize(names.withColumn("id", F.monotonically_increasing_id()), "nodes")


def both_ways(edges: DataFrame) -> DataFrame:
    pair = F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"))))
    return edges.select(pair.alias("p")).select("p.a", "p.b")


def canonical(edges: DataFrame) -> DataFrame:
    """Distinct undirected edges without loops."""
    return edges.filter(F.col("src") != F.col("dst")).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def hook_to_neighbour(edges: DataFrame, round_no: int, jumps: int = 2) -> DataFrame:
    """``(id, parent)``: the neighbour of smallest mixed id, or itself, followed by pointer jumps.

    Round 0 takes the ids as they are, so stars around their smallest node close at once. Later rounds mix them:
    ``xxhash64`` of one long is a bijection, so mixed ids stay unique, and mixing anew keeps chains of descending ids
    short whatever order the input has.
    """
    def mix(c: Column) -> Column:
        for _ in range(round_no):
            c = F.xxhash64(c)
        return c

    links = both_ways(edges).select(F.col("a").alias("id"), mix(F.col("b")).alias("nb"), F.col("b"))
    low = links.groupBy("id").agg(F.min("nb").alias("nb"), F.min_by("b", "nb").alias("b"))
    parent = low.select("id", F.when(F.col("nb") < mix(F.col("id")), F.col("b")).otherwise(F.col("id")).alias("parent"))
    parent = materialize(parent, "hook")
    up = parent.select(F.col("id").alias("parent"), F.col("parent").alias("up"))
    for _ in range(jumps):
        parent = parent.join(up, "parent").select("id", F.col("up").alias("parent"))
    return parent


def contract(edges: DataFrame, assign: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """``(id, root)`` for every vertex with an edge; ``assign(edges, round)`` gives ``(id, parent)`` of a round.

    ``assign`` may map a vertex to any vertex of its own component; rounds go on until no edge joins two parents.
    """
    edges = materialize(canonical(edges), "edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        step = materialize(assign(edges, len(maps)), "assign")
        maps.append(step)
        a, b = step.select(F.col("id").alias("src"), F.col("parent").alias("pa")), step.select(F.col("id").alias("dst"), F.col("parent").alias("pb"))
        moved = edges.join(a, "src").join(b, "dst").select(F.col("pa").alias("src"), F.col("pb").alias("dst"))
        edges = materialize(canonical(moved), "edges")
    if not maps:
        return edges.select(F.col("src").alias("id"), F.col("dst").alias("root"))
    roots = maps[-1].select("id", F.col("parent").alias("root"))
    for step in reversed(maps[:-1]):
        up = roots.select(F.col("id").alias("parent"), "root")
        roots = step.join(up, "parent", "left").select("id", F.coalesce("root", "parent").alias("root"))
    return roots


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` with ``component`` the smallest id of the component; edges are ``(src, dst)`` longs.

    Null ends and loops are dropped, an empty edge table gives no rows.
    """
    edges = edges.select("src", "dst").filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    return smallest_label(contract(edges, hook_to_neighbour))


def smallest_label(roots: DataFrame) -> DataFrame:
    low = roots.groupBy("root").agg(F.min("id").alias("component"))
    return roots.join(low, "root").select("id", "component")


def tied_groups(keyed: DataFrame, name: str = "part_id", label: str = "grp") -> DataFrame:
    """``(name, label)`` of every row of ``(name, keys)`` that shares a key with another one, directly or through others.

    The label is the smallest name of the group; null and empty lists of keys tie nothing.
    """
    nodes = with_ids(keyed.select(name, "keys"))
    return label_by_name(contract(star_edges(nodes.select("id", F.explode("keys").alias("key"))), hook_to_neighbour), nodes, name, label)


def label_by_name(roots: DataFrame, nodes: DataFrame, name: str, label: str) -> DataFrame:
    """``(name, label)``: each vertex by its name and the smallest name of its component (byte order)."""
    named = roots.join(nodes.select("id", F.col(name)), "id")
    low = named.groupBy("root").agg(F.min(name).alias(label))
    return named.join(low, "root").select(name, label)
