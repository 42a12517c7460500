"""Problem 5: clusters of mutually similar records, with their size and most typical members.

Method: density clustering. Vectors are reduced by principal axes, space is partitioned by the reduced vectors with
overlapping margins, each partition is clustered by itself on the full vectors, local clusters that share a point are
merged, and medoids represent the result. A point is core from one point on, so a cluster is all that links reach.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partloom.llm.ann import _shards
from partloom.operators.borders import allowed_distance, opened
from partloom.operators.families import local_clusters, packed_vectors
from partloom.operators.graph import contract, hook_to_neighbour, star_edges, with_ids
from partloom.operators.unit_vectors import as_matrix, digest, kmeans, nearest, same_rows, sample_vectors, unit_vectors, unpacked
from partloom.session import materialize, table


def _fit_cells(sample: np.ndarray, total: int, dims: int, cell_rows: int, shard_rows: int, most_cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(axes, centres, shard_of)``: principal axes, cells in the reduced space, and the partition of each cell."""
    spread = sample - sample.mean(0)
    axes = np.ascontiguousarray(np.linalg.eigh(spread.T @ spread)[1][:, ::-1][:, :dims], np.float32)
    low = sample @ axes
    centres = kmeans(low, int(np.clip(total // cell_rows, 1, min(most_cells, max(1, len(sample) // 8)))))
    weight = np.bincount(nearest(low, centres), minlength=len(centres)) * (total / len(sample))
    return axes, centres, _shards(centres, weight, shard_rows)


def _spread(axes: np.ndarray, centres: np.ndarray, shard_of: np.ndarray, margin: float | None, eps: float, unpack: Callable):
    """Each vector goes to the partition of its cell and to every partition with a cell that is hardly farther, or without
    a ``margin`` with a cell whose border to its own is within half of ``eps``: of two linked vectors in different cells
    one at least is that close to the border between them, so each link lies in some partition."""
    apart = None
    if margin is None:
        square = (centres**2).sum(1)
        apart = np.sqrt(np.maximum(0, square[:, None] + square[None] - 2 * (centres @ centres.T))) * (eps / 2 + 1e-5) + 1e-5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = 0.5 * (centres**2).sum(1)
        for b in batches:
            v = unpack(b.column("vec"))
            for i in range(0, len(v), 4096):
                x = v[i : i + 4096]
                score = (x @ axes) @ centres.T - half
                allowed = margin / 2 if apart is None else apart[score.argmax(1)]
                row, cell = np.nonzero(score >= score.max(1, keepdims=True) - allowed)
                pair = np.unique(np.stack([row, shard_of[cell]], 1), axis=0)
                row, shard = pair[:, 0], pair[:, 1]
                shared = np.bincount(row, minlength=len(x))[row] > 1
                yield pa.record_batch({"shard": pa.array(shard, pa.int32()), "part_id": b.column("part_id").slice(i, len(x)).take(pa.array(row)), "vec": b.column("vec").slice(i, len(x)).take(pa.array(row)), "shared": pa.array(shared)})

    return run


def _cluster(min_sim: float, unpack: Callable):
    def run(t: pa.Table) -> pa.Table:
        v = unpack(t.column("vec"))
        cls = same_rows(v)
        _, first = np.unique(cls, return_index=True)
        local = local_clusters(v[first], min_sim)[cls]
        alone = (np.bincount(local, minlength=len(local))[local] == 1) & ~t.column("shared").to_numpy(zero_copy_only=False)
        keep = np.flatnonzero(~alone)
        shard = t.column("shard")[0].as_py() if t.num_rows else 0
        return pa.table({"part_id": t.column("part_id").combine_chunks().take(pa.array(keep)), "local_id": pa.array((np.int64(shard) << 32) + local[keep], pa.int64()), "shared": t.column("shared").combine_chunks().take(pa.array(keep))})

    return run


def density_clusters(vectors: DataFrame, min_sim: float = 0.96, min_size: int = 8, dims: int = 32, margin: float | None = 0.06, shard_rows: int = 12_000, sample_rows: int = 16_384, most_cells: int = 2048) -> DataFrame:
    """``(part_id, cluster_id)`` of the parts in clusters of at least ``min_size``; the id is the smallest part id.

    ``vectors`` comes from :func:`unit_vectors`. Two vectors link if their product is at least ``min_sim``. Partitions
    overlap by ``margin`` (squared distance beyond the nearest cell, in the reduced space, which never lengthens a
    distance). With ``margin`` None they overlap by what a link can span, which loses none and costs more copies. Axes and
    at most ``most_cells`` cells are fitted on at most ``sample_rows`` vectors; a partition is a cell at least, so beyond
    ``most_cells * shard_rows`` vectors both should grow with the table. Copies of one vector are clustered once.
    """
    full = vectors.filter(F.col("vec").isNotNull()).select("part_id", "vec")
    total = full.count()
    if total == 0:
        return vectors.sparkSession.createDataFrame([], "part_id string, cluster_id string")
    return _large(_with_copies(_linked(full, total, min_sim, dims, margin, shard_rows, sample_rows, most_cells), vectors), min_size)


def _linked(rows: DataFrame, total: int, min_sim: float = 0.96, dims: int = 32, margin: float | None = 0.06, shard_rows: int = 12_000, sample_rows: int = 16_384, most_cells: int = 2048, unpack: Callable = as_matrix) -> DataFrame:
    """``(part_id, root)`` of the rows ``(part_id, vec)``, as :func:`density_clusters` links them; some that are alone are left out."""
    sample = sample_vectors(opened(rows, "part_id", unpack), min(sample_rows, max(2048, total // 4)), total)
    axes, centres, shard_of = _fit_cells(sample, total, dims, 128, shard_rows, most_cells)
    kind = rows.schema["part_id"].dataType.simpleString()
    routed = rows.mapInArrow(_spread(axes, centres, shard_of, margin, allowed_distance(min_sim), unpack), f"shard int, part_id {kind}, vec binary, shared boolean")
    tasks = int(min(20_000, max(8, 3 * (shard_of.max() + 1))))  # some more than partitions, so that few of them share a task
    found = materialize(routed.repartition(tasks, "shard").groupBy("shard").applyInArrow(_cluster(min_sim, unpack), f"part_id {kind}, local_id long, shared boolean"), "local")
    roots = contract(star_edges(found.filter("shared"), "part_id", "local_id"), hook_to_neighbour)
    return found.join(roots.withColumnRenamed("id", "local_id"), "local_id", "left").select("part_id", F.coalesce("root", "local_id").alias("root")).distinct()


def _large(merged: DataFrame, min_size: int) -> DataFrame:
    """``(part_id, cluster_id)`` of the roots with at least ``min_size`` parts."""
    sizes = merged.groupBy("root").agg(F.min("part_id").alias("cluster_id"), F.count("*").alias("n")).filter(F.col("n") >= min_size)
    return merged.join(sizes, "root").select("part_id", "cluster_id")


def distinct_clusters(signatures: DataFrame, min_size: int = 8, without: tuple[str, ...] = ("bbox_ratio",)) -> DataFrame:
    """:func:`density_clusters` of the usable parts, where each distinct vector of the table is moved and compared once,
    however many parts have it and wherever their rows lie; a part with several vectors has the one of smallest digest."""
    found = packed_vectors(signatures, by_block=True, without=without)
    members = materialize(found.groupBy("part_id").agg(F.min("cls").alias("cls")), "members")
    classes = with_ids(members.select("cls").distinct(), "cls")
    rows = materialize(found.groupBy("cls").agg(F.min("vec").alias("vec")).join(classes, "cls").select(F.col("id").alias("part_id"), "vec"), "distinct")
    total = rows.count()
    if total == 0:
        return signatures.sparkSession.createDataFrame([], "part_id string, cluster_id string")
    roots = _linked(rows, total, unpack=partial(unpacked, by_block=True, without=without)).withColumnRenamed("part_id", "id")
    # a vector alone may have enough parts of its own
    named = classes.join(roots, "id", "left").select("cls", F.coalesce("root", -1 - F.col("id")).alias("root"))
    return _large(materialize(members.join(named, "cls").select("part_id", "root"), "merged"), min_size)


def _digests(vectors: DataFrame) -> DataFrame:
    """``(part_id, copy_of)``: the digest of each vector, as the parts without one name it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({"part_id": b.column("part_id"), "copy_of": pa.array([digest(x) for x in as_matrix(b.column("vec"))], pa.binary())})

    return vectors.select("part_id", "vec").mapInArrow(run, "part_id string, copy_of binary")


def _with_copies(merged: DataFrame, vectors: DataFrame) -> DataFrame:
    """Adds the parts whose vector was dropped as one of many copies to the cluster of that vector."""
    extra = vectors.filter(F.col("copy_of").isNotNull()).select("part_id", "copy_of").distinct()
    if extra.isEmpty():
        return merged

    marked = _digests(vectors.filter(F.col("vec").isNotNull()))
    root_of = marked.join(extra.select("copy_of").distinct(), "copy_of", "left_semi").groupBy("copy_of").agg(F.min("part_id").alias("part_id")).join(merged, "part_id").select("copy_of", "root")
    return merged.unionByName(extra.join(root_of, "copy_of").select("part_id", "root")).distinct()


def medoids(clusters: DataFrame, vectors: DataFrame, top: int = 3) -> DataFrame:
    """``(cluster_id, n_parts, part_id, rank, typicality)``: the ``top`` members with the largest mean product to all
    members of their cluster. For unit vectors that is the product with the mean vector, so one sum per cluster is enough.
    Parts whose vector was dropped as one of many copies count in the size and in the mean."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = as_matrix(b.column("vec")).astype(np.float64)
            names, code = np.unique(np.array(b.column("cluster_id").to_pylist(), object).astype(str), return_inverse=True)
            sums = np.zeros((len(names), v.shape[1]))
            weight = b.column("weight").to_numpy().astype(np.float64)
            np.add.at(sums, code, v * weight[:, None])
            yield pa.record_batch({"cluster_id": pa.array(names.tolist(), pa.string()), "n": pa.array(np.bincount(code, weight).astype(np.int64)), "total": pa.array(sums.tolist(), pa.list_(pa.float64()))})

    def add_up(t: pa.Table) -> pa.Table:
        total = np.array(t.column("total").to_pylist()).sum(0)
        n = int(np.sum(t.column("n").to_numpy()))
        return pa.table({"cluster_id": t.column("cluster_id").slice(0, 1), "mean": pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.einsum("nd,nd->n", as_matrix(b.column("vec")), as_matrix(b.column("mean"))) if b.num_rows else np.zeros(0)
            yield pa.record_batch({"cluster_id": b.column("cluster_id"), "n_parts": b.column("n_parts"), "part_id": b.column("part_id"), "typicality": pa.array(s, pa.float64())})

    clusters = materialize(clusters, "clusters")
    sizes = clusters.groupBy("cluster_id").agg(F.count_distinct("part_id").alias("n_parts"))
    kept = vectors.filter(F.col("vec").isNotNull()).select("part_id", "vec").dropDuplicates(["part_id"])
    rows = materialize(clusters.join(kept, "part_id"), "members")
    extra = vectors.filter(F.col("copy_of").isNotNull()).select("part_id", "copy_of").distinct().join(kept.select("part_id"), "part_id", "left_anti").groupBy("copy_of").agg(F.count("*").alias("more"))
    extra = materialize(extra, "copies")
    weighed = rows.withColumn("weight", F.lit(1).cast("long"))
    if not extra.isEmpty():
        first = _digests(rows).join(extra, "copy_of").groupBy("copy_of").agg(F.min("part_id").alias("part_id"), F.max("more").alias("more"))
        weighed = rows.join(first.select("part_id", "more"), "part_id", "left").withColumn("weight", 1 + F.coalesce("more", F.lit(0)))
    means = weighed.select("cluster_id", "vec", "weight").mapInArrow(added, "cluster_id string, n long, total array<double>").groupBy("cluster_id").applyInArrow(add_up, "cluster_id string, mean binary").join(sizes, "cluster_id")
    scored = rows.join(means, "cluster_id").select("cluster_id", "n_parts", "part_id", "vec", "mean").mapInArrow(score, "cluster_id string, n_parts long, part_id string, typicality double")
    best = Window.partitionBy("cluster_id").orderBy(F.desc(F.round("typicality", 6)), "part_id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).withColumn("typicality", F.round("typicality", 5))


def _vectors(spark, sf_dir: str) -> DataFrame:
    return unit_vectors(table(spark, sf_dir, "signatures"), without=("bbox_ratio",))


def p5_found(spark, sf_dir: str) -> DataFrame:
    return distinct_clusters(table(spark, sf_dir, "signatures"))


def p5_medoids(spark, sf_dir: str) -> DataFrame:
    """Each cluster with its size and its three most typical parts."""
    vectors = _vectors(spark, sf_dir)
    return medoids(density_clusters(vectors), vectors)
