"""Places for vectors such that any two within a stated distance meet in one of them, and exact searches in the places.

A tree of halving planes is fitted on bounded samples. A vector within half the distance of a plane goes to both sides:
of two vectors that a plane parts, one at least is that close to it, so the pair stays together in some leaf, whatever
the samples were. Leaves too large for their sample are divided again by a sample of their own. A leaf that no plane
divides well, such as a dense family, is cut into blocks, and each pair of blocks is a place. So a place holds a bounded
number of vectors, whatever the table holds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partloom.operators.unit_vectors import as_binary, as_matrix, kmeans, sample_vectors

#: Steps per unit of a component; no unit vector's component exceeds 1.
STEPS = 32_767
#: Float error of a product of two unit vectors, and of a projection, beyond which nothing is rejected.
SLACK = 1e-5
#: Bits of a place for either of its two blocks; a leaf has at most so many blocks.
BLOCK_BITS = 16


def allowed_distance(min_sim: float) -> float:
    """Largest distance of two unit vectors with a product of at least ``min_sim``."""
    return math.sqrt(max(0.0, 2 * (1 - min_sim)))


@dataclass
class Planes:
    """Plane of each node, its offset, and its two children; a child below zero is the leaf ``-1 - child``. ``rows`` is
    the number of vectors expected in each leaf, ``stuck`` marks the leaves that no plane divides well, ``blocks`` is the
    number of blocks of each leaf."""

    normal: np.ndarray
    offset: np.ndarray
    children: np.ndarray
    reach: float
    rows: np.ndarray
    stuck: np.ndarray
    blocks: np.ndarray

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, leaf, home)`` of every leaf each row of ``x`` goes to; ``home`` marks the one on its own side of all planes."""
        rows, leaves, homes = [], [], []
        todo = [(0 if len(self.normal) else -1, np.arange(len(x)), np.ones(len(x), bool))]
        while todo:
            node, at, home = todo.pop()
            if not len(at):
                continue
            if node < 0:
                rows.append(at)
                leaves.append(np.full(len(at), -1 - node, np.int64))
                homes.append(home)
                continue
            gap = x[at] @ self.normal[node] - self.offset[node]
            low, high = gap <= self.reach, gap >= -self.reach
            todo += [(int(self.children[node, 0]), at[low], home[low] & (gap[low] < 0)), (int(self.children[node, 1]), at[high], home[high] & (gap[high] >= 0))]
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        return np.concatenate(rows), np.concatenate(leaves), np.concatenate(homes)

    def places(self, x: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(row, place, block, home)``: the leaves of each row, and where a leaf has blocks every pair of them with the row's own."""
        row, leaf, home = self.leaves(x)
        n = self.blocks[leaf]
        own = (key[row].astype(np.uint64) % n.astype(np.uint64)).astype(np.int64)
        wide = np.repeat(np.arange(len(row)), n)
        other = np.arange(len(wide)) - np.repeat(np.cumsum(n) - n, n)
        row, leaf, home, own = row[wide], leaf[wide], home[wide], own[wide]
        place = (((leaf << BLOCK_BITS) | np.minimum(own, other)) << BLOCK_BITS) | np.maximum(own, other)
        return row, place, own, home


    def tasks(self) -> int:
        """Partitions for the places: some more than places, so that few of them share a task."""
        return int(min(20_000, max(8, 3 * (self.blocks * (self.blocks + 1) // 2).sum())))


def _best_plane(x: np.ndarray, reach: float, axes: int = 16) -> tuple[float, np.ndarray, float]:
    """``(cost, normal, offset)`` of the plane that sends the fewest rows to both sides for what it divides."""
    mid = x - x.mean(0)
    tries = list(np.linalg.eigh(mid.T @ mid)[1][:, ::-1][:, :axes].T)
    ends = kmeans(x, 8, rounds=4)
    tries += [ends[a] - ends[b] for a in range(len(ends)) for b in range(a)]
    best = (math.inf, mid[0], 0.0)
    for a in tries:
        length = float(np.linalg.norm(a))
        if length < 1e-9:
            continue
        at = np.sort(x @ (a / length))
        cut = np.linspace(at[len(at) // 20], at[-1 - len(at) // 20], 128)
        left, right = np.searchsorted(at, cut + reach) / len(at), 1 - np.searchsorted(at, cut - reach) / len(at)
        below = np.clip(np.searchsorted(at, cut) / len(at), 1e-6, 1 - 1e-6)
        cost = np.log(left + right) / -(below * np.log(below) + (1 - below) * np.log(1 - below))
        cost[np.maximum(left, right) > 0.95] = np.inf
        k = int(cost.argmin())
        if cost[k] < best[0]:
            best = (float(cost[k]), a / length, float(cut[k]))
    return best


def fit_planes(sample: np.ndarray, total: int, reach: float, leaf_rows: int, worst: float = 0.8, least: int = 64) -> Planes:
    """Planes for ``total`` vectors, of which those within ``reach`` of a plane go to both sides; leaves of about
    ``leaf_rows`` vectors. A leaf stays larger where any plane would send too many rows to both sides (``worst``, a share
    per halving), or where fewer than ``least`` rows of the sample are left."""
    reach = reach + SLACK
    normal, offset, children, rows, stuck = [], [], [], [], []
    todo = [(sample, None)]
    while todo:
        x, parent = todo.pop()
        cost, held = math.inf, len(x) * total / max(1, len(sample))
        fits = held <= leaf_rows
        if not fits and len(x) >= least:
            cost, a, cut = _best_plane(x[:4096], reach)
        if cost > worst:
            node = -1 - len(rows)
            rows.append(held)
            stuck.append(not fits and len(x) >= least)
        else:
            node = len(normal)
            normal.append(a)
            offset.append(cut)
            children.append([0, 0])
            gap = x @ a - cut
            todo += [(x[gap <= reach], (node, 0)), (x[gap >= -reach], (node, 1))]
        if parent:
            children[parent[0]][parent[1]] = node
    n = len(rows)
    return Planes(np.array(normal, np.float32).reshape(len(normal), sample.shape[1]), np.array(offset, np.float32), np.array(children, np.int64).reshape(-1, 2), reach, np.array(rows), np.array(stuck, bool), np.ones(n, np.int64))


def _graft(planes: Planes, leaf: int, sub: Planes) -> None:
    """Puts a tree in the place of a leaf; its first leaf keeps the number, the others get new ones."""
    base, more = len(planes.normal), len(planes.rows)
    number = np.r_[leaf, more + np.arange(len(sub.rows) - 1)]
    children = np.where(sub.children >= 0, sub.children + base, 0)
    children[sub.children < 0] = -1 - number[-1 - sub.children[sub.children < 0]]
    planes.children[planes.children == -1 - leaf] = base
    planes.normal, planes.offset, planes.children = np.vstack([planes.normal, sub.normal]), np.r_[planes.offset, sub.offset], np.vstack([planes.children, children])
    planes.rows[leaf], planes.stuck[leaf] = sub.rows[0], sub.stuck[0]
    planes.rows, planes.stuck, planes.blocks = np.r_[planes.rows, sub.rows[1:]], np.r_[planes.stuck, sub.stuck[1:]], np.r_[planes.blocks, np.ones(len(sub.rows) - 1, np.int64)]


def _sample_leaves(planes: Planes, wanted: np.ndarray, rows: int) -> Callable:
    """About ``rows`` vectors of each wanted leaf, by a hash."""
    share = np.zeros(len(planes.rows))
    share[wanted] = np.minimum(1.0, rows / np.maximum(1.0, planes.rows[wanted]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, h = as_matrix(b.column("vec")), b.column("h").to_numpy()
            row, leaf, _ = planes.leaves(x)
            keep = (h[row].astype(np.uint64) >> np.uint64(11)).astype(np.float64) / float(1 << 53) < share[leaf]
            yield pa.record_batch({"leaf": pa.array(leaf[keep], pa.int64()), "vec": as_binary(x[row[keep]])})

    return run


def planes_for(vectors: DataFrame, total: int, reach: float, leaf_rows: int, sample_rows: int = 32_768, key: str = "part_id", worst: float = 0.8) -> Planes:
    """:func:`fit_planes` on at most ``sample_rows`` vectors, then on as many of each leaf that its sample was too small to
    divide, until none is left. What the driver holds is a plane for about every ``leaf_rows`` vectors."""
    sample = sample_vectors(vectors.withColumnRenamed(key, "part_id"), min(sample_rows, max(4096, total // 4)), total)
    planes = fit_planes(sample, total, reach, leaf_rows, worst)
    while len(wanted := np.flatnonzero((planes.rows > 2 * leaf_rows) & ~planes.stuck)):
        held, rows = planes, min(8192, sample_rows)
        size = dict(zip(wanted.tolist(), planes.rows[wanted].tolist(), strict=True))

        def fit(t: pa.Table) -> pa.Table:
            leaf = t.column("leaf")[0].as_py()
            p = fit_planes(as_matrix(t.column("vec")), int(size[leaf]), reach, leaf_rows, worst)  # noqa: B023
            return pa.table({"leaf": [leaf], "normal": [p.normal.ravel().tolist()], "offset": [p.offset.tolist()], "children": [p.children.ravel().tolist()], "rows": [p.rows.tolist()], "stuck": [p.stuck.tolist()]},
                            schema=pa.schema([("leaf", pa.int64()), ("normal", pa.list_(pa.float32())), ("offset", pa.list_(pa.float32())), ("children", pa.list_(pa.int64())), ("rows", pa.list_(pa.float64())), ("stuck", pa.list_(pa.bool_()))]))

        drawn = vectors.filter(F.col("vec").isNotNull()).select(F.xxhash64(key, F.lit(97)).alias("h"), "vec").mapInArrow(_sample_leaves(held, wanted, rows), "leaf long, vec binary")
        found = {r["leaf"]: r for r in drawn.groupBy("leaf").applyInArrow(fit, "leaf long, normal array<float>, offset array<float>, children array<long>, rows array<double>, stuck array<boolean>").collect()}
        for leaf in wanted:
            r = found.get(int(leaf))
            if r is None or not r["offset"]:
                planes.stuck[leaf] = True  # no plane divides it, or it has too few vectors and the estimate was wrong
                continue
            n = len(r["offset"])
            _graft(planes, int(leaf), Planes(np.array(r["normal"], np.float32).reshape(n, -1), np.array(r["offset"], np.float32), np.array(r["children"], np.int64).reshape(-1, 2), planes.reach, np.array(r["rows"]), np.array(r["stuck"], bool), np.ones(len(r["rows"]), np.int64)))
    blocks = np.where(planes.rows > 2 * leaf_rows, np.ceil(planes.rows / leaf_rows), 1).astype(np.int64)
    planes.blocks = np.minimum(blocks, 1 << BLOCK_BITS)
    return planes


def opened(vectors: DataFrame, key: str, unpack: Callable) -> DataFrame:
    """``(key, vec)`` with the vectors as ``unpack`` reads them."""
    if unpack is as_matrix:
        return vectors.select(key, "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({key: b.column(key), "vec": as_binary(unpack(b.column("vec")))})

    return vectors.select(key, "vec").mapInArrow(run, f"{key} {vectors.schema[key].dataType.simpleString()}, vec binary")


def steps_of(x: np.ndarray) -> np.ndarray:
    """Vectors in 16-bit steps, half as long as floats."""
    return np.rint(x * STEPS).astype(np.int16)


def from_steps(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    width = len(col[0].as_py()) // 2
    start = np.frombuffer(col.buffers()[1], np.int32)[col.offset]
    return (np.frombuffer(col.buffers()[2], np.int16, len(col) * width, start).reshape(-1, width) / np.float32(STEPS)).astype(np.float32)


def steps_loss(width: int) -> float:
    """Most that a product of two unit vectors changes by their steps."""
    lost = 0.5 / STEPS * math.sqrt(width)
    return 2 * lost + lost * lost + SLACK


def routed(vectors: DataFrame, planes: Planes, key: str, narrow: bool = False, unpack: Callable = as_matrix) -> DataFrame:
    """``(place, block, home, <other columns>, vec)``: the rows of ``vectors`` for every place they go to.

    ``key`` names a column of longs by which a leaf is cut into blocks. With ``narrow`` vectors travel as 16-bit steps,
    and of several rows with one key in a batch one is sent; else they travel as they come, and ``unpack`` reads them.
    """
    others = [c for c in vectors.columns if c != "vec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column(key).to_numpy()
            at = np.unique(k, return_index=True)[1] if narrow else np.arange(len(k))
            x = unpack(b.column("vec"))
            for i in range(0, len(at), 4096):
                part = at[i : i + 4096]
                row, place, block, home = planes.places(x[part], k[part])
                take = pa.array(part[row])
                if narrow:
                    s = np.ascontiguousarray(steps_of(x[part])[row])
                    off = np.arange(len(row) + 1, dtype=np.int32) * (s.shape[1] * 2)
                    vec = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(s.tobytes())])
                else:
                    vec = b.column("vec").take(take)
                yield pa.record_batch({"place": pa.array(place, pa.int64()), "block": pa.array(block.astype(np.int32)), "home": pa.array(home), **{c: b.column(c).take(take) for c in others}, "vec": vec})

    fields = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in others)
    return vectors.mapInArrow(run, f"place long, block int, home boolean, {fields}, vec binary")


def sides(place: int, block: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows to compare with one another in a place: all with all, or one block with the other and back."""
    one, other = (place >> BLOCK_BITS) & ((1 << BLOCK_BITS) - 1), place & ((1 << BLOCK_BITS) - 1)
    if one == other:
        every = np.arange(len(block))
        return [(every, every)]
    a, b = np.flatnonzero(block == one), np.flatnonzero(block == other)
    return [(a, b), (b, a)]


def _pairs_in_place(min_sim: float):
    def run(t: pa.Table) -> pa.Table:
        v, first = np.unique(t.column("v").to_numpy(), return_index=True)
        x = from_steps(t.column("vec").combine_chunks().take(pa.array(first)))
        least = min_sim - steps_loss(x.shape[1])
        a_rows, b_rows = sides(t.column("place")[0].as_py(), t.column("block").to_numpy()[first])[0]
        got = [np.zeros((2, 0), np.int64)]
        step = max(64, 16_000_000 // max(1, len(b_rows)))
        for i in range(0, len(a_rows), step):
            # all with all: only rows further on
            mates = b_rows[i:] if len(a_rows) == len(x) else b_rows
            a, b = np.divmod(np.flatnonzero(x[a_rows[i : i + step]] @ x[mates].T >= least), max(1, len(mates)))
            got.append(np.stack([a_rows[a + i], mates[b]]))
        a, b = np.sort(np.hstack(got), axis=0)
        return pa.table({"a": pa.array(v[a[a < b]]), "b": pa.array(v[b[a < b]])})

    return run


def close_pairs(vectors: DataFrame, min_sim: float, leaf_rows: int = 24_000, sample_rows: int = 32_768) -> DataFrame:
    """Distinct ``(a, b)`` with ``a < b``: hashes of all pairs of different vectors with a product of at least
    ``min_sim``, and a few just below it.

    ``vectors`` has ``part_id`` and ``vec``, unit vectors or null. No pair is lost; a place is compared in full.
    """
    full = vectors.filter(F.col("vec").isNotNull())
    total = full.count()
    if total == 0:
        return vectors.sparkSession.createDataFrame([], "a long, b long")
    planes = planes_for(full.select("part_id", "vec"), total, allowed_distance(min_sim) / 2, leaf_rows, sample_rows)
    rows = routed(full.select(F.xxhash64("vec").alias("v"), "vec"), planes, "v", narrow=True)
    return rows.repartition(planes.tasks(), "place").groupBy("place").applyInArrow(_pairs_in_place(min_sim), "a long, b long").distinct()


def best_columns(q: np.ndarray, v: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """``(row of q, row of v)`` of the ``k`` largest products of each row of ``q`` that are at least ``least``, ties of
    the rounded products to the lower row of ``v``. Where more than ``k`` are left, double precision decides."""
    s = q @ v.T
    row, col = np.divmod(np.flatnonzero(s >= least), max(1, s.shape[1]))
    full = np.flatnonzero(np.bincount(row, minlength=len(s)) > k)
    if not len(full):
        return row, col
    few = ~np.isin(row, full)
    wide = v.T.astype(np.float64)
    rows, cols = [row[few]], [col[few]]
    for i in range(0, len(full), max(1, 4_000_000 // s.shape[1])):
        at = full[i : i + max(1, 4_000_000 // s.shape[1])]
        key = np.rint(q[at].astype(np.float64) @ wide * 1e6).astype(np.int64) * s.shape[1] - np.arange(s.shape[1])
        rows.append(np.repeat(at, k))
        cols.append(np.argpartition(key, s.shape[1] - k, axis=1)[:, s.shape[1] - k :].ravel())
    return np.concatenate(rows), np.concatenate(cols)


def exact_products(q: np.ndarray, v: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0), *[np.einsum("nd,nd->n", q[a[i : i + 65_536]], v[b[i : i + 65_536]], dtype=np.float64) for i in range(0, len(a), 65_536)]])


def _best_in_place(k: int, min_sim: float, unpack: Callable):
    def run(t: pa.Table) -> pa.Table:
        names, first = np.unique(np.array(t.column("part_id").to_pylist(), object).astype(str), return_index=True)
        x = unpack(t.column("vec").combine_chunks().take(pa.array(first)))
        got, sims = [np.zeros((2, 0), np.int64)], [np.zeros(0)]
        for a_rows, b_rows in sides(t.column("place")[0].as_py(), t.column("block").to_numpy()[first]):
            step = max(16, 12_000_000 // max(1, len(b_rows)))
            for i in range(0, len(a_rows), step):
                at = a_rows[i : i + step]
                a, b = best_columns(x[at], x[b_rows], min(k + 1, len(b_rows)), min_sim - SLACK) if len(b_rows) else np.zeros((2, 0), np.int64)
                got.append(np.stack([at[a], b_rows[b]]))
                sims.append(exact_products(x, x, at[a], b_rows[b]))
        (a, b), s = np.hstack(got), np.concatenate(sims)
        keep = (a != b) & (s >= min_sim - 1e-7)
        return pa.table({"part_id": pa.array(names[a[keep]].tolist(), pa.string()), "other_id": pa.array(names[b[keep]].tolist(), pa.string()), "sim": pa.array(s[keep])})

    return run


def best_links(vectors: DataFrame, k: int, min_sim: float, leaf_rows: int = 24_000, sample_rows: int = 32_768, unpack: Callable = as_matrix) -> DataFrame:
    """``(part_id, other_id, sim)``: for each part the ``k`` other parts of largest product of at least ``min_sim``, ties of
    the rounded products to the smaller id. ``vectors`` has unique ``part_id`` and ``vec``, which ``unpack`` reads. No link
    is lost; every place is compared in full."""
    total = vectors.count()
    if total == 0:
        return vectors.sparkSession.createDataFrame([], "part_id string, other_id string, sim double")
    planes = planes_for(opened(vectors, "part_id", unpack), total, allowed_distance(min_sim) / 2, leaf_rows, sample_rows)
    rows = routed(vectors.select("part_id", F.xxhash64("vec").alias("v"), "vec"), planes, "v", unpack=unpack)
    found = rows.repartition(planes.tasks(), "place").groupBy("place").applyInArrow(_best_in_place(k, min_sim, unpack), "part_id string, other_id string, sim double").dropDuplicates(["part_id", "other_id"])
    best = Window.partitionBy("part_id").orderBy(F.desc(F.round("sim", 6)), "other_id")
    return found.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= k).drop("_rank")
