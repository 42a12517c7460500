"""Problem 1: the k most similar vectors of every vector.

Method: score-aware anisotropic quantisation. Residuals to the centres of cells get four-bit codes, one of 16 words for
every two dimensions; the words are fitted so that error along the vector, which moves the inner product most, costs more
than error across it. A query scans the codes: the sum of its table entries, which is its product with the decoded vector,
is compared with what it could at most be off. That bound is tight because the error along the vector is small: an item
with error ``p`` along itself and ``o`` across has a product of at least ``t`` only if the scan gives at least
``t (1 - p) - sqrt(1 - t^2) o``. What passes is reranked by exact products, so the codes lose nothing where they are scanned.

With a least similarity, vectors meet in the places of :mod:`partloom.operators.borders`, which lose no pair. Without one,
they fall into the cells of a k-means fitted on a bounded sample, and the cells near a query are scanned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partloom.operators.borders import SLACK, allowed_distance, planes_for, routed, sides
from partloom.operators.unit_vectors import as_binary, as_matrix, digest, kmeans, nearest, same_rows, sample_vectors, unit_vectors
from partloom.session import materialize, table

WORDS, WIDTH = 16, 2


@dataclass(frozen=True)
class Index:
    """Fitted on a bounded sample: a rotation that spreads the variance over the subspaces, and the codebook
    ``[subspace, word, 2]`` of rotated residuals over the spread of their cell."""

    turn: np.ndarray
    book: np.ndarray
    eta: float


@dataclass(frozen=True)
class Coded:
    """Decoded codes of items, and the error of each along and across its own direction; for the first subspaces alone the
    rotated vectors, their decoded codes, and the length of the error."""

    back: np.ndarray
    along: np.ndarray
    across: np.ndarray
    lead: np.ndarray
    lead_back: np.ndarray
    lead_error: np.ndarray

    def near_lead(self, items: np.ndarray, least: float) -> np.ndarray:
        """Columns whose product with ``(lead, -|lead|^2 / 2, 1)`` of a query is negative where the first subspaces alone
        show that the product is below ``least``: they lie farther apart than the whole vectors may, plus the error."""
        back = self.lead_back[items]
        room = allowed_distance(least) + self.lead_error[items] + SLACK
        return np.column_stack([back, np.ones(len(items)), (room**2 - (back**2).sum(1)) / 2 + SLACK]).astype(np.float32)

    def least(self, item: np.ndarray, t: np.ndarray | float) -> np.ndarray:
        """What a scan gives at least where the product is at least ``t``; for a negative ``t`` there is no bound."""
        return np.where(np.asarray(t) < 0, -np.inf, t * (1 - self.along[item]) - np.sqrt(np.maximum(0.0, 1 - np.square(t))) * self.across[item] - SLACK)


def _subspaces(m: np.ndarray) -> np.ndarray:
    pad = -m.shape[1] % WIDTH
    return np.pad(m, ((0, 0), (0, pad))).reshape(len(m), -1, WIDTH)


def encode(rest: np.ndarray, unit: np.ndarray, book: np.ndarray, eta: float, rounds: int = 1) -> np.ndarray:
    """Four-bit codes of residuals. ``|e|^2 + (eta - 1) (e . unit)^2`` of the whole error ``e`` is lowered one subspace
    at a time, from the nearest words on."""
    r, u = _subspaces(rest), _subspaces(unit)
    n, subs = r.shape[:2]
    codes = np.zeros((n, subs), np.uint8)
    along = np.zeros(n, np.float32)
    square, par = [], []
    rows = np.arange(n)
    for s in range(subs):
        sq = (book[s] * book[s]).sum(1) - 2 * (r[:, s] @ book[s].T)
        pr = (r[:, s] * u[:, s]).sum(1, keepdims=True) - u[:, s] @ book[s].T
        codes[:, s] = sq.argmin(1)
        along += pr[rows, codes[:, s]]
        square.append(sq)
        par.append(pr)
    for _ in range(rounds):
        for s in range(subs):
            other = along - par[s][rows, codes[:, s]]
            codes[:, s] = (square[s] + (eta - 1) * (other[:, None] + par[s]) ** 2).argmin(1)
            along = other + par[s][rows, codes[:, s]]
    return codes


def _fit_words(rest: np.ndarray, unit: np.ndarray, codes: np.ndarray, book: np.ndarray, eta: float) -> np.ndarray:
    """Words that minimise the score-aware loss for given codes: one linear system over all subspaces."""
    r, u = _subspaces(rest), _subspaces(unit)
    subs = r.shape[1]
    size = subs * WORDS * WIDTH
    a, b = np.zeros((size, size)), np.zeros(size)
    at = ((np.arange(subs) * WORDS)[None, :, None] + codes[:, :, None]) * WIDTH + np.arange(WIDTH)
    for i in range(0, len(r), 1024):
        w, uu, rr = at[i : i + 1024], u[i : i + 1024], r[i : i + 1024]
        z = np.zeros((len(w), size), np.float32)
        z[np.arange(len(w))[:, None, None], w] = uu
        a += (eta - 1) * (z.T @ z)
        a[np.arange(size), np.arange(size)] += np.bincount(w.ravel(), minlength=size)
        b += np.bincount(w.ravel(), rr.ravel(), minlength=size) + (eta - 1) * ((uu * rr).sum((1, 2)) @ z)
    a[np.arange(size), np.arange(size)] += 1e-3
    return np.linalg.solve(a, b + 1e-3 * book.ravel()).reshape(book.shape).astype(np.float32)


def _shards(centres: np.ndarray, weight: np.ndarray, most: float) -> np.ndarray:
    """Groups of neighbouring cells of about ``most`` weight each, by halving along the widest direction."""
    out, todo, shard = np.zeros(len(centres), np.int32), [np.arange(len(centres))], 0
    while todo:
        cells = todo.pop()
        if len(cells) == 1 or weight[cells].sum() <= most:
            out[cells] = shard
            shard += 1
            continue
        x = centres[cells] - np.average(centres[cells], axis=0, weights=weight[cells] + 1e-9)
        axis = np.linalg.eigh(x.T @ (x * weight[cells, None]))[1][:, -1]
        order = np.argsort(x @ axis, kind="stable")
        half = np.cumsum(weight[cells][order])
        cut = min(max(1, int(np.searchsorted(half, half[-1] / 2))), len(cells) - 1)
        todo += [cells[order[:cut]], cells[order[cut:]]]
    return out


def fit_cells(sample: np.ndarray, total: int, cell_rows: int = 64, most_cells: int = 4096, shard_rows: int = 12_000) -> tuple[np.ndarray, np.ndarray]:
    """``(centres, shard of each)`` for ``total`` vectors; at most ``most_cells``, and a cell for every 8 vectors of the sample."""
    k = int(np.clip(total // cell_rows, 1, min(most_cells, max(1, len(sample) // 8))))
    centres = kmeans(sample, k)
    weight = np.bincount(nearest(sample, centres), minlength=len(centres)) * (total / max(1, len(sample)))
    return centres, _shards(centres, weight, shard_rows)


def _cells_of(v: np.ndarray, cell_rows: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(centres, cell of each row, spread of each cell)`` of the vectors of one task; the spread is never 0."""
    centres = kmeans(v if len(v) <= 8192 else v[:: len(v) // 8192 + 1], max(1, len(v) // cell_rows), rounds=3)
    own = nearest(v, centres)
    square = ((v - centres[own]) ** 2).sum(1)
    n = np.maximum(1, np.bincount(own, minlength=len(centres)))
    return centres, own, np.sqrt(np.bincount(own, square, minlength=len(centres)) / n + 1e-12).astype(np.float32)


def fit(sample: np.ndarray, threshold: float = 0.3, book_rows: int = 8192) -> Index:
    """Rotation and words from a bounded sample in random order, of which the words take ``book_rows``; ``threshold`` sets
    the weight of error along the vector."""
    dims = sample.shape[1]
    eta = max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))
    spread = sample - sample.mean(0)
    turn = np.ascontiguousarray(np.linalg.eigh(spread.T @ spread)[1][:, ::-1], np.float32)
    part = sample[:book_rows]
    centres, own, scale = _cells_of(part)
    rest, unit = ((part - centres[own]) @ turn) / scale[own, None], part @ turn
    subs = _subspaces(rest)
    book = np.zeros((subs.shape[1], WORDS, WIDTH), np.float32)
    for s in range(subs.shape[1]):
        words = kmeans(subs[:, s], WORDS, rounds=8)
        book[s, : len(words)] = words
    for _ in range(2):
        book = _fit_words(rest, unit, encode(rest, unit, book, eta), book, eta)
    return Index(turn, book, eta)


def coded(v: np.ndarray, index: Index, lead: int = 16) -> Coded:
    """Four-bit codes of the vectors of one task, by residuals to cells of their own, decoded again.

    Each cell scales the words by its spread, so near-equal vectors get codes as different as any others do. ``lead``
    is the number of leading dimensions that a scan looks at first.
    """
    centres, own, scale = _cells_of(v)
    back = np.empty_like(v)
    for i in range(0, len(v), 8192):
        part, c = v[i : i + 8192], own[i : i + 8192]
        codes = encode(((part - centres[c]) @ index.turn) / scale[c, None], part @ index.turn, index.book, index.eta)
        words = np.concatenate([index.book[s][codes[:, s]] for s in range(codes.shape[1])], 1)[:, : v.shape[1]]
        back[i : i + 8192] = centres[c] + (words * scale[c, None]) @ index.turn.T
    error = v - back
    along = np.einsum("nd,nd->n", error, v)
    across = np.sqrt(np.maximum(0, np.einsum("nd,nd->n", error, error) - along**2))
    turned, turned_back = v @ index.turn[:, :lead], back @ index.turn[:, :lead]
    return Coded(back, along, across, turned, turned_back, np.sqrt(((turned - turned_back) ** 2).sum(1)))


def _route(centres: np.ndarray, shard_of: np.ndarray, probes: int, margin: float):
    """Rows for the shards: each vector goes to the shard of its cell, and as a visitor to those of other near cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = 0.5 * (centres**2).sum(1)
        p = min(probes, len(half))
        for b in batches:
            v = as_matrix(b.column("vec"))
            for i in range(0, len(v), 4096):
                x = v[i : i + 4096]
                score = x @ centres.T - half
                cells = np.argpartition(-score, p - 1, axis=1)[:, :p] if p < len(half) else np.tile(np.arange(p), (len(x), 1))
                near = np.take_along_axis(score, cells, 1)
                home = cells[np.arange(len(x)), near.argmax(1)]
                row, col = np.nonzero(near >= near.max(1, keepdims=True) - margin / 2)
                cell = cells[row, col]
                shard = shard_of[cell]
                order = np.lexsort((cell, shard, row))
                row, cell, shard = row[order], cell[order], shard[order]
                first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (shard[1:] != shard[:-1])])
                off = np.append(first, len(row)).astype(np.int32) * 4
                near_cells = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(cell.astype(np.int32).tobytes())])
                here = shard_of[home[row[first]]] == shard[first]
                yield pa.record_batch({
                    "shard": pa.array(shard[first], pa.int32()), "part_id": b.column("part_id").slice(i, len(x)).take(pa.array(row[first])), "vec": as_binary(x[row[first]]),
                    "home": pa.array(np.where(here, home[row[first]], -1), pa.int32()), "near_cells": near_cells,
                })

    return run


_ROUTED = "shard int, part_id string, vec binary, home int, near_cells binary"
_FOUND = "part_id string, other_id string, sim double, copy_of binary"


def _ranges(lengths: np.ndarray) -> np.ndarray:
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _exact(q: np.ndarray, v: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0), *[np.einsum("nd,nd->n", q[a[i : i + 65_536]], v[b[i : i + 65_536]], dtype=np.float64) for i in range(0, len(a), 65_536)]])


def scan(asks: np.ndarray, v: np.ndarray, items: np.ndarray, codes: Coded, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row of asks, item, product)`` of the ``k`` best of ``items`` for each query, of at least ``least``, and some more.

    ``asks`` and ``items`` are rows of ``v``. The codes of the first subspaces are scanned, then all codes of what is left;
    exact products of the best by the codes give the product that others must reach, and only what can reach it is
    multiplied out. Products that differ by less than 1e-6 are all kept.
    """
    rows, found, products = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    back, width = codes.back[items], len(items)
    enough = codes.least(items, least)
    near = codes.near_lead(items, least).T if least > 0 else None
    step = max(16, 4_000_000 // max(1, width))
    for i in range(0, len(asks), step):
        at = asks[i : i + step]
        s = None
        if near is not None:
            lead = codes.lead[at]
            hit = np.flatnonzero(np.column_stack([lead, -(lead**2).sum(1) / 2, np.ones(len(at), np.float32)]).astype(np.float32) @ near >= 0)
            row, col = np.divmod(hit, width)
        if near is None or len(hit) * 16 > len(at) * width:
            s = v[at] @ back.T
            row, col = np.divmod(np.flatnonzero(s >= enough), width)
            sums = s[row, col]
        else:
            sums = np.concatenate([np.zeros(0, np.float32), *[np.einsum("nd,nd->n", v[at[row[j : j + 65_536]]], back[col[j : j + 65_536]]) for j in range(0, len(row), 65_536)]])
            keep = sums >= enough[col]
            row, col, sums = row[keep], col[keep], sums[keep]
        count = np.bincount(row, minlength=len(at))
        full = np.flatnonzero(count > k)
        if len(full):
            if s is None:
                order = np.lexsort((-sums / (1 - codes.along[items[col]]), row))
                start = np.cumsum(count) - count
                best = col[order[start[full][:, None] + np.arange(k)]]
            else:
                best = np.argpartition(-s[full] / (1 - codes.along[items]), k - 1, axis=1)[:, :k]
            exact = _exact(v, v, np.repeat(at[full], k), items[best.ravel()]).reshape(-1, k)
            reach = np.full(len(at), least)
            reach[full] = np.maximum(least, exact.min(1) - 2e-6)
            keep = sums >= codes.least(items[col], reach[row])
            row, col = row[keep], col[keep]
        rows.append(row + i)
        found.append(items[col])
        products.append(_exact(v, v, at[row], items[col]))
    return np.concatenate(rows), np.concatenate(found), np.concatenate(products)


def _first(a: np.ndarray, b: np.ndarray, exact: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` largest products of each query, ties of the rounded ones to the lower item."""
    ranked = np.lexsort((b, -np.round(exact, 6), a))
    keep = ranked[_ranges(np.bincount(a, minlength=n)) < k]
    return a[keep], b[keep], exact[keep]


def scan_cells(v: np.ndarray, codes: Coded, probe_rows: np.ndarray, probe_cells: np.ndarray, items: np.ndarray, cell: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, item, product)`` of the ``k`` best items for each query among all in the cells it probes; ``items`` are
    rows of ``v`` in the cells ``cell``."""
    order = np.argsort(cell, kind="stable")
    count = np.bincount(cell, minlength=int(probe_cells.max(initial=0)) + 1)
    start = np.cumsum(count) - count
    by_cell = np.argsort(probe_cells, kind="stable")
    pr, pc = probe_rows[by_cell], probe_cells[by_cell]
    got = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for cut in np.split(np.arange(len(pc)), np.flatnonzero(pc[1:] != pc[:-1]) + 1):
        if len(cut) and count[pc[cut[0]]]:
            own = items[order[start[pc[cut[0]]] :][: count[pc[cut[0]]]]]
            a, b, exact = scan(pr[cut], v, own, codes, min(k, len(own)), -1.0)
            got.append((pr[cut][a], b, exact))
    return _first(*(np.concatenate(x) for x in zip(*got, strict=True)), k, len(v))


def _search(index: Index, k: int, min_sim: float, copies: int):
    """Rows of a place are all compared; those of a shard with what lies in the cells they probe."""

    def run(t: pa.Table) -> pa.Table:
        v = as_matrix(t.column("vec"))
        names, rank = np.unique(np.array(t.column("part_id").to_pylist(), object).astype(str), return_inverse=True)
        # classes of equal vectors, in the order of their first ids
        cls = same_rows(v)
        low = np.full(cls.max() + 1, len(names))
        np.minimum.at(low, cls, rank)
        cls = np.argsort(np.lexsort((low,)))[cls]
        _, first = np.unique(cls, return_index=True)
        one = v[first]
        if "home" in t.column_names and "near_cells" in t.column_names:
            home = t.column("home").to_numpy()
            probes = [np.frombuffer(x, np.int32) for x in t.column("near_cells").take(pa.array(first)).to_pylist()]
            size = np.array([len(x) for x in probes])
            item_cls = np.flatnonzero(home[first] >= 0)
            a, b, sim = scan_cells(one, coded(one, index), np.repeat(np.arange(len(first)), size), np.concatenate(probes).astype(np.int64), item_cls, home[first[item_cls]], k + 1)
        else:
            item_cls, codes = np.arange(len(first)), coded(one, index)
            got = []
            for asks, items in sides(t.column("place")[0].as_py(), t.column("block").to_numpy()[first]):
                if len(asks) and len(items):
                    a, b, sim = scan(asks, one, items, codes, min(k + 1, len(items)), min_sim)
                    got.append((asks[a], b, sim))
            a, b, sim = _first(*(np.concatenate(x) for x in zip((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), *got, strict=True)), k + 1, len(first))
        sim = np.where(a == b, 1.0, sim)
        if min_sim > -1:
            a, b, sim = a[sim >= min_sim], b[sim >= min_sim], sim[sim >= min_sim]
        # classes to rows: every row of the asking class, the first ids of the class it found
        rows = np.unique(np.stack([cls, rank], 1), axis=0)
        n_rows = np.bincount(rows[:, 0], minlength=len(first))
        start = np.cumsum(n_rows) - n_rows
        held = np.minimum(n_rows, copies)
        wide = np.repeat(np.arange(len(a)), held[b])
        other = rows[start[b[wide]] + _ranges(held[b]), 1]
        asks = np.repeat(np.arange(len(wide)), n_rows[a[wide]])
        one = rows[start[a[wide[asks]]] + _ranges(n_rows[a[wide]]), 1]
        other, s = other[asks], sim[wide[asks]]
        keep = one != other
        one, other, s = one[keep], other[keep], s[keep]
        order = np.lexsort((other, -np.round(s, 6), one))
        one, other, s = one[order], other[order], s[order]
        keep = _ranges(np.bincount(one, minlength=len(names))) < k
        one, other, s = one[keep], other[keep], s[keep]
        full = item_cls[n_rows[item_cls] >= copies]
        many = np.repeat(full, held[full])
        ids = rows[start[many] + _ranges(held[full]), 1]
        marks = [digest(v[first[c]]) for c in many]
        return pa.table({
            "part_id": pa.array([*names[one], *[None] * len(ids)], pa.string()), "other_id": pa.array([*names[other], *names[ids]], pa.string()),
            "sim": pa.array(np.r_[s, np.ones(len(ids))], pa.float64()), "copy_of": pa.array([*[None] * len(one), *marks], pa.binary()),
        })

    return run


def most_similar(vectors: DataFrame, k: int = 10, min_sim: float = -1.0, probes: int = 16, margin: float = 0.16, leaf_rows: int = 48_000, sample_rows: int = 32_768, copies: int = 11) -> DataFrame:
    """``(part_id, other_id, sim)``: for each part the ``k`` most similar other parts with at least ``min_sim``.

    ``vectors`` comes from :func:`unit_vectors`. Ties go to the smaller id; copies of one vector are compared once.
    With a ``min_sim`` nothing is lost: vectors that similar meet in a place, whose codes are scanned in full. Without
    one, cells farther than ``margin`` (squared distance beyond the nearest) or beyond ``probes`` are not scanned; the
    README has the recall against brute force. Codebook, cells and planes are fitted on at most ``sample_rows`` vectors;
    places hold a bounded number of vectors. No vectors give no rows.
    """
    full = vectors.filter(F.col("vec").isNotNull())
    total = full.count()
    if total == 0:
        return vectors.sparkSession.createDataFrame([], "part_id string, other_id string, sim float")
    sample = sample_vectors(vectors, min(sample_rows, max(4096, total // 4)), total)
    index = fit(sample)
    if min_sim > -1:
        planes = planes_for(full.select("part_id", "vec"), total, allowed_distance(min_sim) / 2, leaf_rows, sample_rows)
        rows = routed(full.select("part_id", F.xxhash64("vec").alias("v"), "vec"), planes, "v").drop("home", "v")
        found = rows.repartition(planes.tasks(), "place").groupBy("place").applyInArrow(_search(index, k, min_sim, copies), _FOUND)
    else:
        rows = full.select("part_id", "vec").mapInArrow(_route(*fit_cells(sample, total), probes, margin), _ROUTED)
        found = rows.groupBy("shard").applyInArrow(_search(index, k, min_sim, copies), _FOUND)
    extra = vectors.filter(F.col("copy_of").isNotNull()).select("part_id", "copy_of")
    if not extra.isEmpty():
        found = materialize(found, "found")
        firsts = found.filter(F.col("copy_of").isNotNull()).select("copy_of", "other_id", "sim")
        found = found.filter(F.col("copy_of").isNull()).drop("copy_of").unionByName(extra.distinct().join(firsts, "copy_of").select("part_id", "other_id", "sim"))
    else:
        found = found.filter(F.col("copy_of").isNull()).drop("copy_of")
    best = Window.partitionBy("part_id").orderBy(F.desc(F.round("sim", 6)), "other_id")
    found = found.filter(F.col("part_id") != F.col("other_id")).dropDuplicates(["part_id", "other_id"])
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("rank").withColumn("sim", F.col("sim").cast("float"))


def p1_found(spark, sf_dir: str) -> DataFrame:
    found = most_similar(unit_vectors(table(spark, sf_dir, "signatures")), k=10, min_sim=0.996)
    return found.select(F.least("part_id", "other_id").alias("part_a"), F.greatest("part_id", "other_id").alias("part_b")).distinct()


def p1_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 10 most similar parts of every part, however far."""
    return most_similar(unit_vectors(table(spark, sf_dir, "signatures")), k=10).withColumn("sim", F.round(F.col("sim").cast("double"), 5))
