"""Feature blocks of parts as unit vectors, and bounded samples of them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partloom.session import materialize

#: Feature blocks and their widths.
BLOCKS = {"d2_hist": 64, "bbox_ratio": 2, "surf_hist": 6, "dih_hist": 36}


def block_matrix(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column as ``(matrix, usable)``, short rows filled with zeros; null, NaN, infinite, all-zero or
    overlong rows are not usable."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    lengths = np.asarray(col.value_lengths().fill_null(0))
    flat = np.asarray(col.flatten().cast(pa.float64()).fill_null(np.nan))
    row = np.repeat(np.arange(n), lengths)
    pos = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.zeros((n, width))
    keep = pos < width
    out[row[keep], pos[keep]] = flat[keep]
    finite = np.isfinite(out).all(1)
    out[~finite] = 0
    return out, finite & (lengths <= width) & np.asarray(col.is_valid()) & (out != 0).any(1)


def joined_unit_vectors(batch: pa.RecordBatch, use: dict[str, int], by_block: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """``(vectors, usable)``: each block divided by its length, joined and divided by the root of the number of blocks.

    The dot product of two rows is the mean of the block cosines. Without ``by_block`` the blocks are joined as they are
    and the whole is divided by its length. A row is usable if all of :data:`BLOCKS` are.
    """
    raw, usable = raw_blocks(batch)
    return _joined([raw[name] for name in BLOCKS if name in use], by_block), usable


def raw_blocks(batch: pa.RecordBatch) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """``(matrix by block, usable)``; a row is usable if all of :data:`BLOCKS` are."""
    raw, usable = {}, np.ones(batch.num_rows, bool)
    for name, width in BLOCKS.items():
        raw[name], ok = block_matrix(batch.column(name), width)
        usable &= ok
    return raw, usable


def _joined(blocks: list[np.ndarray], by_block: bool) -> np.ndarray:
    if by_block:
        return (np.hstack([m / np.where((norm := np.sqrt((m * m).sum(1, keepdims=True))) > 0, norm, 1) for m in blocks]) / np.sqrt(len(blocks))).astype(np.float32)
    x = np.hstack(blocks)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return (x / np.where(norm > 0, norm, 1)).astype(np.float32)


#: Values that are whole multiples of one over this travel as 16-bit counts, without loss.
DECIMALS = 20_000


def packed_rows(raw: dict[str, np.ndarray], vec: np.ndarray) -> pa.Array:
    """What :func:`unpacked` makes ``vec`` of again: all blocks as 16-bit counts where these give the very values, else ``vec``."""
    x = np.hstack(list(raw.values()))
    counts = np.rint(np.clip(x, 0, 65_535 / DECIMALS) * DECIMALS)
    exact = (counts / DECIMALS == x).all(1)
    short = counts.astype(np.uint16)
    if exact.all():
        off = np.arange(len(x) + 1, dtype=np.int32) * (short.shape[1] * 2)
        return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(short.tobytes())])
    return pa.array([short[i].tobytes() if exact[i] else vec[i].tobytes() for i in range(len(x))], pa.binary())


def unpacked(col: pa.Array | pa.ChunkedArray, by_block: bool = False, without: tuple[str, ...] = ()) -> np.ndarray:
    """The vectors of rows packed by :func:`packed_rows`, which had vectors of the same ``by_block`` and ``without``."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    full, width = sum(BLOCKS.values()), sum(w for c, w in BLOCKS.items() if c not in without)
    if not len(col):
        return np.zeros((0, width), np.float32)
    short = np.asarray(pc.equal(pc.binary_length(col), 2 * full))
    out = np.empty((len(col), width), np.float32)
    for mine, kind, held in ((short, np.uint16, full), (~short, np.float32, width)):
        if mine.any():
            part = col.filter(pa.array(mine))
            start = np.frombuffer(part.buffers()[1], np.int32)[part.offset]
            x = np.frombuffer(part.buffers()[2], np.uint8, len(part) * held * np.dtype(kind).itemsize, start).view(kind).reshape(-1, held)
            blocks = np.split(x / DECIMALS, np.cumsum(list(BLOCKS.values()))[:-1], axis=1) if kind is np.uint16 else []
            out[mine] = _joined([m for c, m in zip(BLOCKS, blocks, strict=True) if c not in without], by_block) if blocks else x
    return out


def unpacked_double(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The joined blocks of packed rows, divided by their length in double precision."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    width = sum(BLOCKS.values())
    x = np.zeros((len(col), width))
    short = np.asarray(pc.equal(pc.binary_length(col), 2 * width))
    for mine, kind in ((short, np.uint16), (~short, np.float32)):
        if mine.any():
            part = col.filter(pa.array(mine))
            start = np.frombuffer(part.buffers()[1], np.int32)[part.offset]
            raw = np.frombuffer(part.buffers()[2], np.uint8, len(part) * width * np.dtype(kind).itemsize, start).view(kind).reshape(-1, width)
            x[mine] = raw / DECIMALS if kind is np.uint16 else raw
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def as_matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a binary column of float32 vectors of one width."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    buf = col.buffers()
    off = np.frombuffer(buf[1], np.int32)[col.offset : col.offset + n + 1]
    data = np.frombuffer(buf[2], np.uint8)[off[0] : off[-1]] if n else np.zeros(0, np.uint8)
    return data.view(np.float32).reshape(n, -1) if n else np.zeros((0, 1), np.float32)


def as_binary(m: np.ndarray) -> pa.Array:
    m = np.ascontiguousarray(m, np.float32)
    off = np.arange(len(m) + 1, dtype=np.int32) * (m.shape[1] * 4)
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(m.tobytes())])


def unit_vectors(signatures: DataFrame, without: tuple[str, ...] = (), copies: int = 11) -> DataFrame:
    """Table ``(part_id, vec, copy_of)`` of the parts with usable vectors, written once to the shared folder.

    Of a vector that more than ``copies`` parts of some batch have, only the ``copies`` parts of smallest id of all these
    batches carry ``vec``; the others have null there and the first 16 bytes of the vector's digest in ``copy_of``. A
    vector that a third of all rows have so costs a few rows, however large the table. Null ids are left out; a part
    whose row is repeated keeps its rows.
    """
    use = {k: v for k, v in BLOCKS.items() if k not in without}
    rows = signatures.filter(F.col("part_id").isNotNull() & F.col("d2_hist").isNotNull()).select("part_id", *BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, ok = joined_unit_vectors(b, use)
            at = np.flatnonzero(ok)
            ids = b.column("part_id").take(pa.array(at))
            v = np.ascontiguousarray(v[at])
            many, extra = extra_copies(v, np.array(ids.to_pylist(), object), copies)
            none = pa.nulls(len(at), pa.binary())
            vec = as_binary(v) if len(at) else none
            if many.any():
                yield pa.record_batch({"part_id": ids, "vec": pc.if_else(pa.array(extra), none, vec), "copy_of": pa.array([digest(v[i]) if many[i] else None for i in range(len(at))], pa.binary())})
            else:
                yield pa.record_batch({"part_id": ids, "vec": vec, "copy_of": none})

    found = materialize(rows.mapInArrow(run, "part_id string, vec binary, copy_of binary"), "vectors")
    kept = F.col("vec").isNotNull() & F.col("copy_of").isNotNull()
    if found.filter(kept).isEmpty():
        return found
    # what every batch kept of its frequent vectors, brought down to the smallest ids of the table
    place = F.dense_rank().over(Window.partitionBy("copy_of").orderBy("part_id"))
    first = found.filter(kept).withColumn("_place", place)
    first = first.select("part_id", F.when(F.col("_place") <= copies, F.col("vec")).alias("vec"), F.when(F.col("_place") > copies, F.col("copy_of")).alias("copy_of"))
    return materialize(found.filter(~kept).unionByName(first), "vectors")


def digest(vector: np.ndarray) -> bytes:
    return hashlib.blake2b(np.ascontiguousarray(vector, np.float32).tobytes(), digest_size=16).digest()


def same_rows(v: np.ndarray) -> np.ndarray:
    """Class number of each row; equal rows share one."""
    if not len(v):
        return np.zeros(0, np.int64)
    raw = np.ascontiguousarray(v).view(np.dtype((np.void, v.shape[1] * v.itemsize))).ravel()
    return np.unique(raw, return_inverse=True)[1].ravel()


def extra_copies(v: np.ndarray, ids: np.ndarray, copies: int) -> tuple[np.ndarray, np.ndarray]:
    """Marks the rows of vectors that more than ``copies`` parts have, and those of them beyond the smallest ids."""
    many, extra = np.zeros(len(v), bool), np.zeros(len(v), bool)
    cls = same_rows(v)
    for c in np.flatnonzero(np.bincount(cls) > copies) if len(cls) else ():
        at = np.flatnonzero(cls == c)
        own = sorted(set(ids[at]))
        if len(own) > copies:
            first = set(own[:copies])
            many[at] = True
            extra[at] = [ids[i] not in first for i in at]
    return many, extra


def sample_vectors(vectors: DataFrame, rows: int, total: int, seed: int = 7) -> np.ndarray:
    """About ``rows`` vectors chosen by a hash of the part id and in the order of another one, so that any head of them is a
    sample as well; the same ones in every run, never more than twice ``rows``."""
    share = min(1.0, rows / max(1, total))
    pick = vectors.filter(F.col("vec").isNotNull() & (F.pmod(F.xxhash64("part_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))))
    got = pick.select(F.xxhash64("part_id", F.lit(seed + 1)).alias("place"), "vec").limit(2 * rows).toArrow().sort_by("place")
    return as_matrix(got.column("vec")).copy() if got.num_rows else np.zeros((0, 1), np.float32)


def nearest(points: np.ndarray, centres: np.ndarray, block: int = 4096) -> np.ndarray:
    """Index of the nearest centre of each point."""
    half = 0.5 * (centres * centres).sum(1)
    return np.concatenate([(points[i : i + block] @ centres.T - half).argmax(1) for i in range(0, len(points), block)]) if len(points) else np.zeros(0, np.int64)


def kmeans(points: np.ndarray, k: int, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """Centres of a bounded sample by Lloyd's rounds; empty centres move to far points."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(points)))
    centres = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(points, centres)
        n = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        sums = np.add.reduceat(points[order], np.minimum(np.cumsum(n) - n, len(points) - 1), axis=0)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
        if (n == 0).any():
            far = np.argsort(((points - centres[own]) ** 2).sum(1))[-int((n == 0).sum()) :]
            centres[n == 0] = points[far]
    return centres.astype(np.float32)
