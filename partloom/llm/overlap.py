"""Problem 2: records of evaluation splits that come back, same or almost so, in the training split.

Method: a record's content and geometry hash are sequences whose whole length is one window, so their one fingerprint
stands for the hash itself. Winnowed fingerprints of a vector's symbols lose pairs near the fixed threshold, so vectors
meet in the leaves of :mod:`partloom.operators.borders`, which lose none. A pair is aligned symbol by symbol for its coverage:
a vector, turned and cut into steps, gives one symbol per direction. An exact comparison of the vectors decides last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.functions.ids import key128, part_ref, usable_hash
from partloom.operators.borders import close_pairs
from partloom.operators.unit_vectors import BLOCKS, as_binary, as_matrix, joined_unit_vectors
from partloom.session import materialize, table

#: Symbols of a vector: number, step, and length of the runs that are hashed; window of the winnowing.
SYMBOLS, STEP, RUN, WINDOW = 216, 0.02, 6, 8


def directions(dims: int, symbols: int = SYMBOLS, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Seeded orthonormal turns, side by side, and an offset per symbol."""
    rng = np.random.default_rng(seed)
    turns = [np.linalg.qr(rng.normal(size=(dims, dims)))[0] for _ in range(-(-symbols // dims))]
    return np.hstack(turns)[:, :symbols].astype(np.float32), rng.random(symbols).astype(np.float32)


def symbols_of(v: np.ndarray, turns: np.ndarray, offset: np.ndarray, step: float = STEP) -> np.ndarray:
    return np.floor(v @ turns / step + offset).astype(np.int32)


def winnow(symbols: np.ndarray, run: int = RUN, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, position, fingerprint)`` of the hashes that are the minimum of some window, for equally long sequences.

    Two sequences that agree in ``window + run - 1`` symbols in a row share a fingerprint. The position is hashed in
    and kept in the low byte, so equal fingerprints lie at one place.
    """
    n, length = symbols.shape
    grams = length - run + 1
    h = np.zeros((n, grams), np.uint64)
    for j in range(run):
        h = h * np.uint64(0x9E3779B97F4A7C15) + (symbols[:, j : j + grams].astype(np.int64) + (1 << 20)).astype(np.uint64)
    h += np.arange(grams, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    low = np.lib.stride_tricks.sliding_window_view(h, min(window, grams), axis=1).argmin(2) + np.arange(max(1, grams - window + 1))
    chosen = np.zeros((n, grams), bool)
    chosen[np.arange(n)[:, None], low] = True
    row, pos = np.nonzero(chosen)
    fp = (h[row, pos] & ~np.uint64(0xFF)) | (pos % 256).astype(np.uint64)
    return row, pos, fp.view(np.int64)


def members(lists: DataFrame) -> DataFrame:
    """``(part_id, held)``: per listed part its splits with whether it is in train and in calib or test.

    Entries with null or blank ids, protocols or subsets count for nothing; repeated lines count once.
    """
    subset = F.lower(F.trim("subset"))
    rows = lists.select(part_ref(F.col("part_id")).alias("part_id"), "protocol", "split_id", (subset == "train").alias("train"), subset.isin("calib", "test").alias("held_out"))
    rows = rows.filter(F.col("part_id").isNotNull() & F.col("protocol").isNotNull() & F.col("split_id").isNotNull() & (F.col("train") | F.col("held_out")))
    return rows.distinct().groupBy("part_id").agg(F.collect_list(F.struct("protocol", "split_id", "train", "held_out")).alias("held"))


def listed_records(signatures: DataFrame, lists: DataFrame) -> DataFrame:
    """Table ``(part_id, c, g, vec, cls, held)`` of the listed parts: key of either hash, vector and its 16-byte digest."""
    rows = signatures.filter(F.col("part_id").isNotNull()).select("part_id", key128(F.lit("c"), usable_hash(F.col("content_hash"))).alias("c"), key128(F.lit("g"), usable_hash(F.col("geom_hash"))).alias("g"), *BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, ok = joined_unit_vectors(b, BLOCKS)
            none = pa.nulls(b.num_rows, pa.binary())
            vec = pc.if_else(pa.array(ok), as_binary(v), none) if b.num_rows else none
            yield pa.record_batch({**{c: b.column(c) for c in ("part_id", "c", "g")}, "vec": vec})

    out = rows.mapInArrow(run, "part_id string, c binary, g binary, vec binary").join(members(lists), "part_id")
    return materialize(out.withColumn("cls", F.unhex(F.md5("vec"))), "listed")


def aligned(pairs: DataFrame, records: DataFrame, min_sim: float, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``(a, b, coverage)`` by vector digests, of candidate pairs with at least ``min_sim``; coverage is the share of
    equal symbols. The vectors that occur in pairs are picked by a broadcast of their 8-byte hashes if these are at
    most ``broadcast_rows``, else by a shuffled join."""
    pairs = materialize(pairs, "pairs")
    wanted = materialize(pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v"))).distinct(), "wanted")
    pick = F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted
    one = records.filter(F.col("vec").isNotNull()).select(F.xxhash64("vec").alias("v"), "cls", "vec").join(pick, "v", "left_semi").dropDuplicates(["v"])
    left, right = (one.select(F.col("v").alias(k), F.col("cls").alias(f"c{k}"), F.col("vec").alias(f"v{k}")) for k in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b").select("ca", "cb", "va", "vb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = None
        for b in batches:
            if not b.num_rows:
                continue
            x, y = as_matrix(b.column("va")), as_matrix(b.column("vb"))
            turns = turns or directions(x.shape[1])
            sim = np.einsum("nd,nd->n", x, y, dtype=np.float64)
            cover = (symbols_of(x, *turns) == symbols_of(y, *turns)).mean(1)
            at = pa.array(np.flatnonzero(sim >= min_sim - 1e-7))
            yield pa.record_batch({"a": b.column("ca").take(at), "b": b.column("cb").take(at), "coverage": pa.array(cover).take(at)})

    return both.mapInArrow(run, "a binary, b binary, coverage double")


def cross_split_cases(records: DataFrame, min_sim: float = 0.996) -> DataFrame:
    """``(protocol, split_id, train_part, held_out_part, coverage)``: every record of calib or test that comes back in train.

    A case shares a usable content hash, a usable geometry hash or a vector of at least ``min_sim``, or is one part in
    both; the coverage of hashes, equal vectors and one part is 1. ``records`` comes from :func:`listed_records`; no
    records give no cases.
    """
    keys = F.array_compact(F.array("c", "g", "cls", key128(F.lit("p"), F.col("part_id"))))
    rows = records.select("part_id", "held", F.explode(keys).alias("key")).distinct()
    near = aligned(close_pairs(records, min_sim), records, min_sim)
    ends = F.explode(F.array(F.struct(F.col("a").alias("kt"), F.col("b").alias("kh")), F.struct(F.col("b").alias("kt"), F.col("a").alias("kh"))))
    sides = rows.select("part_id", "key", F.explode("held").alias("h")).select("part_id", "key", "h.*")
    same = sides.groupBy("key").agg(F.max("train").alias("t"), F.max("held_out").alias("h")).filter("t and h").select(F.col("key").alias("kt"), F.col("key").alias("kh"), F.lit(1.0).alias("coverage"))
    links = same.unionByName(near.select(ends.alias("e"), "coverage").select("e.*", "coverage"))
    train = sides.filter("train").select(F.col("key").alias("kt"), "protocol", "split_id", F.col("part_id").alias("train_part"))
    held = sides.filter("held_out").select(F.col("key").alias("kh"), "protocol", "split_id", F.col("part_id").alias("held_out_part"))
    cases = links.join(train, "kt").join(held, ["kh", "protocol", "split_id"])
    return cases.groupBy("protocol", "split_id", "train_part", "held_out_part").agg(F.max("coverage").alias("coverage"))


def _records(spark, sf_dir: str) -> DataFrame:
    return listed_records(table(spark, sf_dir, "signatures"), table(spark, sf_dir, "split_lists"))


def p2_found(spark, sf_dir: str) -> DataFrame:
    cases = cross_split_cases(_records(spark, sf_dir))
    return cases.select("protocol", "split_id", F.least("train_part", "held_out_part").alias("part_a"), F.greatest("train_part", "held_out_part").alias("part_b")).distinct()


def p2_coverage(spark, sf_dir: str) -> DataFrame:
    """Per split and source: records held out, those that come back in train, and their mean coverage."""
    records = _records(spark, sf_dir)
    source = table(spark, sf_dir, "signatures").groupBy("part_id").agg(F.min("source_dataset").alias("source"))
    held = records.join(source, "part_id").select("part_id", "source", F.explode("held").alias("h")).filter("h.held_out").select("part_id", "source", "h.protocol", "h.split_id").distinct()
    best = cross_split_cases(records).groupBy("protocol", "split_id", F.col("held_out_part").alias("part_id")).agg(F.max("coverage").alias("coverage"))
    rows = held.join(best, ["protocol", "split_id", "part_id"], "left")
    return rows.groupBy("protocol", "split_id", "source").agg(F.count("*").alias("held_out"), F.count("coverage").alias("leaked"), F.round(F.avg("coverage"), 4).alias("mean_coverage"))
