"""Nearest vectors, clusters and cross-split overlap against brute force, and their edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from partloom.llm import ann, density, overlap
from partloom.operators.unit_vectors import BLOCKS, as_matrix, unit_vectors
from partloom.session import table

SCHEMA = "part_id string, source_dataset string, content_hash string, geom_hash string, d2_hist array<double>, bbox_ratio array<double>, surf_hist array<double>, dih_hist array<double>, vec int, shard int"


def _rows(n=80, families=6, seed=1, noise=0.01):
    rng = np.random.default_rng(seed)
    centre = [{c: rng.random(w) + 0.05 for c, w in BLOCKS.items()} for _ in range(families)]
    out = []
    for i in range(n):
        c = centre[i % families]
        f = {k: (v * (1 + rng.normal(0, noise, len(v)))).clip(0.001) for k, v in c.items()}
        out.append((f"p{i:03d}", f"s{i % 3}", None, None, f["d2_hist"].tolist(), f["bbox_ratio"].tolist(), f["surf_hist"].tolist(), f["dih_hist"].tolist(), 1, 2))
    return out


DIRTY = [
    ("n1", "s", None, None, None, [1.0, 1.0], [1.0] * 6, [1.0] * 36, 1, 2),
    ("n2", "s", None, None, [float("nan")] * 64, [1.0, 1.0], [1.0] * 6, [1.0] * 36, 1, 2),
    ("n3", "s", None, None, [0.0] * 64, [1.0, 1.0], [1.0] * 6, [1.0] * 36, 1, 2),
    ("n4", "s", None, None, [1.0] * 64, [1.0, None], [1.0] * 6, [1.0] * 36, 1, 2),
    ("n5", "s", None, None, [], [1.0, 1.0], [1.0] * 6, [1.0] * 36, 1, 2),
    (None, "s", None, None, [1.0] * 64, [1.0, 1.0], [1.0] * 6, [1.0] * 36, 1, 2),
]


def _vectors(rows, skip=()):
    out = {}
    for r in rows:
        if r[0] is None or r in DIRTY:
            continue
        parts = []
        for (c, w), x in zip(BLOCKS.items(), r[4:8], strict=True):
            if c not in skip:
                v = np.zeros(w)
                v[: len(x)] = x
                parts.append(v / np.linalg.norm(v))
        out[r[0]] = np.concatenate(parts) / np.sqrt(len(parts))
    return out


def _top(v, k, least):
    ids = sorted(v)
    m = np.array([v[i] for i in ids])
    s = m @ m.T
    out = {}
    for a in range(len(ids)):
        o = sorted((b for b in range(len(ids)) if b != a and s[a, b] >= least), key=lambda b: (-round(float(s[a, b]), 6), ids[b]))
        out[ids[a]] = [ids[b] for b in o[:k]]
    return out


def test_unit_vectors_drop_what_is_unusable(spark):
    short = ("p9", "s", None, None, [3.0, 4.0], [1.0, 0.0], [1.0] + [0.0] * 5, [2.0], 1, 2)
    t = unit_vectors(spark.createDataFrame([*DIRTY, short, short], SCHEMA)).toArrow()
    assert set(t.column("part_id").to_pylist()) == {"p9"}
    assert np.allclose(as_matrix(t.column("vec"))[0], _vectors([short])["p9"], atol=1e-6)


def test_nearest_with_copies_and_repeats(spark):
    rows = _rows()
    copies = [(f"c{i:03d}", *rows[0][1:]) for i in range(30)]
    scaled = ("z", *rows[1][1:4], [x * 20000 for x in rows[1][4]], *rows[1][5:])
    allrows = rows + copies + [scaled] + rows[:5] + DIRTY
    got = {}
    found = ann.most_similar(unit_vectors(spark.createDataFrame(allrows, SCHEMA).repartition(3)), k=10, min_sim=0.9)
    for r in found.collect():
        got.setdefault(r["part_id"], set()).add(r["other_id"])
    want = _top(_vectors(allrows), 10, 0.9)
    hit = sum(len(got.get(p, set()) & set(w)) for p, w in want.items())
    assert hit >= 0.97 * sum(map(len, want.values()))
    for p in ("c000", "c020", "c029", "p000"):  # ties among copies go to the smaller ids
        assert got[p] == set(want[p])
    assert all(len(v) <= 10 and p not in v for p, v in got.items())


def test_nothing_to_find(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ann.most_similar(unit_vectors(empty)).count() == 0
    assert density.density_clusters(unit_vectors(empty)).count() == 0
    lists = spark.createDataFrame([], "protocol string, split_id int, subset string, part_id string")
    assert overlap.cross_split_cases(overlap.listed_records(empty, lists)).count() == 0
    one = spark.createDataFrame(_rows(1), SCHEMA)
    assert ann.most_similar(unit_vectors(one)).count() == 0


@pytest.mark.parametrize("min_sim", [-1.0, 0.996])
def test_recall_on_the_signatures(spark, min_sim):
    s = table(spark, "/root/testdata/sf0.01", "signatures")
    v = unit_vectors(s)
    t = v.dropDuplicates(["part_id"]).toArrow()
    m, ids = as_matrix(t.column("vec")), t.column("part_id").to_pylist()
    want = _top(dict(zip(ids, m, strict=True)), 10, min_sim)
    got = {}
    for r in ann.most_similar(v, min_sim=min_sim).collect():
        got.setdefault(r["part_id"], set()).add(r["other_id"])
    hit = sum(len(got.get(p, set()) & set(w)) for p, w in want.items())
    assert hit >= (0.9 if min_sim < 0 else 0.999) * sum(map(len, want.values()))


def test_error_along_the_vector_is_kept_small_and_bounds_the_scan():
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(30, 40))[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 40)) * 0.3).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    along = {}
    for threshold in (0.0, 0.3):
        codes = ann.coded(x, ann.fit(x, threshold=threshold))
        along[threshold] = np.abs(codes.along).mean()
    assert along[0.3] < 0.7 * along[0.0]
    s, exact = x @ codes.back.T, x.astype(np.float64) @ x.T
    for t in (0.0, 0.5, 0.9, 0.99):
        a, b = np.nonzero(exact >= t)
        assert (s[a, b] >= codes.least(b, t)).all()
    a, b = np.nonzero(s >= codes.least(np.arange(3000), 0.9))
    assert len(a) < 1.6 * (exact >= 0.9).sum()  # the bound is tight enough to be of use
    for least, k in ((0.9, 5), (-1.0, 5)):
        got = ann._first(*ann.scan(np.arange(500), x, np.arange(3000), codes, k, least), k, 500)
        for i in range(500):
            want = [j for j in np.lexsort((np.arange(3000), -np.round(exact[i], 6)))[:k] if exact[i, j] >= least]
            assert got[1][(got[0] == i) & (got[2] >= least)].tolist() == want


def _clusters(v, least, size):
    ids = sorted(v)
    m = np.array([v[i] for i in ids], np.float32)
    near = m @ m.T >= least
    label = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for a in range(len(ids)):
            low = min(label[b] for b in np.flatnonzero(near[a]))
            if low < label[a]:
                label[a], changed = low, True
    n = np.bincount(label, minlength=len(ids))
    return {(ids[a], ids[label[a]]) for a in range(len(ids)) if n[label[a]] >= size}


def test_clusters_and_medoids(spark):
    rows = _rows(90, 5, noise=0.2) + [(f"c{i:03d}", *_rows()[0][1:]) for i in range(25)]
    v = unit_vectors(spark.createDataFrame([*rows, *rows[:4], *DIRTY], SCHEMA).repartition(2), without=("bbox_ratio",))
    clusters = density.density_clusters(v, 0.96, 8)
    want = _clusters(_vectors(rows, ("bbox_ratio",)), 0.96, 8)
    assert {tuple(r) for r in clusters.select("part_id", "cluster_id").collect()} == want
    for margin in (None, 0.06):  # many small partitions
        parts = density.density_clusters(v, 0.96, 8, margin=margin, shard_rows=20)
        assert {tuple(r) for r in parts.select("part_id", "cluster_id").collect()} == want
    vec = _vectors(rows, ("bbox_ratio",))
    for r in density.medoids(clusters, v, 1).collect():
        mates = [p for p, c in want if c == r["cluster_id"]]
        mean = np.mean([vec[p] for p in mates], axis=0)
        assert vec[r["part_id"]] @ mean >= max(vec[p] @ mean for p in mates) - 1e-3


def test_local_clusters_find_every_link():
    rng = np.random.default_rng(4)
    for scale in (0.05, 0.3, 0.6):
        x = (rng.normal(size=(6, 12))[rng.integers(0, 6, 400)] + rng.normal(size=(400, 12)) * scale).astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        got = density.local_clusters(x, 0.9)
        want = _clusters({f"{i:04d}": r for i, r in enumerate(x)}, 0.9, 1)
        assert {(f"{i:04d}", f"{g:04d}") for i, g in enumerate(got)} == want


def test_cross_split_cases(spark):
    rows = _rows(40, 4, noise=0.02)
    h = "0" * 63
    rows[0] = (*rows[0][:2], f"SHA256:{h}A ", None, *rows[0][4:])
    rows[1] = (*rows[1][:2], f"{h}a", "nan", *rows[1][4:])
    rows[2] = (*rows[2][:2], "nan", f"{h}b", *rows[2][4:])
    rows[3] = (*rows[3][:2], "nan", f" {h}b", None, None, None, None, 1, 2)
    lists = [("a", 0, "train" if i % 2 else ("test" if i % 4 else "calib"), f" ./p{i:03d} ") for i in range(40)]
    lists += [("a", 0, "test", "p001"), ("a", 0, "test", "p001"), ("a", 0, "test", None), ("a", 0, "test", "gone"), ("a", 0, None, "p005"), (None, 0, "train", "p004"), ("b", 1, "train", "p\\003"), ("b", 1, "calib", "p002")]
    s = spark.createDataFrame([*rows, *rows[:3], *DIRTY], SCHEMA)
    cases = overlap.cross_split_cases(overlap.listed_records(s, spark.createDataFrame(lists, "protocol string, split_id int, subset string, part_id string")), 0.996)
    got = {(r["train_part"], r["held_out_part"]) for r in cases.filter("protocol = 'a'").collect()}
    vec = _vectors([r for r in rows if r[4]])
    train, held = {f"p{i:03d}" for i in range(1, 40, 2)}, {f"p{i:03d}" for i in range(0, 40, 2)} | {"p001"}
    want = {(a, b) for a in train for b in held if a == b or (a in vec and b in vec and vec[a] @ vec[b] >= 0.996)} | {("p001", "p000"), ("p003", "p002")}
    assert got == want
    assert cases.filter("coverage < 0 or coverage > 1").count() == 0


def test_shared_runs_share_a_fingerprint():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 50, (1, 120)).astype(np.int32)
    for _ in range(30):
        b = rng.integers(50, 99, (1, 120)).astype(np.int32)
        at = int(rng.integers(0, 120 - 15))
        b[0, at : at + 15] = a[0, at : at + 15]
        fa, fb = overlap.winnow(a, run=8, window=8)[2], overlap.winnow(b, run=8, window=8)[2]
        assert set(fa) & set(fb)


def test_found_queries_on_given_tables(spark, small):
    for f in (ann.p1_found, overlap.p2_found, density.p5_found):
        df = f(spark, small)
        assert df.count() == df.distinct().count() > 0
    assert density.p5_medoids(spark, small).filter(F.col("rank") > 3).count() == 0
