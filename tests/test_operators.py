import math
import random
from datetime import date

import numpy as np
from pyspark.sql import functions as F

from partloom.functions import scalars as S
from partloom.functions import vectors as V
from partloom.functions.ids import family_key, part_ref, usable_hash
from partloom.operators import audit, candidates, cluster, shapes, simjoin, splits, stats
from partloom.operators.graph import tied_groups


def _one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_keys(spark):
    h = "ab" * 32
    rows = [(f" SHA256:{h.upper()} ", h), (h, h), (h[:-1], None), ("nan", None), ("", None), (None, None)]
    df = spark.createDataFrame(rows, "a string, want string").select(usable_hash(F.col("a")).alias("got"), "want")
    assert all(r["got"] == r["want"] for r in df.collect())
    refs = [(" ./a/b.stp ", "a/b.stp"), (".\\a\\b.stp", "a/b.stp"), ("A/b", "A/b"), ("  ", None), (None, None)]
    assert all(r["got"] == r["want"] for r in spark.createDataFrame(refs, "a string, want string").select(part_ref(F.col("a")).alias("got"), "want").collect())
    fams = [(" Fam_1 ", "fam_1"), ("fam_-1", None), ("FAM_-1", None), (" ", None), (None, None)]
    assert all(r["got"] == r["want"] for r in spark.createDataFrame(fams, "a string, want string").select(family_key(F.col("a")).alias("got"), "want").collect())


def test_dates_and_tokens(spark):
    rows = [("2021-03-04", date(2021, 3, 4)), ("2021-3-4", date(2021, 3, 4)), ("x 20210304 y", date(2021, 3, 4)), ("04-03-2021", date(2021, 3, 4)), ("2021-02-30", None), ("x", None), (None, None), ("1999-01-01", None)]
    assert [r["d"] for r in spark.createDataFrame(rows, "a string, w date").select(S.date_from_text(F.col("a")).alias("d")).collect()] == [w for _, w in rows]
    more = [("2021-13-40/2022-05-06", date(2022, 5, 6)), ("04/03/2021", date(2021, 3, 4)), ("2021-05-31", date(2021, 5, 31)), ("2021-02-30 20200102", date(2020, 1, 2))]
    assert [r["d"] for r in spark.createDataFrame(more, "a string, w date").select(S.date_from_text(F.col("a")).alias("d")).collect()] == [w for _, w in more]
    told = [("2021-03-04", date(2021, 3, 4)), ("2021-3-4", date(2021, 3, 4)), ("2021/03/04 05:06:07", date(2021, 3, 4)), ("04-03-2021", date(2021, 3, 4)), ("04/03/2021", date(2021, 3, 4)), ("20210304", date(2021, 3, 4)),
            ("2021-02-30", None), ("x", None), (None, None), ("04/13/2021 5:06", date(2021, 4, 13)), ("Thu, 12 Oct 2023 07:31:57 +0100", date(2023, 10, 12)), ("20131125T203407Z", date(2013, 11, 25)), ("1590101025", None), ("2021-03-04T05:06:07.5+02:00", date(2021, 3, 4))]
    assert [r["d"] for r in spark.createDataFrame(told, "a string, w date").select(S.explicit_date(F.col("a")).alias("d")).collect()] == [w for _, w in told]
    heads = [("2021-03-04T05:06:07+02:00", "2021-03-04T03:06:07+00:00"), ("2021-03-04 05:06", "2021-03-04T05:06:00"), ("20210304T050607", "2021-03-04T05:06:07"), ("2021-03-04", "2021-03-04T00:00:00"), ("2021-02-30T00:00:00", None), ("4/3/2021", None), (None, None)]
    assert [r["d"] for r in spark.createDataFrame(heads, "a string, w string").select(S.header_datetime(F.col("a")).alias("d")).collect()] == [w for _, w in heads]
    assert round(S.tolerance_degrees(0.995), 2) == 5.73 and S.tolerance_degrees(2) == 0
    toks = [("  Solid Works! ", "solid_works-"), ("", "NA"), (None, "NA"), ("NaN", "NA")]
    assert [r["t"] for r in spark.createDataFrame(toks, "a string, w string").select(S.sanitize_token(F.col("a")).alias("t")).collect()] == [w for _, w in toks]
    day, tag = S.dated([F.lit("2021/03/04 05:06:07")], F.lit("p/2020-01-01/f"))
    assert _one(spark, tag) == "explicit" and _one(spark, day) == date(2021, 3, 4)
    day, tag = S.dated([F.lit("?")], F.lit("p/2020-01-01/f"))
    assert (_one(spark, day), _one(spark, tag)) == (date(2020, 1, 1), "path")
    day, tag = S.dated([F.lit(None).cast("string")], None, F.lit("2019-05-05").cast("date"))
    assert _one(spark, tag) == "dataset_map"


def test_header(spark):
    text = "ISO-10303-21; HEADER; FILE_NAME('a.stp','2020-01-02T03:04:05',('Ann','Bob'),(''),'pre','SolidWorks 2020','ok'); FILE_SCHEMA(('AP214'));"
    assert _one(spark, S.step_header(F.lit(text))).asDict() == {"created": "2020-01-02T03:04:05", "authors": "Ann|Bob", "system": "SolidWorks 2020", "schema": "AP214"}
    assert _one(spark, S.guess_kernel(F.lit("STEP"), F.lit("SolidWorks"))) == "Parasolid"
    assert _one(spark, S.infer_unit(F.lit("SI_UNIT(.MILLI.,.METRE.)"))) == "mm"
    assert _one(spark, S.classify_error(F.lit("TooLong: timeout"))) == "timeout"


def test_cut_offs(spark):
    for m, want in {1: (1, 0, 0), 2: (1, 1, 0), 3: (1, 1, 1), 4: (2, 1, 1), 10: (5, 4, 1)}.items():
        a, b = S.cut_offs(F.lit(m).cast("long"), 0.5, 0.4)
        a, b = min(m, _one(spark, a)), min(m, _one(spark, b))
        assert (a, b - a, m - b) == want


def test_wilson(spark):
    lo, hi = S.wilson(F.lit(0), F.lit(0))
    assert (_one(spark, lo), _one(spark, hi)) == (0.0, 0.0)
    lo, hi = S.wilson(F.lit(5), F.lit(10))
    assert 0.23 < _one(spark, lo) < 0.24 and 0.76 < _one(spark, hi) < 0.77


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], None), ([0.0, 0.0], [1.0])], "a array<double>, b array<double>")
    r = df.select(V.unit(F.col("a")).alias("u"), V.packed({"a": 3, "b": 2}).alias("p"), V.block_normed({"a": 2, "b": 1}).alias("n")).collect()
    assert np.allclose(r[0]["u"], [0.6, 0.8]) and r[1]["u"] == [0, 0]
    assert r[0]["p"] == [3, 4, 0, 0, 0] and r[1]["p"] == [0, 0, 0, 1, 0]
    assert math.isclose(np.linalg.norm(r[0]["n"]), 1, rel_tol=1e-6)
    assert _one(spark, V.chebyshev(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(1.5), F.lit(2.1)))) == 0.5


def test_majority_and_repair(spark):
    rows = [("1", "c", "b"), ("2", "c", "a"), ("3", "c", "a"), ("4", "c", "b"), ("5", "d", "z"), ("6", None, "q"), ("7", "c", None)]
    got = {r["part_id"]: r["family_fixed"] for r in cluster.repair_families(spark.createDataFrame(rows, "part_id string, duplicate_canonical string, family_id string")).collect()}
    assert got == {"1": "a", "2": "a", "3": "a", "4": "a", "5": "z", "6": "q", "7": "a"}
    empty = spark.createDataFrame([], "part_id string, duplicate_canonical string, family_id string")
    assert cluster.repair_families(empty).count() == 0 and stats.null_rates(empty).count() == 3


def _dbscan(points, eps, least):
    n = len(points)
    near = [[j for j in range(n) if math.dist(points[i], points[j]) <= eps] for i in range(n)]
    core = [len(x) >= least for x in near]
    label = [-1] * n
    for i in range(n):
        if core[i] and label[i] == -1:
            todo, label[i] = [i], i
            while todo:
                for j in near[todo.pop()]:
                    if core[j] and label[j] == -1:
                        label[j] = i
                        todo.append(j)
    return {i: label[i] if core[i] else min([label[j] for j in near[i] if core[j]], default=-1) for i in range(n)}


def test_dbscan_as_in_sequence(spark):
    rng = random.Random(3)
    for least in (1, 3, 4):
        pts = [(rng.choice([0, 1, 2]) + rng.gauss(0, 0.15), rng.gauss(0, 0.15)) for _ in range(45)] + [(9.0, 9.0)]
        df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "id long, x double, y double")
        pairs = simjoin.pairs_within(df, "id", ["x", "y"], 0.2)
        got = {r["id"]: r["label"] for r in cluster.dbscan(df, pairs, least).collect()}
        assert got == _dbscan(pts, 0.2, least)
        assert {r["id"]: r["label"] for r in cluster.grid_dbscan(df, ["x", "y"], 0.2, least).collect()} == got
        want = {i: sum(math.dist(p, q) <= 0.2 for q in pts) for i, p in enumerate(pts)}
        for block in (20_000, 7):
            assert {r["id"]: r["degree"] for r in simjoin.degrees_within(df, "id", ["x", "y"], 0.2, block=block).collect()} == want
    dirty = spark.createDataFrame([(1, None, 0.0), (2, float("nan"), 0.0), (3, 0.0, 0.0), (3, 0.0, 0.0)], "id long, x double, y double")
    assert {r["id"]: r["label"] for r in cluster.grid_dbscan(dirty, ["x", "y"], 0.2, 5).collect()} == {1: -1, 2: -1, 3: -1}
    assert cluster.grid_dbscan(df.limit(0), ["x", "y"], 0.2, 2).count() == 0


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (99, None), (5, x[5].tolist())], "k long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in simjoin.nearest_of_queries(df.filter("k % 10 = 0"), df, "k", "v", 4, block=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["other_id"]))
    for q in range(0, 60, 10):
        s = u @ u[q]
        s[q] = -2
        assert [b for _, b in sorted(got[q])] == list(np.argsort(-s)[:4])
    assert simjoin.nearest_of_queries(df.limit(0), df, "k", "v", 4).count() == 0


def _parts(spark):
    rows = [(f"p{i}", f"d{i % 3}", f"f{i % 7}" if i % 5 else None, f"g{i % 11}", date(2020, 1, 1 + i % 28) if i % 6 else None) for i in range(90)]
    rows += [("q1", None, "f1", "q1", date(2020, 2, 1)), ("q2", "tiny", "f9", "q2", None), ("q3", "d0", "fam_iso_1", "q3", date(2020, 2, 2))]
    return spark.createDataFrame(rows, "part_id string, domain string, family string, grp string, ts date")


def test_lodo_keeps_groups_apart(spark):
    parts = _parts(spark)
    m = splits.leave_one_domain_out(parts, 10, 0.2).join(parts, "part_id").collect()
    folds = {r["split_id"] for r in m}
    assert folds == {0, 1, 2}
    for k in folds:
        test = [r for r in m if r["split_id"] == k and r["subset"] == "test"]
        fit = [r for r in m if r["split_id"] == k and r["subset"] != "test"]
        assert len({r["domain"] for r in test}) == 1
        assert not {r["grp"] for r in test} & {r["grp"] for r in fit}
        assert not ({r["family"] for r in test} & {r["family"] for r in fit}) - {None}
        assert not any((r["family"] or "").startswith("fam_iso_") for r in fit)
        ids = [r["part_id"] for r in m if r["split_id"] == k]
        assert len(ids) == len(set(ids)) and "q1" not in ids


def test_calib_by_row_without_families_and_hash_across_domains(spark):
    rows = [(f"p{i}", f"d{i % 3}", None if i % 3 == 1 else f"f{i}", f"p{i}", None) for i in range(60)]
    parts = spark.createDataFrame(rows, "part_id string, domain string, family string, grp string, ts date")
    m = splits.leave_one_domain_out(parts, 10, 0.2).join(parts, "part_id").collect()
    for k, n in ((0, 4), (2, 4)):
        assert sum(r["subset"] == "calib" and r["domain"] == "d1" for r in m if r["split_id"] == k) == n
    # a canonical in d0 and d1, whose second part shares a hash with d2: no side of a fold has a part of the three without the others
    keyed = spark.createDataFrame([("p0", ["c"]), ("p1", ["c", "h"]), ("p2", ["h"]), ("p3", []), ("p4", None)], "part_id string, keys array<string>")
    groups = tied_groups(keyed)
    assert {tuple(r) for r in groups.collect()} == {("p0", "p0"), ("p1", "p0"), ("p2", "p0")}
    tied = parts.drop("grp").join(groups, "part_id", "left").withColumn("grp", F.coalesce("grp", "part_id"))
    m = splits.leave_one_domain_out(tied, 10, 0.2).filter(F.col("part_id").isin("p0", "p1", "p2")).collect()
    assert sorted((r["split_id"], r["part_id"], r["subset"]) for r in m) == [(0, "p0", "test"), (1, "p1", "test"), (2, "p2", "test")]


def test_temporal_order_and_home(spark):
    parts = _parts(spark)
    m = splits.temporal(parts).join(parts.select("part_id", "ts"), "part_id").collect()
    assert all(r["ts"] is not None for r in m) and all(r["subset"] == "test" for r in m if r["unit"].startswith("fam_iso_"))
    first = {}
    for r in m:
        first[r["unit"]] = min(first.get(r["unit"], r["ts"]), r["ts"])
    side = {r["unit"]: r["subset"] for r in m if not r["unit"].startswith("fam_iso_")}
    order = [side[u] for u in sorted(side, key=lambda u: (first[u], u))]
    assert order == sorted(order, key=["train", "calib", "test"].index)
    home = {r["unit"]: r["home"] for r in splits.temporal_per_domain(parts).collect()}
    dated = [r for r in parts.collect() if r["ts"] and r["domain"]]
    assert all(home[r["family"] or r["grp"]] <= r["domain"] for r in dated)
    banned = splits.banned_components(parts, parts.select("part_id", F.col("grp").alias("component")), 10).join(parts, "part_id").collect()
    for k in {r["split_id"] for r in banned}:
        assert not {r["grp"] for r in banned if r["split_id"] == k and r["subset"] == "test"} & {r["grp"] for r in banned if r["split_id"] == k and r["subset"] != "test"}


def test_leaks(spark):
    rows = [("t", 0, "train", "a", "c1", "f1", "h1"), ("t", 0, "test", "b", "c1", "f2", "h1"), ("t", 0, "train", "c", "c2", "f1", "h2"), ("t", 0, "test", "d", "c2", "f1", "h3"), ("t", 0, "calib", "e", None, None, None), ("t", 0, "test", "a", "c3", None, None)]
    m = spark.createDataFrame(rows, "protocol string, split_id int, subset string, part_id string, canonical string, family string, content_hash string")
    assert {(r["value"], r["true_leak"]) for r in audit.canonical_leaks(m).collect()} == {("c1", True), ("c2", False)}
    assert {r["value"] for r in audit.spread_over_sides(m, "family").collect()} == {"f1"}
    assert {r["value"] for r in audit.in_several_subsets(m).collect()} == {"a"}
    assert audit.canonical_leaks(m.limit(0)).count() == 0


def test_candidates(spark):
    rows = [(1, 1, "cylinder", 2.0, 10.0, 0.0, 0.0, 1.0, 0.0), (1, 2, "cone", 2.0, 1.0, 0.0, 0.0, -1.0, 45.0), (1, 3, "cone", 2.0, 1.0, 0.0, 0.0, 1.0, 30.0), (1, 4, "cylinder", 0.1, 10.0, 1.0, 0.0, 0.0, 0.0), (1, 5, "cylinder", 3.0, 0.1, 1.0, 0.0, 0.0, 0.0), (2, 1, "plane", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (2, 2, "cylinder", 1.0, 4.0, 0.0, 0.0, 0.0, 0.0)]
    f = spark.createDataFrame(rows, "part_id long, face_no int, kind string, radius double, depth double, ax double, ay double, az double, semi_angle double")
    assert [(r["face_no"], r["cone_no"]) for r in candidates.best_coaxial(f).collect()] == [(1, 2)]
    got = {r["hole_id"]: (r["alpha0"], r["q"]) for r in candidates.extract(f, 1.0, 0.5).collect()}
    assert got == {"1::h0001": (90.0, 0.65), "2::h0001": (None, 1.0)}
    ringed = candidates.extract(f.withColumn("q_round", F.lit(0.5)), 1.0, 0.5, rings=f.select("part_id").filter("part_id = 1"), ring_required=False)
    assert {r["hole_id"]: r["q"] for r in ringed.collect()} == {"1::h0001": round(2.5 / 3, 6), "2::h0001": round((0.5 + 1 + 0.7) / 3, 6)}
    one = {r["part_id"]: r for r in candidates.one_per_part(f).collect()}
    assert one[1]["D0"] == 4.0 and math.isclose(one[1]["H0"], 20.1)
    assert set(one) == {1}  # a cylinder without an axis is none
    flat = spark.createDataFrame([(3, 1, "cylinder", 1.0, 2.0, 0.0, 0.0, 3.0, 0.0), (3, 2, "cylinder", 1.0, 5.0, 0.0, 0.0, -1.0, 0.0)], f.schema)
    r = candidates.one_per_part(flat, centres=spark.createDataFrame([(3, 1.0, 2.0, 3.0)], "part_id long, x double, y double, z double")).first()
    assert (r["az"], r["bx"], r["bz"], r["alpha0"]) == (1.0, 1.0, 3.0, 90.0)
    runs = spark.createDataFrame([("ok", 1, 2, 10.0, 3), ("ok", 0, 0, 30.0, 1), ("timeout", 0, 4, 99.0, 0), ("error", 0, 5, 1.0, 9)], "status string, hits int, n_true int, ms double, n_found int")
    e = candidates.evaluation(runs).first()
    assert (e["recall"], e["median_ms"], e["per_part"], e["n"]) == (0.25, 20.0, 2.0, 4) and candidates.evaluation(runs.limit(0)).first()["n"] == 0
    base = {"setting": 0.0, "recall": 0.3, "median_ms": 10.0, "per_part": 1.0}
    trials = lambda best: spark.createDataFrame([(1.0, 0.9, 14.0, 1.0), (2.0, 0.7, 9.0, 1.3), (3.0, 0.7, 8.0, 1.3), (4.0, 0.8, 9.0, 2.0)], "setting double, recall double, median_ms double, per_part double")
    assert candidates.tune([trials], base, 0.6)["setting"] == 3.0 and candidates.tune([trials], base, 0.95)["setting"] == 0.0
    near = spark.createDataFrame([(1, 1, 0.0, 1.0, 0.9, 0.25, 1.0), (1, 2, 0.0, 1.0, 0.9, 0.35, 1.0), (1, 3, 0.0, 1.0, 0.9, 0.15, 0.1)], "part_id int, gt_id int, tilt double, angle double, iou double, apart double, D double")
    assert {r["gt_id"] for r in candidates.matched(near, 5.0, 8.0, 0.7, centre=(0.3, 0.2)).collect()} == {1, 3} and candidates.matched(near, 5.0, 8.0, 0.7).count() == 3
    gt = spark.createDataFrame([(1, 1, 40.0, 1.0, 0.0, 0.0, 10.0, 1.0), (1, 2, 46.0, 1.0, 0.0, 0.0, 10.0, 1.0), (1, 3, 40.0, 0.0, 1.0, 0.0, 10.0, 1.0)], "part_id long, gt_id int, tilt double, ax double, ay double, az double, depth double, radius double")
    pred = spark.createDataFrame([(1, math.cos(math.radians(7)), math.sin(math.radians(7)), 0.0, 7.0)], "part_id long, ax double, ay double, az double, depth double")
    pairs = candidates.pair_measures(gt, pred)
    assert {r["gt_id"] for r in candidates.matched(pairs, 5.73, 8.0, 0.7).collect()} == {2}
    assert {r["gt_id"] for r in candidates.matched(pairs, 7.01, 8.0, 0.7).collect()} == {1, 2}
    grid = {(r["tol"], r["iou_min"]): r["hits"] for r in candidates.recall_grid(gt, pairs, [5.0, 8.0], [0.7, 0.8]).collect()}
    assert grid == {(5.0, 0.7): 0, (5.0, 0.8): 0, (8.0, 0.7): 2, (8.0, 0.8): 0}


def test_shapes(spark):
    edge = "part_id string, face_no int, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double, nx double, ny double, nz double"
    rows = [("p", 1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0), ("p", 2, 1.0, 0.0, 0.0, 0.0, 0.0, 1e-9, 0.0, 1.0, 0.0), ("p", 3, 5.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)]
    got = shapes.dihedral_histogram(spark.createDataFrame(rows, edge)).collect()
    assert [(r["bin"], r["share"]) for r in got] == [(19, 1.0)]
    pts = spark.createDataFrame([("p", i, float(i), 0.0, 0.0) for i in range(10)] + [("q", 0, 0.0, 0.0, 0.0)], "part_id string, point_id int, x double, y double, z double")
    n = shapes.normalised_points(pts).filter("part_id = 'p'").collect()
    assert math.isclose(max(r["x"] for r in n) - min(r["x"] for r in n), 1, rel_tol=1e-6)
    box = shapes.box_ratios(pts).filter("part_id = 'p'").first()
    assert (box["r1"], box["r2"]) == (0.0, 0.0)
    ring = spark.createDataFrame([("r", math.cos(a), math.sin(a), float(a)) for a in range(7)], "part_id string, x double, y double, z double")
    axis = spark.createDataFrame([("r", 0.0, 0.0, 5.0)], "part_id string, ax double, ay double, az double")
    assert math.isclose(shapes.roundness(ring, axis, "part_id").first()["roundness"], 1.0, abs_tol=1e-6) and math.isclose(shapes.extent_along(ring, axis, "part_id").first()["extent"], 6.0, rel_tol=1e-9)
    kinds = shapes.surface_histogram(spark.createDataFrame([("p", "plane"), ("p", "odd"), ("p", None), ("p", "cone")], "part_id string, kind string")).first()
    assert (kinds["plane"], kinds["cone"], kinds["free"]) == (0.25, 0.25, 0.5)
    centre = shapes.mean_of_centres(spark.createDataFrame([("p", 1, 0.0, 0.0, 0.0), ("p", 1, 2.0, 0.0, 0.0), ("p", 2, 5.0, 0.0, 0.0)], "part_id string, face_no int, x double, y double, z double"), pts)
    assert {r["part_id"]: r["x"] for r in centre.collect()} == {"p": 3.0, "q": 0.0}
    h = shapes.pair_distance_histogram(shapes.normalised_points(pts), pairs=200).collect()
    assert {r["part_id"] for r in h} == {"p"} and math.isclose(sum(r["share"] for r in h), 1) and max(r["bin"] for r in h) <= 37
    assert shapes.thinned(pts, 3).groupBy("part_id").count().filter("part_id = 'p'").first()["count"] == 3


def test_ranks_of_groups_of_any_size(spark):
    from partloom.operators.ranking import ranked

    rows = [("a" if i % 3 else "b", i * 7919 % 101, i) for i in range(101)] + [(None, 5, 200), (None, 4, 201)]
    df = spark.createDataFrame(rows, "g string, x int, rn_source int")
    got = {(r["g"], r["x"]): (r["rn"], r["m"]) for r in ranked(df, ["g"], "x").collect()}
    for g in ("a", "b", None):
        xs = sorted(x for k, x, _ in rows if k == g)
        assert [got[g, x] for x in xs] == [(i + 1, len(xs)) for i in range(len(xs))]
    assert [r["rn"] for r in ranked(df, [], F.desc("x"), "rn_source").orderBy(F.desc("x"), "rn_source").collect()] == list(range(1, 104))
    assert ranked(df.limit(0), ["g"], "x").count() == 0
