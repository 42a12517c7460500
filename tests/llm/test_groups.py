"""Groups of linked records and grouped splits against union-find, and their edge cases."""

import re

import pytest
from pyspark.sql import functions as F

from partloom.llm import grouped_splits, groups
from partloom.session import table

H = "0123456789abcdef" * 4


class Sets(dict):
    def root(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self[b] = a


def _hash(s):
    m = re.match(r"^\s*(?:[^:]*:)?\s*([0-9a-f]{64})\s*$", (s or "").lower())
    return m and m[1]


def _ref(s):
    return re.sub(r"^\./", "", (s or "").strip().replace("\\", "/")) or None


def _groups(sets, parts):
    by = {}
    for p in set(parts):
        by.setdefault(sets.root(("p", p)), []).append(p)
    return {(p, min(g)) for g in by.values() if len(g) > 1 for p in g}


@pytest.mark.parametrize("d", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_links_of_the_tables(spark, d):
    sets = Sets()
    rows = table(spark, d, "signatures").select("part_id", "content_hash", "geom_hash").collect()
    known = {r[0] for r in rows}
    for p, c, g in rows:
        for kind, h in (("c", _hash(c)), ("g", _hash(g))):
            if h:
                sets.join(("p", p), (kind, h))
    for r in table(spark, d, "match_pairs").collect():
        a, b = _ref(r["part_a"]), _ref(r["part_b"])
        if a in known and b in known:
            sets.join(("p", a), ("p", b))
    assert {tuple(r) for r in groups.p3_found(spark, d).collect()} == _groups(sets, known)


def test_chains_of_any_length(spark):
    n = 90
    nodes = spark.createDataFrame([(i, f"n{i:03d}") for i in range(n + 3)], "id long, part_id string")
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)] + [(5, 4), (7, 7), (None, 3), (n, n + 1), (n + 1, n)], "src long, dst long")
    got = {tuple(r) for r in groups.link_groups(nodes, edges).collect()}
    assert got == {(f"n{i:03d}", "n000") for i in range(n)} | {(f"n{n:03d}", f"n{n:03d}"), (f"n{n + 1:03d}", f"n{n:03d}")}
    assert groups.link_groups(nodes, edges.limit(0)).count() == 0


def test_dirty_links(spark):
    sig = [("a", H, None, 1), ("b", f" SHA256:{H.upper()}", "nan", 1), ("a", H, None, 1), ("c", "", None, 1), ("d", None, "", 1), (None, H, None, 1), ("e", "x", None, 1), ("f", None, None, 1)]
    pairs = [("./c", "d ", "sim", None), ("d", "c", "sim", 0.1), ("e", "e", "x", 1.0), ("e", None, "x", 1.0), ("e", "gone", "x", 1.0), ("f\\", "e", "x", 1.0)]
    s = spark.createDataFrame(sig, "part_id string, content_hash string, geom_hash string, id int")
    p = spark.createDataFrame(pairs, "part_a string, part_b string, rule string, score double")
    assert {tuple(r) for r in groups.link_groups(*groups.part_links(s, p)).collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")}
    assert groups.link_groups(*groups.part_links(s.limit(0), p.limit(0))).count() == 0


INDEX = "part_id string, family_id string, duplicate_canonical string, content_hash string, unit_id string, n int"


def test_ties_and_splits(spark):
    rows = [("a", " Fam_1", None, None, "x", 1), ("b", "fam_1 ", "./q", None, "x", 1), ("c", "fam_-1", "q", "0x0", "x", 1), ("d", "fam_-1", "", H, "x", 1), ("e", "", None, f"md:{H}", "x", 1), ("f", None, None, None, "x", 1), ("f", None, None, None, "x", 1), (None, "fam_1", "q", H, "x", 1)]
    df = spark.createDataFrame(rows, INDEX)
    units = grouped_splits.update_components(grouped_splits.tie_keys(df))
    assert {tuple(r) for r in units.collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")}
    assert grouped_splits.update_components(grouped_splits.tie_keys(df.limit(0))).count() == 0
    before = spark.createDataFrame([("a", "a", "test"), ("b", "a", "test"), ("d", "d", "train"), ("f", "f", "calib")], "part_id string, unit_id string, split string")
    out = {r["part_id"]: (r["split"], r["status"]) for r in grouped_splits.assign_splits(df.filter("part_id is not null"), units, previous=before).collect()}
    assert out["c"] == ("test", "kept") and out["e"] == ("train", "kept") and out["f"] == ("calib", "kept")
    clash = spark.createDataFrame([("a", "a", "test"), ("b", "b", "train")], "part_id string, unit_id string, split string")
    out = {r["part_id"]: (r["split"], r["status"]) for r in grouped_splits.assign_splits(df.filter("part_id is not null"), units, previous=clash).collect()}
    assert out["a"] == (None, "quarantined") and out["d"][1] == "new"
    assert grouped_splits.assign_splits(df.limit(0), units.limit(0)).count() == 0


def test_an_update_merges_only_what_new_keys_join(spark):
    tied = spark.createDataFrame([("z", [bytearray(b"k")]), ("b", [bytearray(b"k")])], "part_id string, keys array<binary>")
    old = spark.createDataFrame([("a", "a", "train"), ("b", "a", "train"), ("c", "c", "test")], "part_id string, unit_id string, split string")
    assert {tuple(r) for r in grouped_splits.update_components(tied, old).collect()} == {("a", "a"), ("b", "a"), ("z", "a")}


def test_proportions_and_disjointness(spark, small):
    out = grouped_splits.p6_splits(spark, small)
    n = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    total = sum(n.values())
    assert abs(n["train"] / total - 0.8) < 0.1 and out.count() == out.select("part_id").distinct().count()
    assert out.groupBy("unit_id").agg(F.count_distinct("split").alias("k")).filter("k > 1").count() == 0
    held = grouped_splits.p6_domain_splits(spark, small)
    assert held.groupBy("unit_id").agg(F.count_distinct("split").alias("k")).filter("k > 1").count() == 0
    assert held.filter("split = 'test'").count() > 0
