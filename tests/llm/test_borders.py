"""No pair at the stated similarity is lost on the way to the exact comparison."""

import numpy as np

from partloom.llm import overlap
from partloom.operators.borders import allowed_distance, fit_planes
from partloom.operators.unit_vectors import BLOCKS

SCHEMA = "part_id string, content_hash string, geom_hash string, d2_hist array<double>, bbox_ratio array<double>, surf_hist array<double>, dih_hist array<double>"


def _turned(x, cos, rng):
    """A vector with the given cosine to ``x``."""
    x = x / np.linalg.norm(x)
    side = rng.normal(size=len(x))
    side -= (side @ x) * x
    return cos * x + np.sqrt(1 - cos * cos) * side / np.linalg.norm(side)


def test_close_vectors_meet_in_a_leaf():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 24))[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 24)) * 0.15
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    y = np.array([_turned(v, 0.9961, rng) for v in x[:2000]], np.float32)
    planes = fit_planes(x[:1500], 4000, allowed_distance(0.996) / 2, 300)
    row, leaf, home = planes.leaves(np.vstack([x[:2000], y]))
    assert home.sum() == 4000 and len(np.unique(leaf)) > 5 and len(row) < 4 * 4000
    at = [set() for _ in range(4000)]
    for r, k in zip(row.tolist(), leaf.tolist(), strict=True):
        at[r].add(k)
    assert all(at[i] & at[2000 + i] for i in range(2000))


def test_cases_near_the_threshold_are_all_found(spark):
    rng = np.random.default_rng(3)
    rows, lists = [], []
    for i in range(400):
        base = {c: rng.random(w) + 0.05 for c, w in BLOCKS.items()}
        for side, f in (("train", base), ("test", {c: _turned(v, 0.99605, rng) for c, v in base.items()})):
            rows.append((f"{side}{i:03d}", None, None, *[f[c].tolist() for c in ("d2_hist", "bbox_ratio", "surf_hist", "dih_hist")]))
            lists.append(("a", 0, side, f"{side}{i:03d}"))
    records = overlap.listed_records(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(lists, "protocol string, split_id int, subset string, part_id string"))
    got = {(r["train_part"], r["held_out_part"]) for r in overlap.cross_split_cases(records).collect()}
    assert got >= {(f"train{i:03d}", f"test{i:03d}") for i in range(400)}
