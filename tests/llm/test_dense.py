"""Nearest vectors where a third of all rows are distinct but nearly equal."""

import numpy as np
import pyarrow as pa
import pytest

from partloom.llm import ann
from partloom.operators.unit_vectors import as_binary


@pytest.mark.parametrize(("min_sim", "least"), [(0.996, 1.0), (-1.0, 0.9)])
def test_a_dense_family_keeps_its_nearest(spark, min_sim, least):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3600, 108))
    x[:1200] = x[0] + rng.normal(size=(1200, 12)) @ rng.normal(size=(12, 108)) * 0.01
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    ids = [f"p{i:05d}" for i in rng.permutation(3600)]
    t = pa.table({"part_id": ids, "vec": as_binary(x), "copy_of": pa.nulls(3600, pa.binary())})
    found = ann.most_similar(spark.createDataFrame(t), min_sim=min_sim).toArrow().to_pylist()
    got = {}
    for r in found:
        got.setdefault(r["part_id"], set()).add(r["other_id"])
    s = (x[:1200].astype(np.float64) @ x[:1200].T.astype(np.float64)) - 3 * np.eye(1200)
    assert np.median(s[s > -1]) > 0.996
    hit = sum(len(got[ids[i]] & {ids[j] for j in np.lexsort((np.array(ids[:1200]), -np.round(s[i], 6)))[:10]}) for i in range(1200))
    assert hit >= least * 12_000
