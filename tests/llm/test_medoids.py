"""Size and mean of a cluster in which most parts share one vector."""

import numpy as np
import pyarrow as pa

from partloom.llm import density
from partloom.operators.unit_vectors import BLOCKS, unit_vectors


def test_copies_count_in_size_and_mean(spark):
    rng = np.random.default_rng(8)
    base = {c: rng.random(w) + 0.5 for c, w in BLOCKS.items()}
    other = {c: v * (1 + rng.normal(0, 0.05, len(v))) for c, v in base.items()}
    rows = [{"part_id": f"c{i:03d}", **{c: v.tolist() for c, v in base.items()}} for i in range(300)]
    rows += [{"part_id": f"o{i:03d}", **{c: (v * (1 + rng.normal(0, 0.002, len(v)))).tolist() for c, v in other.items()}} for i in range(40)]
    rows += rows[:20] + rows[290:300]
    v = unit_vectors(spark.createDataFrame(pa.Table.from_pylist(rows)).repartition(2), without=("bbox_ratio",))
    assert v.filter("copy_of is not null").count() > 200
    clusters = density.density_clusters(v)
    assert clusters.count() == 340
    top = {r["rank"]: r for r in density.medoids(clusters, v).collect()}
    assert {r["n_parts"] for r in top.values()} == {340}
    # the mean of 300 copies and 40 others is next to the copies
    assert [top[k]["part_id"] for k in (1, 2, 3)] == ["c000", "c001", "c002"]
    blocks = [c for c in BLOCKS if c != "bbox_ratio"]
    unit = np.array([np.concatenate([np.array(r[c]) / np.linalg.norm(r[c]) for c in blocks]) / np.sqrt(3) for r in rows[:340]])
    assert abs(top[1]["typicality"] - unit[0] @ unit.mean(0)) < 2e-5


def test_each_distinct_vector_is_clustered_once(spark, monkeypatch):
    rng = np.random.default_rng(13)
    base = [{c: rng.integers(1, 4000, w) / 20_000 for c, w in BLOCKS.items()} for _ in range(4)]
    base[3] = {c: v + 1e-7 for c, v in base[3].items()}  # no multiples: moved as floats
    row = lambda i, j: {"part_id": f"q{j}{i:03d}", **{c: v.tolist() for c, v in base[j].items()}}
    rows = [row(i, j) for j, n in enumerate((90, 8, 7, 9)) for i in range(n)]
    rows += rows[:5] + [{**row(0, 0), "part_id": "null", "d2_hist": None}]
    seen, linked = [], density._linked
    monkeypatch.setattr(density, "_linked", lambda rows, total, **k: linked(seen.append(total) or rows, total, **k))
    df = spark.createDataFrame(pa.Table.from_pylist(rows)).repartition(7)
    got = {r["part_id"]: r["cluster_id"] for r in density.distinct_clusters(df).collect()}
    # seven parts are too few, and a vector that is alone has parts enough
    assert seen == [4] and got == {f"q{j}{i:03d}": f"q{j}000" for j, n in ((0, 90), (1, 8), (3, 9)) for i in range(n)}
    assert density.distinct_clusters(df.limit(0)).count() == 0
