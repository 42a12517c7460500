import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from partloom.operators.graph import connected_components, star_edges


def _want(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            lo, hi = sorted((root(a), root(b)))
            up[hi] = lo
    return {x: root(x) for x in list(up)}


def _got(spark, edges):
    return {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}


def test_long_chains_and_rings(spark):
    ids = list(range(60))
    random.Random(1).shuffle(ids)
    edges = list(zip(range(60), range(1, 60))) + [(100 + a, 100 + b) for a, b in zip(ids, ids[1:], strict=False)] + [(900, 901), (901, 902), (902, 900)]
    assert _got(spark, edges) == _want(edges)


def test_nulls_loops_repeats_and_nothing(spark):
    assert _got(spark, [(1, 2), (2, 1), (1, 1), (None, 3), (4, None), (2, 5), (2, 5)]) == {1: 1, 2: 1, 5: 1}
    assert _got(spark, []) == {}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=25))
def test_any_graph(spark, edges):
    assert _got(spark, edges) == _want(edges)


def test_stars_link_the_members_of_a_key(spark):
    rows = [("a", 3), ("a", 1), ("a", 1), ("b", 7), (None, 8), (None, 9)]
    got = {tuple(r) for r in star_edges(spark.createDataFrame(rows, "key string, id long")).collect()}
    assert got == {(1, 3)}
