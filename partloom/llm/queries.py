"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from partloom.llm import ann, density, grouped_splits, groups, overlap, packing, subjects, tokenizer
from partloom.plans.index_queries import HASH, REF
from partloom.plans.vector_queries import LEN, PAD, USABLE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": ann.p1_found,
    "p1_neighbours": ann.p1_neighbours,
    "p2_found": overlap.p2_found,
    "p2_coverage": overlap.p2_coverage,
    "p3_found": groups.p3_found,
    "p5_found": density.p5_found,
    "p5_medoids": density.p5_medoids,
    "p6_found": grouped_splits.p6_found,
    "p6_splits": grouped_splits.p6_splits,
    "p6_update": grouped_splits.p6_update,
    "p6_domain_splits": grouped_splits.p6_domain_splits,
    "p8_ids": tokenizer.p8_ids,
    "p8_counts": tokenizer.p8_counts,
    "p9_pack": packing.p9_pack,
    "p9_fill": packing.p9_fill,
    "p10_found": subjects.p10_found,
    "p10_composition": subjects.p10_composition,
}

def _unit(blocks: tuple[str, ...]) -> str:
    """Blocks of length one, joined and over the root of their number."""
    each = " || ".join(f"list_transform({PAD[c]}, lambda x: x / {LEN.format(PAD[c])})" for c in blocks)
    return f"list_transform({each}, lambda x: x / sqrt({float(len(blocks))}))"


_C, _G = HASH.format("content_hash"), HASH.format("geom_hash")
_VECTORS = f"{USABLE}, v AS (SELECT part_id, {_unit(('d2_hist', 'bbox_ratio', 'surf_hist', 'dih_hist'))} x FROM u)"
_SIMILAR = "s AS (SELECT a.part_id a, b.part_id b, list_dot_product(a.x, b.x) sim FROM v a JOIN v b ON a.part_id <> b.part_id WHERE list_dot_product(a.x, b.x) >= {0})"
#: Parts that reach each other over ``e(x, y)``, which has both directions and each part with itself.
_REACH = "r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)"
_LISTS = f"""h AS (SELECT DISTINCT part_id, {_C} c, {_G} g FROM signatures),
  l AS (SELECT DISTINCT protocol, split_id, subset = 'train' t, {REF.format('part_id')} part_id FROM split_lists), m AS (SELECT l.*, c, g FROM l JOIN h USING (part_id))"""

SQL: dict[str, str] = {
    "p1_found": f"WITH {_VECTORS}, {_SIMILAR.format(0.996)}, k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(sim, 6) DESC, b) r FROM s) SELECT DISTINCT least(a, b) AS part_a, greatest(a, b) AS part_b FROM k WHERE r <= 10",
    "p2_found": f"""WITH {_VECTORS}, {_SIMILAR.format(0.996)}, {_LISTS}, a AS (SELECT * FROM m WHERE t), b AS (SELECT * FROM m WHERE NOT t)
        SELECT protocol, split_id, least(a.part_id, b.part_id) AS part_a, greatest(a.part_id, b.part_id) AS part_b FROM a JOIN b USING (protocol, split_id) WHERE a.part_id = b.part_id OR a.c = b.c OR a.g = b.g
        UNION SELECT protocol, split_id, least(a.part_id, b.part_id), greatest(a.part_id, b.part_id) FROM s JOIN a ON a.part_id = s.a JOIN b USING (protocol, split_id) WHERE b.part_id = s.b""",
    "p3_found": f"""WITH RECURSIVE k AS (SELECT DISTINCT part_id p, 'c' || {_C} k FROM signatures WHERE {_C} IS NOT NULL UNION SELECT part_id, 'g' || {_G} FROM signatures WHERE {_G} IS NOT NULL),
        m AS (SELECT {REF.format('part_a')} a, {REF.format('part_b')} b FROM match_pairs), n AS (SELECT a, b FROM m WHERE a IN (SELECT part_id FROM signatures) AND b IN (SELECT part_id FROM signatures)),
        e AS (SELECT DISTINCT a.p x, b.p y FROM k a JOIN k b USING (k) UNION SELECT a, b FROM n UNION SELECT b, a FROM n UNION SELECT part_id, part_id FROM signatures), {_REACH}
        SELECT x AS part_id, min(y) AS group_id FROM r GROUP BY x HAVING count(DISTINCT y) > 1""",
    "p5_found": f"""WITH RECURSIVE {USABLE}, v AS (SELECT part_id, {_unit(('d2_hist', 'surf_hist', 'dih_hist'))} x FROM u), {_SIMILAR.format(0.96)}, e AS (SELECT a x, b y FROM s UNION SELECT part_id, part_id FROM v), {_REACH}
        SELECT x AS part_id, min(y) AS cluster_id FROM r GROUP BY x HAVING count(DISTINCT y) >= 8""",
    "p6_found": f"""WITH RECURSIVE q AS (SELECT DISTINCT part_id p, lower(regexp_replace(family_id, '^\\s+|\\s+$', '', 'g')) f, {REF.format('duplicate_canonical')} d, {_C} h FROM part_index_for_split),
        k AS (SELECT p, 'f' || f k FROM q WHERE f <> '' AND f <> 'fam_-1' UNION SELECT p, 'd' || d FROM q WHERE d IS NOT NULL UNION SELECT p, 'h' || h FROM q WHERE h IS NOT NULL),
        o AS (SELECT p, k, min(p) OVER (PARTITION BY k) lo FROM k), e AS (SELECT DISTINCT p x, lo y FROM o UNION SELECT lo, p FROM o), {_REACH}
        SELECT x AS part_id, min(y) AS unit_id FROM r GROUP BY x HAVING count(DISTINCT y) > 1""",
}
