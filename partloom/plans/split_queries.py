"""Queries over splits: membership, temporal cuts, leakage and coverage audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.functions.ids import part_ref, usable_hash
from partloom.operators import audit, splits
from partloom.plans.index_queries import COMPONENT_KEYS, HASH, REF, STRONG_KEYS, _tied, parts, split_components, strong_groups
from partloom.session import materialize, table

SEED = 42


def split_base(spark, d) -> DataFrame:
    """``part_id, domain, family, grp, hash, ts`` of every part; strong groups are tied by canonical or content hash."""
    dom = table(spark, d, "domains").select("part_id", "source_dataset", "timestamp").distinct()
    p = parts(spark, d, "content_hash", "family_id").select("part_id", F.col("family_id").alias("family"), usable_hash(F.col("content_hash")).alias("hash"))
    rows = dom.join(p, "part_id", "left").join(strong_groups(spark, d), "part_id", "left")
    return rows.select("part_id", F.col("source_dataset").alias("domain"), "family", F.coalesce("grp", "part_id").alias("grp"), "hash", F.col("timestamp").alias("ts"))


def lodo_membership(spark, d):
    return splits.leave_one_domain_out(split_base(spark, d), 30, 0.1, SEED)


def lodo_fold_sizes(spark, d):
    return lodo_membership(spark, d).groupBy("split_id", "subset").agg(F.count("*").alias("n"))


def lodo_fold_meta(spark, d):
    """Per fold whether families, strong groups and hashes of test stay out of train and calib."""
    base = materialize(split_base(spark, d), "split-base")
    m = splits.leave_one_domain_out(base, 30, 0.1, SEED).join(base.select("part_id", "family", "grp", "hash"), "part_id").withColumn("protocol", F.lit("lodo"))
    return audit.disjoint_flags(m.withColumn("subset", F.when(F.col("subset") == "test", "test").otherwise("fit")), "family", "grp", "hash").select("split_id", "key", "disjoint")


def temporal_split(spark, d):
    return splits.temporal(split_base(spark, d))


def iso_relax(spark, d):
    """The temporal cut when the smallest families are isolated and a tenth of them leaves test again."""
    base = split_base(spark, d)
    small = base.groupBy("family").agg(F.count("*").alias("n")).filter("n = 1").select("family")
    named = base.join(small.withColumn("one", F.lit(True)), "family", "left")
    return splits.temporal(named.withColumn("family", F.when(F.col("one"), F.concat(F.lit("fam_iso_"), F.col("part_id"))).otherwise(F.col("family"))), relax=0.1, relax_calib=0.6)


def temporal_per_domain(spark, d):
    return splits.temporal_per_domain(split_base(spark, d))


def component_banned_lodo(spark, d):
    """Leave one domain out; components tied by family or content hash that test has are banned from the pool."""
    return splits.banned_components(split_base(spark, d), split_components(spark, d), 30, 0.1, SEED)


def members(spark, d) -> DataFrame:
    """Split lists with the canonical, family and usable hash of each part."""
    lists = table(spark, d, "split_lists").select("protocol", "split_id", "subset", part_ref(F.col("part_id")).alias("part_id")).filter(F.col("part_id").isNotNull()).distinct()
    p = parts(spark, d, "duplicate_canonical", "family_id", "content_hash").select("part_id", part_ref(F.col("duplicate_canonical")).alias("canonical"), F.col("family_id").alias("family"), usable_hash(F.col("content_hash")).alias("content_hash"))
    return lists.join(p, "part_id", "left")


def leak_ids(spark, d):
    return audit.in_several_subsets(members(spark, d))


def leak_family(spark, d):
    return audit.spread_over_sides(members(spark, d).filter(F.col("family") != "fam_-1"), "family")


def leak_hash(spark, d):
    return audit.spread_over_sides(members(spark, d), "content_hash")


def leak_canonical_true(spark, d):
    return audit.canonical_leaks(members(spark, d))


def disjoint_flags(spark, d):
    return audit.disjoint_flags(members(spark, d), "family", "canonical", "content_hash")


def lodo_single_domain(spark, d):
    """Data sets in the test part of each leave-one-domain-out split; one is right."""
    m = members(spark, d).filter((F.col("protocol") == "lodo") & (F.col("subset") == "test"))
    p = parts(spark, d, "source_dataset")
    return m.select("split_id", "part_id").distinct().join(p, "part_id").groupBy("split_id").agg(F.count_distinct("source_dataset").alias("n_domains"))


def coverage_audit(spark, d):
    """Share of the listed parts that have hole candidates, per split and subset."""
    m = members(spark, d).select("protocol", "split_id", "subset", "part_id").distinct()
    return audit.coverage(m, table(spark, d, "hole_candidates").select("part_id"), "part_id", "protocol", "split_id", "subset")


def worst5(spark, d):
    return audit.worst(coverage_audit(spark, d), "coverage", "protocol", "split_id", "subset")


def balance_check(spark, d):
    """Listed parts against parts with candidates, with only unusable ones, and without any."""
    m = members(spark, d).select("protocol", "split_id", "subset", "part_id").distinct()
    holes = table(spark, d, "hole_candidates").groupBy("part_id").agg(F.max(F.coalesce(F.col("D0") > 0, F.lit(False))).alias("usable"))
    rows = m.join(holes, "part_id", "left")
    per = rows.groupBy("protocol", "split_id", "subset").agg(F.count("*").alias("expected"), F.count_if(F.col("usable")).alias("written"), F.count_if(F.col("usable").isNull()).alias("no_cand"), F.count_if(~F.col("usable")).alias("failed"))
    return audit.balance(per)


def candidate_coverage(spark, d):
    """Candidates per listed part with any: mean, median, p90 and most, and the share of parts without a usable one."""
    m = members(spark, d).select("protocol", "split_id", "subset", "part_id").distinct()
    holes = table(spark, d, "hole_candidates").dropDuplicates(["hole_id"]).groupBy("part_id").agg(F.count("*").alias("n"), F.count_if(F.col("D0") > 0).alias("usable"))
    rows = m.join(holes, "part_id")
    return rows.groupBy("protocol", "split_id", "subset").agg(F.count("*").alias("n_parts"), F.round(F.avg("n"), 6).alias("mean"), F.median("n").alias("p50"), F.round(F.percentile("n", F.lit(0.9)), 6).alias("p90"), F.max("n").alias("most"), F.round(F.avg((F.col("usable") == 0).cast("int")), 6).alias("empty_rate"))


def status_by_subset(spark, d):
    """Listed parts by subset and status: written, failed (no usable candidate) or no_cand."""
    b = balance_check(spark, d)
    wide = b.select("protocol", "split_id", "subset", F.explode(F.array(*[F.struct(F.lit(k).alias("status"), F.col(k).alias("n")) for k in ("written", "failed", "no_cand")])).alias("x"))
    return wide.select("protocol", "split_id", "subset", "x.*").filter("n > 0")


def split_balance(spark, d):
    """Whether all subsets of a split balance, and its totals."""
    b = balance_check(spark, d)
    return b.groupBy("protocol", "split_id").agg(F.bool_and("balanced").alias("balanced"), F.sum("expected").alias("expected"), F.sum("written").alias("written"))


def rebuild_status(spark, d):
    """What a rebuild of the candidates would do with each listed part: it is there, cannot be found, or is work."""
    m = members(spark, d).select("part_id").distinct()
    there = table(spark, d, "hole_candidates").select("part_id").distinct().withColumn("there", F.lit(True))
    known = table(spark, d, "signatures").select("part_id").distinct().withColumn("known", F.lit(True))
    status = F.when(F.col("there"), "skip_exists").when(F.col("known").isNull(), "skip_unresolved").otherwise("ok")
    return m.join(there, "part_id", "left").join(known, "part_id", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def split_report(spark, d):
    """Sizes of all subsets with their totals per split and protocol."""
    m = members(spark, d).select("protocol", "split_id", "subset", "part_id").distinct()
    r = m.rollup("protocol", "split_id", "subset").agg(F.count("*").alias("n"))
    return r.select(F.coalesce("protocol", F.lit("all")).alias("protocol"), F.coalesce("split_id", F.lit(-1)).alias("split_id"), F.coalesce("subset", F.lit("all")).alias("subset"), "n")


def parts_in_index(spark, d):
    """Listed parts that the signatures know, and those they do not."""
    lists = table(spark, d, "split_lists").select(part_ref(F.col("part_id")).alias("part_id")).filter(F.col("part_id").isNotNull()).distinct()
    known = table(spark, d, "signatures").select("part_id").distinct()
    return lists.join(known, "part_id", "left_semi").agg(F.lit("known").alias("state"), F.count("*").alias("n")).unionByName(lists.join(known, "part_id", "left_anti").agg(F.lit("unknown").alias("state"), F.count("*").alias("n")))


BASE = f"""{_tied("s", STRONG_KEYS)}, p AS (SELECT DISTINCT part_id, family_id f, {HASH.format('content_hash')} h FROM part_index_for_split),
  b AS (SELECT d.part_id, d.source_dataset AS domain, p.f AS family, coalesce(s_g.lo, d.part_id) AS grp, p.h AS hash, d.timestamp AS ts FROM (SELECT DISTINCT part_id, source_dataset, timestamp FROM domains) d LEFT JOIN p USING (part_id) LEFT JOIN s_g USING (part_id))"""
FOLDS = "fold AS (SELECT (row_number() OVER (ORDER BY domain) - 1)::INT AS split_id, domain AS td FROM (SELECT domain FROM b WHERE domain IS NOT NULL GROUP BY 1 HAVING count(*) >= 30))"
LODO = f"""WITH RECURSIVE {BASE}, {FOLDS}, test AS (SELECT split_id, part_id, family, grp FROM b JOIN fold ON domain = td),
  pool AS (SELECT f.split_id, b.* FROM b, fold f WHERE b.domain IS NOT NULL AND b.domain <> f.td AND NOT coalesce(starts_with(b.family, 'fam_iso_'), false)
    AND NOT EXISTS (SELECT 1 FROM test t WHERE t.split_id = f.split_id AND t.grp = b.grp) AND NOT EXISTS (SELECT 1 FROM test t WHERE t.split_id = f.split_id AND t.family = b.family)),
  fam AS (SELECT *, row_number() OVER (PARTITION BY split_id, domain ORDER BY md5('{SEED}:' || family), family) rn, count(*) OVER (PARTITION BY split_id, domain) m FROM (SELECT DISTINCT split_id, domain, family FROM pool WHERE family IS NOT NULL)),
  nofam AS (SELECT split_id, grp, row_number() OVER (PARTITION BY split_id, domain ORDER BY md5('{SEED}:' || part_id), part_id) rn, count(*) OVER (PARTITION BY split_id, domain) m FROM pool WHERE (split_id, domain) NOT IN (SELECT (split_id, domain) FROM fam)),
  cg AS (SELECT pool.split_id, grp FROM pool JOIN fam USING (split_id, domain, family) WHERE rn <= greatest(1, ceil(m * 0.1)) UNION SELECT split_id, grp FROM nofam WHERE rn <= greatest(1, ceil(m * 0.1))),
  lodo AS (SELECT split_id, CASE WHEN cg.grp IS NULL THEN 'train' ELSE 'calib' END AS subset, part_id FROM pool LEFT JOIN cg USING (split_id, grp) UNION ALL SELECT split_id, 'test', part_id FROM test)"""


def _cut(m: str, rn: str, tf: float = 0.5, cf: float = 0.4) -> str:
    a, b = f"greatest(1, floor({m} * {tf}))", f"greatest(1, floor({m} * {cf}))"
    full = f"({m} - {a} - {b} < 1)"
    b2, a2 = f"(CASE WHEN {full} AND {b} > 1 THEN {b} - 1 ELSE {b} END)", f"(CASE WHEN {full} AND {b} <= 1 AND {a} > 1 THEN {a} - 1 ELSE {a} END)"
    return f"CASE WHEN {rn} <= {a2} THEN 'train' WHEN {rn} <= {a2} + {b2} THEN 'calib' ELSE 'test' END"


def _temporal(base: str, iso: str) -> str:
    return f"""WITH RECURSIVE {BASE}{base}, r AS (SELECT *, coalesce(family, grp, part_id) AS unit FROM b2 WHERE ts IS NOT NULL),
      u AS (SELECT unit, min(ts) fst, starts_with(unit, 'fam_iso_') iso FROM r GROUP BY 1), w AS (SELECT *, row_number() OVER (PARTITION BY iso ORDER BY fst, unit) rn, count(*) OVER (PARTITION BY iso) m FROM u)
      SELECT part_id, unit, CASE WHEN iso THEN {iso} ELSE {_cut('m', 'rn')} END AS subset FROM r JOIN w USING (unit)"""


MEMBERS = f"""WITH p AS (SELECT DISTINCT part_id, {REF.format('duplicate_canonical')} canonical, family_id AS family, {HASH.format('content_hash')} content_hash FROM part_index_for_split),
  l AS (SELECT DISTINCT protocol, split_id, subset, {REF.format('part_id')} AS part_id FROM split_lists WHERE {REF.format('part_id')} IS NOT NULL),
  m AS (SELECT l.*, p.canonical, p.family, p.content_hash FROM l LEFT JOIN p USING (part_id))"""


def _sides(key: str, where: str = "true") -> str:
    return f"{MEMBERS} SELECT protocol, split_id, {key} AS value FROM m WHERE {key} IS NOT NULL AND {where} GROUP BY ALL HAVING bool_or(subset = 'test') AND bool_or(subset <> 'test')"


COVERAGE = "SELECT protocol, split_id, subset, count(*) AS expected, count(h.part_id) AS found, round(count(h.part_id) / count(*), 6) AS coverage FROM l LEFT JOIN (SELECT DISTINCT part_id FROM hole_candidates) h USING (part_id) GROUP BY 1, 2, 3"

BALANCE = "h AS (SELECT part_id, bool_or(coalesce(D0 > 0, false)) u FROM hole_candidates GROUP BY 1), e AS (SELECT protocol, split_id, subset, count(*) AS expected, count(*) FILTER (u) AS written, count(*) FILTER (u IS NULL) AS no_cand, count(*) FILTER (NOT u) AS failed FROM l LEFT JOIN h USING (part_id) GROUP BY 1, 2, 3)"

QUERIES = {
    f.__name__: f
    for f in (
        lodo_membership, lodo_fold_sizes, lodo_fold_meta, temporal_split, iso_relax, temporal_per_domain, component_banned_lodo, leak_ids, leak_family, leak_hash, leak_canonical_true,
        disjoint_flags, lodo_single_domain, coverage_audit, worst5, balance_check, split_balance, candidate_coverage, status_by_subset, rebuild_status, split_report, parts_in_index,
    )
}

SQL = {
    "lodo_membership": f"{LODO} SELECT * FROM lodo",
    "lodo_fold_sizes": f"{LODO} SELECT split_id, subset, count(*) AS n FROM lodo GROUP BY 1, 2",
    "lodo_fold_meta": f"""{LODO}, x AS (SELECT split_id, CASE WHEN subset = 'test' THEN 1 ELSE 0 END t, family, grp, hash FROM lodo JOIN b USING (part_id)),
        y AS (SELECT split_id, 'family' AS key, family AS v, count(DISTINCT t) n FROM x WHERE family IS NOT NULL GROUP BY ALL UNION ALL SELECT split_id, 'grp', grp, count(DISTINCT t) FROM x WHERE grp IS NOT NULL GROUP BY ALL UNION ALL SELECT split_id, 'hash', hash, count(DISTINCT t) FROM x WHERE hash IS NOT NULL GROUP BY ALL)
        SELECT split_id, key, max(n) <= 1 AS disjoint FROM y GROUP BY 1, 2""",
    "temporal_split": _temporal(", b2 AS (SELECT * FROM b)", "'test'"),
    "iso_relax": _temporal(", s AS (SELECT family FROM b GROUP BY 1 HAVING count(*) = 1), b2 AS (SELECT part_id, domain, CASE WHEN family IN (SELECT family FROM s WHERE family IS NOT NULL) THEN 'fam_iso_' || part_id ELSE family END AS family, grp, ts FROM b)", "CASE WHEN rn <= ceil(ceil(m * 0.1) * 0.6) THEN 'calib' WHEN rn <= ceil(m * 0.1) THEN 'train' ELSE 'test' END"),
    "temporal_per_domain": f"""WITH RECURSIVE {BASE}, r AS (SELECT *, coalesce(family, grp, part_id) AS unit FROM b WHERE ts IS NOT NULL AND domain IS NOT NULL),
        u AS (SELECT unit, min(ts) fst, min(domain) home, starts_with(unit, 'fam_iso_') iso FROM r GROUP BY 1), w AS (SELECT *, row_number() OVER (PARTITION BY home, iso ORDER BY fst, unit) rn, count(*) OVER (PARTITION BY home, iso) m FROM u)
        SELECT part_id, unit, home, CASE WHEN iso THEN 'test' ELSE {_cut('m', 'rn')} END AS subset FROM r JOIN w USING (unit)""",
    "component_banned_lodo": f"""WITH RECURSIVE {BASE}, {FOLDS}, {_tied('c', COMPONENT_KEYS)}, c AS (SELECT DISTINCT part_id, coalesce(lo, part_id) AS component FROM b LEFT JOIN c_g USING (part_id)), t AS (SELECT split_id, part_id, component FROM b JOIN c USING (part_id) JOIN fold ON domain = td),
        pool AS (SELECT f.split_id, part_id FROM b JOIN c USING (part_id), fold f WHERE domain IS NOT NULL AND domain <> f.td AND NOT EXISTS (SELECT 1 FROM t WHERE t.split_id = f.split_id AND t.component = c.component)),
        w AS (SELECT *, row_number() OVER (PARTITION BY split_id ORDER BY md5('{SEED}:' || part_id), part_id) rn, count(*) OVER (PARTITION BY split_id) m FROM pool)
        SELECT split_id, CASE WHEN rn <= floor(m * 0.1) THEN 'calib' ELSE 'train' END AS subset, part_id FROM w UNION ALL SELECT split_id, 'test', part_id FROM t""",
    "leak_ids": f"{MEMBERS} SELECT protocol, split_id, part_id AS value, count(DISTINCT subset) AS n_subsets FROM m GROUP BY 1, 2, 3 HAVING count(DISTINCT subset) > 1",
    "leak_family": _sides("family", "family <> 'fam_-1'"),
    "leak_hash": _sides("content_hash"),
    "leak_canonical_true": f"""{MEMBERS}, s AS (SELECT protocol, split_id, canonical, content_hash h, subset = 'test' t FROM m WHERE canonical IS NOT NULL),
        n AS (SELECT protocol, split_id, canonical FROM s GROUP BY ALL HAVING count(DISTINCT t) = 2), x AS (SELECT DISTINCT protocol, split_id, canonical FROM (SELECT protocol, split_id, canonical, h FROM s WHERE h IS NOT NULL GROUP BY ALL HAVING count(DISTINCT t) = 2))
        SELECT n.protocol, n.split_id, n.canonical AS value, x.canonical IS NOT NULL AS true_leak FROM n LEFT JOIN x USING (protocol, split_id, canonical)""",
    "disjoint_flags": MEMBERS + ", y AS (" + " UNION ALL ".join(f"SELECT protocol, split_id, '{k}' AS key, {k} AS v, count(DISTINCT subset) n FROM m WHERE {k} IS NOT NULL GROUP BY ALL" for k in ("family", "canonical", "content_hash")) + ") SELECT protocol, split_id, key, max(n) <= 1 AS disjoint, count(*) FILTER (n > 1) AS n_shared FROM y GROUP BY 1, 2, 3",
    "lodo_single_domain": f"{MEMBERS} SELECT split_id, count(DISTINCT source_dataset) AS n_domains FROM (SELECT DISTINCT split_id, part_id FROM m WHERE protocol = 'lodo' AND subset = 'test') JOIN part_index_for_split USING (part_id) GROUP BY 1",
    "coverage_audit": f"{MEMBERS} {COVERAGE}",
    "worst5": f"{MEMBERS} {COVERAGE} ORDER BY coverage, protocol, split_id, subset LIMIT 5",
    "split_balance": f"{MEMBERS}, {BALANCE} SELECT protocol, split_id, bool_and(expected = written + no_cand + failed) AS balanced, sum(expected)::BIGINT AS expected, sum(written)::BIGINT AS written FROM e GROUP BY 1, 2",
    "candidate_coverage": f"{MEMBERS}, h AS (SELECT part_id, count(*) n, count(*) FILTER (D0 > 0) u FROM (SELECT DISTINCT ON (hole_id) * FROM hole_candidates) GROUP BY 1) SELECT protocol, split_id, subset, count(*) AS n_parts, round(avg(n), 6) AS mean, median(n)::DOUBLE AS p50, round(quantile_cont(n::DOUBLE, 0.9), 6) AS p90, max(n) AS most, round(avg((u = 0)::INT), 6) AS empty_rate FROM l JOIN h USING (part_id) GROUP BY 1, 2, 3",
    "status_by_subset": f"{MEMBERS}, {BALANCE}, u AS (SELECT protocol, split_id, subset, 'written' AS status, written AS n FROM e UNION ALL SELECT protocol, split_id, subset, 'failed', failed FROM e UNION ALL SELECT protocol, split_id, subset, 'no_cand', no_cand FROM e) SELECT * FROM u WHERE n > 0",
    "rebuild_status": f"{MEMBERS}, x AS (SELECT DISTINCT part_id FROM l) SELECT CASE WHEN part_id IN (SELECT part_id FROM hole_candidates) THEN 'skip_exists' WHEN part_id NOT IN (SELECT part_id FROM signatures) THEN 'skip_unresolved' ELSE 'ok' END AS status, count(*) AS n FROM x GROUP BY 1",
    "balance_check": f"{MEMBERS}, {BALANCE} SELECT *, expected = written + no_cand + failed AS balanced FROM e",
    "split_report": f"{MEMBERS} SELECT coalesce(protocol, 'all') AS protocol, coalesce(split_id, -1) AS split_id, coalesce(subset, 'all') AS subset, count(*) AS n FROM l GROUP BY ROLLUP (protocol, split_id, subset)",
    "parts_in_index": f"{MEMBERS}, x AS (SELECT DISTINCT part_id FROM l) SELECT 'known' AS state, count(*) AS n FROM x WHERE part_id IN (SELECT part_id FROM signatures) UNION ALL SELECT 'unknown', count(*) FROM x WHERE part_id NOT IN (SELECT part_id FROM signatures)",
}
