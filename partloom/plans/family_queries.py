"""Queries that build duplicates, families and the part index anew from the signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.functions import vectors as V
from partloom.functions.ids import usable_hash
from partloom.operators import cluster, families, simjoin, stats
from partloom.operators.unit_vectors import unpacked
from partloom.plans.index_queries import HASH
from partloom.plans.vector_queries import BLOCKS, LEN, PACKED, PAD, USABLE, usable
from partloom.session import materialize, table

K, QUANTILE, SCALE, MIN_SAMPLES, COSINE = 6, 0.12, 1.02, 6, 0.012


def _radius(spark, d) -> DataFrame:
    rows = usable(spark, d, once=False).select("part_id", V.packed(BLOCKS).alias("v"))
    near = simjoin.nearest_of_queries(rows.filter(families.asked(F.col("part_id"))), rows, "part_id", "v", K)
    return simjoin.auto_eps(near, K, QUANTILE, SCALE)


def signature_eps(spark, d):
    """The automatic radius of the packed vectors, from the distances of one part in fifty to its sixth neighbour, beside
    the radius of a fixed cosine distance, which holds where the automatic one is 0."""
    manual = F.lit(cluster.manual_eps(COSINE)).cast("double")
    return _radius(spark, d).select(F.round("eps", 6).alias("eps"), manual.alias("fallback"), F.round(F.col("eps") / manual, 6).alias("ratio"))


def _eps(rows: DataFrame) -> float:
    return families.auto_radius(rows, K, QUANTILE, SCALE) or cluster.manual_eps(COSINE)


def duplicate_components(spark, d):
    """Canonical of every part: the smallest part that equal content hashes or similar vectors tie it to."""
    return families.duplicate_groups(table(spark, d, "signatures"))


def duplicate_summary(spark, d):
    """Parts, groups of at least two, and the largest group of the duplicate components."""
    sizes = duplicate_components(spark, d).groupBy("canonical").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("n_parts"), F.count_if(F.col("n") > 1).alias("n_groups"), F.max("n").alias("largest"))


def _labels(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """``(rows, labels, members, eps)``"""
    rows, members = families.family_rows(table(spark, d, "signatures"))
    eps = _eps(rows)
    labels = families.dense_labels(rows, eps, MIN_SAMPLES, unpack=unpacked)
    return rows, materialize(labels, "family-labels", tidy=True), members, eps


def _named(spark, d, numbered: DataFrame) -> DataFrame:
    """Family of every part from ``(part_id, cluster)``: cluster, else noise by hash, else no geometry by hash."""
    s = table(spark, d, "signatures").groupBy("part_id").agg(F.min("content_hash").alias("content_hash")).withColumn("h", usable_hash(F.col("content_hash")))
    rows = s.join(numbered.withColumn("_seen", F.lit(True)), "part_id", "left")
    noise = cluster.noise_family(F.lit(-1), F.col("h"), F.col("part_id"))
    name = F.when(F.col("cluster").isNotNull(), F.concat(F.lit("fam_"), F.col("cluster"))).when(F.col("_seen"), noise).otherwise(cluster.no_geometry_family(F.col("h")))
    return rows.select("part_id", name.alias("family"))


def family_clusters(spark, d):
    """Family of every part: density clusters of the packed vectors, named by their smallest core part; parts in none are
    named by their hash, those without vectors as well."""
    _, labels, members, _ = _labels(spark, d)
    first = members.join(labels.filter("id = label"), "id").groupBy("label").agg(F.min("part_id").alias("cluster"))
    return _named(spark, d, members.join(labels, "id").join(first, "label", "left").select("part_id", "cluster"))


def family_pieces(spark, d):
    """Families of at most 6 % of the parts: larger clusters are clustered again at smaller radii and then cut."""
    rows, labels, members, eps = _labels(spark, d)
    clustered = rows.select("id", "n").join(labels.filter("label >= 0"), "id").select("id", "n", F.col("label").cast("string").alias("family"))
    cut = families.split_large(clustered, families.size_limit(members.count(), 0.06, 6000), eps, MIN_SAMPLES, unpack=unpacked, vectors=rows)
    return members.join(cut, "id").select("part_id", F.concat(F.lit("fam_"), "family").alias("family"))


def family_diagnostics(spark, d):
    """Share of noise and of parts without geometry, number of families, and the largest."""
    sizes = family_clusters(spark, d).groupBy("family").agg(F.count("*").alias("n"))
    kind = lambda p: F.sum(F.when(F.col("family").startswith(p), F.col("n")).otherwise(0))
    return sizes.agg(F.count("*").alias("n_families"), F.round(kind("fam_iso_") / F.sum("n"), 6).alias("noise_share"), F.round(kind("fam_ch_") / F.sum("n"), 6).alias("no_geometry_share"), F.max("n").alias("largest"))


INDEX_META = ["repo", "format", "file_ext", "file_size_bytes", "file_mtime_utc", "step_schema", "originating_system", "author", "created_at_header", "kernel", "unit", "domain_hint"]


def part_index_rows(spark, d):
    """The whole index row of each part: signature, first metadata row, canonical and family, with defaults for what is missing."""
    s = table(spark, d, "signatures").select("part_id", "rel_path", "source_dataset", "content_hash", "has_points", "geom_hash").distinct()
    m = stats.keep_first(table(spark, d, "metas").select("part_id", *INDEX_META, "timestamp_source", "unit_source", "ingested_at"), "part_id", F.col("ingested_at"), *[F.col(c) for c in INDEX_META]).drop("ingested_at")
    out = s.join(m, "part_id", "left").join(duplicate_components(spark, d), "part_id", "left").join(family_clusters(spark, d), "part_id", "left")
    stamp = F.coalesce("timestamp_source", F.when(F.col("created_at_header").isNotNull(), "header").when(F.col("file_mtime_utc").isNotNull(), "mtime").otherwise("none"))
    unit = F.coalesce("unit_source", F.when(F.col("unit").isNull(), "unknown").otherwise("inferred_step_data"))
    return out.select("part_id", "rel_path", "source_dataset", *INDEX_META, stamp.alias("timestamp_source"), unit.alias("unit_source"), "content_hash", F.coalesce("geom_hash", F.lit("")).alias("geom_hash"),
                      F.coalesce("canonical", "part_id").alias("duplicate_canonical"), F.col("family").alias("family_id"), F.coalesce(F.col("has_points").cast("int"), F.lit(0)).alias("has_points"))


_RAW = f"v AS (SELECT part_id, list_transform({PACKED}, lambda x: x / ({LEN.format(PACKED)})) x FROM u)"
_ASKED = "('0x' || md5('42:' || part_id)[:8])::BIGINT % 50 = 0"
_RADIUS = f"""q AS (SELECT a.part_id a, sqrt(greatest(0.0, 2 - 2 * list_dot_product(a.x, b.x))) dist, row_number() OVER (PARTITION BY a.part_id ORDER BY list_dot_product(a.x, b.x) DESC, b.part_id) r FROM (SELECT * FROM v WHERE {_ASKED}) a JOIN v b ON a.part_id <> b.part_id),
  z AS (SELECT quantile_cont(dist, {QUANTILE}) * {SCALE} AS eps FROM q WHERE r = {K})"""
_NORMED = " || ".join(f"list_transform({PAD[c]}, lambda x: x / (2 * {LEN.format(PAD[c])}))" for c in BLOCKS)
_H = HASH.format("content_hash")
_DUPLICATES = f"""{USABLE}, w AS (SELECT part_id, bbox_ratio bb, {_NORMED} x FROM u), s AS (SELECT a.part_id a, b.part_id b, a.bb ba, b.bb bb, list_dot_product(a.x, b.x) sim FROM w a JOIN w b ON a.part_id <> b.part_id WHERE list_dot_product(a.x, b.x) >= 0.995),
  n AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(sim, 6) DESC, b) r FROM s), k AS (SELECT a, b FROM n WHERE r <= 9 AND greatest(abs(ba[1] - bb[1]), abs(ba[2] - bb[2])) <= 0.02),
  h AS (SELECT part_id p, min(part_id) OVER (PARTITION BY c) lo FROM (SELECT DISTINCT part_id, {_H} c FROM signatures) WHERE c IS NOT NULL),
  e AS (SELECT a x, b y FROM k UNION SELECT b, a FROM k UNION SELECT p, lo FROM h UNION SELECT lo, p FROM h UNION SELECT part_id, part_id FROM signatures), r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
  dup AS (SELECT x AS part_id, min(y) AS canonical FROM r GROUP BY x)"""
_FAMILIES = f"""{_RAW}, {_RADIUS}, g AS (SELECT a.part_id a, b.part_id b FROM v a JOIN v b ON true, z WHERE sqrt(greatest(0.0, 2 - 2 * list_dot_product(a.x, b.x))) <= eps), core AS (SELECT a AS p FROM g GROUP BY 1 HAVING count(*) >= {MIN_SAMPLES}),
  ce AS (SELECT a x, b y FROM g WHERE a IN (SELECT p FROM core) AND b IN (SELECT p FROM core)), cr AS (SELECT x, y FROM ce UNION SELECT cr.x, ce.y FROM cr JOIN ce ON cr.y = ce.x), lab AS (SELECT x AS p, min(y) AS l FROM cr GROUP BY x),
  bord AS (SELECT a AS p, min(l) AS l FROM g JOIN lab ON lab.p = g.b GROUP BY 1), hh AS (SELECT part_id, min({_H}) h FROM signatures GROUP BY 1),
  fam AS (SELECT part_id, CASE WHEN coalesce(lab.l, bord.l) IS NOT NULL THEN 'fam_' || coalesce(lab.l, bord.l) WHEN part_id IN (SELECT part_id FROM v) THEN 'fam_iso_' || CASE WHEN h IS NOT NULL THEN h[:10] ELSE sha1(part_id)[:10] END ELSE 'fam_ch_' || coalesce(h, 'unknown')[:8] END AS family
    FROM hh LEFT JOIN lab ON lab.p = part_id LEFT JOIN bord ON bord.p = part_id)"""
_ALONE = f"WITH RECURSIVE {USABLE}, {_FAMILIES}"
_META = ", ".join(INDEX_META)

QUERIES = {f.__name__: f for f in (signature_eps, duplicate_components, duplicate_summary, family_clusters, family_pieces, family_diagnostics, part_index_rows)}

SQL = {
    "signature_eps": f"WITH {USABLE}, {_RAW}, {_RADIUS} SELECT round(eps, 6) AS eps, sqrt(0.024) AS fallback, round(eps / sqrt(0.024), 6) AS ratio FROM z",
    "duplicate_components": f"WITH RECURSIVE {_DUPLICATES} SELECT * FROM dup",
    "duplicate_summary": f"WITH RECURSIVE {_DUPLICATES}, t AS (SELECT canonical, count(*) n FROM dup GROUP BY 1) SELECT sum(n)::BIGINT AS n_parts, count(*) FILTER (n > 1) AS n_groups, max(n) AS largest FROM t",
    "family_clusters": f"{_ALONE} SELECT * FROM fam",
    "family_diagnostics": f"{_ALONE}, t AS (SELECT family, count(*) n FROM fam GROUP BY 1) SELECT count(*) AS n_families, round(coalesce(sum(n) FILTER (starts_with(family, 'fam_iso_')), 0) / sum(n), 6) AS noise_share, round(coalesce(sum(n) FILTER (starts_with(family, 'fam_ch_')), 0) / sum(n), 6) AS no_geometry_share, max(n) AS largest FROM t",
    "part_index_rows": f"""WITH RECURSIVE {_DUPLICATES}, {_FAMILIES}, m AS (SELECT * FROM (SELECT part_id, {_META}, timestamp_source, unit_source, row_number() OVER (PARTITION BY part_id ORDER BY ingested_at, {', '.join(f'{c} NULLS FIRST' for c in INDEX_META)}) rn FROM metas) WHERE rn = 1)
        SELECT part_id, rel_path, source_dataset, {_META}, coalesce(timestamp_source, CASE WHEN created_at_header IS NOT NULL THEN 'header' WHEN file_mtime_utc IS NOT NULL THEN 'mtime' ELSE 'none' END) AS timestamp_source, coalesce(unit_source, CASE WHEN unit IS NULL THEN 'unknown' ELSE 'inferred_step_data' END) AS unit_source,
          content_hash, coalesce(geom_hash, '') AS geom_hash, coalesce(canonical, part_id) AS duplicate_canonical, family AS family_id, coalesce(has_points::INT, 0) AS has_points
        FROM (SELECT DISTINCT part_id, rel_path, source_dataset, content_hash, has_points, geom_hash FROM signatures) LEFT JOIN m USING (part_id) LEFT JOIN dup USING (part_id) LEFT JOIN fam USING (part_id)""",
}
