"""Queries over the part index and the metadata: repair, duplicates, distributions, scalar derivations, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.functions import scalars as S
from partloom.functions.ids import family_key, key128, part_ref, usable_hash
from partloom.operators import audit, cluster, stats
from partloom.operators.graph import tied_groups
from partloom.session import table

HASH = r"nullif(regexp_extract(lower({0}), '^\s*(?:[^:]*:)?\s*([0-9a-f]{{64}})\s*$', 1), '')"
REF = r"nullif(regexp_replace(replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\', '/'), '^\./', ''), '')"
PARTS = "(SELECT DISTINCT * FROM part_index_for_split)"


def parts(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The part index, each part once (repeated rows are equal)."""
    df = table(spark, d, "part_index_for_split")
    return (df.select("part_id", *columns) if columns else df).distinct()


def majority_label_repair(spark, d):
    return cluster.repair_families(parts(spark, d, "duplicate_canonical", "family_id")).select("part_id", "family_fixed")


def family_major_lookup(spark, d):
    return cluster.family_major(parts(spark, d, "duplicate_canonical", "family_id")).select("part_id", "family_vote")


def repair_report(spark, d):
    p = cluster.repair_families(parts(spark, d, "duplicate_canonical", "family_id"))
    side = lambda c, tag: p.agg(F.lit(tag).alias("stage"), F.count_distinct(c).alias("n_families"), F.round(F.avg(F.coalesce(F.col(c) == "fam_-1", F.lit(False)).cast("int")), 6).alias("noise_share"))
    changed = p.agg(F.lit("changed").alias("stage"), F.count_if(~F.col("family_id").eqNullSafe(F.col("family_fixed"))).alias("n_families"), F.lit(0.0).alias("noise_share"))
    return side("family_id", "before").unionByName(side("family_fixed", "after")).unionByName(changed)


def family_hist_pct(spark, d):
    return stats.share_of_all(parts(spark, d, "family_id"), "family_id")


def _hashed(spark, d, *more):
    return parts(spark, d, "content_hash", *more).withColumn("h", usable_hash(F.col("content_hash")))


def exact_dup_groups(spark, d):
    rows = _hashed(spark, d).filter(F.col("h").isNotNull())
    return rows.groupBy("h").agg(F.min("part_id").alias("canonical"), F.count("*").alias("n")).filter("n > 1").select("canonical", "n")


def dup_group_members(spark, d):
    rows = _hashed(spark, d).filter(F.col("h").isNotNull()).select("part_id", "h")
    low = rows.groupBy("h").agg(F.min("part_id").alias("canonical"), F.count("*").alias("n")).filter("n > 1").select("h", "canonical")
    return rows.join(low, "h").select("part_id", "canonical")


def dup_singleton_ratio(spark, d):
    return stats.singleton_share(_hashed(spark, d), "h")


def hash_multi_canonical(spark, d):
    return audit.many_per_group(_hashed(spark, d, "duplicate_canonical"), "h", "duplicate_canonical")


def canonical_multi_family(spark, d):
    return audit.many_per_group(parts(spark, d, "duplicate_canonical", "family_id"), "duplicate_canonical", "family_id")


def canonical_purity(spark, d):
    return audit.purity(parts(spark, d, "duplicate_canonical", "family_id"), "duplicate_canonical", "family_id")


def family_breadth(spark, d):
    rows = parts(spark, d, "family_id", "source_dataset", "kernel").filter(~F.col("family_id").startswith("fam_iso_") & ~F.col("family_id").startswith("fam_ch_"))
    return stats.distinct_per_group(rows, "family_id", "source_dataset", "kernel")


def group_metrics_top20(spark, d):
    rows = _hashed(spark, d, "family_id", "geom_hash").withColumn("g", usable_hash(F.col("geom_hash")))
    return stats.distinct_per_group(rows, "family_id", "h", "g").orderBy(F.desc("n"), "family_id").limit(20)


def noise_ratio_by_dataset(spark, d):
    return stats.share_where(parts(spark, d, "source_dataset", "family_id"), F.col("family_id") == "fam_-1", "source_dataset")


def noise_ratio_by_kernel(spark, d):
    return stats.share_where(parts(spark, d, "kernel", "family_id"), F.col("family_id") == "fam_-1", "kernel")


def lodo_readiness(spark, d):
    sizes = stats.group_sizes(parts(spark, d, "family_id").filter(F.col("family_id").isNotNull()), "family_id")
    return sizes.agg(*[F.count_if(F.col("n") >= k).alias(f"at_least_{k}") for k in (10, 50, 100)], F.count("*").alias("n_families"))


def topn_distribution(spark, d):
    return stats.top_n(parts(spark, d, "originating_system"), F.col("originating_system"), 10)


def topn_binned(spark, d):
    return stats.binned(table(spark, d, "lineitem"), F.col("l_quantity"), 12)


def describe_groups(spark, d):
    return stats.describe(table(spark, d, "lineitem"), "l_quantity", "l_returnflag")


def null_rates(spark, d):
    return stats.null_rates(table(spark, d, "part_index_for_split"), ["created_at_header", "unit", "family_id", "duplicate_canonical", "content_hash", "geom_hash", "timestamp", "author"])


def dup_key_rows(spark, d):
    rows = stats.repeated_rows(table(spark, d, "metas"), "part_id")
    return rows.select("part_id", F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss").alias("at"))


def keep_first(spark, d):
    rows = table(spark, d, "metas").select("part_id", "src", F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss").alias("ingested"))
    return stats.keep_first(rows, "part_id", F.col("ingested"), F.col("src"))


def domain_build(spark, d):
    p = parts(spark, d, "source_dataset", "kernel", "format")
    return p.select("part_id", S.build_domain(dataset=F.col("source_dataset"), kernel=F.col("kernel"), format=F.col("format")).alias("domain"))


def sanitize_tokens(spark, d):
    return parts(spark, d, "originating_system", "author").select("part_id", S.sanitize_token(F.col("originating_system")).alias("system"), S.sanitize_token(F.col("author")).alias("author"))


def date_from_text(spark, d):
    return parts(spark, d, "timestamp").select("part_id", F.date_format(S.date_from_text(F.col("timestamp")), "yyyy-MM-dd").alias("day"))


def ts_coalesce_source(spark, d):
    p = parts(spark, d, "timestamp", "created_at_header", "rel_path")
    day, tag = S.dated([F.col("timestamp"), F.col("created_at_header")], F.col("rel_path"))
    return p.select("part_id", F.date_format(day, "yyyy-MM-dd").alias("day"), tag.alias("source"))


def header_datetimes(spark, d):
    """The header's date and time of every metadata row as ISO text, in UTC where it has an offset."""
    m = table(spark, d, "metas").select("part_id", "created_at_header").distinct()
    return m.select("part_id", S.header_datetime(F.col("created_at_header")).alias("created"))


def utc_times(spark, d):
    """File times and header times in microseconds UTC, null where the text is none; without an offset they are UTC."""
    m = table(spark, d, "metas").select("part_id", "file_mtime_utc", "created_at_header").distinct()
    return m.select("part_id", *[F.unix_micros(S.iso_time(F.col(c))[0]).alias(a) for c, a in (("file_mtime_utc", "mtime_us"), ("created_at_header", "created_us"))])


def column_check(spark, d):
    """Columns of the part index that it must have and should have, and whether they are there."""
    return audit.column_check(table(spark, d, "part_index_for_split"), ["part_id", "content_hash", "family_id", "duplicate_canonical"], ["unit", "author", "tolerance"])


def path_segments(spark, d):
    return parts(spark, d, "rel_path").select("part_id", S.path_dataset(F.col("rel_path")).alias("dataset"), S.path_repo(F.col("rel_path")).alias("repo"), S.flat_name(F.col("rel_path")).alias("file_name"), S.short_md5(F.col("rel_path")).alias("short_name"))


def kernel_ladder(spark, d):
    p = parts(spark, d, "file_ext", "originating_system")
    fmt = S.file_format(F.col("file_ext"))
    return p.select("part_id", fmt.alias("format"), S.guess_kernel(fmt, F.col("originating_system")).alias("kernel"))


def unit_labels(spark, d):
    return parts(spark, d, "unit").select("part_id", S.infer_unit(F.col("unit")).alias("inferred"), S.normalise_unit(F.col("unit")).alias("normalised"))


def unknown_units(spark, d):
    p = parts(spark, d, "unit", "source_dataset").withColumn("u", S.normalise_unit(F.col("unit")))
    return p.filter(F.col("u").isNotNull() & ~F.col("u").isin("mm", "in")).groupBy("source_dataset").agg(F.count("*").alias("n"))


def timestamp_sources(spark, d):
    m = table(spark, d, "metas").select("part_id", "created_at_header", "file_mtime_utc").distinct()
    return stats.share_of_all(m.select(S.timestamp_source(F.col("created_at_header"), F.col("file_mtime_utc")).alias("source")), "source")


def timestamp_parse_rate(spark, d):
    p = parts(spark, d, "timestamp", "source_dataset")
    return stats.share_where(p.withColumn("ok", S.explicit_date(F.col("timestamp")).isNotNull()), F.col("ok"), "source_dataset")


def monthly_counts(spark, d):
    return stats.monthly(table(spark, d, "domains").distinct(), "timestamp")


def ts_quality(spark, d):
    t = table(spark, d, "domains").select("part_id", "timestamp").distinct()
    return t.agg(F.count("timestamp").alias("valid"), F.count_if(F.col("timestamp").isNull()).alias("missing"), F.round(100 * F.count("timestamp") / F.count("*"), 2).alias("pct"), F.date_format(F.min("timestamp"), "yyyy-MM-dd").alias("first"), F.date_format(F.max("timestamp"), "yyyy-MM-dd").alias("last"))


def unknown_domains(spark, d):
    return stats.share_where(table(spark, d, "domains").distinct(), F.col("domain").isNull(), "source_dataset")


def distinct_totals(spark, d):
    p = parts(spark, d, "family_id", "duplicate_canonical", "source_dataset", "kernel")
    return p.agg(*[F.count_distinct(c).alias(f"n_{c}") for c in ("part_id", "family_id", "duplicate_canonical", "source_dataset", "kernel")])


def fill_from_index(spark, d):
    """Domains whose unit is missing take it from the part index."""
    dom = table(spark, d, "domains").select("part_id", "unit").distinct()
    lookup = parts(spark, d, "unit").groupBy("part_id").agg(F.min("unit").alias("index_unit"))
    return dom.join(lookup, "part_id", "left").select("part_id", F.coalesce("unit", "index_unit").alias("unit"))


def release_dates(spark, d):
    """The earliest known date of each data set, given to its parts that have none."""
    dom = table(spark, d, "domains").select("part_id", "source_dataset", "timestamp").distinct()
    release = dom.groupBy("source_dataset").agg(F.min("timestamp").alias("release"))
    return dom.filter(F.col("timestamp").isNull()).join(release, "source_dataset", "left").select("part_id", F.date_format("release", "yyyy-MM-dd").alias("day"))


def noise_policy(spark, d):
    p = _hashed(spark, d, "family_id", "duplicate_canonical", "has_points")
    label = F.when(F.col("family_id") == "fam_-1", -1).otherwise(0)
    name = F.when(F.col("has_points") == 0, cluster.no_geometry_family(F.col("h"))).otherwise(F.coalesce(cluster.noise_family(label, F.col("h"), F.coalesce(part_ref(F.col("duplicate_canonical")), F.col("part_id"))), F.col("family_id")))
    return p.select("part_id", name.alias("family"))


def no_geometry_naming(spark, d):
    p = parts(spark, d, "has_points", "family_id")
    return stats.share_where(p.filter("has_points = 0"), F.col("family_id").startswith("fam_ch_"), "has_points")


def oversize_families(spark, d):
    return audit.oversize(parts(spark, d, "family_id").filter(F.col("family_id").isNotNull()), "family_id", 0.02, 6000)


def audit_verdict(spark, d):
    return audit.verdict(table(spark, d, "part_index_for_split"), ["unit", "author", "timestamp"])


def index_assembly(spark, d):
    """The index row of each part from signatures, metadata and domains, with defaults for what is missing."""
    s = table(spark, d, "signatures").select("part_id", "rel_path", "source_dataset", "content_hash", "has_points", "geom_hash").distinct()
    m = stats.keep_first(table(spark, d, "metas").select("part_id", "file_ext", "format", "kernel", "ingested_at"), "part_id", F.col("ingested_at"), F.col("file_ext")).drop("ingested_at")
    out = s.join(m, "part_id", "left")
    return out.select("part_id", "rel_path", F.coalesce("source_dataset", F.lit("unknown")).alias("source_dataset"), F.coalesce("format", F.lit("UNKNOWN")).alias("format"), "file_ext", F.coalesce("kernel", F.lit("UNKNOWN")).alias("kernel"), F.coalesce("geom_hash", F.lit("")).alias("geom_hash"), F.col("has_points").cast("int").alias("has_points"))


def strong_groups(spark, d):
    """Parts joined by a canonical or a usable content hash, by the smallest part id."""
    p = parts(spark, d, "duplicate_canonical", "content_hash")
    keys = F.array_compact(F.array(key128(F.lit("d"), part_ref(F.col("duplicate_canonical"))), key128(F.lit("h"), usable_hash(F.col("content_hash")))))
    return tied_groups(p.select("part_id", keys.alias("keys")))


def split_components(spark, d):
    """Parts joined by a family or a usable content hash, by the smallest part id; noise and blank families join nothing."""
    p = parts(spark, d, "family_id", "content_hash")
    keys = F.array_compact(F.array(key128(F.lit("f"), family_key(F.col("family_id"))), key128(F.lit("h"), usable_hash(F.col("content_hash")))))
    return tied_groups(p.select("part_id", keys.alias("keys")), label="component")


MAJOR = """maj AS (SELECT c, f FROM (SELECT c, f, row_number() OVER (PARTITION BY c ORDER BY count(*) DESC, f) r FROM p WHERE c IS NOT NULL AND f IS NOT NULL {0} GROUP BY c, f) WHERE r = 1)"""
BASE = "WITH p AS (SELECT DISTINCT part_id, duplicate_canonical c, family_id f FROM part_index_for_split)"
MANY = "AND c IN (SELECT c FROM p WHERE c IS NOT NULL GROUP BY c HAVING count(DISTINCT f) > 1)"
TOKEN = r"CASE WHEN {0} IS NULL OR trim({0}) = '' OR lower(trim({0})) = 'nan' THEN 'NA' ELSE regexp_replace(regexp_replace(lower(trim({0})), '\s+', '_', 'g'), '[^a-z0-9_\-.]', '-', 'g') END"
FORMATS = ("%Y-%m-%d", "%Y/%m/%d", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d %H:%M:%S", "%d-%m-%Y", "%d/%m/%Y")
LENIENT = ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d %H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d %H:%M", "%m/%d/%Y %H:%M:%S", "%m/%d/%Y %H:%M", "%d/%m/%Y %H:%M", "%m-%d-%Y %H:%M:%S", "%d/%m/%Y %H:%M:%S", "%d-%m-%Y %H:%M:%S", "%d %b %Y %H:%M:%S", "%d %b %Y", "%d %B %Y %H:%M:%S", "%d %B %Y", "%b %d, %Y", "%B %d, %Y")


def _explicit(c: str) -> str:
    first = f"regexp_replace(trim(split_part({c}, '.', 1)), '\\s+', ' ', 'g')"
    bare = f"regexp_replace(regexp_replace(regexp_replace(trim({c}), '\\s+', ' ', 'g'), '^[A-Za-z]{{3,9}}, ', ''), '(\\.[0-9]+)? ?(Z|UTC|GMT|[+-][0-9][0-9]:?[0-9][0-9])?$', '')"
    packed = f"CASE WHEN regexp_full_match({bare}, '[0-9]{{8}}(T[0-9]{{6}})?') THEN try_strptime({bare}[:8], '%Y%m%d') END"
    read = lambda x, f: f"CASE WHEN regexp_matches({x}, '(^|[^0-9])[0-9]{{4}}([^0-9]|$)') THEN try_strptime({x}, '{f}') END"
    return "coalesce(" + ", ".join([*(read(first, f) for f in FORMATS), packed, *(read(bare, f) for f in LENIENT)]) + ")"


def _text_date(c: str) -> str:
    def pick(p: str, y: int, m: int, k: int) -> str:
        part = lambda g, n: f"lpad(nullif(regexp_extract({c}, '{p}', {g}), ''), {n}, '0')"
        return f"try_cast({part(y, 4)} || '-' || {part(m, 2)} || '-' || {part(k, 2)} AS DATE)"

    year, month, day = "(20[0-9][0-9])", "(10|11|12|0?[1-9])", "(30|31|[12][0-9]|0?[1-9])"
    gap = "[-_/.]"
    return f"coalesce({pick(year + gap + month + gap + day, 1, 2, 3)}, {pick(year + '(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])', 1, 2, 3)}, {pick(day + gap + month + gap + year, 3, 2, 1)})"


def _aware(c: str) -> str:
    return f"regexp_matches(trim({c}), '[0-9][+-][0-9][0-9]:[0-9][0-9]$') AND length(trim({c})) > 13"


def _iso(c: str) -> str:
    """Date and time of an ISO or packed text by casts, less its offset."""
    iso = "[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}(:[0-9]{2}(:[0-9]{2}([.]([0-9]{3}|[0-9]{6}))?)?)?([+-][0-9]{2}:[0-9]{2})?)?"
    body = f"regexp_replace(trim({c}), '([0-9])[+-][0-9]{{2}}:[0-9]{{2}}$', '\\1')"
    full = f"CASE length({body}) WHEN 10 THEN {body} || ' 00:00:00' WHEN 13 THEN {body} || ':00:00' WHEN 16 THEN {body} || ':00' ELSE {body} END"
    off = f"CASE WHEN {_aware(c)} THEN (trim({c})[-6:-6] || '1')::INT * (trim({c})[-5:-4]::INT * 60 + trim({c})[-2:]::INT) ELSE 0 END"
    return f"CASE WHEN regexp_full_match(trim({c}), '{iso}') THEN try_cast({full} AS TIMESTAMP) - to_minutes({off}) WHEN regexp_full_match(trim({c}), '[0-9]{{8}}T[0-9]{{6}}') THEN try_strptime(trim({c}), '%Y%m%dT%H%M%S') END"


def _normal_unit(c: str) -> str:
    return f"CASE WHEN lower(trim({c})) IN ('mm','millimeter','millimetre','millimeters','millimetres') THEN 'mm' WHEN lower(trim({c})) IN ('in','inch','inches','\"') THEN 'in' ELSE lower(trim({c})) END"


def _kernel(fmt: str, system: str) -> str:
    cases = "".join(f" WHEN {fmt} = 'STEP' AND contains(lower(coalesce({system}, '')), '{w}') THEN '{k}'" for k, ws in S.KERNEL_WORDS.items() for w in ws)
    return f"CASE WHEN {fmt} = 'BREP' THEN 'OpenCascade'{cases} WHEN {fmt} = 'STEP' THEN 'STEP' ELSE 'UNKNOWN' END"


STRONG_KEYS = f"SELECT DISTINCT part_id p, 'd:' || {REF.format('duplicate_canonical')} k FROM part_index_for_split WHERE {REF.format('duplicate_canonical')} IS NOT NULL UNION SELECT part_id, 'h:' || {HASH.format('content_hash')} FROM part_index_for_split WHERE {HASH.format('content_hash')} IS NOT NULL"
FAM = r"lower(regexp_replace(family_id, '^\s+|\s+$', '', 'g'))"
COMPONENT_KEYS = f"SELECT DISTINCT part_id p, 'f:' || {FAM} k FROM part_index_for_split WHERE {FAM} NOT IN ('', 'fam_-1') UNION SELECT part_id, 'h:' || {HASH.format('content_hash')} FROM part_index_for_split WHERE {HASH.format('content_hash')} IS NOT NULL"


def _tied(name: str, keys: str) -> str:
    """Groups of parts that share keys ``(p, k)``, as ``<name>_g(part_id, lo, n)``, by everything that is reached from each part."""
    return f"""{name}_k AS ({keys}), {name}_o AS (SELECT p, min(p) OVER (PARTITION BY k) lo FROM {name}_k), {name}_e AS (SELECT DISTINCT p x, lo y FROM {name}_o UNION SELECT lo, p FROM {name}_o),
      {name}_r AS (SELECT x, y FROM {name}_e UNION SELECT {name}_r.x, {name}_e.y FROM {name}_r JOIN {name}_e ON {name}_r.y = {name}_e.x), {name}_g AS (SELECT x AS part_id, min(y) lo, count(DISTINCT y) n FROM {name}_r GROUP BY x)"""


FMT = "CASE WHEN lower(file_ext) IN ('.step','.stp','.stpz') THEN 'STEP' WHEN lower(file_ext) IN ('.brep','.brp') THEN 'BREP' ELSE 'UNKNOWN' END"
H = HASH.format("content_hash")

QUERIES = {
    f.__name__: f
    for f in (
        majority_label_repair, family_major_lookup, repair_report, family_hist_pct, exact_dup_groups, dup_group_members, dup_singleton_ratio, hash_multi_canonical,
        canonical_multi_family, canonical_purity, family_breadth, group_metrics_top20, noise_ratio_by_dataset, noise_ratio_by_kernel, lodo_readiness, topn_distribution,
        topn_binned, describe_groups, null_rates, dup_key_rows, keep_first, domain_build, sanitize_tokens, date_from_text, ts_coalesce_source, header_datetimes, utc_times, column_check, path_segments, kernel_ladder,
        unit_labels, unknown_units, timestamp_sources, timestamp_parse_rate, monthly_counts, ts_quality, unknown_domains, distinct_totals, fill_from_index, release_dates,
        noise_policy, no_geometry_naming, oversize_families, audit_verdict, index_assembly, strong_groups, split_components,
    )
}

SQL = {
    "majority_label_repair": f"{BASE}, {MAJOR.format(MANY)} SELECT part_id, coalesce(maj.f, p.f) AS family_fixed FROM p LEFT JOIN maj USING (c)",
    "family_major_lookup": f"{BASE}, {MAJOR.format('')} SELECT part_id, coalesce(maj.f, p.f) AS family_vote FROM p LEFT JOIN maj USING (c)",
    "repair_report": f"""{BASE}, {MAJOR.format(MANY)}, r AS (SELECT p.f, coalesce(maj.f, p.f) g FROM p LEFT JOIN maj USING (c))
        SELECT 'before' AS stage, count(DISTINCT f) AS n_families, round(avg(coalesce(f = 'fam_-1', false)::INT), 6) AS noise_share FROM r
        UNION ALL SELECT 'after', count(DISTINCT g), round(avg(coalesce(g = 'fam_-1', false)::INT), 6) FROM r
        UNION ALL SELECT 'changed', count(*) FILTER (f IS DISTINCT FROM g), 0.0 FROM r""",
    "family_hist_pct": "SELECT family_id, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS pct FROM (SELECT DISTINCT part_id, family_id FROM part_index_for_split) GROUP BY 1",
    "exact_dup_groups": f"SELECT min(part_id) AS canonical, count(*) AS n FROM (SELECT DISTINCT part_id, {H} h FROM part_index_for_split) WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1",
    "dup_group_members": f"SELECT part_id, canonical FROM (SELECT part_id, min(part_id) OVER (PARTITION BY h) AS canonical, count(*) OVER (PARTITION BY h) n FROM (SELECT DISTINCT part_id, {H} h FROM part_index_for_split) WHERE h IS NOT NULL) WHERE n > 1",
    "dup_singleton_ratio": f"SELECT count(*) AS n_groups, round(avg((n = 1)::INT), 6) AS singleton_share FROM (SELECT h, count(*) n FROM (SELECT DISTINCT part_id, {H} h FROM part_index_for_split) WHERE h IS NOT NULL GROUP BY h)",
    "hash_multi_canonical": f"SELECT h AS value, count(DISTINCT c) AS n_values, count(*) AS n FROM (SELECT DISTINCT part_id, {H} h, duplicate_canonical c FROM part_index_for_split) WHERE h IS NOT NULL GROUP BY h HAVING count(DISTINCT c) > 1",
    "canonical_multi_family": f"{BASE} SELECT c AS value, count(DISTINCT f) AS n_values, count(*) AS n FROM p WHERE c IS NOT NULL GROUP BY c HAVING count(DISTINCT f) > 1",
    "canonical_purity": f"{BASE} SELECT count(*) AS n_groups, round(avg((k <= 1)::INT), 6) AS pure_share, round(avg(k), 6) AS mean_values, max(k) AS max_values FROM (SELECT c, count(DISTINCT f) k FROM p WHERE c IS NOT NULL GROUP BY c)",
    "family_breadth": f"SELECT family_id, count(*) AS n, count(DISTINCT source_dataset) AS n_source_dataset, count(DISTINCT kernel) AS n_kernel FROM (SELECT DISTINCT part_id, family_id, source_dataset, kernel FROM {PARTS}) WHERE family_id NOT LIKE 'fam\\_iso\\_%' ESCAPE '\\' AND family_id NOT LIKE 'fam\\_ch\\_%' ESCAPE '\\' GROUP BY 1",
    "group_metrics_top20": f"SELECT family_id, count(*) AS n, count(DISTINCT h) AS n_h, count(DISTINCT g) AS n_g FROM (SELECT DISTINCT part_id, family_id, {H} h, {HASH.format('geom_hash')} g FROM part_index_for_split) WHERE family_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, family_id LIMIT 20",
    "noise_ratio_by_dataset": "SELECT source_dataset, count(*) AS n, round(avg(coalesce(family_id = 'fam_-1', false)::INT), 6) AS share FROM (SELECT DISTINCT part_id, source_dataset, family_id FROM part_index_for_split) GROUP BY 1",
    "noise_ratio_by_kernel": "SELECT kernel, count(*) AS n, round(avg(coalesce(family_id = 'fam_-1', false)::INT), 6) AS share FROM (SELECT DISTINCT part_id, kernel, family_id FROM part_index_for_split) GROUP BY 1",
    "lodo_readiness": "SELECT count(*) FILTER (n >= 10) AS at_least_10, count(*) FILTER (n >= 50) AS at_least_50, count(*) FILTER (n >= 100) AS at_least_100, count(*) AS n_families FROM (SELECT family_id, count(*) n FROM (SELECT DISTINCT part_id, family_id FROM part_index_for_split) WHERE family_id IS NOT NULL GROUP BY 1)",
    "topn_distribution": "SELECT value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS pct FROM (SELECT lower(trim(originating_system)) AS value FROM (SELECT DISTINCT part_id, originating_system FROM part_index_for_split)) WHERE value IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 10",
    "topn_binned": "WITH e AS (SELECT min(l_quantity::DOUBLE) lo, max(l_quantity::DOUBLE) hi FROM lineitem) SELECT CAST(least(12, greatest(1, ceil((l_quantity::DOUBLE - lo) / ((hi - lo) / 12)))) AS INT) AS bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS pct FROM lineitem, e WHERE l_quantity IS NOT NULL GROUP BY 1",
    "describe_groups": "SELECT l_returnflag, count(x) AS n, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, min(x) AS min, round(quantile_cont(x, 0.5), 4) AS p50, round(quantile_cont(x, 0.9), 4) AS p90, round(quantile_cont(x, 0.95), 4) AS p95, round(quantile_cont(x, 0.99), 4) AS p99, max(x) AS max FROM (SELECT l_returnflag, l_quantity::DOUBLE x FROM lineitem) GROUP BY 1",
    "null_rates": " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg(({c} IS NULL)::INT), 6) AS null_rate FROM part_index_for_split" for c in ("created_at_header", "unit", "family_id", "duplicate_canonical", "content_hash", "geom_hash", "timestamp", "author")),
    "dup_key_rows": "SELECT part_id, strftime(ingested_at, '%Y-%m-%d %H:%M:%S') AS at FROM (SELECT *, count(*) OVER (PARTITION BY part_id) n FROM metas) WHERE n > 1",
    "keep_first": "SELECT part_id, src, seen AS ingested FROM (SELECT part_id, src, strftime(ingested_at, '%Y-%m-%d %H:%M:%S') AS seen, row_number() OVER (PARTITION BY part_id ORDER BY ingested_at, src) r FROM metas) WHERE r = 1",
    "domain_build": f"SELECT part_id, concat('domain:dataset=', {TOKEN.format('source_dataset')}, '|kernel=', {TOKEN.format('kernel')}, '|format=', {TOKEN.format('format')}) AS domain FROM {PARTS}",
    "sanitize_tokens": f"SELECT part_id, {TOKEN.format('originating_system')} AS system, {TOKEN.format('author')} AS author FROM (SELECT DISTINCT part_id, originating_system, author FROM part_index_for_split)",
    "date_from_text": f"SELECT part_id, strftime({_text_date('timestamp')}, '%Y-%m-%d') AS day FROM (SELECT DISTINCT part_id, timestamp FROM part_index_for_split)",
    "ts_coalesce_source": f"""SELECT part_id, strftime(coalesce(e::DATE, t), '%Y-%m-%d') AS day, CASE WHEN e IS NOT NULL THEN 'explicit' WHEN t IS NOT NULL THEN 'path' ELSE 'none' END AS source
        FROM (SELECT part_id, coalesce({_explicit('timestamp')}, {_explicit('created_at_header')}) e, {_text_date('rel_path')} t FROM (SELECT DISTINCT part_id, timestamp, created_at_header, rel_path FROM part_index_for_split))""",
    "header_datetimes": f"SELECT part_id, CASE WHEN u IS NOT NULL THEN replace(strftime(u, '%Y-%m-%dT%H:%M:%S.%f'), '.000000', '') || CASE WHEN aware THEN '+00:00' ELSE '' END END AS created FROM (SELECT part_id, {_iso('created_at_header')} u, {_aware('created_at_header')} aware FROM (SELECT DISTINCT part_id, created_at_header FROM metas))",
    "utc_times": f"SELECT part_id, epoch_us({_iso('file_mtime_utc')}) AS mtime_us, epoch_us({_iso('created_at_header')}) AS created_us FROM (SELECT DISTINCT part_id, file_mtime_utc, created_at_header FROM metas)",
    "column_check": "WITH w AS (SELECT unnest(['part_id', 'content_hash', 'family_id', 'duplicate_canonical', 'unit', 'author', 'tolerance']) AS column_name), c AS (SELECT column_name FROM information_schema.columns WHERE table_name = 'part_index_for_split') SELECT column_name, CASE WHEN column_name IN ('unit', 'author', 'tolerance') THEN 'recommended' ELSE 'required' END AS need, column_name IN (SELECT column_name FROM c) AS present FROM w",
    "path_segments": f"SELECT part_id, CASE WHEN contains(rel_path, '/') THEN split_part(rel_path, '/', 1) ELSE 'unknown' END AS dataset, nullif(split_part(rel_path, '/', 2), '') AS repo, replace(rel_path, '/', '__') AS file_name, md5(rel_path)[:16] AS short_name FROM {PARTS}",
    "kernel_ladder": f"SELECT part_id, {FMT} AS format, {_kernel(f'({FMT})', 'originating_system')} AS kernel FROM {PARTS}",
    "unit_labels": f"SELECT part_id, CASE WHEN contains(upper(unit), 'INCH') THEN 'inch' WHEN contains(upper(unit), 'MILLI') AND contains(upper(unit), 'METRE') THEN 'mm' WHEN contains(upper(unit), 'METRE') THEN 'm' END AS inferred, {_normal_unit('unit')} AS normalised FROM {PARTS}",
    "unknown_units": f"SELECT source_dataset, count(*) AS n FROM {PARTS} WHERE unit IS NOT NULL AND {_normal_unit('unit')} NOT IN ('mm', 'in') GROUP BY 1",
    "timestamp_sources": "SELECT source, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS pct FROM (SELECT CASE WHEN trim(created_at_header) <> '' THEN 'header' WHEN trim(file_mtime_utc) <> '' THEN 'mtime' ELSE 'none' END AS source FROM (SELECT DISTINCT part_id, created_at_header, file_mtime_utc FROM metas)) GROUP BY 1",
    "timestamp_parse_rate": f"SELECT source_dataset, count(*) AS n, round(avg(({_explicit('timestamp')} IS NOT NULL)::INT), 6) AS share FROM (SELECT DISTINCT part_id, timestamp, source_dataset FROM part_index_for_split) GROUP BY 1",
    "monthly_counts": "SELECT strftime(timestamp, '%Y-%m') AS month, count(*) AS n FROM (SELECT DISTINCT * FROM domains) WHERE timestamp IS NOT NULL GROUP BY 1",
    "ts_quality": "SELECT count(timestamp) AS valid, count(*) - count(timestamp) AS missing, round(100 * count(timestamp) / count(*), 2) AS pct, strftime(min(timestamp), '%Y-%m-%d') AS first, strftime(max(timestamp), '%Y-%m-%d') AS last FROM (SELECT DISTINCT part_id, timestamp FROM domains)",
    "unknown_domains": "SELECT source_dataset, count(*) AS n, round(avg((domain IS NULL)::INT), 6) AS share FROM (SELECT DISTINCT * FROM domains) GROUP BY 1",
    "distinct_totals": "SELECT " + ", ".join(f"count(DISTINCT {c}) AS n_{c}" for c in ("part_id", "family_id", "duplicate_canonical", "source_dataset", "kernel")) + " FROM part_index_for_split",
    "fill_from_index": "SELECT part_id, coalesce(d.unit, u) AS unit FROM (SELECT DISTINCT part_id, unit FROM domains) d LEFT JOIN (SELECT part_id, min(unit) u FROM part_index_for_split GROUP BY 1) USING (part_id)",
    "release_dates": "WITH t AS (SELECT DISTINCT part_id, source_dataset, timestamp FROM domains) SELECT part_id, strftime(r, '%Y-%m-%d') AS day FROM t LEFT JOIN (SELECT source_dataset, min(timestamp) r FROM t GROUP BY 1) x ON t.source_dataset IS NOT DISTINCT FROM x.source_dataset WHERE timestamp IS NULL",
    "noise_policy": f"SELECT part_id, CASE WHEN has_points = 0 THEN concat('fam_ch_', coalesce(h, 'unknown')[:8]) WHEN f = 'fam_-1' THEN concat('fam_iso_', CASE WHEN h IS NOT NULL THEN h[:10] ELSE sha1(coalesce({REF.format('c')}, part_id))[:10] END) ELSE f END AS family FROM (SELECT DISTINCT part_id, has_points, {H} h, family_id f, duplicate_canonical c FROM part_index_for_split)",
    "no_geometry_naming": "SELECT has_points, count(*) AS n, round(avg(coalesce(starts_with(family_id, 'fam_ch_'), false)::INT), 6) AS share FROM (SELECT DISTINCT part_id, has_points, family_id FROM part_index_for_split) WHERE has_points = 0 GROUP BY 1",
    "oversize_families": "WITH p AS (SELECT DISTINCT part_id, family_id FROM part_index_for_split WHERE family_id IS NOT NULL) SELECT family_id, count(*) AS n FROM p GROUP BY 1 HAVING count(*) > greatest(1, least(6000, floor((SELECT count(*) FROM p) * 0.02)))",
    "audit_verdict": """WITH i AS (SELECT count(*) FILTER (n > 1) r FROM (SELECT part_id, count(*) n FROM part_index_for_split GROUP BY 1)),
        h AS (SELECT count(*) s FROM (SELECT content_hash FROM (SELECT DISTINCT * FROM part_index_for_split) WHERE content_hash IS NOT NULL GROUP BY 1 HAVING count(DISTINCT duplicate_canonical) > 1)),
        g AS (SELECT greatest(avg((unit IS NULL)::INT), avg((author IS NULL)::INT), avg((timestamp IS NULL)::INT)) w FROM part_index_for_split)
        SELECT r AS repeated_ids, s AS split_hashes, round(w, 6) AS worst_gap, CASE WHEN r > 0 OR s > 0 THEN 'FAIL' WHEN w > 0 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS verdict FROM i, h, g""",
    "index_assembly": """SELECT part_id, rel_path, coalesce(source_dataset, 'unknown') AS source_dataset, coalesce(format, 'UNKNOWN') AS format, file_ext, coalesce(kernel, 'UNKNOWN') AS kernel, coalesce(geom_hash, '') AS geom_hash, has_points::INT AS has_points
        FROM (SELECT DISTINCT part_id, rel_path, source_dataset, content_hash, has_points, geom_hash FROM signatures) LEFT JOIN (SELECT part_id, file_ext, format, kernel FROM (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY ingested_at, file_ext) r FROM metas) WHERE r = 1) USING (part_id)""",
    "strong_groups": f"WITH RECURSIVE {_tied('s', STRONG_KEYS)} SELECT part_id, lo AS grp FROM s_g WHERE n > 1",
    "split_components": f"WITH RECURSIVE {_tied('s', COMPONENT_KEYS)} SELECT part_id, lo AS component FROM s_g WHERE n > 1",
}
