"""Queries that write given tables in the formats of the sources, read them back, and so show what the readers make of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partloom.functions import scalars as S
from partloom.functions.ids import part_ref
from partloom.plans.index_queries import REF, parts
from partloom.session import shared_dir, table
from partloom.sources import readers, sinks


def _folder(spark, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/partloom-{tag}-{uuid.uuid4().hex}"


def index_from_csv(spark, d):
    """The part index written as a delimited table and found again by its name in the folder."""
    folder, p = _folder(spark, "csv"), parts(spark, d)
    sinks.write_csv(p, f"{folder}/part_index.csv")
    back = readers.part_index(spark, folder, p.schema)
    return back.select("part_id", "timestamp", "author", "unit", "family_id", "geom_hash", "file_size_bytes", "has_points")


def index_head_semicolon(spark, d):
    """The same with another separator and encoding, counted by source."""
    folder, p = _folder(spark, "sep"), parts(spark, d, "source_dataset", "author")
    p.write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").option("escape", '"').csv(folder)
    return readers.delimited(spark, folder, p.schema, sep=";", encoding="ISO-8859-1").groupBy("source_dataset").agg(F.count("*").alias("n"), F.count("author").alias("n_authors"))


def signatures_from_csv(spark, d):
    """Signatures with their arrays as JSON texts, read back: lengths of the arrays and the truth value."""
    folder = _folder(spark, "signatures")
    sinks.write_csv(table(spark, d, "signatures").select(*readers.SIGNATURES.names).distinct(), folder)
    back = readers.signatures_csv(spark, folder)
    return back.select("part_id", "has_points", *[F.when(F.col(c).isNotNull(), F.size(c)).alias(c) for c in ("d2_hist", "bbox_ratio", "surf_hist", "dih_hist")])


def split_list_files(spark, d):
    """Split lists written as files of lines and read back: lines that name a part, by list."""
    folder = _folder(spark, "lists")
    sinks.write_splits(table(spark, d, "split_lists"), folder)
    return readers.id_lists(spark, folder).groupBy("protocol", "split_id", "subset").agg(F.count("*").alias("n_lines"), F.count_distinct("part_id").alias("n_texts"))


def candidate_lines(spark, d):
    """Hole candidates as JSON lines, those without a depth cut off in the middle: parsed and broken lines by source, and the
    sum of the depths that came back."""
    folder = _folder(spark, "lines")
    h = table(spark, d, "hole_candidates").dropDuplicates(["hole_id"])
    line = F.to_json(F.struct("source_dataset", *readers.CANDIDATES.names))
    h.select(F.when(F.col("H0").isNull(), F.substring(line, 1, 40)).otherwise(line).alias("value")).write.text(folder)
    rows, bad = readers.json_lines(spark, folder, T.StructType([T.StructField("source_dataset", T.StringType()), *readers.CANDIDATES.fields]))
    good = rows.groupBy("source_dataset").agg(F.count("*").alias("n"), F.sum(F.floor("H0")).alias("depth"), F.count_if(F.col("flags.has_entry_ring")).alias("rings"))
    return good.unionByName(bad.agg(F.lit("broken").alias("source_dataset"), F.count("*").alias("n"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("rings")))


def meta_maps(spark, d):
    """Metadata as JSON objects by part, read back as keys and values: the last row of each part."""
    folder, m = _folder(spark, "metas"), table(spark, d, "metas")
    last = m.groupBy("part_id").agg(F.max_by(F.struct("src", "unit", "kernel"), "ingested_at").alias("meta"))
    sinks.write_json_map(last, "part_id", "meta", folder, pieces=max(1, m.count() // 4096))
    back = readers.json_map(spark, folder, "struct<src:string,unit:string,kernel:string>", whole=False)
    return back.select(F.col("key").alias("part_id"), "value.src", "value.unit", "value.kernel")


def last_full_row(spark, d):
    """The data set and path that the last metadata row without an empty field gives each content hash."""
    m = table(spark, d, "metas").select("ch", "src", "rel", F.col("ingested_at").cast("string").alias("at"))
    return readers.keyed_last(m.distinct(), "ch", "at", "rel").select("ch", "src", "rel")


def report_metrics(spark, d):
    """Reports of every source, written with a line per figure and one JSON object, and read back by patterns."""
    folder = _folder(spark, "reports")
    p = parts(spark, d, "source_dataset", "has_points", "unit")
    per = p.groupBy("source_dataset").agg(F.count("*").alias("n"), F.sum("has_points").alias("points"), F.count("unit").alias("units"))
    text = F.concat(F.lit("# Report\n\nsource: "), F.col("source_dataset"), F.lit("\nparts: "), F.col("n"), F.lit("\nwith points= "), F.col("points"), F.lit("\ncounts: "), F.to_json(F.struct("n", "units")), F.lit("\n"))
    per.select(F.col("source_dataset").alias("report"), text.alias("value")).repartition("report").write.option("lineSep", "\x1e").partitionBy("report").text(folder)
    got = readers.report_metrics(spark, folder, {"n": r"parts:\s*([0-9]+)", "points": r"with points=\s*([0-9]+)", "absent": r"latency:\s*([0-9]+)"})
    more = readers.report_json(spark, folder, "counts", "bigint").filter("key = 'units'").select("path", F.col("value").alias("units"))
    return got.join(more, "path").select(F.regexp_extract("path", "report=([^/]+)/", 1).alias("source"), "n", "points", "absent", "units")


def resolved_paths(spark, d):
    """Where each part's file is: under its own root for one source, under the base folder where the metadata list it."""
    p = parts(spark, d, "rel_path")
    rel = table(spark, d, "metas").select("src", "rel").distinct()
    listed = F.when(F.col("src") == "gearhub", F.concat(F.lit("/mnt/g/"), F.regexp_replace("rel", "^[^/]+/", ""))).otherwise(F.concat(F.lit("/base/"), F.col("rel")))
    return readers.resolve_paths(p, rel.select(listed.alias("path")).filter(F.col("path").isNotNull()), {"gearhub": "/mnt/g/"}, ["/other", "/base"]).select("part_id", "file")


def changed_files(spark, d):
    """Files of the index whose results come from a cache and those worked on anew; cached are the files whose unit the
    metadata have, as they were then."""
    listing = parts(spark, d, "source_dataset", "rel_path", "file_size_bytes", "file_mtime_utc").select("source_dataset", F.col("rel_path").alias("path"), F.col("file_size_bytes").alias("size"), F.col("file_mtime_utc").alias("modified"))
    cache = table(spark, d, "metas").filter(F.col("unit").isNotNull()).select(F.col("rel").alias("path"), F.col("file_size_bytes").alias("size"), F.col("file_mtime_utc").alias("modified"), F.lit("cached").alias("state")).distinct()
    states = readers.refreshed(listing, cache, lambda df: df.select("path", "size", "modified", F.lit("new").alias("state")))
    return states.groupBy("state").agg(F.count("*").alias("n"), F.count_distinct("path").alias("n_paths"))


def sampled_lines(spark, d):
    """500 of the distinct listed parts in seeded order, as an evaluation on a slice takes them."""
    lists = table(spark, d, "split_lists").select(part_ref(F.col("part_id")).alias("part_id")).filter(F.col("part_id").isNotNull()).distinct()
    return readers.seeded_sample(lists, "part_id", 500)


def step_headers(spark, d):
    """Headers of exchange files made from the index and read back: time, authors, system, schema, unit."""
    p = parts(spark, d, "timestamp", "author", "originating_system", "step_schema", "unit")
    arg = lambda c: F.concat(F.lit("'"), F.replace(F.coalesce(c, F.lit("")), F.lit("'"), F.lit("''")), F.lit("'"))
    author = F.concat_ws(",", F.lit("'first'"), arg(F.col("author")))
    text = F.concat(F.lit("ISO-10303-21;\nHEADER;\nFILE_NAME('part',"), arg(F.col("timestamp")), F.lit(",\n ("), author, F.lit("),(''),'pre',"), arg(F.col("originating_system")), F.lit(",'ok');\nFILE_SCHEMA(("), arg(F.col("step_schema")), F.lit("));\nDATA;\n"), F.coalesce("unit", F.lit("")))
    return p.select("part_id", S.step_header(text).alias("h"), S.infer_unit(F.col("unit")).alias("unit")).select("part_id", "h.*", "unit")


def file_names(spark, d):
    """Both names of each part's candidate file."""
    names = sinks.file_names(F.col("part_id"))
    return parts(spark, d).select("part_id").distinct().select("part_id", names["flat"].alias("flat"), names["digest"].alias("digest"))


def per_part_files(spark, d):
    """Counts of candidates written per group of parts (by the first two digits of their digest), then again: lines and files
    read back, which the second run does not change. Groups without candidates have an empty file."""
    folder = _folder(spark, "parts")
    h = table(spark, d, "hole_candidates").select("hole_id", "part_id", "D0").dropDuplicates(["hole_id"]).groupBy(F.substring(F.md5("part_id"), 1, 2).alias("part_id")).agg(F.count("*").alias("n"), F.round(F.sum("D0"), 3).alias("total"))
    also = parts(spark, d).select(F.substring(F.md5("part_id"), 1, 2).alias("part_id"))
    for _ in range(2):
        sinks.write_per_part(h, folder, name="digest", also=also)
    back = spark.read.text(folder)
    return back.agg(F.count("*").alias("n_lines"), F.count_distinct("file").alias("n_files"), F.sum(F.get_json_object("value", "$.n").cast("long")).alias("n_holes"))


_CANDIDATES = "(SELECT DISTINCT ON (hole_id) * FROM hole_candidates)"
_ARG = "nullif(trim(replace(coalesce({0}, ''), '''', '''''')), '')"
_MAPPED = "CASE WHEN src = 'gearhub' THEN '/mnt/g/' || regexp_replace(rel, '^[^/]+/', '') ELSE '/base/' || rel END"

QUERIES = {
    f.__name__: f
    for f in (index_from_csv, index_head_semicolon, signatures_from_csv, split_list_files, candidate_lines, meta_maps, last_full_row, report_metrics, resolved_paths, changed_files, sampled_lines, step_headers, file_names, per_part_files)
}

SQL = {
    "index_from_csv": "SELECT part_id, " + ", ".join(f"nullif({c}, '') AS {c}" for c in ("timestamp", "author", "unit", "family_id", "geom_hash")) + ", file_size_bytes, has_points FROM (SELECT DISTINCT * FROM part_index_for_split)",
    "index_head_semicolon": "SELECT source_dataset, count(*) AS n, count(author) AS n_authors FROM (SELECT DISTINCT part_id, source_dataset, author FROM part_index_for_split) GROUP BY 1",
    "signatures_from_csv": "SELECT part_id, has_points, len(d2_hist)::INT AS d2_hist, len(bbox_ratio)::INT AS bbox_ratio, len(surf_hist)::INT AS surf_hist, len(dih_hist)::INT AS dih_hist FROM (SELECT DISTINCT * FROM signatures)",
    "split_list_files": "SELECT protocol, split_id, subset, count(*) AS n_lines, count(DISTINCT t) AS n_texts FROM (SELECT protocol, split_id, subset, regexp_replace(part_id, '^\\s+|\\s+$', '', 'g') t FROM split_lists) WHERE t <> '' GROUP BY 1, 2, 3",
    "candidate_lines": f"SELECT source_dataset, count(*) AS n, sum(floor(H0))::BIGINT AS depth, count(*) FILTER (flags.has_entry_ring) AS rings FROM {_CANDIDATES} WHERE H0 IS NOT NULL GROUP BY 1 UNION ALL SELECT 'broken', count(*), 0, 0 FROM {_CANDIDATES} WHERE H0 IS NULL",
    "meta_maps": "SELECT part_id, src, unit, kernel FROM (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY ingested_at DESC) r FROM metas) WHERE r = 1",
    "last_full_row": "SELECT ch, src, rel FROM (SELECT ch, src, rel, row_number() OVER (PARTITION BY ch ORDER BY ingested_at DESC, rel DESC) r FROM metas WHERE trim(ch) <> '' AND trim(src) <> '' AND trim(rel) <> '' AND ingested_at IS NOT NULL) WHERE r = 1",
    "report_metrics": "SELECT source_dataset AS source, count(*)::DOUBLE AS n, sum(has_points)::DOUBLE AS points, NULL::DOUBLE AS absent, count(unit) AS units FROM (SELECT DISTINCT part_id, source_dataset, has_points, unit FROM part_index_for_split) GROUP BY 1",
    "resolved_paths": f"""WITH l AS (SELECT DISTINCT {_MAPPED} AS f FROM metas WHERE rel IS NOT NULL), p AS (SELECT DISTINCT part_id, rel_path FROM part_index_for_split)
        SELECT part_id, CASE WHEN rel_path IN (SELECT f FROM l) THEN rel_path WHEN starts_with(rel_path, 'gearhub/') AND '/mnt/g/' || rel_path[9:] IN (SELECT f FROM l) THEN '/mnt/g/' || rel_path[9:] WHEN '/other/' || rel_path IN (SELECT f FROM l) THEN '/other/' || rel_path WHEN '/base/' || rel_path IN (SELECT f FROM l) THEN '/base/' || rel_path END AS file FROM p""",
    "changed_files": """WITH l AS (SELECT DISTINCT part_id, rel_path p, file_size_bytes s, file_mtime_utc m FROM part_index_for_split), c AS (SELECT DISTINCT rel p, file_size_bytes s, file_mtime_utc m FROM metas WHERE unit IS NOT NULL)
        SELECT 'cached' AS state, count(*) AS n, count(DISTINCT p) AS n_paths FROM c WHERE EXISTS (SELECT 1 FROM l WHERE l.p = c.p AND l.s = c.s AND l.m = c.m) UNION ALL SELECT 'new', count(*), count(DISTINCT p) FROM l WHERE NOT EXISTS (SELECT 1 FROM c WHERE l.p = c.p AND l.s = c.s AND l.m = c.m)""",
    "sampled_lines": f"SELECT part_id FROM (SELECT DISTINCT {REF.format('part_id')} AS part_id FROM split_lists) WHERE part_id IS NOT NULL ORDER BY md5('42:' || part_id), part_id LIMIT 500",
    "step_headers": f"SELECT part_id, {_ARG.format('timestamp')} AS created, concat_ws('|', 'first', nullif(trim(replace(coalesce(author, ''), '''', '')), '')) AS authors, {_ARG.format('originating_system')} AS system, nullif(trim(step_schema), '') AS schema, CASE WHEN upper(unit) LIKE '%INCH%' THEN 'inch' WHEN upper(unit) LIKE '%MILLI%' AND upper(unit) LIKE '%METRE%' THEN 'mm' WHEN upper(unit) LIKE '%METRE%' THEN 'm' END AS unit FROM (SELECT DISTINCT part_id, timestamp, author, originating_system, step_schema, unit FROM part_index_for_split)",
    "file_names": "SELECT DISTINCT part_id, replace(part_id, '/', '__') AS flat, md5(part_id)[:16] AS digest FROM part_index_for_split",
    "per_part_files": f"WITH h AS (SELECT md5(part_id)[:2] p, count(*) n FROM {_CANDIDATES} GROUP BY 1), a AS (SELECT DISTINCT md5(part_id)[:2] p FROM part_index_for_split) SELECT (SELECT count(*) FROM (SELECT p FROM h UNION SELECT p FROM a)) AS n_lines, (SELECT count(*) FROM (SELECT p FROM h UNION SELECT p FROM a)) AS n_files, (SELECT sum(n)::BIGINT FROM h) AS n_holes",
}
