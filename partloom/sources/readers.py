"""Readers: part files, delimited and JSON tables, id lists, logs; column and path resolution; incremental input."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partloom.functions.scalars import file_format

# Extensions of part files.
PART_FILES = (".step", ".stp", ".stpz", ".brep", ".brp")

SIGNATURES = T.StructType([
    T.StructField("part_id", T.StringType()), T.StructField("rel_path", T.StringType()), T.StructField("source_dataset", T.StringType()), T.StructField("content_hash", T.StringType()),
    T.StructField("has_points", T.BooleanType()), *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("d2_hist", "bbox_ratio", "surf_hist", "dih_hist")], T.StructField("geom_hash", T.StringType()),
])
CANDIDATES = T.StructType([
    T.StructField("hole_id", T.StringType()),
    T.StructField("primitives", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("params", T.MapType(T.StringType(), T.DoubleType()))]))),
    *[T.StructField(c, T.DoubleType()) for c in ("D0", "H0", "alpha0", "q")],
    T.StructField("flags", T.StructType([T.StructField("has_entry_ring", T.BooleanType()), T.StructField("coax_dot", T.DoubleType())])),
])
#: The later candidate format is a schema of its own and is never united with the first.
CANDIDATES_SIMPLE = T.StructType([
    T.StructField("hole_id", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("D0", "H0", "alpha0")], T.StructField("axis", T.ArrayType(T.DoubleType())),
    T.StructField("base", T.ArrayType(T.DoubleType())), T.StructField("q", T.DoubleType()), T.StructField("primitives", T.ArrayType(T.StringType())),
])
STRESS_MANIFEST = T.StructType([
    T.StructField("step", T.StringType()),
    T.StructField("holes", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in ("D", "H", "alpha_deg")], *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("axis", "base")]]))),
])


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def part_files(spark: SparkSession, root: str, fraction: float | None = None, count: int | None = None) -> DataFrame:
    """``(path, ext, format, size, modified)`` of all part files below ``root``, in order of their path.

    ``fraction`` and ``count`` keep the head of that order (at least one file). Only the listing is read, no content.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    out = files.select("path", extension(F.col("path")).alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).filter(F.col("ext").isin(*PART_FILES))
    out = out.withColumn("format", file_format(F.col("ext"))).orderBy("path")
    if fraction is not None:
        out = out.limit(max(1, int(out.count() * fraction)))
    return out if count is None else out.limit(count)


def file_contents(spark: SparkSession, root: str, prefix: int = 300_000) -> DataFrame:
    """``(path, content_hash, text)`` of the part files: SHA-256 of the whole file and its first bytes read as UTF-8 without
    what is no UTF-8 (a replacement mark of the file itself goes as well); packed files have no text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).filter(extension(F.col("path")).isin(*PART_FILES))
    text = F.when(extension(F.col("path")) != ".stpz", F.replace(F.make_valid_utf8(F.substring("content", 1, prefix).cast("string")), F.lit("\ufffd"), F.lit("")))
    return files.select("path", F.sha2("content", 256).alias("content_hash"), text.alias("text"))


def delimited(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",", encoding: str = "UTF-8", rows: int | None = None) -> DataFrame:
    df = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("multiLine", True).option("escape", '"').schema(schema).csv(path)
    return df if rows is None else df.limit(rows)


def signatures_csv(spark: SparkSession, path: str) -> DataFrame:
    """Signatures whose arrays are JSON texts and whose truth value is ``True`` or ``False``."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in SIGNATURES])
    df = delimited(spark, path, text)
    cols = [F.from_json(f.name, "array<double>").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.lower(F.trim(f.name)).isin("true", "1").alias(f.name) if isinstance(f.dataType, T.BooleanType) else F.col(f.name) for f in SIGNATURES]
    return df.select(*cols)


def part_index(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame | None:
    """The part index of a folder: ``part_index.csv``, else its packed form, else None."""
    for name in ("part_index.csv", "part_index.csv.gz"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return delimited(spark, f"{folder.rstrip('/')}/{name}", schema)
    return None


def keyed_last(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key in the given order, of the rows without any empty field."""
    full = df.dropna().filter(" AND ".join(f"trim(cast(`{c}` as string)) <> ''" for c in df.columns))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return full.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def id_lists(spark: SparkSession, root: str) -> DataFrame:
    """``(protocol, split_id, subset, part_id)`` of ``<protocol>/split_<k>/<subset>.txt`` and of the folders that
    :func:`partloom.sources.sinks.write_splits` writes; blank lines and other folders are left out."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(root).select("value", F.input_file_name().alias("path"))
    shape = r"(?:protocol=)?([^/=]+)/split_(?:id=)?(\d+)/(?:subset=)?(train|calib|test)(?:\.txt|/[^/]+)$"
    out = lines.select(F.regexp_extract("path", shape, 1).alias("protocol"), F.regexp_extract("path", shape, 2).alias("k"), F.regexp_extract("path", shape, 3).alias("subset"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("part_id"))
    return out.filter((F.col("subset") != "") & (F.col("part_id") != "")).select("protocol", F.col("k").cast("int").alias("split_id"), "subset", "part_id")


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """``(rows, bad)``: parsed lines, and the lines that are no JSON of the schema with their file."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("path")).filter(F.trim("value") != "")
    marked = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.withColumn("row", F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return parsed.filter("row._bad IS NULL").select("row.*", "path").drop("_bad"), parsed.filter("row._bad IS NOT NULL").select("value", "path")


def json_map(spark: SparkSession, path: str, value: str, whole: bool = True) -> DataFrame:
    """``(key, value)`` rows of a JSON object; ``value`` is the type of its values. Without ``whole`` each line is an object."""
    whole = spark.read.text(path, wholetext=whole)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value}>")))


def report_metrics(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """One row a file with the first match of each pattern as a number; null where it does not occur."""
    text = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("path"))
    number = lambda p: F.regexp_extract("value", p, 1).try_cast("double")
    return text.select("path", *[number(p).alias(k) for k, p in patterns.items()])


def report_json(spark: SparkSession, path: str, name: str, value: str) -> DataFrame:
    """``(path, key, value)`` of the JSON object that a report's line ``name: {...}`` holds; what is no JSON gives no rows."""
    text = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("path"))
    found = F.regexp_extract("value", rf"{name}:\s*(\{{.*\}})", 1)
    return text.select("path", F.explode(F.from_json(found, f"map<string,{value}>")))


# Names a column may have, by the role it plays; the first name that is there is taken.
SYNONYMS = {
    "part_id": ("part_id", "id", "part", "uid"), "family": ("family_major", "family_id", "family", "cluster"), "canonical": ("duplicate_canonical", "canonical", "dup_canonical"),
    "content_hash": ("content_hash", "sha256", "hash"), "unit": ("unit", "units", "length_unit"), "timestamp": ("timestamp", "created_at_header", "created_at", "date", "file_mtime_utc"),
    "dataset": ("source_dataset", "dataset", "source"), "kernel": ("kernel", "cad_kernel"),
}


def resolve_columns(df: DataFrame, roles: Iterable[str] = tuple(SYNONYMS)) -> dict[str, str | None]:
    """Column of each role, whatever its letter case, or None."""
    have = {c.lower(): c for c in reversed(df.columns)}
    return {r: next((have[s] for s in SYNONYMS[r] if s in have), None) for r in roles}


def resolve_paths(parts: DataFrame, listing: DataFrame, roots: dict[str, str], bases: list[str]) -> DataFrame:
    """``parts`` with ``file``: the first that is listed of the path itself, its root by first segment, and each base with it."""
    rel = F.col("rel_path")
    mapped = F.lit(None).cast("string")
    for first, root in roots.items():
        mapped = F.when(F.split(rel, "/").getItem(0) == first, F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace(rel, "^[^/]+/", ""))).otherwise(mapped)
    tries = [rel, mapped, *[F.concat(F.lit(b.rstrip("/") + "/"), rel) for b in bases]]
    rows = parts.select("part_id", F.posexplode(F.array(*tries)).alias("turn", "file")).filter(F.col("file").isNotNull())
    hit = rows.join(listing.select(F.col("path").alias("file")).distinct(), "file").groupBy("part_id").agg(F.min_by("file", "turn").alias("file"))
    return parts.join(hit, "part_id", "left")


def changed_only(listing: DataFrame, done: DataFrame) -> DataFrame:
    """Files whose path, size and time are not among those done."""
    return listing.join(done.select("path", "size", "modified"), ["path", "size", "modified"], "left_anti")


def refreshed(listing: DataFrame, cache: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results of all listed files: those of ``cache`` whose path, size and time are still the same, and ``work`` on the others.

    ``cache`` and what ``work`` gives have the columns ``path, size, modified`` and their results.
    """
    kept = cache.join(listing.select("path", "size", "modified"), ["path", "size", "modified"], "left_semi")
    return kept.unionByName(work(changed_only(listing, cache)))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows in the order of a seeded hash: the same in every run and on every cluster."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)
