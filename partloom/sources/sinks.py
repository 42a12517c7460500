"""Writers: split lists, candidate lines, tables, and small reports from collected aggregates."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.functions.scalars import flat_name, short_md5


def write_splits(members: DataFrame, path: str, pieces: int = 8) -> None:
    """One folder a protocol, split and subset with the part ids as lines, each list in ``pieces`` files by a hash."""
    lines = members.filter(F.col("part_id").isNotNull()).select("protocol", "split_id", "subset", F.col("part_id").alias("value"))
    piece = F.pmod(F.xxhash64("value"), F.lit(pieces))
    lines.repartition("protocol", "split_id", "subset", piece).sortWithinPartitions("value").write.mode("overwrite").partitionBy("protocol", "split_id", "subset").text(path)


def write_new(candidates: DataFrame, path: str, key: str = "part_id") -> int:
    """Appends the rows whose key is not in the JSON table yet, so a repeated run adds nothing; returns their number."""
    spark = candidates.sparkSession
    try:
        done = spark.read.schema(candidates.schema).json(path).select(key).distinct()
        fresh = candidates.join(done, key, "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        fresh = candidates
    n = fresh.count()
    if n:
        fresh.write.mode("append").json(path)
    return n


def file_names(part_id: Column) -> dict[str, Column]:
    """Both ways a part's file is named: its id with separators replaced, and a short digest."""
    return {"flat": flat_name(part_id), "digest": short_md5(part_id)}


def write_per_part(candidates: DataFrame, path: str, key: str = "part_id", name: str = "flat", also: DataFrame | None = None) -> None:
    """JSON lines in one folder per part, named after it as :func:`file_names` says; parts that have a folder are skipped.

    A part without rows gets none, unless ``also`` lists it: then its file has one empty line.
    """
    spark = candidates.sparkSession
    file = file_names(F.col(key))[name]
    lines = candidates.select(file.alias("file"), F.to_json(F.struct(*candidates.columns)).alias("value"))
    if also is not None:
        lines = lines.unionByName(also.select(key).distinct().join(candidates.select(key), key, "left_anti").select(file.alias("file"), F.lit("").alias("value")))
    try:
        lines = lines.join(spark.read.text(path).select("file").distinct(), "file", "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    lines.repartition("file").write.mode("append").partitionBy("file").text(path)


def write_failures(done: DataFrame, path: str, key: str = "path") -> None:
    """Files whose work failed, a line each: name, kind of error and message, set apart by tabs."""
    part = lambda c: F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"\s+", " "), F.lit(""))
    done.filter("status = 'failed'").select(F.concat_ws("\t", part(key), part("error"), part("message")).alias("value")).write.mode("overwrite").text(path)


def write_json_map(df: DataFrame, key: str, value: str, path: str, pieces: int = 1) -> None:
    """``pieces`` JSON objects of ``value`` by ``key``, a line each; one object only where the table is small."""
    piece = F.pmod(F.xxhash64(key), F.lit(pieces))
    pairs = F.map_from_entries(F.collect_list(F.struct(F.col(key).cast("string"), F.col(value))))
    df.filter(F.col(key).isNotNull()).groupBy(piece.alias("_piece")).agg(F.to_json(pairs).alias("value")).select("value").write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A delimited table with a header; arrays become JSON texts. Blanks around a value stay; an empty text is read back as null."""
    cols = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def markdown(title: str, df: DataFrame, most: int = 200) -> str:
    """A small aggregate as a Markdown table: at most ``most`` rows, as a report shows them."""
    rows = df.limit(most).collect()
    head = ["# " + title, "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*head, *["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]]) + "\n"


def report(title: str, facts: dict[str, object], tables: dict[str, DataFrame], most: int = 200) -> str:
    """A Markdown report: a line ``name: value`` for every fact (dictionaries as JSON), and small aggregates as tables."""
    said = [f"{k}: {json.dumps(v, sort_keys=True) if isinstance(v, dict) else v}" for k, v in facts.items()]
    return "\n".join(["# " + title, "", *said, ""]) + "".join("\n#" + markdown(k, t, most) for k, t in tables.items())
