"""Candidate lines as they arrive: the same checks as in batch over a file stream, with one write per part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from partloom.operators.audit import candidate_checks
from partloom.sources.readers import CANDIDATES


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Candidates of new files in a folder, with the time of their file."""
    return spark.readStream.schema(CANDIDATES).option("maxFilesPerTrigger", files_per_batch).json(folder).withColumn("written_at", F.col("_metadata.file_modification_time"))


def problems_per_window(stream: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Broken records per kind of problem and window of the time their file was written; a file that arrives ``late``
    after newer ones no longer counts."""
    bad = candidate_checks(stream.withWatermark("written_at", late), "written_at")
    return bad.groupBy(F.window("written_at", width), "problem").agg(F.count("*").alias("n"))


def keep_sound(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the sound records to a parquet table, each file once even if the stream restarts."""
    sound = stream.filter(F.col("hole_id").isNotNull() & ((F.col("D0") >= 0) | F.col("D0").isNull()) & ((F.col("H0") >= 0) | F.col("H0").isNull()) & F.col("q").between(0, 1))
    return sound.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
