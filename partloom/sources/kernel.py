"""Work per file by a geometry kernel that is not part of this package, as a Spark job with a status for every file."""

from __future__ import annotations

import signal
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.functions.scalars import classify_error
from partloom.operators.ranking import ranked


class _TooLong(Exception):
    pass


def _alarm(*_):
    raise _TooLong("timeout")


def run_files(files: DataFrame, worker: Callable[[str, bytes], list[dict]], fields: str, key: str = "path", seconds: int = 60, largest_first: bool = True) -> DataFrame:
    """Rows of ``worker(path, content)`` for each file, with ``status``, ``message`` and ``elapsed_ms``.

    ``fields`` is the schema of the worker's rows. A file without rows has one row of status ``no_cand``; one that
    raises or takes longer than ``seconds`` one of status ``failed`` with the kind of its error; the others ``written``.
    Large files are dealt evenly and come first in each task; Spark repeats tasks whose executor is lost. A worker that
    hangs in native code is not ended by ``seconds``; ``spark.task.reaper.enabled`` and a task timeout of the cluster are.
    """
    names = [f.split()[0] for f in fields.split(", ")]
    if largest_first and "length" in files.columns:
        # sizes alone are sorted; the contents go straight to the task that their rank in the order gives them
        tasks = max(1, files.sparkSession.sparkContext.defaultParallelism * 4)
        place = ranked(files.select(key, "length"), [], F.desc("length"), key).select(key, "rn")
        files = files.join(place, key).repartition(tasks, F.pmod("rn", F.lit(tasks))).sortWithinPartitions("rn")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signal.signal(signal.SIGALRM, _alarm)
        for frame in frames:
            out = []
            for path, content in zip(frame[key], frame["content"], strict=True):
                began = time.monotonic()
                status, message, rows = "written", None, []
                try:
                    signal.alarm(seconds)
                    rows = worker(path, bytes(content))
                except Exception as e:  # noqa: BLE001
                    status, message = "failed", f"{type(e).__name__}: {e}"[:500]
                finally:
                    signal.alarm(0)
                if status == "written" and not rows:
                    status = "no_cand"
                ms = (time.monotonic() - began) * 1000
                out += [{key: path, "status": status, "message": message, "elapsed_ms": ms, **{n: r.get(n) for n in names}} for r in (rows or [{}])]
            yield pd.DataFrame(out, columns=[key, "status", "message", "elapsed_ms", *names])

    done = files.select(key, "content").mapInPandas(run, f"{key} string, status string, message string, elapsed_ms double, {fields}")
    return done.withColumn("error", classify_error(F.col("message")))


def rebuild(lines: DataFrame, files: DataFrame, done: DataFrame, worker: Callable[[str, bytes], list[dict]], fields: str, seconds: int = 60) -> DataFrame:
    """What a rebuild does with each listed part: ``skip_exists`` where ``done`` has it, ``skip_unresolved`` where no file is
    known, else the rows of :func:`run_files` with their status.

    ``lines`` is ``(part_id)``, ``files`` ``(part_id, path, length, content)``, ``done`` ``(part_id)``. Repeated lines count once.
    """
    listed = lines.select("part_id").filter(F.col("part_id").isNotNull()).distinct()
    there = done.select("part_id").distinct()
    open_ = listed.join(there, "part_id", "left_anti")
    names = [f.split()[0] for f in fields.split(", ")]
    work = run_files(files.join(open_, "part_id", "left_semi"), worker, fields, key="part_id", seconds=seconds)
    skipped = listed.join(there, "part_id", "left_semi").withColumn("status", F.lit("skip_exists")).unionByName(open_.join(files.select("part_id"), "part_id", "left_anti").withColumn("status", F.lit("skip_unresolved")))
    return work.select("part_id", "status", *names).unionByName(skipped, allowMissingColumns=True)
