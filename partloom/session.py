"""Session helpers: test session, table access and lineage cuts in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; production sessions are made by the caller."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("partloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of all executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="partloom-code-")) / "partloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; also makes sure that the executors have this package."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir``, or a temporary folder in local mode only."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir")
    if found:
        return found
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="partloom-")
    return _OWN_DIR[app]


#: Makes Spark remove the shuffle files of a query when it ends, and not when the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def materialize(df: DataFrame, tag: str, tidy: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage of iterative jobs; unlike a local checkpoint it survives the loss of an executor,
    and as a parquet scan it gives the planner real sizes. With ``tidy``, for tables of vectors, the shuffle files of the
    write go with its end, since nothing else can read them, and the table is compressed more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/partloom-{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    try:
        if tidy:
            spark.conf.set(SHUFFLE_CLEANUP, "true")
        (df.write.option("compression", "zstd") if tidy else df.write).parquet(path)
    finally:
        if tidy:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    found = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[found] = path
    return found


def discard(written: DataFrame) -> None:
    """Delete a table that :func:`materialize` gave, once nothing reads it any more."""
    path = _WRITTEN.pop(written, None)
    if path:
        context = written.sparkSession.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
