"""Tables in the folder that all executors share, and numbers without a global sort in one task."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ours: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset (tests on one machine) a temporary folder is set once;
    on a cluster an unset folder is an error, as no machine-local one would do.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "") or _ours.get(sc.applicationId)
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = _ours[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="loam-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended before
        if path.startswith("file:/"):
            shutil.rmtree("/" + path[5:].lstrip("/"), ignore_errors=True)


def clear(spark: SparkSession, app: str | None = None) -> None:
    """Removes what the session wrote for its own use; what still reads it fails from then on."""
    for path in _made.pop(app or spark.sparkContext.applicationId, []):
        _remove(spark, path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed by ``clear`` or when the driver process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _made:
        atexit.register(clear, spark, app)
    _made.setdefault(app, []).append(path)
    return path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it again: its lineage ends there, and lost executors cost nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: str, name: str, start: int = 0) -> DataFrame:
    """df with a column of numbers from start on, without gaps, in the given order: tasks count ranges of it, and the driver adds up only their sizes."""
    part = "__part"
    parts = cut(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "numbered")
    at, offsets = start, []
    for p, n in sorted(tuple(r) for r in parts.groupBy(part).agg(F.count("*")).collect()):
        offsets.append((p, at))
        at += n
    offsets = df.sparkSession.createDataFrame(offsets, f"{part} int, __at long")
    r = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    return parts.withColumn(name, r).join(F.broadcast(offsets), part).withColumn(name, F.col(name) + F.col("__at")).select(*df.columns, name)


def broadcast_under(df: DataFrame, size: int, limit: int = 64 << 20) -> DataFrame:
    """df to be broadcast if the bytes that were counted of it are under the limit; else it is joined by shuffle."""
    return F.broadcast(df) if size <= limit else df
