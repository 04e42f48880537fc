"""Small Spark helpers of the corpus operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ours: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset (tests on one machine) a temporary folder is set once;
    on a cluster an unset folder is an error, as no machine-local one would do.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "") or _ours.get(sc.applicationId)
    if not at:
        if not sc.master.startswith("local["):
            if sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = _ours[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="loam-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    sc = spark.sparkContext

    def drop() -> None:
        try:
            if sc._jsc is not None:
                at = sc._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may have ended before
            pass

    atexit.register(drop)
    return path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it again: its lineage ends there, and lost executors cost nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has in any letter case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        new = f"__{n}"
        while new.lower() in taken:
            new += "_"
        taken.add(new.lower())
        out.append(new)
    return out


def col(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int, limit_bytes: int) -> DataFrame:
    """Broadcast df if its counted size stays under the limit; else it is joined by shuffle."""
    return F.broadcast(df) if rows * row_bytes <= limit_bytes else df


def components(edges: DataFrame, a: str = "a", b: str = "b", *, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: (id, root), root the least id reached.

    Alternating large-star and small-star steps, each a groupBy; rounds are
    logarithmic in practice.  Null ends are left out; repeated edges and loops
    do no harm; an empty graph gives no rows.
    """
    e = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct()
    e = cut(e, "edges")
    mark = None
    for _ in range(max_rounds):
        both = e.select(F.col("hi").alias("v"), F.col("lo").alias("u")).union(e.select(F.col("lo").alias("v"), F.col("hi").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(low, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u < v").distinct()
        # small star: the lower neighbours of v, and v itself, go to the least of them
        low2 = large.groupBy("v").agg(F.min("u").alias("m"))
        j = large.join(low2, "v")
        new = j.select(F.col("v").alias("hi"), F.col("m").alias("lo")).union(j.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).where("lo < hi").distinct()
        e = cut(new.select("lo", "hi"), "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.hash("lo", "hi").cast("long")), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return e.select(F.col("hi").alias("id"), F.col("lo").alias("root")).union(e.select(F.col("lo").alias("id"), F.col("lo").alias("root")).distinct())
