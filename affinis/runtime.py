"""Session settings, staged tables and small planning helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR = "affinis.staging.dir"
_STAGED: list[str] = []
_AT_EXIT: list = []


def staging_root(spark: SparkSession) -> str:
    """Folder for staged tables: spark.checkpoint.dir, or the folder set with setCheckpointDir, where there is one.

    Neither means a test or a laptop: in local mode a temporary folder is used, on a cluster a folder below the
    warehouse directory, which all executors share. The choice is kept in the session.
    """
    set_dir = spark._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (set_dir.get() if set_dir.isDefined() else None) or spark.conf.get(_OWN_DIR, None)
    if named is None:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            named = tempfile.mkdtemp(prefix="affinis-")
        else:
            named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_affinis_staging"
        spark.conf.set(_OWN_DIR, named)
    return named.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a DataFrame to the staging folder and read it back.

    Cuts the lineage with files all executors can read, so a lost executor costs no recomputation, and later readers
    get column pruning and pushed-down filters.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/affinis/{label}-{uuid.uuid4().hex}"
    if not _AT_EXIT:
        _AT_EXIT.append(atexit.register(_clear_at_exit))
    _STAGED.append(path)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _clear_at_exit() -> None:
    """Whatever is still staged goes with the process, as far as its session still answers."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            clear_staged(spark)
        except Exception:  # noqa: BLE001 - the session has ended first
            pass


def clear_staged(spark: SparkSession) -> int:
    """Delete every table staged by this process; call it when all results that depend on them are written."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    gone = 0
    while _STAGED:
        path = jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


_SHUFFLES = re.compile(r"(?m)^[^A-Za-z]*(?:AdaptiveSparkPlan|(?:Broadcast)?Exchange)\b")


def scan_tasks(df: DataFrame) -> int | None:
    """Tasks of a plan that only scans, filters and projects; None for one with an exchange, which is not run to count."""
    plan = df._jdf.queryExecution().executedPlan()
    return None if _SHUFFLES.search(plan.toString()) else plan.execute().getNumPartitions()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition a scan of fewer tasks than cores, such as one small file; leave any other input as it is.

    Behind an exchange adaptive execution chooses the tasks. No job is started.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = scan_tasks(df)
    if tasks is None or tasks * 2 > cores:
        return df
    return df.repartition(cores, *keys) if keys else df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def size_bound(df: DataFrame) -> int:
    """Catalyst's estimate of the output in bytes: an upper bound for filters and projections of a file scan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if(df: DataFrame, max_rows: int, max_bytes: int = 32 << 20) -> DataFrame:
    """Hint a broadcast only when the rows, counted up to max_rows, and the estimated bytes keep within the bounds.

    Beyond them the DataFrame is returned as it is, and Spark joins it by a shuffle.
    """
    if df.limit(max_rows + 1).count() > max_rows or size_bound(df) > max_bytes:
        return df
    return F.broadcast(df)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context, wherever the caller's folder is not on their path."""
    context = spark.sparkContext
    if getattr(context, "_affinis_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="affinis-package-"), "affinis")
    context.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(here), os.path.basename(here)))
    context._affinis_shipped = True
