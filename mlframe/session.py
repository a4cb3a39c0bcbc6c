"""Session set-up and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_local_root: str | None = None
_written: list[str] = []


def get_session(app: str = "mlframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by `spark.checkpoint.dir`.

    A temporary folder is used only in local mode with the setting unset.
    """
    global _local_root
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="mlframe-")
    return _local_root


def scratch_path(spark: SparkSession, stem: str) -> str:
    """A new path in the shared folder, removed again by `release_scratch`."""
    path = f"{shared_dir(spark)}/mlframe/{stem}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def release_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables this process wrote; call it once no frame reads them."""
    conf, n = spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def materialize(df: DataFrame, stem: str = "step", schema: T.StructType | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back, under another schema of the same cells if one is given.

    The copy fixes row placement and generated ids, survives the loss of an
    executor, and keeps column pruning for the readers.
    """
    path = scratch_path(df.sparkSession, stem)
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan out to all cores if it comes in fewer pieces than there are cores.

    For work that is heavy per row (training, tokenising). A table large enough to fill
    the cluster stays as it is. Call it on scans and filters: the plan is only inspected.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def in_threads(jobs: Sequence[Callable[[], object]], threads: int) -> list:
    """Results of independent jobs that share some driver threads, in order."""
    if threads <= 1 or len(jobs) < 2:
        return [job() for job in jobs]
    with ThreadPool(min(threads, len(jobs))) as pool:
        return pool.map(inheritable_thread_target(SparkSession.active())(lambda job: job()), jobs)
