"""Cutting lineage by writing to the shared folder the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows for which another task is worth it.
TASK_ROWS = 100_000
#: Bytes that one task may read of many small splits.
TASK_BYTES = 64 << 20
#: Rows that are kept in memory for several readers; more of them are written.
HELD_ROWS = 2_000_000

#: Every copy written by this process that has not been removed.
_paths: list[str] = []


@contextmanager
def temporary_copies(spark: SparkSession) -> Iterator[None]:
    """Remove the copies staged inside the block at its end. Tables that read them are of no use afterwards:
    write or collect what is wanted before."""
    kept = len(_paths)
    try:
        yield
    finally:
        for path in _paths[kept:]:
            _delete(spark, path)
        del _paths[kept:]


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors reach: the one for checkpoints, else one in the session's warehouse. No setting is
    changed."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/staged"


def stage(df: DataFrame, reader: SparkSession | None = None) -> DataFrame:
    """Write `df` once as parquet and read it back, if asked in another session: later scans prune columns
    and survive lost executors."""
    return _written(df, reader or df.sparkSession)[0]


def _written(df: DataFrame, spark: SparkSession) -> tuple[DataFrame, str]:
    path = f"{shared_folder(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    _paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def held(df: DataFrame, n_rows: int) -> Iterator[DataFrame]:
    """`df` made once for several readers inside the block: in memory, or where it has more than HELD_ROWS rows as a copy that is
    removed at the end. Rows that fill the memory of the executors would be moved between it, their disks and each other."""
    if n_rows > HELD_ROWS:
        copy, path = _written(df, df.sparkSession)
        try:
            yield copy
        finally:
            _delete(df.sparkSession, path)
            _paths.remove(path)
        return
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        kept.count()  # filled before several readers ask for it
        yield kept
    finally:
        kept.unpersist()


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt to as many tasks as run at once, where it has many rows in fewer: a copy is read by as many tasks as have
    written it."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    n, tasks = df.select(F.spark_partition_id().alias("task")).agg(F.count("*"), F.count_distinct("task")).first()
    return df.repartition(slots) if tasks < min(slots, n // TASK_ROWS) else df


def few_tasks(scan: DataFrame, same: DataFrame | None = None) -> DataFrame:
    """A scan of files whose splits are read one after the other, where there are many small ones: a task has up to TASK_BYTES
    of them, and there are still four tasks for each that runs at once. The splits and the order inside them stay. `same` is
    a scan of the same splits by which to count them."""
    spark = scan.sparkSession
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    n, slots = (same or scan).rdd.getNumPartitions(), spark.sparkContext.defaultParallelism
    tasks = max(4 * slots, -(-n * split // TASK_BYTES))
    return scan.coalesce(tasks) if tasks < n else scan


def together(spark: SparkSession, tasks: list[Callable[[], object]], at_once: int) -> list:
    """Run independent actions at the same time, so that one fills the slots another leaves idle; results
    in order."""
    if at_once <= 1 or len(tasks) <= 1:
        return [t() for t in tasks]
    with ThreadPoolExecutor(min(at_once, len(tasks))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(t)) for t in tasks]]
