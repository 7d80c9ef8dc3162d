"""Intermediate results written once and read several times.

A plan that uses one derived table in many places computes it in each of them.
Staging writes it as Parquet to the folder all executors share and reads it
back: later stages see a plain scan with column pruning, and a lost executor
costs only its own tasks. What the job has shuffled is removed as soon as the
table is written, so a query that stages in steps needs the disk of its largest
step, not of all of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Else shuffle files stay until the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """Folder of this application below ``spark.checkpoint.dir``, or below the
    warehouse, which all executors share too, where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{named.rstrip('/')}/staged-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Removes what this application has staged, once no result reads it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(scan: DataFrame) -> DataFrame:
    """Rows of a plain scan dealt evenly to at least two tasks per core.

    A row group is never split, so a small file of many short rows is read by
    few tasks, and all that is worked out of a row before the next shuffle runs
    in these. A scan with enough tasks of its own stays as it is.
    """
    wanted = 2 * scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= wanted else scan.repartition(wanted)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside leave no shuffle files behind."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def stage(frame: DataFrame, partition_by: str | None = None, more: Sequence[DataFrame] = ()) -> DataFrame:
    """``more``: further rows of the same columns, written one frame after the other."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    for part in (frame, *more):
        writer = part.write.mode("errorifexists" if part is frame else "append").option("compression", "zstd")
        with shuffles_removed(spark):
            (writer if partition_by is None else writer.partitionBy(partition_by)).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def discard(staged: DataFrame) -> None:
    """Removes a plain staged table that no result reads any more."""
    spark = staged.sparkSession
    hadoop, folder = spark._jvm.org.apache.hadoop.fs, shared_folder(spark)
    fs = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    root = fs.makeQualified(hadoop.Path(folder)).toUri().getPath()
    for path in {hadoop.Path(f).getParent().toString() for f in staged.inputFiles()}:
        if hadoop.Path(path).getParent().toUri().getPath() == root:
            fs.delete(hadoop.Path(path), True)


class Steps:
    """Stages the steps of one chain; a step reads nothing but the one before, and
    what was staged beside that, which then go."""

    def __init__(self) -> None:
        self._read: list[DataFrame] = []

    def __call__(self, frame: DataFrame, *more: DataFrame) -> DataFrame:
        staged = stage(frame, more=more) if more else stage(frame)
        for table in self._read:
            discard(table)
        self._read = [staged]
        return staged

    def beside(self, frame: DataFrame) -> DataFrame:
        staged = stage(frame)
        self._read.append(staged)
        return staged
