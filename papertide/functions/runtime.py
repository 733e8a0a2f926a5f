"""Session helpers that every part of the library shares."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` under `folder`, read through Spark so that any store that Spark knows works."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's `spark.checkpoint.dir`. Only one machine may do without: there it is a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def checkpoint(frame: DataFrame) -> DataFrame:
    """Cut the lineage of `frame` with a reliable checkpoint in the shared folder."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def spread(frame: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by keys to four partitions a core (at most as many as shuffles have), also where they are few bytes: for steps that make far more of a row, or take far longer over it, than its bytes tell, which adaptive execution
    would else draw together into few tasks."""
    spark = frame.sparkSession
    return frame.repartition(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


#: Whether the files of a query's shuffles go once it has ended; otherwise they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: The folders of the tables kept since passing() began, if it did.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def write(frame: DataFrame, path: str, *by: str, mode: str = "append") -> None:
    """Write the rows to a table; the files of the shuffles that they come from go at once."""
    spark = frame.sparkSession
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        frame.write.mode(mode).partitionBy(*by).option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)


def _new_table(spark: SparkSession) -> str:
    path, made = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}", _MADE.get()
    if made is not None:
        made.append(path)
    return path


def kept(frame: DataFrame) -> DataFrame:
    """The rows of `frame` as a table in the shared folder. What they are made from is not needed any more: the files of its shuffles go at once, and
    columns take a fraction of the space of a checkpoint's rows."""
    path = _new_table(frame.sparkSession)
    write(frame, path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def in_turn(spark: SparkSession, frames: Iterable[Callable[[], DataFrame]], *by: str) -> DataFrame:
    """The rows of several frames as one kept table, with a folder for each value of `by`. Each frame is made when it has its turn, and what it keeps and shuffles is gone before the next one
    begins, so that the space this takes is that of the largest, not of all."""
    path = _new_table(spark)
    for make in frames:
        with passing(spark):
            frame = make()
            write(frame, path, *by)
    return spark.read.schema(frame.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that are kept inside go at its end."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        for path in made:
            remove(spark, path)


def forget(frame: DataFrame) -> None:
    """Remove a kept() table that nothing reads any more."""
    for folder in {os.path.dirname(f) for f in frame.inputFiles()}:
        remove(frame.sparkSession, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Remove a folder of the shared store, if it is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
