"""Cutting lineage through the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The folders of the :func:`passing` blocks that are open, the innermost last.
_OPEN: ContextVar[tuple[str, ...]] = ContextVar("_OPEN", default=())
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where the setting is missing, on one machine only (tests)."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    conf = sc.getConf().get("spark.checkpoint.dir")
    if not conf and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    folder = conf or tempfile.mkdtemp(prefix="attesta-")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, *, keep: int = 0) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back, so that a lost executor costs no recomputation.

    Within :func:`passing` the table goes with the block; ``keep`` tells how many blocks, from the innermost on, it stays beyond.
    """
    spark, folders = df.sparkSession, _OPEN.get()
    around = folders[: max(len(folders) - keep, 0)]
    path = f"{around[-1] if around else shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    if folders:
        with cleaned(spark):
            df.write.option("compression", "zstd").parquet(path)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession) -> str:
    """The folder of the innermost :func:`passing` block that is open, or the shared one."""
    folders = _OPEN.get()
    return folders[-1] if folders else shared_dir(spark)


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """What is run inside deletes its shuffles when it is through."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[], int]]:
    """A block whose tables (see :func:`cut`) are deleted at its end, and whose shuffles are as soon as a table is written. What leaves the
    block is cut with ``keep``. Gives a function that tells how many bytes its tables have."""
    own = f"{folder(spark)}/passing-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(own)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    token = _OPEN.set((*_OPEN.get(), own))
    try:
        yield lambda: store.getContentSummary(place).getLength() if store.exists(place) else 0
    finally:
        _OPEN.reset(token)
        store.delete(place, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
