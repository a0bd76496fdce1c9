"""Small helpers of the text operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that one task of a bucketed stage should hold.
BUCKET_BYTES = 16 << 20


def text_of(column: str = "text") -> Column:
    """A text column in which null reads as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of all texts: one number to the driver."""
    return docs.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0


def bucket_count(docs: DataFrame, column: str = "text", bucket_bytes: int = BUCKET_BYTES) -> int:
    """So many buckets that each holds about ``bucket_bytes`` of text, and at least the shuffle partitions."""
    at_least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(at_least, -(-text_bytes(docs, column) // bucket_bytes))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sealed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that clash with none of an operator's own, and the new name of each column."""
    names = {c: f"in{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def unsealed(out: DataFrame, names: dict[str, str], new: dict[str, str] | None = None) -> DataFrame:
    """The columns of before, then ``new`` ones by their shown names; where names clash the new column stands."""
    new = new or {}
    old = {c: n for c, n in names.items() if c not in new and n in out.columns}
    return out.select(*old.values(), *new.values()).toDF(*old, *new)


def row_key(id_col: str, h: str | Column) -> Column:
    """One text for an id, null included, and a text's hash."""
    return F.concat(F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("")), F.lit(":"), (F.col(h) if isinstance(h, str) else h).cast("string"))


def first_rows(docs: DataFrame, first: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that ``first`` (``_id``, ``_h``) names; repeated ones leave one."""
    wanted = first.select(row_key("_id", "_h").alias("_row"))
    return docs.withColumn("_row", row_key(id_col, F.xxhash64(text_of(f"`{text_col}`")))).join(wanted, "_row").dropDuplicates(["_row"]).drop("_row")


def order_of(id_col: str, h: str) -> Column:
    """The order in which rows of a group are preferred: by id, null ids last, then by the text's hash."""
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(h).alias("h"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, for stages that return more than they take."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker returns the memory that it no longer needs: workers outlive their tasks."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return inner
