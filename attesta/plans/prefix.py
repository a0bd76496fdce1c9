"""Running sums that no single task has to see whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.plans.lineage import cut, shuffle_partitions


def dealt(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int | None = None) -> DataFrame:
    """``rows`` written by ranges of keys and order, with ``_part``: a key may spread over many parts, which follow each other. There are
    ``n`` parts, or as many as shuffles have."""
    n = n or shuffle_partitions(rows.sparkSession)
    return cut(rows.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()))


def scanned(parts: DataFrame, keys: Sequence[str], order: Sequence[str], *, sums: dict[str, str] | None = None, maxima: dict[str, str] | None = None, maxima_before: dict[str, str] | None = None, lags: dict[str, str] | None = None, n: int | None = None) -> DataFrame:
    """Adds to :func:`dealt` rows what a scan in ``order`` knows at each row of its key: running sums and maxima up to the row (new
    name: column), maxima up to the row before and the value of the row before (null at a key's first).

    Each part scans its own rows; one row for each key and part carries the totals, and the last row, over to the next. Rows of
    equal order must not occur. Null keys are a key like any other. ``n`` is the number of tasks, where it isn't that of
    shuffles. Key and part are one struct, in which nulls are equal, so rows stay in their tasks when the totals come to them.
    """
    sums, lags = sums or {}, lags or {}
    own_maxima, maxima = {*(maxima or {})}, (maxima or {}) | (maxima_before or {})
    by = [*keys, "_part"]
    own = Window.partitionBy("_group").orderBy(*order)
    upto, above, before = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys).orderBy("_part")
    last = F.max_by(F.struct(*[F.col(c).alias(f"_e_{new}") for new, c in lags.items()]), F.struct(*order)) if lags else F.lit(None)
    totals = parts.groupBy(*by).agg(*[F.sum(c).alias(f"_t_{new}") for new, c in sums.items()], *[F.max(c).alias(f"_t_{new}") for new, c in maxima.items()], last.alias("_edge"))
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        F.struct(*by).alias("_same"),
        *[F.coalesce(F.sum(f"_t_{new}").over(earlier), F.lit(0)).alias(f"_b_{new}") for new in sums],
        *[F.max(f"_t_{new}").over(earlier).alias(f"_b_{new}") for new in maxima],
        F.lag("_edge").over(before).alias("_edge"),
    )
    grouped = parts.withColumn("_group", F.struct(*by))
    out = (grouped.repartition(n, "_group") if n else grouped).withColumns({new: F.sum(c).over(upto) for new, c in sums.items()} | {new: F.max(c).over(upto if new in own_maxima else above) for new, c in maxima.items()} | {new: F.lag(c).over(own) for new, c in lags.items()} | {"_first": F.row_number().over(own) == 1})
    out = out.join(carried, F.col("_group") == F.col("_same"))
    new_columns = {new: F.col(new) + F.col(f"_b_{new}") for new in sums} | {new: F.greatest(new, f"_b_{new}") for new in maxima} | {new: F.when(F.col("_first"), F.col(f"_edge._e_{new}")).otherwise(F.col(new)) for new in lags}
    return out.withColumns(new_columns).select(*parts.columns, *sums, *maxima, *lags)


def running_sums(rows: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """Adds running sums (new name: column) over each key in ``order``; rows of equal order must not occur."""
    return scanned(dealt(rows, keys, order), keys, order, sums=sums).select(*rows.columns, *sums)


def ordered_digest(rows: DataFrame, keys: Sequence[str], order: Sequence[str], entry: str, *, chunk: int = 4096) -> DataFrame:
    """keys, digest: SHA-256 over each key's entries in ``order``.

    ``chunk`` entries are digested where they lie; a key's digest is that of its chunks' in order, so no task holds a key.
    """
    placed = running_sums(rows.withColumn("_one", F.lit(1)), keys, order, {"_pos": "_one"})
    in_order = lambda at, what: F.transform(F.array_sort(F.collect_list(F.struct(at, what))), lambda x: x[what])
    number = F.floor((F.col("_pos") - 1) / chunk).alias("_chunk")
    chunks = placed.groupBy(*keys, number).agg(F.sha2(F.array_join(in_order("_pos", entry), ","), 256).alias("_h"))
    return chunks.groupBy(*keys).agg(F.sha2(F.array_join(in_order("_chunk", "_h"), ""), 256).alias("digest"))
