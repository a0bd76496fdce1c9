"""Checks on live streams of frames: verdicts, rolling duplicates, replay guards, tails and running statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from attesta.plans.lineage import cut

STATE = "hashes array<string>, last long"


def frames(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A file stream; its zone-less times become times, so that watermarks can use them."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def decoded(stream: DataFrame, data: str = "frame_data") -> DataFrame:
    """Adds ``content``: the bytes of a base64 frame, with or without a data-url head."""
    return stream.withColumn("content", F.unbase64(F.substring_index(data, ",", -1)))


def verdict(trigger, duplicate, variance):
    """(verdict, trust) of a frame: a corner trigger, a recent duplicate, little contrast, or clean."""
    name = F.when(trigger, "POISONED").when(duplicate, "NEAR-DUPLICATE").when(variance < 10, "SUSPICIOUS").otherwise("CLEAN")
    trust = F.when(trigger, 0.12).when(duplicate, 0.85).when(variance < 10, 0.35).otherwise(0.99)
    return name, trust


def rolling_duplicates(stream: DataFrame, key: str, order: str, value: str, *, kind: str = "kind", last: int = 5) -> DataFrame:
    """key, order, value, recent: whether the value is among the ``last`` of its key before it, kept in state.

    Rows of a key are put in order within a micro-batch. A row whose ``kind`` is ``reset`` empties the key's buffer and gives no row.
    """
    types = {c: stream.schema[c].dataType.simpleString() for c in (key, order)}

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for o, v, what in zip(rows[order], rows[value], rows[kind], strict=True):
            if what == "reset":
                held = []
                continue
            out.append((k[0], o, v, v in held))
            held = [*held, v][-last:]
        state.update((held, 0))
        yield pd.DataFrame(out, columns=[key, order, value, "recent"])

    out = f"{key} {types[key]}, {order} {types[order]}, {value} string, recent boolean"
    return stream.select(key, order, F.col(value).cast("string").alias(value), kind).groupBy(key).applyInPandasWithState(run, out, STATE, "append", GroupStateTimeout.NoTimeout)


def replay_guard(stream: DataFrame, keys: list[str], ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """First sights of ``keys`` within the watermark's ``delay``, which bounds what is remembered; see :func:`replays_ever` for a guard
    that never forgets."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def replays_ever(stream: DataFrame, row: str, order: str, values: list[str]) -> DataFrame:
    """row, kind, replayed for each of ``values`` of each row (``kind`` is its name): whether the value was seen before, ever.

    Nothing is forgotten: the state, which the checkpoint keeps over restarts, has a number for each value of each kind, and no watermark
    clears it. Within a micro-batch a value's first row in ``order`` is the first sight. A null value is never a replay. A row is a
    replay if one of its values is (see :func:`replayed_rows`); it makes its values known all the same.
    """
    types = {c: stream.schema[c].dataType.simpleString() for c in (row, order)}
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("kind"), F.col(v).cast("string").alias("value")) for v in values]))
    tokens = stream.select(F.col(row).alias("row"), F.col(order).alias("at"), each.alias("x")).select("row", "at", "x.kind", "x.value").where("value is not null")

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, first = state.exists, None
        show = lambda rows, again: pd.DataFrame({"row": rows["row"], "kind": k[0], "replayed": again})
        for rows in batches:
            if known:
                yield show(rows, True)
                continue
            # the earliest row so far waits; all others are replays whatever comes
            rows = rows if first is None else pd.concat([first, rows], ignore_index=True)
            rows = rows.sort_values(["at", "row"])
            first = rows.iloc[:1]
            yield show(rows.iloc[1:], True)
        if first is not None:
            state.update((True,))
            yield show(first, False)

    found = tokens.groupBy("kind", "value").applyInPandasWithState(run, f"row {types[row]}, kind string, replayed boolean", "seen boolean", "append", GroupStateTimeout.NoTimeout)
    return found.withColumnRenamed("row", row)


def replayed_rows(found: DataFrame, row: str) -> DataFrame:
    """row, replayed: of each row of a drained :func:`replays_ever`, whether any of its values was seen before."""
    return found.groupBy(row).agg(F.bool_or("replayed").alias("replayed"))


def verdict_buffer(stream: DataFrame, key: str, order: str, value: str, folder: str, *, kind: str = "kind", last: int = 5, held: int = 50, carry: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Drains a stream of frames: (all rows but resets with ``recent``, the buffer of each key: its newest ``held`` such rows). Columns
    of ``carry`` go along.

    ``recent`` tells whether the value is among the ``last`` of its key's buffer before it. Each micro-batch meets the buffers that the one
    before left, in a table of at most ``held`` rows a key: windows over both give the verdicts and the next buffers, in the JVM. A row of
    ``kind`` reset empties its key's buffer. Buffers and rows are written under the number of the micro-batch, so a batch that is
    repeated after a failure starts from the same buffers and writes the same rows once.
    """
    names = [key, order, value, *carry]
    kept = ", ".join(f"{c} {stream.schema[c].dataType.simpleString()}" for c in names) + ", recent boolean"

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(kept).parquet(f"{folder}/buffer/{number - 1}") if number else spark.createDataFrame([], kept)
        rows = batch.select(*names, F.col(kind).alias("_kind"), F.lit(None).cast("boolean").alias("_recent")).unionByName(before.select(*names, F.lit("held").alias("_kind"), F.col("recent").alias("_recent")))
        line = Window.partitionBy(key).orderBy(order)
        rows = rows.withColumn("_part", F.sum((F.col("_kind") == "reset").cast("int")).over(line))
        own = Window.partitionBy(key, "_part").orderBy(order)
        shown = rows.where("_kind <> 'reset'").withColumn("_seen", F.array_contains(F.collect_list(value).over(own.rowsBetween(-last, -1)), F.col(value)))
        judged = cut(shown.select(*names, F.coalesce("_recent", "_seen", F.lit(False)).alias("recent"), "_kind", "_part"))
        judged.where("_kind <> 'held'").select(*names, "recent").write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        newest = rows.groupBy(key).agg(F.max("_part").alias("_part"))
        ranked = judged.join(newest, [key, "_part"], "left_semi").withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))))
        ranked.where(F.col("_k") <= held).select(*names, "recent").write.mode("overwrite").parquet(f"{folder}/buffer/{number}")

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    done = query.lastProgress["batchId"] if query.lastProgress else -1
    while done >= 0 and not _written(spark, f"{folder}/buffer/{done}"):
        done -= 1
    none = spark.createDataFrame([], kept)
    if done < 0:
        return none, none
    return spark.read.schema(kept).parquet(f"{folder}/rows/batch=*"), spark.read.schema(kept).parquet(f"{folder}/buffer/{done}")


def _in_batches(stream: DataFrame, kept: str, folder: str, step) -> DataFrame:
    """Drains a stream by ``step`` (rows of a micro-batch, folders of the states before it, folder of its state after, which it writes)
    and gives all rows that the steps gave. State and rows lie under the number of the micro-batch, so one that is repeated after a
    failure reads what it read before and writes the same again."""
    spark = stream.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        out = step(batch, [f"{folder}/state/{k}" for k in range(number)], f"{folder}/state/{number}")
        out.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not _exists(spark, f"{folder}/rows"):
        return spark.createDataFrame([], kept)
    return spark.read.schema(kept).parquet(f"{folder}/rows/batch=*")


def known_replays(stream: DataFrame, row: str, order: str, values: list[str], folder: str) -> DataFrame:
    """row, replayed: :func:`replays_ever` with :func:`replayed_rows`, drained micro-batch by micro-batch in the JVM.

    What is known lies in tables of distinct values, one a micro-batch; a micro-batch meets them in one join, so neither memory nor
    Python calls follow the number of values. It may hold many files: its rows are put in ``order`` by windows that spill to disk.
    """
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("kind"), F.col(v).cast("string").alias("value")) for v in values]))
    kept = f"{row} {stream.schema[row].dataType.simpleString()}, replayed boolean"
    names = "kind string, value string"

    def step(batch: DataFrame, before: list[str], after: str) -> DataFrame:
        spark = batch.sparkSession
        tokens = cut(batch.select(row, F.col(order).alias("_at"), each.alias("x")).select(row, "_at", "x.*"))
        known = spark.read.schema(names).parquet(*before) if before else spark.createDataFrame([], names)
        first = F.row_number().over(Window.partitionBy("kind", "value").orderBy("_at", row)) == 1
        ranked = tokens.where("value is not null").withColumn("_first", first)
        met = cut(ranked.join(known.withColumn("_known", F.lit(True)), ["kind", "value"], "left"))
        met.where("_first and _known is null").select("kind", "value").write.mode("overwrite").parquet(after)
        seen = met.select(row, (F.coalesce("_known", F.lit(False)) | ~F.col("_first")).alias("replayed"))
        return seen.groupBy(row).agg(F.bool_or("replayed").alias("replayed"))

    return _in_batches(stream, kept, folder, step)


def rollback_rows(stream: DataFrame, key: str, order: str, seq: str, folder: str) -> DataFrame:
    """:func:`rollbacks` drained micro-batch by micro-batch in the JVM: the highest number of each key is carried in a table. A micro-batch
    may hold many files, whose rows are put in ``order`` whatever files they came in. A key's first number is held against -1, all
    others against the highest before them, which may lie below that."""
    types = {c: stream.schema[c].dataType.simpleString() for c in (key, order, seq)}
    tops = f"{key} {types[key]}, _top long"

    def step(batch: DataFrame, before: list[str], after: str) -> DataFrame:
        spark = batch.sparkSession
        held = spark.read.schema(tops).parquet(before[-1]) if before else spark.createDataFrame([], tops)
        rows = batch.select(key, order, seq)
        new = rows.select(key, F.col(seq).cast("long").alias("_top")).union(held).groupBy(key).agg(F.max("_top").alias("_top"))
        new.write.mode("overwrite").parquet(after)
        line = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        known = held.select(F.col(key).alias("_k"), "_top")
        met = rows.join(known, F.col(key).eqNullSafe(F.col("_k")), "left").withColumn("_before", F.max(seq).over(line))
        return met.select(key, order, seq, (F.col(seq) <= F.coalesce(F.greatest("_before", "_top"), F.lit(-1))).alias("rollback"))

    return _in_batches(stream, ", ".join(f"{c} {t}" for c, t in types.items()) + ", rollback boolean", folder, step)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _written(spark: SparkSession, path: str) -> bool:
    return _exists(spark, f"{path}/_SUCCESS")


def rollbacks(stream: DataFrame, key: str, order: str, seq: str) -> DataFrame:
    """key, order, seq, rollback: whether a sequence number is not above the highest of its key before it, kept in state.

    Rows of a key are put in ``order`` of arrival within a micro-batch, whose size ``maxFilesPerTrigger`` bounds.
    """
    types = {c: stream.schema[c].dataType.simpleString() for c in (key, order, seq)}

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[1] if state.exists else None
        out = []
        rows = pd.concat(list(batches)).sort_values(order)
        for o, s in zip(rows[order], rows[seq], strict=True):
            out.append((k[0], o, s, bool(s <= (-1 if last is None else last))))
            last = int(s) if last is None else max(last, int(s))
        state.update(([], last))
        yield pd.DataFrame(out, columns=[key, order, seq, "rollback"])

    out = ", ".join(f"{c} {t}" for c, t in types.items())
    return stream.select(key, order, seq).groupBy(key).applyInPandasWithState(run, f"{out}, rollback boolean", STATE, "append", GroupStateTimeout.NoTimeout)


def tail(stream: DataFrame, path: str, checkpoint: str, kind: str = "json"):
    """Appends a stream to a log as it comes, until what is there now is through."""
    return stream.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def statistics(stream: DataFrame, key: str, verdict_col: str, latency: str) -> DataFrame:
    """Running counts and mean latency (0 without frames) of each key."""
    g = stream.groupBy(key).agg(F.count("*").alias("frames"), F.count_if(F.col(verdict_col) == "CLEAN").alias("clean"), F.count_if(F.col(verdict_col) == "POISONED").alias("poisoned"), F.coalesce(F.avg(latency), F.lit(0.0)).alias("latency"))
    return g


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and reads its result as a table; complete results keep the last version."""
    spark = stream.sparkSession
    if mode == "append":
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
