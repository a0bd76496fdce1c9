"""One large JSON document read in parts: the objects of its top-level arrays, wherever Spark cuts the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.plans.lineage import cut, passing, shuffle_partitions
from attesta.plans.prefix import dealt, scanned

#: The first object of an array, or a plain object, after its key; nothing before it may hold a brace.
_ARRAY = r'(?s)^(?:\s*\{)?[^{]*"(\w+)"\s*:\s*\[\s*\{'
_PLAIN = r'(?s)^(?:\s*\{)?[^{]*"(\w+)"\s*:\s*\{'
_LEAD = r"(?s)^(?:\s*\{)?[^{]*\{"


def tasks_for(spark: SparkSession, path: str) -> int:
    """Tasks for the pieces of the documents in ``path``: eight for each of Spark's splits, so that a task's share stays as it is when they grow."""
    return max(shuffle_partitions(spark), 8 * spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions())


def array_objects(spark: SparkSession, path: str, arrays: list[str], *, keep: int = 0) -> DataFrame:
    """file, section, number, json: the objects in the top-level ``arrays`` of each JSON document, in order of ``number``.

    The file is split where braces close, by Spark's own reader, so parts of one document are read by many tasks and from any store.
    Running sums over the pieces then tell for each whether it begins inside a text (quotes so far) and how deep (braces so far), and
    which array was opened last; pieces from one object's beginning to its end are put together. No task holds more than an object.
    Braces in texts and nested objects are borne; keys and plain values between arrays hold no braces. Each scan is written before the
    next, and all of them are gone at the end. ``keep``: as in :func:`cut`.
    """
    with passing(spark):
        return _array_objects(spark, path, arrays, keep + 1)


def _array_objects(spark: SparkSession, path: str, arrays: list[str], keep: int) -> DataFrame:
    n = tasks_for(spark, path)
    raw = spark.read.option("lineSep", "}").text(path)
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    key, order = ["file"], ["block", "at"]
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)
    now = dealt(rows.withColumn("_quotes", (F.size(parts) - 1).cast("long")), key, order, n)
    now = scanned(now, key, order, sums={"_upto": "_quotes"}, n=n).withColumn("_parts", parts)
    begins_in = (F.col("_upto") - F.col("_quotes")) % 2
    outside = F.array_join(F.filter("_parts", lambda x, i: (i + begins_in) % 2 == 0), "")
    now = now.withColumns({"_in": begins_in == 1, "_open": (F.length(outside) - F.length(F.replace(outside, F.lit("{")))).cast("long"), "_close": (F.col("_upto") % 2 == 0).cast("long")})
    now = cut(now.drop("_parts", "_quotes", "_upto").withColumn("_net", F.col("_open") - F.col("_close")))
    now = scanned(now, key, order, sums={"_depth": "_net"}, n=n)
    top = ~F.col("_in") & (F.col("_depth") - F.col("_net") <= 1)
    array, plain = F.regexp_extract("value", _ARRAY, 1), F.regexp_extract("value", _PLAIN, 1)
    name = F.when(top & (array != ""), array).when(top & (plain != ""), F.lit(""))
    now = now.withColumns({"_mark": F.when(name.isNotNull(), F.struct("block", "at", name.alias("name"))), "_ends": ((F.col("_close") == 1) & (F.col("_depth") <= 1)).cast("long"), "_starts": top & (F.col("_open") > 0), "_text": F.concat(F.when(top, F.regexp_replace("value", _LEAD, "{")).otherwise(F.col("value")), F.lit("}"))})
    now = cut(now.select("_part", *key, *order, "_mark", "_ends", "_starts", "_text"))
    now = scanned(now, key, order, sums={"_ended": "_ends"}, maxima={"_last": "_mark"}, n=n)
    pieces = cut(now.select("file", (F.col("_ended") - F.col("_ends")).alias("number"), F.col("_last.name").alias("section"), "_starts", F.struct("block", "at", F.col("_text").alias("text")).alias("piece")).where(F.col("section").isin(*arrays)))
    g = pieces.repartition(n, "file", "number").groupBy("file", "number").agg(F.max("section").alias("section"), F.bool_or("_starts").alias("_whole"), F.array_sort(F.collect_list("piece")).alias("p"))
    return cut(g.where("_whole").select("file", "section", "number", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("json")), keep=keep)
