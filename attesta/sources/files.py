"""Dataset sources: image folders, annotation files, label files, multi-band patches, stored entities and audit logs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.plans.lineage import cut, shuffle_partitions
from attesta.sources.json_arrays import array_objects, tasks_for

# The file kinds and bands that are read.
IMAGES = r"(?i)\.(png|jpe?g|bmp|tiff?|webp|ppm)$"
BANDS = ("B01", "B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B09", "B11", "B12")
MISSING_BAND = "MISSING_BAND"

COCO = T.StructType(
    [
        T.StructField("images", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("file_name", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))),
        T.StructField("annotations", T.ArrayType(T.StructType([T.StructField("image_id", T.LongType()), T.StructField("category_id", T.LongType()), T.StructField("bbox", T.ArrayType(T.DoubleType())), T.StructField("area", T.DoubleType()), T.StructField("iscrowd", T.IntegerType())]))),
        T.StructField("categories", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())]))),
    ]
)


def _store(root: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(re.sub("^file:/*", "file:///", root))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root``: path (relative) and length.

    Directories are listed by tasks, a level at a time, and each level is written to the shared folder, so the driver never has names
    of files. Names that begin with ``_`` or ``.`` are left out, as Spark's readers do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _store(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = fs.get_file_info(FileSelector(f"{base}/{folder}".rstrip("/")))
                names = [i.base_name for i in found]
                seen = [k for k, n in enumerate(names) if not n.startswith(("_", "."))]
                for at in range(0, len(seen), 10_000):
                    part = seen[at : at + 10_000]
                    paths = pa.array([f"{folder}/{names[k]}".lstrip("/") for k in part], pa.string())
                    yield pa.RecordBatch.from_arrays([paths, pa.array([found[k].size for k in part], pa.int64()), pa.array([found[k].type == FileType.Directory for k in part], pa.bool_())], ["path", "length", "folder"])

    n, levels = shuffle_partitions(spark), []
    folders = spark.range(1).select(F.lit("").alias("path"))
    while True:
        levels.append(cut(folders.mapInArrow(run, "path string, length long, folder boolean")))
        folders = levels[-1].where("folder").select("path")
        if folders.isEmpty():
            break
        folders = folders.repartition(n)
    whole = levels[0]
    for level in levels[1:]:
        whole = whole.union(level)
    return whole.where("not folder").drop("folder")


def digests(files: DataFrame, root: str) -> DataFrame:
    """``files`` (path below ``root``, length) with sha256 of what they hold, read a MB at a time by as many tasks as shuffles have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _store(root)
        for batch in batches:
            made = []
            for path in batch.column(0).to_pylist():
                h = hashlib.sha256()
                with fs.open_input_stream(f"{base}/{path}") as content:
                    while piece := content.read(1 << 20):
                        h.update(piece)
                made.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], ["path", "length", "sha256"])

    return files.select("path", "length").repartition(shuffle_partitions(files.sparkSession)).mapInArrow(run, "path string, length long, sha256 string")


def parent(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def image_folder(spark: SparkSession, root: str) -> DataFrame:
    """sample_id, sha256, size, label: every image, labelled by its directory unless it lies in the root."""
    f = digests(listing(spark, root).where(F.col("path").rlike(IMAGES)), root)
    label = F.when(F.instr("path", "/") > 0, parent(F.col("path")))
    return f.select(F.col("path").alias("sample_id"), "sha256", F.col("length").alias("size"), label.alias("label"))


def coco(spark: SparkSession, json_path: str, files: DataFrame, *, by_line: bool = False, whole: bool = False, keep: int = 0) -> DataFrame:
    """sample_id, width, height, labels: images of COCO documents that exist in ``files`` (path), with all their annotations.

    Documents of any size are read in parts, object by object (:mod:`attesta.sources.json_arrays`), and ids hold within a document.
    ``by_line``: one document, a part of it a line; ``whole``: a small document in one piece. ``keep``: how long their objects stay, as in
    :func:`attesta.plans.lineage.cut`.
    """
    if by_line or whole:
        doc = spark.read.schema(COCO).option("multiLine", not by_line).json(json_path)
        images, categories, annotations = (doc.select(F.lit("").alias("file"), F.inline(f.name)) for f in (COCO["images"], COCO["categories"], COCO["annotations"]))
        dealt = lambda df, *by: df
    else:
        objects, n = array_objects(spark, json_path, COCO.names, keep=keep), tasks_for(spark, json_path)
        images, categories, annotations = (objects.where(F.col("section") == x).select("file", F.from_json("json", COCO[x].dataType.elementType).alias("x")).select("file", "x.*") for x in ("images", "categories", "annotations"))
        dealt = lambda df, *by: df.repartition(n, *by)
    cats = categories.select("file", F.col("id").alias("category_id"), F.coalesce("name", F.col("id").cast("string")).alias("category"))
    notes = annotations.join(cats, ["file", "category_id"], "left").withColumn("category", F.coalesce("category", F.lit("unknown")))
    labels = dealt(notes.select("file", F.col("image_id").alias("id"), "category", "category_id", "bbox"), "file", "id").groupBy("file", "id").agg(F.array_sort(F.collect_list(F.struct("category", "category_id", "bbox"))).alias("labels"))
    kept = dealt(images, "file_name").join(files.select(F.element_at(F.split("path", "/"), -1).alias("file_name")), "file_name", "left_semi")
    return kept.join(labels, ["file", "id"], "left").select(F.col("file_name").alias("sample_id"), "width", "height", F.coalesce("labels", F.expr("cast(array() as array<struct<category:string,category_id:bigint,bbox:array<double>>>)")).alias("labels"))


def yolo(spark: SparkSession, root: str) -> DataFrame:
    """sample_id, labels: boxes of each image from ``<stem>.txt`` beside it, else from ``labels/`` in place of ``images/``.

    Lines with fewer than five fields, or with one that is no number, are left out; images without labels have an empty list.
    """
    files = listing(spark, root)
    images = files.where(F.col("path").rlike(IMAGES)).select(F.col("path").alias("sample_id"))
    beside = F.regexp_replace("sample_id", r"\.[^.]*$", ".txt")
    images = images.withColumns({"beside": beside, "apart": F.regexp_replace(beside, r"(^|/)images/", "$1labels/")})
    bare = root.rstrip("/").split("/")[-1]
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root).select(F.regexp_extract(F.col("_metadata.file_path"), f"/{bare}/(.*)$", 1).alias("path"), F.split(F.trim("value"), r"\s+").alias("p"))
    num = F.transform(F.slice("p", 1, 5), lambda x: x.try_cast("double"))
    boxes = lines.withColumn("n", num).where((F.size("p") >= 5) & ~F.exists("n", lambda x: x.isNull()))
    per = boxes.groupBy("path").agg(F.array_sort(F.collect_list("n")).alias("labels"))
    known = files.where(F.col("path").endswith(".txt")).select("path")
    own = images.join(known.withColumnRenamed("path", "beside").withColumn("here", F.lit(True)), "beside", "left")
    at = own.select("sample_id", F.when(F.col("here"), F.col("beside")).otherwise(F.col("apart")).alias("path"))
    return at.join(per, "path", "left").select("sample_id", F.coalesce("labels", F.expr("cast(array() as array<array<double>>)")).alias("labels"))


def patches(spark: SparkSession, root: str) -> DataFrame:
    """patch, one digest for each band (or MISSING_BAND), compound: directories with band files or label metadata."""
    band = F.regexp_extract(F.upper(stem(F.col("path"))), "_(B[0-9]{1,2}A?)$", 1)
    meta = F.col("path").endswith("_labels_metadata.json")
    known = listing(spark, root).where(F.when(meta, "META").otherwise(band) != "")
    rows = digests(known, root).select(parent(F.col("path")).alias("patch"), F.when(meta, "META").otherwise(band).alias("band"), F.col("sha256").alias("h"))
    wide = rows.groupBy("patch").pivot("band", [*BANDS, "META"]).agg(F.first("h"))
    wide = wide.select("patch", *[F.coalesce(b, F.lit(MISSING_BAND)).alias(b) for b in BANDS], F.coalesce("META", F.lit("")).alias("META"))
    return wide.withColumn("compound", F.sha2(F.to_json(F.struct(*BANDS, "META")), 256))


def single_bands(spark: SparkSession, root: str) -> DataFrame:
    """sample_id, sha256, band: TIFF files, band from the name's end or UNKNOWN."""
    f = digests(listing(spark, root).where(F.col("path").rlike(r"(?i)\.tiff?$")), root)
    band = F.regexp_extract(F.upper(stem(F.col("path"))), "(B[0-9]{1,2}A?)$", 1)
    return f.select(F.col("path").alias("sample_id"), "sha256", F.when(band == "", "UNKNOWN").otherwise(band).alias("band"))


def detect_format(files: DataFrame, coco_sources: DataFrame) -> DataFrame:
    """source, format of each top directory of ``files`` (path): COCO if one of its JSON files is (``coco_sources``: source), else YOLO by its layout or if half its images have a label file, else IMAGE_FOLDER."""
    f = files.select(F.element_at(F.split("path", "/"), 1).alias("source"), "path")
    base = F.regexp_replace("path", r"\.[^.]*$", "")
    f = f.withColumns({"base": base, "image": F.col("path").rlike(IMAGES), "text": F.col("path").endswith(".txt")})
    pair = f.groupBy("source", "base").agg(F.bool_or("image").alias("i"), F.bool_or("text").alias("t"), F.bool_or(F.col("path").contains("/images/")).alias("di"), F.bool_or(F.col("path").contains("/labels/")).alias("dl"))
    g = pair.groupBy("source").agg(F.count_if("i").alias("n"), F.count_if(F.expr("i and t")).alias("both"), (F.bool_or("di") & F.bool_or("dl")).alias("dirs"))
    j = g.join(coco_sources.select("source", F.lit(True).alias("c")), "source", "left")
    return j.select("source", F.when(F.col("c"), "COCO").when(F.col("dirs") | (F.col("both") > 0) & (2 * F.col("both") >= F.col("n")), "YOLO").otherwise("IMAGE_FOLDER").alias("format"))


def is_coco(spark: SparkSession, root: str) -> DataFrame:
    """source: top directories with a JSON file that has images, annotations and categories."""
    bare = root.rstrip("/").split("/")[-1]
    doc = spark.read.schema(COCO).option("multiLine", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
    hit = doc.where("images is not null and annotations is not null and categories is not null")
    return hit.select(F.regexp_extract(F.col("_metadata.file_path"), f"/{bare}/([^/]*)/", 1).alias("source")).distinct()


def write_files(files: DataFrame, root: str) -> None:
    """Writes ``content`` (text or bytes) of each row to ``path`` below ``root``, from the tasks; a file that is there is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _store(root)
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs.create_dir(f"{base}/{path}".rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(f"{base}/{path}") as out:
                    out.write(content)
            yield pa.record_batch([pa.array([batch.num_rows])], ["n"])

    files.select("path", F.col("content").cast("binary")).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def entities(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Stored JSON documents of one kind; unreadable ones are left out."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(root)


def audit_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Events of an append-only log of JSON lines; bad lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_audit(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def save(df: DataFrame, path: str, *, kind: str = "parquet", by: list[str] | None = None) -> None:
    """One sealed store of entities, partitioned where asked."""
    w = df.write.mode("append").format(kind)
    (w.partitionBy(*by) if by else w).save(path)


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and distinct edges of a stored graph (``nodes`` and ``edges`` below ``path``). Edges are dealt to a task for each million."""
    edges, key = spark.read.parquet(f"{path}/edges"), ["source_id", "target_id", "edge_type"]
    n = max(shuffle_partitions(spark), edges.count() // 1_000_000 + 1)
    return spark.read.parquet(f"{path}/nodes"), edges.repartition(n, *key).dropDuplicates(key)
