"""Row predicates, small aggregates and projections of the audits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.plans.prefix import running_sums


def filter_findings(findings: DataFrame, equal: dict[str, str], needle: str, columns: Sequence[str]) -> DataFrame:
    """Rows whose columns equal what is asked (``ALL`` asks nothing) and of which one column holds ``needle``, case aside."""
    for name, value in equal.items():
        if value != "ALL":
            findings = findings.where(F.col(name) == value)
    hits = [F.lower(F.col(c)).contains(needle.lower()) for c in columns]
    return findings.where(reduce(lambda a, b: a | b, hits))


def missing_labels(rows: DataFrame, batch: str, missing: Column, folder: Column) -> DataFrame:
    """Rows without a label, but for batches that are plain image folders throughout (``folder``) and have no label at all."""
    bare = rows.groupBy(batch).agg((F.bool_and(missing) & F.bool_and(folder)).alias("_bare")).where("_bare").select(batch)
    return rows.where(missing).join(bare, batch, "left_anti")


def malformed_box(box: Column) -> Column:
    return (F.size(box) == 4) & F.exists(box, lambda v: (v < 0) | (v > 1))


def extreme_aspect(width: Column, height: Column, high: float = 20.0, low: float = 0.05) -> Column:
    ratio = F.when(height > 0, width / height).otherwise(0.0)
    return (ratio > high) | (ratio < low)


def variance(values: Column) -> Column:
    """Population variance of an array."""
    sums = F.aggregate(values, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")))
    return F.transform(F.array(sums), lambda a: a["q"] / F.size(values) - (a["s"] / F.size(values)) * (a["s"] / F.size(values)))[0]


def file_status(manifest: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Manifest rows without a file (MISSING) or with one that does not decode (UNDECODABLE)."""
    status = F.when(F.col("decoded").isNull(), "MISSING").when(~F.col("decoded"), "UNDECODABLE")
    return manifest.join(files.select(key, "decoded"), key, "left").withColumn("status", status).where("status is not null")


def ood(rows: DataFrame, reference: DataFrame, columns: Sequence[str], limit: float = 3.0) -> DataFrame:
    """Rows of which any column is more than ``limit`` deviations from the reference's mean; no reference, no rows.

    A column that the reference does not have deviates by nothing.
    """
    columns = [c for c in columns if c in reference.columns]
    if not columns:
        return rows.withColumn("z", F.lit(0.0)).where("false")
    stats = reference.agg(*[F.avg(c).alias(f"{c}_m") for c in columns], *[F.greatest(F.stddev_pop(c), F.lit(1e-6)).alias(f"{c}_sd") for c in columns])
    zs = [F.abs(F.col(c) - F.col(f"{c}_m")) / F.col(f"{c}_sd") for c in columns]
    z = zs[0] if len(zs) == 1 else F.greatest(*zs)
    return rows.join(F.broadcast(stats)).withColumn("z", z).where(F.col("z") > limit)


def alias_discrepancies(pairs: Sequence[tuple[str, str]]) -> Column:
    """The pairs of columns that are both given and differ."""
    found = []
    for a, b in pairs:
        x, y = F.col(a).cast("string"), F.col(b).cast("string")
        given = x.isNotNull() & y.isNotNull() & ~x.isin("", "0") & ~y.isin("", "0")
        found.append(F.when(given & (x != y), F.lit(f"{a}<>{b}")))
    return F.filter(F.array(*found), lambda m: m.isNotNull())


def resolve_contributor(rows: DataFrame, dataset: str, named: dict[str, str], child: str, generic: Sequence[str] = ("images", "labels", "data", "train", "test")) -> DataFrame:
    """Per dataset: the first given name (column by origin), else the only child folder if it has a telling name, else UNKNOWN."""
    given = {o: F.min(F.when(F.trim(c) != "", F.trim(c))).alias(f"_{o}") for o, c in named.items()}
    g = rows.groupBy(dataset).agg(*given.values(), F.min(child).alias("_child"), F.count_distinct(child).alias("_n"))
    folder = (F.col("_n") == 1) & (F.length("_child") >= 2) & ~F.lower("_child").isin(*generic)
    origin = reduce(lambda acc, o: acc.when(F.col(f"_{o}").isNotNull(), o), list(named)[1:], F.when(F.col(f"_{next(iter(named))}").isNotNull(), next(iter(named))))
    return g.select(dataset, origin.when(folder, "folder").otherwise("none").alias("origin"), F.coalesce(*[F.col(f"_{o}") for o in named], F.when(folder, F.col("_child")), F.lit("UNKNOWN")).alias("contributor"))


def entropy(rows: DataFrame, key: str, bin_col: str) -> DataFrame:
    """Shannon entropy of the bins of each key."""
    counts = rows.groupBy(key, bin_col).agg(F.count("*").alias("n"))
    totals = counts.groupBy(key).agg(F.sum("n").alias("t"), F.collect_list("n").alias("ns"))
    return totals.select(key, F.aggregate("ns", F.lit(0.0), lambda a, n: a - (n / F.col("t")) * F.log2(n / F.col("t"))).alias("entropy"))


def band_means(rows: DataFrame, patch: str, band: str, value: str, bands: Sequence) -> DataFrame:
    """One row a patch with each band's mean; 0 for absent bands."""
    return rows.groupBy(patch).pivot(band, list(bands)).agg(F.avg(value)).na.fill(0.0)


def spectral_indices(bands: DataFrame, *, blue: str, green: str, red: str, nir: str) -> DataFrame:
    """NDVI, NDWI (0 where the denominator is not positive) and the visible mean."""

    def index(a: Column, b: Column) -> Column:
        return F.when(a + b + 1e-6 > 0, (a - b) / (a + b + 1e-6)).otherwise(0.0)

    b, g, r, n = (F.col(f"`{c}`") for c in (blue, green, red, nir))
    return bands.withColumns({"ndvi": index(n, r), "ndwi": index(g, n), "visible": (b + g + r) / 3})


def minmax_255(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``scaled``: the value between its key's extremes as 0 to 255, cut to whole numbers; 0 where they are equal."""
    extremes = rows.groupBy(*keys).agg(F.min(value).alias("_mn"), F.max(value).alias("_mx"))
    out = rows.join(extremes, list(keys))
    scaled = F.when(F.col("_mx") > F.col("_mn"), ((F.col(value) - F.col("_mn")) / (F.col("_mx") - F.col("_mn")) * 255).cast("int")).otherwise(0)
    return out.withColumn("scaled", scaled).drop("_mn", "_mx")


def union_findings(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def common(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that both have, once each, by one grouping: an intersection joins all rows of a kind in one task before it makes them distinct."""
    both = left.withColumn("_side", F.lit(1)).union(right.withColumn("_side", F.lit(2)))
    return both.groupBy(*left.columns).agg(F.bit_or("_side").alias("_side")).where("_side = 3").drop("_side")


def register_batches(batches: DataFrame, dataset: str, order: str, count: str) -> DataFrame:
    """Batch numbers within each dataset, running sample counts, and the height of each batch in the global list (``order`` is unique).

    All are summed by ranges (see :mod:`attesta.plans.prefix`).
    """
    rows = batches.withColumns({"_one": F.lit(1), "_all": F.lit(0)})
    own = running_sums(rows, [dataset], [order], {"batch_number": "_one", "running": count})
    return running_sums(own, ["_all"], [order], {"block_height": "_one"}).drop("_one", "_all")


def register(manifests: DataFrame, known: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Rows to append for new manifests (batch_id, dataset, contributor, merkle_root, sample_count, at), by table; what is known stays.

    ``known``: contributors (contributor), datasets (dataset, contributor, total_samples), batches (batch_id, dataset) and roots
    (root_hash). A batch is registered once, a contributor, a dataset (a name of a contributor) and a root where they are new.
    Batch numbers go on from those of the dataset, block heights from the number of roots. ``datasets`` holds the totals after.
    """
    fresh = manifests.join(known["batches"].select("batch_id"), "batch_id", "left_anti").dropDuplicates(["batch_id"])
    contributors = manifests.select("contributor").distinct().join(known["contributors"].select("contributor"), "contributor", "left_anti")
    added = manifests.groupBy("dataset", "contributor").agg(F.sum("sample_count").alias("_new"))
    both = known["datasets"].select("dataset", "contributor", "total_samples").join(added, ["dataset", "contributor"], "full")
    datasets = both.select("dataset", "contributor", (F.coalesce("total_samples", F.lit(0)) + F.coalesce("_new", F.lit(0))).alias("total_samples"), F.col("total_samples").isNull().alias("is_new"))
    before = known["batches"].groupBy("dataset").agg(F.count("*").alias("_before"))
    numbered = running_sums(fresh.withColumn("_one", F.lit(1)), ["dataset", "contributor"], ["at", "batch_id"], {"_k": "_one"}).join(before, "dataset", "left")
    batches = numbered.select("batch_id", "dataset", "contributor", (F.coalesce("_before", F.lit(0)) + F.col("_k")).alias("batch_number"), "sample_count")
    roots = fresh.groupBy(F.col("merkle_root").alias("root_hash")).agg(F.min(F.struct("at", "batch_id", "sample_count")).alias("f")).join(known["roots"].select("root_hash"), "root_hash", "left_anti")
    tall = known["roots"].agg(F.count("*").alias("_tall"))
    placed = running_sums(roots.select("root_hash", "f.*").withColumns({"_one": F.lit(1), "_all": F.lit(0)}), ["_all"], ["at", "batch_id"], {"_k": "_one"})
    heights = placed.join(F.broadcast(tall)).select("root_hash", "batch_id", F.col("sample_count").alias("leaf_count"), (F.col("_tall") + F.col("_k")).alias("block_height"))
    return {"contributors": contributors, "datasets": datasets, "batches": batches, "roots": heights}


#: Directory names that say nothing about what is in them.
GENERIC = (".", "images", "data", "uploads")


def primary_label(first: Column, scalar: Column, meta_class: Column, path: Column) -> Column:
    """A sample's label: of its first annotation (a map) the class, category, class_id or spectral_band; else the first
    annotation itself where it is a plain value; else the class of its metadata; else its directory unless that is generic."""
    given = F.coalesce(*[F.element_at(first, F.lit(k)) for k in ("class", "category", "class_id", "spectral_band")])
    parts = F.split(path, "/")
    folder = F.when(F.size(parts) > 1, F.element_at(parts, -2))
    filled = [F.when(c != "", c) for c in (F.coalesce(given, scalar), meta_class)]
    return F.coalesce(*filled, F.when((folder != "") & ~folder.isin(*GENERIC), folder))


def standardise(px: Column, mean: Sequence[float], std: Sequence[float], layout: str = "NCHW") -> Column:
    """Pixels row by row with interleaved channels, scaled to 0..1 and standardised a channel; ``NCHW`` puts channel after channel."""
    n = len(mean)
    means, stds = F.array(*[F.lit(float(x)) for x in mean]), F.array(*[F.lit(float(x)) for x in std])
    flat = F.transform(px, lambda x, i: (x / 255.0 - F.get(means, i % n)) / F.get(stds, i % n))
    if layout != "NCHW":
        return flat
    pixels = F.floor(F.size(px) / n).cast("int")
    return F.flatten(F.array(*[F.transform(F.sequence(F.lit(0), pixels - 1), _strided(flat, n, k)) for k in range(n)]))


def _strided(values: Column, n: int, k: int):
    return lambda p: F.get(values, p * n + k)


def evidence_lines(lines: DataFrame, keys: Sequence[str], order: str, line: str, shown: int = 3) -> DataFrame:
    """keys, first_lines (the ``shown`` first), n: distinct lines by their words, in the order of first sight; all lines about
    spatial windows become one last line, which counts them where there are several."""
    words = F.trim(F.regexp_replace(line, "\\s+", " "))
    first = lines.withColumn("_line", words).groupBy(*keys, "_line").agg(F.min(F.struct(order, F.col(line).alias("_raw"))).alias("_first"))
    spatial = F.col("_line").contains("spatial_window_") | F.lower("_line").contains("sliding window")
    found = first.select(*keys, spatial.alias("_spatial"), F.col(f"_first.{order}").alias("_at"), F.col("_first._raw").alias("_raw"))
    merged = found.where("_spatial").groupBy(*keys).agg(F.count("*").alias("_n"), F.min(F.struct("_at", "_raw")).alias("_m"))
    told = F.when(F.col("_n") == 1, F.col("_m._raw")).otherwise(F.concat(F.lit("Suspicious repeated static localized patch patterns detected across "), "_n", F.lit(" spatial windows.")))
    every = found.where("not _spatial").select(*keys, F.lit(0).alias("_last"), "_at", "_raw").union(merged.select(*keys, F.lit(1), "_m._at", told))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_last", "_at"))
    kept = every.withColumn("_k", place).where(F.col("_k") <= shown).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_raw"))), lambda x: x["_raw"]).alias("first_lines"))
    return kept.join(every.groupBy(*keys).agg(F.count("*").alias("n")), list(keys))
