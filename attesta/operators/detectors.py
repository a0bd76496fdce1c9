"""Dataset detectors: exact copies, repeated patches, label quality, health and roll-ups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.tiers import PENALTY, SEVERITIES, lookup, tier
from attesta.operators.merkle import grouped_roots
from attesta.plans.lineage import shuffle_partitions


def exact_duplicates(rows: DataFrame, key: str, digest: str) -> DataFrame:
    """digest, key, n: the rows of each group of equal digests, and its size."""
    return rows.select(digest, key).join(rows.groupBy(digest).agg(F.count("*").alias("n")).where("n > 1"), digest)


def severity_tally(findings: DataFrame, target: str, severity: str) -> DataFrame:
    return findings.groupBy(target).pivot(severity, list(SEVERITIES)).agg(F.count(F.lit(1))).na.fill(0)


def health(findings: DataFrame, target: str, severity: str) -> DataFrame:
    """target, score (1 less the penalties, 0 to 1, four digits), status."""
    penalty = lookup(F.col(severity), PENALTY, 0.0)
    g = findings.groupBy(target).agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.sum(penalty))), 4).alias("score"))
    return g.withColumn("status", tier(F.col("score"), [(0.85, "HEALTHY"), (0.60, "DEGRADED")], "CRITICAL"))


def contributor_rollup(samples: DataFrame, findings: DataFrame, contributor: str, kind: str, severity: str) -> DataFrame:
    """Per contributor: samples, findings, sorted kinds, counts by severity, and indicators (none for UNKNOWN)."""
    n = samples.groupBy(contributor).agg(F.count("*").alias("samples"))
    by = [F.count_if(F.col(severity) == s).alias(s.lower()) for s in SEVERITIES]
    f = findings.groupBy(contributor).agg(F.count("*").alias("findings"), F.array_sort(F.collect_set(kind)).alias("kinds"), *by)
    out = n.join(f, contributor, "left").na.fill(0)
    flags = F.filter(F.array(F.when(F.col("critical") > 0, F.lit("CRITICAL_FINDINGS")), F.when(F.col("high") > 3, F.lit("MANY_HIGH_FINDINGS"))), lambda x: x.isNotNull())
    return out.withColumns({"kinds": F.coalesce("kinds", F.array().cast("array<string>")), "indicators": F.when(F.col(contributor) == "UNKNOWN", F.array().cast("array<string>")).otherwise(flags)})


CORNERS = ("TL", "TR", "BL", "BR")


def corner(px: Column, name: str, side: int = 8, patch: int = 4) -> Column:
    """The patch of a square image at one corner, row by row."""
    top = 0 if name[0] == "T" else side - patch
    left = 0 if name[1] == "L" else side - patch
    return F.concat(*[F.slice(px, (top + r) * side + left + 1, patch) for r in range(patch)])


def corners(images: DataFrame, px: str, side: int = 8, patch: int = 4) -> DataFrame:
    """``images`` with a row for each corner: corner, place (0 to 3) and values."""
    all_ = F.array(*[F.struct(F.lit(n).alias("corner"), F.lit(k).alias("place"), corner(F.col(px), n, side, patch).alias("values")) for k, n in enumerate(CORNERS)])
    return images.select(*images.columns, F.inline(all_))


def repeated_patches(images: DataFrame, key: str, label: str, digest: str, px: str, side: int = 8, patch: int = 4) -> DataFrame:
    """label, corner, signature, key, confidence: the samples of equal corner patches of two or more samples and files of one label.

    An all-zero patch counts only in images whose mean is above 20; labels with one sample are left to the isolated check.
    """
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    sizes = images.groupBy(label).agg(F.count("*").alias("label_size")).where("label_size > 1")
    rows = corners(images, px, side, patch).where((total(F.col("values")) > 0) | (total(F.col(px)) / F.size(px) > 20))
    signature = F.sha2(F.concat_ws(",", F.transform("values", lambda x: x.cast("string"))), 256)
    hits = rows.select(label, "corner", signature.alias("signature"), key, digest).distinct()
    g = hits.groupBy(label, "corner", "signature").agg(F.count_distinct(key).alias("samples"), F.count_distinct(digest).alias("files")).where("samples >= 2 and files >= 2").join(sizes, label)
    kept = g.select(label, "corner", "signature", F.round(F.col("samples") / F.col("label_size"), 4).alias("confidence"))
    return hits.drop(digest).distinct().join(kept, [label, "corner", "signature"])


def set_digest(key: str) -> list[Column]:
    """Aggregates that agree where the distinct keys do, whatever their order: their number and two sums of their hashes."""
    h = F.xxhash64(key).cast("decimal(20,0)")
    return [F.count("*").alias("_set_n"), F.sum(h).alias("_set_a"), F.sum(F.xxhash64(F.lit(1), key).cast("decimal(20,0)")).alias("_set_b")]


def isolated_triggers(images: DataFrame, key: str, px: str, *, least: float = 6000.0, side: int = 8, patch: int = 4) -> DataFrame:
    """key, corner, metric: the first corner of high variance made of dark and light pixels."""
    n = patch * patch
    share = lambda c: F.size(F.filter("values", c)) / n
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    mean = total(F.col("values")) / n
    rows = corners(images, px, side, patch).withColumn("mean", mean).withColumns({"dark": share(lambda x: x < 32), "light": share(lambda x: x > 224)})
    rows = rows.withColumn("variance", total(F.transform("values", lambda x: (x - F.col("mean")) * (x - F.col("mean")))) / n)
    hit = rows.where((F.col("variance") >= least) & (F.col("dark") >= 0.25) & (F.col("light") >= 0.25) & (F.col("dark") + F.col("light") >= 0.70))
    first = hit.groupBy(key).agg(F.min(F.struct("place", "corner", "variance")).alias("m"))
    return first.select(key, "m.corner", F.round(F.least(F.lit(1.0), F.col("m.variance") / 16384), 4).alias("metric"))


def sliding_patches(windows: DataFrame, images: DataFrame, key: str, label: str, digest: str, corner_hits: DataFrame, *, most_hits: int = 2, spread: int = 24) -> DataFrame:
    """label, signature, key: samples of signatures that two or more samples and files of one label share.

    Left out: signatures that any sample has more than ``most_hits`` times, those of just the samples of a corner finding
    (``corner_hits``: :func:`repeated_patches`), and those that spread over more than ``spread`` pixels (solid ones always, hashes
    with few bits only).
    """
    rows = windows.join(images.select(key, label, digest), key)
    hits = rows.groupBy(label, "signature", key).agg(F.count("*").alias("hits"), F.first(digest).alias("file"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.max("ones").alias("ones"))
    g = hits.groupBy(label, "signature").agg(*set_digest(key), F.count_distinct("file").alias("files"), F.max("hits").alias("hits"), F.greatest(F.max("x1") - F.min("x0"), F.max("y1") - F.min("y0")).alias("spread"), F.max("ones").alias("ones"))
    wide = (F.col("spread") > spread) & (F.col("ones").isNull() | (F.col("ones") < 12))
    kept = g.where((F.col("_set_n") >= 2) & (F.col("files") >= 2) & (F.col("hits") <= most_hits) & ~wide)
    known = corner_hits.groupBy(label, "corner", F.col("signature").alias("_s")).agg(*set_digest(key)).drop("corner", "_s").distinct()
    fresh = kept.join(known, [label, "_set_n", "_set_a", "_set_b"], "left_anti").select(label, "signature")
    return hits.select(label, "signature", key).join(fresh, [label, "signature"])


#: Queries that a task compares at once, base rows likewise, and queries that a task holds.
TILE, HELD = 256, 50_000


def _top(d: np.ndarray, ids: np.ndarray, labels: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest of each row of candidates, ties by id."""
    order = np.lexsort((ids, d), axis=1)[:, :k]
    return tuple(np.take_along_axis(x, order, axis=1) for x in (d, ids, labels))


def _nearest(k: int):
    """Queries and base rows of each (block, part) to each query's ``k`` nearest of the part."""

    def near(q: np.ndarray, x: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> Iterator[tuple]:
        squares = (x * x).sum(axis=1)
        for at in range(0, len(q), TILE):
            some = q[at : at + TILE]
            rough = squares - 2 * some @ x.T + (some * some).sum(axis=1)[:, None]
            m = min(k, len(x))
            edge = np.partition(rough, m - 1, axis=1)[:, m - 1]
            scale = 1e-9 * (1 + squares.max() + (some * some).sum(axis=1))
            row, col = np.nonzero(rough <= (edge + scale)[:, None])
            gap = some[row] - x[col]
            exact = np.zeros(len(row))
            for j in range(gap.shape[1]):  # summed in order of the dimensions, so that equal vectors have equal distances
                exact += gap[:, j] * gap[:, j]
            yield at, row, exact, ids[col], labels[col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, queries, best = None, [], None

        def flush() -> Iterator[pa.RecordBatch]:
            if best is not None:
                d, ids, labels = best
                n = np.isfinite(d)
                who = np.repeat(queries[0], n.sum(axis=1))
                yield pa.record_batch([pa.array(who), pa.array(np.repeat(queries[1], n.sum(axis=1))), pa.array(d[n]), pa.array(ids[n]), pa.array(labels[n])], ["x", "lx", "d", "y", "ly"])

        for batch in batches:
            key = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()])
            edge = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edge, edge[1:], strict=False):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                ids, labels = part.column(3).to_numpy(), part.column(4).to_numpy()
                x = np.stack(part.column(5).to_numpy(zero_copy_only=False)).astype(float)
                if (key[0, lo], key[1, lo]) != block:
                    yield from flush()
                    block, queries, best = (key[0, lo], key[1, lo]), [], None
                if key[2, lo] == 0:
                    queries = [np.concatenate([a, b]) for a, b in zip(queries, (ids, labels, x), strict=True)] if queries else [ids, labels, x]
                elif queries:
                    if best is None:
                        best = (np.full((len(queries[0]), k), np.inf), np.full((len(queries[0]), k), -1), np.full((len(queries[0]), k), -1))
                    for at, row, d, y, ly in near(queries[2], x, ids, labels):
                        width = int(np.bincount(row).max())
                        place = np.arange(len(row)) - np.searchsorted(row, row)
                        rows = min(TILE, len(queries[0]) - at)
                        new = [np.full((rows, width), fill) for fill in (np.inf, -1, -1)]
                        for a, values in zip(new, (d, y, ly), strict=True):
                            a[row, place] = values
                        top = _top(*(np.hstack([b[at : at + rows], a]) for b, a in zip(best, new, strict=True)), k)
                        for b, t in zip(best, top, strict=True):
                            b[at : at + rows] = t
        yield from flush()

    return run


def nearest(queries: DataFrame, rows: DataFrame, key: str, label: str, vector: str, k: int) -> DataFrame:
    """(x, lx, d, y, ly): the ``k`` rows nearest to each query by squared distance, ties by key; itself is one where it is among them.

    A stated query set against all rows, in blocks: each part of the rows meets each block of queries in one task, which holds
    the block and streams the part; the best of the parts are merged per query.
    """
    spark = rows.sparkSession
    blocks = max(1, -(-queries.count() // HELD))
    parts = shuffle_partitions(spark)
    kinds = [F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v")]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"), every(parts).alias("part"), F.lit(0).alias("kind"), *kinds)
    base = rows.select(every(blocks).alias("block"), F.pmod(F.xxhash64(key, F.lit(1)), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), *kinds)
    both = asked.union(base).repartition(parts * blocks, "block", "part").sortWithinPartitions("block", "part", "kind")
    found = both.mapInArrow(_nearest(k), "x long, lx long, d double, y long, ly long")
    best = found.groupBy("x", "lx").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "y", "ly"))), 1, k).alias("n"))
    return best.select("x", "lx", F.inline("n"))


def label_quality(rows: DataFrame, key: str, label: str, vector: str, queries: DataFrame, *, flag: float = 0.40) -> DataFrame:
    """key, label, quality, suggested, issue, flagged for each row of ``queries`` against all of ``rows``.

    Classes are voted by the nearest rows, three or as many as the smallest class has. Votes are kept within 1e-4 and 1 less
    that, and made to add up to one over all classes; a row's quality is the share of its own label. A sample is an issue if its
    likeliest class (the smallest of equal ones) is another one, at least as likely as that class is for its own samples on average.
    """
    classes = rows.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n"), F.count("*")).first()
    k, of = max(1, min(3, classes[0] or 1)), classes[1]
    votes = nearest(queries, rows, key, label, vector, k).groupBy("x", "lx", F.col("ly").alias("c")).agg((F.count("*") / k).alias("v"))
    p = votes.withColumn("p", F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), F.col("v"))))
    g = p.groupBy("x", "lx").agg(F.max(F.struct("p", (-F.col("c")).alias("c"))).alias("top"), F.coalesce(F.max(F.when(F.col("c") == F.col("lx"), F.col("p"))), F.lit(1e-4)).alias("own"), (F.sum("p") + 1e-4 * (of - F.count("*"))).alias("total"))
    g = g.select("x", "lx", (-F.col("top.c")).alias("suggested"), (F.col("top.p") / F.col("total")).alias("likely"), (F.col("own") / F.col("total")).alias("quality"))
    own = g.groupBy(F.col("lx").alias("cls")).agg(F.avg("quality").alias("self"))
    out = g.join(own, F.col("suggested") == F.col("cls"), "left")
    issue = (F.col("suggested") != F.col("lx")) & (F.col("likely") >= F.coalesce("self", F.lit(0.0)))
    return out.select(F.col("x").alias(key), F.col("lx").alias(label), F.round("quality", 4).alias("quality"), "suggested", issue.alias("issue"), (issue | (F.col("quality") < flag)).alias("flagged"))


def collection_summary(bands: DataFrame, metadata: DataFrame, patch: str, band: str, size: str, expected: list) -> DataFrame:
    """One row about a collection of patches: patches, complete, incomplete, corrupt, missing_bands, total_bytes, total_mb,
    bands_present, earliest, latest, anomalies, valid (some patch is whole) and clean (all are, and none is corrupt).

    ``bands`` has a row a band file; ``metadata`` (patch, readable, acquired) one a patch: those that are not readable are corrupt.
    """
    need = F.array(*[F.lit(b) for b in expected])
    held = bands.groupBy(patch).agg(F.collect_set(band).alias("seen"), F.sum(size).alias("bytes"))
    g = metadata.join(held, patch, "full").withColumn("missing", F.size(F.array_except(need, F.coalesce("seen", F.array().cast(bands.groupBy().agg(F.collect_set(band)).schema[0].dataType)))))
    bad, gone = ~F.coalesce("readable", F.lit(True)), F.col("missing") > 0
    out = g.agg(
        F.count("*").alias("patches"), F.count_if(~gone).alias("complete"), F.count_if(gone).alias("incomplete"), F.count_if(bad).alias("corrupt"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_bands"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("total_bytes"), F.min(F.when(~bad, F.col("acquired"))).alias("earliest"), F.max(F.when(~bad, F.col("acquired"))).alias("latest"),
    )
    present = bands.groupBy().agg(F.array_sort(F.collect_set(band)).alias("bands_present"))
    n = F.col
    return out.join(present).withColumns({"total_mb": F.round(n("total_bytes") / (1 << 20), 2), "anomalies": n("incomplete") + n("corrupt"), "valid": n("complete") > 0, "clean": (n("patches") > 0) & (n("corrupt") == 0) & (n("incomplete") == 0)})


def label_distribution(metadata: DataFrame, labels: str) -> DataFrame:
    """label, n over the readable metadata."""
    return metadata.where(F.coalesce("readable", F.lit(True))).select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def assess(samples: DataFrame, findings: DataFrame, key: str, changed: DataFrame | None = None) -> DataFrame:
    """key, result, score: the verdict of each sample from its findings (check_type, severity, metric, counts) and on whether it is among
    the ``changed`` ones, whose digest is another than on record.

    Grave findings come first; then whatever isn't a duplicate, a duplicate of medium severity or a changed digest makes a sample
    suspicious; duplicates alone don't.
    """
    eff = F.coalesce(F.col("counts"), F.lit(True))
    dup = F.col("check_type").contains("DUPLICATE")
    g = findings.groupBy(key).agg(
        F.bool_or(eff & F.col("severity").isin("CRITICAL", "HIGH")).alias("bad"),
        F.bool_or(eff & (~dup | (F.col("severity") == "MEDIUM"))).alias("odd"),
        F.bool_or(dup).alias("dup"),
        F.max("metric").alias("score"),
    )
    j = samples.select(key).join(g, key, "left")
    j = j.withColumn("_new", F.lit(False)) if changed is None else j.join(changed.select(key).distinct().withColumn("_new", F.lit(True)), key, "left")
    result = F.when(F.col("bad"), "POISONED").when(F.col("odd") | F.col("_new"), "SUSPICIOUS").when(F.col("dup"), "NEAR-DUPLICATE").otherwise("CLEAN")
    return j.select(key, result.alias("result"), F.coalesce("score", F.lit(0.0)).alias("score"))


def changed_fingerprints(now: DataFrame, history: DataFrame, key: str, digest: str) -> DataFrame:
    """Samples that the history knows, but never with this digest."""
    known = history.select(key).distinct()
    seen = history.select(key, digest).distinct()
    return now.join(known, key, "left_semi").join(seen, [key, digest], "left_anti")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def current_digests(manifest: DataFrame, files: DataFrame, key: str, digest: str, now: str) -> DataFrame:
    """``manifest`` with ``current`` (the file's digest, or FILE_NOT_FOUND) and ``tampered``."""
    j = manifest.join(files.select(key, F.col(now).alias("_now")), key, "left").withColumn("current", F.coalesce("_now", F.lit("FILE_NOT_FOUND")))
    return j.withColumn("tampered", F.col("current") != F.col(digest)).drop("_now")


def manifest_result(leaves: DataFrame, known: DataFrame, batch: str) -> DataFrame:
    """One row a batch: tampered, calculated_root, manifest_root and valid, from leaves (batch, idx, hash, tampered) made anew and
    the roots on record (batch, manifest_root)."""
    found = grouped_roots(leaves.select(batch, "idx", "hash"), [batch]).withColumnRenamed("root", "calculated_root")
    counts = leaves.groupBy(batch).agg(F.count_if("tampered").alias("tampered"))
    out = counts.join(found, batch).join(known, batch, "left")
    return out.withColumn("valid", (F.col("tampered") == 0) & (F.col("calculated_root") == F.col("manifest_root")))


def quarantine(asked: DataFrame, assessments: DataFrame, findings: DataFrame, key: str, finding: str) -> tuple[DataFrame, DataFrame]:
    """Samples that go to quarantine, and requests that are refused (``outcome``: UNKNOWN or CLEAN).

    The first hold result, findings (sorted), trust, action and reason: they are the audit events to append.
    """
    j = asked.join(assessments.select(key, "result"), key, "left")
    why = F.when(F.col("result").isNull(), "UNKNOWN").when(F.col("result") == "CLEAN", "CLEAN")
    per = findings.groupBy(key).agg(F.array_sort(F.collect_list(finding)).alias("findings"))
    done = j.where(why.isNull()).join(per, key, "left").withColumns({"findings": F.coalesce("findings", F.array().cast("array<string>")), "trust": F.lit("REVOKED"), "action": F.lit("QUARANTINED"), "reason": F.lit("Integrity/poisoning violation")})
    return done, j.withColumn("outcome", why).where("outcome is not null").select(key, "outcome")
