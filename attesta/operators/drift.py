"""Distribution shift between a baseline and a target, feature by feature.

Input is long: feature, value, base (true for the baseline). All statistics are grouped aggregates; raw rows are never paired.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.tiers import lookup
from attesta.plans.lineage import cut
from attesta.plans.prefix import ordered_digest, running_sums

BINS = 10
EPSILON = 1e-4


def common_features(rows: DataFrame) -> DataFrame:
    """Rows of the features that both sides have."""
    both = rows.groupBy("feature").agg(F.bool_or("base").alias("b"), F.bool_or(~F.col("base")).alias("t")).where("b and t").select("feature")
    return rows.join(both, "feature", "left_semi")


def ranked(rows: DataFrame) -> DataFrame:
    """feature, value, b, t, cb, ct, n, m: counts of each distinct value on both sides, running ones, and those of the feature.

    What is summed up are distinct values, by ranges (see :mod:`attesta.plans.prefix`). All statistics by rank are read off this
    table: it is written once.
    """
    counts = rows.where("value is not null").groupBy("feature", "value").agg(F.count_if("base").alias("b"), F.count_if(~F.col("base")).alias("t"))
    steps = cut(running_sums(counts, ["feature"], ["value"], {"cb": "b", "ct": "t"}))
    return steps.join(steps.groupBy("feature").agg(F.sum("b").alias("n"), F.sum("t").alias("m")), "feature")


def quantiles(steps: DataFrame, at: list[float], name: str, sides: tuple[str, ...] = ("b", "t")) -> DataFrame:
    """feature and an array of quantiles for each side (``name_b``, ``name_t``; null where a side is empty), interpolated linearly.

    ``steps`` is :func:`ranked`: a value that stands at a wanted rank, or next above it, is picked where it lies. Most values are
    passed over by arithmetic on their own ranks.
    """
    points = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(p).alias("p")) for k, p in enumerate(at)])
    out = steps.select("feature").distinct()
    for side, total, upto in (("b", "n", "cb"), ("t", "m", "ct")):
        if side not in sides:
            continue
        first, last = F.col(upto) - F.col(side), F.col(upto) - 1
        place = lambda x: x["p"] * (F.col(total) - 1)
        over = F.filter(points, lambda x: (F.floor(place(x)) <= last) & (F.ceil(place(x)) >= first))
        found = steps.where((F.col(side) > 0) & _near(at, first, last, F.col(total) - 1)).select("feature", "value", F.col(total).alias("_of"), first.alias("_lo"), last.alias("_hi"), F.explode(over).alias("x"))
        rank = F.col("x.p") * (F.col("_of") - 1)
        inside = lambda r: F.when((F.col("_lo") <= r) & (F.col("_hi") >= r), F.col("value"))
        two = found.groupBy("feature", "x.k").agg(F.max(inside(F.floor(rank))).alias("low"), F.max(inside(F.ceil(rank))).alias("high"), F.max(rank - F.floor(rank)).alias("share"))
        one = two.select("feature", F.struct("k", (F.col("low") + (F.col("high") - F.col("low")) * F.col("share")).alias("q")).alias("x"))
        out = out.join(one.groupBy("feature").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["q"]).alias(f"{name}_{side}")), "feature", "left")
    return out


def _near(at: list[float], first: Column, last: Column, top: Column) -> Column:
    """Whether one of the points, or a rank next to it, may lie among the ranks from ``first`` to ``last`` of 0 to ``top``: exact for a few
    points; for many, which are evenly spaced, by the numbers of the first and last point inside, a little too wide."""
    if len(at) < 9:
        return reduce(or_, [(F.floor(p * top) <= last) & (F.ceil(p * top) >= first) for p in at])
    gap = (at[-1] - at[0]) / (len(at) - 1)
    span = F.greatest(top, F.lit(1))
    number = lambda rank: (rank / span - at[0]) / gap
    low, high = F.greatest(F.ceil(number(first - 1) - 1e-6), F.lit(0)), F.least(F.floor(number(last + 1) + 1e-6), F.lit(len(at) - 1))
    return low <= high


def summaries(rows: DataFrame) -> DataFrame:
    v = F.col("value")
    out = rows.groupBy("feature").agg(F.count(v).alias("count"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_pop(v), 4).alias("std"), F.round(F.min(v), 4).alias("min"), F.round(F.max(v), 4).alias("max"))
    middle = quantiles(ranked(rows.select("feature", "value", F.lit(True).alias("base"))), [0.5], "q", ("b",))
    return out.join(middle.select("feature", F.round(F.get("q_b", F.lit(0)), 4).alias("median")), "feature", "left")


def ks_distance(rows: DataFrame) -> DataFrame:
    """feature, ks, n, m: the largest gap of the two distribution functions; 0 where a side is empty."""
    return _ks(ranked(rows))


def _ks(steps: DataFrame) -> DataFrame:
    gap = F.when((F.col("n") > 0) & (F.col("m") > 0), F.abs(F.col("cb") / F.col("n") - F.col("ct") / F.col("m"))).otherwise(0.0)
    return steps.groupBy("feature").agg(F.max(gap).alias("ks"), F.max("n").alias("n"), F.max("m").alias("m"))


def ks_p_value(d: Column, n: Column, m: Column) -> Column:
    """The asymptotic p-value: 1 for a distance of 0 or an empty side, 0 from a scaled distance of 4 on."""
    en = F.sqrt(n * m / (n + m))
    lam = (en + 0.12 + 0.11 / en) * d
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda j: 2 * F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2 * j * j * lam * lam))
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.when((d <= 0) | (n == 0) | (m == 0), 1.0).when(lam >= 4, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def psi(rows: DataFrame) -> DataFrame:
    """feature, psi over ten equal bins of the joint range, with a small count added to each; 0 for a range of one point, and
    where a side is empty."""
    return _psi(rows.groupBy("feature", "value").agg(F.count_if("base").alias("b"), F.count_if(~F.col("base")).alias("t")))


def _psi(counts: DataFrame) -> DataFrame:
    ends = counts.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    at = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1)).cast("int")
    bins = counts.select("feature", "value", "b", "t").join(ends, "feature").where("hi > lo").groupBy("feature", at.alias("bin")).agg(F.sum("b").alias("b"), F.sum("t").alias("t"))
    sides = bins.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct("b", "t")))).alias("c"), F.sum("b").alias("n"), F.sum("t").alias("m"))

    def term(k: Column) -> Column:
        share = lambda side, total: (F.coalesce(F.element_at("c", k)[side], F.lit(0)) + EPSILON) / (F.col(total) + BINS * EPSILON)
        return (share("t", "m") - share("b", "n")) * F.log(share("t", "m") / share("b", "n"))

    total = F.aggregate(F.sequence(F.lit(0), F.lit(BINS - 1)), F.lit(0.0), lambda a, k: a + term(k))
    both = sides.where("n > 0 and m > 0").select("feature", total.alias("psi"))
    return ends.select("feature").join(both, "feature", "left").na.fill(0.0, ["psi"])


def wasserstein(rows: DataFrame) -> DataFrame:
    """feature, w1: the mean gap of a hundred quantiles from 0.01 to 0.99; 0 where a side is empty."""
    return _wasserstein(ranked(rows))


def _wasserstein(steps: DataFrame) -> DataFrame:
    at = [0.01 + (0.99 - 0.01) * k / 99 for k in range(100)]
    gap = F.aggregate(F.zip_with("q_b", "q_t", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / len(at)
    return quantiles(steps, at, "q").select("feature", F.coalesce(gap, F.lit(0.0)).alias("w1"))


def energy_distance(rows: DataFrame) -> DataFrame:
    """feature, energy over two hundred quantiles of each side, from 0.005 to 0.995; not below 0."""
    return _energy(ranked(rows))


def _energy(steps: DataFrame) -> DataFrame:
    at = [0.005 + (0.995 - 0.005) * k / 199 for k in range(200)]

    def spread(x: Column, y: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, a: s + F.aggregate(y, F.lit(0.0), lambda t, b: t + F.abs(a - b))) / (len(at) * len(at))

    b, t = F.col("q_b"), F.col("q_t")
    return quantiles(steps, at, "q").select("feature", F.coalesce(F.greatest(F.lit(0.0), 2 * spread(b, t) - spread(b, b) - spread(t, t)), F.lit(0.0)).alias("energy"))


def shift_report(rows: DataFrame, threshold: float = 0.25) -> DataFrame:
    """All statistics of each common feature, rounded to four digits, and whether it drifted."""
    steps = cut(ranked(rows).where("n > 0 and m > 0"))
    out = _ks(steps).join(_psi(steps), "feature").join(_wasserstein(steps), "feature").join(_energy(steps), "feature")
    r = lambda c: F.round(c, 4)
    out = out.withColumn("p", ks_p_value(F.col("ks"), F.col("n"), F.col("m")))
    out = out.select("feature", r(F.col("ks")).alias("ks"), r(F.col("p")).alias("p_value"), r(F.col("psi")).alias("psi"), r(F.col("w1")).alias("w1"), r(F.col("energy")).alias("energy"))
    worst = F.when((F.col("psi") > 0.5) | (F.col("ks") > 0.6), "CRITICAL").when((F.col("psi") > 0.25) | (F.col("ks") > threshold), "HIGH")
    return out.withColumns({"drifted": (F.col("ks") > threshold) | (F.col("psi") > 0.25), "severity": worst})


def classify_shift(report: DataFrame, keys: list[str], threshold: float = 0.25, digits: int = 4) -> DataFrame:
    """One verdict for each key of a report (feature, ks, drifted): the mean distance and the features that drifted decide the kind
    of shift, and that its severity and status."""
    g = report.groupBy(*keys).agg(F.round(F.avg("ks"), digits).alias("overall"), F.array_sort(F.collect_set(F.when(F.col("drifted"), F.col("feature")))).alias("drifted"))
    has = lambda *names: F.arrays_overlap("drifted", F.array(*[F.lit(n) for n in names]))
    kind = (
        F.when((F.col("overall") <= threshold) & (F.size("drifted") == 0), "NO_DRIFT")
        .when(has("sharpness") & ~has("brightness", "contrast", "channel_entropy"), "SENSOR_DEGRADATION")
        .when(has("brightness", "color_temperature", "contrast") & ~has("channel_entropy") & (F.col("overall") < 0.60), "OPERATIONAL_ENVIRONMENTAL")
        .when(has("channel_entropy") | (F.col("overall") >= 0.60), "ADVERSARIAL_ANOMALY")
        .otherwise("DATASET_DRIFT")
    )
    severity = {"NO_DRIFT": "NO_DRIFT", "SENSOR_DEGRADATION": "MILD_DRIFT", "OPERATIONAL_ENVIRONMENTAL": "MILD_DRIFT", "ADVERSARIAL_ANOMALY": "CRITICAL_SHIFT"}
    status = {"NO_DRIFT": "ACCEPTED", "ADVERSARIAL_ANOMALY": "QUARANTINED"}
    g = g.withColumn("shift", kind)
    return g.withColumns({"severity": lookup(F.col("shift"), severity, "SIGNIFICANT_DRIFT"), "status": lookup(F.col("shift"), status, "UNDER_REVIEW")})


def baseline_digest(rows: DataFrame, order: list[str]) -> DataFrame:
    """feature, digest over its values in ``order``, as text with four digits (see :func:`attesta.plans.prefix.ordered_digest`)."""
    shown = F.format_string("%.4f", F.col("value"))
    return ordered_digest(rows.select("feature", *order, shown.alias("_shown")), ["feature"], order, "_shown")


def baseline_audit(rows: DataFrame, order: list[str], known: DataFrame) -> DataFrame:
    """feature, digest, expected, valid: digests made anew against ``known`` (feature, digest); one that is missing on either
    side is not valid."""
    now = baseline_digest(rows, order)
    both = now.join(known.select("feature", F.col("digest").alias("expected")), "feature", "full")
    return both.withColumn("valid", F.coalesce(F.col("digest") == F.col("expected"), F.lit(False)))


def baseline_from_summaries(summary: DataFrame, times: int = 5) -> DataFrame:
    """Rows that stand in where only summaries are known: each mean, five times."""
    return summary.select("feature", F.explode(F.array_repeat("mean", times)).alias("value"))
