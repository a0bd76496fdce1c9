"""Model manifests, output fingerprints and trigger sensitivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changed_layers(baseline: DataFrame, candidate: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Layers that both have and whose digests differ."""
    other = candidate.select(*keys, F.col(digest).alias("_now"))
    return baseline.join(other, keys).where(F.col(digest) != F.col("_now")).select(*keys)


def with_baseline(models: DataFrame, baselines: DataFrame, by_id: tuple[str, str], by_name: list[str]) -> DataFrame:
    """``models`` with ``baseline``, a struct of the baseline's columns: that of the given id, else of the name; null where there is none."""
    own, key = by_id
    named = lambda p: baselines.select(F.struct(*baselines.columns).alias(p))
    j = models.join(named("_i"), F.col(own) == F.col(f"_i.{key}"), "left")
    same = F.lit(True)
    for c in by_name:
        same = same & (F.col(c) == F.col(f"_n.{c}"))
    j = j.join(named("_n"), same, "left")
    return j.select(*models.columns, F.coalesce("_i", "_n").alias("baseline"))


def compare_manifests(models: DataFrame, baselines: DataFrame, by_id: tuple[str, str], by_name: list[str], fields: list[str]) -> DataFrame:
    """``models`` with discrepancies (fields that differ from the baseline) and status: the baseline is that of the given id, else of the name; none leaves UNAVAILABLE."""
    known = F.col("baseline").isNotNull()
    diff = F.filter(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"baseline.{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    out = with_baseline(models, baselines, by_id, by_name).withColumn("discrepancies", F.when(known, diff))
    status = F.when(~known, "UNAVAILABLE").when(F.size("discrepancies") == 0, "MATCH").otherwise("MISMATCH")
    return out.withColumn("status", status).select(*models.columns, "discrepancies", "status")


def verify_models(rows: DataFrame) -> DataFrame:
    """Verdicts on models beside their ``baseline`` (see :func:`with_baseline`).

    Models and baselines have artifact_hash, weights_hash, architecture_hash (null or empty: identity_digest stands in),
    identity_digest, access_mode, layer_count, parameter_count, inputs and outputs; models also current_hash (of the file as it is now,
    null where there is no file), changed_layers (names), behavioural and trigger (statuses, UNAVAILABLE where they weren't tested).
    Adds binary_identity, structural_identity, behavioural_identity and trigger_status, weights_match, discrepancies (codes, in this
    order) and is_valid: everything matches or is unavailable, and there is no discrepancy. A black box has no structure to compare,
    which is a discrepancy; without a baseline all is unavailable and nothing valid. Weights count where both sides know them.
    """
    base, black = lambda c: F.col(f"baseline.{c}"), F.lit("BLACK_BOX")
    known, given = F.col("baseline").isNotNull(), lambda c: F.coalesce(c != "", F.lit(False))
    now = F.coalesce("current_hash", "artifact_hash")
    binary = F.coalesce(now == base("artifact_hash"), F.lit(False))
    weights = ~(given(F.col("weights_hash")) & given(base("weights_hash"))) | (F.col("weights_hash") == base("weights_hash"))
    closed = F.coalesce(F.col("access_mode") == black, F.lit(False)) | F.coalesce(base("access_mode") == black, F.lit(False))
    form = lambda a, d: F.when(given(a), a).otherwise(d)
    alike = form(F.col("architecture_hash"), F.col("identity_digest")).eqNullSafe(form(base("architecture_hash"), base("identity_digest")))
    differs = lambda c: ~closed & ~F.col(c).eqNullSafe(base(c))
    codes = [
        ("ARTIFACT_MODIFIED", F.coalesce(F.col("current_hash") != F.col("artifact_hash"), F.lit(False))),
        ("BINARY", ~binary),
        ("STRUCTURE_UNAVAILABLE", closed),
        ("ARCHITECTURE", ~closed & ~alike),
        *[(c.upper(), differs(c)) for c in ("layer_count", "parameter_count", "inputs", "outputs")],
        ("BEHAVIOUR", F.col("behavioural") == "MISMATCH"),
        ("TRIGGER", F.col("trigger") == "SUSPICIOUS"),
    ]
    flags = [F.when(cond, F.lit(code)) for code, cond in codes]
    layers = F.when(~weights, F.transform(F.coalesce("changed_layers", F.array().cast("array<string>")), lambda x: F.concat(F.lit("WEIGHTS:"), x))).otherwise(F.array().cast("array<string>"))
    found = F.concat(F.filter(F.array(*flags[:2]), lambda x: x.isNotNull()), layers, F.filter(F.array(*flags[2:]), lambda x: x.isNotNull()))
    status = lambda yes: F.when(~known, "UNAVAILABLE").when(yes, "MATCH").otherwise("MISMATCH")
    out = rows.withColumns({
        "binary_identity": status(binary),
        "structural_identity": F.when(closed, "UNAVAILABLE").otherwise(status(alike)),
        "behavioural_identity": F.when(known, F.col("behavioural")).otherwise("UNAVAILABLE"),
        "trigger_status": F.when(known, F.col("trigger")).otherwise("UNAVAILABLE"),
        "weights_match": known & weights,
        "discrepancies": F.when(known, found).otherwise(F.array(F.lit("NO_BASELINE"))),
    })
    fine = lambda c: F.col(c).isin("MATCH", "UNAVAILABLE")
    valid = (F.col("binary_identity") == "MATCH") & F.col("weights_match") & fine("structural_identity") & fine("behavioural_identity") & (F.col("trigger_status") != "SUSPICIOUS") & (F.size("discrepancies") == 0)
    return out.withColumn("is_valid", valid)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def probe_pairs(reference: DataFrame, candidate: DataFrame, probe: str, output: str) -> DataFrame:
    """Probes of both models with outputs of one length: probe, a, b, divergent (the outputs differ)."""
    a, b = reference.select(probe, F.col(output).alias("a")), candidate.select(probe, F.col(output).alias("b"))
    return a.join(b, probe).where(F.size("a") == F.size("b")).withColumn("divergent", F.col("a") != F.col("b"))


def similarity(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Over the concatenated outputs of each key: cosine (0 for a zero norm), mse, max_error and status.

    Each probe is reduced where it is; sums are added per key.
    """
    gap = F.zip_with("a", "b", lambda x, y: x - y)
    each = pairs.select(*keys, _dot(F.col("a"), F.col("b")).alias("ab"), _dot(F.col("a"), F.col("a")).alias("aa"), _dot(F.col("b"), F.col("b")).alias("bb"), _dot(gap, gap).alias("sq"), F.array_max(F.transform(gap, lambda x: F.abs(x))).alias("mx"), F.size("a").alias("n"))
    g = each.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("ab", "aa", "bb", "sq", "n")], F.max("mx").alias("mx"))
    cos = F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).otherwise(0.0)
    out = g.select(*keys, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cos)), 4).alias("cosine"), F.round(F.col("sq") / F.col("n"), 4).alias("mse"), F.round("mx", 6).alias("max_error"))
    return out.withColumn("status", F.when(F.col("cosine") < 0.95, "QUARANTINED").otherwise("ACCEPTED"))


def perturbation_vectors(reference: DataFrame, candidate: DataFrame, key: str) -> DataFrame:
    """Paired vectors of results (digest_match is from the digests): a missing reference pairs (0, confidence, 0) with (1, 1, 1)."""
    r = reference.select(key, F.col("digest").alias("_d"), F.col("confidence").alias("_c"), F.col("top").alias("_t"))
    j = candidate.join(r, key, "left")
    there = F.col("_d").isNotNull()
    d = lambda c: c.cast("double")
    same, cls = d(F.col("digest") == F.col("_d")), d(F.col("top") == F.col("_t"))
    a = F.when(there, F.array(same, F.col("confidence"), cls)).otherwise(F.array(F.lit(0.0), F.col("confidence"), F.lit(0.0)))
    b = F.when(there, F.array(F.lit(1.0), F.col("_c"), F.lit(1.0))).otherwise(F.array(*[F.lit(1.0)] * 3))
    return j.select(key, a.alias("a"), b.alias("b"))


def divergence_evidence(results: DataFrame, key: str, match: str, delta: str, divergent: DataFrame) -> DataFrame:
    """A row for each perturbation that does not match, HIGH where the confidence moved by more than 0.1; else one AGGREGATE row for a divergent model."""
    rows = results.where(~F.col(match)).select("model", key, F.when(F.abs(F.col(delta)) > 0.1, "HIGH").otherwise("MEDIUM").alias("severity"))
    rest = divergent.join(rows.select("model").distinct(), "model", "left_anti").select("model", F.lit("AGGREGATE").alias(key), F.lit("HIGH").alias("severity"))
    return rows.union(rest)


def activation_stats(outputs: DataFrame, keys: list[str], vector: str) -> DataFrame:
    x = outputs.select(*keys, F.explode(vector).alias("x"))
    return x.groupBy(*keys).agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("std"), F.round(F.sqrt(F.sum(F.col("x") * F.col("x"))), 6).alias("norm"))


def softmax(v: Column) -> Column:
    def of(m: Column) -> Column:
        e = F.transform(v, lambda x: F.exp(x - m))
        return F.transform(F.array(e), lambda y: F.transform(y, lambda x: x / F.aggregate(y, F.lit(0.0), lambda s, t: s + t)))[0]

    return F.transform(F.array(F.array_max(v)), of)[0]


def prediction_summary(outputs: DataFrame, key: str, vector: str) -> DataFrame:
    """Per key: confidence (mean of the rows' largest probabilities) and top (class of the largest mean). Rows that are all probabilities stay; else each is put through a softmax."""
    total = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x)
    probable = F.forall(vector, lambda x: x >= 0) & (F.abs(total - 1) <= 1e-3)
    all_ = outputs.groupBy(key).agg(F.bool_and(probable).alias("_p"))
    p = outputs.join(all_, key).select(key, F.when(F.col("_p"), F.col(vector)).otherwise(softmax(F.col(vector))).alias("p"))
    conf = p.groupBy(key).agg(F.round(F.avg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.array_max("p")))), 6).alias("confidence"))
    means = p.select(key, F.posexplode("p").alias("k", "x")).groupBy(key, "k").agg(F.avg("x").alias("m"))
    return conf.join(means.groupBy(key).agg((-F.max(F.struct("m", (-F.col("k")).alias("k")))["k"]).alias("top")), key)


def argmax(v: Column) -> Column:
    return F.array_position(v, F.array_max(v)) - 1


def trigger_verdict(probes: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, from clean, triggered and noise outputs: flip rates, the share of the commonest target, suspicious."""
    c, t, n = argmax(F.col("clean")), argmax(F.col("triggered")), argmax(F.col("noise"))
    rows = probes.select(*keys, (c != t).alias("ft"), (c != n).alias("fn"), t.alias("target"))
    by = rows.groupBy(*keys, "target").agg(F.count("*").alias("n"), F.count_if("ft").alias("flips"), F.count_if("fn").alias("noise_flips"))
    j = by.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "flips", "noise_flips")], F.max("flips").alias("most"))
    rate, noise = F.col("flips") / F.col("n"), F.col("noise_flips") / F.col("n")
    share = F.when(F.col("flips") > 0, F.col("most") / F.col("flips")).otherwise(0.0)
    return j.select(*keys, F.round(rate, 4).alias("flip_rate"), F.round(noise, 4).alias("noise_rate"), F.round(share, 4).alias("target_share"), ((rate - noise >= 0.5) & (share >= 0.75) & (F.col("flips") >= 3)).alias("suspicious"))


def tensor_summary(outputs: DataFrame, key: str, vector: str, shape: list[int]) -> DataFrame:
    """key, valid (finite, and of the declared size but for dynamic dimensions), min, max, mean, elements."""
    v = F.col(vector)
    fixed = 1
    for x in shape:
        fixed *= x if x > 0 else 1
    size = F.size(v) % fixed == 0 if any(x <= 0 for x in shape) else F.size(v) == fixed
    finite = F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return outputs.select(key, (finite & size).alias("valid"), F.round(F.array_min(v), 6).alias("min"), F.round(F.array_max(v), 6).alias("max"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v), 6).alias("mean"), F.size(v).cast("long").alias("elements"))


def assurance(verified: DataFrame) -> DataFrame:
    """One finding a model from :func:`verify_models`: its statuses, confidence and limitations."""
    limits = F.when(F.col("access_mode") == "BLACK_BOX", F.array(F.lit("BLACK_BOX"))).otherwise(F.array().cast("array<string>"))
    return verified.withColumns({"confidence": F.when(F.col("binary_identity") == "MATCH", 1.0).otherwise(0.95), "limitations": limits})
