"""Distribution-shift statistics over line items before and from 1998 on."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import drift as D
from attesta.plans import fixtures as fx
from attesta.plans.registry import query, table

_F = fx.FEATURES_SQL
_KS = f"""{_F}, c AS (SELECT feature, value, count(*) FILTER (base) AS b, count(*) FILTER (NOT base) AS t FROM feats GROUP BY ALL),
r AS (SELECT feature, sum(b) OVER w / sum(b) OVER (PARTITION BY feature) AS fb, sum(t) OVER w / sum(t) OVER (PARTITION BY feature) AS ft, sum(b) OVER (PARTITION BY feature) AS n, sum(t) OVER (PARTITION BY feature) AS m FROM c WINDOW w AS (PARTITION BY feature ORDER BY value)),
ks AS (SELECT feature, max(abs(fb - ft)) AS ks, max(n) AS n, max(m) AS m FROM r GROUP BY feature)"""
_P = """lam AS (SELECT feature, ks, n, m, (sqrt(n * m / (n + m)) + 0.12 + 0.11 / sqrt(n * m / (n + m))) * ks AS l FROM ks),
pv AS (SELECT feature, CASE WHEN ks <= 0 THEN 1 WHEN l >= 4 THEN 0 ELSE greatest(0, least(1, list_sum(list_transform(range(1, 101), lambda j: 2 * (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * j * j * l * l))))) END AS p FROM lam)"""
_PSI = """ends AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM feats GROUP BY feature),
bins AS (SELECT feature, least(floor((value - lo) / (hi - lo) * 10), 9) AS bin, count(*) FILTER (base) AS b, count(*) FILTER (NOT base) AS t FROM feats JOIN ends USING (feature) GROUP BY ALL),
allb AS (SELECT e.feature, k AS bin, coalesce(b, 0) AS b, coalesce(t, 0) AS t FROM ends e CROSS JOIN range(10) r(k) LEFT JOIN bins x ON x.feature = e.feature AND x.bin = k),
sh AS (SELECT feature, (b + 1e-4) / (sum(b) OVER (PARTITION BY feature) + 1e-3) AS pb, (t + 1e-4) / (sum(t) OVER (PARTITION BY feature) + 1e-3) AS pt FROM allb),
psi AS (SELECT feature, sum((pt - pb) * ln(pt / pb)) AS psi FROM sh GROUP BY feature)"""
_W1 = "w1q AS (SELECT feature, quantile_cont(value, {q}) FILTER (base) AS qb, quantile_cont(value, {q}) FILTER (NOT base) AS qt FROM feats GROUP BY feature), w1 AS (SELECT feature, list_avg(list_transform(range(1, 101), lambda i: abs(qb[i] - qt[i]))) AS w1 FROM w1q)".format(q=[0.01 + (0.99 - 0.01) * k / 99 for k in range(100)])
_EN = "enq AS (SELECT feature, quantile_cont(value, {q}) FILTER (base) AS qb, quantile_cont(value, {q}) FILTER (NOT base) AS qt FROM feats GROUP BY feature), sp AS (SELECT feature, list_sum(list_transform(qb, lambda a: list_sum(list_transform(qt, lambda b: abs(a - b))))) / 40000 AS bt, list_sum(list_transform(qb, lambda a: list_sum(list_transform(qb, lambda b: abs(a - b))))) / 40000 AS bb, list_sum(list_transform(qt, lambda a: list_sum(list_transform(qt, lambda b: abs(a - b))))) / 40000 AS tt FROM enq), en AS (SELECT feature, greatest(0, 2 * bt - bb - tt) AS energy FROM sp)".format(q=[0.005 + (0.995 - 0.005) * k / 199 for k in range(200)])
_REPORT = f"{_KS}, {_P}, {_PSI}, {_W1}, {_EN}, rep AS (SELECT feature, round(ks, 4)::DOUBLE AS ks, round(p, 4)::DOUBLE AS p_value, round(psi, 4) AS psi, round(w1, 4) AS w1, round(energy, 4) AS energy FROM ks JOIN pv USING (feature) JOIN psi USING (feature) JOIN w1 USING (feature) JOIN en USING (feature))"


@query("x01_ks_distance", f"WITH {_KS} SELECT feature, round(ks, 6) AS ks, n::BIGINT AS n, m::BIGINT AS m FROM ks")
def x01(s, d):
    return D.ks_distance(fx.features(s, d)).withColumn("ks", F.round("ks", 6))


@query("x02_ks_p_value", f"WITH {_KS}, {_P} SELECT feature, round(p, 6)::DOUBLE AS p_value FROM pv")
def x02(s, d):
    return D.ks_distance(fx.features(s, d)).select("feature", F.round(D.ks_p_value(F.col("ks"), F.col("n"), F.col("m")), 6).alias("p_value"))


@query("x03_psi", f"WITH {_F}, {_PSI} SELECT feature, round(psi, 6) AS psi FROM psi")
def x03(s, d):
    return D.psi(fx.features(s, d)).withColumn("psi", F.round("psi", 6))


@query("x04_wasserstein", f"WITH {_F}, {_W1} SELECT feature, round(w1, 5) AS w1 FROM w1")
def x04(s, d):
    return D.wasserstein(fx.features(s, d)).withColumn("w1", F.round("w1", 5))


@query("x05_energy", f"WITH {_F}, {_EN} SELECT feature, round(energy, 5) AS energy FROM en")
def x05(s, d):
    return D.energy_distance(fx.features(s, d)).withColumn("energy", F.round("energy", 5))


@query("x06_shift_report", f"WITH {_REPORT} SELECT *, ks > 0.25 OR psi > 0.25 AS drifted, CASE WHEN psi > 0.5 OR ks > 0.6 THEN 'CRITICAL' WHEN psi > 0.25 OR ks > 0.25 THEN 'HIGH' END AS severity FROM rep")
def x06(s, d):
    return D.shift_report(fx.features(s, d))


_NAMED = "CASE event_type WHEN 'signup' THEN 'brightness' WHEN 'error' THEN 'sharpness' WHEN 'click' THEN 'channel_entropy' WHEN 'view' THEN 'contrast' ELSE 'saturation' END"


@query(
    "x07_shift_class",
    f"""WITH r AS (SELECT user_id, {_NAMED} AS feature, round(avg(least(value / 100, 1)), 6) AS ks FROM events GROUP BY ALL),
g AS (SELECT user_id, round(avg(ks), 6) AS overall, coalesce(list_sort(list(feature) FILTER (ks > 0.6)), []) AS drifted FROM r GROUP BY user_id)
SELECT user_id, overall, CASE WHEN overall <= 0.25 AND len(drifted) = 0 THEN 'NO_DRIFT'
 WHEN list_contains(drifted, 'sharpness') AND NOT list_has_any(drifted, ['brightness', 'contrast', 'channel_entropy']) THEN 'SENSOR_DEGRADATION'
 WHEN list_has_any(drifted, ['brightness', 'color_temperature', 'contrast']) AND NOT list_contains(drifted, 'channel_entropy') AND overall < 0.6 THEN 'OPERATIONAL_ENVIRONMENTAL'
 WHEN list_contains(drifted, 'channel_entropy') OR overall >= 0.6 THEN 'ADVERSARIAL_ANOMALY' ELSE 'DATASET_DRIFT' END AS shift,
 CASE shift WHEN 'NO_DRIFT' THEN 'NO_DRIFT' WHEN 'SENSOR_DEGRADATION' THEN 'MILD_DRIFT' WHEN 'OPERATIONAL_ENVIRONMENTAL' THEN 'MILD_DRIFT' WHEN 'ADVERSARIAL_ANOMALY' THEN 'CRITICAL_SHIFT' ELSE 'SIGNIFICANT_DRIFT' END AS severity,
 CASE shift WHEN 'NO_DRIFT' THEN 'ACCEPTED' WHEN 'ADVERSARIAL_ANOMALY' THEN 'QUARANTINED' ELSE 'UNDER_REVIEW' END AS status FROM g""",
)
def x07(s, d):
    name = F.when(F.col("event_type") == "signup", "brightness").when(F.col("event_type") == "error", "sharpness").when(F.col("event_type") == "click", "channel_entropy").when(F.col("event_type") == "view", "contrast").otherwise("saturation")
    r = table(s, d, "events").groupBy("user_id", name.alias("feature")).agg(F.round(F.avg(F.least(F.col("value") / 100, F.lit(1.0))), 6).alias("ks")).withColumn("drifted", F.col("ks") > 0.6)
    return D.classify_shift(r, ["user_id"], digits=6).select("user_id", "overall", "shift", "severity", "status")


@query(
    "x08_baseline_digest",
    """WITH v AS (SELECT event_type AS feature, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos FROM events),
c AS (SELECT feature, pos // 4096 AS chunk, sha256(string_agg(printf('%.4f', value), ',' ORDER BY pos)) AS h FROM v GROUP BY ALL)
SELECT feature, sha256(string_agg(h, '' ORDER BY chunk)) AS digest FROM c GROUP BY feature""",
)
def x08(s, d):
    rows = table(s, d, "events").select(F.col("event_type").alias("feature"), "event_id", "value")
    return D.baseline_digest(rows, ["event_id"])


_X08 = """v AS (SELECT event_type AS feature, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos FROM events),
c AS (SELECT feature, pos // 4096 AS chunk, sha256(string_agg(printf('%.4f', value), ',' ORDER BY pos)) AS h FROM v GROUP BY ALL), dg AS (SELECT feature, sha256(string_agg(h, '' ORDER BY chunk)) AS digest FROM c GROUP BY feature)"""


@query("x08_baseline_audit", f"WITH {_X08} SELECT feature, CASE WHEN feature = 'click' THEN sha256('x') ELSE digest END AS expected, feature <> 'click' AS valid FROM dg WHERE feature <> 'view' UNION ALL SELECT 'view', NULL, false")
def x08_audit(s, d):
    """The stored digest of one event type is another, and that of a second one is missing."""
    rows = table(s, d, "events").select(F.col("event_type").alias("feature"), "event_id", "value")
    known = D.baseline_digest(rows, ["event_id"]).where("feature <> 'view'").withColumn("digest", F.when(F.col("feature") == "click", F.sha2(F.lit("x"), 256)).otherwise(F.col("digest")))
    return D.baseline_audit(rows, ["event_id"], known).select("feature", "expected", "valid")


@query("x09_summary_baseline", f"WITH {_F} SELECT feature, round(avg(value), 4) AS value FROM feats CROSS JOIN range(5) r(k) GROUP BY feature, k")
def x09(s, d):
    return D.baseline_from_summaries(D.summaries(fx.features(s, d)))


@query("a12_feature_summary", f'WITH {_F} SELECT feature, count(*) AS count, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(min(value), 4) AS min, round(max(value), 4) AS max, round(median(value), 4) AS median FROM feats GROUP BY feature')
def a12(s, d):
    return D.summaries(fx.features(s, d))


@query("j08_common_features", f"WITH {_F} SELECT feature, count(*) AS n FROM feats WHERE feature IN (SELECT feature FROM feats WHERE base INTERSECT SELECT feature FROM feats WHERE NOT base) GROUP BY feature")
def j08(s, d):
    return D.common_features(fx.features(s, d)).groupBy("feature").agg(F.count("*").alias("n"))
