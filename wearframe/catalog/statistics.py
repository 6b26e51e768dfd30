"""Queries over rate estimates: group spread, held-out tests, traits, transfer, trust."""

import re

from pyspark.sql import functions as F

from wearframe.catalog.shared import INTERFERENCE, LAPS, r6, rounded_all, sql
from wearframe.functions.gaussian import cdf_sql
from wearframe.operators import rates, slices
from wearframe.operators import stats as st
from wearframe.operators.staging import stage
from wearframe.sources import adapters as ad

_STEP = {"click": 0, "purchase": 1, "signup": 2, "view": 3}


def estimates(spark, d):
    """Run slopes averaged per (event, mode), an event being a session's week; circuits repeat."""
    laps = ad.laps_from_events(spark, d)
    slopes = rates.run_slopes(laps, ("session_id", "week", "run_id", "mode"))
    step = F.create_map(*[F.lit(v) for kv in _STEP.items() for v in kv])[F.col("mode")]
    est = slopes.groupBy("session_id", "week", "mode").agg(F.avg("slope").alias("rate"), F.sum("n_laps").alias("n_laps"))
    return stage(est.select(
        (F.col("session_id") * 10 + F.col("week")).alias("event"), F.col("mode").alias("label"), "rate", "n_laps",
        F.concat(F.lit("C"), (F.col("session_id") % 3 + step).cast("string")).alias("mode_id"),
        (F.col("session_id") % 5).alias("circuit"), (F.col("session_id") * 7 % 11).cast("double").alias("corners"),
        (F.col("week") * 1.5).cast("double").alias("temperature"),
    ))


EST = LAPS + """,
rs AS (SELECT session_id, week, run_id, mode, regr_slope(perf, age) AS slope, count(*) AS n FROM laps GROUP BY ALL
       HAVING count(*) >= 3 AND max(age) > min(age)),
es AS (SELECT session_id, week, mode, avg(slope) AS rate, CAST(sum(n) AS BIGINT) AS n_laps FROM rs GROUP BY ALL),
est AS (SELECT session_id * 10 + week AS event, mode AS label, rate, n_laps,
          'C' || (session_id % 3 + CASE mode WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 END) AS mode_id,
          session_id % 5 AS circuit, CAST(session_id * 7 % 11 AS DOUBLE) AS corners, CAST(week * 1.5 AS DOUBLE) AS temperature FROM es)
"""

_WX = """
wd_{k} AS (SELECT round({a} - {b}, 12) AS d FROM {t} WHERE round({a} - {b}, 12) <> 0),
wr_{k} AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY abs(d)) AS t FROM wd_{k}),
ws_{k} AS (SELECT CAST(count(*) AS DOUBLE) AS n, least(coalesce(sum(r) FILTER (WHERE d > 0), 0), coalesce(sum(r) FILTER (WHERE d < 0), 0)) AS s,
           sum(t * t - 1.0) AS ties FROM wr_{k}),
wz_{k} AS (SELECT n, s, (s - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM ws_{k}),
wp_{k} AS (SELECT n, s, z, 2 * {cdf} AS p FROM wz_{k})
"""


def _wx(k, a, b, t):
    return _WX.format(k=k, a=a, b=b, t=t, cdf=cdf_sql("(-abs(z))"))


def variance_decomposition(spark, d):
    return rounded_all(st.variance_decomposition(estimates(spark, d)))


def loo_mean(spark, d):
    out = st.loo_mean(estimates(spark, d), ["event"], ["label"], "rate")
    return rounded_all(out.select("event", "label", "loo_mean"))


def loeo_modes(spark, d):
    return rounded_all(st.loeo_modes(estimates(spark, d)).select("event", "label", "pred_label", "pred_mode", "err_label", "err_mode"))


def loeo_modes_summary(spark, d):
    return rounded_all(st.loeo_modes_summary(stage(st.loeo_modes(estimates(spark, d)))))


LOEO = EST + """,
kn AS (SELECT * FROM est WHERE mode_id IS NOT NULL),
lm AS (SELECT a.event, a.label, a.rate, (SELECT avg(b.rate) FROM kn b WHERE b.label = a.label AND b.event <> a.event) AS pl,
         (SELECT avg(b.rate) FROM kn b WHERE b.mode_id = a.mode_id AND b.event <> a.event) AS pm FROM kn a),
lc AS (SELECT event, label, pl, pm, abs(pl - rate) AS el, abs(pm - rate) AS em FROM lm WHERE pl IS NOT NULL AND pm IS NOT NULL)
"""


def signed_rank(spark, d):
    li = ad.table(spark, d, "lineitem").select("l_returnflag", F.round(F.col("l_discount") * 100).alias("a"), F.round(F.col("l_tax") * 100 + 1).alias("b"))
    return rounded_all(st.wilcoxon(li, "a", "b"))


def paired_t(spark, d):
    li = ad.table(spark, d, "lineitem")
    return rounded_all(st.paired_t(li, "l_discount", "l_tax", ["l_returnflag"]))


def bias_screen(spark, d):
    est = estimates(spark, d).withColumn("abs_rate", F.abs("rate"))
    return rounded_all(st.bias_screen(est, "abs_rate", ["corners", "temperature", "n_laps", "circuit", "rate"]))


def leave_one_circuit_out(spark, d):
    est = estimates(spark, d)
    out = st.loco(est, ["corners", "temperature"])
    return rounded_all(out.select("event", "label", "circuit", "predicted"))


FAMILIES = {"shape": ["corners"], "heat": ["temperature"], "everything": ["corners", "temperature"]}


def family_predictions(spark, d):
    return rounded_all(st.family_predictions(estimates(spark, d), FAMILIES).select("event", "label", "circuit", "family", "predicted"))


def circuit_ablation(spark, d):
    est = estimates(spark, d)
    est = st.loo_mean(st.loo_mean(est, ["circuit"], ["label"], "rate", "label_mean"), ["circuit"], [], "rate", "global_mean")
    est = stage(est.withColumn("label_mean", F.coalesce("label_mean", "global_mean")))
    return rounded_all(st.ablation(stage(st.family_predictions(est, FAMILIES))))


def loco_scores(spark, d):
    est = st.loo_mean(st.loo_mean(estimates(spark, d), ["circuit"], ["label"], "rate", "label_mean"), ["circuit"], [], "rate", "global_mean")
    est = est.withColumn("label_mean", F.coalesce("label_mean", "global_mean"))
    both = st.loco(est, ["corners", "temperature"]).withColumnRenamed("predicted", "label_plus_circuit")
    both = st.loco(both.where("mode_id IS NOT NULL"), ["corners", "temperature"], "mode_id").withColumnRenamed("predicted", "mode_plus_circuit")
    return rounded_all(st.loco_scores(stage(both), ["global_mean", "label_mean", "label_plus_circuit", "mode_plus_circuit"]))


def deviations(spark, d):
    laps = ad.laps_from_events(spark, d)
    # a session here is a week of one group of assets
    slopes = rates.run_slopes(laps.withColumn("perf", F.col("perf") + 0.081 * F.col("elapsed")), ("session_id", "week", "asset", "run_id", "mode"), min_laps=8, min_span=3.0)
    per = slices.exact_median(slopes.withColumn("race", F.col("week")), ["race", "asset", "mode"], "slope", "slope")
    dev = st.asset_deviations(per.withColumnRenamed("race", "session_id"))
    return stage(dev.withColumn("team", F.expr("asset div 2")))


DEV = LAPS + """,
fs AS (SELECT week AS session_id, asset, mode, run_id, regr_slope(perf + 0.081 * elapsed, age) AS slope FROM laps GROUP BY ALL
       HAVING count(*) >= 8 AND max(age) - min(age) >= 3),
pm AS (SELECT session_id, asset, mode, median(slope) AS slope FROM fs GROUP BY ALL),
dev AS (SELECT * FROM (SELECT *, slope - avg(slope) OVER w AS deviation, count(*) OVER w AS group_size, asset // 2 AS team
        FROM pm WINDOW w AS (PARTITION BY session_id, mode)) WHERE group_size >= 3)
"""


def asset_deviations(spark, d):
    return rounded_all(deviations(spark, d))


def teammate_gaps(spark, d):
    return rounded_all(st.teammate_gaps(deviations(spark, d)))


def top_gaps(spark, d):
    return rounded_all(st.top_gaps(st.teammate_gaps(deviations(spark, d))))


def split_half(spark, d):
    return rounded_all(st.split_half(deviations(spark, d)))


def split_half_pairs(spark, d):
    """Reliability of the gaps between teammates."""
    gaps = st.teammate_gaps(deviations(spark, d))
    return rounded_all(st.split_half(gaps, key="pair", value="gap", min_shared=3))


def split_half_summary(spark, d):
    return rounded_all(st.reliability_summary(stage(st.split_half(deviations(spark, d)))))


def loso_history(spark, d):
    out = st.loso_history(deviations(spark, d))
    return rounded_all(out.select("session_id", "asset", "mode", "predicted", "history_error", "null_error"))


def history_summary(spark, d):
    return rounded_all(st.history_summary(stage(st.loso_history(deviations(spark, d)))))


def trait_summary(spark, d):
    return rounded_all(st.trait_summary(deviations(spark, d), min_sessions=3))


def _sides_of(laps):
    """Laps of both sides of the comparison."""
    return laps.where(_PRACTICE), laps.where(_RACE)


def _sides(spark, d):
    laps = ad.laps_from_events(spark, d)
    practice, race = _sides_of(laps)
    line = lambda side: rates.ols_by_mode(side).select(
        F.col("session_id").alias("event"), "mode", F.col("slope").alias("rate"), F.col("slope_se").alias("rate_sd"), F.col("n").alias("n_laps"))
    naive = rates.naive_rates(laps.where("week < 1")).select(F.col("session_id").alias("event"), "mode", F.col("rate").alias("naive"))
    return line(practice).join(naive, ["event", "mode"], "left"), line(race)


def compared(spark, d):
    return st.compare_rates(*_sides(spark, d), min_laps=30)


_OLS = """SELECT session_id AS event, mode, count(*) AS n, CASE WHEN count(*) >= 3 AND regr_sxx(perf, age) > 0 THEN regr_slope(perf, age) ELSE 0 END AS rate,
  CASE WHEN count(*) >= 3 AND regr_sxx(perf, age) > 0 THEN sqrt(greatest(regr_syy(perf, age) - regr_sxy(perf, age) ** 2 / regr_sxx(perf, age), 0) / greatest(count(*) - 2, 1) / regr_sxx(perf, age)) END AS sd
  FROM laps WHERE {w} GROUP BY ALL"""
_PRACTICE = "week < 1 AND NOT (session_id = 3 AND mode = 'view')"
_RACE = "week >= 1 AND NOT (session_id = 4 AND mode = 'click')"
_INSIDE = " AND age <= (SELECT depth FROM ct WHERE ct.event = laps.session_id AND ct.mode = laps.mode)"
CMP = LAPS + f""",
pr AS ({_OLS.format(w=_PRACTICE)}),
ra AS ({_OLS.format(w=_RACE)}),
nv AS (SELECT event, mode, avg(s) AS naive FROM (SELECT session_id AS event, run_id, mode, regr_slope(perf, age) AS s FROM laps WHERE week < 1
       GROUP BY ALL HAVING count(*) >= 3 AND max(age) > min(age)) GROUP BY ALL),
cmp AS (SELECT coalesce(pr.event, ra.event) AS event, coalesce(pr.mode, ra.mode) AS mode, pr.rate AS predicted, pr.sd AS predicted_sd,
          pr.n AS practice_laps, CASE WHEN pr.rate IS NOT NULL THEN naive END AS naive_predicted, ra.rate AS actual, ra.sd AS actual_sd, ra.n AS race_laps,
          CASE WHEN pr.rate IS NULL THEN 'absent in practice' WHEN ra.rate IS NULL THEN 'absent in race'
               WHEN pr.n < 30 OR ra.n < 30 THEN 'too few laps' END AS skipped
        FROM pr FULL JOIN ra ON pr.event = ra.event AND pr.mode = ra.mode LEFT JOIN nv ON nv.event = pr.event AND nv.mode = pr.mode),
cm AS (SELECT *, predicted - actual AS error, naive_predicted - actual AS naive_error,
         abs(predicted - actual) <= 1.96 * sqrt(predicted_sd ** 2 + actual_sd ** 2) AS covered FROM cmp)
"""
_TR = """count(*) AS n_comparisons, round(avg(abs(error)), 6) AS mae, round(avg(abs(naive_error)), 6) AS naive_mae,
 round(avg(error), 6) AS bias, round(avg(CASE WHEN covered THEN 1.0 WHEN NOT covered THEN 0.0 END), 6) AS coverage"""


def compare_rates(spark, d):
    return rounded_all(compared(spark, d))


def validation_report(spark, d):
    return rounded_all(st.validation_report(compared(spark, d)))


def transfer_overall(spark, d):
    return rounded_all(st.transfer_overall(compared(spark, d)))


def event_validation(spark, d):
    """Transfer report looked up by names asked in another case or only in part."""
    from wearframe.plans.reports import event_validation as look_up

    named = compared(spark, d).withColumn("year", F.col("event") % 3).withColumn("event", F.concat(F.lit("Grand Prix "), F.col("event").cast("string")))
    asked = ad.table(spark, d, "nation").select(
        (F.col("n_nationkey") % 3).cast("long").alias("year"), F.concat(F.lit("PRIX "), F.col("n_nationkey").cast("string")).alias("asked"))
    return rounded_all(look_up(named, asked))


def depth_summary(spark, d):
    return rounded_all(st.depth_summary(stage(st.depth_matched(*_sides_of(stage(ad.laps_from_events(spark, d))), min_laps=30))))


def bias_table(spark, d):
    laps = stage(ad.laps_from_events(spark, d, interference=True))
    prof = lambda part: rates.stint_profile(laps.where(part)).withColumnRenamed("session_id", "event")
    cond = laps.groupBy(F.col("session_id").alias("event"), F.when(F.col("week") < 1, "FP2").otherwise("R").alias("session")).agg(F.avg("perf").alias("track_temp"))
    return rounded_all(st.bias_table(compared(spark, d), prof("week < 1"), prof("week >= 1"), cond))


def consensus(spark, d):
    laps = ad.laps_from_events(spark, d)
    one = rates.ols_by_mode(laps).select("session_id", "mode", F.lit("raw").alias("model"), F.col("slope").alias("rate"), F.col("slope_se").alias("rate_sd"))
    two = rates.ols_corrected(laps).select("session_id", "mode", F.lit("corrected").alias("model"), F.col("slope").alias("rate"), F.col("slope_se").alias("rate_sd"))
    return rounded_all(st.consensus(one.unionByName(two), ("session_id", "mode")))


def applicability(spark, d):
    laps = stage(ad.laps_from_events(spark, d, interference=True))
    asked = laps.select(
        "session_id", "event_id", "mode",
        (F.col("age") * 2).alias("age"), (F.col("interference") * 1.2).alias("interference"))
    out = st.applicability(laps.where("week < 1"), asked)
    return rounded_all(out.select("event_id", "coverage", "laps_beyond", "age_score", "interference_score", "applicability", "risk",
                                  F.concat_ws("; ", "reasons").alias("reasons")))


#: Measurements asked about: name, share of the uncertainty it would remove, what it would settle.
ASKED = (("track heat probe", 0.35, "heat against wear"), ("fuel scale", 0.30, "load at every lap"), ("depth gauge", 0.20, "wear itself"), ("inflation log", 0.12, "scatter within a run"))


def value_of_information(spark, d):
    fit = rates.ols_by_mode(ad.laps_from_events(spark, d)).withColumnRenamed("slope_se", "rate_sd")
    return rounded_all(st.value_of_information(fit, ASKED))


QUERIES = {f.__name__: f for f in (
    variance_decomposition, loo_mean, loeo_modes, loeo_modes_summary, signed_rank, paired_t, bias_screen, leave_one_circuit_out, family_predictions, circuit_ablation, loco_scores,
    asset_deviations, teammate_gaps, top_gaps, split_half, split_half_pairs, split_half_summary, loso_history, history_summary, trait_summary,
    compare_rates, validation_report, event_validation, transfer_overall, depth_summary, bias_table, consensus, applicability, value_of_information)}

_T = lambda t, nu: f"(2 * {cdf_sql(f'(-((8 * {nu} + 1) / (8 * {nu} + 3)) * sqrt({nu} * ln(1 + {t} * {t} / {nu})))')})"
SPLITS = DEV + """,
ss AS (SELECT k AS split, session_id, substr(md5(k || '-' || session_id), 1, 1) < '8' AS l FROM (SELECT DISTINCT session_id FROM dev), (SELECT unnest(range(0, 500)) AS k)),
hv AS (SELECT split, asset, avg(deviation) FILTER (WHERE l) AS a, avg(deviation) FILTER (WHERE NOT l) AS b FROM dev JOIN ss USING (session_id) GROUP BY ALL),
sp AS (SELECT CAST(split AS INTEGER) AS split, count(*) AS n_shared, corr(a, b) AS r FROM hv WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL HAVING count(*) >= 8)
"""
GAPS = DEV + """,
tm AS (SELECT session_id, team, asset, avg(deviation) AS d FROM dev GROUP BY ALL),
gaps AS (SELECT session_id, team, min(asset) AS first, max(asset) AS second, arg_min(d, asset) - arg_max(d, asset) AS gap,
           min(asset) || '-' || max(asset) AS pair FROM tm GROUP BY ALL HAVING count(*) = 2)
"""
HIST = DEV + """,
hi AS (SELECT session_id, asset, mode, deviation, (SELECT avg(b.deviation) FROM dev b WHERE b.asset = a.asset AND b.session_id <> a.session_id) AS predicted FROM dev a),
hc AS (SELECT *, abs(predicted - deviation) AS history_error, abs(deviation) AS null_error FROM hi WHERE predicted IS NOT NULL)
"""
_preds = ("corners", "temperature", "n_laps", "circuit", "rate")
SCREEN = EST + ", lg AS (" + " UNION ALL ".join(
    f"SELECT '{p}' AS predictor, CAST({p} AS DOUBLE) AS x, abs(rate) AS y FROM est" for p in _preds) + """),
rk AS (SELECT predictor, rank() OVER (PARTITION BY predictor ORDER BY x) + (count(*) OVER (PARTITION BY predictor, x) - 1) / 2.0 AS rx,
         rank() OVER (PARTITION BY predictor ORDER BY y) + (count(*) OVER (PARTITION BY predictor, y) - 1) / 2.0 AS ry FROM lg),
rh AS (SELECT predictor, count(*) AS n, corr(rx, ry) AS rho FROM rk GROUP BY ALL),
rt AS (SELECT predictor, n, rho, abs(rho) * sqrt((n - 2) / greatest(1 - rho * rho, CAST(1e-300 AS DOUBLE))) AS t, CAST(n - 2 AS DOUBLE) AS nu FROM rh),
rp AS (SELECT predictor, n, rho, """ + _T("t", "nu") + """ AS p FROM rt),
rb AS (SELECT *, 0.05 * row_number() OVER (ORDER BY p, predictor) / count(*) OVER () AS bh, row_number() OVER (ORDER BY p, predictor) AS r FROM rp)
"""
_shape = ("n_stints", "mean_length", "max_length", "total_laps", "mean_interference", "stints_per_asset")

# uncentred design with a free intercept; a penalty of five variances is what a penalty of five is on standardised columns
FAMILY = EST + """,
fm AS (SELECT * FROM (VALUES ('shape', [1]), ('heat', [2]), ('everything', [1, 2])) v(family, chosen)),
ft AS (SELECT c.circuit AS held, family, chosen, e.* FROM (SELECT DISTINCT circuit FROM est) c, fm, est e WHERE e.circuit <> c.circuit),
fl AS (SELECT held, family, any_value(chosen) AS chosen, list(DISTINCT label ORDER BY label) AS labels, CAST(count(*) AS DOUBLE) AS n FROM ft GROUP BY ALL),
fx AS (SELECT held, family, rate AS y, list_concat([1.0::DOUBLE], list_transform(labels, lambda q: CASE WHEN q = label THEN 1.0::DOUBLE ELSE 0.0 END), list_transform(fl.chosen, lambda q: [corners, temperature][q])) AS x
       FROM ft JOIN fl USING (held, family)),
fu AS (SELECT held, family, y, x, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS k FROM fx),
fg AS (SELECT held, family, k, list(g ORDER BY j) AS row FROM (SELECT held, family, k, j, sum(v * w) AS g FROM (SELECT held, family, k, v, unnest(x) AS w, unnest(range(1, len(x) + 1)) AS j FROM fu) GROUP BY ALL) GROUP BY ALL),
fk AS (SELECT held, family, k, sum(v * y) AS m, sum(v) AS s FROM fu GROUP BY ALL),
fa AS (SELECT held, family, len(list(k)) AS p,
         list(list_concat(list_transform(row, lambda g, j: g + CASE WHEN j = k AND k > 1 THEN 5.0 * CASE WHEN row[k] / n - (s / n) ** 2 < 1e-20 THEN 1.0 ELSE row[k] / n - (s / n) ** 2 END ELSE 0.0 END), [m]) ORDER BY k) AS a
       FROM fg JOIN fk USING (held, family, k) JOIN fl USING (held, family) GROUP BY ALL),
fe AS (WITH RECURSIVE e AS (
         SELECT held, family, p, 1 AS s, a FROM fa
         UNION ALL
         SELECT held, family, p, s + 1, list_transform(a, lambda r, q: CASE WHEN q = s THEN list_transform(r, lambda v: v / a[s][s]) ELSE list_transform(r, lambda v, j: v - r[s] * a[s][j] / a[s][s]) END) FROM e WHERE s <= p)
       SELECT held, family, list_transform(a, lambda r: r[p + 1]) AS beta FROM e WHERE s = p + 1),
fp AS (SELECT event, label, circuit, fe.family, rate, beta[1] + coalesce(beta[1 + list_position(labels, label)], 0.0)
         + list_sum(list_transform(chosen, lambda q, i: [corners, temperature][q] * beta[1 + len(labels) + i])) AS predicted
       FROM est JOIN fe ON held = circuit JOIN fl ON fl.held = fe.held AND fl.family = fe.family),
fb AS (SELECT fp.*, abs(predicted - rate) AS e, abs(coalesce((SELECT avg(b.rate) FROM est b WHERE b.label = fp.label AND b.circuit <> fp.circuit),
         (SELECT avg(b.rate) FROM est b WHERE b.circuit <> fp.circuit)) - rate) AS b FROM fp)
"""

# the same fits on the nominal mode instead of the label
_BY_MODE = re.sub(r"\bf([mtlxugkaep])\b", r"g\1", FAMILY[len(EST):FAMILY.index(",\nfb AS")]).replace("label", "mode_id").replace("mode_ids", "labels").replace("WHERE e.circuit", "WHERE e.mode_id IS NOT NULL AND e.circuit")
LOCO = FAMILY + _BY_MODE + """,
lp AS (SELECT fp.event, fp.label, fp.rate, fp.predicted AS label_plus_circuit, gp.predicted AS mode_plus_circuit,
         (SELECT avg(b.rate) FROM est b WHERE b.circuit <> fp.circuit) AS global_mean,
         coalesce((SELECT avg(b.rate) FROM est b WHERE b.label = fp.label AND b.circuit <> fp.circuit), (SELECT avg(b.rate) FROM est b WHERE b.circuit <> fp.circuit)) AS label_mean
       FROM fp JOIN est ON est.event = fp.event AND est.label = fp.label JOIN gp ON gp.event = fp.event AND gp.mode_id = est.mode_id AND gp.family = 'everything' WHERE fp.family = 'everything')
"""
_PREDICTORS = ("global_mean", "label_mean", "label_plus_circuit", "mode_plus_circuit")

ORACLES = {
    "loco_scores": sql(LOCO + "".join(f", l_{k} AS (SELECT abs({k} - rate) AS e, abs(label_mean - rate) AS b FROM lp)," + _wx(k, "e", "b", f"l_{k}") for k in _PREDICTORS), " UNION ALL ".join(
        f"SELECT '{k}' AS predictor, round(avg(e), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(100 * (avg(b) - avg(e)) / avg(b), 6) AS vs_baseline_pct, "
        + ("NULL" if k == "label_mean" else f"round((SELECT p FROM wp_{k}), 6)") + f" AS wilcoxon_p FROM l_{k}" for k in _PREDICTORS)),
    "family_predictions": sql(FAMILY, "SELECT event, label, circuit, family, round(predicted, 6) AS predicted FROM fp"),
    "circuit_ablation": sql(FAMILY + "".join(f", f_{k} AS (SELECT e, b FROM fb WHERE family = '{k}')," + _wx(k, "e", "b", f"f_{k}") for k in FAMILIES) + """,
ab AS (SELECT family, count(*) AS n_cases, avg(e) AS mae, avg(b) AS baseline_mae FROM fb GROUP BY ALL),
ap AS (SELECT ab.*, CASE family """ + " ".join(f"WHEN '{k}' THEN (SELECT p FROM wp_{k})" for k in FAMILIES) + """ END AS p FROM ab)""", """
SELECT family, n_cases, round(mae, 6) AS mae, round(baseline_mae, 6) AS baseline_mae, round(p, 6) AS wilcoxon_p, round(100 * (baseline_mae - mae) / baseline_mae, 6) AS vs_baseline_pct,
       p < 0.05 AND mae < baseline_mae AS helps, p < 0.05 AND mae > baseline_mae AS hurts FROM ap WHERE n_cases >= 20"""),
    "leave_one_circuit_out": sql(FAMILY, "SELECT event, label, circuit, round(predicted, 6) AS predicted FROM fp WHERE family = 'everything'"),
    "variance_decomposition": sql(EST + """,
k AS (SELECT * FROM est WHERE mode_id IS NOT NULL),
a AS (SELECT count(*) AS n, var_samp(rate) AS v FROM k GROUP BY label HAVING count(*) >= 3),
b AS (SELECT count(*) AS n, var_samp(rate) AS v FROM k GROUP BY mode_id HAVING count(*) >= 3),
s AS (SELECT (SELECT sqrt(sum((n - 1) * v) / sum(n - 1)) FROM a) AS l, (SELECT sqrt(sum((n - 1) * v) / sum(n - 1)) FROM b) AS m)""", """
SELECT round((SELECT stddev_pop(rate) FROM k), 6) AS overall_sd, round(l, 6) AS within_label_sd, round(m, 6) AS within_mode_sd,
       (SELECT count(*) FROM a) AS n_label_groups, (SELECT count(*) FROM b) AS n_mode_groups, round(100 * (l - m) / l, 6) AS reduction_pct FROM s"""),
    "loo_mean": sql(EST, """
SELECT event, label, round((SELECT avg(b.rate) FROM est b WHERE b.label = a.label AND b.event <> a.event), 6) AS loo_mean FROM est a"""),
    "loeo_modes": sql(LOEO, """
SELECT event, label, round(pl, 6) AS pred_label, round(pm, 6) AS pred_mode, round(el, 6) AS err_label, round(em, 6) AS err_mode FROM lc"""),
    "loeo_modes_summary": sql(LOEO + "," + _wx("m", "em", "el", "lc"), """
SELECT count(*) AS n, round(avg(el), 6) AS mae_by_label, round(avg(em), 6) AS mae_by_mode, round(avg(em - el), 6) AS mean_paired_difference,
       round(avg(CASE WHEN em < el THEN 1.0 ELSE 0.0 END), 6) AS mode_win_rate, round((SELECT p FROM wp_m), 6) AS wilcoxon_p FROM lc"""),
    "signed_rank": "WITH ab AS (SELECT round(l_discount * 100) AS a, round(l_tax * 100 + 1) AS b FROM lineitem)," + _wx("l", "a", "b", "ab") + """
SELECT CAST(n AS BIGINT) AS n, round(s, 6) AS statistic, round(z, 6) AS z, round(p, 6) AS p_value FROM wp_l""",
    "paired_t": """
WITH g AS (SELECT l_returnflag, count(*) AS n, avg(l_discount - l_tax) AS m, stddev_samp(l_discount - l_tax) AS s FROM lineitem GROUP BY ALL),
t AS (SELECT *, m / (s / sqrt(n)) AS t, CAST(n - 1 AS DOUBLE) AS nu FROM g)
SELECT l_returnflag, n, round(m, 6) AS mean_difference, round(t, 6) AS t, round(""" + _T("t", "nu") + """, 6) AS p_value FROM t""",
    "bias_screen": sql(SCREEN, """
SELECT predictor, n, round(rho, 6) AS spearman_rho, round(p, 6) AS p_value, round(bh, 6) AS bh_threshold, p < 0.05 AS significant_raw,
       max(p <= bh) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING) AS significant FROM rb"""),
    "asset_deviations": sql(DEV, """
SELECT session_id, mode, asset, round(slope, 6) AS slope, group_size, round(deviation, 6) AS deviation, team FROM dev"""),
    "teammate_gaps": sql(GAPS, "SELECT session_id, team, first, second, round(gap, 6) AS gap, pair FROM gaps"),
    "top_gaps": sql(GAPS, """
SELECT pair, round(abs(avg(gap)), 6) AS size FROM gaps GROUP BY pair ORDER BY abs(avg(gap)) DESC, pair LIMIT 5"""),
    "split_half": sql(SPLITS, "SELECT split, n_shared, round(r, 6) AS r FROM sp"),
    "split_half_pairs": sql(GAPS + """,
ss AS (SELECT k AS split, session_id, substr(md5(k || '-' || session_id), 1, 1) < '8' AS l FROM (SELECT DISTINCT session_id FROM gaps), (SELECT unnest(range(0, 500)) AS k)),
hv AS (SELECT split, pair, avg(gap) FILTER (WHERE l) AS a, avg(gap) FILTER (WHERE NOT l) AS b FROM gaps JOIN ss USING (session_id) GROUP BY ALL)""", """
SELECT CAST(split AS INTEGER) AS split, count(*) AS n_shared, round(corr(a, b), 6) AS r FROM hv WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY split HAVING count(*) >= 3"""),
    "split_half_summary": sql(SPLITS, """
SELECT count(*) AS n_splits, round(avg(r), 6) AS mean_r, round(quantile_cont(r, 0.05), 6) AS p05, round(quantile_cont(r, 0.95), 6) AS p95,
       quantile_cont(r, 0.05) > 0 AS is_stable FROM sp WHERE r IS NOT NULL AND NOT isnan(r)"""),
    "loso_history": sql(HIST, """
SELECT session_id, asset, mode, round(predicted, 6) AS predicted, round(history_error, 6) AS history_error, round(null_error, 6) AS null_error FROM hc"""),
    "history_summary": sql(HIST + "," + _wx("h", "history_error", "null_error", "hc"), """
SELECT count(*) AS n, count(DISTINCT asset) AS n_assets, round(avg(history_error), 6) AS history_mae, round(avg(null_error), 6) AS null_mae,
       round(100 * (avg(null_error) - avg(history_error)) / avg(null_error), 6) AS improvement_pct, round((SELECT p FROM wp_h), 6) AS wilcoxon_p FROM hc"""),
    "trait_summary": sql(DEV + """,
p AS (SELECT asset, avg(deviation) AS m FROM dev GROUP BY asset HAVING count(DISTINCT session_id) >= 3)""", """
SELECT count(*) AS n_keys, round(stddev_samp(m), 6) AS trait_sd, round((SELECT stddev_samp(deviation) FROM dev), 6) AS observation_sd,
       round(stddev_samp(m) / (SELECT stddev_samp(deviation) FROM dev), 6) AS signal_to_noise FROM p"""),
    "compare_rates": sql(CMP, """
SELECT event, mode, round(predicted, 6) AS predicted, round(predicted_sd, 6) AS predicted_sd, practice_laps, round(naive_predicted, 6) AS naive_predicted,
       round(actual, 6) AS actual, round(actual_sd, 6) AS actual_sd, race_laps, skipped, round(error, 6) AS error,
       round(naive_error, 6) AS naive_error, covered FROM cm"""),
    "validation_report": sql(CMP, f"SELECT event, {_TR} FROM cm WHERE skipped IS NULL GROUP BY event"),
    "event_validation": sql(CMP + f""",
rp AS (SELECT event % 3 AS year, 'Grand Prix ' || event AS recorded, {_TR} FROM cm WHERE skipped IS NULL GROUP BY event),
ak AS (SELECT CAST(n_nationkey % 3 AS BIGINT) AS year, 'PRIX ' || n_nationkey AS asked FROM nation)""", """
SELECT year, asked, recorded, n_comparisons, mae, naive_mae, bias, coverage FROM ak JOIN rp USING (year)
WHERE contains(lower(recorded), lower(asked)) OR contains(lower(asked), lower(recorded))"""),
    "transfer_overall": sql(CMP, f"SELECT {_TR}, count(DISTINCT event) AS n_events FROM cm WHERE skipped IS NULL"),
    "depth_summary": sql(CMP + f""",
ct AS (SELECT event, mode, pd, rd, least(pd, rd) AS depth
       FROM (SELECT session_id AS event, mode, max(age) AS pd FROM laps WHERE {_PRACTICE} GROUP BY ALL)
       JOIN (SELECT session_id AS event, mode, quantile_cont(age, 0.9) AS rd FROM laps WHERE {_RACE} GROUP BY ALL) USING (event, mode) WHERE least(pd, rd) >= 4),
pi AS ({_OLS.format(w=_PRACTICE + _INSIDE)}),
ri AS ({_OLS.format(w=_RACE + _INSIDE)}),
dr AS (SELECT pr.rate - ra.rate AS be, pi.rate - ri.rate AS me, pd - rd AS g
       FROM ct JOIN pr USING (event, mode) JOIN ra USING (event, mode) JOIN pi USING (event, mode) JOIN ri USING (event, mode)
       WHERE pr.n >= 30 AND ra.n >= 30 AND pi.n >= 3 AND ri.n >= 3 AND pr.sd IS NOT NULL AND ra.sd IS NOT NULL AND pi.sd IS NOT NULL AND ri.sd IS NOT NULL),
""" + """
da AS (SELECT abs(be) AS b, abs(me) AS m FROM dr),
dt AS (SELECT avg(b - m) / (stddev_samp(b - m) / sqrt(count(*))) AS t, CAST(count(*) - 1 AS DOUBLE) AS nu FROM da),
""" + _wx("d", "b", "m", "da"), """
SELECT count(*) AS n_comparisons, round(avg(be), 6) AS baseline_bias, round(avg(me), 6) AS matched_bias, round(avg(abs(be)), 6) AS baseline_mae,
       round(avg(abs(me)), 6) AS matched_mae, round(avg(g), 6) AS mean_depth_gap,
       round(100 * (abs(avg(be)) - abs(avg(me))) / abs(avg(be)), 6) AS bias_reduction_pct,
       round(100 * (avg(abs(me)) - avg(abs(be))) / avg(abs(be)), 6) AS mae_change_pct,
       round((SELECT t FROM dt), 6) AS paired_t, round((SELECT """ + _T("t", "nu") + """ FROM dt), 6) AS paired_p,
       round((SELECT p FROM wp_d), 6) AS wilcoxon_p FROM dr"""),
    "bias_table": sql(CMP + INTERFERENCE + """,
pf AS (SELECT event, mode, p, count(*) AS n_stints, avg(n) AS mean_length, max(n) AS max_length, sum(n) AS total_laps, avg(i) AS mean_interference,
         count(*) / count(DISTINCT asset) AS stints_per_asset
       FROM (SELECT session_id AS event, mode, week < 1 AS p, asset, run_id, count(*) AS n, avg(interference) AS i FROM ilaps GROUP BY ALL HAVING count(*) >= 4) GROUP BY ALL),
cd AS (SELECT session_id AS event, avg(perf) FILTER (WHERE week >= 1) - avg(perf) FILTER (WHERE week < 1) AS dt FROM laps GROUP BY ALL)""",
        "SELECT cm.event, cm.mode, round(error, 6) AS error, round(abs(error), 6) AS abs_error, " + ", ".join(
            (f"r.{c} - p.{c} AS d_{c}" if c in ("n_stints", "max_length") else f"CAST(r.{c} - p.{c} AS BIGINT) AS d_{c}" if c == "total_laps"
             else f"round(r.{c} - p.{c}, 6) AS d_{c}") for c in _shape) + """, round(dt, 6) AS d_track_temp
FROM cm JOIN pf p ON p.event = cm.event AND p.mode = cm.mode AND p.p JOIN pf r ON r.event = cm.event AND r.mode = cm.mode AND NOT r.p
LEFT JOIN cd ON cd.event = cm.event WHERE skipped IS NULL"""),
    "consensus": sql(LAPS + f""",
mo AS (SELECT event AS session_id, mode, 'raw' AS model, rate, sd FROM ({_OLS.format(w="true")}) UNION ALL
       SELECT event, mode, 'corrected', rate, sd FROM ({_OLS.format(w="true").replace("(perf, age)", "(perf + 0.081 * elapsed, age)")})),
cs AS (SELECT session_id, mode, count(*) AS n_models, sum(rate / sd ** 2) / sum(1 / sd ** 2) AS c, sqrt(1 / sum(1 / sd ** 2)) AS cs,
         max(rate) - min(rate) AS sp, exp(-(max(rate) - min(rate)) / (2 * median(sd))) AS ag, arg_max(model, rate) AS highest, arg_min(model, rate) AS lowest
       FROM (SELECT * REPLACE (greatest(sd, 1e-6) AS sd) FROM mo) GROUP BY ALL)""", """
SELECT session_id, mode, n_models, round(c, 6) AS consensus, round(cs, 6) AS consensus_sd, round(sp, 6) AS spread, highest, lowest,
       round(ag, 6) AS agreement, ag < 0.5 AS is_flagged FROM cs"""),
    "applicability": sql(LAPS + INTERFERENCE + """,
ob AS (SELECT * FROM ilaps WHERE week < 1),
pm AS (SELECT session_id, mode, count(*) AS n, count(DISTINCT run_id) AS runs, max(age) AS ma FROM ob GROUP BY ALL),
ti AS (SELECT session_id, max(interference) AS mi FROM ob GROUP BY ALL),
qs AS (SELECT session_id, event_id, mode, age * 2 AS age, interference * 1.2 AS i FROM ilaps),
sc AS (SELECT event_id, coalesce(n, 0) AS n, coalesce(runs, 0) AS runs, least(coalesce(n, 0) / 40, 1) * least(coalesce(runs, 0) / 3, 1) AS cov,
         greatest(age - coalesce(ma, 0), 0) AS over, CASE WHEN i <= mi + 0.05 THEN 1.0 ELSE 0.6 END AS tr
       FROM qs LEFT JOIN pm USING (session_id, mode) LEFT JOIN ti USING (session_id)),
ap AS (SELECT *, exp(-over / 6) AS ag, pow(cov * exp(-over / 6) * tr, CAST(1 AS DOUBLE) / 3) AS ap FROM sc)""", """
SELECT event_id, round(cov, 6) AS coverage, round(over, 6) AS laps_beyond, round(ag, 6) AS age_score, CAST(tr AS DOUBLE) AS interference_score,
       round(ap, 6) AS applicability, CASE WHEN ap > 0.7 THEN 'low' WHEN ap > 0.4 THEN 'medium' ELSE 'high' END AS risk,
       coalesce(nullif(concat_ws('; ', CASE WHEN n = 0 THEN 'mode never run' WHEN n < 15 THEN 'only ' || n || ' laps over ' || runs || ' runs' END,
         CASE WHEN over > 3 THEN printf('%.0f', over) || ' laps past the oldest unit seen' END,
         CASE WHEN tr < 1 THEN 'more interference than observed' END), ''), 'inside the observed range') AS reasons FROM ap"""),
    "value_of_information": sql(LAPS + f""",
cu AS (SELECT event AS session_id, avg(sd) AS c FROM ({_OLS.format(w="true")}) GROUP BY ALL),
sg AS (SELECT * FROM (VALUES {", ".join(str(x) for x in ASKED)}) v(signal, r, rationale))""", """
SELECT session_id, signal, round(c, 6) AS current_uncertainty, CAST(r AS DOUBLE) AS estimated_reduction, round(c * (1 - r), 6) AS projected_uncertainty, rationale, true AS is_estimate FROM cu, sg"""),
}
