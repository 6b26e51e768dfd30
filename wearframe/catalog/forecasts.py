"""Queries over forecast streams: rungs, scores, ladders."""

from pyspark.sql import functions as F

from wearframe.catalog.laps import FOLDS
from wearframe.catalog.shared import INTERFERENCE, LAPS, r6, rounded_all, sql
from wearframe.functions import gaussian
from wearframe.operators import folds as fo
from wearframe.operators import rates, windows
from wearframe.operators.staging import stage
from wearframe.sources import adapters as ad


def laps_and_folds(spark, d, interference=False):
    laps = stage(ad.laps_from_events(spark, d, interference=interference))
    return laps, windows.rolling_folds(laps)


def stream(spark, d):
    """Forecast streams of the two line rungs."""
    laps, folds = laps_and_folds(spark, d)
    return stage(fo.evaluate(laps, folds, {"naive": fo.line_rung, "corrected": fo.corrected_rung}))


_RUNG = """
tr_{m} AS (SELECT l.session_id, f.fold, l.mode, l.age, l.perf + {load} * l.elapsed AS y
           FROM laps l JOIN folds f ON l.session_id = f.session_id AND l.seq <= f.cut),
fit_{m} AS (SELECT session_id, fold, mode, count(*) AS n, avg(y) AS my, regr_slope(y, age) AS b, regr_intercept(y, age) AS a,
              regr_sxx(y, age) AS sxx, regr_syy(y, age) AS syy, regr_sxy(y, age) AS sxy FROM tr_{m} GROUP BY ALL),
par_{m} AS (SELECT session_id, fold, mode, n, n >= 3 AND sxx > 0 AS ok, CASE WHEN n >= 3 AND sxx > 0 THEN b ELSE 0 END AS b,
              CASE WHEN n >= 3 AND sxx > 0 THEN a ELSE my END AS a, greatest(syy - sxy * sxy / sxx, 0) AS rss FROM fit_{m}),
pool_{m} AS (SELECT session_id, fold, coalesce(sqrt(sum(rss) FILTER (WHERE ok) / sum(n) FILTER (WHERE ok)), 1.0) AS sd,
              median(a) AS anya FROM par_{m} GROUP BY ALL),
fs_{m} AS (SELECT '{m}' AS model, l.session_id, CAST(f.fold AS INTEGER) AS fold, l.seq, l.asset, l.event_id, l.perf AS actual,
              coalesce(b * age + a, anya) - {load} * elapsed AS mean, greatest(sd, 1e-3) AS sd
           FROM laps l JOIN folds f ON l.session_id = f.session_id AND l.seq > f.cut AND l.seq <= f.last
           JOIN pool_{m} p ON p.session_id = f.session_id AND p.fold = f.fold
           LEFT JOIN par_{m} q ON q.session_id = f.session_id AND q.fold = f.fold AND q.mode = l.mode)
"""
FS = (LAPS + "," + FOLDS + "," + _RUNG.format(m="naive", load="0.0") + "," + _RUNG.format(m="corrected", load="0.081")
      + ", fs AS (FROM fs_naive UNION ALL FROM fs_corrected)")

SCORES = FS + f""",
sc AS (SELECT model, session_id, fold, count(*) AS n_test, avg(abs(actual - mean)) AS mae, sqrt(avg((actual - mean) ** 2)) AS rmse,
         avg({gaussian.crps_sql('actual', 'mean', 'sd')}) AS crps,
         avg(CASE WHEN abs(actual - mean) <= 1.96 * sd THEN 1.0 ELSE 0.0 END) AS coverage, avg(2 * 1.96 * sd) AS width,
         avg(mean - actual) AS bias FROM fs GROUP BY ALL),
ms AS (SELECT model, session_id, count(*) AS n_folds, avg(mae) AS mae, avg(rmse) AS rmse, avg(crps) AS crps, avg(coverage) AS coverage,
         avg(width) AS width, avg(bias) AS bias,
         CASE WHEN count(*) >= 2 THEN arg_max(bias, fold) - arg_min(bias, fold) END AS bias_drift FROM sc GROUP BY ALL)
"""
_m6 = ", ".join(f"round({c}, 6) AS {c}" for c in ("mae", "rmse", "crps", "coverage", "width", "bias"))


def forecast_stream(spark, d):
    return rounded_all(stream(spark, d).drop("failed"))


def fold_scores(spark, d):
    return rounded_all(fo.fold_scores(stream(spark, d)))


def model_scores(spark, d):
    return rounded_all(fo.model_scores(fo.fold_scores(stream(spark, d))))


def ladder(spark, d):
    return rounded_all(fo.ladder(fo.model_scores(fo.fold_scores(stream(spark, d)))))


def ridge_forecast(spark, d):
    laps, folds = laps_and_folds(spark, d, interference=True)
    return rounded_all(fo.ridge_rung(laps, folds).drop("failed"))


def ridge_rates(spark, d):
    laps, folds = laps_and_folds(spark, d, interference=True)
    return rounded_all(fo.ridge_rates(fo.ridge_fit(laps, folds)[0]))


def isolated_rungs(spark, d):
    """Sessions with few laps lose a time in training: what every rung makes of every fold, and why it fails."""
    laps, folds = laps_and_folds(spark, d, interference=True)
    few = laps.groupBy("session_id").count().where("count < 660").select("session_id", F.lit(True).alias("_few"))
    first = laps.groupBy("session_id").agg(F.min("seq").alias("_first"))
    broken = laps.join(few, "session_id", "left").join(first, "session_id").withColumn(
        "perf", F.when(F.col("_few") & (F.col("seq") == F.col("_first")), F.lit(float("nan"))).otherwise(F.col("perf")))
    out = fo.evaluate(stage(broken.drop("_few", "_first")), folds)
    return out.groupBy("model", "session_id", "fold").agg(F.count("mean").alias("n_forecasts"), F.count("failed").alias("n_failed"), F.substring_index(F.min("failed"), ":", 1).alias("kind"))


def boosted_forecast(spark, d):
    laps, folds = laps_and_folds(spark, d, interference=True)
    return rounded_all(fo.boosted_rung(laps, folds))


def rate_recovery(spark, d):
    laps = ad.laps_from_events(spark, d)
    fit = rates.ols_by_mode(laps, ("session_id",)).select(
        F.concat(F.lit("s"), "session_id").alias("model"), "mode", F.col("slope").alias("rate"), F.col("slope_se").alias("rate_sd"))
    silent = laps.select(F.concat(F.lit("b"), F.col("session_id") % 2).alias("model")).distinct().select(
        "model", *[F.lit(None).cast(t).alias(c) for c, t in (("mode", "string"), ("rate", "double"), ("rate_sd", "double"))])
    truth = laps.groupBy("mode").agg((F.min(F.length("mode")) / 100.0).alias("true_rate"))
    return rounded_all(fo.rate_recovery(fit.unionByName(silent), truth))


def recovery_summary(spark, d):
    laps = ad.laps_from_events(spark, d)
    fit = rates.ols_by_mode(laps, ("session_id",)).select(
        F.concat(F.lit("s"), "session_id").alias("model"), "mode", F.col("slope").alias("rate"), F.col("slope_se").alias("rate_sd"))
    truth = laps.groupBy("mode").agg((F.min(F.length("mode")) / 100.0).alias("true_rate"))
    return rounded_all(fo.recovery_summary(fo.rate_recovery(fit, truth)))


QUERIES = {f.__name__: f for f in (
    forecast_stream, fold_scores, model_scores, ladder, ridge_forecast, ridge_rates, isolated_rungs, boosted_forecast, rate_recovery, recovery_summary)}

RECOVERY = LAPS + """,
fit AS (SELECT 's' || session_id AS model, mode, count(*) AS n, regr_slope(perf, age) AS rate,
          sqrt((regr_syy(perf, age) - regr_sxy(perf, age) ** 2 / regr_sxx(perf, age)) / greatest(count(*) - 2, 1) / regr_sxx(perf, age)) AS se
        FROM laps GROUP BY session_id, mode),
truth AS (SELECT DISTINCT mode, length(mode) / 100.0 AS tr FROM laps),
rec AS (SELECT m.model, t.mode, tr AS true_rate, rate AS estimate, rate - tr AS error,
          CASE WHEN rate IS NOT NULL AND se IS NOT NULL THEN abs(rate - tr) <= 1.96 * se END AS covered
        FROM (SELECT DISTINCT model FROM fit) m CROSS JOIN truth t LEFT JOIN fit f ON f.model = m.model AND f.mode = t.mode)
"""

# the whole design, asset columns included, solved by elimination on lists: no Schur complement here
RIDGE = LAPS + INTERFERENCE + "," + FOLDS + """,
rt AS (SELECT f.session_id, f.fold, l.asset, l.mode, l.age, coalesce(l.interference, 0.0) AS i, l.seq - min(l.seq) OVER (PARTITION BY f.session_id, f.fold) AS pr, l.elapsed, l.perf AS y
       FROM ilaps l JOIN folds f ON l.session_id = f.session_id AND l.seq <= f.cut),
rl AS (SELECT session_id, fold, list(DISTINCT asset ORDER BY asset) AS assets, list(DISTINCT mode ORDER BY mode) AS modes, count(*) AS n, sum(y * y) AS yy FROM rt GROUP BY ALL),
rx AS (SELECT session_id, fold, y, list_concat([1.0::DOUBLE], list_transform(assets[2:], lambda a: CASE WHEN a = asset THEN 1.0::DOUBLE ELSE 0.0 END),
         flatten(list_transform(modes, lambda m: CASE WHEN m = mode THEN [1.0::DOUBLE, age] ELSE [0.0::DOUBLE, 0.0] END)), [i, pr, -elapsed]) AS x FROM rt JOIN rl USING (session_id, fold)),
ru AS (SELECT session_id, fold, y, x, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS k FROM rx),
rg AS (SELECT session_id, fold, k, list(g ORDER BY j) AS row, any_value(m) AS m
       FROM (SELECT session_id, fold, k, j, sum(v * w) AS g FROM (SELECT session_id, fold, k, v, unnest(x) AS w, unnest(range(1, len(x) + 1)) AS j FROM ru WHERE v <> 0) GROUP BY ALL)
       JOIN (SELECT session_id, fold, k, sum(v * y) AS m FROM ru GROUP BY ALL) USING (session_id, fold, k) GROUP BY ALL),
rm AS (SELECT session_id, fold, len(list(k)) AS p, list(m ORDER BY k) AS b,
         list(list_concat(list_transform(row, lambda g, j: g + CASE WHEN j = k AND k > 1 THEN 1.0 ELSE 0.0 END), [m]) ORDER BY k) AS a,
         list(list_concat(list_transform(row, lambda g, j: g + CASE WHEN j = k THEN 1.0 ELSE 0.0 END), list_transform(row, lambda g, j: CASE WHEN j = k THEN 1.0::DOUBLE ELSE 0.0 END)) ORDER BY k) AS c,
         list(row ORDER BY k) AS g
       FROM rg GROUP BY ALL),
re AS (WITH RECURSIVE e AS (
         SELECT session_id, fold, p, 1 AS s, a, c FROM rm
         UNION ALL
         SELECT session_id, fold, p, s + 1,
           list_transform(a, lambda r, q: CASE WHEN q = s THEN list_transform(r, lambda v: v / a[s][s]) ELSE list_transform(r, lambda v, j: v - r[s] * a[s][j] / a[s][s]) END),
           list_transform(c, lambda r, q: CASE WHEN q = s THEN list_transform(r, lambda v: v / c[s][s]) ELSE list_transform(r, lambda v, j: v - r[s] * c[s][j] / c[s][s]) END)
         FROM e WHERE s <= p)
       SELECT session_id, fold, list_transform(a, lambda r: r[p + 1]) AS beta, list_transform(c, lambda r, q: r[p + q]) AS inv FROM e WHERE s = p + 1),
rb AS (SELECT session_id, fold, assets, modes, beta, inv, len(assets) AS na,
         sqrt(greatest(yy - 2 * list_sum(list_transform(b, lambda m, k: m * beta[k])) + list_sum(list_transform(g, lambda r, k: beta[k] * list_sum(list_transform(r, lambda v, j: v * beta[j])))), 0)
              / greatest(n - p, 1)) AS sd
       FROM re JOIN rm USING (session_id, fold) JOIN rl USING (session_id, fold))
"""

ORACLES = {
    "isolated_rungs": sql(LAPS + "," + FOLDS + """,
sz AS (SELECT session_id, count(*) < 660 AS few FROM laps GROUP BY ALL),
ts AS (SELECT f.session_id, f.fold, few, count(*) AS n FROM folds f JOIN laps l ON l.session_id = f.session_id AND l.seq > f.cut AND l.seq <= f.last JOIN sz ON sz.session_id = f.session_id GROUP BY ALL)""", """
SELECT model, session_id, CAST(fold AS INTEGER) AS fold, CASE WHEN few THEN 0 ELSE n END AS n_forecasts, CAST(few AS BIGINT) AS n_failed,
       CASE WHEN few THEN CASE WHEN model = 'ridge' THEN 'LinAlgError' ELSE 'ArithmeticError' END END AS kind
FROM ts, (SELECT unnest(['naive', 'corrected', 'ridge']) AS model)"""),
    "ridge_rates": sql(RIDGE, """
SELECT session_id, CAST(fold AS INTEGER) AS fold, mode, round(beta[na + 2 * q], 6) AS rate, round(sd * sqrt(greatest(inv[na + 2 * q], 0)), 6) AS rate_sd
FROM (SELECT session_id, fold, beta, inv, na, sd, unnest(modes) AS mode, unnest(range(1, len(modes) + 1)) AS q FROM rb)"""),
    "ridge_forecast": sql(RIDGE + """,
ro AS (SELECT session_id, fold, min(seq) AS o FROM laps JOIN folds USING (session_id) WHERE seq <= cut GROUP BY ALL),
rf AS (SELECT l.session_id, l.seq, l.asset, l.event_id, l.perf, l.age, l.elapsed, l.interference, CAST(f.fold AS INTEGER) AS fold, o, beta, na, sd, list_position(assets, l.asset) AS pa, coalesce(list_position(modes, l.mode), 1) AS pm, len(beta) AS p
       FROM ilaps l JOIN folds f ON l.session_id = f.session_id AND l.seq > f.cut AND l.seq <= f.last JOIN ro ON ro.session_id = f.session_id AND ro.fold = f.fold JOIN rb ON rb.session_id = f.session_id AND rb.fold = f.fold)""", """
SELECT session_id, fold, seq, asset, event_id, perf AS actual, round(sd_, 6) AS sd, 'ridge' AS model,
       round(beta[1] + CASE WHEN pa > 1 THEN beta[pa] ELSE 0 END + beta[na + 2 * pm - 1] + beta[na + 2 * pm] * age + beta[p - 2] * coalesce(interference, 0.0)
             + beta[p - 1] * (seq - o) - beta[p] * elapsed, 6) AS mean
FROM (SELECT *, greatest(sd, 1e-3) AS sd_ FROM rf)"""),
    "forecast_stream": sql(FS, """
SELECT model, session_id, fold, seq, asset, event_id, actual, round(mean, 6) AS mean, round(sd, 6) AS sd FROM fs"""),
    "fold_scores": sql(SCORES, f"SELECT model, session_id, fold, n_test, {_m6} FROM sc"),
    "model_scores": sql(SCORES, f"SELECT model, session_id, n_folds, {_m6}, round(bias_drift, 6) AS bias_drift FROM ms"),
    "ladder": sql(SCORES, """
SELECT model, count(*) AS n_sessions, """ + ", ".join(
        f"round(avg({c}), 6) AS {c}" for c in ("mae", "rmse", "crps", "coverage", "width", "bias", "bias_drift")) + " FROM ms GROUP BY model"),
    "rate_recovery": sql(RECOVERY, """
SELECT model, mode, round(true_rate, 6) AS true_rate, round(estimate, 6) AS estimate, round(error, 6) AS error, covered FROM rec
UNION ALL SELECT DISTINCT 'b' || (session_id % 2), NULL, NULL, NULL, NULL, NULL FROM laps"""),
    "recovery_summary": sql(RECOVERY, """
SELECT model, round(avg(abs(error)), 6) AS rate_mae, round(avg(error), 6) AS rate_bias,
       round(avg(CASE WHEN covered THEN 1.0 WHEN NOT covered THEN 0.0 END), 6) AS coverage, count(error) AS n FROM rec GROUP BY model"""),
}
