"""Queries over intervals: conformal, adaptive, reliability."""

from pyspark.sql import functions as F

from wearframe.catalog.forecasts import FS, stream
from wearframe.catalog.laps import NAIVE_EV
from wearframe.catalog.shared import r6, rounded_all, sql
from wearframe.functions import gaussian
from wearframe.operators import intervals as iv
from wearframe.operators import rates
from wearframe.operators.staging import stage
from wearframe.sources import adapters as ad


def _cases(spark, d):
    """Early against late naive rates per (session, mode): predicted, actual and two spreads."""
    laps = ad.laps_from_events(spark, d)
    halves = rates.run_slopes(laps, ("session_id", "week", "run_id", "mode"))
    return stage(halves.groupBy("session_id", "mode").agg(
        F.avg(F.when(F.col("week") < 2, F.col("slope"))).alias("predicted"),
        F.avg(F.when(F.col("week") >= 2, F.col("slope"))).alias("actual"),
        F.stddev_samp("slope").alias("sd"),
    ).where("predicted IS NOT NULL AND actual IS NOT NULL AND sd > 0").select(
        F.concat_ws("/", "session_id", "mode").alias("case_id"), F.col("session_id").alias("event"),
        "mode", "predicted", "actual", "sd", (F.col("sd") * 1.5).alias("combined_sd"), F.col("sd").alias("posterior_sd")))


CASES = NAIVE_EV + """,
ws AS (SELECT session_id, week, run_id, mode, regr_slope(perf, age) AS slope FROM laps GROUP BY ALL
       HAVING count(*) >= 3 AND max(age) > min(age)),
cs AS (SELECT session_id, mode, avg(slope) FILTER (WHERE week < 2) AS predicted, avg(slope) FILTER (WHERE week >= 2) AS actual,
         stddev_samp(slope) AS sd FROM ws GROUP BY ALL),
cases AS (SELECT session_id || '/' || mode AS case_id, session_id AS event, mode, predicted, actual, sd, sd * 1.5 AS combined_sd,
            abs(predicted - actual) AS residual FROM cs WHERE predicted IS NOT NULL AND actual IS NOT NULL AND sd > 0)
"""


def conformal_quantile(spark, d):
    s = stream(spark, d).withColumn("score", F.abs(F.col("actual") - F.col("mean")))
    out = iv.conformal_quantile(s, ["model", "session_id"], "score", 0.05)
    return rounded_all(out)


def calibrator(spark, d):
    return rounded_all(iv.fit_calibrator(_cases(spark, d), 0.1, "studentised"))


def calibrated_rates(spark, d):
    cal = iv.fit_calibrator(_cases(spark, d), 0.1, "absolute")
    laps = ad.laps_from_events(spark, d)
    fit = rates.ols_by_mode(laps).select("session_id", "mode", F.col("slope").alias("rate"), F.col("slope_se").alias("rate_sd"))
    return rounded_all(iv.apply_calibrator(cal, fit))


def loeo_intervals(spark, d):
    return rounded_all(iv.loeo_intervals(_cases(spark, d), 0.1))


def loeo_debiased(spark, d):
    return rounded_all(iv.loeo_debiased(_cases(spark, d), 0.1))


def interval_pick(spark, d):
    cases = stage(_cases(spark, d))
    return rounded_all(iv.pick_interval(stage(iv.loeo_intervals(cases, 0.1)), stage(iv.loeo_debiased(cases, 0.1)), 0.9))


def loeo_summary(spark, d):
    return rounded_all(iv.loeo_summary(stage(iv.loeo_intervals(_cases(spark, d), 0.1)), 0.9))


LOEO = CASES + """,
ev_ AS (SELECT DISTINCT event AS held FROM cases),
rest AS (SELECT held, residual, residual / sd AS stu, count(*) OVER (PARTITION BY held) AS n,
           row_number() OVER (PARTITION BY held ORDER BY residual) AS ra, row_number() OVER (PARTITION BY held ORDER BY residual / sd) AS rs
         FROM ev_ JOIN cases ON event <> held),
q AS (SELECT held, any_value(n) AS n, max(residual) FILTER (WHERE ra = ceil((n + 1) * CAST(0.9 AS DOUBLE))) AS qa,
        max(stu) FILTER (WHERE rs = ceil((n + 1) * CAST(0.9 AS DOUBLE))) AS qs FROM rest GROUP BY held),
loeo AS (SELECT event, case_id, residual, 1.959964 * sd AS gaussian_half_width, 1.959964 * combined_sd AS consistency_half_width,
           qa AS absolute_half_width, qs * sd AS studentised_half_width
         FROM cases JOIN q ON event = held WHERE n >= 19)
"""
DEBIASED = CASES + """,
dh AS (SELECT a.event AS held, avg(b.predicted - b.actual) AS shift FROM (SELECT DISTINCT event FROM cases) a JOIN cases b ON a.event <> b.event GROUP BY ALL),
dsc AS (SELECT held, shift, abs(predicted - actual - shift) AS r, sd FROM dh JOIN cases ON event <> held),
drk AS (SELECT held, shift, r, r / sd AS stu, count(*) OVER (PARTITION BY held) AS n, row_number() OVER (PARTITION BY held ORDER BY r) AS ra,
          row_number() OVER (PARTITION BY held ORDER BY r / sd) AS rs FROM dsc),
dq AS (SELECT held, any_value(shift) AS shift, any_value(n) AS n, max(r) FILTER (WHERE ra = ceil((n + 1) * CAST(0.9 AS DOUBLE))) AS qa,
         max(stu) FILTER (WHERE rs = ceil((n + 1) * CAST(0.9 AS DOUBLE))) AS qs FROM drk GROUP BY held),
deb AS (SELECT event, case_id, abs(predicted - actual - shift) AS residual, shift, 1.959964 * sd AS gaussian_half_width, 1.959964 * combined_sd AS consistency_half_width,
          qa AS absolute_half_width, qs * sd AS studentised_half_width FROM cases JOIN dq ON event = held WHERE n >= 19)
"""
_M = ("gaussian", "consistency", "absolute", "studentised")


def split_conformal(spark, d):
    return rounded_all(iv.split_conformal(stream(spark, d)).drop("failed"))


def split_studentised(spark, d):
    out = iv.split_conformal(stream(spark, d), 0.1, "studentised")
    return rounded_all(out.groupBy("model", "session_id", "fold").agg(
        F.avg(F.col("covered").cast("double")).alias("coverage"), F.avg("half_width").alias("half_width"),
        F.count_if("calibrated").alias("n_calibrated")))


SPLIT = FS + """,
sc AS (SELECT *, abs(actual - mean) AS res FROM fs),
past AS (SELECT a.model, a.session_id, a.fold AS f, b.res / {scale} AS s,
           count(*) OVER w AS n, row_number() OVER (w ORDER BY b.res / {scale}) AS r, max(b.res / {scale}) OVER w AS mx
         FROM (SELECT DISTINCT model, session_id, fold FROM fs) a JOIN sc b
           ON a.model = b.model AND a.session_id = b.session_id AND b.fold < a.fold
         WINDOW w AS (PARTITION BY a.model, a.session_id, a.fold)),
q AS (SELECT model, session_id, f AS fold, any_value(n) AS n, any_value(mx) AS mx,
        max(s) FILTER (WHERE r = ceil((n + 1) * CAST({level} AS DOUBLE))) AS q FROM past GROUP BY ALL),
sp AS (SELECT sc.*, coalesce(n >= 19, false) AS calibrated,
         CASE WHEN n >= 19 THEN coalesce(q, mx) * {own} ELSE 1.959964 * sd END AS half_width
       FROM sc LEFT JOIN q USING (model, session_id, fold))
"""


def pooled_intervals(spark, d):
    s = stream(spark, d)
    tagged = iv.split_conformal(s).select("session_id", F.lit("split").alias("method"), "half_width", "covered").unionByName(
        s.select("session_id", F.lit("gaussian").alias("method"), (F.lit(iv.Z95) * F.col("sd")).alias("half_width"),
                 (F.abs(F.col("actual") - F.col("mean")) <= F.lit(iv.Z95) * F.col("sd")).alias("covered")))
    rows = tagged.groupBy("method", "session_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("covered").cast("double")).alias("coverage"),
        (2 * F.avg("half_width")).alias("width"), (2 * F.percentile("half_width", F.lit(0.5))).alias("median_width"))
    return rounded_all(iv.pool_intervals(rows))


def adaptive_intervals(spark, d):
    return rounded_all(iv.adaptive_intervals(stream(spark, d)).drop("failed"))


def pit_histogram(spark, d):
    return rounded_all(iv.pit_histogram(stream(spark, d)))


def pit_diagnosis(spark, d):
    return rounded_all(iv.pit_diagnosis(stream(spark, d)))


PIT = FS + f""",
p AS (SELECT model, {gaussian.cdf_sql('((actual - mean) / sd)')} AS pit FROM fs WHERE sd > 0),
b AS (SELECT *, CAST(least(floor(pit * 20), 19) AS INTEGER) AS bin, row_number() OVER (PARTITION BY model ORDER BY pit) AS r,
        count(*) OVER (PARTITION BY model) AS n FROM p),
dg AS (SELECT model, count(*) AS n, avg(CASE WHEN bin < 2 OR bin >= 18 THEN 1.0 ELSE 0.0 END) AS tail,
         avg(CASE WHEN bin BETWEEN 8 AND 11 THEN 1.0 ELSE 0.0 END) AS mid, avg(pit) - 0.5 AS bias,
         max(greatest(r / n - pit, pit - (r - 1) / n)) AS ks FROM b GROUP BY model)
"""


def reliability_gaussian(spark, d):
    return rounded_all(iv.reliability_gaussian(stream(spark, d)))


def reliability_adaptive(spark, d):
    return rounded_all(iv.reliability_adaptive(stream(spark, d)))


def reliability_gap(spark, d):
    return rounded_all(iv.diagonal_gap(iv.reliability_gaussian(stream(spark, d))))


# one recursion step per observation: past scores as an ordered list
ADAPTIVE = "RECURSIVE " + FS.strip() + """,
lv AS (SELECT unnest({levels}) AS level),
ob AS MATERIALIZED (SELECT fs.*, row_number() OVER (PARTITION BY model, session_id ORDER BY fold, seq, asset, event_id) AS p, abs(actual - mean) AS score FROM fs),
ad(model, session_id, level, p, rate, past, missed, half, hit, used) AS (
  SELECT DISTINCT model, session_id, level, 0::BIGINT, 1.0::DOUBLE - level, []::DOUBLE[], 0, NULL::DOUBLE, NULL::BOOLEAN, NULL::DOUBLE FROM ob, lv
  UNION ALL
  SELECT model, session_id, level, p, rate + 0.02::DOUBLE * ((1.0::DOUBLE - level) - CASE WHEN score <= half THEN 0 ELSE 1 END), list_sort(list_append(past, score)),
    missed + CASE WHEN score <= half THEN 0 ELSE 1 END, half, score <= half, rate
  FROM (SELECT a.model, a.session_id, a.level, o.p, a.rate, a.past, a.missed, o.score,
          CASE WHEN len(past) < 19 THEN 1.959964::DOUBLE * o.sd
               ELSE past[least(ceil((len(past) + 1) * (1.0::DOUBLE - least(greatest(a.rate, 0.001::DOUBLE), 0.999::DOUBLE)))::INT, len(past))] END AS half
        FROM ad a JOIN ob o ON o.model = a.model AND o.session_id = a.session_id AND o.p = a.p + 1))
"""

QUERIES = {f.__name__: f for f in (
    conformal_quantile, calibrator, calibrated_rates, loeo_intervals, loeo_debiased, interval_pick, loeo_summary, split_conformal, split_studentised,
    pooled_intervals, adaptive_intervals, pit_histogram, pit_diagnosis, reliability_gaussian, reliability_adaptive, reliability_gap)}

_LV = " UNION ALL ".join(
    f"SELECT CAST({v} AS DOUBLE) AS level, CAST({gaussian.ppf(0.5 + v / 2)!r} AS DOUBLE) AS z" for v in iv.LEVELS)
REL = FS + f""",
lv AS ({_LV}),
rel AS (SELECT model, level, avg(CASE WHEN abs(actual - mean) <= z * sd THEN 1.0 ELSE 0.0 END) AS coverage FROM fs CROSS JOIN lv GROUP BY ALL)"""

ORACLES = {
    "conformal_quantile": sql(FS + """,
s AS (SELECT model, session_id, abs(actual - mean) AS s, row_number() OVER (PARTITION BY model, session_id ORDER BY abs(actual - mean)) AS r,
        count(*) OVER (PARTITION BY model, session_id) AS n FROM fs)""", """
SELECT model, session_id, any_value(n) AS n,
       round(coalesce(max(s) FILTER (WHERE r = ceil((n + 1) * CAST(0.95 AS DOUBLE))), CAST('inf' AS DOUBLE)), 6) AS quantile,
       round(max(s), 6) AS max_score FROM s GROUP BY ALL"""),
    "calibrator": sql(CASES + """,
b AS (SELECT *, avg(predicted - actual) OVER () AS bias, count(*) OVER () AS n FROM cases),
r AS (SELECT *, abs(predicted - actual - bias) / sd AS s, row_number() OVER (ORDER BY abs(predicted - actual - bias) / sd) AS r FROM b)""", """
SELECT 'studentised' AS score, CAST(0.1 AS DOUBLE) AS alpha, round(max(s) FILTER (WHERE r = ceil((n + 1) * CAST(0.9 AS DOUBLE))), 6) AS quantile,
       round(any_value(bias), 6) AS bias, any_value(n) AS n_calibration, count(DISTINCT event) AS n_events FROM r"""),
    "calibrated_rates": sql(CASES + """,
b AS (SELECT *, avg(predicted - actual) OVER () AS bias, count(*) OVER () AS n FROM cases),
r AS (SELECT *, abs(predicted - actual - bias) AS s, row_number() OVER (ORDER BY abs(predicted - actual - bias)) AS r FROM b),
c AS (SELECT max(s) FILTER (WHERE r = ceil((n + 1) * CAST(0.9 AS DOUBLE))) AS q, any_value(bias) AS bias FROM r),
fit AS (SELECT session_id, mode, regr_slope(perf, age) AS rate,
          sqrt((regr_syy(perf, age) - regr_sxy(perf, age) ** 2 / regr_sxx(perf, age)) / greatest(count(*) - 2, 1) / regr_sxx(perf, age)) AS rate_sd
        FROM laps GROUP BY ALL)""", """
SELECT session_id, mode, round(rate, 6) AS rate, round(rate_sd, 6) AS rate_sd, round(rate - bias, 6) AS expected_rate,
       round(greatest(rate - bias - q, 0), 6) AS low, round(greatest(rate - bias + q, 0), 6) AS high, CAST(0.9 AS DOUBLE) AS confidence
FROM fit, c"""),
    "loeo_intervals": sql(LOEO, "SELECT event, case_id, round(residual, 6) AS residual, " + ", ".join(
        f"round({m}_half_width, 6) AS {m}_half_width, residual <= {m}_half_width AS {m}_covered" for m in _M) + " FROM loeo"),
    "loeo_debiased": sql(DEBIASED, "SELECT event, case_id, round(residual, 6) AS residual, round(shift, 6) AS shift, " + ", ".join(
        f"round({m}_half_width, 6) AS {m}_half_width, residual <= {m}_half_width AS {m}_covered" for m in _M) + " FROM deb"),
    "interval_pick": sql(LOEO + DEBIASED[len(CASES):] + """,
lng AS (""" + " UNION ALL ".join(f"SELECT '{f}' AS form, '{m}' AS method, {m}_half_width AS half, residual FROM {t}" for f, t in (("raw", "loeo"), ("debiased", "deb")) for m in _M) + """),
t AS (SELECT form, method, avg(CASE WHEN residual <= half THEN 1.0 ELSE 0.0 END) AS coverage, avg(half) AS mean_half_width,
        count(*) AS n_scored, median(half) AS median_half_width FROM lng GROUP BY ALL)""", """
SELECT form, method, round(coverage, 6) AS coverage, round(mean_half_width, 6) AS mean_half_width, n_scored, round(median_half_width, 6) AS median_half_width,
       (form, method) = (SELECT (form, method) FROM t WHERE method IN ('absolute', 'studentised') ORDER BY round(abs(coverage - 0.9), 9), round(mean_half_width, 9), form, method LIMIT 1) AS chosen
FROM t"""),
    "loeo_summary": sql(LOEO + """,
lng AS (""" + " UNION ALL ".join(f"SELECT '{m}' AS method, {m}_half_width AS half, residual FROM loeo" for m in _M) + """),
t AS (SELECT method, avg(CASE WHEN residual <= half THEN 1.0 ELSE 0.0 END) AS coverage, avg(half) AS mean_half_width,
        count(*) AS n_scored, median(half) AS median_half_width FROM lng GROUP BY method)""", """
SELECT method, round(coverage, 6) AS coverage, round(mean_half_width, 6) AS mean_half_width, n_scored,
       round(median_half_width, 6) AS median_half_width,
       method = (SELECT method FROM t WHERE method IN ('absolute', 'studentised') ORDER BY abs(coverage - 0.9), mean_half_width LIMIT 1) AS chosen
FROM t"""),
    "split_conformal": sql(SPLIT.format(scale="1.0", own="1.0", level="0.95"), """
SELECT model, session_id, fold, seq, asset, event_id, actual, round(mean, 6) AS mean, round(sd, 6) AS sd,
       round(half_width, 6) AS half_width, res <= half_width AS covered, calibrated FROM sp"""),
    "split_studentised": sql(SPLIT.format(scale="b.sd", own="sd", level="0.9"), """
SELECT model, session_id, fold, round(avg(CASE WHEN res <= half_width THEN 1.0 ELSE 0.0 END), 6) AS coverage,
       round(avg(half_width), 6) AS half_width, count(*) FILTER (WHERE calibrated) AS n_calibrated FROM sp GROUP BY ALL"""),
    "pooled_intervals": sql(SPLIT.format(scale="1.0", own="1.0", level="0.95") + """,
tg AS (SELECT 'split' AS method, session_id, half_width AS h, res FROM sp UNION ALL SELECT 'gaussian', session_id, 1.959964 * sd, res FROM sc),
rw AS (SELECT method, session_id, count(*) AS n, avg(CASE WHEN res <= h THEN 1.0 ELSE 0.0 END) AS c, 2 * avg(h) AS w, 2 * median(h) AS mw FROM tg GROUP BY ALL),
t AS (SELECT method, CAST(sum(n) AS BIGINT) AS n_laps, sum(c * n) / sum(n) AS coverage, sum(w * n) / sum(n) AS width, sum(mw * n) / sum(n) AS median_width FROM rw GROUP BY method)""", """
SELECT method, n_laps, round(coverage, 6) AS coverage, round(width, 6) AS width, round(median_width, 6) AS median_width,
       round(abs(coverage - 0.95), 6) AS coverage_error,
       method = (SELECT method FROM t ORDER BY round(abs(coverage - 0.95), 3), median_width LIMIT 1) AS best FROM t"""),
    "pit_histogram": sql(PIT, """
SELECT model, bin, count(*) AS n, round(count(*) / any_value(n), 6) AS share FROM b GROUP BY model, bin"""),
    "pit_diagnosis": sql(PIT, """
SELECT model, n, round(tail, 6) AS tail_mass, round(mid, 6) AS middle_mass, round(1 - tail - mid, 6) AS shoulder_mass,
       round(bias, 6) AS bias_from_centre, round(ks, 6) AS ks_statistic,
       round(CASE WHEN ks * sqrt(n) < 0.2 THEN 1.0 ELSE greatest(0, least(1, """ + " + ".join(
        f"({2 * (-1) ** (k - 1)} * exp(-2 * {k * k} * ks * ks * n))" for k in range(1, 31)) + """)) END, 6) AS ks_p,
       CASE WHEN n < 100 THEN 'too few observations' WHEN tail > 0.25 AND mid > 0.23 AND 1 - tail - mid < 0.54 THEN 'leptokurtic'
            WHEN tail > 0.25 THEN 'too narrow' WHEN mid > 0.25 THEN 'too wide'
            WHEN bias < -0.05 THEN 'biased high' WHEN bias > 0.05 THEN 'biased low' ELSE 'close to uniform' END AS verdict FROM dg"""),
    "adaptive_intervals": sql(ADAPTIVE.format(levels="[0.95::DOUBLE]"), """
SELECT o.model, o.session_id, o.fold, o.seq, o.asset, o.event_id, o.actual, round(o.mean, 6) AS mean, round(o.sd, 6) AS sd, round(half, 6) AS half_width, hit AS covered,
  round(used, 6) AS working_alpha, round(1.0 - missed / p, 6) AS running_coverage FROM ad JOIN ob o USING (model, session_id, p)"""),
    "reliability_adaptive": sql(ADAPTIVE.format(levels="[" + ", ".join(f"{v!r}::DOUBLE" for v in iv.LEVELS) + "]"), """
SELECT model, level, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM ad WHERE p > 0 GROUP BY model, level"""),
    "reliability_gaussian": sql(REL, "SELECT model, level, round(coverage, 6) AS coverage FROM rel"),
    "reliability_gap": sql(REL, "SELECT model, round(avg(abs(coverage - level)), 6) AS gap FROM rel GROUP BY model"),
}
