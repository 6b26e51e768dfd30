"""Queries over wear-curve shapes."""

from pyspark.sql import functions as F

from wearframe.catalog.laps import LAPS
from wearframe.catalog.shared import LINE, r6, rounded_all, sql
from wearframe.catalog.statistics import _wx
from wearframe.functions import gaussian
from wearframe.operators import rates
from wearframe.operators import shapes as sh
from wearframe.operators.staging import stage
from wearframe.sources import adapters as ad


def _laps(spark, d):
    return sh.corrected(ad.laps_from_events(spark, d))


def _shapes(spark, d):
    laps = _laps(spark, d)
    modes = laps.groupBy("session_id", "asset", "run_id").agg(F.first("mode").alias("mode"))
    return stage(sh.curve_shapes(laps).join(modes, ["session_id", "asset", "run_id"]))


def curve_shapes(spark, d):
    return rounded_all(sh.curve_shapes(_laps(spark, d)))


def curve_shapes_lineitem(spark, d):
    laps = ad.laps_from_lineitem(spark, d).withColumn("corrected", F.col("perf") / 1000)
    return rounded_all(sh.curve_shapes(laps)).drop("broken_bic")


def curve_forecast(spark, d):
    return rounded_all(sh.curve_forecast(_laps(spark, d)))


def regime_census(spark, d):
    return rounded_all(sh.regime_census(_shapes(spark, d)))


def cliff_census(spark, d):
    """On a perf with a known bend past age 9, so that cliffs occur."""
    laps = ad.laps_from_events(spark, d).withColumn(
        "corrected", 0.01 * F.col("perf") + 0.3 * F.greatest(F.col("age") - 9, F.lit(0.0)))
    modes = laps.groupBy("session_id", "asset", "run_id").agg(F.first("mode").alias("mode"))
    return rounded_all(sh.cliff_census(stage(sh.curve_shapes(laps).join(modes, ["session_id", "asset", "run_id"]))))


def forecast_census(spark, d):
    return rounded_all(sh.forecast_census(stage(sh.curve_forecast(_laps(spark, d))), _shapes(spark, d)))


def longest_bent_runs(spark, d):
    laps = _laps(spark, d)
    runs = laps.groupBy("session_id", "mode", "run_id").agg(F.max("age").alias("end_age"))
    out = rates.overview(rates.naive_rates(laps), runs, _shapes(spark, d))
    return out.where("longest_bent_run IS NOT NULL").select("session_id", "longest_bent_run")


def curvature_share(spark, d):
    from wearframe.operators.attribute import curvature_share as share

    return rounded_all(share(_laps(spark, d).withColumn("level", F.col("perf"))))


QUERIES = {f.__name__: f for f in (
    curve_shapes, curve_shapes_lineitem, curve_forecast, regime_census, cliff_census, forecast_census, longest_bent_runs, curvature_share)}

# brute force: every break against every lap of its run
_FIT = """
ln_{k} AS (SELECT {key}, count(*) AS n, min(x) AS x0, max(x) AS x1, avg(y) AS yb, avg(x) AS xb, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy,
          regr_syy(y, x) AS syy FROM {src} GROUP BY ALL),
tr_{k} AS (SELECT a.*, t.x AS tau FROM ln_{k} a JOIN (SELECT DISTINCT {key}, x FROM {src}) t USING ({key}) WHERE t.x BETWEEN x0 + 4 AND x1 - 4),
hs_{k} AS (SELECT {key}, tau, any_value(n) AS n, any_value(sxx) AS saa, any_value(sxy) AS say, any_value(syy) AS syy, any_value(xb) AS xb, any_value(yb) AS yb,
          any_value(x0) AS x0, any_value(x1) AS x1, regr_sxy(greatest(x - tau, 0), x) AS sah, regr_syy(greatest(x - tau, 0), x) AS shh,
          regr_sxy(y, greatest(x - tau, 0)) AS shy, avg(greatest(x - tau, 0)) AS hb FROM tr_{k} JOIN {src} USING ({key}) GROUP BY ALL),
cf_{k} AS (SELECT *, (say * shh - shy * sah) / (saa * shh - sah * sah) AS b, (shy * saa - say * sah) / (saa * shh - sah * sah) AS d FROM hs_{k}),
rs_{k} AS (SELECT *, greatest(syy - b * say - d * shy, 0) AS rss FROM cf_{k}),
bs_{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY round(rss, 9), tau) AS rn FROM rs_{k}) WHERE rn = 1),
st_{k} AS (SELECT l.*, sxy / sxx AS lb, greatest(syy - sxy * sxy / sxx, 0) AS lrss, s.tau, s.b, s.d, s.rss, yb - s.b * xb - s.d * s.hb AS c
        FROM ln_{k} l LEFT JOIN (SELECT {key}, tau, b, d, rss, hb FROM bs_{k}) s USING ({key}))
"""
_SHAPE = """
bc AS (SELECT *, CASE WHEN lrss > 0 AND n > 3 THEN n * ln(lrss / n) + 3 * ln(n) ELSE CAST('inf' AS DOUBLE) END AS lbic,
         CASE WHEN tau IS NOT NULL AND rss > 0 AND n > 5 THEN n * ln(rss / n) + 5 * ln(n) ELSE CAST('inf' AS DOUBLE) END AS bbic
       FROM st_s WHERE n >= 12 AND x1 - x0 >= 4),
shape AS (SELECT *, CASE WHEN bbic >= lbic THEN 'linear' WHEN d < -0.02 THEN 'recovery' WHEN b < -0.005 AND d > 0.02 THEN 'warm-up'
            WHEN d > 0.02 THEN 'cliff' ELSE 'linear' END AS regime FROM bc),
shapes AS (SELECT {key}, regime, n AS n_laps, CASE WHEN regime <> 'linear' THEN b ELSE lb END AS slope,
      CASE WHEN regime <> 'linear' THEN tau END AS changepoint, CASE WHEN regime <> 'linear' THEN d END AS delta,
      CASE WHEN regime <> 'linear' THEN b + d END AS slope_after, CASE WHEN regime <> 'linear' THEN (tau - x0) / greatest(x1 - x0, 1e-9) END AS position,
      lbic AS linear_bic, bbic AS broken_bic, sqrt(CASE WHEN regime <> 'linear' THEN rss ELSE lrss END / n) AS rmse FROM shape)
"""
KEY = "session_id, asset, run_id"
SRC = LAPS + ", src AS (SELECT session_id, asset, run_id, mode, age AS x, perf + 0.081 * elapsed AS y FROM laps)"
SHAPES = SRC + "," + _FIT.format(k="s", key=KEY, src="src") + "," + _SHAPE.format(key=KEY)
FORE = """,
ps AS (SELECT *, row_number() OVER (PARTITION BY session_id, asset, run_id ORDER BY x, y) AS p, count(*) OVER (PARTITION BY session_id, asset, run_id) AS m FROM src),
pc AS (SELECT *, CAST(floor(m * CAST(0.7 AS DOUBLE)) AS BIGINT) AS cut FROM ps WHERE m >= 12),
trn AS (SELECT session_id, asset, run_id, x, y FROM pc WHERE p <= cut AND cut >= 8 AND m - cut >= 2),
""" + _FIT.format(k="f", key=KEY, src="trn") + """,
fc AS (SELECT session_id, asset, run_id, count(*) AS n_forecast, avg(abs(yb - lb * xb + lb * x - y)) AS linear_mae,
         avg(abs(c + b * x + d * greatest(x - tau, 0) - y)) AS stick_mae, avg(yb - lb * xb + lb * x - y) AS linear_bias,
         avg(c + b * x + d * greatest(x - tau, 0) - y) AS stick_bias
       FROM pc JOIN st_f USING (session_id, asset, run_id) WHERE p > cut AND tau IS NOT NULL GROUP BY ALL)
"""
_cols = ", ".join(f"round({c}, 6) AS {c}" for c in (
    "slope", "changepoint", "delta", "slope_after", "position", "linear_bic", "broken_bic", "rmse"))
_fcols = ", ".join(f"round({c}, 6) AS {c}" for c in ("linear_mae", "stick_mae", "linear_bias", "stick_bias"))

ORACLES = {
    "curve_shapes": sql(SHAPES, f"SELECT {KEY}, regime, n_laps, {_cols} FROM shapes"),
    "curve_shapes_lineitem": sql(
        LINE + ", src AS (SELECT session_id, asset, run_id, age AS x, perf / 1000 AS y FROM llaps)," + _FIT.format(k="s", key=KEY, src="src")
        + "," + _SHAPE.format(key=KEY), f"SELECT {KEY}, regime, n_laps, {_cols.replace('round(broken_bic, 6) AS broken_bic, ', '')} FROM shapes"),
    "forecast_census": sql(SHAPES + FORE + f""",
fj AS (SELECT fc.*, regime FROM fc JOIN shapes USING ({KEY})),
wd AS (SELECT regime, round(stick_mae - linear_mae, 12) AS d FROM fj WHERE round(stick_mae - linear_mae, 12) <> 0),
wr AS (SELECT regime, d, rank() OVER (PARTITION BY regime ORDER BY abs(d)) + (count(*) OVER (PARTITION BY regime, abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY regime, abs(d)) AS t FROM wd),
ws AS (SELECT regime, CAST(count(*) AS DOUBLE) AS n, least(coalesce(sum(r) FILTER (WHERE d > 0), 0), coalesce(sum(r) FILTER (WHERE d < 0), 0)) AS s, sum(t * t - 1.0) AS ties FROM wr GROUP BY regime),
wz AS (SELECT regime, (s - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM ws)""", f"""
SELECT fj.regime, count(*) AS n, round(avg(linear_mae), 6) AS linear_mae, round(avg(stick_mae), 6) AS stick_mae, round(avg(linear_bias), 6) AS linear_bias,
  round(avg(stick_bias), 6) AS stick_bias, round(any_value(2 * {gaussian.cdf_sql("(-abs(z))")}), 6) AS wilcoxon_p
FROM fj LEFT JOIN wz USING (regime) GROUP BY fj.regime HAVING count(*) >= 10"""),
    "longest_bent_runs": sql(SHAPES, """
SELECT session_id, run_id AS longest_bent_run FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n_laps DESC, run_id) AS r
FROM shapes WHERE regime <> 'linear') WHERE r = 1"""),
    "curve_forecast": sql(SRC + FORE, f"SELECT {KEY}, n_forecast, {_fcols} FROM fc"),
    "regime_census": sql(SHAPES, """
SELECT regime, count(*) AS n, round(count(*) / (SELECT count(*) FROM shapes), 6) AS share, round(median(slope), 6) AS median_slope,
       round(median(delta), 6) AS median_delta, round(median(changepoint), 6) AS median_changepoint, round(median(position), 6) AS median_position
FROM shapes GROUP BY regime"""),
    "cliff_census": sql(SHAPES.replace("perf + 0.081 * elapsed AS y", "0.01 * perf + 0.3 * greatest(age - 9, 0) AS y") + ", md AS (SELECT DISTINCT session_id, asset, run_id, mode FROM src)", """
SELECT mode, count(*) AS n, round(median(changepoint), 6) AS median_changepoint,
       round(quantile_cont(changepoint, 0.75) - quantile_cont(changepoint, 0.25), 6) AS iqr, round(median(delta), 6) AS median_delta
FROM shapes JOIN md USING (session_id, asset, run_id) WHERE regime = 'cliff' GROUP BY mode HAVING count(*) >= 8"""),
    "curvature_share": sql(LAPS + """,
c AS (SELECT session_id, run_id, count(*) AS n, regr_syy(perf, age) AS syy, regr_sxy(perf, age) AS sxy, regr_sxx(perf, age) AS sxx FROM laps
      GROUP BY ALL HAVING count(*) >= 5 AND max(age) - min(age) >= 2)""", """
SELECT session_id, count(*) AS n_runs, round(sum((syy - sxy * sxy / sxx) / n) / sum(syy / n), 6) AS nonlinear_share,
       round(1 - sum((syy - sxy * sxy / sxx) / n) / sum(syy / n), 6) AS linear_share FROM c GROUP BY session_id"""),
}
