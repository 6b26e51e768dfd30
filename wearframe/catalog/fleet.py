"""Queries over run-to-failure fleets."""

from pyspark.sql import functions as F

from wearframe.catalog.shared import CYCLES, r6, rounded_all, sql
from wearframe.operators import fleet as fl
from wearframe.operators.staging import stage
from wearframe.sources import adapters as ad

SENSORS = [f"sensor_{i}" for i in range(1, 5)]


def _health(spark, d):
    return fl.health_index(ad.cycles_from_lineitem(spark, d), SENSORS)


def condition_count(spark, d):
    return fl.condition_count(ad.cycles_from_lineitem(spark, d))


def trending_sensors(spark, d):
    return rounded_all(fl.trending_sensors(ad.cycles_from_lineitem(spark, d), 0.0))


def health_index(spark, d):
    return rounded_all(_health(spark, d).select("unit", "cycle", "damage", "health"))


def health_from_reference(spark, d):
    cyc = ad.cycles_from_lineitem(spark, d)
    out = fl.health_index(cyc.where("unit % 2 = 0"), SENSORS, cyc.where("unit % 2 = 1"), scale_from="reference")
    return rounded_all(out.select("unit", "cycle", "damage", "health"))


def failure_level(spark, d):
    return rounded_all(fl.failure_level(_health(spark, d)))


def observations(spark, d):
    return rounded_all(fl.to_observations(_health(spark, d)))


def generic_laps(spark, d):
    return rounded_all(fl.to_laps(fl.to_observations(_health(spark, d)), is_cost=False))


def rul_scores(spark, d):
    """Predictions from a straight line on the last health, truth from the cycles not seen."""
    cyc = ad.cycles_from_lineitem(spark, d)
    cases = cyc.groupBy("unit").agg((F.avg("sensor_1") * 2).alias("predicted"), F.max(F.col("n_cycles") / 10.0).alias("rul"))
    pred = cases.select(F.col("unit").alias("asset"), "predicted")
    return rounded_all(fl.rul_scores(fl.with_truth(pred, cases.select("unit", "rul"))))


def remaining_life(spark, d):
    """Every unit, fitted on its whole history."""
    health = stage(_health(spark, d).select("unit", "cycle", "n_cycles", "setting_1", "setting_3", "health"))
    obs = fl.to_observations(health)
    return rounded_all(fl.remaining_life(obs, fl.failure_level(health)))


QUERIES = {f.__name__: f for f in (
    condition_count, trending_sensors, health_index, health_from_reference, failure_level, observations, generic_laps, rul_scores, remaining_life)}


def _hi(frame, ref, scale):
    z = " + ".join(
        f"CASE WHEN s{i} >= 1e-9 THEN (sensor_{i} - m{i}) / s{i} * CASE WHEN l{i} < m{i} THEN -1 ELSE 1 END ELSE 0 END" for i in range(1, 5))
    st = ", ".join(f"avg(sensor_{i}) FILTER (WHERE cycle <= 20) AS m{i}, stddev_samp(sensor_{i}) AS s{i}, avg(sensor_{i}) FILTER (WHERE cycle > n_cycles - 20) AS l{i}"
                   for i in range(1, 5))
    return CYCLES + f""",
st AS (SELECT {st} FROM cyc WHERE {ref}),
dm AS (SELECT unit, cycle, n_cycles, setting_1, setting_3, ({z}) / 4 AS damage FROM cyc, st),
sc AS (SELECT quantile_cont(abs(damage), 0.98) AS p FROM dm WHERE {scale}),
hi AS (SELECT unit, cycle, n_cycles, setting_1, setting_3, damage, greatest(0.0, least(1.0, 1 - damage / (2 * p))) AS health FROM dm, sc WHERE {frame})
"""


HI = _hi("true", "true", "true")
_mode = "'cond_' || CAST(round_even(setting_3, 0) AS INTEGER) || '_' || CAST(round_even(setting_1, 0) AS INTEGER)"

ORACLES = {
    "condition_count": sql(CYCLES, """
SELECT count(DISTINCT (round_even(setting_1, 0), round_even(setting_2, 0), round_even(setting_3, 0))) AS n_conditions FROM cyc"""),
    "trending_sensors": sql(CYCLES + ", lg AS (" + " UNION ALL ".join(
        f"SELECT 'sensor_{i}' AS sensor, unit, corr(cycle, sensor_{i}) AS c FROM cyc GROUP BY unit HAVING stddev_pop(sensor_{i}) >= 1e-9" for i in range(1, 5)) + ")", """
SELECT sensor, round(abs(avg(c)), 6) AS score, count(*) AS n_units FROM lg GROUP BY sensor"""),
    "health_index": sql(HI, "SELECT unit, cycle, round(damage, 6) AS damage, round(health, 6) AS health FROM hi"),
    "health_from_reference": sql(_hi("unit % 2 = 0", "unit % 2 = 1", "unit % 2 = 1"),
                                 "SELECT unit, cycle, round(damage, 6) AS damage, round(health, 6) AS health FROM hi"),
    "failure_level": sql(HI, """
SELECT round(avg(health) FILTER (WHERE cycle <= 5) - avg(health) FILTER (WHERE cycle > n_cycles - 3), 6) AS failure_level FROM hi"""),
    "observations": sql(HI, f"""
SELECT unit AS asset_id, unit AS unit_id, cycle AS sequence, CAST(cycle AS DOUBLE) AS age, round(health, 6) AS performance, {_mode} AS mode,
  CAST(cycle - 1 AS DOUBLE) AS elapsed_in_run FROM hi"""),
    "generic_laps": sql(HI, f"""
SELECT CAST(0 AS BIGINT) AS session_id, unit AS asset, cycle AS seq, unit AS run_id, CAST(cycle AS DOUBLE) AS age, CAST(cycle - 1 AS DOUBLE) AS elapsed,
  round(-health, 6) AS perf, {_mode} AS mode, 0e0 AS interference, cycle AS event_id FROM hi"""),
    "rul_scores": sql(CYCLES + """,
c AS (SELECT unit, avg(sensor_1) * 2 - max(n_cycles / 10.0) AS e FROM cyc GROUP BY unit)""", """
SELECT count(*) AS n_units, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, round(avg(CASE WHEN e < 0 THEN 1.0 ELSE 0.0 END), 6) AS early_share,
  round(sum(CASE WHEN e < 0 THEN exp(-e / 13) - 1 ELSE exp(e / 10) - 1 END), 6) AS score FROM c"""),
}
