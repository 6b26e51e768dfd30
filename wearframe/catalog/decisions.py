"""Queries over stop-or-continue decisions."""

from pyspark.sql import functions as F

from wearframe.catalog.laps import NAIVE_EV
from wearframe.catalog.shared import LAPS, r6, rounded_all, sql
from wearframe.functions import gaussian, narrate
from wearframe.operators import decide as de
from wearframe.operators import rates
from wearframe.operators.staging import stage
from wearframe.sources import adapters as ad


def _cases(spark, d):
    """One case per run: its last lap decides, twenty slots remain, the next mode is the session's first other one."""
    laps = stage(ad.laps_from_events(spark, d))
    fits = rates.ols_by_mode(laps).select("session_id", "mode", F.col("slope").alias("rate"), F.coalesce("slope_se", F.lit(0.0)).alias("rate_sd"))
    models = rates.mode_models(laps, fits)
    base = laps.groupBy("session_id").agg(F.avg("perf").alias("base"))
    last = laps.groupBy("session_id", "asset", "run_id", "mode").agg(F.max("age").alias("age"), F.count(F.lit(1)).alias("n"))
    listed = models.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("mode", "rate", "rate_sd", "base_pace", "cliff_age"))).alias("_m"))
    j = last.join(models, ["session_id", "mode"]).join(listed, "session_id").join(base, "session_id")
    j = j.withColumn("_new", F.element_at(F.filter("_m", lambda m: m["mode"] != F.col("mode")), 1))
    return stage(j.select(
        F.col("run_id").alias("case_id"), "mode", "age", "rate", "rate_sd", "base_pace", "cliff_age",
        (F.col("n") % 10).cast("long").alias("now"), (F.col("n") % 10 + 20).cast("long").alias("total"), "base",
        F.lit(de.STOP_LOSS).alias("stop_loss"), (0.4 + (F.col("run_id") % 5) * 0.4).cast("double").alias("gap_ahead"),
        F.col("_new.rate").alias("new_rate"), F.col("_new.rate_sd").alias("new_rate_sd"),
        F.col("_new.base_pace").alias("new_base_pace"), F.col("_new.cliff_age").alias("new_cliff_age"),
    ))


_E = {k: f"CAST({v!r} AS DOUBLE)" for k, v in de.moments().items()}
CASES = LAPS + """,
fit AS (SELECT session_id, mode, CASE WHEN count(*) >= 3 AND regr_sxx(perf, age) > 0 THEN regr_slope(perf, age) ELSE 0 END AS rate,
   CASE WHEN count(*) >= 3 AND regr_sxx(perf, age) > 0 THEN sqrt(greatest(regr_syy(perf, age) - regr_sxy(perf, age) ** 2 / regr_sxx(perf, age), 0) / greatest(count(*) - 2, 1) / regr_sxx(perf, age)) ELSE 0 END AS rate_sd
   FROM laps GROUP BY ALL),
med AS (SELECT session_id, median(perf) AS m, avg(perf) AS base FROM laps GROUP BY ALL),
mm AS (SELECT l.session_id, l.mode, any_value(rate) AS rate, any_value(rate_sd) AS rate_sd,
         CASE WHEN count(*) FILTER (WHERE age <= 3) >= 3 THEN median(perf) FILTER (WHERE age <= 3) - any_value(m) ELSE 0 END AS base_pace,
         greatest(0.85 * max(age), 8) AS cliff_age FROM laps l JOIN fit USING (session_id, mode) JOIN med USING (session_id) GROUP BY l.session_id, l.mode),
lastl AS (SELECT session_id, run_id, mode, max(age) AS age, count(*) AS n FROM laps GROUP BY session_id, asset, run_id, mode),
cases AS (SELECT run_id AS case_id, l.mode, l.age, mm.rate, mm.rate_sd, mm.base_pace, mm.cliff_age, n % 10 AS now, n % 10 + 20 AS total, base,
    21.0 AS stop_loss, 0.4 + (run_id % 5) * 0.4 AS gap_ahead, nw.rate AS new_rate, nw.rate_sd AS new_rate_sd, nw.base_pace AS new_base_pace, nw.cliff_age AS new_cliff_age
  FROM lastl l JOIN mm USING (session_id, mode) JOIN med USING (session_id)
  JOIN mm nw ON nw.session_id = l.session_id AND nw.mode = (SELECT min(o.mode) FROM mm o WHERE o.session_id = l.session_id AND o.mode <> l.mode))
"""
EVAL = CASES + f""",
opts AS ({{opts}}),
st AS (SELECT c.*, CAST(k AS BIGINT) AS k, age + k AS ag, base + base_pace + rate * (age + k) + 0.004 * greatest(age + k - cliff_age, 0) ** 2 + CASE WHEN gap_ahead < 1.2 THEN 0.45 ELSE 0 END AS d0,
         base + new_base_pace + new_rate * k + 0.004 * greatest(k - new_cliff_age, 0) ** 2 AS d1 FROM cases c, (SELECT unnest(range(1, 21)) AS k)),
pl AS (SELECT o.*, coalesce(stop_at, now + 21) - now AS i FROM opts o JOIN cases USING (case_id)),
pk AS (SELECT pl.option, pl.stop_at, pl.i, st.*, k < i AS stay, k - i + 1 AS j FROM pl JOIN st USING (case_id)),
pc AS (SELECT a.*, CASE WHEN a.stay THEN a.d0 ELSE n.d1 END AS d, CASE WHEN a.stay THEN a.ag ELSE 0 END AS x0, CASE WHEN a.stay THEN 0 ELSE a.j END AS x1,
         CASE WHEN a.stay THEN a.ag > a.cliff_age ELSE a.j > a.new_cliff_age END AS past
       FROM pk a LEFT JOIN st n ON n.case_id = a.case_id AND n.k = a.j),
oc AS (SELECT case_id, option, stop_at, any_value(i) AS i, {_E["mean"]} * sum(d) + CASE WHEN stop_at IS NULL THEN 0 ELSE {_E["stop"]} * any_value(stop_loss) END AS expected,
         sqrt({_E["mean"]} ** 2 * ((any_value(rate_sd) * sum(x0)) ** 2 + (any_value(new_rate_sd) * sum(x1)) ** 2)
           + {_E["var"]} * sum(d * d + (rate_sd * x0) ** 2 + (new_rate_sd * x1) ** 2) + ({_E["mean"]} ** 2 + {_E["var"]}) * 0.0625 * 20
           + CASE WHEN stop_at IS NULL THEN 0 ELSE {_E["stop_var"]} * any_value(stop_loss) ** 2 + 2 * {_E["cov"]} * any_value(stop_loss) * sum(d) FILTER (WHERE j = 1) END) AS sd,
         CAST(max(CASE WHEN past THEN 1 ELSE 0 END) AS DOUBLE) AS past_cliff FROM pc GROUP BY case_id, option, stop_at),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY case_id ORDER BY expected, option) AS INTEGER) AS position FROM oc)
"""
_five = "SELECT case_id, 'Stay out' AS option, CAST(NULL AS BIGINT) AS stop_at FROM cases " + " ".join(
    f"UNION ALL SELECT case_id, '{'Box now' if w == 0 else f'Box in {w} laps'}', now + 1 + {w} FROM cases" for w in (0, 2, 5, 8))
_sweep = """SELECT case_id, 'stay out' AS option, CAST(NULL AS BIGINT) AS stop_at FROM cases
  UNION ALL SELECT case_id, 'stop ' || (now + s), now + s FROM cases, (SELECT unnest(range(1, 21)) AS s)"""
FIVE, SWEEP = EVAL.format(opts=_five), EVAL.format(opts=_sweep)


def _table(spark, d):
    cases = _cases(spark, d)
    return cases, de.outcomes(cases, de.default_options(cases))


def decision_outcomes(spark, d):
    return rounded_all(_table(spark, d)[1])


def recommendations(spark, d):
    out = de.recommend(*_table(spark, d))
    return rounded_all(out.drop("rate", "rate_sd", "gap_ahead", "loss_now", "age", "mode"))


def decision_narration(spark, d):
    return de.recommend(*_table(spark, d)).select("case_id", narrate.decision_text().alias("text"))


def stop_windows(spark, d):
    cases = _cases(spark, d)
    return rounded_all(de.stop_window(de.outcomes(cases, de.sweep_plan(cases))))


def stop_regret(spark, d):
    table = _table(spark, d)[1]
    best = table.where("position = 1").select("case_id", F.col("option").alias("recommended"), F.lit("Stay out").alias("actual"))
    return rounded_all(de.regret(table, best))


def price_histogram(spark, d):
    li = ad.table(spark, d, "lineitem")
    return rounded_all(de.histogram(li, "l_extendedprice", ("l_returnflag",)))


QUERIES = {f.__name__: f for f in (decision_outcomes, recommendations, decision_narration, stop_windows, stop_regret, price_histogram)}

PAIR = FIVE + f""",
ab AS (SELECT x.case_id, x.option AS o1, coalesce(y.option, x.option) AS o2, coalesce(y.expected, x.expected) - x.expected AS margin, x.past_cliff, x.i AS i1, y.i AS i2,
         x.stop_at AS s1, y.stop_at AS s2, y.option IS NOT NULL AS two
       FROM rk x LEFT JOIN rk y ON y.case_id = x.case_id AND y.position = 2 WHERE x.position = 1),
df AS (SELECT ab.case_id, a.k, a.d - b.d AS d, a.x0 - b.x0 AS x0, a.x1 - b.x1 AS x1, a.k = i1 AND s1 IS NOT NULL AS at1, a.k = i2 AND s2 IS NOT NULL AS at2, a.rate_sd, a.new_rate_sd
       FROM ab JOIN pc a ON a.case_id = ab.case_id AND a.option = o1 JOIN pc b ON b.case_id = ab.case_id AND b.option = o2 AND b.k = a.k),
dv AS (SELECT case_id, {_E["mean"]} ** 2 * ((any_value(rate_sd) * sum(x0)) ** 2 + (any_value(new_rate_sd) * sum(x1)) ** 2)
         + {_E["var"]} * sum(d * d + (rate_sd * x0) ** 2 + (new_rate_sd * x1) ** 2)
         + 2 * {_E["cov"]} * 21.0 * (coalesce(sum(d) FILTER (WHERE at1), 0) - coalesce(sum(d) FILTER (WHERE at2), 0)) AS v FROM df GROUP BY case_id),
re AS (SELECT ab.*, sqrt(greatest(v + ((s1 IS NOT NULL)::INT + (s2 IS NOT NULL)::INT) * {_E["stop_var"]} * 441.0, 0)) AS sdd FROM ab JOIN dv USING (case_id)),
rz AS (SELECT *, CASE WHEN sdd > 0 THEN margin / sdd ELSE 40.0 END AS z FROM re),
rw AS (SELECT *, CASE WHEN two THEN {gaussian.cdf_sql("z")} ELSE 1.0 END AS w FROM rz)
"""

ORACLES = {
    "decision_outcomes": sql(FIVE, f"""
SELECT case_id, option, stop_at, round(expected, 6) AS expected, round(sd, 6) AS sd, round(expected - {gaussian.ppf(0.9)!r} * sd, 6) AS p10,
       round(expected + {gaussian.ppf(0.9)!r} * sd, 6) AS p90, past_cliff, position FROM rk"""),
    "recommendations": sql(PAIR, """
SELECT case_id, o1 AS recommended, o2 AS runner_up, round(margin, 6) AS margin, past_cliff, round(w, 6) AS win_probability FROM rw"""),
    "decision_narration": sql(PAIR, """
SELECT r.case_id, concat_ws(' ', printf('The %s unit is %.0f laps old and costs about %.2f s a lap.', lower(mode), age, rate * age + 0.004 * greatest(age - cliff_age, 0) ** 2),
  CASE WHEN rate_sd > 0.4 * abs(rate) THEN printf('The rate is uncertain (%.3f +/- %.3f s/lap), so the margin is soft.', rate, rate_sd) END,
  CASE WHEN margin < 0.5 THEN printf('%s and %s are %.2f s apart, within the noise.', o1, o2, margin) ELSE printf('%s beats %s by %.1f s.', o1, o2, margin) END,
  printf('It wins with probability %.0f%%.', 100 * w), CASE WHEN past_cliff > 0 THEN 'The unit passes its cliff on the way.' END,
  CASE WHEN gap_ahead < 1.2 THEN printf('The car ahead is %.1f s away, so part of the loss is traffic.', gap_ahead) END) AS text FROM rw r JOIN cases USING (case_id)"""),
    "stop_windows": sql(SWEEP + """,
b AS (SELECT case_id, min(expected) AS e, arg_min(stop_at, expected) AS o FROM oc WHERE stop_at IS NOT NULL GROUP BY case_id),
n AS (SELECT case_id, min(stop_at) AS f, max(stop_at) AS t FROM oc JOIN b USING (case_id) WHERE stop_at IS NOT NULL AND expected <= e + 1.0 GROUP BY case_id)""", """
SELECT case_id, round(e, 6) AS optimum_expected, o AS optimum, f AS window_from, t AS window_to, round(s.expected, 6) AS stay_out_expected,
       round(s.expected - e, 6) AS stay_out_cost FROM b JOIN n USING (case_id) JOIN (SELECT case_id, expected FROM oc WHERE stop_at IS NULL) s USING (case_id)"""),
    "stop_regret": sql(FIVE, """
SELECT x.case_id, x.option AS recommended, 'Stay out' AS actual, round(x.expected, 6) AS recommended_expected, round(y.expected, 6) AS actual_expected,
       round(greatest(y.expected - x.expected, 0), 6) AS regret
FROM rk x JOIN rk y ON y.case_id = x.case_id AND y.option = 'Stay out' WHERE x.position = 1"""),
    "price_histogram": """
WITH s AS (SELECT l_returnflag, min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 28 AS w, avg(l_extendedprice) AS mean,
  quantile_cont(l_extendedprice, 0.1) AS p10, quantile_cont(l_extendedprice, 0.9) AS p90 FROM lineitem GROUP BY ALL),
b AS (SELECT l_returnflag, CAST(least(floor((l_extendedprice - lo) / w), 27) AS INTEGER) AS bin, lo, w, mean, p10, p90 FROM lineitem JOIN s USING (l_returnflag))
SELECT l_returnflag, bin, round(any_value(lo + (bin + 0.5) * w), 6) AS centre, count(*) AS n, round(any_value(mean), 6) AS mean, round(any_value(p10), 6) AS p10,
  round(any_value(p90), 6) AS p90 FROM b GROUP BY l_returnflag, bin""",
}
