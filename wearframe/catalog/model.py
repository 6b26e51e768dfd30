"""Queries over fitted sessions.

The fits have no SQL counterpart; what is computed from a fit is checked on
states given by formula.
"""

import uuid

from pyspark.sql import functions as F

from wearframe.catalog.forecasts import laps_and_folds
from wearframe.catalog.shared import LAPS, ULAPS, r6, rounded_all, sql
from wearframe.functions import gaussian, narrate
from wearframe.operators import attribute as at
from wearframe.operators import folds as fo
from wearframe.operators import intervals as iv
from wearframe.operators import rates, stats, windows
from wearframe.operators import statespace as ss
from wearframe.operators.staging import stage
from wearframe.plans import reports, validation
from wearframe.sources import adapters as ad
from wearframe.catalog.statistics import ASKED
from wearframe.catalog.streams import stream_session
from wearframe.streaming import live


def _laps(spark, d):
    return stage(ad.laps_from_events(spark, d, interference=True, unique=True))


def _fit(spark, d):
    return stage(ss.fit_sessions(_laps(spark, d)))


def lap_states(spark, d):
    return rounded_all(ss.lap_states(_fit(spark, d)).select(
        "session_id", "event_id", "level", "level_sd", "rate", "rate_sd", "level_f", "rate_f", "std_residual"))


def coefficients(spark, d):
    return rounded_all(ss.coefficients(_fit(spark, d)))


def mode_rates(spark, d):
    return rounded_all(ss.mode_rates(_fit(spark, d)))


def drift_curve(spark, d):
    return rounded_all(ss.drift_curve(_fit(spark, d)))


def fit_diagnostics(spark, d):
    return rounded_all(ss.diagnostics(_fit(spark, d)))


def tuned_hyper(spark, d):
    return rounded_all(ss.tune(_laps(spark, d)))


def prior_sweep(spark, d):
    return rounded_all(ss.prior_sweep(_laps(spark, d)))


def prior_sensitivity(spark, d):
    """How far each variant moves the rates from the baseline, per session."""
    swept = stage(ss.prior_sweep(_laps(spark, d)))
    base = swept.where("variant = 'baseline'").select("session_id", "mode", F.col("rate").alias("base"))
    return rounded_all(swept.join(base, ["session_id", "mode"]).groupBy("variant").agg(
        F.avg(F.abs(F.col("rate") - F.col("base"))).alias("mean_shift"), F.avg("rate_sd").alias("mean_sd"), F.count(F.lit(1)).alias("n")))


def statespace_forecast(spark, d):
    laps = _laps(spark, d)
    return rounded_all(ss.forecast_rung(laps, windows.rolling_folds(laps)))


def full_ladder(spark, d):
    laps = _laps(spark, d)
    folds = windows.rolling_folds(laps)
    stream = stage(fo.evaluate(laps, folds, {**fo.RUNGS, "boosted": fo.boosted_rung, "statespace": ss.forecast_rung}))
    return rounded_all(fo.ladder(fo.model_scores(fo.fold_scores(stream), stream)))


def fitted_decomposition(spark, d):
    return rounded_all(at.decompose(ss.lap_states(_fit(spark, d))).drop("contributions"))


def fitted_life(spark, d):
    return rounded_all(at.competitive_life(ss.lap_states(_fit(spark, d))))


def fitted_curvature(spark, d):
    return rounded_all(at.curvature_share(ss.lap_states(_fit(spark, d))))


def session_summary(spark, d):
    laps = _laps(spark, d)
    fit = stage(ss.fit_sessions(laps))
    cases = ss.mode_rates(fit).join(rates.naive_rates(laps).select("session_id", "mode", F.col("rate").alias("actual")), ["session_id", "mode"]).select(
        F.col("rate").alias("predicted"), "actual", F.col("rate_sd").alias("posterior_sd"), F.col("session_id").alias("event"))
    codes = laps.select("session_id", F.when(F.col("session_id") % 2 == 0, "FP2").otherwise("R").alias("session")).distinct()
    return rounded_all(reports.session_summary(laps, fit, iv.fit_calibrator(stage(cases), 0.1), codes))


def confounder_shift(spark, d):
    return rounded_all(reports.confounder_shift(_fit(spark, d)))


def filtered_laps(spark, d):
    return rounded_all(reports.lap_table(_fit(spark, d), smoothed=False))


def runs_with_shape(spark, d):
    return rounded_all(reports.runs_with_shape(_fit(spark, d)))


def lap_narration(spark, d):
    return reports.narration(_fit(spark, d))


def trust_report(spark, d):
    laps = _laps(spark, d)
    return rounded_all(reports.trust(laps, stage(ss.fit_sessions(laps))))


def transfer_validation(spark, d):
    laps = _laps(spark, d)
    event = laps.select("session_id").distinct().withColumn("event", F.col("session_id"))
    return rounded_all(validation.validate_transfer(laps.where("week < 1"), laps.where("week >= 1"), event))


def live_replay(spark, d):
    """The live estimator over the whole table in one ordered pass per session."""
    return rounded_all(live.replay_batch(_laps(spark, d)))


def live_stream_agrees(spark, d):
    """Stored laps replayed as a stream, week by week, against the one-pass replay: rows per session, and how many agree."""
    from wearframe.operators.staging import shared_folder

    laps = _laps(spark, d)
    folder = f"{shared_folder(spark)}/wearframe/stream-{uuid.uuid4().hex}"
    files = live.store_batches(laps, "week", f"{folder}/in")
    stream = live.live_states(live.replay(stream_session(spark), f"{folder}/in", laps.schema, max_files=files))
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").outputMode("append")
    writer.trigger(availableNow=True).start().awaitTermination()
    key = ["session_id", "asset", "seq"]
    values = ["level", "level_sd", "rate", "forecast", "low", "high", "coverage"]
    once = live.replay_batch(laps).select(*key, *[F.col(v).alias(f"_{v}") for v in values])
    both = spark.read.schema(stream.schema).parquet(f"{folder}/out").join(once, key, "full_outer")
    close = [F.coalesce(F.abs(F.col(v) - F.col(f"_{v}")) <= 1e-9 * (1 + F.abs(v)), F.lit(False)) for v in values]
    agree = close[0]
    for c in close[1:]:
        agree = agree & c
    return both.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(agree).alias("n_agree"))


def live_rate_trace(spark, d):
    states = live.replay_batch(_laps(spark, d)).where("reason IS NULL")
    return rounded_all(reports.mean_rate_trace(states))


def live_latest(spark, d):
    return rounded_all(live.latest_states(live.replay_batch(_laps(spark, d))))


def live_feed(spark, d):
    return live.live_feed(stage(live.replay_batch(_laps(spark, d))))


# ---- checked on states given by formula ----------------------------------------


def _states(spark, d):
    laps = ad.laps_from_events(spark, d, unique=True)
    e = F.col("event_id")
    return laps.select(
        "session_id", F.lit("f").alias("variant"), "asset", "seq", "run_id", "event_id", "mode", "age", "elapsed", "perf",
        ((e % 10) / 10.0).alias("interference"), (0.03 * F.col("age") + F.col("perf") / 1000).alias("level"),
        (0.05 + 0.001 * F.col("age")).alias("level_sd"), (0.03 + ((e % 7) - 3) / 100.0).alias("rate"), (0.01 + (e % 5) / 1000.0).alias("rate_sd"),
        F.lit(0.0001).alias("level_rate_cov"), F.lit(0.0001).alias("q_level"), F.lit(0.00001).alias("q_rate"),
        (-F.col("seq") / 720.0).alias("drift_basis"), ((e % 11) / 100.0).alias("drift_resid"),
        F.lit(0.08).alias("load"), F.lit(0.015).alias("load_sd"), F.lit(0.5).alias("coefficient"), F.lit(0.2).alias("coefficient_sd"),
        F.lit(0.9).alias("amplitude"), F.lit(0.4).alias("amplitude_sd"),
    )


STATES = ULAPS + """,
s AS (SELECT session_id, 'f' AS variant, asset, seq, run_id, event_id, mode, age, elapsed, perf, (event_id % 10) / 10.0 AS interference,
   0.03 * age + perf / 1000 AS level, 0.05 + 0.001 * age AS level_sd, 0.03 + ((event_id % 7) - 3) / 100.0 AS rate, 0.01 + (event_id % 5) / 1000.0 AS rate_sd,
   -seq / 720.0 AS drift_basis, (event_id % 11) / 100.0 AS drift_resid FROM ulaps)
"""


def state_rate_trace(spark, d):
    return rounded_all(reports.mean_rate_trace(_states(spark, d)))


def _live_states(spark, d):
    """States as the live estimator sends them: rows with a high value are refused."""
    return _states(spark, d).withColumn("reason", F.when(F.col("perf") > 90, "no time")).withColumn("laps_observed", F.col("age").cast("long")).withColumn("coverage", F.lit(0.9))


def state_latest(spark, d):
    return rounded_all(live.latest_states(_live_states(spark, d)))


def state_feed(spark, d):
    """Frames of the feed, with what their payload says of the whole session."""
    states = _live_states(spark, d)
    for c in ("forecast", "low", "high"):
        states = states.withColumn(c, F.col("perf"))
    feed = live.live_feed(states.withColumn("covered", F.lit(True)))
    whole = F.when(F.col("type") != "lap", F.get_json_object("payload", "$.total_laps").cast("long"))
    return feed.select("session_id", "seq", "asset", "type", whole.alias("total_laps"), F.when(F.col("type") == "start", F.get_json_object("payload", "$.modes")).alias("modes"))


def drift_curve_of_laps(spark, d):
    """Drift a session should have picked up by each of its laps, for an amplitude of 0.9."""
    laps = ad.laps_from_events(spark, d)
    return rounded_all(windows.saturating_drift(laps, 0.01).select("session_id", "event_id", (F.col("drift_basis") * 0.9).alias("drift")))


def decomposition(spark, d):
    out = at.decompose(_states(spark, d))
    return rounded_all(out.withColumn("largest", F.col("contributions")[0]["key"]).withColumn(
        "largest_high", F.col("contributions")[0]["high"]).drop("contributions"))


def peel_away(spark, d):
    return rounded_all(at.peel_away(at.decompose(_states(spark, d)), ["load", "drift", "interference"]))


def counterfactuals(spark, d):
    return rounded_all(at.counterfactuals(_states(spark, d)))


def projection(spark, d):
    return rounded_all(at.project(_states(spark, d), horizon=12))


def competitive_life(spark, d):
    return rounded_all(at.competitive_life(_states(spark, d)))


def health_timeline(spark, d):
    return rounded_all(at.health_timeline(_states(spark, d)))


def stint_regimes(spark, d):
    return rounded_all(at.stint_regimes(_states(spark, d)))


def trust_regimes(spark, d):
    return rounded_all(reports.trust_regimes(_states(spark, d)).select("session_id", "asset", "run_id", "laps", "regime", "confidence", "position"))


def fitted_regimes(spark, d):
    return rounded_all(reports.trust_regimes(ss.lap_states(_fit(spark, d))))


def measurement_value(spark, d):
    return rounded_all(reports.measurement_value(ss.mode_rates(_fit(spark, d)), ASKED))


def decomposition_narration(spark, d):
    return at.decompose(_states(spark, d)).select("session_id", "asset", "seq", narrate.decomposition_text().alias("text"))


def projection_narration(spark, d):
    return at.competitive_life(_states(spark, d)).select("session_id", "asset", "seq", narrate.projection_text().alias("text"))


QUERIES = {f.__name__: f for f in (
    lap_states, coefficients, mode_rates, drift_curve, fit_diagnostics, tuned_hyper, prior_sweep, prior_sensitivity, statespace_forecast, full_ladder,
    fitted_decomposition, fitted_life, fitted_curvature, session_summary, confounder_shift, filtered_laps, runs_with_shape, lap_narration, trust_report,
    transfer_validation, live_replay, live_stream_agrees, live_rate_trace, live_latest, live_feed,
    state_rate_trace, state_latest, state_feed, drift_curve_of_laps, decomposition, peel_away, counterfactuals, projection, competitive_life, health_timeline, stint_regimes, trust_regimes, fitted_regimes, measurement_value,
    decomposition_narration, projection_narration)}

DEC = STATES + """,
rf AS (SELECT *, first_value(seq) OVER w AS ref_seq, perf - first_value(perf) OVER w AS delta, level - first_value(level) OVER w AS tyre,
   sqrt(level_sd ** 2 + first_value(level_sd) OVER w ** 2) AS tyre_sd, -0.08 * (elapsed - first_value(elapsed) OVER w) AS load,
   abs(elapsed - first_value(elapsed) OVER w) * 0.015 AS load_sd,
   0.9 * (drift_basis - first_value(drift_basis) OVER w) + drift_resid - first_value(drift_resid) OVER w AS drift,
   abs(drift_basis - first_value(drift_basis) OVER w) * 0.4 AS drift_sd, 0.5 * (interference - first_value(interference) OVER w) AS interference_s,
   abs(interference - first_value(interference) OVER w) * 0.2 AS interference_sd
   FROM s WINDOW w AS (PARTITION BY session_id, asset, run_id ORDER BY seq)),
dc AS (SELECT *, load + drift + interference_s AS confounders FROM rf)
"""
_k = "session_id, variant, asset, seq"
LIFE = STATES + """,
old AS (SELECT session_id, mode, max(age) AS oldest FROM s GROUP BY ALL),
pj AS (SELECT s.*, oldest, h, level + h * rate AS loss,
   sqrt(greatest(level_sd ** 2 + h * h * rate_sd ** 2 + 2 * h * 0.0001 + h * 0.0001 + h * h * h / 3 * 0.00001, 0)) AS loss_sd
   FROM s JOIN old USING (session_id, mode), (SELECT unnest(range(1, {h})) AS h))
"""

ORACLES = {
    "decomposition": sql(DEC, f"""
SELECT {_k}, ref_seq, run_id, mode, age, round(delta, 6) AS delta, round(tyre, 6) AS tyre, round(load, 6) AS load, round(drift, 6) AS drift,
  round(interference_s, 6) AS interference, round(tyre_sd, 6) AS tyre_sd, round(load_sd, 6) AS load_sd, round(drift_sd, 6) AS drift_sd,
  round(interference_sd, 6) AS interference_sd, round(confounders, 6) AS confounders, round(delta - tyre - confounders, 6) AS residual,
  round(CASE WHEN delta > 0 THEN tyre / delta END, 6) AS tyre_share,
  CASE greatest(abs(tyre), abs(load), abs(drift), abs(interference_s)) WHEN abs(tyre) THEN 'tyre' WHEN abs(load) THEN 'load' WHEN abs(drift) THEN 'drift' ELSE 'interference' END AS largest,
  round(CASE greatest(abs(tyre), abs(load), abs(drift), abs(interference_s)) WHEN abs(tyre) THEN tyre + 1.96 * tyre_sd WHEN abs(load) THEN load + 1.96 * load_sd
    WHEN abs(drift) THEN drift + 1.96 * drift_sd ELSE interference_s + 1.96 * interference_sd END, 6) AS largest_high FROM dc"""),
    "decomposition_narration": sql(DEC + """,
big AS (SELECT *, greatest(abs(tyre), abs(load), abs(drift), abs(interference_s)) AS top FROM dc)""", """
SELECT session_id, asset, seq, printf('Lap %d of car %s on the %s unit', seq, asset::VARCHAR, lower(mode)) || CASE
  WHEN delta < -0.05 AND tyre > 0.05 THEN printf(' gained %.2f s over lap %d although the unit lost %.2f s: conditions hid the wear.', (round(round(abs(delta), 9)::DECIMAL(18, 9), 2)::DOUBLE), ref_seq, (round(round(tyre, 9)::DECIMAL(18, 9), 2)::DOUBLE))
  WHEN delta > 0.05 THEN printf(' lost %.2f s to lap %d; the unit explains %.0f%% (%.2f s), and the main cause is %s (%.2f s).', (round(round(delta, 9)::DECIMAL(18, 9), 2)::DOUBLE), ref_seq, (round(round(100 * tyre / delta, 9)::DECIMAL(18, 9), 0)::DOUBLE), (round(round(tyre, 9)::DECIMAL(18, 9), 2)::DOUBLE),
    CASE top WHEN abs(tyre) THEN 'tyre degradation' WHEN abs(load) THEN 'fuel burn-off' WHEN abs(drift) THEN 'track evolution' ELSE 'traffic' END, (round(round(top, 9)::DECIMAL(18, 9), 2)::DOUBLE))
  ELSE printf(' kept the pace of lap %d: unit %.2f s, conditions %.2f s.', ref_seq, (round(round(tyre, 9)::DECIMAL(18, 9), 2)::DOUBLE), (round(round(confounders, 9)::DECIMAL(18, 9), 2)::DOUBLE)) END AS text FROM big"""),
    "projection_narration": sql(LIFE.format(h=21) + f""",
lf AS (SELECT {_k}, run_id, mode, age, any_value(oldest) AS oldest,
  coalesce(min(h) FILTER (WHERE (loss - 0.8) >= {gaussian.ppf(0.2)!r} * greatest(loss_sd, 1e-9)), 20) AS a,
  coalesce(min(h) FILTER (WHERE (loss - 0.8) >= 0), 20) AS b,
  coalesce(min(h) FILTER (WHERE (loss - 0.8) >= {gaussian.ppf(0.8)!r} * greatest(loss_sd, 1e-9)), 20) AS c FROM pj GROUP BY ALL)""", """
SELECT session_id, asset, seq, printf('Car %s, %s unit, age %.0f: expected to pass %.1f s of loss after %.0f laps (likely %.0f to %.0f).', asset::VARCHAR, lower(mode), age::DOUBLE,
  0.8::DOUBLE, b::DOUBLE, a::DOUBLE, c::DOUBLE) || CASE WHEN exp(-greatest(age + 20 - oldest, 0) / 5) < 0.5 THEN ' No unit seen here was ever that old.' ELSE '' END AS text FROM lf"""),
    "state_rate_trace": sql(STATES, "SELECT session_id, seq, mode, round(avg(rate), 6) AS mean_rate, count(*) AS n FROM s GROUP BY ALL"),
    "state_latest": sql(STATES + """,
g AS (SELECT *, row_number() OVER (PARTITION BY session_id, asset ORDER BY seq DESC) AS r FROM s WHERE NOT perf > 90)""", """
SELECT session_id, asset, seq, mode, age, round(level, 6) AS level, round(level_sd, 6) AS level_sd, round(rate, 6) AS rate, round(rate_sd, 6) AS rate_sd,
       CAST(age AS BIGINT) AS laps_observed, CAST(0.9 AS DOUBLE) AS coverage, round(greatest(0, least(100, 100 * (1 - level / 1.5))), 6) AS health FROM g WHERE r = 1"""),
    "state_feed": sql(STATES + """,
g AS (SELECT * FROM s WHERE NOT perf > 90),
e AS (SELECT session_id, min(seq) AS f, max(seq) AS l, count(*) AS n, '["' || string_agg(DISTINCT mode, '","' ORDER BY mode) || '"]' AS m FROM g GROUP BY ALL)""", """
SELECT session_id, seq, asset, 'lap' AS type, NULL::BIGINT AS total_laps, NULL AS modes FROM g
UNION ALL SELECT session_id, f, -1, 'start', n, m FROM e UNION ALL SELECT session_id, l, NULL, 'complete', n, NULL FROM e"""),
    "drift_curve_of_laps": sql(LAPS, """
SELECT session_id, event_id, round(-0.9 * (1 - exp(-0.01 * (seq - min(seq) OVER (PARTITION BY session_id)))), 6) AS drift FROM laps"""),
    "live_stream_agrees": sql(ULAPS, "SELECT session_id, count(*) AS n, count(*) AS n_agree FROM ulaps GROUP BY session_id"),
    "peel_away": sql(DEC, f"""
SELECT {_k}, round(delta, 6) AS step_0, round(delta - load, 6) AS step_1, round(delta - load - drift, 6) AS step_2,
  round(delta - load - drift - interference_s, 6) AS step_3 FROM dc"""),
    "counterfactuals": sql(STATES + """,
o AS (SELECT s.*, 'clean_air' AS scenario, 0.5 * interference AS gain, 0.2 * interference AS sd FROM s UNION ALL
      SELECT s.*, 'fresh_tyre', level, level_sd FROM s UNION ALL
      SELECT s.*, 'clean_air_fresh_tyre', 0.5 * interference + level, sqrt((0.2 * interference) ** 2 + level_sd ** 2) FROM s)""", f"""
SELECT {_k}, mode, perf AS actual, scenario, round(perf - gain, 6) AS estimate, round(-gain, 6) AS delta, round(sd, 6) AS sd,
  round(-gain - 1.96 * sd, 6) AS low, round(-gain + 1.96 * sd, 6) AS high FROM o"""),
    "projection": sql(LIFE.format(h=13), f"""
SELECT {_k}, run_id, mode, age, CAST(h AS INTEGER) AS h, round(loss, 6) AS loss, round(loss_sd, 6) AS loss_sd, round(rate, 6) AS rate,
  round(sqrt(rate_sd ** 2 + h * 0.00001), 6) AS rate_sd, round({gaussian.cdf_sql('((loss - 0.8) / greatest(loss_sd, 1e-9))')}, 6) AS breach_probability,
  round(exp(-greatest(age + h - oldest, 0) / 5), 6) AS applicability FROM pj"""),
    "competitive_life": sql(LIFE.format(h=21) + f""",
lf AS (SELECT {_k}, run_id, mode, age, any_value(oldest) AS oldest,
  coalesce(min(h) FILTER (WHERE (loss - 0.8) >= {gaussian.ppf(0.2)!r} * greatest(loss_sd, 1e-9)), 20) AS a,
  coalesce(min(h) FILTER (WHERE (loss - 0.8) >= 0), 20) AS b,
  coalesce(min(h) FILTER (WHERE (loss - 0.8) >= {gaussian.ppf(0.8)!r} * greatest(loss_sd, 1e-9)), 20) AS c FROM pj GROUP BY ALL)""", f"""
SELECT {_k}, run_id, mode, age, CAST(a AS DOUBLE) AS life_low, CAST(b AS DOUBLE) AS life, CAST(c AS DOUBLE) AS life_high,
  round(exp(-greatest(age + 20 - oldest, 0) / 5), 6) AS end_applicability, CAST(0.8 AS DOUBLE) AS threshold FROM lf"""),
    "health_timeline": sql(STATES, f"""
SELECT {_k}, run_id, age, round(level, 6) AS level, round(level_sd, 6) AS level_sd, round(rate, 6) AS rate, round(rate_sd, 6) AS rate_sd,
  round(greatest(0, least(100, 100 * (1 - level / 1.5))), 6) AS health FROM s"""),
    "trust_regimes": sql(STATES + """,
i AS (SELECT *, row_number() OVER (PARTITION BY session_id, asset, run_id ORDER BY age, seq) AS i FROM s),
f AS (SELECT session_id, asset, run_id, count(*) AS n, avg(rate) AS r, regr_slope(rate, i) AS t, avg(interference) AS m FROM i GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, asset, run_id) AS position FROM f)""", """
SELECT session_id, asset, run_id, n AS laps,
  CASE WHEN n < 4 THEN 'sparse data' WHEN m > 0.35 THEN 'traffic limited' WHEN t > 0.004 THEN 'cliff' WHEN r < -0.01 THEN 'recovering'
       WHEN r > 0.15 THEN 'high degradation' ELSE 'clean running' END AS regime,
  round(CASE WHEN n < 4 THEN 1.0 WHEN m > 0.35 THEN least(m / 0.6, 1) WHEN t > 0.004 THEN least(t / 0.01, 1) WHEN r < -0.01 THEN least(abs(r) / 0.05, 1)
       WHEN r > 0.15 THEN least(r / 0.25, 1) ELSE 0.8 END, 6) AS confidence, position FROM g WHERE position <= 10"""),
    "stint_regimes": sql(STATES + """,
i AS (SELECT *, row_number() OVER (PARTITION BY session_id, asset, run_id ORDER BY age, seq) AS i FROM s),
f AS (SELECT session_id, variant, asset, run_id, count(*) AS n, avg(rate) AS r, regr_slope(rate, i) AS t, avg(interference) AS m FROM i GROUP BY ALL)""", """
SELECT session_id, variant, asset, run_id, n AS laps, round(r, 6) AS mean_rate, round(CASE WHEN n > 1 THEN t END, 6) AS rate_trend, round(m, 6) AS mean_interference,
  CASE WHEN n < 4 THEN 'sparse data' WHEN m > 0.35 THEN 'traffic limited' WHEN t > 0.004 THEN 'cliff' WHEN r < -0.01 THEN 'recovering'
       WHEN r > 0.15 THEN 'high degradation' ELSE 'clean running' END AS regime,
  round(CASE WHEN n < 4 THEN 1.0 WHEN m > 0.35 THEN least(m / 0.6, 1) WHEN t > 0.004 THEN least(t / 0.01, 1) WHEN r < -0.01 THEN least(abs(r) / 0.05, 1)
       WHEN r > 0.15 THEN least(r / 0.25, 1) ELSE 0.8 END, 6) AS confidence FROM f"""),
}
