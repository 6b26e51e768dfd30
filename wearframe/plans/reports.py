"""Report datasets: one DataFrame per question a dashboard or an agent would ask."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearframe.functions import narrate
from wearframe.operators import attribute as at
from wearframe.operators import intervals as iv
from wearframe.operators import rates, shapes
from wearframe.operators import statespace as ss
from wearframe.operators import stats as st

KEYS = list(ss.FIT_KEYS)


def session_summary(laps: DataFrame, fit: DataFrame, calibrator: DataFrame | None = None, sessions: DataFrame | None = None) -> DataFrame:
    """Per session and mode: fitted rate with its interval, the naive rate, laps, and the race projection.

    The projection appears only for practice sessions (codes starting with FP)
    when a calibrator and the session codes are given.
    """
    fitted = ss.mode_rates(fit).withColumn("low", F.col("rate") - 1.96 * F.col("rate_sd")).withColumn("high", F.col("rate") + 1.96 * F.col("rate_sd"))
    naive = rates.naive_rates(laps).select("session_id", "mode", F.col("rate").alias("naive_rate"), "n_runs", "n_laps")
    out = fitted.join(naive, ["session_id", "mode"], "left")
    if calibrator is None or sessions is None:
        return out
    practice = sessions.where(F.upper("session").like("FP%")).select("session_id")
    projected = iv.apply_calibrator(calibrator, ss.mode_rates(fit).join(practice, "session_id", "left_semi")).select(
        *KEYS, "mode", "expected_rate", F.col("low").alias("race_low"), F.col("high").alias("race_high")
    )
    return out.join(projected, [*KEYS, "mode"], "left")


def confounder_shift(fit: DataFrame, priors=None) -> DataFrame:
    """Posterior against prior for load and drift, in prior standard deviations."""
    p = priors or ss.Priors()
    prior = {"load": (p.load_mean, p.load_sd), "drift": (p.drift_mean, p.drift_sd), "interference": (0.0, p.interference_sd)}
    mean, sd = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, (m, s) in prior.items():
        mean = F.when(F.col("name") == name, m).otherwise(mean)
        sd = F.when(F.col("name") == name, s).otherwise(sd)
    return ss.coefficients(fit).withColumn("prior_mean", mean).withColumn("prior_sd", sd).withColumn(
        "shift", (F.col("mean") - F.col("prior_mean")) / F.col("prior_sd")
    ).withColumn("sd_ratio", F.col("sd") / F.col("prior_sd"))


def lap_table(fit: DataFrame, smoothed=True) -> DataFrame:
    """Per-lap state, with hindsight or as known at the lap."""
    s = "" if smoothed else "_f"
    return ss.lap_states(fit).select(
        *KEYS, "asset", "seq", "run_id", "mode", "age", F.col(f"level{s}").alias("level"), F.col(f"level{s}_sd").alias("level_sd"),
        F.col(f"rate{s}").alias("rate"), F.col(f"rate{s}_sd").alias("rate_sd"),
    )


def corrected_laps(fit: DataFrame) -> DataFrame:
    """Fitted laps with load, drift and interference taken out of perf."""
    states = ss.lap_states(fit).withColumnRenamed("drift", "track_effect")
    return shapes.corrected(states, load="load", drift="track_effect", interference="coefficient")


def runs_with_shape(fit: DataFrame) -> DataFrame:
    """Run summaries, longest first, with the shape of the corrected wear curve and its sentence."""
    laps = corrected_laps(fit)
    keys = ["session_id", "asset", "run_id"]
    summary = rates.run_summary(laps, [*keys, "mode"])
    shaped = shapes.curve_shapes(laps, keys)
    return summary.join(shaped.drop("n_laps"), keys, "left").withColumn(
        "text", F.when(F.col("regime").isNotNull(), narrate.shape_text())
    ).orderBy(F.desc("laps"), *keys)


def narration(fit: DataFrame) -> DataFrame:
    """Both sentences for every lap: what changed since the run began, and what is left."""
    states = ss.lap_states(fit)
    why = at.decompose(states).select(*KEYS, "asset", "seq", narrate.decomposition_text().alias("explanation"))
    left = at.competitive_life(states).select(*KEYS, "asset", "seq", narrate.projection_text().alias("outlook"))
    return why.join(left, [*KEYS, "asset", "seq"])


def trust(laps: DataFrame, fit: DataFrame) -> DataFrame:
    """Per session and mode: consensus of the estimators and how well the mode is covered."""
    models = ss.mode_rates(fit).where("variant = 'default'").select("session_id", "mode", F.lit("statespace").alias("model"), "rate", "rate_sd")
    for name, table in (("raw line", rates.ols_by_mode(laps)), ("corrected line", rates.ols_corrected(laps))):
        models = models.unionByName(table.where("slope_se IS NOT NULL").select(
            "session_id", "mode", F.lit(name).alias("model"), F.col("slope").alias("rate"), F.col("slope_se").alias("rate_sd")))
    agreed = st.consensus(models, ("session_id", "mode")).withColumn("text", narrate.consensus_text())
    asked = laps.groupBy("session_id", "mode").agg(F.max("age").alias("age"), F.avg("interference").alias("interference"))
    covered = st.applicability(laps, asked).select("session_id", "mode", "applicability", "risk")
    return agreed.join(covered, ["session_id", "mode"])


def trust_regimes(states: DataFrame, longest=10) -> DataFrame:
    """How the longest runs of every session were operated."""
    from pyspark.sql import Window

    order = Window.partitionBy(*KEYS).orderBy(F.desc("laps"), "asset", "run_id")
    return at.stint_regimes(states).withColumn("position", F.row_number().over(order)).where(F.col("position") <= longest)


def measurement_value(rates_: DataFrame, signals) -> DataFrame:
    """What else to measure, per session, from the uncertainty of its mode rates."""
    return st.value_of_information(rates_, signals, ("session_id",))


def event_validation(compared: DataFrame, asked: DataFrame) -> DataFrame:
    """Transfer report of the events whose recorded name matches the asked one."""
    from wearframe.sources.laps import match_events

    report = st.validation_report(compared, ("year", "event"))
    hits = match_events(asked, report.select("year", F.col("event").alias("recorded")).distinct())
    return hits.join(report.withColumnRenamed("event", "recorded"), ["year", "recorded"])


def mean_rate_trace(states: DataFrame) -> DataFrame:
    """Mean current rate over assets per mode and seq."""
    return states.groupBy("session_id", "seq", "mode").agg(F.avg("rate").alias("mean_rate"), F.count(F.lit(1)).alias("n"))
