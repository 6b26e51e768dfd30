"""Fleets of run-to-failure assets: sensors to health, health to laps, remaining life."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearframe.operators import slices
from wearframe.operators import statespace as ss
from wearframe.operators.attribute import remaining_life as _remaining
from wearframe.operators.staging import stage


def condition_count(cycles: DataFrame) -> DataFrame:
    """Distinct operating conditions, settings rounded half to even."""
    return cycles.agg(F.count_distinct(F.struct(*[F.bround(f"setting_{i}") for i in (1, 2, 3)])).alias("n_conditions"))


def _sensors(cycles):
    return [c for c in cycles.columns if c.startswith("sensor_")]


def trending_sensors(train: DataFrame, min_abs=0.4, sensors=None) -> DataFrame:
    """Sensors whose reading follows age: mean over units of the in-unit correlation, strongest first.

    All correlations of a unit come from one aggregate; constant channels are skipped.
    """
    sensors = sensors or _sensors(train)
    per_unit = train.groupBy("unit").agg(F.map_from_arrays(
        F.array(*[F.lit(s) for s in sensors]),
        F.array(*[F.when(F.stddev_pop(s) >= 1e-9, F.corr("cycle", s)) for s in sensors]),
    ).alias("_r"))
    return (
        per_unit.select(F.explode("_r").alias("sensor", "_c")).where("_c IS NOT NULL AND NOT isnan(_c)")
        .groupBy("sensor").agg(F.abs(F.avg("_c")).alias("score"), F.count(F.lit(1)).alias("n_units"))
        .where(F.col("score") >= min_abs).orderBy(F.desc("score"), "sensor")
    )


def health_index(frame: DataFrame, sensors, reference: DataFrame | None = None, head=20, tail=20, scale_from="frame") -> DataFrame:
    """One health signal in [0, 1] per row from the chosen sensors, 1 as new.

    Sensors are standardised against the reference's opening rows and turned so
    that growing means worse. The range comes from the 98th percentile of the
    damage, of the scored frame or of the reference. Rows carry ``cycle`` and
    ``n_cycles`` (position and length of their unit).
    """
    sensors = list(sensors)
    # written once, for the reference, the range and the scored rows are passes of their own
    frame = stage(frame)
    reference = frame if reference is None else stage(reference)
    early, late = F.col("cycle") <= head, F.col("cycle") > F.col("n_cycles") - tail
    facts = []
    for s in sensors:
        facts += [F.avg(F.when(early, F.col(s))).alias(f"{s}_m"), F.stddev_samp(s).alias(f"{s}_s"), F.avg(F.when(late, F.col(s))).alias(f"{s}_l")]
    # three numbers per sensor; as constants they keep the scoring a plain projection
    ref = reference.agg(*facts).first()

    def damaged(df):
        parts = []
        for s in sensors:
            m, sd, l = (ref[f"{s}_{k}"] for k in ("m", "s", "l"))
            flat = sd is None or sd < 1e-9
            parts.append(F.lit(0.0) if flat else (F.col(s) - F.lit(m)) / F.lit(sd) * F.lit(-1.0 if l < m else 1.0))
        return df.withColumn("damage", sum(parts[1:], parts[0]) / len(parts))

    scored = damaged(frame)
    base = scored if scale_from == "frame" else damaged(reference)
    row = slices.exact_percentiles(base.withColumn("_a", F.abs("damage")), [], "_a", {"p": 0.98}).first()
    scale = (row.p if row else None) or 1.0
    return scored.withColumn("health", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("damage") / F.lit(2.0 * scale))))


def failure_level(health: DataFrame, head=5, tail=3) -> DataFrame:
    """Health lost between the first and last cycles of run-to-failure units."""
    early, late = F.col("cycle") <= head, F.col("cycle") > F.col("n_cycles") - tail
    return health.agg((F.avg(F.when(early, F.col("health"))) - F.avg(F.when(late, F.col("health")))).alias("failure_level"))


def to_observations(health: DataFrame, max_units=0) -> DataFrame:
    """Scored cycles as generic observations; the mode is the rounded operating condition."""
    rows = health
    if max_units:
        units = health.select("unit").distinct().orderBy("unit").limit(max_units)
        rows = health.join(units, "unit", "left_semi")
    code = lambda s: F.bround(s).cast("int").cast("string")
    return rows.select(
        F.col("unit").alias("asset_id"), F.col("unit").alias("unit_id"), F.col("cycle").alias("sequence"), F.col("cycle").cast("double").alias("age"),
        F.col("health").alias("performance"), F.concat_ws("_", F.lit("cond"), code("setting_3"), code("setting_1")).alias("mode"),
        (F.col("cycle") - 1).cast("double").alias("elapsed_in_run"),
    )


def to_laps(observations: DataFrame, is_cost: bool) -> DataFrame:
    """Any asset's observations on the lap schema; a signal that falls with wear is turned over.

    Optional columns (interference) default to 0.
    """
    sign = 1.0 if is_cost else -1.0
    extra = F.coalesce("interference", F.lit(0.0)) if "interference" in observations.columns else F.lit(0.0)
    session = F.col("session_id") if "session_id" in observations.columns else F.lit(0).cast("long")
    return observations.select(
        session.alias("session_id"), F.col("asset_id").alias("asset"), F.col("sequence").alias("seq"), F.col("unit_id").alias("run_id"),
        "age", F.col("elapsed_in_run").alias("elapsed"), (F.lit(sign) * F.col("performance")).alias("perf"), "mode", extra.alias("interference"),
        F.col("sequence").alias("event_id"),
    )


#: Priors of the fleet model: no load gain, little drift, health per cycle; fixed values.
FLEET = {"load_mean": 0.0, "load_sd": 1e-4, "drift_mean": 0.0, "drift_sd": 1e-3, "rate_mean": 0.002, "rate_sd": 0.005, "level_sd": 0.02, "intercept_sd": 1.0}


def remaining_life(observations: DataFrame, failure: DataFrame, together=25, cap=125.0) -> DataFrame:
    """Fit the fleet, ``together`` whole units to a model as the method is defined, and extrapolate every unit to the failure level."""
    units = observations.select("asset_id").distinct().withColumn("_s", F.floor(F.col("asset_id") / 1024)).withColumn("_all", F.lit(0))
    group = slices.positions(units, ["_all"], "_s", ["asset_id"], name="_k").select("asset_id", F.floor((F.col("_k") - 1) / together).cast("long").alias("session_id"))
    fit = ss.fit_sessions(to_laps(observations.drop("session_id").join(group, "asset_id"), is_cost=False), {"fleet": FLEET})
    # of a lap's forty columns, those that the last rows and the fleet's rate are read from
    fit = stage(fit.select(*ss.FIT_KEYS, "kind", "mode", "asset", "seq", "level", "rate", "coef", "coef_sd"))
    fleet_rate = ss.mode_rates(fit).agg(F.avg("rate"))
    return _remaining(ss.lap_states(fit), fleet_rate, failure, cap)


def with_truth(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Predictions with the known remaining life of their unit."""
    return predicted.join(truth.select(F.col("unit").alias("asset"), F.col("rul").alias("actual")), "asset").withColumn(
        "error", F.col("predicted") - F.col("actual")
    )


def rul_scores(cases: DataFrame) -> DataFrame:
    """RMSE, MAE, share predicted early, and the asymmetric exponential score, a sum over units."""
    e = F.col("error")
    return cases.agg(
        F.count(F.lit(1)).alias("n_units"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.avg((e < 0).cast("double")).alias("early_share"), F.sum(F.when(e < 0, F.exp(-e / 13) - 1).otherwise(F.exp(e / 10) - 1)).alias("score"),
    )
