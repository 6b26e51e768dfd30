"""What a fitted session says about single laps: causes, alternatives, outlook."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearframe.functions import gaussian
from wearframe.operators import slices
from wearframe.operators.rates import with_reference

KEYS = ("session_id", "variant")
TERMS = ("tyre", "load", "drift", "interference")
THRESHOLD = 0.8


def curvature_share(levels: DataFrame, by=("session_id",), run="run_id", min_laps=5, min_span=2.0) -> DataFrame:
    """Share of the level's variance that a straight line in age does not explain, over runs."""
    runs = levels.groupBy(*by, run).agg(
        F.count(F.lit(1)).alias("n"), (F.max("age") - F.min("age")).alias("span"),
        F.regr_syy("level", "age").alias("syy"), F.regr_sxy("level", "age").alias("sxy"), F.regr_sxx("level", "age").alias("sxx"),
    ).where((F.col("n") >= min_laps) & (F.col("span") >= min_span))
    left = F.sum((F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")) / F.col("n"))
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_runs"), F.try_divide(left, F.sum(F.col("syy") / F.col("n"))).alias("nonlinear_share")
    ).withColumn("linear_share", 1 - F.col("nonlinear_share"))


def decompose(states: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """Each lap's change against its reference lap, split into causes that add up with the residual.

    The reference is the first lap of the run unless named. ``contributions``
    lists the causes by absolute size; ``tyre_share`` is null unless the lap
    was slower.
    """
    values = ("perf", "age", "elapsed", "interference", "level", "level_sd", "drift_basis", "drift_resid")
    rows = with_reference(states, reference, run=(*KEYS, "asset", "run_id"), values=values)
    d = lambda c: F.col(c) - F.col(f"ref_{c}")
    seconds = {
        "tyre": d("level"), "load": -F.col("load") * d("elapsed"),
        "drift": d("drift_basis") * F.col("amplitude") + d("drift_resid"), "interference": F.col("coefficient") * d("interference"),
    }
    spread = {
        "tyre": F.hypot("level_sd", "ref_level_sd"), "load": F.abs(d("elapsed")) * F.col("load_sd"),
        "drift": F.abs(d("drift_basis")) * F.col("amplitude_sd"), "interference": F.abs(d("interference")) * F.col("coefficient_sd"),
    }
    rows = rows.select(
        *KEYS, "asset", "seq", "ref_seq", "run_id", "mode", "age", d("perf").alias("delta"),
        *[seconds[t].alias(t) for t in TERMS], *[spread[t].alias(f"{t}_sd") for t in TERMS],
    )
    rows = rows.withColumn("confounders", F.col("load") + F.col("drift") + F.col("interference"))
    rows = rows.withColumn("residual", F.col("delta") - F.col("tyre") - F.col("confounders")).withColumn(
        "tyre_share", F.when(F.col("delta") > 0, F.col("tyre") / F.col("delta"))
    )
    parts = F.array(*[F.struct(
        F.lit(t).alias("key"), F.col(t).alias("seconds"), F.col(f"{t}_sd").alias("sd"),
        (F.col(t) - 1.96 * F.col(f"{t}_sd")).alias("low"), (F.col(t) + 1.96 * F.col(f"{t}_sd")).alias("high"),
    ) for t in TERMS])
    bigger = lambda a, b: F.when(F.abs(a["seconds"]) > F.abs(b["seconds"]), -1).when(F.abs(a["seconds"]) < F.abs(b["seconds"]), 1).otherwise(0)
    return rows.withColumn("contributions", F.array_sort(parts, bigger)).select(
        *KEYS, "asset", "seq", "ref_seq", "run_id", "mode", "age", "delta", *TERMS, *[f"{t}_sd" for t in TERMS],
        "confounders", "residual", "tyre_share", "contributions",
    )


def counterfactuals(states: DataFrame) -> DataFrame:
    """Each lap without interference, on a fresh unit, and both; the actual perf stays as observed."""
    i_effect, i_sd = F.col("coefficient") * F.col("interference"), F.col("coefficient_sd") * F.abs("interference")
    options = F.array(
        F.struct(F.lit("clean_air").alias("scenario"), i_effect.alias("gain"), i_sd.alias("sd")),
        F.struct(F.lit("fresh_tyre").alias("scenario"), F.col("level").alias("gain"), F.col("level_sd").alias("sd")),
        F.struct(F.lit("clean_air_fresh_tyre").alias("scenario"), (i_effect + F.col("level")).alias("gain"), F.hypot(i_sd, F.col("level_sd")).alias("sd")),
    )
    return states.withColumn("_o", F.explode(options)).select(
        *KEYS, "asset", "seq", "mode", F.col("perf").alias("actual"), "_o.scenario",
        (F.col("perf") - F.col("_o.gain")).alias("estimate"), (-F.col("_o.gain")).alias("delta"), F.col("_o.sd").alias("sd"),
        (-F.col("_o.gain") - 1.96 * F.col("_o.sd")).alias("low"), (-F.col("_o.gain") + 1.96 * F.col("_o.sd")).alias("high"),
    )


def _outlook(states: DataFrame, horizon: int) -> DataFrame:
    oldest = states.groupBy(*KEYS, "mode").agg(F.max("age").alias("_oldest"))
    return states.join(oldest, [*KEYS, "mode"]).withColumn("_steps", F.sequence(F.lit(1), F.lit(horizon)))


def _loss(h):
    return F.col("level") + h * F.col("rate")


def _loss_var(h):
    return (
        F.col("level_sd") * F.col("level_sd") + h * h * F.col("rate_sd") * F.col("rate_sd") + 2 * h * F.col("level_rate_cov")
        + h * F.col("q_level") + h * h * h / 3 * F.col("q_rate")
    )


def project(states: DataFrame, horizon=20, threshold=THRESHOLD) -> DataFrame:
    """Loss, its spread, breach probability and applicability for every lap and step ahead."""
    rows = _outlook(states, horizon).withColumn("h", F.explode("_steps")).withColumn("_h", F.col("h").cast("double"))
    rows = rows.withColumn("loss", _loss(F.col("_h"))).withColumn("loss_sd", F.sqrt(F.greatest(_loss_var(F.col("_h")), F.lit(0.0))))
    rows = rows.withColumn("_z", (F.col("loss") - F.lit(threshold)) / F.greatest("loss_sd", F.lit(1e-9)))
    over = F.greatest(F.col("age") + F.col("_h") - F.col("_oldest"), F.lit(0.0))
    return rows.select(
        *KEYS, "asset", "seq", "run_id", "mode", "age", "h", "loss", "loss_sd", "rate",
        F.sqrt(F.greatest(F.col("rate_sd") * F.col("rate_sd") + F.col("_h") * F.col("q_rate"), F.lit(0.0))).alias("rate_sd"),
        gaussian.cdf("_z").alias("breach_probability"), F.exp(-over / 5).alias("applicability"),
    )


def competitive_life(states: DataFrame, horizon=20, threshold=THRESHOLD, levels=(0.2, 0.5, 0.8)) -> DataFrame:
    """Steps until the breach probability reaches each level; the horizon if it never does.

    p >= c is the same as loss - threshold >= ppf(c) * sd, so no probability is
    evaluated and no row is exploded.
    """
    rows = _outlook(states, horizon)

    def life(c):
        z = gaussian.ppf(c)

        def reached(h):
            step = h.cast("double")
            sd = F.greatest(F.sqrt(F.greatest(_loss_var(step), F.lit(0.0))), F.lit(1e-9))
            return _loss(step) - F.lit(threshold) >= F.lit(z) * sd

        return F.coalesce(F.try_element_at(F.filter("_steps", reached), F.lit(1)), F.lit(horizon)).cast("double")

    over = F.greatest(F.col("age") + horizon - F.col("_oldest"), F.lit(0.0))
    names = {0.2: "life_low", 0.5: "life", 0.8: "life_high"}
    return rows.select(
        *KEYS, "asset", "seq", "run_id", "mode", "age", *[life(c).alias(names.get(c, f"life_{c}")) for c in levels],
        F.exp(-over / 5).alias("end_applicability"), F.lit(float(threshold)).alias("threshold"),
    )


def health(level: str = "level"):
    """0-100 rescaling of the level: 100 fresh, 0 at a loss of 1.5."""
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * (1.0 - F.col(level) / 1.5)))
    return F.when(F.col(level).isNotNull(), scaled)


def health_timeline(states: DataFrame) -> DataFrame:
    """Per lap of each run: state and health."""
    return states.select(*KEYS, "asset", "run_id", "seq", "age", "level", "level_sd", "rate", "rate_sd", health().alias("health"))


def stint_regimes(states: DataFrame, width=256) -> DataFrame:
    """How each run was operated, read off its mean rate, rate trend and interference."""
    keys = [*KEYS, "asset", "run_id"]
    placed = slices.positions(
        states.withColumn("_slice", F.floor(F.col("age") / width).cast("long")), keys, "_slice", ["age", "seq"], name="_i"
    )
    facts = placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("laps"), F.avg("rate").alias("mean_rate"),
        F.regr_slope("rate", F.col("_i").cast("double")).alias("rate_trend"), F.avg("interference").alias("mean_interference"),
    )
    i, t, r = F.col("mean_interference"), F.col("rate_trend"), F.col("mean_rate")
    one = F.lit(1.0)
    sparse = F.col("laps") < 4
    regime = (
        F.when(sparse, "sparse data").when(i > 0.35, "traffic limited").when(t > 0.004, "cliff").when(r < -0.01, "recovering")
        .when(r > 0.15, "high degradation").otherwise("clean running")
    )
    sure = (
        F.when(sparse, 1.0).when(i > 0.35, F.least(i / 0.6, one)).when(t > 0.004, F.least(t / 0.01, one))
        .when(r < -0.01, F.least(F.abs(r) / 0.05, one)).when(r > 0.15, F.least(r / 0.25, one)).otherwise(0.8)
    )
    return facts.withColumn("regime", regime).withColumn("confidence", sure)


def peel_away(decomposed: DataFrame, removed) -> DataFrame:
    """Observed change with the chosen causes taken out, one step at a time."""
    out = decomposed.withColumn("step_0", F.col("delta"))
    left = F.col("delta")
    for k, term in enumerate(removed, start=1):
        left = left - F.col(term)
        out = out.withColumn(f"step_{k}", left)
    return out.select(*KEYS, "asset", "seq", *[f"step_{k}" for k in range(len(removed) + 1)])


def remaining_life(states: DataFrame, fleet_rate: DataFrame, failure_level: DataFrame, cap=125.0, min_cycles=10) -> DataFrame:
    """Cycles left per unit: (failure level - level) / rate at its last row, within [0, cap].

    A unit not yet degrading takes the fleet rate. ``fleet_rate`` and
    ``failure_level`` are one-value frames.
    """
    last = states.groupBy("asset").agg(
        F.count(F.lit(1)).alias("n_cycles"), F.max_by(F.struct("level", "rate"), "seq").alias("_l")
    ).where(F.col("n_cycles") >= min_cycles)
    rate = F.when(F.col("_l.rate") > 1e-6, F.col("_l.rate")).otherwise(F.coalesce(F.nullif(F.abs("_fleet"), F.lit(0.0)), F.lit(0.002)))
    left = (F.col("_fail") - F.col("_l.level")) / rate
    return last.withColumn("_fleet", fleet_rate.scalar()).withColumn("_fail", failure_level.scalar()).select(
        "asset", "n_cycles", F.col("_l.level").alias("level"), F.col("_l.rate").alias("rate"),
        F.greatest(F.lit(0.0), F.least(F.lit(cap), left)).alias("predicted"),
    )
