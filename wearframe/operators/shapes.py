"""Shape of a unit's wear curve: straight line against a continuous broken stick."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearframe.operators import slices
from wearframe.operators.staging import spread, stage
from wearframe.operators.stats import wilcoxon

MIN_SEGMENT = 4
MIN_LAPS = 3 * MIN_SEGMENT
MEANINGFUL_DELTA = 0.02
WARMUP_SLOPE = 0.005
FIT_FRACTION = 0.7


def corrected(laps: DataFrame, load=0.081, drift="track_effect", interference=None) -> DataFrame:
    """perf with load, drift and interference taken out.

    ``load`` and ``interference`` are numbers or column names.
    """
    as_col = lambda v: F.col(v) if isinstance(v, str) else F.lit(v)
    out = F.col("perf") + as_col(load) * F.col("elapsed")
    if drift in laps.columns:
        out = out - F.coalesce(drift, F.lit(0.0))
    if interference is not None:
        out = out - as_col(interference) * F.col("interference")
    return laps.withColumn("corrected", out)


def bic(rss, n, k):
    """Gaussian BIC, infinite without residual freedom."""
    return F.when((rss > 0) & (n > k), n * F.log(rss / n) + k * F.log(n.cast("double"))).otherwise(F.lit(float("inf")))


def fit_sticks(rows: DataFrame, keys, x="age", y="corrected", width=1024) -> DataFrame:
    """Line and best broken stick per group.

    Every age at least 4 inside both ends is tried as the break. The sums a
    break needs are suffix sums over the ages beyond it, so one ordered pass
    serves all breaks and nothing is paired. Ties keep the lowest break.
    """
    keys = list(keys)
    good = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(y)).select(
        *keys, F.col(x).alias("_x"), F.col(y).alias("_y"), (-F.floor(F.col(x) / width)).cast("long").alias("_slice"))
    # written narrow and by slices of groups, so that what made the rows runs once and a file's sums are as few as its slices
    good = stage(spread(good, *keys, "_slice"))
    line = good.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("_x").alias("x0"), F.max("_x").alias("x1"), F.avg("_y").alias("ybar"),
        F.avg("_x").alias("xbar"), F.regr_sxx("_y", "_x").alias("sxx"), F.regr_sxy("_y", "_x").alias("sxy"), F.regr_syy("_y", "_x").alias("syy"),
    )
    line = line.withColumn("lin_slope", F.try_divide("sxy", "sxx")).withColumn(
        "lin_rss", F.greatest(F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), "sxx"), F.lit(0.0))
    )
    # one row per group, read twice below
    line = stage(line)
    # the line's facts go to the slices, so rows stay where their slice is until one row a slice is left
    facts = good.select(*keys, "_slice").distinct().join(line.select(*keys, "n", "x0", "x1", "xbar", "ybar", "sxx", "sxy", "syy"), keys)
    met = good.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in [*keys, "_slice"]]))
    ages = spread(met, *keys, "_slice").groupBy(*keys, "_slice", "_x").agg(F.count(F.lit(1)).cast("double").alias("_m"), F.sum("_y").alias("_y"))
    u = F.col("_x") - F.col("x0")
    dev = F.col("_y") - F.col("_m") * F.col("ybar")
    ages = ages.join(facts, [*keys, "_slice"]).select(
        *keys, "_x", "_slice", "n", "x0", "x1", "xbar", "ybar", "sxx", "sxy", "syy", u.alias("_u"),
        F.col("_m").alias("_s0"), (F.col("_m") * u).alias("_s1"), (F.col("_m") * u * u).alias("_s2"),
        dev.alias("_y0"), (dev * u).alias("_y1"),
    )
    parts = ("_s0", "_s1", "_s2", "_y0", "_y1")
    # running from the far end gives the sums over ages beyond each break, itself included with weight zero
    sums = slices.running(
        ages, keys, "_slice", [F.desc("_x")], {f"t{p}": F.col(p) for p in parts}
    )
    tries = sums.where(F.col("_x").between(F.col("x0") + MIN_SEGMENT, F.col("x1") - MIN_SEGMENT))
    k = F.col("_u")
    h1 = F.col("t_s1") - k * F.col("t_s0")
    h2 = F.col("t_s2") - 2 * k * F.col("t_s1") + k * k * F.col("t_s0")
    uh = F.col("t_s2") - k * F.col("t_s1")
    n, ubar = F.col("n"), F.col("xbar") - F.col("x0")
    sah = uh - ubar * h1
    shh = h2 - h1 * h1 / n
    shy = F.col("t_y1") - k * F.col("t_y0")
    tries = tries.withColumn("_sah", sah).withColumn("_shh", shh).withColumn("_shy", shy).withColumn(
        "_det", F.col("sxx") * F.col("_shh") - F.col("_sah") * F.col("_sah")
    ).withColumn("b", F.try_divide(F.col("sxy") * F.col("_shh") - F.col("_shy") * F.col("_sah"), "_det")).withColumn(
        "d", F.try_divide(F.col("_shy") * F.col("sxx") - F.col("sxy") * F.col("_sah"), "_det")
    ).withColumn("rss", F.greatest(F.col("syy") - F.col("b") * F.col("sxy") - F.col("d") * F.col("_shy"), F.lit(0.0))).withColumn(
        "c", F.col("ybar") - F.col("b") * F.col("xbar") - F.col("d") * h1 / n
    )
    best = tries.groupBy(*keys).agg(
        F.min_by(F.struct(F.col("_x").alias("tau"), "b", "d", "c", "rss"), F.struct(F.round("rss", 9), F.col("_x"))).alias("_best")
    )
    return line.join(best, keys, "left").select(
        *keys, "n", "x0", "x1", "lin_slope", (F.col("ybar") - F.col("lin_slope") * F.col("xbar")).alias("lin_intercept"), "lin_rss",
        *[F.col(f"_best.{c}").alias(f"stick_{c}") for c in ("tau", "b", "d", "c", "rss")],
    )


def curve_shapes(laps: DataFrame, keys=("session_id", "asset", "run_id"), x="age", y="corrected") -> DataFrame:
    """Regime of each run of at least 12 laps: linear, warm-up, cliff or recovery."""
    fit = fit_sticks(laps, keys, x, y).where((F.col("n") >= MIN_LAPS) & (F.col("x1") - F.col("x0") >= MIN_SEGMENT))
    fit = fit.withColumn("linear_bic", bic(F.col("lin_rss"), F.col("n"), 3)).withColumn(
        "broken_bic", F.when(F.col("stick_tau").isNull(), F.lit(float("inf"))).otherwise(bic(F.col("stick_rss"), F.col("n"), 5))
    )
    b, d = F.col("stick_b"), F.col("stick_d")
    regime = (
        F.when(F.col("broken_bic") >= F.col("linear_bic"), "linear")
        .when(d < -MEANINGFUL_DELTA, "recovery")
        .when((b < -WARMUP_SLOPE) & (d > MEANINGFUL_DELTA), "warm-up")
        .when(d > MEANINGFUL_DELTA, "cliff")
        .otherwise("linear")
    )
    fit = fit.withColumn("regime", regime)
    bent = F.col("regime") != "linear"
    return fit.select(
        *keys, "regime", F.col("n").alias("n_laps"),
        F.when(bent, b).otherwise(F.col("lin_slope")).alias("slope"),
        F.when(bent, F.col("stick_tau")).alias("changepoint"),
        F.when(bent, d).alias("delta"),
        F.when(bent, b + d).alias("slope_after"),
        F.when(bent, (F.col("stick_tau") - F.col("x0")) / F.greatest(F.col("x1") - F.col("x0"), F.lit(1e-9))).alias("position"),
        "linear_bic", "broken_bic",
        F.sqrt(F.when(bent, F.col("stick_rss")).otherwise(F.col("lin_rss")) / F.col("n")).alias("rmse"),
    )


def curve_forecast(laps: DataFrame, keys=("session_id", "asset", "run_id"), x="age", y="corrected", fraction=FIT_FRACTION,
                   width=1024) -> DataFrame:
    """Both shapes fitted on the opening share of each run and scored on the rest."""
    keys = list(keys)
    rows = laps.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"), F.floor(F.col(x) / width).cast("long").alias("_slice"))
    placed = slices.positions(rows, keys, "_slice", ["_x", "_y"], name="_p", extra={"_n": (F.count(F.lit(1)), F.sum)})
    cut = F.floor(F.col("_n") * F.lit(fraction))
    placed = placed.where(F.col("_n") >= MIN_LAPS).withColumn("_cut", cut).where(
        (F.col("_cut") >= 2 * MIN_SEGMENT) & (F.col("_n") - F.col("_cut") >= 2)
    )
    fit = fit_sticks(placed.where(F.col("_p") <= F.col("_cut")), keys, "_x", "_y").where("stick_tau IS NOT NULL")
    test = placed.where(F.col("_p") > F.col("_cut")).join(fit, keys)
    line = F.col("lin_intercept") + F.col("lin_slope") * F.col("_x")
    stick = F.col("stick_c") + F.col("stick_b") * F.col("_x") + F.col("stick_d") * F.greatest(F.col("_x") - F.col("stick_tau"), F.lit(0.0))
    return test.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_forecast"),
        F.avg(F.abs(line - F.col("_y"))).alias("linear_mae"), F.avg(F.abs(stick - F.col("_y"))).alias("stick_mae"),
        F.avg(line - F.col("_y")).alias("linear_bias"), F.avg(stick - F.col("_y")).alias("stick_bias"),
    )


def regime_census(shapes: DataFrame) -> DataFrame:
    """Share of each regime and its medians."""
    keys = ["regime"]
    total = shapes.agg(F.count(F.lit(1))).scalar()
    out = shapes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / total)
    for column in ("slope", "delta", "changepoint", "position"):
        out = out.join(slices.exact_median(shapes, keys, column, f"median_{column}"), keys, "left")
    return out


def cliff_census(shapes: DataFrame, min_n=8, by="mode") -> DataFrame:
    """Where cliffs set in per mode: median and interquartile range of the break."""
    cliffs = shapes.where("regime = 'cliff'")
    q = slices.exact_percentiles(cliffs, [by], "changepoint", {"q1": 0.25, "median_changepoint": 0.5, "q3": 0.75})
    deltas = slices.exact_median(cliffs, [by], "delta", "median_delta")
    return q.where(F.col("n_values") >= min_n).join(deltas, by).select(
        by, F.col("n_values").alias("n"), "median_changepoint", (F.col("q3") - F.col("q1")).alias("iqr"), "median_delta"
    )


def forecast_census(forecasts: DataFrame, shapes: DataFrame, keys=("session_id", "asset", "run_id"), min_n=10) -> DataFrame:
    """Forecast errors of both shapes by the regime the whole run shows, with a paired test."""
    rows = forecasts.join(shapes.select(*keys, "regime"), list(keys))
    scores = rows.groupBy("regime").agg(
        F.count(F.lit(1)).alias("n"), F.avg("linear_mae").alias("linear_mae"), F.avg("stick_mae").alias("stick_mae"),
        F.avg("linear_bias").alias("linear_bias"), F.avg("stick_bias").alias("stick_bias"),
    ).where(F.col("n") >= min_n)
    tests = wilcoxon(rows, "stick_mae", "linear_mae", ["regime"]).select("regime", F.col("p_value").alias("wilcoxon_p"))
    return scores.join(tests, "regime", "left")
