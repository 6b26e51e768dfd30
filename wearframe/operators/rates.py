"""Degradation rates and run summaries straight from the lap table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearframe.operators import slices

#: Cost gained per unit of load used up; fixed physical value.
LOAD_SLOPE = 0.081


def run_slopes(laps: DataFrame, keys=("session_id", "asset", "run_id", "mode"), y="perf", x="age",
               min_laps=3, min_span=0.0) -> DataFrame:
    """Least-squares slope per run, for runs with enough laps and age spread."""
    span = F.max(x) - F.min(x)
    enough = (F.col("n_laps") >= min_laps) & (
        F.col("span") > 0 if min_span <= 0 else F.col("span") >= min_span
    )
    return (
        laps.groupBy(*keys)
        .agg(F.regr_slope(y, x).alias("slope"), F.count(F.lit(1)).alias("n_laps"), span.alias("span"))
        .where(enough)
    )


def naive_rates(laps: DataFrame, by=("session_id",)) -> DataFrame:
    """Unweighted mean over runs of the raw perf-on-age slope, per mode."""
    slopes = run_slopes(laps, [*by, *[k for k in ("run_id", "mode") if k not in by]])
    return slopes.groupBy(*by, "mode").agg(
        F.avg("slope").alias("rate"), F.count(F.lit(1)).alias("n_runs"), F.sum("n_laps").alias("n_laps")
    )


def naive_failures(rates: DataFrame, session="session_id") -> DataFrame:
    """How often the naive rate is negative: per session first, then overall."""
    per_session = rates.groupBy(session).agg(
        F.count("rate").alias("n_modes"), F.count_if(F.col("rate") < 0).alias("n_negative")
    ).where("n_modes > 0")
    return per_session.agg(
        F.count(F.lit(1)).alias("n_sessions"),
        F.count_if(F.col("n_negative") > 0).alias("n_sessions_negative"),
        F.sum("n_modes").alias("n_mode_stints"),
        F.sum("n_negative").alias("n_negative_mode_stints"),
    ).select(
        "*",
        F.try_divide("n_sessions_negative", "n_sessions").alias("session_failure_rate"),
        F.try_divide("n_negative_mode_stints", "n_mode_stints").alias("stint_failure_rate"),
    )


def ols_by_mode(laps: DataFrame, by=("session_id",), y="perf", x="age") -> DataFrame:
    """Line per mode with slope standard error, and the pooled residual sd per group.

    Fewer than 3 laps or no age spread gives slope 0, the mean as intercept and
    no standard error; such modes add nothing to the residual sd.
    """
    sums = laps.groupBy(*by, "mode").agg(
        F.count(y).alias("n"),
        F.avg(y).alias("mean_y"),
        F.regr_slope(y, x).alias("_b"),
        F.regr_intercept(y, x).alias("_a"),
        F.regr_sxx(y, x).alias("_sxx"),
        F.regr_syy(y, x).alias("_syy"),
        F.regr_sxy(y, x).alias("_sxy"),
    )
    return lines(sums, by)


def lines(sums: DataFrame, by) -> DataFrame:
    """Lines from one row of moments per (by, mode): n, mean_y, _a, _b, _sxx, _syy, _sxy."""
    usable = (F.col("n") >= 3) & (F.col("_sxx") > 0)
    rss = F.greatest(F.col("_syy") - F.try_divide(F.col("_sxy") * F.col("_sxy"), "_sxx"), F.lit(0.0))
    per_mode = sums.select(
        *by, "mode", "n",
        F.when(usable, F.col("_b")).otherwise(0.0).alias("slope"),
        F.when(usable, F.col("_a")).otherwise(F.col("mean_y")).alias("intercept"),
        F.when(usable, F.sqrt(F.try_divide(rss / F.greatest(F.col("n") - 2, F.lit(1)), "_sxx"))).alias("slope_se"),
        F.when(usable, rss).alias("_rss"),
        F.when(usable, F.col("n")).alias("_m"),
    )
    pooled = per_mode.groupBy(*by).agg(F.try_divide(F.sum("_rss"), F.sum("_m")).alias("_var"))
    return per_mode.join(pooled, list(by)).select(
        *by, "mode", "n", "slope", "intercept", "slope_se",
        F.coalesce(F.sqrt("_var"), F.lit(1.0)).alias("sd"),
    )


def ols_corrected(laps: DataFrame, by=("session_id",), slope=LOAD_SLOPE) -> DataFrame:
    """The same lines after adding the known load gain back."""
    return ols_by_mode(laps.withColumn("perf", F.col("perf") + F.lit(slope) * F.col("elapsed")), by)


def run_summary(laps: DataFrame, keys=("session_id", "asset", "run_id", "mode")) -> DataFrame:
    """Per run: laps, first and last seq, ages, median perf."""
    medians = slices.exact_median(laps, keys, "perf", "median_perf")
    return (
        laps.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("laps"),
            F.min("seq").alias("start_seq"),
            F.max("seq").alias("end_seq"),
            F.min("age").alias("start_age"),
            F.max("age").alias("end_age"),
        )
        .join(medians, list(keys))
    )


def longest_runs(laps: DataFrame, k=10, min_laps=0, keys=("session_id", "asset", "run_id", "mode")) -> DataFrame:
    """The k longest runs, ties by key."""
    runs = laps.groupBy(*keys).agg(F.count(F.lit(1)).alias("laps"))
    return runs.where(F.col("laps") >= min_laps).orderBy(F.desc("laps"), *keys).limit(k)


def stint_profile(laps: DataFrame, by=("session_id",), min_laps=4) -> DataFrame:
    """Per mode: runs of at least ``min_laps``, their lengths, interference, runs per asset."""
    runs = laps.groupBy(*by, "asset", "run_id", "mode").agg(
        F.count(F.lit(1)).alias("n"), F.avg("interference").alias("_i")
    ).where(F.col("n") >= min_laps)
    return runs.groupBy(*by, "mode").agg(
        F.count(F.lit(1)).alias("n_stints"),
        F.avg("n").alias("mean_length"),
        F.max("n").alias("max_length"),
        F.sum("n").alias("total_laps"),
        F.avg("_i").alias("mean_interference"),
        (F.count(F.lit(1)) / F.count_distinct("asset")).alias("stints_per_asset"),
    )


def mode_models(laps: DataFrame, rates: DataFrame, by=("session_id",)) -> DataFrame:
    """Per mode: fresh pace against the session median, rate, and the age a cliff is assumed at."""
    session_median = slices.exact_median(laps, by, "perf", "_session")
    fresh = slices.exact_percentiles(laps.where("age <= 3"), [*by, "mode"], "perf", {"_fresh": 0.5})
    oldest = laps.groupBy(*by, "mode").agg(F.max("age").alias("_max_age"))
    return (
        rates.join(oldest, [*by, "mode"])
        .join(session_median, list(by))
        .join(fresh, [*by, "mode"], "left")
        .select(
            *by, "mode", "rate", *(["rate_sd"] if "rate_sd" in rates.columns else []),
            F.when(F.col("n_values") >= 3, F.col("_fresh") - F.col("_session")).otherwise(0.0).alias("base_pace"),
            F.greatest(F.lit(0.85) * F.col("_max_age"), F.lit(8.0)).alias("cliff_age"),
        )
    )


def overview(rates: DataFrame, runs: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """Per session: modes with a negative naive rate, deepest age over modes, longest run of each shape."""
    deepest = (
        runs.groupBy("session_id", "mode").agg(F.max("end_age").alias("deepest"))
        .where("deepest >= 5").groupBy("session_id")
        .agg(F.max_by("mode", F.struct("deepest", "mode")).alias("deepest_mode"), F.max("deepest").alias("deepest_age"))
    )
    negative = rates.groupBy("session_id").agg(
        F.count_if(F.col("rate") < 0).alias("negative_modes"), F.count(F.lit(1)).alias("n_modes")
    )
    out = negative.join(deepest, "session_id", "left")
    if shapes is not None:
        bent = shapes.where("regime <> 'linear'").groupBy("session_id").agg(
            F.max_by("run_id", F.struct(F.col("n_laps"), -F.col("run_id"))).alias("longest_bent_run")
        )
        out = out.join(bent, "session_id", "left")
    return out


def collinearity(laps: DataFrame, keys=("session_id", "run_id"), min_laps=5) -> DataFrame:
    """Correlation of elapsed with age inside each run, and how far the centred columns differ."""
    stats = laps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.corr("elapsed", "age").alias("r"),
        F.max(F.col("age") - F.col("elapsed")).alias("_hi"), F.min(F.col("age") - F.col("elapsed")).alias("_lo"),
        F.avg(F.col("age") - F.col("elapsed")).alias("_mid"),
    ).where(F.col("n") >= min_laps)
    return stats.select(
        *keys, "n", "r",
        F.greatest(F.col("_hi") - F.col("_mid"), F.col("_mid") - F.col("_lo")).alias("max_deviation"),
        (F.col("r") > 1 - 1e-9).alias("is_exact"),
    )


def fisher(laps: DataFrame, sigma=0.25, prior_sd=0.016, by=("session_id",), run="run_id", min_laps=5) -> DataFrame:
    """Run-centred 2x2 information of (load, wear) slopes and the bounds it implies.

    The design columns are -elapsed and age. ``var_free`` is null where the
    matrix is singular; ``var_prior`` adds the prior precision of the load slope.
    """
    sums = laps.groupBy(*by, run).agg(
        F.regr_sxx("age", "elapsed").alias("ee"), F.regr_syy("age", "elapsed").alias("aa"),
        F.regr_sxy("age", "elapsed").alias("ea"), F.count(F.lit(1)).alias("n"),
    ).where(F.col("n") >= min_laps).groupBy(*by).agg(F.sum("ee").alias("_ee"), F.sum("aa").alias("_aa"), F.sum("ea").alias("_ea"))
    s2 = float(sigma) ** 2
    a, b, c = F.col("_ee") / s2, -F.col("_ea") / s2, F.col("_aa") / s2
    half, spread = (a + c) / 2, F.sqrt((a - c) * (a - c) / 4 + b * b)
    top, low = half + spread, half - spread
    det = a * c - b * b
    singular = low <= top * 1e-10
    prior = 1.0 / float(prior_sd) ** 2
    return sums.select(
        *by,
        a.alias("info_load"), b.alias("info_cross"), c.alias("info_wear"),
        top.alias("eig_max"),
        F.when(singular, F.lit(0.0)).otherwise(low).alias("eig_min"),
        F.when(singular, F.lit(1)).otherwise(F.lit(2)).alias("rank"),
        F.when(~singular, F.try_divide(a, det)).alias("var_free"),
        F.try_divide(a + prior, (a + prior) * c - b * b).alias("var_prior"),
        F.sqrt(F.try_divide(a + prior, (a + prior) * c - b * b)).alias("sd_prior"),
    )


def half_field(laps: DataFrame, session="session_id", asset="asset") -> DataFrame:
    """Laps of the first half of each session's assets by name, at least two."""
    names = laps.select(session, asset).distinct().withColumn("_s", F.floor(F.col(asset) / 1024))
    ranked = slices.positions(names, [session], "_s", [asset], name="_r", extra={"_n": (F.count(F.lit(1)), F.sum)})
    kept = ranked.where(F.col("_r") <= F.greatest(F.floor(F.col("_n") / 2), F.lit(2)))
    return laps.join(kept.select(session, asset), [session, asset], "left_semi")


def min_evidence(df: DataFrame, keys, n: int, spread: str | None = None, min_spread=0.0) -> DataFrame:
    """Rows of groups with at least ``n`` rows and, optionally, a minimum spread of one column."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    agg = [F.count(F.lit(1)).alias("_n")]
    if spread:
        agg.append((F.max(spread) - F.min(spread)).alias("_s"))
    good = df.groupBy(*keys).agg(*agg).where(F.col("_n") >= n)
    if spread:
        good = good.where(F.col("_s") >= min_spread)
    return df.join(good.select(*keys), keys, "left_semi")


def depth_cut(practice: DataFrame, race: DataFrame, keys=("session_id", "mode"), floor=4.0, q=0.9) -> DataFrame:
    """How deep both sides went per mode: practice_depth (oldest age), race_depth (q-th age) and depth, the lesser of the two, at least ``floor``."""
    keys = list(keys)
    deep = slices.exact_percentiles(race, keys, "age", {"race_depth": q}).select(*keys, "race_depth")
    seen = practice.groupBy(*keys).agg(F.max("age").alias("practice_depth"))
    return deep.join(seen, keys).withColumn("depth", F.least("race_depth", "practice_depth")).where(F.col("depth") >= floor)


def depth_window(practice: DataFrame, race: DataFrame, keys=("session_id", "mode"), floor=4.0, q=0.9) -> DataFrame:
    """Race laps no older than practice went: age <= min(q-th race age, oldest practice age) per mode."""
    keys = list(keys)
    cut = depth_cut(practice, race, keys, floor, q).select(*keys, "depth")
    return race.join(cut, keys).where(F.col("age") <= F.col("depth"))


def lap_at(laps: DataFrame, requests: DataFrame, keys=("session_id", "asset", "seq")) -> DataFrame:
    """Requested laps with a status: found, or no valid lap."""
    keys = list(keys)
    found = laps.join(requests.select(*keys).distinct(), keys, "left_semi")
    return requests.join(found, keys, "left").withColumn(
        "status", F.when(F.col("perf").isNull(), F.lit("no valid lap")).otherwise(F.lit("found"))
    )


def with_reference(laps: DataFrame, reference: DataFrame | None = None,
                   run=("session_id", "asset", "run_id"), seq="seq", values=("perf", "age", "elapsed")) -> DataFrame:
    """Attach each lap's reference lap as ref_* columns: the first lap of its run, or one named per lap.

    ``reference`` is (session_id, asset, seq, ref_seq). A reference on another
    run gives null ref_* columns and ``rejected`` true.
    """
    run = list(run)
    packed = F.struct(F.col(seq).alias(f"ref_{seq}"), *[F.col(v).alias(f"ref_{v}") for v in values])
    if reference is None:
        first = laps.groupBy(*run).agg(F.min_by(packed, F.col(seq)).alias("_ref"))
        return laps.join(first, run).select(*laps.columns, "_ref.*")
    named = laps.join(reference, ["session_id", "asset", seq], "left")
    target = laps.select(
        "session_id", "asset", F.col("run_id").alias("_ref_run"), F.col(seq).alias("ref_seq"),
        *[F.col(v).alias(f"ref_{v}") for v in values],
    )
    joined = named.join(target, ["session_id", "asset", "ref_seq"], "left")
    ok = F.col("_ref_run") == F.col("run_id")
    return joined.select(
        *laps.columns, "ref_seq",
        *[F.when(ok, F.col(f"ref_{v}")).alias(f"ref_{v}") for v in values],
        (~F.coalesce(ok, F.lit(False))).alias("rejected"),
    )


def sample_laps(laps: DataFrame, n: int, by=("session_id",), within=1.07, slice_col="seq",
                order=("asset", "start")) -> DataFrame:
    """About ``n`` quick laps per session, evenly spread in session order.

    Quick means within ``within`` times the session's best; every k-th one is taken.
    """
    by = list(by)
    best = laps.groupBy(*by).agg(F.min("perf").alias("_best"))
    quick = laps.join(best, by).where(F.col("perf") <= F.lit(within) * F.col("_best")).drop("_best")
    placed = slices.positions(
        quick, by, slice_col, list(order), name="_r", extra={"_n": (F.count(F.lit(1)), F.sum)}
    )
    step = F.greatest(F.floor(F.col("_n") / F.lit(n)), F.lit(1))
    taken = (F.col("_r") - 1) % step == 0
    return placed.where(taken & (F.floor((F.col("_r") - 1) / step) < n)).drop("_r", "_n")


def fastest_lap(laps: DataFrame, by=("session_id",)) -> DataFrame:
    """The quickest lap of each session, ties by asset and seq."""
    packed = F.struct(*[F.col(c) for c in laps.columns if c not in by])
    return laps.groupBy(*by).agg(F.min_by(packed, F.struct("perf", "asset", "seq")).alias("_l")).select(*by, "_l.*")


def duplicates(df: DataFrame, keys) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
