"""Forecast rungs over rolling folds, and their scores.

A rung takes the lap table and the fold edges and returns a forecast stream:
session_id, fold, seq, asset, actual, mean, sd, model, failed.
"""

import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearframe.functions import gaussian
from wearframe.operators import rates
from wearframe.operators.rates import LOAD_SLOPE
from wearframe.operators.staging import stage

STREAM = ("session_id", "fold", "seq", "asset", "event_id", "actual", "mean", "sd")


def _with_edges(laps: DataFrame, folds: DataFrame) -> DataFrame:
    """Laps with their session's handful of edges as one array, earliest cut first."""
    edges = folds.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("cut", "fold", "last"))).alias("_folds"))
    return laps.join(edges, "session_id")


def held_out(laps: DataFrame, folds: DataFrame) -> DataFrame:
    """Held-out rows with their fold; test spans do not overlap, so a row has one fold at most."""
    # exploded, not searched: the optimizer pushes a search of the array that looks at ``seq`` below the join, where there is none
    rows = _with_edges(laps, folds).withColumn("_f", F.explode("_folds")).where((F.col("seq") > F.col("_f.cut")) & (F.col("seq") <= F.col("_f.last")))
    return rows.withColumn("fold", F.col("_f.fold")).drop("_f", "_folds")


def train_sums(laps: DataFrame, folds: DataFrame, keys, partial, total) -> DataFrame:
    """Aggregates of every fold's training rows per (session, fold, keys).

    Training sets are nested: rows are summed once per span between two cuts
    (``partial``), and only those few sums are repeated for the folds that
    contain the span and combined (``total``).
    """
    span = F.size(F.filter("_folds", lambda f: f["cut"] < F.col("seq")))
    rows = _with_edges(laps, folds).withColumn("_span", span).where(F.col("_span") < F.size("_folds"))
    cells = rows.groupBy("session_id", "_span", *keys).agg(F.first("_folds").alias("_folds"), *partial)
    later = F.explode(F.slice("_folds", F.col("_span") + 1, F.size("_folds"))).alias("_f")
    return cells.select("*", later).withColumn("fold", F.col("_f.fold")).groupBy("session_id", "fold", *keys).agg(*total)


def in_folds(laps: DataFrame, folds: DataFrame):
    """(train, test) rows tagged with their fold, for rungs that need the training rows themselves."""
    rows = _with_edges(laps, folds)
    later = F.filter("_folds", lambda f: f["cut"] >= F.col("seq"))
    train = rows.withColumn("_f", F.explode(later)).select("*", F.col("_f.fold").alias("fold")).drop("_f", "_folds")
    return train, held_out(laps, folds)


def _stream(df, model, mean, sd):
    return df.select(
        "session_id", "fold", "seq", "asset", "event_id", F.col("perf").alias("actual"),
        mean.alias("mean"), F.greatest(sd, F.lit(1e-3)).alias("sd"),
        F.lit(model).alias("model"), F.lit(None).cast("string").alias("failed"),
    )


def line_rung(laps: DataFrame, folds: DataFrame, model="naive", load=0.0) -> DataFrame:
    """One line per mode; a mode not seen in training gets the median intercept.

    ``load`` is the known gain per unit of load used, added back before the
    fit and taken off the forecast.
    """
    y = F.col("perf") + F.lit(load) * F.col("elapsed")
    sum_of = lambda x, name: F.sum(x).alias(name)
    n, mx, my = F.sum("_n"), F.sum("_x") / F.sum("_n"), F.sum("_y") / F.sum("_n")
    between = lambda a, b: F.sum(F.col(a) * F.col(b) / F.col("_n")) - F.sum(a) * F.sum(b) / F.sum("_n")
    sums = train_sums(
        laps.withColumn("_v", y), folds, ["mode"],
        [F.count("_v").alias("_n"), sum_of("age", "_x"), sum_of("_v", "_y"), F.regr_sxx("_v", "age").alias("_xx"), F.regr_sxy("_v", "age").alias("_xy"), F.regr_syy("_v", "age").alias("_yy")],
        [n.alias("n"), mx.alias("_mx"), my.alias("mean_y"), (F.sum("_xx") + between("_x", "_x")).alias("_sxx"), (F.sum("_xy") + between("_x", "_y")).alias("_sxy"),
         (F.sum("_yy") + between("_y", "_y")).alias("_syy")],
    ).withColumn("_b", F.try_divide("_sxy", "_sxx")).withColumn("_a", F.col("mean_y") - F.col("_b") * F.col("_mx"))
    fit = rates.lines(sums, ("session_id", "fold"))
    test = held_out(laps, folds)
    # one value per mode: a few rows per fold
    fallback = fit.groupBy("session_id", "fold").agg(
        F.median("intercept").alias("_any"), F.first("sd").alias("_sd")
    )
    joined = test.join(fit.drop("n", "sd", "slope_se"), ["session_id", "fold", "mode"], "left").join(
        fallback, ["session_id", "fold"]
    )
    mean = F.coalesce(F.col("slope") * F.col("age") + F.col("intercept"), F.col("_any"))
    return _stream(joined, model, mean - F.lit(load) * F.col("elapsed"), F.col("_sd"))


def corrected_rung(laps: DataFrame, folds: DataFrame) -> DataFrame:
    return line_rung(laps, folds, "corrected", LOAD_SLOPE)


_NUMERIC = ("one", "age", "interference", "progress", "load", "y")
_PAIRS = [(a, b) for i, a in enumerate(_NUMERIC) for b in _NUMERIC[i:]]

_SHARED = ["session_id", "fold"]
_SOLVED = "session_id long, fold int, beta array<double>, spread array<double>, explained double, penalty double, fit_seconds double, failed string"


def _columns(mode_at, values):
    """Entries (position, value) of the shared columns one (asset, mode) cell touches: intercept, level and slope of its mode, interference, progress, load.

    ``values`` maps the six factors to columns; load counts against the lap.
    """
    tail = 1 + 2 * F.size("modes")
    level = 1 + 2 * mode_at
    places = (F.lit(0), level, level + 1, tail, tail + 1, tail + 2)
    factors = ("one", "one", "age", "interference", "progress", "load")
    return [(p.cast("int"), -values(f) if f == "load" else values(f), f) for p, f in zip(places, factors)]


def _factor(u, v):
    return F.col(f"{u}_{v}" if (u, v) in _PAIRS else f"{v}_{u}")


def _solve_shared(key, pdf: pd.DataFrame, ridge: float) -> pd.DataFrame:
    """The reduced normal equations of one (session, fold): a few rows per pair of shared columns, none per asset."""
    q = int(pdf["i"].max()) + 1
    gram, moment = np.zeros((q, q)), np.zeros(q)
    for i, j, v in zip(pdf["i"], pdf["j"], pdf["v"]):
        if j < 0:
            moment[i] = v
        else:
            gram[i, j] = v
    penalty = ridge * np.eye(q)
    out = {"session_id": key[0], "fold": key[1], "failed": None}
    began = time.perf_counter()
    try:
        every = np.linalg.inv(gram + penalty)
        penalty[0, 0] = 0.0
        beta = np.linalg.solve(gram + penalty, moment)
        if not np.isfinite(beta).all():
            raise np.linalg.LinAlgError("coefficients are not finite")
        out |= {"beta": beta.tolist(), "spread": np.sqrt(np.maximum(np.diag(every), 0.0)).tolist(), "penalty": float(ridge * (beta[1:] @ beta[1:]))}
    except np.linalg.LinAlgError as exc:
        out |= {"beta": None, "spread": None, "penalty": None, "failed": f"LinAlgError: {exc}"}
    out["fit_seconds"] = time.perf_counter() - began
    return pd.DataFrame([out]).reindex(columns=[c.split()[0] for c in _SOLVED.split(", ") if c.split()[0] != "explained"])


def ridge_fit(laps: DataFrame, folds: DataFrame, ridge=1.0):
    """Pooled regression per (session, fold): asset levels, mode levels and slopes, interference, progress, load.

    Returns (shared, assets): one row per (session, fold) with the coefficients all assets share, and one row per (session, fold, asset) with its level
    (0 for the first asset, the reference). Cross products are plain sums per (session, fold, asset, mode). Asset columns do not overlap, so their block
    is diagonal: each asset is eliminated from the normal equations by itself, the sums of what that leaves (a Schur complement over two columns per
    mode and four more) are solved, and asset levels follow by substitution. No matrix grows with the assets. Every
    fold trains from the session's first seq, which is the origin of progress. ``ridge`` must be positive; the intercept is not penalised.
    """
    if ridge <= 0:
        raise ValueError("ridge must be positive")
    origin = laps.groupBy("session_id").agg(F.min("seq").cast("double").alias("origin"))
    rows = laps.join(origin, "session_id").select(
        "session_id", "seq", "origin", "asset", "mode", F.lit(1.0).alias("one"), "age",
        F.coalesce("interference", F.lit(0.0)).alias("interference"),
        (F.col("seq") - F.col("origin")).alias("progress"), F.col("elapsed").alias("load"), F.col("perf").alias("y"),
    )
    cells = train_sums(
        rows, folds, ["asset", "mode"], [F.first("origin").alias("origin"), *[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in _PAIRS]],
        [F.first("origin").alias("origin"), *[F.sum(f"{a}_{b}").alias(f"{a}_{b}") for a, b in _PAIRS]],
    )
    cells = stage(cells)
    facts = cells.groupBy(*_SHARED).agg(
        F.array_sort(F.collect_set("mode")).alias("modes"), F.min("asset").alias("_reference"), F.first("origin").alias("origin"),
        F.sum("one_one").alias("_n"), F.sum("y_y").alias("_y2"), F.count_distinct("asset").alias("_assets"),
    )
    cells = cells.join(facts.select(*_SHARED, "modes", "_reference"), _SHARED).withColumn("_at", F.array_position("modes", F.col("mode")).cast("int") - 1)

    # cross products of the shared columns, cell by cell
    touched = _columns(F.col("_at"), lambda f: F.lit(1.0))
    signs = {f: (-1.0 if f == "load" else 1.0) for f in _NUMERIC}
    entry = lambda i, j, v: F.struct(i.alias("i"), j.alias("j"), v.alias("v"))
    pairs = [entry(i, j, signs[u] * signs[v] * _factor(u, v)) for i, _, u in touched for j, _, v in touched]
    sides = [entry(i, F.lit(-1), signs[u] * _factor(u, "y")) for i, _, u in touched]
    sums = cells.select(*_SHARED, F.explode(F.array(*pairs, *sides)).alias("x")).select(*_SHARED, "x.*")

    # an asset's cross products with the shared columns, and what eliminating it takes away
    own = cells.where(F.col("asset") > F.col("_reference"))
    part = own.select(*_SHARED, "asset", "one_one", "one_y", F.explode(F.array(*[F.struct(i.alias("i"), (signs[u] * _factor(u, "one")).alias("c")) for i, _, u in touched])).alias("x"))
    crossed = part.groupBy(*_SHARED, "asset", "x.i").agg(F.sum("x.c").alias("c"))
    level = own.groupBy(*_SHARED, "asset").agg(F.sum("one_one").alias("_m"), F.sum("one_y").alias("_s"))
    assets = stage(crossed.groupBy(*_SHARED, "asset").agg(F.array_sort(F.collect_list(F.struct("i", "c"))).alias("cross")).join(level, [*_SHARED, "asset"]))
    weight = F.col("_m") + F.lit(float(ridge))
    less = F.flatten(F.transform("cross", lambda a: F.transform("cross", lambda b: F.struct(a["i"].alias("i"), b["i"].alias("j"), (-a["c"] * b["c"] / weight).alias("v")))))
    side = F.transform("cross", lambda a: F.struct(a["i"].alias("i"), F.lit(-1).alias("j"), (-a["c"] * F.col("_s") / weight).alias("v")))
    taken = assets.select(*_SHARED, F.explode(F.concat(less, side)).alias("x")).select(*_SHARED, "x.*")
    reduced = sums.unionByName(taken).groupBy(*_SHARED, "i", "j").agg(F.sum("v").alias("v"))

    def solve(key, pdf):
        return _solve_shared(key, pdf, ridge)

    schema = ", ".join(c for c in _SOLVED.split(", ") if not c.startswith("explained"))
    solved = stage(reduced.groupBy(*_SHARED).applyInPandas(solve, schema).join(facts, _SHARED))

    levels = assets.join(solved.select(*_SHARED, "beta"), _SHARED).select(
        *_SHARED, "asset", ((F.col("_s") - F.aggregate("cross", F.lit(0.0), lambda acc, x: acc + x["c"] * F.get("beta", x["i"]))) / weight).alias("level"), "_s"
    )
    levels = stage(levels)
    # rss = y'y - b'm - b'Lb for penalised coefficients b
    explained = levels.groupBy(*_SHARED).agg(F.sum(F.col("level") * F.col("_s")).alias("_em"), F.sum(F.col("level") * F.col("level") * ridge).alias("_ep"))
    moments = sums.where("j = -1").groupBy(*_SHARED, "i").agg(F.sum("v").alias("v")).groupBy(*_SHARED).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("_moment"))
    shared = solved.join(explained, _SHARED, "left").join(moments, _SHARED)
    rss = F.greatest(
        F.col("_y2") - F.aggregate("_moment", F.lit(0.0), lambda acc, x: acc + x["v"] * F.get("beta", x["i"])) - F.coalesce("_em", F.lit(0.0))
        - F.col("penalty") - F.coalesce("_ep", F.lit(0.0)), F.lit(0.0))
    size = F.col("_assets") + 2 * F.size("modes") + 3
    tail = 1 + 2 * F.size("modes")
    sd = F.sqrt(rss / F.greatest(F.col("_n") - size, F.lit(1)))
    shared = shared.select(
        *_SHARED, F.get("beta", F.lit(0)).alias("intercept"), F.get("beta", tail).alias("interference"), F.get("beta", tail + 1).alias("progress"),
        F.get("beta", tail + 2).alias("load"), "origin", sd.alias("sd"), F.get("modes", F.lit(0)).alias("first_mode"),
        F.map_from_arrays("modes", F.transform("modes", lambda m, k: F.struct(
            F.get("beta", 2 * k + 1).alias("level"), F.get("beta", 2 * k + 2).alias("slope"), (sd * F.get("spread", 2 * k + 2)).alias("slope_sd")))).alias("modes"),
        "fit_seconds", "failed",
    )
    return shared, levels.drop("_s")


def ridge_rung(laps: DataFrame, folds: DataFrame, ridge=1.0) -> DataFrame:
    """Forecasts of the pooled regression; an unseen asset or mode takes the reference level."""
    test = held_out(laps, folds)
    fit, levels = ridge_fit(laps, folds, ridge)
    fit = fit.withColumnsRenamed({"interference": "_b_i", "progress": "_b_p", "load": "_b_l"})
    joined = test.join(fit, ["session_id", "fold"]).join(levels, ["session_id", "fold", "asset"], "left")
    mode = F.coalesce(F.try_element_at("modes", F.col("mode")), F.try_element_at("modes", F.col("first_mode")))
    mean = (
        F.col("intercept")
        + F.coalesce("level", F.lit(0.0))
        + mode["level"] + mode["slope"] * F.col("age")
        + F.col("_b_i") * F.coalesce("interference", F.lit(0.0))
        + F.col("_b_p") * (F.col("seq") - F.col("origin"))
        - F.col("_b_l") * F.col("elapsed")
    )
    out = _stream(joined.withColumn("_mean", mean), "ridge", F.col("_mean"), F.col("sd"))
    failed = fit.where("failed IS NOT NULL").select(
        "session_id", "fold", *[F.lit(None).cast(t).alias(c) for c, t in out.dtypes[2:8]],
        F.lit("ridge").alias("model"), "failed",
    )
    return out.where("mean IS NOT NULL").unionByName(failed)


def ridge_rates(fit: DataFrame) -> DataFrame:
    """Mode slopes of the pooled regression."""
    return fit.select("session_id", "fold", F.explode("modes").alias("mode", "_v")).select(
        "session_id", "fold", "mode", F.col("_v.slope").alias("rate"), F.col("_v.slope_sd").alias("rate_sd")
    )


def boosted_rung(laps: DataFrame, folds: DataFrame, trees=200, depth=4, at_once=4) -> DataFrame:
    """Gradient-boosted trees, one model per fold, pooled over sessions.

    The rounds of a model follow one another, the models do not: up to ``at_once`` are fitted side by side. Their rows are written one fold
    after another before, for the rows a round draws depend on the order they are written in.
    """
    from functools import reduce
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target

    folds = stage(folds)
    numbers = sorted(r.fold for r in folds.select("fold").distinct().collect())
    # each call of inheritable_thread_target copies the caller's local properties, which threads must not share
    fits = [inheritable_thread_target(laps.sparkSession)(lambda rows=rows: _boosted_fit(rows, trees, depth))
            for rows in [_boosted_rows(laps, folds, k) for k in numbers]]
    with ThreadPool(max(min(at_once, len(fits)), 1)) as pool:
        streams = pool.map(lambda fit: fit(), fits, chunksize=1)
    return reduce(DataFrame.unionByName, streams)


def boosted_fold(laps: DataFrame, folds: DataFrame, fold: int, trees=200, depth=4) -> DataFrame:
    """Gradient-boosted trees for one fold, pooled over sessions.

    The spread is half the distance between the 16th and 84th percentile of the
    training residuals per mode: the tree learner here has no quantile loss.
    """
    return _boosted_fit(_boosted_rows(laps, folds, fold), trees, depth)


_BOOSTED = ["session_id", "fold", "seq", "asset", "event_id", "perf", "mode", "age", "elapsed", "interference"]


def _boosted_rows(laps: DataFrame, folds: DataFrame, fold: int) -> DataFrame:
    """Training and held-out rows of one fold, written."""
    train, test = in_folds(laps, folds.where(F.col("fold") == fold))
    origin = train.groupBy("session_id").agg(F.min("seq").alias("_o"))
    return stage(
        train.select(*_BOOSTED, F.lit(True).alias("_train")).unionByName(test.select(*_BOOSTED, F.lit(False).alias("_train")))
        .join(origin, "session_id").withColumn("progress", (F.col("seq") - F.col("_o")).cast("double"))
    )


def _boosted_fit(prepared: DataFrame, trees: int, depth: int) -> DataFrame:
    """Forecasts of the held-out rows by trees fitted to the training rows."""
    from pyspark.ml.feature import StringIndexer

    from wearframe.operators import boosting, slices

    indexer = StringIndexer(inputCol="mode", outputCol="mode_code", handleInvalid="keep").fit(prepared.where("_train"))
    ready = indexer.transform(prepared)
    features = ["age", "elapsed", "progress", "interference", "mode_code", "asset", "session_id"]
    # a mode that training never saw is a category of its own
    model = boosting.fit(ready.where("_train"), "perf", features, {"mode_code": len(indexer.labels) + 1}, trees, depth)
    # written once: a row passes all trees, and the percentiles read the rows several times
    scored = stage(boosting.predict(ready, features, model, [*_BOOSTED, "_train"]))
    spread = slices.exact_percentiles(
        scored.where("_train").withColumn("_r", F.col("perf") - F.col("prediction")), ["mode"], "_r", {"lo": 0.16, "hi": 0.84}
    )
    tested = scored.where("NOT _train").join(spread, "mode", "left")
    return _stream(tested, "boosted", F.col("prediction"), F.coalesce((F.col("hi") - F.col("lo")) / 2, F.lit(1.0)))


RUNGS = {"naive": line_rung, "corrected": corrected_rung, "ridge": ridge_rung}


def isolated(stream: DataFrame) -> DataFrame:
    """A rung that cannot forecast a fold of a session fails there alone: one row with the reason stands for its forecasts, all others stay as they are.

    A fold fails if a forecast or its spread is missing or not finite, or if the rung said so itself.
    """
    keys = ["model", "session_id", "fold"]
    finite = lambda c: F.coalesce(F.abs(F.col(c)) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(F.coalesce(F.col(c), F.lit(0.0)))
    stream = stage(stream)
    said = F.min("failed")
    bad = stream.groupBy(*keys).agg(said.alias("_said"), F.count_if(F.col("failed").isNull() & ~(finite("mean") & finite("sd"))).alias("_bad"), F.count(F.lit(1)).alias("_n"))
    bad = bad.where("_said IS NOT NULL OR _bad > 0").withColumn(
        "failed", F.coalesce("_said", F.format_string("ArithmeticError: %d of %d forecasts are not finite", "_bad", "_n")))
    types = dict(stream.dtypes)
    rows = bad.select(*[F.col(c) if c in (*keys, "failed") else F.lit(None).cast(types[c]).alias(c) for c in stream.columns])
    return stream.join(bad.select(*keys), keys, "left_anti").select(*stream.columns).unionByName(rows)


def evaluate(laps: DataFrame, folds: DataFrame, rungs=None) -> DataFrame:
    """Forecast streams of every rung, stacked; a broken session fails by itself (see ``isolated``)."""
    from functools import reduce

    streams = [rung(laps, folds) for rung in (rungs or RUNGS).values()]
    return isolated(reduce(DataFrame.unionByName, streams))


def fold_scores(stream: DataFrame) -> DataFrame:
    """Error, CRPS, coverage, width and bias per (model, session, fold)."""
    err = F.col("actual") - F.col("mean")
    return stream.where("failed IS NULL").groupBy("model", "session_id", "fold").agg(
        F.count(F.lit(1)).alias("n_test"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.expr(gaussian.crps_sql("actual", "mean", "sd"))).alias("crps"),
        F.avg((F.abs(err) <= 1.96 * F.col("sd")).cast("double")).alias("coverage"),
        F.avg(2 * 1.96 * F.col("sd")).alias("width"),
        F.avg(-err).alias("bias"),
    )


_METRICS = ("mae", "rmse", "crps", "coverage", "width", "bias")


def model_scores(folds: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Means over folds, and how much the bias grows from the first fold to the last."""
    drift = F.max_by("bias", "fold") - F.min_by("bias", "fold")
    scores = folds.groupBy("model", "session_id").agg(
        F.count(F.lit(1)).alias("n_folds"), *[F.avg(m).alias(m) for m in _METRICS],
        F.when(F.count(F.lit(1)) >= 2, drift).alias("bias_drift"),
    )
    if failed is None:
        return scores
    bad = failed.where("failed IS NOT NULL").groupBy("model", "session_id").agg(F.min("failed").alias("failed"))
    return scores.join(bad, ["model", "session_id"], "full_outer")


def ladder(scores: DataFrame) -> DataFrame:
    """Mean scores per model over sessions, best CRPS first; failed sessions are left out."""
    rows = scores.where("failed IS NULL") if "failed" in scores.columns else scores
    return rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_sessions"), *[F.avg(m).alias(m) for m in (*_METRICS, "bias_drift")]
    ).orderBy(F.asc_nulls_last("crps"))


def rate_recovery(estimates: DataFrame, truth: DataFrame) -> DataFrame:
    """Estimated rates against known ones: error and 95% coverage; models without rates give a null row.

    estimates(model, mode, rate, rate_sd); truth(mode, true_rate) has one row
    per mode.
    """
    models = estimates.select("model").distinct()
    with_rates = estimates.where("mode IS NOT NULL").select("model").distinct()
    known = truth.agg(F.collect_list(F.struct("mode", "true_rate")).alias("t")).scalar()
    scored = (
        with_rates.withColumn("_t", F.explode(known))
        .select("model", "_t.mode", "_t.true_rate")
        .join(estimates, ["model", "mode"], "left")
    )
    ok = F.col("rate").isNotNull() & F.col("rate_sd").isNotNull()
    error = F.col("rate") - F.col("true_rate")
    out = scored.select(
        "model", "mode", "true_rate", F.col("rate").alias("estimate"), error.alias("error"),
        F.when(ok, F.abs(error) <= 1.96 * F.col("rate_sd")).alias("covered"),
    )
    silent = models.join(with_rates, "model", "left_anti").select(
        "model", *[F.lit(None).cast(t).alias(c) for c, t in out.dtypes[1:]]
    )
    return out.unionByName(silent)


def recovery_summary(recovery: DataFrame) -> DataFrame:
    """Mean absolute error, bias and coverage per model."""
    return recovery.groupBy("model").agg(
        F.avg(F.abs("error")).alias("rate_mae"), F.avg("error").alias("rate_bias"),
        F.avg(F.col("covered").cast("double")).alias("coverage"), F.count("error").alias("n"),
    )
