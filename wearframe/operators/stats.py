"""Group comparisons, rank tests, held-out means and regressions, trait reliability."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wearframe.functions import gaussian
from wearframe.operators import rates, slices
from wearframe.operators.staging import stage


def _keyed(df, by):
    by = list(by)
    return (df, by, by) if by else (df.withColumn("_all", F.lit(0)), ["_all"], [])


def average_ranks(df: DataFrame, keys, value: str, name="rank") -> DataFrame:
    """Rank of each distinct value in its group, ties averaged: (keys, value, n_ties, rank)."""
    keys = list(keys)
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_ties")).withColumn(
        "_slice", F.floor(F.asinh(F.col(value)) * 65536).cast("long")
    )
    placed = slices.running(counted, keys, "_slice", [value], {"_upto": F.col("n_ties")})
    return placed.select(
        *keys, value, "n_ties", (F.col("_upto") - F.col("n_ties") + (F.col("n_ties") + 1) / 2).alias(name)
    )


def wilcoxon(df: DataFrame, a: str, b: str, by=()) -> DataFrame:
    """Signed-rank test of a - b by the normal approximation with tie correction; zeros dropped."""
    df, keys, out = _keyed(df, by)
    # differences of equal sums may be a last bit apart; twelve digits decide what is a zero or a tie
    diffs = df.select(*keys, F.round(F.col(a) - F.col(b), 12).alias("_d")).where("_d <> 0").withColumn("_abs", F.abs("_d"))
    ranks = average_ranks(diffs, keys, "_abs", "_rank")
    signs = diffs.groupBy(*keys, "_abs").agg(F.count_if(F.col("_d") > 0).alias("_pos"))
    sums = ranks.join(signs, [*keys, "_abs"]).groupBy(*keys).agg(
        F.sum("n_ties").alias("n"),
        F.sum(F.col("_rank") * F.col("_pos")).alias("w_plus"),
        F.sum(F.col("_rank") * (F.col("n_ties") - F.col("_pos"))).alias("w_minus"),
        F.sum(F.pow(F.col("n_ties").cast("double"), 3) - F.col("n_ties")).alias("_ties"),
    )
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    stat = sums.withColumn("statistic", F.least("w_plus", "w_minus")).withColumn(
        "z", (F.col("statistic") - n * (n + 1) / 4) / F.sqrt(var)
    )
    return stat.withColumn("p_value", 2 * gaussian.cdf("(-abs(z))")).select(*out, "n", "statistic", "z", "p_value")


def student_p(t, dof):
    """Two-sided p of Student's t through Wallace's normal transform."""
    return f"(2 * {gaussian.cdf_sql(f'(-((8 * {dof} + 1) / (8 * {dof} + 3)) * sqrt({dof} * ln(1 + {t} * {t} / {dof})))')})"


def paired_t(df: DataFrame, a: str, b: str, by=()) -> DataFrame:
    """Paired t statistic of a - b."""
    df, keys, out = _keyed(df, by)
    d = F.col(a) - F.col(b)
    stats = df.groupBy(*keys).agg(
        F.count(d).alias("n"), F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("_s")
    ).withColumn("t", F.try_divide("mean_difference", F.col("_s") / F.sqrt(F.col("n"))))
    dof = "CAST(n - 1 AS DOUBLE)"
    return stats.withColumn("p_value", F.expr(student_p("t", dof))).select(*out, "n", "mean_difference", "t", "p_value")


def bias_screen(df: DataFrame, target: str, predictors, min_pairs=8, min_distinct=3, level=0.05) -> DataFrame:
    """Spearman correlation of each predictor with the target, Benjamini-Hochberg corrected."""
    long = df.select(F.col(target).cast("double").alias("_y"), F.explode(F.array(*[
        F.struct(F.lit(p).alias("predictor"), F.col(p).cast("double").alias("_x")) for p in predictors
    ])).alias("_p")).select("_y", "_p.*").where("_x IS NOT NULL AND _y IS NOT NULL")
    rx = average_ranks(long, ["predictor"], "_x", "_rx").drop("n_ties")
    ry = average_ranks(long, ["predictor"], "_y", "_ry").drop("n_ties")
    rho = long.join(rx, ["predictor", "_x"]).join(ry, ["predictor", "_y"]).groupBy("predictor").agg(
        F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("spearman_rho")
    )
    enough = rx.groupBy("predictor").agg(F.count(F.lit(1)).alias("_d")).where(F.col("_d") >= min_distinct)
    t = "(abs(spearman_rho) * sqrt(CAST(n - 2 AS DOUBLE) / greatest(1 - spearman_rho * spearman_rho, CAST(1e-300 AS DOUBLE))))"
    tested = rho.join(enough, "predictor", "left_semi").where(F.col("n") >= min_pairs).withColumn(
        "p_value", F.expr(student_p(t, "CAST(n - 2 AS DOUBLE)"))
    )
    # one row per predictor from here on
    everyone = Window.orderBy("p_value", "predictor")
    ranked = tested.withColumn("_r", F.row_number().over(everyone)).withColumn(
        "bh_threshold", F.lit(level) * F.col("_r") / F.count(F.lit(1)).over(Window.partitionBy())
    )
    later = Window.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("significant_raw", F.col("p_value") < level).withColumn(
        "significant", F.max(F.col("p_value") <= F.col("bh_threshold")).over(later)
    ).drop("_r")


def variance_decomposition(estimates: DataFrame, value="rate", groupings=("label", "mode_id"), min_size=3) -> DataFrame:
    """Pooled within-group spread under two groupings, and how much tighter the second is."""
    usable = estimates.where(F.col(groupings[1]).isNotNull())
    overall = usable.agg(F.stddev_pop(value)).scalar()
    long = usable.select(F.col(value).alias("_v"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.col(g).cast("string").alias("g")) for i, g in enumerate(groupings)
    ])).alias("_g")).select("_v", "_g.*")
    pooled = (
        long.groupBy("i", "g").agg(F.count("_v").alias("n"), F.var_samp("_v").alias("v")).where(F.col("n") >= min_size)
        .groupBy("i").agg(F.sqrt(F.sum((F.col("n") - 1) * F.col("v")) / F.sum(F.col("n") - 1)).alias("sd"), F.count(F.lit(1)).alias("k"))
    )
    pick = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c)))
    return pooled.agg(
        pick("sd", 0).alias("within_label_sd"), pick("sd", 1).alias("within_mode_sd"),
        pick("k", 0).alias("n_label_groups"), pick("k", 1).alias("n_mode_groups"),
    ).select(
        overall.alias("overall_sd"), "*",
        F.try_divide(100 * (F.col("within_label_sd") - F.col("within_mode_sd")), "within_label_sd").alias("reduction_pct"),
    )


def loo_mean(df: DataFrame, held, key, value: str, name="loo_mean") -> DataFrame:
    """Mean of ``value`` over the row's key, leaving out everything in the row's held-out group.

    Sum-minus-group: two small aggregates joined back, no pairing of groups.
    """
    held, key = list(held), list(key)
    part = df.groupBy(*key, *[h for h in held if h not in key]).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    if key:
        whole = part.groupBy(*key).agg(F.sum("_s").alias("_all_s"), F.sum("_n").alias("_all_n"))
        joined = part.join(whole, key)
    else:
        total = part.agg(F.struct(F.sum("_s").alias("s"), F.sum("_n").alias("n"))).scalar()
        joined = part.withColumn("_t", total).select("*", F.col("_t.s").alias("_all_s"), F.col("_t.n").alias("_all_n"))
    rest = joined.select(
        *key, *[h for h in held if h not in key],
        F.when(F.col("_all_n") > F.col("_n"), (F.col("_all_s") - F.col("_s")) / (F.col("_all_n") - F.col("_n"))).alias(name),
    )
    return df.join(rest, [*key, *[h for h in held if h not in key]])


def loeo_modes(estimates: DataFrame, event="event", value="rate") -> DataFrame:
    """Held-out predictions by relative label and by absolute mode, on cases where both exist."""
    known = estimates.where("mode_id IS NOT NULL")
    out = loo_mean(loo_mean(known, [event], ["label"], value, "pred_label"), [event], ["mode_id"], value, "pred_mode")
    return out.where("pred_label IS NOT NULL AND pred_mode IS NOT NULL").withColumn(
        "err_label", F.abs(F.col("pred_label") - F.col(value))
    ).withColumn("err_mode", F.abs(F.col("pred_mode") - F.col(value)))


def loeo_modes_summary(cases: DataFrame) -> DataFrame:
    """Errors of both predictors, win rate and the paired test."""
    test = wilcoxon(cases, "err_mode", "err_label").select(F.struct("statistic", "p_value").alias("w"))
    return cases.agg(
        F.count(F.lit(1)).alias("n"), F.avg("err_label").alias("mae_by_label"), F.avg("err_mode").alias("mae_by_mode"),
        F.avg(F.col("err_mode") - F.col("err_label")).alias("mean_paired_difference"),
        F.avg((F.col("err_mode") < F.col("err_label")).cast("double")).alias("mode_win_rate"),
    ).withColumn("_w", test.scalar()).select("*", F.col("_w.p_value").alias("wilcoxon_p")).drop("_w")


# ---- held-out ridge on group features -----------------------------------------


def swept(m: np.ndarray, k: int, back=False) -> np.ndarray:
    """A symmetric cross-product matrix with variable ``k`` swept in, or swept out again: once in, its row holds its coefficients on the variables that are not."""
    d = m[k, k]
    out = m - np.outer(m[:, k], m[k]) / d
    out[k] = out[:, k] = (-m[k] if back else m[k]) / d
    out[k, k] = -1.0 / d
    return out


def family_fits(estimates: DataFrame, families: dict, group_col="label", circuit="circuit", value="rate", alpha=5.0) -> DataFrame:
    """Ridge on group dummies and each family's features, without each circuit: circuit, family, intercept, levels, slopes.

    Columns are standardised inside each fold. Cross products of all features are summed once per (circuit, group); the training sums of a held
    circuit are the totals minus its own. The matrix of a circuit is built once; groups are swept in, and each family's features in and out again.
    """
    features = list(dict.fromkeys(f for names in families.values() for f in names))
    names = ["one", *features, "y"]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    rows = estimates.select(
        F.col(circuit).alias("_c"), F.col(group_col).alias("_g"), F.lit(1.0).alias("one"),
        *[F.col(f).cast("double").alias(f) for f in features], F.col(value).cast("double").alias("y"),
    )
    sums = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i, j in pairs]
    cells = rows.groupBy("_c", "_g").agg(*sums)
    totals = cells.groupBy("_g").agg(*[F.sum(f"p{i}_{j}").alias(f"p{i}_{j}") for i, j in pairs])
    # one row per group; every circuit needs every group's total
    packed = totals.agg(F.collect_list(F.struct(*totals.columns))).scalar()
    per_circuit = cells.select("_c").distinct().withColumn("_t", F.explode(packed)).select("_c", "_t.*").withColumn(
        "_own", F.lit(0.0)
    ).unionByName(cells.withColumn("_own", F.lit(1.0)))
    k = len(features)
    schema = "circuit string, family string, intercept double, levels map<string,double>, slopes map<string,double>"

    def solve(key, pdf):
        gram = {}
        for row in pdf.to_dict("records"):
            m = np.zeros((k + 2, k + 2))
            for i, j in pairs:
                m[i, j] = m[j, i] = row[f"p{i}_{j}"]
            gram[row["_g"]] = gram.get(row["_g"], 0) + (m if row["_own"] == 0 else -m)
        groups = sorted(g for g in gram if gram[g][0, 0] > 0.5)
        if not groups:
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        # all columns, y last
        n_groups, size = len(groups), len(groups) + k + 1
        s1, s2 = np.zeros(size), np.zeros((size, size))
        for at, g in enumerate(groups):
            m = gram[g]
            s1[at] = s2[at, at] = m[0, 0]
            s2[at, n_groups:] = s2[n_groups:, at] = m[0, 1:]
            s1[n_groups:] += m[0, 1:]
            s2[n_groups:, n_groups:] += m[1:, 1:]
        n = sum(gram[g][0, 0] for g in groups)
        mean = s1 / n
        cov = s2 / n - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
        sd[sd < 1e-12] = 1.0
        sd[-1] = 1.0
        work = n * cov / np.outer(sd, sd) + alpha * np.diag([1.0] * (size - 1) + [0.0])
        for at in range(n_groups):
            work = swept(work, at)
        out = []
        for family, chosen in families.items():
            columns = [n_groups + features.index(f) for f in chosen]
            for at in columns:
                work = swept(work, at)
            used = [*range(n_groups), *columns]
            beta = work[used, -1] / sd[used]
            out.append({
                "circuit": str(key[0]), "family": family, "intercept": float(mean[-1] - beta @ mean[used]),
                "levels": {str(g): float(beta[i]) for i, g in enumerate(groups)}, "slopes": {f: float(v) for f, v in zip(chosen, beta[n_groups:])},
            })
            for at in reversed(columns):
                work = swept(work, at, back=True)
        return pd.DataFrame(out)

    return per_circuit.groupBy("_c").applyInPandas(solve, schema)


def family_predictions(estimates: DataFrame, families: dict, group_col="label", circuit="circuit", value="rate", alpha=5.0) -> DataFrame:
    """Every estimate predicted by each family's fit without its circuit: ``estimates`` with ``family`` and ``predicted``."""
    fitted = family_fits(estimates, families, group_col, circuit, value, alpha).withColumnRenamed("circuit", "_ck")
    scored = estimates.withColumn("_ck", F.col(circuit).cast("string")).join(fitted, "_ck")
    level = F.coalesce(F.try_element_at("levels", F.col(group_col).cast("string")), F.lit(0.0))
    features = list(dict.fromkeys(f for names in families.values() for f in names))
    slope = sum((F.coalesce(F.try_element_at("slopes", F.lit(f)) * F.col(f), F.lit(0.0)) for f in features), F.lit(0.0))
    return scored.withColumn("predicted", F.col("intercept") + level + slope).drop("_ck", "intercept", "levels", "slopes")


def loco(estimates: DataFrame, features, group_col="label", circuit="circuit", value="rate", alpha=5.0) -> DataFrame:
    """Leave-one-circuit-out ridge on group dummies and ``features`` (see ``family_fits``): ``estimates`` with ``predicted``."""
    return family_predictions(estimates, {"all": list(features)}, group_col, circuit, value, alpha).drop("family")


def ablation(cases: DataFrame, actual="rate", baseline="label_mean", least=20) -> DataFrame:
    """What each family of features is worth beside the baseline: errors, gain, signed-rank p, and whether it clearly helps or hurts.

    cases: ``family_predictions`` with the baseline's predictions. Families with fewer than ``least`` cases are left out.
    """
    rows = cases.select("family", F.abs(F.col("predicted") - F.col(actual)).alias("e"), F.abs(F.col(baseline) - F.col(actual)).alias("b"))
    scores = rows.groupBy("family").agg(F.count(F.lit(1)).alias("n_cases"), F.avg("e").alias("mae"), F.avg("b").alias("baseline_mae")).where(F.col("n_cases") >= least)
    tested = scores.join(wilcoxon(rows, "e", "b", ["family"]).select("family", F.col("p_value").alias("wilcoxon_p")), "family", "left")
    clear = F.coalesce(F.col("wilcoxon_p") < 0.05, F.lit(False))
    return tested.withColumn("vs_baseline_pct", F.try_divide(100 * (F.col("baseline_mae") - F.col("mae")), "baseline_mae")).withColumn(
        "helps", clear & (F.col("mae") < F.col("baseline_mae"))).withColumn("hurts", clear & (F.col("mae") > F.col("baseline_mae")))


def loco_scores(cases: DataFrame, predictors, actual="rate", baseline="label_mean") -> DataFrame:
    """Error of each predictor and its gain over the baseline."""
    long = cases.select(F.explode(F.array(*[
        F.struct(F.lit(p).alias("predictor"), F.abs(F.col(p) - F.col(actual)).alias("e"), F.abs(F.col(baseline) - F.col(actual)).alias("b"))
        for p in predictors
    ])).alias("r")).select("r.*")
    scores = long.groupBy("predictor").agg(
        F.avg("e").alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"),
        F.try_divide(100 * (F.avg("b") - F.avg("e")), F.avg("b")).alias("vs_baseline_pct"),
    )
    test = wilcoxon(long, "e", "b", ["predictor"]).select("predictor", F.col("p_value").alias("wilcoxon_p"))
    return scores.join(test, "predictor", "left")


# ---- asset traits --------------------------------------------------------------


def asset_deviations(slopes: DataFrame, by=("session_id", "mode"), min_group=3) -> DataFrame:
    """Each asset's slope against its (session, mode) mean, in groups of at least ``min_group``."""
    from wearframe.operators.windows import deviation

    return deviation(slopes, list(by), "slope").where(F.col("group_size") >= min_group)


def teammate_gaps(dev: DataFrame) -> DataFrame:
    """First minus second by name, where a team has exactly two assets in a session."""
    means = dev.where("team IS NOT NULL").groupBy("session_id", "team", "asset").agg(F.avg("deviation").alias("d"))
    return means.groupBy("session_id", "team").agg(
        F.count(F.lit(1)).alias("_n"), F.min("asset").alias("first"), F.max("asset").alias("second"),
        (F.min_by("d", "asset") - F.max_by("d", "asset")).alias("gap"),
    ).where("_n = 2").drop("_n").withColumn("pair", F.concat_ws("-", "first", "second"))


def top_gaps(gaps: DataFrame, k=5) -> DataFrame:
    """Pairs with the largest mean gap in absolute terms."""
    return gaps.groupBy("pair").agg(F.avg("gap").alias("mean_gap")).select(
        "pair", F.abs("mean_gap").alias("size")
    ).orderBy(F.desc("size"), "pair").limit(k)


def split_half(dev: DataFrame, key="asset", value="deviation", n=500, min_shared=8) -> DataFrame:
    """Correlation of per-key means between random halves of the sessions, one row per split.

    The first digit of a hash of (split, session) says which half a session is
    in, so the draw needs no order and no partitioning. Rows are summed per
    (session, key) before the splits, and per (split, key) before the shuffle.
    """
    cells = dev.groupBy("session_id", key).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    drawn = cells.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(
        "_left", F.substring(F.md5(F.concat_ws("-", "split", "session_id")), 1, 1) < "8"
    )
    side = lambda c, left: F.sum(F.when(F.col("_left") == left, F.col(c)))
    means = drawn.groupBy("split", key).agg(
        (side("_s", True) / side("_n", True)).alias("a"), (side("_s", False) / side("_n", False)).alias("b"),
    ).where("a IS NOT NULL AND b IS NOT NULL")
    return means.groupBy("split").agg(F.count(F.lit(1)).alias("n_shared"), F.corr("a", "b").alias("r")).where(
        F.col("n_shared") >= min_shared
    )


def reliability_summary(splits: DataFrame) -> DataFrame:
    """Mean and 5th/95th percentiles over splits; stable if the 5th is above zero.

    One value per split, a few hundred in all.
    """
    good = splits.where("r IS NOT NULL AND NOT isnan(r)")
    out = good.agg(
        F.count(F.lit(1)).alias("n_splits"), F.avg("r").alias("mean_r"),
        F.percentile("r", F.lit(0.05)).alias("p05"), F.percentile("r", F.lit(0.95)).alias("p95"),
    )
    return out.withColumn("is_stable", F.col("p05") > 0)


def loso_history(dev: DataFrame, key="asset", value="deviation") -> DataFrame:
    """Each row predicted by the same asset's mean in the other sessions."""
    out = loo_mean(dev, ["session_id"], [key], value, "predicted")
    return out.where("predicted IS NOT NULL").withColumn(
        "history_error", F.abs(F.col("predicted") - F.col(value))
    ).withColumn("null_error", F.abs(value))


def history_summary(cases: DataFrame) -> DataFrame:
    test = wilcoxon(cases, "history_error", "null_error").select("p_value").scalar()
    return cases.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("asset").alias("n_assets"),
        F.avg("history_error").alias("history_mae"), F.avg("null_error").alias("null_mae"),
    ).withColumn("improvement_pct", F.try_divide(100 * (F.col("null_mae") - F.col("history_mae")), "null_mae")).withColumn(
        "wilcoxon_p", test
    )


def trait_summary(dev: DataFrame, key="asset", value="deviation", min_sessions=5) -> DataFrame:
    """Spread of per-asset means against the spread of single observations."""
    per = dev.groupBy(key).agg(F.avg(value).alias("m"), F.count_distinct("session_id").alias("s")).where(
        F.col("s") >= min_sessions
    )
    within = dev.agg(F.stddev_samp(value)).scalar()
    return per.agg(F.count(F.lit(1)).alias("n_keys"), F.stddev_samp("m").alias("trait_sd")).withColumn(
        "observation_sd", within
    ).withColumn("signal_to_noise", F.try_divide("trait_sd", "observation_sd"))


# ---- comparing two sessions ----------------------------------------------------


def compare_rates(practice: DataFrame, race: DataFrame, keys=("event",), min_laps=8) -> DataFrame:
    """Both sides' rate per mode, with the reason a mode cannot be compared.

    Each side: (keys, mode, rate, rate_sd, n_laps[, naive]).
    """
    keys = [*keys, "mode"]
    naive = "naive" if "naive" in practice.columns else None
    p = practice.select(
        *keys, F.col("rate").alias("predicted"), F.col("rate_sd").alias("predicted_sd"), F.col("n_laps").alias("practice_laps"),
        (F.col(naive) if naive else F.lit(None).cast("double")).alias("naive_predicted"),
    )
    r = race.select(*keys, F.col("rate").alias("actual"), F.col("rate_sd").alias("actual_sd"), F.col("n_laps").alias("race_laps"))
    both = p.join(r, keys, "full_outer")
    return both.withColumn(
        "skipped",
        F.when(F.col("predicted").isNull(), "absent in practice").when(F.col("actual").isNull(), "absent in race")
        .when((F.col("practice_laps") < min_laps) | (F.col("race_laps") < min_laps), "too few laps"),
    ).withColumn("error", F.col("predicted") - F.col("actual")).withColumn(
        "naive_error", F.col("naive_predicted") - F.col("actual")
    ).withColumn("covered", F.abs("error") <= 1.96 * F.hypot("predicted_sd", "actual_sd"))


def _transfer(group):
    return group.agg(
        F.count(F.lit(1)).alias("n_comparisons"), F.avg(F.abs("error")).alias("mae"),
        F.avg(F.abs("naive_error")).alias("naive_mae"), F.avg("error").alias("bias"),
        F.avg(F.col("covered").cast("double")).alias("coverage"),
    )


def validation_report(compared: DataFrame, keys=("event",)) -> DataFrame:
    return _transfer(compared.where("skipped IS NULL").groupBy(*keys))


def transfer_overall(compared: DataFrame, event="event") -> DataFrame:
    used = compared.where("skipped IS NULL")
    return _transfer(used.groupBy()).withColumn("n_events", used.agg(F.count_distinct(event)).scalar())


def depth_matched(practice: DataFrame, race: DataFrame, min_laps=8, keys=("session_id", "mode")) -> DataFrame:
    """Errors of the rates as fitted and of rates fitted again inside the age window both sides share: keys,
    baseline_error, matched_error, depth_gap (practice depth less race depth).

    A mode without a window, or with a side that has no slope inside it, is left out.
    """
    keys = list(keys)
    cut = stage(rates.depth_cut(practice, race, keys))
    inside = lambda laps: laps.join(cut.select(*keys, "depth"), keys).where(F.col("age") <= F.col("depth"))

    def error(p, r, least, name):
        fit = lambda laps: rates.ols_by_mode(laps, keys[:-1]).select(
            *keys, F.col("slope").alias("rate"), F.col("slope_se").alias("rate_sd"), F.col("n").alias("n_laps"))
        both = compare_rates(fit(p), fit(r), keys[:-1], min_laps=least).where(
            "skipped IS NULL AND predicted_sd IS NOT NULL AND actual_sd IS NOT NULL")
        return both.select(*keys, F.col("error").alias(name))

    return error(practice, race, min_laps, "baseline_error").join(
        error(inside(practice), inside(race), 3, "matched_error"), keys
    ).join(cut.select(*keys, (F.col("practice_depth") - F.col("race_depth")).alias("depth_gap")), keys)


def depth_summary(rows: DataFrame) -> DataFrame:
    """Depth-matched against baseline errors: biases, absolute errors, changes, tests.

    The paired t compares absolute errors.
    """
    rows = rows.withColumn("_b", F.abs("baseline_error")).withColumn("_m", F.abs("matched_error"))
    t = paired_t(rows, "_b", "_m").select(F.struct("t", "p_value")).scalar()
    w = wilcoxon(rows, "_b", "_m").select("p_value").scalar()
    out = rows.agg(
        F.count(F.lit(1)).alias("n_comparisons"), F.avg("baseline_error").alias("baseline_bias"),
        F.avg("matched_error").alias("matched_bias"), F.avg("_b").alias("baseline_mae"), F.avg("_m").alias("matched_mae"),
        F.avg("depth_gap").alias("mean_depth_gap"),
    )
    b, m = F.abs("baseline_bias"), F.abs("matched_bias")
    return out.withColumn("bias_reduction_pct", F.try_divide(100 * (b - m), b)).withColumn(
        "mae_change_pct", F.try_divide(100 * (F.col("matched_mae") - F.col("baseline_mae")), "baseline_mae")
    ).withColumn("_t", t).select("*", F.col("_t.t").alias("paired_t"), F.col("_t.p_value").alias("paired_p")).drop("_t").withColumn(
        "wilcoxon_p", w
    )


def bias_table(compared: DataFrame, practice_profile: DataFrame, race_profile: DataFrame, conditions: DataFrame,
               keys=("event",)) -> DataFrame:
    """Comparisons with both sessions' stint profiles and conditions as differences, matches on both sides only."""
    keys = list(keys)
    shape = ["n_stints", "mean_length", "max_length", "total_laps", "mean_interference", "stints_per_asset"]
    p = practice_profile.select(*keys, "mode", *[F.col(c).alias(f"p_{c}") for c in shape])
    r = race_profile.select(*keys, "mode", *[F.col(c).alias(f"r_{c}") for c in shape])
    cond = conditions.groupBy(*keys).agg(
        F.max(F.when(F.col("session") == "R", F.col("track_temp"))).alias("race_track_temp"),
        F.max(F.when(F.col("session") != "R", F.col("track_temp"))).alias("practice_track_temp"),
    )
    joined = compared.where("skipped IS NULL").join(p, [*keys, "mode"]).join(r, [*keys, "mode"]).join(cond, keys, "left")
    return joined.select(
        *keys, "mode", "error", F.abs("error").alias("abs_error"),
        *[(F.col(f"r_{c}") - F.col(f"p_{c}")).alias(f"d_{c}") for c in shape],
        (F.col("race_track_temp") - F.col("practice_track_temp")).alias("d_track_temp"),
    )


# ---- trust ---------------------------------------------------------------------


def consensus(estimates: DataFrame, by=("mode",)) -> DataFrame:
    """Precision-weighted view of at least two models per mode; low agreement is flagged.

    estimates(by, model, rate, rate_sd): a handful of models per mode.
    """
    sd = F.greatest("rate_sd", F.lit(1e-6))
    w = 1 / (sd * sd)
    out = estimates.where("rate IS NOT NULL AND NOT isnan(rate)").groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_models"), (F.sum(F.col("rate") * w) / F.sum(w)).alias("consensus"),
        F.sqrt(1 / F.sum(w)).alias("consensus_sd"), (F.max("rate") - F.min("rate")).alias("spread"),
        F.median(sd).alias("_m"), F.max_by("model", "rate").alias("highest"), F.min_by("model", "rate").alias("lowest"),
    ).where("n_models >= 2")
    return out.withColumn("agreement", F.exp(-F.col("spread") / (2 * F.col("_m")))).withColumn(
        "is_flagged", F.col("agreement") < 0.5
    ).drop("_m")


def applicability(laps: DataFrame, queries: DataFrame, by=("session_id",)) -> DataFrame:
    """How far each asked situation (mode, age, interference) lies outside what was observed."""
    by = list(by)
    per_mode = laps.groupBy(*by, "mode").agg(
        F.count(F.lit(1)).alias("_n"), F.count_distinct("run_id").alias("_runs"), F.max("age").alias("_age")
    )
    top = laps.groupBy(*by).agg(F.max("interference").alias("_i"))
    j = queries.join(per_mode, [*by, "mode"], "left").join(top, by, "left").fillna(0, ["_n", "_runs", "_age"])
    over = F.greatest(F.col("age") - F.col("_age"), F.lit(0.0))
    j = j.withColumn("coverage", F.least(F.col("_n") / 40, F.lit(1.0)) * F.least(F.col("_runs") / 3, F.lit(1.0))).withColumn(
        "laps_beyond", over
    ).withColumn("age_score", F.exp(-over / 6)).withColumn(
        "interference_score", F.when(F.col("interference") <= F.col("_i") + 0.05, 1.0).otherwise(0.6)
    )
    j = j.withColumn("applicability", F.pow(F.col("coverage") * F.col("age_score") * F.col("interference_score"), F.lit(1.0 / 3.0)))
    risk = F.when(F.col("applicability") > 0.7, "low").when(F.col("applicability") > 0.4, "medium").otherwise("high")
    reasons = F.filter(F.array(
        F.when(F.col("_n") == 0, F.lit("mode never run")).when(F.col("_n") < 15, F.format_string("only %d laps over %d runs", "_n", "_runs")),
        F.when(F.col("laps_beyond") > 3, F.format_string("%.0f laps past the oldest unit seen", "laps_beyond")),
        F.when(F.col("interference_score") < 1, F.lit("more interference than observed")),
    ), lambda r: r.isNotNull())
    return j.withColumn("risk", risk).withColumn(
        "reasons", F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("inside the observed range")))
    ).drop("_n", "_runs", "_age", "_i")


def value_of_information(rates: DataFrame, signals, by=("session_id",)) -> DataFrame:
    """Measurements ranked by how much of the mean rate uncertainty they would remove.

    ``signals`` is the caller's list of (measurement, share of the uncertainty it would remove, what it would settle).
    """
    current = rates.groupBy(*by).agg(F.avg("rate_sd").alias("current_uncertainty"))
    options = F.array(*[F.struct(F.lit(s).alias("signal"), F.lit(float(r)).alias("reduction"), F.lit(why).alias("why")) for s, r, why in signals])
    return current.withColumn("_s", F.explode(options)).select(
        *by, "_s.signal", "current_uncertainty", F.col("_s.reduction").alias("estimated_reduction"),
        (F.col("current_uncertainty") * (1 - F.col("_s.reduction"))).alias("projected_uncertainty"), F.col("_s.why").alias("rationale"), F.lit(True).alias("is_estimate"),
    ).orderBy(*by, F.desc("estimated_reduction"))
