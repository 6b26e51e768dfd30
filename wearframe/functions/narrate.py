"""Sentences built from numbers only, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Readable names of the contribution keys; fixed values.
LABELS = {"tyre": "Tyre degradation", "load": "Fuel burn-off", "drift": "Track evolution", "interference": "Traffic"}


def _label(key: Column) -> Column:
    out = key
    for k, v in LABELS.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def decomposition_text() -> Column:
    """Over the columns of ``attribute.decompose``: what the stopwatch shows, then what the unit did to it."""
    big = F.col("contributions")[0]
    # a last bit must not decide how a half is rounded
    v = lambda x: F.round(F.round(x, 9), 2) + 0.0
    head = F.format_string("Lap %d of car %s on the %s unit", F.col("seq"), F.col("asset").cast("string"), F.lower("mode"))
    hidden = F.format_string(
        " gained %.2f s over lap %d although the unit lost %.2f s: conditions hid the wear.", v(F.abs("delta")), "ref_seq", v("tyre"))
    slower = F.format_string(
        " lost %.2f s to lap %d; the unit explains %.0f%% (%.2f s), and the main cause is %s (%.2f s).",
        v("delta"), "ref_seq", F.round(F.round(100 * F.col("tyre") / F.col("delta"), 9), 0) + 0.0, v("tyre"), F.lower(_label(big["key"])), v(F.abs(big["seconds"])))
    level = F.format_string(" kept the pace of lap %d: unit %.2f s, conditions %.2f s.", "ref_seq", v("tyre"), v("confounders"))
    return F.concat(head, F.when((F.col("delta") < -0.05) & (F.col("tyre") > 0.05), hidden).when(F.col("delta") > 0.05, slower).otherwise(level))


def projection_text() -> Column:
    """Over the columns of ``attribute.competitive_life``, with a caution when it extrapolates."""
    text = F.format_string(
        "Car %s, %s unit, age %.0f: expected to pass %.1f s of loss after %.0f laps (likely %.0f to %.0f).",
        F.col("asset").cast("string"), F.lower("mode"), "age", "threshold", "life", "life_low", "life_high")
    return F.concat(text, F.when(F.col("end_applicability") < 0.5, F.lit(" No unit seen here was ever that old.")).otherwise(F.lit("")))


def shape_text() -> Column:
    """Over the columns of ``shapes.curve_shapes``."""
    return (
        F.when(F.col("regime") == "linear", F.format_string("Steady loss of %.3f s/lap.", "slope"))
        .when(F.col("regime") == "warm-up", F.format_string("Improved until age %.0f, then %.3f s/lap.", "changepoint", "slope_after"))
        .when(F.col("regime") == "cliff", F.format_string(
            "%.3f s/lap until age %.0f, %.3f s/lap after it.", "slope", "changepoint", "slope_after"))
        .otherwise(F.format_string("%.3f s/lap at first, easing to %.3f s/lap.", "slope", "slope_after"))
    )


def consensus_text() -> Column:
    """Over the columns of ``stats.consensus``."""
    return F.when(
        F.col("is_flagged"),
        F.format_string("Methods disagree on %s by %.3f s/lap: lowest %s, highest %s.", F.lower("mode"), "spread", "lowest", "highest"),
    ).otherwise(F.format_string("%d methods place %s within %.3f s/lap.", "n_models", F.lower("mode"), "spread"))


def decision_text() -> Column:
    """Over the columns of ``decide.recommend``."""
    soft = F.when(
        F.col("rate_sd") > 0.4 * F.abs("rate"),
        F.format_string("The rate is uncertain (%.3f +/- %.3f s/lap), so the margin is soft.", "rate", "rate_sd"))
    close = F.when(
        F.col("margin") < 0.5,
        F.format_string("%s and %s are %.2f s apart, within the noise.", "recommended", "runner_up", "margin"),
    ).otherwise(F.format_string("%s beats %s by %.1f s.", "recommended", "runner_up", "margin"))
    return F.concat_ws(
        " ",
        F.format_string("The %s unit is %.0f laps old and costs about %.2f s a lap.", F.lower("mode"), "age", "loss_now"),
        soft, close,
        F.format_string("It wins with probability %.0f%%.", 100 * F.col("win_probability")),
        F.when(F.col("past_cliff") > 0, F.lit("The unit passes its cliff on the way.")),
        F.when(F.col("gap_ahead") < 1.2, F.format_string("The car ahead is %.1f s away, so part of the loss is traffic.", "gap_ahead")),
    )


def finite_or_null(name: str) -> Column:
    """NaN and infinities become null, as strict JSON needs."""
    c = F.col(name)
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def payload(df, *names: str) -> Column:
    """Columns of ``df`` as a JSON object in which no number is NaN or infinite."""
    kinds = dict(df.dtypes)
    return F.to_json(F.struct(*[finite_or_null(n).alias(n) if kinds[n] in ("double", "float") else F.col(n) for n in names]))
