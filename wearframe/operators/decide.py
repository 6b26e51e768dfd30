"""Stop-or-continue decisions in closed form.

A step costs base + pace + rate * age + cliff loss (+ traffic) + noise, times the
slowdown if an event falls on it; the two rates are normal, events are independent
coin throws, a stop under an event is cheaper. Expected cost and variance of a
plan are therefore sums over its steps: running sums of staying up to the stop,
running sums of the next mode after it. A case has one row per remaining step
and an option is two look-ups, so the work is steps + options and nothing is drawn.
Cases, their steps and their options grow with the input, and the optimizer takes
exploded rows for as small as the file they come from: joins between them are merged,
so that no table of cases is collected to be broadcast.
Quantiles and win probabilities take the cost of a whole plan as normal.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wearframe.functions import gaussian
from wearframe.operators import slices

# Fixed default values.
STOP_LOSS = 21.0
TRAFFIC_LOSS = 0.45
EVENT_RATE = 0.009
EVENT_DISCOUNT = 0.45
EVENT_SLOWDOWN = 1.35
NOISE_SD = 0.25
TRAFFIC_GAP = 1.2
CLIFF_SEVERITY = 0.004


def moments(event_rate=EVENT_RATE):
    """Mean, variance of a step's event factor; mean and variance of a stop's; and their covariance (stop loss 1)."""
    up, down, spread = EVENT_SLOWDOWN - 1, 1 - EVENT_DISCOUNT, event_rate * (1 - event_rate)
    return {"mean": 1 + up * event_rate, "var": up * up * spread, "stop": 1 - down * event_rate, "stop_var": down * down * spread, "cov": -up * down * spread}


def _merged(df: DataFrame) -> DataFrame:
    """The rows of a side that must be shuffled and sorted for its join, whatever its size is taken for."""
    return df.hint("merge")


def default_options(cases: DataFrame, waits=(0, 2, 5, 8)) -> DataFrame:
    """Stay out, or stop after each wait that still lies inside the distance: (case_id, option, stop_at)."""
    plans = [F.struct(F.lit("Stay out").alias("option"), F.lit(None).cast("long").alias("stop_at"))]
    for w in waits:
        label = "Box now" if w == 0 else f"Box in {w} laps"
        plans.append(F.struct(F.lit(label).alias("option"), (F.col("now") + 1 + w).cast("long").alias("stop_at")))
    return cases.withColumn("_p", F.explode(F.array(*plans))).where(
        F.col("_p.stop_at").isNull() | (F.col("_p.stop_at") <= F.col("total"))
    ).select("case_id", "_p.option", "_p.stop_at")


def sweep_plan(cases: DataFrame) -> DataFrame:
    """Stay out plus every remaining lap as a stop."""
    laps = F.when(F.col("total") > F.col("now"), F.sequence(F.col("now") + 1, F.col("total")))
    stops = F.transform(laps, lambda s: F.struct(F.concat(F.lit("stop "), s.cast("string")).alias("option"), s.cast("long").alias("stop_at")))
    stay = F.array(F.struct(F.lit("stay out").alias("option"), F.lit(None).cast("long").alias("stop_at")))
    return cases.withColumn("_p", F.explode(F.concat(stay, stops))).select("case_id", "_p.option", "_p.stop_at")


def _step(k, traffic=TRAFFIC_LOSS):
    """Mean cost and age of the k-th step ahead on the current unit and of the k-th step of the next mode."""
    age = F.col("age") + k
    past = lambda a, limit: F.greatest(a - F.col(limit), F.lit(0.0))
    slow = F.when(F.col("gap_ahead") < TRAFFIC_GAP, F.lit(float(traffic))).otherwise(0.0)
    stay = F.col("base") + F.col("base_pace") + F.col("rate") * age + CLIFF_SEVERITY * F.pow(past(age, "cliff_age"), F.lit(2)) + slow
    new = F.col("base") + F.col("new_base_pace") + F.col("new_rate") * k + CLIFF_SEVERITY * F.pow(past(k, "new_cliff_age"), F.lit(2))
    return stay, age, new


def running_costs(cases: DataFrame) -> DataFrame:
    """Per case and number of steps k = 0..left: sums of mean costs, ages and expected squares, staying (``0``) and after a stop (``1``)."""
    left = (F.col("total") - F.col("now")).cast("int")
    rows = cases.withColumn("k", F.explode(F.sequence(F.lit(0), F.greatest(left, F.lit(0)))))
    stay, age, new = _step(F.col("k").cast("double"))
    some = lambda x: F.when(F.col("k") > 0, x).otherwise(0.0)
    w = Window.partitionBy("case_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        "case_id", "k",
        F.sum(some(stay)).over(w).alias("m0"), F.sum(some(age)).over(w).alias("a0"),
        F.sum(some(stay * stay + F.pow("rate_sd", F.lit(2)) * age * age)).over(w).alias("q0"), F.max(some((age > F.col("cliff_age")).cast("double"))).over(w).alias("c0"),
        F.sum(some(new)).over(w).alias("m1"), F.sum(some(F.col("k").cast("double"))).over(w).alias("a1"),
        F.sum(some(new * new + F.pow("new_rate_sd", F.lit(2)) * F.col("k") * F.col("k"))).over(w).alias("q1"),
        F.max(some((F.col("k") > F.col("new_cliff_age")).cast("double"))).over(w).alias("c1"),
    )


def outcomes(cases: DataFrame, options: DataFrame, noise_sd=NOISE_SD, event_rate=EVENT_RATE) -> DataFrame:
    """Expected cost, spread, 10/90% points and passing of the cliff per option, ranked.

    cases: case_id, now, total, age, base, stop_loss, gap_ahead and, for the
    current and the next mode, rate, rate_sd, base_pace, cliff_age (prefixed
    ``new_``). options: case_id, option, stop_at (null: never). A stop without a next mode is no option.
    """
    e = moments(event_rate)
    sums = running_costs(cases)
    left = (F.col("total") - F.col("now")).cast("int")
    stays = F.col("stop_at").isNull()
    facts = cases.select("case_id", "now", "total", "rate_sd", "new_rate_sd", "stop_loss", (F.col("new_rate").isNotNull() & F.col("new_base_pace").isNotNull()).alias("_next"))
    plan = options.join(_merged(facts), "case_id").where(stays | F.col("_next")).withColumn("_left", F.greatest(left, F.lit(0))).withColumn(
        "_on", F.when(stays, F.col("_left")).otherwise((F.col("stop_at") - F.col("now") - 1).cast("int"))
    ).withColumn("_off", F.col("_left") - F.col("_on"))
    before = sums.select("case_id", F.col("k").alias("_on"), "m0", "a0", "q0", "c0")
    after = sums.select("case_id", F.col("k").alias("_off"), "m1", "a1", "q1", "c1")
    first = sums.where("k = 1").select("case_id", F.col("m1").alias("_first"))
    j = plan.join(_merged(before), ["case_id", "_on"]).join(_merged(after), ["case_id", "_off"]).join(_merged(first), "case_id", "left")
    if_stop = lambda x: F.when(stays, 0.0).otherwise(x)
    none = lambda c: F.when(F.col("_off") == 0, 0.0).otherwise(F.col(c))
    expected = e["mean"] * (F.col("m0") + none("m1")) + if_stop(e["stop"] * F.col("stop_loss"))
    variance = (
        e["mean"] ** 2 * (F.pow(F.col("rate_sd") * F.col("a0"), F.lit(2)) + F.coalesce(F.pow(F.col("new_rate_sd") * none("a1"), F.lit(2)), F.lit(0.0)))
        + e["var"] * (F.col("q0") + none("q1")) + (e["mean"] ** 2 + e["var"]) * noise_sd**2 * F.col("_left")
        + if_stop(e["stop_var"] * F.pow("stop_loss", F.lit(2)) + 2 * e["cov"] * F.col("stop_loss") * F.col("_first"))
    )
    z = gaussian.ppf(0.9)
    table = j.select("case_id", "option", "stop_at", expected.alias("expected"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("sd"),
                     F.greatest("c0", none("c1")).alias("past_cliff"))
    table = table.withColumn("p10", F.col("expected") - z * F.col("sd")).withColumn("p90", F.col("expected") + z * F.col("sd"))
    return table.withColumn("position", F.row_number().over(Window.partitionBy("case_id").orderBy("expected", "option")))


def recommend(cases: DataFrame, table: DataFrame, event_rate=EVENT_RATE) -> DataFrame:
    """Best option per case, its margin over the runner-up, and how likely it wins under the same rates, noise and events.

    The noise of both is the same and cancels; steps on which both do the same cost the same.
    """
    e = moments(event_rate)
    at = lambda c, k: F.max(F.when(F.col("position") == k, F.col(c)))
    heads = table.where("position <= 2").groupBy("case_id").agg(
        at("option", 1).alias("recommended"), F.coalesce(at("option", 2), at("option", 1)).alias("runner_up"),
        (F.coalesce(at("expected", 2), at("expected", 1)) - at("expected", 1)).alias("margin"),
        at("past_cliff", 1).alias("past_cliff"), at("stop_at", 1).alias("_s1"), at("stop_at", 2).alias("_s2"), F.count(F.lit(1)).alias("_n"),
    )
    j = heads.join(_merged(cases), "case_id")
    steps = F.sequence(F.lit(1), F.greatest((F.col("total") - F.col("now")).cast("int"), F.lit(1)))

    def on(k, stop):
        """(stopped, step of the next mode) at step k of a plan."""
        i = (F.col(stop) - F.col("now")).cast("int")
        return F.coalesce(k >= i, F.lit(False)), (k - i + 1).cast("double")

    def difference(k):
        stay, age, _ = _step(k.cast("double"))
        costs, ages, news = [], [], []
        for stop in ("_s1", "_s2"):
            stopped, n = on(k, stop)
            costs.append(F.when(stopped, _step(n)[2]).otherwise(stay))
            ages.append(F.when(stopped, 0.0).otherwise(age))
            news.append(F.when(stopped, n).otherwise(0.0))
        d, a0, a1 = costs[0] - costs[1], ages[0] - ages[1], news[0] - news[1]
        square = d * d + F.pow(F.col("rate_sd") * a0, F.lit(2)) + F.coalesce(F.pow(F.col("new_rate_sd") * a1, F.lit(2)), F.lit(0.0))
        # at a stop, the event factor of the difference and the stop's own go together
        shared = sum((sign * F.when(F.coalesce(k == (F.col(stop) - F.col("now")).cast("int"), F.lit(False)), d).otherwise(0.0) for sign, stop in ((1, "_s1"), (-1, "_s2"))), F.lit(0.0))
        return F.struct(a0.alias("a0"), a1.alias("a1"), square.alias("q"), shared.alias("s"))

    j = j.withColumn("_steps", F.transform(steps, difference))
    total = lambda f: F.aggregate("_steps", F.lit(0.0), lambda x, y: x + F.coalesce(y[f], F.lit(0.0)))
    n_stops = F.col("_s1").isNotNull().cast("int") + F.col("_s2").isNotNull().cast("int")
    variance = (
        e["mean"] ** 2 * (F.pow(F.col("rate_sd") * total("a0"), F.lit(2)) + F.coalesce(F.pow(F.col("new_rate_sd") * total("a1"), F.lit(2)), F.lit(0.0)))
        + e["var"] * total("q") + n_stops * e["stop_var"] * F.pow("stop_loss", F.lit(2)) + 2 * e["cov"] * F.col("stop_loss") * total("s")
    )
    loss = F.col("rate") * F.col("age") + F.lit(CLIFF_SEVERITY) * F.pow(F.greatest(F.col("age") - F.col("cliff_age"), F.lit(0.0)), F.lit(2))
    out = j.withColumn("_sd", F.sqrt(F.greatest(variance, F.lit(0.0)))).withColumn("_z", F.when(F.col("_sd") > 0, F.col("margin") / F.col("_sd")).otherwise(40.0))
    return out.withColumn("win_probability", F.when(F.col("_n") < 2, 1.0).otherwise(gaussian.cdf("_z"))).withColumn("loss_now", loss).select(
        "case_id", "recommended", "runner_up", "margin", "past_cliff", "win_probability", "mode", "age", "rate", "rate_sd", "gap_ahead", "loss_now"
    )


def stop_window(table: DataFrame, within=1.0) -> DataFrame:
    """Optimal stop, the stops within a second of it, and what staying out costs more."""
    stops = table.where("stop_at IS NOT NULL")
    best = stops.groupBy("case_id").agg(
        F.min("expected").alias("optimum_expected"), F.min_by("stop_at", F.struct("expected", "stop_at")).alias("optimum")
    )
    near = stops.join(_merged(best), "case_id").where(F.col("expected") <= F.col("optimum_expected") + within).groupBy("case_id").agg(
        F.min("stop_at").alias("window_from"), F.max("stop_at").alias("window_to")
    )
    stay = table.where("stop_at IS NULL").select("case_id", F.col("expected").alias("stay_out_expected"))
    return best.join(_merged(near), "case_id").join(_merged(stay), "case_id", "left").withColumn(
        "stay_out_cost", F.col("stay_out_expected") - F.col("optimum_expected")
    )


def regret(table: DataFrame, choices: DataFrame) -> DataFrame:
    """Expected cost of the stop actually made over the recommended one, never below zero.

    choices(case_id, recommended, actual) name options.
    """
    t = table.select("case_id", "option", "expected")
    rec = t.withColumnRenamed("option", "recommended").withColumnRenamed("expected", "recommended_expected")
    act = t.withColumnRenamed("option", "actual").withColumnRenamed("expected", "actual_expected")
    return choices.join(_merged(rec), ["case_id", "recommended"]).join(_merged(act), ["case_id", "actual"]).withColumn(
        "regret", F.greatest(F.lit(0.0), F.col("actual_expected") - F.col("recommended_expected"))
    )


def histogram(df: DataFrame, value: str, by=("case_id", "option"), bins=28) -> DataFrame:
    """Equal-width bins between each group's extremes, with the group's mean and 10/90% points: (by, bin, centre, n, mean, p10, p90)."""
    by = list(by)
    span = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    joined = df.join(span, by)
    lo = F.when(F.col("_hi") > F.col("_lo"), F.col("_lo")).otherwise(F.col("_lo") - 0.5)
    width = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0) / bins
    b = F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1)).cast("int")
    counted = joined.select(*by, b.alias("bin"), (lo + (b + 0.5) * width).alias("centre"), F.col(value).alias("_v")).groupBy(*by, "bin").agg(
        F.first("centre").alias("centre"), F.count(F.lit(1)).alias("n"), F.sum("_v").alias("_sum")
    )
    mean = counted.groupBy(*by).agg((F.sum("_sum") / F.sum("n")).alias("mean"))
    points = slices.exact_percentiles(df, by, value, {"p10": 0.1, "p90": 0.9}).drop("n_values")
    return counted.drop("_sum").join(mean, by).join(points, by)
