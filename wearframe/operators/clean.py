"""From raw timing rows to a lap table, with every excluded row accounted for."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearframe.operators import slices
from wearframe.operators.staging import stage
from wearframe.operators.windows import elapsed, lookback_interference, mark_runs

#: Mode labels; fixed values.
UNKNOWN_MODES = ("UNKNOWN", "TEST_UNKNOWN", "NAN", "NONE", "")
WET_MODES = ("INTERMEDIATE", "WET")

#: Exclusion reasons in the order they are charged.
REASONS = (
    "no_lap_time", "pit_in_out_lap", "flagged_inaccurate", "unknown_compound", "wet_compound",
    "slow_lap_safety_car_or_traffic", "run_too_short",
)


def _first_reasons(raw, include_wet):
    reason = (
        F.when(F.col("perf").isNull(), REASONS[0])
        .when(F.col("pit_in").isNotNull() | F.col("pit_out").isNotNull(), REASONS[1])
    )
    if "is_accurate" in raw.columns:
        reason = reason.when(~F.coalesce(F.col("is_accurate"), F.lit(False)), REASONS[2])
    label = F.upper("mode")
    reason = reason.when(label.isNull() | label.isin(*UNKNOWN_MODES), REASONS[3])
    if not include_wet:
        reason = reason.when(label.isin(*WET_MODES), REASONS[4])
    return reason


def slow_limits(laps: DataFrame, k=3.0, session="session_id") -> DataFrame:
    """One-sided robust limit per session: median + k * max(1.4826 * MAD, 0.05)."""
    centre = slices.exact_median(laps, session, "perf", "median")
    spread = slices.exact_median(
        laps.join(centre, session).withColumn("_dev", F.abs(F.col("perf") - F.col("median"))), session, "_dev", "mad"
    )
    return centre.join(spread, session).withColumn(
        "limit", F.col("median") + F.lit(k) * F.greatest(F.lit(1.4826) * F.col("mad"), F.lit(0.05))
    )


def label_exclusions(raw: DataFrame, min_run=4, k=3.0, include_wet=False) -> DataFrame:
    """Raw rows with ``reason``: the first exclusion each meets, null if it is kept.

    Raw columns: session_id, asset, lap, stint, mode, age, perf, pit_in,
    pit_out, start and optionally is_accurate.
    """
    rows = stage(raw.withColumn("reason", _first_reasons(raw, include_wet)))
    usable = rows.where("reason IS NULL")
    limits = slow_limits(usable, k).select("session_id", "limit")
    rows = stage(rows.join(limits, "session_id", "left").withColumn(
        "reason", F.coalesce("reason", F.when(F.col("perf") > F.col("limit"), REASONS[5]))
    ).drop("limit"))
    runs = mark_runs(rows.where("reason IS NULL"))
    short = runs.groupBy("session_id", "run_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < min_run)
    kept = (
        runs.join(short, ["session_id", "run_id"], "left")
        .withColumn("reason", F.when(F.col("_n").isNotNull(), REASONS[6]))
        .drop("_n", "run_id")
    )
    return rows.where("reason IS NOT NULL").unionByName(kept)


def exclusion_ledger(labelled: DataFrame) -> DataFrame:
    """Rows charged to each reason, per session; reasons nobody met are absent."""
    return labelled.where("reason IS NOT NULL").groupBy("session_id", "reason").agg(
        F.count(F.lit(1)).alias("n")
    )


def clean_laps(labelled: DataFrame, full=0.4, clear=2.0, slice_seconds=3600.0) -> DataFrame:
    """The lap table of the rows that were kept: runs renumbered, interference and elapsed added.

    Only surviving rows count as traffic.
    """
    runs = stage(mark_runs(labelled.where("reason IS NULL")))
    laps = lookback_interference(
        runs, order=("asset", "lap"), full=full, clear=clear, slice_seconds=slice_seconds
    )
    return elapsed(laps).select(
        "session_id", "asset", F.col("lap").alias("seq"), "run_id", "age", "elapsed", "perf",
        F.upper("mode").alias("mode"), "interference",
    )


def session_quality(raw: DataFrame, laps: DataFrame) -> DataFrame:
    """Counts, retention and a 0-100 score per session."""
    totals = raw.groupBy("session_id").agg(F.count(F.lit(1)).alias("total_laps"))
    kept = laps.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("retained_laps"),
        F.count_distinct("asset").alias("n_assets"),
        F.count_distinct("run_id").alias("n_runs"),
    )
    longest = laps.groupBy("session_id", "run_id").agg(F.count(F.lit(1)).alias("_n")).groupBy("session_id").agg(
        F.max("_n").alias("longest_run")
    )
    medians = slices.exact_median(laps, "session_id", "perf", "median_perf")
    out = totals.join(kept, "session_id", "left").join(longest, "session_id", "left").join(
        medians, "session_id", "left"
    ).fillna(0, ["retained_laps", "n_assets", "n_runs", "longest_run"])
    retention = F.col("retained_laps") / F.col("total_laps")
    return out.withColumn("retention", retention).withColumn(
        "score",
        100.0 * (
            0.3 * F.least(F.col("retention") / 0.6, F.lit(1.0))
            + 0.4 * F.least(F.col("longest_run") / 12.0, F.lit(1.0))
            + 0.3 * F.least(F.col("n_assets") / 15.0, F.lit(1.0))
        ),
    )


def validate(laps: DataFrame, seq="seq") -> DataFrame:
    """Violations per session: null perf rows and rows whose age steps back inside a run.

    Missing columns raise, since no row can be checked without them.
    """
    from wearframe.operators.windows import age_violations

    required = ["session_id", "asset", seq, "run_id", "age", "elapsed", "perf", "mode"]
    missing = [c for c in required if c not in laps.columns]
    if missing:
        raise ValueError(f"lap table is missing columns: {missing}")
    nulls = laps.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_laps"), F.count_if(F.col("perf").isNull()).alias("null_perf")
    )
    steps = age_violations(laps, seq=seq).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("age_steps_back"), F.count_distinct("run_id").alias("runs_affected")
    )
    return nulls.join(steps, "session_id", "left").fillna(0, ["age_steps_back", "runs_affected"]).withColumn(
        "is_valid", (F.col("null_perf") == 0) & (F.col("age_steps_back") == 0)
    )


def conditions(weather: DataFrame, raw: DataFrame, wet_limit=0.40) -> DataFrame:
    """Weather means and extremes, wet share and the dry verdict, one row per session."""
    sky = weather.groupBy("session_id").agg(
        F.avg("track_temp").alias("track_temp"),
        F.min("track_temp").alias("track_temp_min"),
        F.max("track_temp").alias("track_temp_max"),
        F.avg("air_temp").alias("air_temp"),
        F.avg("humidity").alias("humidity"),
        F.avg("wind_speed").alias("wind_speed"),
        F.bool_or("rainfall").alias("rainfall"),
    )
    tyres = raw.groupBy("session_id").agg(
        F.count_if(F.upper("mode").isin(*WET_MODES)).alias("wet_laps"), F.count(F.lit(1)).alias("total_laps")
    )
    joined = sky.join(tyres, "session_id").withColumn("wet_fraction", F.col("wet_laps") / F.col("total_laps"))
    dry = F.col("wet_fraction") < wet_limit
    return joined.withColumn("rain_advisory", F.col("rainfall") & dry).withColumn("is_dry", dry)


def dry_sessions(sessions: DataFrame, described: DataFrame) -> DataFrame:
    """Sessions not known to be wet; a session nobody described counts as dry."""
    return (
        sessions.join(described.select("session_id", "is_dry"), "session_id", "left")
        .where(F.coalesce(F.col("is_dry"), F.lit(True)))
        .drop("is_dry")
    )


def resolve_events(requests: DataFrame, events: DataFrame, aliases: DataFrame) -> DataFrame:
    """Requested names against a season calendar: alias first, then any shared longer word.

    requests(year, requested), events(year, event, location, country),
    aliases(alias, event). A request that matches nothing keeps a null event.
    Words meet events through a run of four letters and are then looked for in
    full, once per distinct word, so requests and events are never paired. The
    calendar is read as distinct events, and its joins are merged: spelled out, it
    is many times what the optimizer takes it for, too much to be broadcast.
    """
    asked = requests.select("year", "requested").distinct().withColumn("_key", F.lower(F.trim("requested")))
    named = asked.join(
        aliases.select(F.lower("alias").alias("_key"), F.col("event").alias("_alias_event")), "_key", "left"
    )
    direct = named.where("_alias_event IS NOT NULL").join(
        events.select("year", F.col("event").alias("_alias_event")).distinct().hint("merge"), ["year", "_alias_event"], "left_semi"
    ).select("year", "requested", F.col("_alias_event").alias("event"), F.lit("alias").alias("how"))
    words = F.filter(F.split(F.translate("_key", "-", " "), "\\s+"), lambda w: F.length(w) > 3)
    hay = F.lower(F.concat_ws(" ", "event", "location", "country"))
    each = named.where("_alias_event IS NULL").select("year", "requested", F.explode(words).alias("_word"))
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("_hay") - 3, F.lit(1))), lambda i: F.substring(F.col("_hay"), i, F.lit(4))))
    spelled = events.select("year", "event", hay.alias("_hay")).distinct().select("year", "event", "_hay", F.explode(runs).alias("_run"))
    found = (
        each.select("year", "_word").distinct().withColumn("_run", F.substring("_word", 1, 4)).join(spelled.hint("merge"), ["year", "_run"])
        .where(F.instr(F.col("_hay"), F.col("_word")) > 0).groupBy("year", "_word").agg(F.min("event").alias("event"))
    )
    guarded = each.join(found, ["year", "_word"]).groupBy("year", "requested").agg(F.min("event").alias("event")).withColumn("how", F.lit("words"))
    return asked.select("year", "requested").join(
        direct.unionByName(guarded), ["year", "requested"], "left"
    ).withColumn("how", F.coalesce("how", F.lit("no match")))
