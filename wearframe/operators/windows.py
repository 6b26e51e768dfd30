"""Ordered per-group columns: runs, elapsed use, look-back, run index, folds."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wearframe.operators import slices


def lookback_interference(
    df: DataFrame, session="session_id", asset="asset", start="start", order=("asset", "lap"),
    slice_col=None, full=0.4, clear=2.0, slice_seconds=3600.0,
) -> DataFrame:
    """Backward as-of to the latest start by a *different* asset of the session.

    Adds ``gap`` (seconds, null if nobody went before) and ``interference`` =
    clip((clear - gap) / (clear - full), 0, 1), 0 where there is no gap.
    Equal starts keep the ``order`` columns' order.

    Inside a slice of the session the answer is the last row before the current
    block of same-asset rows. Across slices only two rows per slice matter: its
    last row, and its last row by another asset than that one.
    """
    own_slice = slice_col is None
    slice_col = slice_col or "_slice"
    known = df.where(F.col(start).isNotNull())
    unknown = df.where(F.col(start).isNull())
    if own_slice:
        known = known.withColumn(slice_col, F.floor(F.col(start) / slice_seconds).cast("long"))
    inner = [session, slice_col]
    by_order = Window.partitionBy(*inner).orderBy(start, *order)
    upto = by_order.rowsBetween(Window.unboundedPreceding, 0)
    prev_asset, prev_start = F.lag(asset).over(by_order), F.lag(start).over(by_order)
    rows = known.withColumn(
        "_edge", F.when(prev_asset != F.col(asset), F.struct(prev_asset.alias("a"), prev_start.alias("s")))
    ).withColumn("_other", F.last("_edge", ignorenulls=True).over(upto))

    rank = F.struct(F.col(start), *[F.col(c) if isinstance(c, str) else c for c in order])
    ends = rows.groupBy(*inner).agg(
        F.max_by(
            F.struct(F.col(asset).alias("a"), F.col(start).alias("s"), F.col("_other").alias("o")), rank
        ).alias("_end")
    )
    reps = ends.select(
        *inner,
        F.explode(F.filter(F.array(
            F.struct(F.lit(0).alias("k"), F.col("_end.o.a").alias("a"), F.col("_end.o.s").alias("s")),
            F.struct(F.lit(1).alias("k"), F.col("_end.a").alias("a"), F.col("_end.s").alias("s")),
        ), lambda r: r["a"].isNotNull())).alias("r"),
    ).select(*inner, "r.k", "r.a", "r.s")
    over_reps = Window.partitionBy(session).orderBy(slice_col, "k")
    reps_upto = over_reps.rowsBetween(Window.unboundedPreceding, 0)
    reps = reps.withColumn(
        "_e", F.when(F.lag("a").over(over_reps) != F.col("a"), F.lag("s").over(over_reps))
    ).withColumn("_o", F.last("_e", ignorenulls=True).over(reps_upto))
    per_slice = Window.partitionBy(session).orderBy(slice_col)
    carry = reps.where("k = 1").select(
        *inner,
        F.lag(F.struct("a", "s", "_o")).over(per_slice).alias("_carry"),
    )
    out = rows.join(carry, inner, "left")
    previous = F.coalesce(
        F.col("_other.s"),
        F.when(F.col("_carry.a") != F.col(asset), F.col("_carry.s")).otherwise(F.col("_carry._o")),
    )
    out = out.withColumn("gap", F.col(start) - previous).drop("_edge", "_other", "_carry")
    if own_slice:
        out = out.drop(slice_col)
    out = out.unionByName(unknown.withColumn("gap", F.lit(None).cast("double")))
    scaled = (F.lit(clear) - F.col("gap")) / F.lit(clear - full)
    # least and greatest skip nulls, so a missing gap has to be told apart first
    return out.withColumn(
        "interference", F.when(F.col("gap").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)))
    )


def elapsed(df: DataFrame, keys=("asset", "run_id"), age="age") -> DataFrame:
    """Use since the unit was fitted: age minus the run's lowest age, gaps included."""
    floor_age = df.groupBy(*keys).agg(F.min(age).alias("_floor"))
    return df.drop("elapsed").join(floor_age, list(keys)).withColumn(
        "elapsed", (F.col(age) - F.col("_floor")).cast("double")
    ).drop("_floor")


def mark_runs(df: DataFrame, session="session_id", asset="asset", lap="lap", stint="stint", mode="mode",
              age="age", width=4096) -> DataFrame:
    """Number the contiguous blocks of one asset on one unit, across the session.

    A run breaks where the asset, stint or mode changes or age steps back.
    Rows are ordered by (asset, lap); numbering starts at 1 in each session.
    """
    df = df.withColumn("_slice", F.floor(F.col(lap) / F.lit(width)).cast("long"))
    inner = [session, asset, "_slice"]
    by_lap = Window.partitionBy(*inner).orderBy(lap)
    watched = F.struct(F.col(stint).alias("stint"), F.col(mode).alias("mode"), F.col(age).alias("age"))

    def broken(now, before):
        return (
            ~now["stint"].eqNullSafe(before["stint"])
            | ~now["mode"].eqNullSafe(before["mode"])
            | F.coalesce(now["age"] < before["age"], F.lit(False))
        )

    rows = df.withColumn("_w", watched).withColumn("_p", F.lag("_w").over(by_lap))
    rows = rows.withColumn(
        "_new", F.when(F.col("_p").isNull(), 0).otherwise(broken(F.col("_w"), F.col("_p")).cast("int"))
    )
    summary = rows.groupBy(*inner).agg(
        F.sum("_new").alias("_inside"),
        F.min_by("_w", lap).alias("_first"),
        F.max_by("_w", lap).alias("_last"),
    )
    in_asset = Window.partitionBy(session, asset).orderBy("_slice")
    summary = summary.withColumn("_before", F.lag("_last").over(in_asset)).withColumn(
        "_start",
        F.when(F.col("_before").isNull(), 1).otherwise(broken(F.col("_first"), F.col("_before")).cast("int")),
    )
    in_session = Window.partitionBy(session).orderBy(asset, "_slice")
    carry = summary.select(
        *inner,
        (
            F.sum(F.col("_inside") + F.col("_start")).over(in_session.rowsBetween(Window.unboundedPreceding, 0))
            - F.col("_inside")
        ).alias("_offset"),
    )
    running = F.sum("_new").over(by_lap.rowsBetween(Window.unboundedPreceding, 0))
    return (
        rows.join(carry, inner)
        .withColumn("run_id", (F.col("_offset") + running).cast("long"))
        .drop("_w", "_p", "_new", "_offset", "_slice")
    )


def run_index(df: DataFrame, session="session_id", asset="asset", run="run_id") -> DataFrame:
    """0-based index of each run within its asset, ranked by run id."""
    runs = df.select(session, asset, run).distinct()
    ranked = runs.withColumn(
        "run_index", (F.row_number().over(Window.partitionBy(session, asset).orderBy(run)) - 1).cast("int")
    )
    return df.join(ranked, [session, asset, run])


def deviation(df: DataFrame, keys, value: str, name="deviation", size="group_size") -> DataFrame:
    """Distance from the group mean, with the group size alongside."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.count(value).alias(size))
    return df.join(stats, keys).withColumn(name, F.col(value) - F.col("_mean")).drop("_mean")


def rolling_folds(df: DataFrame, session="session_id", seq="seq", n=4, frac=0.4) -> DataFrame:
    """Rolling-origin fold edges per session: (session, fold, cut, last).

    The distinct seqs of a session are ranked; the first ``frac`` always train,
    the rest is cut into ``n`` test spans. A row trains a fold when
    seq <= cut, and tests it when cut < seq <= last. Folds with fewer than 20
    training or 5 test rows are left out, as are sessions with too few seqs.
    """
    counts = df.groupBy(session, seq).agg(F.count(F.lit(1)).alias("_rows"))
    ranked = counts.select(
        session, seq, "_rows",
        F.row_number().over(Window.partitionBy(session).orderBy(seq)).alias("_rank"),
        F.count(F.lit(1)).over(Window.partitionBy(session)).alias("_len"),
        F.sum("_rows").over(
            Window.partitionBy(session).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
        ).alias("_upto"),
    ).where(F.col("_len") >= n + 2)
    first = F.floor(F.lit(frac) * F.col("_len"))
    edge = [(first + F.lit(k) * (F.col("_len") - first) / F.lit(n)).cast("int") for k in range(n + 1)]
    spans = F.array(*[
        F.struct(
            F.lit(k).alias("fold"),
            F.greatest(edge[k], F.lit(1)).alias("lo"),
            F.greatest(edge[k + 1], F.lit(1)).alias("hi"),
        )
        for k in range(n)
    ])
    exploded = ranked.withColumn("_span", F.explode(spans))
    folds = exploded.groupBy(session, F.col("_span.fold").alias("fold")).agg(
        F.max(F.when(F.col("_rank") == F.col("_span.lo"), F.col(seq))).alias("cut"),
        F.max(F.when(F.col("_rank") == F.col("_span.hi"), F.col(seq))).alias("last"),
        F.max(F.when(F.col("_rank") == F.col("_span.lo"), F.col("_upto"))).alias("n_train"),
        F.max(F.when(F.col("_rank") == F.col("_span.hi"), F.col("_upto"))).alias("_seen"),
    )
    return folds.withColumn("n_test", F.col("_seen") - F.col("n_train")).drop("_seen").where(
        "n_train >= 20 AND n_test >= 5"
    )


def transitions(df: DataFrame, session="session_id", asset="asset", seq="seq", run="run_id", age="age",
                width=256) -> DataFrame:
    """Per asset and seq: whether a new unit was fitted, and the age gained otherwise."""
    df = df.withColumn("_slice", F.floor(F.col(seq) / F.lit(width)).cast("long"))
    out = slices.previous(df, [session, asset], "_slice", [seq], {"_run": run, "_age": age})
    reset = F.col("_run").isNull() | (F.col("_run") != F.col(run))
    return (
        out.withColumn("is_reset", reset)
        .withColumn("age_gain", F.when(reset, 0.0).otherwise(F.greatest(F.col(age) - F.col("_age"), F.lit(0.0))))
        .drop("_slice", "_run", "_age")
    )


def age_violations(df: DataFrame, session="session_id", run="run_id", seq="seq", age="age", width=256) -> DataFrame:
    """Rows whose age is below the previous row of their run."""
    df = df.withColumn("_slice", F.floor(F.col(seq) / F.lit(width)).cast("long"))
    out = slices.previous(df, [session, run], "_slice", [seq], {"_age": age})
    return out.where(F.col(age) < F.col("_age")).drop("_slice", "_age")


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def saturating_drift(laps: DataFrame, shape: float, session="session_id", seq="seq") -> DataFrame:
    """Adds ``drift_basis``: -(1 - exp(-shape * laps since the session began)), from 0 towards -1.

    Only each session's first seq is shuffled to its rows, so a session of any size spreads over many tasks.
    """
    first = laps.groupBy(session).agg(F.min(seq).alias("_first"))
    return laps.join(first, session).withColumn("drift_basis", -(1 - F.exp(-F.lit(float(shape)) * (F.col(seq) - F.col("_first"))))).drop("_first")
