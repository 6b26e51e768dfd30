"""Ordered work over groups of any size.

A window partitioned by a session or an asset puts the whole group into one
task. These helpers cut a group into slices along its order (an hour of a
session, a block of positions), do the row work inside a slice, and carry what
crosses a slice boundary through one small summary row per slice. Rows are
shuffled by (group, slice), so one group holding a third of the table still
spreads over many tasks, and every result is exact.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(keys):
    return [keys] if isinstance(keys, str) else list(keys)


def same(left, right, keys):
    """Null-safe equality over several columns of two aliased frames."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def positions(df: DataFrame, keys, slice_col: str, order, name="pos", extra=None) -> DataFrame:
    """1-based position of each row in its group, in (slice, order) order.

    ``slice_col`` must grow with the order. ``extra`` maps output names to
    aggregates that are wanted per whole group (``min_by`` and similar); they
    ride on the same summary, so no second pass over the rows is needed.
    Each entry is (partial aggregate, combining window aggregate over "x").
    """
    keys = _cols(keys)
    order = [order] if isinstance(order, (str, Column)) else list(order)
    extra = extra or {}
    inner = keys + [slice_col]
    summary = df.groupBy(*inner).agg(
        F.count(F.lit(1)).alias("_n"),
        *[partial.alias(f"_{k}") for k, (partial, _) in extra.items()],
    )
    before = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carried = summary.select(
        *inner,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        *[combine(F.col(f"_{k}")).over(whole).alias(k) for k, (_, combine) in extra.items()],
    )
    local = F.row_number().over(Window.partitionBy(*inner).orderBy(*order))
    return (
        df.join(carried, inner)
        .withColumn(name, (F.col("_before") + local).cast("long"))
        .drop("_before")
    )


def halo(df: DataFrame, keys, pos: str, reach: int, width: int = 4096) -> DataFrame:
    """Cut each group into blocks of ``width`` positions with overlapping edges.

    Adds ``_block`` and ``_core``. Rows within ``reach`` of an edge are copied
    into the neighbouring block with ``_core`` false, so a lag, lead or centred
    frame of up to ``reach`` rows inside (keys, _block) sees what it would see
    in the whole group. Drop the copies with ``_core`` afterwards.
    """
    p = F.col(pos)
    own = F.floor((p - 1) / F.lit(width)).cast("long")
    left = F.floor((p - 1 - F.lit(reach)) / F.lit(width)).cast("long")
    right = F.floor((p - 1 + F.lit(reach)) / F.lit(width)).cast("long")
    blocks = F.array_distinct(F.array(own, left, right))
    return (
        df.withColumn("_own", own)
        .withColumn("_block", F.explode(blocks))
        .withColumn("_core", F.col("_block") == F.col("_own"))
        .drop("_own")
    )


def running(df: DataFrame, keys, slice_col: str, order, values: dict) -> DataFrame:
    """Running sums over a group, in (slice, order) order.

    ``values`` maps output names to column expressions.
    """
    keys = _cols(keys)
    inner = keys + [slice_col]
    order = [order] if isinstance(order, (str, Column)) else list(order)
    df = df.select("*", *[v.alias(f"_v_{k}") for k, v in values.items()])
    summary = df.groupBy(*inner).agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in values])
    before = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *inner, *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in values]
    )
    upto = Window.partitionBy(*inner).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(carried, inner)
    for k in values:
        out = out.withColumn(k, F.col(f"_b_{k}") + F.sum(f"_v_{k}").over(upto))
    return out.drop(*[f"_v_{k}" for k in values], *[f"_b_{k}" for k in values])


def running_max(df: DataFrame, keys, slice_col: str, order, values: dict) -> DataFrame:
    """Largest value so far over a group, in (slice, order) order, nulls ignored.

    ``values`` maps output names to column expressions. A slice carries the largest value of all slices before it.
    """
    keys = _cols(keys)
    inner = keys + [slice_col]
    order = [order] if isinstance(order, (str, Column)) else list(order)
    df = df.select("*", *[v.alias(f"_v_{k}") for k, v in values.items()])
    summary = df.groupBy(*inner).agg(*[F.max(f"_v_{k}").alias(f"_s_{k}") for k in values])
    before = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(*inner, *[F.max(f"_s_{k}").over(before).alias(f"_b_{k}") for k in values])
    upto = Window.partitionBy(*inner).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(carried, inner).select("*", *[F.greatest(f"_b_{k}", F.max(f"_v_{k}").over(upto)).alias(k) for k in values])
    return out.drop(*[f"_v_{k}" for k in values], *[f"_b_{k}" for k in values])


def previous(df: DataFrame, keys, slice_col: str, order, values: dict) -> DataFrame:
    """Values of the preceding row of the group, null on its first row.

    ``values`` maps output names to column names.
    """
    keys = _cols(keys)
    inner = keys + [slice_col]
    order = [order] if isinstance(order, (str, Column)) else list(order)
    packed = F.struct(*[F.col(v).alias(k) for k, v in values.items()])
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    tails = df.groupBy(*inner).agg(F.max_by(packed, rank).alias("_tail"))
    carry = tails.select(
        *inner, F.lag("_tail").over(Window.partitionBy(*keys).orderBy(slice_col)).alias("_carry")
    )
    out = df.join(carry, inner).withColumn(
        "_prev", F.coalesce(F.lag(packed).over(Window.partitionBy(*inner).orderBy(*order)), F.col("_carry"))
    )
    return out.select("*", *[F.col(f"_prev.{k}").alias(k) for k in values]).drop("_prev", "_carry")


#: Bins per unit of asinh(value): a value near 100 falls into a bin 0.0015 wide.
_BINS_PER_UNIT = 65536


def order_statistics(df: DataFrame, keys, value: str, ranks, few=False) -> DataFrame:
    """Exact order statistics per group: (keys, n, rank, value).

    ``ranks`` builds an array column of 1-based ranks from the group-size
    column. Rows are counted into narrow bins on a fixed monotone scale, so the
    ordered pass over a group sees its bins and never its rows. Only the rows of
    the bins that hold a wanted rank are then counted by value and ordered;
    with ``few`` wanted ranks in all, no other row is moved.
    """
    keys = _cols(keys)
    v = F.col(value).cast("double")
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(v)).select(
        *keys, (v + F.lit(0.0)).alias("_value"), F.floor(F.asinh(v + F.lit(0.0)) * F.lit(_BINS_PER_UNIT)).cast("long").alias("_bin"))
    group = Window.partitionBy(*keys)
    upto = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_w")).select(
        *keys, "_bin", "_w", F.sum("_w").over(upto).alias("_upto"), F.sum("_w").over(group).alias("n")
    )
    before = F.col("_upto") - F.col("_w")
    hits = totals.select(
        *keys, "_bin", "n", before.alias("_before"),
        F.filter(
            F.array_distinct(ranks(F.col("n"))), lambda r: (r >= 1) & (r > before) & (r <= F.col("_upto"))
        ).alias("_ranks"),
    ).where(F.size("_ranks") > 0)
    inside = Window.partitionBy(*keys, "_bin").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.join(F.broadcast(hits) if few else hits, keys + ["_bin"]).groupBy(*keys, "_bin", "_value").agg(
        F.count(F.lit(1)).alias("_w"), *[F.first(c).alias(c) for c in ("n", "_before", "_ranks")])
    placed = counted.withColumn("_upto", F.col("_before") + F.sum("_w").over(inside))
    held = F.filter("_ranks", lambda r: (r <= F.col("_upto")) & (r > F.col("_upto") - F.col("_w")))
    return placed.select(*keys, "n", F.explode(held).alias("rank"), F.col("_value").alias("value"))


def exact_percentiles(df: DataFrame, keys, value: str, probs: dict) -> DataFrame:
    """Linear-interpolation percentiles per group, exact at any group size.

    ``probs`` maps output names to probabilities. Same definition as the
    built-in ``percentile``, which holds every distinct value of a group in one
    task. The group size comes back as ``n_values``.
    """
    keys = _cols(keys)
    grouped = keys or ["_all"]
    if not keys:
        df = df.withColumn("_all", F.lit(0))

    def ranks(n):
        spots = [F.lit(float(p)) * (n - 1) for p in probs.values()]
        return F.array(*[f(s).cast("long") + 1 for s in spots for f in (F.floor, F.ceil)])

    table = order_statistics(df, grouped, value, ranks, few=not keys).groupBy(*grouped).agg(
        F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_m"),
        F.max("n").alias("n_values"),
    )
    out = []
    for name, p in probs.items():
        spot = F.lit(float(p)) * (F.col("n_values") - 1)
        low = F.col("_m")[F.floor(spot).cast("long") + 1]
        high = F.col("_m")[F.ceil(spot).cast("long") + 1]
        frac = spot - F.floor(spot)
        out.append(((F.lit(1.0) - frac) * low + frac * high).alias(name))
    return table.select(*keys, "n_values", *out)


def exact_median(df: DataFrame, keys, value: str, name="median") -> DataFrame:
    """Median per group, exact at any group size."""
    return exact_percentiles(df, keys, value, {name: 0.5}).drop("n_values")
