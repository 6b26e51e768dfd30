"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected `target / source_size` times. Expected copies are summed up along the documents of the source, a random
offset is added, and a document is emitted once for every whole number that its step crosses. Documents are ordered by size, then by a hash, so the
words taken follow the target to within about one document. All arithmetic is on integers (24 binary places), so reruns agree.

The prefix sum needs no task that holds a source: documents fall into (source, size bin, hash slice) cells, cells are counted with map-side
combination, offsets come from the small table of cells, and only positions inside one cell are numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wearframe.llm.common import key_of, staged

#: Binary places of expected copies, offsets and hashes.
PLACES = 24
SLICES = 256


def hash24(*parts: Column) -> Column:
    """The first 24 bits of an MD5, as a long; any SQL engine can repeat it."""
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 6), 16, 10).cast("long")


def size_bin(size: Column) -> Column:
    """Eight bins per doubling, from the leading binary digits."""
    digits = F.length(F.bin(size)).cast("long")
    lead = F.floor(size / F.pow(F.lit(2.0), digits - 4)).cast("long")
    return F.when(size < 16, size).otherwise(digits * 8 + lead)


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Adds `target` to one row per source (`__src`, `source`, `source_size`).

    Sources in code-point order, null last, take the weights in turn. `share` times all sizes is given out by weight; no source gets more than
    `most` times its own size, and what it leaves goes to the others by weight. Solved at once: with sources in order of cap per weight, the
    common level is that of the first source that stays under its cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sources.withColumn("__w", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("__cap", most * F.col("source_size"))
    by_cap = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("__cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("__w").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    levels = weighed.withColumn("__level", (share * F.sum("source_size").over(everything) - before) / rest)
    fits = F.col("__level") * F.col("__w") <= F.col("__cap")
    first = F.min(F.when(fits, F.struct((F.col("__cap") / F.col("__w")).alias("per"), F.col("__level").alias("level")))).over(everything)
    solved = levels.withColumn("__first", first)
    target = F.least(F.col("__cap"), F.coalesce(F.col("__first.level") * F.col("__w"), F.col("__cap")))
    return solved.select("__src", "source_size", target.cast("double").alias("target"))


def mix(
    docs: DataFrame,
    size: Column,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """Adds `size`, `source_size`, `target`, `copies` and `taken` (copies x size) to every row; columns of these names are replaced.

    A null source is a source of its own, last in order. Null ids and repeated rows are ordinary rows; rows alike in id and size may swap their
    copies. A null size counts as 0: such rows are sampled like others and take nothing. A source of size 0 has target 0 and no copies. An empty
    table gives an empty result.
    """
    bound = int(most) if float(most).is_integer() else most
    sized = docs.withColumn("size", F.coalesce(size.cast("long"), F.lit(0)))
    keyed = sized.withColumn("__src", key_of(F.col(source_col))).withColumn("__key", F.md5(F.concat(F.lit(f"{seed}:"), key_of(F.col(id_col)))))
    keyed = keyed.withColumn("__bin", size_bin(F.col("size")))
    keyed = keyed.withColumn("__slice", F.conv(F.substring("__key", 1, 2), 16, 10).cast("int"))
    cells = staged(
        keyed.groupBy("__src", "__bin", "__slice").agg(F.first(source_col).alias("source"), F.count(F.lit(1)).alias("__n"), F.sum("size").alias("__words")), "cells"
    )
    bins = cells.groupBy("__src", "__bin").agg(F.first("source").alias("source"), F.sum("__n").alias("__n"), F.sum("__words").alias("__words"))
    sources = bins.groupBy("__src").agg(F.first("source").alias("source"), F.sum("__words").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = targets(sources, weights, share, most).select(
        "__src", "source_size", "target", F.least(F.floor(rate * 2**PLACES), F.lit(int(bound * 2**PLACES))).cast("long").alias("__step"),
        hash24(F.lit(f"{seed}/"), F.col("__src")).alias("__from"),
    )
    earlier_bins = F.coalesce(F.sum("__n").over(Window.partitionBy("__src").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earlier_cells = F.coalesce(F.sum("__n").over(Window.partitionBy("__src", "__bin").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = (
        cells.select("__src", "__bin", "__slice", earlier_cells.alias("__in_bin"))
        .join(bins.select("__src", "__bin", earlier_bins.alias("__before")), ["__src", "__bin"])
        .join(plan, "__src")
        .select("__src", "__bin", "__slice", (F.col("__in_bin") + F.col("__before")).alias("__ahead"), "source_size", "target", "__step", "__from")
    )
    kept = [c for c in sized.columns if c.lower() not in ("source_size", "target", "copies", "taken")]
    inside = Window.partitionBy("__src", "__bin", "__slice").orderBy("__key", "size", F.col(id_col))
    placed = keyed.select(*kept, "__src", "__key", "__bin", "__slice").join(offsets, ["__src", "__bin", "__slice"])
    place = F.col("__ahead") + F.row_number().over(inside)
    crossed = lambda at: F.shiftright(at * F.col("__step") + F.col("__from"), PLACES)
    return placed.withColumn("__at", place).select(
        *kept, "source_size", "target", (crossed(F.col("__at")) - crossed(F.col("__at") - 1)).alias("copies")
    ).withColumn("taken", F.col("copies") * F.col("size"))


def emit(mixed: DataFrame) -> DataFrame:
    """Repeats every row `copies` times (rows without a copy go)."""
    return mixed.filter("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("__copy")
