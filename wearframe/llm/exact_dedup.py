"""Exact deduplication with a heavy-hitter split.

A frequent-items sketch (the Misra-Gries family, Spark's `approx_top_k`) names digests that may be frequent. Their true counts and winners are then
aggregated exactly; that table has at most HEAVY rows, is broadcast, and settles their losing copies where they are read, without a shuffle. All other
rows, the heavy winners among them, are shuffled by digest in the ordinary way. A digest that the sketch misses has few copies, so no group that
is shuffled is large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wearframe.llm.common import SPACE, aside, staged, text_of

#: Most digests broadcast: about 100 bytes each.
HEAVY = 1000
#: Counters of the sketch: it tracks every digest with more than about 1/6000 of all rows.
TRACKED = 8192


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+", "")


def digests(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds `text_sha256` (of the text without white space) and `n_points` (code points of the original); null text is empty."""
    text = text_of(text_col)
    return docs.withColumn("text_sha256", F.sha2(normalised(text).cast("binary"), 256)).withColumn("n_points", F.length(text).cast("long"))


def frequent(marked: DataFrame) -> DataFrame:
    """At most HEAVY digests (`text_sha256`) that occur more than once by the sketch's estimate."""
    top = marked.agg(F.expr(f"approx_top_k(text_sha256, {HEAVY}, {TRACKED})").alias("top")).select(F.inline("top"))
    return top.filter("count > 1").select(F.col("item").alias("text_sha256"))


def mark_copies(marked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds `keep_id`, `group_size` and `kept` to rows that carry `text_sha256` and `n_points` (see `digests`).

    Of equal digests the row with the most code points stays, then the smallest id (null ids last), and exactly one row: where rows repeat with
    the same id and text, one of them is kept and the others point to their own id. Null and empty texts are equal to each other and to texts of
    white space alone. Columns named keep_id, group_size or kept are replaced. An empty table gives an empty result.
    """
    rows = marked.drop("keep_id", "group_size", "kept")
    ident = F.col(id_col)
    rank = F.struct((-F.col("n_points")).alias("p"), ident.isNull().alias("none"), ident.alias("id"))
    heavy = F.broadcast(frequent(rows))
    winners = staged(
        rows.join(heavy, "text_sha256", "left_semi").groupBy("text_sha256").agg(F.min(rank).alias("__best"), F.count(F.lit(1)).alias("__size")),
        "heavy-winners",
    )
    known = rows.join(F.broadcast(winners), "text_sha256", "left")
    ahead = F.col("__best").isNotNull() & ~rank.eqNullSafe(F.col("__best"))
    settled = known.filter(ahead).select(*rows.columns, F.col("__best.id").alias("keep_id"), F.col("__size").alias("group_size"), F.lit(False).alias("kept"))
    # rows like a heavy winner: one of them stays, found by a number of their own
    ties = staged(known.filter(F.col("__best").isNotNull() & rank.eqNullSafe(F.col("__best"))).withColumn("__at", F.monotonically_increasing_id()), "heavy-ties")
    one = F.broadcast(ties.groupBy("text_sha256").agg(F.min("__at").alias("__one")))
    tied = ties.join(one, "text_sha256").select(*rows.columns, F.col("__best.id").alias("keep_id"), F.col("__size").alias("group_size"), (F.col("__at") == F.col("__one")).alias("kept"))
    group = Window.partitionBy("text_sha256")
    best = group.orderBy(F.col("n_points").desc(), ident.asc_nulls_last())
    others = known.filter(F.col("__best").isNull()).select(
        *rows.columns, F.first(ident).over(best).alias("keep_id"), F.count(F.lit(1)).over(group).alias("group_size"), (F.row_number().over(best) == 1).alias("kept"),
    )
    return settled.unionByName(tied).unionByName(others)


def drop_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of each group of equal texts, with the columns of `docs`."""
    hidden, place, back = aside(docs)
    return back(mark_copies(digests(hidden, place[text_col.lower()]), place[id_col.lower()]).filter("kept"))
