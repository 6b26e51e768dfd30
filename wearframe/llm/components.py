"""Connected components of a link table as Spark jobs.

Each round every node points at its smallest neighbour in a hashed order, links are moved to what their ends point at, and links inside a component
vanish. The hashed order breaks up long chains, so a few rounds are enough whatever the ids look like. Between rounds only tables in the
shared folder remain; the driver sees a count of links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearframe.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """(`a` long, `b` long) links in any direction, repeats allowed -> `node`, `root`: equal roots, same component. Nodes without links are absent."""
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    links = staged(links.filter("a <> b").select("a", "b").distinct(), "links")
    labels = None
    while links.limit(1).count():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # map-side minimum: a hub is one row per task
        pointed = both.groupBy("a").agg(F.min(order("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", order("a")).alias("m"))
        pointed = staged(pointed.select("node", F.col("m.n").alias("root")), "pointers")
        left = links.join(pointed.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        moved = left.join(pointed.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        links = staged(moved.filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
        if labels is None:
            labels = pointed
        else:
            follow = pointed.select(F.col("node").alias("root"), F.col("root").alias("__next"))
            labels = staged(labels.join(follow, "root", "left").select("node", F.coalesce("__next", "root").alias("root")), "labels")
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
