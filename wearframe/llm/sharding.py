"""Sharding through fixed virtual slots.

Records are hashed into thousands of slots once and for ever. Bytes are added up per slot, and a small versioned table says which shard owns which
slot. Rebalancing edits that table; only records of the edited slots move. The first map gives the slots, largest first, to the shard
that has the fewest bytes so far. All work on records is one map-side aggregate, one broadcast of the slot table (its size is fixed) and one
shuffle by slot.

Rows that repeat an id and a text have one record key, so hashing alone would crowd their slot. A key with more than an average slot's bytes is dealt out over
slots of its own, as many as its bytes need; there are never more such keys than slots.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wearframe.llm.common import key_of, shared_dir, staged, text_of

SLOTS = 4096
#: The slot table is broadcast; beyond this it would no longer be small.
MOST_SLOTS = 65_536


def record_slot(record: Column, slots: int) -> Column:
    """The slot of a record key: leading 32 bits of its MD5, modulo the number of slots."""
    return (F.conv(F.substring(F.md5(record), 1, 8), 16, 10).cast("long") % slots).cast("int")


def with_slots(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds `size` (UTF-8 bytes + 1), `text_crc32` and `vslot`. The record key is id and checksum, so a repeated id does not crowd a slot."""
    if slots > MOST_SLOTS:
        raise ValueError(f"{slots} slots; the slot table is broadcast, so {MOST_SLOTS} is the most")
    text = text_of(text_col)
    sized = docs.withColumn("size", F.octet_length(text).cast("long") + 1).withColumn("text_crc32", F.crc32(text.cast("binary")))
    return sized.withColumn("vslot", record_slot(F.concat(key_of(F.col(id_col)), F.lit(":"), F.col("text_crc32").cast("string")), slots))


def crowded_keys(slotted: DataFrame, slots: int = SLOTS, id_col: str = "doc_id") -> DataFrame:
    """Repeated record keys (`__id`, `text_crc32`) with more bytes than an average slot: the first of their own slots and how many they get.

    Such keys are fewer than slots, because their bytes add up to no more than all bytes; so the table can be broadcast.
    """
    keys = staged(slotted.groupBy(F.col(id_col).alias("__id"), "text_crc32").agg(F.sum("size").alias("__bytes"), F.count(F.lit(1)).alias("__rows")), "record-keys")
    share = (keys.agg(F.sum("__bytes").alias("b")).first().b or 0) / slots
    heavy = keys.filter((F.col("__rows") > 1) & (F.col("__bytes") > share)).withColumn("__parts", F.least("__rows", F.ceil(F.col("__bytes") / max(share, 1))).cast("int"))
    upto = F.sum("__parts").over(Window.orderBy("__id", "text_crc32").rowsBetween(Window.unboundedPreceding, 0))
    return heavy.select("__id", "text_crc32", "__parts", (slots + upto - F.col("__parts")).cast("int").alias("__first"))


def deal_out(slotted: DataFrame, crowded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`slotted` with the rows of crowded keys dealt over their own slots, turn by turn.

    Rows of a key are numbered by prefix counts over the partitions they are written in, so every slot of a key gets as many rows whatever the
    partitions are; equal rows may swap places.
    """
    named = crowded.withColumnRenamed("text_crc32", "__crc")
    met = slotted.join(F.broadcast(named), (F.col("text_crc32") == F.col("__crc")) & F.col(id_col).eqNullSafe(F.col("__id")), "left")
    places = met.filter("__first is not null").withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    places = staged(places, "crowded-rows")
    counts = places.groupBy("__first", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__first").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("__first", "__part", F.coalesce(before, F.lit(0)).alias("__before"))
    number = F.col("__before") + F.row_number().over(Window.partitionBy("__first", "__part").orderBy("__at")) - 1
    dealt = places.join(counts, ["__first", "__part"]).withColumn("vslot", (F.col("__first") + number % F.col("__parts")).cast("int"))
    return met.filter("__first is null").select(*slotted.columns).unionByName(dealt.select(*slotted.columns))


def slot_sizes(slotted: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Bytes and rows of every slot (`vslot`, `bytes`, `rows`), empty slots included."""
    filled = slotted.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    every = slotted.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(filled, "vslot", "left").select("vslot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows"))


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 0 of the map (`version`, `vslot`, `shard`): largest slot first, each to the lightest shard so far (ties: the lower number)."""
    queue = sizes.agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "vslot"))).alias("queue"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("load"), F.array().cast("array<int>").alias("owner"))

    def give(state: Column, slot: Column) -> Column:
        lightest = F.array_position(state["load"], F.array_min(state["load"])).cast("int")
        load = F.transform(state["load"], lambda x, i: F.when(i == lightest - 1, x - slot["less"]).otherwise(x))
        return F.struct(load.alias("load"), F.array_append(state["owner"], lightest - 1).alias("owner"))

    given = queue.select(F.arrays_zip("queue", F.aggregate("queue", start, give)["owner"].alias("owner")).alias("pairs"))
    rows = given.select(F.explode("pairs").alias("p"))
    return rows.select(F.lit(0).alias("version"), F.col("p.queue.vslot").alias("vslot"), F.col("p.owner").alias("shard"))


def add_shard(latest: DataFrame, sizes: DataFrame) -> DataFrame:
    """The next version of a map, with one more shard: it takes slots (in slot order, turn by turn from every shard) until it has its
    share of the bytes; a slot larger than that share stays. No record moves between old shards."""
    facts = latest.join(sizes, "vslot").withColumn("__turn", F.row_number().over(Window.partitionBy("shard").orderBy("vslot")))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = Window.orderBy("__turn", "shard").rowsBetween(Window.unboundedPreceding, 0)
    new = F.max("shard").over(everything) + 1
    share = F.sum("bytes").over(everything) / (new + 1)
    ranked = facts.withColumn("__new", new).withColumn("__share", share)
    fits = F.col("bytes") <= F.col("__share")
    ranked = ranked.withColumn("__sum", F.sum(F.when(fits, F.col("bytes")).otherwise(0)).over(so_far))
    return ranked.select((F.col("version") + 1).alias("version"), "vslot", F.when(fits & (F.col("__sum") <= F.col("__share")), F.col("__new")).otherwise(F.col("shard")).alias("shard"))


def save_map(versioned: DataFrame, path: str) -> None:
    """Adds a version to the stored map; older ones stay readable."""
    versioned.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the latest by default."""
    stored = spark.read.schema("vslot int, shard int, version int").parquet(path)
    if version is None:
        return stored.join(F.broadcast(stored.agg(F.max("version").alias("version"))), "version").select("version", "vslot", "shard")
    return stored.filter(F.col("version") == version).select("version", "vslot", "shard")


def assign(slotted: DataFrame, latest: DataFrame, sizes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds `shard`, `slot` (place inside the shard, from 0 without gaps), `law` and `grown_shard` (null: only a law of keys has it).

    A place is the number of rows in the shard's earlier virtual slots plus the place inside the own one, so no task holds a shard.
    """
    earlier = F.sum("rows").over(Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1))
    table = latest.join(sizes, "vslot").select("vslot", "shard", F.coalesce(earlier, F.lit(0)).alias("__before"))
    kept = [c for c in slotted.columns if c.lower() not in ("shard", "slot", "law", "grown_shard")]
    inside = Window.partitionBy("vslot").orderBy(F.col(id_col), "text_crc32")
    return slotted.select(*kept).join(F.broadcast(table), "vslot").select(
        *kept, F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("__before") + F.row_number().over(inside) - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def shard(docs: DataFrame, shards: int = 8, slots: int = SLOTS, map_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deals `docs` into shards of near-equal bytes and stores version 0 of the map at `map_path` (default: in the shared folder).

    Null texts count as empty (one byte for the row); null ids are one id, told apart by their texts; repeated rows share a slot unless they have more than
    an average slot's bytes, then they have slots of their own (numbers from `slots` on). Columns named
    size, text_crc32, vslot, law, shard, slot or grown_shard are replaced. An empty table gives an empty result and a full map.
    """
    slotted = with_slots(docs, slots, id_col, text_col)
    crowded = staged(crowded_keys(slotted, slots, id_col), "crowded-keys")
    own = crowded.agg(F.sum("__parts").alias("n")).first().n or 0
    if own:
        slotted = deal_out(slotted, crowded, id_col)
    sizes = staged(slot_sizes(slotted.select("vslot", "size"), slots + own), "slot-sizes")
    path = map_path or f"{shared_dir(docs.sparkSession)}/slot-map-{uuid.uuid4().hex}"
    save_map(first_map(sizes, shards), path)
    return assign(slotted, load_map(docs.sparkSession, path), sizes, id_col)
