"""Lap-table views of the star-schema test tables.

Column meanings: ``session_id`` groups assets that share a clock, ``asset`` is
the thing that wears, ``run_id`` one unit between replacements, ``seq`` the
shared clock, ``age`` and ``elapsed`` use of the unit, ``mode`` the operating
label, ``perf`` the cost observed (higher is worse), ``interference`` 0..1.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wearframe.operators import slices

_US = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)"
_HOUR_US = 3_600_000_000
_WEEK_US = 604_800_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the lap-table keys attached and nothing computed over groups."""
    ev = table(spark, sf_dir, "events")
    us = F.expr(_US)
    return ev.select(
        F.expr("user_id div 10").alias("session_id"),
        F.col("user_id").alias("asset"),
        F.expr(f"{_US} div {_HOUR_US}").alias("seq"),
        F.expr(f"{_US} div {_WEEK_US}").alias("week"),
        (us.cast("double") / 1e6).alias("start"),
        "event_id",
        "event_type",
        F.col("value").alias("perf"),
        "props",
    )


def laps_from_events(spark: SparkSession, sf_dir: str, interference=False, unique=False) -> DataFrame:
    """The main lap table.

    ``interference`` adds the look-back index; ``unique`` keeps one row per
    (asset, seq), which the state models need.
    """
    from wearframe.operators.windows import lookback_interference

    rows = event_rows(spark, sf_dir).drop("props")
    if interference:
        rows = lookback_interference(
            rows, session="session_id", asset="asset", start="start", order=["event_id"],
            slice_col="seq", full=60.0, clear=600.0,
        )
    laps = slices.positions(
        rows, ["asset", "week"], "seq", ["start", "event_id"], name="_rn",
        extra={"mode": (F.min(F.struct("event_id", "event_type")), F.min)},
    )
    laps = laps.select(
        "session_id", "asset", "seq", "week",
        (F.col("asset") * 10 + F.col("week")).alias("run_id"),
        F.col("mode.event_type").alias("mode"),
        (F.col("_rn") + F.col("asset") % 4).cast("double").alias("age"),
        (F.col("_rn") - 1).cast("double").alias("elapsed"),
        "perf", "start", "event_id",
        *(["interference"] if interference else []),
    )
    if unique:
        laps = laps.withColumn(
            "_k", F.row_number().over(Window.partitionBy("asset", "seq").orderBy("event_id"))
        ).where("_k = 1").drop("_k")
    return laps


def raw_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncleaned rows: pit stamps, an accuracy flag, unknown and wet modes, missing times."""
    rows = event_rows(spark, sf_dir)
    laps = slices.positions(
        rows, ["asset", "week"], "seq", ["start", "event_id"], name="_rn",
        extra={"_size": (F.count(F.lit(1)), F.sum)},
    )
    label = F.upper("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    return laps.select(
        "session_id", "asset",
        F.col("event_id").alias("lap"),
        F.col("seq"),
        F.col("week").alias("stint"),
        F.when(label == "ERROR", F.lit(None)).otherwise(label).alias("mode"),
        (F.col("_rn") + F.col("asset") % 4).cast("double").alias("age"),
        F.when(F.col("perf") >= 1, F.col("perf")).alias("perf"),
        F.when(F.col("_rn") == F.col("_size"), F.col("start")).alias("pit_in"),
        F.when(F.col("_rn") == 1, F.col("start")).alias("pit_out"),
        (k % 17 != 0).alias("is_accurate"),
        "start",
    )


def laps_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The large lap table: suppliers as assets, ship years as runs."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(
        F.col("l_suppkey").alias("asset"),
        F.year("l_shipdate").alias("_year"),
        F.month("l_shipdate").alias("_month"),
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag",
    )
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    key = F.struct(*order, F.col("l_returnflag").alias("flag"))
    laps = slices.positions(
        rows, ["asset", "_year"], "_month", order, name="_rn", extra={"_first": (F.min(key), F.min)}
    )
    return laps.select(
        (F.col("asset") % 64).alias("session_id"), "asset",
        (F.col("asset") * 10000 + F.col("_year")).alias("run_id"),
        F.col("_first.flag").alias("mode"),
        F.col("_rn").cast("double").alias("age"),
        (F.col("_rn") - 1).cast("double").alias("elapsed"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("perf"),
    )


def telemetry_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position and speed samples per (asset, week); ``i`` is the 1-based sample number."""
    rows = event_rows(spark, sf_dir).select("session_id", "asset", "week", "seq", "start", "event_id", "perf", "event_type")
    laps = slices.positions(
        rows, ["asset", "week"], "seq", ["start", "event_id"], name="i",
        extra={
            "t0": (F.min("start"), F.min),
            "n_samples": (F.count(F.lit(1)), F.sum),
        },
    )
    i = F.col("i").cast("double")
    return laps.select(
        "session_id", "asset", F.col("week").alias("lap"), "i", "n_samples",
        (F.col("start") - F.col("t0")).alias("t"),
        (F.lit(80.0) + F.col("perf")).alias("speed_kmh"),
        (F.lit(1000.0) * F.cos(i / 5)).alias("x"),
        (F.lit(1000.0) * F.sin(i / 5) + F.col("perf")).alias("y"),
        F.col("event_type").alias("mode"),
    )


def cycles_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-to-failure cycles: suppliers as units, four numeric columns as sensors."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(
        F.col("l_suppkey").alias("unit"),
        F.expr("year(l_shipdate) * 12 + month(l_shipdate)").alias("_month"),
        F.quarter("l_shipdate").cast("double").alias("setting_2"),
        F.col("l_linenumber").cast("double").alias("setting_1"),
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey",
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    )
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    laps = slices.positions(
        rows, ["unit"], "_month", order, name="cycle", extra={"n_cycles": (F.count(F.lit(1)), F.sum)}
    )
    return laps.select(
        "unit", "cycle", "n_cycles", "setting_1", "setting_2", F.lit(0.0).alias("setting_3"),
        F.col("l_quantity").alias("sensor_1"), F.col("l_extendedprice").alias("sensor_2"),
        F.col("l_discount").alias("sensor_3"), F.col("l_tax").alias("sensor_4"),
    )


def passages_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as search passages, language as heading."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("passage_id"), "text", F.col("lang").alias("heading"), "source",
        F.lit("doc").alias("kind"),
    )
