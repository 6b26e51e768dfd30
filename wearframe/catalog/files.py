"""Queries over stored files: tables derived from the given ones are written in a source's own format and read back."""

import uuid

from pyspark.sql import functions as F

from wearframe.catalog.shared import CYCLES, LAPS, r6, rounded_all, sql
from wearframe.catalog.sources import MANIFEST, _manifest
from wearframe.operators.staging import shared_folder
from wearframe.sources import adapters as ad
from wearframe.sources import laps as src


def _folder(spark):
    return f"{shared_folder(spark)}/wearframe/files-{uuid.uuid4().hex}"


def stored_laps(spark, d):
    """Sessions written with a wrong ``elapsed``, which reading must recompute."""
    laps = ad.laps_from_events(spark, d).withColumn("year", (F.lit(2020) + F.col("week")).cast("int")).withColumn("elapsed", F.lit(-1.0))
    quality = laps.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_laps"))
    path = _folder(spark)
    src.write_session(laps, quality, path)
    back = src.read_laps(spark, f"{path}/laps").join(spark.read.parquet(f"{path}/quality"), "session_id")
    return back.select("session_id", "year", "event_id", "elapsed", "n_laps")


def sessions_stored_again(spark, d):
    """All sessions stored, then the larger ones once more with only their first weeks: the others must stay, those be replaced."""
    laps = ad.laps_from_events(spark, d).withColumn("year", F.lit(2024))
    quality = lambda rows, call: rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_laps"), F.lit(call).alias("call"))
    path = _folder(spark)
    src.write_session(laps, quality(laps, "first"), path)
    again = laps.join(laps.groupBy("session_id").count().where("count >= 660").select("session_id"), "session_id").where("week < 3")
    src.write_session(again, quality(again, "again"), path)
    stored = src.read_laps(spark, f"{path}/laps").groupBy("session_id").agg(F.count(F.lit(1)).alias("n_stored"), F.max("week").alias("last_week"))
    return stored.join(spark.read.parquet(f"{path}/quality"), "session_id").select("session_id", "n_stored", "last_week", "n_laps", "call")


def _store(spark, d):
    """A manifest of all sessions beside the larger ones' files."""
    m = _manifest(spark, d)
    path = _folder(spark)
    m.where("n_laps >= 300").write.partitionBy("session_id").parquet(path)
    record = F.to_json(F.collect_list(F.struct(*[c for c in m.columns if c != "n_assets"], F.col("n_assets").alias("n_drivers"))))
    m.agg(record.alias("value")).write.text(f"{path}/corpus.json")
    return path


def manifest_of_files(spark, d):
    out = src.read_manifest(spark, _store(spark, d))
    return out.select("session_id", "year", "round_number", "event_name", "session", "n_laps", "n_drivers")


def catalogue_of_files(spark, d):
    return src.catalogue_from_files(spark, _store(spark, d))


def cycle_files(spark, d):
    cycles = ad.cycles_from_lineitem(spark, d)
    names = ["unit", "cycle", "setting_1", "setting_2", "setting_3", "sensor_1", "sensor_2", "sensor_3", "sensor_4"]
    path = _folder(spark)
    cycles.select(F.concat(F.concat_ws("  ", *[F.col(c).cast("string") for c in names]), F.lit("  ")).alias("value")).write.text(path)
    return rounded_all(src.read_cycles(spark, path, n_sensors=4).select(*names))


def life_labels(spark, d):
    """One label line per unit, in the order of the units."""
    units = ad.cycles_from_lineitem(spark, d).groupBy("unit").agg(F.max("n_cycles").alias("n"))
    path = _folder(spark)
    units.orderBy("unit").coalesce(1).select(F.format_string("%.1f ", F.col("n") / 10).alias("value")).write.text(path)
    return src.read_rul(spark, path, units)


def derived_cache(spark, d):
    """Built on the first call, read on the second, whose builder is another one; a third call replaces it."""
    li = ad.table(spark, d, "lineitem")
    path = _folder(spark)
    first = src.cached(lambda: li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")), spark, path)
    again = src.cached(lambda: first.limit(0), spark, path).withColumn("call", F.lit("again"))
    kept = [tuple(r) for r in again.collect()]
    refit = src.cached(lambda: li.groupBy("l_returnflag").agg(F.max("l_linenumber").cast("long").alias("n")), spark, path, refit=True).withColumn("call", F.lit("refit"))
    return refit.unionByName(spark.createDataFrame(kept, again.schema))


def result_files(spark, d):
    li = ad.table(spark, d, "lineitem")
    path = _folder(spark)
    rows = li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.min("l_linenumber").alias("least"))
    rows.repartition("l_returnflag").write.partitionBy("l_returnflag").json(path)
    return src.read_results(spark, path).select(
        F.get_json_object("body", "$.n").cast("long").alias("n"), F.get_json_object("body", "$.least").cast("int").alias("least"))


def calibration_file(spark, d):
    li = ad.table(spark, d, "lineitem")
    fitted = li.groupBy("l_returnflag").agg(
        F.avg("l_discount").alias("quantile"), F.avg("l_tax").alias("bias"), F.count(F.lit(1)).alias("n_calibration"), F.count_distinct("l_suppkey").alias("n_events"))
    path = _folder(spark)
    src.save_calibration(fitted.select(F.col("l_returnflag").alias("score"), F.lit(0.05).alias("alpha"), "quantile", "bias", "n_calibration", "n_events", F.lit(1).alias("unknown")), path)
    return src.load_calibration(spark, path).select("score", "alpha", r6("quantile"), r6("bias"), "n_calibration", "n_events")


QUERIES = {f.__name__: f for f in (stored_laps, sessions_stored_again, manifest_of_files, catalogue_of_files, cycle_files, life_labels, derived_cache, result_files, calibration_file)}

_six = ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in ("setting_1", "setting_2", "setting_3", "sensor_1", "sensor_2", "sensor_3", "sensor_4"))
ORACLES = {
    "stored_laps": sql(LAPS, """
SELECT session_id, CAST(2020 + week AS INTEGER) AS year, event_id, age - min(age) OVER (PARTITION BY session_id, asset, run_id) AS elapsed,
       count(*) OVER (PARTITION BY session_id) AS n_laps FROM laps"""),
    "sessions_stored_again": sql(LAPS + """,
sz AS (SELECT session_id, count(*) >= 660 AS big FROM laps GROUP BY ALL),
kp AS (SELECT laps.*, big FROM laps JOIN sz USING (session_id) WHERE NOT big OR week < 3)""", """
SELECT CAST(session_id AS INTEGER) AS session_id, count(*) AS n_stored, max(week) AS last_week, count(*) AS n_laps, CASE WHEN big THEN 'again' ELSE 'first' END AS call FROM kp GROUP BY session_id, big"""),
    "manifest_of_files": sql(MANIFEST, """
SELECT session_id, year, round_number, event_name, session, n_laps, n_assets AS n_drivers FROM manifest WHERE n_laps >= 300"""),
    "catalogue_of_files": sql(MANIFEST, """
SELECT session_id, year, 0 AS round_number, session_id AS event_name, session FROM manifest WHERE n_laps >= 300"""),
    "cycle_files": sql(CYCLES, f"SELECT CAST(unit AS INTEGER) AS unit, CAST(cycle AS INTEGER) AS cycle, {_six} FROM cyc"),
    "life_labels": sql(CYCLES, "SELECT unit, max(n_cycles) / 10 AS rul FROM cyc GROUP BY unit"),
    "derived_cache": """
SELECT l_returnflag, count(*) AS n, 'again' AS call FROM lineitem GROUP BY l_returnflag
UNION ALL SELECT l_returnflag, CAST(max(l_linenumber) AS BIGINT), 'refit' FROM lineitem GROUP BY l_returnflag""",
    "result_files": "SELECT count(*) AS n, CAST(min(l_linenumber) AS INTEGER) AS least FROM lineitem GROUP BY l_returnflag",
    "calibration_file": """
SELECT l_returnflag AS score, 0.05::DOUBLE AS alpha, round(avg(l_discount), 6) AS quantile, round(avg(l_tax), 6) AS bias, count(*) AS n_calibration,
       count(DISTINCT l_suppkey) AS n_events FROM lineitem GROUP BY l_returnflag""",
}
