"""Queries over raw rows: exclusions, cleaning, quality, conditions."""

from pyspark.sql import functions as F

from wearframe.catalog.shared import EV, RAW, r6, rounded_all, sql
from wearframe.operators import clean, windows
from wearframe.sources import adapters as ad


def _raw(spark, d):
    """Raw rows with one dry mode per stint; every fifth event type stays unknown or wet."""
    raw = ad.raw_from_events(spark, d)
    return raw.withColumn(
        "mode", F.when(F.col("mode").isNull(), F.lit("unknown")).when(F.col("mode") == "SIGNUP", F.lit("wet")).otherwise(F.lit("dry"))
    )


RAW2 = RAW + """,
raw2 AS (SELECT * REPLACE (CASE WHEN mode IS NULL THEN 'UNKNOWN' WHEN mode = 'SIGNUP' THEN 'WET' ELSE 'DRY' END AS mode) FROM raw),
r1 AS (SELECT *, CASE WHEN perf IS NULL THEN 'no_lap_time'
          WHEN pit_in IS NOT NULL OR pit_out IS NOT NULL THEN 'pit_in_out_lap'
          WHEN NOT coalesce(is_accurate, false) THEN 'flagged_inaccurate'
          WHEN mode = 'UNKNOWN' THEN 'unknown_compound'
          WHEN mode = 'WET' THEN 'wet_compound' END AS reason1 FROM raw2),
med AS (SELECT session_id, median(perf) AS m FROM r1 WHERE reason1 IS NULL GROUP BY ALL),
mad AS (SELECT session_id, any_value(m) AS m, median(abs(perf - m)) AS d FROM r1 JOIN med USING (session_id)
        WHERE reason1 IS NULL GROUP BY ALL),
lim AS (SELECT session_id, m, d, m + {k} * greatest(1.4826 * d, 0.05) AS lim FROM mad),
r2 AS (SELECT r1.*, CASE WHEN reason1 IS NOT NULL THEN reason1 WHEN perf > lim THEN 'slow_lap_safety_car_or_traffic' END AS reason2
       FROM r1 LEFT JOIN lim USING (session_id)),
f1 AS (SELECT *, CASE WHEN stint IS DISTINCT FROM lag(stint) OVER w OR mode IS DISTINCT FROM lag(mode) OVER w
          OR age < lag(age) OVER w OR lag(lap) OVER w IS NULL THEN 1 ELSE 0 END AS flag
       FROM r2 WHERE reason2 IS NULL WINDOW w AS (PARTITION BY session_id, asset ORDER BY lap)),
g1 AS (SELECT *, sum(flag) OVER (PARTITION BY session_id ORDER BY asset, lap) AS run FROM f1),
g2 AS (SELECT *, count(*) OVER (PARTITION BY session_id, run) AS size FROM g1),
labelled AS (
  SELECT session_id, lap, reason2 AS reason FROM r2 WHERE reason2 IS NOT NULL
  UNION ALL SELECT session_id, lap, CASE WHEN size < 4 THEN 'run_too_short' END FROM g2),
kept AS (SELECT r.* FROM raw2 r JOIN labelled l USING (session_id, lap) WHERE reason IS NULL),
f2 AS (SELECT *, CASE WHEN stint IS DISTINCT FROM lag(stint) OVER w OR mode IS DISTINCT FROM lag(mode) OVER w
          OR age < lag(age) OVER w OR lag(lap) OVER w IS NULL THEN 1 ELSE 0 END AS flag
       FROM kept WINDOW w AS (PARTITION BY session_id, asset ORDER BY lap)),
g3 AS (SELECT *, CAST(sum(flag) OVER (PARTITION BY session_id ORDER BY asset, lap) AS BIGINT) AS run_id FROM f2),
lb AS (SELECT a.lap, max(b.start) AS before FROM kept a JOIN kept b ON a.session_id = b.session_id AND a.asset <> b.asset
         AND (b.start < a.start OR (b.start = a.start AND (b.asset, b.lap) < (a.asset, a.lap))) GROUP BY a.lap),
cleaned AS (SELECT g3.session_id, asset, lap AS seq, run_id, age,
      age - min(age) OVER (PARTITION BY session_id, asset, run_id) AS elapsed, perf, mode,
      CASE WHEN before IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, (600.0 - (start - before)) / 540.0)) END AS interference
  FROM g3 LEFT JOIN lb USING (lap))
"""
RAW2 = RAW2.replace("{k}", "1.0")


def _labelled(spark, d):
    return clean.label_exclusions(_raw(spark, d), min_run=4, k=1.0)


def _clean(labelled):
    return clean.clean_laps(labelled, full=60.0, clear=600.0, slice_seconds=3600.0)


def exclusion_ledger(spark, d):
    return clean.exclusion_ledger(_labelled(spark, d))


def clean_laps(spark, d):
    return rounded_all(_clean(_labelled(spark, d)))


def session_quality(spark, d):
    labelled = _labelled(spark, d)
    return rounded_all(clean.session_quality(labelled, _clean(labelled)))


def mark_runs(spark, d):
    raw = ad.raw_from_events(spark, d)
    return windows.mark_runs(raw, width=512).select("session_id", "lap", "run_id")


def slow_limits(spark, d):
    return rounded_all(clean.slow_limits(ad.laps_from_events(spark, d)))


def validate_laps(spark, d):
    laps = ad.laps_from_events(spark, d, unique=True).select(
        "session_id", "asset", "seq", "run_id", "elapsed", "mode",
        F.when(F.col("event_id") % 29 != 0, F.col("perf")).alias("perf"),
        F.when(F.col("event_id") % 31 == 0, F.lit(0.0)).otherwise(F.col("age")).alias("age"),
    )
    return clean.validate(laps)


def _weather(spark, d):
    ev = ad.event_rows(spark, d)
    return ev.select(
        "session_id", (F.col("perf") + 20).alias("track_temp"), (F.col("perf") / 2 + 10).alias("air_temp"),
        (F.col("event_id") % 100).cast("double").alias("humidity"), (F.col("event_id") % 7).cast("double").alias("wind_speed"),
        (F.col("perf") > 150).alias("rainfall"),
    )


def _raw_wet(spark, d):
    return ad.event_rows(spark, d).select(
        "session_id",
        F.when((F.col("event_type") == "signup") | ((F.col("session_id") % 4 == 0) & (F.col("event_type") == "view")), "wet")
        .otherwise("dry").alias("mode"),
    )


WEATHER = EV + """,
sky AS (SELECT session_id, avg(perf + 20) AS track_temp, min(perf + 20) AS track_temp_min, max(perf + 20) AS track_temp_max,
          avg(perf / 2 + 10) AS air_temp, avg(event_id % 100) AS humidity, avg(event_id % 7) AS wind_speed,
          bool_or(perf > 150) AS rainfall,
          count(*) FILTER (WHERE event_type = 'signup' OR (session_id % 4 = 0 AND event_type = 'view')) AS wet_laps,
          count(*) AS total_laps FROM evk GROUP BY ALL)
"""


def session_conditions(spark, d):
    return rounded_all(clean.conditions(_weather(spark, d), _raw_wet(spark, d), wet_limit=0.30))


def dry_laps(spark, d):
    described = clean.conditions(_weather(spark, d), _raw_wet(spark, d), wet_limit=0.30)
    laps = ad.event_rows(spark, d)
    return clean.dry_sessions(laps, described).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


def resolve_events(spark, d):
    part = ad.table(spark, d, "part")
    requests = part.select(
        (F.col("p_partkey") % 3).cast("int").alias("year"),
        F.when(F.col("p_size") == 7, F.lit(" Special One ")).otherwise(F.col("p_name")).alias("requested"),
    )
    events = part.select(
        (F.col("p_partkey") % 3).cast("int").alias("year"),
        F.concat_ws(" ", "p_name", "p_brand").alias("event"), F.col("p_type").alias("location"), F.lit("").alias("country"),
    )
    aliases = part.where("p_size = 7").agg(F.min(F.concat_ws(" ", "p_name", "p_brand")).alias("event")).select(F.lit("special one").alias("alias"), "event")
    return clean.resolve_events(requests, events, aliases)


QUERIES = {
    "exclusion_ledger": exclusion_ledger,
    "clean_laps": clean_laps,
    "session_quality": session_quality,
    "mark_runs": mark_runs,
    "slow_limits": slow_limits,
    "validate_laps": validate_laps,
    "session_conditions": session_conditions,
    "dry_laps": dry_laps,
    "resolve_events": resolve_events,
}

ORACLES = {
    "exclusion_ledger": sql(RAW2, "SELECT session_id, reason, count(*) AS n FROM labelled WHERE reason IS NOT NULL GROUP BY ALL"),
    "clean_laps": sql(RAW2, """
SELECT session_id, asset, seq, run_id, age, elapsed, round(perf, 6) AS perf, mode, round(interference, 6) AS interference FROM cleaned"""),
    "session_quality": sql(RAW2 + """,
tot AS (SELECT session_id, count(*) AS total_laps FROM raw2 GROUP BY ALL),
kp AS (SELECT session_id, count(*) AS retained_laps, count(DISTINCT asset) AS n_assets, count(DISTINCT run_id) AS n_runs,
         median(perf) AS median_perf FROM cleaned GROUP BY ALL),
lg AS (SELECT session_id, max(n) AS longest_run FROM (SELECT session_id, run_id, count(*) AS n FROM cleaned GROUP BY ALL) GROUP BY ALL),
q AS (SELECT session_id, total_laps, coalesce(retained_laps, 0) AS retained_laps, coalesce(n_assets, 0) AS n_assets,
        coalesce(n_runs, 0) AS n_runs, coalesce(longest_run, 0) AS longest_run, median_perf,
        coalesce(retained_laps, 0) / total_laps AS retention
      FROM tot LEFT JOIN kp USING (session_id) LEFT JOIN lg USING (session_id))""", """
SELECT session_id, total_laps, retained_laps, n_assets, n_runs, longest_run, round(median_perf, 6) AS median_perf,
       round(retention, 6) AS retention,
       round(100 * (0.3 * least(retention / 0.6, 1) + 0.4 * least(longest_run / 12.0, 1) + 0.3 * least(n_assets / 15.0, 1)), 6) AS score
FROM q"""),
    "mark_runs": sql(RAW + """,
f AS (SELECT *, CASE WHEN stint IS DISTINCT FROM lag(stint) OVER w OR mode IS DISTINCT FROM lag(mode) OVER w
          OR age < lag(age) OVER w OR lag(lap) OVER w IS NULL THEN 1 ELSE 0 END AS flag
      FROM raw WINDOW w AS (PARTITION BY session_id, asset ORDER BY lap))""", """
SELECT session_id, lap, CAST(sum(flag) OVER (PARTITION BY session_id ORDER BY asset, lap) AS BIGINT) AS run_id FROM f"""),
    "slow_limits": sql(EV + """,
med AS (SELECT session_id, median(perf) AS m FROM evk GROUP BY ALL),
mad AS (SELECT session_id, any_value(m) AS m, median(abs(perf - m)) AS d FROM evk JOIN med USING (session_id) GROUP BY ALL)""", """
SELECT session_id, round(m, 6) AS median, round(d, 6) AS mad, round(m + 3.0 * greatest(1.4826 * d, 0.05), 6) AS "limit" FROM mad"""),
    "validate_laps": None,
    "session_conditions": sql(WEATHER, """
SELECT session_id, round(track_temp, 6) AS track_temp, round(track_temp_min, 6) AS track_temp_min,
       round(track_temp_max, 6) AS track_temp_max, round(air_temp, 6) AS air_temp, round(humidity, 6) AS humidity,
       round(wind_speed, 6) AS wind_speed, rainfall, wet_laps, total_laps, round(wet_laps / total_laps, 6) AS wet_fraction,
       rainfall AND wet_laps / total_laps < 0.30 AS rain_advisory, wet_laps / total_laps < 0.30 AS is_dry FROM sky"""),
    "dry_laps": sql(WEATHER, """
SELECT session_id, total_laps AS n FROM sky WHERE wet_laps / total_laps < 0.30"""),
    "resolve_events": """
WITH cal AS (SELECT CAST(p_partkey % 3 AS INTEGER) AS year, p_name || ' ' || p_brand AS event, p_type AS location FROM part),
asked AS (SELECT DISTINCT CAST(p_partkey % 3 AS INTEGER) AS year, CASE WHEN p_size = 7 THEN ' Special One ' ELSE p_name END AS requested FROM part),
al AS (SELECT min(p_name || ' ' || p_brand) AS event FROM part WHERE p_size = 7),
w AS (SELECT year, requested, unnest(string_split(replace(lower(trim(requested)), '-', ' '), ' ')) AS word FROM asked
      WHERE lower(trim(requested)) <> 'special one'),
uw AS (SELECT DISTINCT year, word FROM w WHERE length(word) > 3),
hw AS (SELECT uw.year, word, min(cal.event) AS event FROM uw JOIN cal ON uw.year = cal.year
         AND contains(lower(cal.event || ' ' || cal.location || ' '), word) GROUP BY ALL),
hit AS (SELECT w.year, w.requested, min(hw.event) AS event FROM w JOIN hw USING (year, word) GROUP BY ALL),
ali AS (SELECT asked.year, requested, al.event FROM asked, al
        WHERE lower(trim(requested)) = 'special one' AND EXISTS (SELECT 1 FROM cal WHERE cal.year = asked.year AND cal.event = al.event))
SELECT year, requested, coalesce(ali.event, hit.event) AS event,
       CASE WHEN ali.event IS NOT NULL THEN 'alias' WHEN hit.event IS NOT NULL THEN 'words' ELSE 'no match' END AS how
FROM asked LEFT JOIN ali USING (year, requested) LEFT JOIN hit USING (year, requested)""",
}

from wearframe.catalog.shared import ULAPS  # noqa: E402

ORACLES["validate_laps"] = sql(ULAPS + """,
m AS (SELECT session_id, run_id, seq, CASE WHEN event_id % 29 <> 0 THEN perf END AS perf,
        CASE WHEN event_id % 31 = 0 THEN 0.0 ELSE age END AS age FROM ulaps),
p AS (SELECT *, age < lag(age) OVER (PARTITION BY session_id, run_id ORDER BY seq) AS back FROM m)""", """
SELECT session_id, count(*) AS n_laps, count(*) FILTER (WHERE perf IS NULL) AS null_perf,
       count(*) FILTER (WHERE back) AS age_steps_back, count(DISTINCT run_id) FILTER (WHERE back) AS runs_affected,
       count(*) FILTER (WHERE perf IS NULL) = 0 AND count(*) FILTER (WHERE back) = 0 AS is_valid
FROM p GROUP BY ALL""")
