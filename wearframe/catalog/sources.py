"""Queries over manifests, catalogues and lookups derived from the given tables."""

from pyspark.sql import functions as F

from wearframe.catalog.shared import LAPS, r6, rounded_all, sql
from wearframe.sources import adapters as ad
from wearframe.sources import laps as src


def _manifest(spark, d):
    """One record per (week, session): weeks as rounds, two session codes, region as season."""
    laps = ad.laps_from_events(spark, d)
    rows = laps.groupBy(
        (F.lit(2020) + F.col("session_id") % 3).cast("int").alias("year"),
        F.col("week").cast("int").alias("round_number"),
        F.when(F.col("session_id") % 2 == 0, "R").otherwise("FP2").alias("session"),
        F.concat(F.lit("Event "), F.col("week").cast("string")).alias("event_name"),
    ).agg(
        F.count(F.lit(1)).alias("n_laps"), F.count_distinct("asset").alias("n_assets"),
    )
    return rows.withColumn("session_id", src.session_slug("year", "event_name", "session"))


MANIFEST = LAPS + """,
man AS (SELECT CAST(2020 + session_id % 3 AS INTEGER) AS year, CAST(week AS INTEGER) AS round_number,
          CASE WHEN session_id % 2 = 0 THEN 'R' ELSE 'FP2' END AS session, 'Event ' || week AS event_name,
          count(*) AS n_laps, count(DISTINCT asset) AS n_assets FROM laps GROUP BY ALL),
manifest AS (SELECT *, year || '-' || replace(lower(event_name), ' ', '-') || '-' || session AS session_id FROM man)
"""


def manifest_records(spark, d):
    return _manifest(spark, d)


def select_sessions(spark, d):
    m = _manifest(spark, d)
    counts = m.select("session_id", F.col("n_laps").alias("n"))
    return src.select_sessions(m, counts, "R", limit=8, min_laps=300, years=[2021, 2022]).select("session_id", "year", "round_number", "n_laps")


def selected_laps(spark, d):
    laps = ad.laps_from_events(spark, d)
    m = laps.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).select(
        "session_id", "n", F.lit("R").alias("session"), (F.col("session_id") % 3).alias("year"),
        F.expr("session_id div 3").alias("round_number"))
    picked = src.select_sessions(m, m.select("session_id", "n"), "R", limit=4, min_laps=10)
    return src.load_selected(laps, picked).select("session_id", "event_id", "run_id", "age")


def catalogue_from_names(spark, d):
    return src.catalogue_from_names(_manifest(spark, d).select(
        F.when(F.col("round_number") == 3, F.concat(F.lit("demo-"), "session")).otherwise(F.col("session_id")).alias("session_id")).distinct())


def ingest_plan(spark, d):
    m = _manifest(spark, d)
    schedule = m.select("year", "round_number", "event_name").distinct()
    return src.ingest_plan(schedule, ["R", "FP2", "FP1"], m.where("n_laps > 400")).select(
        "year", "round_number", "session", "session_id")


def session_entries(spark, d):
    out = src.session_entry(ad.laps_from_events(spark, d))
    return out.withColumn("modes", F.concat_ws(",", "modes"))


def corpus_totals(spark, d):
    return src.corpus_totals(_manifest(spark, d))


def _results(spark, d):
    return ad.event_rows(spark, d).select(
        F.lit(2024).alias("year"), F.col("week").cast("int").alias("round"), "asset",
        F.concat(F.lit("team "), F.expr("asset div 2").cast("string")).alias("team"))


def lineups(spark, d):
    out = src.lineups(_results(spark, d))
    return out.select("year", "round", F.size("lineup").alias("n"), F.col("lineup")[F.lit(7)].alias("team_of_7"))


def with_team(spark, d):
    laps = ad.laps_from_events(spark, d).select("event_id", "asset", F.lit(2024).alias("year"), F.col("week").cast("int").alias("round"))
    return src.with_team(laps, _results(spark, d)).select("event_id", "team")


def upsert_features(spark, d):
    part = ad.table(spark, d, "part")
    old = part.where("p_size <= 40").select(
        F.lit(2024).alias("year"), F.col("p_partkey").alias("circuit"),
        F.when(F.col("p_size") > 20, F.col("p_retailprice")).alias("lateral_energy"))
    new = part.where("p_size >= 10").select(
        F.lit(2024).alias("year"), F.col("p_partkey").alias("circuit"), (F.col("p_retailprice") * 2).alias("lateral_energy"))
    return rounded_all(src.upsert_features(old, new))


def session_catalogue(spark, d):
    m = _manifest(spark, d).select("session_id", "year", "session")
    return src.session_catalogue(m, m.where("session = 'R'"))


def catalogue_health(spark, d):
    m = _manifest(spark, d).select("session_id", "year", "session")
    return src.catalogue_health(src.session_catalogue(m, m.where("session = 'R'")))


def _nominations(spark, d):
    part = ad.table(spark, d, "part")
    return part.select(
        (F.col("p_partkey") % 4).cast("int").alias("year"), F.expr("p_partkey div 4").cast("int").alias("round"),
        F.col("p_name").alias("event"), (F.col("p_size") % 3 + 1).alias("hardest"), F.lit("confirmed").alias("confidence"))


def nomination_coverage(spark, d):
    return src.nomination_coverage(src.check_nominations(_nominations(spark, d)))


def paired_events(spark, d):
    m = _manifest(spark, d)
    cond = m.where("session = 'R'").select("year", "event_name", (F.col("round_number") != 2).alias("is_dry"))
    return src.paired_events(m, cond)


def with_conditions(spark, d):
    laps = ad.laps_from_events(spark, d)
    est = laps.groupBy(F.col("week").alias("year"), F.col("session_id").alias("round"), "mode").agg(F.avg("perf").alias("rate"))
    cond = laps.groupBy(F.col("week").alias("year"), F.col("session_id").alias("round")).agg(
        F.max("perf").alias("track_temp"), (F.count(F.lit(1)) > 140).alias("is_dry")).withColumn("session", F.lit("R"))
    both = cond.unionByName(cond.withColumn("session", F.lit("FP2"))).where("track_temp > 51")
    return rounded_all(src.with_conditions(est, both))


def with_features(spark, d):
    laps = ad.laps_from_events(spark, d)
    est = laps.groupBy(F.col("week").alias("year"), F.col("session_id").alias("round"), "mode").agg(F.avg("perf").alias("rate"))
    feat = laps.where("age > 3").groupBy(F.col("week").alias("year"), F.col("session_id").alias("round")).agg(
        F.stddev_samp("perf").alias("roughness"), F.max("age").alias("longest")).where("longest >= 10")
    return rounded_all(src.with_features(est, feat))


def default_catalogue(spark, d):
    m = _manifest(spark, d)
    return src.session_catalogue(None, m.where("session = 'R'").select("session_id"))


def not_stored(spark, d):
    m = _manifest(spark, d)
    return src.not_stored(m.select("session_id", "n_laps"), m.where("session = 'FP2'"))


def lookup_circuit(spark, d):
    part = ad.table(spark, d, "part")
    circuits = part.where("p_size > 25").select(F.concat(F.lit("C"), "p_name", F.col("p_partkey").cast("string")).alias("circuit"), F.col("p_retailprice").alias("left_share"))
    names = part.select(F.upper(F.concat(F.lit("c"), "p_name", F.col("p_partkey").cast("string"))).alias("circuit"))
    out = src.lookup_circuit(names, circuits)
    return out.select("circuit", "measured", "measured_circuit", r6("left_share"), "n_available")


def match_events(spark, d):
    part = ad.table(spark, d, "part")
    asked = part.select((F.col("p_size") % 5).alias("year"), F.upper(F.element_at(F.split("p_name", " "), 2)).alias("asked")).distinct()
    recorded = part.select((F.col("p_size") % 5).alias("year"), F.col("p_name").alias("recorded")).distinct()
    return src.match_events(asked, recorded)


QUERIES = {f.__name__: f for f in (
    manifest_records, select_sessions, selected_laps, catalogue_from_names, ingest_plan, session_entries, corpus_totals,
    lineups, with_team, upsert_features, session_catalogue, catalogue_health, nomination_coverage, paired_events,
    with_conditions, with_features, default_catalogue, not_stored, lookup_circuit, match_events)}

ORACLES = {
    "manifest_records": sql(MANIFEST, "SELECT * FROM manifest"),
    "select_sessions": sql(MANIFEST, """
SELECT session_id, year, round_number, n_laps FROM manifest WHERE session = 'R' AND year IN (2021, 2022) AND n_laps >= 300
ORDER BY year DESC, round_number, session_id LIMIT 8"""),
    "selected_laps": sql(LAPS + """,
pick AS (SELECT session_id FROM laps GROUP BY session_id HAVING count(*) >= 10
         ORDER BY session_id % 3 DESC, session_id // 3, session_id LIMIT 4)""",
                         "SELECT session_id, event_id, run_id, age FROM laps WHERE session_id IN (FROM pick)"),
    "catalogue_from_names": sql(MANIFEST + """,
n AS (SELECT DISTINCT CASE WHEN round_number = 3 THEN 'demo-' || session ELSE session_id END AS session_id FROM manifest)""", """
SELECT session_id, CASE WHEN regexp_full_match(left(session_id, 4), '[0-9]{4}') THEN CAST(left(session_id, 4) AS INTEGER) ELSE 0 END AS year,
       0 AS round_number, session_id AS event_name, string_split(session_id, '-')[-1] AS session FROM n"""),
    "ingest_plan": sql(MANIFEST + """,
plan AS (SELECT DISTINCT m.year, m.round_number, s.session,
           m.year || '-' || replace(lower(event_name), ' ', '-') || '-' || s.session AS session_id
         FROM manifest m, (SELECT unnest(['R', 'FP2', 'FP1']) AS session) s)""", """
SELECT * FROM plan WHERE session_id NOT IN (SELECT session_id FROM manifest WHERE n_laps > 400)"""),
    "session_entries": sql(LAPS, """
SELECT session_id, count(*) AS n_laps, count(DISTINCT asset) AS n_assets, string_agg(DISTINCT mode, ',' ORDER BY mode) AS modes
FROM laps GROUP BY ALL"""),
    "corpus_totals": sql(MANIFEST, """
SELECT CAST(sum(n_laps) AS BIGINT) AS n_laps, count(DISTINCT (year, event_name)) AS n_events, count(DISTINCT year) AS n_seasons FROM manifest"""),
    "lineups": sql(LAPS, """
SELECT 2024 AS year, CAST(week AS INTEGER) AS round, CAST(count(DISTINCT asset) AS INTEGER) AS n,
       max(CASE WHEN asset = 7 THEN 'team 3' END) AS team_of_7 FROM laps GROUP BY week"""),
    "with_team": sql(LAPS, """
SELECT event_id, 'team ' || (asset // 2) AS team FROM laps"""),
    "upsert_features": """
SELECT 2024 AS year, p_partkey AS circuit,
       round(CASE WHEN p_size > 20 AND p_size <= 40 THEN p_retailprice WHEN p_size >= 10 THEN p_retailprice * 2 END, 6) AS lateral_energy FROM part""",
    "session_catalogue": sql(MANIFEST, "SELECT session_id, year, session, session = 'R' AS cached FROM manifest"),
    "catalogue_health": sql(MANIFEST, """
SELECT count(*) AS sessions, count(*) FILTER (WHERE session = 'R') AS cached, bool_and(session = 'R') AS offline_ready FROM manifest"""),
    "nomination_coverage": """
SELECT CAST(p_partkey % 4 AS INTEGER) AS year, CAST(p_partkey // 4 AS INTEGER) AS round, p_name AS event,
       'C' || (p_size % 3 + 1) AS hard, 'C' || (p_size % 3 + 2) AS medium, 'C' || (p_size % 3 + 3) AS soft,
       'confirmed' AS confidence FROM part""",
    "paired_events": sql(MANIFEST, """
SELECT year, event_name FROM manifest WHERE round_number <> 2 GROUP BY ALL HAVING bool_or(session = 'R') AND bool_or(session = 'FP2')"""),
    "with_conditions": sql(LAPS + """,
c AS (SELECT week, session_id, max(perf) AS track_temp, count(*) > 140 AS is_dry FROM laps GROUP BY ALL)""", """
SELECT l.week AS year, l.session_id AS round, mode, round(avg(perf), 6) AS rate,
       round(any_value(CASE WHEN track_temp > 51 THEN track_temp END), 6) AS track_temp,
       any_value(CASE WHEN track_temp > 51 THEN is_dry END) AS is_dry
FROM laps l JOIN c USING (week, session_id) GROUP BY l.week, l.session_id, mode"""),
    "with_features": sql(LAPS + """,
e AS (SELECT week AS year, session_id AS round, mode, avg(perf) AS rate FROM laps GROUP BY ALL),
f AS (SELECT week AS year, session_id AS round, stddev_samp(perf) AS roughness, max(age) AS longest FROM laps WHERE age > 3 GROUP BY ALL HAVING max(age) >= 10)""", """
SELECT year, round, mode, round(rate, 6) AS rate, round(roughness, 6) AS roughness, longest FROM e JOIN f USING (year, round)"""),
    "default_catalogue": sql(MANIFEST, """
SELECT session_id, year, 0 AS round_number, session_id AS event_name, session, true AS cached FROM manifest WHERE session = 'R'"""),
    "not_stored": sql(MANIFEST, "SELECT session_id, n_laps FROM manifest WHERE session <> 'FP2'"),
    "lookup_circuit": """
WITH c AS (SELECT 'C' || p_name || p_partkey AS circuit, p_retailprice AS left_share FROM part WHERE p_size > 25),
n AS (SELECT upper('c' || p_name || p_partkey) AS circuit FROM part)
SELECT n.circuit, c.circuit IS NOT NULL AS measured, c.circuit AS measured_circuit, round(left_share, 6) AS left_share,
       (SELECT count(DISTINCT circuit) FROM c) AS n_available
FROM n LEFT JOIN c ON lower(n.circuit) = lower(c.circuit)""",
    "match_events": """
WITH a AS (SELECT DISTINCT p_size % 5 AS year, upper(string_split(p_name, ' ')[2]) AS asked FROM part),
r AS (SELECT DISTINCT p_size % 5 AS year, p_name AS recorded FROM part)
SELECT year, asked, recorded FROM a JOIN r USING (year)
WHERE contains(lower(asked), lower(recorded)) OR contains(lower(recorded), lower(asked))""",
}
