"""SQL fragments used by the oracle queries, and rounding helpers."""

from pyspark.sql import functions as F

EV = """
ev AS (
  SELECT event_id, user_id AS asset, user_id // 10 AS session_id,
         epoch_us(ts) - 1704067200000000 AS us, event_type, value AS perf, props
  FROM events),
evk AS (
  SELECT *, us // 3600000000 AS seq, us // 604800000000 AS week, CAST(us AS DOUBLE) / 1e6 AS start FROM ev)
"""

LAPS = EV + """,
laps AS (
  SELECT session_id, asset, seq, week, asset * 10 + week AS run_id,
         first_value(event_type) OVER (PARTITION BY asset, week ORDER BY event_id) AS mode,
         CAST(row_number() OVER (PARTITION BY asset, week ORDER BY start, event_id) + asset % 4 AS DOUBLE) AS age,
         CAST(row_number() OVER (PARTITION BY asset, week ORDER BY start, event_id) - 1 AS DOUBLE) AS elapsed,
         perf, start, event_id
  FROM evk)
"""

ULAPS = LAPS + """,
ulaps AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset, seq ORDER BY event_id) AS k FROM laps) WHERE k = 1)
"""

# brute force: the latest earlier start by another asset of the session
INTERFERENCE = """,
lookback AS (
  SELECT a.event_id, max(b.start) AS before
  FROM evk a JOIN evk b ON a.session_id = b.session_id AND a.asset <> b.asset
   AND (b.start < a.start OR (b.start = a.start AND b.event_id < a.event_id))
  GROUP BY a.event_id),
ilaps AS (
  SELECT l.*, CASE WHEN b.before IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, (600.0 - (l.start - b.before)) / 540.0)) END AS interference
  FROM laps l LEFT JOIN lookback b USING (event_id))
"""

RAW = EV + """,
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY asset, week ORDER BY start, event_id) AS rn,
         count(*) OVER (PARTITION BY asset, week) AS size
  FROM evk),
raw AS (
  SELECT session_id, asset, event_id AS lap, seq, week AS stint,
         CASE WHEN upper(event_type) = 'ERROR' THEN NULL ELSE upper(event_type) END AS mode,
         CAST(rn + asset % 4 AS DOUBLE) AS age,
         CASE WHEN perf >= 1 THEN perf END AS perf,
         CASE WHEN rn = size THEN start END AS pit_in,
         CASE WHEN rn = 1 THEN start END AS pit_out,
         CAST(json_extract_string(props, '$.k') AS INTEGER) % 17 <> 0 AS is_accurate,
         start
  FROM numbered)
"""

LINE = """
line AS (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey, year(l_shipdate) ORDER BY l_shipdate, l_orderkey,
              l_linenumber, l_partkey, l_quantity, l_extendedprice) AS rn FROM lineitem),
llaps AS (
  SELECT l_suppkey % 64 AS session_id, l_suppkey AS asset, l_suppkey * 10000 + year(l_shipdate) AS run_id,
         first_value(l_returnflag) OVER (PARTITION BY l_suppkey, year(l_shipdate) ORDER BY l_shipdate, l_orderkey,
              l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag) AS mode,
         CAST(rn AS DOUBLE) AS age, CAST(rn - 1 AS DOUBLE) AS elapsed, l_extendedprice / l_quantity AS perf
  FROM line)
"""

TELEMETRY = EV + """,
tel AS (
  SELECT session_id, asset, week AS lap, i, count(*) OVER w AS n_samples,
         start - min(start) OVER w AS t, 80.0 + perf AS speed_kmh,
         1000.0 * cos(i / 5.0) AS x, 1000.0 * sin(i / 5.0) + perf AS y, event_type AS mode
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY asset, week ORDER BY start, event_id) AS DOUBLE) AS i FROM evk)
  WINDOW w AS (PARTITION BY asset, week))
"""

CYCLES = """
cyc AS (
  SELECT l_suppkey AS unit,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey,
              l_quantity, l_extendedprice) AS cycle,
         count(*) OVER (PARTITION BY l_suppkey) AS n_cycles,
         CAST(l_linenumber AS DOUBLE) AS setting_1, CAST(quarter(l_shipdate) AS DOUBLE) AS setting_2,
         0.0 AS setting_3, l_quantity AS sensor_1, l_extendedprice AS sensor_2,
         l_discount AS sensor_3, l_tax AS sensor_4
  FROM lineitem)
"""


def sql(prefix, body):
    return f"WITH {prefix.strip()}\n{body}"


def r6(name, alias=None):
    """A double column rounded for comparison across engines; negative zero becomes zero."""
    col = F.col(name) if isinstance(name, str) else name
    return (F.round(col.cast("double"), 6) + F.lit(0.0)).alias(alias or name)


def rounded(df, *names):
    """Round the named columns in place, keeping the column order."""
    return df.select(*[r6(c) if c in names else F.col(c) for c in df.columns])


def rounded_all(df):
    return df.select(*[r6(c) if t == "double" else F.col(c) for c, t in df.dtypes])
