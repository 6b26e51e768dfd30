"""Queries that run stored laps as a stream: frames of every session, and the times of its micro-batches."""

import uuid

from pyspark.sql import functions as F

from wearframe.catalog.shared import ULAPS, sql
from wearframe.operators.staging import shared_folder, stage
from wearframe.sources import adapters as ad
from wearframe.streaming import live

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SEQ_OF_A_WEEK = 168


def stream_session(spark):
    """A session of its own for streams: the state store is chosen there and nowhere else."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    return own


def _run_frames(spark, d):
    """All laps as a stream of two batches a week, a session being a week of one group of assets; returns the folder of the results.

    Laps of the first half of a week with a low value arrive with the second half, so those behind the clock by then must be refused. Assets
    with fewer than 15 laps and modes of a single asset are not declared. A last row moves the clock so that every session ends.
    """
    laps = ad.laps_from_events(spark, d, unique=True)
    second = (F.col("seq") - F.col("week") * _SEQ_OF_A_WEEK >= _SEQ_OF_A_WEEK // 2) | (F.col("perf") < 20)
    laps = laps.select(
        (F.col("session_id") * 10 + F.col("week")).alias("session_id"), "asset", "seq", "run_id", "mode", "age", "elapsed", "perf",
        F.lit(0.0).alias("interference"), F.timestamp_micros((F.col("start") * 1e6).cast("long")).alias("at"), (F.col("week") * 2 + F.when(second, 1).otherwise(0)).alias("batch"),
    )
    # written once: every batch is picked out of these rows
    laps = stage(laps)
    folder = f"{shared_folder(spark)}/wearframe/frames-{uuid.uuid4().hex}"
    files = live.store_batches(laps, "batch", f"{folder}/in")
    end = laps.agg((F.max("at") + F.expr("INTERVAL 60 DAYS")).alias("at"))
    end.select(*[(F.lit(-1).cast(t) if c == "session_id" else F.col("at") if c == "at" else F.lit(None).cast(t)).alias(c) for c, t in laps.dtypes]).write.mode("append").parquet(f"{folder}/in")
    assets = laps.groupBy("session_id", "asset").count().where("count >= 15").groupBy("session_id").agg(F.array_sort(F.collect_list("asset")).alias("assets"))
    modes = laps.groupBy("session_id", "mode").agg(F.count_distinct("asset").alias("n")).where("n >= 2").groupBy("session_id").agg(F.array_sort(F.collect_list("mode")).alias("modes"))
    empty = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
    declared = assets.join(modes, "session_id", "full_outer").select("session_id", empty("assets", "array<bigint>"), empty("modes", "array<string>"))
    declared.write.parquet(f"{folder}/declared")
    own = stream_session(spark)
    feed = live.replay(own, f"{folder}/in", laps.schema, max_files=files)
    frames = live.live_frames(feed, own.read.parquet(f"{folder}/declared"), "at", lateness="8 days", idle_ms=3_600_000)
    live.run_and_time(frames, f"{folder}/out", f"{folder}/progress", f"{folder}/times")
    return folder


def live_frames(spark, d):
    """Start, lap, rejected and complete frames of every session of the stream."""
    out = spark.read.schema(live.FRAME).parquet(f"{_run_frames(spark, d)}/out")
    return out.select("session_id", "type", "seq", "asset", "mode", "reason", "laps_observed", "total_laps", "rejected", "assets", "modes")


def stream_latency(spark, d):
    """Rows and laps of every micro-batch of the stream, and whether its update times were measured and are in order."""
    times = spark.read.schema(live.BATCHES).parquet(f"{_run_frames(spark, d)}/times").where("n_rows > 0")
    ordered = (F.col("mean_ms") > 0) & (F.col("mean_ms") <= F.col("max_ms")) & (F.col("p95_ms") <= F.col("max_ms")) & (F.col("trigger_ms") > 0)
    return times.select("batch", "n_rows", "laps", F.coalesce(ordered, F.col("laps") == 0).alias("measured"))


QUERIES = {f.__name__: f for f in (live_frames, stream_latency)}

FRAMES = ULAPS + """,
sw AS (SELECT * REPLACE (session_id * 10 + week AS session_id), week * 2 + CASE WHEN seq - week * 168 >= 84 OR perf < 20 THEN 1 ELSE 0 END AS batch FROM ulaps),
da AS (SELECT session_id, asset FROM sw GROUP BY ALL HAVING count(*) >= 15),
dm AS (SELECT session_id, mode FROM sw GROUP BY ALL HAVING count(DISTINCT asset) >= 2),
jd AS (SELECT sw.*, CASE WHEN da.asset IS NULL THEN 'asset not declared' WHEN dm.mode IS NULL THEN 'mode not declared' WHEN perf IS NULL THEN 'no time' END AS r
       FROM sw LEFT JOIN da USING (session_id, asset) LEFT JOIN dm USING (session_id, mode)),
ck AS (SELECT session_id, max(seq) AS clock FROM jd WHERE r IS NULL AND batch % 2 = 0 GROUP BY ALL),
fr AS (SELECT jd.*, coalesce(r, CASE WHEN batch % 2 = 1 AND seq < clock THEN 'seq went backwards' END) AS reason FROM jd LEFT JOIN ck USING (session_id))
"""

ORACLES = {
    "live_frames": sql(FRAMES + """,
st AS (SELECT session_id, min(seq) AS seq FROM (SELECT *, min(batch) OVER (PARTITION BY session_id) AS b FROM sw) WHERE batch = b GROUP BY ALL),
en AS (SELECT session_id, max(seq) FILTER (WHERE reason IS NULL) AS seq, count(*) FILTER (WHERE reason IS NULL) AS ok, count(reason) AS bad,
         count(DISTINCT asset) FILTER (WHERE reason IS NULL) AS n, coalesce(string_agg(DISTINCT mode, ',' ORDER BY mode) FILTER (WHERE reason IS NULL), '') AS modes FROM fr GROUP BY ALL)""", """
SELECT session_id, 'start' AS type, seq, NULL::BIGINT AS asset, NULL AS mode, NULL AS reason, NULL::BIGINT AS laps_observed, NULL::BIGINT AS total_laps, NULL::BIGINT AS rejected,
       (SELECT count(*) FROM da WHERE da.session_id = st.session_id) AS assets, coalesce((SELECT string_agg(mode, ',' ORDER BY mode) FROM dm WHERE dm.session_id = st.session_id), '') AS modes FROM st
UNION ALL SELECT session_id, CASE WHEN reason IS NULL THEN 'lap' ELSE 'rejected' END, seq, asset, mode, reason,
       CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY session_id, asset, reason IS NULL ORDER BY batch, seq) END, NULL, NULL, NULL, NULL FROM fr
UNION ALL SELECT session_id, 'complete', seq, NULL, NULL, NULL, NULL, ok, bad, n, modes FROM en"""),
    "stream_latency": sql(FRAMES, """
SELECT row_number() OVER (ORDER BY batch) - 1 AS batch, count(*) AS n_rows, count(*) FILTER (WHERE reason IS NULL) AS laps, true AS measured FROM fr GROUP BY fr.batch
UNION ALL SELECT (SELECT count(DISTINCT batch) FROM fr), 1, 0, true"""),
}
