import pandas as pd
import pytest

from wearframe.streaming import live


def _run(spark, laps, tmp_path, name):
    src = tmp_path / "in"
    for k, (lo, hi) in enumerate([(0, 6), (6, 12), (12, 99)]):
        laps.where(f"seq >= {lo} AND seq < {hi}").coalesce(1).write.mode("append").parquet(str(src))
    stream = live.replay(spark, str(src), laps.schema, max_files=1)
    q = (live.live_states(stream).writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(240)
    metrics = live.stream_metrics(q.recentProgress)
    return spark.table(name).toPandas(), metrics


def test_stream_equals_replay(spark, laps, tmp_path):
    got, metrics = _run(spark, laps, tmp_path, "live_eq")
    want = live.replay_batch(laps).toPandas()
    key = ["asset", "seq"]
    got, want = got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[["asset", "seq", "level", "rate", "forecast", "low"]], want[["asset", "seq", "level", "rate", "forecast", "low"]])
    assert metrics["rows"] == len(want) and metrics["batches"] >= 3


def test_refusals_and_latest(spark, laps_pdf):
    est = live.SessionEstimator(live.Hyper(), live.Priors(), max_runs=1)
    rows = laps_pdf[laps_pdf["asset"] == 0].copy()
    out = live._fold(est, rows)
    assert set(out["reason"].dropna()) == {"run budget exceeded"}
    back = live._fold(est, rows.iloc[[0]])
    assert back["reason"].iloc[0] == "seq went backwards"


def test_forecast_precedes_update(spark, laps_pdf):
    base = live._fold(live.SessionEstimator(live.Hyper(), live.Priors()), laps_pdf)
    moved = laps_pdf.copy()
    last = moved["event_id"] == moved.sort_values(["seq", "asset"])["event_id"].iloc[-1]
    moved.loc[last, "perf"] += 30
    other = live._fold(live.SessionEstimator(live.Hyper(), live.Priors()), moved)
    assert other["forecast"].iloc[-1] == pytest.approx(base["forecast"].iloc[-1])
    assert other["level"].iloc[-1] != pytest.approx(base["level"].iloc[-1])


def test_feed_frames(spark, laps):
    kinds = {r.type: r["count"] for r in live.live_feed(live.replay_batch(laps)).groupBy("type").count().collect()}
    assert kinds == {"start": 1, "complete": 1, "lap": laps.count()}
