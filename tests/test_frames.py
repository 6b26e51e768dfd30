"""Streamed frames: declared assets and modes, refusals, completion by event time, and what is left in the state store."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wearframe.streaming import live

SCHEMA = "session_id long, asset long, seq long, run_id long, mode string, age double, elapsed double, perf double, interference double, batch int"


def lap(session, asset, seq, batch, mode="S", perf=90.0, run=0):
    return (session, asset, seq, run, mode, float(seq), float(seq), perf, 0.0, batch)


ROWS = [
    *[lap(1, a, s, 0, perf=90 + 0.1 * s + a) for s in range(5) for a in (1, 2)],
    lap(1, 9, 2, 0), lap(1, 1, 5, 0, mode="X"), lap(1, 2, 5, 0, perf=None),
    # the second batch: one lap behind the clock, one in order, and a session nobody declared
    lap(1, 1, 3, 1), lap(1, 2, 6, 1), lap(7, 1, 6, 1),
    # much later, another session: the first one is over
    *[lap(2, 1, 100 + s, 2) for s in range(3)],
    # nothing but the clock
    (-1, None, None, None, None, None, None, None, None, 3),
]
DECLARED = [(1, [1, 2], ["S", "M"]), (2, [1], ["S"]), (3, [5], ["S"])]


@pytest.fixture(scope="module")
def frames(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("frames"))
    laps = spark.createDataFrame(ROWS, SCHEMA)
    at = F.coalesce(F.timestamp_seconds(F.col("seq") * 60 + 1_000_000), F.timestamp_seconds(F.lit(10_000_000)))
    laps = laps.withColumn("at", at)
    files = live.store_batches(laps, "batch", f"{folder}/in", files=1)
    declared = spark.createDataFrame(DECLARED, "session_id long, assets array<long>, modes array<string>")
    stream = live.live_frames(live.replay(spark, f"{folder}/in", laps.schema, max_files=files), declared, "at", lateness="10 minutes", idle_ms=20 * 60_000)
    q = (stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination(240)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").collect(), f"{folder}/progress"


def test_frames_of_a_session(frames):
    rows = [r for r in frames[0] if r.session_id == 1]
    (start,) = [r for r in rows if r.type == "start"]
    assert (start.seq, start.assets, start.modes) == (0, 2, "M,S")
    (end,) = [r for r in rows if r.type == "complete"]
    assert (end.seq, end.total_laps, end.rejected, end.assets, end.modes) == (6, 11, 4, 2, "S")
    assert sum(r.type == "lap" for r in rows) == 11
    assert sorted((r.asset, r.seq, r.reason) for r in rows if r.type == "rejected") == [
        (1, 3, "seq went backwards"), (1, 5, "mode not declared"), (2, 5, "no time"), (9, 2, "asset not declared")]


def test_undeclared_session_and_silent_ones(frames):
    assert {(r.type, r.reason) for r in frames[0] if r.session_id == 7} == {("start", None), ("rejected", "asset not declared"), ("complete", None)}
    assert not [r for r in frames[0] if r.session_id in (3, -1)]
    assert [r.total_laps for r in frames[0] if r.session_id == 2 and r.type == "complete"] == [3]


def test_filtered_values_equal_one_pass(spark, frames):
    laps = spark.createDataFrame([r for r in ROWS if r[0] == 1 and r[1] in (1, 2) and r[4] == "S" and r[7] is not None and (r[9] == 0 or r[2] == 6)], SCHEMA)
    want = {(r.asset, r.seq): (r.level, r.rate, r.forecast, r.low, r.coverage) for r in live.replay_batch(laps).collect()}
    got = {(r.asset, r.seq): (r.level, r.rate, r.forecast, r.low, r.coverage) for r in frames[0] if r.session_id == 1 and r.type == "lap"}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_no_state_is_left(spark, frames):
    """Only the declaration of the session that never came is kept."""
    for name, left in (("clock", 0), ("belief", 0), ("interval", 0), ("declared", 1)):
        assert spark.read.format("statestore").option("stateVarName", name).load(frames[1]).count() == left, name


class _Handle:
    """Counts what is asked of a session's store."""

    def __init__(self):
        self.calls = 0

    def _state(self, *a):
        handle = self

        class State:
            def _call(self, *a):
                handle.calls += 1

            get = update = updateValue = _call

        return State()

    getValueState = getMapState = _state


def test_calls_of_the_store_do_not_grow_with_assets():
    calls = []
    for assets in (2, 20):
        handle, estimator = _Handle(), live.SessionEstimator(live.Hyper(), live.Priors())
        laps = pd.DataFrame([lap(1, a, 0, 0) for a in range(assets)], columns=[c.split()[0] for c in SCHEMA.split(", ")])
        assert live._fold(estimator, laps)["reason"].isna().all()
        live.SessionStore(handle).save(estimator, last_ms=0, accepted=assets, rejected=0)
        calls.append(handle.calls)
    assert calls[0] == calls[1] <= 5


def test_large_ids_beside_a_start_frame_stay_exact():
    rows = live._framed({"type": ["start", "lap"], "asset": [None, 2**53 + 1], "seq": [0, 1]})
    assert rows["asset"].tolist() == [None, 2**53 + 1] and rows["reason"].tolist() == [None, None]


def test_covariance_stays_symmetric(laps_pdf):
    estimator = live.SessionEstimator(live.Hyper(), live.Priors())
    live._fold(estimator, laps_pdf)
    assert (estimator.P == estimator.P.T).all()


def test_laps_are_made_once_for_all_batches(spark, data, monkeypatch):
    """The batches are picked out of written laps: their plan is a scan, without the windows that number the laps."""
    from wearframe.catalog import streams

    plans = []

    def seen(laps, batch, folder, files=4):
        plans.append(laps._jdf.queryExecution().optimizedPlan().toString())
        raise InterruptedError

    monkeypatch.setattr(live, "store_batches", seen)
    with pytest.raises(InterruptedError):
        streams._run_frames(spark, data)
    assert "Window" not in plans[0] and "Relation" in plans[0]
