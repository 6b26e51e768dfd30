"""Sentences from records of any shape, running maxima, rungs that fail alone, feature families."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearframe.operators import folds as fo
from wearframe.operators import search as se
from wearframe.operators import slices
from wearframe.operators import stats as st
from wearframe.operators import telemetry as te
from wearframe.operators.windows import rolling_folds


def test_records_of_any_shape(spark):
    bodies = {
        "a": {"experiment": "exp", "mae": 0.5, "unknown": 3, "coverage": None, "deep": {"inner": {"n_events": 4}}, "list": [{"model": "m", "bias": -0.25}, {"model": "n"}, 7]},
        "b": {"verdict": "fine", "crps": "not a number"},
        "c": {"nothing": 1},
    }
    records = spark.createDataFrame([(k, json.dumps(v)) for k, v in bodies.items()] + [("d", "no json"), ("e", None)], "name string, body string")
    got = sorted((r.name, r.heading, r.text) for r in se.record_sentences(records).collect())
    assert got == [
        ("a", "deep inner", "exp, deep inner: events 4."),
        ("a", "list", "exp, list: rung m, bias -0.2500."),
        ("a", "list", "exp, list: rung n."),
        ("a", "record", "exp, record: mean absolute error 0.5000."),
        ("b", "record", "b, record: finding fine."),
    ]


@pytest.mark.parametrize("width", [1, 3, 100])
def test_running_max_over_slices(spark, width):
    rng = np.random.default_rng(3)
    values = [(g, i, float(v) if v > -5 else None) for g in range(3) for i, v in enumerate(rng.integers(-9, 40, 25))]
    df = spark.createDataFrame(values, "g int, i int, v double").withColumn("s", F.floor(F.col("i") / width))
    got = {(r.g, r.i): r.top for r in slices.running_max(df, "g", "s", "i", {"top": F.col("v")}).collect()}
    for g in range(3):
        top = None
        for k, i, v in values:
            if k == g:
                top = v if top is None else top if v is None else max(top, v)
                assert got[g, i] == top


def test_stamps_across_slice_edges(spark):
    laps = {0: [0.0, 1.0, 2.0, 3.0, 4.0], 1: [0.0, 1.0, 1.0, 2.0, 3.0], 2: [0.0, 5.0, 2.0, 3.0, 6.0]}
    rows = [(0, 0, lap, i + 1, 5, t) for lap, ts in laps.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "session_id int, asset int, lap int, i int, n_samples int, t double")
    for width in (2, 3):
        got = {(r.lap, r.i): r._t for r in te.nudged(df, width).collect()}
        for lap, ts in laps.items():
            want = np.array(ts)
            if (np.diff(want) <= 0).any():
                want = np.maximum.accumulate(want + np.arange(5) * 1e-9)
            assert [got[lap, i] for i in range(1, 6)] == want.tolist()


def test_a_broken_session_fails_alone(spark, laps):
    broken = laps.withColumn("session_id", F.lit(5)).withColumn("perf", F.when((F.col("seq") == 2) & (F.col("asset") == 0), float("nan")).otherwise(F.col("perf")))
    both = laps.withColumn("session_id", F.col("session_id").cast("int")).unionByName(broken.withColumn("session_id", F.col("session_id").cast("int")))
    both = both.withColumn("session_id", F.col("session_id").cast("long")).cache()
    out = fo.evaluate(both, rolling_folds(both)).collect()
    n_folds = len({r.fold for r in out if r.session_id == 0})
    for model in fo.RUNGS:
        bad = [r for r in out if r.model == model and r.session_id == 5]
        assert len(bad) == n_folds and all(r.failed and r.mean is None for r in bad)
        assert all(r.failed is None and np.isfinite(r.mean) for r in out if r.model == model and r.session_id == 0)


def test_sweeping_in_and_out():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 4))
    m = x.T @ x
    once = st.swept(st.swept(m, 0), 2)
    assert once[[0, 2], 3] == pytest.approx(np.linalg.solve(m[np.ix_([0, 2], [0, 2])], m[[0, 2], 3]))
    assert st.swept(st.swept(once, 2, back=True), 0, back=True) == pytest.approx(m)
