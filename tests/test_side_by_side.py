"""Sessions fitted side by side get what each gets alone."""

import numpy as np
import pandas as pd
import pytest

from wearframe.operators import sidebyside as sb
from wearframe.operators import statespace as ss
from wearframe.operators.staging import by_groups

from test_statespace import _field


def _sessions(laps_pdf):
    twice = pd.concat([laps_pdf, laps_pdf.iloc[5:9].assign(event_id=-1)])
    return [laps_pdf, laps_pdf.iloc[:1], _field(3, 7), _field(1, 40, seed=3), twice, _field(12, 3), laps_pdf.assign(perf=np.nan), laps_pdf[laps_pdf["seq"] % 3 != 1]]


@pytest.mark.parametrize("at_once", [1, 3, 64])
def test_together_as_alone(laps_pdf, at_once, monkeypatch):
    monkeypatch.setattr(sb, "TOGETHER", at_once)
    monkeypatch.setattr(ss, "ONE_BY_ONE", 8)
    fits = [((k, "v"), ss.Layout(pdf), ss.Hyper(log_noise_sd=-1.0 - 0.1 * k), ss.Priors(rate_sd=0.2 + 0.01 * k)) for k, pdf in enumerate(_sessions(laps_pdf))]
    for fit, got in zip(fits, ss._fit_many(fits)):
        alone = ss._fit_rows(*fit)
        got = pd.DataFrame(got)
        assert list(got.columns) == list(alone.columns) and len(got) == len(alone)
        for c in got.columns:
            if alone[c].dtype == object:
                assert got[c].astype(str).tolist() == alone[c].astype(str).tolist(), c
            else:
                assert np.allclose(got[c].astype(float), alone[c].astype(float), rtol=1e-7, atol=1e-9, equal_nan=True), c


def test_last_states_as_alone(laps_pdf):
    lays = [ss.Layout(pdf, pdf["run_id"].unique()) for pdf in _sessions(laps_pdf)]
    for lay, (a, P) in zip(lays, ss._ends(lays, ss.Hyper(), ss.Priors())):
        end = {}
        ss.run_filter(lay, ss.Hyper(), ss.Priors(), keep=False, visit=lambda step, a, P: end.update(a=a, P=P))
        assert np.allclose(a[: lay.n], end["a"], rtol=1e-8, equal_nan=True) and np.allclose(P[: lay.n, : lay.n], end["P"], rtol=1e-7, atol=1e-10)


def test_groups_stay_whole(spark):
    rows = [(k if k < 9 else None, "ab"[k % 2] if k % 5 else None, i) for k in range(10) for i in range(k + 1)]
    df = spark.createDataFrame(rows, "k long, v string, i long")

    def work(groups):
        for key, pdf in groups:
            yield {"k": [key[0]], "v": [key[1]], "n": [len(pdf)], "s": [pdf["i"].sum()]}

    got = by_groups(df, ("k", "v"), work, "k long, v string, n long, s long", groups=3, most=7).collect()
    want = df.groupBy("k", "v").agg({"*": "count", "i": "sum"}).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((r.k, r.v, r["count(1)"], r["sum(i)"])) for r in want)
