"""Runs that are never open together share a place in the session model, and its results stay those of one dense distribution."""

import numpy as np
import pytest

from wearframe.operators import statespace as ss

from test_statespace import _dense


def test_runs_share_places(laps_pdf, monkeypatch):
    hyper, priors = ss.Hyper(), ss.Priors()
    lay, loglik, mean, cov = _dense(laps_pdf, hyper, priors)
    assert lay.n == 4 + 2 + 2 * 4 + 4 and lay.n_states == 4 + 2 + 2 * 4 + 8
    for at_once in (0, 8):
        monkeypatch.setattr(ss, "ONE_BY_ONE", at_once)
        out = ss._fit_rows((0, "default"), lay, hyper, priors)
        got = out[out.kind == "lap"]
        assert out.loglik.iloc[0] == pytest.approx(loglik, rel=1e-8) and set(out.n_states) == {lay.n_states}
        assert np.allclose(got.rate, [mean[s][i + 1] for s, i in zip(lay.step, lay.level)], atol=1e-5)
        spread = [cov[lay.n * s + i + 1, lay.n * s + i + 1] for s, i in zip(lay.step, lay.level)]
        assert np.allclose(got.rate_sd, np.sqrt(spread), atol=1e-5)


def test_held_runs_keep_their_place(laps_pdf):
    held = laps_pdf["run_id"].unique()
    kept, shared = ss.Layout(laps_pdf, held), ss.Layout(laps_pdf)
    assert kept.n == kept.n_states and len(set(kept.run_at.values())) == 8
    a, b = (ss.run_filter(x, ss.Hyper(), ss.Priors(), keep=False)[0] for x in (kept, shared))
    assert a == pytest.approx(b, rel=1e-10)
