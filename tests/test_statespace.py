"""The session fit against one dense normal distribution."""

import math

import numpy as np
import pandas as pd
import pytest

from wearframe.operators import attribute as at
from wearframe.operators import statespace as ss
from wearframe.operators.folds import in_folds
from wearframe.operators.windows import rolling_folds
from wearframe.streaming import live


def _dense(pdf, hyper, priors):
    """Joint mean and covariance of all steps' states, then exact conditioning."""
    lay = ss.Layout(pdf)
    n, steps = lay.n, len(lay.by_step)
    a, P = lay.start(priors)
    mean, cov = [], np.zeros((n * steps, n * steps))
    zero = np.zeros((n, n))
    for s in range(steps):
        shift, Q = ss._advance(lay, s, hyper, priors, np.zeros(n), zero)
        T = np.column_stack([ss._advance(lay, s, hyper, priors, e, zero)[0] - shift for e in np.eye(n)])
        a = T @ a + shift
        P = T @ P @ T.T + Q
        mean.append(a)
        i = slice(n * s, n * (s + 1))
        cov[i, i] = P
        if s:
            cov[i, : n * s] = T @ cov[n * (s - 1): n * s, : n * s]
            cov[: n * s, i] = cov[i, : n * s].T
    z = lay.design(hyper)
    m = len(lay.y)
    H = np.zeros((m, n * steps))
    for j in range(m):
        H[j, n * lay.step[j]: n * (lay.step[j] + 1)] = z[j]
    mean = np.concatenate(mean)
    S = H @ cov @ H.T + math.exp(2 * hyper.log_noise_sd) * np.eye(m)
    v = lay.y - H @ mean
    loglik = -0.5 * (m * math.log(2 * math.pi) + np.linalg.slogdet(S)[1] + v @ np.linalg.solve(S, v))
    K = np.linalg.solve(S, H @ cov).T
    return lay, loglik, (mean + K @ v).reshape(steps, n), (cov - K @ H @ cov)


def test_likelihood_and_smoothing_match_dense(laps_pdf):
    hyper, priors = ss.Hyper(), ss.Priors()
    lay, loglik, mean, cov = _dense(laps_pdf, hyper, priors)
    got, _, _, kept = ss.run_filter(lay, hyper, priors)
    assert got == pytest.approx(loglik, rel=1e-8)
    n = lay.n
    # states of assets not fitted yet carry a diffuse placeholder that nothing reads
    for s, (a, read, P) in enumerate(ss.run_smoother(lay, kept)):
        assert np.allclose(a[read], mean[s][read], atol=1e-5)
        block = cov[n * s: n * (s + 1), n * s: n * (s + 1)]
        assert np.allclose(P, block[np.ix_(read, read)], atol=1e-5)


def test_fit_table(laps):
    fit = ss.fit_sessions(laps).cache()
    diag = ss.diagnostics(fit).collect()
    assert len(diag) == 1 and diag[0].error is None
    assert ss.lap_states(fit).count() == laps.count()
    rates = {r["mode"]: r["rate"] for r in ss.mode_rates(fit).collect()}
    assert rates["A"] > rates["B"] > 0
    rows = at.decompose(ss.lap_states(fit)).collect()
    for r in rows:
        assert r.delta == pytest.approx(r.tyre + r.load + r.drift + r.interference + r.residual)
        sizes = [abs(c.seconds) for c in r.contributions]
        assert sizes == sorted(sizes, reverse=True)
        assert (r.tyre_share is None) == (r.delta <= 0)


def _field(assets, steps, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(0, a, s, a, float(s + 1), float(s), 90 + 0.05 * s + 0.1 * (a % 3) + rng.normal(0, 0.1), "AB"[a % 2], float(rng.uniform()), a * steps + s)
            for s in range(steps) for a in range(assets)]
    return pd.DataFrame(rows, columns=["session_id", "asset", "seq", "run_id", "age", "elapsed", "perf", "mode", "interference", "event_id"])


@pytest.mark.parametrize("kept", [1, 128 << 20])
@pytest.mark.parametrize("assets", [24, 26, 60])
def test_one_model_whatever_the_field(assets, kept, monkeypatch):
    monkeypatch.setattr(ss, "KEPT_BYTES", kept)
    pdf, hyper, priors = _field(assets, 4), ss.Hyper(), ss.Priors()
    lay, loglik, mean, cov = _dense(pdf, hyper, priors)
    out = ss._fit_rows((0, "default"), lay, hyper, priors)
    laps = out[out.kind == "lap"]
    assert laps.loglik.iloc[0] == pytest.approx(loglik, rel=1e-8) and len(laps) == len(pdf)
    level = np.array([mean[lay.step[j]][lay.level[j]] for j in range(len(pdf))])
    spread = np.array([cov[lay.n * lay.step[j] + lay.level[j], lay.n * lay.step[j] + lay.level[j]] for j in range(len(pdf))])
    assert np.allclose(laps.level, level, atol=1e-5) and np.allclose(laps.level_sd, np.sqrt(spread), atol=1e-5)
    modes = out[out.kind == "mode"].set_index("mode").coef
    assert all(modes[m] == pytest.approx(mean[-1][i], abs=1e-6) for m, i in lay.mode_at.items())


@pytest.mark.parametrize("kept", [1, 128 << 20])
def test_blocks_change_nothing_beyond_2000_steps(kept, monkeypatch):
    monkeypatch.setattr(ss, "KEPT_BYTES", kept)
    pdf, hyper, priors = _field(1, 2100), ss.Hyper(), ss.Priors()
    lay = ss.Layout(pdf)
    out = ss._fit_rows((0, "default"), lay, hyper, priors)
    laps = out[out.kind == "lap"].reset_index(drop=True)
    loglik, _, _, kept = ss.run_filter(lay, hyper, priors)
    whole = ss.run_smoother(lay, kept)
    assert laps.loglik[0] == pytest.approx(loglik)
    assert np.allclose(laps.level, [whole[lay.step[j]][0][lay.level[j]] for j in range(len(pdf))], atol=1e-8)
    assert np.allclose(laps.level_f, [kept[lay.step[j]][2][lay.level[j]] for j in range(len(pdf))], atol=1e-8)


def test_remaining_life_of_known_slopes(spark):
    from wearframe.operators import fleet

    rng = np.random.default_rng(2)
    slopes = {u: 0.0008 + 0.0001 * u for u in range(30)}
    rows = [(u, u, c, float(c), 1.0 - s * c + rng.normal(0, 0.005), "cond", float(c - 1)) for u, s in slopes.items() for c in range(1, 300)]
    obs = spark.createDataFrame(rows, "asset_id long, unit_id long, sequence long, age double, performance double, mode string, elapsed_in_run double")
    got = {r.asset: r.predicted for r in fleet.remaining_life(obs, spark.createDataFrame([(0.5,)], "failure_level double"), cap=1e6).collect()}
    assert len(got) == 30
    for u, s in slopes.items():
        assert got[u] == pytest.approx(max(0.5 / s - 299, 0), abs=35)


def test_tuning_never_lowers_the_likelihood(laps):
    row = ss.tune(laps, rounds=1).first()
    assert row.loglik >= row.start_loglik
    for name, (lo, hi) in zip(ss.HYPER_NAMES, ss.BOUNDS):
        assert lo - 1e-9 <= row[name] <= hi + 1e-9
    tuned = ss.diagnostics(ss.fit_sessions(laps, hyper=ss.tune(laps, rounds=1))).first()
    assert tuned.loglik == pytest.approx(row.loglik)


def test_bad_session_becomes_an_error_row(spark, laps_pdf):
    broken = laps_pdf.assign(perf=float("nan"))
    fit = ss.fit_sessions(spark.createDataFrame(broken))
    assert ss.diagnostics(fit).count() == 1


def test_forecast_uses_training_rows_only(spark, laps, laps_pdf):
    folds = rolling_folds(laps).cache()
    base = ss.forecast_rung(laps, folds).toPandas().sort_values(["fold", "event_id"])
    changed = laps_pdf.assign(perf=laps_pdf["perf"].where(laps_pdf["seq"] < 15, laps_pdf["perf"] + 50))
    other = ss.forecast_rung(spark.createDataFrame(changed), folds).toPandas().sort_values(["fold", "event_id"])
    cut = {r.fold: r.cut for r in folds.collect()}
    early = base["fold"].map(cut) < 15
    assert early.any() and np.allclose(base.loc[early, "mean"], other.loc[other["fold"].map(cut) < 15, "mean"])
    assert in_folds(laps, folds)[1].count() == len(base)


def test_live_equals_batch_filter(spark, laps_pdf):
    one = laps_pdf[laps_pdf["asset"] == 1].reset_index(drop=True)
    lay = ss.Layout(one)
    est = live.SessionEstimator(ss.Hyper(), ss.Priors())
    est.reference = lay.reference
    est.first = est.clock = int(one["seq"].iloc[0])
    _, _, _, kept = ss.run_filter(lay, ss.Hyper(), ss.Priors())
    for j, lap in enumerate(one.itertuples(index=False)):
        out = est.observe(lap)
        i = lay.level[j]
        assert out["level"] == pytest.approx(kept[j][2][i], abs=2e-3)
        assert out["rate"] == pytest.approx(kept[j][2][i + 1], abs=2e-3)


def test_remaining_life_writes_only_what_it_reads(spark, monkeypatch):
    from wearframe.operators import fleet as fl

    cycles = [(u, c, float(c), 1.0 - 0.004 * (u + 1) * c, "cond_0_1", float(c - 1)) for u in range(3) for c in range(1, 41)]
    obs = spark.createDataFrame([(u, u, *r) for u, *r in cycles], "asset_id long, unit_id long, sequence long, age double, performance double, mode string, elapsed_in_run double")
    failure = spark.createDataFrame([(0.5,)], "failure_level double")
    written, moved = [], []
    monkeypatch.setattr(fl, "stage", lambda df, keep=fl.stage: written.append(df.columns) or keep(df))
    monkeypatch.setattr(ss, "by_groups", lambda rows, *a, keep=ss.by_groups: moved.append(rows.columns) or keep(rows, *a))
    got = {r.asset: r for r in fl.remaining_life(obs, failure).collect()}
    assert set(got) == {0, 1, 2} and all(r.n_cycles == 40 and abs(r.rate - 0.004 * (u + 1)) < 0.002 for u, r in got.items())
    assert len(written) == 1 and len(written[0]) <= 10
    assert moved and not {"load_mean", "log_q_drift"} & set(moved[0])
