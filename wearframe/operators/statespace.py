"""The session model: degradation states under load, drift and interference.

perf = reference + run intercept + level(asset) - load * elapsed
       + drift amplitude * basis(seq) + drift residual + coefficient * interference + noise

The level of an asset integrates its rate over age; a new unit resets the level
to zero and redraws the rate around the mode's baseline. Constants are states
without process noise, so their priors carry through exactly.

One fit is one (session, variant) group: one model per session at any size. The
forward pass stores the state only at the start of each block, and the backward pass
runs a block forward again before it goes back through it. A block has what fits into
a fixed memory, or sqrt(steps) steps if that is more; a session of one block runs once.

The intercept of a run is a state from its first lap to its last. Before, it is its prior
and unrelated to all else; after, nothing reads it. So runs that are never open together
share a place, and the states of a session are as many as its open runs, not all its runs.
Few laps of one step are taken up one after the other, which gives the same as at once.
"""

import math
from dataclasses import dataclass, fields
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearframe.operators.sidebyside import SideBySide, batches, kept_bytes
from wearframe.operators.staging import by_groups, spread

_LOG_2PI = math.log(2 * math.pi)
_DIFFUSE = 1.0e4


@dataclass(frozen=True)
class Priors:
    """Prior means and standard deviations, in seconds; fixed default values."""

    load_mean: float = 0.081
    load_sd: float = 0.016
    drift_mean: float = 0.90
    drift_sd: float = 0.45
    interference_sd: float = 1.0
    intercept_sd: float = 5.0
    rate_mean: float = 0.05
    rate_sd: float = 0.20
    level_sd: float = 0.05


@dataclass(frozen=True)
class Hyper:
    """Log variances and the drift shape; fixed default values."""

    log_q_drift: float = math.log(1e-5)
    log_q_level: float = math.log(1e-4)
    log_q_rate: float = math.log(1e-5)
    log_noise_sd: float = math.log(0.25)
    log_unit_rate_sd: float = math.log(0.05)
    log_drift_shape: float = math.log(0.055)


HYPER_NAMES = tuple(f.name for f in fields(Hyper))

#: Search bounds of the hyper-parameters, in the order of HYPER_NAMES; fixed values.
BOUNDS = (
    (math.log(1e-9), math.log(1e-3)),
    (math.log(1e-8), math.log(1e-1)),
    (math.log(1e-10), math.log(1e-2)),
    (math.log(0.01), math.log(3.0)),
    (math.log(1e-3), math.log(1.0)),
    (math.log(0.005), math.log(0.5)),
)

FIT_KEYS = ("session_id", "variant")

#: Memory for the covariances that one backward pass reads.
KEPT_BYTES = 128 << 20

#: What makes a group unfit for the model: it becomes a row with the reason.
_UNFIT = (np.linalg.LinAlgError, FloatingPointError, ValueError)

#: Laps of one step up to which they are taken up one by one.
ONE_BY_ONE = 8


class Layout:
    """Positions of the states and the step list of one group.

    ``held`` names runs whose intercept is asked for after the last step; they keep their place.
    """

    def __init__(self, pdf: pd.DataFrame, held=()):
        pdf = pdf.sort_values(["seq", "asset"], kind="stable").reset_index(drop=True)
        self.rows = pdf
        self.assets = sorted(pdf["asset"].unique())
        self.modes = sorted(pdf["mode"].unique())
        self.runs = sorted(pdf["run_id"].unique())
        at = 4
        self.mode_at = {m: at + i for i, m in enumerate(self.modes)}
        at += len(self.modes)
        self.level_at = {a: at + 2 * i for i, a in enumerate(self.assets)}
        at += 2 * len(self.assets)
        self.n_states = at + len(self.runs)
        self.reference = float(pdf["perf"].median())
        seq = pdf["seq"].to_numpy()
        self.seqs = np.unique(seq)
        self.offset = pdf["seq"].to_numpy(float) - float(self.seqs[0])
        self.step = np.searchsorted(self.seqs, seq)
        steps = len(self.seqs)
        self.run_at, opened, self.n = self._places(pdf["run_id"].tolist(), self.step.tolist(), steps, at, set(held))
        m = len(pdf)
        z = np.zeros((m, self.n))
        z[:, 1] = 1.0
        z[:, 2] = -pdf["elapsed"].to_numpy(float)
        z[:, 3] = pdf["interference"].fillna(0.0).to_numpy(float)
        level = pdf["asset"].map(self.level_at).to_numpy()
        z[np.arange(m), level] = 1.0
        place = pdf["run_id"].map(self.run_at).to_numpy()
        z[np.arange(m), place] = 1.0
        self.z, self.level, self.place = z, level, place
        self.y = pdf["perf"].to_numpy(float) - self.reference
        # what happens to each observed asset on the way into the step
        before = pdf.groupby("asset", sort=False)[["run_id", "age"]].shift()
        fresh = (before["run_id"] != pdf["run_id"]).to_numpy()
        gain = np.where(fresh, 0.0, np.maximum(pdf["age"] - before["age"].fillna(0.0), 0.0))
        base = pdf["mode"].map(self.mode_at).to_numpy()
        self.edges = edges = np.searchsorted(self.step, np.arange(steps + 1))
        # per step, the last lap of an asset counting: its rows, the (level, mode) of fresh units, the (level, age gained) of older ones, and the places that new runs take
        levels, bases, gains, news = level.tolist(), base.tolist(), gain.tolist(), fresh.tolist()
        self.by_step, self.crowd = [], {}
        for s in range(steps):
            rows = range(edges[s], edges[s + 1])
            if len(rows) > ONE_BY_ONE:
                j = edges[s] + np.flatnonzero(~fresh[edges[s] : edges[s + 1]])
                self.crowd[s] = (level[j], gain[j])
            self.by_step.append((
                np.arange(edges[s], edges[s + 1]), list({levels[j]: bases[j] for j in rows if news[j]}.items()),
                list({levels[j]: gains[j] for j in rows if not news[j]}.items()), opened[s]))

    @cached_property
    def reads(self):
        """States read at each step: the shared ones, the levels and the rates of the assets seen; at the last step all levels, rates and mode rates."""
        shared = np.arange(4)
        reads = [np.concatenate([shared, self.level[r], self.level[r] + 1]) for r, *_ in self.by_step[:-1]]
        every = np.array(list(self.level_at.values()))
        return [*reads, np.concatenate([shared, every, every + 1, np.array(list(self.mode_at.values()), dtype=int)])]

    @staticmethod
    def _places(runs, step, steps, at, held):
        """Place of every run, the places taken at each step, and the number of states."""
        last = dict(zip(runs, step))
        run_at, opened, free, ends = {}, [[] for _ in range(steps)], [], [[] for _ in range(steps + 1)]
        seen = 0
        for run, s in zip(runs, step):
            if run in run_at:
                continue
            while seen < s:
                free += ends[seen]
                seen += 1
            if free:
                run_at[run] = free.pop()
            else:
                run_at[run] = at
                at += 1
            opened[s].append(run_at[run])
            if run not in held:
                ends[last[run]].append(run_at[run])
        return run_at, opened, at

    def start(self, priors: Priors):
        a, p = np.zeros(self.n), np.zeros(self.n)
        a[0], p[0] = priors.drift_mean, priors.drift_sd ** 2
        p[1] = 1e-4
        a[2], p[2] = priors.load_mean, priors.load_sd ** 2
        p[3] = priors.interference_sd ** 2
        for i in self.mode_at.values():
            a[i], p[i] = priors.rate_mean, priors.rate_sd ** 2
        p[list(self.run_at.values())] = priors.intercept_sd ** 2
        for i in self.level_at.values():
            p[i] = p[i + 1] = _DIFFUSE
        return a, np.diag(p)

    def design(self, hyper: Hyper):
        z = self.z.copy()
        z[:, 0] = -(1.0 - np.exp(-math.exp(hyper.log_drift_shape) * self.offset))
        return z


def _advance(lay: Layout, step: int, hyper: Hyper, priors: Priors, a, P):
    """Move mean and covariance into a step: reset or age the assets seen there, and reset the places of new runs."""
    _, fresh, older, opened = lay.by_step[step]
    a, P = a.copy(), P.copy()
    diagonal = P.reshape(-1)[:: lay.n + 1]
    q_level, q_rate = math.exp(hyper.log_q_level), math.exp(hyper.log_q_rate)
    unit_rate = math.exp(2 * hyper.log_unit_rate_sd)
    if step in lay.crowd:
        i, g = lay.crowd[step]
        a[i] += g * a[i + 1]
        P[i] += g[:, None] * P[i + 1]
        P[:, i] += g * P[:, i + 1]
    else:
        for i, g in older:
            a[i] += g * a[i + 1]
            P[i] += g * P[i + 1]
            P[:, i] += g * P[:, i + 1]
    for i, b in fresh:
        a[i] = 0.0
        a[i + 1] = a[b]
        P[i] = 0.0
        P[i + 1] = P[b]
        P[:, i] = 0.0
        P[:, i + 1] = P[:, b]
        diagonal[i] += priors.level_sd ** 2
        diagonal[i + 1] += unit_rate
    for i in opened:
        a[i] = 0.0
        P[i] = 0.0
        P[:, i] = 0.0
        diagonal[i] = priors.intercept_sd ** 2
    diagonal[1] += math.exp(hyper.log_q_drift)
    for i, g in [lay.crowd[step]] if step in lay.crowd else older:
        diagonal[i] += q_level * g
        diagonal[i + 1] += q_rate * g
    return a, P


def _back(lay: Layout, step: int, X):
    """T' X for the transition into a step, in place: how later states depend on earlier ones."""
    _, fresh, older, opened = lay.by_step[step]
    for i, b in fresh:
        X[b] += X[i + 1]
        X[i : i + 2] = 0.0
    if step in lay.crowd:
        i, g = lay.crowd[step]
        X[i + 1] += (g * X[i].T).T
        older = ()
    for i, g in older:
        X[i + 1] += g * X[i]
    for i in opened:
        X[i] = 0.0


def run_filter(lay: Layout, hyper: Hyper, priors: Priors, keep=True, span=None, state=None, visit=None):
    """Forward pass with the exact log-likelihood; ``keep`` stores what smoothing needs.

    ``span`` and ``state`` restart it inside a session; ``visit`` sees every step's filtered mean and covariance.
    What is kept per step: its mean and covariance before its laps, its mean after them, and what each lap, or all at once, changed.
    """
    z, noise_var = lay.design(hyper), math.exp(2 * hyper.log_noise_sd)
    a, P = state or lay.start(priors)
    loglik, kept = 0.0, []
    resid, rvar = np.empty(len(lay.y)), np.empty(len(lay.y))
    for step in range(*(span or (0, len(lay.by_step)))):
        idx = lay.by_step[step][0]
        prior_a, prior_P = a, P = _advance(lay, step, hyper, priors, a, P)
        Z = z[idx[0] : idx[-1] + 1]
        changes = []
        if len(idx) <= ONE_BY_ONE:
            ahead = len(idx) > 1
            if ahead:
                resid[idx] = lay.y[idx] - Z @ a
                rvar[idx] = ((Z @ P) * Z).sum(axis=1) + noise_var
            for j, x in zip(idx, Z):
                px = P @ x
                v, s = float(lay.y[j] - x @ a), float(x @ px) + noise_var
                if not s > 0:
                    raise np.linalg.LinAlgError("Matrix is not positive definite")
                if not ahead:
                    resid[j], rvar[j] = v, s
                loglik -= 0.5 * (_LOG_2PI + math.log(s) + v * v / s)
                a = a + px * (v / s)
                g = px / math.sqrt(s)
                P = P - g[:, None] * g
                if keep:
                    changes.append((x, px, s, v))
        else:
            # a lap reads the four shared states, its level and its run: rows of P are added up, Z is not multiplied out
            lv, run, k = lay.level[idx], lay.place[idx], len(idx)
            v = lay.y[idx] - Z @ a
            ZP = Z[:, :4] @ P[:4] + P[lv] + P[run]
            S = ZP[:, :4] @ Z[:, :4].T + ZP[:, lv] + ZP[:, run]
            S[np.diag_indices_from(S)] += noise_var
            S = 0.5 * (S + S.T)
            L = np.linalg.cholesky(S)
            half = np.linalg.solve(L, np.column_stack([v, ZP, np.eye(k)] if keep else [v, ZP]))
            w, G = half[:, 0], half[:, 1 : lay.n + 1]
            loglik -= 0.5 * (k * _LOG_2PI + 2 * np.log(np.diag(L)).sum() + w @ w)
            resid[idx], rvar[idx] = v, np.diag(S)
            a = a + G.T @ w
            P = P - G.T @ G
            if keep:
                whole = np.linalg.solve(L.T, half)
                changes = (Z, whole[:, 0], whole[:, 1 : lay.n + 1], whole[:, lay.n + 1 :])
        P = 0.5 * (P + P.T)
        if keep:
            kept.append((prior_a, prior_P, a, changes))
        if visit:
            visit(step, a, P)
    return loglik, resid, rvar, kept


def run_smoother(lay: Layout, kept, first=0, later=None, carry=None):
    """Backward pass in information form (r, N): no inverse of a state covariance is needed.

    Returns per step the mean of every state, the states whose covariance is
    read (shared ones, the assets seen there, mode rates at the end) and that
    block of the covariance. ``first`` is the step of ``kept[0]``, ``later`` the
    (r, N) of the block behind it, and ``carry`` receives those of this block.
    """
    r, N = (x.copy() for x in later) if later else (np.zeros(lay.n), np.zeros((lay.n, lay.n)))
    out = [None] * len(kept)
    for step in range(first + len(kept) - 1, first - 1, -1):
        prior_a, prior_P, _, changes = kept[step - first]
        # fold this step's observations into (r, N), which describe what follows
        if isinstance(changes, list):
            for x, px, s, v in reversed(changes):
                r = r + x * ((v - float(px @ r)) / s)
                w = N @ px / s
                h = x[:, None] * (w - x * (0.5 * (float(px @ w) + 1.0) / s))
                N -= h
                N -= h.T
        else:
            # gain K: N becomes (I - KZ)' N (I - KZ) + Z' inv(S) Z
            Z, u, gain, inverse = changes
            r = r + Z.T @ (u - gain @ r)
            NK = N @ gain.T
            D = (0.5 * (Z.T @ (inverse + gain @ NK)) - NK) @ Z
            N = N + D + D.T
            N = 0.5 * (N + N.T)
        mean = prior_a + prior_P @ r
        sel = lay.reads[step]
        side = prior_P[sel]
        out[step - first] = (mean, sel, side[:, sel] - side @ N @ side.T)
        _back(lay, step, r)
        _back(lay, step, N)
        _back(lay, step, N.T)
    if carry is not None:
        carry[:] = [r, N]
    return out


STATE_SCHEMA = (
    "session_id long, variant string, kind string, seq long, asset long, run_id long, event_id long, mode string, age double, "
    "elapsed double, perf double, interference double, "
    "level_f double, level_f_sd double, rate_f double, rate_f_sd double, "
    "level double, level_sd double, rate double, rate_sd double, level_rate_cov double, "
    "innovation double, innovation_sd double, "
    "drift double, drift_sd double, drift_basis double, drift_resid double, "
    "load double, load_sd double, coefficient double, coefficient_sd double, amplitude double, amplitude_sd double, "
    "coef double, coef_sd double, loglik double, n_obs long, n_states long, reference double, "
    "q_level double, q_rate double, noise_sd double, error string"
)
_COLUMNS = [c.split()[0] for c in STATE_SCHEMA.split(", ")]


def _fit_rows(key, lay: Layout, hyper: Hyper, priors: Priors):
    steps = len(lay.by_step)
    # as many steps as fit into the bound are kept; the result does not depend on how many
    block = min(max(math.isqrt(steps), KEPT_BYTES // (16 * lay.n * lay.n), 1), steps)
    live_at = _live_at(steps)
    shared, seen, filtered, smoothed = [None] * steps, [lay.level[r] for r, *_ in lay.by_step], [None] * steps, [None] * steps
    starts, known_live = {0: lay.start(priors)}, {}

    def visit(step, a, P):
        i = seen[step]
        diagonal = P.diagonal()
        filtered[step] = np.array([a[i], diagonal[i], a[i + 1], diagonal[i + 1]])
        if (step + 1) % block == 0:
            starts[step + 1] = (a, P)
        if step == live_at:
            known_live.update({name: (a[i], P[i, i]) for name, i in lay.mode_at.items()})

    loglik, resid, rvar, kept = run_filter(lay, hyper, priors, keep=block == steps, visit=visit)
    later, last = None, None
    for first in range((steps - 1) // block * block, -1, -block):
        if block < steps:
            *_, kept = run_filter(lay, hyper, priors, span=(first, min(first + block, steps)), state=starts[first])
        carry = []
        for step, (mean, sel, P) in enumerate(run_smoother(lay, kept, first, later, carry), first):
            i = seen[step]
            # the levels seen stand behind the four shared states, their rates behind the levels; the last step reads all assets
            if step == steps - 1:
                lv, width = 4 + np.searchsorted(sel[4 : 4 + len(lay.assets)], i), len(lay.assets)
                last = (mean, sel, P)
            else:
                lv, width = slice(4, 4 + len(i)), len(i)
            diagonal = P.diagonal()
            smoothed[step] = np.array([mean[i], diagonal[lv], mean[i + 1], diagonal[width:][lv], P.diagonal(width)[lv]])
            shared[step] = np.concatenate([mean[:4], diagonal[:4]])
        later = tuple(carry)
    last_a, sel, last_P = last
    spot = {int(s): k for k, s in enumerate(sel)}
    ends = {i: (last_a[i], last_P[spot[i], spot[i]]) for i in (2, 3, 0, *lay.mode_at.values())}
    found = _found(key, lay, hyper, loglik, resid, rvar, np.hstack(filtered), np.hstack(smoothed), np.array(shared)[lay.step].T, ends, known_live)
    return pd.DataFrame(found)


def _found(key, lay: Layout, hyper: Hyper, loglik, resid, rvar, filtered, smoothed, by_lap, ends, known_live):
    """Columns of the rows of one fit: its laps, coefficients, mode rates, mode rates as known live, and the fit itself."""
    m, sd = len(lay.y), lambda x: math.sqrt(max(x, 0.0))
    get = dict(zip(("level_f", "level_f_sd", "rate_f", "rate_f_sd"), filtered))
    get |= dict(zip(("level", "level_sd", "rate", "rate_sd", "level_rate_cov"), smoothed))
    get |= dict(zip(("amplitude", "drift_resid", "load", "coefficient", "amplitude_sd", "", "load_sd", "coefficient_sd"), by_lap))
    del get[""]
    get |= {c: np.sqrt(np.maximum(x, 0.0)) for c, x in get.items() if c.endswith("_sd")}
    rows = lay.rows
    basis = -(1.0 - np.exp(-math.exp(hyper.log_drift_shape) * lay.offset))
    get |= {"innovation": resid, "innovation_sd": np.sqrt(rvar), "drift_basis": basis,
            "drift": basis * get["amplitude"] + get["drift_resid"], "drift_sd": np.abs(basis) * get["amplitude_sd"]}
    get |= {c: rows[c].to_numpy() for c in ("seq", "asset", "run_id", "event_id", "mode", "age", "elapsed", "perf", "interference")}
    # mode rates at the end, and as they stood three quarters through, before the rest was seen
    coefs = [("coef", name, *ends[i]) for name, i in (("load", 2), ("interference", 3), ("drift", 0))]
    coefs += [("mode", name, *ends[i]) for name, i in lay.mode_at.items()]
    coefs += [("live", name, *known_live[name]) for name in known_live]
    behind = len(coefs) + 1
    texts = {"kind": ["lap"] * m + [c[0] for c in coefs] + ["fit"], "mode": [*get.pop("mode"), *[c[1] for c in coefs], None]}
    numbers = {"coef": [c[2] for c in coefs], "coef_sd": [sd(c[3]) for c in coefs]}
    whole = {"loglik": loglik, "n_obs": m, "n_states": lay.n_states, "reference": lay.reference, "q_level": math.exp(hyper.log_q_level),
             "q_rate": math.exp(hyper.log_q_rate), "noise_sd": math.exp(hyper.log_noise_sd)}
    out = {}
    for c in _COLUMNS:
        if c in texts:
            column = np.empty(m + behind, dtype=object)
            column[:] = texts[c]
        elif c in ("session_id", "variant", "error"):
            column = np.empty(m + behind, dtype=object)
            column[:] = {"session_id": key[0], "variant": key[1], "error": None}[c]
        elif c in whole:
            column = np.full(m + behind, whole[c])
        else:
            column = np.full(m + behind, np.nan)
            if c in numbers:
                column[m : m + len(coefs)] = numbers[c]
            else:
                column[:m] = get[c]
        out[c] = column
    return out


def _live_at(steps):
    """The step three quarters through."""
    return max(int((steps + 1) * 0.75) - 1, 1) - 1


def _fit_many(fits):
    """Columns of every fit, given as (key, layout, hyper-parameters, priors), or the reason why it has none.

    Sessions run side by side, but for those with many laps in one step or more than fits into the bound.
    """
    out = [None] * len(fits)
    small = [i for i, (_, lay, *_) in enumerate(fits) if not lay.crowd and kept_bytes(lay) <= KEPT_BYTES]
    for i in sorted({*range(len(fits))} - {*small}):
        try:
            out[i] = dict(_fit_rows(*fits[i]).items())
        except _UNFIT as exc:
            out[i] = exc
    for chosen in batches([fits[i][1] for i in small], KEPT_BYTES):
        chosen = [small[i] for i in chosen]
        keys, lays, hypers, priors = zip(*[fits[i] for i in chosen])
        both = SideBySide(lays, hypers, priors).forward(watch=[_live_at(len(x.by_step)) for x in lays]).backward()
        for b, i in enumerate(chosen):
            if both.broken[b]:
                out[i] = np.linalg.LinAlgError("Matrix is not positive definite")
                continue
            lay, m = lays[b], len(lays[b].y)
            diagonal = both.P[b].diagonal()
            ends = {i: (both.a[b, i], diagonal[i]) for i in (2, 3, 0, *lay.mode_at.values())}
            mean, var = both.watched[b]
            known_live = {name: (mean[j], var[j]) for name, j in lay.mode_at.items()}
            out[i] = _found(keys[b], lay, hypers[b], both.loglik[b], both.resid[:m, b], both.rvar[:m, b], both.filtered[:, :m, b], both.smoothed[:, :m, b],
                            both.shared[:, :m, b], ends, known_live)
    return out


_INPUT = ("session_id", "variant", "seq", "asset", "run_id", "event_id", "mode", "age", "elapsed", "perf", "interference")


def _settings_of(variants=None):
    """Prior and hyper-parameters of every variant to fit."""
    names = [f.name for f in fields(Priors)] + list(HYPER_NAMES)
    rows = {}
    for label, changes in (variants or {"default": {}}).items():
        full = {**{f.name: f.default for f in fields(Priors)}, **{f.name: f.default for f in fields(Hyper)}, **changes}
        rows[label] = {n: float(full[n]) for n in names}
    return rows


def _settings(settings, pdf):
    """Hyper-parameters and priors of a group, its own hyper-parameters before those of its variant."""
    first = pdf.iloc[0]
    own = {n: float(first[n]) for n in HYPER_NAMES if n in pdf.columns and not pd.isna(first[n])}
    full = {**settings[first["variant"]], **own}
    return Hyper(**{n: full[n] for n in HYPER_NAMES}), Priors(**{f.name: full[f.name] for f in fields(Priors)})


def fit_sessions(laps: DataFrame, variants=None, hyper: DataFrame | None = None) -> DataFrame:
    """Fit every session under every variant; one long table of lap, coefficient, mode and fit rows.

    ``hyper`` optionally replaces the hyper-parameters per session, as ``tune``
    returns them. A group that cannot be fitted becomes one row with
    ``error`` set.
    """
    if "interference" not in laps.columns:
        laps = laps.withColumn("interference", F.lit(0.0))
    # settings are not moved with the rows but for those a session has of its own
    settings = _settings_of(variants)
    rows = laps.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in settings])))
    if hyper is not None:
        rows = rows.drop(*HYPER_NAMES).join(hyper.select("session_id", *HYPER_NAMES), "session_id", "left")

    def fit(groups):
        out, fits = {}, []
        for k, (key, pdf) in enumerate(groups):
            try:
                hyp, pri = _settings(settings, pdf)
                fits.append((k, (key, Layout(pdf), hyp, pri)))
            except _UNFIT as exc:
                out[k] = exc
        out |= dict(zip([k for k, _ in fits], _fit_many([f for _, f in fits])))
        for k, (key, _) in enumerate(groups):
            yield _unfit(key, out[k]) if isinstance(out[k], Exception) else out[k]

    return by_groups(rows.select(*_INPUT, *(HYPER_NAMES if hyper is not None else ())), FIT_KEYS, fit, STATE_SCHEMA)


def _unfit(key, exc):
    """The one row of a group that cannot be fitted."""
    said = {"session_id": key[0], "variant": key[1], "kind": "fit", "error": f"{type(exc).__name__}: {exc}"}
    return {c: np.array([said.get(c)], dtype=object) for c in _COLUMNS}


def lap_states(fit: DataFrame) -> DataFrame:
    """Per-lap filtered and smoothed states with the standardised one-step residual, unless the residuals were left out of the table."""
    laps = fit.where("kind = 'lap'")
    return laps if "innovation" not in fit.columns else laps.withColumn("std_residual", F.col("innovation") / F.col("innovation_sd"))


def coefficients(fit: DataFrame) -> DataFrame:
    """Load slope, interference coefficient and drift amplitude."""
    return fit.where("kind = 'coef'").select(*FIT_KEYS, F.col("mode").alias("name"), F.col("coef").alias("mean"), F.col("coef_sd").alias("sd"))


def mode_rates(fit: DataFrame) -> DataFrame:
    """Pooled degradation rate per mode."""
    return fit.where("kind = 'mode'").select(*FIT_KEYS, "mode", F.col("coef").alias("rate"), F.col("coef_sd").alias("rate_sd"))


def drift_curve(fit: DataFrame) -> DataFrame:
    """Estimated drift of the session against its start, per seq."""
    return fit.where("kind = 'lap'").groupBy(*FIT_KEYS, "seq").agg(F.first("drift").alias("drift"), F.first("drift_sd").alias("drift_sd"))


def diagnostics(fit: DataFrame, n_params=len(HYPER_NAMES)) -> DataFrame:
    """Log-likelihood, AIC and BIC per fit, or the error that stopped it."""
    return fit.where("kind = 'fit'").select(
        *FIT_KEYS, "loglik", "n_obs", "n_states", (2.0 * n_params - 2 * F.col("loglik")).alias("aic"),
        (F.lit(float(n_params)) * F.log("n_obs") - 2 * F.col("loglik")).alias("bic"), "error",
    )


_TUNED = "session_id long, loglik double, start_loglik double, evaluated int, " + ", ".join(f"{n} double" for n in HYPER_NAMES)


def tune(laps: DataFrame, priors: Priors | None = None, rounds=3, step=1.5) -> DataFrame:
    """Hyper-parameters per session that maximise the marginal likelihood inside fixed bounds.

    A coordinate search: every round tries one step up and down in each of the
    six, keeps what helps and halves the step. The design of a session is built
    once for all its candidates. A candidate that breaks down scores -1e12.
    """
    priors = priors or Priors()
    if "interference" not in laps.columns:
        laps = laps.withColumn("interference", F.lit(0.0))
    rows = laps.withColumn("variant", F.lit("tune"))

    def search(key, pdf):
        lay = Layout(pdf)
        tried = 0

        def score(v):
            nonlocal tried
            tried += 1
            try:
                return run_filter(lay, Hyper(*v), priors, keep=False)[0]
            except (np.linalg.LinAlgError, FloatingPointError):
                return -1.0e12

        best = [f.default for f in fields(Hyper)]
        top = start = score(best)
        width = step
        for _ in range(rounds):
            for i, (lo, hi) in enumerate(BOUNDS):
                for sign in (1, -1):
                    trial = list(best)
                    trial[i] = min(max(trial[i] + sign * width, lo), hi)
                    value = score(trial) if trial != best else top
                    if value > top:
                        best, top = trial, value
                        break
            width /= 2
        return pd.DataFrame([{"session_id": key[0], "loglik": top, "start_loglik": start, "evaluated": tried,
                              **dict(zip(HYPER_NAMES, best))}])

    return spread(rows.select(*_INPUT), "session_id").groupBy("session_id").applyInPandas(search, _TUNED)


_PREDICTED = ("session_id long, fold int, seq long, asset long, event_id long, actual double, mean double, sd double, model string, failed string")


def forecast_rung(laps: DataFrame, folds: DataFrame, hyper: Hyper | None = None) -> DataFrame:
    """Forecasts of held-out laps: the last smoothed state, the level carried forward over the age gained.

    An asset the training laps never saw gets their median and spread.
    """
    from wearframe.operators.folds import in_folds

    hyper = hyper or Hyper()
    if "interference" not in laps.columns:
        laps = laps.withColumn("interference", F.lit(0.0))
    train, test = in_folds(laps, folds)
    cols = ["session_id", "fold", "seq", "asset", "run_id", "event_id", "mode", "age", "elapsed", "perf", "interference"]
    rows = train.select(*cols, F.lit(True).alias("is_train")).unionByName(test.select(*cols, F.lit(False).alias("is_train")))

    names = [c.split()[0] for c in _PREDICTED.split(", ")]

    def predict(groups):
        lays, failed = {}, {}
        for k, (_, pdf) in enumerate(groups):
            seen, held = pdf[pdf["is_train"]], pdf[~pdf["is_train"]]
            if held.empty:
                continue
            try:
                lays[k] = Layout(seen, held["run_id"].unique())
            except _UNFIT as exc:
                failed[k] = exc
        ends = dict(zip(lays, _ends(list(lays.values()), hyper, Priors())))
        for k, (_, pdf) in enumerate(groups):
            held = pdf[~pdf["is_train"]]
            base = held[["session_id", "fold", "seq", "asset", "event_id"]].assign(actual=held["perf"], model="statespace", failed=None)
            end = failed.get(k) or ends.get(k)
            if held.empty:
                yield base.assign(mean=[], sd=[])[names]
            elif isinstance(end, Exception):
                yield base.assign(mean=np.nan, sd=np.nan, failed=f"{type(end).__name__}: {end}")[names]
            else:
                mean, sd = _ahead(lays[k], hyper, pdf[pdf["is_train"]], held, *end)
                yield base.assign(mean=mean, sd=sd)[names]

    return by_groups(rows, ("session_id", "fold"), predict, _PREDICTED)


def _ends(lays, hyper: Hyper, priors: Priors):
    """Mean and covariance of every session after its last step, where the smoothed state is the filtered one, or the reason why there is none."""
    out = [None] * len(lays)
    small = [i for i, lay in enumerate(lays) if not lay.crowd]
    for i in sorted({*range(len(lays))} - {*small}):
        end = {}
        try:
            run_filter(lays[i], hyper, priors, keep=False, visit=lambda step, a, P: end.update(a=a, P=P))
            out[i] = (end["a"], end["P"])
        except _UNFIT as exc:
            out[i] = exc
    for chosen in batches([lays[i] for i in small], KEPT_BYTES):
        some = [lays[small[i]] for i in chosen]
        both = SideBySide(some, [hyper] * len(some), [priors] * len(some)).forward(keep=False)
        for b, i in enumerate(chosen):
            out[small[i]] = np.linalg.LinAlgError("Matrix is not positive definite") if both.broken[b] else (both.a[b], both.P[b])
    return out


def _ahead(lay: Layout, hyper: Hyper, seen, held, a, P):
    """Forecasts and spreads of held-out laps from the last state."""
    oldest = seen.groupby(["asset", "run_id"])["age"].max().to_dict()
    shape, noise = math.exp(hyper.log_drift_shape), math.exp(2 * hyper.log_noise_sd)
    ql, qr = math.exp(hyper.log_q_level), math.exp(hyper.log_q_rate)
    middle, apart = float(seen["perf"].median()), float(seen["perf"].std())
    means, sds = [], []
    for row in held.itertuples(index=False):
        i = lay.level_at.get(row.asset)
        if i is None:
            means.append(middle)
            sds.append(apart)
            continue
        level, var = a[i], max(P[i, i], 0.0)
        known = oldest.get((row.asset, row.run_id))
        if known is not None and row.age > known:
            ahead = row.age - known
            level += ahead * a[i + 1]
            var += ahead ** 2 * max(P[i + 1, i + 1], 0.0) + ahead * ql + ahead ** 3 / 3 * qr
        run = lay.run_at.get(row.run_id)
        basis = -(1 - math.exp(-shape * (row.seq - float(lay.seqs[0]))))
        means.append(lay.reference + (a[run] if run is not None else 0.0) + level + basis * a[0] + a[1]
                     - a[2] * row.elapsed + a[3] * (0.0 if pd.isna(row.interference) else row.interference))
        sds.append(max(math.sqrt(var + noise), 1e-3))
    return means, sds


#: Prior variants of the sensitivity sweep; fixed values.
PRIOR_VARIANTS = {
    "baseline": {},
    "load +1sd": {"load_mean": 0.097},
    "load -1sd": {"load_mean": 0.065},
    "drift +1sd": {"drift_mean": 1.35},
    "drift -1sd": {"drift_mean": 0.45},
    "wide priors": {"load_sd": 0.032, "drift_sd": 0.90},
}


def prior_sweep(laps: DataFrame, variants=None) -> DataFrame:
    """Mode rates under each prior variant, on half the assets, and as known live three quarters through."""
    from wearframe.operators.rates import half_field
    from wearframe.operators.staging import stage

    fit = stage(fit_sessions(laps, variants or PRIOR_VARIANTS))
    half = mode_rates(fit_sessions(half_field(laps))).withColumn("variant", F.lit("half field"))
    live = fit.where("kind = 'live' AND variant = 'baseline'").select(
        "session_id", F.lit("live at 75%").alias("variant"), "mode", F.col("coef").alias("rate"), F.col("coef_sd").alias("rate_sd")
    )
    return mode_rates(fit).unionByName(half).unionByName(live)
