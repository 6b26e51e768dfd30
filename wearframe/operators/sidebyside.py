"""Many sessions of the session model at once: their laps are taken up side by side.

The work of one lap is a few small array operations, which cost more to call than to do. Here a call does
the next lap of every session at hand. The sessions stay independent and each gets what ``run_filter`` and
``run_smoother`` give it; sessions too large to keep, or with many laps in one step, are left to those.
"""

import math

import numpy as np

_LOG_2PI = math.log(2 * math.pi)

#: Sessions taken up together, and the bytes of their covariances that should stay in a processor's cache.
TOGETHER, CACHE_BYTES = 64, 1 << 20


def kept_bytes(lay) -> int:
    """What both passes keep of one session, as the longest of its batch."""
    return 8 * len(lay.y) * (8 * lay.n + 64)


def batches(lays, limit):
    """Positions of ``lays`` in batches of like length; every batch keeps at most ``limit`` bytes, or is one session."""
    order = sorted(range(len(lays)), key=lambda i: -len(lays[i].y))
    out, n, most = [], 0, 0
    for i in order:
        wide, long = max(n, lays[i].n), max(most, kept_bytes(lays[i]))
        size = len(out) + 1
        if out and (size > TOGETHER or size * wide * wide * 8 > CACHE_BYTES or size * long * wide // lays[i].n > limit):
            yield out
            out, wide, long = [], lays[i].n, kept_bytes(lays[i])
        out.append(i)
        n, most = wide, long
    if out:
        yield out


def _by_lap(k, *values):
    """Entries by lap number: for each number, one array of every value."""
    k = np.asarray(k, dtype=np.int64)
    order = np.argsort(k, kind="stable")
    cuts = np.flatnonzero(np.diff(k[order])) + 1
    parts = zip(*[np.split(np.asarray(v)[order], cuts) for v in values])
    return dict(zip(k[order][[0, *cuts]].tolist(), parts)) if len(k) else {}


class SideBySide:
    """Both passes over sessions given by falling number of laps, so that those with laps left are the first ones."""

    def __init__(self, lays, hypers, priors):
        self.lays, self.priors = lays, priors
        size, self.n, self.m = len(lays), max(x.n for x in lays), len(lays[0].y)
        counts = np.array([len(x.y) for x in lays])
        self.live = np.searchsorted(-counts, -np.arange(self.m), side="left").tolist()
        self.idx = np.zeros((self.m, size, 6), dtype=np.int64)
        self.val, self.y = np.zeros((self.m, size, 6)), np.zeros((self.m, size))
        older, fresh, opened, laps, starts = [], [], [], [], []
        for b, (lay, hyper) in enumerate(zip(lays, hypers)):
            c = counts[b]
            self.idx[:c, b, :4] = range(4)
            self.idx[:c, b, 4], self.idx[:c, b, 5] = lay.level, lay.place
            self.val[:c, b] = np.take_along_axis(lay.design(hyper), self.idx[:c, b], axis=1)
            self.y[:c, b] = lay.y
            first = lay.edges[lay.step]
            laps.append(np.stack([np.full(c, b), np.arange(c), first, lay.edges[lay.step + 1] - 1, lay.level]))
            starts.append(np.stack([lay.edges[:-1], np.full(len(lay.by_step), b)]))
            for k, (_, new, old, taken) in zip(lay.edges.tolist(), lay.by_step):
                older += [(k, b, i, g) for i, g in old]
                fresh += [(k, b, i, at, j) for j, (i, at) in enumerate(new)]
                opened += [(k, b, i) for i in taken]
        # what happens on the way into the steps that begin with a lap; a level or place is named once a step
        self.older, self.fresh, self.opened = (_by_lap(*zip(*x)) if x else {} for x in (older, fresh, opened))
        self.starts = _by_lap(*np.concatenate(starts, axis=1))
        b, lap, first, last, level = np.concatenate(laps, axis=1)
        # all laps of the steps that begin or end with a lap: session, lap and level
        self.begins, self.ends = _by_lap(first, b, lap, level), _by_lap(last, b, lap, level)
        every = lambda f: np.array([math.exp(f(h)) for h in hypers])
        self.noise = every(lambda h: 2 * h.log_noise_sd)
        self.q_drift, self.q_level, self.q_rate = every(lambda h: h.log_q_drift), every(lambda h: h.log_q_level), every(lambda h: h.log_q_rate)
        self.unit_rate = every(lambda h: 2 * h.log_unit_rate_sd)
        self.level_var, self.intercept_var = (np.array([getattr(p, f) ** 2 for p in priors]) for f in ("level_sd", "intercept_sd"))

    def _advance(self, k, a, P):
        """As ``statespace._advance``, for the sessions whose next step begins with lap ``k``."""
        if k in self.older:
            b, i, g = self.older[k]
            w = g[:, None]
            a[b, i] += g * a[b, i + 1]
            P[b, i] += w * P[b, i + 1]
            P[b, :, i] += w * P[b, :, i + 1]
        if k in self.fresh:
            b, i, at, _ = self.fresh[k]
            a[b, i], a[b, i + 1] = 0.0, a[b, at]
            P[b, i], P[b, i + 1] = 0.0, P[b, at]
            P[b, :, i], P[b, :, i + 1] = 0.0, P[b, :, at]
            P[b, i, i] += self.level_var[b]
            P[b, i + 1, i + 1] += self.unit_rate[b]
        if k in self.opened:
            b, i = self.opened[k]
            a[b, i], P[b, i], P[b, :, i] = 0.0, 0.0, 0.0
            P[b, i, i] = self.intercept_var[b]
        (b,) = self.starts[k]
        P[b, 1, 1] += self.q_drift[b]
        if k in self.older:
            b, i, g = self.older[k]
            P[b, i, i] += self.q_level[b] * g
            P[b, i + 1, i + 1] += self.q_rate[b] * g

    def _back(self, k, r, N):
        """As ``statespace._back``, for the sessions whose step began with lap ``k``."""
        if k in self.fresh:
            every = self.fresh[k]
            # units of one mode add to the same state, so one unit of a session at a time
            for j in range(int(every[3].max()) + 1):
                b, i, at, _ = (x[every[3] == j] for x in every)
                r[b, at] += r[b, i + 1]
                N[b, at] += N[b, i + 1]
                N[b, :, at] += N[b, :, i + 1]
                r[b, i], N[b, i], N[b, :, i] = 0.0, 0.0, 0.0
                r[b, i + 1], N[b, i + 1], N[b, :, i + 1] = 0.0, 0.0, 0.0
        if k in self.older:
            b, i, g = self.older[k]
            w = g[:, None]
            r[b, i + 1] += g * r[b, i]
            N[b, i + 1] += w * N[b, i]
            N[b, :, i + 1] += w * N[b, :, i]
        if k in self.opened:
            b, i = self.opened[k]
            r[b, i], N[b, i], N[b, :, i] = 0.0, 0.0, 0.0

    def forward(self, keep=True, watch=None):
        """Log-likelihoods, broken sessions, last means and covariances, residuals and filtered states of every lap; ``keep`` stores what ``backward`` needs.

        ``watch`` names a step per session, after which the diagonal and the mean are kept in ``watched``.
        """
        size, n = len(self.lays), self.n
        a, P = np.zeros((size, n)), np.zeros((size, n, n))
        for b, (lay, prior) in enumerate(zip(self.lays, self.priors)):
            a[b, : lay.n], P[b, : lay.n, : lay.n] = lay.start(prior)
        self.loglik, self.broken = np.zeros(size), np.zeros(size, dtype=bool)
        self.resid, self.rvar, self.filtered = np.zeros((self.m, size)), np.zeros((self.m, size)), np.zeros((4, self.m, size))
        self.kept, self.before, self.watched = [], {}, {}
        seen_at = {}
        for b, step in enumerate(watch or ()):
            seen_at.setdefault(int(self.lays[b].edges[step + 1] - 1), []).append(b)
        buffer = np.empty_like(P)
        for k in range(self.m):
            live = self.live[k]
            if k in self.begins:
                self._advance(k, a, P)
                b, lap, level = self.begins[k]
                at, x = self.idx[lap, b], self.val[lap, b]
                self.resid[lap, b] = self.y[lap, b] - (x * a[b[:, None], at]).sum(axis=1)
                across = P[b[:, None, None], at[:, :, None], at[:, None, :]]
                self.rvar[lap, b] = (np.matmul(across, x[:, :, None])[:, :, 0] * x).sum(axis=1) + self.noise[b]
                if keep:
                    # the shared states, the level and the rate of every lap
                    read = at.copy()
                    read[:, 5] = level + 1
                    rows = P[b[:, None], read]
                    own = np.take_along_axis(rows, read[:, :, None], axis=2)[:, :, 0]
                    self.before[k] = (rows, a[b[:, None], read], own, rows[np.arange(len(b)), 4, level + 1])
            at, x, places = self.idx[k, :live], self.val[k, :live], np.arange(live)[:, None]
            px = np.matmul(x[:, None, :], P[places, at])[:, 0]
            v = self.y[k, :live] - (x * a[places, at]).sum(axis=1)
            s = (px[places, at] * x).sum(axis=1) + self.noise[:live]
            positive = s > 0
            if not positive.all():
                self.broken[:live] |= ~positive
                s = np.where(positive, s, 1.0)
            self.loglik[:live] -= 0.5 * (_LOG_2PI + np.log(s) + v * v / s)
            a[:live] += px * (v / s)[:, None]
            g = px / np.sqrt(s)[:, None]
            np.einsum("bi,bj->bij", g, g, out=buffer[:live])
            P[:live] -= buffer[:live]
            if keep:
                self.kept.append((px, s, v))
                if k in self.ends:
                    b, lap, level = self.ends[k]
                    self.filtered[:, lap, b] = a[b, level], P[b, level, level], a[b, level + 1], P[b, level + 1, level + 1]
            for b in seen_at.get(k, ()):
                self.watched[b] = (a[b].copy(), P[b].diagonal().copy())
        self.a, self.P = a, P
        return self

    def backward(self):
        """Smoothed states of every lap: (level, var, rate, var, cov) in ``smoothed``, the four shared means and variances in ``shared``."""
        size, n = len(self.lays), self.n
        r, N = np.zeros((size, n)), np.zeros((size, n, n))
        crossed = N.transpose(0, 2, 1)
        self.smoothed, self.shared = np.zeros((5, self.m, size)), np.zeros((8, self.m, size))
        for k in range(self.m - 1, -1, -1):
            at, x, (px, s, v) = self.idx[k], self.val[k], self.kept[k]
            live = len(s)
            at, x, places = at[:live], x[:live], np.arange(live)[:, None]
            w = np.matmul(N[:live], px[:, :, None])[:, :, 0] / s[:, None]
            r[places, at] += x * ((v - (px * r[:live]).sum(axis=1)) / s)[:, None]
            w[places, at] -= x * (0.5 * ((px * w).sum(axis=1) + 1.0) / s)[:, None]
            change = x[:, :, None] * w[:, None, :]
            N[places, at] -= change
            crossed[places, at] -= change
            if k in self.begins:
                (b, lap, _), (rows, mean, var, cov) = self.begins[k], self.before[k]
                mean = mean + np.matmul(rows, r[b][:, :, None])[:, :, 0]
                through = np.matmul(rows, N[b])
                var = var - (through * rows).sum(axis=2)
                cov = cov - (through[:, 4] * rows[:, 5]).sum(axis=1)
                self.smoothed[:, lap, b] = mean[:, 4], var[:, 4], mean[:, 5], var[:, 5], cov
                self.shared[:4, lap, b], self.shared[4:, lap, b] = mean[:, :4].T, var[:, :4].T
                self._back(k, r, N)
        return self
