"""Live estimation: one lap in, one state out, with the state kept per session.

The update is the same whether rows come from a stream or are replayed from a
table, so a replay gives exactly what the stream would have given.
"""

import math
import time
from collections import namedtuple
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from wearframe.operators.attribute import health
from wearframe.functions import narrate
from wearframe.operators import intervals
from wearframe.operators.staging import spread
from wearframe.operators.statespace import Hyper, Priors

OUTPUT = (
    "session_id long, asset long, seq long, run_id long, mode string, age double, level double, level_sd double, rate double, rate_sd double, "
    "laps_observed long, innovation double, innovation_z double, forecast double, low double, high double, covered boolean, "
    "coverage double, mode_rate double, mode_rate_sd double, perf double, reason string"
)
_COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]


class SessionEstimator:
    """Filtered state of one session, growing as new assets, modes and runs appear.

    Only the blocks of the covariance that exist are held; adding a state adds
    a row and a column with its prior. With ``declared`` (assets, modes), laps of others are refused.
    """

    def __init__(self, hyper: Hyper, priors: Priors, alpha=0.05, max_runs=None, declared=None):
        self.hyper, self.priors, self.max_runs = hyper, priors, max_runs
        self.declared = None if declared is None else (frozenset(declared[0]), frozenset(declared[1]))
        p = priors
        self.a = np.array([p.drift_mean, 0.0, p.load_mean, 0.0])
        self.P = np.diag([p.drift_sd ** 2, 1e-4, p.load_sd ** 2, p.interference_sd ** 2])
        self.modes, self.levels, self.runs, self.open_run, self.age, self.seen, self.n_runs = {}, {}, {}, {}, {}, {}, {}
        self.first = self.clock = self.reference = None
        self.alpha, self.interval = alpha, intervals.cold(alpha)

    def _grow(self, means, variances):
        n, k = len(self.a), len(means)
        self.a = np.concatenate([self.a, means])
        P = np.zeros((n + k, n + k))
        P[:n, :n] = self.P
        P[range(n, n + k), range(n, n + k)] = variances
        self.P = P
        return n

    def _retire(self, asset):
        """Drop the intercept of the asset's closed run: nothing later depends on it."""
        gone = self.runs.pop((asset, self.open_run.get(asset)), None)
        if gone is None:
            return
        self.a = np.delete(self.a, gone)
        self.P = np.delete(np.delete(self.P, gone, 0), gone, 1)
        for places in (self.modes, self.levels, self.runs):
            places.update({k: i - (i > gone) for k, i in places.items()})

    def refusal(self, lap):
        """Why a lap cannot be folded in, or None."""
        if self.declared is not None and lap.asset not in self.declared[0]:
            return "asset not declared"
        if self.declared is not None and lap.mode not in self.declared[1]:
            return "mode not declared"
        if lap.perf is None or not math.isfinite(lap.perf):
            return "no time"
        if self.clock is not None and lap.seq < self.clock:
            return "seq went backwards"
        new_run = self.open_run.get(lap.asset) != lap.run_id
        if self.max_runs is not None and new_run and self.n_runs.get(lap.asset, 0) >= self.max_runs:
            return "run budget exceeded"
        return None

    def observe(self, lap):
        """Advance to the lap, forecast it, score the interval, then update."""
        h, p = self.hyper, self.priors
        if self.first is None:
            self.first = self.clock = lap.seq
            self.reference = lap.perf
        if lap.mode not in self.modes:
            self.modes[lap.mode] = self._grow([p.rate_mean], [p.rate_sd ** 2])
        if lap.asset not in self.levels:
            self.levels[lap.asset] = self._grow([0.0, 0.0], [1e4, 1e4])
        if (lap.asset, lap.run_id) not in self.runs:
            self.runs[lap.asset, lap.run_id] = self._grow([0.0], [p.intercept_sd ** 2])
        a, P = self.a, self.P
        P[1, 1] += math.exp(h.log_q_drift) * (lap.seq - self.clock)
        self.clock = lap.seq
        lv, base = self.levels[lap.asset], self.modes[lap.mode]
        rt = lv + 1
        if self.open_run.get(lap.asset) != lap.run_id:
            self.n_runs[lap.asset] = self.n_runs.get(lap.asset, 0) + 1
            self._retire(lap.asset)
            a, P, lv, base = self.a, self.P, self.levels[lap.asset], self.modes[lap.mode]
            rt = lv + 1
            self.open_run[lap.asset] = lap.run_id
            a[lv], a[rt] = 0.0, a[base]
            P[lv, :] = P[:, lv] = 0.0
            P[rt, :] = P[base, :]
            P[:, rt] = P[:, base]
            P[lv, lv] = p.level_sd ** 2
            P[rt, rt] = P[base, base] + math.exp(2 * h.log_unit_rate_sd)
        else:
            gain = lap.age - self.age[lap.asset]
            if gain > 0:
                a[lv] += gain * a[rt]
                P[lv, :] += gain * P[rt, :]
                P[:, lv] += gain * P[:, rt]
                P[lv, lv] += math.exp(h.log_q_level) * gain
                P[rt, rt] += math.exp(h.log_q_rate) * gain
        self.age[lap.asset] = lap.age
        idx = [0, 1, 2, 3, lv, self.runs[lap.asset, lap.run_id]]
        basis = -(1.0 - math.exp(-math.exp(h.log_drift_shape) * (lap.seq - self.first)))
        i = 0.0 if lap.interference is None or math.isnan(lap.interference) else lap.interference
        z = np.array([basis, 1.0, -lap.elapsed, i, 1.0, 1.0])
        Pz = P[:, idx] @ z
        var = float(z @ Pz[idx]) + math.exp(2 * h.log_noise_sd)
        forecast = self.reference + float(z @ a[idx])
        v = lap.perf - forecast
        own, normal = abs(v), intervals.Z95 * math.sqrt(var)
        limit, hit = intervals.step(self.interval, own, own <= normal, self.alpha)
        half = normal if limit is None else limit * self.interval["past"].grid
        self.a = a + Pz * (v / var)
        # every change is made to rows and columns alike, so the covariance stays symmetric to the last digit
        P -= np.outer(Pz, Pz) / var
        self.seen[lap.asset] = self.seen.get(lap.asset, 0) + 1
        sd = lambda k: math.sqrt(max(self.P[k, k], 0.0))
        return {
            "level": self.a[lv], "level_sd": sd(lv), "rate": self.a[rt], "rate_sd": sd(rt), "laps_observed": self.seen[lap.asset],
            "innovation": v, "innovation_z": v / math.sqrt(var), "forecast": forecast, "low": forecast - half, "high": forecast + half,
            "covered": bool(hit), "coverage": 1.0 - self.interval["missed"] / self.interval["seen"],
            "mode_rate": self.a[base], "mode_rate_sd": sd(base),
        }


_LAP = ["session_id", "asset", "seq", "run_id", "mode", "age", "elapsed", "perf", "interference"]
_Lap = namedtuple("_Lap", _LAP)
_SHARED = ("session_id", "asset", "seq", "run_id", "mode", "age", "perf")
_OBSERVED = [c for c in _COLUMNS if c not in (*_SHARED, "reason")]


def _fold_columns(estimator: SessionEstimator, pdf: pd.DataFrame) -> dict[str, list]:
    """Columns of the laps in (seq, asset) order with what the estimator makes of each: a reason, or its state and forecast."""
    order = np.lexsort((pdf["asset"].to_numpy(), pdf["seq"].to_numpy()))
    laps = [_Lap(*values) for values in zip(*(pdf[c].to_numpy()[order].tolist() for c in _LAP))]
    out = {c: [getattr(lap, c) for lap in laps] for c in _SHARED} | {c: [] for c in (*_OBSERVED, "reason", "took_ms")}
    for lap in laps:
        began = time.perf_counter()
        reason = estimator.refusal(lap)
        seen = {} if reason else estimator.observe(lap)
        out["took_ms"].append((time.perf_counter() - began) * 1000)
        out["reason"].append(reason)
        for c in _OBSERVED:
            out[c].append(seen.get(c))
    return out


def _fold(estimator: SessionEstimator, pdf: pd.DataFrame) -> pd.DataFrame:
    out = _fold_columns(estimator, pdf)
    return pd.DataFrame({c: out[c] for c in _COLUMNS})


def replay_batch(laps: DataFrame, hyper: Hyper | None = None, priors: Priors | None = None, max_runs=None) -> DataFrame:
    """Replay stored laps through the live estimator, in order, one session per group.

    Batches of a session arrive in order and are folded in one after another;
    only the session's state is held.
    """
    hyper, priors = hyper or Hyper(), priors or Priors()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        estimator = SessionEstimator(hyper, priors, max_runs=max_runs)
        for pdf in batches:
            yield _fold(estimator, pdf)

    ordered = spread(laps.select(*_LAP), "session_id").sortWithinPartitions("session_id", "seq", "asset")
    return ordered.groupBy("session_id").applyInPandas(run, OUTPUT)


# ---- typed state of a streamed session --------------------------------------------

_BELIEF = "names ARRAY<STRING>, mean ARRAY<DOUBLE>, lower ARRAY<DOUBLE>"
_CLOCK = "first BIGINT, clock BIGINT, reference DOUBLE, last_ms BIGINT, accepted BIGINT, rejected BIGINT"
_ASSETS = "asset ARRAY<BIGINT>, open_run ARRAY<BIGINT>, age ARRAY<DOUBLE>, seen ARRAY<BIGINT>, runs ARRAY<BIGINT>"
_MODES = "mode ARRAY<STRING>, laps ARRAY<BIGINT>"
_INTERVAL = "rate DOUBLE, seen BIGINT, missed BIGINT"
_BLOCK = "keys ARRAY<BIGINT>, counts ARRAY<BIGINT>"
_DECLARED = "assets ARRAY<BIGINT>, modes ARRAY<STRING>"


class SessionStore:
    """A session in the state store, one typed variable per kind of fact.

    ``belief`` has the means and the lower triangle of the covariance of the named states, ``assets`` the open run of every asset, ``scores``
    the counted scores of the interval, of which only changed blocks are written. A call of the store costs more than a lap, so what
    grows with assets or modes, as the belief does, is one value and not one entry for each.
    """

    def __init__(self, handle):
        self.declared = handle.getValueState("declared", _DECLARED)
        self.clock = handle.getValueState("clock", _CLOCK)
        self.belief = handle.getValueState("belief", _BELIEF)
        self.interval = handle.getValueState("interval", _INTERVAL)
        self.assets = handle.getValueState("assets", _ASSETS)
        self.scores = handle.getMapState("scores", "low BIGINT", _BLOCK)
        self.totals = handle.getValueState("modes", _MODES)

    def load(self, fresh: SessionEstimator, clock) -> SessionEstimator:
        """``fresh`` as it was when the last rows of the session had been folded in; ``clock`` is the stored one, or None."""
        belief = self.belief.get() if clock is not None else None
        if belief is None:
            return fresh
        fresh.first, fresh.clock, fresh.reference = clock[:3]
        names, mean, lower = belief
        n = len(mean)
        fresh.a = np.array(mean, float)
        fresh.P = np.zeros((n, n))
        fresh.P[np.tril_indices(n)] = lower
        fresh.P = fresh.P + np.tril(fresh.P, -1).T
        for i, name in enumerate(names):
            kind, _, rest = name.partition("/")
            if kind == "mode":
                fresh.modes[None if rest == "" else rest[1:]] = i
            elif kind == "level":
                fresh.levels[int(rest)] = i
            elif kind == "run":
                asset, run = rest.split("/")
                fresh.runs[int(asset), int(run)] = i
        for asset, run, age, seen, runs in zip(*self.assets.get()):
            fresh.open_run[asset], fresh.age[asset], fresh.seen[asset], fresh.n_runs[asset] = run, age, seen, runs
        rate, seen, missed = self.interval.get()
        fresh.interval |= {"rate": rate, "seen": seen, "missed": missed}
        fresh.interval["past"] = type(fresh.interval["past"])(fresh.interval["past"].grid, [(k[0], list(v[0]), list(v[1])) for k, v in self.scores.iterator()])
        return fresh

    def save(self, estimator: SessionEstimator, last_ms: int, accepted: int, rejected: int) -> None:
        self.clock.update((estimator.first, estimator.clock, estimator.reference, last_ms, accepted, rejected))
        names = ["shared"] * len(estimator.a)
        for mode, i in estimator.modes.items():
            names[i] = "mode/" if mode is None else f"mode/={mode}"
        for asset, i in estimator.levels.items():
            names[i], names[i + 1] = f"level/{asset}", f"rate/{asset}"
        for (asset, run), i in estimator.runs.items():
            names[i] = f"run/{asset}/{run}"
        self.belief.update((names, estimator.a.tolist(), estimator.P[np.tril_indices(len(estimator.a))].tolist()))
        ran = list(estimator.open_run)
        self.assets.update((ran, [estimator.open_run[a] for a in ran], [float(estimator.age[a]) for a in ran], [estimator.seen[a] for a in ran], [estimator.n_runs[a] for a in ran]))
        self.interval.update((float(estimator.interval["rate"]), estimator.interval["seen"], estimator.interval["missed"]))
        past = estimator.interval["past"]
        for low, keys, counts in past.blocks(only_changed=True):
            self.scores.updateValue((low,), (keys, counts))
        past.changed.clear()

    def clear(self) -> None:
        for state in (self.declared, self.clock, self.belief, self.interval, self.assets, self.scores, self.totals):
            state.clear()


FRAME = f"{OUTPUT}, type string, total_laps long, rejected long, assets long, modes string, took_ms double"
_FRAMES = [c.split()[0] for c in FRAME.split(", ")]
_OBJECTS = [c.split()[0] for c in FRAME.split(", ") if c.endswith((" string", " long"))]


def _framed(rows: dict[str, list]) -> pd.DataFrame:
    """All columns of frames, of which ``rows`` has some; texts and whole numbers as plain objects, for pandas makes numbers beside a null inexact."""
    empty = [None] * len(next(iter(rows.values())))
    return pd.DataFrame({c: pd.Series(rows.get(c, empty), dtype=object) if c in _OBJECTS else rows.get(c, empty) for c in _FRAMES})


def _stamped(rows) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True)


def _states_processor(hyper, priors, max_runs):
    """Laps in, filtered states out; the session stays in the store for ever."""
    from pyspark.sql.streaming import StatefulProcessor

    class Estimate(StatefulProcessor):
        def init(self, handle) -> None:
            self.store = SessionStore(handle)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            clock = self.store.clock.get()
            estimator = self.store.load(SessionEstimator(hyper, priors, max_runs=max_runs), clock)
            before = clock or (None, None, None, 0, 0, 0)
            out = _fold(estimator, _stamped(rows))
            good = int(out["reason"].isna().sum())
            yield out
            self.store.save(estimator, 0, before[4] + good, before[5] + len(out) - good)

        def close(self) -> None:
            pass

    return Estimate()


def _frames_processor(hyper, priors, max_runs, idle_ms):
    """Start, lap, rejected and complete frames; a session ends when event time has passed its last lap by ``idle_ms``, and leaves no state behind."""
    from pyspark.sql.streaming import StatefulProcessor

    class Monitor(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle, self.store = handle, SessionStore(handle)

        def handleInitialState(self, key, initialState, timerValues) -> None:
            self.store.declared.update(([int(a) for a in initialState["assets"].iloc[0]], [str(m) for m in initialState["modes"].iloc[0]]))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            laps = _stamped(rows)
            laps = laps[laps["seq"].notna()]
            if laps.empty:
                return
            # a row without an asset is nobody's lap: no declared asset is called -1
            laps = laps.assign(**{c: laps[c].fillna(-1).astype(np.int64) for c in ("seq", "asset", "run_id") if laps[c].dtype != np.int64})
            assets, modes = self.store.declared.get() or ((), ())
            clock = self.store.clock.get()
            estimator = self.store.load(SessionEstimator(hyper, priors, max_runs=max_runs, declared=(assets, modes)), clock)
            _, _, _, before_ms, accepted, rejected = clock or (None, None, None, 0, 0, 0)
            out = _fold_columns(estimator, laps)
            n, good = len(out["reason"]), out["reason"].count(None)
            out["type"] = ["rejected" if reason else "lap" for reason in out["reason"]]
            if clock is None:
                start = {"session_id": key[0], "type": "start", "seq": int(laps["seq"].min()), "assets": len(assets), "modes": ",".join(sorted(modes))}
                out = {c: [start.get(c), *out.get(c, [None] * n)] for c in _FRAMES}
            yield _framed(out)
            last_ms = max(before_ms, int(laps["at_ms"].max()))
            if good:
                known = dict(zip(*(self.store.totals.get() or ((), ()))))
                for kind, mode in zip(out["type"], out["mode"]):
                    if kind == "lap" and mode is not None:
                        known[mode] = known.get(mode, 0) + 1
                self.store.totals.update((list(known), list(known.values())))
                self.store.save(estimator, last_ms, accepted + good, rejected + n - good)
            else:
                self.store.clock.update((estimator.first, estimator.clock, estimator.reference, last_ms, accepted, rejected + n))
            # a session that has a clock has one timer
            if clock is None or last_ms != before_ms:
                if clock is not None:
                    self.handle.deleteTimer(before_ms + idle_ms)
                self.handle.registerTimer(last_ms + idle_ms)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            _, clock, _, _, accepted, rejected = self.store.clock.get()
            ran, modes = self.store.assets.get() or ((),), self.store.totals.get() or ((),)
            yield self._frame(key, type="complete", seq=clock, total_laps=accepted, rejected=rejected, assets=len(ran[0]), modes=",".join(sorted(modes[0])))
            self.store.clear()

        def _frame(self, key, **facts) -> pd.DataFrame:
            return _framed({c: [v] for c, v in {"session_id": key[0], **facts}.items()})

        def close(self) -> None:
            pass

    return Monitor()


def live_states(stream: DataFrame, hyper: Hyper | None = None, priors: Priors | None = None, event_time=None, lateness="1 hour",
                max_runs=None) -> DataFrame:
    """Streaming form: filtered states per lap, the session kept in typed state variables (see ``SessionStore``).

    Rows of a micro-batch are put in (seq, asset) order; a row older than the
    session clock comes out with its ``reason`` instead of failing the query.
    ``event_time`` names a timestamp column used to drop repeated
    (session, asset, seq) rows within ``lateness``. Needs the RocksDB state store.
    """
    hyper, priors = hyper or Hyper(), priors or Priors()
    if event_time:
        stream = stream.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(["session_id", "asset", "seq"])
    return stream.select(*_LAP).groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=_states_processor(hyper, priors, max_runs), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )


def live_frames(stream: DataFrame, declared: DataFrame, event_time: str, lateness="1 hour", idle_ms=1_800_000, hyper: Hyper | None = None,
                priors: Priors | None = None, max_runs=None) -> DataFrame:
    """The feed of every session: one start frame, a lap or rejected frame per row, and one complete frame with the totals.

    ``declared`` (session_id, assets, modes; a batch table with one row per session) seeds the state: rows of assets and modes it does not name come out rejected
    with a reason, like rows without a time, rows behind the session clock and runs beyond ``max_runs``. Event time ends a session: when the watermark is
    ``idle_ms`` past its last row, the complete frame is sent and the state is removed. Rows with a null ``seq`` only move the clock forward. Rows
    later than ``lateness`` are dropped by the watermark. Needs the RocksDB state store.
    """
    hyper, priors = hyper or Hyper(), priors or Priors()
    rows = stream.withWatermark(event_time, lateness).select(*_LAP, event_time, F.unix_millis(event_time).alias("at_ms"))
    return rows.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=_frames_processor(hyper, priors, max_runs, idle_ms), outputStructType=FRAME, outputMode="Append", timeMode="EventTime",
        initialState=declared.select("session_id", "assets", "modes").groupBy("session_id"),
    )


def store_batches(laps: DataFrame, batch: str, folder: str, files=4) -> int:
    """Writes the rows of every value of ``batch`` as ``files`` files each, in its order; a replay of that many files a trigger reads one value a trigger.

    Rows are dealt out evenly, so no file holds a session's whole batch. Returns ``files``.
    """
    for value in sorted(r[0] for r in laps.select(batch).distinct().collect()):
        one = laps.where(F.col(batch) == value)
        one.repartition(files).write.mode("append").parquet(folder)
    return files


def replay(spark: SparkSession, path: str, schema, max_files=1) -> DataFrame:
    """Stored laps as a stream, a few files per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def latest_states(states: DataFrame) -> DataFrame:
    """Last state of every asset, with its health."""
    packed = F.struct("seq", "mode", "age", "level", "level_sd", "rate", "rate_sd", "laps_observed", "coverage")
    last = states.where("reason IS NULL").groupBy("session_id", "asset").agg(F.max_by(packed, "seq").alias("_s"))
    return last.select("session_id", "asset", "_s.*").withColumn("health", health())


def live_feed(states: DataFrame) -> DataFrame:
    """Start, lap and complete frames per session as (session_id, seq, type, payload JSON)."""
    good = states.where("reason IS NULL").withColumn("health", health())
    lap = good.select(
        "session_id", F.col("seq"), F.col("asset"), F.lit("lap").alias("type"),
        narrate.payload(good, "asset", "seq", "mode", "age", "level", "level_sd", "rate", "rate_sd", "forecast", "low", "high", "covered", "coverage", "health").alias("payload"),
    )
    ends = good.groupBy("session_id").agg(
        F.min("seq").alias("first"), F.max("seq").alias("last"), F.count(F.lit(1)).alias("total_laps"), F.count_distinct("asset").alias("assets"),
        F.array_sort(F.collect_set("mode")).alias("modes"),
    )
    start = ends.select("session_id", F.col("first").alias("seq"), F.lit(-1).cast("long").alias("asset"), F.lit("start").alias("type"),
                        F.to_json(F.struct("total_laps", "assets", "modes")).alias("payload"))
    complete = ends.select("session_id", F.col("last").alias("seq"), F.lit(None).cast("long").alias("asset"), F.lit("complete").alias("type"),
                           F.to_json(F.struct("total_laps", "assets")).alias("payload"))
    return start.unionByName(lap).unionByName(complete)


def with_update_times(frames: DataFrame) -> DataFrame:
    """The same frames, with the number of laps of every micro-batch and how long their updates took observed on the way (see ``BatchTimes``)."""
    took = F.when(F.col("type") == "lap", F.col("took_ms"))
    return frames.observe("updates", F.count(took).alias("laps"), F.avg(took).alias("mean_ms"), F.percentile_approx(took, 0.95, 10_000).alias("p95_ms"), F.max(took).alias("max_ms"))


BATCHES = "query string, batch long, n_rows long, trigger_ms long, laps long, mean_ms double, p95_ms double, max_ms double"


class BatchTimes(StreamingQueryListener):
    """One row per finished micro-batch of the queries it hears of: rows, trigger time, and the observed update times."""

    def __init__(self):
        self.rows: list[tuple] = []

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        seen = p.observedMetrics.get("updates")
        times = (seen.laps, seen.mean_ms, seen.p95_ms, seen.max_ms) if seen is not None else (0, None, None, None)
        self.rows.append((str(p.id), p.batchId, p.numInputRows, p.durationMs.get("triggerExecution"), *times))

    def save(self, spark: SparkSession, path: str) -> None:
        """Appends what has been heard so far to the table at ``path``; the list starts anew."""
        done, self.rows = self.rows, []
        spark.createDataFrame(done, BATCHES).coalesce(1).write.mode("append").parquet(path)


def run_and_time(frames: DataFrame, out: str, progress: str, times: str) -> None:
    """Runs a stream of stored laps to its end, writing frames to ``out`` and one row per micro-batch to the table ``times``."""
    spark = frames.sparkSession
    listener = BatchTimes()
    spark.streams.addListener(listener)
    try:
        query = (with_update_times(frames).writeStream.format("parquet").option("path", out).option("checkpointLocation", progress)
                 .outputMode("append").trigger(availableNow=True).start())
        query.awaitTermination()
        last, waited = query.lastProgress, 0
        # progress events reach the listener a little later
        while last is not None and waited < 100 and not any(r[1] >= last["batchId"] for r in listener.rows):
            time.sleep(0.1)
            waited += 1
        listener.save(spark, times)
    finally:
        spark.streams.removeListener(listener)


def stream_metrics(progress) -> dict:
    """Latency of finished micro-batches: mean, 95th percentile and maximum milliseconds, rows per second.

    ``progress`` is a query's ``recentProgress``.
    """
    took = [p["durationMs"]["triggerExecution"] for p in progress if p["numInputRows"]]
    rows = sum(p["numInputRows"] for p in progress)
    if not took:
        return {"batches": 0, "rows": 0}
    return {
        "batches": len(took), "rows": rows, "mean_ms": float(np.mean(took)), "p95_ms": float(np.percentile(took, 95)), "max_ms": float(max(took)),
        "rows_per_second": 1000.0 * rows / sum(took),
    }
