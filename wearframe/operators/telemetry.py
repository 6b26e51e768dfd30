"""Loads and energy from position and speed samples.

Input: session_id, asset, lap, i (1-based sample number in time order),
n_samples, t (s), speed_kmh, x, y (tenths of a metre). Derivatives look a few
samples to each side, so laps are cut into overlapping blocks of samples and no
window ever holds more than a block.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wearframe.functions import vehicle as ve
from wearframe.operators import slices
from wearframe.operators.staging import spread

LAP = ("session_id", "asset", "lap")
_REACH = 8


def trim(df: DataFrame, edge: int, min_n: int) -> DataFrame:
    """Samples at least ``edge`` away from both ends of laps with ``min_n`` samples or more."""
    return df.where((F.col("n_samples") >= min_n) & (F.col("i") > edge) & (F.col("i") <= F.col("n_samples") - edge))


def _gradient(value: str, w, first, last):
    """Central difference over the sample number, one-sided at the lap's ends."""
    ahead, back = F.lead(value).over(w), F.lag(value).over(w)
    here = F.col(value)
    return F.when(first, ahead - here).when(last, here - back).otherwise((ahead - back) / 2)


def nudged(samples: DataFrame, width=4096) -> DataFrame:
    """Adds ``_t``: stamps that never fall back, for differentiation.

    A lap with a stamp not above the one before gets a nanosecond more per sample, and then the largest stamp so far; other laps keep theirs.
    """
    keys = list(LAP)
    cut = samples.withColumn("_slice", F.floor((F.col("i") - 1) / width).cast("long"))
    late = F.col("t") + (F.col("i") - 1) * 1e-9
    ahead = slices.running_max(cut, keys, "_slice", "i", {"_top": F.col("t"), "_late": late})
    # stamps rise everywhere exactly if the largest so far is new at every sample
    flat = ahead.groupBy(*keys).agg((F.count_distinct("_top") < F.count(F.lit(1))).alias("_flat"))
    return ahead.join(flat, keys).withColumn("_t", F.when(F.col("_flat"), F.col("_late")).otherwise(F.col("t"))).drop("_slice", "_top", "_late", "_flat")


def dynamics(samples: DataFrame, vehicle: ve.Vehicle | None = None, width=4096) -> DataFrame:
    """Curvature, accelerations, corner loads and frictional power per sample."""
    v = vehicle or ve.Vehicle()
    keys = list(LAP)
    w = Window.partitionBy(*keys, "_block").orderBy("i")
    seven = w.rowsBetween(-3, 3)
    first, last = F.col("i") == 1, F.col("i") == F.col("n_samples")
    b = slices.halo(nudged(samples, width), keys, "i", _REACH, width)
    b = b.withColumn("speed", F.col("speed_kmh") / 3.6)
    # moving average with zero padding at the ends: always divided by seven
    b = b.withColumn("_xs", F.sum(F.col("x") / 10.0).over(seven) / 7).withColumn("_ys", F.sum(F.col("y") / 10.0).over(seven) / 7)
    b = b.withColumn("_dx", _gradient("_xs", w, first, last)).withColumn("_dy", _gradient("_ys", w, first, last))
    b = b.withColumn("_ddx", _gradient("_dx", w, first, last)).withColumn("_ddy", _gradient("_dy", w, first, last))
    speed2 = F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")
    kappa = F.when(speed2 > 0, (F.col("_dx") * F.col("_ddy") - F.col("_dy") * F.col("_ddx")) / F.pow(speed2, F.lit(1.5)))
    b = b.withColumn("curvature", F.when(F.col("n_samples") >= 9, F.coalesce(kappa, F.lit(0.0))).otherwise(0.0))
    limit = ve.MAX_LATERAL_G * ve.G
    lateral = F.when(F.col("speed") < ve.MIN_SPEED, 0.0).otherwise(F.col("speed") * F.col("speed") * F.col("curvature"))
    b = b.withColumn("a_lat", F.greatest(F.lit(-limit), F.least(F.lit(limit), lateral)))
    hl, hr = F.col("_t") - F.lag("_t").over(w), F.lead("_t").over(w) - F.col("_t")
    fl, f0, fr = F.lag("speed").over(w), F.col("speed"), F.lead("speed").over(w)
    inner = F.try_divide(hl * hl * fr + (hr * hr - hl * hl) * f0 - hr * hr * fl, hl * hr * (hl + hr))
    b = b.withColumn(
        "a_long", F.when(F.col("n_samples") < 2, 0.0).when(first, F.try_divide(fr - f0, hr)).when(last, F.try_divide(f0 - fl, hl)).otherwise(inner)
    ).withColumn("dt", _gradient("t", w, first, last))
    loads = ve.corner_loads(F.col("speed"), F.col("a_long"), F.col("a_lat"), v)
    for c, load in loads.items():
        b = b.withColumn(f"load_{c}", load)
    for c in ve.CORNERS:
        b = b.withColumn(f"power_{c}", ve.frictional_power(F.col(f"load_{c}"), F.col("speed"), F.col("a_long"), F.col("a_lat")))
    b = b.withColumn("power", sum((F.col(f"power_{c}") for c in ve.CORNERS[1:]), F.col("power_FL")))
    step = F.col("t") - F.lag("t").over(w)
    for c in (*ve.CORNERS, ""):
        name = f"power_{c}" if c else "power"
        b = b.withColumn(f"work_{c}" if c else "work", (F.col(name) + F.lag(name).over(w)) / 2 * step)
    kept = [c for c in samples.columns if c not in keys]
    return b.where("_core").select(
        *keys, *kept, "speed", "curvature", "a_lat", "a_long", "dt", *[f"load_{c}" for c in ve.CORNERS],
        *[f"power_{c}" for c in ve.CORNERS], "power", *[f"work_{c}" for c in ve.CORNERS], "work",
    )


def _inside(edge):
    return (F.col("i") > edge) & (F.col("i") <= F.col("n_samples") - edge)


def _trapezoid(name, edge):
    """Integral between the trimmed ends: steps whose both samples are kept."""
    return F.sum(F.when(_inside(edge) & (F.col("i") > edge + 1), F.col(name)))


def lap_energy(dyn: DataFrame, edge=4, min_n=12) -> DataFrame:
    """Per lap: energy per corner (MJ-equivalent), shares, peaks, mean speed, distance."""
    agg = dyn.where(F.col("n_samples") >= min_n).groupBy(*LAP).agg(
        *[(_trapezoid(f"work_{c}", edge) / 1e6).alias(f"energy_{c}") for c in ve.CORNERS],
        (F.max(F.when(_inside(edge), F.abs("a_lat"))) / ve.G).alias("peak_lateral_g"),
        (F.abs(F.min(F.when(_inside(edge), F.col("a_long")))) / ve.G).alias("peak_longitudinal_g"),
        F.avg("speed_kmh").alias("mean_speed_kmh"), F.sum(F.col("speed") * F.col("dt")).alias("distance_m"),
        F.count(F.lit(1)).alias("n_samples"),
    )
    e = {c: F.col(f"energy_{c}") for c in ve.CORNERS}
    total = e["FL"] + e["FR"] + e["RL"] + e["RR"]
    share = lambda a, b: F.when(F.col("energy") != 0, F.try_divide(e[a] + e[b], "energy"))
    return agg.withColumn("energy", total).withColumn("front_share", share("FL", "FR")).withColumn("left_share", share("FL", "RL"))


def asymmetry(dyn: DataFrame, edge=6, min_n=50) -> DataFrame:
    """Per lap: left and front energy shares, share of cornering done to the left, net rotation."""
    turn = F.abs("a_lat") * F.col("speed")
    inside = _inside(edge)
    agg = dyn.where(F.col("n_samples") >= min_n).groupBy(*LAP).agg(
        *[_trapezoid(f"work_{c}", edge).alias(f"_{c}") for c in ve.CORNERS],
        F.sum(F.when(inside, F.col("curvature"))).alias("net_rotation"),
        F.sum(F.when(inside & (F.col("a_lat") > 0), turn).otherwise(0.0)).alias("_left"),
        F.sum(F.when(inside & (F.col("a_lat") < 0), turn).otherwise(0.0)).alias("_right"),
        (F.max(F.when(inside, F.abs("a_lat"))) / ve.G).alias("peak_lateral_g"),
    )
    total = F.col("_FL") + F.col("_FR") + F.col("_RL") + F.col("_RR")
    turning = F.col("_left") + F.col("_right")
    return agg.withColumn("_total", total).where("_total > 0").select(
        *LAP, ((F.col("_FL") + F.col("_RL")) / F.col("_total")).alias("left_share"),
        ((F.col("_FL") + F.col("_FR")) / F.col("_total")).alias("front_share"),
        F.when(turning > 0, F.col("_left") / turning).alias("left_turn_share"), "net_rotation", "peak_lateral_g",
    )


def circuit_asymmetry(laps: DataFrame, min_laps=3, by=("session_id",)) -> DataFrame:
    """Direction of each circuit from the average left-side share of its sampled laps."""
    rotation = slices.exact_median(laps, list(by), "net_rotation", "net_rotation")
    agg = laps.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_laps"), F.avg("left_share").alias("left_share"), F.avg("front_share").alias("front_share"),
        F.avg("left_turn_share").alias("left_turn_share"), F.avg("peak_lateral_g").alias("peak_lateral_g"),
    ).where(F.col("n_laps") >= min_laps)
    return agg.join(rotation, list(by)).withColumn(
        "direction", F.when(F.col("left_share") > 0.5, "clockwise").otherwise("anti-clockwise")
    )


def circuit_geometry(corners: DataFrame, by=("circuit",), order="number", tight=90.0) -> DataFrame:
    """Corner count, tight corners, mean turn and median spacing. A circuit has a few dozen corners."""
    w = Window.partitionBy(*by).orderBy(order)
    gap = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    rows = corners.withColumn("_turn", ve.turn_magnitude(F.col("angle"))).withColumn("_gap", gap)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_corners"), F.count_if(F.col("_turn") >= tight).alias("n_tight"),
        F.avg("_turn").alias("mean_turn"), F.median("_gap").alias("median_spacing"),
    )


def circuit_energetics(dyn: DataFrame, by=("session_id",), loaded_g=3.0) -> DataFrame:
    """Mean and 95th-percentile lateral g, share of loaded samples, mean lateral power, top speed."""
    rows = dyn.withColumn("_g", F.abs("a_lat") / ve.G)
    high = slices.exact_percentiles(rows, list(by), "_g", {"p95_lateral_g": 0.95}).drop("n_values")
    return rows.groupBy(*by).agg(
        F.avg("_g").alias("mean_lateral_g"), F.avg((F.col("_g") >= loaded_g).cast("double")).alias("loaded_fraction"),
        F.avg(F.col("speed") * F.abs("a_lat")).alias("lateral_power"), F.max("speed_kmh").alias("top_speed_kmh"),
    ).join(high, list(by))


def track_features(dyn: DataFrame, lap_times: DataFrame, corners: DataFrame) -> DataFrame:
    """Geometry and energetics of each session's fastest lap."""
    best = lap_times.groupBy("session_id").agg(F.min_by(F.struct("asset", "lap"), F.struct("perf", "asset", "lap")).alias("_b")).select(
        "session_id", "_b.asset", "_b.lap"
    )
    fast = dyn.join(best, list(LAP), "left_semi")
    length = fast.groupBy("session_id").agg(F.sum(F.col("speed") * F.col("dt")).alias("lap_length_m"))
    return circuit_energetics(fast).join(length, "session_id").join(circuit_geometry(corners, ("session_id",)), "session_id", "left")


def load_sections(dyn: DataFrame, threshold=0.45, top=None, width=4096) -> DataFrame:
    """Contiguous samples at or above the threshold of normalised load, with their share of the lap."""
    keys = list(LAP)
    peak = dyn.groupBy(*keys).agg(F.max("power").alias("_peak"))
    rows = dyn.join(peak, keys).withColumn("tyre_load", F.col("power") / F.greatest("_peak", F.lit(1e-9))).withColumn(
        "_slice", F.floor(F.col("i") / width).cast("long")
    )
    total = rows.groupBy(*keys).agg(F.sum("tyre_load").alias("_total"))
    low = F.when(F.col("tyre_load") >= threshold, 0).otherwise(1)
    marked = slices.running(rows, keys, "_slice", ["i"], {"_section": low}).where(F.col("tyre_load") >= threshold)
    out = marked.groupBy(*keys, "_section").agg(
        F.min("i").alias("start"), F.max("i").alias("end"), F.max("tyre_load").alias("peak"), F.sum("tyre_load").alias("load")
    ).join(total, keys).withColumn("share", F.col("load") / F.coalesce(F.nullif("_total", F.lit(0.0)), F.lit(1.0))).drop("_section", "_total")
    if top:
        w = Window.partitionBy(*keys).orderBy(F.desc("load"), "start")
        out = out.withColumn("position", F.row_number().over(w)).where(F.col("position") <= top)
    return out


def friction_limit(dyn: DataFrame, by=("session_id",)) -> DataFrame:
    """Plot limit of combined g: the 99.5% order statistic rounded up, plus a half."""
    rows = dyn.withColumn("_g", F.hypot("a_lat", "a_long") / ve.G)
    stat = slices.order_statistics(rows, list(by), "_g", lambda n: F.array(F.floor(n * F.lit(0.995)).cast("long") + 1))
    return stat.select(*by, (F.ceil("value") + 0.5).alias("limit"))


def track_line(dyn: DataFrame, points=420, edge=8, min_n=100) -> DataFrame:
    """Resampled line of each lap given: arrays of position, speed, g and normalised load, with its peaks.

    Meant for chosen laps, such as the fastest: a lap's samples become arrays.
    """
    keys = list(LAP)
    rows = trim(dyn, edge, min_n)
    cols = {"x": "x", "y": "y", "speed_kmh": "speed_kmh", "lateral": "a_lat", "longitudinal": "a_long", "power": "power"}
    packed = F.array_sort(F.collect_list(F.struct("i", *[F.col(s).cast("double").alias(n) for n, s in cols.items()])))
    laps = rows.groupBy(*keys).agg(
        packed.alias("_s"), F.max("power").alias("_peak"),
        (F.percentile(F.abs("a_lat"), F.lit(0.99)) / ve.G).alias("peak_lateral_g"),
        (F.percentile(F.abs(F.least("a_long", F.lit(0.0))), F.lit(0.99)) / ve.G).alias("peak_braking_g"),
        F.sum(F.col("speed") * F.col("dt")).alias("track_length_m"),
    )

    def line(name, scale, digits):
        return F.transform(ve.resample(F.col(f"_s.{name}"), points), lambda q: F.round(q * scale, digits)).alias(name)

    return laps.select(
        *keys, line("x", F.lit(0.1), 2), line("y", F.lit(0.1), 2), line("speed_kmh", F.lit(1.0), 1),
        line("lateral", F.lit(1 / ve.G), 3), line("longitudinal", F.lit(1 / ve.G), 3), line("power", 1 / F.greatest("_peak", F.lit(1e-9)), 3),
        "peak_lateral_g", "peak_braking_g", "track_length_m",
    )


# ---- heat and wear ---------------------------------------------------------------


class Thermal:
    """Two heat stores of a tyre; fixed default values."""

    surface_capacity = 12_000.0
    bulk_capacity = 48_000.0
    surface_to_bulk = 55.0
    convection_per_speed = 2.4
    conduction_to_track = 30.0
    bulk_convection = 8.0
    ambient = 25.0
    track = 35.0
    low, high = 90.0, 110.0

    def step(self, s, b, power, speed, dt):
        ds = (power - self.surface_to_bulk * (s - b) - self.convection_per_speed * np.maximum(speed, 0.0) * (s - self.ambient)
              - self.conduction_to_track * (s - self.track)) / self.surface_capacity
        db = (self.surface_to_bulk * (s - b) - self.bulk_convection * (b - self.ambient)) / self.bulk_capacity
        return s + ds * dt, b + db * dt


_EXPOSURE = (
    "session_id long, asset long, lap long, n long, start_bulk double, peak_surface double, mean_surface double, mean_bulk double, "
    "in_window double, stress double, wear double, last_bulk double"
)
#: Samples of whole laps that are stepped together.
TOGETHER = 200_000


def _whole_laps(frames, keys):
    """Frames of about TOGETHER rows that end between laps; rows come sorted by lap and sample."""
    held, rows = [], 0
    for pdf in frames:
        held.append(pdf)
        rows += len(pdf)
        if rows >= TOGETHER:
            both = pd.concat(held, ignore_index=True)
            last = (both[keys] == both[keys].iloc[-1]).all(axis=1)
            cut = int((~last).sum())
            if cut:
                yield both.iloc[:cut]
                both = both.iloc[cut:]
            held, rows = [both], len(both)
    if rows:
        yield pd.concat(held, ignore_index=True)


class _Laps:
    """Whole laps side by side: step k of all laps that have one is a vector; longest laps first."""

    def __init__(self, pdf, keys):
        pdf = pdf.reset_index(drop=True)
        change = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy()
        first = np.flatnonzero(change)
        size = np.diff(np.append(first, len(pdf)))
        order = np.argsort(-size, kind="stable")
        self.first, self.size = first[order], size[order]
        self.keys = pdf.loc[self.first, keys].reset_index(drop=True)
        self.at = lambda name: pdf.loc[self.first, name].to_numpy(float)
        self.column = {c: pdf[c].to_numpy(float) for c in ("t", "power", "speed", "factor")}
        if not (np.diff(pdf["i"].to_numpy(float))[~change[1:]] > 0).all():
            raise ValueError("samples are not in order")

    def steps(self):
        """(laps with a k-th sample, k, that sample's columns and the time since the one before)."""
        for k in range(int(self.size[0])):
            m = int(np.searchsorted(-self.size, -k, side="left"))
            rows = self.first[:m] + k
            now = {c: v[rows] for c, v in self.column.items()}
            yield m, k, now, (now["t"] - self.column["t"][rows - 1] if k else None)


def thermal_features(dyn: DataFrame, stint=("session_id", "asset"), model: Thermal | None = None, edge=4, min_n=12) -> DataFrame:
    """Heat exposure of every lap, the carcass starting each lap at the previous lap's mean.

    The mean carcass temperature of a lap depends on its start only through a
    straight line, so laps are walked twice in parallel (once from 0 and 1 to
    find that line, once for real) and the carry along a stint is a fold over
    one (slope, offset) pair per lap. A walk steps all laps of a batch together.
    """
    model = model or Thermal()
    keys = list(LAP)
    rows = dyn.where(F.col("n_samples") >= min_n).select(
        *keys, "i", "n_samples", "t", "speed", "power", ve.mode_factor(F.col("mode") if "mode" in dyn.columns else F.lit("")).alias("factor")
    )
    held = (model.low + model.high) / 2

    def line(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_laps(frames, keys):
            laps = _Laps(pdf, keys)
            n = len(laps.size)
            s, b = np.full((2, n), held), np.repeat([[0.0], [1.0]], n, axis=1)
            total = np.zeros((2, n))
            for m, k, now, gap in laps.steps():
                if k:
                    s[:, :m], b[:, :m] = model.step(s[:, :m], b[:, :m], now["power"], now["speed"], np.clip(gap, 0.0, 0.5))
                total[:, :m] += b[:, :m]
            mean = total / laps.size
            yield laps.keys.assign(offset=mean[0], slope=mean[1] - mean[0])

    ordered = spread(rows, *keys).sortWithinPartitions(*keys, "i")
    lines = ordered.mapInPandas(line, "session_id long, asset long, lap long, offset double, slope double")
    first = held - 8.0
    # laps of one stint: tens of rows
    chain = lines.groupBy(*stint).agg(F.array_sort(F.collect_list(F.struct("lap", "offset", "slope"))).alias("_l"))
    walked = F.aggregate(
        "_l",
        F.struct(F.lit(first).alias("at"), F.array().cast("array<struct<lap:bigint,start:double>>").alias("out")),
        lambda acc, x: F.struct(
            (x["offset"] + x["slope"] * acc["at"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct(x["lap"].alias("lap"), acc["at"].alias("start")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    starts = chain.select(*stint, F.explode(walked).alias("_s")).select(*stint, "_s.lap", F.col("_s.start").alias("start_bulk"))

    def expose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_laps(frames, keys):
            laps = _Laps(pdf, keys)
            n = len(laps.size)
            start, expected = laps.at("start_bulk"), laps.at("n_samples")
            s, b, rate = np.full(n, held), start.copy(), np.zeros(n)
            peak, sum_s, sum_b, inside, stress, wear = np.full(n, -np.inf), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
            for m, k, now, gap in laps.steps():
                if k:
                    s[:m], b[:m] = model.step(s[:m], b[:m], now["power"], now["speed"], np.clip(gap, 0.0, 0.5))
                out = np.maximum(0.0, np.maximum(model.low - s[:m], s[:m] - model.high))
                peak[:m] = np.maximum(peak[:m], s[:m])
                sum_s[:m] += s[:m]
                sum_b[:m] += b[:m]
                inside[:m] += out == 0.0
                stress[:m] += out * out
                fresh = 1e-8 * now["factor"] * (1 + 0.025 * out * out) * np.maximum(now["power"], 0.0)
                if k > edge:
                    wear[:m] += np.where(k + 1 <= expected[:m] - edge, (fresh + rate[:m]) / 2 * gap, 0.0)
                rate[:m] = fresh
            yield laps.keys.assign(
                n=laps.size, start_bulk=start, peak_surface=peak, mean_surface=sum_s / laps.size, mean_bulk=sum_b / laps.size,
                in_window=inside / laps.size, stress=stress / laps.size, wear=wear, last_bulk=b,
            )

    seeded = spread(rows.join(starts, keys), *keys).sortWithinPartitions(*keys, "i")
    out = seeded.mapInPandas(expose, _EXPOSURE)
    mean = F.col("mean_surface")
    return out.withColumn(
        "regime",
        F.when(mean < model.low - 12, "underheated").when(mean < model.low, "below window").when(mean > model.high + 12, "overheating")
        .when(mean > model.high, "above window").otherwise("in window"),
    )


def lap_wear(dyn: DataFrame, thermal: DataFrame) -> DataFrame:
    """Energy, wear and heat of every lap in one row."""
    return lap_energy(dyn).join(thermal.drop("n"), list(LAP))


def energy_clock(wear: DataFrame, stint=("session_id", "asset"), energy="energy") -> DataFrame:
    """Running energy in units of the stint's average lap; the lap count where the average is not positive.

    A stint has tens of laps.
    """
    w = Window.partitionBy(*stint)
    mean = F.avg(energy).over(w)
    upto = w.orderBy("lap").rowsBetween(Window.unboundedPreceding, 0)
    return wear.withColumn("_mean", mean).withColumn(
        "clock", F.when(F.col("_mean") > 0, F.sum(F.try_divide(energy, "_mean")).over(upto)).otherwise(F.row_number().over(w.orderBy("lap")))
    ).drop("_mean")


def clock_test(rows: DataFrame, stint=("session_id", "asset"), min_laps=4) -> DataFrame:
    """Does perf follow energy better than age? Slope and R2 on both clocks per stint.

    rows: stint, corrected, age, clock, energy, and optionally regime.
    """
    out = rows.groupBy(*stint).agg(
        F.count(F.lit(1)).alias("n_laps"),
        F.regr_slope("corrected", "age").alias("_as"), F.regr_r2("corrected", "age").alias("_ar"),
        F.regr_slope("corrected", "clock").alias("_es"), F.regr_r2("corrected", "clock").alias("_er"),
        F.avg("energy").alias("mean_energy"), (F.stddev_pop("energy") / F.greatest(F.avg("energy"), F.lit(1e-9))).alias("energy_cv"),
    )
    ok = F.col("n_laps") >= min_laps
    out = out.select(
        *stint, "n_laps", F.when(ok, F.col("_as")).alias("age_slope"), F.when(ok, F.col("_ar")).alias("age_r2"),
        F.when(ok, F.col("_es")).alias("energy_slope"), F.when(ok, F.col("_er")).alias("energy_r2"), "mean_energy", "energy_cv",
    ).withColumn("r2_gain", F.col("energy_r2") - F.col("age_r2"))
    if "regime" in rows.columns:
        counts = rows.groupBy(*stint, "regime").agg(F.count(F.lit(1)).alias("n")).groupBy(*stint).agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("regime", "n")))).alias("regimes")
        )
        out = out.join(counts, list(stint), "left")
    return out


def clock_verdict(tests: DataFrame) -> DataFrame:
    """Overall gain of the energy clock and what it amounts to."""
    return tests.agg(
        F.count("r2_gain").alias("n_stints"), F.count_if(F.col("r2_gain") > 0).alias("energy_wins"),
        F.avg("r2_gain").alias("mean_r2_gain"), F.avg("energy_cv").alias("mean_energy_cv"),
    ).withColumn(
        "verdict",
        F.when(F.col("mean_r2_gain") > 0.01, "energy clock is better").when(F.col("mean_r2_gain") > -0.01, "no meaningful difference")
        .otherwise("lap count is better"),
    )
