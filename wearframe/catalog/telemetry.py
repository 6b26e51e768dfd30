"""Queries over telemetry: loads, energy, geometry, heat, wear."""

from pyspark.sql import functions as F

from wearframe.catalog.shared import TELEMETRY, r6, rounded_all, sql
from wearframe.functions import vehicle as ve
from wearframe.operators import telemetry as te
from wearframe.operators.staging import stage
from wearframe.sources import adapters as ad


def _dyn(spark, d, width=4096):
    return te.dynamics(ad.telemetry_from_events(spark, d), width=width)


def sample_dynamics(spark, d):
    """Cut into small blocks, so the overlap is exercised."""
    out = _dyn(spark, d, width=16)
    return rounded_all(out.select("session_id", "asset", "lap", "i", "curvature", "a_lat", "a_long", "load_FL", "load_RR"))


def nudged_stamps(spark, d):
    """Stamps that jump back by a day where the value is high, in small slices: what differentiation sees instead."""
    samples = ad.telemetry_from_events(spark, d)
    back = samples.withColumn("t", F.col("t") - F.when(F.col("speed_kmh") > 150, F.lit(90_000.0)).otherwise(0.0))
    out = te.nudged(back, width=8)
    return out.select("session_id", "asset", "lap", "i", r6("t"), r6("_t", "nudged"), (F.col("_t") - F.col("t") > 1).alias("held_up"))


def lap_energy(spark, d):
    return rounded_all(te.lap_energy(_dyn(spark, d)))


def lap_asymmetry(spark, d):
    return rounded_all(te.asymmetry(_dyn(spark, d), min_n=16))


def circuit_asymmetry(spark, d):
    return rounded_all(te.circuit_asymmetry(stage(te.asymmetry(_dyn(spark, d), min_n=16))))


def _corners(spark, d):
    return ad.table(spark, d, "part").select(
        F.expr("p_partkey div 20").alias("circuit"), (F.col("p_partkey") % 20).alias("number"), (F.col("p_size") * 17.0 - 300).alias("angle"),
        (F.col("p_retailprice") * 3).alias("x"), (F.col("p_size") * 10.0).alias("y"))


def circuit_geometry(spark, d):
    return rounded_all(te.circuit_geometry(_corners(spark, d)))


def circuit_energetics(spark, d):
    return rounded_all(te.circuit_energetics(_dyn(spark, d), loaded_g=0.3))


def track_features(spark, d):
    times = ad.telemetry_from_events(spark, d).groupBy("session_id", "asset", "lap").agg(F.avg("speed_kmh").alias("perf"))
    return rounded_all(te.track_features(stage(_dyn(spark, d)), times, _corners(spark, d).withColumnRenamed("circuit", "session_id")))


def load_sections(spark, d):
    return rounded_all(te.load_sections(stage(_dyn(spark, d)), threshold=0.2, top=3))


def friction_limit(spark, d):
    return rounded_all(te.friction_limit(_dyn(spark, d)))


def track_line(spark, d):
    out = te.track_line(_dyn(spark, d), edge=2, min_n=16)
    spots = [F.element_at("x", k).alias(f"x_{k}") for k in (1, 100, 311, 420)]
    return rounded_all(out.select("session_id", "asset", "lap", *spots, F.size("power").alias("n_points"), "peak_lateral_g", "peak_braking_g", "track_length_m"))


def thermal_features(spark, d):
    return rounded_all(te.thermal_features(stage(_dyn(spark, d))))


def lap_wear(spark, d):
    dyn = stage(_dyn(spark, d))
    return rounded_all(te.lap_wear(dyn, te.thermal_features(dyn)))


def _clock(spark, d):
    return te.energy_clock(stage(te.lap_energy(_dyn(spark, d))))


def energy_clock(spark, d):
    return rounded_all(_clock(spark, d).select("session_id", "asset", "lap", "energy", "clock"))


def clock_test(spark, d):
    rows = _clock(spark, d).withColumn("age", F.col("lap").cast("double")).withColumn("corrected", F.col("mean_speed_kmh") + 0.081 * F.col("lap"))
    return rounded_all(te.clock_test(rows))


def clock_verdict(spark, d):
    rows = _clock(spark, d).withColumn("age", F.col("lap").cast("double")).withColumn("corrected", F.col("mean_speed_kmh") + 0.081 * F.col("lap"))
    return rounded_all(te.clock_verdict(te.clock_test(rows)))


def wear_formulas(spark, d):
    """The scalar wear and load formulas over lineitem columns."""
    li = ad.table(spark, d, "lineitem")
    q, p = F.col("l_quantity"), F.col("l_extendedprice") / 1000
    mode = F.when(F.col("l_returnflag") == "A", "soft").when(F.col("l_returnflag") == "N", "hard").otherwise("other")
    return rounded_all(li.groupBy("l_returnflag").agg(
        (ve.archard_wear(q, p) * 1e6).alias("archard"), F.avg(ve.temperature_multiplier(q * 3)).alias("multiplier"),
        (F.avg(ve.energy_wear_rate(p, q * 3, mode)) * 1e6).alias("wear_rate"), F.avg(ve.turn_magnitude(p * 7)).alias("turn"),
        F.avg(ve.downforce(q, ve.Vehicle())).alias("downforce"), F.avg(ve.cliff_loss(F.col("l_tax"), q, F.lit(25.0))).alias("cliff_loss"),
    ))


QUERIES = {f.__name__: f for f in (
    sample_dynamics, nudged_stamps, lap_energy, lap_asymmetry, circuit_asymmetry, circuit_geometry, circuit_energetics, track_features, load_sections, friction_limit,
    track_line, thermal_features, lap_wear, energy_clock, clock_test, clock_verdict, wear_formulas)}


def _grad(v):
    return (f"CASE WHEN i = 1 THEN lead({v}) OVER w - {v} WHEN i = n_samples THEN {v} - lag({v}) OVER w "
            f"ELSE (lead({v}) OVER w - lag({v}) OVER w) / 2 END")


_W = "WINDOW w AS (PARTITION BY asset, lap ORDER BY i)"
_V = "(798.0 * 9.81 + 0.5 * 1.225 * 5.4 * sp * sp)"
DYN = TELEMETRY + f""",
d1 AS (SELECT *, speed_kmh / 3.6 AS sp, sum(x / 10.0) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7 AS xs,
         sum(y / 10.0) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7 AS ys FROM tel {_W}),
d2 AS (SELECT *, {_grad('xs')} AS dx, {_grad('ys')} AS dy, {_grad('t')} AS dt FROM d1 {_W}),
d3 AS (SELECT *, {_grad('dx')} AS ddx, {_grad('dy')} AS ddy FROM d2 {_W}),
d4 AS (SELECT *, CASE WHEN n_samples >= 9 AND dx * dx + dy * dy > 0 THEN (dx * ddy - dy * ddx) / pow(dx * dx + dy * dy, 1.5) ELSE 0 END AS curvature,
         t - lag(t) OVER w AS hl, lead(t) OVER w - t AS hr, lag(sp) OVER w AS fl, lead(sp) OVER w AS fr FROM d3 {_W}),
d5 AS (SELECT *, CASE WHEN sp < 8 THEN 0 ELSE greatest(-68.67, least(68.67, sp * sp * curvature)) END AS a_lat,
         CASE WHEN n_samples < 2 THEN 0 WHEN i = 1 THEN (fr - sp) / hr WHEN i = n_samples THEN (sp - fl) / hl
              ELSE (hl * hl * fr + (hr * hr - hl * hl) * sp - hr * hr * fl) / (hl * hr * (hl + hr)) END AS a_long FROM d4),
d6 AS (SELECT *, {_V} * 0.455 - 798.0 * a_long * 0.28 / 3.6 AS front, {_V} * 0.545 + 798.0 * a_long * 0.28 / 3.6 AS rear,
         798.0 * a_lat * 0.28 / 2.0 AS side FROM d5),
d7 AS (SELECT *, greatest(front / 2 - side / 2, 0) AS l_fl, greatest(front / 2 + side / 2, 0) AS l_fr, greatest(rear / 2 - side / 2, 0) AS l_rl,
         greatest(rear / 2 + side / 2, 0) AS l_rr, sqrt(a_long * a_long + a_lat * a_lat) / 9.81 * sp AS u FROM d6),
dyn AS (SELECT *, (l_fl + l_fr + l_rl + l_rr) * u AS power,
         (l_fl * u + lag(l_fl * u) OVER w) / 2 * hl AS w_fl, (l_fr * u + lag(l_fr * u) OVER w) / 2 * hl AS w_fr,
         (l_rl * u + lag(l_rl * u) OVER w) / 2 * hl AS w_rl, (l_rr * u + lag(l_rr * u) OVER w) / 2 * hl AS w_rr FROM d7 {_W})
"""
_E = lambda e, c: f"sum(w_{c}) FILTER (WHERE i > {e + 1} AND i <= n_samples - {e})"
ENERGY = DYN + f""",
en AS (SELECT session_id, asset, lap, {', '.join(f'{_E(4, c)} / 1e6 AS {c}' for c in ('fl', 'fr', 'rl', 'rr'))},
  max(abs(a_lat)) FILTER (WHERE i > 4 AND i <= n_samples - 4) / 9.81 AS pl, abs(min(a_long) FILTER (WHERE i > 4 AND i <= n_samples - 4)) / 9.81 AS pb,
  avg(speed_kmh) AS ms, sum(sp * dt) AS dist, count(*) AS n FROM dyn WHERE n_samples >= 12 GROUP BY ALL),
eng AS (SELECT *, fl + fr + rl + rr AS e FROM en),
clk AS (SELECT *, avg(e) OVER (PARTITION BY session_id, asset) AS me, sum(e) OVER (PARTITION BY session_id, asset ORDER BY lap) AS ce,
   row_number() OVER (PARTITION BY session_id, asset ORDER BY lap) AS k FROM eng),
clock AS (SELECT *, CASE WHEN me > 0 THEN ce / me ELSE k END AS clock, ms + 0.081 * lap AS corrected FROM clk)
"""
# heat, one recursion step per sample of a stint; a lap's carcass starts at the mean of the lap before
HEAT = "RECURSIVE " + ENERGY.strip() + """,
th AS MATERIALIZED (SELECT session_id, asset, lap, i, n_samples, t, sp, power, row_number() OVER (PARTITION BY session_id, asset ORDER BY lap, i) AS p,
  lag(t) OVER (PARTITION BY session_id, asset, lap ORDER BY i) AS tp FROM dyn WHERE n_samples >= 12),
ht(session_id, asset, p, s, b, start, n, peak, ss, sb, inside, stress, wear, rate) AS (
  SELECT DISTINCT session_id, asset, 0::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, 0, NULL::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM th
  UNION ALL
  SELECT session_id, asset, p, s, b, start, CASE WHEN new THEN 1 ELSE n + 1 END, CASE WHEN new THEN s ELSE greatest(peak, s) END, CASE WHEN new THEN s ELSE ss + s END,
    CASE WHEN new THEN b ELSE sb + b END, CASE WHEN new THEN 0 ELSE inside END + CASE WHEN o = 0 THEN 1 ELSE 0 END, CASE WHEN new THEN 0 ELSE stress END + o * o,
    CASE WHEN new THEN 0 ELSE wear END + CASE WHEN i > 5 AND i <= n_samples - 4 THEN (1e-8 * (1 + 0.025 * o * o) * greatest(power, 0) + rate) / 2 * (t - tp) ELSE 0 END,
    1e-8 * (1 + 0.025 * o * o) * greatest(power, 0)
  FROM (SELECT *, greatest(0, 90 - s, s - 110) AS o FROM (
    SELECT h.session_id, h.asset, x.p, x.i = 1 AS new, x.i, x.n_samples, x.power, x.t, x.tp, h.n, h.peak, h.ss, h.sb, h.inside, h.stress, h.wear, h.rate,
      CASE WHEN x.i = 1 THEN coalesce(h.sb / nullif(h.n, 0), 92.0::DOUBLE) ELSE h.start END AS start,
      CASE WHEN x.i = 1 THEN 100.0::DOUBLE ELSE h.s + (x.power - 55 * (h.s - h.b) - 2.4 * greatest(x.sp, 0) * (h.s - 25) - 30 * (h.s - 35)) / 12000 * least(greatest(x.t - x.tp, 0), 0.5) END AS s,
      CASE WHEN x.i = 1 THEN coalesce(h.sb / nullif(h.n, 0), 92.0::DOUBLE) ELSE h.b + (55 * (h.s - h.b) - 8 * (h.b - 25)) / 48000 * least(greatest(x.t - x.tp, 0), 0.5) END AS b
    FROM ht h JOIN th x ON x.session_id = h.session_id AND x.asset = h.asset AND x.p = h.p + 1))),
heat AS (SELECT x.session_id, x.asset, x.lap, h.n, round(start, 6) AS start_bulk, round(peak, 6) AS peak_surface, round(ss / h.n, 6) AS mean_surface, round(sb / h.n, 6) AS mean_bulk,
  round(inside / h.n, 6) AS in_window, round(stress / h.n, 6) AS stress, round(wear, 6) AS wear, round(b, 6) AS last_bulk,
  CASE WHEN ss / h.n < 78 THEN 'underheated' WHEN ss / h.n < 90 THEN 'below window' WHEN ss / h.n > 122 THEN 'overheating' WHEN ss / h.n > 110 THEN 'above window' ELSE 'in window' END AS regime
  FROM ht h JOIN th x USING (session_id, asset, p) WHERE x.i = x.n_samples)
"""
ASYM = DYN + f""",
am AS (SELECT session_id, asset, lap, {', '.join(f'{_E(6, c)} AS {c}' for c in ('fl', 'fr', 'rl', 'rr'))},
  sum(curvature) FILTER (WHERE i > 6 AND i <= n_samples - 6) AS rot,
  coalesce(sum(abs(a_lat) * sp) FILTER (WHERE a_lat > 0 AND i > 6 AND i <= n_samples - 6), 0) AS lt,
  coalesce(sum(abs(a_lat) * sp) FILTER (WHERE a_lat < 0 AND i > 6 AND i <= n_samples - 6), 0) AS rt,
  max(abs(a_lat)) FILTER (WHERE i > 6 AND i <= n_samples - 6) / 9.81 AS pl FROM dyn WHERE n_samples >= 16 GROUP BY ALL),
asy AS (SELECT session_id, asset, lap, (fl + rl) / (fl + fr + rl + rr) AS left_share, (fl + fr) / (fl + fr + rl + rr) AS front_share,
  CASE WHEN lt + rt > 0 THEN lt / (lt + rt) END AS left_turn_share, rot AS net_rotation, pl AS peak_lateral_g FROM am WHERE fl + fr + rl + rr > 0)
"""
_a6 = ", ".join(f"round({c}, 6) AS {c}" for c in ("left_share", "front_share", "left_turn_share", "net_rotation", "peak_lateral_g"))
GEO = """
cr AS (SELECT p_partkey // 20 AS circuit, p_partkey % 20 AS number, abs(p_size * 17.0 - 300) % 360 AS a, p_retailprice * 3 AS x, p_size * 10.0 AS y FROM part),
gp AS (SELECT circuit, least(a, 360 - a) AS turn, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS gap FROM cr WINDOW w AS (PARTITION BY circuit ORDER BY number)),
geo AS (SELECT circuit, count(*) AS n_corners, count(*) FILTER (WHERE turn >= 90) AS n_tight, round(avg(turn), 6) AS mean_turn, round(median(gap), 6) AS median_spacing FROM gp GROUP BY circuit)
"""
_EN = """round(avg(abs(a_lat) / 9.81), 6) AS mean_lateral_g, round(avg(CASE WHEN abs(a_lat) / 9.81 >= {g} THEN 1.0 ELSE 0.0 END), 6) AS loaded_fraction,
 round(avg(sp * abs(a_lat)), 6) AS lateral_power, max(speed_kmh) AS top_speed_kmh, round(quantile_cont(abs(a_lat) / 9.81, 0.95), 6) AS p95_lateral_g"""
_d = "CAST({} AS DOUBLE)".format

ORACLES = {
    "sample_dynamics": sql(DYN, """
SELECT session_id, asset, lap, CAST(i AS BIGINT) AS i, round(curvature, 6) AS curvature, round(a_lat, 6) AS a_lat, round(a_long, 6) AS a_long,
       round(l_fl, 6) AS load_FL, round(l_rr, 6) AS load_RR FROM dyn"""),
    "nudged_stamps": sql(TELEMETRY + f""",
bk AS (SELECT session_id, asset, lap, CAST(i AS BIGINT) AS i, t - CASE WHEN speed_kmh > 150 THEN 90000.0 ELSE 0.0 END AS t FROM tel),
mx AS (SELECT *, max(t) OVER w AS top, max(t + (i - 1) * 1e-9) OVER w AS late FROM bk {_W}),
fl AS (SELECT asset, lap, count(DISTINCT top) < count(*) AS flat FROM mx GROUP BY ALL)""", """
SELECT session_id, asset, lap, i, round(t, 6) AS t, round(CASE WHEN flat THEN late ELSE t END, 6) AS nudged, flat AND late - t > 1 AS held_up
FROM mx JOIN fl USING (asset, lap)"""),
    "lap_energy": sql(ENERGY, """
SELECT session_id, asset, lap, round(fl, 6) AS energy_FL, round(fr, 6) AS energy_FR, round(rl, 6) AS energy_RL, round(rr, 6) AS energy_RR,
       round(pl, 6) AS peak_lateral_g, round(pb, 6) AS peak_longitudinal_g, round(ms, 6) AS mean_speed_kmh, round(dist, 6) AS distance_m, n AS n_samples,
       round(e, 6) AS energy, round((fl + fr) / nullif(e, 0), 6) AS front_share, round((fl + rl) / nullif(e, 0), 6) AS left_share FROM eng"""),
    "lap_asymmetry": sql(ASYM, f"SELECT session_id, asset, lap, {_a6} FROM asy"),
    "circuit_asymmetry": sql(ASYM, """
SELECT session_id, count(*) AS n_laps, round(avg(left_share), 6) AS left_share, round(avg(front_share), 6) AS front_share,
       round(avg(left_turn_share), 6) AS left_turn_share, round(avg(peak_lateral_g), 6) AS peak_lateral_g, round(median(net_rotation), 6) AS net_rotation,
       CASE WHEN avg(left_share) > 0.5 THEN 'clockwise' ELSE 'anti-clockwise' END AS direction FROM asy GROUP BY session_id HAVING count(*) >= 3"""),
    "circuit_geometry": "WITH " + GEO + " SELECT * FROM geo",
    "circuit_energetics": sql(DYN, f"SELECT session_id, {_EN.format(g=0.3)} FROM dyn GROUP BY session_id"),
    "track_features": sql(DYN + "," + GEO + """,
lt AS (SELECT session_id, asset, lap, avg(speed_kmh) AS p FROM tel GROUP BY ALL),
bl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY p, asset, lap) AS r FROM lt) WHERE r = 1)""", f"""
SELECT session_id, {_EN.format(g=3.0)}, round(sum(sp * dt), 6) AS lap_length_m, any_value(n_corners) AS n_corners, any_value(n_tight) AS n_tight,
       any_value(mean_turn) AS mean_turn, any_value(median_spacing) AS median_spacing
FROM dyn JOIN (SELECT session_id, asset, lap FROM bl) USING (session_id, asset, lap) LEFT JOIN geo ON geo.circuit = session_id GROUP BY session_id"""),
    "load_sections": sql(DYN + """,
nl AS (SELECT *, power / greatest(max(power) OVER (PARTITION BY asset, lap), 1e-9) AS tl FROM dyn),
sc AS (SELECT *, sum(CASE WHEN tl >= 0.2 THEN 0 ELSE 1 END) OVER (PARTITION BY asset, lap ORDER BY i) AS sec, sum(tl) OVER (PARTITION BY asset, lap) AS total FROM nl),
se AS (SELECT session_id, asset, lap, sec, CAST(min(i) AS BIGINT) AS start, CAST(max(i) AS BIGINT) AS "end", max(tl) AS peak, sum(tl) AS load, any_value(total) AS total FROM sc WHERE tl >= 0.2 GROUP BY ALL),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY session_id, asset, lap ORDER BY load DESC, start) AS INTEGER) AS position FROM se)""", """
SELECT session_id, asset, lap, start, "end", round(peak, 6) AS peak, round(load, 6) AS load, round(load / coalesce(nullif(total, 0), 1), 6) AS share, position
FROM rk WHERE position <= 3"""),
    "friction_limit": sql(DYN + """,
g AS (SELECT session_id, sqrt(a_lat ** 2 + a_long ** 2) / 9.81 AS g FROM dyn),
r AS (SELECT session_id, g, row_number() OVER (PARTITION BY session_id ORDER BY g) AS r, count(*) OVER (PARTITION BY session_id) AS n FROM g)""", f"""
SELECT session_id, ceil(g) + 0.5 AS "limit" FROM r WHERE r = floor(n * {_d(0.995)}) + 1"""),
    "energy_clock": sql(ENERGY, "SELECT session_id, asset, lap, round(e, 6) AS energy, round(clock, 6) AS clock FROM clock"),
    "thermal_features": sql(HEAT, "SELECT * FROM heat"),
    "lap_wear": sql(HEAT, """
SELECT session_id, asset, lap, round(fl, 6) AS energy_FL, round(fr, 6) AS energy_FR, round(rl, 6) AS energy_RL, round(rr, 6) AS energy_RR,
       round(pl, 6) AS peak_lateral_g, round(pb, 6) AS peak_longitudinal_g, round(ms, 6) AS mean_speed_kmh, round(dist, 6) AS distance_m, eng.n AS n_samples,
       round(e, 6) AS energy, round((fl + fr) / nullif(e, 0), 6) AS front_share, round((fl + rl) / nullif(e, 0), 6) AS left_share, heat.* EXCLUDE (session_id, asset, lap, n)
FROM eng JOIN heat USING (session_id, asset, lap)"""),
    "clock_verdict": sql(ENERGY + """,
ct AS (SELECT CASE WHEN count(*) >= 4 THEN regr_r2(corrected, clock) - regr_r2(corrected, lap) END AS g, stddev_pop(e) / greatest(avg(e), 1e-9) AS cv FROM clock GROUP BY session_id, asset)""", """
SELECT count(g) AS n_stints, count(*) FILTER (WHERE g > 0) AS energy_wins, round(avg(g), 6) AS mean_r2_gain, round(avg(cv), 6) AS mean_energy_cv,
  CASE WHEN avg(g) > 0.01 THEN 'energy clock is better' WHEN avg(g) > -0.01 THEN 'no meaningful difference' ELSE 'lap count is better' END AS verdict FROM ct"""),
    "track_line": sql(DYN + """,
tm AS (SELECT session_id, asset, lap, i, CAST(x AS DOUBLE) AS x, a_lat, a_long, sp * dt AS step FROM dyn WHERE n_samples >= 16 AND i > 2 AND i <= n_samples - 2),
ls AS (SELECT session_id, asset, lap, list(x ORDER BY i) AS xs, count(*) AS m, quantile_cont(abs(a_lat), 0.99) / 9.81 AS pl,
  quantile_cont(abs(least(a_long, 0)), 0.99) / 9.81 AS pb, sum(step) AS len FROM tm GROUP BY ALL),
pt AS (SELECT *, list_transform([0, 99, 310, 419], lambda k: k * (m - 1) / 419.0::DOUBLE) AS q FROM ls),
rs AS (SELECT *, list_transform(q, lambda s: xs[floor(s)::INT + 1] + (s - floor(s)) * (xs[least(floor(s)::INT + 2, m)] - xs[floor(s)::INT + 1])) AS v FROM pt)""", """
SELECT session_id, asset, lap, round(v[1] * 0.1, 2) AS x_1, round(v[2] * 0.1, 2) AS x_100, round(v[3] * 0.1, 2) AS x_311, round(v[4] * 0.1, 2) AS x_420,
  420 AS n_points, round(pl, 6) AS peak_lateral_g, round(pb, 6) AS peak_braking_g, round(len, 6) AS track_length_m FROM rs"""),
    "clock_test": sql(ENERGY + """,
ct AS (SELECT session_id, asset, count(*) AS n, regr_slope(corrected, lap) AS sa, regr_r2(corrected, lap) AS ra, regr_slope(corrected, clock) AS se,
  regr_r2(corrected, clock) AS re, avg(e) AS me, stddev_pop(e) / greatest(avg(e), 1e-9) AS cv FROM clock GROUP BY ALL)""", """
SELECT session_id, asset, n AS n_laps, round(CASE WHEN n >= 4 THEN sa END, 6) AS age_slope, round(CASE WHEN n >= 4 THEN ra END, 6) AS age_r2,
  round(CASE WHEN n >= 4 THEN se END, 6) AS energy_slope, round(CASE WHEN n >= 4 THEN re END, 6) AS energy_r2, round(me, 6) AS mean_energy,
  round(cv, 6) AS energy_cv, round(CASE WHEN n >= 4 THEN re - ra END, 6) AS r2_gain FROM ct"""),
    "wear_formulas": """
WITH x AS (SELECT l_returnflag, l_quantity AS q, l_extendedprice / 1000 AS p, l_tax, greatest(0, 90 - l_quantity * 3, l_quantity * 3 - 110) AS o,
  (l_extendedprice / 1000 * 7) % 360 AS a, CASE l_returnflag WHEN 'A' THEN 1.55 WHEN 'N' THEN 0.68 ELSE 1.0 END AS f FROM lineitem)
SELECT l_returnflag, round(1e-8 * sum(q * p) * 1e6, 6) AS archard, round(avg(1 + 0.025 * o * o), 6) AS multiplier,
  round(avg(1e-8 * f * (1 + 0.025 * o * o) * p) * 1e6, 6) AS wear_rate, round(avg(least(a, 360 - a)), 6) AS turn,
  round(avg(0.5 * 1.225 * 5.4 * q * q), 6) AS downforce, round(avg(l_tax * q + 0.004 * greatest(q - 25, 0) ** 2), 6) AS cliff_loss FROM x GROUP BY ALL""",
}
