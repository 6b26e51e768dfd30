"""Queries over the cleaned lap table: rates, runs, windows, selections."""

from pyspark.sql import functions as F

from wearframe.catalog.shared import INTERFERENCE, LAPS, LINE, ULAPS, r6, rounded_all, sql
from wearframe.operators import rates, slices, windows
from wearframe.sources import adapters as ad
from wearframe.sources.laps import annotate_mode


def naive_rates(spark, d):
    return rounded_all(rates.naive_rates(ad.laps_from_events(spark, d)))


NAIVE = """
slopes AS (SELECT session_id, run_id, mode, regr_slope(perf, age) AS slope, count(*) AS n FROM {t}
           GROUP BY ALL HAVING count(*) >= 3 AND max(age) > min(age)),
naive AS (SELECT session_id, mode, avg(slope) AS rate, count(*) AS n_runs, CAST(sum(n) AS BIGINT) AS n_laps
          FROM slopes GROUP BY ALL)
"""
NAIVE_EV = LAPS + "," + NAIVE.format(t="laps")
NAIVE_LI = LINE + "," + NAIVE.format(t="llaps")
_naive_out = "SELECT session_id, mode, round(rate, 6) AS rate, n_runs, n_laps FROM naive"


def naive_rates_lineitem(spark, d):
    return rounded_all(rates.naive_rates(ad.laps_from_lineitem(spark, d)))


def naive_failures(spark, d):
    return rounded_all(rates.naive_failures(rates.naive_rates(ad.laps_from_events(spark, d))))


def ols_by_mode(spark, d):
    return rounded_all(rates.ols_by_mode(ad.laps_from_events(spark, d)))


def ols_corrected(spark, d):
    return rounded_all(rates.ols_corrected(ad.laps_from_events(spark, d)))


OLS = """
fit AS (SELECT session_id, mode, count(*) AS n, avg({y}) AS my, regr_slope({y}, age) AS b, regr_intercept({y}, age) AS a,
           max(age) - min(age) AS span, avg(age) AS mx FROM laps GROUP BY ALL),
res AS (SELECT l.session_id, l.mode, sum(({y} - b * age - a) ** 2) AS rss, sum((age - mx) ** 2) AS sxx
        FROM laps l JOIN fit USING (session_id, mode) WHERE n >= 3 AND span > 0 GROUP BY ALL),
pool AS (SELECT session_id, sum(rss) / sum(n) AS v FROM res JOIN fit USING (session_id, mode) GROUP BY ALL)
SELECT session_id, mode, n, round(CASE WHEN rss IS NULL THEN 0 ELSE b END, 6) AS slope,
       round(CASE WHEN rss IS NULL THEN my ELSE a END, 6) AS intercept,
       round(sqrt(rss / greatest(n - 2, 1) / sxx), 6) AS slope_se,
       round(coalesce(sqrt(v), 1.0), 6) AS sd
FROM fit LEFT JOIN res USING (session_id, mode) LEFT JOIN pool USING (session_id)
"""


def interference(spark, d):
    laps = ad.laps_from_events(spark, d, interference=True)
    return laps.select("session_id", "event_id", r6("interference"))


def run_summary(spark, d):
    return rounded_all(rates.run_summary(ad.laps_from_events(spark, d)))


def longest_runs(spark, d):
    return rates.longest_runs(ad.laps_from_events(spark, d), k=10, min_laps=8)


def stint_profile(spark, d):
    return rounded_all(rates.stint_profile(ad.laps_from_events(spark, d, interference=True)))


def run_index(spark, d):
    out = windows.run_index(ad.laps_from_events(spark, d))
    return out.select("session_id", "asset", "event_id", "run_id", "run_index")


def elapsed_from_age(spark, d):
    laps = ad.laps_from_events(spark, d)
    return windows.elapsed(laps).select("event_id", "age", "elapsed")


def age_transitions(spark, d):
    laps = ad.laps_from_events(spark, d, unique=True)
    return windows.transitions(laps).select("event_id", "is_reset", "age_gain")


def age_violations(spark, d):
    laps = ad.laps_from_events(spark, d, unique=True).withColumn(
        "age", F.when(F.col("event_id") % 13 == 0, F.lit(0.0)).otherwise(F.col("age"))
    )
    return windows.age_violations(laps).select("session_id", "run_id", "seq", "event_id", "age")


def rolling_folds(spark, d):
    return windows.rolling_folds(ad.laps_from_events(spark, d))


FOLDS = """
dseq AS (SELECT session_id, seq, count(*) AS rows_ FROM laps GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS r, count(*) OVER (PARTITION BY session_id) AS len
       FROM dseq),
edges AS (SELECT DISTINCT session_id, k AS fold, len, floor(0.4 * len) AS st,
             CAST(floor(floor(0.4 * len) + k * (len - floor(0.4 * len)) / 4.0) AS BIGINT) AS e0,
             CAST(floor(floor(0.4 * len) + (k + 1) * (len - floor(0.4 * len)) / 4.0) AS BIGINT) AS e1
          FROM rk, (SELECT unnest([0, 1, 2, 3]) AS k) WHERE len >= 6),
spans AS (SELECT e.session_id, e.fold, a.seq AS cut, b.seq AS last FROM edges e
          JOIN rk a ON a.session_id = e.session_id AND a.r = e.e0
          JOIN rk b ON b.session_id = e.session_id AND b.r = e.e1),
folds AS (SELECT s.session_id, s.fold, s.cut, s.last,
            count(*) FILTER (WHERE l.seq <= s.cut) AS n_train,
            count(*) FILTER (WHERE l.seq > s.cut AND l.seq <= s.last) AS n_test
          FROM spans s JOIN laps l USING (session_id) GROUP BY ALL
          HAVING count(*) FILTER (WHERE l.seq <= s.cut) >= 20
             AND count(*) FILTER (WHERE l.seq > s.cut AND l.seq <= s.last) >= 5)
"""


def mode_models(spark, d):
    laps = ad.laps_from_events(spark, d)
    return rounded_all(rates.mode_models(laps, rates.naive_rates(laps).select("session_id", "mode", "rate")))


def session_overview(spark, d):
    laps = ad.laps_from_events(spark, d)
    runs = laps.groupBy("session_id", "mode", "run_id").agg(F.max("age").alias("end_age"))
    return rounded_all(rates.overview(rates.naive_rates(laps), runs))


def collinearity(spark, d):
    return rounded_all(rates.collinearity(ad.laps_from_events(spark, d)))


def fisher(spark, d):
    laps = ad.laps_from_events(spark, d)
    out = rates.fisher(windows.elapsed(laps))
    return out.select(
        "session_id", *[(F.round(F.col(c), 3) + 0.0).alias(c) for c in ("info_load", "info_cross", "info_wear", "eig_max", "eig_min")],
        "rank", "var_free", r6("var_prior"), r6("sd_prior"),
    )


def half_field(spark, d):
    return rates.half_field(ad.laps_from_events(spark, d)).select("session_id", "asset", "event_id")


def min_evidence(spark, d):
    laps = ad.laps_from_events(spark, d)
    return rates.min_evidence(laps, ["asset", "run_id"], 8, "age", 3.0).select("asset", "run_id", "event_id")


def depth_window(spark, d):
    laps = ad.laps_from_events(spark, d)
    out = rates.depth_window(laps.where("week < 2"), laps.where("week >= 2"))
    return out.select("session_id", "mode", "event_id", r6("depth"))


def lap_lookup(spark, d):
    laps = ad.laps_from_events(spark, d, unique=True).select("session_id", "asset", "seq", "perf", "age", "mode")
    asked = ad.table(spark, d, "orders").select(
        F.expr("(o_orderkey % 150) div 10").alias("session_id"), (F.col("o_orderkey") % 150).alias("asset"),
        F.expr("o_orderkey div 150").alias("seq"),
    )
    return rates.lap_at(laps, asked)


def reference_lap(spark, d):
    laps = ad.laps_from_events(spark, d, unique=True)
    out = rates.with_reference(laps)
    return out.select("event_id", "ref_seq", "ref_age", r6(F.col("perf") - F.col("ref_perf"), "delta"))


def reference_lap_named(spark, d):
    laps = ad.laps_from_events(spark, d, unique=True)
    named = laps.select("session_id", "asset", "seq", (F.col("seq") - F.col("seq") % 7).alias("ref_seq"))
    out = rates.with_reference(laps, named)
    return out.select("event_id", "ref_seq", "ref_age", "rejected", r6(F.col("perf") - F.col("ref_perf"), "delta"))


def sample_laps(spark, d):
    laps = ad.laps_from_events(spark, d)
    return rates.sample_laps(laps.withColumn("perf", F.col("perf") + 100), 20, within=1.2,
                             order=("start", "event_id")).select("session_id", "event_id")


def fastest_lap(spark, d):
    return rates.fastest_lap(ad.laps_from_events(spark, d, unique=True)).select(
        "session_id", "asset", "seq", "event_id", "perf")


def shared_modes(spark, d):
    laps = ad.laps_from_events(spark, d)
    first = laps.where("week < 2").select("session_id", "mode")
    return first.intersect(laps.where("week >= 2").select("session_id", "mode"))


def modes_not_run_late(spark, d):
    laps = ad.laps_from_events(spark, d)
    first = laps.where("week < 2").select("asset", "run_id", "mode").distinct()
    return first.join(laps.where("week >= 2").select("asset", "run_id", "mode"), ["asset", "run_id", "mode"], "left_anti")


def duplicate_keys(spark, d):
    return rates.duplicates(ad.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def annotated_modes(spark, d):
    laps = ad.laps_from_events(spark, d).withColumn("year", F.col("week")).withColumn("round", F.col("session_id")).withColumn(
        "mode", F.upper("mode"))
    part = ad.table(spark, d, "part")
    nominations = part.select(
        (F.col("p_partkey") % 4).alias("year"), F.expr("p_partkey div 4").alias("round"),
        (F.col("p_size") % 3 + 1).alias("hardest"),
    )
    return annotate_mode(laps, nominations, offsets={"CLICK": 0, "PURCHASE": 1, "VIEW": 2}).select(
        "event_id", "mode", "mode_id")


def exact_quantiles(spark, d):
    li = ad.table(spark, d, "lineitem")
    out = slices.exact_percentiles(li, ["l_returnflag"], "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p99": 0.99})
    return rounded_all(out)


QUERIES = {
    "naive_rates": naive_rates,
    "naive_rates_lineitem": naive_rates_lineitem,
    "naive_failures": naive_failures,
    "ols_by_mode": ols_by_mode,
    "ols_corrected": ols_corrected,
    "interference": interference,
    "run_summary": run_summary,
    "longest_runs": longest_runs,
    "stint_profile": stint_profile,
    "run_index": run_index,
    "elapsed_from_age": elapsed_from_age,
    "age_transitions": age_transitions,
    "age_violations": age_violations,
    "rolling_folds": rolling_folds,
    "mode_models": mode_models,
    "session_overview": session_overview,
    "collinearity": collinearity,
    "fisher_information": fisher,
    "half_field": half_field,
    "min_evidence": min_evidence,
    "depth_window": depth_window,
    "lap_lookup": lap_lookup,
    "reference_lap": reference_lap,
    "reference_lap_named": reference_lap_named,
    "sample_laps": sample_laps,
    "fastest_lap": fastest_lap,
    "shared_modes": shared_modes,
    "modes_not_run_late": modes_not_run_late,
    "duplicate_keys": duplicate_keys,
    "annotated_modes": annotated_modes,
    "exact_quantiles": exact_quantiles,
}

ORACLES = {
    "naive_rates": sql(NAIVE_EV, _naive_out),
    "naive_rates_lineitem": sql(NAIVE_LI, _naive_out),
    "naive_failures": sql(NAIVE_EV + """,
s AS (SELECT session_id, count(*) AS m, count(*) FILTER (WHERE rate < 0) AS neg FROM naive GROUP BY ALL)""", """
SELECT count(*) AS n_sessions, count(*) FILTER (WHERE neg > 0) AS n_sessions_negative,
       CAST(sum(m) AS BIGINT) AS n_mode_stints, CAST(sum(neg) AS BIGINT) AS n_negative_mode_stints,
       round(count(*) FILTER (WHERE neg > 0) / count(*), 6) AS session_failure_rate,
       round(sum(neg) / sum(m), 6) AS stint_failure_rate FROM s"""),
    "ols_by_mode": sql(LAPS + ",", OLS.format(y="perf")),
    "ols_corrected": sql(LAPS + ",", OLS.format(y="(perf + 0.081 * elapsed)")),
    "interference": sql(LAPS + INTERFERENCE,
                        "SELECT session_id, event_id, round(interference, 6) AS interference FROM ilaps"),
    "run_summary": sql(LAPS, """
SELECT session_id, asset, run_id, mode, count(*) AS laps, min(seq) AS start_seq, max(seq) AS end_seq,
       min(age) AS start_age, max(age) AS end_age, round(median(perf), 6) AS median_perf FROM laps GROUP BY ALL"""),
    "longest_runs": sql(LAPS, """
SELECT session_id, asset, run_id, mode, count(*) AS laps FROM laps GROUP BY ALL HAVING count(*) >= 8
ORDER BY laps DESC, session_id, asset, run_id, mode LIMIT 10"""),
    "stint_profile": sql(LAPS + INTERFERENCE + """,
r AS (SELECT session_id, mode, asset, run_id, count(*) AS n, avg(interference) AS i FROM ilaps GROUP BY ALL
      HAVING count(*) >= 4)""", """
SELECT session_id, mode, count(*) AS n_stints, round(avg(n), 6) AS mean_length, max(n) AS max_length,
       CAST(sum(n) AS BIGINT) AS total_laps, round(avg(i), 6) AS mean_interference,
       round(count(*) / count(DISTINCT asset), 6) AS stints_per_asset FROM r GROUP BY ALL"""),
    "run_index": sql(LAPS, """
SELECT session_id, asset, event_id, run_id,
       CAST(dense_rank() OVER (PARTITION BY session_id, asset ORDER BY run_id) - 1 AS INTEGER) AS run_index FROM laps"""),
    "elapsed_from_age": sql(LAPS, """
SELECT event_id, age, age - min(age) OVER (PARTITION BY asset, run_id) AS elapsed FROM laps"""),
    "age_transitions": sql(ULAPS, """
SELECT event_id, coalesce(lag(run_id) OVER w <> run_id, true) AS is_reset,
       CASE WHEN coalesce(lag(run_id) OVER w <> run_id, true) THEN 0.0
            ELSE greatest(age - lag(age) OVER w, 0.0) END AS age_gain
FROM ulaps WINDOW w AS (PARTITION BY session_id, asset ORDER BY seq)"""),
    "age_violations": sql(ULAPS + """,
m AS (SELECT * REPLACE (CASE WHEN event_id % 13 = 0 THEN 0.0 ELSE age END AS age) FROM ulaps),
p AS (SELECT *, lag(age) OVER (PARTITION BY session_id, run_id ORDER BY seq) AS before FROM m)""",
                          "SELECT session_id, run_id, seq, event_id, age FROM p WHERE age < before"),
    "rolling_folds": sql(LAPS + "," + FOLDS, "SELECT session_id, fold, cut, last, n_train, n_test FROM folds"),
    "mode_models": sql(NAIVE_EV + """,
med AS (SELECT session_id, median(perf) AS m FROM laps GROUP BY ALL),
g AS (SELECT session_id, mode, median(perf) FILTER (WHERE age <= 3) AS fresh, count(*) FILTER (WHERE age <= 3) AS nf,
             max(age) AS ma FROM laps GROUP BY ALL)""", """
SELECT session_id, mode, round(rate, 6) AS rate, round(CASE WHEN nf >= 3 THEN fresh - m ELSE 0 END, 6) AS base_pace,
       round(greatest(0.85 * ma, 8.0), 6) AS cliff_age
FROM naive JOIN g USING (session_id, mode) JOIN med USING (session_id)"""),
    "session_overview": sql(NAIVE_EV + """,
dp AS (SELECT session_id, mode, max(age) AS deepest FROM laps GROUP BY ALL HAVING max(age) >= 5),
dm AS (SELECT session_id, arg_max(mode, {'a': deepest, 'b': mode}) AS deepest_mode, max(deepest) AS deepest_age
       FROM dp GROUP BY ALL)""", """
SELECT session_id, count(*) FILTER (WHERE rate < 0) AS negative_modes, count(*) AS n_modes,
       any_value(deepest_mode) AS deepest_mode, any_value(deepest_age) AS deepest_age
FROM naive LEFT JOIN dm USING (session_id) GROUP BY session_id"""),
    "collinearity": sql(LAPS, """
SELECT session_id, run_id, count(*) AS n, round(corr(elapsed, age), 6) AS r, 0e0 AS max_deviation, corr(elapsed, age) > 1 - 1e-9 AS is_exact
FROM laps GROUP BY ALL HAVING count(*) >= 5"""),
    "fisher_information": sql(LAPS + """,
e AS (SELECT session_id, run_id, age, age - min(age) OVER (PARTITION BY asset, run_id) AS f FROM laps),
c AS (SELECT session_id, run_id, age - avg(age) OVER w AS a, f - avg(f) OVER w AS f, count(*) OVER w AS n
      FROM e WINDOW w AS (PARTITION BY session_id, run_id)),
g AS (SELECT session_id, sum(f * f) / 0.0625 AS a, -sum(f * a) / 0.0625 AS b, sum(a * a) / 0.0625 AS c
      FROM c WHERE n >= 5 GROUP BY ALL)""", """
SELECT session_id, round(a, 3) AS info_load, round(b, 3) AS info_cross, round(c, 3) AS info_wear,
       round((a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b), 3) AS eig_max, 0e0 AS eig_min,
       1 AS rank, CAST(NULL AS DOUBLE) AS var_free,
       round((a + 1 / 0.016 ** 2) / ((a + 1 / 0.016 ** 2) * c - b * b), 6) AS var_prior,
       round(sqrt((a + 1 / 0.016 ** 2) / ((a + 1 / 0.016 ** 2) * c - b * b)), 6) AS sd_prior FROM g"""),
    "half_field": sql(LAPS + """,
k AS (SELECT session_id, asset, row_number() OVER (PARTITION BY session_id ORDER BY asset) AS r,
             count(*) OVER (PARTITION BY session_id) AS n FROM (SELECT DISTINCT session_id, asset FROM laps))""", """
SELECT l.session_id, l.asset, l.event_id FROM laps l JOIN k USING (session_id, asset) WHERE r <= greatest(n // 2, 2)"""),
    "min_evidence": sql(LAPS, """
SELECT asset, run_id, event_id FROM (SELECT *, count(*) OVER w AS n, max(age) OVER w - min(age) OVER w AS s
FROM laps WINDOW w AS (PARTITION BY asset, run_id)) WHERE n >= 8 AND s >= 3"""),
    "depth_window": sql(LAPS + """,
cut AS (SELECT session_id, mode, least(quantile_cont(age, 0.9) FILTER (WHERE week >= 2), max(age) FILTER (WHERE week < 2)) AS depth,
          count(*) FILTER (WHERE week >= 2) AS r, count(*) FILTER (WHERE week < 2) AS p FROM laps GROUP BY ALL)""", """
SELECT session_id, mode, event_id, round(depth, 6) AS depth FROM laps JOIN cut USING (session_id, mode)
WHERE week >= 2 AND r > 0 AND p > 0 AND depth >= 4 AND age <= depth"""),
    "lap_lookup": sql(ULAPS + """,
asked AS (SELECT (o_orderkey % 150) // 10 AS session_id, o_orderkey % 150 AS asset, o_orderkey // 150 AS seq FROM orders)""", """
SELECT session_id, asset, seq, perf, age, mode, CASE WHEN perf IS NULL THEN 'no valid lap' ELSE 'found' END AS status
FROM asked LEFT JOIN (SELECT session_id, asset, seq, perf, age, mode FROM ulaps) USING (session_id, asset, seq)"""),
    "reference_lap": sql(ULAPS, """
SELECT event_id, first_value(seq) OVER w AS ref_seq, first_value(age) OVER w AS ref_age,
       round(perf - first_value(perf) OVER w, 6) AS delta
FROM ulaps WINDOW w AS (PARTITION BY session_id, asset, run_id ORDER BY seq)"""),
    "reference_lap_named": sql(ULAPS, """
SELECT a.event_id, a.seq - a.seq % 7 AS ref_seq, CASE WHEN b.run_id = a.run_id THEN b.age END AS ref_age,
       coalesce(b.run_id <> a.run_id, true) AS rejected,
       round(a.perf - CASE WHEN b.run_id = a.run_id THEN b.perf END, 6) AS delta
FROM ulaps a LEFT JOIN ulaps b ON b.session_id = a.session_id AND b.asset = a.asset AND b.seq = a.seq - a.seq % 7"""),
    "sample_laps": sql(LAPS + """,
q AS (SELECT *, min(perf + 100) OVER (PARTITION BY session_id) AS best FROM laps),
r AS (SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY seq, start, event_id) - 1 AS r,
             count(*) OVER (PARTITION BY session_id) AS n FROM q WHERE perf + 100 <= 1.2 * best)""", """
SELECT session_id, event_id FROM r WHERE r % greatest(n // 20, 1) = 0 AND r // greatest(n // 20, 1) < 20"""),
    "fastest_lap": sql(ULAPS, """
SELECT session_id, asset, seq, event_id, perf FROM (SELECT *, row_number() OVER (PARTITION BY session_id
ORDER BY perf, asset, seq) AS r FROM ulaps) WHERE r = 1"""),
    "shared_modes": sql(LAPS, """
SELECT session_id, mode FROM laps WHERE week < 2 INTERSECT SELECT session_id, mode FROM laps WHERE week >= 2"""),
    "modes_not_run_late": sql(LAPS, """
SELECT asset, run_id, mode FROM laps WHERE week < 2 EXCEPT SELECT asset, run_id, mode FROM laps WHERE week >= 2"""),
    "duplicate_keys": """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""",
    "annotated_modes": sql(LAPS + """,
nom AS (SELECT p_partkey % 4 AS year, p_partkey // 4 AS round, p_size % 3 + 1 AS hardest FROM part)""", """
SELECT event_id, upper(mode) AS mode,
       'C' || CAST(hardest + CASE upper(mode) WHEN 'CLICK' THEN 0 WHEN 'PURCHASE' THEN 1 WHEN 'VIEW' THEN 2 END AS VARCHAR) AS mode_id
FROM laps LEFT JOIN nom ON nom.year = laps.week AND nom.round = laps.session_id"""),
    "exact_quantiles": """
SELECT l_returnflag, count(*) AS n_values, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10,
       round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99
FROM lineitem GROUP BY ALL""",
}
