"""Regressions, intervals, traits, heat and search against small brute-force computations."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wearframe.functions import gaussian, text
from wearframe.operators import folds as fo
from wearframe.operators import intervals as iv
from wearframe.operators import search as se
from wearframe.operators import shapes as sh
from wearframe.operators import stats as st
from wearframe.operators import telemetry as te
from wearframe.operators.windows import rolling_folds
from wearframe.sources import adapters as ad


def test_normal_cdf(spark):
    from statistics import NormalDist

    zs = [-40.0, -8.5, -3.0, -0.1, 0.0, 0.7, 2.5, 7.5, 9.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", gaussian.cdf("z").alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(NormalDist().cdf(r.z), rel=1e-9, abs=1e-15)


def test_ridge_equals_dense(laps, laps_pdf):
    folds = rolling_folds(laps).cache()
    got = fo.ridge_rung(laps, folds).toPandas().set_index(["fold", "event_id"])["mean"]
    for f in folds.collect():
        tr, te_ = laps_pdf[laps_pdf.seq <= f.cut], laps_pdf[(laps_pdf.seq > f.cut) & (laps_pdf.seq <= f["last"])]
        assets, modes, o = sorted(tr.asset.unique()), sorted(tr["mode"].unique()), tr.seq.min()

        def x(p):
            mode = p["mode"].where(p["mode"].isin(modes), modes[0])
            cols = [np.ones(len(p))] + [(p.asset == a).astype(float) for a in assets[1:]]
            for m in modes:
                cols += [(mode == m).astype(float), (mode == m) * p.age]
            return np.column_stack(cols + [p.interference, p.seq - o, -p.elapsed])

        X = x(tr)
        pen = np.eye(X.shape[1])
        pen[0, 0] = 0
        beta = np.linalg.lstsq(np.vstack([X, pen]), np.r_[tr.perf, np.zeros(len(pen))], rcond=None)[0]
        for e, want in zip(te_.event_id, x(te_) @ beta):
            assert got.loc[(f.fold, e)] == pytest.approx(want, abs=1e-6)


def _stream(spark, n, scale):
    rng = np.random.default_rng(5)
    y = rng.standard_t(4, n) * scale(np.arange(n) / n)
    pdf = pd.DataFrame({"model": "m", "session_id": 1, "fold": np.arange(n) * 4 // n, "seq": np.arange(n), "asset": 0, "event_id": np.arange(n),
                        "actual": y, "mean": 0.0, "sd": 1.0})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("scale", [lambda u: 1 + 0 * u, lambda u: 1 + 3 * (u > 0.5), lambda u: 1 + 2 * u, lambda u: 1 - 0.7 * u])
def test_adaptive_coverage(spark, scale):
    pdf, df = _stream(spark, 3000, scale)
    out = iv.adaptive_intervals(df).toPandas().sort_values("seq")
    assert out["covered"].mean() == pytest.approx(0.95, abs=0.03)


def test_adaptive_definition(spark):
    pdf, df = _stream(spark, 300, lambda u: 1 + u)
    out = iv.adaptive_intervals(df, alpha=0.1, gamma=0.05).toPandas().sort_values("seq")
    work, scores = 0.1, []
    for r in out.itertuples():
        assert r.working_alpha == pytest.approx(work)
        if len(scores) < 19:
            half = gaussian.Z95
        else:
            k = math.ceil((len(scores) + 1) * (1 - min(max(work, 1e-3), 0.999)))
            half = max(scores) if k > len(scores) else sorted(scores)[k - 1]
        assert r.half_width == pytest.approx(half)
        hit = abs(r.actual) <= half
        assert bool(r.covered) == hit
        work += 0.05 * (0.1 - (0 if hit else 1))
        scores.append(abs(r.actual))


def test_conformal_quantile_counts(spark):
    df = spark.createDataFrame([(1, float(i)) for i in range(1, 20)] + [(2, 1.0)], "g int, s double")
    got = {r.g: r.quantile for r in iv.conformal_quantile(df, "g", "s", 0.05).collect()}
    assert got == {1: 19.0, 2: float("inf")}


def test_calibrator_refuses_small_samples(spark):
    df = spark.createDataFrame([(1.0, 0.9, 0.1, "e")] * 5, "predicted double, actual double, posterior_sd double, event string")
    with pytest.raises(Exception, match="too few"):
        iv.fit_calibrator(df, 0.05).collect()


def test_leave_one_circuit_out_equals_refit(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"circuit": rng.integers(0, 5, 60), "label": rng.choice(list("abc"), 60), "f": rng.normal(size=60), "g": rng.normal(size=60)})
    pdf["rate"] = pdf["f"] * 0.3 + (pdf["label"] == "a") + rng.normal(0, 0.1, 60)
    pdf["id"] = range(60)
    got = st.loco(spark.createDataFrame(pdf), ["f", "g"]).toPandas().set_index("id")["predicted"]
    for c in range(5):
        tr, tt = pdf[pdf.circuit != c], pdf[pdf.circuit == c]
        labels = sorted(tr.label.unique())
        x = lambda p: np.column_stack([*[(p.label == q).astype(float) for q in labels], p.f, p.g])
        X = x(tr)
        m, s = X.mean(0), X.std(0)
        Z = (X - m) / s
        beta = np.linalg.solve(Z.T @ Z + 5 * np.eye(Z.shape[1]), Z.T @ (tr.rate - tr.rate.mean()))
        want = tr.rate.mean() + ((x(tt) - m) / s) @ beta
        assert np.allclose(got.loc[tt.id], want)


@pytest.mark.parametrize("bend,regime", [((0.05, 0.0), "linear"), ((0.05, 0.3), "cliff"), ((-0.1, 0.25), "warm-up"), ((0.2, -0.15), "recovery")])
def test_curve_regimes(spark, bend, regime):
    rng = np.random.default_rng(4)
    age = np.arange(1.0, 25.0)
    y = 80 + bend[0] * age + bend[1] * np.maximum(age - 12, 0) + rng.normal(0, 0.03, 24)
    df = spark.createDataFrame(pd.DataFrame({"session_id": 1, "asset": 1, "run_id": 1, "age": age, "corrected": y}))
    row = sh.curve_shapes(df).first()
    assert row.regime == regime
    if regime != "linear":
        assert abs(row.changepoint - 12) <= 2


def test_circle_has_known_curvature(spark):
    n, r, v = 200, 100.0, 30.0
    i = np.arange(1, n + 1)
    pdf = pd.DataFrame({"session_id": 1, "asset": 1, "lap": 1, "i": i, "n_samples": n, "t": i * 0.2, "speed_kmh": v * 3.6,
                        "x": 10 * r * np.cos(i * v * 0.2 / r), "y": 10 * r * np.sin(i * v * 0.2 / r)})
    dyn = te.trim(te.dynamics(spark.createDataFrame(pdf), width=64), 8, 100).toPandas()
    assert np.allclose(dyn["curvature"], 1 / r, rtol=0.02)
    assert np.allclose(dyn["a_lat"], v * v / r, rtol=0.02)
    assert (dyn["load_FR"] > dyn["load_FL"]).all()


def test_thermal_chain_equals_sequential(spark):
    rng = np.random.default_rng(6)
    rows = [(1, 1, lap, i + 1, 40, i * 0.1, float(rng.uniform(20, 80)), float(rng.uniform(0, 2e5))) for lap in range(4) for i in range(40)]
    df = spark.createDataFrame(rows, "session_id long, asset long, lap long, i long, n_samples long, t double, speed double, power double")
    got = te.thermal_features(df).toPandas().sort_values("lap")
    model, bulk = te.Thermal(), 92.0
    for lap in range(4):
        s, b, bs, ss_ = 100.0, bulk, [], []
        mine = [r for r in rows if r[2] == lap]
        for k, r in enumerate(mine):
            if k:
                s, b = model.step(s, b, r[7], r[6], 0.1)
            bs.append(b)
            ss_.append(s)
        row = got.iloc[lap]
        assert row.mean_bulk == pytest.approx(np.mean(bs)) and row.peak_surface == pytest.approx(max(ss_))
        bulk = np.mean(bs)


def _fixture(spark):
    texts = ["tyre wear rises with temperature and load", "fuel mass falls every lap of the race", "the track gains grip as rubber goes down",
             "exp01_recovery reports error 0.0044 per lap", "pit stops cost time but restore tyre grip", "wear and grip are not the same thing",
             "temperature changes grip", "load transfer under braking"]
    p = spark.createDataFrame([(i, t, "h", "s", "doc") for i, t in enumerate(texts)], "passage_id long, text string, heading string, source string, kind string")
    q = spark.createDataFrame([(0, "tyre wear temperature"), (1, "exp01_recovery error 0.0044"), (2, "grip of the track")], "query_id long, query string")
    return texts, p, q


def test_search_equals_full_scoring(spark):
    texts, p, q = _fixture(spark)
    k = 7
    got = se.search(p, q, k=8, components=k, rounds=6).toPandas()
    weights = se.tfidf(p).toPandas()
    terms = sorted(weights["term"].unique())
    A = np.zeros((len(texts), len(terms)))
    for r in weights.itertuples():
        A[r.passage_id, terms.index(r.term)] = r.w
    V = np.linalg.svd(A, full_matrices=False)[2][:k].T
    emb = A @ V
    emb /= np.linalg.norm(emb, axis=1, keepdims=True)
    idf = dict(zip(weights["term"], weights["idf"]))
    lex = se.bm25(p, q).toPandas()
    for qid, query in [(0, "tyre wear temperature"), (1, "exp01_recovery error 0.0044"), (2, "grip of the track")]:
        words = [w for w in spark.createDataFrame([(query,)], "q string").select(text.words(F.col("q")).alias("w")).first().w if w in idf]
        v = np.zeros(len(terms))
        for w in words:
            v[terms.index(w)] += idf[w]
        e = v @ V
        sem = emb @ (e / np.linalg.norm(e))
        srank = {i: int((sem > sem[i] + 1e-9).sum()) for i in range(len(texts))}
        mine = got[got.query_id == qid]
        for r in mine.itertuples():
            assert r.semantic_rank == srank[r.passage_id]
            assert r.score == pytest.approx(1 / (60 + r.lexical_rank) + 1 / (60 + r.semantic_rank))
        best = lex[lex.query_id == qid].sort_values(["lexical", "passage_id"], ascending=[False, True])["passage_id"].tolist()
        ranks = dict(zip(mine.passage_id, mine.lexical_rank))
        assert all(ranks[b] == i for i, b in enumerate(best) if b in ranks)
    assert got[got.query_id == 1].sort_values("position").iloc[0].passage_id == 3


def test_search_keeps_queries_without_vector(spark):
    _, p, q = _fixture(spark)
    p = p.unionByName(spark.createDataFrame([(8, "slick 1.5 and c-3 used", "h", "s", "doc"), (9, "1.5 1.5", "h", "s", "doc")], p.schema))
    bare = spark.createDataFrame([(7, "1.5"), (8, "c-3")], "query_id long, query string")
    for asked in (bare, q.unionByName(bare)):
        got = se.search(p, asked, k=3, components=5).toPandas()
        mine = got[got.query_id >= 7]
        assert sorted(zip(mine.query_id, mine.passage_id)) == [(7, 8), (7, 9), (8, 8)]
        assert mine.semantic_rank.isna().all() and np.allclose(mine.score, 1 / (60 + mine.lexical_rank))
        assert set(got.query_id) == {r.query_id for r in asked.collect()}


def test_search_blocks_do_not_matter(spark, monkeypatch):
    _, p, q = _fixture(spark)
    run = lambda: sorted(map(tuple, se.search(p, q, k=4, components=5).select("query_id", "position", "passage_id", "lexical_rank", "semantic_rank").collect()))
    whole = run()
    monkeypatch.setattr(se, "_QUERY_BLOCK", 1)
    monkeypatch.setattr(se, "_PASSAGE_CHUNK", 2)
    assert run() == whole and len(whole) >= 6


def test_bounded_scan_equals_full_scan(spark):
    rng = np.random.default_rng(17)
    # clusters along the leading components, so that blocks differ and bounds can exclude them
    v = rng.normal(size=(600, 12)) * 0.15 + rng.choice([-1, 1], size=(600, 3)) @ np.eye(3, 12)
    v[500:] = v[500]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    q = v[[3, 77, 510]]
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "passage_id long, v array<double>")
    wanted = [-0.9, 0.2, 0.7, 0.97]
    asked = spark.createDataFrame([(j, x.tolist(), wanted) for j, x in enumerate(q)], "query_id long, v array<double>, wanted array<double>")
    blocked, centres = se.in_blocks(vectors, bits=3)
    assert centres.count() > 4
    got = {(r.query_id, r.passage_id) for r in se.semantic_top(blocked, centres, asked.drop("wanted"), 15).collect()}
    s = v @ q.T
    for j in range(3):
        order = np.lexsort((np.arange(600), -s[:, j].round(12)))[:15]
        assert {i for k, i in got if k == j} == set(order.tolist())
    ranks = {(r.query_id, r.k): r.semantic_rank for r in se.semantic_ranks(blocked, centres, asked).collect()}
    assert ranks == {(j, k): int((s[:, j] > w).sum()) for j in range(3) for k, w in enumerate(wanted)}


def test_chunker(spark):
    words = " ".join(f"w{i}" for i in range(20))
    doc = f"# First **part**\n{words}\n```\nskip this code entirely please now ok\n```\nshort line\n\n## Second\n| a | [b](http://x) |\n|---|---|\n{words}\n"
    got = se.chunk(spark.createDataFrame([(1, doc, "s")], "doc_id int, text string, source string")).orderBy("number").collect()
    assert [r.heading for r in got] == ["First part", "Second"]
    assert got[1].text.startswith("a · b w0") and "skip" not in " ".join(r.text for r in got)


def test_numbers(spark):
    df = spark.createDataFrame([("rate 0.113 over 25 laps", "about 0.11 in 25"), ("rate 0.113", "rate 0.15"), ("x 1,5", "1.5")], "a string, b string")
    assert [r.ok for r in df.select(text.rewrite_ok(F.col("b"), F.col("a")).alias("ok")).collect()] == [True, False, True]


def test_wilcoxon_small(spark):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in [(5, 3), (4, 4), (7, 2), (1, 2), (9, 5), (6, 3)]], "a double, b double")
    row = st.wilcoxon(df, "a", "b").first()
    assert (row.n, row.statistic) == (5, 1.0)


def test_partition_count_does_not_matter(spark, data):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        rows = ad.laps_from_events(spark, data, interference=True).orderBy("event_id").collect()
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        return rows

    assert run(1) == run(50)


_CASE = ("case_id long, mode string, age double, rate double, rate_sd double, base_pace double, cliff_age double, now long, "
         "total long, base double, stop_loss double, gap_ahead double, new_rate double, new_rate_sd double, new_base_pace double, new_cliff_age double")


def test_closed_form_equals_simulation(spark):
    from wearframe.operators import decide as de

    rows = [(1, "M", 18.0, 0.113, 0.023, 0.0, 22.0, 30, 53, 84.0, 21.0, 0.9, 0.074, 0.018, 0.45, 12.0), (2, "S", 30.0, 0.2, 0.05, 0.1, 20.0, 0, 25, 84.0, 21.0, 3.0, 0.05, 0.02, 0.3, 30.0)]
    cases = spark.createDataFrame(rows, _CASE)
    got = de.outcomes(cases, de.default_options(cases), event_rate=0.05)
    best = {r.case_id: r for r in de.recommend(cases, got, event_rate=0.05).collect()}
    table = {(r.case_id, r.option): r for r in got.collect()}
    rng = np.random.default_rng(0)
    n = 40_000
    for case in cases.collect():
        steps = case.total - case.now
        r0, r1 = rng.normal(case.rate, case.rate_sd, n), rng.normal(case.new_rate, case.new_rate_sd, n)
        event, noise = rng.random((n, steps)) < 0.05, rng.normal(0, de.NOISE_SD, (n, steps))
        totals = {}
        for (c, option), row in table.items():
            if c != case.case_id:
                continue
            total = np.zeros(n)
            for k in range(1, steps + 1):
                lap = case.now + k
                stopped = row.stop_at is not None and lap >= row.stop_at
                age = lap - row.stop_at + 1 if stopped else case.age + k
                cliff, pace, rate = (case.new_cliff_age, case.new_base_pace, r1) if stopped else (case.cliff_age, case.base_pace, r0)
                cost = case.base + pace + rate * age + de.CLIFF_SEVERITY * max(age - cliff, 0) ** 2 + noise[:, k - 1]
                cost = cost + (de.TRAFFIC_LOSS if case.gap_ahead < de.TRAFFIC_GAP and not stopped else 0)
                total += cost * np.where(event[:, k - 1], de.EVENT_SLOWDOWN, 1)
                if row.stop_at == lap:
                    total += case.stop_loss * np.where(event[:, k - 1], de.EVENT_DISCOUNT, 1)
            totals[option] = total
            assert row.expected == pytest.approx(total.mean(), abs=6 * total.std() / np.sqrt(n))
            assert row.sd == pytest.approx(total.std(), rel=0.02)
        b = best[case.case_id]
        assert b.win_probability == pytest.approx((totals[b.recommended] < totals[b.runner_up]).mean(), abs=0.08)


def test_stop_cost_is_paid_and_regret_is_not_negative(spark):
    from wearframe.operators import decide as de

    case = [(1, "M", 18.0, 0.113, 0.023, 0.0, 22.0, 30, 53, 84.0, 21.0, 3.0, 0.074, 0.018, 0.45, 32.0), (2, "M", 9.0, 0.1, 0.02, 0.0, 22.0, 5, 9, 84.0, 21.0, 3.0, None, None, None, None)]
    cases = spark.createDataFrame(case, _CASE)
    opts = de.default_options(cases)
    cost = lambda c: {(r.case_id, r.option): r.expected for r in de.outcomes(c, opts).collect()}
    base, dear = cost(cases), cost(cases.withColumn("stop_loss", F.lit(41.0)))
    assert dear[1, "Stay out"] == pytest.approx(base[1, "Stay out"])
    assert dear[1, "Box now"] == pytest.approx(base[1, "Box now"] + 20 * de.moments()["stop"])
    assert [k for k in base if k[0] == 2] == [(2, "Stay out")]  # no other mode to go to
    ch = spark.createDataFrame([(1, "Box now", "Stay out"), (1, "Stay out", "Box now")], "case_id long, recommended string, actual string")
    assert all(r.regret >= 0 for r in de.regret(de.outcomes(cases, opts), ch).collect())


def test_depth_matched_fits_again_inside_the_window(spark):
    rng = np.random.default_rng(4)
    rows = [(s, m, side, float(a), 90 + (0.1 + 0.02 * s) * a + (0.004 * a * a if side else 0) + rng.normal(0, 0.05))
            for s in range(3) for m in "AB" for side, deep in ((0, 12 + s), (1, 25 if m == "A" else 3)) for a in range(1, deep + 1) for _ in range(2)]
    pdf = pd.DataFrame(rows, columns=["session_id", "mode", "race", "age", "perf"])
    laps = spark.createDataFrame(pdf)
    got = st.depth_matched(laps.where("race = 0"), laps.where("race = 1"), min_laps=6).toPandas().set_index(["session_id", "mode"])
    # the races of mode B are too short for a window
    assert sorted(got.index) == [(s, "A") for s in range(3)]
    for s in range(3):
        p, r = (pdf[(pdf.session_id == s) & (pdf["mode"] == "A") & (pdf.race == side)] for side in (0, 1))
        window = min(np.percentile(r.age, 90), p.age.max())
        error = lambda a, b: np.polyfit(a.age, a.perf, 1)[0] - np.polyfit(b.age, b.perf, 1)[0]
        row = got.loc[(s, "A")]
        assert row.baseline_error == pytest.approx(error(p, r)) and row.depth_gap == pytest.approx(p.age.max() - np.percentile(r.age, 90))
        assert row.matched_error == pytest.approx(error(p[p.age <= window], r[r.age <= window]))


def test_depth_summary_query_uses_the_refit(spark, data):
    from wearframe.catalog import statistics as cs

    rows = st.depth_matched(*cs._sides_of(ad.laps_from_events(spark, data)), min_laps=30).toPandas()
    got = cs.depth_summary(spark, data).first()
    assert got.n_comparisons == len(rows) > 0
    assert got.matched_bias == pytest.approx(rows.matched_error.mean(), abs=1e-5) and got.mean_depth_gap == pytest.approx(rows.depth_gap.mean(), abs=1e-5)


def test_boosting_runs_as_many_rounds_as_the_reference(monkeypatch):
    import inspect

    from wearframe.catalog import model

    assert {inspect.signature(f).parameters["trees"].default for f in (fo.boosted_rung, fo.boosted_fold)} == {200}
    rungs = {}
    monkeypatch.setattr(model, "_laps", lambda *a: None)
    monkeypatch.setattr(model.windows, "rolling_folds", lambda *a: None)

    def seen(laps, folds, named):
        rungs.update(named)
        raise InterruptedError

    monkeypatch.setattr(fo, "evaluate", seen)
    with pytest.raises(InterruptedError):
        model.full_ladder(None, None)
    assert rungs["boosted"] is fo.boosted_rung and set(rungs) == {*fo.RUNGS, "boosted", "statespace"}


def test_boosted_folds_are_fitted_side_by_side(spark, laps, monkeypatch):
    import threading

    from wearframe.operators import windows

    folds = windows.rolling_folds(laps)
    numbers = sorted(r.fold for r in folds.collect())
    assert len(numbers) > 1
    met = threading.Barrier(len(numbers), timeout=20)

    def fit(prepared, trees, depth):
        met.wait()
        return prepared.select("fold", F.lit(trees), F.lit(depth)).distinct()

    monkeypatch.setattr(fo, "_boosted_fit", fit)
    assert [tuple(r) for r in fo.boosted_rung(laps, folds).collect()] == [(k, 200, 4) for k in numbers]


def test_boosted_folds_side_by_side_forecast_every_held_out_row(spark, laps):
    """Forecasts themselves are not compared: the rows a round draws depend on the order they are written in."""
    from wearframe.operators import windows

    folds = windows.rolling_folds(laps)
    rows = fo.boosted_rung(laps, folds, trees=3).collect()
    held = fo.held_out(laps, folds).select("fold", "event_id", "perf").collect()
    assert held and sorted((r.fold, r.event_id, r.actual) for r in rows) == sorted(tuple(r) for r in held)
    assert all(math.isfinite(r.mean) and r.sd > 0 for r in rows)
