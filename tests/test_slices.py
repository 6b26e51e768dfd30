import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wearframe.operators import slices, windows


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(0)
    n = 6000
    pdf = pd.DataFrame({
        "k": np.where(rng.random(n) < 0.6, 0, rng.integers(1, 40, n)), "t": rng.permutation(n),
        "v": np.round(rng.normal(50, 20, n), 2), "a": rng.integers(0, 5, n)})
    pdf.loc[:5, "v"] = np.nan
    return pdf, spark.createDataFrame(pdf).withColumn("s", F.floor(F.col("t") / 100))


@pytest.mark.parametrize("partitions", [1, 64])
def test_percentiles_match_numpy(spark, skewed, partitions):
    pdf, df = skewed
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    got = slices.exact_percentiles(df, ["k"], "v", {"p10": 0.1, "p50": 0.5, "p98": 0.98}).toPandas().set_index("k")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    for k, g in pdf.dropna().groupby("k"):
        assert np.allclose(got.loc[k, ["p10", "p50", "p98"]].astype(float), np.percentile(g["v"], [10, 50, 98]))


def test_global_median(skewed):
    pdf, df = skewed
    assert slices.exact_percentiles(df, [], "v", {"m": 0.5}).first().m == pytest.approx(pdf["v"].median())


def test_positions_running_previous(skewed):
    pdf, df = skewed
    out = slices.positions(df, ["k"], "s", ["t"])
    out = slices.running(out, ["k"], "s", ["t"], {"sum_a": F.col("a")})
    out = slices.previous(out, ["k"], "s", ["t"], {"before": "a"}).toPandas().sort_values(["k", "t"])
    want = pdf.sort_values(["k", "t"])
    g = want.groupby("k")["a"]
    assert (out["pos"].to_numpy() == (g.cumcount() + 1).to_numpy()).all()
    assert (out["sum_a"].to_numpy() == g.cumsum().to_numpy()).all()
    assert np.array_equal(out["before"].to_numpy(float), g.shift().to_numpy(float), equal_nan=True)


def test_halo_window_equals_plain_window(spark, skewed):
    from pyspark.sql import Window

    _, df = skewed
    placed = slices.positions(df, ["k"], "s", ["t"], name="i")
    w = Window.partitionBy("k").orderBy("i").rowsBetween(-3, 3)
    b = Window.partitionBy("k", "_block").orderBy("i").rowsBetween(-3, 3)
    plain = placed.select("t", F.sum("a").over(w).alias("x"))
    cut = slices.halo(placed, ["k"], "i", 3, 16).withColumn("y", F.sum("a").over(b)).where("_core").select("t", "y")
    assert plain.join(cut, "t").where("x <> y").count() == 0
    assert cut.count() == plain.count()


def test_lookback_matches_loop(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"session_id": 1, "asset": rng.choice([1, 1, 1, 2, 3], 400), "lap": range(400), "start": np.sort(np.round(rng.uniform(0, 3000, 400), 1))})
    pdf.loc[10:13, "start"] = pdf.loc[10, "start"]
    pdf = pdf.sort_values(["start", "asset", "lap"]).reset_index(drop=True)
    got = windows.lookback_interference(spark.createDataFrame(pdf), slice_seconds=60.0).toPandas().set_index("lap")
    for i, row in pdf.iterrows():
        before = pdf[:i]
        other = before[before["asset"] != row["asset"]]["start"]
        want = 0.0 if other.empty else min(max((2.0 - (row["start"] - other.iloc[-1])) / 1.6, 0.0), 1.0)
        assert got.loc[row["lap"], "interference"] == pytest.approx(want)


def test_mark_runs_breaks(spark):
    rows = [(1, 1, 1, 1, "A", 1.0), (1, 1, 2, 1, "A", 2.0), (1, 1, 3, 1, "B", 3.0), (1, 1, 4, 1, "B", 2.0), (1, 1, 5, 2, "B", 3.0), (1, 2, 1, 2, "B", 4.0)]
    df = spark.createDataFrame(rows, "session_id int, asset int, lap int, stint int, mode string, age double")
    for width in (1, 2, 100):
        got = [r.run_id for r in windows.mark_runs(df, width=width).orderBy("asset", "lap").collect()]
        assert got == [1, 1, 2, 3, 4, 5]


def test_elapsed_counts_gaps(spark):
    df = spark.createDataFrame([(1, 1, 3.0), (1, 1, 4.0), (1, 1, 9.0)], "asset int, run_id int, age double")
    assert sorted(r.elapsed for r in windows.elapsed(df).collect()) == [0.0, 1.0, 6.0]


def test_sticks_run_what_made_the_rows_once_and_move_them_once_more(spark):
    from wearframe.operators import shapes as sh

    ran = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            ran.add(len(pdf))
            yield pdf

    rows = [(g, float(x), 0.1 * x + 0.4 * max(x - 9 - g, 0) + 0.01 * ((x * 7) % 5)) for g in (0, 1) for x in range(1, 31)] + [(None, 1.0, 2.0)]
    laps = spark.createDataFrame(rows, "g long, age double, corrected double")
    want = {r.g: r for r in sh.fit_sticks(laps, ["g"], width=4).collect()}
    got = {r.g: r for r in sh.fit_sticks(laps.mapInPandas(counted, laps.schema), ["g"]).collect()}
    assert ran.value == len(rows) and got.keys() == want.keys() == {0, 1, None}
    assert [got[g].stick_tau for g in (0, 1, None)] == [want[g].stick_tau for g in (0, 1, None)] == [9.0, 10.0, None]
    assert all(abs(got[g].stick_rss - want[g].stick_rss) < 1e-9 and abs(got[g].stick_d - 0.4) < 0.01 for g in (0, 1))
