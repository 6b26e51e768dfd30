"""Boosted trees over packed rows against Spark ML's."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wearframe.operators import boosting as bo
from wearframe.operators import folds as fo


def test_first_state_is_that_of_the_generator():
    assert bo._start(5) == -983371857858525063 + (1 << 64)
    one = np.array([bo._start(7)], dtype=np.uint64)
    for state in bo.states(7, 3000):
        one = bo._step(one)
        assert state == one[0]


@pytest.mark.parametrize("n, task", [(700, 1 << 20), (11_000, 4_000)])
def test_trees_are_those_of_spark_ml(spark, tmp_path, monkeypatch, n, task):
    """By one task and by several, with all rows and with a sample for the bins; a piece is a part of a block."""
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    monkeypatch.setattr(bo, "TASK", task)
    monkeypatch.setattr(bo, "CUT", 2)
    monkeypatch.setattr(bo, "PIECE", 300)
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": rng.integers(0, 5, n), "c": rng.integers(-90, 90, n) * 1.0, "mode": np.array(list("ABCD"))[rng.integers(0, 4, n)]})
    pdf["y"] = 2 * pdf.a + pdf.b + 2 * (pdf["mode"] == "C") + np.sin(pdf.c / 9) + rng.normal(size=n)
    spark.createDataFrame(pdf).repartition(5).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    rows = StringIndexer(inputCol="mode", outputCol="code", handleInvalid="keep").fit(rows).transform(rows)
    features = ["a", "b", "code", "c"]
    vectors = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    theirs = GBTRegressor(labelCol="y", maxIter=5, maxDepth=4, stepSize=0.05, subsamplingRate=0.9, seed=0).fit(vectors).transform(vectors)
    model = bo.fit(rows, "y", features, {"code": 5}, 5, 4)
    ours = bo.predict(rows, features, model, ["a", "mode"]).toPandas().sort_values("a")
    assert np.allclose(ours["prediction"], theirs.select("a", "prediction").toPandas().sort_values("a")["prediction"], rtol=0, atol=1e-9)


def test_missing_numbers_and_no_rows_are_refused(spark):
    rows = spark.createDataFrame([(1.0, None, 0.0), (2.0, 1.0, 0.0)], "a double, y double, code double")
    with pytest.raises(Exception, match="must not be null"):
        bo.fit(rows, "y", ["a", "code"], {"code": 2}, 2, 2)
    with pytest.raises(ValueError, match="no rows"):
        bo.fit(rows.where("a > 5"), "y", ["a", "code"], {"code": 2}, 2, 2)


def test_rounds_of_few_rows_are_one_job(spark, laps):
    from wearframe.operators import windows

    prepared = fo._boosted_rows(laps, windows.rolling_folds(laps), 1)
    sc = spark.sparkContext
    sc.setJobGroup("boosted", "rounds")
    try:
        assert fo._boosted_fit(prepared, 25, 4).where(F.col("mean").isNull()).count() == 0
        assert len(sc.statusTracker().getJobIdsForGroup("boosted")) < 25
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
