"""Storing sessions writes few files, whatever the number of tasks."""

import glob

from pyspark.sql import functions as F

from wearframe.sources import laps as src


def test_a_session_is_stored_in_one_file_by_all_tasks(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 16).select(
        (F.col("id") % 5).alias("session_id"), F.lit(2024).alias("year"), (F.col("id") % 3).alias("asset"), F.lit(1).alias("run_id"), F.col("id").cast("double").alias("age"))
    src.write_session(rows, rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")), str(tmp_path))
    assert len(glob.glob(f"{tmp_path}/laps/*/*/*.parquet")) == 5
    assert src.read_laps(spark, f"{tmp_path}/laps").count() == 4000
