import json

import pytest
from pyspark.sql import functions as F

from wearframe.operators import staging
from wearframe.sources import laps as src


def test_sessions_round_trip(spark, laps, tmp_path):
    stored = laps.withColumn("year", F.lit(2024)).withColumn("elapsed", F.lit(-1.0))
    quality = spark.createDataFrame([(0, 80.0)], "session_id int, score double")
    src.write_session(stored, quality, str(tmp_path))
    back = src.read_laps(spark, str(tmp_path / "laps"))
    assert back.count() == laps.count() and back.where("elapsed < 0").count() == 0
    assert back.where("session_id = 0 AND year = 2024").count() == laps.count()


def test_storing_one_session_keeps_the_others(spark, laps, tmp_path):
    one = laps.withColumn("year", F.lit(2024))
    quality = lambda s, score: spark.createDataFrame([(s, score)], "session_id int, score double")
    src.write_session(one, quality(0, 80.0), str(tmp_path))
    src.write_session(one.withColumn("session_id", F.lit(7)), quality(7, 70.0), str(tmp_path))
    src.write_session(one.where("asset < 2"), quality(0, 60.0), str(tmp_path))
    counts = {r.session_id: r["count"] for r in src.read_laps(spark, str(tmp_path / "laps")).groupBy("session_id").count().collect()}
    assert counts == {0: laps.where("asset < 2").count(), 7: laps.count()}
    assert {(r.session_id, r.score) for r in spark.read.parquet(str(tmp_path / "quality")).collect()} == {(0, 60.0), (7, 70.0)}


def test_manifest_and_catalogue(spark, laps, tmp_path):
    for name in ("2023-x-R", "demo-FP2"):
        laps.limit(2).toPandas().to_parquet(tmp_path / f"{name}.parquet")
    records = [{"session_id": s, "year": 2023, "round_number": 1, "event_name": "X", "session": "R", "compounds": ["A"]} for s in ("2023-x-R", "2023-gone-R")]
    (tmp_path / "corpus.json").write_text(json.dumps(records))
    assert [r.session_id for r in src.read_manifest(spark, str(tmp_path)).collect()] == ["2023-x-R"]
    cat = {r.session_id: (r.year, r.session, r.round_number) for r in src.catalogue_from_files(spark, str(tmp_path)).collect()}
    assert cat == {"2023-x-R": (2023, "R", 0), "demo-FP2": (0, "FP2", 0)}


def test_nominations_are_checked(spark, tmp_path):
    row = {"year": 2024, "round": 1, "event": "X", "hardest": 2, "confidence": "high", "source": "s"}
    path = tmp_path / "n.json"
    path.write_text(json.dumps({"allocations": [row]}))
    cov = src.nomination_coverage(src.read_nominations(spark, str(path))).first()
    assert (cov.hard, cov.medium, cov.soft) == ("C2", "C3", "C4")
    path.write_text(json.dumps({"allocations": [row | {"hardest": 4}]}))
    with pytest.raises(Exception, match="out of range"):
        src.read_nominations(spark, str(path)).collect()


def test_cycles_and_labels(spark, tmp_path):
    (tmp_path / "c.txt").write_text("2 1 0.1 0.2 100 " + " ".join(["1.5"] * 21) + "  \n5 1 0 0 100 " + " ".join(["2"] * 21) + "\n")
    (tmp_path / "r.txt").write_text("112\n98 \n")
    cycles = src.read_cycles(spark, str(tmp_path / "c.txt"))
    assert [(r.unit, r.cycle, r.sensor_21) for r in cycles.orderBy("unit").collect()] == [(2, 1, 1.5), (5, 1, 2.0)]
    assert {r.unit: r.rul for r in src.read_rul(spark, str(tmp_path / "r.txt"), cycles).collect()} == {2: 112.0, 5: 98.0}


def test_results_skip_broken_files(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"verdict": "fine"}')
    (tmp_path / "bad.json").write_text('{"verdict": ')
    assert [r.name for r in src.read_results(spark, str(tmp_path)).collect()] == ["good"]


def test_calibration_round_trip(spark, tmp_path):
    cal = spark.createDataFrame([("absolute", 0.05, 0.2, 0.02, 94, 42, "extra")],
                                "score string, alpha double, quantile double, bias double, n_calibration long, n_events long, unknown string")
    src.save_calibration(cal, str(tmp_path / "c"))
    back = src.load_calibration(spark, str(tmp_path / "c")).first()
    assert back.quantile == 0.2 and "unknown" not in back.asDict()
    with pytest.raises(Exception):
        src.load_calibration(spark, str(tmp_path / "absent")).collect()


def test_cached_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "t")
    for _ in range(2):
        assert src.cached(build, spark, path).count() == 3
    src.cached(build, spark, path, refit=True)
    assert len(calls) == 2


def test_repeated_conditions_raise(spark):
    est = spark.createDataFrame([(1, 1, 0.1)], "year int, round int, rate double")
    cond = spark.createDataFrame([(1, 1, "R", 30.0, True), (1, 1, "R", 31.0, True)], "year int, round int, session string, track_temp double, is_dry boolean")
    with pytest.raises(Exception, match="twice"):
        src.with_conditions(est, cond).collect()


def test_stage_uses_the_named_folder(spark):
    folder = staging.shared_folder(spark)
    files = staging.stage(spark.range(5)).inputFiles()
    assert all(folder in f for f in files)
