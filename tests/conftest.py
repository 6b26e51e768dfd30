import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wearframe.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[8]", 8)
    s.conf.set("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def laps_pdf():
    """Four assets, two modes, one gap, seeded."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    rows = []
    for asset in range(4):
        age, run = 1 + asset % 2, 0
        start = age
        for seq in range(18):
            if seq == 8 + asset:
                run, age = 1, 1
                start = age
            if seq == 5 and asset == 2:
                age += 1
                continue
            mode = "A" if (asset + run) % 2 else "B"
            elapsed = age - start
            rate = 0.12 if mode == "A" else 0.05
            rows.append((0, asset, seq, asset * 10 + run, float(age), float(elapsed), 90 + rate * age - 0.08 * elapsed + rng.normal(0, 0.1), mode,
                         float(rng.uniform(0, 1)), len(rows)))
            age += 1
    return pd.DataFrame(rows, columns=["session_id", "asset", "seq", "run_id", "age", "elapsed", "perf", "mode", "interference", "event_id"])


@pytest.fixture
def laps(spark, laps_pdf):
    return spark.createDataFrame(laps_pdf)
