"""Tables that grow with the input are not collected to be broadcast, however small they look."""

import pytest

from wearframe.operators import clean, decide
from wearframe.operators.staging import stage


def _physical(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.fixture
def cases(spark):
    rows = [(i, "A", 5.0 + i, 0.1, 0.01, 0.5, 12.0, i, 20 + i, 90.0, 21.0, 1.0, 0.05, 0.02, 0.1, 15.0) for i in range(3)]
    return stage(spark.createDataFrame(
        rows, "case_id long, mode string, age double, rate double, rate_sd double, base_pace double, cliff_age double, now long, total long, base double, "
        "stop_loss double, gap_ahead double, new_rate double, new_rate_sd double, new_base_pace double, new_cliff_age double"))


def test_decisions_broadcast_no_cases(cases):
    table = decide.outcomes(cases, decide.default_options(cases))
    best = table.where("position = 1").selectExpr("case_id", "option AS recommended", "'Stay out' AS actual")
    sweep = decide.outcomes(cases, decide.sweep_plan(cases))
    for df, n in ((table, 15), (sweep, 63), (decide.recommend(cases, table), 3), (decide.stop_window(sweep), 3), (decide.regret(table, best), 3)):
        assert "Broadcast" not in _physical(df)
        assert df.count() == n


def test_resolved_events_broadcast_no_calendar(spark):
    calendar = spark.createDataFrame(
        [(1, "North Ring Open", "Hill", ""), (1, "North Ring Open", "Hill", ""), (1, "Lake Ring", "Ringtown", ""), (2, "Lake Cup", "Shore", "")],
        "year int, event string, location string, country string")
    asked = spark.createDataFrame([(1, "ring"), (1, "Nr"), (2, "ringtown"), (2, "shore-line"), (1, "NR one")], "year int, requested string")
    aliases = spark.createDataFrame([("nr one", "North Ring Open")], "alias string, event string")
    out = clean.resolve_events(stage(asked), stage(calendar), stage(aliases))
    held = [line for line in _physical(out).splitlines() if "BroadcastHashJoin" in line and ("_run" in line or "LeftSemi" in line)]
    assert held == []
    assert {(r.year, r.requested): (r.event, r.how) for r in out.collect()} == {
        (1, "ring"): ("Lake Ring", "words"), (1, "Nr"): (None, "no match"), (2, "ringtown"): (None, "no match"),
        (2, "shore-line"): ("Lake Cup", "words"), (1, "NR one"): ("North Ring Open", "alias")}
