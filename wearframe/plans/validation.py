"""Practice against race for every event at once."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearframe.operators import rates
from wearframe.operators import statespace as ss
from wearframe.operators import stats as st
from wearframe.operators.staging import stage


def validate_transfer(practice: DataFrame, race: DataFrame, event: DataFrame, min_laps=8) -> DataFrame:
    """Fit both sides with the same priors and compare their mode rates.

    practice, race: lap tables; ``event`` maps session_id to event for both.
    No race row reaches the practice fit.
    """
    def side(laps, naive):
        fitted = stage(ss.mode_rates(ss.fit_sessions(laps)).where("rate IS NOT NULL"))
        counts = laps.groupBy("session_id", "mode").agg(F.count(F.lit(1)).alias("n_laps"))
        out = fitted.join(counts, ["session_id", "mode"]).join(event, "session_id")
        if naive:
            out = out.join(rates.naive_rates(laps).select("session_id", "mode", F.col("rate").alias("naive")), ["session_id", "mode"], "left")
        return out.groupBy("event", "mode").agg(
            F.avg("rate").alias("rate"), F.avg("rate_sd").alias("rate_sd"), F.max("n_laps").alias("n_laps"),
            *([F.avg("naive").alias("naive")] if naive else []),
        )

    return st.compare_rates(side(practice, True), side(race, False), ("event",), min_laps)
