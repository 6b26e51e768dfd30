"""Lap tables, manifests, nominations and results: reading, writing, bookkeeping."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearframe.operators import slices
from wearframe.operators.windows import elapsed

#: Relative labels as steps above an event's hardest nominated mode; fixed values.
LABEL_OFFSETS = {"HARD": 0, "MEDIUM": 1, "SOFT": 2}

MANIFEST = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("round_number", T.IntegerType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("session", T.StringType()),
    T.StructField("n_laps", T.LongType()),
    T.StructField("n_drivers", T.LongType()),
    T.StructField("quality_score", T.DoubleType()),
    T.StructField("compounds", T.ArrayType(T.StringType())),
])

NOMINATIONS = T.StructType([
    T.StructField("allocations", T.ArrayType(T.StructType([
        T.StructField("year", T.IntegerType()),
        T.StructField("round", T.IntegerType()),
        T.StructField("event", T.StringType()),
        T.StructField("hardest", T.IntegerType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("source", T.StringType()),
    ]))),
])

CALIBRATION = T.StructType([
    T.StructField("score", T.StringType()),
    T.StructField("alpha", T.DoubleType()),
    T.StructField("quantile", T.DoubleType()),
    T.StructField("bias", T.DoubleType()),
    T.StructField("n_calibration", T.LongType()),
    T.StructField("n_events", T.LongType()),
    T.StructField("seasons", T.ArrayType(T.IntegerType())),
    T.StructField("generated_at", T.StringType()),
])


def _stem(path_col="_metadata.file_name"):
    return F.regexp_replace(F.col(path_col), r"\.[^.]*$", "")


def read_laps(spark: SparkSession, path: str) -> DataFrame:
    """Stored laps. ``elapsed`` is always recomputed from age, so filtered gaps still count."""
    laps = spark.read.parquet(path)
    keys = ["session_id", "asset", "run_id"] if "session_id" in laps.columns else ["asset", "run_id"]
    return elapsed(laps, keys)


def write_session(laps: DataFrame, quality: DataFrame, path: str) -> None:
    """Stores sessions: laps by year and session, quality as its own table by session.

    Only the partitions that come are replaced, so sessions stored before stay, and one that is stored again has its new rows only.
    Rows of a session are brought together first: else every task writes a file of its own into every folder. A large session is dealt over several tasks.
    """
    for table, folder, keys in ((laps, "laps", ["year", "session_id"]), (quality, "quality", ["session_id"])):
        table.hint("rebalance", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{path}/{folder}")


def cached(build, spark: SparkSession, path: str, refit=False) -> DataFrame:
    """The table stored at ``path``; built and stored first if absent or ``refit``.

    ``build`` returns the DataFrame. An absent path is the only read error
    taken to mean "not stored yet".
    """
    from pyspark.errors import AnalysisException

    if not refit:
        try:
            return spark.read.parquet(path)
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def stored_sessions(spark: SparkSession, directory: str) -> DataFrame:
    """Names of the session files or partitions under a directory."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    parts = F.split(F.col("path"), "/")
    partition = F.filter(parts, lambda p: p.startswith("session_id="))
    name = F.when(F.size(partition) > 0, F.substring_index(F.get(partition, F.lit(0)), "=", -1)).otherwise(F.regexp_replace(F.element_at(parts, -1), r"\.parquet$", ""))
    return reader.load(directory).select(F.url_decode(name).alias("session_id")).distinct()


def read_manifest(spark: SparkSession, directory: str, name="corpus.json") -> DataFrame:
    """Manifest records that have a stored file."""
    records = spark.read.schema(MANIFEST).json(f"{directory}/{name}", multiLine=True)
    return records.join(stored_sessions(spark, directory), "session_id", "left_semi")


def catalogue_from_names(names: DataFrame) -> DataFrame:
    """Identity read off a file stem: leading year or 0, session after the last hyphen, round 0."""
    stem = F.col("session_id")
    head = F.substring(stem, 1, 4)
    return names.select(
        "session_id",
        F.when(head.rlike("^[0-9]{4}$"), head.cast("int")).otherwise(0).alias("year"),
        F.lit(0).alias("round_number"),
        stem.alias("event_name"),
        F.substring_index(stem, "-", -1).alias("session"),
    )


def catalogue_from_files(spark: SparkSession, directory: str) -> DataFrame:
    """Catalogue of a directory that has no manifest."""
    return catalogue_from_names(stored_sessions(spark, directory))


def session_slug(year, event, session):
    """Column: year-event-session, the event lower-cased with hyphens for spaces."""
    return F.concat_ws("-", F.col(year).cast("string"), F.replace(F.lower(event), F.lit(" "), F.lit("-")), F.col(session))


def select_sessions(manifest: DataFrame, lap_counts: DataFrame, session_type="R", limit=0, min_laps=100,
                    years=None) -> DataFrame:
    """Sessions by season descending, round ascending, id; the lap floor applies before the limit."""
    found = manifest
    if session_type is not None:
        found = found.where(F.col("session") == session_type)
    if years:
        found = found.where(F.col("year").isin(*years))
    if min_laps:
        found = found.join(
            lap_counts.where(F.col("n") >= min_laps).select("session_id"), "session_id", "left_semi"
        )
    ordered = found.orderBy(F.desc("year"), "round_number", "session_id")
    return ordered.limit(limit) if limit else ordered


def load_selected(laps: DataFrame, selected: DataFrame) -> DataFrame:
    """All laps of the selected sessions, in one table."""
    return laps.join(selected.select("session_id"), "session_id", "left_semi")


def read_nominations(spark: SparkSession, path: str) -> DataFrame:
    """Nominated modes per event; a hardest mode outside 1..3 is an error."""
    rows = spark.read.schema(NOMINATIONS).json(path, multiLine=True).select(F.inline("allocations"))
    return check_nominations(rows)


def check_nominations(rows: DataFrame) -> DataFrame:
    bad = ~F.col("hardest").between(1, 3) | F.col("hardest").isNull()
    return rows.withColumn(
        "hardest",
        F.when(bad, F.raise_error(F.format_string("round %s of %s: hardest mode out of range", "round", "year")))
        .otherwise(F.col("hardest")).cast("int"),
    )


def nomination_coverage(nominations: DataFrame) -> DataFrame:
    """Absolute mode of each relative label, per event in calendar order."""
    mode = lambda k: F.concat(F.lit("C"), (F.col("hardest") + k).cast("string"))
    return nominations.select(
        "year", "round", "event",
        *[mode(step).alias(label.lower()) for label, step in LABEL_OFFSETS.items()], "confidence",
    ).orderBy("year", "round")


def annotate_mode(laps: DataFrame, nominations: DataFrame, offsets=None) -> DataFrame:
    """Absolute mode id from the event's nomination; null when either is unknown.

    ``nominations`` has one row per (year, round), a season calendar. The join
    is left to the optimizer.
    """
    offset = F.lit(None).cast("int")
    for label, step in (offsets or LABEL_OFFSETS).items():
        offset = F.when(F.upper("mode") == label, F.lit(step)).otherwise(offset)
    joined = laps.join(nominations.select("year", "round", "hardest"), ["year", "round"], "left")
    return joined.withColumn(
        "mode_id", F.concat(F.lit("C"), (F.col("hardest") + offset).cast("string"))
    ).drop("hardest")


def ingest_plan(schedule: DataFrame, sessions, existing: DataFrame) -> DataFrame:
    """Candidate sessions not stored yet: by session priority, newest season, round.

    Each event carries its handful of session codes, so this explodes a short
    constant array rather than joining.
    """
    order = F.array(*[F.lit(s) for s in sessions])
    plan = schedule.withColumn("session", F.explode(order)).withColumn(
        "session_id", session_slug("year", "event_name", "session")
    )
    return plan.join(existing.select("session_id"), "session_id", "left_anti").orderBy(
        F.array_position(order, F.col("session")), F.desc("year"), "round_number"
    )


def session_entry(laps: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """Summary record per stored session."""
    out = laps.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_laps"),
        F.count_distinct("asset").alias("n_assets"),
        F.array_sort(F.collect_set("mode")).alias("modes"),
    )
    return out if quality is None else out.join(quality.select("session_id", "score"), "session_id", "left")


def corpus_totals(manifest: DataFrame) -> DataFrame:
    """Laps, event-seasons (year and event, since names repeat) and seasons."""
    return manifest.agg(
        F.sum("n_laps").alias("n_laps"),
        F.count_distinct(F.struct("year", "event_name")).alias("n_events"),
        F.count_distinct("year").alias("n_seasons"),
    )


def lineups(results: DataFrame) -> DataFrame:
    """Asset to team per event as a map; rows without either are dropped."""
    named = results.where("asset IS NOT NULL AND team IS NOT NULL").select("year", "round", "asset", "team").distinct()
    return named.groupBy("year", "round").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("asset", "team")))).alias("lineup")
    )


def with_team(rows: DataFrame, results: DataFrame) -> DataFrame:
    """Attach the team an asset ran for at that event."""
    teams = results.select("year", "round", "asset", "team").distinct()
    return rows.join(teams, ["year", "round", "asset"], "left")


def upsert_features(existing: DataFrame, new: DataFrame, key=("year", "circuit"), full="lateral_energy") -> DataFrame:
    """New rows replace old ones that lack energetics; complete old rows stay."""
    complete = existing.where(F.col(full).isNotNull() & (F.col(full) != 0))
    added = new.join(complete.select(*key), list(key), "left_anti")
    untouched = existing.join(added.select(*key), list(key), "left_anti")
    return untouched.unionByName(added)


def session_catalogue(manifest: DataFrame | None, stored: DataFrame) -> DataFrame:
    """Manifest entries with a ``cached`` flag, cached ones first; without a manifest, what the stored names say."""
    manifest = catalogue_from_names(stored) if manifest is None else manifest
    files = stored.select("session_id").distinct().withColumn("_here", F.lit(True))
    return manifest.join(files, "session_id", "left").withColumn(
        "cached", F.coalesce("_here", F.lit(False))
    ).drop("_here").orderBy(F.desc("cached"), "session_id")


def catalogue_health(catalogue: DataFrame) -> DataFrame:
    """Counts behind the health report."""
    return catalogue.agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count_if("cached").alias("cached"),
        F.coalesce(F.bool_and("cached"), F.lit(False)).alias("offline_ready"),
    )


def save_calibration(calibration: DataFrame, path: str) -> None:
    calibration.coalesce(1).write.mode("overwrite").json(path)


def load_calibration(spark: SparkSession, path: str) -> DataFrame:
    """The stored calibrator. Unknown fields are ignored; a missing path raises."""
    return spark.read.schema(CALIBRATION).json(path)


def read_results(spark: SparkSession, directory: str) -> DataFrame:
    """Recorded result files as (name, body); files that do not parse are skipped."""
    text = spark.read.text(directory, wholetext=True, pathGlobFilter="*.json").select(
        _stem().alias("name"), F.col("value").alias("body")
    )
    return text.where(F.try_parse_json("body").isNotNull())


def lookup_circuit(names: DataFrame, circuits: DataFrame) -> DataFrame:
    """Case-insensitive circuit lookup, with how many circuits there are; ``circuits`` itself lists what an unmeasured name could have been."""
    available = circuits.agg(F.count_distinct("circuit"))
    keyed = circuits.withColumn("_key", F.lower("circuit")).withColumnRenamed("circuit", "measured_circuit")
    out = names.withColumn("_key", F.lower("circuit")).join(keyed, "_key", "left").drop("_key")
    return out.withColumn("measured", F.col("measured_circuit").isNotNull()).withColumn("n_available", available.scalar())


def match_events(asked: DataFrame, recorded: DataFrame) -> DataFrame:
    """Asked names contained in a recorded name or the reverse, ignoring case.

    The shorter name's first three letters (or all it has) must occur in the
    longer one, so names meet by that key and are then compared in full.
    """
    def held(df, name):
        text = F.lower(name)
        cut = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(text, i, F.lit(k)))
        runs = [cut(k) for k in (1, 2, 3)]
        return df.withColumn("_key", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *runs))))

    def start(df, name):
        return df.withColumn("_key", F.substring(F.lower(name), 1, 3))

    inside = start(asked, "asked").join(held(recorded, "recorded"), ["year", "_key"]).where(F.contains(F.lower("recorded"), F.lower("asked")))
    around = held(asked, "asked").join(start(recorded, "recorded"), ["year", "_key"]).where(F.contains(F.lower("asked"), F.lower("recorded")))
    return inside.drop("_key").unionByName(around.drop("_key")).distinct()


def paired_events(manifest: DataFrame, conditions: DataFrame, practice="FP2") -> DataFrame:
    """Events having both a practice and a race session, minus those known to be wet."""
    both = manifest.groupBy("year", "event_name").agg(
        F.bool_or(F.col("session") == practice).alias("_p"), F.bool_or(F.col("session") == "R").alias("_r")
    ).where("_p AND _r").select("year", "event_name")
    wet = conditions.where("NOT is_dry").select("year", "event_name")
    return both.join(wet, ["year", "event_name"], "left_anti")


def with_features(estimates: DataFrame, features: DataFrame, keys=("year", "round")) -> DataFrame:
    """Estimates with the features of their round; an estimate without features is left out."""
    return estimates.join(features, list(keys))


def with_conditions(estimates: DataFrame, conditions: DataFrame) -> DataFrame:
    """Race conditions attached to estimates. Practice rows are left out first, and a
    key that still repeats is an error, so no estimate can be duplicated."""
    race = conditions.where("session = 'R'").groupBy("year", "round").agg(
        F.count(F.lit(1)).alias("_n"), F.first("track_temp").alias("track_temp"), F.first("is_dry").alias("is_dry")
    )
    checked = race.withColumn(
        "track_temp",
        F.when(F.col("_n") > 1, F.raise_error(F.format_string("round %s of %s described twice", "round", "year")))
        .otherwise(F.col("track_temp")).cast("double"),
    ).drop("_n")
    return estimates.join(checked, ["year", "round"], "left")


def not_stored(candidates: DataFrame, existing: DataFrame, keys=("session_id",)) -> DataFrame:
    """Candidates with no stored row yet."""
    return candidates.join(existing.select(*keys), list(keys), "left_anti")


def read_cycles(spark: SparkSession, path: str, n_sensors=21) -> DataFrame:
    """Headerless whitespace-delimited engine cycles; extra trailing columns are ignored."""
    parts = F.split(F.trim("value"), r"\s+")
    names = ["unit", "cycle", "setting_1", "setting_2", "setting_3"] + [f"sensor_{i}" for i in range(1, n_sensors + 1)]
    kinds = ["int", "int"] + ["double"] * (3 + n_sensors)
    rows = spark.read.text(path).where(F.trim("value") != "").withColumn("_p", parts)
    return rows.select(*[F.try_element_at("_p", F.lit(i + 1)).cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds))])


def read_rul(spark: SparkSession, path: str, test: DataFrame) -> DataFrame:
    """Remaining-life labels: the n-th line belongs to the n-th smallest unit id.

    One line per unit, so both sides are as small as the fleet.
    """
    lines = spark.read.text(path, wholetext=True).select(
        F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")).alias("_k", "_line")
    ).select((F.col("_k") + 1).alias("_k"), F.element_at(F.split(F.trim("_line"), r"\s+"), 1).cast("double").alias("rul"))
    spread = test.select("unit").distinct().withColumn("_all", F.lit(0)).withColumn("_slice", F.floor(F.col("unit") / 1024))
    units = slices.positions(spread, ["_all"], "_slice", ["unit"], name="_k").select("unit", "_k")
    return units.join(lines, "_k").select("unit", "rul")
