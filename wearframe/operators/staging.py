"""Cutting long lineages with written tables.

A plan that reads the same intermediate many times is both slow to plan and
slow to recompute after a lost executor. ``stage`` writes it once to the shared
folder the cluster names in ``spark.checkpoint.dir`` and reads it back.
"""

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """The folder named in ``spark.checkpoint.dir``, which all executors must share; on one machine without that setting, a folder of this application."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        folder = f"/tmp/wearframe/{spark.sparkContext.applicationId}"
    if not folder:
        raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    return folder.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """The same rows, read back from a table written to the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/wearframe/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows hashed by ``keys`` over all shuffle partitions, for work that is heavy per row.

    Adaptive execution merges partitions by their bytes, which would put many
    small but slow groups into one task; a fixed partition count is left alone.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}


def _column(values, kind) -> pa.Array:
    """One column of results; what is not a number becomes null."""
    values = np.asarray(values)
    if values.dtype.kind == "f" and pa.types.is_integer(kind):
        return pa.array(values, from_pandas=True).cast(kind)
    return pa.array(values, type=kind, from_pandas=True)


def by_groups(rows: DataFrame, keys, work, schema: str, groups=64, most=100_000) -> DataFrame:
    """Like a grouped map, but ``work`` gets several whole groups at a time and returns one result (columns by name) for each.

    ``work`` takes a list of (key, pandas rows). Groups arrive one after another in a partition hashed and sorted by ``keys``; they are
    handed over when there are ``groups`` of them or they hold ``most`` rows, so a task never holds more than that besides its largest group.
    """
    keys, fields = list(keys), [(c.split()[0], _ARROW[c.split()[1]]) for c in schema.split(", ")]

    def emit(found):
        for result in work([(key, pa.Table.from_batches(parts).to_pandas()) for key, parts in found]):
            columns = [_column(result[name], kind) for name, kind in fields]
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays(columns, names=[name for name, _ in fields])

    def run(batches):
        found, held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [batch.column(batch.schema.get_field_index(c)) for c in keys]
            codes = np.stack([c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in codes])
            cuts = [0, *(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                key = tuple(batch.column(batch.schema.get_field_index(c))[lo].as_py() for c in keys)
                if found and found[-1][0] == key:
                    found[-1][1].append(batch.slice(lo, hi - lo))
                else:
                    if len(found) >= groups or held >= most:
                        yield from emit(found)
                        found, held = [], 0
                    found.append((key, [batch.slice(lo, hi - lo)]))
                held += hi - lo
        if found:
            yield from emit(found)

    return spread(rows, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
