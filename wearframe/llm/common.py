"""Helpers shared by the text operators: intermediate tables, null-safe keys, Arrow text batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words (fixed value): space and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only on one machine where that is unset (tests) a local one of this application."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and master.startswith("local") and not master.startswith("local-cluster"):
        named = f"/tmp/wearframe/{spark.sparkContext.applicationId}"
    if not named:
        raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    return named.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: lineage ends there, and the table is computed once."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def key_of(column: Column) -> Column:
    """A non-null string that differs for null and for every value, so that ordinary equality joins keep nulls."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


def aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[..., DataFrame]]:
    """`docs` under names that clash with nothing, where each (lower-case) column went, and a function that takes the columns back and adds others.

    For steps that return the rows of their input as they were, whatever its columns are called.
    """
    names = docs.columns
    hidden = [f"__in_{i}" for i in range(len(names))]

    def back(df: DataFrame, *added: str) -> DataFrame:
        new = {c.lower() for c in added}
        return df.select(*[F.col(h).alias(c) for h, c in zip(hidden, names, strict=True) if c.lower() not in new], *added)

    return docs.toDF(*hidden), {c.lower(): h for h, c in zip(reversed(hidden), reversed(names), strict=True)}, back


def words_in(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def utf8_bytes(column) -> list[bytes | None]:
    """The cells of an Arrow string array as UTF-8 bytes, without decoding."""
    import pyarrow as pa

    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


#: Bytes whose characters end words become a space, A-Z become a-z; word characters are 0-9, a-z and all non-ASCII.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text that are cut into words at a time.
PART = 1 << 20


def each_utf8(column) -> Iterator[bytes | None]:
    """The cells of an Arrow string array as UTF-8 bytes, one at a time."""
    import pyarrow as pa

    for cell in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()):
        yield cell.as_py()


def word_parts(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text (A-Z lower-cased) in lists from about `PART` bytes each, so that a long text is never held as words."""
    at = 0
    while at < len(raw):
        stop = min(at + PART, len(raw))
        folded = raw[at:stop].translate(FOLD)
        while stop < len(raw) and folded[-1] != 32:
            # a word goes on: take bytes until it ends
            more = raw[stop : stop + PART].translate(FOLD)
            cut = more.find(b" ")
            cut = len(more) if cut < 0 else cut + 1
            folded += more[:cut]
            stop += cut
        yield folded.split()
        at = stop
