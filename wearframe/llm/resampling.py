"""Importance resampling towards a target: array-scored weights, then a distributed least-significant-digit radix sort.

Hashed word runs of the corpus and of the target are counted per bucket (one small array a partition, added up by Spark). A document's weight is the sum of its
buckets' gains, looked up in an array; a fixed noise of its id turns the highest scores into a draw without replacement. Ranks come from stable
counting-sort passes over the digits of (score, id, number of features), lowest digit first. A pass counts digits per block of rows, adds the counts up
to global prefix offsets, and moves each row to its offset plus its place among the block's rows of that digit. Blocks have a fixed number of rows, so
neither a common digit nor a common score is one task's work, and only narrow rows are shuffled.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf
from pyspark.sql.pandas.types import from_arrow_type

from wearframe.llm.common import aside, each_utf8, staged, word_parts

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: Different word runs whose buckets a worker remembers.
KNOWN = 1 << 18
#: Rows of a block of the sort: 2 to this power; bits of a digit at most.
BLOCK_BITS = 16
DIGIT_BITS = 11

SCORED = pa.struct([("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64())])


class Hasher:
    """Buckets of word runs; remembers those it has met, up to a bound."""

    def __init__(self, buckets: int, longest: int):
        self.buckets, self.longest, self.known = buckets, longest, {}

    def of(self, raw: bytes | None) -> Iterator[tuple[int, np.ndarray]]:
        """(words, buckets of the runs that end among them) per part of a text."""
        before: list[bytes] = []
        for words in word_parts(raw or b""):
            line, first = before + words, len(before)
            found: list[int] = []
            known = self.known
            for n in range(1, self.longest + 1):
                runs = words if n == 1 else [b" ".join(line[i - n + 1 : i + 1]) for i in range(max(first, n - 1), len(line))]
                try:
                    found += [known[w] for w in runs]
                except KeyError:
                    fresh = {w: zlib.crc32(w) % self.buckets for w in set(runs) if w not in known}
                    if len(known) + len(fresh) > KNOWN:
                        known.clear()
                        fresh = {w: zlib.crc32(w) % self.buckets for w in set(runs)}
                    known |= fresh
                    found += [known[w] for w in runs]
            yield len(words), np.array(found, np.int64)
            before = line[len(line) - self.longest + 1 :] if self.longest > 1 else []


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = 1) -> np.ndarray:
    """How many features of all texts fall into each bucket. The driver gets one number a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = Hasher(buckets, longest), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in each_utf8(batch.column(0)):
                for _, found in hasher.of(text):
                    total += np.bincount(found, minlength=buckets)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(total[filled])], names=["bucket", "n"])

    counted = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed bucket shares, rounded down."""
    all_s, all_t, n = float(source.sum()), float(target.sum()), len(source)
    ratio = [(t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n)) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def noise(digest: str) -> int:
    """Gumbel noise in thousandths, from the first 8 hex digits of a digest."""
    return math.floor(-1000 * math.log(-math.log((int(digest[:8], 16) + 0.5) / 4294967296)))


def scores(gain: np.ndarray, id_col: str, text_col: str, longest: int = 1, seed: int = SEED) -> Column:
    """n_words, n_features, weight and score of a document. Null texts have no words; a null id counts as the word null."""

    @arrow_udf(from_arrow_type(SCORED))
    def scored(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        hasher = Hasher(len(gain), longest)
        for digests, texts in columns:
            rows = []
            for digest, text in zip(digests.to_pylist(), each_utf8(texts), strict=True):
                words = features = weight = 0
                for n, found in hasher.of(text):
                    words, features, weight = words + n, features + len(found), weight + int(gain[found].sum())
                rows.append({"n_words": words, "n_features": features, "weight": weight, "score": weight + noise(digest)})
            yield pa.array(rows, SCORED)

    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return scored(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), F.col(text_col).cast("string"))


def ordered_bits(key: Column, low: int, high: int, descending: bool) -> tuple[Column, int]:
    """`key` (long, from `low` to `high`) as bits whose unsigned order is the wanted one, and how many bits matter."""
    if high - low < 1 << 63:
        return (F.lit(high) - key if descending else key - F.lit(low)), (high - low).bit_length()
    flipped = key.bitwiseXOR(F.lit(-(1 << 63)))
    return (F.bitwise_not(flipped) if descending else flipped), 64


def one_pass(rows: DataFrame, digit: Column, block_bits: int) -> DataFrame:
    """A stable counting-sort pass: `__at` (place, any distinct numbers the first time) becomes the place in digit order."""
    cut = rows.withColumn("__block", F.shiftright("__at", block_bits)).withColumn("__digit", digit.cast("int"))
    counts = staged(cut.groupBy("__block", "__digit").agg(F.count(F.lit(1)).alias("__n")), "digit-counts")
    smaller = Window.orderBy("__digit").rowsBetween(Window.unboundedPreceding, -1)
    # one row a digit value: at most 2 to the power of DIGIT_BITS
    base = counts.groupBy("__digit").agg(F.sum("__n").alias("__all")).select("__digit", F.coalesce(F.sum("__all").over(smaller), F.lit(0)).alias("__base"))
    earlier = Window.partitionBy("__digit").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).join(F.broadcast(base), "__digit")
    offsets = offsets.select("__block", "__digit", (F.col("__base") + F.col("__before")).alias("__offset"))
    place = F.row_number().over(Window.partitionBy("__block", "__digit").orderBy("__at"))
    moved = cut.join(offsets, ["__block", "__digit"]).withColumn("__to", F.col("__offset") + place - 1)
    return moved.drop("__at", "__block", "__digit", "__offset").withColumnRenamed("__to", "__at")


def radix_ranks(rows: DataFrame, keys: list[tuple[str, bool]], *, block_bits: int = BLOCK_BITS, digit_bits: int = DIGIT_BITS) -> tuple[DataFrame, int]:
    """(`rows` with `rank` from 1 in the order of `keys`, number of rows). Keys are (long column, descending), first key first; nulls come last.

    All columns travel through every pass: give narrow rows. Rows equal in all keys are ranked in an arbitrary but gapless way.
    """
    rows = staged(rows.withColumn("__at", F.monotonically_increasing_id()), "radix-rows")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{name}{i}") for i, (c, _) in enumerate(keys) for name, f in (("low", F.min), ("high", F.max), ("held", F.count))]).first()
    for i, (name, descending) in reversed(list(enumerate(keys))):
        digits: list[Column] = []
        if facts[f"held{i}"]:
            key, bits = ordered_bits(F.coalesce(F.col(name), F.lit(facts[f"low{i}"])), facts[f"low{i}"], facts[f"high{i}"], descending)
            passes = -(-bits // digit_bits)
            step = -(-bits // passes) if passes else 0
            digits = [F.shiftrightunsigned(key, at * step).bitwiseAND(F.lit((1 << step) - 1)) for at in range(passes)]
            if facts[f"held{i}"] < facts["n"]:
                digits.append(F.isnull(name).cast("int"))
        for digit in digits:
            rows = staged(one_pass(rows, digit, block_bits), "radix-rows")
    if facts["n"] and not any(facts[f"high{i}"] != facts[f"low{i}"] or facts[f"held{i}"] < facts["n"] for i in range(len(keys))):
        # all keys are equal: one pass over a constant digit only numbers the rows
        rows = staged(one_pass(rows, F.lit(0), block_bits), "radix-rows")
    return rows.withColumn("rank", F.col("__at") + 1).drop("__at"), facts["n"]


def score_documents(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, longest: int = 1, seed: int = SEED) -> DataFrame:
    """Adds `__scored` (n_words, n_features, weight, score) to every document. An empty corpus or target has zero counts, which smoothing allows."""
    gain = gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_col, buckets, longest))
    return docs.withColumn("__scored", scores(gain, id_col, text_col, longest, seed))


def rank_documents(docs: DataFrame, target: DataFrame, *, least_words: int = LEAST_WORDS, percent: int = PERCENT, block_bits: int = BLOCK_BITS, digit_bits: int = DIGIT_BITS, **options) -> DataFrame:
    """doc_id, n_features, weight, score and rank (1 is the highest score, ties to the smaller id; null if not drawn) of every row of `docs`.

    Of the N documents with at least `least_words` words, floor(percent * N / 100) are drawn. Ids are integers; a null id comes last among equal scores.
    Null and empty texts have no words and weight 0. Repeated rows are ranked each. Other columns are not read.
    """
    narrow = staged(score_documents(docs.select("doc_id", "text"), target, **options).select("doc_id", "__scored.*"), "scored")
    kept = ["doc_id", "n_features", "weight", "score"]
    fit = narrow.filter(F.col("n_words") >= least_words).select(*kept)
    ranked, n = radix_ranks(fit, [("score", True), ("doc_id", False), ("n_features", False)], block_bits=block_bits, digit_bits=digit_bits)
    drawn = ranked.withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    return drawn.unionByName(narrow.filter(F.col("n_words") < least_words).select(*kept, F.lit(None).cast("long").alias("rank")))


def draw(docs: DataFrame, target: DataFrame, *, least_words: int = LEAST_WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The drawn documents with all their columns, unchanged (see `rank_documents`). Texts are written once and joined by row number, not sorted."""
    hidden, place, back = aside(docs)
    id_col, text_col = place[id_col.lower()], place[text_col.lower()]
    numbered = staged(hidden.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    scored = staged(score_documents(numbered.select("__row", id_col, text_col), target, id_col=id_col, text_col=text_col, **options).select("__row", id_col, "__scored.*"), "scored")
    fit = scored.filter(F.col("n_words") >= least_words).select("__row", id_col, "n_features", "score")
    ranked, n = radix_ranks(fit, [("score", True), (id_col, False), ("n_features", False)])
    return back(numbered.join(ranked.filter(F.col("rank") <= percent * n // 100).select("__row"), "__row"))
