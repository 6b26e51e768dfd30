"""Toxicity scores: gradient-boosted trees over dense features of a text, with isotonic calibration.

The lexicon is learned: word beginnings (4 to 8 letters) that mark toxic documents of the labelled sample. Dense features are densities of lexicon hits, their
weights, how near they stand to a second person, capitals, punctuation and obfuscated spellings. Spark ML fits the trees and the calibration. Rows of the sample are
dealt into folds: a row's features use the lexicon of the other folds, the trees learn from three folds and the calibration from the other two.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from wearframe.llm.common import staged
from wearframe.llm.language import held_out

#: Bound of the labelled sample: rows of each class.
FIT_ROWS = 3000
FOLDS = 5
#: Documents whose terms are Python objects at the same time.
DOCS = 32
#: Most lexicon entries; a term counts if it is in so many toxic documents and so much likelier there.
LEXICON = 2000
LEAST_DOCUMENTS = 3
LEAST_WEIGHT = 1.5
SHORTEST, LONGEST = 4, 8
#: Words between a hit and a second person.
NEAR = 6
#: Second-person words of the languages at hand.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos ti tus usted ustedes vosotros vuestro".split()
)
#: Characters written for letters.
SPOKEN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
EDGE = "\"'`.,;:!?()[]{}<>*#%&|$_-=~«»¿¡"
FEATURES = ("density", "distinct", "strongest", "total", "near_second_person", "spoken_density", "capitals", "exclamations", "punctuation", "obfuscated", "log_words")


def stems(word: str) -> list[str]:
    return [word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1)]


def terms(text: str) -> set[str]:
    """Beginnings of the words of a text that hold letters only."""
    return {s for w in set(text.lower().split()) if (v := w.strip(EDGE)).isalpha() for s in stems(v)}


def lexicons(counts: list[tuple[str, int, int, int]], totals: dict[int, tuple[int, int]]) -> list[dict[str, float]]:
    """Term weights (log odds) learned without fold 0, 1, ... and, last, from all folds; `counts` has (term, fold, toxic, clean)."""
    by_term: dict[str, dict[int, tuple[int, int]]] = {}
    for term, fold, toxic, clean in counts:
        by_term.setdefault(term, {})[fold] = (toxic, clean)
    out = []
    for left_out in [*range(FOLDS), None]:
        n_toxic, n_clean = (sum(t[k] for f, t in totals.items() if f != left_out) for k in (0, 1))
        weighed = []
        for term, folds in by_term.items():
            toxic, clean = (sum(t[k] for f, t in folds.items() if f != left_out) for k in (0, 1))
            weight = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))
            if toxic >= LEAST_DOCUMENTS and weight >= LEAST_WEIGHT:
                weighed.append((-weight * math.sqrt(toxic), term, weight))
        out.append({term: weight for _, term, weight in sorted(weighed)[:LEXICON]})
    return out


def features(text: str | None, raw: bytes | None, lexicon: dict[str, float], heads: set[str]) -> list[float]:
    """FEATURES of one text; all 0 for an empty one."""
    if not text:
        return [0.0] * len(FEATURES)
    words = text.lower().split()
    hits, spoken = [], 0
    for i, w in enumerate(words):
        if w[:SHORTEST] in heads or (not w[:SHORTEST].isalpha() and len(w) >= SHORTEST):
            v = w.strip(EDGE)
            if v[:SHORTEST] in heads:
                best = max((lexicon[s] for s in stems(v) if s in lexicon), default=0.0)
                if best:
                    hits.append((i, best, v))
            elif len(v) >= SHORTEST and not v.isalpha() and (s := v.translate(SPOKEN))[:SHORTEST] in heads and any(x in lexicon for x in stems(s)):
                spoken += 1
    near = sum(any(x.strip(EDGE) in SECOND_PERSON for x in words[max(0, i - NEAR) : i + NEAR + 1]) for i, _, _ in hits)
    n = max(len(words), 1)
    b = np.frombuffer(raw, np.uint8)
    letter = ((b | 32) >= 97) & ((b | 32) <= 122) | (b >= 128)
    capital = np.count_nonzero((b >= 65) & (b <= 90))
    inside = np.count_nonzero(letter[:-2] & ~letter[1:-1] & letter[2:] & (b[1:-1] > 32)) if len(b) > 2 else 0
    marks = np.count_nonzero(~letter & (b > 32) & ((b < 48) | (b > 57)))
    weights = [w for _, w, _ in hits]
    return [
        100.0 * len(hits) / n, float(len({v for _, _, v in hits})), max(weights, default=0.0), float(sum(weights)), 100.0 * near / n, 100.0 * spoken / n, capital / len(b),
        (raw.count(b"!") + raw.count(b"?")) / n, marks / n, 100.0 * inside / n, math.log1p(n),
    ]


def labelled_sample(docs: DataFrame, labels: DataFrame, text_col: str, id_col: str, label_col: str) -> DataFrame:
    """(`label`, `fold`, `text`) of at most FIT_ROWS ids of each class that are not held out, by hash of the id; ids are a bounded broadcast.

    An id gives one row, however often it repeats: its greatest text, found while rows are read.
    """
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label"))
    usable = usable.groupBy("__id").agg(F.max("label").alias("label")).withColumn("__h", F.xxhash64("__id"))
    counts = {r.label: r["count"] for r in usable.groupBy("label").count().collect()}
    # a draw of about the wanted number comes before the exact cut, so that partitions do not each send FIT_ROWS rows to one task
    wanted = FIT_ROWS + 6 * math.isqrt(FIT_ROWS)
    draw = F.pmod("__h", F.lit(1 << 30)) / (1 << 30)
    picked = [usable.filter((F.col("label") == k) & (draw * counts.get(k, 0) < wanted)).orderBy("__h", "__id").limit(FIT_ROWS) for k in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]).withColumn("fold", F.pmod("__h", F.lit(FOLDS)).cast("int")))
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.join(chosen, "__id").groupBy("__id", "label", "fold").agg(F.max("text").alias("text"))


def learn_lexicons(sample: DataFrame) -> list[dict[str, float]]:
    @arrow_udf("array<string>")
    def terms_of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.string())
        for column in texts:
            # a few documents at a time, so that their terms do not all live as Python objects
            parts = [pa.array([sorted(terms(t.as_py())) for t in column[at : at + DOCS]], kind) for at in range(0, len(column), DOCS)]
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    totals = {r.fold: (r.toxic, r.clean) for r in sample.groupBy("fold").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")).collect()}
    counted = sample.select("fold", "label", F.explode(terms_of("text")).alias("term")).groupBy("term").agg(
        *[F.count(F.when((F.col("fold") == f) & (F.col("label") == k), 1)).alias(f"n{f}_{k}") for f in range(FOLDS) for k in (1, 0)]
    )
    toxic, clean = (sum((F.col(f"n{f}_{k}") for f in range(FOLDS)), F.lit(0)) for k in (1, 0))
    n_toxic, n_clean = (sum(t[k] for t in totals.values()) for k in (0, 1))
    weight = F.log((toxic + 0.5) / (n_toxic + 1)) - F.log((clean + 0.5) / (n_clean + 1))
    # twice the lexicon, so that every fold can fill its own
    likely = counted.filter((toxic >= LEAST_DOCUMENTS) & (weight >= LEAST_WEIGHT / 2)).orderBy((weight * F.sqrt(toxic)).desc(), "term").limit(2 * LEXICON).collect()
    counts = [(r.term, f, r[f"n{f}_1"], r[f"n{f}_0"]) for r in likely for f in range(FOLDS)]
    return lexicons(counts, totals)


def with_features(docs: DataFrame, text_col: str, fold_col: str | None, words: list[dict[str, float]]) -> DataFrame:
    """Adds the vector `__features`; rows of fold k use lexicon k, without folds the last one."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    @arrow_udf("array<double>")
    def compute(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known = [(x, {term[:SHORTEST] for term in x}) for x in shared.value]
        for texts, folds in batches:
            rows = ((t.as_py(), f.as_py()) for t, f in zip(texts, folds, strict=True))
            yield pa.array([features(t, t.encode() if t else None, *known[f]) for t, f in rows], pa.list_(pa.float64()))

    fold = F.col(fold_col) if fold_col else F.lit(FOLDS)
    return docs.withColumn("__features", array_to_vector(compute(F.col(text_col), fold.cast("int"))))


def score(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """Adds `held_out`, `score` (0 to 1, calibrated) and `predicted` (score at least 0.5); columns of these names are replaced.

    Labels that are null, not 0 or 1, held out, without an id, or of unknown documents are not learned from; of several labels of an id the highest counts. Null and
    empty texts have all features 0 and are scored like any other. If one class is missing among the labels, every score is the share of toxic labels
    (0 without labels). Repeated rows get equal scores; an empty table gives an empty result.
    """
    sample = staged(labelled_sample(docs, labels, text_col, id_col, label_col), "toxicity-sample")
    words = learn_lexicons(sample)
    # a bounded sample: one partition in a fixed order, so that the fit repeats exactly
    fitted = staged(with_features(sample, "text", "fold", words).select("__id", "label", "fold", "__features").orderBy("__id"), "toxicity-features").coalesce(1)
    fitted = fitted.withColumn("label", F.col("label").cast("double")).sortWithinPartitions("__id")
    seen = {(r.label, r.fold < 3) for r in fitted.select("label", "fold").distinct().collect()}
    base = docs.drop("held_out", "score", "predicted").withColumn("held_out", held_out(id_col))
    if len(seen) < 4:
        share = fitted.agg(F.coalesce(F.avg("label"), F.lit(0.0))).first()[0]
        out = base.withColumn("score", F.lit(float(share)))
    else:
        trees = GBTClassifier(featuresCol="__features", labelCol="label", predictionCol="__p", maxIter=20, maxDepth=3, stepSize=0.2, seed=7)
        trees = trees.setRawPredictionCol("__raw").setProbabilityCol("__margin")
        booster = trees.fit(fitted.filter("fold < 3"))
        margin = lambda df: df.withColumn("__x", vector_to_array("__margin")[1]).drop("__p", "__raw", "__margin")
        calibration = IsotonicRegression(featuresCol="__x", labelCol="label", predictionCol="__score").fit(margin(booster.transform(fitted.filter("fold >= 3"))))
        scored = calibration.transform(margin(booster.transform(with_features(base, text_col, None, words))))
        out = scored.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__score")))).drop("__score", "__x", "__features")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
