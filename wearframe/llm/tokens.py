"""Token counts with a two-tier lookup on the map side.

SentencePiece marks every space with U+2581, and no piece of the vocabulary has that mark behind another character, so merges never cross the
start of a marked word: a text has as many tokens as its space-separated pre-tokens together. Frequent pre-tokens (from a bounded sample of documents)
are encoded once and their lengths broadcast as a small hash table; others are encoded in batches and remembered in a bounded cache of the worker.
Only pre-tokens of the sample are shuffled, to be counted; no others are. What the sample holds affects speed only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

#: Documents (about) whose pre-tokens are counted for the table, and the size of the table.
SAMPLE_DOCS = 2000
TABLE = 16_384
#: Most pre-tokens a worker remembers, and the longest one it does.
CACHE = 400_000
LONGEST = 64
#: Characters of a text taken at a time; cuts fall between words only.
PIECE = 1_000_000
MARK = "▁"


def frequent_pretokens(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS, table: int = TABLE) -> list[str]:
    """The most frequent pre-tokens of a random sample of about `sample_docs` documents; these pre-tokens are shuffled by value and sorted."""
    share = min(1.0, sample_docs / max(docs.count(), 1))
    sample = docs.select(F.col(text_col).alias("t")).filter(F.rand(seed=7) < share)
    counted = sample.select(F.explode(F.split("t", " ")).alias("w")).filter(F.length("w").between(1, LONGEST)).groupBy("w").count()
    return [r.w for r in counted.orderBy(F.desc("count"), "w").limit(table).collect()]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text cut at single spaces (which are left out), about `size` characters each."""
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while cut >= 0 and (text[cut - 1] == " " or text[cut + 1 : cut + 2] in ("", " ")):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def pretokens(piece: str) -> list[str]:
    """Space-separated words; further spaces of a run stay at the front of the next word, a run at the end is given as spaces alone."""
    words = piece.split(" ")
    if "" not in words:
        return words
    out, run = [], 0
    for w in words:
        if w:
            out.append(" " * run + w)
            run = 0
        else:
            run += 1
    return [*out, " " * run] if run else out


class Counter:
    """Counts tokens of whole texts; `frequent` is never forgotten."""

    def __init__(self, processor, frequent: dict[str, int]):
        self.processor, self.frequent, self.known = processor, frequent, dict(frequent)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(self._piece(p) for p in pieces(text.replace(MARK, " ") if MARK in text else text))

    def _piece(self, piece: str) -> int:
        if piece.isspace() and not piece.strip(" "):
            return len(self.processor.encode(piece))
        words = pretokens(piece)
        tail = words.pop() if words[-1].isspace() and not words[-1].strip(" ") else ""
        known = self.known
        unknown = [w for w in set(words) if w not in known]
        if unknown:
            if len(known) + len(unknown) > CACHE:
                known = self.known = dict(self.frequent)
                unknown = [w for w in set(words) if w not in known]
            fresh = dict(zip(unknown, map(len, self.processor.encode(unknown, num_threads=1)), strict=True))
            total = sum(map((known | fresh).__getitem__, words)) if len(fresh) > CACHE else None
            if total is None:
                known.update(fresh)
                total = sum(map(known.__getitem__, words))
                for w in unknown:
                    if len(w) > LONGEST:
                        del known[w]
        else:
            total = sum(map(known.__getitem__, words))
        # a run of spaces at the end: the mark of the last one is all that an empty pre-token has
        return total + (1 if tail == " " else len(self.processor.encode(tail[1:])) if tail else 0)


def count_tokens(docs: DataFrame, model_file: str, *, text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Adds `n_bytes` (UTF-8), `n_tokens` and `over_limit` (more than `limit` tokens); columns of these names are replaced.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows are counted each. An empty table gives an empty result. `model_file` must exist
    on every executor.
    """
    import sentencepiece

    frequent = frequent_pretokens(docs, text_col)
    lengths = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=model_file).encode(frequent, num_threads=1)] if frequent else []
    shared = docs.sparkSession.sparkContext.broadcast(dict(zip(frequent, lengths, strict=True)))

    @arrow_udf("long")
    def n_tokens(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import sentencepiece

        counter = Counter(sentencepiece.SentencePieceProcessor(model_file=model_file), shared.value)
        for column in texts:
            yield pa.array([counter.count(t.as_py()) for t in column], pa.int64())

    size: Column = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    out = docs.withColumn("n_tokens", n_tokens(F.col(text_col))).withColumn("n_bytes", size)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
