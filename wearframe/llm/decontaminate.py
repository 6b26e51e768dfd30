"""Benchmark decontamination with an Aho-Corasick automaton.

Test items are normalised and cut into windows of consecutive words; one automaton holds all windows and reads every normalised text once. Word
positions of the hits are mapped back to code points of the original. The automaton's letters are halves of word numbers, two for a word, so its size goes with
the number of words and not with their length. A benchmark of more windows than fit a bounded automaton is read in further passes, one automaton at a time.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf
from pyspark.sql.pandas.types import from_arrow_type

from wearframe.llm.common import FOLD, aside, each_utf8, staged, word_parts

WINDOW = 10
#: Windows of one automaton at most (about 0.9 KB each, measured), and different words: as many as two letters can number.
BLOCK = 1 << 18
HALF = 256
#: First letters and second letters of words lie apart, so a hit always starts with a word; no word of the items has the letter for all others.
FIRST, SECOND, OTHER = 1, 1 + HALF, "\x00"
ORIGINAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

RESULT = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:bigint,end:bigint>>>"
ARROW = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])


def words(raw: bytes | None) -> list[bytes]:
    return raw.translate(FOLD).split() if raw else []


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int = WINDOW, block: int = BLOCK) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Stretches of items, (name, words), in blocks of at most `block` windows and HALF * HALF different words. A null id is called `null`.

    Neighbouring stretches of a long item overlap by a word less than a window. The driver holds one block and one item.
    """
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("i"), F.col(text_col).cast("binary").alias("t"))
    held, windows, known = [], 0, set()
    most = max(1, min(block, HALF * HALF) // 4)
    for r in rows.toLocalIterator():
        w = words(bytes(r.t) if r.t is not None else None)
        for at in range(0, max(len(w) - window + 1, 1) if w else 0, most):
            part = w[at : at + most + window - 1]
            fresh = known | set(part)
            n = max(len(part) - window + 1, 1)
            if held and (windows + n > block or len(fresh) > HALF * HALF):
                yield held
                held, windows, fresh = [], 0, set(part)
            held.append((r.i, part))
            windows, known = windows + n, fresh
    if held:
        yield held


class Scanner:
    """One automaton over the windows of a block of items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        import ahocorasick

        self.window, self.letters = window, {}
        owners: dict[str, int] = {}
        self.lengths: list[int] = []
        self.names: list[str] = []
        self.owned: list[set[int] | int] = []
        for number, (name, w) in enumerate(items):
            self.names.append(name)
            spelled = [self._spell(x) for x in w]
            for i in range(max(1, len(w) - window + 1) if w else 0):
                part = spelled[i : i + window]
                at = owners.setdefault("".join(part), len(self.lengths))
                if at == len(self.lengths):
                    self.lengths.append(len(part))
                    self.owned.append(number)
                elif self.owned[at] != number:
                    self.owned[at] = {number} | (self.owned[at] if isinstance(self.owned[at], set) else {self.owned[at]})
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for pattern, at in owners.items():
            self.automaton.add_word(pattern, at)
        if owners:
            self.automaton.make_automaton()

    def _spell(self, word: bytes) -> str:
        found = self.letters.get(word)
        if found is None:
            n = len(self.letters)
            found = self.letters[word] = chr(FIRST + n // HALF) + chr(SECOND + n % HALF)
        return found

    def scan(self, raw: bytes | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, hits as (first word, number of words), and the items they belong to. The text is read in bounded parts."""
        n, found, names = 0, [], set()
        # a word outside the items is one letter, so a letter's word is looked up only for hits
        get, tail = self.letters.get, []
        for part in word_parts(raw or b""):
            spelled = tail + [get(w, OTHER) for w in part]
            if self.lengths:
                line, starts = "".join(spelled), None
                for end, at in self.automaton.iter(line):
                    if starts is None:
                        starts = np.cumsum([0] + [len(x) for x in spelled])
                    last = int(np.searchsorted(starts, end, "right")) - 1
                    # hits that end in the tail were found before
                    if last >= len(tail):
                        found.append((n - len(tail) + last - self.lengths[at] + 1, self.lengths[at]))
                        owned = self.owned[at]
                        names |= {self.names[k] for k in owned} if isinstance(owned, set) else {self.names[owned]}
            n += len(part)
            tail = spelled[max(0, len(spelled) - self.window + 1) :] if self.window > 1 else []
        return n, found, names


def hit_words(n_words: int, found: list[tuple[int, int]]) -> np.ndarray:
    """Which words lie in a hit."""
    at = np.array(found, np.int64)
    step = np.zeros(n_words + 1, np.int64)
    np.add.at(step, at[:, 0], 1)
    np.add.at(step, at[:, 0] + at[:, 1], -1)
    return np.cumsum(step[:-1]) > 0


def original_spans(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words as code-point spans of the original text."""
    out: list[dict[str, int]] = []
    last = -2
    for i, m in enumerate(ORIGINAL_WORD.finditer(text)):
        if hit[i]:
            if last == i - 1:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end()})
            last = i
    return out


def leak_of(text: str | None, n: int, found: list[tuple[int, int]], names) -> dict:
    if not found:
        return {"n_words": n, "n_hit": 0, "items": [], "spans": []}
    hit = hit_words(n, found)
    return {"n_words": n, "n_hit": int(hit.sum()), "items": sorted(names), "spans": original_spans(text, hit)}


HITS = pa.struct([("n_words", pa.int64()), ("first", pa.list_(pa.int64())), ("length", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


_LAST: dict[str, Scanner] = {}


def scanner_of(key: str, shared, window: int) -> Scanner:
    """The automaton of a broadcast block, built once a worker; the one before it is let go."""
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = Scanner(shared.value, window)
    return _LAST[key]


def hits_of(shared, window: int):
    """Hits of a text with the windows of one broadcast block."""
    key = uuid.uuid4().hex

    @arrow_udf(from_arrow_type(HITS))
    def seen(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = scanner_of(key, shared, window)
        for column in texts:
            out = []
            for n, found, names in map(scanner.scan, each_utf8(column)):
                out.append({"n_words": n, "first": [f[0] for f in found], "length": [f[1] for f in found], "items": sorted(names)})
            yield pa.array(out, HITS)

    return seen


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Adds `leak` to every row: n_words, n_hit, items (ids as strings) and spans (code points, end exclusive, of the original text).

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. Null or empty texts have no words
    and no hits; items without words are never found; items that repeat an id count once; a null item id is called `null`. With an empty benchmark
    nothing is hit. A column named leak is replaced. More than `block` windows take several passes: the rows are written once with a number, every pass
    keeps only what it hits, and the hits of a row are joined to it in the end.
    """
    context = docs.sparkSession.sparkContext
    blocks = item_blocks(benchmark, item_id_col, item_text_col, window, block)
    first, second = next(blocks, []), next(blocks, None)

    if second is None:
        shared, key = context.broadcast(first), uuid.uuid4().hex

        @arrow_udf(RESULT)
        def leak(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            scanner = scanner_of(key, shared, window)
            for column in texts:
                yield pa.array([leak_of(column[i].as_py() if (seen := scanner.scan(t))[1] else None, *seen) for i, t in enumerate(each_utf8(column))], ARROW)

        return docs.withColumn("leak", leak(F.col(text_col)))

    numbered = staged(docs.drop("leak").withColumn("__row", F.monotonically_increasing_id()), "numbered")
    hits = None
    for items in chain((first, second), blocks):
        shared = context.broadcast(items)

        part = staged(numbered.select("__row", hits_of(shared, window)(F.col(text_col)).alias("h")).filter(F.size("h.first") > 0), "hits")
        shared.destroy()
        hits = part if hits is None else hits.unionByName(part)
    joined = hits.groupBy("__row").agg(F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("h.first", "h.length")))).alias("__found"), F.array_distinct(F.flatten(F.collect_list("h.items"))).alias("__items"))

    @arrow_udf(RESULT)
    def merged(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, found, items in columns:
            out = []
            for i, raw in enumerate(each_utf8(texts)):
                pairs = [tuple(p.values()) for p in found[i].as_py() or []]
                out.append(leak_of(texts[i].as_py() if pairs else None, sum(map(len, word_parts(raw or b""))), pairs, items[i].as_py()))
            yield pa.array(out, ARROW)

    return numbered.join(joined, "__row", "left").withColumn("leak", merged(F.col(text_col), "__found", "__items")).drop("__row", "__found", "__items")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no window of any item, unchanged."""
    hidden, place, back = aside(docs)
    return back(find_leaks(hidden, benchmark, text_col=place[text_col.lower()], **options).filter("leak.n_hit = 0"))
