"""SimHash near-deduplication with bit-sliced comparison.

Fingerprints that differ in at most RADIUS bits agree in at least BLOCKS - RADIUS of BLOCKS pieces of their bits. Each distinct fingerprint is sent to every
choice of that many pieces (here 15 tables keyed by two of six pieces); only rows that share a key go on. There they are stored as bit planes,
vertically: one machine word holds one bit of 64 fingerprints. A query adds the planes that differ from its own bits into carry-save counters, 64 distances at
a time, and drops a block once every lane exceeds the radius. Keys with many rows are cut into chunks that meet pair by pair, each
pair in its own group, so no key is one task's work. Links leave a task as a spanning forest, and components are joined up by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

from wearframe.llm.common import aside, key_of, staged, text_of, utf8_bytes
from wearframe.llm.components import components

WORDS = 4
SEED = 42
RADIUS = 4
BLOCKS = 6
#: Rows of one key that are compared in one group; more are cut into chunks of this size.
CHUNK = 1024
#: Lanes of a block of planes, and queries held against it at a time.
LANES = 512
QUERIES = 512
#: Shingles whose bits are counted at a time.
SHINGLES = 1 << 16


def fingerprint(raw: bytes | None, words: int = WORDS) -> int:
    """The fingerprint of a text, as a signed 64-bit number; 0 without words."""
    import xxhash

    joined = b" ".join(raw.lower().split()) if raw else b""
    if not joined:
        return 0
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    n = max(1, len(blanks) + 2 - words)
    starts = np.concatenate(([0], blanks + 1))[:n]
    ends = np.concatenate((blanks, [len(joined)]))[words - 1 :] if len(blanks) + 1 >= words else np.array([len(joined)])
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, SHINGLES):
        part = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + SHINGLES].tolist(), ends[at : at + SHINGLES].tolist(), strict=True)]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    value = sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist())
    return value - (1 << 64) if value >> 63 else value


@arrow_udf(T.LongType())
def fingerprints(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in texts:
        yield pa.array([fingerprint(t) for t in utf8_bytes(column)], pa.int64())


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of all values, 64 values to a word (unused lanes are 0)."""
    width = -(-len(values) // 64)
    bits = np.zeros((64, width * 64), np.uint8)
    bits[:, : len(values)] = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def within(planes: np.ndarray, queries: np.ndarray, closed: np.ndarray, radius: int) -> np.ndarray:
    """Lanes (queries x words, one bit each) at most `radius` bits from each query.

    `closed` has the lanes that need no answer. Counters have as many planes as radius + 1 needs and start so high that one more than `radius` overflows;
    overflow closes a lane for good. Queries whose lanes are all closed are dropped between rounds of eight planes.
    """
    places = (radius + 1).bit_length()
    start = (1 << places) - (radius + 1)
    rows = np.arange(len(queries))
    result = np.zeros_like(closed)
    over = closed.copy()
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    counters = [np.full_like(over, full if start >> p & 1 else 0) for p in range(places)]
    for first in range(0, 64, 8):
        for b in range(first, first + 8):
            own = (queries[rows] >> np.uint64(b)) & np.uint64(1)
            carry = planes[b][None, :] ^ np.where(own == 1, full, np.uint64(0))[:, None]
            for p in range(places):
                counters[p], carry = counters[p] ^ carry, counters[p] & carry
            over |= carry
        alive = ~(over == full).all(axis=1)
        if not alive.any():
            return result
        if alive.sum() < 0.7 * len(rows):
            rows, over = rows[alive], over[alive]
            counters = [c[alive] for c in counters]
    result[rows] = ~over
    return result


def links_in_order(keys: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows within `radius`, at least all those that share a key; rows are sorted by key.

    A block of consecutive rows is the lanes; its queries are its own rows and those that continue its last key. Pairs of different keys that
    happen to be met are true links as well.
    """
    n = len(values)
    ends = np.searchsorted(keys, keys, side="right")
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, n, LANES):
        stop = min(at + LANES, n)
        planes = planes_of(values[at:stop])
        for q in range(at, int(ends[stop - 1]), QUERIES):
            upto = min(q + QUERIES, int(ends[stop - 1]))
            lane, query = np.arange(planes.shape[1] * 64), np.arange(q, upto)
            closed = (lane[None, :] + at >= np.minimum(query, stop)[:, None])
            packed = np.packbits(closed, axis=1, bitorder="little").view("<u8")
            near = within(planes, values[q:upto], packed, radius)
            hit, word = np.nonzero(near)
            if len(hit):
                bits = np.unpackbits(near[hit, word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                r, c = np.nonzero(bits)
                found.append((query[hit[r]], word[r] * 64 + c + at))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For every index its component's smallest index, given links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
        if (root == before).all():
            return root


def spanning_links(radius: int):
    """mapInArrow function over rows (key, fp) sorted by key: links (a, b) from every linked row to its component's first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = np.empty(0, np.int64), np.empty(0, np.uint64)

        def emit(k: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            a, b = links_in_order(k, v, radius)
            root = forest(len(v), a, b)
            linked = np.flatnonzero(root != np.arange(len(v)))
            return pa.RecordBatch.from_arrays([pa.array(v[linked].view(np.int64)), pa.array(v[root[linked]].view(np.int64))], names=["a", "b"])

        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy(zero_copy_only=False)))
            values = np.concatenate((values, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            if (np.diff(keys) < 0).any():
                raise ValueError("rows are not in the order of their keys")
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if cut:
                yield emit(keys[:cut], values[:cut])
                keys, values = keys[cut:], values[cut:]
        if len(keys):
            yield emit(keys, values)

    return run


def pieces(blocks: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each piece; they differ by at most one bit."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def table_keys(fp: Column, radius: int, blocks: int) -> Column:
    """One key per choice of blocks - radius pieces: the pieces' bits in place, the number of the choice hashed in."""
    cut = pieces(blocks)
    keys = []
    for i, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << n) - 1) << a for a, n in (cut[c] for c in chosen))
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(signed).cast("long"))))
    return F.array(*keys)


def near_links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """Links (`a`, `b`) between distinct fingerprints (`fp`) such that components are those of all pairs within `radius` bits."""
    sent = distinct.select("fp", F.explode(table_keys(F.col("fp"), radius, blocks)).alias("key"))
    # a grouped count combines before it is shuffled, and a join can be split where a key is crowded; a window over a key could be neither
    met = sent.join(sent.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "key")
    # a key of more than `chunk` rows: each row goes to all pairs of chunks that hold its own
    chunks = F.ceil(F.col("n") / chunk).cast("long")
    own = F.pmod(F.xxhash64("fp", F.lit("chunk")), chunks)
    pair = F.transform(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda other: F.least(own, other) * chunks + F.greatest(own, other))
    dealt = met.select("key", "fp", F.explode(pair).alias("pair")).select(F.xxhash64("key", "pair").alias("group"), "fp")
    parts = dealt.repartition("group").sortWithinPartitions("group")
    return parts.mapInArrow(spanning_links(radius), "a long, b long")


def near_groups(marked: DataFrame, id_col: str = "doc_id", radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """`fp`, `root`, `component_id` (smallest id of the component) for every fingerprint of `marked` (`fp` and ids); exact, whatever the group sizes."""
    distinct = staged(marked.groupBy("fp").agg(F.min(id_col).alias("__least")), "fingerprints")
    linked = components(near_links(distinct.select("fp"), radius, blocks))
    rooted = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "__least")
    least = rooted.groupBy("root").agg(F.min("__least").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def mark_near_copies(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """One row per row of `docs`: id, `fingerprint` (16 hex digits), `component_id`.

    Null, empty and blank texts have fingerprint 0 and are linked like any other. Texts of fewer words than a shingle are one shingle. A null id never names
    a component unless all its ids are null. Repeated rows get equal rows. An empty table gives an empty result.
    """
    marked = staged(docs.select(F.col(id_col), fingerprints(text_of(text_col)).alias("fp")), "marked")
    groups = near_groups(marked, id_col, radius, blocks)
    return marked.join(groups, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """One document of each component, with the columns of `docs`: the one with the smallest id (null last); of repeated rows one stays."""
    hidden, place, back = aside(docs)
    text_col, id_col = place[text_col.lower()], place[id_col.lower()]
    # rows get a number once, in a written table: it tells equal rows apart, and no key is shared by many rows
    numbered = staged(hidden.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    row_key = F.md5(F.concat_ws("\x1f", key_of(F.col(id_col)), text_of(text_col)))
    marked = staged(numbered.select(id_col, "__at", row_key.alias("__row"), fingerprints(text_of(text_col)).alias("fp")), "marked")
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("__row").alias("row"), F.col("__at").alias("at")))
    groups = near_groups(marked, id_col, radius, blocks)
    stays = marked.groupBy("fp").agg(first.alias("first")).join(groups, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.at").alias("__at"))
    return back(numbered.join(stays, "__at", "left_semi"))
