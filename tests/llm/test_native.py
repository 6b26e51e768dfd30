"""Mixing, exact deduplication and sharding against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import EXTRA, SCHEMA, words
from wearframe.llm import exact_dedup, mixing, sharding
from wearframe.llm.common import words_in


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, total = set(), share * sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = sum(w[s] for s in order if s not in capped)
        got = {s: most * sizes[s] if s in capped else rest * w[s] / free for s in order}
        over = {s for s in order if s not in capped and got[s] > most * sizes[s]}
        if not over:
            return got
        capped |= over


def test_mix_meets_targets(awkward_docs, awkward):
    rows = mixing.mix(awkward_docs, words_in(F.col("text"))).select("doc_id", "source", "size", "source_size", "target", "copies", "taken", "kept").collect()
    assert len(rows) == len(awkward)
    assert {r.kept for r in rows} == {"mine"}
    sizes = Counter()
    for _, text, _, source in awkward:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    wanted = plain_targets(sizes)
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(wanted[r.source])
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    largest = defaultdict(int)
    for r in rows:
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= largest[s]


def test_mix_repeats_and_empty(awkward_docs, no_docs):
    once = [tuple(sorted((str(r.doc_id), r.size, r.taken) for r in mixing.mix(awkward_docs.repartition(n), words_in(F.col("text"))).collect())) for n in (1, 7)]
    assert once[0] == once[1]
    assert mixing.mix(no_docs, words_in(F.col("text"))).count() == 0
    emitted = mixing.emit(mixing.mix(awkward_docs, words_in(F.col("text"))))
    assert emitted.count() == mixing.mix(awkward_docs, words_in(F.col("text"))).agg(F.sum("copies")).first()[0]


def test_exact_dedup_matches_plain(awkward_docs, awkward):
    marked = exact_dedup.mark_copies(exact_dedup.digests(awkward_docs)).select("doc_id", "text", "keep_id", "group_size", "kept", "text_sha256").collect()
    groups = defaultdict(list)
    for i, text, _, _ in awkward:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", text or "").encode()).hexdigest()].append((-len(text or ""), i is None, i))
    assert len(marked) == len(awkward)
    for r in marked:
        group = groups[r.text_sha256]
        assert r.group_size == len(group)
        assert r.keep_id == min(group, key=lambda g: (g[0], g[1], g[2] or 0))[2]
    kept = Counter(r.text_sha256 for r in marked if r.kept)
    assert kept == Counter(list(groups))


def test_heavy_digests_skip_the_shuffle(awkward_docs):
    heavy = {r.text_sha256 for r in exact_dedup.frequent(exact_dedup.digests(awkward_docs)).collect()}
    counts = exact_dedup.digests(awkward_docs).groupBy("text_sha256").count().filter("count > 1").collect()
    assert {r.text_sha256 for r in counts} <= heavy


def test_drop_copies_keeps_columns(awkward_docs, no_docs):
    left = exact_dedup.drop_copies(awkward_docs)
    assert left.columns == awkward_docs.columns
    assert {r.kept for r in left.select("kept").distinct().collect()} == {"mine"}
    assert exact_dedup.drop_copies(no_docs).count() == 0


def test_shards(awkward_docs, awkward, no_docs):
    rows = sharding.shard(awkward_docs, 4).collect()
    assert len(rows) == len(awkward)
    by_shard = defaultdict(list)
    for r in rows:
        assert r.text_crc32 == zlib.crc32((r.text or "").encode()) and r.size == len((r.text or "").encode()) + 1
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 4
        by_shard[r.shard].append(r)
    for members in by_shard.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    loads = sorted(sum(r.size for r in m) for m in by_shard.values())
    # no shard could be lighter than its longest row; the rest are as equal as single rows allow
    longest = sorted(r.size for r in rows)
    rest = (sum(longest) - longest[-1] - longest[-2]) / 2
    assert loads[1] - loads[0] <= longest[-3] and abs(loads[0] - rest) <= longest[-3]
    assert sharding.shard(no_docs, 4).count() == 0


def test_repeated_rows_are_dealt_out(spark, awkward):
    """One row is a third of all rows and most of the bytes; shards stay within one row of equal, and a second run gives the same sizes."""
    rng = random.Random(9)
    rows = [(i, words(rng, 30), "en", "s") for i in range(400)] + [(7000, words(rng, 200), "en", "s")] * 200 + [(None, None, None, None)] * 50
    docs = spark.createDataFrame([r + EXTRA for r in rows], SCHEMA).repartition(5).cache()
    runs = []
    for partitions in (5, 3):
        got = sharding.shard(docs.repartition(partitions), 8).select("doc_id", "size", "shard", "slot").collect()
        loads = defaultdict(int)
        for r in got:
            loads[r.shard] += r.size
        assert len(got) == len(rows) and max(loads.values()) - min(loads.values()) <= max(r.size for r in got)
        for k in range(8):
            assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
        runs.append(sorted((str(r.doc_id), r.size, r.shard, r.slot) for r in got))
    assert runs[0] == runs[1]
    # all rows are one row
    same = sharding.shard(docs.filter("doc_id = 7000"), 8).groupBy("shard").count().collect()
    assert len(same) == 8 and max(r["count"] for r in same) - min(r["count"] for r in same) <= 2


def test_slot_map_versions(spark, awkward_docs, tmp_path):
    slotted = sharding.with_slots(awkward_docs, 256)
    sizes = sharding.slot_sizes(slotted, 256)
    path = str(tmp_path / "map")
    first = sharding.first_map(sizes, 4)
    sharding.save_map(first, path)
    sharding.save_map(sharding.add_shard(sharding.load_map(spark, path), sizes), path)
    old = {r.vslot: r.shard for r in sharding.load_map(spark, path, 0).collect()}
    new = {r.vslot: r.shard for r in sharding.load_map(spark, path).collect()}
    assert len(old) == len(new) == 256
    moved = {v for v in old if old[v] != new[v]}
    assert moved and {new[v] for v in moved} == {4}
    with pytest.raises(ValueError, match="slot table"):
        sharding.with_slots(awkward_docs, 1 << 20)


def test_first_map_is_greedy(spark):
    sizes = spark.createDataFrame([(i, b, 1) for i, b in enumerate([9, 7, 6, 5, 4, 3, 2, 0])], "vslot int, bytes long, rows long")
    loads, want = [0, 0, 0], {}
    for i, b in enumerate([9, 7, 6, 5, 4, 3, 2, 0]):
        k = loads.index(min(loads))
        loads[k] += b
        want[i] = k
    assert {r.vslot: r.shard for r in sharding.first_map(sizes, 3).collect()} == want
