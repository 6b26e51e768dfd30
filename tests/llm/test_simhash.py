"""Bit-sliced comparison, components and near-deduplication against plain versions."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wearframe.llm import simhash
from wearframe.llm.components import components


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_roots(values, radius=4):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_kernel_counts_like_popcount(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    flips = [np.uint64(1) << rng.integers(0, 64, 130).astype(np.uint64) for _ in range(radius + 1)]
    values = base[rng.integers(0, 4, 130)]
    for f in flips:
        values = values ^ f
    planes = simhash.planes_of(values)
    closed = np.packbits(np.arange(planes.shape[1] * 64)[None, :] >= np.full((130, 1), 130), axis=1, bitorder="little").view("<u8")
    near = np.unpackbits(simhash.within(planes, values, closed, radius).view(np.uint8), axis=1, bitorder="little")[:, :130]
    assert (near == (np.bitwise_count(values[:, None] ^ values[None, :]) <= radius)).all()


def test_links_cover_every_key(monkeypatch):
    monkeypatch.setattr(simhash, "LANES", 64)
    monkeypatch.setattr(simhash, "QUERIES", 50)
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**63, 3, dtype=np.uint64)[rng.integers(0, 3, 400)] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    values ^= np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)
    keys = np.sort(rng.integers(0, 3, 400))
    a, b = simhash.links_in_order(keys, values, 4)
    got = {(min(p), max(p)) for p in zip(a.tolist(), b.tolist(), strict=True)}
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(near & (keys[:, None] == keys[None, :])), strict=True) if i < j}
    assert want <= got and all(near[i, j] for i, j in got)


def test_components_of_chains_and_hubs(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5000), (7, 7), (2000, 2001), (2001, 2000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert len({got[i] for i in range(61)}) == 1 and len({got[1000 + i] for i in range(50)}) == 1 and got[2000] == got[2001]
    assert len(set(got.values())) == 3 and 5000 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chunks_of_a_hot_key_meet(spark):
    rng = np.random.default_rng(2)
    center = int(rng.integers(0, 2**62))
    values = sorted({center ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 60, (300, 3))})
    distinct = spark.createDataFrame([(v,) for v in values], "fp long")
    want = plain_roots(values)
    for chunk in (16, 4096):
        roots = {r.node: r.root for r in components(simhash.near_links(distinct, chunk=chunk)).collect()}
        got = [roots.get(v, v) for v in values]
        assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_near_copies_match_plain(awkward_docs, awkward):
    rows = simhash.mark_near_copies(awkward_docs).collect()
    assert len(rows) == len(awkward)
    values = [plain_fingerprint(t) for _, t, _, _ in awkward]
    roots = plain_roots(values)
    least = {}
    for (i, *_), r in zip(awkward, roots, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = sorted((str(i), f"{v:016x}", str(least.get(r))) for (i, *_), v, r in zip(awkward, values, roots, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in rows) == want


def test_one_of_each_component_stays(awkward_docs, awkward, no_docs):
    kept = simhash.drop_near_copies(awkward_docs)
    assert kept.columns == awkward_docs.columns
    roots = plain_roots([plain_fingerprint(t) for _, t, _, _ in awkward])
    assert kept.count() == len(set(roots))
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    marked = simhash.mark_near_copies(awkward_docs).filter("component_id is not null")
    assert {r.component_id for r in marked.select("component_id").distinct().collect()} <= ids
    assert simhash.drop_near_copies(no_docs).count() == 0
    assert simhash.mark_near_copies(no_docs).count() == 0


def test_fingerprints_of_long_and_short_texts(spark):
    texts = ["", " ", "one", "one two three", "A b C d", "a b c d e " * 30_000, "É é"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", simhash.fingerprints(F.col("text")).alias("fp"))
    for r in df.collect():
        assert r.fp % (1 << 64) == plain_fingerprint(r.text)
