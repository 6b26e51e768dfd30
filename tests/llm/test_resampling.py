"""Importance resampling against a plain version, and the radix sort against an ordinary one."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from wearframe.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, target, longest=1, least=20, percent=10):
    def features(text):
        w = WORD.findall((text or "").translate(FOLD))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    out = []
    for i, text in rows:
        n, f = features(text)
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def both(spark, docs, awkward, target, **options):
    bench = spark.createDataFrame([(t, "mine") for t in target], "text string, doc_id string")
    got = resampling.rank_documents(docs, bench, **options).collect()
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got), key=repr) == plain([(r[0], r[1]) for r in awkward], target, **{k: v for k, v in options.items() if k in ("longest", "percent")})


def test_equals_plain(spark, awkward_docs, awkward, no_docs):
    target = [awkward[0][1], awkward[3][1], None, "", "x" * 5000]
    both(spark, awkward_docs, awkward, target)
    both(spark, awkward_docs, awkward, target, longest=3, percent=50, block_bits=3, digit_bits=4)
    both(spark, awkward_docs, awkward, [])
    assert resampling.rank_documents(no_docs, no_docs).collect() == []


def test_draw_keeps_columns(spark, awkward_docs, awkward, no_docs):
    bench = spark.createDataFrame([(awkward[0][1],)], "text string")
    drawn = resampling.draw(awkward_docs, bench)
    assert drawn.columns == awkward_docs.columns
    ranked = resampling.rank_documents(awkward_docs, bench).filter("rank is not null").collect()
    assert sorted((r.doc_id for r in drawn.collect()), key=repr) == sorted((r.doc_id for r in ranked), key=repr)
    assert {r.kept for r in drawn.collect()} == {"mine"}
    assert resampling.draw(no_docs, bench).count() == 0


def test_radix_sorts_any_longs(spark):
    rng = random.Random(3)
    rows = [(rng.choice([-(1 << 63), (1 << 63) - 1, rng.getrandbits(40), -5, None]), rng.randint(-3, 3)) for _ in range(700)] + [(7, 7)] * 300
    df = spark.createDataFrame(rows, "a long, b long").repartition(6)
    ranked, n = resampling.radix_ranks(df, [("b", True), ("a", False)], block_bits=4, digit_bits=5)
    got = [(r.a, r.b) for r in sorted(ranked.collect(), key=lambda r: r["rank"])]
    assert n == 1000 and [r["rank"] for r in sorted(ranked.collect(), key=lambda r: r["rank"])] == list(range(1, 1001))
    assert got == sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
    # all equal, and nothing
    assert sorted(r["rank"] for r in resampling.radix_ranks(df.filter("a = 7"), [("a", False)])[0].collect()) == list(range(1, 301))
    assert resampling.radix_ranks(df.filter("a = 8"), [("a", False)])[0].collect() == []


def test_long_texts_are_cut_between_words():
    text = b"Aa bb " * 300_000 + b"z" * 3_000_000 + b" end"
    parts = list(resampling.word_parts(text))
    assert len(parts) > 2 and [w for p in parts for w in p] == text.lower().split()
