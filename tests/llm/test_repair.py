"""Conversation repair against a plain shortest-path search, row by row."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

from wearframe.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, cost string, audit string"


def plain_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        shown = lambda x: " " if x is None else str(x)
        d = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        if d == 1:
            text = ""
        if d == 2:
            text = re.sub("[.!?]", "", text)
        if d == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    for group in out.values():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    return out


def plain_repair(group):
    """Dijkstra over (rows read, role initials so far); the queue's order is (cost, audit)."""
    faults, seen = [], set()
    for _, role, text in group:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    queue, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, last, lines = heapq.heappop(queue)
        if (i, last) in done:
            continue
        if i == len(group) and last in ("", "a"):
            break
        done.add((i, last))
        nxt = "a" if last == "u" else "u"
        name = {"a": "assistant", "u": "user"}[nxt]
        heapq.heappush(queue, (cost + 2, audit + "I", i, nxt, (*lines, f"{name}:")))
        if i < len(group):
            _, role, text = group[i]
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, last, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                heapq.heappush(queue, (cost + 2 + more, audit + "R", i + 1, nxt, (*lines, f"{name}:{text}")))
                if role[:1] == nxt or (role[:1] == "s" and last == ""):
                    heapq.heappush(queue, (cost + more, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))
    turns = [t for t, _, _ in group if t is not None]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(group, group[1:])),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def awkward(seed=5):
    rng = random.Random(seed)
    texts = ["yes.", "no", "why?", " \t", "", None, "well!", "one two. ", "é日\n."]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, "ux"]), rng.choice(texts)) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(70, t % 3, rng.choice(["user", "assistant"]), rng.choice(texts)) for t in range(12)]
    rows += [(None, None, "user", "hi."), (None, None, "assistant", "hi"), (None, 3, None, None), (71, None, "user", "a."), (71, -5, "assistant", "b."), (71, 1 << 40, "", "c.")]
    rows += [(72, t, "user" if t % 2 else "assistant", "same." if t % 3 else "x" * 50_000) for t in range(60)]
    rows += [(73, 1, "user", "again and again.")] * 100
    return rows


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, "mine", "mine") for r in rows], SCHEMA).repartition(4)
    got = {r.conv_id: r.asDict() for r in repair.repair_damaged(df).collect()} if not options else None
    if options:
        found = repair.repair(repair.damage(df.select("conv_id", "turn", "role", "text")), **options).collect()
        got = {None if r["__c"] == "null" else int(r["__c"][1:]): r.asDict() for r in found}
    for conv, group in plain_damage(rows).items():
        if group or not options:
            want = plain_repair(group)
            assert {k: got[conv][k] for k in want} == want, conv
    return got


def test_equals_plain_search(spark):
    got = check(spark, awkward())
    assert len(got) == 65


def test_cells_join_up(spark):
    # cells of two rows: long conversations are put together from many tables
    check(spark, awkward(6), cell_bits=1)


def test_all_dropped_and_empty(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = check(spark, [(gone, 0, "user", "hello.")])
    assert got[gone]["audit"] == "" and got[gone]["cost"] == 0
    assert repair.repair_damaged(spark.createDataFrame([], SCHEMA)).collect() == []


def test_weights_spell_in_ascii_order():
    w = repair.Weights(4)
    spelled = ["", "D", "DI", "DK", "I", "K", "KKKK", "R"]
    assert sorted(spelled, key=lambda s: w.of(7, s)) == spelled
    assert w.of(3, "RRRR") < w.of(4, "")
    assert all(w.read(w.of(5, s)) == (5, s) for s in spelled)
    assert w.before(repair.KEEP, 2, w.of(1, "DI")) == w.of(3, "KDI")
