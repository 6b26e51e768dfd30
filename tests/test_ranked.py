import bisect
import math
import random

import numpy as np

from wearframe.functions.ranked import RankedCounts
from wearframe.operators import intervals


def test_counts_equal_a_sorted_list():
    rng = random.Random(2)
    counted, plain = RankedCounts(1e-3), []
    for i in range(100_000):
        key = rng.choice([rng.randint(0, 50), rng.randint(0, 1 << 40), int(rng.expovariate(1e-3))])
        counted.add(key)
        bisect.insort(plain, key)
        if i % 97 == 0:
            k = rng.randint(1, len(plain))
            assert counted.kth(k) == plain[k - 1]
    assert counted.total == len(plain)
    # what is kept grows with different values, in blocks of bounded size
    assert sum(len(v) for v in counted.values) == len(set(plain))
    assert max(len(v) for v in counted.values) <= 2 * RankedCounts.SIZE


def test_blocks_restore_and_report_changes():
    counted = RankedCounts(1e-3)
    for i in range(5000):
        counted.add(i * 7 % 5000)
    again = RankedCounts(1e-3, counted.blocks())
    assert [again.kth(k) for k in range(1, 5001)] == list(range(5000))
    again.changed.clear()
    again.add(3)
    assert len(again.blocks(only_changed=True)) == 1


def test_follow_equals_an_exact_list():
    rng = np.random.default_rng(7)
    mean, actual = np.zeros(3000), np.abs(rng.normal(size=3000)).round(6)
    state = intervals.cold(0.1)
    half, hit, rates, cover = intervals.follow(state, mean, np.ones(3000), actual, 0.1)
    past, rate, missed = [], 0.1, 0
    for i, y in enumerate(actual.tolist()):
        limit = intervals.Z95
        if len(past) >= intervals.MIN_CALIBRATION:
            limit = past[min(math.ceil((len(past) + 1) * (1 - min(max(rate, 1e-3), 0.999))), len(past)) - 1]
        assert half[i] == np.float64(limit) or abs(half[i] - limit) < 1e-9
        assert rates[i] == rate and hit[i] == (y <= limit + 1e-9)
        rate += 0.02 * (0.1 - (not hit[i]))
        missed += not hit[i]
        bisect.insort(past, y)
        assert abs(cover[i] - (1 - missed / (i + 1))) < 1e-12


def test_counts_below_equal_a_sorted_list():
    rng = random.Random(5)
    counted, plain = RankedCounts(1e-3), []
    for i in range(20_000):
        key = rng.choice([rng.randint(0, 50), rng.randint(0, 1 << 40)])
        if i % 7 == 0:
            assert counted.below(key) == bisect.bisect_left(plain, key)
        counted.add(key)
        bisect.insort(plain, key)


def test_levels_followed_together_equal_each_alone():
    rng = np.random.default_rng(3)
    actual = np.abs(rng.standard_t(3, 1200)).round(2)
    actual[[0, 30, 500]] = np.nan, np.inf, np.nan
    mean, sd, alphas = np.zeros(1200), rng.choice([0.0, 0.5, 2.0], 1200), [1 - v for v in intervals.LEVELS]
    for score in ("absolute", "studentised"):
        together, alone = intervals.cold_levels(alphas, score), [intervals.cold(a, score) for a in alphas]
        for cut in (slice(0, 10), slice(10, 700), slice(700, 1200)):
            hits = intervals.follow_levels(together, mean[cut], sd[cut], actual[cut], score=score)
            for a, state, got in zip(alphas, alone, hits):
                assert got == intervals.follow(state, mean[cut], sd[cut], actual[cut], a, score=score)[1].tolist()
        assert together["rates"] == [s["rate"] for s in alone]


def test_past_scores_are_counted_once_for_all_levels(monkeypatch):
    added = []
    monkeypatch.setattr(RankedCounts, "add", lambda self, key, add=RankedCounts.add: (added.append(key), add(self, key)))
    intervals.follow_levels(intervals.cold_levels([0.5, 0.1, 0.05]), np.zeros(100), np.ones(100), np.arange(100.0))
    assert len(added) == 100
