"""The learner of decision lists against plain Python."""

import math
import random

import numpy as np
import pytest

from kvspark.llm import quality_rules


def gain(rows, test):
    """FOIL's gain of one more test over rows (values, bad)."""
    name, above, limit = test
    hit = [b for v, b in rows if (v[name] >= limit if above else v[name] <= limit)]
    p, n, p0 = sum(hit), len(hit) - sum(hit), sum(b for _, b in rows)
    return p * (math.log2(p / (p + n)) - math.log2(p0 / len(rows))) if p else -1.0


@pytest.mark.parametrize("seed", range(4))
def test_rules_are_what_covering_makes(seed):
    r = random.Random(seed)
    rows = []
    for _ in range(900):
        v = {"a": round(r.random(), 2), "b": r.gauss(0, 1), "c": float(r.randint(0, 4))}
        bad = (v["a"] > 0.8 and v["b"] > 0) or v["c"] == 4 and r.random() < 0.98
        rows.append((v, bad))
    stats = {n: np.array([v[n] for v, _ in rows]) for n in "abc"}
    bad = np.array([b for _, b in rows])
    rules = quality_rules.cover(stats, bad)
    assert 1 <= len(rules) <= 12
    holds = lambda t, v: v[t.name] >= t.limit if t.above else v[t.name] <= t.limit
    left = list(range(len(rows)))
    for number, rule in enumerate(rules):
        grown = [rows[i] for i in left if i % 3 != 2]
        for t in rule:  # each test gains as much as any cut of any statistic could
            cuts = [(n, up, float(c)) for n in "abc" for up in (True, False) for c in np.unique(np.quantile(stats[n], np.linspace(0, 1, 49)))]
            best = max(gain(grown, c) for c in cuts)
            assert gain(grown, (t.name, t.above, t.limit)) == pytest.approx(best)
            grown = [(v, b) for v, b in grown if holds(t, v)]
        hit = [i for i in left if all(holds(t, rows[i][0]) for t in rule)]
        pruned = [i for i in hit if i % 3 == 2]
        assert sum(bad[hit]) >= max(5, 0.95 * len(hit)) and sum(bad[pruned]) >= 0.95 * len(pruned)
        left = [i for i in left if i not in set(hit)]
    assert sum(bad[left]) < sum(bad)  # it stops at the first rule that does not hold on the pruning part


def test_nothing_to_learn():
    none = {n: np.zeros(0) for n in "ab"}
    assert quality_rules.cover(none, np.zeros(0, bool)) == []
    flat = {n: np.ones(50) for n in "ab"}
    assert quality_rules.cover(flat, np.arange(50) % 2 == 0) == []
