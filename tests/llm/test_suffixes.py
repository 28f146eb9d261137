import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from kvspark.llm import suffixes

LENGTH, GRAM = 40, 8


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + LENGTH] for d in data for i in range(len(d) - LENGTH + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - LENGTH + 1):
            if seen[d[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = True
        kept = bytes(b for b, g in zip(d, gone[:-1], strict=True) if not g)
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        out.append((len(d), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    text = lambda k: "".join(r.choice("abcdé ") for _ in range(k))
    passages = [text(r.randint(30, 70)) for _ in range(6)]
    out = []
    for _ in range(n):
        out.append(text(r.randint(0, 60)) + r.choice(passages) + text(r.randint(0, 30)) + r.choice(passages)[r.randint(0, 9) :] + text(r.randint(0, 20)))
    out += out[:3] + [None, "", "x" * 39, "y" * 40, "y" * 41, "z" * 300, "ab" * 100, "short"]
    return out


@pytest.mark.parametrize("max_group", [30_000, 3])
def test_matches_brute_force(spark, max_group):
    texts = corpus(1)
    df = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, k1 string").repartition(5)
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.cut_repeats(df, length=LENGTH, gram=GRAM, max_group=max_group).collect()}
    assert [rows[i] for i in range(len(texts))] == brute(texts)


def test_empty_table(spark):
    assert suffixes.cut_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_anchors_cover_every_window_once():
    data = np.frombuffer(corpus(2)[0].encode() * 3, np.uint8)
    _, place, lo, hi = suffixes.anchors(data, LENGTH, GRAM)
    starts = sorted(p - o for p, a, b in zip(place, lo, hi, strict=True) for o in range(a, b + 1))
    assert starts == list(range(len(data) - LENGTH + 1))
    assert (lo >= 0).all() and (hi <= LENGTH - GRAM).all()


def test_merge_gives_order_and_shared_prefixes():
    r = random.Random(3)
    keys = [bytes(r.choice(b"ab") for _ in range(r.randint(1, 12))) for _ in range(300)]
    runs = [suffixes.front_code(sorted((k, b"%d" % i) for i, k in enumerate(keys) if i % 5 == part)) for part in range(5)]
    merged = list(suffixes.merge_runs(runs))
    assert [k for _, k, _ in merged] == sorted(keys)
    before = b""
    for n, key, payload in merged:
        assert n == suffixes.shared(before, key, 0) and keys[int(payload)] == key
        before = key


def test_hashes_of_anchors_are_spread():
    r = random.Random(5)
    data = np.frombuffer(bytes(r.randrange(256) for _ in range(200_000)), np.uint8)
    ranges = suffixes.anchors(data)[0].view(np.uint64) >> np.uint64(61)
    assert np.bincount(ranges.astype(int), minlength=8).max() < 2 * len(ranges) / 8
