"""Weights and sample against plain Python."""

import math
import random
import re

import xxhash

from kvspark.llm import importance

M = 2**64


def spread(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % M
    x = (x ^ x >> 27) * 0x94D049BB133111EB % M
    return x ^ x >> 31


def buckets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hashes = [xxhash.xxh64_intdigest(w.encode(), 0) for w in words]
    pairs = [spread((a * 0x9E3779B97F4A7C15 + b) % M) for a, b in zip(hashes, hashes[1:])]
    return [h % 16384 for h in hashes + pairs]


def noise(number, seed):
    u = ((spread((number * 0x9E3779B97F4A7C15 + seed) % M) >> 11) + 0.5) / 2.0**53
    return -math.log(-math.log(u))


def test_weights_and_sample(spark):
    r = random.Random(8)
    words = [f"W{k}é" for k in range(300)]
    docs = [(i, " ".join(r.choices(words[: 100 + 2 * (i % 100)], k=r.randint(0, 80)))) for i in range(150)] + [(150, None), (151, ""), (152, "One"), (None, "no id at all"), (3, "a second text")]
    labels = [(i, int(i % 3 == 0), int(i % 5 == 0)) for i in range(90)] + [(3, 0, 0), (500, 1, 0), (None, 1, 0), (60, None, 0)]
    good = {}
    for i, quality, toxic in labels:
        if i is not None and quality is not None:
            good[i] = good.get(i, True) and quality == 1 and toxic == 0
    raw, target = [1.0] * 16384, [1.0] * 16384
    for i, text in docs:
        for b in buckets(text):
            raw[b] += 1
            target[b] += good.get(i, False)
    ratio = [math.log(p / sum_p) - math.log(q / sum_q) for sum_p, sum_q in [(sum(target), sum(raw))] for p, q in zip(target, raw)]
    want = []
    for i, text in docs:
        found = buckets(text)
        weight = sum(ratio[b] for b in found)
        number = xxhash.xxh64_intdigest(text or "") >> 1 if i is None else i
        want.append((weight + noise(number, 7), i, len(found), weight))
    k = round(sum(good.values()) / len(good) * len(docs))
    want = sorted(want, key=lambda x: -x[0])[:k]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = importance.resample(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == k > 20 and all(x.kept for x in got)
    for x, (key, i, n, weight) in zip(sorted(got, key=lambda x: -x.gumbel_key), want, strict=True):
        assert (x.doc_id, x.n_features) == (i, n) and abs(x.log_weight - weight) < 1e-6 and abs(x.gumbel_key - key) < 1e-6
