"""run() against a version written out in plain Python, stage by stage."""

import random
import re

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from kvspark.llm import decontaminate, pieces, simhash  # noqa: E402
from tests.llm.test_pipeline import write  # noqa: E402
from tests.llm.test_workers import naive_merge  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def good_enough(text):
    """The base rules: enough words, and few of them in windows of eight that come again."""
    words = WORD.findall(text or "")
    n, windows = len(words), {}
    for i in range(n - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return n >= 20 and 100 * len(repeated) <= 30 * n


def test_run_against_plain_python(spark, tmp_path):
    import public_tokenizers

    r = random.Random(21)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    prose = lambda n: [r.choice(vocabulary) for _ in range(n)]
    docs, items = [], [(k, " ".join(prose(20))) for k in range(6)]
    for i in range(60):
        words = prose(r.choice([10, 40, 90]))
        docs.append((len(docs), " ".join(words)))
        if i % 4 == 0:  # near copies with one to many words changed
            for c in (1, 2, 12):
                other = list(words)
                for at in r.sample(range(len(other)), min(c, len(other))):
                    other[at] = r.choice(vocabulary)
                docs.append((len(docs), " ".join(other)))
        if i % 5 == 0:
            item = r.choice(items)[1].split()
            item[r.randrange(20)] = "changed"
            docs.append((len(docs), " ".join([*prose(30), *item, *prose(5)])))
        if i % 7 == 0:
            docs.append((len(docs), " ".join([*prose(25), "mail", f"x{i}@host.org", *prose(3)])))
    docs += [(len(docs), None), (len(docs) + 1, ""), (len(docs) + 2, " ".join(prose(8) * 6))]
    write(spark, tmp_path, docs, [], items)
    got = {x.doc_id: x.ids for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    # without labels only the base rules reject
    texts = {i: t for i, t in docs if good_enough(t)}
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    texts = {i: t for i, t in texts.items() if find(i) == i}

    def leaks(text):
        ids, rule = decontaminate.WordIds(), decontaminate.Overlap()
        words = decontaminate.tokens(text, ids)
        others = [decontaminate.tokens(item, ids) for _, item in items]
        return any(decontaminate.best_overlap(words, o, range(1 - len(o), len(words)), rule) for o in others)

    texts = {i: re.sub(r"\S+@host\.org", "[EMAIL]", t) for i, t in texts.items() if not leaks(t)}
    assert sorted(got) == sorted(texts) and 30 < len(got) < len(docs) - 20 and any("[EMAIL]" in t for t in texts.values())
    model = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    for i, text in texts.items():
        units, want = pieces.UNIT.findall(" " + text), []
        keys = pieces.mix(np.arange(len(units), dtype=np.uint64) * np.uint64(pieces._UNIT) + np.uint64(pieces.xxhash.xxh64_intdigest(str(i), 7))).tolist()
        for unit, key in zip(units, keys, strict=True):
            want += naive_merge(model, unit.replace(" ", "▁"), 0.1, key)
        assert got[i] == want
