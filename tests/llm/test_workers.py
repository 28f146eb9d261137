import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from kvspark.llm import decontaminate, importance, near_copies, pieces, simhash, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
EDGE = [None, "", " ", "a", "Hello  world\n\tfoo é 你好 ", "don't we'll 123 x²³ \u0085y\u00a0z\x1cq", "a<|endoftext|>b <|endoftext|>", "x" * 20000, "日本語 текст ελ ا ﷽ 🎉 ᲀ ꟍ", "\n", " \n x", "▁a ▁"]


def naive_fingerprint(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    r = random.Random(1)
    for text in [*EDGE, "One Two three", "É a b c d", " ".join(r.choice("abcdef") for _ in range(500))]:
        assert simhash.fingerprint(text) == naive_fingerprint(text)


def random_marks(n, seed):
    r, out = random.Random(seed), []
    for _ in range(n):
        base = r.choice(out) if out and r.random() < 0.7 else r.getrandbits(64)
        for _ in range(r.randint(0, 6)):
            base ^= 1 << r.randrange(64)
        out.append(base)
    return sorted(set(out))


def test_near_pairs_lose_and_repeat_nothing(spark):
    marks = [0, (1 << 64) - 1, 1 << 63, *random_marks(400, 2)]
    marks = sorted(set(marks))
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    df = spark.createDataFrame([(m,) for m in signed], "mark long")
    got = [tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)))) for r in simhash.near_pairs(df).collect()]
    want = {(a, b) for i, a in enumerate(marks) for b in marks[i + 1 :] if (a ^ b).bit_count() <= 4}
    assert len(got) == len(set(got)) and set(got) == want
    with pytest.raises(ValueError):
        simhash.near_pairs(df, distance=7, groups=7)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(205, 203), (203, 201), (201, 205), (7, 7)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), **dict.fromkeys((201, 203, 205), 201)}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_duplicates_and_keep_one(spark):
    words = [f"w{i}" for i in range(200)]
    texts = [(5, " ".join(words)), (3, " ".join(words)), (9, " ".join([*words[:199], "other"])), (1, "quite another text of its own"), (7, None), (8, ""), (None, " ".join(words)), (3, " ".join(words))]
    df = spark.createDataFrame([(i, t, "m") for i, t in texts], "doc_id long, text string, mark string")
    rows = simhash.simhash_report(df).collect()
    assert len(rows) == len(texts)
    of = {r.doc_id: r for r in rows}
    assert of[5].component_id == of[3].component_id == 3 and of[7].component_id == of[8].component_id == 7
    assert of[7].fingerprint == "0" * 16 and of[1].fingerprint == f"{naive_fingerprint('quite another text of its own'):016x}"
    near = (naive_fingerprint(texts[0][1]) ^ naive_fingerprint(texts[2][1])).bit_count() <= 4
    assert of[9].component_id == (3 if near else 9)
    kept = near_copies.keep_one(df)  # 9 shares 195 of 197 shingles with the others
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "7", "None"]
    assert near_copies.keep_one(df.limit(0)).count() == 0
    twice = df.filter("doc_id = 1").unionByName(df.filter("doc_id = 1"))
    assert [r.doc_id for r in near_copies.keep_one(twice).collect()] == [1]


def test_copies_in_small_files_are_not_broadcast(spark, tmp_path):
    """Their size is guessed from the files, so at scale all rows of such a table went through the driver."""
    path = str(tmp_path / "copies")
    spark.range(20000).selectExpr("id AS doc_id", "concat('some words that are repeated in copy number ', id % 3) AS text").write.parquet(path)
    df = spark.read.parquet(path)
    for out in (simhash.near_duplicates(df), near_copies.groups_of(df)):
        assert "BuildLeft" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == 20000
    marks = [simhash.fingerprint(f"some words that are repeated in copy number {k}") for k in range(3)]
    assert all((marks[0] ^ m).bit_count() > 4 for m in marks[1:])
    assert {(r.id % 3, r.component_id) for r in simhash.near_duplicates(df).collect()} == {(k, k if (marks[1] ^ marks[2]).bit_count() > 4 else min(k, 1)) for k in range(3)}
    wanted = spark.createDataFrame([(1, 1, 1)], "number long, digest long, node long")
    made = near_copies.sets_of(near_copies._marked(df, "doc_id", "text", "number", "digest"), wanted, 5)
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()


def test_seeds_of_many_texts_at_a_time(spark, monkeypatch):
    r = random.Random(4)
    texts = [None, "", *(" ".join(r.choice("abcdefgh") for _ in range(r.choice([0, 1, 3, 11, 12, 13, 50]))) for _ in range(300)), "x y " * 30000, "a b c"]
    ids, masks = decontaminate.WordIds(), [*decontaminate.MASKS, "11"]
    groups = list(decontaminate.joined_tokens(pa.array(texts), ids))
    assert len(groups) < 4  # one for each text, before
    everything = np.full(1 << 24, 255, np.uint8)
    df = spark.createDataFrame([(i, -i, t) for i, t in enumerate(texts)], "k1 long, k2 long, text string").coalesce(1)
    got = {(x.k1, x.k2, x.h, x.place) for x in decontaminate.hits_of(df, masks, spark.sparkContext.broadcast(everything)).collect()}
    want = set()
    for i, text in enumerate(texts):
        words = decontaminate.tokens(text, ids)
        for mask in masks:
            want |= {(i, -i, h, place) for place, h in enumerate(decontaminate.seed_hashes(words, mask).view(np.int64).tolist())}
    assert got == want


def shingle_set(text):
    return set(simhash.shingle_hashes(text, 5).tolist())


def similar_texts(r, n, changes, start):
    """Pairs of texts of ``n`` words, the second with the given numbers of words changed: (id, text) twice for each."""
    rows = []
    for k, c in enumerate(changes):
        words = [f"w{start + k}x{r.randrange(10**6)}" for _ in range(n)]
        other = list(words)
        for at in r.sample(range(n), c):
            other[at] = f"new{r.randrange(10**9)}"
        rows += [(start + 2 * k, " ".join(words)), (start + 2 * k + 1, " ".join(other))]
    return rows


def test_similarity_of_long_texts_is_exact(spark):
    rows = similar_texts(random.Random(3), 600, [10, 11, 12, 13, 14, 15] * 6, 0)
    sets = dict((i, shingle_set(t)) for i, t in rows)
    want = {k: len(sets[k] & sets[k + 1]) / len(sets[k] | sets[k + 1]) for k in range(0, len(rows), 2)}
    df = spark.createDataFrame([(i, sorted(x - (1 << 64) if x >> 63 else x for x in s)) for i, s in sets.items()], "node long, shingles array<long>")
    pairs = spark.createDataFrame([(k, k + 1) for k in want], "a long, b long")
    assert {r.a for r in near_copies.alike(pairs, df, 0.8).collect()} == {k for k, j in want.items() if j >= 0.8}
    assert any(0.78 < j < 0.8 for j in want.values()) and any(0.8 <= j < 0.82 for j in want.values())
    assert near_copies.alike(spark.createDataFrame([(0, 1)], "a long, b long"), spark.createDataFrame([(0, []), (1, [])], "node long, shingles array<long>"), 0.8).count() == 1


def test_all_similar_pairs_are_linked(spark):
    r, rows = random.Random(9), []
    for n, most in ((6, 1), (30, 1), (60, 1), (120, 3), (600, 12)):
        rows += similar_texts(r, n, [r.randint(1, most) for _ in range(30)], len(rows))
    line = " ".join(f"license{k}" for k in range(30))  # common to many
    rows = [(i, f"{t} {line}" if i % 3 == 0 else t) for i, t in rows]
    rows += [(5000 + k, " ".join([*(f"g{x}" for x in range(100)), f"end{k}"])) for k in range(60)] + [(6000, ""), (6001, None), (6002, "one two")]
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in sets.items():
        for k, b in sets.items():
            if i < k and (len(a & b) >= 0.8 * len(a | b)):
                x, y = sorted((find(i), find(k)))
                root[y] = x
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.id: x.low.id for x in near_copies.groups_of(df).collect()}
    assert got == {i: find(i) for i in sets}
    assert sum(find(i) == find(i + 1) for i in range(0, 300, 2)) > 40
    assert {x.doc_id for x in near_copies.keep_one(df).collect()} == {find(i) for i in sets}


@pytest.mark.parametrize("order", ["unknown", "backwards"])
def test_groups_do_not_depend_on_the_learned_order(spark, monkeypatch, order):
    """Counts of shingles, which come from a share of the documents, only order the shingles: other counts give the same groups."""
    r, rows = random.Random(5), []
    for n, most in ((30, 1), (120, 4)):
        rows += similar_texts(r, n, [r.randint(1, most) for _ in range(20)], len(rows))
    line = " ".join(f"license{k}" for k in range(12))
    df = spark.createDataFrame([(i, f"{t} {line}" if i % 3 else t) for i, t in rows], "doc_id long, text string")
    want = {x.id: x.low.id for x in near_copies.groups_of(df).collect()}
    learned = near_copies.common_shingles

    def other(texts, n, shingle):
        common, counts = learned(texts, n, shingle)
        assert len(common)
        return (common[:0], counts[:0]) if order == "unknown" else (common, counts.max() + 1 - counts)

    monkeypatch.setattr(near_copies, "common_shingles", other)
    assert {x.id: x.low.id for x in near_copies.groups_of(df).collect()} == want
    sets = {i: shingle_set(t) for i, t in ((x.doc_id, x.text) for x in df.collect())}
    assert all(want[i] == want[k] for i in sets for k in sets if i < k and len(sets[i] & sets[k]) >= 0.8 * len(sets[i] | sets[k]))
    assert 0 < sum(i != low for i, low in want.items()) < len(rows)


def test_token_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = token_counts.load(path)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(EDGE)], "doc_id long, text string, n_tokens string")
    rows = {r.doc_id: r for r in token_counts.count_tokens(df, path, limit=10).collect()}
    for i, text in enumerate(EDGE):
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        assert (rows[i].n_bytes, rows[i].n_tokens, rows[i].over_limit) == (len((text or "").encode()), n, n > 10), text
    assert token_counts.count_tokens(df.limit(0), path).collect() == []


def test_pieces_are_the_librarys_without_dropout():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    encoder = pieces.Encoder(path, 0.0, 1)
    for text in filter(None, EDGE):
        assert encoder.encode_all([text], [0])[0].tolist() == library.encode(text), text


def naive_merge(model, unit, dropout, key):
    """One agenda, written out: all neighbours, the best rank first, then the leftmost; a candidate that its draw skips does not come again until a side changes."""
    parts, skipped = [(i, c) for i, c in enumerate(unit)], set()
    while True:
        found = []
        for (i, a), (j, b) in zip(parts, parts[1:]):
            if a + b in model.ranks and (i, len(a), a + b) not in skipped:
                found.append((model.ranks[a + b], i, j, a + b, len(a)))
        if not found:
            break
        _, i, j, joined, split = min(found)
        x = (key + i * 0x9E3779B97F4A7C15 + split * 0xC2B2AE3D27D4EB4F + model.ids[joined] * 0x165667B19E3779F9) % 2**64
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        if x ^ x >> 31 < int(dropout * 2**64):
            skipped.add((i, split, joined))
            continue
        parts = [(k, joined if k == i else p) for k, p in parts if k != j]
    return [x for _, p in parts for x in ([model.ids[p]] if p in model.ids else [model.byte_ids[b] for b in p.encode()])]


def test_agendas_agree_with_a_naive_one():
    path, r = public_tokenizers.path("piece_bpe_32k.model"), random.Random(6)
    for dropout in (0.0, 0.1, 0.5, 0.9):
        encoder = pieces.Encoder(path, dropout, 3)
        words = ["".join(r.choice("etaoinshrdlué日x☃ ") for _ in range(n)) for n in (1, 2, 3, 5, 8, 13, 20, 40, 48, 49, 90) for _ in range(12)]
        texts = [" ".join(words), "international organisations of the world", "\n\n a  b ", "", "th" * 24, "naïve\u2581word \u2581", "x"]
        got = encoder.encode_all(texts, range(len(texts)))
        for number, (text, ids) in enumerate(zip(texts, got, strict=True)):
            want = []
            units = pieces.UNIT.findall(" " + text) if text else []
            keys = pieces.mix(np.arange(len(units), dtype=np.uint64) * np.uint64(pieces._UNIT) + np.uint64(xxhash.xxh64_intdigest(str(number), 3))).tolist()
            for unit, key in zip(units, keys, strict=True):
                if dropout and "\u2581" in unit:
                    at = 0
                    for part in re.split("(\u2581)", unit):
                        want += [encoder.pieces.byte_ids[b] for b in part.encode()] if part == "\u2581" else naive_merge(encoder.pieces, part.replace(" ", "\u2581"), dropout, key + at * pieces._START)
                        at += len(part)
                else:
                    want += naive_merge(encoder.pieces, unit.replace(" ", "\u2581"), dropout, key)
            assert ids.tolist() == want, (dropout, text[:50])


def test_pieces_with_dropout(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [*EDGE, "international organisations " * 20]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    one, two = (pieces.encode(df, path, 0.3, seed, with_ids=True) for seed in (1, 2))
    assert all(r.lossless for r in one.collect())
    a, b = ({r.doc_id: r.ids for r in x.collect()} for x in (one, two))
    assert a == {r.doc_id: r.ids for r in one.collect()} and a != b
    last = len(texts) - 1
    plain = len(pieces.Encoder(path, 0.0, 1).encode(texts[last], 0)) // 4
    assert len(a[last]) > plain
    back = {r.doc_id: r.text for r in pieces.decode(one.drop("text"), path).collect()}
    assert [back[i] for i in range(len(texts))] == [t or "" for t in texts]


def test_each_candidate_draws_on_its_own():
    path, text = public_tokenizers.path("piece_bpe_32k.model"), "international " * 3000
    encoder = pieces.Encoder(path, 0.1, 7)
    ids = encoder.encode_all([text], [5])[0].tolist()
    assert encoder.encode(text, 5) != encoder.encode(text, 6)
    starts = [k for k, i in enumerate(ids) if encoder.pieces.strings[i].startswith("\u2581")]
    assert len({tuple(ids[a:b]) for a, b in zip(starts, starts[1:])}) > 30  # ways to cut one word
    names, counts = encoder.pieces.ids, []
    assert "th" in names
    for unit in ("th" * 20, "th" * 200):  # equal candidates in one unit, short or long
        half = pieces.Encoder(path, 0.5, 7)
        for key in range(50):
            merged = half.encode_all([unit], [key])[0].tolist()
            counts.append(sum(i == names["t"] for i in merged) * 40 / len(unit))
    assert 4 < sum(counts) / len(counts) < 16 and sum(0 < c < 20 for c in counts) > 90


ITEMS = [(1, "the quick brown fox jumps over the lazy dog while nine wizards quietly mix seven odd potions tonight"), (2, "short one"), (3, None)]


def test_overlaps(spark):
    words = ITEMS[0][1].split()
    swapped = [*words[:5], "XX", *words[6:11], "YY", *words[12:]]
    filler = " ".join(f"f{k}" for k in range(50))
    docs = [(1, filler + " " + " ".join(words) + " " + filler), (2, " ".join(swapped)), (3, filler), (4, None), (5, ""), (6, " ".join(words[:6]) + " " + filler), (7, " ".join(words).upper().replace(" ", " - ")), (7, "nothing here")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = decontaminate.find_overlaps(df, items).collect()
    assert sorted(r.doc_id for r in rows) == [1, 2, 7] and {r.item_id for r in rows} == {1}
    assert next((r.start_token, r.end_token, r.n_equal) for r in rows if r.doc_id == 1) == (50, 50 + len(words), len(words))
    assert next(r.n_equal for r in rows if r.doc_id == 2) == len(words) - 2
    clean = decontaminate.clean_documents(df, items)
    assert clean.columns == df.columns and sorted(r.doc_id for r in clean.collect()) == [3, 4, 5, 6, 7]
    assert decontaminate.find_overlaps(df, items.limit(0)).count() == 0 and decontaminate.clean_documents(df.limit(0), items).count() == 0


def test_spaced_seeds_tolerate_substitutions():
    base = np.arange(40, dtype=np.uint64)
    for mask in decontaminate.MASKS[1:]:
        changed = base.copy()
        changed[10 + mask.index("0")] = 999
        assert decontaminate.seed_hashes(base, mask)[10] == decontaminate.seed_hashes(changed, mask)[10]


def test_every_accepted_overlap_has_a_seed(spark):
    r, items, docs, want = random.Random(12), [], [], set()
    for n in [*range(1, 31), 60]:
        item = [f"item{n}x{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        for _ in range(40):
            words = list(item)
            for at in r.sample(range(n), n // 5):
                words[at] = "other"
            want.add((len(docs), n))
            docs.append((len(docs), "a b " + " ".join(words) + " c"))
        if n < 13:  # too many substitutions
            docs.append((len(docs), " ".join(item[: n - n // 5 - 1] + ["other"] * (n // 5 + 1))))
    items.append((100, "今天天气很好我们一起去公园散步吧"))
    want.add((len(docs), 100))
    docs += [(len(docs), f"他说{items[-1][1]}然后走了 and left"), (len(docs) + 1, "他说然后走了今天天气不好")]
    found = decontaminate.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x.doc_id, x.item_id) for x in found.collect()} == want


def test_overlaps_match_brute_force(spark):
    r, rule = random.Random(4), decontaminate.Overlap(min_tokens=6, max_subs=0.25)
    letters = "abcdefgh"
    items = [(i, " ".join(r.choice(letters) for _ in range(r.choice([3, 6, 9, 15, 30])))) for i in range(12)] + [(50, " ".join(["same"] * 40))]
    docs = []
    for i in range(60):
        words = r.choice(items[:12])[1].split() if i % 2 else []
        words = [w if r.random() > 0.15 else r.choice(letters) for w in words]
        docs.append((i, " ".join([*(r.choice(letters) for _ in range(r.randint(0, 25))), *words, *(r.choice(letters) for _ in range(10))])))
    docs += [(90, " ".join(["same"] * 3000)), (90, docs[1][1]), (91, None)]
    want = set()
    for i, text in docs:
        ids = decontaminate.WordIds()
        words = decontaminate.tokens(text, ids)
        for k, item in items:
            other = decontaminate.tokens(item, ids)
            best = decontaminate.best_overlap(words, other, range(1 - len(other), len(words)), rule)  # all diagonals
            if best:
                want.add((i, k, best[3]))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_overlaps(df, bench, rule).collect()
    assert {(x.doc_id, x.item_id, x.n_equal) for x in got} == want and len(want) > 30
    assert {x.doc_id for x in decontaminate.clean_documents(df, bench, rule).collect()} == {i for i, _ in docs} - {w[0] for w in want}


def test_top_k_is_exact(spark):
    r = random.Random(4)
    values = [r.gauss(0, 1e3) for _ in range(500)] + [1.0] * 50 + [1.0 + 1e-13, -1e300, 1e300]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ranked = sorted(values, reverse=True)
    for k in (1, 2, 10, 250, len(values), len(values) + 5):
        last = ranked[min(k, len(values)) - 1]
        assert sorted(x.v for x in importance.top_k(df, "v", k).collect()) == sorted(v for v in values if v >= last)
    assert importance.top_k(df, "v", 0).count() == 0 and importance.top_k(df.limit(0), "v", 3).count() == 0


def test_resampling_prefers_the_target(spark):
    r = random.Random(5)
    good = lambda: " ".join(r.choice(["river", "stone", "bridge", "water", "green", "hill"]) for _ in range(60))
    bad = lambda: " ".join(r.choice(["buy", "cheap", "pills", "click", "win", "cash"]) for _ in range(60))
    docs = [(i, good() if i % 2 else bad()) for i in range(400)] + [(None, None), (401, "")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    kept = importance.resample(df, labels)
    held_out = [x.doc_id for x in kept.collect() if x.doc_id is not None and 200 <= x.doc_id < 400]
    assert sum(i % 2 for i in held_out) >= 0.98 * len(held_out) and len(held_out) >= 95
    assert {tuple(x) for x in kept.collect()} == {tuple(x) for x in kept.repartition(2).collect()}
    assert importance.resample(df, labels.limit(0)).count() == len(docs)
    assert importance.resample(df.limit(0), labels).count() == 0


def test_sketches_bound_the_difference(spark):
    r, rows = np.random.default_rng(3), []
    for n, m, changed in ((0, 0, 0), (5, 5, 1), (150, 150, 20), (500, 530, 40), (700, 600, 90), (3000, 2500, 300)):
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[changed : min(n, m)], r.integers(0, 1 << 63, m - min(n, m) + changed, dtype=np.uint64)]))
        rows.append([near_copies.odd_sketch(x, near_copies.sketch_longs(len(x))).tolist() for x in (a, b)] + [len(np.setxor1d(a, b))])
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, differ int")
    got = df.select("differ", near_copies.sketch_distance(df.a, df.b).alias("d")).collect()
    assert all(x.d <= x.differ and x.d % 2 == x.differ % 2 for x in got) and sum(x.d > 0.5 * x.differ for x in got) >= 5
    long, short = near_copies.odd_sketch(np.arange(999, dtype=np.uint64), 16), near_copies.odd_sketch(np.arange(999, dtype=np.uint64), 8)
    assert (long[:8] ^ long[8:] == short).all()
