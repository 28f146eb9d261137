"""Exact removal of repeated substrings by a distributed merge sort of suffixes.

Bytes covered by a ``LENGTH``-byte string that starts anywhere else are removed. Each
window of that length has an anchor, the smallest hash among its ``GRAM``-byte grams, so
equal windows have equal anchors at equal offsets; sorting the suffixes at anchors is
enough. Anchors whose gram is unique go early. Of the others, each task sorts the suffixes
it has, front-codes them (length of the prefix shared with the one before, then the rest)
and sends these runs by ranges of the gram's hash. A loser tree that keeps common-prefix
lengths merges the runs without comparing known prefixes again, and its output has the
common prefix of neighbours, from which, with the left contexts, the repeated windows follow.
Everything that decides is a comparison of bytes; hashes only bring candidates together.

There are as many ranges as it takes for about ``RANGE_BYTES`` in each, whatever the input.

An anchor's group with more than ``MAX_GROUP`` members is not gathered: its windows are
counted one by one by a 128-bit hash, which is dealt over all tasks.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvspark.llm.base import remove, shared_folder, text_batches
from kvspark.llm.words import bit_table, in_table, mix

LENGTH, GRAM = 400, 64
MAX_GROUP = 30_000
PIECE = 1 << 18
RUN_BYTES, RANGE_BYTES = 8 << 20, 24 << 20
_STEP = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_STEP, -1, 1 << 64)
_TABLE = np.array([xxhash.xxh64_intdigest(bytes([b]), 11) for b in range(256)], np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each ``gram`` bytes, from prefix sums of a polynomial modulo 2**64."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * _powers(_STEP, n), out=sums[1:])
    out = (sums[gram:] - sums[:-gram]) * _powers(_INVERSE, n - gram + 1)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def _first_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest value in each window of ``width``, by doubling."""
    low, at, size = values, np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        right = low[step:] < low[:-step]
        at = np.where(right, at[step:], at[:-step])
        low = np.minimum(low[step:], low[:-step])
        size += step
    return at


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> list[np.ndarray]:
    """[hash, place, lo, hi] of the anchors of one text: windows that start ``lo`` to ``hi`` bytes before the place have it."""
    found = []
    for begin in range(0, max(0, len(data) - length + 1), PIECE):
        part = data[begin : begin + PIECE + length - 1]
        hashes = gram_hashes(part, gram)
        at = _first_smallest(hashes, length - gram + 1)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:], [len(at)]]) - 1
        place = at[first]
        # smallest hashes crowd at the low end; mixed once more they are even, and so are the ranges they are dealt by
        found.append([mix(hashes[place]).view(np.int64), place + begin, place - last, place - first])
    return [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(4)]


def front_code(entries: list[tuple[bytes, bytes]]) -> bytes:
    """A sorted run of (key, payload): shared prefix, sizes, rest of the key, payload."""
    out, before = [], b""
    for key, payload in entries:
        n = shared(before, key, 0)
        out.append(n.to_bytes(4, "little") + (len(key) - n).to_bytes(4, "little") + len(payload).to_bytes(4, "little"))
        out += (key[n:], payload)
        before = key
    return b"".join(out)


def shared(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that share ``known`` bytes already."""
    end = min(len(a), len(b))
    if a[known:end] == b[known:end]:
        return end
    low, high = known, end  # a[known:low] equals b's, a[known:high] does not
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def read_run(run: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(prefix shared with the one before, key, payload) of a front-coded run."""
    at, key = 0, b""
    while at < len(run):
        n, rest, size = (int.from_bytes(run[at + k : at + k + 4], "little") for k in (0, 4, 8))
        at += 12
        key = key[:n] + run[at : at + rest]
        at += rest
        yield n, key, run[at : at + size]
        at += size


def merge_runs(runs: list[bytes]) -> Iterator[tuple[int, bytes, bytes]]:
    """All entries in order, each with the prefix that it shares with the one before.

    A loser tree over the runs. Each waiting entry knows the prefix it shares with the last
    winner: the longer one is smaller; only equal lengths are compared, from there on.
    """
    readers = [read_run(r) for r in runs]
    k = 1
    while k < len(readers):
        k *= 2
    done = (-1, None, b"")
    heads = [next(r, done) for r in readers] + [done] * (k - len(readers))
    common = [0 if h[1] is not None else -1 for h in heads]
    losers = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser then knows what it shares with the winner."""
        ka, kb = heads[a][1], heads[b][1]
        if ka is None or kb is None:
            return (b, a) if ka is None else (a, b)
        ca, cb = common[a], common[b]
        if ca != cb:
            return (a, b) if ca > cb else (b, a)
        n = shared(ka, kb, ca)
        if n == len(ka) or (n < len(kb) and ka[n] < kb[n]):
            common[b] = n
            return a, b
        common[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if k > 1 else 0
    while heads[winner][1] is not None:
        _, key, payload = heads[winner]
        yield common[winner], key, payload
        heads[winner] = head = next(readers[winner], done)
        common[winner] = head[0]  # with its predecessor in the run, which has just won
        node = (winner + k) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def _classes(order: np.ndarray, lcp: np.ndarray, depth: int) -> np.ndarray:
    """Numbers of the members such that those sharing ``depth`` bytes have the same."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], lcp[1:] < depth]))
    return out


def repeated(members: list[tuple[int, bytes, bytes, int, int]], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Offset ranges [from, to] at which each member's window occurs in another member.

    members: (shared with the one before, right context, left context, lo, hi) in the order of the right contexts.
    A window at offset l is l bytes to the left and length - l to the right.
    """
    n = len(members)
    if n == 2:
        (_, _, left_a, lo_a, hi_a), (right, _, left_b, lo_b, hi_b) = members
        left = shared(left_a[::-1], left_b[::-1], 0)
        low, high = max(lo_a, lo_b, length - right), min(hi_a, hi_b, left)
        return [[(low, high)], [(low, high)]] if low <= high else [[], []]
    right = np.array([m[0] for m in members], np.int64)
    right[0] = 0
    mirrored = [m[2][::-1] for m in members]
    order = np.array(sorted(range(n), key=mirrored.__getitem__))
    left = np.array([0, *(shared(mirrored[a], mirrored[b], 0) for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True))], np.int64)
    lo, hi = (np.array([m[k] for m in members], np.int64) for k in (3, 4))
    # between these offsets no class and no range changes
    cuts = np.unique(np.concatenate([lo, hi + 1, left + 1, length - right]))
    cuts = cuts[(cuts >= lo.min()) & (cuts <= hi.max() + 1)]
    straight, out = np.arange(n), [[] for _ in range(n)]
    for begin, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        inside = np.flatnonzero((lo <= begin) & (begin <= hi))
        if len(inside) < 2:
            continue
        both = (_classes(straight, right, length - begin) * n + _classes(order, left, begin))[inside]
        _, which, counts = np.unique(both, return_inverse=True, return_counts=True)
        for m in inside[counts[which] > 1].tolist():
            if out[m] and out[m][-1][1] == begin - 1:
                out[m][-1] = (out[m][-1][0], stop - 1)
            else:
                out[m].append((begin, stop - 1))
    return out


def _bytes(batch: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
    for text in batch.column(batch.schema.get_field_index(name)):
        yield np.frombuffer(text.as_buffer() or b"", np.uint8)


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(data, length, gram)[0] for data in _bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], ["h"])

    return run


def _chosen(batch: pa.RecordBatch, length: int, gram: int, twice, large, want_large: bool) -> Iterator[tuple[bytes, bytes, int, int, int, int]]:
    """(owner, text, hash, place, lo, hi) of the anchors that are not unique, of the large groups or of the others."""
    for k1, k2, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _bytes(batch, "text"), strict=True):
        if len(data) < length:
            continue
        found = anchors(data, length, gram)
        keep = in_table(twice, found[0])
        if large is not None:
            keep &= in_table(large, found[0]) == want_large
        if keep.any():
            owner, text = k1.to_bytes(8, "big", signed=True) + k2.to_bytes(8, "big", signed=True), data.tobytes()
            for h, place, lo, hi in zip(*(f[keep].tolist() for f in found), strict=True):
                yield owner, text, h, place, lo, hi


def _run_rows(length: int, gram: int, parts: int, twice, large):
    """Front-coded sorted runs of the suffixes at a task's anchors, one row for a run and range of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[bytes, bytes]]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            ranges = sorted(waiting)
            runs = [front_code(sorted(waiting[r])) for r in ranges]
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(ranges, pa.int64()), pa.array(runs, pa.binary())], ["range", "run"])

        for batch in batches:
            for owner, text, h, place, lo, hi in _chosen(batch, length, gram, twice.value, large and large.value, False):
                h %= 1 << 64
                key = h.to_bytes(8, "big") + text[place : place + length - lo]
                payload = owner + place.to_bytes(8, "big") + lo.to_bytes(4, "big") + hi.to_bytes(4, "big") + text[place - hi : place]
                waiting.setdefault(h * parts >> 64, []).append((key, payload))
                size += len(key) + len(payload)
                if size >= RUN_BYTES:
                    yield flush()
                    size = 0
        if waiting:
            yield flush()

    return run


def _merged_spans(length: int):
    """Spans of one range of hashes: merges its runs and settles group after group."""

    def settle(group: list[tuple[int, bytes, bytes]], out: list[tuple[int, int, int, int]]) -> None:
        members = [(n - 8, key, p[32:], int.from_bytes(p[24:28], "big"), int.from_bytes(p[28:32], "big")) for n, key, p in group]
        for (_, _, p), offsets in zip(group, repeated(members, length), strict=True):
            place = int.from_bytes(p[16:24], "big")
            for low, high in offsets:
                out.append((int.from_bytes(p[:8], "big", signed=True), int.from_bytes(p[8:16], "big", signed=True), place - high, place - low + length))

    def run(table: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        group: list[tuple[int, bytes, bytes]] = []
        for entry in merge_runs([r.as_py() for r in table.column("run")]):
            if entry[0] < 8:  # another gram
                if len(group) > 1:
                    settle(group, out)
                group = []
            group.append(entry)
        if len(group) > 1:
            settle(group, out)
        return pa.table({n: pa.array([r[k] for r in out], pa.int64()) for k, n in enumerate(("k1", "k2", "start", "end"))})

    return run


def _window_rows(length: int, gram: int, twice, large):
    """Each window of the anchors in large groups, by its hash."""
    signed = lambda b: int.from_bytes(b, "big", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, ...]] = []
            for owner, text, _, place, lo, hi in _chosen(batch, length, gram, twice.value, large.value, True):
                for start in range(place - hi, place - lo + 1):
                    whole = xxhash.xxh3_128_digest(text[start : start + length])
                    rows.append((signed(whole[:8]), signed(whole[8:]), signed(owner[:8]), signed(owner[8:]), start))
                if len(rows) >= 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names)
                    rows = []
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names)

    names = ["w1", "w2", "k1", "k2", "start"]
    return run


def _cut_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k1, k2, data, spans, copies in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _bytes(batch, "text"), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                n = len(data)
                if copies > 1 and n >= length:
                    spans = [{"start": 0, "end": n}]
                joined: list[list[int]] = []
                for s in sorted(((s["start"], s["end"]) for s in spans or ()),):
                    if joined and s[0] <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], s[1])
                    else:
                        joined.append([*s])
                text, at, kept = data.tobytes(), 0, []
                for a, b in joined:
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                rows.append((k1, k2, n, sum(b - a for a, b in joined), len(joined), hashlib.sha256(b"".join(kept)).hexdigest(), [{"start": a, "end": b} for a, b in joined]))
            kinds = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    return run


def cut_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, max_group: int = MAX_GROUP) -> DataFrame:
    """One row per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (byte ranges, end exclusive).

    Null texts count as empty: nothing to remove. Repeated rows are copies of each other: all their bytes go if there
    are ``length`` or more. Texts that are equal are worked on once. Nothing is capped.
    """
    spark = df.sparkSession
    text_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    name = f"suffixes_{uuid.uuid4().hex}"
    folder = f"{shared_folder(spark)}/{name}"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2"), text.alias("text"), F.col(id_col).alias("doc_id"))
    # the only shuffle of texts; written in buckets, so that the spans can be joined to them without another
    once = rows.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    once.write.bucketBy(parts, "k1", "k2").option("path", f"{folder}/texts").option("compression", "zstd").saveAsTable(name)
    texts = spark.table(name)
    counts = texts.select("text").mapInArrow(_anchor_rows(length, gram), "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    counts.write.parquet(f"{folder}/twice")
    twice = spark.read.parquet(f"{folder}/twice")
    hot = twice.filter(F.col("n") > max_group)
    members = twice.agg(F.sum("n")).first()[0] or 0
    ranges = max(2 * parts, -(-members * 2 * length // RANGE_BYTES))
    table = spark.sparkContext.broadcast(bit_table(twice))  # a fixed number of bits
    large = None if hot.isEmpty() else spark.sparkContext.broadcast(bit_table(hot))
    named = texts.select("k1", "k2", "text")
    runs = named.mapInArrow(_run_rows(length, gram, ranges, table, large), "range long, run binary")
    spans = runs.groupBy("range").applyInArrow(_merged_spans(length), "k1 long, k2 long, start long, end long")
    if large is not None:
        named.mapInArrow(_window_rows(length, gram, table, large), "w1 long, w2 long, k1 long, k2 long, start long").write.parquet(f"{folder}/windows")
        windows = spark.read.parquet(f"{folder}/windows")
        # written first, so that both sides of the join are plain exchanges and a window with many members can be split
        windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n > 1").select("w1", "w2").write.parquet(f"{folder}/again")
        again = spark.read.parquet(f"{folder}/again")
        spans = spans.unionByName(windows.join(again, ["w1", "w2"]).select("k1", "k2", "start", (F.col("start") + length).alias("end")))
    by_text = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    cut = texts.join(by_text, ["k1", "k2"], "left").select("k1", "k2", "text", "spans", "copies")
    out = "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>"
    cut.mapInArrow(_cut_rows(length), out).write.parquet(f"{folder}/cut")
    spark.sql(f"DROP TABLE {name}")
    for part in ("texts", "twice", "windows", "again"):
        remove(spark, f"{folder}/{part}")
    # a text with many copies is one row on the right; on the left, a plain exchange, it can be split
    return rows.select("k1", "k2", "doc_id").join(spark.read.parquet(f"{folder}/cut"), ["k1", "k2"]).drop("k1", "k2")
