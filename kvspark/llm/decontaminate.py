"""Benchmark decontamination by seeds.

A seed is a fixed mask over up to ``SPAN`` neighbouring tokens; positions that it ignores may
differ. The masks' hashes of all benchmark items are joined with those of the documents, and each hit fixes a
diagonal between a document and an item. A table of bits of fixed size keeps hashes that no item has from the join.
Along the diagonal the best stretch is found that tolerates substitutions, and
reported if it is long enough. Besides the fixed masks, each item has a run of equal tokens as a
mask that is short enough for any overlap that the rule accepts (``run_length``), so none is missed.
Scripts without spaces are cut into characters. Neither the benchmark nor the hits go to the driver.
"""

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvspark.llm.base import checkpoint, fresh, text_batches
from kvspark.llm.words import WordIds, bit_table, in_table, mix, per_worker, slices

# Masks of one span; 1 is a token that counts, 0 one that may differ.
MASKS = ("11111111", "110101101011", "111001011001", "101100110111")
SPAN = 12
#: Thai, Lao, Burmese, Khmer, kana and Han: each character is a token.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
TOKEN = re.compile(rf"[^\W{_UNSPACED}]+|(?=\w)[{_UNSPACED}]")


@dataclass(frozen=True)
class Overlap:
    """min_tokens: equal tokens that an overlap needs (the item's own length, less what may differ, if that is shorter). max_subs: share of
    positions in it that may differ."""

    min_tokens: int = 13
    max_subs: float = 0.2


#: Digests that are broadcast at most; more are joined by a shuffle.
SENT = 200_000
#: Tokens of neighbouring texts that are hashed at a time; a text that has more is hashed whole.
JOINED = 1 << 15


def tokens(text: str | None, ids: WordIds) -> np.ndarray:
    return ids.of(TOKEN.findall((text or "").lower()))


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at each position where it fits whole; equal for equal tokens under the same mask only."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, xxhash.xxh64_intdigest(mask), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    return mix(out)


def joined_tokens(texts: Iterable, ids: WordIds) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, tokens of some neighbouring texts, end of each in them): one array for many short texts saves most of the time that small arrays take."""
    first, parts, size = 0, [], 0
    for k, text in enumerate(texts):
        parts.append(tokens(text.as_py(), ids))
        size += len(parts[-1])
        if size >= JOINED:
            yield first, np.concatenate(parts), np.cumsum([len(p) for p in parts])
            first, parts, size = k + 1, [], 0
    if parts:
        yield first, np.concatenate(parts), np.cumsum([len(p) for p in parts])


def needed(n: int, rule: Overlap) -> int:
    """Equal tokens that an overlap with an item of ``n`` tokens needs."""
    return min(rule.min_tokens, math.ceil(n * (1 - rule.max_subs) - 1e-9))


def run_length(n: int, rule: Overlap) -> int:
    """Neighbouring equal tokens that any overlap with an item of ``n`` tokens has: s equal tokens and d others leave a run of s / (d + 1)."""
    least, most = max(1, needed(n, rule)), n
    runs = [s for s in (n,) if s]
    for s in range(least, most + 1):
        d = min(n - s, math.floor(s * rule.max_subs / (1 - rule.max_subs) + 1e-9)) if rule.max_subs < 1 else n - s
        runs.append(-(-s // (d + 1)))
        if s >= 4 * rule.min_tokens:  # from here on runs differ by rounding only, upwards
            break
    return max(1, min(runs, default=1))


def best_stretch(equal: np.ndarray, max_subs: float) -> tuple[int, int]:
    """The longest-scoring stretch of a diagonal: a match adds ``max_subs``, a difference takes ``1 - max_subs``, so the share of differences in it is below ``max_subs``."""
    sums = np.concatenate([[0.0], np.cumsum(np.where(equal, max_subs, max_subs - 1.0))])
    lows = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - lows))
    start = int(np.flatnonzero(sums[: end + 1] == lows[end])[-1]) if end else 0
    return start, end


def widest_stretch(equal: np.ndarray, max_subs: float) -> tuple[int, int]:
    """The stretch with most equal positions of those in which the share of differences is at most ``max_subs``; both its ends are equal."""
    sums = np.concatenate([[0.0], np.cumsum(np.where(equal, max_subs, max_subs - 1.0))])
    lows, same = np.minimum.accumulate(sums), np.concatenate([[0], np.cumsum(equal)])
    starts = np.searchsorted(-lows, -(sums + 1e-9))  # the first from which the sum up to each end is not negative
    end = int(np.argmax(same - same[starts]))
    start = int(starts[end])
    inside = np.flatnonzero(equal[start:end])
    return (start + int(inside[0]), start + int(inside[-1]) + 1) if len(inside) else (0, 0)


def best_overlap(words: np.ndarray, item: np.ndarray, shifts: list[int], rule: Overlap) -> tuple[int, int, int, int] | None:
    """(start, end, item_start, equal tokens) on the diagonals ``shifts`` (document position minus item position): the one with most equal tokens, then the first."""
    best, need = None, needed(len(item), rule)
    for shift in sorted(shifts):
        low, high = max(0, shift), min(len(words), shift + len(item))
        equal = words[low:high] == item[low - shift : high - shift]
        if np.count_nonzero(equal) < (need if best is None else best[0]):
            continue
        start, end = best_stretch(equal, rule.max_subs)
        same = int(equal[start:end].sum())
        if same < need:  # shorter runs between differences than the score asks for
            start, end = widest_stretch(equal, rule.max_subs)
            same = int(equal[start:end].sum())
        if same >= need:
            new = (same, -(low + start), low + end, low + start - shift)
            best = new if best is None else max(best, new)
    return None if best is None else (-best[1], best[2], best[3], best[0])


def seeds_of(items: DataFrame, rule: Overlap) -> DataFrame:
    """(h, item, at): each seed of each item (item, text), and ``run``, the length of the item's run of equal tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in slices(batches):
            columns: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = tokens(text, ids)
                length = run_length(len(words), rule)
                for mask in dict.fromkeys([*MASKS, "1" * length]):
                    hashes = seed_hashes(words, mask)
                    for column, values in zip(columns, (hashes.view(np.int64), np.full(len(hashes), item), np.arange(len(hashes)), np.full(len(hashes), length)), strict=True):
                        column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in columns], ["h", "item", "at", "run"])

    return items.mapInArrow(run, "h long, item long, at long, run long")


def hits_of(texts: DataFrame, masks: list[str], table) -> DataFrame:
    """(k1, k2, h, place): seeds of the texts (k1, k2, text) that some item may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = per_worker("decontaminate words", WordIds)
        for batch in slices(batches):
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3]
            for first, words, ends in joined_tokens(batch.column(2), ids):
                for mask in masks:
                    hashes = seed_hashes(words, mask).view(np.int64)
                    at = np.flatnonzero(in_table(table.value, hashes))
                    text = np.searchsorted(ends, at, "right")
                    whole = at + len(mask) <= ends[text]  # not across two texts
                    at, text = at[whole], text[whole]
                    found.append((first + text, hashes[at], at - np.concatenate([[0], ends])[text]))
            row, h, place = (np.concatenate([f[c] for f in found]) for c in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(h), pa.array(place)], ["k1", "k2", "h", "place"])

    return texts.mapInArrow(run, "k1 long, k2 long, h long, place long")


def texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts (k1, k2, text) of the digests in ``wanted``, each once. Others go on the map side, by a table of bits of fixed size."""
    sent = texts.sparkSession.sparkContext.broadcast(bit_table(wanted.select(F.col("k1").alias("h"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(in_table(sent.value, batch.column(0).to_numpy(zero_copy_only=False))))

    some = texts.mapInArrow(run, "k1 long, k2 long, text string").join(wanted, ["k1", "k2"], "left_semi")
    return some.groupBy("k1", "k2").agg(F.first("text").alias("text"))


def _digests(docs: DataFrame, text_col: str, k1: str = "k1", k2: str = "k2") -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumns({k1: F.xxhash64(text), k2: F.xxhash64(F.lit("second"), text)})


def overlaps(texts: DataFrame, benchmark: DataFrame, rule: Overlap, item_col: str) -> DataFrame:
    """(k1, k2, item_id, start_token, end_token, item_start, n_equal, n_tokens) of each different text (k1, k2, text) and item that overlap."""
    text_batches(texts.sparkSession)
    items = checkpoint(benchmark.select(F.col(item_col).cast("long").alias("item"), F.col("text").alias("words")).dropna())
    seeds = checkpoint(seeds_of(items, rule))
    runs = [r[0] for r in seeds.select("run").distinct().collect()]  # a few short lengths, by the rule
    masks = list(dict.fromkeys([*MASKS, *("1" * k for k in sorted(runs))]))
    table = texts.sparkSession.sparkContext.broadcast(bit_table(seeds.select("h")))  # a fixed number of bits
    hits = hits_of(texts, masks, table).distinct().join(seeds.drop("run"), "h")
    pairs = checkpoint(hits.groupBy("k1", "k2", "item").agg(F.collect_set(F.col("place") - F.col("at")).alias("shifts")))
    table.unpersist()
    found = pairs.join(items, "item").join(texts_of(texts, pairs.select("k1", "k2").distinct()), ["k1", "k2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in slices(batches):
            rows = []
            for k1, k2, item, shifts, words, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                document = tokens(text, ids)
                best = best_overlap(document, tokens(words, ids), shifts, rule)
                if best:
                    rows.append((k1, k2, item, *best, len(document)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(8)], names)

    names = ["k1", "k2", "item_id", "start_token", "end_token", "item_start", "n_equal", "n_tokens"]
    return checkpoint(found.select("k1", "k2", "item", "shifts", "words", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names)))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, rule: Overlap | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per row of ``docs`` and item that it overlaps: doc_id, item_id, start_token, end_token, item_start, n_equal, n_tokens.

    Null and empty texts overlap nothing; repeated rows are reported alike. Items of fewer than five tokens
    are found whole only. Items without tokens or with a null id are not found. An empty benchmark gives no rows.
    """
    rows = _digests(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "text")
    found = overlaps(rows.select("k1", "k2", "text"), benchmark, rule or Overlap(), item_col)
    # merged, as the rows' size is guessed from compressed files: copies are many rows in few bytes, and would be broadcast
    return rows.select("doc_id", "k1", "k2").join(found.hint("merge"), ["k1", "k2"]).drop("k1", "k2")


def clean_documents(docs: DataFrame, benchmark: DataFrame, rule: Overlap | None = None, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows that overlap no item, columns unchanged. Rows of one text are judged alike; null and empty texts stay. Only the digests of leaks are looked up."""
    k1, k2 = fresh(docs, "k1", "k2")
    texts = _digests(docs.select(F.col(text_col).cast("string").alias("text")), "text").select("k1", "k2", "text")
    leaks = checkpoint(overlaps(texts, benchmark, rule or Overlap(), item_col).select(F.col("k1").alias(k1), F.col("k2").alias(k2)).distinct())
    leaks = F.broadcast(leaks) if leaks.count() <= SENT else leaks
    return _digests(docs, text_col, k1, k2).join(leaks, [k1, k2], "left_anti").select(docs.columns)
