"""Quality classifier by importance resampling.

Words and word pairs of a text are hashed to ``BUCKETS`` buckets. Two multinomial models,
one of the target texts and one of all raw texts, give each document the log of their
ratio. Gumbel noise, keyed by the document, is added, and the k largest sums are the
sample: drawing without replacement by importance weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvspark.llm.base import checkpoint
from kvspark.llm.words import LOWER, WORD, WordIds, mix, per_worker

BUCKETS = 1 << 14
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def features(text: str | None, ids: WordIds) -> np.ndarray:
    """Buckets of all words and all pairs of neighbours of the whole text, repeats included."""
    words = ids.of(WORD.findall((text or "").encode().translate(LOWER)))
    pairs = mix(words[:-1] * _PAIR + words[1:])
    return (np.concatenate([words, pairs]) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _ids() -> WordIds:
    return per_worker("importance words", WordIds)


def bucket_counts(df: DataFrame, targets: np.ndarray, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Features by bucket over all rows, and over those whose id is in ``targets`` (sorted): two vectors of ``BUCKETS`` numbers.

    Each task counts its own rows; what is shuffled is a row per task and bucket, and the driver gets ``BUCKETS`` rows.
    """
    sent = df.sparkSession.sparkContext.broadcast(targets)  # bounded by max_labelled

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target, ids, wanted = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), _ids(), sent.value
        for batch in batches:
            numbers = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(wanted, numbers), max(0, len(wanted) - 1))
            chosen = (wanted[at] == numbers) & batch.column(0).is_valid().to_numpy(zero_copy_only=False) if len(wanted) else np.zeros(len(numbers), bool)
            for text, is_target in zip(batch.column(1), chosen.tolist(), strict=True):
                counts = np.bincount(features(text.as_py(), ids), minlength=BUCKETS)
                raw += counts
                if is_target:
                    target += counts
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    parts = df.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "bucket long, raw long, target long")
    rows = parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    out = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for vector, name in zip(out, ("raw", "target"), strict=True):
        vector[rows["bucket"].to_numpy(int)] = rows[name]
    return out


def log_ratios(raw: np.ndarray, target: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log p_target - log p_raw by bucket, smoothed."""
    p, q = target + smooth, raw + smooth
    return np.log(p / p.sum()) - np.log(q / q.sum())


def gumbel(ids: np.ndarray, seed: int) -> np.ndarray:
    """Noise that depends on the id and the seed alone, so a task that runs again draws the same."""
    u = (mix(ids.astype(np.int64).view(np.uint64) * _PAIR + np.uint64(seed)) >> np.uint64(11)).astype(np.float64)
    return -np.log(-np.log((u + 0.5) / 2.0**53))


def weigh(df: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """(id, n_features, log_weight, gumbel_key) for each row. Texts without words have weight 0; a null id draws the noise of its text."""
    sent = df.sparkSession.sparkContext.broadcast(ratios)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, ids = sent.value, _ids()
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            found = [features(t, ids) for t in texts]
            weight = np.array([table[f].sum() for f in found], float)
            keys = np.array([xxhash.xxh64_intdigest(t) >> 1 if i is None else i for i, t in zip(batch.column(0).to_pylist(), texts, strict=True)], np.int64)
            arrays = [batch.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array(weight), pa.array(weight + gumbel(keys, seed))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n_features", "log_weight", "gumbel_key"])

    return df.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "id long, n_features long, log_weight double, gumbel_key double")


def top_k(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The rows with the k largest values of a double column, exactly, without a global sort; rows that tie with the last all stay.

    The range that holds the k-th value is cut into 65,536 slots, and the slot that holds it is cut again; each pass counts slots.
    """
    low, high = rows.agg(F.min(key), F.max(key)).first()
    if low is None or k <= 0:
        return rows.limit(0)
    while low < high:
        width = (high - low) / 65536
        slot = F.least(F.floor((F.col(key) - low) / width), F.lit(65535)) if width > 0 else F.col(key)
        counts = rows.filter(F.col(key).between(low, high)).groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
        above = rows.filter(F.col(key) > high).count()
        for row in counts.orderBy(F.desc("slot")).collect():  # at most 65,536 rows
            if above + row["n"] >= k:
                low, high = row["low"], row["high"]
                break
            above += row["n"]
        else:
            return rows
    return rows.filter(F.col(key) >= low)


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 7, max_labelled: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sampled documents: doc_id, n_features, log_weight, gumbel_key, kept (true).

    Target: labelled documents of quality 1 that are not toxic, at most ``max_labelled`` of them, those of the smallest id hashes;
    the raw model is of all documents. k: ``share`` of all rows; by default the target's share of the labelled documents.
    Without labels nothing tells target from raw, and all rows stay. Repeated rows weigh and draw alike. Ties with the k-th row stay.
    """
    good = labels.select(F.col("doc_id").cast("long").alias("id"), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good")).dropna().groupBy("id").agg(F.min("good").alias("good"))
    n, wanted = good.agg(F.count("*"), F.count_if("good")).first()
    targets = np.sort(good.filter("good").orderBy(F.xxhash64("id"), "id").limit(max_labelled).toPandas()["id"].to_numpy(np.int64))
    raw, target = bucket_counts(docs, targets, id_col, text_col)
    rows = checkpoint(weigh(docs, log_ratios(raw, target), id_col, text_col, seed))
    if share is None:
        share = wanted / n if n else 1.0
    chosen = top_k(rows, "gumbel_key", round(share * rows.count()))
    return chosen.select(F.col("id").alias("doc_id"), "n_features", "log_weight", "gumbel_key", F.lit(True).alias("kept"))
