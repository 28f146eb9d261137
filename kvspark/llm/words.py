"""Words of a text as 64-bit numbers, for operators that work on n-grams in Python workers."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"\w+")
#: Bits of a table of hashes, as a power of two.
FILTER_BITS = 27
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class WordIds(dict):
    """Word to its 64-bit hash. It is emptied when it holds ``bound`` words, so a worker's memory stays bounded."""

    def __init__(self, seed: int = 0, bound: int = 150_000):
        super().__init__()
        self.seed, self.bound = seed, bound

    def __missing__(self, word):
        if len(self) >= self.bound:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, self.seed)
        return value

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in smaller parts, so that what a worker makes of one part goes on before the next is begun."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def per_worker(key, make):
    """What ``make`` returns, kept for all tasks of one Python worker (functions arrive by value, so their globals are not).

    A worker keeps what it used last and before that; it outlives a stage, so what other operators kept would add up.
    """
    import sys

    kept = sys.__dict__.setdefault("_kvspark_per_worker", {})
    if key not in kept:
        kept[key] = make()
    kept[key] = found = kept.pop(key)
    while len(kept) > 2:
        del kept[next(iter(kept))]
    return found


def bit_table(hashes: DataFrame) -> np.ndarray:
    """One bit for each value of the low ``FILTER_BITS`` bits of the column ``h``, packed. Built in pages by Spark; the driver gets no more than the table."""
    slot = F.col("h").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) + 1  # bitmap functions count from 1
    pages = hashes.groupBy(F.bitmap_bucket_number(slot).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for row in pages.toLocalIterator():
        part = np.frombuffer(bytes(row["bits"]), np.uint8)
        out[(row["page"] - 1) * len(part) : row["page"] * len(part)] = part
    return out


def in_table(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & ((1 << FILTER_BITS) - 1)
    return (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
