"""SimHash near-dedup by segment popcounts.

Each fingerprint of 64 bits maps to the bit counts of its 32 two-bit segments. The
Manhattan distance of two such vectors is never more than the Hamming distance of the
fingerprints. The segments form ``groups`` groups; two vectors at most ``distance``
apart differ in at most ``distance`` groups, so they share the cell of at least one set
of ``groups - distance`` groups. The grid join meets fingerprints by cell, tests the
Manhattan bound, takes each pair only in the first cell that it shares, and then
compares all bits. Links between different fingerprints become components by
alternating star contraction; equal fingerprints are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvspark.llm.base import checkpoint, text_batches
from kvspark.llm.words import LOWER, WORD

SEED = 42
#: Links that one task holds while they become components, so that a round needs no shuffle; more are dealt to several.
ALONE = 100_000
_LOW = 0x5555555555555555
#: Bits of each byte value, most significant first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_LANE = (np.arange(8, dtype=np.uint16) * 256)[None, :]


def shingle_hashes(text: str | None, shingle: int = 4) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words, or of all words if there are fewer; none for no words or null."""
    words = WORD.findall((text or "").encode().translate(LOWER))
    n = len(words)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([digest(joined, SEED)] * (n > 0), np.uint64)
    size = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(size + 1) - 1
    start = (end - size).tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(start, end[shingle - 1 :].tolist(), strict=False)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """64 bits; a bit is 1 if over half the hashes have it. No hashes: 0."""
    if not len(hashes):
        return 0
    seen = np.bincount((hashes.astype(">u8").view(np.uint8).reshape(-1, 8) + _LANE).ravel(), minlength=2048).reshape(8, 256)
    return int.from_bytes(np.packbits((seen @ _BITS).ravel() * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 4) -> int:
    return majority(shingle_hashes(text, shingle))


def fingerprints(df: DataFrame, text_col: str = "text", shingle: int = 4, out: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint as a signed long; the text column is left out. Text by text, whatever its length."""
    kept = [f for f in df.schema.fields if f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint(t.as_py(), shingle) for t in batch.column(batch.schema.get_field_index(text_col))]
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.array(marks, np.uint64).view(np.int64))], schema.names)

    schema = type(df.schema)(list(kept)).add(out, "long")
    return df.mapInArrow(run, schema)


def _masks(groups: int) -> list[int]:
    """The bits of each group of two-bit segments."""
    cuts = [round(32 * g / groups) for g in range(groups + 1)]
    return [((1 << 2 * b) - 1) ^ ((1 << 2 * a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def segment_counts(mark: Column) -> Column:
    """The bit counts of the 32 segments, two bits each, in one long."""
    low = F.lit(_LOW)
    a, b = mark.bitwiseAND(low), F.shiftrightunsigned(mark, 1).bitwiseAND(low)
    return a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def manhattan(a: Column, b: Column) -> Column:
    """Sum of |difference| over the segments of two packed vectors; counts are 0, 1 or 2, so an exclusive or of 10 is 2 apart and any other is 1."""
    x, low = a.bitwiseXOR(b), F.lit(_LOW)
    odd = x.bitwiseAND(low)
    far = F.shiftrightunsigned(x, 1).bitwiseAND(low).bitwiseAND(F.bitwise_not(odd))
    return F.bit_count(odd) + F.bit_count(far) * 2


def near_pairs(marks: DataFrame, distance: int = 4, groups: int = 7, node: str = "mark") -> DataFrame:
    """Pairs (a, b), a < b, of different values of the column ``node`` whose ``mark`` differs in ``distance`` or fewer bits, once each.

    ``marks`` holds each node once; by default the marks are the nodes. No cell has a cap; the work in one grows with the square of the different fingerprints in it.
    """
    if not 0 < distance < groups <= 30:
        raise ValueError("distance must be positive and below the number of groups, which is at most 30")
    masks = _masks(groups)
    sets = [sum(1 << g for g in s) for s in combinations(range(groups), groups - distance)]
    unions = [_signed(sum(m for g, m in enumerate(masks) if s >> g & 1)) for s in sets]
    at = segment_counts(F.col("mark"))
    cells = marks.select(
        F.explode(F.array(*[F.struct(F.lit(s | ((1 << s.bit_length()) - 1) << 32).alias("set"), F.xxhash64(F.lit(s), at.bitwiseAND(F.lit(u))).alias("cell")) for s, u in zip(sets, unions, strict=True)])).alias("c"),
        *dict.fromkeys(["mark", node]),
    ).select("c.set", "c.cell", *dict.fromkeys(["mark", node]))
    left, right = cells.alias("l"), cells.alias("r")
    a, b = F.col("l.mark"), F.col("r.mark")
    differs = segment_counts(a).bitwiseXOR(segment_counts(b))
    agree = F.lit(0)
    for g, mask in enumerate(masks):
        agree = agree.bitwiseOR(F.when(differs.bitwiseAND(F.lit(_signed(mask))) == 0, F.lit(1 << g)).otherwise(F.lit(0)))
    # a set is the first that a pair shares if of the groups up to its highest only its own agree; a short test keeps the join's code small
    own, upto = F.col("l.set").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned("l.set", 32)
    meets = (
        (F.col("l.cell") == F.col("r.cell")) & (F.col("l.set") == F.col("r.set")) & (F.col(f"l.{node}") < F.col(f"r.{node}"))
        & (manhattan(segment_counts(a), segment_counts(b)) <= distance)
        & (F.bit_count(a.bitwiseXOR(b)) <= distance)
        & (agree.cast("long").bitwiseAND(upto) == own)
    )
    # merged by name: Spark takes an exploded table to be no larger than before, and would send this one, a row for each set, through the driver
    return left.join(right.hint("merge"), meets).select(F.col(f"l.{node}").alias("a"), F.col(f"r.{node}").alias("b"))


def _each(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """(u, v) for each of ``pairs`` of columns of each row. Not a union, which would deal out anew what one task holds."""
    return df.select(F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])).alias("e")).select("e.u", "e.v")


def _lowest(df: DataFrame, alone: bool) -> DataFrame:
    """(u, v) with m, the smallest v of each u. Of one partition by a window, which needs no shuffle; else by a join, so that a u with many rows can be split."""
    if alone:
        return df.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    return df.join(df.groupBy("u").agg(F.min("v").alias("m")), "u")


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of ``pairs`` (a, b): the smallest node that it can reach. Alternating large and small stars.

    Each round cuts its lineage with a checkpoint; rounds grow with the logarithm of the longest chain. Up to ``ALONE`` links are
    one partition, for which a round is one task without a shuffle: many rounds of many small tasks cost the driver's memory.
    """
    edges = checkpoint(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), ALONE)

    def state(df: DataFrame):
        return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()

    before, now = None, state(edges)
    while now != before:
        alone = now["n"] <= ALONE
        both = _lowest(_each(edges, ("u", "v"), ("v", "u")), alone).withColumn("m", F.least("m", "u"))
        large = both.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        small = _each(_lowest(large, alone), ("v", "m"), ("u", "m"))
        edges = checkpoint(small.filter("u > v").distinct(), ALONE)
        before, now = now, state(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, shingle: int = 4, groups: int = 7) -> DataFrame:
    """One row per input row: id, fingerprint (signed long), component_id (the smallest id that can be reached).

    Null and empty texts have fingerprint 0 and are linked like any other. Null ids get the component
    of their fingerprint; a component without any id has a null one.
    """
    text_batches(df.sparkSession)
    rows = checkpoint(fingerprints(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", shingle, "mark"))
    nodes = rows.groupBy("mark").agg(F.min("id").alias("low"))
    roots = components(near_pairs(nodes.select("mark"), distance, groups))
    linked = checkpoint(nodes.join(roots, nodes["mark"] == roots["node"], "left").select("mark", "low", F.coalesce("root", "mark").alias("root")))
    # written, so that a component or fingerprint with many rows can be split
    lows = checkpoint(linked.groupBy("root").agg(F.min("low").alias("component_id")))
    named = checkpoint(linked.join(lows, "root").select("mark", "component_id"))
    # each mark is named; a left join never broadcasts its left side, whose size is guessed from the compressed files: copies are many rows in few bytes
    return rows.join(named, "mark", "left").select("id", F.col("mark").alias("fingerprint"), "component_id")


def simhash_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint in 16 hexadecimal digits, component_id."""
    rows = near_duplicates(docs)
    return rows.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
