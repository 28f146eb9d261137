"""Near copies by SimHash: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more; one of each group stays.

Candidates come from the grid join of fingerprints by segment popcounts (``simhash.near_pairs``) and are verified on whole
shingle sets. At this similarity two fingerprints of 64 bits differ in about 10 bits, so the grid, which is exact up to
``distance`` bits, meets only the closest texts. What it misses is found by an exact join of shingles:

* In any one order of all shingles, two sets that are as similar share one of the first ``n - ceil(0.8 n) + 1`` of each.
  Rare shingles come first. The order is learned from a share of the documents; results do not depend on it.
* Each shingle's group elects leaders, and members are verified against leaders only. So a large group of near copies of
  one text makes few pairs, and nearly all of its members are linked.
* Then members of one group whose components still differ meet, and only they. An odd sketch (the parity of the shingles in each
  of some hundred buckets) comes with each set: the bits in which two sketches differ are a lower bound on the shingles in which the
  sets differ, so pairs beyond the bound are never made, and no similar pair is lost.

Every decision is by whole sets of 64-bit shingle hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from kvspark.llm.base import checkpoint, fresh, text_batches
from kvspark.llm.simhash import components, majority, near_pairs, shingle_hashes
from kvspark.llm.words import bit_table, in_table, slices

#: Longs of the short sketch, which all texts have.
SHORT = 8
#: One document in ``SHARE`` at most, and ``LEAST`` documents if there are as many, teach which shingles are common.
SHARE, LEAST = 100, 2_000
#: Common shingles that are sent to all tasks, those with most documents first; parts that a common shingle's group is dealt to.
COMMON, DEALT = 200_000, 256
#: Rows of a list that is broadcast at most; longer ones are joined by a shuffle.
SENT = 200_000


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def set_number(hashes: np.ndarray) -> int:
    """A 64-bit hash of a set; equal sets are one node."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), 5) - (1 << 63)


def odd_sketch(hashes: np.ndarray, longs: int) -> np.ndarray:
    """Parity of the number of hashes in each of ``64 * longs`` buckets, a power of two; the sketch of a smaller size is the exclusive or of its parts."""
    bucket = (hashes * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)).astype(np.int64) & (64 * longs - 1)
    return np.packbits((np.bincount(bucket, minlength=64 * longs) & 1).astype(np.uint8)).view(np.int64)


def sketch_longs(n: int) -> int:
    """At least a bit for each shingle."""
    return max(SHORT, 1 << max(0, math.ceil(n / 64) - 1).bit_length())


def allowed(na: Column, nb: Column, similarity: float) -> Column:
    """Shingles in which two sets of these sizes may differ."""
    return (na + nb) * F.lit((1 - similarity) / (1 + similarity)) + F.lit(1e-9)


def sketch_distance(a: Column, b: Column) -> Column:
    """Bits in which two odd sketches differ, the longer one folded to the size of the other."""
    size = F.least(F.size(a), F.size(b))

    def folded(s: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.aggregate(F.filter(s, lambda _, i: i % size == k), F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y)))
        return F.when(F.size(s) == size, s).otherwise(parts)

    return F.aggregate(F.zip_with(folded(a), folded(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two whole sets of shingle hashes. Two empty sets: 1."""
    common = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(common.cast("double"), (F.size(a) + F.size(b) - common).cast("double")), F.lit(1.0))


def describe(df: DataFrame, shingle: int) -> DataFrame:
    """id, number, digest and text to id, number, digest, node, n, mark, sketch and short: nothing that grows with the text but the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column(3)]
            columns = [batch.column(0), batch.column(1), batch.column(2)]
            columns.append(pa.array([set_number(h) for h in sets], pa.int64()))
            columns.append(pa.array([len(h) for h in sets], pa.int32()))
            columns.append(pa.array(np.fromiter(map(majority, sets), np.uint64, len(sets)).view(np.int64)))
            columns.append(pa.array([odd_sketch(h, sketch_longs(len(h))) for h in sets], pa.list_(pa.int64())))
            columns.append(pa.array([odd_sketch(h, SHORT) for h in sets], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    schema = df.select("id", "number", "digest").schema
    for name, kind in (("node", LongType()), ("n", IntegerType()), ("mark", LongType()), ("sketch", ArrayType(LongType())), ("short", ArrayType(LongType()))):
        schema = schema.add(name, kind)
    return df.select("id", "number", "digest", "text").mapInArrow(run, schema)


def common_shingles(texts: DataFrame, n: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of common shingles, sorted, with their counts in the documents that were looked at."""
    every = min(SHARE, max(1, n // LEAST))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes = [shingle_set(t.as_py(), shingle) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *hashes]).view(np.int64))], ["h"])

    some = texts.filter(F.pmod(F.xxhash64("number", "digest"), F.lit(every)) == 0).select("text").mapInArrow(run, "h long")
    counts = some.groupBy("h").agg(F.count("*").alias("c")).filter("c > 2").orderBy(F.desc("c"), "h").limit(COMMON).toPandas()
    order = np.argsort(counts["h"].to_numpy(np.int64).view(np.uint64))
    return counts["h"].to_numpy(np.int64).view(np.uint64)[order], counts["c"].to_numpy(np.int64)[order]


def first_shingles(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a set, rare ones first, as many as it takes for two similar sets to share one; and which of them are common."""
    often = np.zeros(len(hashes), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        often = np.where(common[at] == hashes, counts[at], 0)
    needed = max(1, math.ceil(similarity * len(hashes) - 1e-9))
    first = np.lexsort((hashes, often))[: len(hashes) - needed + 1]
    return hashes[first], often[first] > 0


def shingle_index(texts: DataFrame, n: int, similarity: float, shingle: int) -> DataFrame:
    """(h, node, n, place, part): the first shingles of all sets, some more than once. A common shingle's members are dealt to parts."""
    sent = texts.sparkSession.sparkContext.broadcast(common_shingles(texts, n, shingle))  # COMMON at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = sent.value
        seen: set[int] = set()
        for batch in slices(batches):
            columns: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
            for text in batch.column(0):
                hashes = shingle_set(text.as_py(), shingle)
                node = set_number(hashes)
                if node in seen or not len(hashes):  # copies that one task meets
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(node)
                first, often = first_shingles(hashes, common, counts, similarity)
                k = len(first)
                for column, values in zip(columns, (first.view(np.int64), np.full(k, node), np.full(k, len(hashes)), np.arange(k), np.where(often, node % DEALT, -1)), strict=True):
                    column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(columns, kinds, strict=True)], ["h", "node", "n", "place", "part"])

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    return texts.select("text").mapInArrow(run, "h long, node long, n int, place int, part int")


def with_leaders(index: DataFrame) -> DataFrame:
    """The members of shingles that more than one set has among its first, once each, with two leaders (three of common shingles)."""
    group = Window.partitionBy("h", "part")
    order = F.struct(F.xxhash64("h", "node").alias("x"), "node")
    once = index.withColumn("before", F.lag("node").over(group.orderBy("node"))).filter("before IS NULL OR before != node").drop("before")
    led = once.withColumns({"low": F.min(order).over(group), "high": F.max(order).over(group)})
    led = checkpoint(led.filter("low.node != high.node OR part >= 0").select("h", "node", "n", "place", "part", F.col("low.node").alias("low"), F.col("high.node").alias("high")))
    tops = led.filter("part >= 0").groupBy("h").agg(F.min_by("low", F.xxhash64("h", "low")).alias("top"))  # COMMON rows at most
    return led.join(F.broadcast(tops), "h", "left")


def sets_of(texts: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of the nodes in ``wanted`` (number, digest, node). Texts that are not wanted go before their shingles are made."""
    sent = texts.sparkSession.sparkContext.broadcast(bit_table(wanted.select(F.col("digest").alias("h"))))  # a fixed number of bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            maybe = np.flatnonzero(in_table(sent.value, batch.column(1).to_numpy(zero_copy_only=False)))
            part = batch.take(pa.array(maybe))
            sets = [shingle_set(t.as_py(), shingle).view(np.int64) for t in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sets, pa.list_(pa.int64()))], ["number", "digest", "shingles"])

    made = texts.select("number", "digest", "text").mapInArrow(run, "number long, digest long, shingles array<long>")
    # all copies of a wanted text are made, so they are not broadcast either
    return made.join(wanted.hint("merge"), ["number", "digest"]).groupBy("node").agg(F.first("shingles").alias("shingles"))


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole sets are as similar; ``sets`` has node and shingles, each node once."""
    a, b = (sets.select(F.col("node").alias(n), F.col("shingles").alias(f"of_{n}")) for n in "ab")
    return pairs.join(a, "a").join(b, "b").filter(jaccard(F.col("of_a"), F.col("of_b")) >= similarity).select("a", "b")


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar: by their sketches first, then by their shingles."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for n in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(n), F.col("n").alias(f"n{n}"), F.col("sketch").alias(f"s{n}")), n)
    sizes = F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(similarity - 1e-9)
    near = checkpoint(pairs.filter(sizes).filter(sketch_distance(F.col("sa"), F.col("sb")) <= allowed(F.col("na"), F.col("nb"), similarity)).select("a", "b"))
    some = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = checkpoint(nodes.join(some, "node", "left_semi").select("low.number", "low.digest", "node"))
    return checkpoint(alike(near, checkpoint(sets_of(texts, wanted, shingle)), similarity))


def similar_pairs(nodes: DataFrame, texts: DataFrame, n: int, similarity: float, shingle: int, distance: int, groups: int) -> DataFrame:
    """Pairs (a, b) of similar nodes that join all nodes that any chain of similar pairs joins."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    index = with_leaders(shingle_index(texts, n, similarity, shingle))
    leaders = index.select(F.explode(F.array_distinct(F.array_compact(F.array("low", "high", "top")))).alias("a"), F.col("node").alias("b")).filter("a != b")
    close = near_pairs(nodes.filter("n > 0").select("node", "mark"), distance, groups, node="node")
    links = verified(close.unionByName(leaders), nodes, texts, similarity, shingle)
    roots = components(links)
    short = nodes.select("node", *[F.col("short")[k].alias(f"s{k}") for k in range(SHORT)])
    members = index.select("h", "node", "n", "place").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(short, "node")
    left, right = members.alias("l"), members.alias("r")
    differ = F.lit(0)
    for k in range(SHORT):
        differ = differ + F.bit_count(F.col(f"l.s{k}").bitwiseXOR(F.col(f"r.s{k}")))
    # what two sets can share at most, seen from one shared shingle
    most = F.least("l.place", "r.place") + F.least(F.col("l.n") - F.col("l.place"), F.col("r.n") - F.col("r.place"))
    meets = (
        (F.col("l.h") == F.col("r.h")) & (F.col("l.node") < F.col("r.node")) & (F.col("l.root") != F.col("r.root"))
        & (most >= F.lit(similarity - 1e-9) * (F.col("l.n") + F.col("r.n") - most))
        & (differ <= allowed(F.col("l.n"), F.col("r.n"), similarity))
    )
    rest = left.join(right, meets).select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))
    return links.unionByName(verified(rest, nodes, texts, similarity, shingle))


def _marked(docs: DataFrame, id_col: str, text_col: str, number: str, digest: str) -> DataFrame:
    return docs.withColumns({number: F.xxhash64(F.col(id_col)), digest: F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})


def groups_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5, distance: int = 4, groups: int = 7) -> DataFrame:
    """One row per row: id, number and digest (hashes of id and text), and low, the struct (id, number, digest) of the first row of its group.

    The first is that of the smallest id (a null id comes before all), then the hash of the id, then that of the text. Texts without
    words are one group; texts that have fewer words than a shingle are like no other.
    """
    text_batches(df.sparkSession)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = _marked(source, "id", "text", "number", "digest").select("id", "number", "digest", "text")
    rows = checkpoint(describe(texts, shingle))
    same = ("n", "mark", "sketch", "short")
    nodes = checkpoint(rows.groupBy("node").agg(F.min(F.struct("id", "number", "digest")).alias("low"), *[F.first(c).alias(c) for c in same]))
    pairs = similar_pairs(nodes, texts.drop("id"), rows.count(), similarity, shingle, distance, groups)
    roots = components(pairs).withColumnRenamed("node", "member")
    linked = checkpoint(nodes.join(roots, nodes["node"] == roots["member"], "left").select("node", "low", F.coalesce("root", "node").alias("root")))
    lows = checkpoint(linked.groupBy("root").agg(F.min("low").alias("low")))
    # both written, so that a node or root with many rows can be split
    named = checkpoint(linked.drop("low").join(lows, "root").select("node", "low"))
    # left, though each node is named: so the rows are never broadcast, however small their files are
    return rows.select("id", "number", "digest", "node").join(named, "node", "left").select("id", "number", "digest", "low")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """One row of each group, columns unchanged: the first as in ``groups_of``.

    Of rows that share both id and text one stays, whichever of them. Rows with a null id are told apart by their texts. An empty table
    stays empty. Only rows that are removed or repeated are looked up, so the texts themselves are not shuffled while those are few.
    """
    number, digest = fresh(docs, "number", "digest")
    found = groups_of(docs, id_col, text_col, similarity, shingle)
    gone = (F.col("low.number") != F.col("number")) | (F.col("low.digest") != F.col("digest"))
    fate = found.groupBy("number", "digest").agg(F.max(gone).alias("__gone"), F.count("*").alias("n")).filter("__gone OR n > 1")
    fate = checkpoint(fate.select(F.col("number").alias(number), F.col("digest").alias(digest), "__gone"))
    fate = F.broadcast(fate) if fate.count() <= SENT else fate
    marked = _marked(docs, id_col, text_col, number, digest).join(fate, [number, digest], "left")
    once = marked.filter("NOT __gone").dropDuplicates([number, digest])
    return marked.filter("__gone IS NULL").unionByName(once).select(docs.columns)
