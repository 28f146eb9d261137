"""Reads of a multi-version log as DataFrame operations.

Every function takes any log: key columns, a sequence column, an expression that says
whether a version is live, and whatever value columns there are. Versions are resolved
by an aggregate that combines before the shuffle, so a key with a third of all versions
does not end up in one task. Conditions on key columns reach the scan; conditions on
values or liveness are applied after the resolution, never before.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvspark.functions.keys import prefix_end
from kvspark.sources.shared import cut

_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
#: Keys that a batch lookup sends to every task; more are joined by a shuffle.
MAX_BROADCAST_KEYS = 100_000


@dataclass(frozen=True)
class Shape:
    """How to read a DataFrame as a log."""

    keys: tuple[str, ...] = ("key",)
    seq: str = "seq"
    vtype: str = "vtype"

    def values(self, log: DataFrame) -> list[str]:
        return [c for c in log.columns if c not in (*self.keys, self.seq, self.vtype)]


SHAPE = Shape()


def newest(log: DataFrame, as_of: int | None = None, shape: Shape = SHAPE) -> DataFrame:
    """The newest version of each key with seq <= ``as_of``, deletes included."""
    if as_of is not None:
        log = log.filter(F.col(shape.seq) <= as_of)
    rest = [shape.vtype, *shape.values(log)]
    if all(isinstance(log.schema[c].dataType, _FIXED) for c in rest):  # aggregates by hash; a struct would sort
        picked = [F.max_by(c, shape.seq).alias(c) for c in rest]
        return log.groupBy(*shape.keys).agg(F.max(shape.seq).alias(shape.seq), *picked).select(log.columns)
    top = log.groupBy(*shape.keys).agg(F.max(shape.seq).alias(shape.seq), F.max_by(F.struct(*rest), shape.seq).alias("__top"))
    return top.select(*shape.keys, shape.seq, "__top.*").select(log.columns)


def visible(log: DataFrame, as_of: int | None = None, shape: Shape = SHAPE) -> DataFrame:
    """The live keys at ``as_of`` with their newest values."""
    return newest(log, as_of, shape).filter(F.col(shape.vtype) == 1)


def tombstones(log: DataFrame, as_of: int | None = None, shape: Shape = SHAPE) -> DataFrame:
    """Keys whose newest version is a delete."""
    return newest(log, as_of, shape).filter(F.col(shape.vtype) == 0)


def get(log: DataFrame, key, as_of: int | None = None, shape: Shape = SHAPE) -> DataFrame:
    """The live version of one key: one row or none. ``key`` is a value, or one for each key column."""
    wanted = key if isinstance(key, tuple) else (key,)
    for name, value in zip(shape.keys, wanted, strict=True):
        log = log.filter(F.col(name) == F.lit(value))
    return visible(log, as_of, shape)


def multi_get(log: DataFrame, keys: DataFrame, as_of: int | None = None, shape: Shape = SHAPE) -> DataFrame:
    """The live versions of all keys in ``keys`` (same column names). A bounded number of keys is sent to every task, more are joined by a shuffle."""
    wanted = keys.select(*shape.keys).distinct()
    few = wanted.limit(MAX_BROADCAST_KEYS + 1).count() <= MAX_BROADCAST_KEYS
    return visible(log.join(F.broadcast(wanted) if few else wanted, list(shape.keys), "left_semi"), as_of, shape)


def _bounds(name: str, start, end) -> Column | None:
    test = None
    if start is not None:
        test = F.col(name) >= F.lit(start)
    if end is not None:
        below = F.col(name) < F.lit(end)
        test = below if test is None else test & below
    return test


def range_scan(log: DataFrame, start=None, end=None, as_of: int | None = None, reverse: bool = False, limit: int | None = None, shape: Shape = SHAPE) -> DataFrame:
    """Live keys with start <= key < end in key order, or in reverse; bounds are on the first key column, None is open."""
    test = _bounds(shape.keys[0], start, end)
    rows = visible(log if test is None else log.filter(test), as_of, shape)
    ordered = rows.orderBy(*[F.col(k).desc() if reverse else F.col(k).asc() for k in shape.keys])
    return ordered if limit is None else ordered.limit(limit)


def seek(log: DataFrame, key, as_of: int | None = None, limit: int = 1, shape: Shape = SHAPE) -> DataFrame:
    """The first ``limit`` live keys >= ``key``."""
    return range_scan(log, key, None, as_of, False, limit, shape)


def seek_for_prev(log: DataFrame, key, as_of: int | None = None, limit: int = 1, shape: Shape = SHAPE) -> DataFrame:
    """The last ``limit`` live keys <= ``key``, largest first."""
    rows = visible(log.filter(F.col(shape.keys[0]) <= F.lit(key)), as_of, shape)
    return rows.orderBy(*[F.col(k).desc() for k in shape.keys]).limit(limit)


def _begins(name: str, prefix) -> Column:
    """That a key begins with ``prefix``, as a range so that the scan can skip files."""
    if isinstance(prefix, str):
        return (F.col(name) >= F.lit(prefix)) & F.startswith(F.col(name), F.lit(prefix))
    return _bounds(name, prefix, prefix_end(prefix))


def prefix_scan(log: DataFrame, prefix, as_of: int | None = None, shape: Shape = SHAPE) -> DataFrame:
    """Live keys that begin with ``prefix``."""
    return visible(log.filter(_begins(shape.keys[0], prefix)), as_of, shape).orderBy(*shape.keys)


def prefix_versions(log: DataFrame, prefix, as_of: int | None = None, shape: Shape = SHAPE) -> DataFrame:
    """All versions of the keys that begin with ``prefix``, deletes and repeated rows included, in internal order: key, then newest first."""
    if as_of is not None:
        log = log.filter(F.col(shape.seq) <= as_of)
    return log.filter(_begins(shape.keys[0], prefix)).orderBy(*shape.keys, F.col(shape.seq).desc())


def history(log: DataFrame, shape: Shape = SHAPE) -> DataFrame:
    """All versions in internal order: key, then newest first, with their rank ``rn``.

    A range sort by key and sequence number splits a key with many versions over partitions. Ranks count within a partition; keys
    that go on over a boundary, at most one for each, then get the number of their versions in the partitions before.
    """
    keys, seq = list(shape.keys), F.col(shape.seq).desc()
    rows = cut(log.repartitionByRange(*keys, seq).sortWithinPartitions(*keys, seq)).withColumn("__part", F.spark_partition_id())
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("__part", *keys).orderBy(seq)))
    sizes = rows.groupBy("__part", *keys).agg(F.count("*").alias("__n"))
    ends = rows.groupBy("__part").agg(F.max(F.struct(*keys)).alias("__k")).select("__k.*").distinct()  # a key that goes on is the last of a partition
    sizes = sizes.join(F.broadcast(ends), keys, "left_semi")  # at most partitions squared
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter("__before > 0")
    out = ranked.join(F.broadcast(before.select("__part", *keys, "__before")), ["__part", *keys], "left")
    return out.withColumn("rn", (F.col("rn") + F.coalesce("__before", F.lit(0))).cast("int")).select(*log.columns, "rn")


def merge_sources(sources: Sequence[DataFrame], shape: Shape = SHAPE) -> DataFrame:
    """One log from several. Of versions with the same key and seq that of the earlier source stays."""
    ranked = [s.withColumn("__source", F.lit(i)) for i, s in enumerate(sources)]
    union = ranked[0]
    for other in ranked[1:]:
        union = union.unionByName(other)
    columns = sources[0].columns
    rest = [c for c in columns if c not in (*shape.keys, shape.seq)]
    first = union.groupBy(*shape.keys, shape.seq).agg(F.min_by(F.struct(*rest), "__source").alias("__first"))
    return first.select(*shape.keys, shape.seq, "__first.*").select(columns)


def snapshot_diff(log: DataFrame, before: int, after: int, shape: Shape = SHAPE) -> DataFrame:
    """What changed between two snapshots: keys, ``change`` (added, removed, changed), ``old_seq`` and ``new_seq``.

    One aggregate over the log finds both states of each key.
    """
    at = lambda s: F.max_by(F.struct(F.col(shape.seq).alias("seq"), F.col(shape.vtype).alias("vtype")), F.when(F.col(shape.seq) <= s, F.col(shape.seq)))
    both = log.filter(F.col(shape.seq) <= max(before, after)).groupBy(*shape.keys).agg(at(before).alias("o"), at(after).alias("n"))
    old, new = (F.when(F.col(f"{x}.vtype") == 1, F.col(f"{x}.seq")) for x in "on")
    change = F.when(old.isNull(), "added").when(new.isNull(), "removed").otherwise("changed")
    rows = both.select(*shape.keys, old.alias("old_seq"), new.alias("new_seq"), change.alias("change"))
    return rows.filter(~F.col("old_seq").eqNullSafe(F.col("new_seq")))


def number_rows(df: DataFrame, *order: Column, name: str = "pos") -> DataFrame:
    """Adds each row's place in the order, from 1. A range sort, written, and the sizes of its partitions: no task gets all rows, no row goes through Python."""
    rows = cut(df.orderBy(*order)).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = dict(rows.groupBy("__part").agg(F.count("*")).collect())  # one row a partition
    before = list(accumulate((sizes.get(p, 0) for p in range(max(sizes, default=0) + 1)), initial=0))[:-1]
    start = F.element_at(F.array(*map(F.lit, before)), F.col("__part") + 1) if before else F.lit(0)
    return rows.select(*df.columns, (start + F.col("__at") + 1).cast("long").alias(name))


def changes_since(log: DataFrame, seq: int, shape: Shape = SHAPE) -> DataFrame:
    """The versions written after ``seq``."""
    return log.filter(F.col(shape.seq) > seq)
