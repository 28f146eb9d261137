"""Compaction as a DataFrame job.

With S the oldest sequence number that a snapshot pins, a version is dropped if the next
newer version of its key is also visible at S. So what stays is every version above S and the
newest one at or below S: the former pass through, the latter are one aggregate with map-side
combination, instead of a window that would put all versions of a hot key into one task.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvspark.operators.resolve import SHAPE, Shape, newest


@dataclass(frozen=True)
class CompactionFilter:
    """Says what becomes of the newest version of each key.

    keep: a condition; versions that fail are removed. value: the value that replaces the old one (puts only).
    decide: instead of both, a Python function from a pandas frame (key, vtype, value) to one with the
    columns ``keep`` and ``value``; it runs in Arrow batches.
    mode: ``plain`` offers versions at or below the oldest snapshot, and removes rows; ``safe`` never offers what a
    pinned snapshot can see, and removal leaves a delete, so no older version comes back.
    """

    keep: Column | None = None
    value: Column | None = None
    decide: Callable[[pd.DataFrame], pd.DataFrame] | None = None
    mode: str = "safe"


def prune(log: DataFrame, oldest: int, shape: Shape = SHAPE, flag: bool = False) -> DataFrame:
    """Drops versions that no snapshot at ``oldest`` or later can see. With ``flag``, adds ``__newest``: no newer version of the key exists."""
    seq = F.col(shape.seq)
    rows = log.filter(seq > oldest).unionByName(newest(log.filter(seq <= oldest), shape=shape))
    if not flag:
        return rows
    # by key and number, so the versions of a hot key do not meet in one task
    last = log.groupBy(*shape.keys).agg(F.max(shape.seq).alias(shape.seq)).withColumn("__newest", F.lit(True))
    return rows.join(last, [*shape.keys, shape.seq], "left").select(*log.columns, F.coalesce("__newest", F.lit(False)).alias("__newest"))


#: Ranges that are tested one by one in an expression; more are searched.
FEW_RANGES = 32


def merged(ranges: Sequence[tuple]) -> list[tuple]:
    """The ranges (smallest, largest), both inclusive, as disjoint ones in order."""
    out: list[tuple] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def elide_tombstones(rows: DataFrame, oldest: int, deeper: Sequence[tuple] | None, shape: Shape = SHAPE) -> DataFrame:
    """Drops deletes at or below ``oldest`` whose key lies in no file of a deeper level: one pass, no join.

    ``deeper``: (smallest, largest) of those files, as the manifest has them; many are searched by bisection, for deletes only.
    """
    gone = (F.col(shape.vtype) == 0) & (F.col(shape.seq) <= oldest)
    spans, key = merged(deeper or ()), F.col(shape.keys[0])
    if len(spans) <= FEW_RANGES:
        covered = F.lit(False)
        for low, high in spans:
            covered = covered | key.between(F.lit(low), F.lit(high))
        return rows.filter(~gone | covered)
    at, schema = rows.columns.index(shape.keys[0]), rows.schema

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows = [low for low, _ in spans]
        for batch in batches:
            found = [(k := bisect_right(lows, x)) > 0 and x <= spans[k - 1][1] for x in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(found, pa.bool_()))

    return rows.filter(~gone).unionByName(rows.filter(gone).mapInArrow(inside, schema))


def apply_filter(rows: DataFrame, oldest: int, rule: CompactionFilter, pinned: bool, shape: Shape = SHAPE) -> DataFrame:
    """Applies a filter to the rows that it may see; needs the column ``__newest``."""
    safe = rule.mode == "safe"
    offered = F.col("__newest") & (((F.col(shape.seq) > oldest) if pinned else F.lit(True)) if safe else (F.col(shape.seq) <= oldest))
    columns = rows.columns
    if rule.decide is not None:
        names = ["key" if "key" in columns else shape.keys[0], shape.vtype, "value"]

        def run(batches):
            for part in batches:
                made = rule.decide(part[names])
                part["__keep"], part["__new"] = made["keep"].astype(bool), made["value"]
                yield part

        schema = type(rows.schema)(list(rows.schema.fields)).add("__keep", "boolean").add("__new", rows.schema["value"].dataType)
        seen = rows.filter(offered).mapInPandas(run, schema)
    else:
        seen = rows.filter(offered).withColumns({"__keep": F.coalesce(rule.keep, F.lit(False)) if rule.keep is not None else F.lit(True), "__new": rule.value if rule.value is not None else F.col("value")})
    put = F.col(shape.vtype) == 1
    if safe:
        kept = seen.withColumns({"value": F.when(F.col("__keep") & put, F.col("__new")), shape.vtype: F.when(F.col("__keep"), F.col(shape.vtype)).otherwise(0).cast(rows.schema[shape.vtype].dataType)})
    else:
        kept = seen.filter("__keep").withColumn("value", F.when(put, F.col("__new")).otherwise(F.col("value")))
    return rows.filter(~offered).unionByName(kept.select(columns))


def compact(log: DataFrame, oldest: int, deeper: Sequence[tuple] | None = None, rule: CompactionFilter | None = None, pinned: bool = False, shape: Shape = SHAPE) -> DataFrame:
    """Prune, then elide, then filter."""
    rows = elide_tombstones(prune(log, oldest, shape, flag=rule is not None), oldest, deeper, shape)
    if rule is not None:
        rows = apply_filter(rows, oldest, rule, pinned, shape)
        if rule.mode == "safe" and not pinned:  # the deletes that removal has left cover nothing any more
            rows = elide_tombstones(rows, oldest, deeper, shape)
    return rows.drop("__newest")
