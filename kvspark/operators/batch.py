"""Atomic write batches and the numbering of their operations."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvspark.errors import Corruption, InvalidArgument
from kvspark.operators.resolve import number_rows
from kvspark.schema import BATCH, DELETE, MAX_SEQ, PUT

_HEADER = 12


class Handler(Protocol):
    """What ``WriteBatch.iterate`` calls for each operation, in order."""

    def put(self, key: bytes, value: bytes) -> None: ...

    def delete(self, key: bytes) -> None: ...


class WriteBatch:
    """Puts and deletes that become visible together. A later one on the same key wins."""

    def __init__(self) -> None:
        self.ops: list[tuple[int, bytes, bytes | None]] = []

    def put(self, key: bytes, value: bytes) -> WriteBatch:
        self.ops.append((PUT, bytes(key), bytes(value)))
        return self

    def delete(self, key: bytes) -> WriteBatch:
        self.ops.append((DELETE, bytes(key), None))
        return self

    def append(self, other: WriteBatch) -> WriteBatch:
        self.ops += list(other.ops)
        return self

    def clear(self) -> None:
        self.ops.clear()

    def __len__(self) -> int:
        return len(self.ops)

    def approximate_size(self) -> int:
        """Bytes of the batch; an empty one has its header alone."""
        sized = lambda b: len(b) + max(1, -(-len(b).bit_length() // 7))  # noqa: E731  a length takes 7 bits a byte
        return _HEADER + sum(1 + sized(k) + (sized(v) if v is not None else 0) for _, k, v in self.ops)

    def iterate(self, handler: Handler) -> None:
        for vtype, key, value in self.ops:
            if vtype == PUT and value is not None:
                handler.put(key, value)
            elif vtype == DELETE and value is None:
                handler.delete(key)
            else:
                raise Corruption(f"operation of type {vtype}")

    def rows(self, last_seq: int) -> list[tuple[bytes, int, int, bytes | None]]:
        """Log rows numbered from ``last_seq + 1`` in order."""
        if last_seq + len(self.ops) > MAX_SEQ:
            raise InvalidArgument("sequence numbers are used up")
        return [(k, last_seq + 1 + i, t, v) for i, (t, k, v) in enumerate(self.ops)]

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, t, k, v) for i, (t, k, v) in enumerate(self.ops)], BATCH)


def assign_sequence(batch: DataFrame, last_seq: int) -> DataFrame:
    """Log rows of a batch DataFrame: ``seq = last_seq + 1 + op_index``. The batch gives its own order, never the partitions'."""
    return batch.select(F.col("key").cast("binary").alias("key"), (F.col("op_index") + last_seq + 1).cast("long").alias("seq"), F.col("vtype").cast("int").alias("vtype"), F.col("value").cast("binary").alias("value"))


def index_ops(ops: DataFrame, order: list[str]) -> DataFrame:
    """Adds a contiguous ``op_index`` from 0 by the given columns, without gathering the rows: a range sort and the partitions' counts."""
    return number_rows(ops, *map(F.col, order), name="op_index").select((F.col("op_index") - 1).alias("op_index"), *ops.columns)


def check_batch(batch: DataFrame) -> int:
    """Number of operations; raises Corruption if types, nulls or indexes break the rules."""
    n, wrong, low, high, kinds = batch.agg(
        F.count("*"),
        F.count_if(~(((F.col("vtype") == PUT) & F.col("value").isNotNull()) | ((F.col("vtype") == DELETE) & F.col("value").isNull())) | F.col("key").isNull()),
        F.min("op_index"), F.max("op_index"), F.sum("op_index"),
    ).first()
    if wrong or n and (low, high, kinds) != (0, n - 1, n * (n - 1) // 2):
        raise Corruption(f"{wrong} malformed operations, indexes {low} to {high} for {n}")
    return n
