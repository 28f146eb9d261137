"""Continuous ingest of a changelog, and reading changes back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kvspark.operators.batch import index_ops
from kvspark.sources.table import KVTable


def ingest(stream: DataFrame, table: KVTable, checkpoint: str, order: list[str], name: str = "ingest", trigger: dict | None = None) -> StreamingQuery:
    """Writes a stream of (vtype, key, value, order columns) to a table, each micro-batch once.

    ``order`` gives the order of operations inside a batch. The batch's number is part of the commit, so a
    batch that is tried again after a failure changes nothing. Late rows get higher sequence numbers: commit
    order is the only clock.
    """

    def take(batch: DataFrame, number: int) -> None:
        ops = index_ops(batch.select("vtype", "key", "value", *order), order)
        table.write_df(ops.select("op_index", F.col("vtype").cast("int").alias("vtype"), "key", "value"), f"{name}:{number}")
        table.maintain()

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def changelog(table: KVTable, after: int, upto: int | None = None) -> DataFrame:
    """Versions with after < seq <= upto (now, by default), as far as compaction has left them."""
    upto = table.state.last_seq if upto is None else upto
    return table.log(as_of=upto).filter((F.col("seq") > after) & (F.col("seq") <= upto)).select("key", "seq", "vtype", "value")
