"""Queries that go through ``KVTable``: writes, flushes, compactions, repair, properties, cursors, logs and streams.

``events`` is written as batches in the order of event_id, so the sequence numbers are those of ``registry.EVENTS``. Each query
has a folder of its own in the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvspark.functions.keys import numeric_key
from kvspark.operators.batch import WriteBatch, index_ops
from kvspark.operators.compaction import CompactionFilter
from kvspark.plans.registry import EVENTS, HIGH, KEY, LOW, PREFIX, S1, S2, newest_sql, points, query
from kvspark.sources.files import Files
from kvspark.sources.logfile import LogWriter, read_logs
from kvspark.sources.options import Options, ReadOptions
from kvspark.sources.shared import shared_folder
from kvspark.sources.table import KVTable
from kvspark.streaming.ingest import changelog, ingest

STATE = "key, event_type AS value"
RANGES = [(0, LOW, HIGH), (1, HIGH, "0000000000000090"), (2, "0000000000000090", "0000000000000090"), (3, "1", "2")]


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op_index, vtype, key, value of all events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    put = F.col("event_type") != "error"
    return index_ops(events, ["event_id"]).select(
        "op_index", put.cast("int").alias("vtype"), numeric_key(F.col("user_id")).cast("binary").alias("key"), F.when(put, F.col("event_type")).cast("binary").alias("value")
    )


def written(spark: SparkSession, sf_dir: str, flush: tuple[bool, bool], snapshot: bool = False, **options):
    """A table of all events in two commits, the first up to S1, and the snapshot between them if asked for."""
    table, rows = KVTable.open(spark, folder(spark), Options(create_if_missing=True, reuse_logs=True, **options)), operations(spark, sf_dir)
    first, _, _ = points(rows.select((F.col("op_index") + 1).alias("seq")))
    table.write_df(rows.filter(F.col("op_index") < first), "first")
    if flush[0]:
        table.flush()
    snap = table.get_snapshot() if snapshot else None
    table.write_df(rows.filter(F.col("op_index") >= first).withColumn("op_index", F.col("op_index") - first), "second")
    table.write_df(rows, "second")  # a batch that is tried again changes nothing
    if flush[1]:
        table.flush()
    return (table, snap) if snapshot else table


def text(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("string") for c in ("key", "value") if c in rows.columns})


@query("kv_table_write", f"{newest_sql()} SELECT {STATE} FROM newest WHERE vtype = 1")
def kv_table_write(spark, sf_dir):
    return text(written(spark, sf_dir, (False, False)).scan())


@query("kv_table_flush", f"{newest_sql()} SELECT {STATE} FROM newest WHERE vtype = 1")
def kv_table_flush(spark, sf_dir):
    return text(written(spark, sf_dir, (True, True)).scan())


@query("kv_table_log", f"WITH {EVENTS} SELECT key, seq, vtype, CASE WHEN vtype = 1 THEN event_type END AS value FROM log")
def kv_table_log(spark, sf_dir):
    return text(written(spark, sf_dir, (True, False)).log().select("key", "seq", "vtype", "value"))


@query("kv_table_compact", f"{newest_sql()} SELECT key, seq, vtype, event_type AS value FROM newest WHERE vtype = 1")
def kv_table_compact(spark, sf_dir):
    table = written(spark, sf_dir, (True, True))
    table.compact_range()
    return text(table.log().select("key", "seq", "vtype", "value"))


@query("kv_table_compact_part", f"{newest_sql()} SELECT {STATE} FROM newest WHERE vtype = 1")
def kv_table_compact_part(spark, sf_dir):
    table = written(spark, sf_dir, (True, False), max_file_size=1 << 14)
    table.compact_range(LOW.encode(), HIGH.encode())
    return text(table.scan())


@query("kv_table_maintain", f"{newest_sql()} SELECT {STATE} FROM newest WHERE vtype = 1")
def kv_table_maintain(spark, sf_dir):
    table = written(spark, sf_dir, (True, True), write_buffer_size=1)
    table.maintain()
    return text(table.scan())


@query("kv_table_snapshot", f"{newest_sql(f' WHERE seq <= {S1}')} SELECT {STATE} FROM newest WHERE vtype = 1")
def kv_table_snapshot(spark, sf_dir):
    table, snap = written(spark, sf_dir, (True, True), snapshot=True)
    table.compact_range()
    return text(table.scan(options=ReadOptions(snapshot=snap)))


@query("kv_table_filter", f"{newest_sql()} SELECT {STATE} FROM newest WHERE vtype = 1 AND event_type <> 'click'")
def kv_table_filter(spark, sf_dir):
    table = written(spark, sf_dir, (True, True), compaction_filter=CompactionFilter(keep=F.col("value") != F.lit(b"click")))
    table.compact_range()
    return text(table.scan())


@query("kv_table_reopen", f"{newest_sql()} SELECT {STATE} FROM newest WHERE vtype = 1 AND starts_with(key, '{PREFIX}')")
def kv_table_reopen(spark, sf_dir):
    table = written(spark, sf_dir, (True, False))
    return text(KVTable.open(spark, table.path).prefix(PREFIX.encode()))


@query("kv_table_repair", f"{newest_sql()} SELECT {STATE} FROM newest WHERE vtype = 1")
def kv_table_repair(spark, sf_dir):
    table = written(spark, sf_dir, (True, False))
    Files(spark, table.path).delete("manifest")
    KVTable.repair(spark, table.path)
    return text(KVTable.open(spark, table.path).scan())


@query("kv_table_get", f"{newest_sql()} SELECT {STATE} FROM newest WHERE vtype = 1 AND key = '{KEY}'")
def kv_table_get(spark, sf_dir):
    found = written(spark, sf_dir, (True, False)).get_or_none(KEY.encode())
    return spark.createDataFrame([(KEY, found.decode())] if found is not None else [], "key string, value string")


@query("kv_table_multi_get", f"{newest_sql()} SELECT {STATE} FROM newest WHERE vtype = 1 AND key IN (SELECT lpad(cast(n_nationkey AS varchar), 16, '0') FROM nation)")
def kv_table_multi_get(spark, sf_dir):
    keys = [bytes(r[0]) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select(numeric_key(F.col("n_nationkey")).cast("binary")).collect()]  # a list by nature
    found = written(spark, sf_dir, (True, True)).multi_get(keys)
    return spark.createDataFrame([(k.decode(), v.decode()) for k, v in found.items()], "key string, value string")


@query("kv_table_verify", "SELECT count(*) AS n_versions FROM events")
def kv_table_verify(spark, sf_dir):
    return spark.createDataFrame([(written(spark, sf_dir, (True, False)).verify(),)], "n_versions long")


_PARTS = f"parts AS (SELECT *, CASE WHEN seq <= {S1} THEN 2 ELSE 1 END AS level FROM log)"


@query("kv_table_files", f"WITH {EVENTS}, {_PARTS} SELECT level, count(*) AS n_rows, min(key) AS smallest, max(key) AS largest, min(seq) AS first_seq, max(seq) AS last_seq FROM parts GROUP BY level")
def kv_table_files(spark, sf_dir):
    files = written(spark, sf_dir, (True, True)).state.files  # the manifest's list
    rows = spark.createDataFrame([(f.level, f.rows, f.smallest.decode(), f.largest.decode(), f.smallest_seq, f.largest_seq) for f in files], "level int, n long, low string, high string, a long, b long")
    return rows.groupBy("level").agg(F.sum("n").alias("n_rows"), F.min("low").alias("smallest"), F.max("high").alias("largest"), F.min("a").alias("first_seq"), F.max("b").alias("last_seq"))


@query("kv_table_properties", f"WITH {EVENTS}, {_PARTS}, levels AS (SELECT unnest(range(0, 8)) AS n) SELECT cast(n AS integer) AS level, CASE WHEN n < 7 THEN n IN (SELECT level FROM parts) END AS has_files, CASE WHEN n < 7 THEN n IN (SELECT level FROM parts) END AS in_stats FROM levels")
def kv_table_properties(spark, sf_dir):
    table = written(spark, sf_dir, (True, True))
    listed = {int(line.split()[0]) for line in table.get_property("kv.stats").splitlines()[1:]}
    counts = [table.get_property(f"kv.num-files-at-level{n}") for n in range(8)]
    return spark.createDataFrame([(n, None if c is None else int(c) > 0, None if c is None else n in listed) for n, c in enumerate(counts)], "level int, has_files boolean, in_stats boolean")


_RANGES = ", ".join(f"({i}, '{a}', '{b}')" for i, a, b in RANGES)


@query("kv_table_sizes", f"WITH {EVENTS}, ranges(range_id, low, high) AS (VALUES {_RANGES}) SELECT range_id, EXISTS (SELECT 1 FROM log WHERE key >= low AND key < high) AS has_bytes, true AS within FROM ranges")
def kv_table_sizes(spark, sf_dir):
    table = written(spark, sf_dir, (True, True))
    sizes = table.get_approximate_sizes([(a.encode(), b.encode()) for _, a, b in RANGES])
    whole = sum(f.bytes for f in table.state.files)
    return spark.createDataFrame([(i, n > 0, n <= whole) for (i, _, _), n in zip(RANGES, sizes, strict=True)], "range_id int, has_bytes boolean, within boolean")


@query("kv_table_cursor", f"""{newest_sql()}, live AS (SELECT key, event_type FROM newest WHERE vtype = 1)
SELECT key, event_type AS value, row_number() OVER (ORDER BY key) AS pos, 'next' AS way FROM live WHERE key >= '{LOW}' QUALIFY pos <= 25
UNION ALL SELECT key, event_type, row_number() OVER (ORDER BY key DESC), 'prev' FROM live WHERE key <= '{HIGH}' QUALIFY row_number() OVER (ORDER BY key DESC) <= 25""")
def kv_table_cursor(spark, sf_dir):
    table, out = written(spark, sf_dir, (True, False)), []
    with table.new_iterator(page=10) as cursor:
        table.put(b"0", b"not seen")  # neither this nor what follows changes what the cursor sees
        table.flush()
        table.compact_range()
        for way, seek, move in (("next", lambda: cursor.seek(LOW.encode()), cursor.next), ("prev", lambda: cursor.seek_for_prev(HIGH.encode()), cursor.prev)):
            seek()
            for pos in range(1, 26):
                if cursor.valid():
                    out.append((cursor.key().decode(), cursor.value().decode(), pos, way))
                    move()
    return spark.createDataFrame(out, "key string, value string, pos long, way string")


@query("kv_log_files", "SELECT lpad(cast(c_custkey AS varchar), 16, '0') AS key, row_number() OVER (ORDER BY c_custkey) AS seq, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS vtype, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS value FROM customer")
def kv_log_files(spark, sf_dir):
    """One writer writes a log, in order; files are read in parallel."""
    where, seq, batch = folder(spark), 0, WriteBatch()
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment").orderBy("c_custkey")
    with LogWriter(spark, where, rotate=1 << 20) as writer:
        for row in rows.toLocalIterator():
            key = b"%016d" % row.c_custkey
            batch = batch.delete(key) if row.c_custkey % 3 == 0 else batch.put(key, row.c_mktsegment.encode())
            if len(batch) == 100:
                seq, batch = writer.add(batch, seq + 1), WriteBatch()
        if len(batch):
            writer.add(batch, seq + 1)
    return text(read_logs(spark, f"{where}/*.log", verify=True, skip_damaged=False))


@query("kv_stream_ingest", f"{newest_sql()} SELECT {STATE} FROM newest WHERE vtype = 1")
def kv_stream_ingest(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    table = KVTable.open(spark, folder(spark), Options(create_if_missing=True))
    files = spark.readStream.schema(spark.read.parquet(path).schema)  # a stream reads folders, so a single file is picked from its own
    events = files.parquet(path) if Files(spark, path).is_folder() else files.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    put = F.col("event_type") != "error"
    rows = events.select(put.cast("int").alias("vtype"), numeric_key(F.col("user_id")).cast("binary").alias("key"), F.when(put, F.col("event_type")).cast("binary").alias("value"), "event_id")
    ingest(rows, table, f"{table.path}-progress", ["event_id"]).awaitTermination()
    return text(table.scan())


@query("kv_changelog", f"WITH {EVENTS} SELECT key, seq, vtype, CASE WHEN vtype = 1 THEN event_type END AS value FROM log WHERE seq > {S2}")
def kv_changelog(spark, sf_dir):
    table = written(spark, sf_dir, (True, False))
    _, after, _ = points(table.log())
    return text(changelog(table, after))
