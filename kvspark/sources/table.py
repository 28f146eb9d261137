"""A key/value table on disk: commits, levels of sorted Parquet files, and deltas that are not flushed yet."""

from __future__ import annotations

import io
import json
import logging
import threading
import time
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import replace

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvspark.errors import Corruption, InvalidArgument, NotFound
from kvspark.functions.keys import prefix_end, printable
from kvspark.operators import compaction as job
from kvspark.operators.batch import WriteBatch, assign_sequence, check_batch
from kvspark.operators.cursor import Cursor
from kvspark.operators.resolve import Shape, visible
from kvspark.plans import planner
from kvspark.plans.planner import LEVELS, FileMeta
from kvspark.schema import LOG
from kvspark.sources.files import Files
from kvspark.sources.logfile import read_logs
from kvspark.sources.manifest import Manifest, State, level_counts, parse_name
from kvspark.sources.options import FlushOptions, Options, ReadOptions, WriteOptions

log = logging.getLogger("kvspark")
STORED = T.StructType([T.StructField("sort_key", T.BinaryType(), False), *LOG.fields])
BY_SORT_KEY = Shape(keys=("sort_key",))
DATA, LOST, PINS, DROPPED = "data", "lost", "pins", "dropped"
#: Keys of a batch lookup that are sent to every task at most; more are joined by a shuffle.
MAX_SENT_KEYS = 100_000


class Snapshot:
    """A pinned sequence number; ``release`` (or leaving a ``with`` block) gives it back."""

    def __init__(self, table: KVTable, seq: int, pin: str):
        self.table, self.seq, self.pin = table, seq, pin

    def release(self) -> None:
        self.table._unpin(self.pin)

    def __enter__(self) -> Snapshot:
        return self

    def __exit__(self, *_) -> None:
        self.release()


def _names(state: State) -> set[str]:
    """Names in the data folder that a state needs: of a file, or of the folder that it is in."""
    paths = [f.path.split("/") for f in (*state.files, *state.deltas)]
    return {p[-1] if p[-1].endswith(".delta") else p[-2] for p in paths}


class KVTable:
    """``KVTable.open`` for a table on disk, ``KVTable.in_memory`` for one without files."""

    def __init__(self, spark: SparkSession, path: str | None, options: Options):
        self.spark, self.path, self.options = spark, path, options
        self.state, self.lock = State(order=options.key_order.name), threading.RLock()
        self.pins: dict[str, dict] = {}  # our own; those on disk are everyone's
        self.memory: list[tuple] = []
        self.files = Files(spark, path) if path else None
        self.manifest = Manifest(self.files) if self.files else None

    # -- life cycle ------------------------------------------------------------------

    @classmethod
    def in_memory(cls, spark: SparkSession, options: Options | None = None) -> KVTable:
        return cls(spark, None, options or Options())

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: Options | None = None) -> KVTable:
        table = cls(spark, path, options or Options())
        state = table.manifest.latest()
        if state is None:
            if not table.options.create_if_missing:
                raise InvalidArgument(f"{path} does not exist")
            table.files.make(DATA)
            state = table.manifest.commit(State(order=table.options.key_order.name))
        elif table.options.error_if_exists:
            raise InvalidArgument(f"{path} exists")
        if state.order != table.options.key_order.name:
            raise InvalidArgument(f"the table is ordered by {state.order}, not {table.options.key_order.name}")
        table.state = state
        if state.deltas and not table.options.reuse_logs:
            table.flush()
        return table

    def close(self) -> None:
        for pin in list(self.pins):
            self._unpin(pin)

    def __enter__(self) -> KVTable:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    @staticmethod
    def destroy(spark: SparkSession, path: str) -> None:
        """Removes the files of a table; others stay, and so does the folder then."""
        files = Files(spark, path)
        for folder in ("manifest", DATA, LOST, PINS, DROPPED):
            for name in files.names(folder):
                if parse_name(name) or folder in (LOST, PINS, DROPPED) or name.endswith(".crc"):
                    files.delete(f"{folder}/{name}")
            if files.exists(folder) and not files.names(folder):
                files.delete(folder)
        if files.exists() and not files.names():
            files.delete()

    # -- writing ---------------------------------------------------------------------

    def put(self, key: bytes, value: bytes) -> None:
        self.write(WriteBatch().put(key, value))

    def delete(self, key: bytes) -> None:
        self.write(WriteBatch().delete(key))

    def write(self, batch: WriteBatch, options: WriteOptions | None = None) -> int:
        """Commits a batch as a whole and returns the last sequence number. A commit is durable.

        With many files on level 0 a write waits a moment; with too many it compacts first.
        """
        if not len(batch):
            return self.state.last_seq
        encode = self.options.key_order.encode
        with self.lock:
            self._make_room()
            while True:
                rows = [(encode(r[0]), *r) for r in batch.rows(self.state.last_seq)]
                if not self.files:
                    self.memory += rows
                    self.state = replace(self.state, last_seq=rows[-1][2])
                    return rows[-1][2]
                number = self._numbers(1)
                meta = self._write_delta(number, rows)
                try:
                    self._publish(replace(self.state, last_seq=rows[-1][2], deltas=(*self.state.deltas, meta)))
                    break
                except InvalidArgument:  # someone else was first; number the operations anew
                    self.files.delete(f"{DATA}/{number:012d}.delta")
                    self.state = self.manifest.latest()
            if sum(d.bytes for d in self.state.deltas) >= self.options.write_buffer_size:
                self.flush()
            return rows[-1][2]

    def write_group(self, batches: Sequence[WriteBatch], options: WriteOptions | None = None) -> list[int]:
        """Commits several batches as one, in order, and returns the last sequence number of each."""
        together, ends = WriteBatch(), []
        for batch in batches:
            together.append(batch)
            ends.append(len(together))
        last = self.write(together, options)
        return [last - len(together) + n for n in ends]

    def _make_room(self) -> None:
        advice = self.debt().advice
        if advice == "slow":
            time.sleep(0.001)
        elif advice == "stop":
            self.maintain()

    def write_df(self, batch: DataFrame, batch_id: str | None = None) -> int:
        """Commits a DataFrame (op_index, vtype, key, value). With a ``batch_id`` a second attempt does nothing."""
        if not self.files:
            raise InvalidArgument("a table without files takes WriteBatch only")
        with self.lock:
            if batch_id is not None and batch_id in self.state.batches:
                return self.state.last_seq
            n = check_batch(batch)
            if n:
                number = self._numbers(1)
                rows = assign_sequence(batch, self.state.last_seq).withColumn("sort_key", self.options.key_order.column(F.col("key")))
                metas = self._write_level(rows.select(STORED.names), number, 0, 1 + n // 1_000_000)
            done = self.state.batches if batch_id is None else (*self.state.batches, batch_id)[-1000:]
            self._publish(replace(self.state, last_seq=self.state.last_seq + n, batches=done, deltas=(*self.state.deltas, *(metas if n else ()))))
            return self.state.last_seq

    def _write_delta(self, number: int, rows: list[tuple]) -> FileMeta:
        schema = pa.schema([("sort_key", pa.binary()), ("key", pa.binary()), ("seq", pa.int64()), ("vtype", pa.int32()), ("value", pa.binary())])
        ordered = sorted(rows, key=lambda r: (r[0], -r[2]))
        sink = io.BytesIO()
        pq.write_table(pa.table([pa.array([r[k] for r in ordered], schema.field(k).type) for k in range(5)], schema=schema), sink, compression=self.options.compression)
        name = f"{DATA}/{number:012d}.delta"
        if not self.files.create(name, sink.getvalue()):
            raise Corruption(f"{name} exists")
        seqs = [r[2] for r in rows]
        return FileMeta(0, number, len(sink.getvalue()), ordered[0][0], ordered[-1][0], min(seqs), max(seqs), len(rows), self.files.uri(name))

    def _numbers(self, n: int) -> int:
        first = max([self.state.next_number, *(m[1] + 1 for name in self.files.names(DATA) if (m := parse_name(name)))])
        self.state = replace(self.state, next_number=first + n)
        return first

    def _publish(self, state: State) -> None:
        before, self.state = _names(self.state), self.manifest.commit(state)
        gone = sorted(before - _names(self.state))
        if gone:  # how long they stay is for vacuum to say; repair leaves them out
            self.files.create(f"{DROPPED}/{self.state.version:012d}.json", json.dumps({"at": time.time(), "names": gone}).encode())

    # -- files -----------------------------------------------------------------------

    def _write_level(self, rows: DataFrame, number: int, level: int, parts: int) -> list[FileMeta]:
        """Writes rows as files sorted by key, newest first; all versions of a key are in one file."""
        name = f"{DATA}/{number:012d}.data"
        ordered = rows.repartitionByRange(parts, "sort_key").sortWithinPartitions("sort_key", F.desc("seq"))
        ordered.write.options(**self.options.parquet()).mode("overwrite").parquet(self.files.uri(name))
        return self._describe([self.files.uri(name)], number, level)

    def _describe(self, paths: Sequence[str], number: int, level: int) -> list[FileMeta]:
        found = self.spark.read.schema(STORED).parquet(*paths).groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).agg(
            F.min("sort_key").alias("low"), F.max("sort_key").alias("high"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("*").alias("n")
        )
        rows = sorted(found.collect(), key=lambda r: bytes(r["low"]))  # one row a file
        return [FileMeta(level, number * 100_000 + i, r["size"], bytes(r["low"]), bytes(r["high"]), r["first"], r["last"], r["n"], r["path"]) for i, r in enumerate(rows)]

    def _read(self, files: Iterable[FileMeta], verify: bool = False) -> DataFrame:
        paths = [f.path for f in files]
        reader = self.spark.read.schema(STORED)
        if verify or self.options.paranoid_checks:
            reader = reader.option("parquet.page.verify-checksum.enabled", "true")
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], STORED)

    def log(self, begin: bytes | None = None, end: bytes | None = None, as_of: int | None = None, verify: bool = False) -> DataFrame:
        """All versions that a read of the encoded range (inclusive) can need, from the files that overlap it."""
        if not self.files:
            return self.spark.createDataFrame(self.memory, STORED)
        chosen = planner.prune([*self.state.files, *self.state.deltas], begin, end, as_of)
        return self._read(chosen, verify)

    # -- reading ---------------------------------------------------------------------

    def _seq(self, options: ReadOptions | None) -> int:
        pinned = options.snapshot if options else None
        return self.state.last_seq if pinned is None else pinned.seq

    def get(self, key: bytes, options: ReadOptions | None = None) -> bytes:
        found = self.get_or_none(key, options)
        if found is None:
            raise NotFound(repr(key))
        return found

    get_with_options = get

    def get_or_none(self, key: bytes, options: ReadOptions | None = None) -> bytes | None:
        sort_key, seq = self.options.key_order.encode(key), self._seq(options)
        rows = self.log(sort_key, sort_key, seq, bool(options and options.verify_checksums)).filter(F.col("sort_key") == F.lit(sort_key))
        found = visible(rows, seq, BY_SORT_KEY).select("value").take(1)
        return bytes(found[0][0]) if found else None

    def multi_get(self, keys: Iterable[bytes], options: ReadOptions | None = None) -> dict[bytes, bytes]:
        """The live ones of a list of keys, in one job."""
        encoded = {self.options.key_order.encode(k): k for k in keys}
        if not encoded:
            return {}
        wanted = self.spark.createDataFrame([(k,) for k in encoded], "sort_key binary")
        wanted = F.broadcast(wanted) if len(encoded) <= MAX_SENT_KEYS else wanted
        rows = self.log(min(encoded), max(encoded), self._seq(options)).join(wanted, "sort_key", "left_semi")
        return {encoded[bytes(r.sort_key)]: bytes(r.value) for r in visible(rows, self._seq(options), BY_SORT_KEY).collect()}

    def scan(self, start: bytes | None = None, end: bytes | None = None, options: ReadOptions | None = None, reverse: bool = False, limit: int | None = None) -> DataFrame:
        """(key, value) of the live keys with start <= key < end in the table's order."""
        encode, seq = self.options.key_order.encode, self._seq(options)
        low, high = (None if k is None else encode(k) for k in (start, end))
        rows, key = self.log(low, high, seq), F.col("sort_key")
        if low is not None:
            rows = rows.filter(key >= F.lit(low))
        if high is not None:
            rows = rows.filter(key < F.lit(high))
        live = visible(rows, seq, BY_SORT_KEY).orderBy(key.desc() if reverse else key.asc())
        return (live if limit is None else live.limit(limit)).select("key", "value")

    def prefix(self, prefix: bytes, options: ReadOptions | None = None) -> DataFrame:
        if self.options.key_order.name == "bytewise":
            return self.scan(prefix, prefix_end(prefix), options)
        return self.scan(options=options).filter(F.startswith("key", F.lit(prefix)))

    def new_iterator(self, options: ReadOptions | None = None, page: int = 1000) -> Cursor:
        """A cursor over the state as it is now, unpositioned. It pins the version and its files until it is closed, or its pin runs out."""
        with self.lock:
            rows, pin = self.log(), self._pin(self._seq(options), self.state.version)
        if options is not None and not options.fill_cache:
            page = min(page, 100)
        return Cursor(rows, self._seq(options), self.options.key_order.encode, page, lambda: self._unpin(pin))

    def get_snapshot(self) -> Snapshot:
        """Pins what can be read now, in the table's folder, so that every process that compacts sees it."""
        with self.lock:
            seq = self.state.last_seq
            return Snapshot(self, seq, self._pin(seq, None))

    def _pin(self, seq: int, version: int | None) -> str:
        name, pin = uuid.uuid4().hex, {"seq": seq, "version": version, "until": time.time() + self.options.pin_seconds}
        self.pins[name] = pin
        if self.files:
            self.files.create(f"{PINS}/{name}.json", json.dumps(pin).encode())
        return name

    def _unpin(self, name: str) -> None:
        with self.lock:
            if self.pins.pop(name, None) is not None and self.files:
                self.files.delete(f"{PINS}/{name}.json")

    def held(self) -> list[dict]:
        """All pins that have not run out, of every process."""
        if not self.files:
            return list(self.pins.values())
        found = [json.loads(self.files.read(f"{PINS}/{n}")) for n in self.files.names(PINS) if n.endswith(".json") and not n.startswith(".")]
        return [p for p in found if p["until"] > time.time()]

    def oldest_pinned(self) -> int:
        return min((p["seq"] for p in self.held()), default=self.state.last_seq)

    # -- maintenance -----------------------------------------------------------------

    def flush(self, options: FlushOptions | None = None) -> threading.Thread | None:
        """Makes sorted files of the deltas. Nothing happens without files or deltas."""
        if options is not None and not options.wait:
            thread = threading.Thread(target=self.flush, daemon=True)
            thread.start()
            return thread
        with self.lock:
            deltas = self.state.deltas
            if not self.files or not deltas:
                return None
            number = self._numbers(1)
            low, high = planner.key_range(deltas)
            level = planner.flush_level(self.state.files, low, high, self.options.max_file_size)
            parts = max(1, -(-sum(d.bytes for d in deltas) // self.options.max_file_size))
            added = self._write_level(self._read(deltas), number, level, parts)
            state = self.state.with_files(added, set())
            self._publish(replace(state, deltas=(), flushed_seq=max(d.largest_seq for d in deltas)))
            self.vacuum()
            return None

    def _run(self, plan: planner.Compaction) -> None:
        if planner.is_trivial_move(plan, self.options.max_file_size) and self.options.compaction_filter is None:
            moved = planner.move(plan)
            self._publish(replace(self.state.with_files([moved], {moved.number}), pointers=self.state.pointers | {plan.level: plan.pointer}))
            return
        number, oldest = self._numbers(1), self.oldest_pinned()
        deeper = planner.deeper_ranges([*self.state.files, *(replace(d, level=LEVELS) for d in self.state.deltas)], plan)
        rows = job.compact(self._read(plan.all_inputs), oldest, deeper, self.options.compaction_filter, bool(self.held()), BY_SORT_KEY)
        parts = max(1, -(-sum(f.bytes for f in plan.all_inputs) // self.options.max_file_size))
        added = self._write_level(rows.select(STORED.names), number, plan.level + 1, parts)
        state = self.state.with_files(added, {f.number for f in plan.all_inputs})
        self._publish(replace(state, pointers=self.state.pointers | {plan.level: plan.pointer}))
        log.info("compacted %d files of level %d into %d", len(plan.all_inputs), plan.level, len(added))

    def compact_range(self, begin: bytes | None = None, end: bytes | None = None) -> None:
        """Pushes the files that overlap begin..end (inclusive) down, level after level. Deltas are not flushed; nothing happens without files."""
        if not self.files:
            return
        low, high = (None if k is None else self.options.key_order.encode(k) for k in (begin, end))
        with self.lock:
            deepest = max((f.level for f in self.state.files if f.overlaps(low, high)), default=0)
            for level in range(min(deepest, LEVELS - 2) + 1):
                plan = planner.pick_range(self.state.files, level, low, high, self.options.max_file_size)
                if plan is not None:
                    self._run(plan)
            self.vacuum()

    def maintain(self) -> int:
        """Flushes if due, then compacts until no level asks for it. Returns the number of compactions."""
        with self.lock:
            if sum(d.bytes for d in self.state.deltas) >= self.options.write_buffer_size:
                self.flush()
            n = 0
            while self.files and (plan := planner.pick(self.state.files, self.state.pointers, self.options.max_file_size)):
                self._run(plan)
                n += 1
            self.vacuum()
            return n

    def debt(self) -> planner.Debt:
        return planner.Debt(list(self.state.files))

    def vacuum(self) -> list[str]:
        """Removes data that neither the state nor a pinned version needs, once it has been out of use for ``retention_seconds``.

        So a scan that was made before a flush or compaction can still run for that long, and a cursor as long as its pin holds.
        Files that no commit has ever named are left: another writer may be about to commit them.
        """
        if not self.files:
            return []
        pinned = {p["version"] for p in self.held() if p["version"] is not None}
        live = _names(self.state).union(*(_names(self.manifest.read(v)) for v in pinned if v in self.manifest.versions()))
        gone = []
        for mark in self.files.names(DROPPED):
            if not mark.endswith(".json") or mark.startswith("."):
                continue
            entry = json.loads(self.files.read(f"{DROPPED}/{mark}"))
            if entry["at"] + self.options.retention_seconds > time.time():
                continue
            free = [n for n in entry["names"] if n not in live]
            for name in free:
                self.files.delete(f"{DATA}/{name}")
            gone += free
            if len(free) == len(entry["names"]):
                self.files.delete(f"{DROPPED}/{mark}")
        for name in self.files.names(PINS):
            if name.endswith(".json") and not name.startswith(".") and json.loads(self.files.read(f"{PINS}/{name}"))["until"] <= time.time():
                self.files.delete(f"{PINS}/{name}")
        self.manifest.prune(pinned)
        return gone

    # -- introspection ---------------------------------------------------------------

    def get_property(self, name: str) -> str | None:
        """``<prefix>.num-files-at-level<N>``, ``.stats``, ``.sstables``, ``.approximate-memory-usage``; None for others."""
        prefix, dot, what = name.partition(".")
        if not (prefix and dot):
            return None
        counts = level_counts(self.state)
        if what.startswith("num-files-at-level"):
            level = what.removeprefix("num-files-at-level")
            return str(counts[int(level)]) if level.isdecimal() and int(level) < LEVELS else None
        if what == "stats":
            lines = ["Level  Files  Size(MB)"]
            lines += [f"{n:5d}  {counts[n]:5d}  {sum(f.bytes for f in planner.at_level(self.state.files, n)) / 1048576:8.1f}" for n in counts if counts[n]]
            return "\n".join(lines) + "\n"
        if what == "sstables":
            return "".join(
                f"--- level {n} ---\n" + "".join(f" {f.number}:{f.bytes}[{printable(f.smallest)} .. {printable(f.largest)}]\n" for f in planner.at_level(self.state.files, n)) for n in range(LEVELS)
            )
        if what == "approximate-memory-usage":
            return str(sum(d.bytes for d in self.state.deltas) + sum(len(r[1]) + len(r[4] or b"") + 16 for r in self.memory))
        return None

    def get_approximate_sizes(self, ranges: Sequence[tuple[bytes | None, bytes | None]]) -> list[int]:
        """Bytes on disk of [start, limit) for each range, deltas left out. None is an open end. Files that straddle a bound count by their share of rows."""
        encode, out, open_ = self.options.key_order.encode, [], []
        for i, (start, limit) in enumerate(ranges):
            low, high = (None if k is None else encode(k) for k in (start, limit))
            total = 0
            for f in self.state.files:
                if low is not None and high is not None and low >= high:
                    continue
                if (low is None or low <= f.smallest) and (high is None or f.largest < high):
                    total += f.bytes
                elif (high is None or f.smallest < high) and (low is None or low <= f.largest):
                    open_.append((i, low, high, f))
            out.append(total)
        if open_:
            tests = []
            for i, low, high, f in open_:
                test = F.col("_metadata.file_path") == f.path
                test = test if low is None else test & (F.col("sort_key") >= F.lit(low))
                tests.append(F.count_if(test if high is None else test & (F.col("sort_key") < F.lit(high))))
            counts = self._read({f.path: f for *_, f in open_}.values()).agg(*tests).first()
            for (i, _, _, f), n in zip(open_, counts, strict=True):
                out[i] += f.bytes * n // max(1, f.rows)
        return out

    def verify(self) -> int:
        """Reads everything with checksums on and checks the log's invariants; returns the number of versions."""
        rows = self.log(verify=True)
        bad = rows.filter(~F.col("vtype").isin(0, 1) | ((F.col("vtype") == 0) != F.col("value").isNull())).count()
        twice = rows.groupBy("sort_key", "seq").agg(F.count("*").alias("n")).filter("n > 1").count()
        if bad or twice:
            raise Corruption(f"{bad} malformed versions, {twice} sequence numbers given twice")
        return rows.count()

    @staticmethod
    def repair(spark: SparkSession, path: str, options: Options | None = None) -> list[str]:
        """Makes a new commit from the data files that can be read; the others go to ``lost``. Returns their names.

        Write-ahead logs (``.log``) among them are read as well. All files become level 0; reads resolve by sequence number, so
        their order does not matter. Files that a commit has put out of use are left out, or what they hold would come back.
        """
        table = KVTable(spark, path, options or Options())
        metas, lost, dropped = [], [], set()
        for mark in table.files.names(DROPPED):
            if mark.endswith(".json") and not mark.startswith("."):
                dropped |= set(json.loads(table.files.read(f"{DROPPED}/{mark}"))["names"])
        for name in table.files.names(DATA):
            kind = parse_name(name)
            if not kind or kind[0] not in ("table", "delta", "wal") or name in dropped:
                continue
            if kind[0] == "wal":
                rows = read_logs(spark, table.files.uri(f"{DATA}/{name}"), verify=True).withColumn("sort_key", table.options.key_order.column(F.col("key")))
                if not rows.isEmpty():
                    metas += table._write_level(rows.select(STORED.names), table._numbers(1), 0, 1)
                table.files.make(LOST)
                table.files.move(f"{DATA}/{name}", f"{LOST}/{name}")
                continue
            parts = [f"{DATA}/{name}"] if kind[0] == "delta" else [f"{DATA}/{name}/{p}" for p in table.files.names(f"{DATA}/{name}") if p.endswith(".parquet")]
            for i, part in enumerate(parts):
                try:
                    metas += [replace(m, number=kind[1] * 100_000 + i) for m in table._describe([table.files.uri(part)], kind[1], 0)]
                except Exception as e:  # noqa: BLE001  any unreadable file is set aside
                    log.warning("%s cannot be read: %s", part, str(e)[:200])
                    table.files.make(LOST)
                    table.files.move(part, f"{LOST}/{part.replace('/', '_')}")
                    lost.append(part)
        last = max((m.largest_seq for m in metas), default=0)
        version = max(table.manifest.versions(), default=0)
        number = max([0, *(m[1] for n in table.files.names(DATA) if (m := parse_name(n)))]) + 1
        table.manifest.commit(State(version=version, order=table.options.key_order.name, last_seq=last, flushed_seq=last, next_number=number, files=tuple(metas)))
        return lost
