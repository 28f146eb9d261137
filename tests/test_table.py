import random

import pytest
from pyspark.sql import functions as F

from kvspark.__main__ import main
from kvspark.errors import Corruption, InvalidArgument, NotFound
from kvspark.functions.keys import CASELESS, REVERSE
from kvspark.operators.batch import WriteBatch, check_batch
from kvspark.operators.compaction import CompactionFilter
from kvspark.sources.files import Files
from kvspark.sources.logfile import LogWriter
from kvspark.sources.manifest import State, parse_name
from kvspark.sources.options import Options, ReadOptions
from kvspark.sources.table import KVTable
from kvspark.streaming.ingest import changelog, ingest

NEW = Options(create_if_missing=True)


def contents(table, **options):
    return [(bytes(r.key), bytes(r.value)) for r in table.scan(**options).collect()]


def test_life_cycle(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(InvalidArgument):
        KVTable.open(spark, path)
    assert not (tmp_path / "t" / "manifest").exists()
    with KVTable.open(spark, path, NEW) as table:
        table.write(WriteBatch().put(b"key", b"value").put(b"foo", b"bar"))
        table.delete(b"foo")
        table.delete(b"never there")
    with KVTable.open(spark, path) as table:
        assert table.get(b"key") == b"value" and table.get_or_none(b"foo") is None
        with pytest.raises(NotFound):
            table.get(b"foo")
        assert table.state.last_seq == 4 and table.state.flushed_seq == 4 and not table.state.deltas
    with pytest.raises(InvalidArgument):
        KVTable.open(spark, path, Options(error_if_exists=True))
    with pytest.raises(InvalidArgument):
        KVTable.open(spark, path, Options(key_order=REVERSE))
    (tmp_path / "t" / "mine.txt").write_text("stays")
    KVTable.destroy(spark, path)
    assert [p.name for p in (tmp_path / "t").iterdir() if not p.name.startswith(".")] == ["mine.txt"]
    KVTable.destroy(spark, str(tmp_path / "nowhere"))


def test_random_operations_against_a_model(spark, tmp_path):
    r, want, snaps = random.Random(7), {}, []
    table = KVTable.open(spark, str(tmp_path / "t"), NEW)
    for step in range(24):
        batch = WriteBatch()
        for _ in range(r.randint(1, 6)):
            key = b"k%d" % r.randrange(12)
            if r.random() < 0.3:
                batch.delete(key)
                want.pop(key, None)
            else:
                value = b"v%d.%d" % (step, r.randrange(100))
                batch.put(key, value)
                want[key] = value
        table.write(batch)
        if step in (5, 15):
            snaps.append((table.get_snapshot(), dict(want)))
        if step % 6 == 3:
            table.flush()
        if step % 8 == 7:
            table.compact_range()
            table.maintain()
    assert contents(table) == sorted(want.items())
    for snap, then in snaps:
        assert contents(table, options=ReadOptions(snapshot=snap)) == sorted(then.items())
        snap.release()
    table.flush()
    table.compact_range()
    assert contents(table) == sorted(want.items()) and table.verify() == table.log().count()
    assert contents(KVTable.open(spark, str(tmp_path / "t"))) == sorted(want.items())
    assert table.multi_get([b"k1", b"k2", b"absent"]) == {k: want[k] for k in (b"k1", b"k2") if k in want}


def test_cursor_turns_round(spark):
    table = KVTable.in_memory(spark)
    table.write(WriteBatch().put(b"a", b"1").put(b"b", b"2").put(b"c", b"3").put(b"x", b"").delete(b"x"))
    for page in (1, 2, 100):
        cursor = table.new_iterator(page=page)
        assert not cursor.valid()
        cursor.seek_to_last()
        seen = [cursor.key()]
        for move in (cursor.prev, cursor.next, cursor.prev, cursor.prev, cursor.next):
            move()
            seen.append(cursor.key())
        assert seen == [b"c", b"b", b"c", b"b", b"a", b"b"]
        cursor.seek(b"b0")
        assert list(cursor.forward()) == [(b"c", b"3")] and not cursor.valid()
        cursor.seek_for_prev(b"b0")
        assert cursor.value() == b"2"
    table.put(b"a", b"new")
    cursor.seek_to_first()
    assert cursor.value() == b"1" and table.get(b"a") == b"new"


def test_in_memory_does_nothing_on_disk(spark):
    table = KVTable.in_memory(spark)
    table.put(b"", b"")
    table.flush()
    table.compact_range()
    assert table.get(b"") == b"" and table.get_approximate_sizes([(b"", None)]) == [0] and table.maintain() == 0


def test_orders(spark, tmp_path):
    table = KVTable.open(spark, str(tmp_path / "r"), Options(create_if_missing=True, key_order=REVERSE))
    table.write(WriteBatch().put(b"a", b"1").put(b"b", b"2").put(b"c", b"3"))
    assert [k for k, _ in contents(table)] == [b"c", b"b", b"a"] and [k for k, _ in contents(table, start=b"b")] == [b"b", b"a"]
    caseless = KVTable.in_memory(spark, Options(key_order=CASELESS))
    caseless.write(WriteBatch().put(b"Key", b"1").put(b"kEY", b"2"))
    assert caseless.get(b"key") == b"2" and len(contents(caseless)) == 1


def test_properties_and_sizes(spark, tmp_path):
    table = KVTable.open(spark, str(tmp_path / "t"), Options(create_if_missing=True, bloom_bits_per_key=10, compression="zstd"))
    table.write(WriteBatch().append(_many(100)))
    assert int(table.get_property("kv.approximate-memory-usage")) > 0 and table.get_approximate_sizes([(None, None)]) == [0]
    table.flush()
    assert table.get_property("kv.num-files-at-level2") == "1" and table.get_property("kv.num-files-at-level7") is None
    assert table.get_property("kv.nothing") is None and table.get_property("num-files-at-level0") is None
    assert "key0000 .. key0099" in table.get_property("kv.sstables") and table.get_property("kv.stats").count("\n") == 2
    whole, half, none, empty = table.get_approximate_sizes([(None, None), (b"key0000", b"key0050"), (b"z", None), (b"key0001", b"key0001")])
    assert whole > 0 and abs(half - whole / 2) <= 2 and none == empty == 0 and table.get_approximate_sizes([]) == []


def _many(n):
    batch = WriteBatch()
    for i in range(n):
        batch.put(b"key%04d" % i, b"x" * 50)
    return batch


def test_compaction_filter_and_trivial_move(spark, tmp_path):
    keep = ~F.startswith("key", F.lit(b"drop"))
    table = KVTable.open(spark, str(tmp_path / "t"), Options(create_if_missing=True, compaction_filter=CompactionFilter(keep=keep)))
    table.write(WriteBatch().put(b"drop_1", b"x").put(b"keep_1", b"y"))
    table.flush()
    table.write(WriteBatch().put(b"drop_2", b"x").put(b"keep_0", b"y"))
    table.flush()
    table.compact_range()
    assert [k for k, _ in contents(table)] == [b"keep_0", b"keep_1"]
    plain = KVTable.open(spark, str(tmp_path / "p"), NEW)
    plain.put(b"a", b"1")
    plain.flush()
    before = {f.path for f in plain.state.files}
    plain.compact_range()
    assert {f.path for f in plain.state.files} == before and {f.level for f in plain.state.files} == {3}


def test_two_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    one, two = KVTable.open(spark, path, NEW), KVTable.open(spark, path)
    one.put(b"a", b"1")
    two.put(b"b", b"2")
    again = KVTable.open(spark, path)
    assert contents(again) == [(b"a", b"1"), (b"b", b"2")] and again.state.last_seq == 2


def test_repair(spark, tmp_path):
    path = str(tmp_path / "t")
    table = KVTable.open(spark, path, Options(create_if_missing=True, reuse_logs=True))
    table.put(b"k", b"old")
    table.flush()
    table.put(b"k", b"new")
    table.put(b"from_delta", b"yes")
    Files(spark, path).delete("manifest")
    (tmp_path / "t" / "data" / "000000000099.delta").write_bytes(b"not parquet")
    lost = KVTable.repair(spark, path)
    assert lost == ["data/000000000099.delta"] and (tmp_path / "t" / "lost").exists()
    again = KVTable.open(spark, path)
    assert contents(again) == [(b"from_delta", b"yes"), (b"k", b"new")] and again.state.last_seq == 3


def test_batches(spark):
    batch = WriteBatch().put(b"foo", b"bar").put(b"baz", b"qux").delete(b"foo")
    seen = []

    class Visitor:
        def put(self, key, value):
            seen.append((key, value))

        def delete(self, key):
            seen.append(key)

    batch.iterate(Visitor())
    assert seen == [(b"foo", b"bar"), (b"baz", b"qux"), b"foo"] and len(batch) == 3
    assert WriteBatch().approximate_size() == 12 < batch.approximate_size()
    assert check_batch(batch.to_df(spark)) == 3
    with pytest.raises(Corruption):
        check_batch(batch.to_df(spark).filter("op_index <> 1"))
    batch.clear()
    assert not len(batch)


def test_names_and_commits():
    assert parse_name("000000000012.json") == ("commit", 12) and parse_name("000000000003.data") == ("table", 3)
    assert parse_name("LOCK") == ("lock", 0) and parse_name("notes.txt") is None
    state = State(last_seq=5, pointers={1: b"\xff"}, batches=("a",))
    assert State.decode(state.encode()) == state
    with pytest.raises(Corruption):
        State.decode(b"{}")


def test_stream_and_changelog(spark, tmp_path):
    source = tmp_path / "in"
    rows = spark.createDataFrame([(1, b"a", b"1", 1), (1, b"b", b"2", 2), (0, b"a", None, 3)], "vtype int, key binary, value binary, n int")
    rows.coalesce(1).write.parquet(str(source))
    table = KVTable.open(spark, str(tmp_path / "t"), NEW)
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(str(source))
        ingest(stream, table, str(tmp_path / "c"), ["n"]).awaitTermination(60)
        assert contents(table) == [(b"b", b"2")] and table.state.last_seq == 3
    assert table.write_df(WriteBatch().put(b"z", b"z").to_df(spark), "ingest:0") == 3
    assert sorted(r.seq for r in changelog(table, 1).collect()) == [2, 3]


def test_command_line(spark, tmp_path, capsys):
    run = lambda *args: main(["--dir", str(tmp_path / "t"), *args], spark)
    assert run("put", "k", "v") == 0 and run("get", "k") == 0 and capsys.readouterr().out == "v\n"
    assert run("flush") == run("compact") == run("delete", "k") == 0 and run("get", "k") == 1


def test_cursors_and_scans_outlive_maintenance(spark, tmp_path):
    table = KVTable.open(spark, str(tmp_path / "t"), Options(create_if_missing=True, retention_seconds=0, write_buffer_size=1 << 30))
    lasting = KVTable.open(spark, str(tmp_path / "t"))
    for i in range(6):
        table.put(b"k%d" % i, b"old")
    cursor = table.new_iterator(page=2)
    cursor.seek_to_first()
    seen = [cursor.key()]
    for step in range(5):
        table.write(WriteBatch().put(b"k%d" % step, b"new").delete(b"k5").put(b"k%da" % step, b"x"))
        table.flush()
        if step % 2:
            table.compact_range()
        cursor.next()
        seen.append((cursor.key(), cursor.value()))
    assert seen == [b"k0", *[(b"k%d" % i, b"old") for i in range(1, 6)]]
    assert lasting.state.version < table.state.version and len(table.files.names("pins")) == 1
    cursor.close()
    assert table.vacuum() and table.held() == [] and not cursor.valid()
    names = {n for n in table.files.names("data")}
    assert all(any(n in f.path for f in table.state.files) for n in names)
    kept = KVTable.open(spark, str(tmp_path / "t"))  # files that it stops using stay for a while
    before = kept.scan()
    kept.put(b"k0", b"newest")
    kept.flush()
    kept.compact_range()
    assert dict((bytes(r.key), bytes(r.value)) for r in before.collect())[b"k0"] == b"new" and kept.get(b"k0") == b"newest"


def test_pins_of_other_processes_hold(spark, tmp_path):
    path = str(tmp_path / "t")
    one = KVTable.open(spark, path, NEW)
    one.put(b"k", b"old")
    snap = one.get_snapshot()
    two = KVTable.open(spark, path)
    two.put(b"k", b"new")
    assert two.oldest_pinned() == snap.seq
    two.flush()
    two.compact_range()
    assert two.log().count() == 2
    assert KVTable.open(spark, path).get(b"k", ReadOptions(snapshot=snap)) == b"old"
    snap.release()
    snap.release()
    assert two.oldest_pinned() == two.state.last_seq
    short = KVTable.open(spark, path, Options(pin_seconds=-1))
    short.get_snapshot()
    assert two.held() == [] and two.files.names("pins")
    two.vacuum()
    assert two.files.names("pins") == []


def test_groups_and_back_pressure(spark, tmp_path):
    table = KVTable.open(spark, str(tmp_path / "t"), NEW)
    assert table.write_group([WriteBatch().put(b"a", b"1"), WriteBatch(), WriteBatch().delete(b"a").put(b"b", b"2")]) == [1, 1, 3]
    assert contents(table) == [(b"b", b"2")] and len(table.state.deltas) == 1
    for i in range(16):
        table.put(b"a", b"%d" % i)
        table.put(b"z", b"%d" % i)
        table.flush()
        if table.debt().advice == "stop":
            break
    else:
        raise AssertionError("level 0 never filled")
    table.put(b"m", b"m")
    assert table.debt().advice == "go" and table.get(b"z") == b"%d" % i


def test_repair_leaves_out_what_is_out_of_use_and_reads_logs(spark, tmp_path):
    path = str(tmp_path / "t")
    table = KVTable.open(spark, path, NEW)
    table.put(b"gone", b"x")
    table.flush()
    table.delete(b"gone")
    table.put(b"stays", b"y")
    table.flush()
    table.compact_range()
    with LogWriter(spark, f"{path}/data", first=77) as writer:
        assert writer.add(WriteBatch().put(b"from_log", b"z").delete(b"nothing"), table.state.last_seq + 1) == 5
    Files(spark, path).delete("manifest")
    KVTable.repair(spark, path)
    again = KVTable.open(spark, path)
    assert contents(again) == [(b"from_log", b"z"), (b"stays", b"y")] and again.state.last_seq == 5
