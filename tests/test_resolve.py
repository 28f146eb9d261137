import pytest

from kvspark.functions.keys import ORDERS, prefix_end, printable, separator
from kvspark.operators import resolve
from kvspark.operators.resolve import Shape
from kvspark.schema import LOG
from tests import model


def frame(spark, rows):
    return spark.createDataFrame(rows, LOG)


def pairs(df):
    return [(bytes(r.key), bytes(r.value)) for r in df.collect()]


#: Rule by rule: nothing, alive, not yet written, deleted, before the delete, written again, and odd keys.
GOLDEN = [
    ([], 7, []),
    ([(b"city", 3, 1, b"Oslo")], 3, [(b"city", b"Oslo")]),
    ([(b"city", 3, 1, b"Oslo")], 2, []),
    ([(b"city", 3, 1, b"Oslo"), (b"city", 8, 0, None)], None, []),
    ([(b"city", 3, 1, b"Oslo"), (b"city", 8, 0, None)], 7, [(b"city", b"Oslo")]),
    ([(b"city", 3, 1, b"Oslo"), (b"city", 8, 0, None), (b"city", 9, 1, b"Rome")], 20, [(b"city", b"Rome")]),
    ([(b"city", 8, 0, None), (b"dish", 9, 1, b"soup")], 20, [(b"dish", b"soup")]),
    ([(b"", 1, 1, b""), (b"x", 2, 0, None)], 10, [(b"", b"")]),
]


@pytest.mark.parametrize("rows, as_of, want", GOLDEN)
def test_golden(spark, rows, as_of, want):
    assert pairs(resolve.range_scan(frame(spark, rows), as_of=as_of)) == want


def test_seeks(spark):
    log = frame(spark, [(b"a", 1, 1, b"a"), (b"b", 2, 0, None), (b"c", 3, 1, b"c"), (b"\xff\x00", 4, 1, b"z")])
    assert pairs(resolve.seek(log, b"b")) == [(b"c", b"c")]
    assert pairs(resolve.seek(log, b"\xff\xff")) == []
    assert pairs(resolve.seek_for_prev(log, b"b")) == [(b"a", b"a")]
    assert pairs(resolve.range_scan(log, reverse=True)) == [(b"\xff\x00", b"z"), (b"c", b"c"), (b"a", b"a")]
    assert pairs(resolve.range_scan(log, b"a", b"c")) == [(b"a", b"a")]
    assert pairs(resolve.prefix_scan(log, b"\xff")) == [(b"\xff\x00", b"z")]


def test_merge_prefers_the_earlier_source(spark):
    new = frame(spark, [(b"ant", 11, 1, b"six legs"), (b"bee", 12, 0, None), (b"cow", 6, 1, b"new source")])
    old = frame(spark, [(b"cow", 6, 1, b"old source"), (b"ant", 4, 1, b"legs"), (b"bee", 5, 1, b"stripes"), (b"dog", 7, 1, b"barks")])
    both = resolve.merge_sources([new, old])
    assert both.count() == 6
    assert pairs(resolve.range_scan(both)) == [(b"ant", b"six legs"), (b"cow", b"new source"), (b"dog", b"barks")]
    assert pairs(resolve.range_scan(both, as_of=10)) == [(b"ant", b"legs"), (b"bee", b"stripes"), (b"cow", b"new source"), (b"dog", b"barks")]


def test_numbers_and_history_of_hot_keys(spark):
    rows = [(b"hot" if i % 3 else b"k%03d" % i, i, 1, b"v") for i in range(300)]
    log = frame(spark, rows).repartition(7)
    numbered = resolve.number_rows(log, log.seq.desc(), name="n")
    assert sorted((r.n, r.seq) for r in numbered.collect()) == [(k + 1, 299 - k) for k in range(300)]
    assert resolve.number_rows(log.limit(0), log.seq).count() == 0
    got = {(bytes(r.key), r.seq): r.rn for r in resolve.history(log).collect()}
    hot = sorted((s for k, s, _, _ in rows if k == b"hot"), reverse=True)
    assert got == {(k, s): hot.index(s) + 1 if k == b"hot" else 1 for k, s, _, _ in rows}


@pytest.mark.parametrize("seed", range(3))
def test_random_logs(spark, seed):
    rows = model.random_log(seed)
    log = frame(spark, rows)
    for as_of in (None, 0, 100, 250):
        want = model.visible(rows, as_of)
        got = {bytes(r.key): (r.seq, bytes(r.value)) for r in resolve.visible(log, as_of).collect()}
        assert got == want
    keys = sorted({r[0] for r in rows})[:5] + [b"absent!"]
    wanted = spark.createDataFrame([(k,) for k in keys], "key binary")
    assert {bytes(r.key) for r in resolve.multi_get(log, wanted).collect()} == set(keys) & set(model.visible(rows))
    old, new = model.visible(rows, 100), model.visible(rows, 250)
    diff = {bytes(r.key): (r.change, r.old_seq, r.new_seq) for r in resolve.snapshot_diff(log, 100, 250).collect()}
    assert diff == {
        k: ("added" if k not in old else "removed" if k not in new else "changed", old.get(k, (None,))[0], new.get(k, (None,))[0])
        for k in {*old, *new} if old.get(k) != new.get(k)
    }


def test_fixed_width_values_are_aggregated_by_hash(spark):
    log = spark.createDataFrame([(1, 1, 1, 2.0), (1, 2, 1, None), (2, 1, 0, 1.0)], "k int, seq long, vtype int, v double")
    live = resolve.visible(log, shape=Shape(keys=("k",)))
    assert [tuple(r) for r in live.collect()] == [(1, 2, 1, None)]
    assert "SortAggregate" not in live._jdf.queryExecution().executedPlan().toString()


def test_key_filter_reaches_the_scan(spark, tmp_path):
    frame(spark, model.random_log(9)).write.parquet(str(tmp_path / "log"))
    plan = resolve.get(spark.read.parquet(str(tmp_path / "log")), b"k")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key" in plan


def test_key_orders(spark):
    keys = sorted({r[0] for r in model.random_log(4, keys=60)} | {b"", b"a", b"ab", b"B", b"b"})
    df = spark.createDataFrame([(k,) for k in keys], "key binary")
    for order in ORDERS.values():
        made = {bytes(r.key): bytes(r.e) for r in df.select("key", order.column(df.key).alias("e")).collect()}
        assert made == {k: order.encode(k) for k in keys}
    reverse = ORDERS["reverse-bytewise"].encode
    assert sorted(keys, key=reverse) == keys[::-1]
    assert prefix_end(b"a\xff") == b"b" and prefix_end(b"\xff") is None and prefix_end(b"") is None
    assert b"abc" <= separator(b"abcx", b"azz") < b"azz" and separator(b"a", b"b") == b"a"
    assert printable(b"a\x00\xff") == "a\\x00\\xff"
