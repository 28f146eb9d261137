import pandas as pd
import pytest
from pyspark.sql import functions as F

from kvspark.operators import compaction
from kvspark.operators.compaction import CompactionFilter
from kvspark.schema import LOG
from tests import model


def tuples(df):
    return sorted((bytes(r.key), r.seq, r.vtype, None if r.value is None else bytes(r.value)) for r in df.collect())


@pytest.mark.parametrize("seed, oldest", [(1, 0), (2, 120), (3, 300)])
def test_prune_and_reads_after_it(spark, seed, oldest):
    rows = model.random_log(seed)
    log = spark.createDataFrame(rows, LOG)
    pruned = compaction.prune(log, oldest)
    assert tuples(pruned.drop("__newest")) == sorted(model.prune(rows, oldest))
    small = tuples(compaction.compact(log, oldest))
    for at in (oldest, oldest + 50, 300):
        if at >= oldest:
            assert model.visible(small, at) == model.visible(rows, at)
    assert not any(t == 0 and s <= oldest for _, s, t, _ in small)


def test_deletes_stay_above_deeper_files(spark):
    log = spark.createDataFrame([(b"a", 2, 0, None), (b"m", 3, 0, None), (b"z", 9, 0, None)], LOG)
    deeper = [(b"l", b"n")]
    assert [r[0] for r in tuples(compaction.compact(log, 5, deeper))] == [b"m", b"z"]
    many = [(b"l%03d" % i, b"l%03d" % i) for i in range(100)] + [(b"l5", b"m"), (b"ma", b"n"), (b"y", b"z")]
    assert compaction.merged(many)[-3:] == [(b"l5", b"m"), (b"ma", b"n"), (b"y", b"z")]
    assert [r[0] for r in tuples(compaction.compact(log, 5, many))] == [b"m", b"z"]
    assert compaction.merged([(b"b", b"d"), (b"a", b"b"), (b"c", b"e")]) == [(b"a", b"e")]


def test_prune_has_one_shuffle_and_no_join(spark):
    plan = compaction.prune(spark.createDataFrame([(b"a", 2, 0, None)], LOG), 5)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


ROWS = [(b"drop_1", 1, 1, b"bye"), (b"drop_1", 4, 1, b"again"), (b"keep_1", 2, 1, b"hi"), (b"gone", 3, 0, None)]


def test_filter_removes_and_changes(spark):
    log = spark.createDataFrame(ROWS, LOG)
    keep = ~F.startswith("key", F.lit(b"drop"))
    for rule in (CompactionFilter(keep=keep), CompactionFilter(keep=keep, mode="plain"), CompactionFilter(decide=lambda p: pd.DataFrame({"keep": [not k.startswith(b"drop") for k in p["key"]], "value": p["value"]}))):
        assert tuples(compaction.compact(log, 10, rule=rule)) == [(b"keep_1", 2, 1, b"hi")]
    change = CompactionFilter(value=F.encode(F.upper(F.decode("value", "UTF-8")), "UTF-8"))
    assert {r[3] for r in tuples(compaction.compact(log, 10, rule=change))} == {b"AGAIN", b"HI"}


def test_filter_leaves_what_a_snapshot_sees(spark):
    log = spark.createDataFrame(ROWS, LOG)
    rule = CompactionFilter(keep=F.lit(False))
    out = tuples(compaction.compact(log, 2, rule=rule, pinned=True))
    assert model.visible(out, 2) == model.visible(ROWS, 2) and model.visible(out) == {b"keep_1": (2, b"hi")}
