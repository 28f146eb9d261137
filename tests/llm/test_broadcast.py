"""What is sent through the driver: a table that grew by an explode counts with all its rows."""

import random

from kvspark.llm import simhash


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_are_not_broadcast_by_the_size_of_their_nodes(spark):
    r = random.Random(8)
    marks = [r.getrandbits(64) for _ in range(1500)]
    marks += [m ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for m in marks[:200]]
    marks = sorted({m - (1 << 64) if m >> 63 else m for m in marks})
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, str(30 * len(marks)))  # the nodes are 16 to 24 bytes each, their cells over 1,000
    try:
        nodes = spark.createDataFrame([(m,) for m in marks], "mark long").groupBy("mark").count().select("mark")
        pairs = simhash.near_pairs(nodes)
        got = sorted((x.a, x.b) for x in pairs.collect())  # then the plan is that which ran
    finally:
        spark.conf.set(name, before)
    assert "isFinalPlan=true" in plan(pairs) and "Broadcast" not in plan(pairs)
    assert got == [(a, b) for i, a in enumerate(marks) for b in marks[i + 1 :] if ((a ^ b) % (1 << 64)).bit_count() <= 4] and len(got) > 150
