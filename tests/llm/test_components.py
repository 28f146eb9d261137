"""Links to components: few links are one task's, more are dealt out, with the same result."""

import random

from kvspark.llm import simhash


def smallest(links):
    """Plain Python: node to the smallest node that it can reach."""
    root = {x: x for link in links for x in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def graph():
    rng = random.Random(3)
    chain = [(k, k + 1) for k in range(1000, 1060)]
    star = [(-5, k) for k in range(2000, 2080)]
    loose = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    return chain + star + [(a, b) for a, b in loose if a != b] + [(7, 9), (9, 7), (7, 9)]


def found(spark, links, group):
    spark.sparkContext.setJobGroup(group, group)
    try:
        rows = simhash.components(spark.createDataFrame(links, "a long, b long")).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.root for r in rows}


def tasks(spark, group):
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))


def test_few_links_need_no_shuffle_in_a_round(spark):
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        assert found(spark, graph(), "few links") == smallest(graph())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # the links are made distinct by one shuffle, and so are the roots; each round of shuffles took hundreds of tasks
    assert 0 < tasks(spark, "few links") < 60 * 6


def test_links_dealt_out_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(simhash, "ALONE", 20)
    assert found(spark, graph(), "dealt out") == smallest(graph())
    assert found(spark, [], "no links") == {}
