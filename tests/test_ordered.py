"""Ordered helpers: results may not depend on how groups are cut."""

import random

import pytest
from pyspark.sql import functions as F

from flowplace.operators import metrics as m
from flowplace.operators import ordered as o


@pytest.fixture(scope="module")
def table(spark):
    """Three groups; one holds most rows, with bursts of equal order keys and an outlier."""
    rng = random.Random(7)
    rows, seen = [], 0
    for group, size in (("hot", 400), ("warm", 60), ("cold", 3)):
        for _ in range(size):
            t = rng.choice([rng.randrange(50), rng.randrange(1000), 500])
            rows.append((group, rng.randrange(6), t, seen, rng.randrange(-5, 20)))
            seen += 1
    rows.append(("hot", 1, 10**9, seen, 4))
    return spark.createDataFrame(rows, "g string, k int, t bigint, id bigint, v bigint"), rows


@pytest.mark.parametrize("slices", [1, 3, 60, None])
def test_running_and_numbered(table, slices):
    frame, rows = table
    pieces = o.cut(frame, ["g"], ["t", "id"], slices)
    got = o.finish(o.running(pieces, ["g"], ["t", "id"], {"total": F.col("v"), "n": F.lit(1)}))
    expected, totals, counts = {}, {}, {}
    for g, _, _, i, v in sorted(rows, key=lambda r: (r[2], r[3])):
        totals[g] = totals.get(g, 0) + v
        counts[g] = counts.get(g, 0) + 1
        expected[i] = (totals[g], counts[g])
    assert {r["id"]: (r["total"], r["n"]) for r in got.collect()} == expected
    numbers = o.numbered(frame, ["g"], ["t", "id"], "n", slices)
    assert {r["id"]: r["n"] for r in numbers.collect()} == {i: n for i, (_, n) in expected.items()}


@pytest.mark.parametrize("slices", [1, 3, 60, None])
def test_previous(table, slices):
    frame, rows = table
    pieces = o.cut(frame, ["g"], ["t", "id"], slices)
    got = o.finish(o.previous(pieces, ["g", "k"], ["t", "id"], {"before": F.col("v")}, "known"))
    expected, last = {}, {}
    for g, k, _, i, v in sorted(rows, key=lambda r: (r[2], r[3])):
        expected[i] = (last.get((g, k)), (g, k) in last)
        last[g, k] = v
    assert {r["id"]: (r["before"], r["known"]) for r in got.collect()} == expected


def test_hot_group_is_spread(table):
    frame, _ = table
    sizes = o.cut(frame, ["g"], ["t", "id"], 20).groupBy("g", o.SLICE).count()
    slices = {r["g"]: r["n"] for r in sizes.groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert slices["cold"] <= 2 and slices["hot"] > 5


def test_busy_instant_is_spread(spark):
    """Nine tenths of a group at one time: slices are cut inside the instant, by the id."""
    frame = spark.range(20_000).selectExpr("'g' as g", "if(id % 10 = 0, id, 5) as t", "id")
    sizes = o.cut(frame, ["g"], ["t", "id"], 20).groupBy(o.SLICE).count()
    assert sizes.count() == 20 and sizes.agg(F.max("count")).first()[0] < 2 * 1_000
    numbers = o.numbered(frame, ["g"], ["t", "id"], "n", 20)
    assert numbers.filter("n <> 1").count() == 19_999 and numbers.agg(F.countDistinct("n"), F.max("n")).first() == (20_000, 20_000)


def test_ids_beyond_32_bits(spark):
    big = 2**31 + 5
    frame = spark.createDataFrame([("g", 1, big), ("g", 1, big + 1)], "g string, t bigint, id bigint")
    assert {r["id"]: r["n"] for r in o.numbered(frame, ["g"], ["t", "id"], "n").collect()} == {big: 1, big + 1: 2}


def test_groups_without_key_stay_whole(spark):
    frame = spark.createDataFrame([(None, i) for i in range(20)] + [("a", 1)], "g string, t bigint")
    got = o.numbered(frame, ["g"], ["t"], "n", 3)
    assert sorted(r["n"] for r in got.filter("g is null").collect()) == list(range(1, 21))


@pytest.mark.parametrize("slices", [40, None])
def test_running_of_latest(spark, slices):
    rng = random.Random(3)
    points = [("t", "m" if rng.random() < 0.9 else "n", rng.randrange(-1, 6), i, rng.randrange(100)) for i in range(300)]
    frame = spark.createDataFrame(points, "topology string, name string, task_id int, id bigint, value bigint")
    frame = frame.withColumn("ts", F.timestamp_seconds("id"))
    latest, expected = {}, {}
    for _, name, task, i, value in points:
        latest.setdefault(name, {})[task] = value
        total = sum(latest[name].values())
        expected[i] = (total, int(total / len(latest[name])))
    sums = {r["id"]: r["aggregated"] for r in m.running_sum_of_latest(frame, slices).collect()}
    means = {r["id"]: r["aggregated"] for r in m.running_avg_of_latest(frame, slices).collect()}
    assert {i: (sums[i], means[i]) for i in sums} == expected


def test_counter_rate_edges(spark):
    readings = [("a", 0, 0), ("a", 5, 100), ("a", 10, 93), ("a", 15, 193), ("b", 0, 7)]
    frame = spark.createDataFrame(readings, "host string, s bigint, bytes bigint").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r["host"], r["s"]): r["rate"] for r in m.counter_rate(frame, 5, 2).collect()}
    # First reading, a reading after zero, a counter that fell (truncated toward zero), a normal one.
    assert got == {("a", 0): 0, ("a", 5): 0, ("a", 10): -1, ("a", 15): 20, ("b", 0): 0}
