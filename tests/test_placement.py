import pytest

from flowplace.operators import placement as pl

PARTS = "topology string, task_id int, part int"
TASKS = "topology string, start_task int, end_task int, component string"
MACHINES = "id bigint, host string, blacklisted boolean, assignable_slots int, used_ports int"


@pytest.fixture(scope="module")
def machines(spark):
    rows = [
        (1, "h1", False, 2, 1), (2, "h2", False, 1, 0), (3, "h3", True, 4, 0), (4, "h4", False, 0, 0), (5, "h5", False, 3, 0),
    ]
    return spark.createDataFrame(rows, MACHINES)


def test_line_puts_free_machines_first(machines, rows):
    assert rows(pl.order_supervisors(machines, 4), "place", "id", "usable") == [(0, 2, 3), (1, 5, 3), (2, 1, 3)]


def test_no_machine_at_all(spark, machines):
    assert pl.order_supervisors(machines.filter("id = 3")).isEmpty()


def test_all_or_nothing(spark, machines, rows):
    schedule = [("fits", i, i % 3) for i in range(1, 7)] + [("wide", i, i % 4) for i in range(1, 9)] + [("one", 1, 0)]
    places = pl.place_partitions(spark.createDataFrame(schedule, PARTS), machines, 4)
    assert rows(places, "topology", "part", "supervisor") == [("fits", 0, 2), ("fits", 1, 5), ("fits", 2, 1), ("one", 0, 2)]


def test_apply_schedule(spark, rows):
    schedule = spark.createDataFrame([("x", 1, 2), ("x", 2, 0), ("x", 3, 1)], PARTS)
    tasks = [("x", i, i, "c") for i in (-1, 0, 1, 3, 7)] + [("x", 8, 9, "c"), ("none", 1, 1, "c")]
    frame = spark.createDataFrame(tasks, TASKS)
    assert rows(pl.apply_schedule(frame, schedule), "task_id", "part") == [(1, 2), (3, 1), (7, 1)]
    gapped = spark.createDataFrame([("x", 1, 2), ("x", 2, 0), ("x", 9, 1), ("x", 10, 0)], PARTS)
    tasks = spark.createDataFrame([("x", i, i, "c") for i in (1, 3, 9, 10, 11)], TASKS)
    # A known task keeps its line wherever it stands; unknown ones, in a gap or beyond the end, go round robin.
    assert rows(pl.apply_schedule(tasks, gapped), "task_id", "part") == [(1, 2), (3, 0), (9, 1), (10, 0), (11, 2)]
    kept = pl.apply_schedule(frame, schedule, keep_special=True)
    assert kept.filter("part is null").count() == 2


@pytest.mark.parametrize("slices", [5, None])
def test_spread_and_fallback(spark, machines, rows, slices):
    schedule = spark.createDataFrame([("x", i, 0) for i in range(1, 8)], PARTS)
    tasks = spark.createDataFrame([(t, i, i, "c") for t in ("x", "y") for i in range(1, 8)], TASKS)
    placed = pl.apply_schedule(tasks, schedule)
    places = pl.place_partitions(schedule, machines.filter("id = 5"))
    spread = pl.spread_in_slots(placed, places, slices)
    assert rows(spread, "task_id", "slot") == [(i, (i - 1) % 3) for i in range(1, 8)]
    slots = [(1, 0), (1, 1), (2, 0), (5, 0), (5, 1), (5, 2)]
    even = pl.fallback_even(tasks, schedule, machines, slices)
    assert rows(even, "topology", "task_id", "supervisor", "slot") == [("y", i + 1, *slots[i % 6]) for i in range(7)]


def test_members_and_changes(spark, rows):
    schedule = spark.createDataFrame([("x", i, i % 2 * 10) for i in range(1, 6)], PARTS)
    assert rows(pl.partition_members(schedule), "part", "members") == [("0", "2,4"), ("10", "1,3,5")]
    assert rows(pl.partition_members(schedule, 2), "part", "block", "members")[0] == ("0", 0, "2")
    versions = spark.createDataFrame([("x", i, t) for i, t in enumerate("aabba")], "topology string, n bigint, text string")
    changed = pl.schedule_changes(versions, ["n"], 2)
    assert rows(changed, "n", "text") == [(0, "a"), (2, "b"), (4, "a")]
