"""Streams against their batch forms, with files in no order, one per batch and all at once."""

import os
import random
from inspect import signature
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowplace.operators import metrics as m
from flowplace.operators import placement as pl
from flowplace.operators import projections as p
from flowplace.operators import routing, tracking
from flowplace.streaming import debounce, live
from flowplace.streaming.io import collect_rows, run_available, stream_table
from flowplace.streaming.keyed import CELL_SECS, PROVIDER_CONF, Neighbours, follow, keyed_session

POINT = "topology string, name string, task_id bigint, id bigint, value bigint"


def in_files(spark, frame, path, pieces, per_trigger=1):
    """The rows as a stream of files whose rows and order have nothing to do with time."""
    frame.withColumn("_piece", F.pmod(F.xxhash64(*frame.columns), F.lit(pieces))).repartition(pieces, "_piece").drop("_piece").write.parquet(str(path))
    reader = keyed_session(spark).readStream.schema(frame.schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(str(path))


@pytest.fixture(params=[1, None], ids=["file-by-file", "at-once"])
def stream(request, spark, tmp_path):
    """A function that makes a stream of a frame."""
    numbers = iter(range(100))
    return lambda frame, pieces=5: in_files(spark, frame, tmp_path / str(next(numbers)), pieces, request.param)


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(11)
    names = ["throughput", "complete_latency", "emitted_messages", "worker_cpu_load"]
    rows = [("t", rng.choice(names), rng.randrange(-1, 5), i, rng.randrange(50)) for i in range(400)]
    return spark.createDataFrame(rows, POINT).withColumn("ts", F.timestamp_seconds(F.expr("id * 3 div 2"))).cache()


# A cell of 37 seconds cuts every test's keys into several; the default keeps them whole.
CELLS = pytest.mark.parametrize("cell_secs", [37, CELL_SECS])


@CELLS
def test_running_totals(points, stream, rows, cell_secs):
    batch = m.metric_series(p.reported_metrics(points))
    columns = ("name", "task_id", "id", "aggregated")
    assert rows(live.metric_series(p.reported_metrics(stream(points)), 5, cell_secs), *columns) == rows(batch, *columns)


@CELLS
def test_changes(spark, stream, rows, cell_secs):
    rng = random.Random(2)
    versions = spark.createDataFrame(
        [(rng.choice(["x", "y", None]), i, rng.choice("ab")) for i in range(120)], "topology string, id bigint, text string"
    ).withColumn("ts", F.timestamp_seconds("id"))
    columns = (F.coalesce("topology", F.lit("-")), "id", "text")
    assert rows(live.schedule_changes(stream(versions), cell_secs), *columns) == rows(pl.schedule_changes(versions, m.UPDATE_ORDER), *columns)
    updates = spark.createDataFrame(
        [("x", rng.randrange(3), rng.randrange(3), i, rng.choice([0, 1, 2, None])) for i in range(150)],
        "topology string, source bigint, target bigint, id bigint, value bigint",
    ).withColumn("ts", F.timestamp_seconds(F.expr("id div 4")))
    columns = ("source", "target", "id", F.coalesce("value", F.lit(-1)), F.coalesce("old_value", F.lit(-1)))
    assert rows(live.edge_changes(stream(updates), cell_secs), *columns) == rows(m.edge_changes(updates), *columns)
    assert rows(live.latest_graph(stream(updates.filter("value is not null")))) == rows(m.latest_edges(updates.filter("value is not null")))


def one_file_each(spark, frames, path):
    """A stream that takes the frames in order, one per batch."""
    for i, frame in enumerate(frames):
        frame.coalesce(1).write.parquet(str(path / f"{i:03d}"))
        at = 1_700_000_000 + i
        for file in (path / f"{i:03d}").glob("*.parquet"):
            os.utime(file, (at, at))
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(path / "*"))


def ticks(spark, ids):
    made = spark.createDataFrame([("x", i, i) for i in ids], "topology string, id bigint, value bigint")
    return made.withColumn("ts", F.timestamp_seconds("id"))


def test_a_batch_costs_what_it_brings(spark, tmp_path):
    """Rows in order are written once however long the history; a late row adds itself and the row it comes before."""
    frames = [ticks(spark, [i for i in range(40 * b, 40 * b + 40) if i != 77]) for b in range(6)] + [ticks(spark, [77])]
    own = keyed_session(spark)
    known = follow(one_file_each(own, frames, tmp_path), ["topology"], m.UPDATE_ORDER, {"before": "value"}, "cost", 100)
    assert [r[1] for r in sorted(known.versions().groupBy("batch").count().collect())] == [40, 39, 40, 40, 40, 40, 2]
    late = known.versions().filter("batch = 6").select("id", "before").collect()
    assert sorted(map(tuple, late)) == [(77, 76), (78, 77)]
    found = known.rows("known").select("id", "known", "before").collect()
    assert sorted(map(tuple, found)) == [(i, i > 0, i - 1 if i else None) for i in range(240)]


def test_state_goes_after_the_lateness(spark, tmp_path):
    """Behind the watermark a cell's state is dropped and its late rows too; rows in time count."""
    frames = [ticks(spark, range(1, 50)), ticks(spark, range(60, 100)), ticks(spark, range(900, 950)), ticks(spark, range(990, 995)), ticks(spark, [55, 951])]
    known = follow(one_file_each(keyed_session(spark), frames, tmp_path), ["topology"], m.UPDATE_ORDER, {"before": "value"}, "bounded", 50, "60 seconds")
    found = sorted(r["id"] for r in known.rows("known").collect())
    assert found == [*range(1, 50), *range(60, 100), *range(900, 950), 951, *range(990, 995)]


def test_rows_that_come_twice_and_without_a_time(spark, tmp_path):
    rows = ticks(spark, [3, 4]).unionByName(ticks(spark, [9]).withColumn("ts", F.lit(None).cast("timestamp")))
    known = follow(one_file_each(keyed_session(spark), [rows, rows], tmp_path), ["topology"], m.UPDATE_ORDER, {"before": "value"}, "twice")
    assert known.rows("known").filter("ts is null").select("id", "known").collect() == [(9, False)]
    assert sorted(r["id"] for r in known.rows("known").collect()) == [3, 4, 9]
    nothing = follow(one_file_each(keyed_session(spark), [rows.filter("false")], tmp_path / "none"), ["topology"], m.UPDATE_ORDER, {"before": "value"}, "none")
    assert nothing.rows("known").isEmpty()


class Kept:
    """A value and a list as a state store keeps them."""

    def __init__(self):
        self.value, self.entries = None, []
        self.update = lambda v: setattr(self, "value", v)
        self.appendValue = self.entries.append
        self.put = lambda v: setattr(self, "entries", list(v))

    def get(self):
        return iter(self.entries) if self.entries else self.value


def test_a_busy_cell_is_kept_in_small_entries():
    """No entry of state holds more than a few thousand rows, equal texts are held once, and schedules lie in narrow cells."""
    shape = T.StructType.fromDDL("topology string, ts bigint, id bigint, text string")
    cell, kept = Neighbours(shape, ["ts", "id"], ["text"], ["before"], 3_600, False), [Kept(), Kept()]
    cell.init(SimpleNamespace(getValueState=lambda *_: kept[0], getListState=lambda *_: kept[1]))
    row = Row("topology", "ts", "id", "text")
    ids = [i for i in range(10_000) if i != 77]
    random.Random(4).shuffle(ids)
    made = list(cell.handleInputRows(("x", 0), iter([row("x", i // 7, i, f"version {i // 900}") for i in ids]), None))
    assert [r["id"] for r in made] == sorted(ids)
    assert [r["before"] for r in made] == [None, *[r["text"] for r in made[:-1]]]
    assert [len(cell.unpacked(e)) for e in kept[1].entries] == [4_096, 4_096, 1_807]
    assert len({id(r["text"]) for r in made}) == 12
    late = list(cell.handleInputRows(("x", 0), iter([row("x", 11, 77, "late"), row("x", 11, 78, "again")]), None))
    assert [(r["id"], r["text"], r["before"]) for r in late] == [(77, "late", "version 0"), (78, "version 0", "late")]
    assert [len(cell.unpacked(e)) for e in kept[1].entries] == [4_096, 4_096, 1_808]
    assert signature(live.schedule_changes).parameters["cell_secs"].default <= 3_600


def test_callers_session_is_left_alone(spark):
    before = spark.conf.get(PROVIDER_CONF, None)
    assert keyed_session(keyed_session(spark)).conf.get(PROVIDER_CONF) != before
    assert spark.conf.get(PROVIDER_CONF, None) == before


def test_windows_are_complete(spark, stream, rows):
    emits = spark.createDataFrame(
        [("x", i, 1 + i % 2, "__metrics" if i % 5 == 0 else "default", [1, 2]) for i in range(100)],
        "topology string, s bigint, source bigint, stream string, out_tasks array<bigint>",
    ).withColumn("ts", F.timestamp_seconds("s"))
    assert rows(live.throughput(stream(emits))) == rows(m.throughput(emits))
    assert rows(live.edge_counts(stream(emits))) == rows(m.edge_counts_per_interval(emits))
    acks = emits.selectExpr("topology", "source as task_id", "ts as ack_ts", "if(s % 3 = 0, null, s) as latency_ms")
    assert rows(live.complete_latency(stream(acks))) == rows(m.complete_latency(acks))
    readings = emits.selectExpr("topology", "source as task_id", "ts", "s as value")
    assert rows(live.sliding_load(stream(readings), 4, 5)) == rows(m.sliding_load(readings, 4, 5))


def test_sessions_do_not_depend_on_ticks(spark, stream, rows):
    rng = random.Random(6)
    at = sorted(rng.sample(range(0, 200_000), 80))
    updates = spark.createDataFrame([("x", t) for t in at], "topology string, ms bigint").withColumn(
        "ts", F.timestamp_millis("ms")
    )
    sessions, last = [], None
    for t in at:
        if last is None or t - last > 5_000:
            sessions.append([t, t, 0])
        sessions[-1][1], sessions[-1][2], last = t, sessions[-1][2] + 1, t
    for got in (debounce.publish_sessions(updates, slices=7), live.publish_sessions(stream(updates))):
        found = got.select(F.unix_millis("first_update"), F.unix_millis("published"), "updates")
        assert sorted(tuple(r) for r in found.collect()) == [(a, b + 5_000, n) for a, b, n in sessions]


def publish_by_hand(at, silence=5_000, interval=15_000):
    due = last = None
    out = []
    for now in at:
        if due is not None and due <= now:
            out.append(due)
            due, last = None, due
        if due is None or last is None or last + interval > now:
            due = now + silence
    return [*out, due]


def test_longest_wait(spark, stream):
    rng = random.Random(8)
    graphs = {
        # Busy for two minutes, then quiet, then busy again.
        "busy": sorted(rng.sample(range(0, 120_000), 200) + rng.sample(range(150_000, 200_000), 60)) + [1_000_000],
        "even": list(range(0, 90_000, 5_000)),
        "slow": sorted(rng.sample(range(0, 600_000), 90)),
        "once": [7],
    }
    updates = spark.createDataFrame([(g, t) for g, at in graphs.items() for t in at + at[:3]], "topology string, ms bigint")
    updates = updates.withColumn("ts", F.timestamp_millis("ms"))
    expected = {g: publish_by_hand(at) for g, at in graphs.items()}
    for got in (debounce.publish_times(debounce.ticks(updates), slices=6), live.publish_times(stream(updates, 3))):
        found = {g: [] for g in graphs}
        for r in got.collect():
            found[r["topology"]].append(r["published_ms"])
        assert {g: sorted(t) for g, t in found.items()} == expected
    # The first publication waits for silence; in the second burst none is put off for long.
    assert expected["busy"][0] > 120_000
    second = [t for t in expected["busy"] if 150_000 < t < 206_000]
    assert len(second) > 2 and max(b - a for a, b in zip(second, second[1:], strict=False)) <= 20_000


def test_tracking_with_replays(spark, stream, rows):
    roots = spark.createDataFrame(
        [("x", i % 40, i, 1) for i in range(60)], "topology string, msg_id bigint, s bigint, source bigint"
    ).withColumn("ts", F.timestamp_seconds(F.col("msg_id") + F.when(F.col("s") >= 40, 1003).otherwise(1000)))
    acks = spark.createDataFrame(
        [("x", i, 1, i + (200 if i % 4 == 0 else 10), None if i % 3 == 0 else 10) for i in range(0, 40)] + [("x", 999, 1, 600, 1)],
        "topology string, msg_id bigint, task_id bigint, s bigint, latency_ms bigint",
    ).withColumn("ack_ts", F.timestamp_seconds(F.col("s") + 1000))
    got = live.tracked(stream(roots.drop("s"), 3), stream(acks, 3))
    first = roots.filter("s < 40").drop("s")
    expected = tracking.emit_ack_match(first, acks)
    columns = ("msg_id", "ts", "completed", F.coalesce("latency_ms", F.lit(-1)))
    assert rows(got, *columns) == rows(expected, *columns)
    assert got.filter("not completed").count() == 10 and got.count() == 40


def test_stream_of_a_table_takes_that_table_only(spark, tmp_path, rows):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    spark.range(9).write.parquet(str(tmp_path / "t.parquet2"))
    assert collect_rows(stream_table(spark, str(tmp_path), "t"), "t").count() == 5


def test_sliding_default(spark, rows):
    points = spark.createDataFrame([("x", 1, s, s) for s in (0, 7, 61)], "topology string, task_id int, s bigint, value bigint")
    got = m.sliding_load(points.withColumn("ts", F.timestamp_seconds("s"))).select(F.unix_seconds("start").alias("s"), "readings", "load")
    expected = []
    for start in range(-55, 65, 5):
        inside = [v for v in (0, 7, 61) if start <= v < start + 60]
        if inside:
            expected.append((start, len(inside), sum(inside) // len(inside)))
    assert rows(got, "s", "readings", "load") == expected


def test_admission_cap(spark, rows):
    events = spark.createDataFrame([(s, i, i // 10) for s in (1, 2) for i in range(30)], "source int, id bigint, s bigint")
    kept = routing.admit_per_period(events.withColumn("ts", F.timestamp_seconds("s")), 4)
    assert rows(kept, "source", "id") == [(s, 10 * k + i) for s in (1, 2) for k in range(3) for i in range(3)]
    timed = events.withColumn("ts", F.timestamp_seconds("s"))
    assert routing.admit_per_period(timed, 5_000).count() == 60 and routing.admit_per_period(timed, 1).isEmpty()


def test_keys_stay_together(spark):
    frame = spark.range(300).select("id", F.when(F.col("id") < 200, "hot").otherwise(F.col("id").cast("string")).alias("key"))
    dealt = routing.co_locate(frame, 8, "key").withColumn("at", F.spark_partition_id())
    assert dealt.drop("at").exceptAll(frame).isEmpty() and dealt.count() == 300
    assert dealt.groupBy("key").agg(F.countDistinct("at").alias("n")).filter("n <> 1").isEmpty()
    shared = routing.co_locate_shares(frame, 8, "key", 4).withColumn("at", F.spark_partition_id())
    assert shared.groupBy("key", "share").agg(F.countDistinct("at").alias("n")).filter("n <> 1").isEmpty()
    assert shared.filter("key = 'hot'").select("at").distinct().count() > 1


def test_latency_without_latencies(spark, rows):
    acks = spark.createDataFrame([("x", 1, None), ("x", 1, 41), ("x", 2, None)], "topology string, task_id int, latency_ms bigint")
    acks = acks.withColumn("ack_ts", F.timestamp_seconds(F.lit(2)))
    assert rows(m.complete_latency(acks), "task_id", "complete_latency") == [(1, 4), (2, 0)]
    assert rows(m.complete_latency(acks, per_second=False), "task_id", "complete_latency") == [(1, 20), (2, 0)]


def test_failed_stream_raises(spark, points, tmp_path):
    stream = in_files(spark, points, tmp_path / "in", 1).withColumn("x", F.raise_error(F.lit("broken")))
    with pytest.raises(Exception, match="broken"):
        run_available(stream.writeStream.format("noop"), "broken")
