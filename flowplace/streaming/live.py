"""Windowed, session and keyed forms of the operators on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowplace.operators import metrics, tracking
from flowplace.streaming import debounce
from flowplace.streaming.io import collect_changes, collect_rows
from flowplace.streaming.keyed import CELL_SECS, follow

SCHEDULE_CELL_SECS = 3_600  # topologies are few and report often, and a cell's rows are held by one task
TASK_CELL_SECS = 4 * CELL_SECS  # tasks are many and report seldom: fewer cells, fewer groups of state


def edge_counts(emits: DataFrame, secs: int = metrics.GRAPH_SECS) -> DataFrame:
    return collect_changes(metrics.edge_counts_per_interval(emits, secs), ["topology", "start", "source", "target"], "edges")


def throughput(emits: DataFrame, secs: int = metrics.MONITORING_SECS) -> DataFrame:
    return collect_changes(metrics.throughput(emits, secs), ["topology", "task_id", "start"], "throughput")


def complete_latency(acks: DataFrame, secs: int = metrics.MONITORING_SECS) -> DataFrame:
    return collect_changes(metrics.complete_latency(acks, secs), ["topology", "task_id", "start"], "latency")


def sliding_load(points: DataFrame, slots: int = metrics.LOAD_SLOTS, slot_secs: int = metrics.LOAD_SLOT_SECS) -> DataFrame:
    """The stream keeps the slots' sums; windows are put together when they are read."""
    sums = collect_changes(metrics.slot_sums(points, slot_secs), ["topology", "task_id", "at"], "slots")
    return metrics.slide(sums, slots, slot_secs)


def publish_sessions(updates: DataFrame, silence_secs: int = debounce.SILENCE_SECS) -> DataFrame:
    """The stream keeps one span per graph and tick of the silence; sessions are put together when they are read."""
    spans = collect_changes(debounce.spans(updates, silence_secs), ["topology", "tick"], "spans")
    return debounce.sessions(spans, silence_secs)


def publish_times(
    updates: DataFrame, silence_secs: int = debounce.SILENCE_SECS, interval_secs: int = metrics.GRAPH_SECS
) -> DataFrame:
    """The stream keeps the distinct milliseconds of each graph's updates; times follow when they are read."""
    ticks = collect_changes(debounce.ticks(updates), ["topology", "ms"], "ticks")
    return debounce.publish_times(ticks, silence_secs, interval_secs)


def tracked(roots: DataFrame, acks: DataFrame, timeout_secs: int = tracking.TIMEOUT_SECS) -> DataFrame:
    """At-least-once tracking: replays of a message count once, from its first emit."""
    rest = [c for c in roots.columns if c not in ("msg_id", "ts")]
    first = roots.groupBy("msg_id").agg(F.min(F.struct("ts", *rest)).alias("first")).select("msg_id", "first.*")
    once = collect_changes(first, ["msg_id"], "roots")
    return tracking.emit_ack_match(once, collect_rows(acks, "acks"), timeout_secs)


def latest_graph(updates: DataFrame, label: str = "graph") -> DataFrame:
    """The live graph: the newest value of every edge, kept in Spark's state; a batch writes the edges it changed."""
    edge = ["topology", "source", "target"]
    return collect_changes(metrics.latest_edges(updates), edge, label).select(*edge, "value")


def metric_series(points: DataFrame, slices: int | None = None, cell_secs: int = TASK_CELL_SECS) -> DataFrame:
    """Running totals: the stream keeps each task's value before, the changes are added up when they are read."""
    known = follow(points, metrics.TASK_METRIC, metrics.UPDATE_ORDER, {"_before": "value"}, "series", cell_secs)
    return metrics.series_of_changes(known.rows("_known"), "_before", "_known", slices)


def schedule_changes(versions: DataFrame, cell_secs: int = SCHEDULE_CELL_SECS) -> DataFrame:
    """Schedule versions that differ from the one before, in the order of (ts, id)."""
    known = follow(versions, ["topology"], metrics.UPDATE_ORDER, {"_before": "text"}, "schedules", cell_secs)
    return known.rows("_known").filter("not _known or not text <=> _before").drop("_before", "_known")


def edge_changes(updates: DataFrame, cell_secs: int = CELL_SECS) -> DataFrame:
    """Updates that gave an edge a new value."""
    edge = ["topology", "source", "target"]
    known = follow(updates, edge, metrics.UPDATE_ORDER, {"old_value": "value"}, "edge-changes", cell_secs)
    return known.rows("_known").filter("not _known or not value <=> old_value").drop("_known")
