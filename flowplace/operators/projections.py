"""Row-wise steps: pass-through, derived fields, filters."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowplace.functions import metric_path

# Marks of control streams, and the metric names with how each is combined over tasks.
CONTROL_MARKS = ("__ack", "__metrics")
METRIC_AGGREGATES = {
    "complete_latency": "avg",
    "throughput": "sum",
    "worker_cpu_load": "sum",
    "worker_network_bytes": "sum",
}
UNLOGGED_METRICS = ("emitted_messages",)


def pass_key(df: DataFrame) -> DataFrame:
    return df.select("keyfield")


def pass_key_payload(df: DataFrame) -> DataFrame:
    return df.select("keyfield", "payload")


def append_and_project(df: DataFrame, name: str, value: Column, *keep: str) -> DataFrame:
    """Append one derived field, then keep only it and the named fields."""
    return df.select(value.alias(name), *keep)


def is_control(stream: str = "stream") -> Column:
    first, *rest = (F.col(stream).contains(mark) for mark in CONTROL_MARKS)
    for other in rest:
        first = first | other
    return first


def data_streams(df: DataFrame, stream: str = "stream") -> DataFrame:
    """Drop rows of control streams."""
    return df.filter(~is_control(stream))


def reported_metrics(points: DataFrame, aggregates: Mapping[str, str] = METRIC_AGGREGATES) -> DataFrame:
    """Keep the metrics on the list and name the aggregate each is combined with."""
    pairs = [F.lit(x) for pair in aggregates.items() for x in pair]
    return points.filter(F.col("name").isin(*aggregates)).withColumn(
        "aggregate", F.element_at(F.create_map(*pairs), F.col("name"))
    )


def logged_metrics(points: DataFrame, unlogged: tuple[str, ...] = UNLOGGED_METRICS) -> DataFrame:
    return points.filter(~F.col("name").isin(*unlogged))


def regular_tasks(df: DataFrame, task: str = "task_id") -> DataFrame:
    """System tasks carry negative ids and are never measured."""
    return df.filter(F.col(task) >= 0)


def without_self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("source") != F.col("target"))


def reporting_updates(points: DataFrame) -> DataFrame:
    """Updates that cause a line of output: those of task 1 and all worker metrics."""
    return points.filter((F.col("task_id") == 1) | F.lower("name").contains("worker"))


def with_metric_path(points: DataFrame, base: Column | None = None) -> DataFrame:
    return points.withColumn("path", metric_path(base, F.col("topology"), F.col("name")))


def single_task(executors: DataFrame) -> DataFrame:
    return executors.filter(F.col("start_task") == F.col("end_task"))


def multi_task(executors: DataFrame) -> DataFrame:
    """Executors a schedule cannot place: they hold more than one task."""
    return executors.filter(F.col("start_task") != F.col("end_task"))


def require_single_task(executors: DataFrame) -> DataFrame:
    """Strict form: the job fails on the first executor with more than one task."""
    message = F.format_string("executor %d-%d holds more than one task", "start_task", "end_task")
    checked = F.when(F.col("start_task") == F.col("end_task"), F.col("end_task")).otherwise(
        F.raise_error(message).cast("int")
    )
    return executors.withColumn("end_task", checked)
