"""Join schedules with tasks and machines into placements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowplace.operators.metrics import div
from flowplace.operators.ordered import cut, finish, numbered, previous, running
from flowplace.operators.projections import single_task
from flowplace.session import materialise

MEMBERS_BLOCK = 4_096


def schedule_size(assignment: DataFrame) -> DataFrame:
    """Per topology: partitions (highest + 1) and scheduled tasks."""
    return assignment.groupBy("topology").agg(
        (F.max("part") + 1).alias("partitions"), F.count(F.lit(1)).alias("tasks")
    )


def apply_schedule(executors: DataFrame, assignment: DataFrame, keep_special: bool = False) -> DataFrame:
    """Partition of each single-task executor of the topologies that have a schedule.

    Special tasks (id below 1) are left out, or kept with a NULL partition; tasks that the schedule
    has no line for, beyond its end or in a gap, go round robin by id.
    """
    tasks = single_task(executors).select("topology", F.col("start_task").alias("task_id"), "component")
    placed = (
        tasks.join(schedule_size(assignment), "topology")
        .join(assignment.select("topology", "task_id", F.col("part").alias("_part")), ["topology", "task_id"], "left")
    )
    part = F.coalesce("_part", F.col("task_id") % F.col("partitions"))
    placed = placed.select(
        "topology", "task_id", "component", F.when(F.col("task_id") >= 1, part).cast("int").alias("part")
    )
    return placed if keep_special else placed.filter(F.col("task_id") >= 1)


def order_supervisors(supervisors: DataFrame, slices: int | None = None) -> DataFrame:
    """Usable supervisors with their 0-based place in line, unoccupied ones first.

    ``usable`` repeats how many there are. Each half is numbered by itself; the busy half
    then starts after the free one, by a join with the two halves' sizes.
    """
    usable = supervisors.filter(~F.col("blacklisted") & (F.col("assignable_slots") > 0)).withColumn(
        "busy", (F.col("used_ports") > 0).cast("int")
    )
    halves = F.create_map(F.lit(0), F.lit(0).cast("bigint"), F.lit(1), F.sum(1 - F.col("busy")))
    sizes = usable.agg(halves.alias("starts"), F.count(F.lit(1)).alias("usable")).select(
        F.explode("starts").alias("busy", "start"), "usable"
    )
    line = numbered(usable, ["busy"], ["id"], "_n", slices)
    return line.join(F.broadcast(sizes), "busy").select(
        "id", "host", "assignable_slots", "busy", (F.col("start") + F.col("_n") - 1).alias("place"), "usable"
    )


def place_partitions(assignment: DataFrame, supervisors: DataFrame, slices: int | None = None) -> DataFrame:
    """Partition i of a topology goes to the i-th supervisor in line.

    A topology with more partitions than there are usable supervisors gets no rows at all.
    """
    line = materialise(
        order_supervisors(supervisors, slices).select(
            F.col("place").cast("int").alias("part"), F.col("id").alias("supervisor"), "host", "assignable_slots", "usable"
        ),
        "line",
    )
    machines = line.agg(F.coalesce(F.max("usable"), F.lit(0))).scalar()
    parts = (
        schedule_size(assignment)
        .filter(F.col("partitions") <= machines)
        .select("topology", F.explode(F.sequence(F.lit(0), F.col("partitions") - 1)).alias("part"))
    )
    return parts.join(line, "part").select("topology", "part", "supervisor", "host", "assignable_slots")


def spread_in_slots(tasks: DataFrame, places: DataFrame, slices: int | None = None) -> DataFrame:
    """The i-th task of a partition goes to slot ``i mod slots`` of its supervisor."""
    ranked = numbered(tasks, ["topology", "part"], ["task_id"], "_n", slices)
    return ranked.join(places, ["topology", "part"]).select(
        "topology",
        "part",
        "task_id",
        "supervisor",
        ((F.col("_n") - 1) % F.col("assignable_slots")).cast("int").alias("slot"),
    )


def slot_line(supervisors: DataFrame, slices: int | None = None) -> DataFrame:
    """All assignable slots of usable supervisors, numbered by (supervisor, slot)."""
    usable = supervisors.filter(~F.col("blacklisted") & (F.col("assignable_slots") > 0)).select(
        (~F.col("blacklisted")).alias("cluster"), "id", F.col("assignable_slots").cast("bigint").alias("slots")
    )
    pieces = cut(usable, ["cluster"], ["id"], slices)
    ends = finish(running(pieces, ["cluster"], ["id"], {"_end": F.col("slots")}))
    return ends.select(
        F.col("id").alias("supervisor"),
        F.posexplode(F.sequence(F.col("_end") - F.col("slots"), F.col("_end") - 1)).alias("slot", "slot_no"),
    )


def fallback_even(
    executors: DataFrame, assignment: DataFrame, supervisors: DataFrame, slices: int | None = None
) -> DataFrame:
    """Topologies without a schedule: their tasks, by id, go around all slots evenly."""
    scheduled = assignment.select("topology").distinct()
    tasks = single_task(executors).join(scheduled, "topology", "left_anti").select(
        "topology", F.col("start_task").alias("task_id")
    )
    line = materialise(slot_line(supervisors, slices), "slots")
    total = line.agg(F.count(F.lit(1))).scalar()
    ranked = numbered(tasks, ["topology"], ["task_id"], "_n", slices)
    return (
        ranked.withColumn("slot_no", (F.col("_n") - 1) % F.when(total > 0, total))
        .join(line, "slot_no")
        .select("topology", "task_id", "supervisor", "slot")
    )


def schedule_changes(
    versions: DataFrame, order: Sequence[str] = ("ts",), slices: int | None = None
) -> DataFrame:
    """Schedule versions that differ from the one applied before."""
    pieces = cut(versions, ["topology"], order, slices)
    pieces = previous(pieces, ["topology"], order, {"_before": F.col("text")}, "_known")
    changed = pieces.filter(~F.col("_known") | ~F.col("text").eqNullSafe(F.col("_before")))
    return finish(changed).drop("_before", "_known")


def partition_members(assignment: DataFrame, block: int = MEMBERS_BLOCK) -> DataFrame:
    """Comma-joined task ids per partition, in ascending order; parts as text.

    ``block`` numbers ranges of ids: a list never holds more than that many, and a small
    topology's partition is one list with block 0.
    """
    number = div(F.col("task_id") - 1, block).alias("block")
    ids = F.array_sort(F.collect_list("task_id"))
    return (
        assignment.groupBy("topology", F.col("part").cast("string").alias("part"), number)
        .agg(F.array_join(ids, ",").alias("members"))
    )
