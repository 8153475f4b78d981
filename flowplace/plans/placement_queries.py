"""Queries that place tasks on machines."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowplace.operators import graph as g
from flowplace.operators import placement as pl
from flowplace.plans import lenses as L
from flowplace.plans.lenses import with_lenses
from flowplace.plans.registry import query
from flowplace.session import materialise

_SIZES = "sizes as (select topology, max(part) + 1 as partitions, count(*) as tasks from assignment group by topology)"

_PLACED = f"""{_SIZES},
placed as (
    select e.topology, e.start_task as task_id, e.component,
           coalesce(a.part, e.start_task % s.partitions)::int as part
    from executors e join sizes s on s.topology = e.topology
    left join assignment a on a.topology = e.topology and a.task_id = e.start_task
    where e.start_task = e.end_task and e.start_task >= 1)"""

_LINE = """line as (
    select id, host, assignable_slots, (used_ports > 0)::int as busy,
           row_number() over (order by used_ports > 0, id) - 1 as place, count(*) over () as usable
    from supervisors where not blacklisted and assignable_slots > 0)"""

_PLACES = f"""{_LINE},
places as (
    select p.topology, p.part::int as part, l.id as supervisor, l.host, l.assignable_slots
    from (select topology, partitions, unnest(range(0, partitions::bigint)) as part from sizes) p
    join line l on l.place = p.part where p.partitions <= l.usable)"""


def _assignment(spark, d):
    """The schedule as a table: placement joins it and counts it."""
    return materialise(L.assignment(L.edges_dense(spark, d)), "schedule")


@query("agg10_schedule_size", with_lenses(f"with {_SIZES} select * from sizes", "assignment"))
def agg10(spark, d):
    return pl.schedule_size(_assignment(spark, d))


@query("joi01_apply_schedule", with_lenses(f"with {_PLACED} select * from placed", "executors", "assignment"))
def joi01(spark, d):
    return pl.apply_schedule(L.executors(spark, d), _assignment(spark, d))


@query("srt01_order_supervisors", with_lenses(f"with {_LINE} select * from line", "supervisors"))
def srt01(spark, d):
    return pl.order_supervisors(L.supervisors(spark, d))


@query(
    "joi02_place_partitions",
    with_lenses(f"with {_SIZES}, {_PLACES} select * from places", "assignment", "supervisors"),
)
def joi02(spark, d):
    return pl.place_partitions(_assignment(spark, d), L.supervisors(spark, d))


@query(
    "joi03_spread_in_slots",
    with_lenses(
        f"""with {_PLACED}, {_PLACES}
            select t.topology, t.part, t.task_id, p.supervisor,
                   ((row_number() over (partition by t.topology, t.part order by t.task_id) - 1) % p.assignable_slots)::int as slot
            from placed t join places p on p.topology = t.topology and p.part = t.part""",
        "executors",
        "assignment",
        "supervisors",
    ),
)
def joi03(spark, d):
    assignment = _assignment(spark, d)
    tasks = pl.apply_schedule(L.executors(spark, d), assignment)
    return pl.spread_in_slots(tasks, pl.place_partitions(assignment, L.supervisors(spark, d)))


@query(
    "joi04_fallback_even",
    with_lenses(
        """with slots as (
               select supervisor, slot, row_number() over (order by supervisor, slot) - 1 as slot_no
               from (select id as supervisor, unnest(range(0, assignable_slots))::int as slot
                     from supervisors where not blacklisted and assignable_slots > 0)),
           open as (
               select topology, start_task as task_id, row_number() over (partition by topology order by start_task) - 1 as n
               from executors e where start_task = end_task
                    and not exists (select 1 from partial_assignment a where a.topology = e.topology))
           select o.topology, o.task_id, s.supervisor, s.slot
           from open o join slots s on s.slot_no = o.n % (select count(*) from slots)""",
        "executors",
        "partial_assignment",
        "supervisors",
    ),
)
def joi04(spark, d):
    schedule = materialise(L.partial_assignment(L.edges_dense(spark, d)), "schedule")
    return pl.fallback_even(L.executors(spark, d), schedule, L.supervisors(spark, d))


@query(
    "win04_schedule_changes",
    with_lenses(
        """select topology, epoch_us(ts) // 1000000 as version, text
           from (select *, lag(text) over (partition by topology order by ts) as before from schedule_versions)
           where before is null or before <> text""",
        "schedule_versions",
    ),
)
def win04(spark, d):
    changes = pl.schedule_changes(L.schedule_versions(spark, d))
    return changes.select("topology", F.unix_seconds("ts").alias("version"), "text")


@query(
    "agg11_partition_members",
    with_lenses(
        """select topology, (id % 8)::varchar as part, ((id - 1) // 4096)::bigint as block,
                  string_agg(id::varchar, ',' order by id) as members
           from (select distinct topology, unnest([source, target]) as id from edges_planted) group by 1, 2, 3""",
        "edges_planted",
    ),
)
def agg11(spark, d):
    nodes = g.graph_nodes(L.edges_planted(spark, d))
    return pl.partition_members(
        nodes.select("topology", F.col("id").alias("task_id"), (F.col("id") % 8).alias("part"))
    )


@query(
    "joi03_task_traffic_by_host",
    with_lenses(
        f"""with {_PLACED}, {_PLACES}
            select f.supervisor as from_supervisor, t.supervisor as to_supervisor, sum(e.value)::bigint as value
            from edges_dense e
            join placed a on a.topology = e.topology and a.task_id = e.source
            join places f on f.topology = a.topology and f.part = a.part
            join placed b on b.topology = e.topology and b.task_id = e.target
            join places t on t.topology = b.topology and t.part = b.part
            group by 1, 2""",
        "edges_dense",
        "executors",
        "assignment",
        "supervisors",
    ),
)
def host_traffic(spark, d):
    """Schedule, placement and edge weights in one job: traffic between machines."""
    edges = L.stored_edges_dense(spark, d)
    assignment = materialise(L.assignment(edges), "schedule")
    tasks = pl.apply_schedule(L.executors(spark, d), assignment)
    places = pl.place_partitions(assignment, L.supervisors(spark, d)).select("topology", "part", "supervisor")
    at = tasks.join(places, ["topology", "part"]).select("topology", "task_id", "supervisor")
    source = at.withColumnsRenamed({"task_id": "source", "supervisor": "from_supervisor"})
    target = at.withColumnsRenamed({"task_id": "target", "supervisor": "to_supervisor"})
    return (
        edges.join(source, ["topology", "source"])
        .join(target, ["topology", "target"])
        .groupBy("from_supervisor", "to_supervisor")
        .agg(F.sum("value").alias("value"))
    )
