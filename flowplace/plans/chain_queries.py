"""The whole way in one job: reported messages, graph, partitions, schedule text, machines, slots, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowplace.operators import graph as g
from flowplace.operators import metrics as m
from flowplace.operators import partition as part
from flowplace.operators import placement as pl
from flowplace.operators import quality
from flowplace.operators.projections import without_self_loops
from flowplace.plans import lenses as L
from flowplace.plans.graph_queries import ALL_ROUNDS, ROUND_ROBIN_START, _graph_sql, _run_sql, _with
from flowplace.plans.lenses import with_lenses
from flowplace.plans.placement_queries import _PLACES
from flowplace.plans.registry import query
from flowplace.session import materialise
from flowplace.sinks import formats as out
from flowplace.sources import formats as src

K = 4

_CHAIN = [
    f"assignment as (select topology, id as task_id, kept::int as part from c_s{ALL_ROUNDS})",
    "sizes as (select topology, max(part) + 1 as partitions from assignment group by topology)",
    """placed as (select e.topology, e.task_id, coalesce(a.part, e.task_id % s.partitions)::int as part
               from (select distinct topology, task_id from datapoints where task_id >= 1) e
               join sizes s using (topology) left join assignment a using (topology, task_id))""",
    _PLACES,
    """shares as (select l.topology, sum(l.value)::bigint as total, sum(case when s.part <> t.part then l.value else 0 end)::bigint as remote
               from links l join assignment s on s.topology = l.topology and s.task_id = l.source
                            join assignment t on t.topology = l.topology and t.task_id = l.target group by 1)""",
]


@query(
    "chain_reports_to_slots",
    with_lenses(
        _with(
            _graph_sql("edges_latest") + _run_sql("c_", ROUND_ROBIN_START, K, ALL_ROUNDS) + _CHAIN,
            """select t.topology, t.part, t.task_id, p.supervisor,
                      ((row_number() over (partition by t.topology, t.part order by t.task_id) - 1) % p.assignable_slots)::int as slot,
                      (q.remote * 1000000 // greatest(q.total, 1))::bigint as remote_ppm
               from placed t join places p on p.topology = t.topology and p.part = t.part join shares q on q.topology = t.topology""",
        ),
        "edges_latest",
        "datapoints",
        "supervisors",
    ),
)
def chain(spark, d):
    """Slots of all reporting tasks, next to the share of messages that crosses partitions."""
    links = materialise(without_self_loops(m.latest_edges(L.edge_updates(spark, d))), "links")
    vertices = materialise(g.vertex_weights(links), "vertices")
    parts = part.partition_graph(vertices, part.lay_out(g.undirected(links)), K)
    text = materialise(out.partition_vector(parts), "vector")
    schedule = materialise(src.read_vector_blocks(text, out.IDS_PER_BLOCK), "schedule")
    tasks = L.datapoints(spark, d).select(
        "topology", F.col("task_id").alias("start_task"), F.col("task_id").alias("end_task"), "component"
    )
    placed = pl.apply_schedule(tasks.distinct(), schedule)
    slots = pl.spread_in_slots(placed, pl.place_partitions(schedule, L.supervisors(spark, d)))
    shares = quality.cut_summary(quality.edge_partitions(links, schedule)).select("topology", "remote_ppm")
    return slots.join(shares, "topology")
