"""Queries for graph preparation, partitioning and partition quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowplace.operators import graph as g
from flowplace.operators import partition as part
from flowplace.operators import quality, volume
from flowplace.operators.projections import without_self_loops
from flowplace.plans import lenses as L
from flowplace.plans.lenses import with_lenses
from flowplace.plans.registry import query
from flowplace.session import materialise

K = 8


@query("set01_graph_nodes", with_lenses("select topology, id from nodes_dense", "nodes_dense"))
def set01(spark, d):
    return g.graph_nodes(L.edges_dense(spark, d))


@query(
    "set01_graph_nodes_bipartite",
    with_lenses("select distinct topology, unnest([source, target]) as id from edges_bipartite", "edges_bipartite"),
)
def set01_bipartite(spark, d):
    return g.graph_nodes(L.edges_bipartite(spark, d))


@query(
    "set02_isolated_nodes",
    with_lenses(
        """select distinct topology, start_task as id from executors e
           where start_task >= 1 and not exists (
               select 1 from edges_dense l where l.topology = e.topology and l.source <> l.target
                      and (l.source = e.start_task or l.target = e.start_task))""",
        "executors",
        "edges_dense",
    ),
)
def set02(spark, d):
    tasks = L.executors(spark, d).filter(F.col("start_task") >= 1)
    return g.isolated_nodes(tasks.select("topology", F.col("start_task").alias("id")), L.edges_dense(spark, d))


_WEIGHTS = """
with links as (select * from {edges} where source <> target),
header as (select topology, max(greatest(source, target)) as n from links group by topology),
spine as (select topology, unnest(range(1, n + 1)) as id from header),
ends as (select topology, source as id, value from links union all select topology, target, value from links)
select topology, id, (1 + coalesce(sum(value), 0))::bigint as vw
from spine left join ends using (topology, id) group by topology, id
"""


@query("agg05_vertex_weights", with_lenses(_WEIGHTS.format(edges="edges_dense"), "edges_dense"))
def agg05(spark, d):
    return g.vertex_weights(without_self_loops(L.stored_edges_dense(spark, d)))


@query("agg05_vertex_weights_planted", with_lenses(_WEIGHTS.format(edges="edges_planted"), "edges_planted"))
def agg05_planted(spark, d):
    return g.vertex_weights(materialise(L.edges_planted(spark, d), "links"))


@query(
    "agg06_graph_header",
    with_lenses(
        """select topology, max(greatest(source, target)) as n,
                  count(distinct case when source <> target
                        then least(source, target) || '-' || greatest(source, target) end) as m
           from (select * from edges_dense union all select * from edges_bipartite) group by topology""",
        "edges_dense",
        "edges_bipartite",
    ),
)
def agg06(spark, d):
    return g.graph_header(L.edges_dense(spark, d).unionByName(L.edges_bipartite(spark, d)))


_SYMMETRIC = """
select topology, id, nbr, w from (
    select coalesce(f.topology, b.topology) as topology, coalesce(f.source, b.target) as id,
           coalesce(f.target, b.source) as nbr,
           (case when f.value is null then 1
                 when b.value is null then f.value
                 when f.source < f.target then greatest(f.value, 1)
                 else 1 + f.value end)::bigint as w
    from (select * from edges_dense where source <> target) f
    full join (select * from edges_dense where source <> target) b
      on f.topology = b.topology and f.source = b.target and f.target = b.source)
"""


@query("gph01_symmetrise", with_lenses(_SYMMETRIC, "edges_dense"))
def gph01(spark, d):
    return g.symmetrise(L.edges_dense(spark, d))


@query(
    "gph01_undirected",
    with_lenses(
        f"""with adj as ({_SYMMETRIC})
            select x.topology, x.id, x.nbr, x.w + y.w as w
            from adj x join adj y on x.topology = y.topology and x.id = y.nbr and x.nbr = y.id""",
        "edges_dense",
    ),
)
def gph01_undirected(spark, d):
    return g.undirected(L.edges_dense(spark, d))


@query(
    "agg15_node_flow",
    with_lenses(
        """select topology, id, greatest(coalesce(o, 0), coalesce(i, 0))::bigint as flow
           from (select topology, source as id, sum(value) as o from edges_dense group by 1, 2)
           full join (select topology, target as id, sum(value) as i from edges_dense group by 1, 2)
           using (topology, id)""",
        "edges_dense",
    ),
)
def agg15(spark, d):
    return g.node_flow(L.edges_dense(spark, d))


@query(
    "joi05_links_to_index",
    with_lenses(
        """with places as (select topology, id, row_number() over (partition by topology order by id) - 1 as pos
                       from (select distinct topology, unnest([source, target]) as id from edges_planted))
           select l.topology, s.pos as source_index, t.pos as target_index, l.value
           from edges_planted l join places s on s.topology = l.topology and s.id = l.source
                                join places t on t.topology = l.topology and t.id = l.target""",
        "edges_planted",
    ),
)
def joi05(spark, d):
    links = materialise(L.edges_planted(spark, d), "links")
    return g.links_to_index(links, g.graph_nodes(links))


@query(
    "srt02_links_by_width",
    with_lenses(
        """select topology, source, target, value, greatest(value, 1) as width,
                  row_number() over (partition by topology order by value desc, source, target) as rank
           from edges_dense where source <> target""",
        "edges_dense",
    ),
)
def srt02(spark, d):
    return g.links_by_width(without_self_loops(L.edges_dense(spark, d)))


@query("gph03_one_partition", with_lenses("select topology, id as task_id, 0 as part from nodes_dense", "nodes_dense"))
def gph03(spark, d):
    return part.one_partition(g.graph_nodes(L.edges_dense(spark, d)))


@query(
    "gph04_round_robin_partition",
    with_lenses("select topology, id as task_id, (id % 4)::int as part from nodes_dense", "nodes_dense"),
)
def gph04(spark, d):
    return part.round_robin_partition(g.graph_nodes(L.edges_dense(spark, d)), 4)


_LABELLED = """
labelled as (
    select e.topology, e.source, e.target, e.value, s.part as source_part, t.part as target_part,
           s.part <> t.part as remote
    from edges_dense e join assignment s on s.topology = e.topology and s.task_id = e.source
                       join assignment t on t.topology = e.topology and t.task_id = e.target)
"""


def _labelled(spark, d):
    edges = L.stored_edges_dense(spark, d)
    return quality.edge_partitions(edges, L.assignment(edges))


@query(
    "joi06_edge_partitions",
    with_lenses(
        f"with {_LABELLED} select topology, source, target, value, source_part, target_part, remote from labelled",
        "edges_dense",
        "assignment",
    ),
)
def joi06(spark, d):
    return _labelled(spark, d)


@query(
    "agg12_cut_summary",
    with_lenses(
        f"""with {_LABELLED}
            select topology, sum(value)::bigint as total_weight,
                   sum(case when remote then value else 0 end)::bigint as remote_weight,
                   sum(case when remote then 0 else value end)::bigint as local_weight,
                   (sum(case when remote then value else 0 end)::bigint * 1000000 // sum(value)::bigint)::bigint as remote_ppm
            from labelled group by topology""",
        "edges_dense",
        "assignment",
    ),
)
def agg12(spark, d):
    return quality.cut_summary(_labelled(spark, d))


@query(
    "agg13_communication_volume",
    with_lenses(
        f"""with {_LABELLED}
            select topology, count(*) as volume
            from (select topology, source as id, target_part as other from labelled where remote
                  union select topology, target, source_part from labelled where remote) group by topology""",
        "edges_dense",
        "assignment",
    ),
)
def agg13(spark, d):
    return quality.communication_volume(_labelled(spark, d))


_VW = _WEIGHTS.strip().removeprefix("with ")
_VERTICES = "links as" + _VW.format(edges="edges_dense").removeprefix("links as").replace(
    "select topology, id, (1 +", ", vertices as (select topology, id, (1 +"
) + ")"


@query(
    "agg14_partition_load",
    with_lenses(
        f"""with {_VERTICES}
            select v.topology, a.part, sum(v.vw)::bigint as load, count(*) as tasks
            from vertices v join assignment a on a.topology = v.topology and a.task_id = v.id group by 1, 2""",
        "edges_dense",
        "assignment",
    ),
)
def agg14(spark, d):
    edges = L.stored_edges_dense(spark, d)
    return quality.partition_load(g.vertex_weights(without_self_loops(edges)), L.assignment(edges))


@query(
    "agg14_imbalance",
    with_lenses(
        f"""with {_VERTICES}
            select topology, max(load) as largest, sum(load)::bigint as total,
                   (max(load) * (max(part) + 1) * 1000000 // sum(load)::bigint)::bigint as imbalance_ppm
            from (select v.topology, a.part, sum(v.vw)::bigint as load
                  from vertices v join assignment a on a.topology = v.topology and a.task_id = v.id group by 1, 2)
            group by topology""",
        "edges_dense",
        "assignment",
    ),
)
def agg14_imbalance(spark, d):
    edges = L.stored_edges_dense(spark, d)
    vertices = g.vertex_weights(without_self_loops(edges))
    return quality.imbalance(quality.partition_load(vertices, L.assignment(edges)))


@query(
    "agg16_worker_traffic",
    with_lenses(
        f"""with {_LABELLED}
            select topology, source_part, target_part, sum(value)::bigint as value from labelled group by 1, 2, 3""",
        "edges_dense",
        "assignment",
    ),
)
def agg16(spark, d):
    return quality.worker_traffic(_labelled(spark, d))


# --- partitioning ---------------------------------------------------------------------------


def _planted(spark, d):
    """Vertices and undirected adjacency of the planted graph, written once."""
    links = materialise(L.edges_planted(spark, d), "links")
    return materialise(g.vertex_weights(links), "vertices"), g.undirected(links), links


HASH_START = "(('0x' || substr(md5(id::varchar), 1, 8))::bigint % {k})::int"
ROUND_ROBIN_START = "(id % {k})::int"


def _graph_sql(edges: str) -> list[str]:
    """Links, vertices and the undirected adjacency of a lens."""
    return [
        _WEIGHTS.format(edges=edges).strip().removeprefix("with ").replace(
            "select topology, id, (1 +", ", vertices as materialized (select topology, id, (1 +"
        )
        + ")",
        """pairs as (select topology, least(source, target) as a, greatest(source, target) as b,
                  max(case when source < target then value end) as ab, max(case when source > target then value end) as ba
           from links group by 1, 2, 3)""",
        """weighted as (select topology, a, b,
                  (case when ab is not null and ba is not null then greatest(ab, 1) + ba + 1
                        else coalesce(ab, 1) + coalesce(ba, 1) end)::bigint as w from pairs)""",
        """adj as materialized (select topology, a as id, b as nbr, w from weighted
           union all select topology, b, a, w from weighted)""",
    ]


def _run_sql(x: str, start: str, k: int, rounds: int, measure: str = "cut") -> list[str]:
    """Propagation spelled out round by round, ``x`` naming the run: id ranges and gain
    magnitudes as in the job, the best labels of each graph kept until the run is idle."""
    ranges = part.RANGES_PER_PART * k
    amount = {
        "cut": "select topology, sum(reach - own)::bigint // 2 as now from {x}wish{r} group by 1",
        "volume": """select s.topology, count(t.to_part) as now from {x}s{r} s
                     left join {x}scores{r} t on t.topology = s.topology and t.id = s.id and t.to_part <> s.part group by 1""",
    }[measure]
    parts = [
        f"""{x}sizes as (select topology, max(id) as max_id,
                  (sum(vw)::bigint * {100 + part.SLACK_PERCENT} + {100 * k - 1}) // {100 * k} as capacity
           from vertices group by topology)""",
        f"""{x}s0 as materialized (select topology, id, vw, {start.format(k=k)} as part, capacity,
                  id::bigint * {ranges} // (max_id + 1) as id_range, null::int as kept
           from vertices join {x}sizes using (topology))""",
        f"{x}best0 as materialized (select distinct topology, null::bigint as best, null::bigint as anchor from vertices)",
        f"{x}idle0 as materialized (select 0 as idle)",
    ]
    for r in range(rounds):
        parts += [
            f"""{x}scores{r} as materialized (select a.topology, a.id, s.part as to_part, sum(a.w)::bigint as score
                 from adj a join {x}s{r} s on s.topology = a.topology and s.id = a.nbr group by 1, 2, 3)""",
            f"""{x}top{r} as (select topology, id, max(score) as score, arg_min(to_part, (-score, to_part)) as to_part,
                        sum(score)::bigint as reach
                 from {x}scores{r} group by 1, 2)""",
            f"""{x}wish{r} as materialized (
                 select s.*, coalesce(t.to_part, s.part) as target, coalesce(own.score, 0) as own,
                        coalesce(t.reach, 0) as reach, coalesce(t.score, 0) - coalesce(own.score, 0) as gain
                 from {x}s{r} s left join {x}top{r} t on t.topology = s.topology and t.id = s.id
                 left join {x}scores{r} own on own.topology = s.topology and own.id = s.id and own.to_part = s.part)""",
            f"""{x}judged{r} as materialized (
                 select *, (select idle from {x}idle{r}) < {part.PATIENCE} and (old_best is null or now < old_best) as improved,
                        anchor is null or best * {part.TOLERANCE} < anchor * {part.TOLERANCE - 1} as progress
                 from (select b.topology, b.best as old_best, least(c.now, coalesce(b.best, c.now)) as best, b.anchor, c.now
                       from {x}best{r} b join ({amount.format(x=x, r=r)}) c using (topology)))""",
            f"""{x}best{r + 1} as materialized (
                 select topology, case when improved then best else old_best end as best,
                        case when progress then best else anchor end as anchor from {x}judged{r})""",
            f"""{x}idle{r + 1} as materialized (
                 select case when idle >= {part.PATIENCE} then idle
                             when (select bool_or(progress) from {x}judged{r}) then 0 else idle + 1 end as idle
                 from {x}idle{r})""",
            f"""{x}asked{r} as (select *, case when gain > 0 and (id + {r}) % 2 = 0
                 then (64 - length(bin(gain))) * {ranges} + id_range end as block from {x}wish{r})""",
            f"""{x}load{r} as (select topology, part as target, sum(vw)::bigint as load from {x}wish{r} group by 1, 2)""",
            f"""{x}cutoff{r} as (
                 select topology, target, max(block) as cutoff
                 from (select topology, target, block, capacity,
                              sum(sum(vw)) over (partition by topology, target order by block) as upto
                       from {x}asked{r} where block is not null group by topology, target, block, capacity)
                 left join {x}load{r} using (topology, target)
                 where upto + coalesce(load, 0) <= capacity group by topology, target)""",
            f"""{x}s{r + 1} as materialized (
                 select a.topology, a.id, a.vw, case when a.block <= c.cutoff then a.target else a.part end as part,
                        a.capacity, a.id_range, case when j.improved then a.part else a.kept end as kept
                 from {x}asked{r} a join {x}judged{r} j on j.topology = a.topology
                 left join {x}cutoff{r} c on c.topology = a.topology and c.target = a.target)""",
        ]
    return parts


def _with(parts: list[str], body: str) -> str:
    return "with " + ",\n".join(parts) + "\n" + body


# SQL can't stop early; a finished run changes nothing in further rounds.
ALL_ROUNDS = 32


@query(
    "gph02_propagate_3_rounds",
    with_lenses(
        _with(
            _graph_sql("edges_planted") + _run_sql("", ROUND_ROBIN_START, K, 3),
            "select topology, id as task_id, part::int as part from s3",
        ),
        "edges_planted",
    ),
)
def gph02_rounds(spark, d):
    """Three steps of the operator, not a settled partition; ``gph02_partition_graph`` is the whole job."""
    vertices, adjacency, _ = _planted(spark, d)
    return part.propagate(vertices, part.lay_out(adjacency), K, rounds=3)


@query(
    "gph02_partition_graph",
    with_lenses(
        _with(
            _graph_sql("edges_planted") + _run_sql("", ROUND_ROBIN_START, K, ALL_ROUNDS),
            f"select topology, id as task_id, kept::int as part from s{ALL_ROUNDS}",
        ),
        "edges_planted",
    ),
)
def gph02(spark, d):
    vertices, adjacency, _ = _planted(spark, d)
    return part.partition_graph(vertices, part.lay_out(adjacency), K)


def _volume_sql(k: int, rounds: int) -> list[str]:
    """Volume-seeking rounds from the cut run's labels, spelled out: neighbours counted per partition, gains from both ends."""
    ranges = part.RANGES_PER_PART * k
    parts = [f"v0 as materialized (select topology, id, vw, kept as part, capacity, id_range from s{ALL_ROUNDS})"]
    for r in range(rounds + 1):
        parts += [
            f"""counts{r} as materialized (select a.topology, a.id, v.part as p, count(*) as n
                 from adj a join v{r} v on v.topology = a.topology and v.id = a.nbr group by 1, 2, 3)""",
            f"""amount{r} as materialized (select v.topology, count(c.p) as amount from v{r} v
                 left join counts{r} c on c.topology = v.topology and c.id = v.id and c.p <> v.part group by 1)""",
        ]
        if r == rounds:
            break
        parts += [
            f"""here{r} as (select topology, id, p, max(lone) as lone
                 from (select c.topology, c.id, c.p, (c.n = 1 and c.p <> v.part)::int as lone
                       from counts{r} c join v{r} v on v.topology = c.topology and v.id = c.id
                       union all select topology, id, part, 0 from v{r}) group by 1, 2, 3)""",
            f"""heard{r} as materialized (select a.topology, a.id, h.p, count(*) as has, sum(h.lone) as lone
                 from adj a join here{r} h on h.topology = a.topology and h.id = a.nbr group by 1, 2, 3)""",
            f"""degree{r} as (select topology, id, sum(n) as degree from counts{r} group by 1, 2)""",
            f"""wins{r} as (select topology, id, max(gain) as gain, arg_min(p, (-gain, p)) as target
                 from (select v.topology, v.id, c.p,
                              coalesce(f.lone, 0) - d.degree + h.has + 1 - (own.p is not null)::int as gain
                       from v{r} v join counts{r} c on c.topology = v.topology and c.id = v.id and c.p <> v.part
                       join degree{r} d on d.topology = v.topology and d.id = v.id
                       join heard{r} h on h.topology = v.topology and h.id = v.id and h.p = c.p
                       left join heard{r} f on f.topology = v.topology and f.id = v.id and f.p = v.part
                       left join counts{r} own on own.topology = v.topology and own.id = v.id and own.p = v.part)
                 group by 1, 2)""",
            f"""vasked{r} as materialized (select v.*, w.target, case when w.gain > 0 and (v.id + {r}) % 2 = 0
                 then (64 - length(bin(w.gain::bigint))) * {ranges} + v.id_range end as block
                 from v{r} v left join wins{r} w using (topology, id))""",
            f"""vload{r} as (select topology, part as target, sum(vw)::bigint as load from v{r} group by 1, 2)""",
            f"""vcutoff{r} as (select topology, target, max(block) as cutoff
                 from (select topology, target, block, capacity,
                              sum(sum(vw)) over (partition by topology, target order by block) as upto
                       from vasked{r} where block is not null group by topology, target, block, capacity)
                 left join vload{r} using (topology, target)
                 where upto + coalesce(load, 0) <= capacity group by topology, target)""",
            f"""v{r + 1} as materialized (select a.topology, a.id, a.vw,
                        case when a.block <= c.cutoff then a.target else a.part end as part, a.capacity, a.id_range
                 from vasked{r} a left join vcutoff{r} c on c.topology = a.topology and c.target = a.target)""",
        ]
    rounds_ = " union all ".join(f"select topology, {r} as round, amount from amount{r}" for r in range(rounds + 1))
    labels = " union all ".join(f"select topology, {r} as round, id, part from v{r}" for r in range(rounds + 1))
    return [
        *parts,
        f"chosen as (select topology, arg_min(round, (amount, round)) as round from ({rounds_}) group by 1)",
        f"vlabels as ({labels})",
    ]


@query(
    "gph02_partition_volume",
    with_lenses(
        _with(
            _graph_sql("edges_planted") + _run_sql("", ROUND_ROBIN_START, K, ALL_ROUNDS) + _volume_sql(K, volume.ROUNDS),
            "select topology, id as task_id, part::int as part from vlabels join chosen using (topology, round)",
        ),
        "edges_planted",
    ),
)
def gph02_volume(spark, d):
    """The cut run's partition, moved on towards the smallest communication volume."""
    vertices, adjacency, _ = _planted(spark, d)
    edges = part.lay_out(adjacency)
    return volume.seek_volume(vertices, edges, part.partition_graph(vertices, edges, K), K)


_WINNER = f"""
runs as materialized (select 0 as run, topology, id, vw, capacity, kept from a_s{ALL_ROUNDS}
                      union all select 1, topology, id, vw, capacity, kept from b_s{ALL_ROUNDS}),
over as (select run, topology, max(load) > max(capacity) as over
         from (select run, topology, kept, max(capacity) as capacity, sum(vw)::bigint as load from runs group by 1, 2, 3)
         group by 1, 2),
cuts as (select 0 as run, topology, best as cut from a_best{ALL_ROUNDS}
         union all select 1, topology, best from b_best{ALL_ROUNDS}),
winner as (select topology, arg_min(run, (over, cut, run)) as run from over join cuts using (run, topology) group by 1)"""


@query(
    "gph02_partition_many_graphs",
    with_lenses(
        _with(
            _graph_sql("edges_dense")
            + _run_sql("a_", ROUND_ROBIN_START, 4, ALL_ROUNDS)
            + _run_sql("b_", HASH_START, 4, ALL_ROUNDS)
            + [_WINNER.strip()],
            "select topology, id as task_id, kept::int as part from runs join winner using (topology, run)",
        ),
        "edges_dense",
    ),
)
def gph02_many(spark, d):
    """All dense graphs in one job, from the better of both starts."""
    links = materialise(without_self_loops(L.edges_dense(spark, d)), "links")
    return part.partition_with("label_propagation", g.vertex_weights(links), g.undirected(links), 4)


def _compare_sql(before: list[str], tried: str) -> str:
    return _with(before, "").rstrip() + f""",
tried as materialized ({tried}),
labelled as materialized (
    select s.strategy, l.topology, l.source, l.target, l.value, s.part as sp, t.part as tp
    from links l join tried s on s.topology = l.topology and s.id = l.source
                 join tried t on t.topology = l.topology and t.id = l.target and t.strategy = s.strategy),
cuts as (select strategy, topology, sum(value)::bigint as total_weight,
                sum(case when sp <> tp then value else 0 end)::bigint as remote_weight from labelled group by 1, 2),
volumes as (select strategy, topology, count(*) as volume
            from (select strategy, topology, source as id, tp as other from labelled where sp <> tp
                  union select strategy, topology, target, sp from labelled where sp <> tp) group by 1, 2),
loads as (select strategy, topology,
                 (max(load) * (max(part) + 1) * 1000000 // sum(load)::bigint)::bigint as imbalance_ppm
          from (select strategy, topology, part, sum(vw)::bigint as load from tried group by 1, 2, 3) group by 1, 2)
select strategy, topology, total_weight, remote_weight, total_weight - remote_weight as local_weight,
       remote_weight * 1000000 // total_weight as remote_ppm, coalesce(volume, 0) as volume, imbalance_ppm
from cuts left join volumes using (strategy, topology) join loads using (strategy, topology)"""


_THREE = f"""select 'one' as strategy, topology, id, vw, 0 as part from vertices
    union all select 'round_robin', topology, id, vw, {ROUND_ROBIN_START.format(k=K)} from vertices
    union all select 'hash', topology, id, vw, {HASH_START.format(k=K)} from vertices"""


@query("gph05_compare_partitionings", with_lenses(_compare_sql(_graph_sql("edges_planted"), _THREE), "edges_planted"))
def gph05(spark, d):
    vertices, _, links = _planted(spark, d)
    names = ("one", "round_robin", "hash")
    tried = {n: part.partition_with(n, vertices, links, K) for n in names}
    return quality.compare_partitionings(links, vertices, tried)


_START_AND_END = f"""select 'round_robin' as strategy, topology, id, vw, {ROUND_ROBIN_START.format(k=K)} as part from vertices
    union all select 'label_propagation', topology, id, vw, kept from s{ALL_ROUNDS}"""


@query(
    "gph05_partition_quality",
    with_lenses(
        _compare_sql(
            _graph_sql("edges_planted") + _run_sql("", ROUND_ROBIN_START, K, ALL_ROUNDS), _START_AND_END
        ),
        "edges_planted",
    ),
)
def gph05_quality(spark, d):
    """The propagated partitioning next to its start."""
    vertices, adjacency, links = _planted(spark, d)
    tried = {
        "round_robin": part.round_robin_partition(vertices, K),
        "label_propagation": part.partition_graph(vertices, part.lay_out(adjacency), K),
    }
    return quality.compare_partitionings(links, vertices, tried)
