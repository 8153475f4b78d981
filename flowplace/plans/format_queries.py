"""Queries that read and write the data formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowplace.functions import edge_ends, to_be_long
from flowplace.operators import graph as g
from flowplace.operators import metrics as m
from flowplace.operators import projections as p
from flowplace.plans import lenses as L
from flowplace.plans.lenses import with_lenses
from flowplace.plans.registry import query
from flowplace.session import materialise, new_path
from flowplace.sinks import formats as out
from flowplace.sinks.publish import latest_per_key
from flowplace.sources import formats as src


def _reported(spark, d):
    return src.parse_reports(L.task_reports(spark, d))


@query(
    "src01_datapoints",
    with_lenses(
        """select topology, epoch_us(ts) // 1000 as ts_ms, id, worker_host, worker_port, component, task_id, p.name as name,
                  coalesce(p.value, -1) as value, p.counts as counts
           from (select *, unnest([{'name': name, 'value': value, 'counts': 0},
                                   {'name': 'emitted_messages', 'value': null, 'counts': 1}]) as p from datapoints)""".replace(
            "'value': value", "'value': value::bigint"
        ),
        "datapoints",
    ),
)
def src01(spark, d):
    return _reported(spark, d).select(
        "topology",
        F.unix_millis("ts").alias("ts_ms"),
        "id",
        "worker_host",
        "worker_port",
        "component",
        "task_id",
        "name",
        F.coalesce("value", F.lit(-1)).alias("value"),
        F.coalesce(F.size("value_map"), F.lit(0)).alias("counts"),
    )


@query(
    "src01_edge_values",
    with_lenses(
        """select topology, id, task_id as source, id % 25 + 1 as target, value from datapoints""", "datapoints"
    ),
)
def src01_edges(spark, d):
    return src.edge_values(_reported(spark, d).filter(F.col("value_map").isNotNull())).drop("ts")


def _pieces(spark, d):
    edges = L.stored_edges_dense(spark, d)
    return out.sendgraph_json(edges, g.graph_nodes(edges))


_LINKS = "select topology, source, target, value from edges_dense where source <> target"


@query("src02_sendgraph_links", with_lenses(_LINKS, "edges_dense"))
def src02_links(spark, d):
    return src.sendgraph_piece_links(_pieces(spark, d))


@query("src02_sendgraph_nodes", with_lenses("select topology, id from nodes_dense", "nodes_dense"))
def src02_nodes(spark, d):
    return src.sendgraph_piece_nodes(_pieces(spark, d))


_METIS = """
with links as (select topology, source, target, value from {edges} where source <> target),
pairs as (select topology, least(source, target) as a, greatest(source, target) as b,
                 max(case when source < target then value end) as ab, max(case when source > target then value end) as ba
          from links group by 1, 2, 3),
adj as (
    select topology, a as id, b as nbr,
           case when ab is not null and ba is not null then greatest(ab, 1) else coalesce(ab, 1) end as w from pairs
    union all
    select topology, b, a, case when ab is not null and ba is not null then ba + 1 else coalesce(ba, 1) end from pairs),
header as (select topology, max(b) as n, count(*) as m from pairs group by topology),
ends as (select topology, source as id, value from links union all select topology, target, value from links),
vertices as (select topology, id, (1 + coalesce(sum(value), 0))::bigint as vw
             from (select topology, unnest(range(1, n + 1)) as id from header) left join ends using (topology, id)
             group by topology, id),
lines as (
    select topology, 0::bigint as line_no, -1::bigint as piece, n || ' ' || m || ' 011 1' as text from header
    union all
    select topology, id, -1, vw::varchar from vertices
    union all
    select topology, id, nbr // 4096, string_agg(' ' || nbr || ' ' || greatest(w, 1), '' order by nbr) from adj group by 1, 2, 3)
"""


def _lines(spark, d, lens):
    return out.metis_lines(p.without_self_loops(materialise(lens(spark, d), "links")))


@query(
    "snk02_metis_lines",
    with_lenses(_METIS.format(edges="edges_dense") + "select topology, line_no, piece, text from lines", "edges_dense"),
)
def snk02(spark, d):
    return _lines(spark, d, L.edges_dense)


@query(
    "snk02_metis_lines_bipartite",
    with_lenses(
        _METIS.format(edges="edges_bipartite") + "select topology, line_no, piece, text from lines",
        "edges_bipartite",
    ),
)
def snk02_bipartite(spark, d):
    return _lines(spark, d, L.edges_bipartite)


@query(
    "src03_metis_vertices",
    with_lenses(_METIS.format(edges="edges_dense") + "select topology, id, vw from vertices", "edges_dense"),
)
def src03_vertices(spark, d):
    return src.metis_vertices(_lines(spark, d, L.edges_dense))


@query(
    "src03_metis_adjacency",
    with_lenses(_METIS.format(edges="edges_dense") + "select topology, id, nbr, w::bigint as w from adj", "edges_dense"),
)
def src03_adjacency(spark, d):
    return src.metis_adjacency(_lines(spark, d, L.edges_dense))


@query(
    "src03_graph_file_round_trip",
    with_lenses(_METIS.format(edges="edges_planted") + "select topology, id, nbr, w::bigint as w from adj", "edges_planted"),
)
def src03_file(spark, d):
    """The planted graph written as a graph file and read back."""
    path = new_path(spark, "graph-file")
    out.write_metis(materialise(L.edges_planted(spark, d), "links"), path)
    return src.metis_adjacency(src.read_metis(spark, path))


@query(
    "src03_metis_header",
    with_lenses(_METIS.format(edges="edges_dense") + "select topology, n, m from header", "edges_dense"),
)
def src03_header(spark, d):
    return src.metis_header(_lines(spark, d, L.edges_dense))


@query(
    "src04_partition_vector",
    with_lenses(
        """select topology, epoch_us(ts) // 1000000 as version, pos as task_id,
                  string_split(text, chr(10))[pos]::int as part
           from (select topology, ts, text, unnest(range(1, 26)) as pos from schedule_versions)""",
        "schedule_versions",
    ),
)
def src04(spark, d):
    versions = L.schedule_versions(spark, d)
    docs = versions.select(F.struct("topology", F.unix_seconds("ts").alias("version")).alias("topology"), "text")
    return src.read_partition_vector(docs).select("topology.*", "task_id", "part")


@query(
    "src05_binary_counters",
    with_lenses("select topology, source, target, value from edges_dense", "edges_dense"),
)
def src05(spark, d):
    read = src.read_counters(L.binary_counters(spark, d))
    return read.select(F.element_at(F.split("path", "/"), 3).alias("topology"), "source", "target", "value")


@query(
    "src05_encode_be_long",
    with_lenses(
        "select topology, source, target, lpad(upper(to_hex(value)), 16, '0') as bytes from edges_dense", "edges_dense"
    ),
)
def src05_encode(spark, d):
    return L.edges_dense(spark, d).select(
        "topology", "source", "target", F.hex(to_be_long(F.col("value"))).alias("bytes")
    )


@query(
    "src06_edge_paths",
    """select id, regexp_extract(path, '(-?\\d+)[-_](-?\\d+)$', 1)::bigint as source,
              regexp_extract(path, '(-?\\d+)[-_](-?\\d+)$', 2)::bigint as target
       from (select event_id as id, '/root/t/' || (user_id - 2) || '_' || (event_id % 25 - 3) as path from events)""",
)
def src06(spark, d):
    path = F.concat(
        F.lit("/root/t/"),
        (F.col("user_id") - 2).cast("string"),
        F.lit("_"),
        (F.col("event_id") % 25 - 3).cast("string"),
    )
    source, target = edge_ends(F.col("path"))
    files = L.table(spark, d, "events").select(F.col("event_id").alias("id"), path.alias("path"))
    return files.select("id", source.alias("source"), target.alias("target"))


@query(
    "src07_netstat",
    """select host, epoch_us(ts) as snapshot_ts, line_no, iface, in_bytes, out_bytes
       from (select 'h' || (user_id % 5) as host, ts, unnest([
                {'line_no': 1, 'iface': 'en0', 'in_bytes': event_id * 1000, 'out_bytes': event_id * 10},
                {'line_no': 2, 'iface': 'en0', 'in_bytes': event_id * 7777, 'out_bytes': event_id * 7},
                {'line_no': 4, 'iface': 'en12', 'in_bytes': event_id * 3, 'out_bytes': user_id}], recursive := true)
             from events)""",
)
def src07(spark, d):
    return src.parse_netstat(L.netstat(spark, d)).withColumn("snapshot_ts", F.unix_micros("snapshot_ts"))


@query(
    "src08_keyed_events",
    with_lenses(
        """select source, row_number() over (partition by source order by ts, id) as msg_id, keyfield, payload from keyed""",
        "keyed",
    ),
)
def src08(spark, d):
    """Recorded events replayed as keyed messages with ids per source."""
    return m.message_ids(L.keyed(spark, d)).select("source", "msg_id", "keyfield", "payload")


@query("src09_word_events", with_lenses("select word as keyfield, count(*) as n from words group by word", "words"))
def src09(spark, d):
    """Words as messages: every word of every document, counted per key."""
    return L.words(spark, d).groupBy(F.col("word").alias("keyfield")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "src11_topology_config",
    """select r_name as topology, case when r_regionkey = 1 then 10 else 5 end as timeout from region""",
)
def src11(spark, d):
    return src.topology_config(L.config(spark, d), "scheduling.metrics.timeout.secs", "int", 5, "timeout")


@query("src11_topology_workers", "select r_name as topology, (r_regionkey + 4)::bigint as workers from region")
def src11_workers(spark, d):
    return src.topology_config(L.config(spark, d), "topology.workers", "bigint", 1, "workers")


@query(
    "snk01_sendgraph_json",
    with_lenses(
        """with entries as (
               select topology, 1 as section, id // 4096 as a, 0::bigint as b, id, '{"name":"' || id || '"}' as entry from nodes_dense
               union all
               select topology, 3, source, target // 4096, target,
                      '{"source":' || source || ',"target":' || target || ',"value":' || value || '}'
               from edges_dense where source <> target),
           pieces as (select topology, section, a, b, string_agg(entry, ',' order by id) as text from entries group by 1, 2, 3, 4)
           select topology, section, a, b,
                  case when row_number() over (partition by topology, section order by a, b) = 1 then '' else ',' end || text as text
           from pieces
           union all
           select topology, section, 0, 0, text
           from (select distinct topology from nodes_dense),
                (values (0, '{"nodes":['), (2, '],"links":['), (4, ']}')) as frame(section, text)""",
        "nodes_dense",
    ),
)
def snk01(spark, d):
    return _pieces(spark, d)


@query("src02_json_file_round_trip", with_lenses(_LINKS.replace("edges_dense", "edges_bipartite"), "edges_bipartite"))
def src02_file(spark, d):
    """The bipartite graph written as a JSON document and read back."""
    path = new_path(spark, "json-file")
    edges = materialise(L.edges_bipartite(spark, d), "edges")
    out.write_sendgraph_json(edges, g.graph_nodes(edges), path)
    return src.sendgraph_piece_links(src.read_text_pieces(spark, path))


_FILLED = """(select topology, task_id, (task_id % 8)::int as part
               from (select topology, unnest(range(1, max(greatest(source, target)) + 1)) as task_id from edges_planted group by topology))"""


def _planted_parts(spark, d):
    nodes = g.graph_nodes(L.edges_planted(spark, d))
    return nodes.select("topology", F.col("id").alias("task_id"), (F.col("id") % 8).cast("int").alias("part"))


@query(
    "snk03_partition_vector",
    with_lenses(
        f"""select topology, (task_id - 1) // 4096 as block, string_agg(part::varchar, chr(10) order by task_id) as text
            from {_FILLED} group by 1, 2""",
        "edges_planted",
    ),
)
def snk03(spark, d):
    return out.partition_vector(_planted_parts(spark, d))


@query("src04_vector_round_trip", with_lenses(f"select topology, task_id, part from {_FILLED}", "edges_planted"))
def src04_blocks(spark, d):
    """Every task comes back with its own partition, tasks in gaps with the fallback's."""
    return src.read_vector_blocks(out.partition_vector(_planted_parts(spark, d)), out.IDS_PER_BLOCK)


@query("src04_vector_file_round_trip", with_lenses(f"select topology, task_id, part from {_FILLED}", "edges_planted"))
def src04_file(spark, d):
    path = new_path(spark, "vector-file")
    out.write_partition_vector(_planted_parts(spark, d), path)
    lines = src.read_lines(spark, path)
    return lines.select("topology", (F.col("line_no") + 1).alias("task_id"), F.col("line").cast("int").alias("part"))


_SERIES = """
with changes as (
    select topology, name, task_id, ts, id, value, value - coalesce(lag(value) over task, 0) as delta,
           case when row_number() over task = 1 then 1 else 0 end as first
    from datapoints where name <> 'emitted_messages'
    window task as (partition by topology, name, task_id order by ts, id)
), totals as (
    select topology, name, task_id, ts, sum(delta) over upto as total, sum(first) over upto as tasks from changes
    window upto as (partition by topology, name order by ts, id rows between unbounded preceding and current row)
)
select 'flowplace.' || topology || '.' || name || ' '
       || (case when name = 'complete_latency' then total::bigint // greatest(tasks, 1)::bigint else total::bigint end)
       || ' ' || (epoch_us(ts) // 1000000) as line
from totals where task_id = 1 or contains(lower(name), 'worker')
"""


def series_lines(totals):
    """Combined metrics as (path, value, epoch) at reporting updates."""
    combined = p.with_metric_path(p.reporting_updates(totals))
    return combined.select("path", F.col("aggregated").alias("value"), F.unix_seconds("ts").alias("epoch"))


def series(points):
    """Allow-listed metrics, combined over tasks."""
    return series_lines(m.metric_series(p.reported_metrics(points)))


@query("snk04_graphite_lines", with_lenses(_SERIES, "datapoints"))
def snk04(spark, d):
    return out.graphite_lines(series(L.datapoints(spark, d)))


@query(
    "snk05_metrics_log_lines",
    with_lenses(
        r"""select printf(chr(9) || '%d' || chr(9) || '%15s:%-4d' || chr(9) || '%-20s' || chr(9) || '%-11s' || chr(9) || '%3d' || chr(9),
                          epoch_us(ts) // 1000000, worker_host, worker_port, topology, component, task_id)
                   || rpad(name, 33, ' ') || chr(9) || value as line
            from datapoints where name <> 'emitted_messages'""",
        "datapoints",
    ),
)
def snk05(spark, d):
    return out.metrics_log_lines(p.logged_metrics(L.datapoints(spark, d)))


@query(
    "snk06_publish_latest",
    with_lenses(
        """select topology, epoch_us(arg_max(ts, ts)) // 1000000 as version, arg_max(text, ts) as text
           from schedule_versions group by topology""",
        "schedule_versions",
    ),
)
def snk06(spark, d):
    newest = latest_per_key(L.schedule_versions(spark, d), ["topology"], ["ts"])
    return newest.select("topology", F.unix_seconds("ts").alias("version"), "text")
