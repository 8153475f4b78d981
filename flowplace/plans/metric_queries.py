"""Queries for filters, counts, metric windows and rolling totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowplace.operators import metrics as m
from flowplace.operators import projections as p
from flowplace.operators import tracking
from flowplace.plans import lenses as L
from flowplace.plans.lenses import with_lenses
from flowplace.plans.registry import query
from flowplace.session import materialise
from flowplace.sources import formats

HOUR = 3_600
CONTROL = "not contains(stream, '__ack') and not contains(stream, '__metrics')"
LISTED = "name in ('complete_latency', 'throughput', 'worker_cpu_load', 'worker_network_bytes')"


def _secs(name: str = "start"):
    return F.unix_seconds(name).alias(name)


def _micros(name: str = "ts"):
    return F.unix_micros(name).alias(name)


@query("prj01_pass_key", with_lenses("select keyfield from keyed", "keyed"))
def prj01(spark, d):
    return p.pass_key(L.keyed(spark, d))


@query("prj02_pass_key_payload", with_lenses("select keyfield, payload from keyed", "keyed"))
def prj02(spark, d):
    return p.pass_key_payload(L.keyed(spark, d))


@query(
    "prj03_append_and_project",
    with_lenses("select md5(keyfield) as derived, payload from keyed", "keyed"),
)
def prj03(spark, d):
    return p.append_and_project(L.keyed(spark, d), "derived", F.md5("keyfield"), "payload")


@query(
    "prj04_data_streams",
    with_lenses(
        f"select topology, msg_id, source, stream, len(out_tasks)::int as targets from emits where {CONTROL}", "emits"
    ),
)
def prj04(spark, d):
    return p.data_streams(L.emits(spark, d)).select(
        "topology", "msg_id", "source", "stream", F.size("out_tasks").alias("targets")
    )


@query(
    "prj05_reported_metrics",
    with_lenses(
        f"""select topology, id, task_id, name, value,
                   case when name = 'complete_latency' then 'avg' else 'sum' end as aggregate
            from datapoints where {LISTED}""",
        "datapoints",
    ),
)
def prj05(spark, d):
    return p.reported_metrics(L.datapoints(spark, d)).select("topology", "id", "task_id", "name", "value", "aggregate")


@query(
    "prj06_logged_metrics",
    with_lenses("select topology, id, task_id, name, value from datapoints where name <> 'emitted_messages'", "datapoints"),
)
def prj06(spark, d):
    return p.logged_metrics(L.datapoints(spark, d)).select("topology", "id", "task_id", "name", "value")


@query(
    "prj07_regular_tasks",
    with_lenses("select topology, id, task_id, name, value from datapoints where task_id >= 0", "datapoints"),
)
def prj07(spark, d):
    return p.regular_tasks(L.datapoints(spark, d)).select("topology", "id", "task_id", "name", "value")


@query(
    "prj08_without_self_loops",
    with_lenses("select topology, source, target, value from edges_dense where source <> target", "edges_dense"),
)
def prj08(spark, d):
    return p.without_self_loops(L.edges_dense(spark, d))


@query(
    "prj09_reporting_updates",
    with_lenses(
        "select topology, id, task_id, name, value from datapoints where task_id = 1 or contains(lower(name), 'worker')",
        "datapoints",
    ),
)
def prj09(spark, d):
    return p.reporting_updates(L.datapoints(spark, d)).select("topology", "id", "task_id", "name", "value")


@query(
    "prj10_metric_path",
    with_lenses("select id, 'flowplace.' || topology || '.' || name as path from datapoints", "datapoints"),
)
def prj10(spark, d):
    return p.with_metric_path(L.datapoints(spark, d)).select("id", "path")


@query(
    "prj11_single_task",
    with_lenses("select topology, start_task, component from executors where start_task = end_task", "executors"),
)
def prj11_good(spark, d):
    return p.single_task(L.executors(spark, d)).select("topology", "start_task", "component")


@query(
    "prj11_multi_task",
    with_lenses("select topology, start_task, end_task from executors where start_task <> end_task", "executors"),
)
def prj11_bad(spark, d):
    return p.multi_task(L.executors(spark, d)).select("topology", "start_task", "end_task")


@query("agg01_edge_counts", with_lenses("select topology, source, target, value from edges_dense", "edges_dense"))
def agg01(spark, d):
    return L.edges_dense(spark, d)


@query(
    "agg01_send_graph",
    with_lenses("select topology, source, target, value from edges_dense where source <> target", "edges_dense"),
)
def send_graph(spark, d):
    return p.without_self_loops(m.edge_counts(L.emits(spark, d)))


@query(
    "agg02_edge_counts_per_interval",
    with_lenses(
        f"""select topology, (epoch_us(ts) // 15000000 * 15)::bigint as start, source, target, count(*) as value
            from (select topology, ts, source, stream, unnest(out_tasks) as target from emits) where {CONTROL}
            group by all""",
        "emits",
    ),
)
def agg02(spark, d):
    return m.edge_counts_per_interval(L.emits(spark, d)).withColumn("start", F.unix_seconds("start"))


@query(
    "agg03_latest_edges",
    with_lenses(
        "select topology, source, target, arg_max(value, id) as value from edge_updates group by all", "edge_updates"
    ),
)
def agg03(spark, d):
    return m.latest_edges(L.edge_updates(spark, d))


@query(
    "agg04_complete_graph",
    with_lenses(
        """select topology, source, target, sum(value)::bigint as value
           from (select topology, source, target, value from edges_dense
                 union all select topology, start_task, start_task, 0 from executors where start_task >= 0)
           group by topology, source, target""",
        "edges_dense",
        "executors",
    ),
)
def agg04(spark, d):
    tasks = L.executors(spark, d).select("topology", F.col("start_task").alias("task_id"))
    return m.complete_graph(L.edges_dense(spark, d), tasks)


@query(
    "agg07_throughput",
    with_lenses(
        """select topology, source as task_id, (epoch_us(ts) // 5000000 * 5)::bigint as start,
                  count(*) // 5 as throughput
           from emits group by 1, 2, 3""",
        "emits",
    ),
)
def agg07(spark, d):
    return m.throughput(L.emits(spark, d)).withColumn("start", F.unix_seconds("start"))


_LATENCY = """select topology, task_id, (epoch_us(ack_ts) // 5000000 * 5)::bigint as start,
       ({expr})::bigint as complete_latency
from acks group by 1, 2, 3"""
_MEAN = "coalesce(sum(latency_ms), 0)::bigint // greatest(count(*), 1)"


@query("agg08_complete_latency", with_lenses(_LATENCY.format(expr=f"{_MEAN} // 5"), "acks"))
def agg08(spark, d):
    return m.complete_latency(L.acks(spark, d)).withColumn("start", F.unix_seconds("start"))


@query("agg08_mean_latency", with_lenses(_LATENCY.format(expr=_MEAN), "acks"))
def agg08_mean(spark, d):
    return m.complete_latency(L.acks(spark, d), per_second=False).withColumn("start", F.unix_seconds("start"))


_HOST_BYTES = """select 'h' || (user_id % 5) as host, ts,
       event_id * 1010 + event_id * 3 + user_id as bytes from events"""


@query("agg09_interface_bytes", f"select host, epoch_us(ts) as snapshot_ts, bytes from ({_HOST_BYTES})")
def agg09(spark, d):
    totals = m.interface_bytes(formats.parse_netstat(L.netstat(spark, d)))
    return totals.select("host", _micros("snapshot_ts"), "bytes")


_TOTALS = """
with changes as (
    select topology, name, task_id, ts, id, value,
           value - coalesce(lag(value) over task, 0) as delta,
           case when row_number() over task = 1 then 1 else 0 end as first
    from datapoints
    window task as (partition by topology, name, task_id order by ts, id)
), totals as (
    select topology, name, task_id, ts, id,
           sum(delta) over upto as total, sum(first) over upto as tasks
    from changes
    window upto as (partition by topology, name order by ts, id rows between unbounded preceding and current row)
)
"""


@query(
    "win01_running_sum_of_latest",
    with_lenses(_TOTALS + "select topology, name, task_id, id, total::bigint as aggregated from totals", "datapoints"),
)
def win01(spark, d):
    out = m.running_sum_of_latest(L.datapoints(spark, d))
    return out.select("topology", "name", "task_id", "id", "aggregated")


@query(
    "win02_running_avg_of_latest",
    with_lenses(
        _TOTALS
        + "select topology, name, task_id, id, (total::bigint // greatest(tasks, 1)::bigint)::bigint as aggregated from totals",
        "datapoints",
    ),
)
def win02(spark, d):
    out = m.running_avg_of_latest(L.datapoints(spark, d))
    return out.select("topology", "name", "task_id", "id", "aggregated")


@query(
    "win03_counter_rate",
    f"""select host, epoch_us(ts) as ts,
               (case when lag(bytes) over w > 0 then (bytes - lag(bytes) over w) // 5 else 0 end)::bigint as rate
        from ({_HOST_BYTES}) window w as (partition by host order by ts)""",
)
def win03(spark, d):
    counters = m.interface_bytes(formats.parse_netstat(L.netstat(spark, d))).withColumnRenamed("snapshot_ts", "ts")
    return m.counter_rate(materialise(counters, "counters")).select("host", _micros("ts"), "rate")


@query(
    "win05_one_reporter_per_worker",
    with_lenses(
        "select topology, worker_host, worker_port, arg_min(task_id, id) as task_id from datapoints group by 1, 2, 3",
        "datapoints",
    ),
)
def win05(spark, d):
    return m.one_reporter_per_worker(L.datapoints(spark, d))


@query(
    "win06_message_ids",
    with_lenses("select source, id, row_number() over (partition by source order by ts, id) as msg_id from keyed", "keyed"),
)
def win06(spark, d):
    return m.message_ids(L.keyed(spark, d)).select("source", "id", "msg_id")


@query(
    "str02_sliding_load",
    with_lenses(
        f"""select topology, task_id, start, count(value) as readings,
                   sum(value)::bigint // greatest(count(value), 1) as load
            from (select topology, task_id, value,
                         unnest(range(epoch_us(ts) // 3600000000 - 11, epoch_us(ts) // 3600000000 + 1)) * {HOUR} as start
                  from datapoints)
            group by topology, task_id, start""",
        "datapoints",
    ),
)
def str02(spark, d):
    return m.sliding_load(L.datapoints(spark, d), 12, HOUR).withColumn("start", F.unix_seconds("start"))


@query(
    "str08_edge_changes",
    with_lenses(
        """select topology, source, target, id, value, coalesce(old_value, -1) as old_value
           from (select *, lag(value) over w as old_value, row_number() over w as n from edge_updates
                 window w as (partition by topology, source, target order by ts, id))
           where n = 1 or value <> old_value""",
        "edge_updates",
    ),
)
def str08(spark, d):
    changes = m.edge_changes(L.edge_updates(spark, d))
    return changes.select(
        "topology", "source", "target", "id", "value", F.coalesce("old_value", F.lit(-1)).alias("old_value")
    )


@query(
    "joi07_emit_ack_match",
    with_lenses(
        """select r.topology, r.msg_id, r.source, a.msg_id is not null as completed,
                  coalesce(a.latency_ms, -1) as latency_ms
           from roots r left join acks a
             on r.msg_id = a.msg_id and a.ack_ts between r.ts and r.ts + interval 100 second""",
        "roots",
        "acks",
    ),
)
def joi07(spark, d):
    matched = tracking.emit_ack_match(L.roots(spark, d), L.acks(spark, d)).drop("ts")
    return matched.withColumn("latency_ms", F.coalesce("latency_ms", F.lit(-1)))
