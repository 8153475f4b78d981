"""Streams over the given tables, run until all files are processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowplace.operators import projections as p
from flowplace.plans import lenses as L
from flowplace.plans.format_queries import _SERIES, series_lines
from flowplace.plans.lenses import with_lenses
from flowplace.plans.metric_queries import _LATENCY, _MEAN, _TOTALS, CONTROL
from flowplace.plans.registry import query
from flowplace.sinks import formats as out
from flowplace.streaming import debounce, live
from flowplace.streaming.io import stream_table
from flowplace.streaming.keyed import keyed_session

HOUR = 3_600
GAP = 600


def _secs(frame):
    return frame.withColumn("start", F.unix_seconds("start"))


@query(
    "str01_edge_counts_stream",
    with_lenses(
        f"""select topology, (epoch_us(ts) // 15000000 * 15)::bigint as start, source, target, count(*) as value
            from (select topology, ts, source, stream, unnest(out_tasks) as target from emits) where {CONTROL}
            group by all""",
        "emits",
    ),
)
def str01_edges(spark, d):
    return _secs(live.edge_counts(L.emits(spark, d, stream_table)))


@query(
    "str01_throughput_stream",
    with_lenses(
        """select topology, source as task_id, (epoch_us(ts) // 5000000 * 5)::bigint as start, count(*) // 5 as throughput
           from emits group by 1, 2, 3""",
        "emits",
    ),
)
def str01_throughput(spark, d):
    return _secs(live.throughput(L.emits(spark, d, stream_table)))


@query("str01_complete_latency_stream", with_lenses(_LATENCY.format(expr=f"{_MEAN} // 5"), "acks"))
def str01_latency(spark, d):
    return _secs(live.complete_latency(L.acks(spark, d, stream_table)))


@query(
    "str02_sliding_load_stream",
    with_lenses(
        f"""select topology, task_id, start, count(value) as readings, sum(value)::bigint // greatest(count(value), 1) as load
            from (select topology, task_id, value,
                         unnest(range(epoch_us(ts) // 3600000000 - 11, epoch_us(ts) // 3600000000 + 1)) * {HOUR} as start
                  from datapoints)
            group by topology, task_id, start""",
        "datapoints",
    ),
)
def str02(spark, d):
    return _secs(live.sliding_load(L.datapoints(spark, d, stream_table), 12, HOUR))


_SESSIONS = f"""
select topology, epoch_us(min(ts)) as first_update, epoch_us(max(ts)) + {GAP} * 1000000 as published, count(*) as updates
from (select topology, ts, sum(opens) over (partition by topology order by ts, id) as session
      from (select topology, ts, id, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by topology order by ts, id))
                                               <= {GAP} * 1000000 then 0 else 1 end as opens from edge_updates))
group by topology, session
"""


def _micros(frame):
    return frame.withColumns({c: F.unix_micros(c) for c in ("first_update", "published")})


@query("str03_publish_sessions", with_lenses(_SESSIONS, "edge_updates"))
def str03(spark, d):
    return _micros(debounce.publish_sessions(L.edge_updates(spark, d), GAP))


@query("str03_publish_sessions_stream", with_lenses(_SESSIONS, "edge_updates"))
def str03_stream(spark, d):
    return _micros(live.publish_sessions(L.edge_updates(spark, d, stream_table), GAP))


_PUBLISH_TIMES = f"""
with recursive ticks as materialized (
    select topology, ms, row_number() over (partition by topology order by ms) as n
    from (select distinct topology, epoch_us(ts) // 1000 as ms from edge_updates)),
steps as (
    select topology, 0::bigint as n, null::bigint as due, null::bigint as last, null::bigint as published
    from (select distinct topology from ticks)
    union all
    select topology, n,
           case when open is null or before is null or before + {3 * GAP * 1000} > ms then ms + {GAP * 1000} else open end,
           before, fired
    from (select s.topology, t.n, t.ms,
                 case when s.due <= t.ms then null else s.due end as open,
                 case when s.due <= t.ms then s.due else s.last end as before,
                 case when s.due <= t.ms then s.due end as fired
          from steps s join ticks t on t.topology = s.topology and t.n = s.n + 1)),
ended as (
    select topology, published as published_ms from steps where published is not null
    union all
    select topology, due from steps
    where (topology, n) in (select topology, max(n) from ticks group by topology))
select topology, published_ms from ended
"""


@query("str03_publish_times", with_lenses(_PUBLISH_TIMES, "edge_updates"))
def str03_times(spark, d):
    """Silence of ten minutes, but a new version at least every half hour of updates."""
    return debounce.publish_times(debounce.ticks(L.edge_updates(spark, d)), GAP, 3 * GAP)


@query("str03_publish_times_stream", with_lenses(_PUBLISH_TIMES, "edge_updates"))
def str03_times_stream(spark, d):
    return live.publish_times(L.edge_updates(spark, d, stream_table), GAP, 3 * GAP)


@query(
    "str04_latest_graph_stream",
    with_lenses(
        "select topology, source, target, arg_max(value, id) as value from edge_updates group by all", "edge_updates"
    ),
)
def str04(spark, d):
    return live.latest_graph(L.edge_updates(spark, d, stream_table))


@query(
    "str05_running_totals_stream",
    with_lenses(
        _TOTALS
        + """select topology, name, task_id, id,
                    (case when name = 'complete_latency' then total::bigint // greatest(tasks, 1)::bigint
                          else total::bigint end)::bigint as aggregated
             from totals where name <> 'emitted_messages'""",
        "datapoints",
    ),
)
def str05(spark, d):
    points = p.reported_metrics(L.datapoints(keyed_session(spark), d, stream_table))
    return live.metric_series(points).select("topology", "name", "task_id", "id", "aggregated")


@query(
    "str06_schedule_changes_stream",
    with_lenses(
        """select topology, id, text
           from (select *, lag(text) over (partition by topology order by ts, id) as before from schedule_reports)
           where before is null or before <> text""",
        "schedule_reports",
    ),
)
def str06(spark, d):
    reports = L.schedule_reports(keyed_session(spark), d, stream_table)
    return live.schedule_changes(reports).select("topology", "id", "text")


@query(
    "str07_tracked_stream",
    with_lenses(
        """select r.topology, r.msg_id, r.source, a.msg_id is not null as completed, coalesce(a.latency_ms, -1) as latency_ms
           from roots r left join acks a on r.msg_id = a.msg_id and a.ack_ts between r.ts and r.ts + interval 100 second""",
        "roots",
        "acks",
    ),
)
def str07(spark, d):
    found = live.tracked(L.roots(spark, d, stream_table), L.acks(spark, d, stream_table)).drop("ts")
    return found.withColumn("latency_ms", F.coalesce("latency_ms", F.lit(-1)))


@query(
    "str08_edge_changes_stream",
    with_lenses(
        """select topology, source, target, id, value, coalesce(old_value, -1) as old_value
           from (select *, lag(value) over w as old_value, row_number() over w as n from edge_updates
                 window w as (partition by topology, source, target order by ts, id))
           where n = 1 or value <> old_value""",
        "edge_updates",
    ),
)
def str08(spark, d):
    found = live.edge_changes(L.edge_updates(keyed_session(spark), d, stream_table))
    return found.select(
        "topology", "source", "target", "id", "value", F.coalesce("old_value", F.lit(-1)).alias("old_value")
    )


@query("snk04_graphite_lines_stream", with_lenses(_SERIES, "datapoints"))
def snk04_stream(spark, d):
    """Lines of the combined series, from the totals behind a stream."""
    points = p.reported_metrics(L.datapoints(keyed_session(spark), d, stream_table))
    return out.graphite_lines(series_lines(live.metric_series(points)))
