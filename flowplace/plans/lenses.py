"""Reshape the given tables into the inputs of the operators.

Each lens exists twice: as a DataFrame function and, for checking, as one SQL common
table expression over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowplace.functions import to_be_long
from flowplace.operators import graph, metrics
from flowplace.session import materialise

METRIC_OF_TYPE = {
    "view": "throughput",
    "click": "complete_latency",
    "purchase": "worker_network_bytes",
    "signup": "worker_cpu_load",
    "error": "emitted_messages",
}
LINES_PER_VERSION = 25


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


Reader = Callable[[SparkSession, str, str], DataFrame]


def _clock(day: str) -> Column:
    """Recorded days become 100 ms apart, so the default 5 s and 15 s windows fill up."""
    return F.expr(
        f"timestampadd(MILLISECOND, 100 * datediff({day}, date'1992-01-01'), timestamp'2024-01-01 00:00:00')"
    )


def _stream() -> Column:
    return (
        F.when(F.col("o_orderkey") % 10 == 0, "__ack_ack")
        .when(F.col("o_orderkey") % 10 == 1, "__metrics")
        .otherwise("default")
    )


def _id(key: str) -> Column:
    """Ids are BIGINT throughout and count from 1."""
    return F.col(key).cast("bigint") + 1


def emits(spark: SparkSession, d: str, read: Reader = table) -> DataFrame:
    """One emit per line item, from the customer's nation to the supplier's; returned
    lines go to a second target as well."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    supplier = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    lineitem = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_returnflag")
    target = _id("s_nationkey")
    return (
        lineitem.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderpriority").alias("topology"),
            _clock("o_orderdate").alias("ts"),
            F.col("o_orderkey").alias("msg_id"),
            _id("c_nationkey").alias("source"),
            _stream().alias("stream"),
            F.when(F.col("l_returnflag") == "R", F.array(target, F.col("l_linenumber").cast("bigint")))
            .otherwise(F.array(target))
            .alias("out_tasks"),
        )
    )


def roots(spark: SparkSession, d: str, read: Reader = table) -> DataFrame:
    """The first emit of each message: one row per order."""
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return (
        read(spark, d, "orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderpriority").alias("topology"),
            _clock("o_orderdate").alias("ts"),
            F.col("o_orderkey").alias("msg_id"),
            _id("c_nationkey").alias("source"),
        )
    )


def acks(spark: SparkSession, d: str, read: Reader = table) -> DataFrame:
    """Pending orders are never acknowledged; some acknowledgements carry no latency."""
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    millis = (F.col("o_orderkey") % 150) * 1000
    return (
        read(spark, d, "orders")
        .filter(F.col("o_orderstatus") != "P")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderpriority").alias("topology"),
            F.col("o_orderkey").alias("msg_id"),
            _id("c_nationkey").alias("task_id"),
            (_clock("o_orderdate") + F.make_dt_interval(secs=F.col("o_orderkey") % 150)).alias("ack_ts"),
            F.when(F.col("o_orderkey") % 17 != 0, millis).alias("latency_ms"),
        )
    )


def _metric_name() -> Column:
    pairs = [F.lit(x) for pair in METRIC_OF_TYPE.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.col("event_type"))


def _whole(value: str = "value") -> Column:
    return F.floor(value).cast("bigint")


def _text(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def datapoints(spark: SparkSession, d: str, read: Reader = table) -> DataFrame:
    e = read(spark, d, "events")
    return e.select(
        _text("topo", F.col("event_id") % 3).alias("topology"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("id"),
        _text("w", F.col("user_id") % 20).alias("worker_host"),
        (F.col("user_id") % 4 + 6700).cast("int").alias("worker_port"),
        _text("c", F.col("user_id") % 4).alias("component"),
        (F.col("user_id") - 2).alias("task_id"),
        _metric_name().alias("name"),
        _whole().alias("value"),
    )


def task_reports(spark: SparkSession, d: str) -> DataFrame:
    """Raw reports as JSON text: one metric reading and one map of message counts each."""
    none_map = F.lit(None).cast("map<bigint,bigint>")
    reading = F.struct("name", "value", none_map.alias("value_map"))
    counts = F.struct(
        F.lit("emitted_messages").alias("name"),
        F.lit(None).cast("bigint").alias("value"),
        F.create_map(F.col("id") % 25 + 1, F.col("value")).alias("value_map"),
    )
    points = datapoints(spark, d)
    rest = [c for c in points.columns if c not in ("name", "value")]
    return points.select(F.to_json(F.struct(*rest, F.array(reading, counts).alias("points"))).alias("json"))


def edge_updates(spark: SparkSession, d: str, read: Reader = table) -> DataFrame:
    return read(spark, d, "events").select(
        _text("topo", F.col("event_id") % 3).alias("topology"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("id"),
        (F.col("user_id") % 25 + 1).alias("source"),
        (F.col("event_id") % 25 + 1).alias("target"),
        _whole().alias("value"),
    )


def edges_dense(spark: SparkSession, d: str) -> DataFrame:
    return metrics.edge_counts(emits(spark, d))


def edges_bipartite(spark: SparkSession, d: str) -> DataFrame:
    suppliers = table(spark, d, "supplier").agg(F.count(F.lit(1))).scalar()
    return (
        table(spark, d, "lineitem")
        .groupBy("l_suppkey", "l_partkey")
        .agg(F.count(F.lit(1)).alias("value"))
        .select(
            F.lit("bipartite").alias("topology"),
            (F.col("l_suppkey") + 1).alias("source"),
            (suppliers + F.col("l_partkey") + 1).alias("target"),
            "value",
        )
    )


def edges_planted(spark: SparkSession, d: str) -> DataFrame:
    """Eight planted groups plus noise, for judging partitions."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    top = table(spark, d, "lineitem").agg(F.max("l_orderkey") + 2).scalar()
    size = table(spark, d, "part").agg(F.call_function("div", F.count(F.lit(1)), F.lit(8))).scalar()
    group = F.call_function("div", F.col("l_orderkey"), F.lit(100)) % 8
    inner = F.when(F.col("l_linenumber") == 7, F.col("l_partkey")).otherwise(
        group * size + F.col("l_partkey") % size
    )
    return (
        lines.select((F.col("l_orderkey") + 1).alias("source"), (top + inner).alias("target"))
        .groupBy("source", "target")
        .agg(F.count(F.lit(1)).alias("value"))
        .select(F.lit("planted").alias("topology"), "source", "target", "value")
    )


def stored_edges_dense(spark: SparkSession, d: str) -> DataFrame:
    """The dense graphs as a table, for queries that look at them more than once."""
    return materialise(edges_dense(spark, d), "edges")


def assignment(edges: DataFrame) -> DataFrame:
    """A schedule for the dense graphs of all topologies: task i -> i div 3 mod 4; every seventh task has no line."""
    nodes = graph.graph_nodes(edges).filter(F.col("id") % 7 != 0)
    part = F.call_function("div", F.col("id"), F.lit(3)) % 4
    return nodes.select("topology", F.col("id").alias("task_id"), part.cast("int").alias("part"))


def partial_assignment(edges: DataFrame) -> DataFrame:
    """The same with one topology that nobody has scheduled yet."""
    return assignment(edges).filter(F.col("topology") != "5-LOW")


def _vector(shift: Column) -> Column:
    lines = F.transform(
        F.sequence(F.lit(1), F.lit(LINES_PER_VERSION)), lambda i: ((i + shift) % 4).cast("string")
    )
    return F.array_join(lines, "\n").alias("text")


def schedule_reports(spark: SparkSession, d: str, read: Reader = table) -> DataFrame:
    """Each event reports the vector that is current on its day."""
    rows = read(spark, d, "events").select(
        _text("topo", F.col("event_id") % 3).alias("topology"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("id"),
    )
    return rows.select("topology", "ts", "id", _vector(F.call_function("div", F.day("ts"), F.lit(3))))


def schedule_versions(spark: SparkSession, d: str) -> DataFrame:
    """A vector per topology and recorded hour; it follows the hour's number of events."""
    hours = table(spark, d, "events").groupBy(
        _text("topo", F.col("event_id") % 3).alias("topology"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"),
    )
    return hours.agg(F.count(F.lit(1)).alias("n")).select("topology", "ts", _vector(F.col("n")))


def executors(spark: SparkSession, d: str) -> DataFrame:
    """A task for each customer with orders in a topology, from -2 on; of every fifty, one executor has two tasks."""
    tasks = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("topology"), (F.col("o_custkey") - 2).alias("start_task")
    )
    end = F.when(F.col("start_task") % 50 == 30, F.col("start_task") + 1).otherwise(F.col("start_task"))
    return tasks.distinct().select(
        "topology", "start_task", end.alias("end_task"), _text("c", F.col("start_task") % 4).alias("component")
    )


def supervisors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("host"),
        (F.col("s_suppkey") % 10 == 9).alias("blacklisted"),
        (F.col("s_nationkey") % 4).alias("assignable_slots"),
        (F.col("s_suppkey") % 3).cast("int").alias("used_ports"),
    )


def netstat(spark: SparkSession, d: str) -> DataFrame:
    """Four lines of an interface table per event; the second ``en0`` line must not count."""
    def line(name: str, n_in: str, n_out: str) -> Column:
        return F.format_string(
            f"{name:<5} 1500  <Link#5>    54:26:96:da:ed:9f   1  0 %d  2  0 %d  0", F.expr(n_in), F.expr(n_out)
        )

    lines = F.array(
        line("lo0", "event_id", "event_id"),
        line("en0", "event_id * 1000", "event_id * 10"),
        line("en0", "event_id * 7777", "event_id * 7"),
        line("bridg", "event_id", "1"),
        line("en12", "event_id * 3", "user_id"),
    )
    return table(spark, d, "events").select(
        _text("h", F.col("user_id") % 5).alias("host"),
        F.col("ts").cast("timestamp").alias("snapshot_ts"),
        F.posexplode(lines).alias("line_no", "line"),
    )


def config(spark: SparkSession, d: str) -> DataFrame:
    workers = F.create_map(F.lit("topology.workers"), (F.col("r_regionkey") + 4).cast("string"))
    timeout = F.create_map(
        F.lit("scheduling.metrics.timeout.secs"),
        F.when(F.col("r_regionkey") == 3, "soon").otherwise((F.col("r_regionkey") * 10).cast("string")),
    )
    return table(spark, d, "region").select(
        F.col("r_name").alias("topology"),
        F.when(F.col("r_regionkey") % 2 == 1, F.map_concat(workers, timeout)).otherwise(workers).alias("conf"),
    )


def binary_counters(spark: SparkSession, d: str) -> DataFrame:
    return edges_dense(spark, d).select(
        F.concat_ws(
            "/", F.lit("/root"), "topology", F.concat_ws("-", F.col("source").cast("string"), F.col("target").cast("string"))
        ).alias("path"),
        to_be_long(F.col("value")).alias("data"),
    )


def keyed(spark: SparkSession, d: str) -> DataFrame:
    key = F.md5(F.col("user_id").cast("string"))
    return table(spark, d, "events").select(
        F.col("user_id").alias("source"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("id"),
        key.alias("keyfield"),
        F.repeat(key, F.lit(4)).alias("payload"),
    )


def words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("word"))


_CLOCK = (
    "timestamp '2024-01-01' + to_milliseconds(100 * date_diff('day', timestamp '1992-01-01', o_orderdate))"
)
_METRIC_CASE = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in METRIC_OF_TYPE.items()) + " end"

# name -> (lenses it builds on, body)
SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "emits": (
        (),
        f"""
        select o_orderpriority as topology, {_CLOCK} as ts, o_orderkey as msg_id, c_nationkey::bigint + 1 as source,
               case o_orderkey % 10 when 0 then '__ack_ack' when 1 then '__metrics' else 'default' end as stream,
               case when l_returnflag = 'R' then [s_nationkey::bigint + 1, l_linenumber::bigint] else [s_nationkey::bigint + 1] end
                   as out_tasks
        from lineitem join supplier on l_suppkey = s_suppkey
                      join orders on l_orderkey = o_orderkey
                      join customer on o_custkey = c_custkey""",
    ),
    "roots": (
        (),
        f"""
        select o_orderpriority as topology, {_CLOCK} as ts, o_orderkey as msg_id, c_nationkey::bigint + 1 as source
        from orders join customer on o_custkey = c_custkey""",
    ),
    "acks": (
        (),
        f"""
        select o_orderpriority as topology, o_orderkey as msg_id, c_nationkey::bigint + 1 as task_id,
               {_CLOCK} + to_seconds(o_orderkey % 150) as ack_ts,
               case when o_orderkey % 17 <> 0 then (o_orderkey % 150) * 1000 end as latency_ms
        from orders join customer on o_custkey = c_custkey
        where o_orderstatus <> 'P'""",
    ),
    "datapoints": (
        (),
        f"""
        select 'topo' || (event_id % 3) as topology, ts, event_id as id, 'w' || (user_id % 20) as worker_host,
               (user_id % 4 + 6700)::int as worker_port, 'c' || (user_id % 4) as component,
               user_id - 2 as task_id, {_METRIC_CASE} as name, floor(value)::bigint as value
        from events""",
    ),
    "edge_updates": (
        (),
        """
        select 'topo' || (event_id % 3) as topology, ts, event_id as id, user_id % 25 + 1 as source,
               event_id % 25 + 1 as target, floor(value)::bigint as value
        from events""",
    ),
    "edges_latest": (
        ("edge_updates",),
        "select topology, source, target, arg_max(value, id) as value from edge_updates group by all",
    ),
    "edges_dense": (
        ("emits",),
        """
        select topology, source, target, count(*) as value
        from (select topology, source, stream, unnest(out_tasks) as target from emits)
        where not contains(stream, '__ack') and not contains(stream, '__metrics')
        group by topology, source, target""",
    ),
    "edges_bipartite": (
        (),
        """
        select 'bipartite' as topology, l_suppkey + 1 as source,
               (select count(*) from supplier) + l_partkey + 1 as target, count(*) as value
        from lineitem group by l_suppkey, l_partkey""",
    ),
    "edges_planted": (
        (),
        """
        select 'planted' as topology, l_orderkey + 1 as source,
               ((select max(l_orderkey) + 2 from lineitem)
                + case when l_linenumber = 7 then l_partkey
                       else (l_orderkey // 100 % 8) * (select count(*) // 8 from part)
                            + l_partkey % (select count(*) // 8 from part) end)::bigint as target,
               count(*) as value
        from lineitem group by 1, 2, 3""",
    ),
    "nodes_dense": (
        ("edges_dense",),
        "select distinct topology, unnest([source, target]) as id from edges_dense",
    ),
    "assignment": (
        ("nodes_dense",),
        """
        select topology, id as task_id, (id // 3 % 4)::int as part from nodes_dense where id % 7 <> 0""",
    ),
    "partial_assignment": (("assignment",), "select * from assignment where topology <> '5-LOW'"),
    "schedule_versions": (
        (),
        f"""
        select topology, ts,
               array_to_string(list_transform(range(1, {LINES_PER_VERSION + 1}),
                                              lambda i: ((i + n) % 4)::varchar), chr(10)) as text
        from (select 'topo' || (event_id % 3) as topology, date_trunc('hour', ts)::timestamp as ts, count(*) as n
              from events group by 1, 2)""",
    ),
    "schedule_reports": (
        (),
        f"""
        select 'topo' || (event_id % 3) as topology, ts, event_id as id,
               array_to_string(list_transform(range(1, {LINES_PER_VERSION + 1}),
                                              lambda i: ((i + day(ts) // 3) % 4)::varchar), chr(10)) as text
        from events""",
    ),
    "executors": (
        (),
        """
        select topology, start_task,
               case when start_task % 50 = 30 then start_task + 1 else start_task end as end_task,
               'c' || (start_task % 4) as component
        from (select distinct o_orderpriority as topology, o_custkey - 2 as start_task from orders)""",
    ),
    "supervisors": (
        (),
        """
        select s_suppkey as id, s_name as host, s_suppkey % 10 = 9 as blacklisted,
               s_nationkey % 4 as assignable_slots, (s_suppkey % 3)::int as used_ports
        from supplier""",
    ),
    "keyed": (
        (),
        """
        select user_id as source, ts, event_id as id, md5(user_id::varchar) as keyfield,
               repeat(md5(user_id::varchar), 4) as payload
        from events""",
    ),
    "words": ((), "select doc_id, unnest(string_split(text, ' ')) as word from documents"),
}


def with_lenses(body: str, *names: str) -> str:
    """``body`` preceded by the common table expressions it needs."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for base in SQL[name][0]:
            add(base)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        add(name)
    ctes = ",\n".join(f"{n} as ({SQL[n][1]}\n)" for n in wanted)
    body = body.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{body[15:]}"
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
