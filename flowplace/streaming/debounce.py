"""When graphs are published: after a silence, and by a rule that bounds how long updates can put that off.

The rule with a longest wait is a chain: a publication at some tick's time plus the silence decides which
tick the next one follows. The tick after next, and so on, are found by doubling steps, so a graph's chain is followed in as many
rounds as its length has binary digits, over all graphs at once, and no graph's ticks meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowplace.operators.metrics import GRAPH_SECS
from flowplace.operators.ordered import cut, finish, numbered, previous, running
from flowplace.session import materialise

# Fixed value: seconds of silence after which a graph is published.
SILENCE_SECS = 5


def spans(updates: DataFrame, silence_secs: int = SILENCE_SECS) -> DataFrame:
    """First and last update and their number per graph and tick of the silence."""
    tick = F.window("ts", f"{silence_secs} seconds")
    found = updates.groupBy("topology", tick.alias("w")).agg(
        F.min("ts").alias("ts"), F.max("ts").alias("until"), F.count(F.lit(1)).alias("updates")
    )
    return found.select("topology", F.col("w.start").alias("tick"), "ts", "until", "updates")


def sessions(found: DataFrame, silence_secs: int = SILENCE_SECS, slices: int | None = None) -> DataFrame:
    """Spans that are no more than the silence apart, as one publication each.

    A busy graph's spans are numbered in slices, not brought into one task.
    """
    pieces = cut(found, ["topology"], ["ts"], slices)
    pieces = previous(pieces, ["topology"], ["ts"], {"_until": F.col("until")}, "_known")
    gap = F.unix_micros("ts") - F.unix_micros("_until")
    opens = F.when(F.col("_known") & (gap <= silence_secs * 1_000_000), 0).otherwise(1)
    numbered_spans = finish(running(pieces, ["topology"], ["ts"], {"_session": opens}))
    whole = numbered_spans.groupBy("topology", "_session").agg(
        F.min("ts").alias("first_update"), F.max("until").alias("_last"), F.sum("updates").alias("updates")
    )
    published = F.col("_last") + F.make_dt_interval(secs=F.lit(silence_secs))
    return whole.select("topology", "first_update", published.alias("published"), "updates")


def publish_sessions(updates: DataFrame, silence_secs: int = SILENCE_SECS, slices: int | None = None) -> DataFrame:
    """When each graph is published: after ``silence_secs`` without an update."""
    return sessions(spans(updates, silence_secs), silence_secs, slices)


def ticks(updates: DataFrame) -> DataFrame:
    """Distinct milliseconds of each graph's updates, with their number."""
    return updates.groupBy("topology", F.unix_millis("ts").alias("ms")).agg(F.count(F.lit(1)).alias("updates"))


def publish_times(
    found: DataFrame, silence_secs: int = SILENCE_SECS, interval_secs: int = GRAPH_SECS, slices: int | None = None
) -> DataFrame:
    """(topology, published_ms) from the ticks of graphs.

    An update puts a pending publication off to ``silence`` after itself, but only as long as the last publication
    is less than ``interval`` ago (or there was none); the last pending one is published too.
    """
    silence, interval = silence_secs * 1_000, interval_secs * 1_000
    graph = ["topology"]
    line = materialise(numbered(found.select("topology", "ms"), graph, ["ms"], "n", slices), "ticks")
    # Runs of ticks less than the silence apart, and the number of each run's last tick.
    pieces = previous(cut(line, graph, ["n"], slices), graph, ["n"], {"_ms": F.col("ms")}, "_known")
    opens = F.when(F.col("_known") & (F.col("ms") - F.col("_ms") < silence), 0).otherwise(1)
    runs = materialise(finish(running(pieces, graph, ["n"], {"run": opens})).drop("_ms", "_known"), "ticks")
    ends = runs.groupBy("topology", "run").agg(F.max("n").alias("end"))
    placed = materialise(runs.join(ends, ["topology", "run"]).select("topology", "n", "ms", "end"), "ticks")
    # How many ticks lie before the publication after a tick, and before the end of the interval from there.
    asked = F.array(
        F.struct(F.col("ms").alias("at"), F.lit(1).alias("kind"), F.lit(1).alias("tick")),
        F.struct((F.col("ms") + silence).alias("at"), F.lit(0).alias("kind"), F.lit(0).alias("tick")),
        F.struct((F.col("ms") + silence + interval).alias("at"), F.lit(-1).alias("kind"), F.lit(0).alias("tick")),
    )
    marks = placed.select("topology", "n", F.inline(asked))
    order = ["at", "kind", "n"]
    counted = finish(running(cut(marks, graph, order, slices), graph, order, {"before": F.col("tick")})).filter("tick = 0")
    counts = counted.groupBy("topology", "n").agg(
        F.max(F.when(F.col("kind") == 0, F.col("before"))).alias("start"), F.max(F.when(F.col("kind") == -1, F.col("before"))).alias("reach")
    ).withColumn("start", F.col("start") + 1)
    run_end = placed.select("topology", F.col("n").alias("start"), F.col("end").alias("start_end"))
    after = counts.join(run_end, [*graph, "start"])  # ticks whose publication is the last have no start
    jump = materialise(
        after.select("topology", "n", F.least("start_end", F.greatest("start", "reach")).alias("to")), "jumps"
    )
    jumps = [jump]
    while not jump.isEmpty():
        further = jump.select("topology", F.col("n").alias("to"), F.col("to").alias("_to"))
        jump = materialise(jump.join(further, [*graph, "to"]).select("topology", "n", F.col("_to").alias("to")), "jumps")
        jumps.append(jump)
    reached = placed.filter("n = 1").select("topology", F.col("end").alias("n"))
    for jump in reversed(jumps):
        reached = materialise(reached.unionByName(reached.join(jump, [*graph, "n"]).select("topology", F.col("to").alias("n"))), "chain")
    return reached.join(placed, [*graph, "n"]).select("topology", (F.col("ms") + silence).alias("published_ms"))
