"""Partitions whose moves seek the communication volume: how many other partitions the vertices have neighbours in.

Per vertex and partition the *number of neighbours* there is kept, by differences along the edges of moved vertices. A move's
gain counts the vertex's own partitions and, over its neighbours, those that lose or win a partition by it. Moves are
admitted as in :mod:`partition`: blocks of requests, largest gain first, while they fit the target's capacity.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowplace.operators.ordered import union_all
from flowplace.operators.partition import SLACK_PERCENT, Edges, Towards, _asks, _cutoffs, _initial, along, best_of, write_state
from flowplace.session import discard, materialise

ROUNDS = 6
STATE = ["topology", "id", "vw", "part", "capacity", "id_range", "scores"]


def _move(state: DataFrame, edges: Edges, round_no: int, k: int) -> DataFrame:
    """``state`` (with target and gain) after one round: requests that fit are granted and the changed labels sent over the edges."""
    shape = Towards.of(state)
    cutoffs = materialise(_cutoffs(state, round_no, k), "cutoffs")
    granted = _asks(round_no, k) <= F.col("cutoff")
    moved = state.join(cutoffs, ["topology", "target"], "left").withColumn("new_part", F.when(granted, F.col("target")).otherwise(F.col("part")))
    changed = moved.filter(F.col("new_part") != F.col("part")).select("topology", F.col("id").alias("nbr"), "part", "new_part")
    change = shape.summed(along(edges, changed, narrow=True), F.lit(1).cast("bigint"), "new_part", "part")
    following = moved.join(change.hint("shuffle_hash") if shape.wide else change, ["topology", "id"], "left")
    return following.select("topology", "id", "vw", F.col("new_part").alias("part"), "capacity", "id_range", shape.added())


def _heard(state: DataFrame, edges: Edges, shape: Towards) -> DataFrame:
    """What a vertex hears from its neighbours, per partition: how many are in it or touch it (``has``) and to how many of them a single
    neighbour gives it (``lone``). Columns has_0, lone_0, ... or a map ``heard``."""
    if shape.wide:  # a vertex sends its partitions as bits
        bits = lambda flags: reduce(add, [F.when(f, F.lit(1 << p)).otherwise(F.lit(0)).cast("bigint") for p, f in enumerate(flags)])
        seen = [(w != 0) | (F.col("part") == p) for p, w in enumerate(shape.each)]
        single = [(w == 1) & (F.col("part") != p) for p, w in enumerate(shape.each)]
        sent = state.select("topology", F.col("id").alias("nbr"), bits(seen).alias("seen"), bits(single).alias("single"))
        count = lambda c, p: F.sum(F.shiftright(c, p).bitwiseAND(F.lit(1).cast("bigint")))
        sums = [count(c, p).alias(f"{n}_{p}") for p in range(shape.k) for n, c in (("has", "seen"), ("lone", "single"))]
        return along(edges, sent, narrow=True).groupBy("topology", "id").agg(*sums)
    here = F.array_distinct(F.concat(F.map_keys("scores"), F.array("part")))
    lone = lambda p: (F.coalesce(F.try_element_at("scores", p), F.lit(0)) == 1) & (p != F.col("part"))
    sent = state.select("topology", F.col("id").alias("nbr"), F.transform(here, lambda p: F.struct(p.alias("p"), lone(p).cast("bigint").alias("lone"))).alias("seen"))
    heard = along(edges, sent).select("topology", "id", F.inline("seen")).groupBy("topology", "id", "p").agg(F.count("*").alias("has"), F.sum("lone").alias("lone"))
    entries = F.map_from_entries(F.collect_list(F.struct("p", F.struct("has", "lone").alias("v"))))
    return heard.groupBy("topology", "id").agg(entries.alias("heard"))


def gains(state: DataFrame, edges: Edges) -> DataFrame:
    """``state`` with the target and the gain in volume, ``scores`` counting neighbours.

    A vertex of partition a sends its partitions (its own and its neighbours') to every neighbour, and marks those that a single
    neighbour gives it. If that neighbour moves away it loses the marked one; if it moves to b the vertex wins b unless b is among those sent.
    """
    shape = Towards.of(state)
    heard = _heard(state, edges, shape)
    joined = state.join(heard.hint("shuffle_hash") if shape.wide else heard, ["topology", "id"], "left").withColumn("degree", shape.total())
    none = F.lit(0).cast("bigint")
    if shape.wide:
        freed = F.coalesce(*[F.when(F.col("part") == p, F.col(f"lone_{p}")) for p in range(shape.k)], none)
        joined = joined.withColumn("base", (freed - F.col("degree") + 1 - F.when(shape.own() != 0, 1).otherwise(0)).cast("bigint"))
        gain, target = best_of([((w != 0) & (F.col("part") != p), F.col("base") + F.col(f"has_{p}")) for p, w in enumerate(shape.each)])
    else:
        freed = F.coalesce(F.try_element_at("heard", F.col("part"))["lone"], F.lit(0))
        stays = F.when(F.map_contains_key("scores", F.col("part")), 1).otherwise(0)
        others = F.filter(F.map_keys("scores"), lambda p: p != F.col("part"))
        option = lambda p: F.struct(
            (freed - F.col("degree") + F.try_element_at("heard", p)["has"] + 1 - stays).cast("bigint").alias("gain"), (-p).alias("p")
        )
        best = F.array_max(F.transform(others, option))
        gain, target = best["gain"], -best["p"]
    return joined.select(
        *STATE, F.coalesce(target, F.col("part")).alias("target"), F.coalesce(gain, none).alias("gain"), shape.spread().alias("spread")
    )


def seek_volume(
    vertices: DataFrame, edges: Edges, labels: DataFrame, k: int, rounds: int = ROUNDS, slack: int = SLACK_PERCENT
) -> DataFrame:
    """``labels`` (topology, task_id, part) after rounds of moves that bring the communication volume down.

    Each graph gets the labels of its best round, the start included and the earlier of equal ones. A move never lifts a partition above its
    capacity. ``edges`` is undirected, see :func:`partition.lay_out`; its weights play no part.
    """
    counted = Edges(edges.rows.withColumn("w", F.lit(1).cast("bigint")), edges.hubs)
    state = _initial(vertices, counted, labels, k, slack)
    judged = []
    for n in range(rounds):
        judged.append(write_state(gains(state, edges)))
        discard(state)
        state = write_state(_move(judged[n], edges, n, k))
    states = [*judged, state.withColumn("spread", Towards.of(state).spread())]
    amounts = [s.groupBy("topology").agg(F.sum("spread").alias("amount")).withColumn("round", F.lit(n)) for n, s in enumerate(states)]
    best = union_all(amounts).groupBy("topology").agg(F.min_by("round", F.struct("amount", "round")).alias("round"))
    every = union_all([s.select("topology", F.col("id").alias("task_id"), "part", F.lit(n).alias("round")) for n, s in enumerate(states)])
    return every.join(best, ["topology", "round"]).select("topology", "task_id", "part")
