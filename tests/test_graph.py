import glob
import random

import pytest
from pyspark.sql import functions as F

from flowplace.operators import graph as g
from flowplace.operators import partition as p
from flowplace.operators import quality as q
from flowplace.operators import volume as vol
from flowplace.session import materialise, shared_dir

EDGE = "topology string, source int, target int, value bigint"


def one_by_one(links):
    """Add links in (source, target) order, leaving a reverse weight of 1 where there is none."""
    weights = {}
    for s, t, v in sorted(links):
        if s != t:
            weights[s, t] = weights.get((s, t), 0) + v
            if weights.get((t, s), 0) == 0:
                weights[t, s] = 1
    return weights


@pytest.mark.parametrize("seed", range(3))
def test_symmetrise(spark, rows, seed):
    rng = random.Random(seed)
    links = {(rng.randrange(1, 7), rng.randrange(1, 7)): rng.randrange(0, 4) for _ in range(14)}
    links = [(s, t, v) for (s, t), v in links.items()]
    frame = spark.createDataFrame([("x", *link) for link in links], EDGE)
    expected = one_by_one(links)
    # A one-way link of weight 0 keeps it; the others are what the additions leave.
    assert rows(g.symmetrise(frame), "id", "nbr", "w") == sorted((a, b, w) for (a, b), w in expected.items())
    both = {(a, b): w + expected[b, a] for (a, b), w in expected.items()}
    assert rows(g.undirected(frame), "id", "nbr", "w") == sorted((a, b, w) for (a, b), w in both.items())


def test_gaps_and_trailing_nodes(spark, rows):
    edges = spark.createDataFrame([("x", 1, 5, 3), ("x", 9, 9, 4)], EDGE)
    nodes = spark.createDataFrame([("x", 1), ("x", 5), ("x", 7), ("x", 9)], "topology string, id int")
    links = edges.filter("source <> target")
    assert rows(g.vertex_weights(links), "id", "vw") == [(1, 4), (2, 1), (3, 1), (4, 1), (5, 4)]
    assert rows(g.graph_header(links), "n", "m") == [(5, 1)]
    assert rows(g.isolated_nodes(nodes, edges), "id") == [(7,), (9,)]


def test_header_counts_pairs_once(spark, rows):
    links = spark.createDataFrame([("x", 1, 2, 1), ("x", 2, 1, 1), ("x", 3, 3, 1)], EDGE)
    assert rows(g.graph_header(links), "n", "m") == [(3, 1)]


def test_spine_spans_blocks(spark, monkeypatch):
    monkeypatch.setattr(g, "SPINE_BLOCK", 10)
    header = spark.createDataFrame([("a", 25), ("b", 10), ("c", 1)], "topology string, n int")
    got = g.id_spine(header).groupBy("topology").agg(F.count("*").alias("n"), F.countDistinct("id").alias("d"), F.max("id").alias("m"))
    assert sorted(tuple(r) for r in got.collect()) == [("a", 25, 25, 25), ("b", 10, 10, 10), ("c", 1, 1, 1)]


def test_empty_graph(spark):
    none = spark.createDataFrame([], EDGE)
    assert g.vertex_weights(none).isEmpty() and g.symmetrise(none).isEmpty() and g.graph_header(none).isEmpty()


def planted(spark, groups=4, size=30, seed=1):
    rng = random.Random(seed)
    links = {}
    for name in ("a", "b"):
        for _ in range(groups * size * 3):
            s = rng.randrange(groups * size)
            t = rng.randrange(groups * size) if rng.random() < 0.1 else s // size * size + rng.randrange(size)
            # Shuffle ids so that groups are not contiguous.
            links[name, s * 37 % (groups * size) + 1, t * 37 % (groups * size) + 1] = rng.randrange(1, 5)
    return spark.createDataFrame([(*k, v) for k, v in links.items()], EDGE).filter("source <> target")


def cut_of(adjacency, assignment):
    label = {(r["topology"], r["task_id"]): r["part"] for r in assignment.collect()}
    cut = {}
    for r in adjacency.collect():
        name = r["topology"]
        cut.setdefault(name, 0)
        if r["id"] < r["nbr"] and label[name, r["id"]] != label[name, r["nbr"]]:
            cut[name] += r["w"]
    return cut


def test_partition_invariants(spark):
    links, k = planted(spark).cache(), 4
    vertices, adjacency = g.vertex_weights(links).cache(), g.undirected(links).cache()
    got = p.partition_graph(vertices, p.lay_out(adjacency), k).cache()
    assert got.count() == vertices.count() == got.select("topology", "task_id").distinct().count()
    assert got.filter("part < 0 or part >= 4").isEmpty()
    start = cut_of(adjacency, p.round_robin_partition(vertices, k))
    end = cut_of(adjacency, got)
    assert all(end[n] < start[n] for n in start)
    load, total, heaviest = {}, {}, {}
    weights = {(r["topology"], r["id"]): r["vw"] for r in vertices.collect()}
    for r in got.collect():
        key = r["topology"]
        load[key, r["part"]] = load.get((key, r["part"]), 0) + weights[key, r["task_id"]]
        total[key] = total.get(key, 0) + weights[key, r["task_id"]]
    begin = {}
    for r in p.round_robin_partition(vertices, k).collect():
        begin[r["topology"], r["part"]] = begin.get((r["topology"], r["part"]), 0) + weights[r["topology"], r["task_id"]]
    for (name, part), weight in load.items():
        capacity = -(-total[name] * 110 // (100 * k))
        assert weight <= max(capacity, begin[name, part])


def test_kept_weights_follow_the_labels(spark, rows):
    """Differences sent along the edges leave the same weights as looking at all edges again."""
    links = planted(spark, seed=5).cache()
    hub = spark.createDataFrame([("a", 1, i, 2) for i in range(2, 120)], EDGE)
    links = links.unionByName(hub).groupBy("topology", "source", "target").agg(F.max("value").alias("value")).cache()
    vertices, adjacency = g.vertex_weights(links).cache(), p.lay_out(g.undirected(links))
    state = p._initial(vertices, adjacency, p.round_robin_partition(vertices, 4), 4, 10)
    judged = None
    for n in range(3):
        judged = p._judge(state, judged, "cut")
        state = p._round(state, adjacency, judged, n, 4)
    labels = state.select("topology", F.col("id").alias("task_id"), "part")
    fresh = p._initial(vertices, adjacency, labels, 4, 10)
    columns = ("topology", "id", "part", "own", "target", "gain", "spread")
    assert rows(state, *columns) == rows(fresh, *columns)


def test_many_parts_and_volume(spark):
    links = planted(spark, groups=8, size=40, seed=3).filter("topology = 'a'").cache()
    vertices, adjacency = g.vertex_weights(links).cache(), p.lay_out(g.undirected(links))
    start = p.round_robin_partition(vertices, 128)
    volume = lambda parts: sum(r["volume"] for r in q.communication_volume(q.edge_partitions(links, parts)).collect())
    got = p.partition_graph(vertices, adjacency, 128, patience=1, measure="volume").cache()
    assert got.count() == vertices.count() and got.filter("part < 0 or part >= 128").isEmpty()
    assert volume(got) < volume(start)


def test_edges_stay_where_they_are(spark, rows, monkeypatch):
    """Labels go to the edges: with broadcasts off there is one exchange, of the labels; a hub's edges lie over several salts."""
    monkeypatch.setattr(p, "HUB", 20)
    links = planted(spark).unionByName(spark.createDataFrame([("a", 1, i, 2) for i in range(200, 3000)], EDGE)).cache()
    adjacency = g.undirected(links).cache()
    edges = p.lay_out(adjacency)
    assert edges.hubs is not None and edges.rows.filter("topology = 'a' and nbr = 1").select("salt").distinct().count() > 1
    sent = spark.createDataFrame([("a", 1, 7), ("a", 2, 8), ("b", 3, 9)], "topology string, nbr int, said int")
    heard = p.along(edges, sent)
    assert rows(heard, "topology", "id", "nbr", "w", "said") == rows(adjacency.join(sent, ["topology", "nbr"]), "topology", "id", "nbr", "w", "said")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        monkeypatch.setattr(p, "HUB", 10_000)
        plain = p.lay_out(adjacency)
        plan = p.along(plain, materialise(sent))._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1, plan


def test_rounds_leave_vertices_where_they_are(spark):
    """A round shuffles neither edges nor vertices and sorts no edges; one table of vertices is left, however many rounds there were."""
    links = planted(spark).cache()
    vertices, edges = g.vertex_weights(links).cache(), p.lay_out(g.undirected(links))
    state = p._initial(vertices, edges, p.round_robin_partition(vertices, 4), 4, 10)
    sent = materialise(state.select("topology", F.col("id").alias("nbr"), "part"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        plan = p.along(edges, sent, narrow=True)._jdf.queryExecution().executedPlan().toString()
        beside = state.join(sent.withColumnRenamed("nbr", "id").drop("part").hint("shuffle_hash"), ["topology", "id"], "left")
        assert beside._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "Sort " not in plan and "SortMergeJoin" not in plan and plan.count("Exchange") == 1, plan
    tables = lambda: set(glob.glob(f"{shared_dir(spark)}/flowplace/labels-*"))
    old = tables()
    p.propagate(vertices, edges, 4, rounds=3)
    assert len(tables() - old) == 1


def test_columns_and_maps_agree(spark, rows, monkeypatch):
    """What a vertex has towards few partitions is kept in columns, else in a map; labels are the same. Labels beyond k take the map."""
    links = planted(spark, seed=9).cache()
    vertices, edges = g.vertex_weights(links).cache(), p.lay_out(g.undirected(links))
    cut = p.propagate(vertices, edges, 4, rounds=3)
    volume = vol.seek_volume(vertices, edges, cut, 4, rounds=2)
    found = rows(cut), rows(volume)
    monkeypatch.setattr(p, "WIDE", 0)
    assert rows(p.propagate(vertices, edges, 4, rounds=3)) == found[0]
    assert rows(vol.seek_volume(vertices, edges, cut, 4, rounds=2)) == found[1]
    monkeypatch.undo()
    strange = vertices.select("topology", F.col("id").alias("task_id"), (F.col("id") % 6).cast("int").alias("part"))
    assert not p.Towards.of(p._initial(vertices, edges, strange, 4, 10)).wide


def volume_of(edges, label):
    """Volume by looking at every vertex."""
    beside = {}
    for a, b in edges:
        beside.setdefault(a, set()).add(label[b])
    return sum(len(parts - {label[a]}) for a, parts in beside.items())


def test_volume_gain_is_what_a_move_brings(spark):
    links = planted(spark, seed=11).filter("topology = 'a'").cache()
    vertices, adjacency = g.vertex_weights(links).cache(), g.undirected(links).cache()
    ends = [(r["id"], r["nbr"]) for r in adjacency.collect()]
    edges = p.lay_out(adjacency)
    start = p.round_robin_partition(vertices, 4)
    counted = p.Edges(edges.rows.withColumn("w", F.lit(1).cast("bigint")), edges.hubs)
    state = p._initial(vertices, counted, start, 4, 10).select(*vol.STATE)
    label = {r["id"]: r["part"] for r in state.collect()}
    before = volume_of(ends, label)
    moves = [r for r in vol.gains(state, edges).collect() if r["target"] != r["part"]]
    assert len(moves) > 50
    for r in moves:
        assert before - volume_of(ends, {**label, r["id"]: r["target"]}) == r["gain"]
        others = [before - volume_of(ends, {**label, r["id"]: t}) for t in {label[b] for a, b in ends if a == r["id"]} - {r["part"]}]
        assert max(others) == r["gain"]


def test_seeking_volume_goes_below_the_cut_run(spark):
    links = planted(spark, groups=6, size=50, seed=4).cache()
    vertices, edges = g.vertex_weights(links).cache(), p.lay_out(g.undirected(links))
    volume = lambda parts: {r["topology"]: r["volume"] for r in q.communication_volume(q.edge_partitions(links, parts)).collect()}
    cut = p.partition_graph(vertices, edges, 6, patience=2).cache()
    got = vol.seek_volume(vertices, edges, cut, 6).cache()
    assert got.count() == vertices.count() and got.filter("part < 0 or part >= 6").isEmpty()
    old, new = volume(cut), volume(got)
    assert all(new[n] <= old[n] for n in old) and sum(new.values()) < sum(old.values())
    none = vertices.filter("false")
    assert vol.seek_volume(none, p.lay_out(g.undirected(links.filter("false"))), p.round_robin_partition(none, 6), 6, rounds=1).count() == 0


def test_quality_of_known_partition(spark, rows):
    # Two triangles and one bridge of weight 5.
    links = [(1, 2, 1), (2, 3, 1), (3, 1, 1), (4, 5, 1), (5, 6, 1), (6, 4, 1), (3, 4, 5)]
    edges = spark.createDataFrame([("x", *link) for link in links], EDGE)
    parts = spark.createDataFrame([("x", i, 0 if i < 4 else 1) for i in range(1, 7)], "topology string, task_id int, part int")
    labelled = q.edge_partitions(edges, parts)
    assert rows(q.cut_summary(labelled), "total_weight", "remote_weight", "remote_ppm") == [(11, 5, 454545)]
    assert rows(q.communication_volume(labelled), "volume") == [(2,)]
    load = q.partition_load(g.vertex_weights(edges), parts)
    assert rows(load, "part", "load", "tasks") == [(0, 14, 3), (1, 14, 3)]
    assert rows(q.imbalance(load), "imbalance_ppm") == [(1_000_000,)]
    apart = q.edge_partitions(edges, parts.withColumn("part", F.lit(0)))
    assert rows(q.communication_volume(apart), "volume") == [(0,)]


def test_best_of_starts_prefers_lower_cut(spark):
    links = planted(spark, seed=9).cache()
    vertices, adjacency = g.vertex_weights(links).cache(), g.undirected(links).cache()
    layout = p.lay_out(adjacency)
    best = cut_of(adjacency, p.best_of_starts(vertices, layout, 4))
    tried = [
        cut_of(adjacency, p.partition_graph(vertices, layout, 4, start=begin))
        for begin in (None, p.hash_partition(vertices, 4))
    ]
    assert all(best[n] in (tried[0][n], tried[1][n]) for n in best)


def test_links_by_width(spark, rows):
    links = spark.createDataFrame([("x", 1, 2, 5), ("x", 2, 3, 0), ("x", 3, 4, 9), ("y", 1, 2, 0)], EDGE)
    expected = [("x", 1, 9, 9), ("x", 2, 5, 5), ("x", 3, 0, 1), ("y", 1, 0, 1)]
    assert rows(g.links_by_width(links, 3), "topology", "rank", "value", "width") == expected
