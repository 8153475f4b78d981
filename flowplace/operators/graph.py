"""Send-graph preparation: nodes, weights, symmetric adjacency, chart data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowplace.operators.ordered import numbered
from flowplace.operators.projections import without_self_loops
from flowplace.session import materialise

SPINE_BLOCK = 65_536


def _ends(edges: DataFrame, *keep: str) -> DataFrame:
    return edges.select("topology", F.explode(F.array("source", "target")).alias("id"), *keep)


def graph_nodes(edges: DataFrame) -> DataFrame:
    """Every id at either end of an edge, once."""
    return _ends(edges).distinct()


def isolated_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without a link to another node."""
    linked = _ends(without_self_loops(edges))
    marks = nodes.select("topology", "id", F.lit(0).alias("linked")).unionByName(
        linked.select("topology", "id", F.lit(1).alias("linked")).distinct()
    )
    # One grouping instead of an anti-join: a hub's many ends combine before the shuffle.
    seen = marks.groupBy("topology", "id").agg(F.max("linked").alias("linked"))
    return seen.filter(F.col("linked") == 0).select("topology", "id")


def graph_header(links: DataFrame) -> DataFrame:
    """Per graph: ``n`` = highest id at a link end, ``m`` = unordered pairs of distinct nodes."""
    pairs = links.groupBy("topology", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(
        F.lit(1).alias("_one")
    )
    return pairs.groupBy("topology").agg(
        F.max("b").alias("n"), F.sum(F.when(F.col("a") != F.col("b"), 1).otherwise(0)).alias("m")
    )


def id_spine(header: DataFrame) -> DataFrame:
    """All ids ``1..n`` of each graph. Blocks are spread out before they are unrolled, so a
    large graph's ids do not come out of one task."""
    blocks = header.select(
        "topology",
        F.col("n").cast("bigint").alias("_n"),
        F.explode(
            F.sequence(F.lit(0).cast("bigint"), F.call_function("div", F.col("n") - 1, F.lit(SPINE_BLOCK)))
        ).alias("_block"),
    ).repartition("topology", "_block")
    low = F.col("_block") * SPINE_BLOCK + 1
    ids = F.sequence(low, F.least(F.col("_n"), low + (SPINE_BLOCK - 1)))
    return blocks.select("topology", F.explode(ids).alias("id"))


def vertex_weights(links: DataFrame) -> DataFrame:
    """``1`` + all weight in and out, for every id up to the highest; gaps weigh 1."""
    ends = _ends(without_self_loops(links), "value")
    highest = links.groupBy("topology").agg(F.max(F.greatest("source", "target")).alias("n"))
    spine = id_spine(highest).withColumn("value", F.lit(0).cast("bigint"))
    return (
        ends.unionByName(spine).groupBy("topology", "id").agg((F.sum("value") + 1).alias("vw"))
    )


def _by_pair(links: DataFrame) -> DataFrame:
    """One row per unordered pair a < b with the weight of either direction, NULL if absent."""
    forward = F.col("source") < F.col("target")
    return (
        without_self_loops(links)
        .groupBy("topology", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
        .agg(
            F.sum(F.when(forward, F.col("value"))).alias("ab"),
            F.sum(F.when(~forward, F.col("value"))).alias("ba"),
        )
    )


def _stub_weights() -> tuple[Column, Column]:
    """Weights after links are added in (source, target) order, each leaving a reverse
    weight of 1 where there was none."""
    ab, ba = F.col("ab"), F.col("ba")
    both = ab.isNotNull() & ba.isNotNull()
    out = F.when(both, F.greatest(ab, F.lit(1))).otherwise(F.coalesce(ab, F.lit(1)))
    back = F.when(both, ba + 1).otherwise(F.coalesce(ba, F.lit(1)))
    return out, back


def _both_ways(pairs: DataFrame, out: Column, back: Column) -> DataFrame:
    directed = F.array(
        F.struct(F.col("a").alias("id"), F.col("b").alias("nbr"), out.cast("bigint").alias("w")),
        F.struct(F.col("b").alias("id"), F.col("a").alias("nbr"), back.cast("bigint").alias("w")),
    )
    return pairs.select("topology", F.inline(directed))


def symmetrise(links: DataFrame) -> DataFrame:
    """Adjacency (id, nbr, w) with an entry in both directions of every link.

    One grouping by unordered pair; no self join.
    """
    return _both_ways(_by_pair(links), *_stub_weights())


def undirected(links: DataFrame) -> DataFrame:
    """Adjacency whose two directions carry the same weight: the sum of the symmetrised ones."""
    out, back = _stub_weights()
    return _both_ways(_by_pair(links), out + back, out + back)


def node_flow(edges: DataFrame) -> DataFrame:
    """Per node the larger of what comes in and what goes out."""
    none = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("source").alias("id"), F.col("value").alias("sent"), none.alias("received")),
        F.struct(F.col("target").alias("id"), none.alias("sent"), F.col("value").alias("received")),
    )
    return (
        edges.select("topology", F.inline(sides))
        .groupBy("topology", "id")
        .agg(F.greatest(F.sum("sent"), F.sum("received")).alias("flow"))
    )


def node_positions(nodes: DataFrame, slices: int | None = None) -> DataFrame:
    """0-based position of each node in its graph's ascending node list."""
    ranked = numbered(nodes.select("topology", "id"), ["topology"], ["id"], "_number", slices)
    return ranked.select("topology", "id", (F.col("_number") - 1).alias("position"))


def links_to_index(links: DataFrame, nodes: DataFrame, slices: int | None = None) -> DataFrame:
    """Replace the ids at both link ends by node positions. Hub ids make skewed join keys;
    AQE splits those."""
    at = materialise(node_positions(nodes, slices), "positions")
    source = at.select("topology", F.col("id").alias("source"), F.col("position").alias("source_index"))
    target = at.select("topology", F.col("id").alias("target"), F.col("position").alias("target_index"))
    return links.join(source, ["topology", "source"]).join(target, ["topology", "target"]).select(
        "topology", "source_index", "target_index", "value"
    )


def links_by_width(links: DataFrame, slices: int | None = None) -> DataFrame:
    """All links of each graph with their ``rank``, widest first."""
    thin = links.withColumn("_thin", -F.col("value"))
    ranked = numbered(thin, ["topology"], ["_thin", "source", "target"], "rank", slices)
    return ranked.drop("_thin").withColumn("width", F.greatest(F.col("value"), F.lit(1)))
