"""Documents and lines of the data formats, in pieces of bounded size.

A graph, and a hub's line in a graph file, can be larger than any row may be. Documents therefore
always come as ordered pieces, cut by fixed ranges of ids whatever the size; put together they are
the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowplace.operators.graph import graph_header, id_spine, symmetrise, vertex_weights
from flowplace.operators.metrics import div
from flowplace.operators.projections import without_self_loops

IDS_PER_BLOCK = 4_096  # ids of a piece
# Sections of a send-graph document, in order.
OPENING, NODES, BETWEEN, LINKS, CLOSING = range(5)
# Graph file header format (weights on vertices and edges), log line layout.
HEADER_FORMAT = "%d %d 011 1"
LOG_FORMAT = "\t%d\t%15s:%-4d\t%-20s\t%-11s\t%3d\t"
LOG_NAME_WIDTH = 33


def sendgraph_json(edges: DataFrame, nodes: DataFrame, block: int = IDS_PER_BLOCK) -> DataFrame:
    """Send-graph documents as pieces (topology, section, a, b, text): nodes and links in ascending order.

    Self links only count as nodes. Put together in the order of (section, a, b) the texts are one JSON document per
    topology, at any size: a piece of nodes is a range of ids, a piece of links one source with a range of targets.
    """
    name = F.concat(F.lit('{"name":"'), F.col("id").cast("string"), F.lit('"}'))
    node = nodes.select("topology", F.lit(NODES).alias("section"), div(F.col("id"), block).alias("a"), F.lit(0).cast("bigint").alias("b"), "id", name.alias("entry"))
    link = F.to_json(F.struct(*[F.col(c).cast("bigint").alias(c) for c in ("source", "target", "value")]))
    links = without_self_loops(edges).select(
        "topology", F.lit(LINKS).alias("section"), F.col("source").alias("a"), div(F.col("target"), block).alias("b"), F.col("target").alias("id"), link.alias("entry")
    )
    entries = F.transform(F.array_sort(F.collect_list(F.struct("id", "entry"))), lambda e: e["entry"])
    pieces = node.unionByName(links).groupBy("topology", "section", "a", "b").agg(F.array_join(entries, ",").alias("text"))
    # A comma stands before every piece but the first of its section.
    first = pieces.groupBy("topology", "section").agg(F.min(F.struct("a", "b")).alias("first"))
    lead = F.when(F.struct("a", "b") == F.col("first"), "").otherwise(",")
    body = pieces.join(first, ["topology", "section"]).select("topology", "section", "a", "b", F.concat(lead, "text").alias("text"))
    none = F.lit(0).cast("bigint")
    marks = F.array(*[F.struct(F.lit(n).alias("section"), F.lit(t).alias("text")) for n, t in ((OPENING, '{"nodes":['), (BETWEEN, '],"links":['), (CLOSING, "]}"))])
    frame = nodes.select("topology").distinct().select("topology", F.inline(marks))
    return frame.select("topology", "section", none.alias("a"), none.alias("b"), "text").unionByName(body)


def metis_lines(links: DataFrame, block: int = IDS_PER_BLOCK) -> DataFrame:
    """Graph file lines as pieces (topology, line_no, piece, text).

    Line 0 is the header, line i vertex i: piece -1 is its weight, piece j the neighbours with ids from ``j * block`` on,
    each with the edge's weight, by ascending neighbour. Appended to each other they are the line.
    Edge weights are at least 1, as the format demands.
    """
    first = F.lit(-1).cast("bigint").alias("piece")
    header = graph_header(links).select(
        "topology", F.lit(0).cast("bigint").alias("line_no"), first, F.format_string(HEADER_FORMAT, "n", "m").alias("text")
    )
    weights = vertex_weights(links).select("topology", F.col("id").alias("line_no"), first, F.col("vw").cast("string").alias("text"))
    one = F.transform(
        F.array_sort(F.collect_list(F.struct("nbr", F.greatest("w", F.lit(1)).alias("w")))),
        lambda e: F.concat(F.lit(" "), e["nbr"].cast("string"), F.lit(" "), e["w"].cast("string")),
    )
    body = (
        symmetrise(links)
        .groupBy("topology", F.col("id").alias("line_no"), div(F.col("nbr"), block).alias("piece"))
        .agg(F.array_join(one, "").alias("text"))
    )
    return header.unionByName(weights).unionByName(body)


def every_task(assignment: DataFrame) -> DataFrame:
    """``assignment`` with a row for every task up to the highest: line i of a vector is task i, so gaps need a line.

    A task that nobody placed gets partition ``id mod partitions``, as it would without a line.
    """
    size = assignment.groupBy("topology").agg(F.max("task_id").alias("n"), (F.max("part") + 1).alias("_parts"))
    ids = id_spine(size).select("topology", F.col("id").alias("task_id"))
    rows = ids.join(assignment.select("topology", "task_id", "part"), ["topology", "task_id"], "left")
    filled = F.coalesce("part", F.col("task_id") % F.col("_parts")).cast("int")
    return rows.join(size.select("topology", "_parts"), "topology").select("topology", "task_id", filled.alias("part"))


def partition_vector(assignment: DataFrame, block: int = IDS_PER_BLOCK) -> DataFrame:
    """Vector text (topology, block, text): one partition per line, line i for task i.

    A block holds the lines of a fixed range of task ids; blocks are to be joined by a
    newline, and a topology of up to ``block`` tasks is a single text.
    """
    rows = F.array_sort(F.collect_list(F.struct("task_id", "part")))
    return every_task(assignment).groupBy("topology", div(F.col("task_id") - 1, block).alias("block")).agg(
        F.array_join(F.transform(rows, lambda r: r["part"].cast("string")), "\n").alias("text")
    )


def graphite_lines(series: DataFrame) -> DataFrame:
    """(path, value, epoch) -> ``path value epoch``."""
    return series.select(F.format_string("%s %d %d", "path", "value", "epoch").alias("line"))


def log_line(timestamp: Column) -> Column:
    """Log line of a data point; names are padded and cut to a fixed width."""
    head = F.format_string(LOG_FORMAT, timestamp, "worker_host", "worker_port", "topology", "component", "task_id")
    value = F.coalesce(F.col("value").cast("string"), F.lit("null"))
    return F.concat(head, F.rpad("name", LOG_NAME_WIDTH, " "), F.lit("\t"), value)


def metrics_log_lines(points: DataFrame) -> DataFrame:
    return points.select(log_line(F.unix_seconds("ts")).alias("line"))


def write_lines(
    lines: DataFrame, path: str, order: list[str], text: Column, separator: str = "\n"
) -> None:
    """Text files per topology whose content, read in file order, is in ``order``.

    Ranges of (topology, order) are written in parallel; no task holds a whole document.
    """
    (
        lines.repartitionByRange("topology", *order)
        .sortWithinPartitions("topology", *order)
        .select("topology", text.alias("value"))
        .write.partitionBy("topology")
        .option("lineSep", separator)
        .text(path)
    )


def write_partition_vector(assignment: DataFrame, path: str) -> None:
    """One line per task, in task order and without gaps, in a folder per topology."""
    write_lines(every_task(assignment), path, ["task_id"], F.col("part").cast("string"))


def write_metis(links: DataFrame, path: str, block: int = IDS_PER_BLOCK) -> None:
    """Graph files, one folder per topology, in pieces of lines: no row holds a hub's line.

    Rows are separated by the blank that separates numbers, and each line but the first
    begins with its line break; so lines end in a blank, which readers of the format skip.
    """
    starts_line = (F.col("piece") < 0) & (F.col("line_no") > 0)
    text = F.concat(F.when(starts_line, "\n").otherwise(""), F.ltrim("text"))
    write_lines(metis_lines(links, block), path, ["line_no", "piece"], text, " ")


def write_sendgraph_json(edges: DataFrame, nodes: DataFrame, path: str) -> None:
    """One JSON document per topology, its pieces separated by blanks."""
    write_lines(sendgraph_json(edges, nodes), path, ["section", "a", "b"], F.col("text"), " ")
