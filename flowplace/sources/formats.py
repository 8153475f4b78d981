"""Readers: recorded reports, graph documents, partition vectors, counters, interface tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowplace import schemas
from flowplace.functions import be_long, edge_ends
from flowplace.functions.columns import config_value
from flowplace.operators.metrics import div
from flowplace.session import materialise

# Physical interfaces, and where their byte counts stand in a line (from 0).
INTERFACE = "en[0-9]+"
IN_FIELD, OUT_FIELD = 6, 9
EMITTED = "emitted_messages"
WORDS_PER_CHUNK = 4_096  # of a graph file, between blanks


def explode_reports(reports: DataFrame) -> DataFrame:
    """One row per data point of each task report."""
    by_task = F.transform_keys("point.value_map", lambda task, count: task.cast("bigint")).alias("value_map")
    return reports.withColumn("point", F.explode("points")).select(
        *[c for c in reports.columns if c != "points"], "point.name", "point.value", by_task
    )


def parse_reports(lines: DataFrame, column: str = "json") -> DataFrame:
    """Reports given as JSON text in ``column``."""
    return explode_reports(lines.select(F.from_json(column, schemas.TASK_REPORT).alias("r")).select("r.*"))


def read_datapoints(spark: SparkSession, path: str) -> DataFrame:
    """Data points of JSON report files."""
    return explode_reports(spark.read.schema(schemas.TASK_REPORT).json(path))


def stream_datapoints(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream over a folder that keeps receiving files."""
    return explode_reports(spark.readStream.schema(schemas.TASK_REPORT).json(path))


def edge_values(points: DataFrame) -> DataFrame:
    """Message counts of a report as edge updates: the reporting task is the source."""
    return points.filter(F.col("name") == EMITTED).select(
        "topology", "ts", "id", F.col("task_id").alias("source"), F.explode("value_map").alias("target", "value")
    )


def _parsed(docs: DataFrame, column: str) -> DataFrame:
    return docs.select("topology", F.from_json(column, schemas.SENDGRAPH_DOC).alias("doc"))


def sendgraph_links(docs: DataFrame, column: str = "json") -> DataFrame:
    """Links of send-graph documents; a graph may come in several documents."""
    return _parsed(docs, column).select("topology", F.inline("doc.links"))


def sendgraph_nodes(docs: DataFrame, column: str = "json") -> DataFrame:
    return _parsed(docs, column).select("topology", F.explode("doc.nodes.name").alias("name")).select(
        "topology", F.col("name").cast("bigint").alias("id")
    )


def _piece_entries(pieces: DataFrame, field: str, opening: str) -> DataFrame:
    """The entries of pieces whose text begins like an entry of ``field``, with or without a comma before it."""
    whole = F.concat(F.lit(f'{{"{field}":['), F.ltrim(F.col("text"), F.lit(",")), F.lit("]}"))
    kept = pieces.filter(F.ltrim(F.col("text"), F.lit(",")).startswith(opening))
    return _parsed(kept.select("topology", whole.alias("json")), "json").select("topology", F.inline(f"doc.{field}"))


def sendgraph_piece_links(pieces: DataFrame) -> DataFrame:
    """Links of send-graph documents that come in pieces (topology, text), in any order."""
    return _piece_entries(pieces, "links", '{"source"')


def sendgraph_piece_nodes(pieces: DataFrame) -> DataFrame:
    names = _piece_entries(pieces, "nodes", '{"name"')
    return names.select("topology", F.col("name").cast("bigint").alias("id"))


def split_lines(docs: DataFrame, column: str) -> DataFrame:
    """Documents as (topology, line_no from 0, line)."""
    return docs.select("topology", F.posexplode(F.split(column, "\n")).alias("line_no", "line"))


def pairs(numbers: Column) -> Column:
    """(nbr, w) of each two consecutive numbers; NULL if there are not two."""
    found = F.transform(
        F.sequence(F.lit(0), F.size(numbers) - 2, F.lit(2)),
        lambda i: F.struct(F.get(numbers, i).cast("bigint").alias("nbr"), F.get(numbers, i + 1).cast("bigint").alias("w")),
    )
    return F.when(F.size(numbers) >= 2, found)


def line_pieces(lines: DataFrame) -> DataFrame:
    """Whole graph file lines (topology, line_no, line) as pieces: -1 the header or a vertex's weight, 0 its neighbours."""
    numbers = F.split(F.trim("line"), " +", 2)
    header = F.col("line_no") == 0
    parts = F.array(
        F.struct(F.lit(-1).cast("bigint").alias("piece"), F.when(header, F.trim("line")).otherwise(numbers[0]).alias("text")),
        F.struct(F.lit(0).cast("bigint").alias("piece"), F.when(~header, F.get(numbers, 1)).alias("text")),
    )
    return lines.select("topology", F.col("line_no").cast("bigint").alias("line_no"), F.inline(parts)).filter(F.col("text").isNotNull())


def metis_vertices(pieces: DataFrame) -> DataFrame:
    """Vertex weights: piece -1 of every line but the header; line number = id."""
    weights = pieces.filter((F.col("line_no") > 0) & (F.col("piece") < 0))
    return weights.select("topology", F.col("line_no").alias("id"), F.trim("text").cast("bigint").alias("vw"))


def metis_adjacency(pieces: DataFrame) -> DataFrame:
    """(id, nbr, w) of the other pieces; a hub's entries come from as many rows as its line has pieces."""
    entries = pieces.filter((F.col("line_no") > 0) & (F.col("piece") >= 0))
    return entries.select("topology", F.col("line_no").alias("id"), F.inline(pairs(F.split(F.trim("text"), " +"))))


def metis_header(pieces: DataFrame) -> DataFrame:
    head = F.split(F.trim("text"), " +")
    return pieces.filter(F.col("line_no") == 0).select(
        "topology", head[0].cast("bigint").alias("n"), head[1].cast("bigint").alias("m")
    )


def read_partition_vector(docs: DataFrame, column: str = "text") -> DataFrame:
    """(task_id, part): line i holds the partition of task i, counting from 1."""
    return (
        split_lines(docs, column)
        .filter(F.col("line") != "")
        .select("topology", (F.col("line_no") + 1).cast("bigint").alias("task_id"), F.trim("line").cast("int").alias("part"))
    )


def read_vector_blocks(blocks: DataFrame, block_size: int) -> DataFrame:
    """The same from vectors that come in blocks of ``block_size`` lines."""
    lines = blocks.select("topology", "block", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    task = F.col("block") * block_size + F.col("line_no") + 1
    return lines.select("topology", task.alias("task_id"), F.trim("line").cast("int").alias("part"))


def read_text_pieces(spark: SparkSession, path: str, separator: str = " ") -> DataFrame:
    """(topology, text) of the files in ``topology=…`` folders, cut at a separator, in no order."""
    text = spark.read.schema("value string, topology string").option("lineSep", separator).text(path)
    return text.select("topology", F.col("value").alias("text"))


def _numbers(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda n: n != "")


def read_metis(spark: SparkSession, path: str, words: int = WORDS_PER_CHUNK) -> DataFrame:
    """Graph files in ``topology=…`` folders as pieces (topology, line_no, piece, text), as ``line_pieces`` gives whole lines.

    The files of a folder are one text in name order, so a line may be of any length and go on in the next file: only line breaks
    end it. Text is read from blank to blank and put together in chunks of so many words of a block of a file. What earlier chunks come to, a row each,
    says in which line and at which number of it a chunk begins; a pair that two chunks share belongs to the first.
    """
    cut = spark.read.schema("value string, topology string").option("lineSep", " ").text(path).select(
        "topology",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("seq"),
        "value",
    )
    place = ["file", "start", "chunk"]
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda w: w["value"])
    chunks = materialise(
        cut.groupBy("topology", "file", "start", div(F.col("seq"), words).alias("chunk")).agg(F.array_join(ordered, " ").alias("text")), "chunks"
    )
    lines = F.split("text", "\n")
    opening = _numbers(lines[0])
    sizes = chunks.select(
        "topology",
        *place,
        (F.size(lines) - 1).cast("bigint").alias("breaks"),
        F.get(opening, F.lit(0)).alias("first"),
        F.size(_numbers(F.element_at(lines, -1))).cast("bigint").alias("last"),  # numbers after the last line break
    ).filter("breaks > 0 or last > 0")
    order = Window.partitionBy("topology").orderBy(*place)
    in_line = Window.partitionBy("topology", "opened").orderBy(*place)
    begins = (
        sizes.withColumn("opened", F.sum(F.when(F.col("breaks") > 0, 1).otherwise(0)).over(order))
        .withColumn("upto", F.sum("last").over(in_line))
        .select(
            *place,
            "breaks",
            (F.sum("breaks").over(order) - F.col("breaks")).alias("begin"),
            F.lag("upto", 1, 0).over(order).alias("before"),
            F.lead("first").over(order).alias("next"),
        )
    )
    found = chunks.join(begins, place).select("topology", "breaks", "begin", "before", "next", F.posexplode(lines).alias("n", "line"))
    found = found.select(
        "topology",
        (F.col("begin") + F.col("n")).alias("line_no"),
        F.when(F.col("n") == 0, F.col("before")).otherwise(0).alias("at"),  # numbers of the line in earlier chunks
        _numbers(F.col("line")).alias("own"),
        F.when(F.col("n") == F.col("breaks"), F.col("next")).alias("next"),
    ).filter(F.size("own") > 0)
    known = F.when(F.col("next").isNull(), F.col("own")).otherwise(F.concat("own", F.array("next")))
    found = found.withColumn("known", known)
    # The line's first number is the vertex's weight; after it the numbers at odd places are neighbours.
    skip = F.when(F.col("at") == 0, 1).otherwise((F.col("at") + 1) % 2).cast("int")
    whole = div(F.size("known") - skip, 2).cast("int") * 2
    header, opens = F.col("line_no") == 0, F.col("at") == 0
    text = F.array_join(F.slice("known", skip + 1, F.greatest(whole, F.lit(0))), " ")
    parts = F.array(
        F.struct(
            F.lit(-1).cast("bigint").alias("piece"),
            F.when(opens & header, F.array_join("known", " ")).when(opens, F.get("own", F.lit(0))).alias("text"),
        ),
        F.struct(F.col("at").alias("piece"), F.when(~header & (whole > 0), text).alias("text")),
    )
    return found.select("topology", "line_no", F.inline(parts)).filter(F.col("text").isNotNull())


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(topology, line_no from 0, line) of the text files in ``topology=…`` folders.

    Files count in name order and are read in blocks: lines are numbered inside their block,
    and a block starts at the number of lines in the blocks before it.
    """
    text = spark.read.schema("value string, topology string").text(path).select(
        "topology",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("line"),
    )
    block = ["topology", "file", "start"]
    earlier = Window.partitionBy("topology").orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    sizes = text.groupBy(*block).agg(F.count(F.lit(1)).alias("lines"))
    starts = sizes.select(*block, F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy(*block).orderBy("seq")) - 1
    return text.join(starts, block).select("topology", (F.col("first") + inside).alias("line_no"), "line")


def read_counters(files: DataFrame) -> DataFrame:
    """(path, data) of binary counters -> (path, source, target, value)."""
    source, target = edge_ends(F.col("path"))
    return files.select("path", source.alias("source"), target.alias("target"), be_long(F.col("data")).alias("value"))


def parse_netstat(lines: DataFrame) -> DataFrame:
    """Byte counts of the physical interfaces in captured interface tables."""
    part = F.split("line", r"\s+")
    return lines.filter(F.col("line").rlike(rf"^{INTERFACE}(\s|$)")).select(
        "host",
        "snapshot_ts",
        "line_no",
        part[0].alias("iface"),
        part[IN_FIELD].cast("bigint").alias("in_bytes"),
        part[OUT_FIELD].cast("bigint").alias("out_bytes"),
    )


def topology_config(config: DataFrame, key: str, kind: str, default, name: str) -> DataFrame:
    """Typed value of one setting per topology, with a default."""
    return config.select("topology", config_value(F.col("conf"), key, kind, default).alias(name))
