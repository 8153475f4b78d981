import glob
import json

import pytest
from pyspark.sql import functions as F

from flowplace.operators import graph as g
from flowplace.operators.projections import require_single_task
from flowplace.sinks import formats as out
from flowplace.sinks.publish import latest_per_key
from flowplace.sources import formats as src

EDGE = "topology string, source bigint, target bigint, value bigint"
LINKS = [("x", 1, 2, 7), ("x", 2, 1, 3), ("x", 1, 6, 0), ("x", 4, 1, 2), ("x", 5, 5, 9), ("y", 2, 3, 1)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(LINKS, EDGE)


def files_of(path, topology):
    return "".join(open(f).read() for f in sorted(glob.glob(f"{path}/topology={topology}/part-*")))


def documents(pieces):
    texts = {}
    for r in sorted(pieces.collect(), key=lambda r: (r["topology"], r["section"], r["a"], r["b"])):
        texts[r["topology"]] = texts.get(r["topology"], "") + r["text"]
    return texts


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_sendgraph_round_trip(spark, edges, rows, block):
    pieces = out.sendgraph_json(edges, g.graph_nodes(edges), block)
    doc = json.loads(documents(pieces)["x"])
    assert [n["name"] for n in doc["nodes"]] == ["1", "2", "4", "5", "6"]
    assert [tuple(link.values()) for link in doc["links"]] == [(1, 2, 7), (1, 6, 0), (2, 1, 3), (4, 1, 2)]
    links = sorted(e for e in LINKS if e[1] != e[2])
    assert rows(src.sendgraph_piece_links(pieces), "topology", "source", "target", "value") == links
    assert rows(src.sendgraph_piece_nodes(pieces)) == rows(g.graph_nodes(edges), "topology", "id")
    whole = spark.createDataFrame(list(documents(pieces).items()), "topology string, json string")
    assert rows(src.sendgraph_links(whole), "topology", "source", "target", "value") == links
    assert rows(src.sendgraph_nodes(whole)) == rows(g.graph_nodes(edges), "topology", "id")


def test_sendgraph_without_links(spark, edges):
    alone = edges.filter("source = target")
    assert json.loads(documents(out.sendgraph_json(alone, g.graph_nodes(alone)))["x"]) == {"nodes": [{"name": "5"}], "links": []}


METIS = ["6 3 011 1", "13 2 7 4 1 6 1", "11 1 4", "1", "3 1 2", "1", "1 1 1"]


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_metis_round_trip(edges, rows, block):
    links = edges.filter("source <> target")
    pieces = out.metis_lines(links, block)
    lines = {}
    for r in sorted(pieces.collect(), key=lambda r: (r["topology"], r["line_no"], r["piece"])):
        key = r["topology"], r["line_no"]
        lines[key] = lines.get(key, "") + r["text"]
    assert [lines["x", i] for i in range(7)] == METIS
    whole = pieces.sparkSession.createDataFrame([(t, i, text) for (t, i), text in lines.items()], "topology string, line_no bigint, line string")
    clamped = g.symmetrise(links).withColumn("w", F.greatest("w", F.lit(1)))
    for doc in (pieces, src.line_pieces(whole)):
        assert rows(src.metis_adjacency(doc)) == rows(clamped, "topology", "id", "nbr", "w")
        assert rows(src.metis_vertices(doc)) == rows(g.vertex_weights(links), "topology", "id", "vw")
        assert rows(src.metis_header(doc)) == [("x", 6, 3), ("y", 3, 1)]


@pytest.mark.parametrize("words", [1, 2, 3, 4096])
def test_graph_file_cut_anywhere(spark, rows, tmp_path, words):
    """A line goes on in the next block and file, whichever number that begins with; a file may begin with a line break."""
    text = "\n".join(METIS)
    entries = [(1, 2, 7), (1, 4, 1), (1, 6, 1), (2, 1, 4), (4, 1, 2), (6, 1, 1)]
    weights = [(1, 13), (2, 11), (3, 1), (4, 3), (5, 1), (6, 1)]
    ends = [i for i, c in enumerate(text) if c in " \n"]
    folders = {f"c{n}_{b}": [text[: n + 1 - b], text[n + 1 - b :]] for n in ends for b in (0, 1)}
    folders["words"] = [w + " " for w in text.replace("\n", " \n").split(" ")]
    for name, files in folders.items():
        (tmp_path / "files" / f"topology={name}").mkdir(parents=True)
        for i, part in enumerate(files):
            (tmp_path / "files" / f"topology={name}" / f"part-{i:03}").write_text(part)
    pieces = src.read_metis(spark, str(tmp_path / "files"), words)
    assert rows(src.metis_adjacency(pieces)) == sorted((name, *e) for name in folders for e in entries)
    assert rows(src.metis_vertices(pieces)) == sorted((name, *w) for name in folders for w in weights)
    assert rows(src.metis_header(pieces)) == sorted((name, 6, 3) for name in folders)


def test_hub_line_in_many_files(spark, rows, tmp_path):
    """A hub's line, written over several files and read in small blocks, comes back whole and in no large row."""
    links = spark.range(2, 3002).select(F.lit("x").alias("topology"), F.lit(1).cast("bigint").alias("source"), F.col("id").alias("target"), F.col("id").alias("value"))
    links = links.unionByName(links.select("topology", F.col("target").alias("source"), (F.col("target") + 1).alias("target"), "value"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        out.write_metis(links, str(tmp_path / "metis"), 64)
        assert len(glob.glob(f"{tmp_path}/metis/topology=x/part-*")) > 1
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        pieces = src.read_metis(spark, str(tmp_path / "metis"), 100)
        assert rows(src.metis_adjacency(pieces)) == rows(g.symmetrise(links), "topology", "id", "nbr", "w")
        assert rows(src.metis_vertices(pieces)) == rows(g.vertex_weights(links), "topology", "id", "vw")
        assert pieces.agg(F.max(F.length("text"))).first()[0] < 2_000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_written_files_are_in_order(spark, edges, tmp_path):
    out.write_metis(edges.filter("source <> target"), str(tmp_path / "metis"), 1)
    text = files_of(tmp_path / "metis", "x")
    assert [line.rstrip() for line in text.split("\n")] == METIS
    parts = spark.range(1, 2001).select(
        F.lit("big").alias("topology"), F.col("id").alias("task_id"), (F.col("id") * 7 % 13).cast("int").alias("part")
    )
    out.write_partition_vector(parts, str(tmp_path / "vector"))
    assert files_of(tmp_path / "vector", "big").split() == [str(i * 7 % 13) for i in range(1, 2001)]
    out.write_sendgraph_json(edges, g.graph_nodes(edges), str(tmp_path / "json"))
    assert len(json.loads(files_of(tmp_path / "json", "x"))["nodes"]) == 5


def test_lines_keep_their_numbers(spark, tmp_path, rows):
    """Files in several blocks: numbers go on from block to block and from file to file."""
    parts = spark.range(1, 3001).select(
        F.lit("big").alias("topology"), F.col("id").alias("task_id"), (F.col("id") * 7 % 1300).cast("int").alias("part")
    )
    out.write_partition_vector(parts, str(tmp_path / "vector"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = src.read_lines(spark, str(tmp_path / "vector"))
        got = lines.select(F.col("line_no") + 1, F.col("line").cast("int"))
        assert rows(got) == rows(parts, "task_id", "part")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_partition_vector_blocks(spark, rows):
    some = [1, 2, 3, 7, 8, 25]
    parts = spark.createDataFrame([("x", i, (i + 1) % 3) for i in some], "topology string, task_id bigint, part int")
    filled = [("x", i, (i + 1) % 3 if i in some else i % 3) for i in range(1, 26)]
    blocks = out.partition_vector(parts, 10)
    whole = "\n".join(r["text"] for r in blocks.orderBy("block").collect())
    docs = spark.createDataFrame([("x", whole)], "topology string, text string")
    assert rows(src.read_vector_blocks(blocks, 10)) == filled
    assert blocks.count() == 3 and rows(src.read_partition_vector(docs)) == filled


def test_reports_from_files(spark, tmp_path, rows):
    report = {
        "topology": "t", "ts": "2024-01-01T00:00:05.000Z", "id": 1, "worker_host": "h", "worker_port": 6700, "component": "c",
        "task_id": 3,
        "points": [{"name": "throughput", "value": 9}, {"name": "emitted_messages", "value_map": {"4": 2, "5": 1}}],
    }
    (tmp_path / "r.json").write_text(json.dumps(report))
    points = src.read_datapoints(spark, str(tmp_path))
    assert rows(points, "task_id", "name", F.coalesce("value", F.lit(-1))) == [(3, "emitted_messages", -1), (3, "throughput", 9)]
    assert rows(src.edge_values(points), "source", "target", "value") == [(3, 4, 2), (3, 5, 1)]


def test_interface_table(spark, rows):
    def line(name, address, received, sent):
        return f"{name:<5} 1500  net {address:>17}  10 0 {received} 20 0 {sent} 0"

    text = [
        "Name  Mtu   Network       Address            Ipkts Ierrs     Ibytes    Opkts Oerrs     Obytes  Coll",
        line("lo0", "localhost", 999, 999),
        line("en0", "aa:bb", 1_000, 200),
        line("bridg", "cc:dd", 5, 7),
        line("xen2", "ee:ff", 5, 7),
        line("en12", "10.0.0.1", 9_000_000_000, 30),
        line("en12", "10.0.0.2", 9_000_000_000, 30),
        line("en3a", "10.0.0.3", 5, 7),
    ]
    from flowplace.operators.metrics import interface_bytes

    lines = spark.createDataFrame([("h", i, t) for i, t in enumerate(text)], "host string, line_no int, line string")
    parsed = src.parse_netstat(lines.withColumn("snapshot_ts", F.lit("2024-01-01").cast("timestamp")))
    expected = [(2, "en0", 1_000), (5, "en12", 9_000_000_000), (6, "en12", 9_000_000_000)]
    assert rows(parsed, "line_no", "iface", "in_bytes") == expected
    assert interface_bytes(parsed).first()["bytes"] == 1_200 + 9_000_000_030


def test_log_line_pads_and_cuts(spark):
    points = spark.sql(
        """select timestamp'1970-01-01 00:00:07' ts, 'h' worker_host, 67 worker_port, 'topo' topology, 'comp' component,
                  3 task_id, n name, 5L value from values ('short'), (repeat('x', 40)) as t(n)"""
    )
    got = [r["line"] for r in out.metrics_log_lines(points).collect()]
    head = "\t7\t              h:67  \ttopo                \tcomp       \t  3\t"
    assert got == [head + "short" + " " * 28 + "\t5", head + "x" * 33 + "\t5"]


def test_latest_per_key(spark, rows):
    docs = spark.createDataFrame([("a", 1, "old"), ("a", 3, "new"), ("b", 2, "only")], "topology string, ts int, text string")
    assert rows(latest_per_key(docs, ["topology"], ["ts"])) == [("a", 3, "new"), ("b", 2, "only")]


def test_strict_executors(spark):
    bad = spark.createDataFrame([(1, 1), (2, 3)], "start_task int, end_task int")
    with pytest.raises(Exception, match="2-3 holds more than one task"):
        require_single_task(bad).collect()
