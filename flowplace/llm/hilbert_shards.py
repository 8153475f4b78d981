"""Shards along a Hilbert curve over several metadata dimensions, in DataFrame operations only.

Each dimension is quantised to a few bits, the curve index orders the rows, and the order is cut
into runs of equal row count. Neighbours on the curve are neighbours in every dimension, so a
file of a shard covers a small box and its min/max statistics prune in all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowplace.llm.common import partitions_of, ranked, running_base, text_of
from flowplace.session import materialise

BITS = 6  # bits per dimension
SHARDS = 40


def hilbert_index(dims: list[Column], bits: int = BITS) -> Column:
    """Curve index of integer coordinates below ``2 ** bits`` (Skilling 2004), as BIGINT.

    The coordinates' bits are untangled from the highest down, Gray coded and interleaved.
    """
    n = len(dims)
    if n * bits > 62:
        raise ValueError("the index must fit 62 bits")
    long = lambda v: F.lit(v).cast("long")
    levels = F.array(*[long(1 << b) for b in range(bits - 1, 0, -1)])
    places = F.sequence(F.lit(0), F.lit(n - 1))

    def untangle(x: Column, q: Column) -> Column:
        def step(x: Column, i: Column) -> Column:
            first, own, low = x[0], F.element_at(x, i + 1), q - 1
            flip = own.bitwiseAND(q) != 0
            t = first.bitwiseXOR(own).bitwiseAND(low)
            return F.transform(
                x,
                lambda v, j: F.when(j == 0, F.when(flip, v.bitwiseXOR(low)).otherwise(v.bitwiseXOR(t)))
                .when((j == i) & ~flip, v.bitwiseXOR(t))
                .otherwise(v),
            )

        return F.aggregate(places, x, step)

    x = F.aggregate(levels, F.array(*[d.cast("long") for d in dims]), untangle)
    gray = F.aggregate(
        x, F.array().cast("array<bigint>"), lambda out, v: F.concat(out, F.array(v.bitwiseXOR(F.coalesce(F.try_element_at(out, F.lit(-1)), long(0)))))
    )
    spin = lambda g: F.aggregate(
        levels, long(0), lambda t, q: F.when(F.element_at(g, -1).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t)
    )
    turned = F.transform(F.array(gray), lambda g: F.transform(g, lambda v: v.bitwiseXOR(spin(g))))[0]
    weave = lambda g: F.aggregate(
        F.array(*[long(1 << b) for b in range(bits - 1, -1, -1)]),
        long(0),
        lambda out, q: F.aggregate(g, out, lambda o, v: o * 2 + F.when(v.bitwiseAND(q) != 0, 1).otherwise(0)),
    )
    return F.transform(F.array(turned), weave)[0]


def quantised(df: DataFrame, column: str, *of: str, bits: int = BITS) -> list[Column]:
    """Coordinates of the columns ``of`` by the quantiles of a numeric column over all rows; null gets 0.

    The quantiles are a summary of at most ``2 ** bits`` values, computed over the whole table.
    """
    n = 1 << bits
    cuts = df.agg(F.percentile_approx(column, [i / n for i in range(1, n)], 10_000)).first()[0] or []
    bounds = F.lit(sorted(set(cuts))) if cuts else F.array().cast("array<double>")
    place = lambda c: F.size(F.filter(bounds, lambda b: b < F.col(c)))
    return [F.coalesce(F.when(F.col(c).isNotNull(), place(c)), F.lit(0)) for c in of]


def hashed(column: str, bits: int = BITS) -> Column:
    """Coordinate of a categorical column; null gets 0. Equal values share a coordinate."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(1 << bits)), F.lit(0))


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, curve, the four coordinates, shard, slot.

    Law: rows. Shard sizes differ by at most one row, slots count from 0 in curve order; ties on
    the curve go by content and doc_id. Equal texts form a group: all its rows lie at the group's smallest id and
    coordinates, so they are neighbours in the order whatever their metadata, and a group lies in one shard unless a cut, which the law
    fixes by row counts, falls inside it. The four coordinates returned are the row's own. Null text
    has no bytes; a null id, language or source lies at coordinate 0 and sorts first; missing
    ``lang`` or ``source`` columns count as null. Fewer rows than shards leave shards empty, an
    empty table gives no rows. Other columns of ``docs`` are ignored.
    """
    have = set(docs.columns)
    pick = lambda c: F.col(f"`{c}`").cast("string") if c in have else F.lit(None).cast("string")
    body = text_of("text")
    narrow = materialise(
        docs.select(
            F.col(f"`{doc_id}`").alias("doc_id"),
            F.col(f"`{text}`").cast("string").alias("text"),
            pick("lang").alias("lang"),
            pick("source").alias("source"),
        ).select(
            "doc_id",
            (F.octet_length(body).cast("long") + 16).alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.xxhash64(body).alias("content"),
            hashed("source").alias("d_source"),
            hashed("lang").alias("d_lang"),
        ),
        "shards",
    )
    own = {"g_id": "doc_id", "g_source": "d_source", "g_lang": "d_lang"}
    groups = narrow.groupBy("content").agg(F.count("*").alias("copies"), *[F.min(c).alias(g) for g, c in own.items()])
    # Only texts with copies meet their group; a text's copies are one key, which AQE splits if it is busy.
    grouped = narrow.join(groups.filter("copies > 1").drop("copies"), "content", "left")
    grouped = materialise(grouped.withColumns({g: F.coalesce(g, c) for g, c in own.items()}), "shards")
    d_id, g_id = quantised(narrow, "doc_id", "doc_id", "g_id")
    placed = grouped.withColumns({"d_id": d_id, "g_id": g_id, "d_size": quantised(narrow, "size", "size")[0]})
    curve = hilbert_index([F.col(c) for c in ("g_source", "g_lang", "g_id", "d_size")])
    order = ["curve", "content", "doc_id"]
    line = ranked(placed.withColumn("curve", curve), order, partitions_of(docs), "shards")
    counts = materialise(line.groupBy("part").agg(F.count("*").alias("n")), "shards")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # One row per partition of the sort: as many as the session has shuffle partitions.
    bases = running_base(counts, "part", "n", "base")
    rank = line.join(F.broadcast(bases), "part").withColumn("rank", F.col("base") + F.col("place"))
    small, extra = divmod(total, shards)  # the first ``extra`` shards have a row more
    edge = extra * (small + 1)
    shard = F.when(F.col("rank") < edge, F.expr(f"rank div {small + 1}")).otherwise(
        extra + F.expr(f"(rank - {edge}) div {max(1, small)}")
    )
    first = F.when(F.col("shard") < extra, F.col("shard") * (small + 1)).otherwise(edge + (F.col("shard") - extra) * small)
    return (
        rank.withColumn("shard", shard.cast("int"))
        .withColumn("slot", (F.col("rank") - first).cast("long"))
        .select("doc_id", "size", "text_crc32", "curve", "d_source", "d_lang", "d_id", "d_size", "shard", "slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write ``docs`` as one folder per shard, in curve order, next to a table of each shard's box.

    ``doc_id`` must tell the rows apart here: it is what texts and shards are joined by. Repeated or null ids are an error.
    """
    rows = materialise(hilbert_shards(docs, shards, doc_id, text), "shards")
    if not rows.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        raise ValueError("ids must be there and differ to write shards")
    full = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{doc_id}`").alias("doc_id"))
    joined = full.join(rows.select("doc_id", "size", "shard", "slot"), "doc_id")
    joined.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(f"{path}/rows")
    box = [f(c).alias(f"{n}_{c}") for c in ("doc_id", "size", "d_source", "d_lang") for n, f in (("min", F.min), ("max", F.max))]
    rows.groupBy("shard").agg(F.count("*").alias("n"), *box).write.parquet(f"{path}/boxes")


def read_box(spark: SparkSession, path: str, **bounds: tuple[int, int]) -> DataFrame:
    """Written rows whose ``doc_id`` and ``size`` lie within the bounds (both ends included), from shards whose boxes meet them.

    Only the folders of these shards are read. One row per shard comes to the driver.
    """
    if not bounds.keys() <= {"doc_id", "size"}:
        raise ValueError("bounds are given for doc_id and size")
    boxes = spark.read.parquet(f"{path}/boxes")
    for name, (low, high) in bounds.items():
        boxes = boxes.filter((F.col(f"max_{name}") >= low) & (F.col(f"min_{name}") <= high))
    folders = [f"{path}/rows/shard={r['shard']}" for r in boxes.select("shard").collect()]
    if not folders:
        return spark.read.parquet(f"{path}/rows").filter("false")
    rows = spark.read.option("basePath", f"{path}/rows").parquet(*folders)
    for name, (low, high) in bounds.items():
        rows = rows.filter(F.col(name).between(low, high))
    return rows
