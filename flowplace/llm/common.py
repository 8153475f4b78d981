"""What several operators of this folder need: bounded key sketches, prefix sums, components."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowplace.session import materialise

# Ship the helpers inside the tasks, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SKETCH_BITS = 1 << 25  # 4 MB; the only thing of this folder that is broadcast by hint
CHUNK = 4 << 20  # bytes of text that a task works on at once
BITMAP = 32_768  # bits in one bitmap of Spark's bitmap functions, a fixed value


def text_of(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _place(key: str, bits: int) -> Column:
    """Place in the sketch, from 1: Spark's bitmap functions count from there."""
    return F.pmod(F.col(key), F.lit(bits)) + 1


def sketch(keys: DataFrame, key: str, bits: int = SKETCH_BITS) -> DataFrame:
    """Bitmaps of the 64-bit hashes in ``key``: at most ``bits / 32768`` rows of 4 KB, whatever the input."""
    place = _place(key, bits)
    return keys.groupBy(F.bitmap_bucket_number(place).alias("sketch_no")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("sketch_bits")
    )


def flag(df: DataFrame, key: str, name: str, bitmaps: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """``df`` with boolean ``name``: false means that ``key`` is surely not in the sketch.

    The sketch has a fixed size, so it may be broadcast. A full sketch says "maybe" for every
    row, which costs time and never changes a result.
    """
    place = _place(key, bits)
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("sketch_bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.getbit(byte, (bit % 8).cast("int")) == 1
    joined = df.withColumn("sketch_no", F.bitmap_bucket_number(place)).join(F.broadcast(bitmaps), "sketch_no", "left")
    return joined.withColumn(name, F.coalesce(found, F.lit(False))).drop("sketch_no", "sketch_bits")


def drop_keys(docs: DataFrame, key: Column, losers: DataFrame, loser: str) -> DataFrame:
    """Rows of ``docs`` whose 64-bit ``key`` is not in ``losers``.

    Only rows that the sketch can't rule out take part in the join, so most texts are never
    shuffled. Columns keep their names and order.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("drop_key"))
    marked = flag(rows, "drop_key", "drop_maybe", sketch(losers, loser))
    checked = marked.filter("drop_maybe").join(
        losers.select(F.col(loser).alias("drop_key")).distinct(), "drop_key", "left_anti"
    )
    return marked.filter("not drop_maybe").select("row.*").unionByName(checked.select("row.*"))


def running_base(parts: DataFrame, part: str, size: str, base: str) -> DataFrame:
    """Per part the sum of ``size`` over smaller parts. ``parts`` has one row per partition, not per row of data."""
    before = F.sum(size).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    return parts.select(part, F.coalesce(before, F.lit(0)).cast("long").alias(base))


def ranked(df: DataFrame, keys: list, parts: int, label: str) -> DataFrame:
    """A written copy of ``df`` in the order of ``keys`` with its ``part`` and its ``place`` in the part.

    Parts are ranges of the order. The place is the low half of Spark's increasing id, so no
    window over a part is needed.
    """
    ordered = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    return materialise(
        ordered.withColumn("at", at)
        .withColumn("part", F.shiftright("at", 33).cast("int"))
        .withColumn("place", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("at"),
        label,
    )


def partitions_of(df: DataFrame) -> int:
    """Shuffle width of the session, as set for the size of the job."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def discard(*tables: DataFrame) -> None:
    """Delete written tables whose successors are written too; what still reads them would fail, so nothing may."""
    for table in tables:
        for file in table.inputFiles()[:1]:
            jvm = table.sparkSession.sparkContext._jvm
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """``(node, root)``: the smallest node reachable over ``links (a, b)``; nodes without links are not listed.

    Alternates "large star" and "small star" steps (Kiveris et al. 2014): every step is a
    grouped minimum, combined before its shuffle, and a join back, so no group of links is
    ever collected. Each round is written to the shared folder; it ends when a round changes nothing.
    """
    edges = materialise(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    seen = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        following = materialise(small.filter("u <> v").distinct(), "links")
        discard(edges)
        edges = following
        state = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    root = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return root.unionByName(root.select(F.col("root").alias("node"), "root").distinct())


def chunks(batch: pa.RecordBatch, column: str | int, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, so working memory does not grow with the batch."""
    sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + (size or 0) > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size or 0
    if start < len(sizes):
        yield batch.slice(start)


def kept(operator: str, name: str, make: Callable[[], Any]) -> Any:
    """``make()``, kept in the Python worker for later tasks of the same operator; a task of another one drops it."""
    own = sys.__dict__.setdefault("_flowplace_kept", {}).setdefault(operator, {})
    if name not in own:
        own[name] = make()
    return own[name]


def make_room(operator: str | None = None) -> None:
    """Drop what other operators keep in this Python worker and give memory that is not in use back to the system.

    A worker lives on for the tasks of all stages and shares the executor's memory with the JVM.
    """
    held = sys.__dict__.get("_flowplace_kept", {})
    others = [k for k in held if k != operator]
    for k in others:
        del held[k]
    if others:
        gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc alone has it
        libc.malloc_trim(0)


def per_chunk(
    work: Callable[[pa.RecordBatch], pa.RecordBatch], column: str | int, limit: int = CHUNK, operator: str | None = None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Apply ``work`` to bounded slices of every Arrow batch. ``operator`` names what :func:`kept` holds for ``work``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401 - binds pa.compute in the worker

        make_room(operator)
        for batch in batches:
            for piece in chunks(batch, column, limit):
                yield work(piece)
        make_room(operator)  # the worker lives on for other tasks

    return run
