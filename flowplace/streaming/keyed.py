"""The row before, per key and in event order, kept in Spark's state store behind a stream.

A key's rows lie in cells of event time, and (key, cell) is what state is kept by: a busy key is the work of
as many tasks as it has cells, and a batch touches only the cells its rows fall in, whatever came
before. A cell knows its last place. Rows after that place are appended and nothing else is read; rows that
come late read their own cell and send a correction for each row whose predecessor they became. A task holds the
rows that a batch brings to one cell, so cells are to be as narrow as a key's rows are dense.

The first row of a cell follows the last one of the cell before. These links, one per key and cell, are
made when the result is read, as are running totals over groups: sums of changes, which any number of tasks
can share.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from flowplace.session import new_path
from flowplace.streaming.io import nullable, run_available

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"
# Fixed value: the state store that keyed state needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

CELL_SECS = 7 * 86_400
CELL, FOLLOWS = "_cell", "_follows"
ENTRY_ROWS = 4_096  # most rows of an entry of state


def keyed_session(spark: SparkSession) -> SparkSession:
    """``spark`` if its state store can hold keyed state; else a session beside it whose store can.

    The caller's own settings are never changed; all else is taken over. Streams given to this module must come from such a session.
    """
    if spark.conf.get(PROVIDER_CONF, None) == ROCKSDB:
        return spark
    own = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set(PROVIDER_CONF, ROCKSDB)
    return own


class Neighbours(StatefulProcessor):
    """Per (key, cell): rows in order; gives each new row, and each row it comes before, the place of its predecessor.

    ``names`` are the columns of a row, ``order`` those that order it, ``values`` those its successor wants to know, under the names ``told``.
    """

    def __init__(
        self, row: T.StructType, order: Sequence[str], values: Sequence[str], told: Sequence[str], cell_secs: int, timed: bool
    ):
        self.row, self.names = row, row.fieldNames()
        self.at, self.told = [self.names.index(c) for c in order], [self.names.index(c) for c in values]
        self.cell_secs, self.timed = cell_secs, timed
        self.made = Row(*self.names, FOLLOWS, *told)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Rows are kept packed, one entry or few per batch: a state call costs the same for one row as for many.
        self.last = handle.getValueState("last", "packed binary")
        self.rows = handle.getListState("rows", "packed binary")

    def packed(self, rows: Sequence[tuple]) -> tuple[bytes]:
        return (pickle.dumps(rows, pickle.HIGHEST_PROTOCOL),)

    def entries(self, rows: Sequence[tuple]) -> list[tuple[bytes]]:
        return [self.packed(rows[i : i + ENTRY_ROWS]) for i in range(0, len(rows), ENTRY_ROWS)]

    def unpacked(self, entry: Row) -> list[tuple]:
        return pickle.loads(entry[0])  # noqa: S301 - the job's own state

    def place(self, row: tuple) -> tuple:
        return tuple((row[i] is not None, row[i]) for i in self.at)

    def plain(self, rows: Iterable[Row]) -> list[tuple]:
        """Rows as tuples that share equal texts."""
        same: dict[str, str] = {}
        found, places = [], None
        for r in rows:
            places = places or [r.__fields__.index(c) for c in self.names]
            found.append(tuple([same.setdefault(v, v) if isinstance(v, str) else v for v in (r[i] for i in places)]))
        return found

    def once(self, rows: list[tuple]) -> list[tuple]:
        """The rows in order; of those at one place the last."""
        rows.sort(key=self.place)
        return [r for i, r in enumerate(rows) if i + 1 == len(rows) or self.place(r) != self.place(rows[i + 1])]

    def emitted(self, row: tuple, before: tuple | None) -> Row:
        told = [None if before is None else before[i] for i in self.told]
        return self.made(*row, before is not None, *told)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        fresh = self.once(self.plain(rows))
        held = self.last.get()
        before = None if held is None else self.unpacked(held)[0]
        if before is None or self.place(before) < self.place(fresh[0]):
            for entry in self.entries(fresh):
                self.rows.appendValue(entry)
            self.last.update(self.packed(fresh[-1:]))
            if self.timed and before is None and key[-1] is not None:
                self.handle.registerTimer((key[-1] + 1) * self.cell_secs * 1_000)
            for row in fresh:
                yield self.emitted(row, before)
                before = row
            return
        # Late rows: only this cell is read. A row is sent if it is new or follows a new one.
        old = [row for entry in self.rows.get() for row in self.unpacked(entry)]
        seen = {self.place(r) for r in old}
        fresh = [r for r in fresh if self.place(r) not in seen]
        line = [*((r, False) for r in old), *((r, True) for r in fresh)]
        line.sort(key=lambda entry: self.place(entry[0]))
        self.rows.put(self.entries([r for r, _ in line]))
        self.last.update(self.packed([line[-1][0]]))
        before, new_before = None, False
        for row, new in line:
            if new or new_before:
                yield self.emitted(row, before)
            before, new_before = row, new

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        """The watermark has passed the end of the cell: no row can come any more."""
        self.rows.clear()
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


@dataclass(frozen=True)
class Followed:
    """What a stream has written: every row with its predecessor's values, newest version per row."""

    spark: SparkSession
    root: str
    schema: T.StructType
    keys: Sequence[str]
    order: Sequence[str]
    values: dict[str, str]

    def versions(self) -> DataFrame:
        """All versions of rows as the batches wrote them, with the batch's number."""
        stored = _plain(self.schema)
        told = [T.StructField(n, stored[c].dataType) for n, c in self.values.items()]
        marks = [T.StructField(CELL, T.LongType()), T.StructField(FOLLOWS, T.BooleanType())]
        shape = T.StructType([*stored.fields, *marks, *told, T.StructField("batch", T.LongType())])
        return self.spark.read.schema(shape).parquet(self.root)

    def rows(self, known: str) -> DataFrame:
        """Rows with the predecessor's values; ``known`` is false for the first row of a key."""
        versions = self.versions()
        place = [*self.keys, CELL, *self.order]
        rest = [c for c in versions.columns if c not in (*place, "batch")]
        newest = versions.groupBy(*place).agg(F.max_by(F.struct(*rest), "batch").alias("_row")).select(*place, "_row.*")
        # One row per key and cell: the values that the first row of the next cell follows.
        lasts = newest.groupBy(*self.keys, CELL).agg(
            F.max_by(F.struct(*[F.col(c).alias(n) for n, c in self.values.items()]), F.struct(*self.order)).alias("_told")
        )
        line = Window.partitionBy(*self.keys).orderBy(CELL)
        links = lasts.withColumn("_told", F.lag("_told").over(line)).filter(F.col("_told").isNotNull())
        links = links.select(*[F.col(c).alias(f"_l_{c}") for c in (*self.keys, CELL)], "_told")
        same = F.lit(True)
        for c in (*self.keys, CELL):
            same = same & F.col(c).eqNullSafe(F.col(f"_l_{c}"))
        joined = newest.join(links, same & ~F.col(FOLLOWS), "left")
        told = {n: F.when(F.col(FOLLOWS), F.col(n)).otherwise(F.col(f"_told.{n}")) for n in self.values}
        own = [_back(f) for f in self.schema]
        return joined.select(*own, (F.col(FOLLOWS) | F.col("_told").isNotNull()).alias(known), *[v.alias(n) for n, v in told.items()])


def _plain(schema: T.StructType) -> T.StructType:
    """The schema with times as microseconds, which no time zone can change on the way to Python and back."""
    kinds = [T.LongType() if isinstance(f.dataType, T.TimestampType) else f.dataType for f in schema]
    return T.StructType([T.StructField(f.name, k) for f, k in zip(schema, kinds, strict=True)])


def _back(field: T.StructField):
    if isinstance(field.dataType, T.TimestampType):
        return F.timestamp_micros(field.name).alias(field.name)
    return F.col(field.name)


def follow(
    stream: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, str],
    label: str,
    cell_secs: int = CELL_SECS,
    lateness: str | None = None,
) -> Followed:
    """Run ``stream`` and tell every row ``{new column: source}`` of the row before it per key.

    ``order`` begins with an event time and ends with an id that is unique within the key; a row that comes twice counts
    once. Null keys are a key of their own and rows without a time come first. State holds the rows of every cell; with ``lateness`` (an
    interval) a cell's state goes once the watermark has passed its end, and rows later than that are dropped. ``stream`` must
    come from a ``keyed_session``.
    """
    spark = stream.sparkSession
    clock = order[0]
    timed = lateness is not None
    source = stream.withWatermark(clock, lateness) if timed else stream
    shape = _plain(stream.schema)
    times = [f.name for f in stream.schema if isinstance(f.dataType, T.TimestampType)]
    celled = source.withColumn(CELL, F.floor(F.unix_micros(clock) / (cell_secs * 1_000_000)).cast("bigint"))
    if timed:  # the event time itself must reach the operator, which drops what comes too late
        celled = celled.withColumn("_at", F.col(clock))
    celled = celled.withColumns({c: F.unix_micros(c) for c in times})
    told = [T.StructField(n, shape[c].dataType) for n, c in values.items()]
    out = T.StructType([*shape.fields, T.StructField(FOLLOWS, T.BooleanType()), *told])
    states = celled.groupBy(*keys, CELL).transformWithState(
        Neighbours(shape, order, list(values.values()), list(values), cell_secs, timed), out, "Update", "EventTime" if timed else "None"
    )
    states = states.withColumn(CELL, F.floor(F.col(clock) / (cell_secs * 1_000_000)).cast("bigint"))
    root = new_path(spark, label)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")

    run_available(states.writeStream.outputMode("update").foreachBatch(write), label)
    return Followed(spark, root, nullable(stream.schema), list(keys), list(order), dict(values))
