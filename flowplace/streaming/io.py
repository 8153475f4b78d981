"""Open recorded tables as streams and run streams into tables.

A stream's result never depends on how many files a trigger takes or in which order files
arrive. Grouped results go out in update mode: Spark's state store keeps them, each batch writes
the groups it changed, and the newest row of a group counts. Nothing waits for a watermark, so no
window is missing at the end and no late row is dropped; a limit on lateness, where state must be bounded,
is the caller's ``withWatermark``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from flowplace.session import new_path


def stream_table(spark: SparkSession, d: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """The files of a table as a stream; the schema is that of the table."""
    path = f"{d}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # A table may be one file, which a stream only takes as a pattern: one that fits nothing else.
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def run_available(writer: DataStreamWriter, label: str) -> None:
    """Process what is there, then stop; raises what the stream raised."""
    spark = writer._spark
    query = (
        writer.option("checkpointLocation", new_path(spark, f"{label}-progress")).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema])


def collect_rows(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream without groups into files of the shared folder and read them."""
    spark = stream.sparkSession
    path = new_path(spark, label)
    run_available(stream.writeStream.format("parquet").outputMode("append").option("path", path), label)
    return spark.read.schema(nullable(stream.schema)).parquet(path)


def collect_changes(stream: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Run a grouped stream and read the newest row of each group.

    A batch writes only the groups it changed, under its number, so a repeated batch overwrites itself.
    """
    spark = stream.sparkSession
    root = new_path(spark, label)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")

    run_available(stream.writeStream.outputMode("update").foreachBatch(write), label)
    shape = T.StructType([*nullable(stream.schema).fields, T.StructField("batch", T.LongType())])
    rest = [c for c in stream.columns if c not in keys]
    newest = spark.read.schema(shape).parquet(root).groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
    return newest.select(*keys, "_row.*").select(*stream.columns)
