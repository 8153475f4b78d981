"""Steps that a user brings: functions that append rows to rows, and opaque code over Arrow batches.

A *row function* is a Python table function: it gets columns of a row and yields none, one or many rows, whose columns are appended to
it. What columns these are may depend on its constant arguments (``analyze``). An *opaque step* gets Arrow batches and yields Arrow
batches of a declared schema. Both run inside tasks, as many as the input has partitions, and see one row or one batch at a time.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from flowplace.functions import hashing

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TRIES = 100  # per bucket, a fixed value


def append_rows(df: DataFrame, function: type, *args: Column) -> DataFrame:
    """``df`` with the rows that ``function`` yields for each of its rows appended; a row without any disappears.

    ``function`` is a table function class: ``eval`` yields tuples, a static ``analyze`` names their columns. Arguments that are columns of ``df`` are
    marked with ``.outer()``. Nulls reach the function as None; repeated rows are asked for each; an empty table gives no rows.
    """
    return df.lateralJoin(F.udtf(function)(*args))


def opaque(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType) -> DataFrame:
    """``work`` over every Arrow batch of ``df``; its batches must have ``schema``. The rest of the plan sees only that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield work(batch)

    return df.mapInArrow(run, schema)


class NextKeys:
    """Row function: for a key the first keys of the following buckets, one row per level down to ``depth``; none for a null key.

    Columns: level, bucket and ``key_field``, a name of the caller's choice.
    """

    @staticmethod
    def analyze(key: AnalyzeArgument, buckets: AnalyzeArgument, depth: AnalyzeArgument, key_field: AnalyzeArgument) -> AnalyzeResult:
        if not key_field.isConstantExpression or not key_field.value:
            raise ValueError("the name of the key's column must be a constant")
        fields = [("level", T.IntegerType()), ("bucket", T.IntegerType()), (key_field.value, T.StringType())]
        return AnalyzeResult(schema=T.StructType([T.StructField(name, kind) for name, kind in fields]))

    def eval(self, key: str | None, buckets: int, depth: int, key_field: str) -> Iterator[tuple[int, int, str]]:
        for level in range(1, depth + 1) if key is not None else ():
            bucket = hashing.signed_remainder(hashing.hash_texts([key]), buckets)
            wanted = hashing.signed_remainder(bucket + 1, buckets)
            key = hashing.first_keys([key], wanted, buckets, TRIES * buckets)[0]
            if key is None:
                raise ValueError(f"no key for bucket {wanted[0]} in {TRIES * buckets} tries")
            yield level, int(wanted[0]), key


def with_bucket(batch: pa.RecordBatch, key: str, buckets: int) -> pa.RecordBatch:
    """An opaque step: the batch with its ``bucket``, null where the key is."""
    column = batch.column(key)
    found = hashing.signed_remainder(hashing.hash_texts(column.fill_null("").to_pylist()), buckets)
    bucket = pa.array(found.astype("int32"), mask=column.is_null().to_numpy(zero_copy_only=False))
    return pa.RecordBatch.from_arrays([*batch.columns, bucket], [*batch.schema.names, "bucket"])
