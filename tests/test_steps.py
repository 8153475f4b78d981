"""Steps that a user brings, and admission by a group limit."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeResult

from flowplace.functions import hashing
from flowplace.operators import routing, steps


class Repeated:
    """None, one or many rows per row."""

    @staticmethod
    def analyze(n, name):
        return AnalyzeResult(schema=T.StructType([T.StructField(name.value, T.IntegerType())]))

    def eval(self, n, name):
        for i in range(n or 0):
            yield (i,)


def test_rows_of_a_row_function(spark, rows):
    frame = spark.createDataFrame([("a", 2), ("b", 0), ("c", None), ("a", 2), ("d", 1)], "k string, n int")
    got = steps.append_rows(frame, Repeated, F.col("n").outer(), F.lit("copy"))
    assert got.columns == ["k", "n", "copy"]
    assert rows(got, "k", "copy") == [("a", 0), ("a", 0), ("a", 1), ("a", 1), ("d", 0)]
    assert steps.append_rows(frame.filter("false"), Repeated, F.col("n").outer(), F.lit("copy")).isEmpty()


def test_next_keys_follow_the_buckets(spark):
    frame = spark.createDataFrame([("one",), ("two",), (None,)], "k string")
    got = steps.append_rows(frame, steps.NextKeys, F.col("k").outer(), F.lit(5), F.lit(3), F.lit("found")).collect()
    assert sorted({r["k"] for r in got}) == ["one", "two"] and len(got) == 6
    for name in ("one", "two"):
        key = name
        for r in sorted((r for r in got if r["k"] == name), key=lambda r: r["level"]):
            bucket = lambda k: int(hashing.signed_remainder(hashing.hash_texts([k]), 5)[0])
            assert r["bucket"] == int(hashing.signed_remainder(np.array([bucket(key) + 1]), 5)[0]) == bucket(r["found"])
            key = r["found"]
    with pytest.raises(Exception, match="constant"):
        steps.append_rows(frame, steps.NextKeys, F.col("k").outer(), F.lit(5), F.lit(3), F.col("k").outer()).collect()


def test_opaque_step(spark, rows):
    frame = spark.createDataFrame([(1, "hello"), (2, None), (3, "")], "id long, k string")
    got = steps.opaque(frame, lambda b: steps.with_bucket(b, "k", 7), "id long, k string, bucket int")
    assert rows(got, "id", "bucket") == [(1, 99162322 % 7), (2, None), (3, 0)]
    assert steps.opaque(frame.filter("false"), lambda b: steps.with_bucket(b, "k", 7), "id long, k string, bucket int").isEmpty()


def test_row_function_runs_after_a_hash_in_the_same_process(spark, rows):
    frame = spark.createDataFrame([("hello",), (None,)], "k string")
    assert rows(frame.select(hashing.java_hash(F.col("k")).alias("h")).filter("h is not null"), "h") == [(99162322,)]
    assert steps.append_rows(frame, steps.NextKeys, F.col("k").outer(), F.lit(5), F.lit(2), F.lit("found")).count() == 2


def test_opaque_step_runs_after_a_hash_in_the_same_process(spark, rows):
    frame = spark.createDataFrame([("hello",), (None,)], "k string")
    assert rows(frame.select(hashing.java_hash(F.col("k")).alias("h")).filter("h is not null"), "h") == [(99162322,)]
    got = steps.opaque(frame, lambda b: steps.with_bucket(b, "k", 7), "k string, bucket int")
    assert rows(got.filter("k is not null"), "k", "bucket") == [("hello", 99162322 % 7)]


def test_admission_limits_groups_before_the_shuffle(spark, rows):
    frame = spark.range(5_000).select((F.col("id") % 3).alias("source"), F.timestamp_seconds(F.col("id") % 40).alias("ts"), "id").repartition(4)
    few, many = routing.admit_per_period(frame, 4), routing.admit_per_period(frame, routing.GROUP_LIMIT + 2)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Exchange") < plan.index("Partial")
    assert many.count() == 5_000
    want = sorted((r["source"], r["id"]) for r in many.collect())
    kept = {}
    for source, i in want:
        kept.setdefault((source, i % 40), []).append(i)
    assert rows(few, "source", "id") == sorted((s, i) for (s, _), ids in kept.items() for i in sorted(ids)[:3])
