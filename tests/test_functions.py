import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowplace.functions import be_long, config_value, edge_ends, find_key, floor_log2, hash_bucket, java_hash, to_be_long
from flowplace.functions.hashing import first_keys, hash_texts
from flowplace.operators import routing


def by_hand(text):
    h = 0
    units = text.encode("utf-16-be", "surrogatepass")
    for i in range(0, len(units), 2):
        h = (h * 31 + int.from_bytes(units[i : i + 2], "big")) % 2**32
    return h - 2**32 if h >= 2**31 else h


@given(st.lists(st.text(max_size=60), max_size=8))
def test_hash_texts(texts):
    assert hash_texts(texts).tolist() == [by_hand(t) for t in texts]


def test_java_hash_column(spark):
    texts = ["hello", "", "polygenelubricants", "Été", "a\U0001f600b", None, "x" * 5000]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["h"] for r in frame.select("t", java_hash(F.col("t")).alias("h")).collect()}
    assert got["hello"] == 99162322 and got["polygenelubricants"] == -(2**31) and got[None] is None
    assert all(got[t] == by_hand(t) for t in texts if t is not None)


def test_bucket_keeps_sign(spark):
    frame = spark.createDataFrame([("polygenelubricants",), ("hello",)], "t string")
    got = [r["b"] for r in frame.select(hash_bucket(F.col("t"), 7).alias("b")).collect()]
    assert got == [-(2**31 % 7), 99162322 % 7]


def test_first_keys_are_first_hits():
    import hashlib

    import numpy as np

    seeds, buckets = ["a", "b", "c"], np.array([3, -2, 0])
    for seed, bucket, key in zip(seeds, buckets, first_keys(seeds, buckets, 5, 500), strict=True):
        keys = (hashlib.md5(f"{seed}#{i}".encode()).hexdigest() for i in range(500))
        assert key == next(k for k in keys if int(np.fmod(by_hand(k), 5)) == bucket)


def test_find_key_without_hit(spark):
    frame = spark.createDataFrame([("a", 3)], "seed string, bucket int")
    missing = frame.select(find_key(F.col("seed"), 1000, F.col("bucket"), 1, on_fail="null").alias("k"))
    assert missing.first()["k"] is None
    with pytest.raises(Exception, match="no key for bucket"):
        frame.select(find_key(F.col("seed"), 1000, F.col("bucket"), 1).alias("k")).collect()


def test_aligned_and_rotated_keys(spark):
    aligned = routing.aligned_keys(spark.range(6).selectExpr("cast(id as int) source"), 6)
    assert [(r["source"], by_hand(r["keyfield"]) % 6 if by_hand(r["keyfield"]) >= 0 else None) for r in aligned.collect()] == [
        (i, i) for i in range(1)
    ] + [(i, i) for i in range(1, 6)]
    hops = routing.multi_hop(aligned, "keyfield", 6, 3)
    for r in hops.collect():
        assert [r[f"bucket_{i}"] for i in range(4)] == [(r["source"] + i) % 6 for i in range(4)]


def test_big_endian_longs(spark):
    values = [0, 1, 255, 256, 2**62, 2**63 - 1]
    frame = spark.createDataFrame([(v,) for v in values], "v bigint").withColumn("b", to_be_long(F.col("v")))
    for r in frame.withColumn("back", be_long(F.col("b"))).collect():
        assert bytes(r["b"]) == r["v"].to_bytes(8, "big") and r["back"] == r["v"]
    negative = spark.sql("select -2L v").select(to_be_long(F.col("v")).alias("b")).first()["b"]
    assert bytes(negative) == (-2).to_bytes(8, "big", signed=True)


def test_edge_ends(spark):
    frame = spark.createDataFrame([("/x/2-6",), ("/x/-1_-4",), ("/x/y",)], "p string")
    source, target = edge_ends(F.col("p"))
    assert [tuple(r) for r in frame.select(source, target).collect()] == [(2, 6), (-1, -4), (None, None)]


def test_config_value(spark):
    frame = spark.sql("select map('a', '7', 'b', 'soon') conf")
    got = frame.select(*[config_value(F.col("conf"), k, "int", 5).alias(k) for k in "abc"]).first()
    assert tuple(got) == (7, 5, 5)


def test_floor_log2(spark):
    values = [1, 2, 3, 4, 7, 8, 2**40 - 1, 2**40]
    got = spark.createDataFrame([(v,) for v in values], "v bigint").select(floor_log2(F.col("v")).alias("l")).collect()
    assert [r["l"] for r in got] == [v.bit_length() - 1 for v in values]
