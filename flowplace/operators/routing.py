"""Which task a row goes to, and how many rows a source may send."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowplace.functions import find_key, hash_bucket, next_bucket
from flowplace.operators.ordered import first_rows, numbered
from flowplace.session import materialise

# Limits of the key searches, and the default batch size.
ALIGNED_TRIES = 1_000_000
TRIES_PER_BUCKET = 100
BATCH_ROWS = 100_000
GROUP_LIMIT = 1_000  # Spark's default bound for limits inside window groups


def bucket_by_key(df: DataFrame, key: str, n: int) -> DataFrame:
    """Name the receiving task of each row: signed remainder of the key's string hash."""
    return df.withColumn("bucket", hash_bucket(F.col(key), n))


def co_locate(df: DataFrame, n: int, key: str) -> DataFrame:
    """Bring rows with the same key into the same partition, however many there are.

    That is the operator's promise, and it makes a busy key one task's work; what can do with
    parts of a key should take :func:`co_locate_shares`.
    """
    return df.repartition(n, key)


def co_locate_shares(df: DataFrame, n: int, key: str, shares: int) -> DataFrame:
    """Bring rows with the same (key, ``share``) together; the share, 0 to ``shares - 1`` by the rest of the row, is a column.

    Whoever combines by key does so per share first and over the shares afterwards.
    """
    others = [c for c in df.columns if c != key]
    share = F.pmod(F.xxhash64(*others), F.lit(shares)) if others else F.lit(0)
    return df.withColumn("share", share.cast("int")).repartition(n, key, "share")


def spread_evenly(df: DataFrame, n: int, row_id: str | None = None) -> DataFrame:
    """Even, key-independent spread; with ``row_id`` the receiving task is also named."""
    if row_id is None:
        return df.repartition(n)
    return df.withColumn("bucket", F.pmod(F.col(row_id), F.lit(n)).cast("int"))


def aligned_keys(sources: DataFrame, n: int, seed: str = "source", tries: int = ALIGNED_TRIES) -> DataFrame:
    """For each source index a key that is routed to the task of the same index."""
    start = F.concat(F.lit(f"{seed}/"), F.col("source").cast("string"))
    return sources.withColumn("keyfield", find_key(start, n, F.col("source"), tries))


def next_bucket_key(key: Column, n: int) -> Column:
    """A new key that is routed to the task after the one ``key`` is routed to."""
    return find_key(key, n, next_bucket(key, n), TRIES_PER_BUCKET * n)


def multi_hop(df: DataFrame, key: str, n: int, depth: int) -> DataFrame:
    """Bucket of each row on every level when each level renews the key for the next task.

    Adds ``bucket_0 .. bucket_<depth>``; only the key of the last level is kept. Keys are looked for once
    per distinct key; a key has the bucket after its predecessor's, so only the first level is hashed.
    """
    hops = df.select(F.col(key).alias("_key")).distinct().withColumn("_bucket", hash_bucket(F.col("_key"), n))
    hops = materialise(hops.withColumn("_hop", F.col("_key")), "hops")
    buckets = [F.col("_bucket")]
    for _ in range(depth):
        buckets.append((buckets[-1] + 1) % n)
    for wanted in buckets[1:]:
        hops = hops.withColumn("_hop", find_key(F.col("_hop"), n, wanted, TRIES_PER_BUCKET * n))
    found = hops.select("_key", "_hop", *[b.alias(f"bucket_{i}") for i, b in enumerate(buckets)])
    joined = df.join(found, F.col(key) == F.col("_key"), "left").withColumn(key, F.col("_hop"))
    return joined.drop("_key", "_hop")


def with_next_keys(df: DataFrame, key: str, n: int) -> DataFrame:
    """Add ``bucket``, ``follower`` (the next bucket's key) and ``next_bucket``, looked for once per distinct key."""
    keys = df.select(F.col(key).alias("_key")).distinct().withColumn("bucket", hash_bucket(F.col("_key"), n))
    keys = materialise(keys, "hops").withColumn("next_bucket", (F.col("bucket") + 1) % n)
    keys = keys.withColumn("follower", find_key(F.col("_key"), n, F.col("next_bucket"), TRIES_PER_BUCKET * n))
    return df.join(keys, F.col(key) == F.col("_key"), "left").drop("_key")


def admit_per_period(df: DataFrame, cap: int, period: str = "second") -> DataFrame:
    """At most ``cap - 1`` rows per source and period, earliest first.

    Up to ``GROUP_LIMIT`` rows every task first drops what can't be among them, so only those few per task and group are
    shuffled; beyond that the rows are numbered in ranges.
    """
    timed = df.withColumn("_period", F.date_trunc(period, "ts"))
    if cap - 1 <= GROUP_LIMIT:
        line = Window.partitionBy("source", "_period").orderBy("ts", "id")
        return timed.withColumn("_n", F.row_number().over(line)).filter(F.col("_n") <= cap - 1).drop("_n", "_period")
    return first_rows(timed, ["source", "_period"], ["ts", "id"], cap - 1, "_n").drop("_n", "_period")


def batch_rows(df: DataFrame, size: int = BATCH_ROWS, slices: int | None = None) -> DataFrame:
    """Number bounded batches per source."""
    ranked = numbered(df, ["source"], ["ts", "id"], "_n", slices)
    return ranked.withColumn("batch", F.call_function("div", F.col("_n") - 1, F.lit(size))).drop("_n")
