"""Queries for routing, key search and admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowplace.functions import java_hash
from flowplace.operators import routing as r
from flowplace.operators import steps
from flowplace.plans import lenses as L
from flowplace.plans.lenses import with_lenses
from flowplace.plans.registry import query

N = 8
DEPTH = 3
SOURCES = 25


def _hash(text: str) -> str:
    """String hash in SQL: UTF-16 units folded modulo 2^32, read as signed."""
    units = (
        f"list_transform(string_split({text}, ''), lambda ch: unicode(ch)::bigint)"
    )
    fold = (
        f"list_reduce({units}, lambda h, c: case when c < 65536 then (h * 31 + c) % 4294967296 "
        "else ((h * 31 + 55296 + (c - 65536) // 1024) * 31 + 56320 + (c - 65536) % 1024) % 4294967296 end, 0::bigint)"
    )
    return f"(({fold} + 2147483648) % 4294967296 - 2147483648)"


@query(
    "rte01_bucket_by_key",
    with_lenses(
        f"""select word, n, (case when word = '' then 0 else {_hash("word")} end % {N})::int as bucket
            from (select word, count(*) as n from words group by word)""",
        "words",
    ),
)
def rte01(spark, d):
    """Hashed once per distinct word; every word of every document counts."""
    counted = L.words(spark, d).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return r.bucket_by_key(counted, "word", N)


@query(
    "rte01_bucket_sizes",
    with_lenses(
        f"""select bucket, sum(n)::bigint as n from (
                select n, ({_hash("keyfield")} % {N})::int as bucket
                from (select keyfield, count(*) as n from keyed group by keyfield)) group by bucket""",
        "keyed",
    ),
)
def rte01_sizes(spark, d):
    return r.bucket_by_key(L.keyed(spark, d), "keyfield", N).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query(
    "rte01_string_hash",
    f"""select conv_id, turn, role, ({_hash("text")})::int as hash from conversations""",
)
def rte01_hash(spark, d):
    """The hash over whole texts."""
    return L.table(spark, d, "conversations").select("conv_id", "turn", "role", java_hash(F.col("text")).alias("hash"))


@query(
    "rte02_spread_evenly",
    with_lenses(f"select (id % {N})::int as bucket, count(*) as n from keyed group by 1", "keyed"),
)
def rte02(spark, d):
    return r.spread_evenly(L.keyed(spark, d), N, "id").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("rte03_co_locate", with_lenses("select source, id, keyfield from keyed", "keyed"))
def rte03(spark, d):
    return r.co_locate(L.keyed(spark, d), N, "keyfield").select("source", "id", "keyfield")


@query(
    "rte04_aligned_keys",
    f"""with tries as (
            select n_nationkey as source, i, md5('source/' || n_nationkey || '#' || i) as keyfield
            from nation, (select unnest(range(0, 2500)) as i)),
        hits as (select source, i, keyfield from tries where {_hash("keyfield")} % {SOURCES} = source)
        select source, arg_min(keyfield, i) as keyfield from hits group by source""",
)
def rte04(spark, d):
    return r.aligned_keys(L.table(spark, d, "nation").select(F.col("n_nationkey").alias("source")), SOURCES)


def _hop(table: str, level: int) -> str:
    """One level: the bucket of each distinct key, and its first follower in the next bucket."""
    return f"""
    level{level} as materialized (
        select key, ({_hash("key")} % {N})::int as bucket from (select distinct key from {table})),
    tries{level} as (
        select key, i, md5(key || '#' || i) as follower, ((bucket + 1) % {N}) as wanted
        from level{level}, (select unnest(range(0, {r.TRIES_PER_BUCKET * N})) as i)),
    next{level} as materialized (
        select l.key, l.bucket, n.follower
        from level{level} l
        left join (select key, arg_min(follower, i) as follower from tries{level}
                   where {_hash("follower")} % {N} = wanted group by key) n using (key)),
    keys{level + 1} as (select follower as key from next{level})"""


@query(
    "rte05_next_bucket_key",
    with_lenses(
        f"""with keys0 as (select keyfield as key from keyed), {_hop("keys0", 0)}
            select k.id, n.bucket, n.follower, ({_hash("n.follower")} % {N})::int as next_bucket
            from keyed k join next0 n on n.key = k.keyfield""",
        "keyed",
    ),
)
def rte05(spark, d):
    return r.with_next_keys(L.keyed(spark, d).select("id", "keyfield"), "keyfield", N).drop("keyfield")


@query(
    "rte06_multi_hop",
    with_lenses(
        f"""with keys0 as (select keyfield as key from keyed),
            {",".join(_hop(f"keys{i}", i) for i in range(DEPTH))}
            select k.id, a.bucket as bucket_0, b.bucket as bucket_1, c.bucket as bucket_2,
                   ({_hash("c.follower")} % {N})::int as bucket_3, c.follower as keyfield
            from keyed k join next0 a on a.key = k.keyfield join next1 b on b.key = a.follower
                         join next2 c on c.key = b.follower""",
        "keyed",
    ),
)
def rte06(spark, d):
    return r.multi_hop(L.keyed(spark, d).select("id", "keyfield"), "keyfield", N, DEPTH)


@query(
    "rte07_admit_per_period",
    with_lenses(
        """select source, id from (
               select source, id, row_number() over (partition by source, date_trunc('day', ts) order by ts, id) as n
               from keyed) where n <= 3""",
        "keyed",
    ),
)
def rte07(spark, d):
    """Events are days apart per source, so the period is a day; the cap of 4 admits 3."""
    return r.admit_per_period(L.keyed(spark, d), 4, "day").select("source", "id")


@query(
    "rte08_batch_rows",
    with_lenses(
        "select source, id, (row_number() over (partition by source order by ts, id) - 1) // 10 as batch from keyed",
        "keyed",
    ),
)
def rte08(spark, d):
    return r.batch_rows(L.keyed(spark, d), 10).select("source", "id", "batch")


@query(
    "ext01_appended_rows",
    with_lenses(
        f"""with keys0 as (select keyfield as key from keyed), {_hop("keys0", 0)}, {_hop("keys1", 1)}
            select k.keyfield, 1::int as level, ((n.bucket + 1) % {N})::int as bucket, n.follower
            from (select distinct keyfield from keyed) k join next0 n on n.key = k.keyfield
            union all
            select k.keyfield, 2, ((m.bucket + 1) % {N})::int, m.follower
            from (select distinct keyfield from keyed) k join next0 n on n.key = k.keyfield join next1 m on m.key = n.follower""",
        "keyed",
    ),
)
def ext01(spark, d):
    """A user's row function appends two rows to every distinct key: the first keys of the next two buckets."""
    keys = L.keyed(spark, d).select("keyfield").distinct()
    return steps.append_rows(keys, steps.NextKeys, F.col("keyfield").outer(), F.lit(N), F.lit(2), F.lit("follower"))


@query(
    "ext02_opaque_step",
    with_lenses(f"select id, keyfield, ({_hash('keyfield')} % {N})::int as bucket from keyed", "keyed"),
)
def ext02(spark, d):
    """A user's opaque step over Arrow batches, here one that names the receiving task."""
    rows = L.keyed(spark, d).select("id", "keyfield")
    schema = rows.withColumn("bucket", F.lit(None).cast("int")).schema
    return steps.opaque(rows, lambda batch: steps.with_bucket(batch, "keyfield", N), schema)
