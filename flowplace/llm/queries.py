"""The registered queries of this folder and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowplace.llm import (
    chat_trie,
    config_packing,
    exact_refine,
    hilbert_shards,
    piece_trie,
    prefix_centroid,
    quality_pu,
    secret_battery,
    simhash_pivots,
    token_align,
    token_blocks,
    url_markov,
    winnow,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; the executors have the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query(
    "op2_exact_refine",
    """
    select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
           row_number() over (partition by coalesce(text, '') order by doc_id desc nulls last) = 1 as kept,
           sha256(coalesce(text, '')) as text_sha256
    from documents window same as (partition by coalesce(text, ''))
    """,
)
def op2(spark: SparkSession, d: str) -> DataFrame:
    return exact_refine.exact_groups(table(spark, d, "documents"), digest_all=True)


@query("op6_hilbert_shards")
def op6(spark: SparkSession, d: str) -> DataFrame:
    rows = hilbert_shards.hilbert_shards(table(spark, d, "documents"))
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
        "d_source",
        "d_lang",
        "d_id",
        "d_size",
    )


@query("op5_simhash_pivots")
def op5(spark: SparkSession, d: str) -> DataFrame:
    rows = simhash_pivots.near_components(table(spark, d, "documents"))
    return rows.select("doc_id", simhash_pivots.hex_text("fingerprint").alias("fingerprint"), "component_id")


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # a word of the decontamination rule
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op7_winnow",
    f"""
    with d as (select row_number() over () as r, doc_id, regexp_extract_all({LOWER}, '{WORD}') as w from documents),
    i as (select coalesce(cast(item_id as varchar), '') as item_id, regexp_extract_all({LOWER}, '{WORD}') as w from benchmark),
    runs as (
      select distinct item_id, n, array_to_string(w[s + 1 : s + n], ' ') as run
      from (select *, unnest(range(len(w) - n + 1)) as s from (select *, least(len(w), 10) as n from i where len(w) > 0))
    ),
    lengths as (select distinct n from runs),
    spans as (
      select r, n, s, array_to_string(w[s + 1 : s + n], ' ') as run
      from (select *, unnest(range(len(w) - n + 1)) as s from d join lengths on len(w) >= n)
    ),
    hit as (select * from spans where (n, run) in (select n, run from runs)),
    covered as (select r, count(distinct p) as n_hit from (select r, unnest(range(s, s + n)) as p from hit) group by r),
    named as (
      select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
      from (select distinct r, item_id from hit join runs using (n, run)) group by r
    )
    select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
           sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from d left join covered using (r) left join named using (r)
    """,
)
def op7(spark: SparkSession, d: str) -> DataFrame:
    rows = winnow.decontaminate(table(spark, d, "documents"), table(spark, d, "benchmark"))
    ids = F.array_join("items", ",").cast("binary")
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        "contaminated",
    )


@query("op1_quality_pu")
def op1(spark: SparkSession, d: str) -> DataFrame:
    return quality_pu.score_quality(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op3_url_markov")
def op3(spark: SparkSession, d: str) -> DataFrame:
    return url_markov.judge_urls(table(spark, d, "pages"))


@query("op4_token_blocks")
def op4(spark: SparkSession, d: str) -> DataFrame:
    files = token_blocks.write_blocks(table(spark, d, "documents"), vocabulary("word_bpe_49k.json"))
    return token_blocks.read_blocks(files)


@query("op8_secret_battery")
def op8(spark: SparkSession, d: str) -> DataFrame:
    rows = secret_battery.find_secrets(table(spark, d, "documents"))
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == secret_battery.KINDS.index(k))).cast("long").alias(f"n_{k}")
    return rows.select(
        "doc_id",
        of("assign"),
        of("access"),
        of("hex"),
        F.sha2(secret_battery.span_text("base").cast("binary"), 256).alias("base_sha256"),
        secret_battery.span_text("spans").alias("spans"),
    )


@query("op9_chat_trie")
def op9(spark: SparkSession, d: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string"
    )
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    model = vocabulary("byte_bpe_50k.json")
    read = chat_trie.read_tree(*chat_trie.write_tree(turns, model), model)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("learnt", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op10_piece_trie")
def op10(spark: SparkSession, d: str) -> DataFrame:
    model = vocabulary("piece_bpe_32k.model")
    docs = table(spark, d, "documents")
    return piece_trie.round_trip(docs, model)


@query("op11_token_align")
def op11(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = token_align.align(
        table(spark, d, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), digest=True
    )
    return rows.withColumn("doc_id", F.col("doc_id").cast("long")).withColumnRenamed("groups", "groups_sha256")


@query("op12_config_packing")
def op12(spark: SparkSession, d: str) -> DataFrame:
    placed, _ = config_packing.pack(table(spark, d, "documents"), vocabulary("byte_bpe_50k.json"))
    return placed.drop("row")


# Unsigned CRC-32 of a decimal number, bit by bit: a code of -1 stands for a shift.
CRC32 = """xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(cast(c as varchar), ''),
            lambda x: list_concat([ascii(x)::bigint], [-1, -1, -1, -1, -1, -1, -1, -1]::bigint[])))),
          lambda crc, x: case when x >= 0 then xor(crc, x) else xor(crc >> 1, case when crc & 1 = 1 then 3988292384 else 0 end)::bigint end),
        4294967295::bigint)"""


@query(
    "op13_prefix_centroid",
    f"""
    with own as (
      select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as n,
             coalesce(role, '') as role, coalesce(text, '') as txt from conversations where conv_id is not null
    ),
    takes as (select c, c - c % 100 as base, {CRC32} % 6 as h from (select distinct c from own)),
    firsts as (select t.c, o.n as i, o.role, o.txt from takes t join own o on o.c = t.base and o.n <= t.h),
    lent as (select c, count(*) as k from firsts group by c),
    turns as (
      select * from firsts union all
      select o.c, o.n - t.h + coalesce(k, 0), o.role, o.txt from own o join takes t using (c) left join lent using (c) where o.n > t.h
    ),
    lines as (
      select takes.c, coalesce(said, []) as said from takes
      left join (select c, list(length(role) || ':' || role || length(txt) || ':' || txt order by i) as said from turns group by c) using (c)
    ),
    steps as (
      select c, d, md5(array_to_string(said[1 : d], '|')) as key, case when d > 0 then md5(array_to_string(said[1 : d - 1], '|')) end as up, d = len(said) as ends
      from (select *, unnest(range(len(said) + 1)) as d from lines)
    ),
    nodes as (
      select d, key, any_value(up) as up, min(c) as conv_id, count(*) as n_convs,
             sha256(coalesce(string_agg(c, ',' order by c) filter (where ends), '')) as ends_sha256
      from steps group by d, key
    ),
    own_part as (
      select n.*, (n_convs - 1) * coalesce(length(t.txt), 0) as saved, coalesce(k.n, 0) as n_children
      from nodes n left join turns t on t.c = n.conv_id and t.i = n.d
      left join (select d - 1 as d, up as key, count(*) as n from nodes where d > 0 group by d, up) k on k.d = n.d and k.key = n.key
    ),
    totals as (
      select s.d, s.key, sum(case when o.n_children = 0 then 1 else 0 end) as n_leaves, sum(o.saved) as saved_tokens
      from own_part o join steps s on s.c = o.conv_id and s.d <= o.d group by s.d, s.key
    )
    select o.conv_id, o.d as depth, p.conv_id as parent_conv_id, o.n_convs, cast(o.n_children as bigint) as n_children,
           cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, o.ends_sha256
    from own_part o join totals using (d, key) left join nodes p on p.d = o.d - 1 and p.key = o.up
    """,
)
def op13(spark: SparkSession, d: str) -> DataFrame:
    return prefix_centroid.prefix_trie(*prefix_centroid.rebuilt(table(spark, d, "conversations")))
