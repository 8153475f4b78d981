"""Exact duplicates by progressive refinement: length, then hash of the beginning, then hash of the whole.

One scan reads the length and the first characters of every text. Texts whose length, or whose
length and beginning, no other text shares are unique and done. Only the rest are hashed in
full, in a second scan. What that scan must know is a bitmap of fixed size, so no text is
shuffled to find the candidates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowplace.llm.common import flag, sketch, text_of
from flowplace.session import materialise

PREFIX = 64  # characters of the beginning


def _marked(docs: DataFrame, text: str) -> DataFrame:
    body = text_of(text)
    return docs.withColumn("refine_size", F.octet_length(body).cast("long")).withColumn(
        "refine_key", F.xxhash64("refine_size", F.substring(body, 1, PREFIX))
    )


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Keys ``refine_key`` of the groups that survive length and prefix hash."""
    seen = _marked(docs.select(F.col(f"`{text}`").alias("text")), "text")
    pairs = materialise(seen.groupBy("refine_size", "refine_key").count(), "refine")
    lengths = pairs.groupBy("refine_size").agg(F.sum("count").alias("n")).filter("n > 1").select("refine_size")
    left = pairs.filter("count > 1").join(lengths, "refine_size", "left_semi")
    return materialise(left.select("refine_key"), "refine")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. The row with the largest doc_id
    stays; a null id is smaller than any other, and of repeated rows with that id one stays.
    A group with null ids only keeps one of its rows (keep_id null). ``text_sha256`` is null for texts that were
    never hashed in full, unless ``digest_all``. An empty table gives no rows; other columns
    of ``docs`` are ignored, whatever their names.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    marked = flag(_marked(rows, "text"), "refine_key", "shared", sketch(candidates(rows), "refine_key"))
    full = F.sha2(text_of().cast("binary"), 256)
    hashed = marked.select("doc_id", "shared", (full if digest_all else F.when(F.col("shared"), full)).alias("text_sha256"))
    hashed = materialise(hashed, "refine")
    single = hashed.filter("not shared").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    ids = hashed.filter("shared").groupBy("text_sha256", "doc_id").agg(F.count("*").alias("copies"))
    groups = ids.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    # Written, so that the join is between two plain shuffles and a group of very many copies can be split.
    groups = materialise(groups, "refine")
    # A repeated row has the same id and text: count it once, then write it out again.
    grouped = (
        ids.join(groups, "text_sha256")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            "text_sha256",
        )
    )
    return single.unionByName(grouped)


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rules as in :func:`exact_groups`. Rows that may have a copy go through a shuffle with their
    texts, all others do not.
    """
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    rows = packed.select("row", F.col(f"row.`{doc_id}`").alias("doc_id"), F.col(f"row.`{text}`").alias("text"))
    found = candidates(rows.select("text"))
    marked = flag(_marked(rows, "text"), "refine_key", "shared", sketch(found, "refine_key"))
    marked = marked.withColumn("digest", F.when(F.col("shared"), F.sha2(text_of().cast("binary"), 256)))
    shared = marked.filter("shared")
    keep = shared.groupBy("digest").agg(F.max("doc_id").alias("keep_id")).select(
        F.col("digest").alias("keep_digest"), "keep_id"
    )
    stay = shared.join(
        keep, (F.col("digest") == F.col("keep_digest")) & F.col("doc_id").eqNullSafe(F.col("keep_id")), "left_semi"
    )
    once = stay.groupBy("digest").agg(F.first("row").alias("row"))
    return marked.filter("not shared").select("row.*").unionByName(once.select("row.*"))
