"""Benchmark decontamination by winnowing.

Texts become words. Every run of ``SPAN`` words has ``SPAN - GRAM + 1`` word k-grams; the
smallest of their hashes is the run's mark, so equal runs have equal marks and every shared
span of ``SPAN`` words or more is found. A bitmap of fixed size holds the marks of all benchmark
items; document runs whose mark is in it go to a join by mark, which compares the runs word for word and
extends each hit over the words it covers. An item of fewer words is one run of its own length.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowplace.llm.common import BITMAP, drop_keys, per_chunk, sketch, text_of
from flowplace.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPAN = 10  # words of a run
GRAM = 5  # words of a hashed k-gram
MARK_BITS = 1 << 24  # 2 MB bitmap of the items' marks
# ASCII characters that end a word; letters have been lower-cased before. Fixed values.
BREAKS = bytes.maketrans(
    bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]), b" " * (0x30 + (0x61 - 0x3A) + 5)
)


def words_of(text: str | None) -> list[bytes]:
    """Runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z, as UTF-8."""
    return (text or "").encode().lower().translate(BREAKS).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words from the words' hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = (out ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def marks(hashes: np.ndarray, n: int) -> np.ndarray:
    """Mark of every run of ``n`` words: the smallest k-gram hash, or for short runs the run's own hash."""
    if n < SPAN:
        return gram_hashes(hashes, n)
    grams = gram_hashes(hashes, GRAM)
    count = len(hashes) - SPAN + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    low = grams[:count]
    for i in range(1, SPAN - GRAM + 1):
        low = np.minimum(low, grams[i : i + count])
    return low


def item_runs(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Rows (item_id STRING, n, mark, run) of all runs of all items; ids as text, a null id as empty text."""
    rows = items.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item_id"), text_of(f"`{text}`").alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, sizes, found, runs = [], [], [], []
        for item, body in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = words_of(body)
            n = min(len(words), SPAN)
            if n:
                low = marks(word_hashes(words), n)
                ids += [item] * len(low)
                sizes += [n] * len(low)
                found.append(low)
                runs += [b" ".join(words[i : i + n]).decode() for i in range(len(low))]
        low = np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.string()), pa.array(sizes, pa.int32()), pa.array(low), pa.array(runs, pa.string())],
            ["item_id", "n", "mark", "run"],
        )

    return rows.mapInArrow(per_chunk(work, "text"), "item_id string, n int, mark bigint, run string")


def collect_marks(runs: DataFrame) -> np.ndarray:
    """The bitmap of all marks as bytes: 2 MB at most, whatever the number of items."""
    out = np.zeros(MARK_BITS // 8, np.uint8)
    for row in sketch(runs, "mark", MARK_BITS).toLocalIterator():
        at = (row["sketch_no"] - 1) * (BITMAP // 8)
        out[at : at + BITMAP // 8] = np.frombuffer(row["sketch_bits"], np.uint8)
    return out


def likely_runs(docs: DataFrame, runs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Per row of ``docs``: row, doc_id, text_key, n_words and the runs whose mark some item may have."""
    bitmap = docs.sparkSession.sparkContext.broadcast(collect_marks(runs))
    lengths = sorted(r["n"] for r in runs.select("n").distinct().collect())  # SPAN values at most
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(f"`{text}`").alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = bitmap.value
        totals, counts, start, size, mark, run = [], [], [], [], [], []
        for body in batch.column("text").to_pylist():
            words = words_of(body)
            totals.append(len(words))
            hashes = word_hashes(words)
            before = len(start)
            for n in lengths:
                low = marks(hashes, n)
                place = low & np.uint64(MARK_BITS - 1)
                known = (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1
                hit = np.flatnonzero(known)
                start += hit.tolist()
                size += [n] * len(hit)
                mark += low[hit].view(np.int64).tolist()
                run += [b" ".join(words[i : i + n]).decode() for i in hit.tolist()]
            counts.append(len(start) - before)
        found = pa.StructArray.from_arrays(
            [pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(mark, pa.int64()), pa.array(run, pa.string())],
            ["start", "n", "mark", "run"],
        )
        ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(totals, pa.int64()), pa.ListArray.from_arrays(ends, found)],
            ["doc_id", "text_key", "n_words", "found"],
        )

    rows = rows.withColumn("text_key", F.xxhash64("text"))
    shape = rows.select(
        "doc_id", "text_key", F.lit(0).cast("long").alias("n_words"), F.expr("array(struct(0 as start, 0 as n, 0L as mark, '' as run))").alias("found")
    ).schema
    scanned = rows.mapInArrow(per_chunk(work, "text"), shape)
    return materialise(scanned.withColumn("row", F.monotonically_increasing_id()), "winnow")


def hits(scanned: DataFrame, runs: DataFrame) -> DataFrame:
    """(row, text_key, start, n, run) of every document run that is word for word a run of some item."""
    spread = scanned.select("row", "text_key", F.explode("found").alias("f")).select("row", "text_key", "f.*")
    return spread.join(runs.select("n", "mark", "run").distinct(), ["n", "mark", "run"], "left_semi")


def covered(spans: Column) -> Column:
    """Words inside the union of an array of (start, n)."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))

    def add(state, span):
        end = span["start"] + span["n"]
        more = F.greatest(F.lit(0), end - F.greatest(state["end"], span["start"]))
        return F.struct(F.greatest(state["end"], end).alias("end"), (state["total"] + more).alias("total"))

    return F.aggregate(F.array_sort(spans), zero, add, lambda s: s["total"])


def decontaminate(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, items (ids as sorted text), contaminated.

    ``n_hit`` counts the words inside any run of an item. Null and empty texts have no words;
    items without words have no runs; items that share an id count once; an item without id is listed
    as empty text. Repeated documents each get a row; no documents give no rows and no items give
    no hits. Other columns are ignored.
    """
    runs = materialise(item_runs(items, item_id, item_text), "winnow")
    scanned = likely_runs(docs, runs, doc_id, text)
    hit = materialise(hits(scanned, runs), "winnow")
    # A document's spans and its items are bounded by its own words and its own hits.
    spans = hit.groupBy("row").agg(covered(F.collect_list(F.struct("start", "n"))).alias("n_hit"))
    where = hit.select("row", "n", "mark", "run").distinct()
    owners = where.join(runs.distinct(), ["n", "mark", "run"]).select("row", "item_id").distinct()
    named = owners.groupBy("row").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    return (
        scanned.select("row", "doc_id", "n_words")
        .join(spans, "row", "left")
        .join(named, "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        )
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, that share no run with any item. Rules as in :func:`decontaminate`.

    Rows are told apart by a 64-bit hash of their text; equal texts share the verdict.
    """
    runs = materialise(item_runs(items), "winnow")
    scanned = likely_runs(docs, runs, doc_id, text)
    losers = materialise(hits(scanned, runs).select("text_key").distinct(), "winnow")
    return drop_keys(docs, F.xxhash64(text_of(f"`{text}`")), losers, "text_key")
