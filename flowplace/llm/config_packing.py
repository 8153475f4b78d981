"""Packing documents into fixed-length sequences by a configuration linear program.

What a sequence may hold depends on lengths alone, and there are at most ``capacity`` of those. So the
packing is decided on the histogram of lengths, whatever the number of documents:

1. One scan encodes every document, cuts those beyond the capacity, and writes the pieces.
2. The histogram (at most ``capacity`` rows) goes to the driver. A *configuration* is a multiset of lengths that fits one
   sequence. The linear program asks for the smallest total use of configurations that covers the histogram.
   It is solved by multiplicative weights: each length has a weight, a knapsack dynamic program prices configurations, the one
   of greatest price and, for every length, the best one that holds it are used if they come near that price, and the
   lengths they cover lose weight.
3. Uses are rounded down, then up as far as pieces are left, and what is left is solved again until nothing is. Every sequence
   is a configuration of the program.
4. Pieces are ranked by length. The places that the used configurations offer are ranked by length too, so
   a piece's rank *is* its place: a search in a table of runs, without a join.
"""

from __future__ import annotations

import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowplace.llm.byte_level import worker_encoder
from flowplace.llm.common import partitions_of, per_chunk, ranked, running_base, text_of
from flowplace.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 2_048
END_ID = 0
ROUNDS = 8  # times the linear program prices configurations
PHASES = 6  # times the rest is solved in so many rounds; the last few pieces are priced once each time
STARTS = (1.0, 1.2)  # powers of the length that prices start with: 1 where sequences can be filled, more where long pieces are in the way
NEAR = 0.98  # share of the greatest price from which on a configuration is used
RATE = 0.5  # how fast a covered length loses weight
CHUNK = 1 << 20  # bytes of text that are encoded at once


class Run(NamedTuple):
    """``count`` sequences from number ``base`` on that all hold the same lengths: (length, copies, offset of the first)."""

    base: int
    count: int
    held: list[tuple[int, int, int]]


class Packing(NamedTuple):
    runs: list[Run]
    sequences: int
    bound: float  # no packing needs fewer: value of a feasible dual solution, rounded up by the caller


Configuration = tuple[np.ndarray, np.ndarray]  # lengths, and how many of each


class Prices(NamedTuple):
    """Greatest price of what is held up to each size, and the items (length, copies) that lead there."""

    best: np.ndarray
    items: list[tuple[int, int]]
    last: list[np.ndarray]  # per item and size: the last item taken, of those so far; -1 for none

    def held(self, size: int, *more: int) -> Configuration:
        """The configuration of greatest price up to ``size``, and ``more`` lengths."""
        found, at = Counter(more), len(self.items)
        while at and (at := int(self.last[at - 1][size])) >= 0:
            length, copies = self.items[at]
            found[length] += copies
            size -= length * copies
        return np.array(list(found), np.int64), np.array(list(found.values()), np.int64)


def prices(price: np.ndarray, most: np.ndarray, capacity: int) -> Prices:
    """The knapsack table over lengths (index), at most ``most`` of each.

    Copies are taken in powers of two, so a length costs the logarithm of its copies. Long lengths come first, and among equal prices
    they stay, so short ones are kept for the gaps.
    """
    best, items, rows = np.zeros(capacity + 1), [], []
    last = np.full(capacity + 1, -1, np.int32)
    for length in np.flatnonzero(most)[::-1].tolist():
        left, size = int(min(most[length], capacity // length)), 1
        while left > 0:
            copies = min(size, left)
            width = copies * length
            worth = best[:-width] + copies * price[length]
            last = last.copy()
            np.copyto(last[width:], len(items), where=worth > best[width:])
            np.maximum(best[width:], worth, out=best[width:])
            items.append((length, copies))
            rows.append(last)
            left, size = left - copies, size * 2
    return Prices(best, items, rows)


def knapsack(price: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """Copies of each length (index) with the greatest total price, at most ``most`` of each, in one sequence."""
    out = np.zeros(len(most), np.int64)
    lengths, copies = prices(price, most, capacity).held(capacity)
    out[lengths] = copies
    return out


def weigh(demand: np.ndarray, capacity: int, rounds: int, start: float = 1.0) -> tuple[list[tuple[Configuration, float]], float]:
    """Fractional uses ``(configuration, uses)`` that together cover about ``demand``, and the best lower bound seen.

    Prices start at ``length ** start``; 1 is the dual solution that is exact where sequences can be filled. The first
    configuration is always one that ``demand`` can pay for.
    """
    length, need = np.flatnonzero(demand), demand.astype(np.float64)
    weight = length**start * need[length]
    weight /= weight.sum()
    uses, covered, bound = [], np.zeros(len(need)), 0.0
    for _ in range(rounds):
        price = np.zeros(len(need))
        price[length] = weight / need[length]
        table = prices(price, demand, capacity)
        top = table.best[capacity]
        bound = max(bound, weight.sum() / top)
        near = length[price[length] + table.best[capacity - length] >= NEAR * top][::-1]
        before = covered.copy()
        for own in [None, *near.tolist()]:
            if own is not None and covered[own] >= need[own]:
                continue
            held, copies = table.held(capacity) if own is None else table.held(capacity - own, own)
            if (copies > demand[held]).any():
                continue
            # The use after which its scarcest length is covered.
            step = float((np.maximum(need[held] - covered[held], 0.0) / copies).min())
            if step > 0:
                uses.append(((held, copies), step))
                covered[held] += step * copies
        weight = weight * np.exp(-RATE * np.minimum(1.0, (covered - before)[length] / need[length]))
        weight /= weight.sum()
        if (covered >= need).all():
            break
    return uses, bound


def fill(opened: list[tuple[np.ndarray, int]], left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Best fit, which the program is held against; no packing is made by it. For what is ``left``: the longest that still fits, into opened sequences first, fullest first, then into new ones.

    Equal sequences are filled at once, so the work follows the number of lengths and not that of pieces.
    """
    left, out = left.copy(), []
    size = np.arange(len(left))
    opened = sorted(opened, key=lambda u: -int(u[0] @ size))
    while opened or left.any():
        base, open_ = opened.pop(0) if opened else (np.zeros(len(left), np.int64), int(left.sum()))
        while open_:
            shape, room = base.copy(), capacity - int(base @ size)
            fits = np.flatnonzero(left[: room + 1])
            while len(fits):
                length = fits[-1]
                copies = min(room // length, left[length])
                shape[length] += copies
                room -= copies * length
                fits = fits[:-1]
                fits = fits[: np.searchsorted(fits, room, "right")]
            held = np.flatnonzero(shape - base)
            if not len(held):
                if base.any():
                    out.append((base, open_))
                break
            count = min(open_, int((left[held] // (shape - base)[held]).min()))
            left[held] -= count * (shape - base)[held]
            out.append((shape, count))
            open_ -= count
    return out


def solved(histogram: np.ndarray, capacity: int, rounds: int, phases: int, start: float = 1.0) -> tuple[list[tuple[Configuration, int]], float]:
    """Whole uses of configurations that hold all pieces, and the lower bound of the first solution."""
    left, bound, phase = histogram.copy(), 0.0, 0
    chosen: Counter[tuple[tuple[int, ...], tuple[int, ...]]] = Counter()
    while left.any():
        uses, low = weigh(left, capacity, rounds if phase < phases else 1, start)
        bound = low if phase == 0 else bound
        uses.sort(key=lambda u: -u[0][0].max())
        for down in (True, False):
            for (held, copies), step in uses:
                count = min(int(step) if down else 1, int((left[held] // copies).min()))
                if count:
                    left[held] -= count * copies
                    chosen[tuple(held.tolist()), tuple(copies.tolist())] += count
        phase += 1
    return [((np.array(held), np.array(copies)), count) for (held, copies), count in chosen.items()], bound


def plan(histogram: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS, phases: int = PHASES) -> Packing:
    """How often to use which configuration, so that all pieces of the histogram (index: length) have a place.

    The program is solved from each of STARTS, unless a solution meets the bound; the one with the fewest sequences is used.
    """
    histogram = np.array(histogram, np.int64)
    tokens = float(histogram @ np.arange(len(histogram)))
    chosen, bound, fewest = [], tokens / capacity, np.inf
    for start in STARTS:
        found, low = solved(histogram, capacity, rounds, phases, start)
        total, bound = sum(count for _, count in found), max(bound, low)
        if total < fewest:
            chosen, fewest = found, total
        if fewest < bound - 1e-6 + 1:
            break
    runs, base = [], 0
    for (lengths, copies), count in chosen:
        held, offset = [], 0
        for length, n in sorted(zip(lengths.tolist(), copies.tolist(), strict=True), reverse=True):
            held.append((length, n, offset))
            offset += length * n
        runs.append(Run(base, count, held))
        base += count
    return Packing(runs, base, bound)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, doc_id: str, text: str) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32, ids): ids as little-endian u32. ``row`` tells the written pieces apart.

    Every document ends with ``end_id``. One beyond the capacity is cut so that only its *first* piece may be shorter: the others fill a
    sequence each, and just the short one has to be packed.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(f"`{text}`").alias("text"))

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = worker_encoder(tokenizer, False).encode(batch.column("text").to_pylist())
        sizes = np.array([len(x) + 1 for x in found], np.int64)
        n = -(-sizes // capacity)
        owner = np.repeat(np.arange(len(n)), n)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        first = sizes - (n - 1) * capacity
        start = np.where(number == 0, 0, first[owner] + (number - 1) * capacity)
        length = np.where(number == 0, first[owner], capacity)
        end = np.array([end_id], "<u4")
        data = np.concatenate([np.empty(0, "<u4"), *[a for x in found for a in (x, end)]]).astype("<u4")
        bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(length * 4)])
        view = memoryview(data).cast("B")
        crc = [zlib.crc32(view[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        packed = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(owner)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), packed.cast(pa.binary())],
            ["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for batch in per_chunk(encode, "text", CHUNK)(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + batch.num_rows)), *batch.columns], ["row", *batch.schema.names])
            at += batch.num_rows

    kind = rows.schema["doc_id"].dataType.simpleString()
    shape = f"row bigint, doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"
    return materialise(rows.mapInArrow(work, shape), "packing-pieces")


def place(pieces: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, Packing]:
    """``pieces`` (with ``length``, 1 to ``capacity``) with ``sequence_id`` and ``offset``, and the packing they follow."""
    counts = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts:
        histogram[r["length"]] = r["count"]
    packing = plan(histogram, capacity)
    # Places in the order of lengths: per configuration and length one run of places.
    table = [(length, r.base, copies, r.count * copies, offset) for r in packing.runs for length, copies, offset in r.held]
    table.sort()
    columns = [np.array(c, np.int64) for c in zip(*table, strict=True)] if table else [np.zeros(1, np.int64)] * 5
    lengths, bases, copies, places, offsets = columns
    starts = np.cumsum(places) - places
    ranks = ranked(pieces, ["length", "row"], partitions_of(pieces), "packing-ranks")
    before = running_base(ranks.groupBy("part").agg(F.count("*").alias("size")), "part", "size", "before")
    at = ranks.join(F.broadcast(before), "part").withColumn("at", F.col("before") + F.col("place")).drop("part", "place", "before")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("at").to_numpy()
            run = np.searchsorted(starts, rank, "right") - 1
            own = rank - starts[run]
            sequence = bases[run] + own // copies[run]
            offset = offsets[run] + own % copies[run] * lengths[run]
            kept = [c for c in batch.schema.names if c != "at"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    zero = F.lit(0).cast("long")
    shape = pieces.withColumns({"sequence_id": zero, "offset": zero}).schema
    return at.mapInArrow(work, shape), packing


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Pack all documents; returns (placements, pieces).

    ``placements``: row, doc_id, piece, start, length, ids_crc32, sequence_id, offset, one row per piece. ``pieces``: row and its
    ``ids``. ``tokenizer`` is a file of the tokenizers library. Null and empty texts are one piece of the end id alone. Null
    ids are documents like any other, repeated rows are packed each, an empty table gives no pieces, other columns are ignored.
    """
    pieces = token_pieces(docs, tokenizer, capacity, end_id, doc_id, text)
    placed, _ = place(pieces.drop("ids"), capacity)
    return placed, pieces.select("row", "ids")


def sequences(placements: DataFrame, pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (little-endian u32), and per piece where it lies (spans: doc_id, piece, offset, length).

    A sequence holds at most the capacity, so a group is bounded.
    """
    joined = placements.join(pieces, "row").select("sequence_id", F.struct("offset", "length", "doc_id", "piece", "ids").alias("held"))
    whole = joined.groupBy("sequence_id").agg(F.array_sort(F.collect_list("held")).alias("held"))
    return whole.select(
        "sequence_id",
        F.unhex(F.array_join(F.transform("held", lambda h: F.hex(h["ids"])), "")).alias("ids"),
        F.transform("held", lambda h: F.struct(h["doc_id"].alias("doc_id"), h["piece"].alias("piece"), h["offset"].alias("offset"), h["length"].alias("length"))).alias("spans"),
    )
