"""Near duplicates by SimHash fingerprints, pivot distance tables and a final check.

A fingerprint is compared with a set of reference fingerprints once, and the distances are kept
next to it. Two fingerprints whose distances to any reference differ by more than the radius can't
be within the radius (triangle inequality), so the pair is discarded on small integers; only
survivors are compared bit by bit.

Pairs meet by key, never in a cross join: of five blocks of a 64-bit fingerprint, three
differing bits leave two blocks untouched, so every pair within three bits shares one of
the ten pairs of blocks. Nothing within the radius is lost. All work is on distinct
fingerprints; copies take part once.

Near copies at a similarity of shingle sets may be far beyond three bits. Fingerprints and pivots propose their pairs first; the rest
meet by the first shingles of their sets in one order, parity sketches discard pairs, and the sets themselves decide on all.
"""

from __future__ import annotations

import itertools
import sys
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowplace.llm.common import components, discard, flag, per_chunk, sketch, text_of
from flowplace.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED = 42
PIVOTS = 16
BLOCK = 1 << 16  # shingles whose bits are counted at once
OFTEN = 8  # texts that make a shingle a frequent one
SKETCH = 2  # bits per shingle, at least, of the sketch that bounds the difference of two sets from below
FOLDED = 256  # bits of the sketch that go along where pairs meet; its least size is twice that
FREQUENT = 1 << 16  # frequent shingles that are told apart; the only thing of the near copies that tasks carry


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: spreads 64-bit integers; its constants are fixed values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words, A-Z lower-cased; one hash for a shorter text, none for none."""
    import xxhash

    found = text.encode().lower().split()  # both act on ASCII alone
    if not found:
        return np.empty(0, np.uint64)
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1])
    n = max(1, len(found) - words + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[min(words, len(found)) - 1 :].tolist(), strict=True)
    return np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64, n)


def majority(hashes: np.ndarray) -> np.ndarray:
    """Bits set in over half the hashes."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.uint32)
    return total * 2 > len(hashes)


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as signed 64-bit words, lowest bit first."""
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64)


def fingerprints(docs: DataFrame, words: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fingerprint BIGINT)`` of whole texts; no word gives zero."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(f"`{text}`").alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = np.zeros((batch.num_rows, 64), bool)
        for i, body in enumerate(batch.column("text").to_pylist()):
            bits[i] = majority(shingle_hashes(body, words))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed(bits)[:, 0])], ["doc_id", "fingerprint"])

    return rows.mapInArrow(per_chunk(work, "text"), rows.select("doc_id", F.lit(0).cast("long").alias("fingerprint")).schema)


def pivot_values(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints by a rule: well-spread 64-bit integers, as signed numbers."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64).tolist()


def pivot_table(prints: DataFrame, word: str = "fingerprint", n: int = PIVOTS) -> DataFrame:
    """``prints`` with its distance to each reference as TINYINT columns ``p0, p1, ...``."""
    distance = [
        F.bit_count(F.col(word).bitwiseXOR(F.lit(v))).cast("tinyint").alias(f"p{i}") for i, v in enumerate(pivot_values(n))
    ]
    return prints.select("*", *distance)


def block_masks(radius: int, bits: int = 64) -> list[int]:
    """Masks of two of ``radius + 2`` blocks; any pair within the radius agrees on one of them."""
    edges = [round(i * bits / (radius + 2)) for i in range(radius + 3)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    masks = [x | y for x, y in itertools.combinations(blocks, 2)]
    return np.array(masks, np.uint64).view(np.int64).tolist()


def links(prints: DataFrame, radius: int) -> DataFrame:
    """Pairs ``(a, b)`` of distinct fingerprints at most ``radius`` bits apart, ``a < b``."""
    masked = [F.struct(F.lit(i).alias("n"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(block_masks(radius))]
    keyed = pivot_table(prints.select("fingerprint").distinct()).withColumn("key", F.explode(F.array(*masked)))
    keyed = keyed.select("key.n", "key.v", "fingerprint", *[f"p{i}" for i in range(PIVOTS)])
    a, b = keyed.alias("a"), keyed.alias("b")
    gap = F.greatest(*[F.abs(F.col(f"a.p{i}") - F.col(f"b.p{i}")) for i in range(PIVOTS)])
    apart = F.bit_count(F.col("a.fingerprint").bitwiseXOR(F.col("b.fingerprint")))
    near = (
        (F.col("a.n") == F.col("b.n"))
        & (F.col("a.v") == F.col("b.v"))
        & (F.col("a.fingerprint") < F.col("b.fingerprint"))
        & (gap <= radius)
        & (apart <= radius)
    )
    return a.join(b, near).select(F.col("a.fingerprint").alias("a"), F.col("b.fingerprint").alias("b")).distinct()


def near_components(docs: DataFrame, words: int = 3, radius: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint BIGINT, component_id.

    ``component_id`` is the smallest doc_id reachable over links, the row itself included; null
    ids are passed over, so it is null where a component has no other. Null and empty texts have
    no words and fingerprint zero, and link like any other. Repeated rows share a fingerprint
    and each come back; an empty table gives no rows; other columns of ``docs`` are ignored.
    """
    prints = materialise(fingerprints(docs, words, doc_id, text), "simhash")
    heads = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("low"))
    root = components(links(prints, radius))
    placed = heads.join(root, heads.fingerprint == root.node, "left").select(
        "fingerprint", "low", F.coalesce("root", "fingerprint").alias("root")
    )
    placed = materialise(placed, "simhash")
    lows = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    names = placed.join(lows, "root").select("fingerprint", "component_id")
    return prints.join(names, "fingerprint").select("doc_id", "fingerprint", "component_id")


def hex_text(column: str) -> Column:
    """A 64-bit word as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


# Near duplicates at a similarity of shingle sets -----------------------------------------


def exact_share(similarity: float) -> tuple[int, int]:
    """The similarity as written, as numerator and denominator: no rounding decides at the limit."""
    return Fraction(str(similarity)).as_integer_ratio()


def frequent_shingles(docs: DataFrame, words: int, text: str) -> list[int]:
    """Shingles of many texts, the rarest first; at most FREQUENT of them.

    They only set the order of shingles, which may be any: a list that is too short costs time and
    changes no result. Counted are shingles that come twice within a chunk of texts.
    """
    rows = docs.select(text_of(f"`{text}`").alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingle_hashes(body, words)) for body in batch.column("text").to_pylist()]
        found, n = np.unique(np.concatenate(sets), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found[n > 1].view(np.int64)), pa.array(n[n > 1])], ["shingle", "n"])

    counts = rows.mapInArrow(per_chunk(work, "text"), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counts.filter(F.col("n") >= OFTEN).orderBy(F.desc("n"), "shingle").limit(FREQUENT).select("shingle").collect()
    return [r["shingle"] for r in reversed(top)]


def shingle_prefixes(docs: DataFrame, words: int, similarity: float, last: list[int], doc_id: str, text: str) -> DataFrame:
    """doc_id, row_key, node (digest of the set of shingles), fingerprint, size of the set, its prefix and its sketch.

    All sets are put in one order, shingles in ``last`` behind all others. A set at least ``similarity``
    like this one holds ``ceil(similarity * size)`` of its shingles or more, so what both have in common
    begins within the first ``size - ceil(similarity * size) + 1`` of either: the prefix. A bit of the sketch is the parity of the shingles that
    fall on it, so sketches differ in no more bits than the sets in shingles. It grows with its set: one of fixed size says nothing about a long text.
    """
    over, under = exact_share(similarity)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(f"`{text}`").alias("text")).withColumn(
        "row_key", F.xxhash64("doc_id", "text")
    )
    order = np.array(last, np.int64).view(np.uint64)
    by_hash = np.argsort(order)
    known = order[by_hash]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        import xxhash

        nodes, sizes, prefixes, sketches = [], [], [], []
        bits = np.zeros((batch.num_rows, 64), bool)
        for i, body in enumerate(batch.column("text").to_pylist()):
            found = np.unique(shingle_hashes(body, words))
            bits[i] = majority(found)
            wide = max(2 * FOLDED, 1 << (SKETCH * len(found)).bit_length())
            parity = np.bincount((found % np.uint64(wide)).astype(np.int64), minlength=wide) % 2
            sketches.append(packed(parity.astype(bool)[None])[0])
            nodes.append(xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63))
            sizes.append(len(found))
            if len(known) and len(found):
                at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                found = found[np.argsort(np.where(known[at] == found, by_hash[at] + 1, 0), kind="stable")]
            prefixes.append(found[: len(found) + 1 - -(-over * len(found) // under)].view(np.int64))
        columns = [batch.column("doc_id"), batch.column("row_key"), pa.array(nodes, pa.int64()), pa.array(packed(bits)[:, 0]), pa.array(sizes, pa.int32())]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(prefixes, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
            ["doc_id", "row_key", "node", "fingerprint", "size", "prefix", "sketch"],
        )

    zero = F.lit(0).cast("long")
    empty = [zero.alias("node"), zero.alias("fingerprint"), F.lit(0).alias("size"), F.array(zero).alias("prefix"), F.array(zero).alias("sketch")]
    shape = rows.select("doc_id", "row_key", *empty).schema
    return rows.mapInArrow(per_chunk(work, "text"), shape)


def proposed(sets: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs ``(a, b)`` of nodes whose fingerprints are close, by :func:`links`; nodes of one fingerprint pair with the smallest of them."""
    nodes = sets.select("fingerprint", "node").distinct()
    heads = materialise(nodes.groupBy("fingerprint").agg(F.min("node").alias("head")), "simhash")
    equal = nodes.join(heads, "fingerprint").select(F.col("head").alias("a"), F.col("node").alias("b"))
    side = lambda s: heads.select(F.col("fingerprint").alias(s), F.col("head").alias(f"{s}_head"))
    close = links(heads, radius).join(side("a"), "a").join(side("b"), "b")
    close = close.select(F.least("a_head", "b_head").alias("a"), F.greatest("a_head", "b_head").alias("b"))
    return equal.filter("a <> b").unionByName(close)


def fold(sketch: str, word: Column, width: Column) -> Column:
    """A word of the sketch folded to ``width`` words: parities of shingles again, so they differ in no more bits than the sets."""
    return F.aggregate(F.sequence(word, F.size(sketch), width), F.lit(0).cast("long"), lambda t, at: t.bitwiseXOR(F.element_at(sketch, at)))


def folded() -> list[Column]:
    """The sketch of FOLDED bits as columns ``f0, f1, ...``."""
    words = FOLDED // 64
    return [fold("sketch", F.lit(i + 1), F.lit(words)).alias(f"f{i}") for i in range(words)]


def band_members(sets: DataFrame) -> DataFrame:
    """Nodes that meet others: band, node, pivot (one of the band's nodes), place, size, folded sketch and the upper half of one twice as long.

    Shingles whose prefixes are the same nodes' bring the same pairs, so they are one band, named by a digest of its nodes. All sets are in one
    order, so the smallest places of two nodes in a band are those of the same shingle. Were two digests equal, more pairs would meet, and none less.
    """
    keys = sets.select("node", F.posexplode("prefix").alias("place", "shingle")).repartition("shingle")
    nodes = keys.groupBy("shingle", "node").agg(F.min("place").alias("place"))
    holders = Window.partitionBy("shingle")
    ends = [F.min("node").over(holders).alias("low"), F.max("node").over(holders).alias("high")]
    # Pivots are drawn per shingle: with the smallest node a large group would have the same few in all its bands.
    drawn = F.min(F.struct(F.xxhash64("shingle", "node").alias("draw"), F.col("node").alias("pivot"))).over(holders)
    met = nodes.select("*", *ends, drawn.alias("drawn"), F.bit_xor(F.xxhash64("node")).over(holders).alias("band")).filter("low < high")
    bands = met.groupBy("band", "node").agg(F.min("drawn").getField("pivot").alias("pivot"), F.min("place").alias("place"))
    words = FOLDED // 64
    upper = [fold("sketch", F.lit(words + i + 1), F.lit(2 * words)).alias(f"h{i}") for i in range(words)]
    return bands.join(sets.select("node", "size", *folded(), *upper).dropDuplicates(["node"]), "node")


def finer(similarity: float) -> Column:
    """Sketches of twice FOLDED bits leave room for the similarity: ``h`` is the upper half, which folded onto the lower gives ``f``."""
    over, under = exact_share(similarity)
    words = range(FOLDED // 64)
    upper = [F.col(f"a.h{i}").bitwiseXOR(F.col(f"b.h{i}")) for i in words]
    lower = [F.col(f"a.f{i}").bitwiseXOR(F.col(f"b.f{i}")).bitwiseXOR(upper[i]) for i in words]
    return sum(F.bit_count(x) for x in upper + lower) * (over + under) <= (F.col("a.size") + F.col("b.size")) * (under - over)


def may_be_similar(a: DataFrame, b: DataFrame, similarity: float, *more: Column) -> DataFrame:
    """Pairs ``(a, b)``, ``a < b``, of nodes of two tables that share a band, are of like size, have enough shingles left behind the shared one and folded
    sketches that leave room for the similarity."""
    over, under = exact_share(similarity)
    a, b = a.alias("a"), b.alias("b")
    least = F.least(F.col("a.size"), F.col("b.size"))
    most = F.greatest(F.col("a.size"), F.col("b.size"))
    left = F.least(F.col("a.size") - F.col("a.place"), F.col("b.size") - F.col("b.place"))
    fits = (least * under >= most * over) & (left * (over + under) >= (least + most) * over)
    apart = sum(F.bit_count(F.col(f"a.f{i}").bitwiseXOR(F.col(f"b.f{i}"))) for i in range(FOLDED // 64))
    fits = fits & (apart * (over + under) <= (least + most) * (under - over))
    met = a.join(b, [F.col("a.band") == F.col("b.band"), F.col("a.node") != F.col("b.node"), fits, *more])
    ends = [F.col("a.node"), F.col("b.node")]
    return met.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b")).distinct()


def close_sketches(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` whose sizes and sketches leave room for the similarity. No similar pair is lost, and no set has been moved yet.

    At a Jaccard similarity of t two sets differ in at most ``(1 - t) / (1 + t)`` of the sum of their sizes. The longer sketch is folded to the shorter.
    """
    over, under = exact_share(similarity)
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    likely = flag(sets.select("node", "size", "sketch"), "node", "paired", sketch(nodes, "node")).filter("paired")
    one = likely.dropDuplicates(["node"])
    side = lambda s: one.select(F.col("node").alias(s), F.col("size").alias(f"{s}_size"), F.col("sketch").alias(f"{s}_sketch"))
    width = F.least(F.size("a_sketch"), F.size("b_sketch"))
    level = lambda s: F.when(F.size(s) == width, F.col(s)).otherwise(F.transform(F.sequence(F.lit(1), width), lambda i: fold(s, i, width)))
    bits = F.zip_with(level("a_sketch"), level("b_sketch"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(bits, F.lit(0), lambda t, n: t + n)
    sizes = [F.col("a_size"), F.col("b_size")]
    fits = (F.least(*sizes) * under >= F.greatest(*sizes) * over) & (apart * (under + over) <= (sizes[0] + sizes[1]) * (under - over))
    return materialise(pairs.join(side("a"), "a").join(side("b"), "b").filter(fits).select("a", "b"), "simhash")


def similar_pairs(pairs: DataFrame, sets: DataFrame, docs: DataFrame, words: int, similarity: float, doc_id: str, text: str) -> DataFrame:
    """The pairs ``(a, b)`` whose sets of shingles have the Jaccard similarity or more, by counting both whole sets."""
    over, under = exact_share(similarity)
    near = close_sketches(pairs, sets, similarity)
    nodes = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    likely = flag(sets.select("node", "row_key"), "node", "paired", sketch(nodes, "node")).filter("paired")
    texts = materialise(likely.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("row_key").alias("row_key")), "simhash")
    rows = docs.select(text_of(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{doc_id}`"), text_of(f"`{text}`")).alias("row_key"))
    rows = flag(rows, "row_key", "paired", sketch(texts, "row_key")).filter("paired").select("row_key", "text")
    rows = rows.join(texts, "row_key").dropDuplicates(["row_key"]).select("node", "text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.unique(shingle_hashes(body, words)).view(np.int64) for body in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int64()))], ["node", "held"])

    held = materialise(rows.mapInArrow(per_chunk(work, "text"), "node long, held array<long>"), "simhash")
    side = lambda s: held.select(F.col("node").alias(s), F.col("held").alias(f"{s}_held"))
    both = F.size(F.array_intersect("a_held", "b_held"))
    either = F.size("a_held") + F.size("b_held") - both
    found = materialise(near.join(side("a"), "a").join(side("b"), "b").filter(both * under >= either * over).select("a", "b"), "simhash")
    discard(near, texts, held)
    return found


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows that have a near duplicate: doc_id, row_key, root (the group).

    Texts are similar when the Jaccard similarity of their sets of shingles is ``similarity`` or more. Texts with
    equal sets are one node. Close fingerprints propose pairs; nodes also meet by the shingles of their prefixes, which no similar pair can
    miss; sketches discard pairs before any set is moved, and both whole sets decide. In each band every node is first held against one of them, the pivot, then against all nodes
    that this has not put into its own group. Tables are deleted as soon as their successors are written.
    """
    last = frequent_shingles(docs, words, text)
    sets = materialise(shingle_prefixes(docs, words, similarity, last, doc_id, text), "simhash")
    members = materialise(band_members(sets), "simhash")
    first = may_be_similar(members.filter("node = pivot"), members, similarity, finer(similarity))
    pairs = materialise(proposed(sets).unionByName(first).distinct(), "simhash")
    found = similar_pairs(pairs, sets, docs, words, similarity, doc_id, text)
    root = materialise(components(found), "simhash")
    # All pairs with the pivot are settled; of the others a band needs those of different groups.
    inner = members.filter("node <> pivot").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    inner = materialise(inner, "simhash")
    discard(members)
    open_bands = inner.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("band")
    opened = materialise(inner.join(open_bands, "band", "left_semi"), "simhash")
    discard(inner)
    once = [F.col("a.node") < F.col("b.node"), F.col("a.root") != F.col("b.root"), finer(similarity)]
    rest = may_be_similar(opened, opened, similarity, *once).join(pairs, ["a", "b"], "left_anti")
    rest = materialise(rest, "simhash")
    discard(opened, pairs)
    if not rest.isEmpty():
        root = components(found.unionByName(similar_pairs(rest, sets, docs, words, similarity, doc_id, text)))
    copies = sets.groupBy("node").count().filter("count > 1").select("node")
    grouped = root.unionByName(copies.join(root, "node", "left_anti").select("node", F.col("node").alias("root")))
    groups = materialise(sets.select("doc_id", "row_key", "node").join(grouped, "node").select("doc_id", "row_key", "root"), "simhash")
    discard(sets, rest)
    return groups


def drop_similar(docs: DataFrame, words: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: of every group the one with the smallest doc_id.

    A null id counts as larger than any other; of repeated rows one stays. Texts without words
    are copies of each other. Rows without a near duplicate are passed on without a shuffle.
    """
    groups = similar_groups(docs, words, similarity, doc_id, text)
    keep = groups.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("row_key").alias("key"))).alias("best")
    ).select(F.col("best.key").alias("keep_key"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("row"), F.xxhash64(F.col(f"`{doc_id}`"), text_of(f"`{text}`")).alias("row_key"))
    grouped = groups.select("row_key").distinct()
    marked = flag(rows, "row_key", "grouped", sketch(grouped, "row_key"))
    member = marked.filter("grouped").join(grouped.withColumn("listed", F.lit(True)), "row_key", "left")
    best = (
        member.filter("listed").join(keep, F.col("row_key") == F.col("keep_key"), "left_semi").groupBy("row_key").agg(F.first("row").alias("row"))
    )
    alone = marked.filter("not grouped").select("row.*").unionByName(member.filter("listed is null").select("row.*"))
    return alone.unionByName(best.select("row.*"))
