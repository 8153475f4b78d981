"""Prefix trie of conversations, rolled up by centroid decomposition.

A node is a sequence of first turns. It is named by the smallest conversation that begins with it and by its depth, so
the node above a node at any depth is a look-up of (conversation, depth): no path is ever stored or walked.

Sums over subtrees don't go up edge by edge, which would take as many steps as the longest conversation has turns. The
forest of parent edges is split at centroids instead: the centroid of a component is its lowest node with at least half of its weight
below it. The total of the centroid's own subtree is added to the nodes on the path from the centroid to the component's top, the
centroid is taken out, and what is left are components of at most half the weight. All components are split at the same time,
so the number of rounds is at most the logarithm of the number of turns. A component of at most ``WHOLE`` nodes is finished inside one task by the same rule.

The weight of a node is the number of conversations that pass through it. Its subtree's weight is then a sum over member
conversations, known as soon as nodes are grouped, so centroids need no roll-up of their own.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowplace.llm.common import partitions_of
from flowplace.operators import ordered
from flowplace.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WHOLE = 1 << 14  # nodes of a component that one task finishes
SUMS = [f"s{n}" for n in range(4)]  # four sums of 31-bit hashes name a set of numbered turns
JOINED = 1 << 12  # conversation ids that are joined into one string before they are digested


def said(turns: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(conv, i, d1, d2, chars): the turns of each conversation, numbered from 1, with a 128-bit digest of role and text.

    Order: turn, a null turn first, ties by the digest. Null roles and texts are empty; rows without an id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    half = lambda at: F.conv(F.substring(F.col("digest"), at, 16), 16, -10).cast("long")
    rows = turns.select(F.col(f"`{conv_id}`").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    rows = rows.filter("conv is not null").select("conv", "turn", half(1).alias("d1"), half(17).alias("d2"), "chars")
    return ordered.numbered(rows, ["conv"], ["turn", "d1", "d2"], "i").drop("turn")


def rebuilt(turns: DataFrame, block: int = 100, most: int = 6, conv_id: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another one: (rows as :func:`said`, conversations as conv and n_turns).

    Conversation c takes the first h turns of conversation ``c - c % block`` (all if fewer, none if absent), h being the
    unsigned crc32 of c in decimal modulo ``most``, and then its own turns after its first h. ``%`` is SQL's, with the sign of c.
    """
    own = materialise(said(turns, conv_id), "prefix-said")
    base = lambda c: F.col(c) - F.col(c) % block
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    sizes = own.groupBy("conv").agg(F.max("i").alias("n_own"))
    begins = own.filter((F.col("conv") == base("conv")) & (F.col("i") < most)).select(F.col("conv").alias("base"), "i", "d1", "d2", "chars")
    begins = materialise(begins, "prefix-begins")
    lent = begins.groupBy("base").agg(F.max("i").alias("lent"))
    convs = sizes.select("conv", base("conv").alias("base"), "n_own", taken.alias("h")).join(lent, "base", "left")
    convs = convs.withColumn("k", F.least("h", F.coalesce("lent", F.lit(0).cast("long"))))
    convs = materialise(convs.withColumn("n_turns", F.col("k") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))), "prefix-convs")
    first = convs.select("conv", "base", "k").join(begins, "base").filter("i <= k").select("conv", "i", "d1", "d2", "chars")
    rest = own.withColumn("h", taken).filter("i > h").withColumn("base", base("conv")).join(lent, "base", "left")
    place = F.col("i") - F.col("h") + F.least("h", F.coalesce("lent", F.lit(0).cast("long")))
    return first.unionByName(rest.select("conv", place.alias("i"), "d1", "d2", "chars")), convs.select("conv", "n_turns")


def node_key(sums: list[Column], depth: Column) -> list[Column]:
    """128 bits that stand for the first ``depth`` turns."""
    return [F.xxhash64(F.lit(salt), *sums, depth.cast("long")).alias(name) for salt, name in ((1, "k1"), (2, "k2"))]


def steps(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per conversation and depth, depth 0 included: conv, depth, key k1 k2, key of the node above u1 u2, chars, n_turns.

    The first d turns are known by the sum of hashes of (place, turn), a running total over the conversation, however long.
    """
    bits = [F.shiftright(F.xxhash64(F.lit(n), "i", "d1", "d2"), 33) + F.lit(1 << 30) for n in range(len(SUMS))]
    pieces = ordered.cut(rows.select("*", *[b.alias(f"own_{s}") for b, s in zip(bits, SUMS, strict=True)]), ["conv"], ["i"])
    total = ordered.finish(ordered.running(pieces, ["conv"], ["i"], {s: F.col(f"own_{s}") for s in SUMS}))
    above = [k.alias(k_) for k, k_ in zip(node_key([F.col(s) - F.col(f"own_{s}") for s in SUMS], F.col("i") - 1), ("u1", "u2"), strict=True)]
    turns = total.select("conv", F.col("i").alias("depth"), *node_key([F.col(s) for s in SUMS], F.col("i")), *above, "chars").join(convs, "conv")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    tops = convs.select("conv", zero.alias("depth"), *node_key([zero] * len(SUMS), zero), none.alias("u1"), none.alias("u2"), zero.alias("chars"), "n_turns")
    return materialise(turns.unionByName(tops), "prefix-steps")


def digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of ``ends`` (k1, k2, conv): SHA-256 of the ids in ascending order with commas between.

    Ids are brought into order over all nodes and joined into strings where they lie; one task then runs over a node's *strings* as a
    stream, so a node with very many conversations needs no memory and little of a task's time.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = [], None

        def row() -> pa.RecordBatch:
            columns = [pa.array([name[0]]), pa.array([name[1]]), pa.array([held[0]]), pa.array([",".join(map(str, held))])]
            return pa.RecordBatch.from_arrays(columns, ["k1", "k2", "first", "part"])

        for batch in batches:
            for k1, k2, conv in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "conv")), strict=True):
                if held and ((k1, k2) != name or len(held) >= JOINED):
                    yield row()
                    held = []
                name = (k1, k2)
                held.append(conv)
        if held:
            yield row()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, running = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name[0]]), pa.array([name[1]]), pa.array([running.hexdigest()])], ["k1", "k2", "ends_sha256"])

        for batch in batches:
            for k1, k2, part in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "part")), strict=True):
                if (k1, k2) == name:
                    running.update(b"," + part.encode())
                    continue
                if name is not None:
                    yield row()
                name, running = (k1, k2), hashlib.sha256(part.encode())
        if name is not None:
            yield row()

    wide = partitions_of(ends)
    sorted_ = ends.repartitionByRange(wide, "k1", "k2", "conv").sortWithinPartitions("k1", "k2", "conv")
    parts = sorted_.mapInArrow(join, "k1 bigint, k2 bigint, first bigint, part string")
    streams = parts.repartition(wide, "k1", "k2").sortWithinPartitions("k1", "k2", "first")
    return streams.mapInArrow(digest, "k1 bigint, k2 bigint, ends_sha256 string")


def finish_component(parent: list[int], weight: list[int], own: np.ndarray, found: np.ndarray) -> None:
    """Centroid decomposition of one tree in memory; ``parent`` is -1 at its top.

    ``found`` holds what was added to each node before and is turned into its subtree's totals.
    """
    below: list[set[int]] = [set() for _ in parent]
    for node, up in enumerate(parent):
        if up >= 0:
            below[up].add(node)
    todo = [node for node, up in enumerate(parent) if up < 0]
    while todo:
        top = todo.pop()
        half, centroid = weight[top], top
        while (low := next((c for c in below[centroid] if 2 * weight[c] >= half), None)) is not None:
            centroid = low
        # All that hangs on the centroid.
        hung = [centroid]
        for node in hung:
            hung.extend(below[node])
        total = own[hung].sum(axis=0)
        found[centroid] += total
        todo.extend(below[centroid])
        if centroid != top:
            below[parent[centroid]].discard(centroid)
            node = centroid
            while node != top:
                node = parent[node]
                found[node] += total
                weight[node] -= weight[centroid]
            todo.append(top)


def finish_small(nodes: DataFrame, measures: list[str]) -> DataFrame:
    """Totals of components that fit a task: conv, depth and each measure."""
    totals = [f"t_{m}" for m in measures]

    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        conv, depth = table["conv"].to_pylist(), table["depth"].to_pylist()
        place = {name: n for n, name in enumerate(zip(conv, depth, strict=True))}
        parent = [place.get((p, d - 1), -1) if top != d else -1 for p, d, top in zip(table["parent"].to_pylist(), depth, table["top_depth"].to_pylist(), strict=True)]
        own = np.stack([table[m].to_numpy() for m in measures], axis=1)
        found = np.stack([table[t].to_numpy() for t in totals], axis=1).copy()
        finish_component(parent, table["weight"].to_pylist(), own, found)
        return pa.RecordBatch.from_arrays([pa.array(conv), pa.array(depth), *[pa.array(found[:, n]) for n in range(len(measures))]], ["conv", "depth", *measures])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Whole components, several at once: a row group ends where the top changes.
        held: list[pa.RecordBatch] = []
        for batch in batches:
            tops = [batch.column(c).to_numpy() for c in ("top_conv", "top_depth")]
            changed = np.flatnonzero((np.diff(tops[0]) != 0) | (np.diff(tops[1]) != 0)) + 1
            if held:
                last = held[-1]
                same = all(last.column(c)[-1].as_py() == t[0] for c, t in zip(("top_conv", "top_depth"), tops, strict=True))
                if not same:
                    yield solve(held)
                    held = []
                elif len(changed):
                    yield solve([*held, batch.slice(0, changed[0])])
                    batch, changed, held = batch.slice(changed[0]), changed[1:] - changed[0], []
            if len(changed):
                yield solve([batch.slice(0, changed[-1])])
                batch = batch.slice(changed[-1])
            held.append(batch)
        if held:
            yield solve(held)

    shape = "conv bigint, depth bigint, " + ", ".join(f"{m} bigint" for m in measures)
    wide = partitions_of(nodes)
    dealt = nodes.repartition(wide, "top_conv", "top_depth").sortWithinPartitions("top_conv", "top_depth")
    return dealt.mapInArrow(work, shape)


def roll_up(nodes: DataFrame, line: DataFrame, measures: list[str], whole: int = WHOLE) -> DataFrame:
    """(conv, depth, one column per measure): the measures of ``nodes`` summed over subtrees, tops included.

    ``nodes``: conv and depth (the name), parent (conv of the node above, null at a root), weight (sum over the subtree of
    positive weights) and BIGINT measures; they are one tree. ``line``: conv, depth, node and above, the node of a conversation at a depth and the one above it.
    """
    zero, top = F.lit(0).cast("long"), ["top_conv", "top_depth"]
    totals = [f"t_{m}" for m in measures]
    names = ["conv", "depth", "parent", "weight", *measures, *totals, *top]
    root = nodes.filter("parent is null").first()  # one row, or none in an empty table
    first = [F.lit(root[c] if root else 0).cast("long") for c in ("conv", "depth")]
    active = materialise(nodes.withColumns({t: zero for t in totals} | dict(zip(top, first, strict=True))).select(names), "prefix-active")
    done: list[DataFrame] = []
    while True:
        sizes = materialise(active.groupBy(*top).agg(F.count("*").alias("n"), F.max("weight").alias("all")), "prefix-sizes")
        big = sizes.filter(F.col("n") > whole)
        if big.isEmpty():
            done.append(finish_small(active, measures))
            break
        small = active.join(sizes.filter(F.col("n") <= whole).select(*top), top, "left_semi")
        done.append(materialise(finish_small(small, measures), "prefix-done"))
        split = active.join(big.select(*top, "all"), top)
        lowest = F.min(F.struct("weight", "conv", "depth")).alias("c")
        centroid = split.filter(2 * F.col("weight") >= F.col("all")).groupBy(*top).agg(lowest)
        centroid = materialise(centroid.select(*top, F.col("c.conv").alias("c_conv"), F.col("c.depth").alias("c_depth"), F.col("c.weight").alias("c_weight")), "prefix-centroids")
        rows = split.drop("all").join(centroid, top)
        # Below the centroid's depth: the node of one's own line just under that depth tells the new component, if the centroid is above it.
        under = line.select(F.col("conv"), F.col("depth").alias("u_depth"), F.col("node").alias("u_node"), F.col("above").alias("u_above"))
        deep = rows.filter("depth > c_depth").withColumn("u_depth", F.col("c_depth") + 1).join(under, ["conv", "u_depth"])
        deep = deep.withColumn("hung", F.col("u_above") == F.col("c_conv"))
        flat = rows.filter("depth <= c_depth").withColumns({"u_depth": F.lit(None).cast("long"), "u_node": F.lit(None).cast("long"), "u_above": F.lit(None).cast("long")})
        flat = flat.withColumn("hung", (F.col("conv") == F.col("c_conv")) & (F.col("depth") == F.col("c_depth")))
        marked = materialise(deep.unionByName(flat), "prefix-marked")
        total = marked.filter("hung").groupBy(*top).agg(*[F.sum(m).alias(f"c_{m}") for m in measures])
        # The path from the centroid up to the component's top, by name.
        path = centroid.join(line, (F.col("conv") == F.col("c_conv")) & (F.col("depth") <= F.col("c_depth")) & (F.col("depth") >= F.col("top_depth")))
        path = path.select(*top, F.col("node").alias("conv"), "depth", F.lit(True).alias("on_path"))
        added = marked.join(total, top).join(path, [*top, "conv", "depth"], "left").withColumn("on_path", F.coalesce("on_path", F.lit(False)))
        added = added.withColumns({t: F.col(t) + F.when(F.col("on_path"), F.col(f"c_{m}")).otherwise(0) for m, t in zip(measures, totals, strict=True)})
        added = materialise(added, "prefix-added")
        is_c = (F.col("conv") == F.col("c_conv")) & (F.col("depth") == F.col("c_depth"))
        done.append(added.filter(is_c).select("conv", "depth", *[F.col(t).alias(m) for m, t in zip(measures, totals, strict=True)]))
        left = added.filter(~is_c)
        left = left.withColumn("weight", F.col("weight") - F.when(F.col("on_path"), F.col("c_weight")).otherwise(0))
        left = left.withColumns({"top_conv": F.when(F.col("hung"), F.col("u_node")).otherwise(F.col("top_conv")), "top_depth": F.when(F.col("hung"), F.col("u_depth")).otherwise(F.col("top_depth"))})
        active = materialise(left.select(names), "prefix-active")
    return ordered.union_all(done)


def prefix_trie(rows: DataFrame, convs: DataFrame, whole: int = WHOLE) -> DataFrame:
    """One row per distinct sequence of first turns, the empty one included.

    ``rows``: conv, i (place from 1), d1, d2 (digest of the turn), chars, see :func:`said`; ``convs``: conv, n_turns, also those without turns.
    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over the subtree, each
    node's members beyond the first times the characters of its last text), ends_sha256. No conversations give no rows. Turns are told
    apart by 128-bit digests.
    """
    stepped = steps(rows, convs)
    left = F.col("n_turns") - F.col("depth") + 1
    grouped = stepped.groupBy("k1", "k2").agg(
        F.min("conv").alias("conv"),
        F.min("depth").alias("depth"),
        F.min("u1").alias("u1"),
        F.min("u2").alias("u2"),
        F.min("chars").alias("chars"),
        F.count("*").alias("n_convs"),
        F.sum(left).alias("weight"),
    )
    grouped = materialise(grouped, "prefix-nodes")
    children = grouped.filter("u1 is not null").groupBy(F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(F.count("*").alias("n_children"))
    above = grouped.select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("conv").alias("parent"))
    nodes = grouped.join(children, ["k1", "k2"], "left").join(above, ["u1", "u2"], "left")
    nodes = nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = nodes.withColumn("leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"))
    nodes = nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("chars"))
    nodes = materialise(nodes.drop("u1", "u2", "chars"), "prefix-nodes")
    # The line of every conversation that names a node.
    naming = nodes.select("conv").distinct()
    line = stepped.join(naming, "conv", "left_semi").select("conv", "depth", "k1", "k2")
    line = line.join(nodes.select("k1", "k2", F.col("conv").alias("node"), F.col("parent").alias("above")), ["k1", "k2"])
    line = materialise(line.select("conv", "depth", "node", "above"), "prefix-line")
    measured = nodes.select("conv", "depth", "parent", "weight", "leaves", "saved")
    rolled = roll_up(measured, line, ["leaves", "saved"], whole).select("conv", "depth", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    ended = digests(stepped.filter("depth = n_turns").select("k1", "k2", "conv"))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    whole_rows = nodes.drop("leaves", "saved").join(rolled, ["conv", "depth"]).join(ended, ["k1", "k2"], "left")
    return whole_rows.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )


def conversation_trie(turns: DataFrame, conv_id: str = "conv_id", whole: int = WHOLE) -> DataFrame:
    """:func:`prefix_trie` of the conversations in ``turns`` (turn, role, text) as they are."""
    rows = materialise(said(turns, conv_id), "prefix-said")
    return prefix_trie(rows, rows.groupBy("conv").agg(F.max("i").alias("n_turns")), whole)
