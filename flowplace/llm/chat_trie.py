"""Conversations as one prefix tree: shared first turns are stored and trained on once.

A node is a turn together with all turns before it, so conversations that begin alike share
nodes. Nodes are laid out depth first: their order is the order of their paths, a range sort, so
no tree has to fit a task. Each node carries the place of its tokens in the layout, the position id of its first
token (the tokens of its ancestors), and the end of its subtree: a token at place ``s`` is attended to
from the places ``s`` up to that end, which is exactly its own turn and everything said after it.

Template: ``<|turn|>role<|text|>text<|end|>``. Control strings inside roles and texts get a backslash
after their first character (one more if there are some already), which is undone on reading.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowplace.llm.common import chunks, partitions_of, running_base
from flowplace.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# Beginnings and rests of the control strings of this and other common templates.
OPEN, REST = r"([<\[])", r"(\||/?s>|/?INST\]|/?SYS>>)"
CONTROL, ESCAPED = re.compile(OPEN + r"(\\*)" + REST), re.compile(OPEN + r"\\(\\*)" + REST)
SPOKEN = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)
LEARNT = "assistant"  # role whose texts are under the loss mask


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def worker_tokenizer(path: str):
    """The tokenizer, read once per Python worker."""
    kept = sys.__dict__.setdefault("_chat_trie_tokenizers", {})
    if path not in kept:
        from tokenizers import Tokenizer

        kept[path] = Tokenizer.from_file(path)
        kept[path].encode_special_tokens = True  # their strings in a text are ordinary text
    return kept[path]


def _conversations(turns: DataFrame, conv_id: str) -> DataFrame:
    """(conv_id, leaf, keys, said): the turns in order and for each the key of its node."""
    rows = turns.select(
        F.col(f"`{conv_id}`").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("said"),
    )
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("said")).alias("said"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for said in batch.column("said").to_pylist():
                chain, own = b"", []
                for one in said:
                    role, text = one["role"].encode(), one["text"].encode()
                    chain = hashlib.blake2b(chain + len(role).to_bytes(8) + role + text, digest_size=16).digest()
                    own.append(chain.hex())
                keys.append(own)
            leaf = pa.array([k[-1] for k in keys], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), leaf, pa.array(keys, pa.list_(pa.string())), batch.column("said")], ["conv_id", "leaf", "keys", "said"]
            )

    shape = whole.select("conv_id", F.lit("").alias("leaf"), F.array(F.lit("")).alias("keys"), "said").schema
    return materialise(whole.mapInArrow(work, shape), "chat")


def _laid_out(nodes: DataFrame, tokenizer: str) -> DataFrame:
    """Nodes in path order with their ids and ``part`` and ``local`` place."""
    kind = "key string, part int, local bigint, n_tokens int, loss_from int, loss_to int, role string, ids array<int>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_tokenizer(tokenizer).encode_batch
        part, local = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in chunks(batch, "text"):
                roles, texts = piece.column("role").to_pylist(), piece.column("text").to_pylist()
                head = [e.ids for e in encode([f"{TURN}{escape(r)}{TEXT}" for r in roles], add_special_tokens=False)]
                body = [e.ids for e in encode([escape(t) for t in texts], add_special_tokens=False)]
                tail = encode([END], add_special_tokens=False)[0].ids
                ids = [a + b + tail for a, b in zip(head, body, strict=True)]
                sizes = np.array([len(x) for x in ids], np.int64)
                ends = local + np.cumsum(sizes)
                learnt = [r == LEARNT for r in roles]
                begin = [len(a) if on else 0 for a, on in zip(head, learnt, strict=True)]
                stop = [len(a) + len(b) if on else 0 for a, b, on in zip(head, body, learnt, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("key"),
                        pa.array([part] * len(ids), pa.int32()),
                        pa.array(ends - sizes),
                        pa.array(sizes.astype(np.int32)),
                        pa.array(begin, pa.int32()),
                        pa.array(stop, pa.int32()),
                        piece.column("role"),
                        pa.array(ids, pa.list_(pa.int32())),
                    ],
                    ["key", "part", "local", "n_tokens", "loss_from", "loss_to", "role", "ids"],
                )
                local = int(ends[-1]) if len(ends) else local

    ordered = nodes.repartitionByRange(partitions_of(nodes), "path").sortWithinPartitions("path")
    return materialise(ordered.select("key", "role", "text").mapInArrow(work, kind), "chat")


def write_tree(turns: DataFrame, tokenizer: str, conv_id: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """Write the tree; returns (nodes, sequences) as written.

    ``nodes``: start, stop, position (id of the first token), subtree_end, role, loss_from, loss_to (token offsets under
    the loss mask), ids. ``sequences``: conv_id and the intervals (start, stop) of the layout that the
    conversation's tokens are read from and attend to, in order.

    ``turns`` has turn, role and text; a null role or text is empty, a null turn comes first, ties go by role and
    text, repeated rows are repeated turns, null ids are one conversation. No rows give no conversations; other
    columns are ignored. One conversation is one training example: its turns must fit a task as a document's
    text does, while shared turns and equal conversations may be any number.
    """
    convs = _conversations(turns, conv_id)
    distinct = materialise(convs.groupBy("leaf").agg(F.first("keys").alias("keys"), F.first("said").alias("said")), "chat")
    steps = distinct.select("keys", F.posexplode(F.arrays_zip("keys", "said")).alias("depth", "at"))
    path = F.array_join(F.transform(F.slice("keys", F.lit(1), F.col("depth") + 1), lambda k: F.substring(k, 1, 16)), "")
    nodes = steps.select(F.col("at.keys").alias("key"), "at.said.role", "at.said.text", path.alias("path")).groupBy("key").agg(
        F.first("role").alias("role"), F.first("text").alias("text"), F.first("path").alias("path")
    )
    laid = _laid_out(materialise(nodes, "chat"), tokenizer)
    # One row per partition of the sort.
    bases = running_base(laid.groupBy("part").agg(F.sum("n_tokens").alias("size")), "part", "size", "base")
    placed = materialise(
        laid.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("local")).withColumn("stop", F.col("start") + F.col("n_tokens")).drop("part", "local", "base"),
        "chat",
    )
    steps = distinct.select("leaf", F.posexplode("keys").alias("depth", "key")).join(placed.select("key", "start", "stop", "n_tokens"), "key")
    lines = materialise(
        steps.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("depth", "start", "stop", "n_tokens", "key"))).alias("line")), "chat"
    )
    said = lines.select(F.element_at("line", -1).stop.alias("leaf_stop"), "line", F.posexplode("line").alias("depth", "node"))
    before = F.aggregate(F.slice("line", F.lit(1), F.col("depth")), F.lit(0).cast("long"), lambda t, n: t + n["n_tokens"])
    spans = said.select("node.key", before.alias("position"), "leaf_stop").groupBy("key").agg(
        F.min("position").alias("position"), F.max("leaf_stop").alias("subtree_end")
    )
    nodes = materialise(
        placed.join(spans, "key").select("start", "stop", "position", "subtree_end", "role", "loss_from", "loss_to", "ids"), "chat-nodes"
    )
    intervals = lines.select("leaf", F.transform("line", lambda n: F.struct(n["start"].alias("start"), n["stop"].alias("stop"))).alias("intervals"))
    sequences = materialise(convs.select("conv_id", "leaf").join(intervals, "leaf").select("conv_id", "intervals"), "chat-sequences")
    return nodes, sequences


def read_tree(nodes: DataFrame, sequences: DataFrame, tokenizer: str) -> DataFrame:
    """Per conversation, from the written tree: conv_id, formatted, turns (role, text), learnt (texts under the loss mask)."""
    # Equal conversations are read once.
    keyed = sequences.withColumn("first", F.xxhash64("intervals"))
    once = materialise(keyed.groupBy("intervals").agg(F.first("first").alias("first")), "chat")
    steps = once.select("intervals", F.posexplode("intervals").alias("depth", "span"))
    steps = steps.select("intervals", "depth", F.col("span.start").alias("start"))
    found = steps.join(nodes.select("start", "loss_from", "loss_to", "ids"), "start")
    lines = found.groupBy("intervals").agg(F.array_sort(F.collect_list(F.struct("depth", "loss_from", "loss_to", "ids"))).alias("line"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = worker_tokenizer(tokenizer)
        for batch in batches:
            full, said, learnt = [], [], []
            for line in batch.column("line").to_pylist():
                full.append("".join(tool.decode_batch([n["ids"] for n in line], skip_special_tokens=False)))
                said.append([{"role": unescape(r), "text": unescape(t)} for r, t in SPOKEN.findall(full[-1])])
                mask = [n["ids"][n["loss_from"] : n["loss_to"]] for n in line if n["loss_to"]]
                learnt.append([unescape(t) for t in tool.decode_batch(mask, skip_special_tokens=False)])
            turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("intervals"), pa.array(full, pa.string()), pa.array(said, turn), pa.array(learnt, pa.list_(pa.string()))],
                ["intervals", "formatted", "turns", "learnt"],
            )

    kind = "intervals array<struct<start bigint, stop bigint>>, formatted string, turns array<struct<role string, text string>>, learnt array<string>"
    read = materialise(lines.mapInArrow(work, kind), "chat")
    return sequences.join(read, "intervals").select("conv_id", "formatted", "turns", "learnt")
