"""Alignment of two tokenizers over the same bytes, in Arrow columns from end to end.

A task turns a chunk of texts into two flat columns of token ids with the index of each token's document (its parent). The
bytes that a token stands for have a known length, so a running sum inside each document gives every token's end. Ends
become one key per document and place; an Acero hash join on it finds the tokens of both sides that end together. Those
places cut both token lists into groups of equal bytes.

Which pairs of ids can ever end together is known in advance: one side's bytes are the end of the other's. So
the pairs are numbered once from the two vocabularies, the table of counts has at most that many rows whatever the corpus, and may be handed
to every task. Counts are partial per chunk (``Table.group_by``) and merged by Spark.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - binds pa.compute
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowplace.llm.byte_level import token_bytes, worker_encoder
from flowplace.llm.common import per_chunk
from flowplace.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARK = "▁"
CHUNK = 1 << 20  # bytes of text that are aligned at once


def piece_bytes(path: str) -> list[bytes]:
    """The bytes of every id of a SentencePiece file: byte pieces as their byte, all others in UTF-8 with the mark as a space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    of = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(MARK, " ").encode()
    return [of(i) for i in range(model.vocab_size())]


class Side:
    """The vocabulary of one side as Arrow binary and the length of each token."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = pa.array(tokens, pa.large_binary())
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.names = pa.array([str(i) for i in range(len(tokens))], pa.string())


class Pair:
    """Both sides and the numbered pairs of ids whose tokens can end together."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece

        self.bytes_ = worker_encoder(byte_path, True)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        a, b = token_bytes(byte_path), piece_bytes(piece_path)
        self.a, self.b = Side(a), Side(b)
        # Every pair where one token is an end of the other, as a * len(b) + b: fewer than the bytes of both vocabularies, a few
        # times more where different ids of a side have the same bytes.
        by_a, by_b = ids_of(a), ids_of(b)
        keys = {x * len(b) + y for t, ends in by_a.items() for cut in range(len(t)) for x in ends for y in by_b.get(t[cut:], ())}
        keys |= {x * len(b) + y for t, ends in by_b.items() for cut in range(len(t)) for y in ends for x in by_a.get(t[cut:], ())}
        self.keys = np.array(sorted(keys), np.int64)

    def number(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, a.astype(np.int64) * len(self.b.sizes) + b)


def ids_of(tokens: list[bytes]) -> dict[bytes, list[int]]:
    out: dict[bytes, list[int]] = {}
    for i, t in enumerate(tokens):
        if t:
            out.setdefault(t, []).append(i)
    return out


def worker_pair(byte_path: str, piece_path: str) -> Pair:
    """One pair of encoders per process."""
    kept = sys.__dict__.setdefault("_token_align_pairs", {})
    if (byte_path, piece_path) not in kept:
        kept[byte_path, piece_path] = Pair(byte_path, piece_path)
    return kept[byte_path, piece_path]


def flattened(lists: list, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row and the index of the document each belongs to: list flatten and list parent indices."""
    sizes = np.array([len(x) for x in lists], np.int64)
    flat = np.concatenate([np.empty(0, kind), *[np.asarray(x, kind) for x in lists]])
    listed = pa.LargeListArray.from_arrays(pa.array(np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])), pa.array(flat))
    return listed.flatten().to_numpy(), pa.compute.list_parent_indices(listed).to_numpy()


def spelled(side: Side, ids: np.ndarray, parent: np.ndarray, sizes: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Per document whether the bytes of its tokens, joined, are its own bytes in ``line`` (whose documents have ``sizes`` bytes)."""
    own = np.bincount(parent, side.sizes[ids], len(sizes)).astype(np.int64)
    good = own == sizes
    keep = good[parent]
    taken = side.tokens.take(pa.array(ids[keep]))
    # The data of the taken tokens is their bytes in a row.
    held = np.frombuffer(taken.buffers()[2] or b"", np.uint8)[: int(sizes[good].sum())]
    starts = np.cumsum(sizes) - sizes
    at = np.flatnonzero(good)
    mine = np.concatenate([np.zeros(0, np.uint8), *[line[starts[i] : starts[i] + sizes[i]] for i in at]])
    differs = np.concatenate([np.zeros(1, np.int64), np.cumsum(held != mine)])
    ends = np.cumsum(sizes[at])
    good[at] = differs[ends] == differs[ends - sizes[at]]
    return good


def ends_of(side: Side, ids: np.ndarray, parent: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each token's end as one key over all documents: the running sum inside its document behind the document's own start."""
    length = side.sizes[ids]
    upto = np.cumsum(length)
    own = np.bincount(parent, length, len(sizes)).astype(np.int64)
    before = (np.cumsum(own) - own)[parent]
    return upto - before + (np.cumsum(sizes) - sizes)[parent]


def named(side: Side, ids: np.ndarray, last: np.ndarray) -> pa.Array:
    """Per group, in order, its ids as text with commas between; ``last`` marks the tokens that end a group."""
    offsets = np.concatenate([np.zeros(1, np.int32), np.flatnonzero(last).astype(np.int32) + 1])
    listed = pa.ListArray.from_arrays(pa.array(offsets), side.names.take(pa.array(ids)))
    return pa.compute.binary_join(listed, ",")


def align_chunk(texts: list[str | None], pair: Pair) -> list[pa.Array]:
    """Per text: n_a, n_b, n_groups, the pair number of every link, and the groups as text."""
    said = [" " + t if t else "" for t in texts]
    sizes = np.array([len(s.encode()) for s in said], np.int64)
    line = np.frombuffer("".join(said).encode(), np.uint8)
    a, a_of = flattened(pair.bytes_.encode(said), np.uint32)
    b, b_of = flattened(pair.pieces.encode([t or "" for t in texts], num_threads=1) if texts else [], np.int32)
    good = spelled(pair.a, a, a_of, sizes, line) & spelled(pair.b, b, b_of, sizes, line)
    a, a_of = a[good[a_of]], a_of[good[a_of]]
    b, b_of = b[good[b_of]], b_of[good[b_of]]
    a_end, b_end = ends_of(pair.a, a, a_of, sizes), ends_of(pair.b, b, b_of, sizes)
    left = pa.table({"end": a_end, "a": a.astype(np.int64), "doc": a_of.astype(np.int64)})
    right = pa.table({"end": b_end, "b": b.astype(np.int64)})
    met = left.join(right, "end", join_type="inner", use_threads=False).sort_by([("end", "ascending"), ("a", "ascending"), ("b", "ascending")])
    doc, number = met["doc"].to_numpy(), pair.number(met["a"].to_numpy(), met["b"].to_numpy())
    met_end = met["end"].to_numpy()
    cut = np.zeros(len(line) + 1, bool)
    cut[met_end] = True
    n = len(texts)
    n_links = np.bincount(doc, minlength=n)
    # Each group ends at a cut, the last one of a document where the document ends; both sides have the same groups.
    n_groups = np.bincount(a_of[cut[a_end]], minlength=n)
    a_text, b_text = named(pair.a, a, cut[a_end]), named(pair.b, b, cut[b_end])
    both = pa.compute.binary_join_element_wise(a_text, b_text, "|")
    offsets = pa.array(np.concatenate([np.zeros(1, np.int64), np.cumsum(n_groups)]).astype(np.int32))
    groups = pa.compute.binary_join(pa.ListArray.from_arrays(offsets, both), ";")
    offsets = pa.array(np.concatenate([np.zeros(1, np.int64), np.cumsum(n_links)]).astype(np.int32))
    return [
        pa.array(np.bincount(a_of, minlength=n).astype(np.int64)),
        pa.array(np.bincount(b_of, minlength=n).astype(np.int64)),
        pa.array(n_groups.astype(np.int64)),
        pa.ListArray.from_arrays(offsets, pa.array(number.astype(np.int32))),
        groups,
    ]


def aligned(docs: DataFrame, byte_path: str, piece_path: str, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, links (the number of each link's pair of ids, in order of places) and groups.

    Side A is ``byte_path`` (byte-level BPE, tokenizers library) over a space and the text, side B ``piece_path`` (SentencePiece) over the
    text; special strings are plain text. ``groups`` reads ``a1,a2|b1;a3|b2,b3``, or is its SHA-256 if ``digest`` ('' without tokens). Texts
    that are null, empty, or not spelled by the tokens of either side have no tokens. Repeated rows and null ids come back each, an
    empty table gives no rows, other columns are ignored.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = align_chunk(batch.column("text").to_pylist(), worker_pair(byte_path, piece_path))
        if digest:
            found[-1] = pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in found[-1].to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *found], ["doc_id", "n_a", "n_b", "n_groups", "links", "groups"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, links array<int>, groups string"
    return rows.mapInArrow(per_chunk(work, "text", CHUNK), shape)


def pair_counts(rows: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """(a, b, n): how many links of the whole corpus hold the pair linked. Counted per batch in Arrow, merged by Spark."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.table({"number": batch.column("links").flatten()})
            counted = table.group_by("number", use_threads=False).aggregate([([], "count_all")])
            yield from counted.select(["number", "count_all"]).rename_columns(["number", "n"]).to_batches()

    merged = rows.select("links").mapInArrow(part, "number int, n bigint").groupBy("number").agg(F.sum("n").alias("n"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = worker_pair(byte_path, piece_path)
        for batch in batches:
            key = pair.keys[batch.column("number").to_numpy()]
            columns = [pa.array(key // len(pair.b.sizes)), pa.array(key % len(pair.b.sizes)), batch.column("number"), batch.column("n")]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "number", "n"])

    return materialise(merged.mapInArrow(spell, "a bigint, b bigint, number int, n bigint"), "align-counts")


def align(docs: DataFrame, byte_path: str, piece_path: str, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """Align all documents; returns (rows, counts).

    ``rows``: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the most counted one of its B id, ties included), count_sum
    and groups, see :func:`aligned`. ``counts``: a, b, n of the whole corpus.
    """
    rows = materialise(aligned(docs, byte_path, piece_path, doc_id, text, digest), "align")
    counts = pair_counts(rows, byte_path, piece_path)
    top = counts.groupBy("b").agg(F.max("n").alias("top"))
    judged = counts.join(top, "b").select("number", "n", (F.col("n") == F.col("top")).alias("best"))
    # At most as many rows as the two vocabularies have pairs with a common end, see Pair.
    table = judged.toArrow()
    numbers, many = table["number"].to_numpy(), int(pa.compute.max(table["number"]).as_py() or 0) + 1 if len(table) else 1
    n, best = np.zeros(many, np.int64), np.zeros(many, bool)
    n[numbers], best[numbers] = table["n"].to_numpy(), table["best"].to_numpy(zero_copy_only=False)
    shared = docs.sparkSession.sparkContext.broadcast((n, best))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, best = shared.value
        for batch in batches:
            links = batch.column("links")
            flat, size = links.flatten().to_numpy(), pa.compute.list_value_length(links).to_numpy()
            upto = lambda v: np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(v)])[np.concatenate([[0], np.cumsum(size)])])
            own = [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")]
            columns = [*own, pa.array(size.astype(np.int64)), pa.array(upto(best[flat].astype(np.int64))), pa.array(upto(n[flat])), batch.column("groups")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"
    return rows.mapInArrow(work, shape), counts.select("a", "b", "n")
