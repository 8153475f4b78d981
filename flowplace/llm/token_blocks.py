"""Token ids in a binary format of patched frame-of-reference blocks.

Documents are encoded once where they are read, brought into doc_id order as packed ids, and
written as segments. A segment holds whole documents; its ids are cut into blocks of 128. A block
stores its minimum, the differences packed at the width that 90 % of them need, and the rest as
a list of exceptions. An index of block starts lets a reader begin at any block.

Segment bytes, little endian: ``b"PFB1"``, counts of documents, ids and blocks (u32 each); per
block its start in the body (u32, one more at the end), minimum (u32), width and number of exceptions (u8);
ids per document (u32); the body: per block the packed differences, the exceptions' places (u8)
and their differences (u32).
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowplace.llm.byte_level import byte_of
from flowplace.llm.common import chunks, partitions_of, per_chunk, running_base, text_of
from flowplace.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAGIC = b"PFB1"
BLOCK = 128
SHARE = 0.9  # of a block's differences that the packed width must hold
SEGMENT = 1 << 16  # ids after which a segment ends with its document
END_ID = 1  # appended to each document
KNOWN = 800_000  # words that a worker remembers; it starts anew beyond
MAX_PARTS = 4_096  # ranges of the doc_id order, also the bound of the table of their sizes

# Words that the fast path splits itself: ASCII and the Latin-1 letters; the splitting rule is the tokenizer's.
LETTERS = "À-ÖØ-öø-ÿ"
PLAIN = re.compile(f"[!-~{LETTERS}]+")
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|[^a-z0-9ß-öø-ÿ\n]+")


class Ragged:
    """Numbered lists of ids, kept flat; ``known`` maps a name to its number."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.sizes, self.ids = array("q"), array("q"), array("I")

    def add(self, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.starts)
        self.known.update(zip(names, range(first, first + len(names)), strict=True))
        self.starts.frombytes((len(self.ids) + np.cumsum(sizes, dtype=np.int64) - sizes).astype(np.int64).tobytes())
        self.sizes.frombytes(np.asarray(sizes, np.int64).tobytes())
        self.ids.frombytes(np.asarray(ids, np.uint32).tobytes())

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbers ``at`` in a row, and how many each has."""
        starts, sizes = np.frombuffer(self.starts, np.int64)[at], np.frombuffer(self.sizes, np.int64)[at]
        after = np.cumsum(sizes)
        total = int(after[-1]) if len(after) else 0
        return np.frombuffer(self.ids, np.uint32)[np.arange(total) + np.repeat(starts - after + sizes, sizes)], sizes


class Merges:
    """The merges of a byte-level file with word ends, as tiktoken ranks: many pieces in one call.

    A piece is its bytes and ``WORD_END``. The last byte and the end are merged before anything else, which makes them the one symbol
    that the file starts from; its own merges follow in their order.
    """

    WORD_END = "\x01"  # no plain word holds it

    def __init__(self, ranks: dict[bytes, int], ids: list[int]):
        import tiktoken

        end = self.WORD_END
        self.tool = tiktoken.Encoding("word-ends", pat_str=f"[^{end}]+{end}", mergeable_ranks=ranks, special_tokens={})
        self.ids = np.array(ids, np.uint32)
        self.ends = np.zeros(len(ids), bool)
        self.ends[[rank for token, rank in ranks.items() if token.endswith(end.encode())]] = True

    @classmethod
    def of(cls, path: str) -> Merges | None:
        """None where the file's rule is another one."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix, vocab, as_byte = model.get("end_of_word_suffix"), model.get("vocab", {}), byte_of()
        if model["type"] != "BPE" or not suffix or model.get("continuing_subword_prefix") or model.get("dropout"):
            return None
        end = cls.WORD_END.encode()
        names = [*as_byte, *(c + suffix for c in as_byte), *("".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"])]
        spelled = [bytes(map(as_byte.get, n.removesuffix(suffix))) + (end if n.endswith(suffix) else b"") for n in names if all(c in as_byte for c in n.removesuffix(suffix))]
        if len(set(spelled)) < len(names) or any(n not in vocab for n in names):
            return None
        # Every single byte needs a rank, the word end's own byte included, which is one of them.
        return cls({token: rank for rank, token in enumerate(spelled)}, [vocab[n] for n in names])

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces in a row, and how many each has."""
        ranks = self.tool.encode_to_numpy("".join([p + self.WORD_END for p in pieces]), disallowed_special=())
        last = np.flatnonzero(self.ends[ranks])
        return self.ids[ranks], np.diff(last, prepend=-1)


class Words:
    """Ids of every word seen, for tokenizers that drop white space: there a space or line feed
    always ends a token, so a word's ids don't depend on its neighbours and are asked for once."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.merges = Merges.of(path)
        self.as_bytes = {c: to_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.clean()

    def clean(self) -> None:
        self.words, self.parts = Ragged(), Ragged()
        self.words.add(["", "\n"], np.array([self.end_id]), np.array([0, 1]))  # a line feed is no word
        self.parts.add(["\n"], np.empty(0), np.array([0]))

    def learn(self, new: list[str]) -> None:
        """Ask the library for words it has not been asked for: plain ones piece by piece, others whole."""
        plain = [w for w in new if PLAIN.fullmatch(w) and not self.special.search(w)]
        pieces = PIECES.findall("\n".join(plain).lower())
        unknown = list({p for p in pieces if p not in self.parts.known})
        if unknown:
            if self.merges is not None:
                ids, sizes = self.merges.encode(unknown)
            else:
                tokenize = self.tokenizer.model.tokenize
                found = [[t.id for t in tokenize(p if p.isascii() else p.translate(self.as_bytes))] for p in unknown]
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                ids = np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum()))
            self.parts.add(unknown, ids, sizes)
        at = np.fromiter(map(self.parts.known.__getitem__, pieces), np.int64, len(pieces))
        ids, sizes = self.parts.take(at)
        ends = np.append(np.flatnonzero(at == 0), len(at))  # line feeds stand between the words
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])[ends] if len(pieces) else np.empty(0, np.int64)
        if plain:
            self.words.add(plain, ids, np.diff(upto, prepend=0))
        done = set(plain)
        odd = [w for w in new if w not in done]
        found = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in odd]
        self.words.add(odd, np.array([i for ids in found for i in ids]), np.array([len(ids) for ids in found], np.int64))

    def numbers(self, words: list[str]) -> np.ndarray:
        """Numbers of distinct words in ``self.words``."""
        if len(self.words.known) > KNOWN:
            self.clean()
        self.learn([w for w in words if w not in self.words.known])
        return np.fromiter(map(self.words.known.__getitem__, words), np.int64, len(words))


def worker_words(path: str, end_id: int) -> Words:
    """One table of words per Python worker and tokenizer, kept between its tasks."""
    kept = sys.__dict__.setdefault("_token_blocks_words", {})
    if (path, end_id) not in kept:
        kept.clear()
        kept[path, end_id] = Words(path, end_id)
    return kept[path, end_id]


def encode(texts: pa.Array, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts in a row, each text with the end id, and the ids per text."""
    import pyarrow.compute as pc

    spread = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    ends = spread.offsets.to_numpy()[1:].astype(np.int64) - spread.offsets[0].as_py()
    coded = spread.flatten().dictionary_encode()
    numbers = words.numbers(coded.dictionary.to_pylist())
    at = np.ones(len(coded) + len(ends), np.int64)  # 1 is the end id
    own = np.arange(len(coded)) + np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    at[own] = numbers[coded.indices.to_numpy()]
    ids, sizes = words.words.take(at)
    upto = np.cumsum(sizes)[ends + np.arange(len(ends))] if len(ends) else np.empty(0, np.int64)
    return ids, np.diff(upto, prepend=0)


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def pack(ids: np.ndarray, sizes: np.ndarray) -> bytes:
    """One segment: the ids and, per document, how many of them are its own."""
    n = -(-len(ids) // BLOCK)
    padded = np.zeros(n * BLOCK, np.uint32)
    padded[: len(ids)] = ids
    if len(ids):
        padded[len(ids) :] = ids[-1]
    grid = padded.reshape(n, BLOCK)
    low = grid.min(axis=1) if n else np.empty(0, np.uint32)
    gap = grid - low[:, None]
    k = int(np.ceil(SHARE * BLOCK)) - 1
    width = _bit_lengths(np.partition(gap, k, axis=1)[:, k]) if n else np.empty(0, np.int64)
    over = gap.astype(np.uint64) >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    odd = over.sum(axis=1)
    packed_size = width * (BLOCK // 8)
    ends = np.cumsum(packed_size + 5 * odd)
    starts = np.concatenate([np.zeros(1, np.int64), ends])
    body = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            values = gap[rows].astype("<u4")
            bits = np.unpackbits(values.view(np.uint8).reshape(len(rows), BLOCK, 4), axis=2, bitorder="little", count=int(w))
            body[starts[rows][:, None] + np.arange(w * BLOCK // 8)] = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
    row, place = np.nonzero(over)
    rank = np.arange(len(row)) - (np.cumsum(odd) - odd)[row]
    at = (starts[:-1] + packed_size)[row]
    body[at + rank] = place
    body[(at + odd[row] + 4 * rank)[:, None] + np.arange(4)] = gap[row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    head = np.array([len(sizes), len(ids), n], "<u4").tobytes()
    index = [starts.astype("<u4"), low.astype("<u4"), width.astype("u1"), odd.astype("u1"), np.asarray(sizes).astype("<u4")]
    return b"".join([MAGIC, head, *[x.tobytes() for x in index], body.tobytes()])


def unpack(segment: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a segment and the ids per document."""
    if segment[:4] != MAGIC:
        raise ValueError("not a segment")
    docs, total, n = np.frombuffer(segment, "<u4", 3, 4).astype(np.int64).tolist()
    at = 16

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(segment, kind, count, at)
        at += out.nbytes
        return out

    starts, low = take("<u4", n + 1).astype(np.int64), take("<u4", n)
    width, odd, sizes = take("u1", n).astype(np.int64), take("u1", n).astype(np.int64), take("<u4", docs)
    body = np.frombuffer(segment, np.uint8, -1, at)
    gap = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            bits = np.unpackbits(body[starts[rows][:, None] + np.arange(w * BLOCK // 8)], axis=1, bitorder="little")
            wide = np.zeros((len(rows), BLOCK, 4), np.uint8)
            part = np.packbits(bits.reshape(len(rows), BLOCK, int(w)), axis=2, bitorder="little")
            wide[:, :, : part.shape[2]] = part
            gap[rows] = wide.view("<u4")[:, :, 0]
    row = np.repeat(np.arange(n), odd)
    rank = np.arange(len(row)) - (np.cumsum(odd) - odd)[row]
    at_body = (starts[:-1] + width * (BLOCK // 8))[row]
    values = body[(at_body + odd[row] + 4 * rank)[:, None] + np.arange(4)]
    gap[row, body[at_body + rank]] = np.ascontiguousarray(values).view("<u4")[:, 0]
    return (gap + low[:, None]).reshape(-1)[:total], sizes


def id_kind(tokenizer: str) -> np.dtype:
    """Width of an id between the two shuffled halves of the work: two bytes do for most vocabularies."""
    from tokenizers import Tokenizer

    return np.dtype("<u2" if Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")


def encoded(docs: DataFrame, tokenizer: str, kind: np.dtype, bounds: np.ndarray, doc_id: str, text: str, end_id: int) -> DataFrame:
    """(doc_id, tie, part, ids): ids as bytes, and the range of the doc_id order that a row belongs to.

    Rows whose id is itself a bound may lie in any range next to it: they are spread by ``tie``, so
    an id that many rows share does not meet in one task.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(f"`{text}`").alias("text")).withColumn("tie", F.xxhash64("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = worker_words(tokenizer, end_id)
        ids, sizes = encode(batch.column("text"), words)
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes * kind.itemsize)])
        data = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype(kind))])
        known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        key = np.where(known, batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False), np.iinfo(np.int64).min)
        first, last = np.searchsorted(bounds, key, "left"), np.searchsorted(bounds, key, "right")
        spread = batch.column("tie").to_numpy().astype(np.float64) / 2.0**64 + 0.5
        part = np.minimum(first + (spread * (last - first + 1)).astype(np.int64), last)
        part = np.where(known, part, 0).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("tie"), pa.array(part), data.cast(pa.binary())], ["doc_id", "tie", "part", "ids"]
        )

    shape = rows.select("doc_id", "tie", F.lit(0).alias("part"), F.lit(b"").alias("ids")).schema
    return rows.mapInArrow(per_chunk(work, "text"), shape)


def write_blocks(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, label: str = "token-blocks"
) -> DataFrame:
    """Encode and write all documents; returns the written files as (part, segment, start, n_ids, doc_ids, payload).

    ``tokenizer`` is a file of the tokenizers library; it must be one that drops white space.
    Order: doc_id, a null id first, equal ids by a hash of the text. Null and empty texts are the end id alone;
    repeated rows are written again; an empty table gives no segments; other columns are ignored. ``doc_id`` is an integer column.
    """
    wide = partitions_of(docs)
    parts = min(MAX_PARTS, 4 * wide)
    ids = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or []
    kind = id_kind(tokenizer)
    rows = encoded(docs, tokenizer, kind, np.array(sorted(cuts), np.int64), doc_id, text, end_id)
    owner_kind = rows.schema["doc_id"].dataType.simpleString()
    ordered = rows.repartition(wide, "part").sortWithinPartitions("part", "doc_id", "tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, start, held, owners, size = None, 0, 0, [], [], 0
        id_type = None

        def row() -> pa.RecordBatch:
            nonlocal number, start, held, owners, size
            sizes = np.array([len(x) // kind.itemsize for x in held], np.int64)
            payload = pack(np.frombuffer(b"".join(held), kind).astype(np.uint32), sizes)
            total = int(sizes.sum())
            columns = [
                pa.array([part], pa.int32()),
                pa.array([number], pa.int32()),
                pa.array([start], pa.int64()),
                pa.array([total], pa.int64()),
                pa.array([owners], pa.list_(id_type)),
                pa.array([payload], pa.binary()),
            ]
            number, start, held, owners, size = number + 1, start + total, [], [], 0
            return pa.RecordBatch.from_arrays(columns, ["part", "segment", "start", "n_ids", "doc_ids", "payload"])

        for batch in batches:
            for piece in chunks(batch, "ids"):
                id_type = piece.column("doc_id").type
                columns = [piece.column(c).to_pylist() for c in ("part", "doc_id", "ids")]
                for at, owner, data in zip(*columns, strict=True):
                    if held and (at != part or size >= SEGMENT):
                        yield row()
                    if at != part:
                        part, number, start = at, 0, 0
                    held.append(data)
                    owners.append(owner)
                    size += len(data) // kind.itemsize
        if held:
            yield row()

    shape = f"part int, segment int, start bigint, n_ids bigint, doc_ids array<{owner_kind}>, payload binary"
    return materialise(ordered.mapInArrow(write, shape), label)


def read_blocks(files: DataFrame) -> DataFrame:
    """Per document of the written files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian u32)."""
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("size"))
    # At most MAX_PARTS rows.
    based = files.join(F.broadcast(running_base(sizes, "part", "size", "base")), "part")
    rows = based.select((F.col("base") + F.col("start")).alias("start"), "doc_ids", "payload")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, sizes = unpack(batch.column("payload")[i].as_py())
                ends = np.cumsum(sizes, dtype=np.int64)
                data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crc = [zlib.crc32(data[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_ids").slice(i, 1).flatten(),
                        pa.array(batch.column("start")[i].as_py() + ends - sizes),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(crc, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    return rows.mapInArrow(read, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
