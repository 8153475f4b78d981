"""SentencePiece encoding and decoding over a trie of distinct marked words.

White space becomes the mark ``▁`` and text is cut before each run of marks; no piece of the
model crosses such a cut, so a word's pieces don't depend on its neighbours. The distinct words of a batch are
sorted, which is a depth-first walk over their trie: the forward table of a word is kept as far as the next
word agrees with it, so every shared prefix is worked out once.

Forward table, by model type. *Unigram*: the best score of any segmentation of the prefix and its last piece (Viterbi).
*BPE*: merges have no best sum, but the segmentation of a prefix is a prefix of the segmentation, so each place
again has one last piece: the one that the segmentation before it does not merge with. Two pieces may stand side by
side if merging their characters gives them back; that is asked once per pair and remembered.
"""

from __future__ import annotations

import re
import sys
from array import array

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowplace.llm.common import kept, per_chunk, text_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
KNOWN = 1 << 16  # words after which a worker begins to forget those that have not come again; a chunk may go beyond
SLOTS = (1 << 19) - 1  # places for remembered pairs of pieces, a prime; a later pair takes the place of an earlier one
CHUNK = 1 << 18  # bytes of text that are cut into words at once
OPERATOR = "piece_trie"  # owner of what a worker keeps
NO_SCORE = -1e9  # pieces at or below this score take no part in sums


class Trie:
    """Encoder and decoder of one model file; everything it needs is read from the model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in normal}
        self.scores = {self.pieces[i]: model.get_score(i) for i in normal}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece crosses the beginning of a word; such models are not supported")
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.unknown = model.unk_id()
        # Merge models score pieces by rank: whole numbers, none above zero. Sums of logarithms are not whole.
        self.merges = all(float(s).is_integer() for s in self.scores.values())
        self.plain = [b"" if model.is_control(i) else self.pieces[i].encode() for i in range(n)]
        for value, i in self.bytes.items():
            self.plain[i] = bytes([value])
        self.plain[self.unknown] = " ⁇ ".encode()  # how the library shows it
        self.words: dict[str, bytes] = {}  # ids as packed i32
        self.older: dict[str, bytes] = {}  # words of the round before; those that come again move on
        self.pairs = array("q", [-1]) * SLOTS  # number of the pair, doubled, and whether its pieces stay apart
        self.ends = self.by_end()

    def by_end(self) -> dict:
        """The usable pieces as a tree of their characters from the last to the first; under "" stands the piece.

        A merge model never arrives at some of its pieces; these are left out.
        """
        root: dict = {}
        for piece in self.ids:
            if not self.merges or len(piece) == 1 or self.merged(piece) == [piece]:
                node = root
                for c in reversed(piece):
                    node = node.setdefault(c, {})
                node[""] = piece
        return root

    def normal(self, text: str) -> str:
        """The text as the model sees it: its own normaliser, marks included."""
        return self.model.normalize(text)

    def merged(self, text: str) -> list[str]:
        """Pieces of a short string by merging, best score first and leftmost among equals; unknown characters stay alone."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def apart(self, a: str, b: str) -> bool:
        """Whether ``a`` and ``b`` stay as they are next to each other."""
        pair = self.number(a) * (len(self.pieces) + sys.maxunicode + 1) + self.number(b)
        known = self.pairs[pair % SLOTS]
        if known >> 1 != pair:
            known = self.pairs[pair % SLOTS] = 2 * pair + (self.merged(a + b) == [a, b])
        return bool(known & 1)

    def number(self, piece: str) -> int:
        """The id of a piece; a character that is none has a number beyond all ids."""
        own = self.ids.get(piece)
        return len(self.pieces) + ord(piece) if own is None else own

    def pieces_before(self, word: str, end: int) -> list[str]:
        """Pieces that end at a place of the word, longest first; the last character by itself if it is none."""
        found, node, at = [], self.ends, end
        while at and (node := node.get(word[at - 1])) is not None:
            at -= 1
            if "" in node:
                found.append(node[""])
        if not found or len(found[0]) > 1:
            found.insert(0, word[end - 1])
        found.reverse()
        return found

    def learn(self, words: list[str]) -> None:
        """Encode the sorted distinct ``words``: a depth-first walk, each shared prefix once."""
        before, last, best = "", [""], [0.0]
        for word in words:
            shared = 0
            limit = min(len(before), len(word))
            while shared < limit and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], best[shared + 1 :]
            for end in range(len(last), len(word) + 1):
                options = self.pieces_before(word, end)
                if self.merges:
                    last.append(next(p for p in options if len(p) == end or self.apart(last[end - len(p)], p)))
                else:
                    scored = [(best[end - len(p)] + self.scores.get(p, NO_SCORE), p) for p in options]
                    top, piece = max(scored, key=lambda o: o[0])
                    last.append(piece)
                    best.append(top)
            ids: list[int] = []
            end = len(word)
            while end:
                piece = last[end]
                own = self.ids.get(piece)
                if own is not None:
                    ids.append(own)
                elif self.bytes:
                    ids += [self.bytes[b] for b in reversed(piece.encode())]
                else:
                    ids.append(self.unknown)
                end -= len(piece)
            self.words[word] = array("i", reversed(ids)).tobytes()
            before = word

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [WORD.findall(self.normal(t)) for t in texts]
        if len(self.words) > KNOWN:
            self.words, self.older = {}, self.words
        known = self.words
        new = {w for words in cut for w in words if w not in known}
        again = new & self.older.keys()
        known.update((w, self.older.pop(w)) for w in again)
        self.learn(sorted(new - again))
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32) for words in cut]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; the mark that the model adds in front is taken away again."""
        text = b"".join(map(self.plain.__getitem__, ids.tolist())).decode(errors="replace").replace(MARK, " ")
        return text.removeprefix(" ")


def worker_trie(path: str) -> Trie:
    """One encoder per Python worker and model, until the worker turns to another operator."""
    return kept(OPERATOR, path, lambda: Trie(path))


def encode_pieces(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and the ids of its whole text.

    ``model`` is a SentencePiece file. Ids equal the library's. Null and empty texts have no ids; characters without
    a piece become byte pieces, or the unknown piece in models without those. Repeated rows come back each, an
    empty table gives no rows, other columns are ignored.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(f"`{text}`").alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = worker_trie(model).encode(batch.column("text").to_pylist())
        ends = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
        flat = np.concatenate([np.empty(0, np.int32), *found])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(flat))], ["doc_id", "ids"])

    return rows.mapInArrow(per_chunk(work, "text", CHUNK, OPERATOR), rows.select("doc_id", F.array(F.lit(0)).alias("ids")).schema)


def decode_pieces(rows: DataFrame, model: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per row: doc_id and the text of its ids. Null or no ids give empty text.

    White-space marks become spaces, so a text that itself holds the mark comes back with spaces there; byte
    pieces that are no UTF-8 come back as the replacement character.
    """
    picked = rows.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{ids}`").alias("ids"))

    def work(batches):
        for batch in batches:
            tool = worker_trie(model)
            texts = [tool.decode(np.array(x or [], np.int32)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return picked.mapInArrow(work, picked.select("doc_id", F.lit("").alias("text")).schema)


def round_trip(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_ids, ids_sha256 (ids as little-endian i32), text_sha256 and lossless, of the decoded text."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(f"`{text}`").alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        import hashlib

        tool = worker_trie(model)
        texts = batch.column("text").to_pylist()
        found = tool.encode(texts)
        back = [tool.decode(ids) for ids in found]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(x) for x in found], pa.int64()),
                pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in found], pa.string()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string()),
                pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_()),
            ],
            ["doc_id", "n_ids", "ids_sha256", "text_sha256", "lossless"],
        )

    kind = rows.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, n_ids bigint, ids_sha256 string, text_sha256 string, lossless boolean"
    return rows.mapInArrow(per_chunk(work, "text", CHUNK, OPERATOR), shape)
