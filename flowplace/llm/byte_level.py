"""Byte-level BPE files of the tokenizers library, encoded many texts at a time.

A file whose rule is the plain one (byte-level split, no normaliser, merges in the order of their ids) is put into
tiktoken as ranks, which gives the same ids several times faster. Any other file, and any text that holds one of the file's
special strings or that tiktoken gives up on (very long white space), goes through the library itself.
"""

from __future__ import annotations

import json
import re
import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The splitting rule of byte-level files with ``use_regex``, a fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level file; special tokens are their own strings."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = {i: t.content.encode() for i, t in tokenizer.get_added_tokens_decoder().items()}
    known = {i: s for s, i in tokenizer.get_vocab(with_added_tokens=False).items()}
    as_byte = byte_of()
    return [special.get(i) or bytes(map(as_byte.__getitem__, known.get(i, ""))) for i in range(max(known.keys() | special.keys()) + 1)]


class ByteLevel:
    """Encoder of one file. ``plain``: special strings inside texts are ordinary text."""

    def __init__(self, path: str, plain: bool):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        special = [] if plain else [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        self.fast = self.ranks(path)

    @staticmethod
    def ranks(path: str):
        """The file as a tiktoken encoding, or None where its rule is another one."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        rule, model = spec["pre_tokenizer"] or {}, spec["model"]
        simple = (
            spec["normalizer"] is None
            and rule.get("type") == "ByteLevel"
            and rule.get("use_regex")
            and not rule.get("add_prefix_space")
            and model["type"] == "BPE"
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            and all(t["special"] or t["normalized"] is False for t in spec["added_tokens"])
        )
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        vocab = model.get("vocab", {})
        merged = [vocab.get(a + b) for a, b in pairs] if simple else [None]
        if None in merged or any(a >= b for a, b in zip(merged, merged[1:], strict=False)) or len(merged) + 256 != len(vocab):
            return None
        import tiktoken

        as_byte = byte_of()
        ranks = {bytes(map(as_byte.__getitem__, s)): i for s, i in vocab.items()}
        return tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def one(self, text: str) -> np.ndarray:
        if self.fast is not None and not self.special.search(text):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # white space beyond the depth that its regular expressions can go back
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, unsigned 32-bit."""
        return [self.one(t) for t in texts]


def worker_encoder(path: str, plain: bool) -> ByteLevel:
    """One encoder per Python worker, file and treatment of special strings."""
    kept = sys.__dict__.setdefault("_byte_level_encoders", {})
    if (path, plain) not in kept:
        kept[path, plain] = ByteLevel(path, plain)
    return kept[path, plain]
