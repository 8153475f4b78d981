"""String hashing as the JVM does it, and the search for keys with a wanted hash.

Spark can say both with higher-order functions, but a fold over the characters runs
interpreted: about 50 microseconds for a 32-character key, against one or two for the Arrow
batches here. Keys are hashed for every row that is routed, so this is the hot path.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ship these few functions inside the tasks, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MATRIX = 500_000  # candidate keys looked at in one step


def hash_texts(texts: list[str]) -> np.ndarray:
    """``sum(unit * 31 ** (length - 1 - place))`` over UTF-16 units, as signed 32 bits."""
    encoded = [t.encode("utf-16-le", "surrogatepass") for t in texts]
    units = np.frombuffer(b"".join(encoded), dtype="<u2").astype(np.uint32)
    sizes = np.fromiter((len(e) // 2 for e in encoded), dtype=np.int64, count=len(encoded))
    ends = np.cumsum(sizes)
    powers = np.ones(int(sizes.max(initial=0)) + 1, dtype=np.uint32)
    powers[1:] = 31
    powers = np.multiply.accumulate(powers, dtype=np.uint32)
    terms = units * powers[np.repeat(ends, sizes) - 1 - np.arange(len(units))]
    upto = np.concatenate([np.zeros(1, np.uint32), np.cumsum(terms, dtype=np.uint32)])
    return (upto[ends] - upto[ends - sizes]).view(np.int32)


def _hash_series(texts: pd.Series) -> pd.Series:
    known = texts.notna()
    out = pd.Series(pd.NA, index=texts.index, dtype="Int32")
    out[known] = hash_texts(texts[known].tolist())
    return out


def java_hash(text: Column) -> Column:
    """The 32-bit string hash of the JVM, exact for all text."""
    # Made per call: a UDF that has run holds the session, and this module must stay fit to be sent to tasks.
    return F.pandas_udf(_hash_series, T.IntegerType())(text)


def signed_remainder(hashes: np.ndarray, n: int) -> np.ndarray:
    """Remainder with the sign of the hash, like the JVM's ``%``."""
    return np.fmod(hashes.astype(np.int64), n)


def candidates(seed: str, low: int, high: int) -> list[str]:
    start = hashlib.md5(f"{seed}#".encode())
    keys = []
    for attempt in range(low, high):
        digest = start.copy()
        digest.update(str(attempt).encode())
        keys.append(digest.hexdigest())
    return keys


def first_keys(seeds: list[str], buckets: np.ndarray, n: int, tries: int) -> list[str | None]:
    """For each seed its first candidate key in the wanted bucket, looked for in growing blocks."""
    found: list[str | None] = [None] * len(seeds)
    left, low, size = np.arange(len(seeds)), 0, 2 * n
    while len(left) and low < tries:
        high = min(low + size, tries)
        still = []
        step = max(1, MATRIX // (high - low))
        for at in range(0, len(left), step):
            rows = left[at : at + step]
            keys = [key for row in rows for key in candidates(seeds[row], low, high)]
            hit = signed_remainder(hash_texts(keys), n).reshape(len(rows), high - low) == buckets[rows, None]
            first = hit.argmax(axis=1)
            for i, row in enumerate(rows):
                if hit[i, first[i]]:
                    found[row] = keys[i * (high - low) + first[i]]
                else:
                    still.append(row)
        left, low, size = np.array(still, dtype=int), high, min(size * 2, MATRIX)
    return found


def find_key(seed: Column, n: int, bucket: Column, tries: int, on_fail: str = "error") -> Column:
    """First key ``md5(seed # attempt)`` whose signed hash remainder is ``bucket``.

    ``on_fail``: ``"error"`` fails the job for a row without a hit, ``"null"`` leaves NULL.
    Equal (seed, bucket) pairs of a batch are searched once.
    """

    @F.pandas_udf(T.StringType())
    def search(seeds: pd.Series, buckets: pd.Series) -> pd.Series:
        pairs = pd.DataFrame({"seed": seeds, "bucket": buckets})
        known = pairs.dropna().drop_duplicates().reset_index(drop=True)
        keys = first_keys(known["seed"].tolist(), known["bucket"].to_numpy(np.int64), n, tries)
        if on_fail == "error" and None in keys:
            lost = known.iloc[keys.index(None)]
            raise ValueError(f"no key for bucket {lost['bucket']} from {lost['seed']!r} in {tries} tries")
        known["key"] = pd.Series(keys, dtype=object)
        return pairs.merge(known, on=["seed", "bucket"], how="left")["key"]

    return search(seed, bucket)
