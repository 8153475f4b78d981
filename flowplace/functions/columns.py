"""Scalar column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowplace.functions.hashing import java_hash

# The two ways the id pair of an edge path may be separated.
EDGE_PATH = r"(-?\d+)[-_](-?\d+)$"
# Root of a metric path when none is given.
DEFAULT_BASE = "flowplace"


def be_long(data: Column) -> Column:
    """8 big-endian bytes -> BIGINT."""
    return F.conv(F.hex(data), 16, 10).cast("bigint")


def to_be_long(value: Column) -> Column:
    """BIGINT -> 8 big-endian bytes."""
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 16, "0"))


def edge_ends(path: Column) -> tuple[Column, Column]:
    """``…/2-6`` or ``…/-1_4`` -> (source, target); NULL where the path has no id pair."""
    return tuple(F.regexp_extract(path, EDGE_PATH, i).try_cast("bigint") for i in (1, 2))


def config_value(conf: Column, key: str, kind: str, default) -> Column:
    """Typed lookup in a string-keyed map; a missing or unreadable value gives the default."""
    return F.coalesce(F.try_element_at(conf, F.lit(key)).try_cast(kind), F.lit(default).cast(kind))


def metric_path(base: Column | None, *parts: Column) -> Column:
    """``base.topology.metric`` with the default base where none is given."""
    root = F.lit(DEFAULT_BASE) if base is None else F.coalesce(base, F.lit(DEFAULT_BASE))
    return F.concat_ws(".", root, *parts)


def floor_log2(value: Column) -> Column:
    """Exact floor(log2(value)) of a positive BIGINT."""
    return F.length(F.bin(value)) - 1


def hash_bucket(key: Column, n: Column | int) -> Column:
    """Signed remainder of the string hash: negative hashes keep their sign."""
    return java_hash(key) % n


def next_bucket(key: Column, n: Column | int) -> Column:
    """The bucket after the key's own one, rotating on the signed remainder."""
    return (hash_bucket(key, n) + 1) % n
