"""Column helpers: built-in Spark expressions, and Arrow batches for string hashing."""

from flowplace.functions.columns import (
    be_long,
    config_value,
    edge_ends,
    floor_log2,
    hash_bucket,
    metric_path,
    next_bucket,
    to_be_long,
)
from flowplace.functions.hashing import find_key, java_hash

__all__ = [
    "be_long",
    "config_value",
    "edge_ends",
    "find_key",
    "floor_log2",
    "hash_bucket",
    "java_hash",
    "metric_path",
    "next_bucket",
    "to_be_long",
]
