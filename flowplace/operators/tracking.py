"""Match emitted messages with their acknowledgements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: seconds after which an unacknowledged message has failed.
TIMEOUT_SECS = 100


def emit_ack_match(roots: DataFrame, acks: DataFrame, timeout_secs: int = TIMEOUT_SECS) -> DataFrame:
    """Each message with ``completed``, and its latency where an ack came in time.

    A message with several acks in time gives a row for each.
    """
    a = acks.select(F.col("msg_id").alias("_ack_id"), "ack_ts", "latency_ms")
    in_time = F.col("ack_ts").between(F.col("ts"), F.col("ts") + F.expr(f"interval {timeout_secs} seconds"))
    return roots.join(a, (F.col("msg_id") == F.col("_ack_id")) & in_time, "left").select(
        "topology",
        "ts",
        "msg_id",
        "source",
        F.col("_ack_id").isNotNull().alias("completed"),
        "latency_ms",
    )
