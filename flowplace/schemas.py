"""Explicit schemas of the tables and documents; nothing is ever inferred."""

from pyspark.sql import types as T

# JSON object keys are text; readers turn them into task ids.
POINT = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("value", T.LongType()),
        T.StructField("value_map", T.MapType(T.StringType(), T.LongType())),
    ]
)

TASK_REPORT = T.StructType(
    [
        T.StructField("topology", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("id", T.LongType()),
        T.StructField("worker_host", T.StringType()),
        T.StructField("worker_port", T.IntegerType()),
        T.StructField("component", T.StringType()),
        T.StructField("task_id", T.LongType()),
        T.StructField("points", T.ArrayType(POINT)),
    ]
)

SENDGRAPH_DOC = T.StructType(
    [
        T.StructField("nodes", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))),
        T.StructField(
            "links",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("source", T.LongType()),
                        T.StructField("target", T.LongType()),
                        T.StructField("value", T.LongType()),
                    ]
                )
            ),
        ),
    ]
)
