"""Running totals, numbering and previous values over ordered groups of any size.

A plain window puts a whole group into one task. Here rows are brought into the full order
(group, order keys) and written once, in as many ranges ("slices") as the job has shuffle
partitions. A slice is a range of the *full* order, so a busy group, or a busy instant inside
one, is spread by whatever key tells its rows apart. Windows run per (group, slice); what
earlier slices come to is one small row per group and slice and enters as a leading row. The
slices are written, so everything that looks at them sees the same cuts; results do not depend on them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowplace.session import materialise

SLICE = "_slice"


def cut(df: DataFrame, by: Sequence[str], order: Sequence[str], slices: int | None = None) -> DataFrame:
    """A written copy of ``df`` with the slice number of each row; slices follow (by, order).

    ``slices`` defaults to the session's shuffle partitions, the setting that says how wide a job of this size is.
    Rows are spread as far as ``order`` tells them apart, so it should end with a unique id.
    """
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *by, *order)
    return materialise(ranged.withColumn(SLICE, F.spark_partition_id()), "slices")


def finish(pieces: DataFrame) -> DataFrame:
    return pieces.drop(SLICE)


def with_leads(pieces: DataFrame, leads: DataFrame) -> DataFrame:
    """Rows plus one leading row per group and slice; ``_lead`` is 0 there and 1 elsewhere."""
    return pieces.withColumn("_lead", F.lit(1)).unionByName(
        leads.withColumn("_lead", F.lit(0)), allowMissingColumns=True
    )


def without_leads(rows: DataFrame, *helpers: str) -> DataFrame:
    return rows.filter(F.col("_lead") == 1).drop("_lead", *helpers)


def running(pieces: DataFrame, by: Sequence[str], order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Inclusive running totals ``{new column: summand}`` in ``order`` within ``by``."""
    keys = [*by, SLICE]
    totals = pieces.groupBy(*keys).agg(*[F.sum(v).alias(f"_s_{n}") for n, v in sums.items()])
    line = Window.partitionBy(*by).orderBy(SLICE)
    earlier = line.rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        *keys,
        F.lag(SLICE).over(line).alias("_former"),
        *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_s_{n}") for n in sums],
    )
    leads = before.filter(F.col("_former").isNotNull()).drop("_former")
    rows = with_leads(pieces.withColumns({f"_s_{n}": v for n, v in sums.items()}), leads)
    upto = Window.partitionBy(*keys).orderBy("_lead", *order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({n: F.sum(f"_s_{n}").over(upto) for n in sums})
    return without_leads(rows, *[f"_s_{n}" for n in sums])


def slice_lasts(pieces: DataFrame, by: Sequence[str], order: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    """Per group and slice: the last row's values, and those of the group's slice before
    (``_last`` and ``_carried``)."""
    kept = F.struct(*[v.alias(n) for n, v in columns.items()])
    lasts = pieces.groupBy(*by, SLICE).agg(F.max_by(kept, F.struct(*order)).alias("_last"))
    return lasts.withColumn("_carried", F.lag("_last").over(Window.partitionBy(*by).orderBy(SLICE)))


def previous(
    pieces: DataFrame, by: Sequence[str], order: Sequence[str], columns: dict[str, Column], found: str
) -> DataFrame:
    """Values ``{new column: source}`` of the row before in ``order`` within ``by``.

    ``found`` names a flag that is false for the first row, where the new columns are NULL.
    ``by`` must contain the columns the pieces were cut by.
    """
    keys = [*by, SLICE]
    leads = slice_lasts(pieces, by, order, columns).filter(F.col("_carried").isNotNull())
    kept = F.struct(*[v.alias(n) for n, v in columns.items()])
    rows = with_leads(pieces.withColumn("_kept", kept), leads.select(*keys, F.col("_carried").alias("_kept")))
    rows = rows.withColumn("_prev", F.lag("_kept").over(Window.partitionBy(*keys).orderBy("_lead", *order)))
    rows = rows.withColumns(
        {found: F.col("_prev").isNotNull(), **{n: F.col(f"_prev.{n}") for n in columns}}
    )
    return without_leads(rows, "_prev", "_kept")


def numbered(
    df: DataFrame, by: Sequence[str], order: Sequence[str], name: str, slices: int | None = None
) -> DataFrame:
    """1-based row number in ``order`` within ``by``."""
    pieces = cut(df, by, order, slices)
    return finish(running(pieces, by, order, {name: F.lit(1).cast("bigint")}))


def first_rows(
    df: DataFrame, by: Sequence[str], order: Sequence[str], k: int, name: str, slices: int | None = None
) -> DataFrame:
    """The first ``k`` rows of each group with their 1-based number, for any ``k``."""
    return numbered(df, by, order, name, slices).filter(F.col(name) <= k)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
