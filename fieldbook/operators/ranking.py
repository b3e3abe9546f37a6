"""Places of rows in an order, over all of them or within groups, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldbook.sources.shared import ready_checkpoints

#: Rows of a table of counts that are broadcast; beyond, Spark chooses the join.
SMALL = 100_000


def placed(rows: DataFrame, order: list[Column], within: list[str] | None = None, out: str = "place") -> DataFrame:
    """rows with their place, from 1, in an order; within each of some groups if so wanted (nulls are a group).

    Rows are dealt by ranges of group and order, and sorted there; equal rows may lie in several ranges, so neither a
    large group nor a common key is one task's.  A row's place is its number in its range, plus the rows of its
    group in the ranges before, which are counted by range and group.  A checkpoint keeps where rows lie,
    as bounds that are sampled twice could differ.
    """
    ready_checkpoints(rows.sparkSession)
    within = within or []
    keys = [F.col(c).asc_nulls_first() for c in within] + order
    spread = rows.repartitionByRange(*keys, F.rand(7)).sortWithinPartitions(*keys)
    spread = spread.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()).checkpoint()
    ranges = spread.groupBy(*within, "_p").agg(F.min("_i").alias("_s"), F.count("*").alias("_n"))
    ahead = W.partitionBy(*within).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # a row for each range, and one more for each group at most
    starts = ranges.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(within)], F.col("_p").alias("_q"), "_s", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_b"))
    if starts.count() <= SMALL:
        starts = F.broadcast(starts)
    same = F.col("_p") == F.col("_q")
    for i, c in enumerate(within):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return spread.join(starts, same).select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_b") + F.col("_i") - F.col("_s") + 1).alias(out))


def first_k(rows: DataFrame, order: list[Column], within: list[str], k: int, out: str = "place") -> DataFrame:
    """The first k rows of each group with their place; tasks hand on k rows of a group at most."""
    place = F.row_number().over(W.partitionBy(*within).orderBy(*order))
    return rows.withColumn(out, place).where(F.col(out) <= k)
