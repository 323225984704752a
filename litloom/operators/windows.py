"""Window operators: scaling within groups, ranks, running budgets, ordinal identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litloom.runtime import BROADCAST_LIMIT, cut, estimated_bytes


def minmax(value: Column, low: Column, high: Column, reverse: bool = False) -> Column:
    """Value scaled to [0, 1] between ``low`` and ``high``; 1 for all if the two are equal but for 1e-9 of their size."""
    equal = F.abs(high - low) <= 1e-9 * F.greatest(F.abs(high), F.abs(low))
    scaled = (value - low) / F.when(high == low, F.lit(None)).otherwise(high - low)
    return F.when(equal, 1.0).otherwise(1.0 - scaled if reverse else scaled)


def scaled_within(df: DataFrame, group: str, value: str, alias: str, reverse: bool = False) -> DataFrame:
    """Add the value scaled within its group.

    The bounds come from an aggregate that is joined back, so that a hot group is pre-aggregated and never sits in one
    window partition.
    """
    bounds = df.groupBy(group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    joined = df.join(F.broadcast(bounds) if _few(bounds) else bounds, group)
    return joined.withColumn(alias, minmax(F.col(value), F.col("_lo"), F.col("_hi"), reverse)).drop("_lo", "_hi")


def _few(bounds: DataFrame) -> bool:
    return estimated_bytes(bounds) <= BROADCAST_LIMIT


def _numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` in a total order over all tasks, with the task (``_part``) and the place in it (``_row``).

    The input is written first, as the sort by range samples it.
    """
    df = cut(df)
    ordered = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    numbered = ordered.withColumn("_id", F.monotonically_increasing_id())
    part, row = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return cut(numbered.withColumn("_part", part).withColumn("_row", row).drop("_id"))


def ranked(df: DataFrame, order: list[Column], alias: str = "rank") -> DataFrame:
    """Add a dense 1-based rank (bigint) in a total order.

    A global row number needs one order over all rows. The rows are sorted by range over all tasks; each task counts, and
    the number of rows in the tasks before it is added, so no task holds more than its share.
    """
    numbered = _numbered(df, order)
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    return numbered.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn(alias, F.col("_before") + F.col("_row") + 1).drop("_part", "_row", "_before")


def numbered_within(df: DataFrame, group: str, order: list[str], alias: str) -> DataFrame:
    """Add the 1-based number of each row within its group.

    Rows are sorted by range over group and order, so a hot group lies in many tasks; a task numbers its part of a group,
    and what lies in the tasks before is added from one row per group and task.
    """
    numbered = _numbered(df, [F.col(group), *[F.col(c) for c in order]])
    own = numbered.groupBy("_part", group).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return numbered.join(own.select("_part", group, "_first", before.alias("_before")), ["_part", group]).withColumn(alias, F.col("_before") + F.col("_row") - F.col("_first") + 1).drop("_part", "_row", "_first", "_before")


def within_budget(df: DataFrame, group: str, order: list[str], per_group: int) -> DataFrame:
    """Requests allowed by a budget for each group, in order of arrival: the running count is within the limit."""
    running = F.count("*").over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("request_no", running).withColumn("allowed", F.col("request_no") <= per_group)


def first_appearance(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: where it appears first."""
    return df.groupBy(key).agg(F.min(order).alias(order))
