"""Ranks and running sums over all rows, without a task that sees all rows.

Rows are sorted by range partition and written once (ranges are sampled, so
they must not be drawn again); what lies before a partition is a sum over a row
per partition, which is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import materialize

_LOW = (1 << 33) - 1  # monotonically_increasing_id: partition in the upper bits, place in the lower 33


def _in_ranges(df: DataFrame, order: list) -> DataFrame:
    rows = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    return rows.withColumn("_part", F.shiftrightunsigned("_at", 33))


def _with_before(rows: DataFrame, value: Column) -> DataFrame:
    """``rows`` with ``_before``: the sum of ``value`` over all earlier partitions."""
    sums = rows.groupBy(F.col("_part").alias("_p")).agg(F.sum(value).alias("_s"))
    earlier = F.coalesce(F.sum("_s").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(sums.select("_p", earlier.alias("_before"))), F.col("_part") == F.col("_p"))


def positions(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """Add each row's place, from 1, in the order of ``order``; rows that tie come in any order. Empty table: empty result."""
    placed = _with_before(_in_ranges(df, order), F.lit(1).cast("long"))
    return placed.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(_LOW) + 1).drop("_at", "_part", "_p", "_before")


def running_sums(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over this row and all before it in the order of ``order``."""
    placed = _with_before(_in_ranges(df, order), F.col(value))
    inside = F.sum(value).over(W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, 0))
    return placed.withColumn(name, F.col("_before") + inside).drop("_at", "_part", "_p", "_before")


def percent_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add (rank - 1) / (rows - 1) of ``column``, equal values ranking alike; 0 for a single row. Nulls come first."""
    placed = materialize(positions(df, [column], "_position"), "positions")
    first = placed.groupBy(F.col(column).alias("_v")).agg(F.min("_position").alias("_first"))
    total = F.broadcast(placed.agg(F.count(F.lit(1)).alias("_rows")))
    ranked = placed.join(first, F.col(column).eqNullSafe(F.col("_v"))).join(total)
    share = F.when(F.col("_rows") > 1, (F.col("_first") - 1) / (F.col("_rows") - 1)).otherwise(0.0)
    return ranked.withColumn(name, share).drop("_position", "_v", "_first", "_rows")
