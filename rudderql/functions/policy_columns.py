"""The scores and buckets of policy.py as columns, for logs and tables of any size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epsilon(n: Column, start: float = 0.2, least: float = 0.02) -> Column:
    return F.greatest(F.lit(start) / F.sqrt(F.greatest(F.lit(1), n)), F.lit(least))


def impact(cost: Column, cap: float = 5.0) -> Column:
    """1 where the cost is null."""
    return F.coalesce(1 / (1 + F.least(F.greatest(cost.cast("double"), F.lit(0.0)), F.lit(cap))), F.lit(1.0))


def normal_cost(total: Column) -> Column:
    return F.log10(1 + total) / 3


def squash(raw: Column) -> Column:
    soft = F.log1p(F.exp(raw / 0.5)) - F.log(F.lit(2.0))
    return F.least(F.greatest(1 / (1 + F.exp(-6 * soft)) - 0.5, F.lit(0.0)), F.lit(1.0))


def optimistic(score: Column, runs: Column, beta: float, high_is_good: bool = False) -> Column:
    """An arm that was never run (null) keeps its score."""
    bonus = beta / F.sqrt(F.greatest(F.lit(1), runs))
    return F.when(runs.isNull(), score).otherwise(score + bonus if high_is_good else score - bonus)


def group_bucket(keys: Column) -> Column:
    return F.least(keys, F.lit(3)).cast("int")


def rows_bucket(rows: Column) -> Column:
    return F.when(rows < 1e3, 0).when(rows < 1e5, 1).otherwise(2)


def count_bucket(n: Column) -> Column:
    return F.when(n <= 0, 0).when(n <= 2, 1).otherwise(2)


def one_hot(value: Column, size: int) -> list[Column]:
    """A column of 0 and 1 for each value; values outside the range count as the nearest one."""
    at = F.least(F.greatest(value, F.lit(0)), F.lit(size - 1))
    return [(at == i).cast("int") for i in range(size)]
