"""Does a model make any known query slower? The gate before it replaces another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regressions(runs: DataFrame, chosen: DataFrame, slack: float = 1.01) -> tuple[int, float]:
    """(queries over ``slack`` times their best arm, summed gap) for runs (query_id, arm, reward) and chosen (query_id, arm)."""
    by_arm = runs.groupBy("query_id", "arm").agg(F.avg("reward").alias("r"))
    best = by_arm.groupBy("query_id").agg(F.min("r").alias("best"))
    r = by_arm.join(chosen, ["query_id", "arm"]).join(best, "query_id").agg(F.count_if(F.col("r") > F.col("best") * slack).alias("n"), F.coalesce(F.sum(F.col("r") - F.col("best")), F.lit(0.0)).alias("gap")).first()
    return int(r.n), float(r.gap)


def accepts(new: tuple[int, float], old: tuple[int, float] | None) -> bool:
    """No regression at all, or no more of them and no larger gap than the model in use."""
    return new[0] == 0 or old is not None and new[0] <= old[0] and new[1] <= old[1]
