"""Benchmark analytics over run logs (at, path, seconds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import positions, running_sums


def completion_curve(log: DataFrame, per_minute: float = 60.0) -> DataFrame:
    """at, done (queries so far), minutes since the first; ``per_minute``: units of ``at`` in a minute."""
    begun = F.broadcast(log.agg(F.min("at").alias("_begun")))
    return positions(log, ["at", "path"], "done").join(begun).withColumn("minutes", (F.col("at") - F.col("_begun")) / F.lit(per_minute)).drop("_begun")


def latency_cdf(log: DataFrame) -> DataFrame:
    """share: part of the other runs that are faster; ties by path, then in any order."""
    rows = F.broadcast(log.agg(F.count(F.lit(1)).alias("_rows")))
    placed = positions(log, ["seconds", "path"], "_position").join(rows)
    return placed.withColumn("share", F.when(F.col("_rows") > 1, (F.col("_position") - 1) / (F.col("_rows") - 1)).otherwise(0.0)).drop("_rows", "_position")


def regression_table(log: DataFrame, baseline: DataFrame) -> DataFrame:
    """path, worst, best, last in ``log``, best in ``baseline``, and whether the last run is over 1 % slower."""
    mine = log.groupBy("path").agg(F.max("seconds").alias("worst"), F.min("seconds").alias("best"), F.max_by("seconds", "at").alias("last"), F.count(F.lit(1)).alias("repeats"))
    base = baseline.groupBy("path").agg(F.min("seconds").alias("baseline"))
    number = F.regexp_extract("path", r"/q(\d+)", 1)
    return mine.join(base, "path").withColumn("slower", F.col("last") > F.col("baseline") * 1.01).orderBy(F.when(number != "", number.cast("int")), "path")


def chunks(log: DataFrame, size: int = 25) -> DataFrame:
    """Rounds of ``size`` queries by completion; the first is the warm-up."""
    return positions(log, ["at", "path"], "_position").withColumn("chunk", F.floor((F.col("_position") - 1) / size).cast("int")).drop("_position")


def done_before(log: DataFrame, trainings: DataFrame) -> DataFrame:
    """trained_at and how many queries were complete by then: one sort of both, no pairs."""
    both = log.select("at", F.lit(1).cast("long").alias("q")).unionByName(trainings.select(F.col("trained_at").alias("at"), F.lit(0).cast("long").alias("q")))
    return running_sums(both, ["at", F.desc("q")], "q", "done").where("q = 0").select(F.col("at").alias("trained_at"), "done")


def percentiles(log: DataFrame) -> DataFrame:
    return log.agg(F.count(F.lit(1)).alias("queries"), F.sum("seconds").alias("total"), F.avg("seconds").alias("mean"), *[F.percentile("seconds", p).alias(f"p{int(p * 100)}") for p in (0.5, 0.9, 0.95, 0.99)], F.max("seconds").alias("max"))


def runs_by_experiment(experiments: DataFrame, log: DataFrame) -> DataFrame:
    """query_id, arm, runs (ids in order) and best reward of the experiments' runs, in order of query and arm."""
    mine = log.join(experiments.select("query_id").distinct(), "query_id")
    return mine.groupBy("query_id", "arm").agg(F.sort_array(F.collect_list("id")).alias("runs"), F.min("reward").alias("best")).orderBy("query_id", "arm")
