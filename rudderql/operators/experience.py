"""The experience log and what is derived from it."""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import SharedFolder
from .ranks import positions

SCHEMA = "id long, pid long, query_id string, template_id string, arm int, plan string, features array<double>, reward double, at timestamp"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


class ExperienceStore:
    """An append-only Parquet log; statistics are derived by aggregation, never updated in place.

    Rows from ``record`` are held back until ``batch`` of them are there, or
    the log is read here, or flush() is called: one file for many queries. At
    most so many rewards are lost with the driver.
    """

    def __init__(self, spark: SparkSession, path: str, batch: int = 50):
        self.spark, self.path, self.batch = spark, path.rstrip("/"), batch
        self._held: list[tuple] = []

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/experience")

    def record(self, **row) -> None:
        """One executed query; ``reward`` is its time in ms."""
        now = datetime.now(timezone.utc)
        self._held.append(tuple(row.get(n, now if n == "at" else None) for n in NAMES))
        if len(self._held) >= self.batch:
            self.flush()

    def flush(self) -> None:
        if self._held:
            self.append(self.spark.createDataFrame(self._held, SCHEMA).coalesce(1))
            self._held = []

    def experience(self) -> DataFrame:
        self.flush()
        if not SharedFolder(self.spark, self.path).there("experience"):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/experience")

    def experiments(self) -> dict[str, str]:
        """query_id -> SQL of the registered test queries: few, since each runs under every arm."""
        if not SharedFolder(self.spark, self.path).there("experiments"):
            return {}
        return {r.query_id: r.sql for r in self.spark.read.schema("query_id string, sql string").parquet(f"{self.path}/experiments").collect()}

    def add_experiment(self, query_id: str, sql: str) -> None:
        self.spark.createDataFrame([(query_id, sql)], "query_id string, sql string").coalesce(1).write.mode("append").parquet(f"{self.path}/experiments")

    def cache_sql(self, rows: DataFrame) -> None:
        """Add texts (sequence_id, sql_text); one that is there already is replaced for readers."""
        rows.select("sequence_id", "sql_text", F.current_timestamp().alias("created_at"), F.lit(time.time_ns()).alias("at")).write.mode("append").parquet(f"{self.path}/sql_cache")

    def cached_sql(self) -> DataFrame:
        """sequence_id, sql_text, created_at: the text added last for each."""
        schema = "sequence_id string, sql_text string, created_at timestamp, at long"
        if not SharedFolder(self.spark, self.path).there("sql_cache"):
            return self.spark.createDataFrame([], schema).drop("at")
        return latest(self.spark.read.schema(schema).parquet(f"{self.path}/sql_cache"), ["sequence_id"], [F.desc("at"), F.desc("sql_text")]).drop("at")

    def arm_stats(self) -> DataFrame:
        return welford(self.experience(), ["template_id", "arm"], "reward")

    def templates(self) -> DataFrame:
        return templates(self.experience())

    def latest(self) -> DataFrame:
        return latest(self.experience(), ["pid"], [F.desc("id")])

    def status(self) -> dict:
        return totals(self.experience()).first().asDict()


def templates(log: DataFrame) -> DataFrame:
    """template_id, how often it was run, and when first and last."""
    return log.groupBy("template_id").agg(F.count(F.lit(1)).alias("sample_count"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))


def totals(log: DataFrame) -> DataFrame:
    """One row: runs, and distinct queries and templates among them."""
    return log.agg(F.count(F.lit(1)).alias("experience"), F.count_distinct("query_id").alias("queries"), F.count_distinct("template_id").alias("templates"))


def arm_usage(log: DataFrame) -> DataFrame:
    return log.groupBy("arm").agg(F.count(F.lit(1)).alias("uses"))


def arm_ranking(log: DataFrame) -> DataFrame:
    """template_id, arm, its best reward, runs and place among the template's arms, from 1; equal rewards by arm."""
    best = log.groupBy("template_id", "arm").agg(F.min("reward").alias("best"), F.count(F.lit(1)).alias("runs"))
    return best.withColumn("place", F.row_number().over(W.partitionBy("template_id").orderBy("best", "arm")))


def exploration_arms(log: DataFrame, top: int = 3, least_seen: int = 2) -> DataFrame:
    """template_id, arm: the ``top`` arms run ``least_seen`` times at least, but never a template's worst."""
    ranked = arm_ranking(log).withColumn("arms", F.count(F.lit(1)).over(W.partitionBy("template_id")))
    return ranked.where((F.col("place") <= top) & (F.col("runs") >= least_seen) & (F.col("place") < F.col("arms"))).select("template_id", "arm")


def welford(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, mean, m2: what running mean and sum of squared deviations would hold."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"))


def merge_welford(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Combine (n, mean, m2) rows of the same keys by their means' deviations, which lose no digits to cancellation."""
    of = W.partitionBy(*keys)
    common = F.sum(F.col("n") * F.col("mean")).over(of) / F.sum("n").over(of)
    spread = F.col("m2") + F.col("n") * (F.col("mean") - F.col("_common")) * (F.col("mean") - F.col("_common"))
    return parts.withColumn("_common", common).groupBy(*keys).agg(F.sum("n").alias("n"), F.max("_common").alias("mean"), F.sum(spread).alias("m2"))


def _ranked(df: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return _ranked(df, keys, order).where("_rank = 1").drop("_rank")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Of both the latest row by key; of equals the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, keys, [F.desc(at), F.desc("_new")]).drop("_new")


def balanced_batch(df: DataFrame, per_arm: int) -> DataFrame:
    """The most recent ``per_arm`` rows of each arm."""
    return _ranked(df, ["arm"], [F.desc("id")]).where(F.col("_rank") <= per_arm).drop("_rank")


def pending(experiments: DataFrame, arms: DataFrame, done: DataFrame) -> DataFrame:
    """(query_id, arm) not run yet. ``arms`` has at most 26 rows, so it is broadcast."""
    return experiments.crossJoin(F.broadcast(arms)).join(done, ["query_id", "arm"], "left_anti")


def hard_tail(df: DataFrame, share: float = 0.2) -> DataFrame:
    """The ``share`` of all rows (rounded up) with the largest reward, equal ones by id."""
    n = -int(-df.count() * share // 1)
    return positions(df, [F.desc("reward"), F.asc("id")], "_position").where(F.col("_position") <= n).drop("_position")


def template_cap(df: DataFrame, cap: int) -> DataFrame:
    """Of each template the ``cap`` rows with the largest reward, equal ones by id."""
    return _ranked(df, ["template_id"], [F.desc("reward"), F.asc("id")]).where(F.col("_rank") <= cap).drop("_rank")


def arm_coverage(df: DataFrame, per_arm: int) -> DataFrame:
    """Of each template and arm the ``per_arm`` rows with the largest reward, equal ones by id."""
    return _ranked(df, ["template_id", "arm"], [F.desc("reward"), F.asc("id")]).where(F.col("_rank") <= per_arm).drop("_rank")


def sample_budgeted(df: DataFrame, budget: int = 1000, cap: int = 100, per_arm: int = 5, hard: float = 0.2, vector: str | None = None, diverse: int = 0) -> DataFrame:
    """At most ``budget`` rows of (id, template_id, arm, reward, ...), all of them if they are no more; ids must be distinct.

    First come the worst ``hard`` share, then rows that give each arm of a
    template ``per_arm``, then others, at most ``cap`` of a template. Priority
    is class, then reward downwards, then id. With ``vector`` (an array
    column) up to ``diverse`` of the budget go to rows of the last class that
    are farthest apart, instead of those with the largest reward.
    """
    if df.count() <= budget:
        return df
    top = lambda rows, n: rows.orderBy(F.desc("reward"), "id").limit(n)
    keep = max(0, budget - diverse) if vector else budget
    # No more than ``keep`` rows of a class can be used, so the classes meet as a few rows.
    tiers = [top(x, keep).select("id", "reward", F.lit(i).alias("_tier")) for i, x in enumerate((hard_tail(df, hard), arm_coverage(df, per_arm), template_cap(df, cap)))]
    first = tiers[0].unionByName(tiers[1]).unionByName(tiers[2]).groupBy("id").agg(F.min("_tier").alias("_tier"), F.first("reward").alias("reward"))
    ids = first.orderBy("_tier", F.desc("reward"), "id").limit(keep).select("id")
    chosen = df.join(F.broadcast(ids), "id", "left_semi")  # ``budget`` rows at most
    if not vector or not diverse:
        return chosen
    left = template_cap(df.join(F.broadcast(ids), "id", "left_anti"), cap)
    return chosen.unionByName(k_centers(left, vector, "id", diverse))


def k_centers(df: DataFrame, vector: str, key: str, k: int, duplicate: float = 0.995) -> DataFrame:
    """Greedy max-min choice of ``k`` rows, begun at the row farthest from the mean.

    A row whose cosine with a chosen one is over ``duplicate`` is never
    chosen, nor is one twice, so the choice ends early when none is left.
    Each step is one distributed aggregate; only the chosen rows, k at most,
    come to the driver.
    """
    from ..functions.policy import cosine

    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    size = rows.select(F.max(F.size("v"))).first()[0]
    if not size:
        return df.limit(0)
    mean = rows.agg(*[F.avg(F.get("v", F.lit(i))).alias(f"m{i}") for i in range(size)]).first()
    gap = lambda c: F.aggregate(F.zip_with("v", F.lit([float(x) for x in c]), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, x: s + x)
    chosen: list = []
    for _ in range(k):
        if not chosen:
            score, free = gap(mean), F.lit(True)
        else:
            score = F.least(*[gap(c.v) for c in chosen]) if len(chosen) > 1 else gap(chosen[0].v)
            free = F.lit(True)
            for c in chosen:
                free = free & (F.col("key") != c.key) & (cosine(F.col("v"), F.lit([float(x) for x in c.v])) <= duplicate)
        best = rows.where(free).select(F.struct(score.alias("s"), (-F.col("key")).alias("neg"), "key", "v").alias("b")).agg(F.max("b").alias("b")).first().b
        if best is None:
            break
        chosen.append(best)
    keys = [c.key for c in chosen]
    return df.where(F.col(key).isin(keys)) if keys else df.limit(0)
