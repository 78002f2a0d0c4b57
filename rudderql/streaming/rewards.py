"""Rewards as a stream: micro-batches merged into running statistics per template and arm."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.experience import merge_welford, welford
from ..sources.shared import SharedFolder

KEYS = ["template_id", "arm"]
ROWS = "template_id string, arm int, n long, mean double, m2 double"


class RewardStats:
    """Statistics under ``path``: versions, each with the last batch that it holds of every stream.

    A batch that is sent again is not added twice, and a stream with a new
    checkpoint is a stream of its own, whose batches count from 0 again.
    Versions are renamed into place; the last two are kept, for readers.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._folder = SharedFolder(spark, path)

    def _versions(self) -> list[str]:
        return [n for n in self._folder.names() if n.startswith("version-")]

    def current(self) -> DataFrame:
        done = self._versions()
        return self.spark.read.schema(ROWS).parquet(f"{self.path}/{done[-1]}/rows") if done else self.spark.createDataFrame([], ROWS)

    def add(self, batch: DataFrame, batch_id: int, stream: str = "") -> bool:
        """Merge a batch into a new version; False if its stream has brought it before."""
        while True:
            done = self._versions()
            seen = {}
            if done:  # a row a stream
                seen = {r.stream: r.batch for r in self.spark.read.schema("stream string, batch long").parquet(f"{self.path}/{done[-1]}/streams").collect()}
            if batch_id <= seen.get(stream, -1):
                return False
            staged, following = f"staging-{uuid.uuid4().hex}", int(done[-1].split("-")[1]) + 1 if done else 0
            merged = merge_welford(self.current().unionByName(welford(batch, KEYS, "reward")), KEYS)
            merged.write.parquet(f"{self.path}/{staged}/rows")
            self.spark.createDataFrame(list((seen | {stream: batch_id}).items()), "stream string, batch long").coalesce(1).write.parquet(f"{self.path}/{staged}/streams")
            if self._folder.place(staged, f"version-{following:012d}"):
                for old in self._versions()[:-2]:
                    self._folder.remove(old)
                return True

    def start(self, rewards: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return rewards.writeStream.foreachBatch(lambda batch, i: self.add(batch, i, checkpoint) and None).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_latency(rewards: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Runs and mean reward per arm in tumbling windows of ``at``, with a watermark for late rows."""
    w = rewards.withWatermark("at", late).groupBy(F.window("at", width), "arm").agg(F.count(F.lit(1)).alias("n"), F.avg("reward").alias("mean"))
    return w.select(F.col("window.start").alias("begin"), "arm", "n", "mean")
