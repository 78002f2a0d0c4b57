"""Latency prediction: a base model of the query and a correction for each arm.

Rewards are scaled by log1p and min-max. The base is fitted on features, then
each arm's correction on the base's residuals, so an arm without data predicts
the base. Fits are small linear solves over aggregated moments: Spark sums
x x' and x y by partition, the driver solves a system as wide as the features.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class TrainingError(RuntimeError):
    """There is nothing to learn from."""


@dataclass
class LatencyModel:
    names: list[str]
    low: float = 0.0
    high: float = 1.0
    base: list[float] = field(default_factory=list)
    deltas: dict[int, list[float]] = field(default_factory=dict)
    samples: int = 0

    def scale(self, reward: float) -> float:
        return (math.log1p(reward) - self.low) / max(self.high - self.low, 1e-9)

    def unscale(self, value: float) -> float:
        return math.expm1(value * max(self.high - self.low, 1e-9) + self.low)

    def predict(self, features: list[float], arms: list[int]) -> list[float]:
        """Milliseconds by arm, never below 0."""
        x = np.array([1.0, *features])
        return [max(0.0, self.unscale(float(np.clip(x @ self.base + (x @ self.deltas[a] if a in self.deltas else 0.0), -0.5, 1.5)))) for a in arms]

    def save(self, path: str, spark: SparkSession | None = None) -> None:
        """As one line of JSON in a folder of any file system that Spark can write."""
        text = json.dumps(self.__dict__ | {"deltas": {str(k): v for k, v in self.deltas.items()}})
        (spark or SparkSession.active()).createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, path: str, spark: SparkSession | None = None) -> LatencyModel:
        d = json.loads((spark or SparkSession.active()).read.text(path).first().value)
        return cls(**(d | {"deltas": {int(k): v for k, v in d["deltas"].items()}}))


def scaled_rewards(df: DataFrame, reward: str = "reward", name: str = "scaled") -> DataFrame:
    """Add 1 for the least reward, 0 for the largest, in between by log1p; 1 if all are equal."""
    edges = F.broadcast(df.agg(F.min(F.log1p(reward)).alias("_lo"), F.max(F.log1p(reward)).alias("_hi")))
    return df.join(edges).withColumn(name, 1 - (F.log1p(reward) - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-9))).drop("_lo", "_hi")


def _moments(df: DataFrame, width: int, y) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """arm -> (sum x x', sum x y), x with a leading 1; width is bounded by the feature list."""
    def part(batches):
        sums: dict = {}
        for b in batches:
            for arm, rows in b.groupby("arm"):
                x = np.column_stack([np.ones(len(rows)), np.stack(rows["features"].to_numpy())])
                xx, xy = x.T @ x, x.T @ rows["y"].to_numpy()
                old = sums.get(arm, (0, 0))
                sums[arm] = (old[0] + xx, old[1] + xy)
        import pandas as pd

        if sums:  # an empty frame's lists have no type that Arrow could convert
            yield pd.DataFrame({"arm": list(sums), "xx": [s[0].ravel().tolist() for s in sums.values()], "xy": [s[1].tolist() for s in sums.values()]})

    parts = df.select(F.col("arm").cast("int"), "features", y.alias("y")).mapInPandas(part, "arm int, xx array<double>, xy array<double>")
    long = parts.select("arm", F.posexplode(F.concat("xx", "xy")).alias("i", "v")).groupBy("arm", "i").agg(F.sum("v").alias("v"))
    n, out = width + 1, {}
    flat: dict[int, np.ndarray] = {}
    for r in long.collect():  # (features + 1) * (features + 2) numbers an arm
        flat.setdefault(r.arm, np.zeros(n * n + n))[r.i] = r.v
    for arm, v in flat.items():
        out[arm] = (v[: n * n].reshape(n, n), v[n * n :])
    return out


def _solve(xx: np.ndarray, xy: np.ndarray, ridge: float) -> list[float]:
    return np.linalg.solve(xx + ridge * np.eye(len(xy)), xy).tolist()


def fit(experience: DataFrame, names: list[str], ridge: float = 1e-3, delta_ridge: float = 1.0) -> LatencyModel:
    """Fit on rows (arm, features, reward). Raises TrainingError without any."""
    rows = experience.where("reward is not null and reward >= 0 and features is not null").select("arm", "features", F.log1p("reward").alias("log"))
    edge = rows.agg(F.count(F.lit(1)).alias("n"), F.min("log").alias("lo"), F.max("log").alias("hi")).first()
    if not edge.n:
        raise TrainingError("no experience to train on")
    model = LatencyModel(list(names), edge.lo, edge.hi, samples=edge.n)
    scaled = rows.withColumn("y", (F.col("log") - edge.lo) / max(edge.hi - edge.lo, 1e-9))
    by_arm = _moments(scaled, len(names), F.col("y"))
    model.base = _solve(sum(m[0] for m in by_arm.values()), sum(m[1] for m in by_arm.values()), ridge)
    base = np.array(model.base)
    # The residuals' moments follow from those of y, so the rows are read once.
    model.deltas = {int(a): _solve(xx, xy - xx @ base, delta_ridge) for a, (xx, xy) in by_arm.items()}
    return model
