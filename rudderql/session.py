"""Steering: plan a query under several arms, choose one, run it, learn from its time."""

from __future__ import annotations

import configparser
import json
import os
import random
import threading
import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, fields
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.features import query_features
from .functions.policy import Choice, choose, cold_start, normal_cost
from .operators import learning, regression
from .operators.experience import ExperienceStore, pending, sample_budgeted
from .plans.arms import ALLOWED, Arm, aliases, settings, uncommented, with_hint
from .plans.catalyst import join_strategies, plan_tree
from .plans.templates import FACTS


@dataclass
class SteeringConfig:
    """What is switched on, and the defaults of selection and training."""

    enabled: bool = True
    mode: str = "model"  # 'native': Spark's own plan; 'cold_start': least-used of the cheapest; 'model'
    record_rewards: bool = True
    num_arms: int = 6
    round_size: int = 25
    budget: int = 1000
    template_cap: int = 100
    arm_min: int = 5
    hard_ratio: float = 0.2
    diverse: int = 20
    max_query_seconds: float = 120.0
    least_samples: int = 20
    max_retries: int = 3
    seed: int = 42
    facts: tuple = tuple(FACTS)

    def __post_init__(self):
        if self.mode not in ("native", "cold_start", "model"):
            raise ValueError(f"no mode {self.mode!r}")
        if not 1 <= self.num_arms <= max(ALLOWED) + 1:
            raise ValueError(f"num_arms is 1 to {max(ALLOWED) + 1}")
        if self.max_query_seconds <= 0:
            raise ValueError("max_query_seconds must be positive")

    @classmethod
    def read(cls, text: str, section: str = "steering") -> SteeringConfig:
        """From the text of an INI file; options that are not there keep their defaults, unknown ones are an error."""
        ini = configparser.ConfigParser()
        ini.read_string(text)
        if section not in ini:
            raise ValueError(f"no section [{section}]")
        known, out = {f.name: f for f in fields(cls)}, {}
        for key in ini[section]:
            if key not in known:
                raise ValueError(f"no option {key!r}")
            kind = type(known[key].default)
            out[key] = ini[section].getboolean(key) if kind is bool else tuple(x.strip() for x in ini[section][key].split(",")) if kind is tuple else kind(ini[section][key])
        return cls(**out)


class QueryTimeout(RuntimeError):
    """The query was cancelled because its time was up."""


class Run(NamedTuple):
    choice: Choice
    ms: float
    result: Any = None


def _noop(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


class Steering:
    """Selection, execution, feedback and retraining over one experience store.

    Any failure to describe a query or to predict falls back to Spark's own
    plan; a reward that cannot be stored is dropped with the reason kept in
    ``last_error``.
    """

    def __init__(self, spark: SparkSession, store: str, config: SteeringConfig | None = None):
        self.spark, self.config = spark, config or SteeringConfig()
        self.store, self.folder = ExperienceStore(spark, store), store
        self.model: learning.LatencyModel | None = None
        self.uses: dict[int, int] = {}
        self._seen: dict[str, Counter] = {}  # template -> arm -> runs: read from the log once a template, then kept in step
        self.last_error: str | None = None
        self._random = random.Random(self.config.seed)
        self._features: dict[str, dict] = {}
        self.experiments: dict[str, str] = self.store.experiments()

    @property
    def arms(self) -> list[int]:
        """The arms with an index below num_arms."""
        return [a for a in sorted(ALLOWED) if a < self.config.num_arms]

    def hinted(self, sql: str, arm: int) -> str:
        return with_hint(sql, Arm(arm).hints(aliases(sql, self.spark), self.config.facts))

    def eligible(self, sql: str) -> bool:
        """A SELECT over named relations only; comments before it do not matter."""
        names = aliases(sql, self.spark) if uncommented(sql).lower().startswith("select") else []
        return bool(names) and all(a.isidentifier() for a in names)

    def features(self, sql: str) -> dict:
        if sql not in self._features:
            self._features[sql] = query_features(self.spark, sql)
        return self._features[sql]

    def plan_costs(self, sql: str) -> list[float]:
        """Cost of each arm's plan: logged sizes of its operators, sorting joins counted twice."""
        base = sum(n["cost"] for n in plan_tree(self.spark, sql))
        out = []
        for a in self.arms:
            with settings(self.spark, Arm(a).settings):
                joins = join_strategies(self.spark, self.hinted(sql, a))
            out.append(base + sum({"BroadcastHashJoinExec": 5.0, "ShuffledHashJoinExec": 12.0, "SortMergeJoinExec": 16.0}.get(j, 400.0) for j in joins))
        return out

    def predict(self, sql: str) -> list[float] | None:
        return self.model.predict(list(self.features(sql)["numbers"].values()), self.arms) if self.model else None

    def select(self, sql: str) -> Choice:
        if not self.config.enabled or self.config.mode == "native" or not self.eligible(sql):
            return Choice(0, "native")
        try:
            if self.config.mode == "cold_start" or self.model is None:
                return Choice(cold_start(self.plan_costs(sql), self.uses), "cold_start")
            f = self.features(sql)
            runs, arms = self._runs(f["template_id"]), self.arms
            choice = choose(self.predict(sql), {i: runs[a] for i, a in enumerate(arms) if runs[a]}, sum(runs.values()), cost=normal_cost(f["cost"]), rng=self._random)
            return Choice(arms[choice.arm], choice.mode, choice.trace)  # scores go by place, and arm 6 has none
        except Exception as e:  # noqa: BLE001  selection must never stop a query
            self.last_error = str(e)
            return Choice(0, "fallback")

    def frame(self, sql: str, arm: int | None = None) -> DataFrame:
        """The query under an arm (the chosen one if none is given), analysed but not run."""
        return self.spark.sql(self.hinted(sql, self.select(sql).arm if arm is None else arm))

    def _runs(self, template: str) -> Counter:
        if template not in self._seen:
            counts = self.store.experience().where(F.col("template_id") == template).groupBy("arm").count().collect()  # an arm a row
            self._seen[template] = Counter({r.arm: r["count"] for r in counts})
        return self._seen[template]

    def run(self, sql: str, arm: int | None = None, query_id: str | None = None, sink: Callable[[DataFrame], Any] = _noop, timeout: float | None = None) -> Run:
        """Run a query once, record its time, and return the choice, the milliseconds and what ``sink`` made of the rows.

        ``sink`` gets the query's DataFrame and must use it up; without one
        the rows are computed and dropped. After ``timeout`` seconds (default
        max_query_seconds) the query is cancelled and QueryTimeout raised.
        """
        choice = self.select(sql) if arm is None else Choice(arm, "given")
        limit, context, job = timeout or self.config.max_query_seconds, self.spark.sparkContext, f"steered-{uuid.uuid4().hex}"
        late = threading.Event()

        def stop() -> None:
            late.set()
            context.cancelJobGroup(job)

        timer = threading.Timer(limit, stop)
        with settings(self.spark, Arm(choice.arm).settings):
            df = self.frame(sql, choice.arm)
            context.setJobGroup(job, "steered query", interruptOnCancel=True)
            timer.start()
            began = time.perf_counter()
            try:
                result = sink(df)
            except Exception as e:
                if late.is_set():
                    raise QueryTimeout(f"stopped after {limit} s") from e
                raise
            finally:
                ms = (time.perf_counter() - began) * 1000
                timer.cancel()
                context.setLocalProperty("spark.jobGroup.id", None)
        self.uses[choice.arm] = self.uses.get(choice.arm, 0) + 1
        if self.config.record_rewards:
            self.record(sql, choice.arm, ms, query_id)
        return Run(choice, ms, result)

    def collect(self, sql: str, arm: int | None = None) -> list:
        """The rows of a query that is run once, timed and recorded; for results that fit the driver."""
        return self.run(sql, arm, sink=DataFrame.collect).result

    def save_as(self, sql: str, path: str, arm: int | None = None) -> DataFrame:
        """Run a query once into Parquet files, timed and recorded, and return what reads them."""
        self.run(sql, arm, sink=lambda df: df.write.mode("overwrite").parquet(path))
        return self.spark.read.parquet(path)

    def record(self, sql: str, arm: int, reward: float, query_id: str | None = None) -> None:
        try:
            f = self.features(sql)
            plan = json.dumps({"Plan": {"Node Type": plan_tree(self.spark, sql)[0]["node_type"], "Total Cost": f["cost"]}})
            runs = self._runs(f["template_id"])
            self.store.record(id=time.time_ns(), pid=os.getpid(), query_id=query_id or uuid.uuid5(uuid.NAMESPACE_OID, sql).hex, template_id=f["template_id"], arm=arm, plan=plan, features=[float(x) for x in f["numbers"].values()], reward=float(reward))
            runs[arm] += 1
        except Exception as e:  # noqa: BLE001  a lost reward must not fail a query that ran
            self.last_error = str(e)

    def explain(self, sql: str, include_json: bool = False) -> dict:
        """Predictions, the recommended arm with its switches, and optionally the plan."""
        choice = self.select(sql)
        out = {"arm": choice.arm, "mode": choice.mode, "hint": Arm(choice.arm).hint_text, "joins": join_strategies(self.spark, self.hinted(sql, choice.arm)), "prediction_ms": self.predict(sql)}
        return out | ({"plan": plan_tree(self.spark, sql)} if include_json else {})

    def add_test_query(self, sql: str) -> str:
        """Register a query for experiments: it must be a SELECT that can be planned."""
        if not self.eligible(sql):
            raise ValueError("only a SELECT over named relations can be an experiment")
        self.spark.sql(sql)
        key = uuid.uuid5(uuid.NAMESPACE_OID, sql).hex
        if key not in self.experiments:
            self.store.add_experiment(key, sql)
        self.experiments[key] = sql
        return key

    def experiment(self, seconds: float = 60.0) -> int:
        """Run (experiment, arm) pairs that were not run yet until time is up; how many ran.

        A run that takes max_query_seconds is cancelled and recorded with
        twice that time; one that only the end of ``seconds`` stops is not.
        """
        if not self.experiments:
            return 0
        asked = self.spark.createDataFrame([(k,) for k in self.experiments], "query_id string")
        arms = self.spark.createDataFrame([(a,) for a in self.arms], "arm int")
        todo = pending(asked, arms, self.store.experience().select("query_id", "arm")).orderBy("query_id", "arm").collect()
        end, n = time.monotonic() + seconds, 0
        for r in todo:
            left = end - time.monotonic()
            if left <= 0:
                break
            try:
                self.run(self.experiments[r.query_id], r.arm, r.query_id, timeout=min(left, self.config.max_query_seconds))
            except QueryTimeout:
                if left < self.config.max_query_seconds:
                    break
                self.record(self.experiments[r.query_id], r.arm, 2000 * self.config.max_query_seconds, r.query_id)
            n += 1
        return n

    def _gaps(self, model: learning.LatencyModel | None) -> tuple[int, float] | None:
        if model is None or not self.experiments:
            return None
        picks = []
        for k, sql in self.experiments.items():
            ms = model.predict(list(self.features(sql)["numbers"].values()), self.arms)
            picks.append((k, self.arms[min(range(len(ms)), key=ms.__getitem__)]))
        return regression.regressions(self.store.experience(), self.spark.createDataFrame(picks, "query_id string, arm int"))

    def train(self, emphasis: int = 0) -> learning.LatencyModel:
        """Fit on a budgeted sample; experiments count ``emphasis`` more times."""
        c, rows = self.config, self.store.experience().where("features is not null")
        sample = sample_budgeted(rows, c.budget, c.template_cap, c.arm_min, c.hard_ratio, "features", c.diverse)
        for _ in range(emphasis):
            sample = sample.unionByName(rows.where(F.col("query_id").isin(list(self.experiments))))
        names = list(next(iter(self._features.values()))["numbers"]) if self._features else [str(i) for i in range(len(rows.select("features").first().features))] if not rows.isEmpty() else []
        return learning.fit(sample, names)

    def retrain(self) -> bool:
        """Train and swap if the gate accepts; a few more emphasised attempts if not."""
        old = self._gaps(self.model)
        for attempt in range(self.config.max_retries + 1):
            model = self.train(emphasis=attempt)
            new = self._gaps(model)
            if new is None or regression.accepts(new, old):
                self.model = model
                return True
        return False

    def save(self, path: str) -> None:
        """To any folder that Spark can write."""
        self.model.save(path, self.spark)

    def load(self, path: str) -> None:
        self.model = learning.LatencyModel.load(path, self.spark)

    def status(self) -> dict:
        return self.store.status() | {"model_samples": self.model.samples if self.model else 0, "experiments": len(self.experiments)}

    def replay(self, sqls: Iterable[tuple[str, str]], k: int = 200, retrain: bool = True, warm_up: int = 0) -> list[tuple]:
        """Draw ``k`` of the (path, sql) with the seed, run them in rounds, retrain between: rows (round, path, at, ms, arm).

        The first ``warm_up`` runs use Spark's own plan and make up round -1.
        A query that is cancelled counts twice max_query_seconds.
        """
        pool, out = list(sqls), []
        drawn = random.Random(self.config.seed).choices(pool, k=k)
        for i, (path, sql) in enumerate(drawn):
            after = i - warm_up
            if retrain and after >= 0 and i and after % self.config.round_size == 0:
                self.retrain()
            choice = Choice(0, "native") if after < 0 else self.select(sql)
            try:
                ms = self.run(sql, choice.arm).ms
            except QueryTimeout:
                ms = 2000 * self.config.max_query_seconds
                self.record(sql, choice.arm, ms)
            out.append((after // self.config.round_size if after >= 0 else -1, path, time.time(), ms, choice.arm))
        return out

    def compare(self, sqls: Iterable[tuple[str, str]], k: int = 200, warm_up: int = 0) -> list[tuple]:
        """The same draw under Spark's own plans and steered, one after the other: rows (path, native ms, steered ms, arm)."""
        pool, mode = list(sqls), self.config.mode
        steered = self.replay(pool, k, warm_up=warm_up)
        self.config.mode = "native"
        try:
            native = self.replay(pool, k, retrain=False, warm_up=warm_up)
        finally:
            self.config.mode = mode
        return [(s[1], n[3], s[3], s[4]) for s, n in zip(steered, native, strict=True)]
