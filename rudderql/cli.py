"""Steering from the command line: python -m rudderql.cli --store DIR --tables DIR [--config FILE] command ..."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .operators.learning import TrainingError
from .session import Steering, SteeringConfig
from .sources.shared import SharedFolder
from .sources.tables import TABLES, register, sql_files


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rudderql", description=__doc__)
    p.add_argument("--store", required=True, help="folder of the experience, the experiments and the model")
    p.add_argument("--tables", help="folder with NAME.parquet for each table")
    p.add_argument("--config", help="INI file with a section [steering]")
    c = p.add_subparsers(dest="command", required=True)
    c.add_parser("status", help="what the store holds")
    c.add_parser("train", help="fit a model and put it into use, whatever the gate says")
    c.add_parser("retrain", help="fit a model and use it if it makes no known query slower")
    c.add_parser("check", help="whether tables and store can be read")
    for name, what in (("run", "run a query and print its rows"), ("explain", "predictions and the recommended arm"), ("add-test-query", "register a query for experiments")):
        c.add_parser(name, help=what).add_argument("sql", help="the query, or @FILE")
    c.add_parser("experiment", help="run test queries under arms not tried yet").add_argument("--seconds", type=float, default=60.0)
    replay = c.add_parser("replay", help="run queries drawn from a folder of SQL files")
    replay.add_argument("folder")
    replay.add_argument("--count", type=int, default=200)
    replay.add_argument("--warm-up", type=int, default=25)
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Print one JSON value a line; 0 if the command did what it says."""
    a = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("rudderql").getOrCreate()
    text = lambda path: "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    if a.tables:
        register(spark, a.tables, tuple(t for t in TABLES if SharedFolder(spark, a.tables).there(f"{t}.parquet")))
    s = Steering(spark, a.store, SteeringConfig.read(text(a.config)) if a.config else None)
    model = f"{a.store.rstrip('/')}/model"
    if SharedFolder(spark, a.store).there("model"):
        s.load(model)
    say = lambda x: print(json.dumps(x, default=str))
    sql = (text(a.sql[1:]) if a.sql.startswith("@") else a.sql) if hasattr(a, "sql") else ""
    try:
        if a.command == "status":
            say(s.status())
        elif a.command == "check":
            say({"tables": sorted(t.name for t in spark.catalog.listTables()), "experience": s.status()["experience"]})
        elif a.command == "train":
            s.model = s.train()
            s.save(model)
            say({"samples": s.model.samples})
        elif a.command == "retrain":
            accepted = s.retrain()
            if accepted:
                s.save(model)
            say({"accepted": accepted})
            return int(not accepted)
        elif a.command == "run":
            for row in s.collect(sql):
                say(row.asDict(recursive=True))
        elif a.command == "explain":
            say(s.explain(sql))
        elif a.command == "add-test-query":
            say({"query_id": s.add_test_query(sql)})
        elif a.command == "experiment":
            say({"ran": s.experiment(a.seconds)})
        elif a.command == "replay":
            files = [(r.path, r.sql) for r in sql_files(spark, a.folder).orderBy("path").collect()]
            for row in s.replay(files, a.count, warm_up=a.warm_up):
                say(row)
    except (TrainingError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    finally:
        s.store.flush()
    return 0


if __name__ == "__main__":
    sys.exit(main())
