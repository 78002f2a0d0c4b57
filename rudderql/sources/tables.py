"""Readers: Parquet tables, SQL files, JSON plans, run logs and the Spark catalog."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
PLAN_NODE = "`Node Type` string, `Relation Name` string, `Total Cost` double, `Plan Rows` double"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SCHEMAS: dict[tuple, StructType] = {}


def _schema(spark: SparkSession, path: str) -> StructType:
    """Schema of a Parquet table; its footer is read once for each state of the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    changed = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).getModificationTime()
    if (path, changed) not in _SCHEMAS:
        _SCHEMAS[path, changed] = spark.read.parquet(path).schema
    return _SCHEMAS[path, changed]


def register(spark: SparkSession, sf_dir: str, names: tuple = TABLES[:9]) -> None:
    """Views over the Parquet tables; a query binds to the files when it is analysed."""
    for name in names:
        path = f"{sf_dir}/{name}.parquet"
        spark.read.schema(_schema(spark, path)).parquet(path).createOrReplaceTempView(name)


def register_named(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Views for the tables whose names occur in ``sql``."""
    register(spark, sf_dir, tuple(t for t in TABLES if re.search(rf"\b{t}\b", sql)))


def sql_files(spark: SparkSession, path: str) -> DataFrame:
    """path, sql: a row per file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("sql"))


def json_plans(rows: DataFrame, column: str = "plan") -> DataFrame:
    """The root node of each JSON plan; text that is no JSON gives nulls."""
    parsed = F.from_json(F.col(column), f"Plan struct<{PLAN_NODE.replace(' string', ': string').replace(' double', ': double')}>", {"mode": "PERMISSIVE"})
    return rows.withColumn("p", parsed).select(*rows.columns, F.col("p.Plan.`Node Type`").alias("node_type"), F.col("p.Plan.`Relation Name`").alias("relation"), F.col("p.Plan.`Total Cost`").alias("cost"), F.col("p.Plan.`Plan Rows`").alias("rows"))


PLAN_ROWS = "key string, node_id int, parent_id int, depth int, node_type string, relation string, cost double, rows double"


def json_plan_nodes(plans: DataFrame, key: str, column: str = "plan") -> DataFrame:
    """key, node_id, parent_id, depth, node_type, relation, cost, rows: every node of each JSON plan, numbered in preorder.

    A plan is {"Plan": node} or a node; a node's children are its "Plans".
    Text that is no such JSON, or null, gives no rows.
    """
    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, text in zip(b["key"], b["plan"], strict=True):
                try:
                    top = json.loads(text)
                except (TypeError, ValueError):
                    continue
                top = top.get("Plan", top) if isinstance(top, dict) else None
                stack, count = [(top, -1, 0)], 0
                while stack:
                    node, parent, depth = stack.pop()
                    if not isinstance(node, dict) or "Node Type" not in node:
                        continue
                    out.append((k, count, parent, depth, node["Node Type"], node.get("Relation Name"), node.get("Total Cost"), node.get("Plan Rows")))
                    stack += [(x, count, depth + 1) for x in reversed(node.get("Plans") or [])]
                    count += 1
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PLAN_ROWS.split(", ")]).astype({"cost": "Float64", "rows": "Float64"})

    return plans.select(F.col(key).cast("string").alias("key"), F.col(column).alias("plan")).mapInPandas(nodes, PLAN_ROWS)


def run_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """at, path, seconds of run-log lines: those that begin with a digit or x, split at blanks."""
    f = F.split(F.trim(column), " +")
    return lines.where(F.col(column).rlike("^[0-9x]") & (F.size(f) >= 5)).select(f[2].cast("double").alias("at"), f[3].alias("path"), f[4].cast("double").alias("seconds"))


def catalog_scan(spark: SparkSession, names: tuple | None = None) -> DataFrame:
    """table_name, column_name, data_type, is_numeric of the tables and views in the current catalog."""
    tables = names or [t.name for t in spark.catalog.listTables()]
    rows = [(t, c.name, c.dataType, c.dataType in ("int", "float", "double")) for t in tables for c in spark.catalog.listColumns(t)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, is_numeric boolean")


def key_scan(spark: SparkSession, names: tuple) -> DataFrame:
    """table_name, column_name, is_partition, is_bucket, has_index: what lets a scan skip data by a column.

    Spark has no indexes; columns that a table is partitioned, bucketed or
    sorted in files by stand in for them.
    """
    rows = [(t, c.name, bool(c.isPartition), bool(c.isBucket), bool(c.isPartition or c.isBucket)) for t in names for c in spark.catalog.listColumns(t)]
    return spark.createDataFrame(rows, "table_name string, column_name string, is_partition boolean, is_bucket boolean, has_index boolean")


def cached_relations(spark: SparkSession, names: tuple) -> DataFrame:
    """relation, cached, blocks (in memory or on disk now), bytes; system-like names left out."""
    blocks: dict[str, list] = {}
    for info in spark.sparkContext._jsc.sc().getRDDStorageInfo():
        held = blocks.setdefault(str(info.name()), [0, 0])
        held[0] += info.numCachedPartitions()
        held[1] += info.memSize() + info.diskSize()
    rows = []
    for n in names:
        if not n.startswith(("pg_", "sql_")):
            n_blocks, size = blocks.get(f"In-memory table {n}", (0, 0))
            rows.append((n, bool(spark.catalog.isCached(n)), int(n_blocks), int(size)))
    return spark.createDataFrame(rows, "relation string, cached boolean, blocks int, bytes long")


def order_correlation(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """column_name, correlation between the rank in ``order`` and the value's rank; over 0.9 is flagged, sign kept.

    Ranks are shares of the rows without a null in the column, equal values
    ranking alike; both come from sorts by range partition.
    """
    from ..operators.ranks import percent_ranks

    out = None
    for c in columns:
        rows = df.where(F.col(c).isNotNull()).select(F.col(order).alias("o"), F.col(c).alias("c"))
        ranked = percent_ranks(percent_ranks(rows, "o", "p"), "c", "v")
        one = ranked.agg(F.round(F.corr("p", "v"), 6).alias("correlation")).select(F.lit(c).alias("column_name"), "correlation")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("above_09", F.col("correlation") > 0.9)
