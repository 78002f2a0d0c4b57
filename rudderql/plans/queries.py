"""Registered queries of the relational, plan and experience layers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features
from ..sources.tables import catalog_scan, order_correlation, register, register_named
from . import catalyst, examples
from .arms import DEFAULT_ARMS, Arm, aliases, settings, with_hint
from .templates import ALL, ARM_SQL, BOTH, FACTS

SQLS = ALL | {k: spark for k, (spark, _) in BOTH.items()}
HINTS = {"join_hash": "SHUFFLE_HASH", "join_merge": "MERGE", "join_broadcast": "BROADCAST"}
#: The driver and each executor hold a broadcast table whole, as a hash table of two to three times its rows; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20


def _sql(text: str) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_named(spark, sf_dir, text)
        return spark.sql(text)

    return run


def _hinted(hint: str) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_named(spark, sf_dir, ARM_SQL)
        names = aliases(ARM_SQL, spark)
        small = catalyst.small_relations(spark, ARM_SQL, BROADCAST_BYTES) if hint == "BROADCAST" else names
        # Without a hint Spark would go by the size of the files.
        hints = (hint, small), ("MERGE", [a for a in names if a not in small])
        return spark.sql(with_hint(ARM_SQL, ", ".join(f"{h}({', '.join(of)})" for h, of in hints if of)))

    return run


def _arm(index: int) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_named(spark, sf_dir, ARM_SQL)
        arm = Arm(index)
        hinted = {k: v for k, v in arm.settings.items() if k.startswith("spark.sql.auto")}
        with settings(spark, hinted):
            return spark.sql(with_hint(ARM_SQL, arm.hints(aliases(ARM_SQL, spark), FACTS)))

    return run


def join_nl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A theta join of two small tables without an equality: a broadcast nested loop."""
    register(spark, sf_dir, ("region", "nation"))
    return spark.sql("select count(*) n from region r, nation s where s.n_nationkey > r.r_regionkey")


def scan_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns, an IN list and a range, all of which reach the Parquet scan."""
    register(spark, sf_dir, ("lineitem",))
    return spark.table("lineitem").where("l_returnflag in ('R', 'A') and l_quantity > 45").groupBy("l_returnflag").count().withColumnRenamed("count", "n")


def stats_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ("orders",))
    return order_correlation(spark.table("orders"), "o_orderkey", ["o_orderkey", "o_totalprice"])


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    return catalog_scan(spark, ("nation", "customer"))


def sql_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    return catalyst.semantics_rows(spark, catalyst.EXAMPLES)


def sql_join_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    return catalyst.join_edges(spark, catalyst.EXAMPLES)


def ontology_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that the example queries name, with their roles."""
    register(spark, sf_dir)
    return catalyst.ontology_rows(spark, catalyst.EXAMPLES).where("in_sql")


def flags_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    return features.table_flags(catalyst.ontology_rows(spark, catalyst.EXAMPLES).where("in_sql"))


def plan_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators of the example queries' optimised plans, and the columns they work on; sizes depend on the files and are left out."""
    register(spark, sf_dir)
    rows = catalyst.plan_rows(spark, {q: catalyst.EXAMPLES[q] for q in (1, 3, 5)})
    return rows.select("query_id", "node_id", "parent_id", "depth", "node_type", "relation", F.array_join("columns", ",").alias("columns"))


def aggregate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    return catalyst.aggregate_rows(spark, catalyst.EXAMPLES)


def adjacency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    return features.adjacency(spark, {q: catalyst.EXAMPLES[q] for q in (1, 5)})


def _of_examples(names: str, rows: Callable[[int, list[dict]], list[tuple]]) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.createDataFrame([(q, *r) for q, nodes in examples.plans().items() for r in rows(q, nodes)], f"query_id int, {names}")

    return run


def _shares(prefix: str) -> Callable[[int, list[dict]], list[tuple]]:
    return lambda q, nodes: [(k.removeprefix(prefix), v) for k, v in features.cost_shares(nodes).items() if k.startswith(prefix)]


def _attributed(q: int, nodes: list[dict]) -> list[tuple]:
    tables, columns = features.attributed_costs(nodes)
    return [("table", t, v) for t, v in tables.items()] + [("column", f"{t}.{c}", v) for (t, c), v in columns.items()]


def _metric(q: int, nodes: list[dict]) -> list[tuple]:
    shares = {k.removeprefix("table_"): v for k, v in features.cost_shares(nodes).items() if k.startswith("table_")}
    return [(f"{t}.{c}", v) for (t, c), v in features.table_metric(shares, [("orders", "o_custkey"), ("orders", "o_totalprice"), ("customer", "c_name"), ("part", "p_name")]).items()]


EXAMPLE_PLANS = {
    "op_shares": _of_examples("node_type string, share double", _shares("op_")),
    "depth_shares": _of_examples("level_no string, share double", _shares("level_")),
    "plan_shares": _of_examples("relation string, cost_share double", _shares("table_")),
    "op_shape_capped": _of_examples("j int, s int, o int, a int", lambda q, nodes: [tuple(features.shape(nodes)[k] for k in ("JOIN", "SCAN", "SORT", "AGG"))]),
    "plan_max_rows": _of_examples("flag string, value int", lambda q, nodes: list(features.plan_flags(nodes).items())),
    "cost_attribution": _of_examples("kind string, item string, cost double", _attributed),
    "broadcast_metric": _of_examples("item string, metric double", _metric),
}


def hint_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, Arm(i).hint_text, Arm(i).config_json) for i in DEFAULT_ARMS], "arm int, hint string, config string")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {k: _sql(v) for k, v in SQLS.items()}
    out |= {k: _hinted(h) for k, h in HINTS.items()}
    out |= {f"arm_{i}": _arm(i) for i in DEFAULT_ARMS}
    out |= {f.__name__: f for f in (join_nl, scan_pushdown, stats_correlation, sql_semantics, sql_join_edges, ontology_flags, flags_rollup, aggregate_flags, plan_nodes, adjacency_edges, hint_text)}
    return out | EXAMPLE_PLANS | {"catalog_scan": catalog}


#: The example plans again, for SQL: query, kind, relation, depth, cost, rows.
PLAN_VALUES = """(values
  (1, 'Aggregate', null, 0, 90.0, 5.0), (1, 'Join', null, 1, 80.0, 900.0), (1, 'LogicalRelation', 'orders', 2, 30.0, 1500.0),
  (1, 'Join', null, 2, 40.0, 200000.0), (1, 'LogicalRelation', 'customer', 3, 8.0, 10.0), (1, 'LogicalRelation', 'lineitem', 3, 12.0, 1500.0),
  (2, 'Sort', null, 0, 20.0, 70.0), (2, 'Filter', null, 1, 10.0, 70.0), (2, 'LogicalRelation', 'part', 2, 10.0, 99000.0)) p(query_id, node_type, relation, depth, cost, est_rows)"""
#: Query, node, cost that goes to the role's columns, cost that goes to its tables, role, table, column.
SPREAD_VALUES = """(values
  (1, 0, 45.0, 45.0, 'group', 'orders', 'o_custkey'), (1, 0, 45.0, 45.0, 'group', 'customer', 'c_name'), (1, 0, 45.0, 45.0, 'args', 'orders', 'o_totalprice'),
  (1, 1, 16.0, 24.0, 'left', 'orders', 'o_custkey'), (1, 1, 16.0, 24.0, 'right', 'customer', 'c_custkey'),
  (1, 2, 30.0, 30.0, 'where', 'orders', 'o_totalprice'), (1, 2, 30.0, 30.0, 'where', 'orders', 'o_orderdate'),
  (1, 3, 8.0, 12.0, 'left', 'customer', 'c_custkey'), (1, 3, 8.0, 12.0, 'right', 'lineitem', 'l_suppkey'), (1, 3, 8.0, 12.0, 'right', 'lineitem', 'l_tax'),
  (1, 4, 8.0, 8.0, 'where', 'customer', null), (1, 5, 12.0, 12.0, 'where', 'lineitem', 'l_tax'),
  (2, 0, 20.0, 20.0, 'sort', 'part', 'p_name'), (2, 0, 20.0, 20.0, 'sort', 'part', 'p_size'), (2, 2, 10.0, 10.0, 'where', 'part', 'p_name')) s(query_id, node, to_columns, to_tables, role, tbl, col)"""
#: Columns that the example queries name (4 and 5 all of a table, by a star): query, table, column, where, join, group, sort, numeric.
ONTOLOGY_VALUES = """(values
  (1, 'customer', 'c_nationkey', true, true, false, false, true), (1, 'nation', 'n_name', true, false, false, false, false), (1, 'nation', 'n_nationkey', true, true, false, false, true),
  (2, 'customer', 'c_name', true, false, false, false, false),
  (3, 'customer', 'c_custkey', true, true, false, false, false), (3, 'customer', 'c_mktsegment', false, false, true, false, false), (3, 'orders', 'o_custkey', true, true, false, false, false), (3, 'orders', 'o_totalprice', true, false, false, false, true),
  (4, 'orders', 'o_custkey', false, false, false, false, false), (4, 'orders', 'o_orderkey', false, false, false, false, false), (4, 'orders', 'o_orderpriority', false, false, false, false, false),
  (4, 'orders', 'o_orderdate', false, false, false, false, false), (4, 'orders', 'o_orderstatus', true, false, false, false, false), (4, 'orders', 'o_totalprice', true, false, false, false, true),
  (5, 'lineitem', 'l_discount', false, false, false, false, true), (5, 'lineitem', 'l_extendedprice', false, false, false, false, true), (5, 'lineitem', 'l_linenumber', false, false, false, false, true), (5, 'lineitem', 'l_linestatus', false, false, false, false, false), (5, 'lineitem', 'l_partkey', false, false, false, false, false),
  (5, 'lineitem', 'l_quantity', false, false, false, false, true), (5, 'lineitem', 'l_returnflag', false, false, false, false, false), (5, 'lineitem', 'l_shipdate', false, false, false, false, false), (5, 'lineitem', 'l_suppkey', false, false, false, false, false), (5, 'lineitem', 'l_tax', false, false, false, false, true),
  (5, 'lineitem', 'l_orderkey', true, true, false, false, false), (5, 'orders', 'o_orderkey', true, true, false, false, false),
  (6, 'orders', 'o_custkey', false, false, true, false, false), (6, 'orders', 'o_totalprice', false, false, false, false, true),
  (7, 'orders', 'o_custkey', false, false, false, false, false), (7, 'orders', 'o_orderdate', false, false, false, false, false), (7, 'orders', 'o_orderkey', false, false, false, false, false),
  (8, 'lineitem', 'l_orderkey', true, true, false, false, false), (8, 'lineitem', 'l_shipdate', true, true, false, false, false), (8, 'orders', 'o_orderdate', true, true, false, false, false), (8, 'orders', 'o_orderkey', true, true, false, false, false)) o(query_id, table_name, column_name, in_where, in_join, in_group, in_sort, is_numeric)"""
HINT_VALUES = """(values
  (0, '', '{"enable_hashjoin": true, "enable_mergejoin": true, "enable_nestloop": true, "enable_indexscan": true, "enable_seqscan": true, "enable_indexonlyscan": true, "index": 0}'),
  (1, 'SET enable_nestloop TO off;', '{"enable_hashjoin": true, "enable_mergejoin": true, "enable_nestloop": false, "enable_indexscan": true, "enable_seqscan": true, "enable_indexonlyscan": true, "index": 1}'),
  (2, 'SET enable_mergejoin TO off; SET enable_indexscan TO off;', '{"enable_hashjoin": true, "enable_mergejoin": false, "enable_nestloop": true, "enable_indexscan": false, "enable_seqscan": true, "enable_indexonlyscan": true, "index": 2}'),
  (3, 'SET enable_mergejoin TO off; SET enable_nestloop TO off; SET enable_indexscan TO off;', '{"enable_hashjoin": true, "enable_mergejoin": false, "enable_nestloop": false, "enable_indexscan": false, "enable_seqscan": true, "enable_indexonlyscan": true, "index": 3}'),
  (4, 'SET enable_hashjoin TO off;', '{"enable_hashjoin": false, "enable_mergejoin": true, "enable_nestloop": true, "enable_indexscan": true, "enable_seqscan": true, "enable_indexonlyscan": true, "index": 4}'),
  (5, 'SET enable_mergejoin TO off;', '{"enable_hashjoin": true, "enable_mergejoin": false, "enable_nestloop": true, "enable_indexscan": true, "enable_seqscan": true, "enable_indexonlyscan": true, "index": 5}')) t(arm, hint, config)"""
PLAN_NODE_VALUES = """(values
  (1, 0, -1, 0, 'Aggregate', null, ''), (1, 1, 0, 1, 'Project', null, ''), (1, 2, 1, 2, 'Join', null, 'left nation.n_nationkey,right customer.c_nationkey'),
  (1, 3, 2, 3, 'Project', null, ''), (1, 4, 3, 4, 'Filter', null, ''), (1, 5, 4, 5, 'LogicalRelation', 'nation', 'where nation.n_name,where nation.n_nationkey'),
  (1, 6, 2, 3, 'Project', null, ''), (1, 7, 6, 4, 'Filter', null, ''), (1, 8, 7, 5, 'LogicalRelation', 'customer', 'where customer.c_nationkey'),
  (3, 0, -1, 0, 'GlobalLimit', null, ''), (3, 1, 0, 1, 'LocalLimit', null, ''), (3, 2, 1, 2, 'Sort', null, ''), (3, 3, 2, 3, 'Aggregate', null, 'args customer.c_custkey,group customer.c_mktsegment'),
  (3, 4, 3, 4, 'Project', null, ''), (3, 5, 4, 5, 'Join', null, 'left customer.c_custkey,right orders.o_custkey'),
  (3, 6, 5, 6, 'Project', null, ''), (3, 7, 6, 7, 'Filter', null, ''), (3, 8, 7, 8, 'LogicalRelation', 'customer', 'where customer.c_custkey'),
  (3, 9, 5, 6, 'Project', null, ''), (3, 10, 9, 7, 'Filter', null, ''), (3, 11, 10, 8, 'LogicalRelation', 'orders', 'where orders.o_custkey,where orders.o_totalprice'),
  (5, 0, -1, 0, 'Join', null, 'left orders.o_orderkey,right lineitem.l_orderkey'), (5, 1, 0, 1, 'Project', null, ''), (5, 2, 1, 2, 'LogicalRelation', 'orders', ''), (5, 3, 0, 1, 'Project', null, ''), (5, 4, 3, 2, 'LogicalRelation', 'lineitem', '')) n(query_id, node_id, parent_id, depth, node_type, relation, columns)"""
EXAMPLE_SQL = {
    "op_shares": f"select query_id, node_type, sum(cost) / any_value(total) share from (select *, sum(cost) over (partition by query_id) total from {PLAN_VALUES}) group by query_id, node_type",
    "depth_shares": f"select query_id, cast(least(depth, 3) as varchar) level_no, sum(cost) / any_value(total) share from (select *, sum(cost) over (partition by query_id) total from {PLAN_VALUES}) group by 1, 2",
    "plan_shares": f"select query_id, relation, sum(cost) / any_value(total) cost_share from (select *, sum(cost) over (partition by query_id) total from {PLAN_VALUES}) where relation is not null group by 1, 2",
    "op_shape_capped": f"select query_id, cast(count(*) filter (where node_type = 'Join') as int) j, cast(count(*) filter (where node_type = 'LogicalRelation') as int) s, cast(count(*) filter (where node_type = 'Sort') as int) o, cast(count(*) filter (where node_type = 'Aggregate') as int) a from {PLAN_VALUES} group by query_id",
    "plan_max_rows": "select * from (values (1, 'has_distinct', 1), (1, 'has_exists', 0), (1, 'has_not_exists', 1), (1, 'has_non_equi_pred', 1), (1, 'need_sort_for_merge', 0), (1, 'hot_present', 1), (1, 'hot_twice', 0), (1, 'group_by_cols_bucket', 2), (1, 'rows_bucket', 2), (2, 'has_distinct', 0), (2, 'has_exists', 0), (2, 'has_not_exists', 0), (2, 'has_non_equi_pred', 0), (2, 'need_sort_for_merge', 1), (2, 'hot_present', 0), (2, 'hot_twice', 0), (2, 'group_by_cols_bucket', 0), (2, 'rows_bucket', 1)) t(query_id, flag, value)",
    "cost_attribution": f"with s as (select *, count(col) over (partition by query_id, node, role) n_cols, role in ('group', 'args', 'sort') by_column from {SPREAD_VALUES}), t as (select query_id, tbl, sum(to_tables / n_cols) v from s where by_column group by query_id, tbl union all select query_id, tbl, sum(v / k) from (select query_id, tbl, any_value(to_tables) v, any_value(k) k from (select *, (select count(distinct x.tbl) from s x where x.query_id = s.query_id and x.node = s.node and x.role = s.role) k from s where not by_column) group by query_id, node, role, tbl) group by query_id, tbl) select query_id, 'table' kind, tbl item, cast(sum(v) as double) cost from t group by query_id, tbl union all select query_id, 'column', tbl || '.' || col, cast(sum(to_columns / n_cols) as double) from s where col is not null group by query_id, tbl, col",
    "broadcast_metric": f"with t as (select query_id, relation, sum(cost) / any_value(total) m from (select *, sum(cost) over (partition by query_id) total from {PLAN_VALUES}) where relation is not null group by 1, 2) select cast(q as int) query_id, tbl || '.' || col item, coalesce(m, 0) metric from range(1, 3) r(q), (values ('orders', 'o_custkey'), ('orders', 'o_totalprice'), ('customer', 'c_name'), ('part', 'p_name')) c(tbl, col) left join t on t.query_id = q and t.relation = tbl",
    "ontology_flags": f"select query_id, table_name, column_name, true in_sql, in_where, in_join, in_group, in_sort, is_numeric from {ONTOLOGY_VALUES}",
    "flags_rollup": f"select query_id, table_name, true in_sql, bool_or(in_where) in_where, bool_or(in_join) in_join, bool_or(in_group) in_group, bool_or(in_sort) in_sort, bool_or(is_numeric) is_numeric from {ONTOLOGY_VALUES} group by 1, 2",
    "aggregate_flags": "select * from (values (1, 'has_count_star', '*'), (3, 'has_count', 'customer.c_custkey'), (4, 'has_max', 'orders.o_totalprice'), (4, 'has_min', 'orders.o_orderdate'), (6, 'has_sum', 'orders.o_totalprice'), (8, 'has_count_star', '*')) t(query_id, flag, column_name)",
    "plan_nodes": f"select * from {PLAN_NODE_VALUES}",
    "adjacency_edges": "with c as (select query_id, table_name t, column_name c from (values (1, 'nation'), (1, 'customer'), (5, 'orders'), (5, 'lineitem')) q(query_id, tbl) join information_schema.columns on table_name = tbl) select query_id, t src, t || '.' || c dst from c union all select x.query_id, x.t || '.' || x.c, y.t || '.' || y.c from c x join c y on x.query_id = y.query_id and x.t = y.t and x.c < y.c union all select * from (values (1, 'customer.c_nationkey', 'nation.n_nationkey'), (5, 'lineitem.l_orderkey', 'orders.o_orderkey'))",
    "stats_correlation": "select column_name, round(corr(p, v), 6) correlation, round(corr(p, v), 6) > 0.9 above_09 from (select 'o_orderkey' column_name, percent_rank() over (order by o_orderkey) p, percent_rank() over (order by o_orderkey) v from orders union all select 'o_totalprice', percent_rank() over (order by o_orderkey), percent_rank() over (order by o_totalprice) from orders where o_totalprice is not null) group by column_name",
    "hint_text": f"select * from {HINT_VALUES}",
}


def oracle_sql() -> dict[str, str]:
    text = lambda rows: ", ".join("(" + ", ".join("null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'" for v in r) + ")" for r in rows)
    out = ALL | {k: duck for k, (_, duck) in BOTH.items()} | EXAMPLE_SQL
    out |= dict.fromkeys([*HINTS, *(f"arm_{i}" for i in DEFAULT_ARMS)], ARM_SQL)
    out["join_nl"] = "select count(*) n from region r, nation s where s.n_nationkey > r.r_regionkey"
    out["scan_pushdown"] = "select l_returnflag, count(*) n from lineitem where l_returnflag in ('R', 'A') and l_quantity > 45 group by l_returnflag"
    out["sql_semantics"] = f"select * from (values {text(catalyst.EXPECTED_SEMANTICS)}) t(query_id, feature, value)"
    out["sql_join_edges"] = f"select * from (values {text(catalyst.EXPECTED_EDGES)}) t(query_id, left_column, right_column)"
    out["catalog_scan"] = "select table_name, column_name, case data_type when 'INTEGER' then 'int' when 'BIGINT' then 'bigint' when 'VARCHAR' then 'string' else 'double' end data_type, data_type in ('INTEGER', 'FLOAT', 'DOUBLE') is_numeric from information_schema.columns where table_name in ('nation', 'customer')"
    return out
