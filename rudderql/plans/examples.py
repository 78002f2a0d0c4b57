"""Two small optimised plans whose features are known, as plan_tree() gives them."""

from __future__ import annotations


def _node(query: int, node: int, parent: int, depth: int, kind: str, relation: str | None, cost: float, rows: float, **more) -> dict:
    return {"query_id": query, "node_id": node, "parent_id": parent, "depth": depth, "node_type": kind, "relation": relation, "cost": cost, "est_rows": rows, "join_type": None, "keys": 0, "equi": True, "columns": {}} | more


NODES = [
    _node(1, 0, -1, 0, "Aggregate", None, 90.0, 5.0, keys=2, columns={"group": [("orders", "o_custkey"), ("customer", "c_name")], "args": [("orders", "o_totalprice")]}),
    _node(1, 1, 0, 1, "Join", None, 80.0, 900.0, join_type="Inner", columns={"left": [("orders", "o_custkey")], "right": [("customer", "c_custkey")]}),
    _node(1, 2, 1, 2, "LogicalRelation", "orders", 30.0, 1500.0, columns={"where": [("orders", "o_totalprice"), ("orders", "o_orderdate")]}),
    _node(1, 3, 1, 2, "Join", None, 40.0, 200000.0, join_type="LeftAnti", equi=False, columns={"left": [("customer", "c_custkey")], "right": [("lineitem", "l_suppkey"), ("lineitem", "l_tax")]}),
    _node(1, 4, 3, 3, "LogicalRelation", "customer", 8.0, 10.0),
    _node(1, 5, 3, 3, "LogicalRelation", "lineitem", 12.0, 1500.0, columns={"where": [("lineitem", "l_tax")]}),
    _node(2, 0, -1, 0, "Sort", None, 20.0, 70.0, columns={"sort": [("part", "p_name"), ("part", "p_size")]}),
    _node(2, 1, 0, 1, "Filter", None, 10.0, 70.0),
    _node(2, 2, 1, 2, "LogicalRelation", "part", 10.0, 99000.0, columns={"where": [("part", "p_name")]}),
]


def plans() -> dict[int, list[dict]]:
    return {q: [n for n in NODES if n["query_id"] == q] for q in sorted({n["query_id"] for n in NODES})}
