import hashlib
import json
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rudderql import cli
from rudderql.functions import features, policy
from rudderql.functions import policy_columns as columns
from rudderql.operators import analysis, experience, learning, ranks, regression, trees
from rudderql.plans import arms, catalyst
from rudderql.plans.queries import queries
from rudderql.plans.templates import ARM_SQL, FACTS, TEMPLATES
from rudderql.session import QueryTimeout, Steering, SteeringConfig
from rudderql.sources import tables

from .compare import connect, differences


@pytest.fixture(scope="module")
def views(spark, sf):
    tables.register(spark, sf)
    return sf


def test_policy_values():
    assert policy.epsilon(0) == 0.2 and policy.epsilon(4) == 0.1 and policy.epsilon(10**6) == 0.02
    assert policy.impact(None) == 1 and policy.impact(1) == 0.5 and policy.impact(99) == pytest.approx(1 / 6) and policy.impact(-3) == 1
    assert policy.normal_cost(999) == pytest.approx(1)
    assert policy.squash(0) == 0 and 0 < policy.squash(0.2) < policy.squash(2) <= 0.5 and policy.squash(-9) == 0
    assert [policy.group_bucket(n) for n in (0, 1, 2, 3, 9)] == [0, 1, 2, 3, 3]
    assert [policy.rows_bucket(n) for n in (0, 999, 1000, 99_999, 1e5)] == [0, 0, 1, 1, 2]
    assert [policy.count_bucket(n) for n in (0, 1, 2, 3)] == [0, 1, 1, 2]
    assert policy.one_hot(7, 3) == [0, 0, 1] and policy.one_hot(-1, 2) == [1, 0]
    assert [policy.cut_bucket(v, (1, 5)) for v in ([], [0.5], [1], [5, 2], [6])] == [0, 0, 1, 1, 2]
    assert policy.optimistic([5.0, 5.0], {0: 4}, 1.0) == [4.5, 5.0]
    assert sorted(policy.balanced_schedule(12, 4)) == sorted([0, 1, 2, 3] * 3) and policy.balanced_schedule(12, 4) == policy.balanced_schedule(12, 4)


def test_choice():
    c = policy.choose([3.0, 1.0, 2.0, 9.0], {}, rng=random.Random(0))
    assert (c.arm, c.mode) == (1, "exploit") and c.trace["banned"] == [3] and c.trace["unseen"] == [0, 1, 2, 3]
    seen = {0: 5, 1: 1, 2: 5, 3: 5}
    assert policy.choose([3.0, 1.0, 2.0, 9.0], seen, least=0.0, start=0.0).arm == 2  # arm 1 has too few runs
    drawn = {policy.choose([3.0, 1.0, 2.0, 9.0], dict.fromkeys(range(4), 9), start=5.0, least=1.0, rng=random.Random(i)).arm for i in range(60)}
    assert drawn == {0, 1, 2}
    assert policy.choose([1.0], {0: 9}).arm == 0
    assert policy.choose([1.0, 2.0], {}, high_is_good=True).arm == 1
    with pytest.raises(ValueError):
        policy.choose([], {})
    assert policy.cold_start([100, 50, 700], {0: 0, 1: 2}) == 0 and policy.cold_start([100, 50, 700], {}) == 1


def test_arms(spark, views):
    with pytest.raises(ValueError):
        arms.Arm(6)
    assert len(arms.ALLOWED) == 25 and arms.Arm(0).hint_text == "" and arms.Arm(3).config["enable_mergejoin"] is False
    assert arms.aliases(ARM_SQL) == ["u", "q", "a", "t"] and arms.aliases("select 1") == [] and arms.aliases("no query") == []
    odd = "-- select x from y\n/* from z */ select (select max(r_regionkey) from region) m, '-- from w' t from nation a join customer b on a.n_nationkey = b.c_nationkey, orders where exists (select 1 from part)"
    assert arms.aliases(odd) == ["a", "b", "orders"] and arms.aliases("select 1 from x union select 2 from y") == []
    assert arms.uncommented(odd).startswith("select (select max") and "'-- from w'" in arms.uncommented(odd)
    assert arms.with_hint(odd, "MERGE(a)").startswith("select /*+ MERGE(a) */ (select max")
    kinds = {i: set(catalyst.join_strategies(spark, arms.with_hint(ARM_SQL, arms.Arm(i).hints(arms.aliases(ARM_SQL), FACTS)))) for i in (1, 2, 3, 5)}
    assert kinds[1] == {"SortMergeJoinExec"} and kinds[3] == {"ShuffledHashJoinExec"} and "BroadcastHashJoinExec" in kinds[2] and kinds[5] >= {"ShuffledHashJoinExec"}
    before = spark.conf.get("spark.sql.adaptive.enabled")
    with arms.settings(spark, arms.Arm(4).settings):
        assert spark.conf.get("spark.sql.adaptive.enabled") == "false"
    assert spark.conf.get("spark.sql.adaptive.enabled") == before


def test_arms_agree(spark, views):
    want = sorted(map(tuple, spark.sql(TEMPLATES["so_q12"]).collect()))
    for i in arms.ALLOWED:
        sql = arms.with_hint(TEMPLATES["so_q12"], arms.Arm(i).hints(arms.aliases(TEMPLATES["so_q12"]), FACTS))
        assert sorted(map(tuple, spark.sql(sql).collect())) == want


def test_broadcast_is_bounded(spark, sf, tmp_path):
    """join_broadcast broadcasts what is small, but no table that would fill the driver, however small its file is."""
    for t in ("customer", "orders", "part"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    orders, parts = spark.read.parquet(f"{sf}/orders.parquet").count(), spark.read.parquet(f"{sf}/part.parquet").count()
    spark.range(2_000_000).select((F.col("id") % orders).alias("l_orderkey"), (F.col("id") % parts).alias("l_partkey")).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert differences(spark, connect(tmp_path), str(tmp_path), queries()["join_broadcast"], ARM_SQL) is None
    joins = lambda d: str(queries()["join_broadcast"](spark, d)._jdf.queryExecution().sparkPlan())
    assert joins(sf).count("BroadcastHashJoin") == 3 and "SortMergeJoin" not in joins(sf)
    plan = joins(str(tmp_path))
    assert plan.count("BroadcastHashJoin") == 2 and plan.count("SortMergeJoin [o_orderkey") == 1
    tables.register(spark, str(tmp_path), ("customer", "orders", "lineitem", "part"))
    rows = spark.table("customer").agg(F.sum(24 + F.octet_length("c_mktsegment"))).first()[0], orders * 24, 2_000_000 * 24, spark.table("part").where("p_brand = 'Brand#2'").count() * 16
    for limit in rows:
        assert catalyst.small_relations(spark, ARM_SQL, limit) == [a for a, n in zip("uqat", rows, strict=True) if n <= limit]
    tables.register(spark, sf)


def test_pushdown(spark, views):
    text = spark.table("lineitem").where("l_quantity > 45 and l_returnflag in ('R')").select("l_orderkey")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters" in text and "GreaterThan(l_quantity,45.0)" in text and "l_comment" not in text.split("ReadSchema")[1]


def test_roles_and_features(spark, views):
    r = catalyst.Roles(spark, "select u.c_mktsegment, count(*) from customer u, orders q, orders p where q.o_custkey = u.c_custkey and p.o_custkey = u.c_custkey and q.o_totalprice > p.o_totalprice group by u.c_mktsegment order by u.c_mktsegment")
    assert r.tables() == ["customer", "orders"]
    assert {"join", "where"} <= r.roles["orders", "o_totalprice"] and {"group", "sort"} <= r.roles["customer", "c_mktsegment"] and not r.roles["customer", "c_name"]
    assert r.edges == {("customer.c_custkey", "orders.o_custkey")} and r.numeric["orders", "o_totalprice"] and not r.numeric["orders", "o_orderkey"]
    f = features.query_features(spark, TEMPLATES["so_q13"])
    g = features.query_features(spark, TEMPLATES["so_q13"].replace("5 and", "6 and"))
    assert f["template_id"] == g["template_id"] != features.query_features(spark, TEMPLATES["so_q01"])["template_id"]
    anti = features.plan_flags(catalyst.plan_tree(spark, TEMPLATES["so_q09"]))
    semi = features.plan_flags(catalyst.plan_tree(spark, TEMPLATES["so_q10"]))
    assert anti["has_not_exists"] == 1 and semi["has_exists"] == 1 and semi["hot_twice"] == 1
    shares = features.cost_shares(catalyst.plan_tree(spark, TEMPLATES["so_q13"]))
    assert sum(v for k, v in shares.items() if k.startswith("op_")) == pytest.approx(1) and sum(v for k, v in shares.items() if k.startswith("level_")) == pytest.approx(1)
    assert features.feature_matrix(spark, {1: TEMPLATES["so_q01"]}).count() > 50 and features.adjacency(spark, {1: TEMPLATES["so_q01"]}).where("src like '%.%' and dst like '%.%'").count() > 0


def test_sql_cache_and_vectors(spark, tmp_path):
    store = experience.ExperienceStore(spark, f"file://{tmp_path}/store")
    assert store.cached_sql().count() == 0
    rows = lambda *r: spark.createDataFrame(list(r), "sequence_id string, sql_text string")
    store.cache_sql(rows(("a", "select 1"), ("b", "select 2")))
    store.cache_sql(rows(("a", "select 0"), ("a", "select 0")))
    assert {r.sequence_id: r.sql_text for r in store.cached_sql().collect()} == {"a": "select 0", "b": "select 2"} and store.cached_sql().count() == 2
    v = spark.createDataFrame([(1, [1.0, 2.5]), (2, None), (3, [1.0, 2.5]), (4, [])], "i int, v array<float>")
    got = {r.i: r.h for r in v.select("i", features.vector_sha1("v").alias("h")).collect()}
    assert got[1] == got[3] == hashlib.sha1(np.array([1.0, 2.5], dtype="<f4").tobytes()).hexdigest() and got[2] is None and got[4] == hashlib.sha1(b"").hexdigest()


def test_samplers(spark):
    rng = random.Random(1)
    rows = [(i, f"t{i % 7}", i % 6, rng.random() * 100) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, template_id string, arm int, reward double")
    got = experience.sample_budgeted(df, budget=300, cap=30, per_arm=3, hard=0.2).collect()
    worst = {r[0] for r in sorted(rows, key=lambda r: (-r[3], r[0]))[:180]}
    assert len(got) == len({r.id for r in got}) <= 300 and worst <= {r.id for r in got}
    assert len({(r.template_id, r.arm) for r in got}) == 42
    assert experience.sample_budgeted(df, budget=900).count() == 900
    assert experience.balanced_batch(df, 4).groupBy("arm").count().where("count = 4").count() == 6
    parts = experience.welford(df.where("id < 500"), ["arm"], "reward").unionByName(experience.welford(df.where("id >= 500"), ["arm"], "reward"))
    whole = {r.arm: r for r in experience.welford(df, ["arm"], "reward").collect()}
    for r in experience.merge_welford(parts, ["arm"]).collect():
        assert (r.n, r.mean, r.m2) == pytest.approx((whole[r.arm].n, whole[r.arm].mean, whole[r.arm].m2))


def test_sampler_diversity(spark):
    rng = random.Random(3)
    rows = [(i, f"t{i % 5}", i % 3, rng.random(), [rng.random(), rng.random()]) for i in range(300)] + [(999, "far", 0, 0.0, [50.0, -50.0])]
    df = spark.createDataFrame(rows, "id long, template_id string, arm int, reward double, v array<double>")
    plain = {r.id for r in experience.sample_budgeted(df, 60, 20, 1, 0.1).collect()}
    got = {r.id for r in experience.sample_budgeted(df, 60, 20, 1, 0.1, "v", 10).collect()}
    assert len(plain) == 60 and 50 < len(got) <= 60 and 999 in got and len(got & plain) >= 50


def test_ranks(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(40), rng.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "i long, k int, v double").repartition(6)
    place = {r.i: r.position for r in ranks.positions(df, [F.desc("k"), F.asc("i")]).collect()}
    assert place == {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    sums, so_far = {r.i: r.s for r in ranks.running_sums(df, ["v"], "k", "s").collect()}, 0
    for i, k, _ in sorted(rows, key=lambda r: r[2]):
        so_far += k
        assert sums[i] == so_far
    want = {r.i: r.p for r in df.withColumn("p", F.percent_rank().over(W.orderBy("k"))).collect()}
    assert {r.i: r.p for r in ranks.percent_ranks(df, "k", "p").collect()} == pytest.approx(want)
    assert ranks.positions(df.limit(0), ["i"]).count() == 0 and ranks.percent_ranks(df.limit(1), "k", "p").first().p == 0


def test_policy_columns(spark):
    """Columns and plain functions agree."""
    n = [0, 1, 2, 3, 4, 7, 99, 1000, 99_999, 100_000, 10**6]
    df = spark.createDataFrame([(x, float(x) / 10 - 1) for x in n], "n long, v double")
    cols = {"eps": columns.epsilon(F.col("n")), "impact": columns.impact(F.col("v")), "cost": columns.normal_cost(F.col("n")), "squash": columns.squash(F.least("v", F.lit(9.0))), "group": columns.group_bucket(F.col("n")), "rows": columns.rows_bucket(F.col("n")), "count": columns.count_bucket(F.col("n")), "good": columns.optimistic(F.col("v"), F.col("n"), 0.5), "hot": F.array(*columns.one_hot(F.col("n"), 3))}
    for r in df.select("n", "v", *[c.alias(k) for k, c in cols.items()]).collect():
        assert (r.eps, r.impact, r.cost, r.squash) == pytest.approx((policy.epsilon(r.n), policy.impact(r.v), policy.normal_cost(r.n), policy.squash(min(r.v, 9.0))))
        assert (r.group, r.rows, r["count"], r.hot) == (policy.group_bucket(r.n), policy.rows_bucket(r.n), policy.count_bucket(r.n), policy.one_hot(r.n, 3))
        assert r.good == pytest.approx(policy.optimistic([r.v], {0: r.n}, 0.5)[0])
    none = df.limit(1).select(columns.impact(F.lit(None)).alias("a"), columns.optimistic(F.col("v"), F.lit(None), 1.0).alias("b"), "v").first()
    assert none.a == 1 and none.b == none.v


def test_k_centers(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 5))
    v[50:] = v[0]  # copies are never chosen twice
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(60)], "i long, v array<double>")
    got = [r.i for r in experience.k_centers(df, "v", "i", 6).collect()]
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    want = [max(range(60), key=lambda i: (((v[i] - v.mean(0)) ** 2).sum(), -i))]
    while len(want) < 6:
        free = [i for i in range(60) if i not in want and all(cos(v[i], v[j]) <= 0.995 for j in want)]
        want.append(max(free, key=lambda i: (min(((v[i] - v[j]) ** 2).sum() for j in want), -i)))
    assert sorted(got) == sorted(want)
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)], "i long, v array<double>")
    assert experience.k_centers(same, "v", "i", 4).count() == 1 and experience.k_centers(same.limit(0), "v", "i", 2).count() == 0


def test_learning(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i % 3, [float(x := rng.random()), 1 - x], math.expm1(2 + 3 * x + (i % 3) * 0.5)) for i in range(600)]
    df = spark.createDataFrame(rows, "arm int, features array<double>, reward double")
    m = learning.fit(df, ["a", "b"])
    got = m.predict([0.5, 0.5], [0, 1, 2, 7])
    assert got[0] < got[1] < got[2] and got[1] == pytest.approx(math.expm1(4.0), rel=0.1) and got[3] == pytest.approx(got[1], rel=0.1)
    m.save(str(tmp_path / "m.json"), spark)
    assert learning.LatencyModel.load(str(tmp_path / "m.json"), spark).predict([0.5, 0.5], [0, 1, 2, 7]) == got
    x = np.array([[1, *r[1]] for r in rows])
    y = (np.log1p([r[2] for r in rows]) - m.low) / (m.high - m.low)
    base = np.linalg.solve(x.T @ x + 1e-3 * np.eye(3), x.T @ y)
    of = np.array([r[0] for r in rows]) == 1
    delta = np.linalg.solve(x[of].T @ x[of] + np.eye(3), x[of].T @ (y - x @ base)[of])
    assert m.base == pytest.approx(base.tolist()) and m.deltas[1] == pytest.approx(delta.tolist())
    with pytest.raises(learning.TrainingError):
        learning.fit(df.limit(0), ["a", "b"])


def test_learning_empty_partitions(spark):
    """Small files and filters leave tasks without a row; the fit is that of the rows in one task."""
    rows = spark.range(0, 4, 1, 1).select((F.col("id") % 2).cast("int").alias("arm"), F.array(F.col("id") / 4).alias("features"), F.exp("id").alias("reward"))
    one, many = learning.fit(rows, ["a"]), learning.fit(rows.repartitionByRange(4, "arm").unionByName(rows.where("arm > 9").repartition(3)), ["a"])
    assert many.samples == 4 and many.base == pytest.approx(one.base) and many.deltas == {a: pytest.approx(w) for a, w in one.deltas.items()}


def test_regression_gate(spark):
    runs = spark.createDataFrame([("q1", 0, 100.0), ("q1", 1, 50.0), ("q2", 0, 10.0), ("q2", 1, 10.05)], "query_id string, arm int, reward double")
    pick = lambda a, b: spark.createDataFrame([("q1", a), ("q2", b)], "query_id string, arm int")
    assert regression.regressions(runs, pick(0, 1)) == (1, pytest.approx(50.05)) and regression.regressions(runs, pick(1, 1)) == (0, pytest.approx(0.05))
    assert regression.accepts((0, 9.0), None) and not regression.accepts((1, 1.0), None) and regression.accepts((1, 1.0), (1, 2.0)) and not regression.accepts((2, 1.0), (1, 2.0))


def test_logs(spark):
    lines = spark.createDataFrame([("x x 10.0 a/q2/q2-1.sql 1.5 PG 7",), ("0 1 70.0 a/q1/q1-1.sql 2.5 8",), ("training x x x x",), ("0 2 130 a/q2/q2-1.sql 4.0 9",), ("3 short",)], "value string")
    log = tables.run_log(lines)
    assert [(r.done, r.minutes) for r in analysis.completion_curve(log).orderBy("done").collect()] == [(1, 0.0), (2, 1.0), (3, 2.0)]
    table = analysis.regression_table(log, log.where("seconds < 4")).collect()
    assert [(r.path, r.last, r.slower) for r in table] == [("a/q1/q1-1.sql", 2.5, False), ("a/q2/q2-1.sql", 4.0, True)]
    asked = spark.createDataFrame([(5.0,), (70.0,), (999.0,)], "trained_at double")
    assert [r.done for r in analysis.done_before(log, asked).orderBy("trained_at").collect()] == [0, 2, 3]
    assert [r.chunk for r in analysis.chunks(log, 2).orderBy("at").collect()] == [0, 0, 1] and analysis.percentiles(log).first().p50 == 2.5
    assert [r.share for r in analysis.latency_cdf(log).orderBy("seconds").collect()] == [0, 0.5, 1]


def test_sources(spark, tmp_path, views):
    (tmp_path / "a.sql").write_text("select 1\nfrom x")
    r = tables.sql_files(spark, str(tmp_path)).first()
    assert r.sql == "select 1\nfrom x" and r.path.endswith("a.sql")
    plans = spark.createDataFrame([('{"Plan": {"Node Type": "Seq Scan", "Relation Name": "t", "Total Cost": 5.5, "Plan Rows": 9}}',), ("no json",)], "plan string")
    assert [(p.node_type, p.cost) for p in tables.json_plans(plans).collect()] == [("Seq Scan", 5.5), (None, None)]
    assert tables.catalog_scan(spark, ("nation",)).where("is_numeric").count() == 2
    spark.catalog.cacheTable("nation")
    spark.table("nation").count()
    held = {r.relation: r for r in tables.cached_relations(spark, ("nation", "part", "pg_x")).collect()}
    spark.catalog.uncacheTable("nation")
    assert set(held) == {"nation", "part"} and held["nation"].cached and held["nation"].blocks > 0 and held["nation"].bytes > 0 and not held["part"].cached and held["part"].blocks == 0
    spark.table("customer").write.partitionBy("c_mktsegment").bucketBy(2, "c_custkey").mode("overwrite").saveAsTable("keyed_customer")
    keys = {r.column_name: (r.is_partition, r.is_bucket, r.has_index) for r in tables.key_scan(spark, ("keyed_customer",)).collect()}
    spark.sql("drop table keyed_customer")
    assert keys["c_mktsegment"] == (True, False, True) and keys["c_custkey"] == (False, True, True) and keys["c_name"] == (False, False, False)
    nested = '{"Node Type": "Sort", "Plans": [{"Node Type": "Hash", "Plan Rows": 3, "Plans": [{"Node Type": "Seq Scan", "Relation Name": "a"}]}, {"Node Type": "Seq Scan", "Relation Name": "b"}]}'
    plans = spark.createDataFrame([(1, nested), (2, None), (3, "[]"), (4, '{"Plan": 5}'), (5, '{"Plan": %s}' % nested)], "i int, plan string")
    rows = [tuple(r)[1:6] for r in tables.json_plan_nodes(plans, "i").where("key = '5'").orderBy("node_id").collect()]
    assert rows == [(0, -1, 0, "Sort", None), (1, 0, 1, "Hash", None), (2, 1, 2, "Seq Scan", "a"), (3, 0, 1, "Seq Scan", "b")] and tables.json_plan_nodes(plans, "i").count() == 8


def test_trees():
    tree = ((0, 1), ((1, 2), ((0, 1),), ((-1, 0),)), ((-3, 0), ((2, 3),), ((1, 2),)))
    nodes, triples = trees.flatten(tree, lambda v: v if not isinstance(v[0], tuple) else v[0])
    assert nodes.shape == (8, 2) and triples.shape == (7, 3)
    rng = np.random.default_rng(0)
    out = nodes
    for a, b in ((2, 16), (16, 8), (8, 4)):
        out = trees.relu(trees.layer_norm(trees.convolve(out, triples, rng.normal(size=(b, 3 * a)), rng.normal(size=b))))
    assert trees.pool(out).shape == (4,)
    with pytest.raises(trees.TreeError):
        trees.flatten("5", tuple)


def test_session(spark, views, tmp_path):
    s = Steering(spark, f"file://{tmp_path}/store", SteeringConfig(mode="model", num_arms=3, round_size=4))
    assert s.select("update x set y = 1").mode == "native" and s.select("select 1").mode == "native"
    pool = [(k, TEMPLATES[k]) for k in ("so_q01", "so_q13", "so_q06")]
    assert s.select(pool[0][1]).mode == "cold_start"
    key = s.add_test_query(pool[0][1])
    assert s.experiment(120) == 3 and s.experiment(120) == 0
    with pytest.raises(ValueError):
        s.add_test_query("drop table x")
    out = s.replay(pool, k=6)
    assert len(out) == 6 and s.last_error is None and [r[0] for r in out] == [0, 0, 0, 0, 1, 1]
    assert s.retrain() in (True, False)
    s.model = s.model or s.train()
    advice = s.explain(pool[1][1], include_json=True)
    assert len(advice["prediction_ms"]) == 3 and advice["arm"] in (0, 1, 2) and advice["plan"] and s.status()["experience"] == 9
    assert s.store.experience().where(F.col("query_id") == key).count() >= 3 and s.store.arm_stats().count() > 0 and s.store.templates().count() == 3
    s.save(str(tmp_path / "model.json"))
    s.load(str(tmp_path / "model.json"))
    s.record("select broken from nowhere", 0, 1.0)
    assert s.last_error and s.status()["experience"] == 9
    with pytest.raises(ValueError):
        SteeringConfig(num_arms=27)


def test_session_rows_and_timeouts(spark, views, tmp_path):
    s = Steering(spark, f"file://{tmp_path}/store", SteeringConfig(num_arms=26, max_query_seconds=30))
    assert len(s.arms) == 25 and 6 not in s.arms
    sql = "-- a comment\n" + TEMPLATES["so_q13"]
    assert s.eligible(sql) and not s.eligible("select 1")
    want = sorted(map(tuple, spark.sql(sql).collect()))
    assert sorted(map(tuple, s.collect(sql, 7))) == want and sorted(map(tuple, s.save_as(sql, f"file://{tmp_path}/rows").collect())) == want
    assert s.status()["experience"] == 2 and s._runs(s.features(sql)["template_id"]).total() == 2
    again = Steering(spark, f"file://{tmp_path}/store")
    assert again._runs(s.features(sql)["template_id"]) == s._runs(s.features(sql)["template_id"])
    slow = "select count(*) n from lineitem a, lineitem b, lineitem c where a.l_tax + b.l_tax + c.l_tax > 9"
    began = time.monotonic()
    with pytest.raises(QueryTimeout):
        s.run(slow, 0, timeout=2)
    assert time.monotonic() - began < 25 and s.status()["experience"] == 2 and s.collect(sql, 0)
    s.config.max_query_seconds, s.config.num_arms = 2, 1
    key = s.add_test_query(slow)
    assert s.experiment(60) == 1 and [r.reward for r in s.store.experience().where(F.col("query_id") == key).collect()] == [4000.0]
    assert Steering(spark, f"file://{tmp_path}/store").experiments == {key: slow}
    rows = Steering(spark, f"file://{tmp_path}/other", SteeringConfig(mode="cold_start", round_size=2)).compare([("q", TEMPLATES["so_q04"])], k=2, warm_up=1)
    assert len(rows) == 2 and all(p == "q" and a > 0 and b > 0 for p, a, b, _ in rows)


def test_config_and_command_line(spark, sf, tmp_path, capsys):
    c = SteeringConfig.read("[steering]\nmode = cold_start\nnum_arms = 8\nrecord_rewards = no\nhard_ratio = 0.5\nfacts = q, a")
    assert (c.mode, c.num_arms, c.record_rewards, c.hard_ratio, c.facts) == ("cold_start", 8, False, 0.5, ("q", "a"))
    for bad in ("[steering]\nnothing = 1", "[other]\nmode = model", "[steering]\nmode = what", "[steering]\nmax_query_seconds = 0"):
        with pytest.raises(ValueError):
            SteeringConfig.read(bad)
    (tmp_path / "c.ini").write_text("[steering]\nnum_arms = 2\n")
    (tmp_path / "sql").mkdir()
    (tmp_path / "sql/q.sql").write_text(TEMPLATES["so_q15"])

    def call(*args):
        code = cli.main(["--store", f"file://{tmp_path}/store", "--tables", sf, "--config", str(tmp_path / "c.ini"), *args], spark)
        return code, [json.loads(x) for x in capsys.readouterr().out.splitlines()]

    assert call("train")[0] == 1  # nothing to learn from
    assert call("run", "@" + str(tmp_path / "sql/q.sql"))[1] == [r.asDict() for r in spark.sql(TEMPLATES["so_q15"]).collect()]
    assert len(call("add-test-query", TEMPLATES["so_q04"])[1][0]["query_id"]) == 32
    assert call("experiment", "--seconds", "60") == (0, [{"ran": 2}])
    assert len(call("replay", str(tmp_path / "sql"), "--count", "2", "--warm-up", "1")[1]) == 2
    assert call("train")[1][0]["samples"] == 5 and call("status")[1][0]["model_samples"] == 5
    assert call("explain", TEMPLATES["so_q04"])[1][0]["prediction_ms"] and call("retrain")[0] in (0, 1) and "nation" in call("check")[1][0]["tables"]


def test_streaming(spark, tmp_path):
    from rudderql.streaming.rewards import RewardStats, windowed_latency

    rows = [(f"t{i % 3}", i % 2, float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "template_id string, arm int, reward double")
    stats = RewardStats(spark, f"file://{tmp_path}/stats")
    assert stats.add(df.where("reward < 40"), 0) and stats.add(df.where("reward >= 40 and reward < 60"), 1)
    assert not stats.add(df.where("reward >= 40"), 1)  # sent again
    assert stats.add(df.where("reward >= 60 and reward < 80"), 0, "a new checkpoint") and stats.add(df.where("reward >= 80"), 2)
    assert not stats.add(df, 0, "a new checkpoint") and len(stats._versions()) == 2
    want = {(r.template_id, r.arm): r for r in experience.welford(df, ["template_id", "arm"], "reward").collect()}
    got = {(r.template_id, r.arm): r for r in stats.current().collect()}
    assert {k: (r.n, pytest.approx(r.mean), pytest.approx(r.m2)) for k, r in want.items()} == {k: (r.n, r.mean, r.m2) for k, r in got.items()}
    timed = df.withColumn("at", F.timestamp_seconds(F.col("reward") * 600))
    assert windowed_latency(timed).agg(F.sum("n")).first()[0] == 100
