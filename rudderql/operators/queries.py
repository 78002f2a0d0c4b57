"""Registered queries of the learning, sampling, log and streaming layers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features
from ..functions import policy_columns as policy
from ..plans.templates import TEMPLATES
from ..sources.shared import new_path
from ..sources.tables import json_plan_nodes, load, register, run_log
from . import analysis, experience, learning, ranks, regression


def _experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as runs: a user is a template, event_id % 6 the arm, value the time."""
    e = load(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("template_id"), (F.col("event_id") % 6).cast("int").alias("arm"), F.col("value").alias("reward"), F.col("event_type").alias("kind"), F.col("ts").alias("at"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp").cast("double")
    return e.select(at.alias("at"), F.concat(F.lit("/q"), F.col("user_id"), F.lit("/"), F.col("event_type"), F.lit(".sql")).alias("path"), F.col("value").alias("seconds"))


def _long_arm(df: DataFrame, *names: str) -> DataFrame:
    """Named columns under other names (old:new), with arm as a long."""
    pairs = [(n.split(":") * 2)[:2] for n in names]
    return df.select(*[(F.col(a).cast("long") if a == "arm" else F.col(a)).alias(b) for a, b in pairs])


def sample_budgeted_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experience.sample_budgeted(_experience(spark, sf_dir), budget=500, cap=10, per_arm=2).drop("at")


def sample_hard_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experience.hard_tail(_experience(spark, sf_dir)).select(F.col("id").alias("event_id"))


def sample_template_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experience.template_cap(_experience(spark, sf_dir), 10).select(F.col("id").alias("event_id"))


def sample_arm_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long_arm(experience.arm_coverage(_experience(spark, sf_dir), 3), "id:event_id", "arm")


def exp_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _experience(spark, sf_dir).withColumn("query_id", F.col("arm"))
    return _long_arm(experience.totals(log), "experience:runs", "templates", "queries:arms")


def exp_template_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experience.templates(_experience(spark, sf_dir)).withColumnRenamed("template_id", "tpl")


def exp_last_by_pid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long_arm(experience.latest(_experience(spark, sf_dir), ["template_id"], [F.desc("id")]), "template_id:pid", "id:event_id")


def exp_balanced_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long_arm(experience.balanced_batch(_experience(spark, sf_dir), 50), "id:event_id", "arm")


def exp_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _experience(spark, sf_dir).select(F.col("template_id").alias("pid"), F.col("kind").alias("event_type"), F.struct("at", "id").alias("at"))
    old, new = log.where("at.id % 3 = 0"), log.where("at.id % 3 <> 0")
    return experience.upsert(old, new, ["pid"], "at").drop("at")


def exp_run_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _experience(spark, sf_dir).withColumnRenamed("template_id", "query_id")
    rows = analysis.runs_by_experiment(log.where("kind = 'signup'"), log)
    return rows.select("query_id", "arm", F.array_join(F.transform("runs", lambda x: x.cast("string")), ",").alias("runs"), "best")


def arm_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long_arm(experience.arm_usage(_experience(spark, sf_dir)), "arm", "uses")


def arm_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long_arm(experience.arm_ranking(_experience(spark, sf_dir)), "template_id:tpl", "arm", "place")


def arm_topk_banned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long_arm(experience.exploration_arms(_experience(spark, sf_dir)), "template_id:tpl", "arm")


def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _experience(spark, sf_dir).groupBy(F.col("template_id").alias("query_id"), "arm").agg(F.max("reward").alias("reward"))
    n, gap = regression.regressions(runs, runs.where("arm = 0").select("query_id", "arm"))
    return spark.createDataFrame([(n, round(gap, 4))], "nreg long, gap double")


def _by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").cast("double").alias("at"), F.col("event_id").alias("path"), F.col("value").alias("seconds"), "event_type")


def latency_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.latency_cdf(_by_event(spark, sf_dir)).select("event_id", F.round("share", 9).alias("p"))


def chunk_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.chunks(_by_event(spark, sf_dir).withColumn("at", F.col("event_id"))).select("event_id", F.col("chunk").cast("long").alias("chunk"))


def completion_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = load(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("path"))
    return analysis.completion_curve(log, 6e7).select("event_id", F.col("done").cast("int").alias("done"), F.round("minutes", 6).alias("mins"))


def trained_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _by_event(spark, sf_dir).withColumn("other", (F.col("event_type") != "error").cast("long"))
    return ranks.running_sums(rows, ["at", "event_id"], "other", "before_n").where("event_type = 'error'").select("event_id", "before_n")


def reward_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = learning.scaled_rewards(_experience(spark, sf_dir))
    return rows.select(F.col("id").alias("event_id"), F.round("scaled", 9).alias("s"))


def policy_epsilon(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _experience(spark, sf_dir).groupBy(F.col("template_id").alias("user_id")).count()
    return n.select("user_id", policy.epsilon(F.col("count")).alias("eps"))


def policy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _experience(spark, sf_dir).select(F.col("id").alias("event_id"), policy.impact(F.col("reward") / 100).alias("gate"))


def policy_optimism(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = experience.arm_ranking(_experience(spark, sf_dir))
    return _long_arm(best.withColumn("score", policy.optimistic(F.col("best"), F.col("runs"), 0.5)), "template_id:tpl", "arm", "score")


def cost_log_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", F.round(policy.normal_cost(F.col("o_totalprice")), 9).alias("c"))


def score_squash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _experience(spark, sf_dir).select(F.col("id").alias("event_id"), F.round(policy.squash(F.col("reward") / 500), 9).alias("s"))


def bucket_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", policy.rows_bucket(F.col("o_totalprice")).alias("b"))


def bucket_groupcols(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    return lines.select("g", policy.group_bucket(F.col("g")).alias("b"), "n")


def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_orderkey").agg(F.count("l_orderkey").alias("n"))
    return per.groupBy("n").agg(F.count(F.lit(1)).alias("orders_n")).select("n", policy.count_bucket(F.col("n")).alias("b"), "orders_n")


def onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return lines.select("l_linenumber", *[c.alias(f"h{i + 1}") for i, c in enumerate(policy.one_hot(F.col("l_linenumber") - 1, 3))], "n")


#: A JSON plan with the events of a user as the rows that its scans are thought to read.
NESTED = '{"Plan": {"Node Type": "Hash Join", "Total Cost": %d.5, "Plan Rows": %d, "Plans": [{"Node Type": "Seq Scan", "Relation Name": "t%d", "Plan Rows": 7}, {"Node Type": "Sort", "Plans": [{"Node Type": "Index Scan", "Relation Name": "u"}]}]}}'


def json_plan_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    plans = users.select("user_id", F.when(F.col("user_id") % 5 == 0, "no plan").otherwise(F.format_string(NESTED, "n", "n", "user_id")).alias("plan"))
    return json_plan_nodes(plans, "user_id").withColumnRenamed("key", "user_id")


def diverse_kcenter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experience.k_centers(load(spark, sf_dir, "embeddings"), "embedding", "vec_id", 6).select("vec_id", "label")


def vector_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are equal as 32-bit floats form a template."""
    rows = load(spark, sf_dir, "embeddings").select("vec_id", features.vector_sha1("embedding").alias("template_id"))
    return rows.groupBy("template_id").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n")).drop("template_id")


def exp_welford_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = experience.welford(_experience(spark, sf_dir), ["template_id", "arm"], "reward")
    return w.select("template_id", "arm", "n", F.round("mean", 6).alias("mean"), F.round("m2", 2).alias("m2"))


def pending_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _experience(spark, sf_dir).withColumnRenamed("template_id", "query_id")
    return experience.pending(e.select("query_id").distinct(), spark.range(6).select(F.col("id").cast("int").alias("arm")), e.where("kind = 'click'").select("query_id", "arm"))


def learned_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit base and arm corrections on the events and predict each event's time."""
    rows = _experience(spark, sf_dir).withColumn("features", F.array(*[(F.col("kind") == k).cast("double") for k in ("view", "signup", "error", "click")], F.log1p(F.col("template_id").cast("double"))))
    model = learning.fit(rows, ["view", "signup", "error", "click", "user"])
    x = F.concat(F.array(F.lit(1.0)), F.col("features"))
    dot = lambda w: F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in w]), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    delta = F.coalesce(*[F.when(F.col("arm") == a, dot(w)) for a, w in sorted(model.deltas.items())], F.lit(0.0))
    scaled = F.greatest(F.lit(-0.5), F.least(F.lit(1.5), dot(model.base) + delta))
    return rows.select("id", "arm", F.greatest(F.lit(0.0), F.expm1(scaled * max(model.high - model.low, 1e-9) + model.low)).alias("predicted_ms"))


def log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    line = F.concat_ws(" ", F.when(F.col("event_type") == "view", "x").otherwise((F.col("event_id") / 25).cast("int").cast("string")), F.lit("x"), F.col("event_id"), F.concat(F.lit("q/"), F.col("event_type"), F.lit(".sql")), F.col("value"), F.lit("sid"))
    lines = e.select(F.when(F.col("event_type") == "error", F.concat(F.lit("training "), line)).otherwise(line).alias("value"))
    return run_log(lines).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last_at"), F.max("seconds").alias("worst"))


def regression_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return analysis.regression_table(log, log.where("seconds > 1")).drop("last")


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analysis.percentiles(_log(spark, sf_dir))
    return rows.select("queries", *[F.round(c, 6).alias(c) for c in rows.columns if c != "queries"])


def trained_before_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return analysis.done_before(log, log.where("path like '%error.sql'").select(F.col("at").alias("trained_at")))


def stream_reward_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of rewards, merged batch by batch."""
    from ..streaming.rewards import RewardStats

    folder = new_path(spark, "rewards")
    schema = load(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rewards = events.select(F.col("user_id").cast("string").alias("template_id"), (F.col("event_id") % 6).cast("int").alias("arm"), F.col("value").alias("reward"))
    stats = RewardStats(spark, f"{folder}/stats")
    stats.start(rewards, f"{folder}/progress").awaitTermination()
    return stats.current().select("template_id", "arm", "n", F.round("mean", 6).alias("mean"), F.round("m2", 2).alias("m2"))


def steered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship template under the arm that cold start picks."""
    from ..session import Steering, SteeringConfig

    register(spark, sf_dir)
    session = Steering(spark, new_path(spark, "experience"), SteeringConfig(mode="cold_start", record_rewards=False))
    return session.frame(TEMPLATES["so_q13"])


WELFORD = "select {key} template_id, cast(event_id % 6 as int) arm, count(*) n, round(avg(value), 6) mean, round(var_pop(value) * count(*), 2) m2 from events group by 1, 2"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        diverse_kcenter, exp_welford_moments, pending_experiments, learned_predictions, log_parse, regression_report, latency_percentiles, trained_before_events, stream_reward_stats, steered,
        sample_hard_tail, sample_template_cap, sample_arm_coverage, exp_counts, exp_template_seen, exp_last_by_pid, exp_balanced_batch, exp_upsert_latest, exp_run_lists,
        arm_usage, arm_rank, arm_topk_banned, regression_gate, latency_cdf, chunk_rounds, completion_curve, trained_before, reward_scale,
        policy_epsilon, policy_gate, policy_optimism, cost_log_norm, score_squash, bucket_rows, bucket_groupcols, bucket_counts, onehot, json_plan_tree, vector_template,
    )
    return {f.__name__: f for f in named} | {"sample_budgeted": sample_budgeted_query}


def _centers(k: int, size: int = 64) -> str:
    """The greedy choice of ``k`` vectors, a step a query: distance to the nearest chosen one, and whether none is nearly the same."""
    gap = lambda x, y: f"list_sum(list_transform(range(1, {size + 1}), lambda i: ({x}[i] - {y}[i]) * ({x}[i] - {y}[i])))"
    dot = lambda x, y: f"list_sum(list_transform(range(1, {size + 1}), lambda i: {x}[i] * {y}[i]))"
    parts = [
        "e as materialized (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) v from embeddings)",
        f"m as (select list(a order by i) v from (select i, avg(v[i]) a from e, range(1, {size + 1}) r(i) group by i))",
        f"c1 as materialized (select e.vec_id, e.label, e.v from e, m order by {gap('e.v', 'm.v')} desc, e.vec_id limit 1)",
    ]
    for j in range(1, k):
        before = "e" if j == 1 else f"s{j - 1}"
        near, free = f"{gap('s.v', 'c.v')}", f"{dot('s.v', 'c.v')} / (sqrt({dot('s.v', 's.v')}) * sqrt({dot('c.v', 'c.v')})) <= 0.995 and s.vec_id <> c.vec_id"
        parts.append(f"s{j} as materialized (select s.vec_id, s.label, s.v, {near if j == 1 else f'least(s.d, {near})'} d, {free if j == 1 else f's.free and {free}'} free from {before} s, c{j} c)")
        parts.append(f"c{j + 1} as materialized (select vec_id, label, v from s{j} where free order by d desc, vec_id limit 1)")
    return f"with {', '.join(parts)} " + " union all ".join(f"select vec_id, label from c{j}" for j in range(1, k + 1))


BUDGETED = """
with e as (select event_id id, user_id template_id, cast(event_id % 6 as int) arm, value reward, event_type kind from events),
r as (select *, row_number() over (order by reward desc, id) p, count(*) over () n, row_number() over (partition by template_id, arm order by reward desc, id) a, row_number() over (partition by template_id order by reward desc, id) t from e),
c as (select *, case when p <= ceil(0.2 * n) then 0 when a <= 2 then 1 when t <= 10 then 2 end tier from r)
select id, template_id, arm, reward, kind from c where tier is not null order by tier, reward desc, id limit 500"""
TREE = """
with u as (select user_id, count(*) n from events group by user_id having user_id % 5 <> 0)
select cast(user_id as varchar) user_id, x.* from u, lateral (values (0, -1, 0, 'Hash Join', null, n + 0.5, cast(n as double)), (1, 0, 1, 'Seq Scan', 't' || user_id, null, 7), (2, 0, 1, 'Sort', null, null, null), (3, 2, 2, 'Index Scan', 'u', null, null)) x(node_id, parent_id, depth, node_type, relation, cost, rows)"""


def oracle_sql() -> dict[str, str]:
    return {
        "exp_welford_moments": WELFORD.format(key="user_id"),
        "stream_reward_stats": WELFORD.format(key="cast(user_id as varchar)"),
        "pending_experiments": "select q.user_id query_id, cast(a.arm as int) arm from (select distinct user_id from events) q cross join range(6) a(arm) where not exists (select * from events e where e.user_id = q.user_id and e.event_id % 6 = a.arm and e.event_type = 'click')",
        "log_parse": "select 'q/' || event_type || '.sql' path, count(*) n, cast(max(event_id) as double) last_at, max(value) worst from events where event_type <> 'error' group by event_type",
        "regression_report": "with m as (select '/q' || user_id || '/' || event_type || '.sql' path, max(value) worst, min(value) best, arg_max(value, ts) last_v, count(*) repeats, min(value) filter (where value > 1) baseline from events group by 1) select path, worst, best, repeats, baseline, last_v > baseline * 1.01 slower from m where baseline is not null",
        "steered": TEMPLATES["so_q13"],
        "latency_percentiles": "select count(*) queries, round(sum(value), 6) total, round(avg(value), 6) mean, round(quantile_cont(value, 0.5), 6) p50, round(quantile_cont(value, 0.9), 6) p90, round(quantile_cont(value, 0.95), 6) p95, round(quantile_cont(value, 0.99), 6) p99, round(max(value), 6) max from events",
        "trained_before_events": "select epoch_us(ts) / 1e6::double trained_at, done from (select ts, event_type, count(*) over (order by ts range between unbounded preceding and current row) done from events) where event_type = 'error'",
        "sample_budgeted": BUDGETED,
        "diverse_kcenter": _centers(6),
        "exp_run_lists": "select user_id query_id, cast(event_id % 6 as int) arm, string_agg(event_id, ',' order by event_id) runs, min(value) best from events where user_id in (select user_id from events where event_type = 'signup') group by 1, 2",
        "json_plan_tree": TREE,
        "vector_template": "select min(vec_id) first_id, count(*) n from embeddings group by embedding",
    }
