"""The workload's query templates over the star schema, and single-operator queries.

site = nation, user = customer, question = orders, answer and comment =
lineitem, tag = part, badge = events, link = orders of the same customer.
Each entry is SQL that Spark runs as it stands; ``DUCK`` has the text for the
few that the oracle engine spells differently.
"""

from __future__ import annotations

STAR = "nation s, customer u, orders q, lineitem a, part t"
KEYS = "u.c_nationkey = s.n_nationkey and q.o_custkey = u.c_custkey and a.l_orderkey = q.o_orderkey and a.l_partkey = t.p_partkey"

TEMPLATES = {
    "so_q01": f"select count(*) n from {STAR} where s.n_name = 'NATION_7' and t.p_brand = 'Brand#2' and {KEYS}",
    "so_q02": "select distinct u.c_name from customer u, orders q1, lineitem a, part t1, orders q2, lineitem b, part t2 where t1.p_brand = 'Brand#2' and a.l_partkey = t1.p_partkey and q1.o_orderkey = a.l_orderkey and t2.p_brand = 'Brand#4' and b.l_partkey = t2.p_partkey and q2.o_orderkey = b.l_orderkey and q1.o_custkey = u.c_custkey and q2.o_custkey = u.c_custkey",
    "so_q03": "select count(distinct u.c_name) n from customer u, orders q1, lineitem a, supplier p, orders q2 where a.l_orderkey = q1.o_orderkey and a.l_suppkey = p.s_suppkey and p.s_nationkey = u.c_nationkey and q1.o_orderpriority = '1-URGENT' and q2.o_orderpriority = '5-LOW' and q2.o_custkey = u.c_custkey and q1.o_custkey = u.c_custkey",
    "so_q04": "select count(distinct u.c_name) n from customer u, orders q, lineitem a, part t where t.p_type = 'ECONOMY' and a.l_partkey = t.p_partkey and a.l_orderkey = q.o_orderkey and q.o_custkey = u.c_custkey and a.l_shipdate >= q.o_orderdate + interval '1' year",
    "so_q05": "select count(distinct u.c_name) n from customer u, orders q, lineitem c, part t where t.p_brand in ('Brand#2', 'Brand#4') and c.l_partkey = t.p_partkey and c.l_orderkey = q.o_orderkey and q.o_custkey = u.c_custkey and q.o_totalprice > 100000 and c.l_quantity < 20",
    "so_q06": "select count(distinct u.c_name) n from customer u, orders q, lineitem c where c.l_orderkey = q.o_orderkey and q.o_custkey = u.c_custkey and c.l_extendedprice > q.o_totalprice and u.c_mktsegment in ('HOUSEHOLD', 'MACHINERY')",
    "so_q07": "select count(distinct u.c_custkey) n from customer u, events b1, events b2 where b1.user_id = u.c_custkey and b2.user_id = u.c_custkey and b1.event_type = 'signup' and b2.event_type = 'purchase' and b2.ts > b1.ts + interval '28' day and u.c_name <> ''",
    "so_q08": "select count(distinct q1.o_orderkey) n from orders q1, orders q2, lineitem c1, lineitem c2 where q1.o_custkey = q2.o_custkey and q1.o_orderkey < q2.o_orderkey and c1.l_orderkey = q1.o_orderkey and c2.l_orderkey = q2.o_orderkey and c1.l_partkey = c2.l_partkey and c1.l_shipdate < c2.l_shipdate",
    "so_q09": "select count(distinct u.c_custkey) n from customer u, orders q, nation s where not exists (select * from lineitem a where a.l_orderkey = q.o_orderkey) and q.o_orderdate > cast('1998-01-01' as date) and u.c_custkey = q.o_custkey and s.n_nationkey = u.c_nationkey and u.c_acctbal > 67",
    "so_q10": "select count(distinct q1.o_orderkey) n from orders q1, orders q2, orders q3 where q1.o_custkey = q2.o_custkey and q2.o_custkey = q3.o_custkey and q1.o_orderkey < q2.o_orderkey and q2.o_orderkey < q3.o_orderkey and q1.o_totalprice > q3.o_totalprice and exists (select * from lineitem l where l.l_orderkey = q1.o_orderkey and l.l_returnflag = 'R') and exists (select * from lineitem l where l.l_orderkey = q2.o_orderkey) and exists (select * from lineitem l where l.l_orderkey = q3.o_orderkey)",
    "so_q11": f"select count(*) n from {STAR} where s.n_name in ('NATION_7', 'NATION_2') and t.p_brand in ('Brand#1', 'Brand#3') and q.o_totalprice >= 1000 and q.o_totalprice <= 250000 and {KEYS}",
    "so_q12": f"select t.p_brand, count(*) n from {STAR} where s.n_name in ('NATION_7', 'NATION_2') and q.o_totalprice >= 1000 and q.o_totalprice <= 200000 and u.c_acctbal >= 0 and u.c_acctbal <= 9000 and {KEYS} group by t.p_brand",
    "so_q13": f"select u.c_mktsegment, s.n_name, count(*) n from {STAR} where a.l_quantity >= 5 and a.l_quantity <= 30 and {KEYS} group by u.c_mktsegment, s.n_name order by n desc, u.c_mktsegment, s.n_name limit 100",
    "so_q14": f"select count(*) n from {STAR} where t.p_name ilike '%bolt%' and u.c_acctbal >= 0 and u.c_acctbal <= 8000 and {KEYS}",
    "so_q15": "select t.p_type, count(*) n from part t, lineitem a where t.p_partkey = a.l_partkey and t.p_name ilike '%BOLT' group by t.p_type order by n desc, t.p_type limit 100",
    "so_q16": f"select count(*) n from {STAR} where u.c_name ilike '%7' and q.o_totalprice >= 500 and q.o_totalprice <= 300000 and {KEYS}",
}

ARM_SQL = "select u.c_mktsegment, count(*) n from customer u, orders q, lineitem a, part t where q.o_custkey = u.c_custkey and a.l_orderkey = q.o_orderkey and a.l_partkey = t.p_partkey and t.p_brand = 'Brand#2' group by u.c_mktsegment"
FACTS = ["q", "a", "q1", "q2", "q3", "b", "c", "c1", "c2"]

OPERATORS = {
    "proj_alias": "select min(c_name) as first_name, max(c_acctbal) as top_balance from customer",
    "pred_eq": "select count(*) n from part where p_brand = 'Brand#2'",
    "pred_ne": "select count(*) n from customer where c_name <> ''",
    "pred_one_sided": "select count(*) n from orders where o_totalprice > 100000",
    "pred_range": "select count(*) n from lineitem where l_quantity >= 5 and l_quantity <= 30",
    "pred_range_rev": "select count(*) n from lineitem where 25 < l_quantity",
    "pred_in": "select count(*) n from part where p_brand in ('Brand#2', 'Brand#4', 'Brand#9')",
    "pred_in_coerced": "select count(*) n from nation where n_regionkey in ('1', '3')",
    "pred_like_prefix": "select count(*) n from part where p_name like 'b%'",
    "pred_like_inner": "select count(*) n from part where p_name like '%o%t%'",
    "pred_ilike": "select count(*) n from pages where url ilike '%com/%'",
    "pred_isnull_or": "select count(*) n from customer left join orders on c_custkey = o_custkey where o_orderstatus in ('F') or o_orderstatus is null",
    "pred_notnull": "select count(*) n from documents where text is not null and lang is not null",
    "pred_or_likes": "select count(*) n from part where p_name like 'b%' or p_name like '%t'",
    "pred_column_pair": "select count(*) n from orders, lineitem where l_orderkey = o_orderkey and l_extendedprice > o_totalprice",
    "proj_cast_date": "select cast(o_orderdate as date) d, count(*) n from orders group by cast(o_orderdate as date)",
    "proj_interval": "select count(*) n from lineitem, orders where l_orderkey = o_orderkey and l_shipdate > o_orderdate + interval '7' month",
    "join_theta": "select count(*) n from orders q, lineitem l where q.o_orderkey = l.l_orderkey and l.l_shipdate > q.o_orderdate",
    "join_composite": "select count(*) n from lineitem x, lineitem y where x.l_orderkey = y.l_orderkey and x.l_partkey = y.l_partkey and x.l_linenumber < y.l_linenumber",
    "join_self": "select count(*) n from nation x, nation y where x.n_regionkey = y.n_regionkey and x.n_nationkey < y.n_nationkey",
    "join_cycle": "select count(*) n from customer u, orders q, lineitem a, supplier p where q.o_custkey = u.c_custkey and a.l_orderkey = q.o_orderkey and a.l_suppkey = p.s_suppkey and p.s_nationkey = u.c_nationkey",
    "join_semi": "select count(*) n from orders q where exists (select * from lineitem l where l.l_orderkey = q.o_orderkey and l.l_returnflag = 'R')",
    "join_anti": "select count(*) n from orders q where not exists (select * from lineitem l where l.l_orderkey = q.o_orderkey)",
    "join_cross_anti_pending": "select t.tpl, a.arm from (select distinct user_id tpl from events) t cross join (select distinct event_id % 6 arm from events) a left join (select distinct user_id tpl, event_id % 6 arm from events where event_type = 'click') d on d.tpl = t.tpl and d.arm = a.arm where d.tpl is null",
    "join_experiment_runs": "select e.user_id tpl, e.event_id % 6 arm, max(e.value) slowest from events e join (select distinct user_id from events where event_type = 'signup') q on q.user_id = e.user_id join customer c on c.c_custkey = e.user_id group by e.user_id, e.event_id % 6",
    "agg_count": "select count(*) n from lineitem",
    "agg_count_distinct": "select count(distinct l_partkey) n from lineitem",
    "agg_min_text": "select min(c_name) a, min(s_name) b from customer, supplier where c_nationkey = s_nationkey and c_acctbal < 0",
    "agg_group_nullable": "select case when c_acctbal < 0 then null else c_mktsegment end seg, count(*) n from customer group by case when c_acctbal < 0 then null else c_mktsegment end",
    "agg_distinct": "select distinct c_mktsegment from customer",
    "top_100": "select o_custkey, count(*) n from orders group by o_custkey order by n desc, o_custkey limit 100",
    "top_latest_20": "select event_id from events order by event_id desc limit 20",
    "bag_union_emphasis": "select arm, count(*) n from (select event_id % 6 arm from events union all select event_id % 6 arm from events where event_type = 'error') x group by arm",
    "exp_counts": "select count(*) runs, count(distinct user_id) templates, count(distinct event_id % 6) arms from events",
    "exp_welford": "select user_id tpl, event_id % 6 arm, count(*) n, cast(sum(cast(value as decimal(18,2))) as double) sv, cast(sum(cast(cast(value as decimal(9,2)) * cast(value as decimal(9,2)) as decimal(20,4))) as double) s2 from events group by user_id, event_id % 6",
    "exp_template_seen": "select user_id tpl, count(*) sample_count, min(ts) first_seen, max(ts) last_seen from events group by user_id",
    "exp_last_by_pid": "select user_id pid, event_id from (select user_id, event_id, row_number() over (partition by user_id order by event_id desc) rk from events) x where rk = 1",
    "exp_balanced_batch": "select event_id, arm from (select event_id, event_id % 6 arm, row_number() over (partition by event_id % 6 order by event_id desc) rk from events) x where rk <= 50",
    "exp_upsert_latest": "select pid, event_type from (select user_id pid, event_type, row_number() over (partition by user_id order by ts desc, event_id desc) rk from events) x where rk = 1",
    "exp_consecutive": "select tpl, arm, runs from (select user_id tpl, event_id % 6 arm, count(*) runs from events group by user_id, event_id % 6) x",
    "sample_hard_tail": "select event_id from (select event_id, row_number() over (order by value desc, event_id) rk, count(*) over () n from events) x where rk <= ceil(0.2 * n)",
    "sample_template_cap": "select event_id from (select event_id, row_number() over (partition by user_id order by value desc, event_id) rk from events) x where rk <= 10",
    "sample_arm_coverage": "select event_id, arm from (select event_id, event_id % 6 arm, row_number() over (partition by user_id, event_id % 6 order by value desc, event_id) rk from events) x where rk <= 3",
    "arm_rank": "select tpl, arm, row_number() over (partition by tpl order by m, arm) place from (select user_id tpl, event_id % 6 arm, min(value) m from events group by user_id, event_id % 6) x",
    "arm_topk_banned": "select tpl, arm from (select tpl, arm, runs, row_number() over (partition by tpl order by m, arm) place, count(*) over (partition by tpl) arms from (select user_id tpl, event_id % 6 arm, min(value) m, count(*) runs from events group by user_id, event_id % 6) x) y where place <= 3 and runs >= 2 and place < arms",
    "arm_usage": "select event_id % 6 arm, count(*) uses from events group by event_id % 6",
    "regression_gate": "select cast(sum(case when v0 > best * 1.01 then 1 else 0 end) as bigint) nreg, round(sum(v0 - best), 4) gap from (select user_id, min(m) best, max(case when arm = 0 then m end) v0 from (select user_id, event_id % 6 arm, max(value) m from events group by user_id, event_id % 6) a group by user_id) b",
    "latency_cdf": "select event_id, round(percent_rank() over (order by value, event_id), 9) p from events",
    "query_best_worst": "select user_id q, max(value) worst, min(value) best, max(event_id) last_run, count(*) repeats from events group by user_id",
    "max_repeats": "select max(n) repeats from (select user_id, count(*) n from events group by user_id) x",
    "chunk_rounds": "select event_id, cast(floor((row_number() over (order by event_id) - 1) / 25) as bigint) chunk from events",
    "bucket_rows": "select o_orderkey, case when o_totalprice < 1000 then 0 when o_totalprice < 100000 then 1 else 2 end b from orders",
    "bucket_groupcols": "select l_linenumber g, case when l_linenumber < 3 then l_linenumber else 3 end b, count(*) n from lineitem group by l_linenumber",
    "bucket_counts": "select n, case when n = 0 then 0 when n <= 2 then 1 else 2 end b, count(*) orders_n from (select o_orderkey, count(l_orderkey) n from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey) x group by n",
    "onehot": "select l_linenumber, case when l_linenumber <= 1 then 1 else 0 end h1, case when l_linenumber = 2 then 1 else 0 end h2, case when l_linenumber >= 3 then 1 else 0 end h3, count(*) n from lineitem group by l_linenumber",
}

#: Oracle text where the spelling differs.
DUCK: dict[str, str] = {}

#: What each engine calls its own way: (Spark, oracle).
BOTH = {
    "pred_regex_guarded_cast": ("select count(*) n from events where get_json_object(props, '$.k') rlike '^(?:[1-9][0-9]*|0)?(?:[.][0-9]+)?$' and try_cast(get_json_object(props, '$.k') as double) <= 50", "select count(*) n from events where regexp_matches(json_extract_string(props, '$.k'), '^(?:[1-9][0-9]*|0)?(?:[.][0-9]+)?$') and try_cast(json_extract_string(props, '$.k') as double) <= 50"),
    "json_plan_source": ("select j.k k, count(*) n from (select from_json(props, 'k int') j from events) x group by j.k", "select cast(json_extract_string(props, '$.k') as int) k, count(*) n from events group by 1"),
    "split_qualified": ("select distinct split('customer.' || c_mktsegment, '[.]', 2)[0] t, split('customer.' || c_mktsegment, '[.]', 2)[1] c from customer", "select distinct 'customer' t, c_mktsegment c from customer"),
    "prefix_filter": ("select count(*) n from part where not startswith(p_name, 'pg_') and not startswith(p_name, 'sql_')", "select count(*) n from part where not starts_with(p_name, 'pg_') and not starts_with(p_name, 'sql_')"),
    "template_id": ("select user_id, sha1(concat_ws('|', user_id, event_type)) template_id, count(*) n from events group by user_id, event_type", "select user_id, sha1(concat_ws('|', user_id, event_type)) template_id, count(*) n from events group by user_id, event_type"),
    "policy_epsilon": ("select user_id, greatest(0.2 / sqrt(greatest(1, count(*))), 0.02) eps from events group by user_id", "select user_id, greatest(cast(0.2 as double) / sqrt(greatest(1, count(*))), cast(0.02 as double)) eps from events group by user_id"),
    "policy_gate": ("select event_id, 1 / (1 + least(greatest(value / 100, 0D), 5D)) gate from events", "select event_id, 1 / (1 + least(greatest(value / 100, 0::double), 5::double)) gate from events"),
    "policy_optimism": ("select tpl, arm, m - 0.5D / sqrt(n) score from (select user_id tpl, event_id % 6 arm, min(value) m, count(*) n from events group by 1, 2) x", "select tpl, arm, m - 0.5::double / sqrt(n) score from (select user_id tpl, event_id % 6 arm, min(value) m, count(*) n from events group by 1, 2) x"),
    "cost_log_norm": ("select o_orderkey, round(log10(1 + o_totalprice) / 3, 9) c from orders", "select o_orderkey, round(log10(1 + o_totalprice) / 3, 9) c from orders"),
    "score_squash": ("select event_id, round(least(greatest(1 / (1 + exp(-6 * (ln(1 + exp(value / 500 / 0.5D)) - ln(2D)))) - 0.5D, 0D), 1D), 9) s from events", "select event_id, round(least(greatest(1 / (1 + exp(-6 * (ln(1 + exp(value / 500 / 0.5::double)) - ln(2::double)))) - 0.5::double, 0), 1), 9) s from events"),
    "reward_scale": ("select event_id, round(1 - (ln(1 + value) - lo) / (hi - lo), 9) s from (select event_id, value, min(ln(1 + value)) over () lo, max(ln(1 + value)) over () hi from events) x", "select event_id, round(1 - (ln(1 + value) - lo) / (hi - lo), 9) s from (select event_id, value, min(ln(1 + value)) over () lo, max(ln(1 + value)) over () hi from events) x"),
    "reward_inverse": ("select event_id, round(expm1(log1p(value)), 6) v from events", "select event_id, round(exp(ln(1 + value)) - 1, 6) v from events"),
    "safe_division": ("select l_orderkey, l_linenumber, round(l_tax / (l_discount + 1e-9), 6) r from lineitem", "select l_orderkey, l_linenumber, round(l_tax / (l_discount + 1e-9::double), 6) r from lineitem"),
    "natural_sort": ("select p_name, cast(nullif(regexp_extract(p_brand, '#([0-9]+)', 1), '') as int) k, count(*) n from part group by 1, 2 order by k, p_name", "select p_name, cast(nullif(regexp_extract(p_brand, '#([0-9]+)', 1), '') as int) k, count(*) n from part group by 1, 2 order by k, p_name"),
    "completion_curve": ("select event_id, row_number() over (order by ts, event_id) done, round((unix_micros(ts_z) - min(unix_micros(ts_z)) over ()) / 6e7, 6) mins from (select event_id, ts, cast(ts as timestamp) ts_z from events) x", "select event_id, row_number() over (order by ts, event_id) done, round((epoch_us(ts) - min(epoch_us(ts)) over ()) / 6e7::double, 6) mins from events"),
    "trained_before": ("select event_id, before_n from (select event_id, event_type, count(case when event_type <> 'error' then 1 end) over (order by ts, event_id rows between unbounded preceding and current row) before_n from events) x where event_type = 'error'",) * 2,
    "array_difference": ("select user_id, size(array_except(sequence(0, 5), collect_set(cast(event_id % 6 as int)))) unseen from events group by user_id", "select user_id, cast(6 - count(distinct event_id % 6) as int) unseen from events group by user_id"),
    "cosine_to_first": ("select vec_id, round(case when nx < 1e-8 or ny < 1e-8 then 0 else d / (nx * ny) end, 6) c from (select x.vec_id, aggregate(zip_with(x.embedding, y.embedding, (p, q) -> double(p) * double(q)), 0D, (s, v) -> s + v) d, sqrt(aggregate(x.embedding, 0D, (s, v) -> s + double(v) * double(v))) nx, sqrt(aggregate(y.embedding, 0D, (s, v) -> s + double(v) * double(v))) ny from embeddings x join (select label, min(vec_id) vec_id from embeddings group by label) f on f.label = x.label join embeddings y on y.vec_id = f.vec_id) z", "select x.vec_id, round(list_cosine_similarity(x.embedding::double[], y.embedding::double[]), 6) c from embeddings x join (select label, min(vec_id) vec_id from embeddings group by label) f on f.label = x.label join embeddings y on y.vec_id = f.vec_id"),
}

ALL = TEMPLATES | OPERATORS
