"""H: feedback analytics over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import rules
from larder.functions.common import rnd
from larder.operators import feedback as fb
from larder.plans.registry import Tables, query
from larder.plans.retrieval_queries import CENT, DIV, _TOPK, centroids, corpus, diversity
from larder.operators import retrieval as ret
from larder.plans.sqltext import in_list, q, sql_case, sql_round

_G = lambda c: sql_case(f"upper(trim(coalesce({c}, '')))", rules.GRADES, "1")
BASE_I = "SELECT *, ts AS impression_timestamp, CASE WHEN feedback_type IS NOT NULL THEN ts + INTERVAL 5 MINUTE END AS feedback_timestamp FROM interactions"


def rows(t: Tables):
    later = F.when(F.col("feedback_type").isNotNull(), F.col("ts") + F.expr("INTERVAL 5 MINUTE"))
    return t.interactions.withColumns({"impression_timestamp": F.col("ts"), "feedback_timestamp": later})


HIST = f"SELECT session_id, user_id, recipe_id, event_id, position, impression_timestamp FROM ({BASE_I})"
# Some feedback arrives without its session, and some of it twice.
FEED = f"SELECT CASE WHEN event_id % 10 = 3 THEN NULL ELSE session_id END AS session_id, user_id, recipe_id, feedback_type, CAST(position AS INT) AS rating, feedback_timestamp FROM (SELECT *, unnest(CASE WHEN event_id % 4 = 1 THEN [1, 2] ELSE [1] END) AS copy FROM ({BASE_I}) WHERE feedback_type IS NOT NULL)"


def history(t: Tables):
    return rows(t).select("session_id", "user_id", "recipe_id", "event_id", "position", "impression_timestamp")


def feedback(t: Tables):
    r = rows(t).where("feedback_type IS NOT NULL").withColumn("copy", F.explode(F.expr("sequence(1, IF(event_id % 4 = 1, 2, 1))")))
    return r.select(F.when(F.col("event_id") % 10 == 3, None).otherwise(F.col("session_id")).alias("session_id"), "user_id", "recipe_id", "feedback_type", F.col("position").alias("rating"), "feedback_timestamp")


TIED = f"""SELECT * FROM ({FEED}) WHERE session_id IS NOT NULL UNION ALL SELECT s AS session_id, user_id, recipe_id, feedback_type, rating, feedback_timestamp FROM (
  SELECT f.fid, f.user_id, f.recipe_id, f.feedback_type, f.rating, f.feedback_timestamp, max_by(h.session_id, (h.impression_timestamp, h.session_id)) AS s FROM (SELECT *, row_number() OVER () AS fid FROM ({FEED})) f JOIN ({HIST}) h ON f.user_id = h.user_id AND f.recipe_id = h.recipe_id AND h.impression_timestamp <= f.feedback_timestamp
  WHERE f.session_id IS NULL GROUP BY ALL)"""
EXPORT = f"SELECT h.session_id, h.user_id, h.recipe_id, h.event_id, h.position, h.impression_timestamp, f.feedback_type, f.rating, {_G('f.feedback_type')} AS relevance_label FROM ({HIST}) h LEFT JOIN ({TIED}) f ON h.session_id = f.session_id AND h.user_id = f.user_id AND h.recipe_id = f.recipe_id"


def export(t: Tables):
    return fb.export_interactions(history(t), feedback(t)).drop("feedback_timestamp")


@query("H01_export_interactions", f"SELECT session_id, user_id, recipe_id, event_id, position, feedback_type, CAST(rating AS DOUBLE) AS rating, relevance_label FROM ({EXPORT})")
def h01(t: Tables):
    return export(t).drop("impression_timestamp").withColumn("rating", F.col("rating").cast("double"))


@query("H02_relevance_grade", f"SELECT feedback_type, {_G('feedback_type')} AS label, count(*) AS n FROM interactions GROUP BY ALL")
def h02(t: Tables):
    return t.interactions.groupBy("feedback_type").agg(F.count(F.lit(1)).alias("n")).withColumn("label", fb.grade("feedback_type"))


RESOLVED = f"""SELECT *, {_G('ft')} AS relevance_label FROM (SELECT *, row_number() OVER (PARTITION BY session_id, recipe_id ORDER BY {sql_case('ft', {a: i for i, a in enumerate(rules.PRECEDENCE)}, '99')}, impression_timestamp, event_id) AS rn
  FROM (SELECT *, upper(coalesce(feedback_type, 'IMPRESSION')) AS ft FROM ({BASE_I}))) WHERE rn = 1"""


def resolved(t: Tables):
    return fb.resolve_conflicts(rows(t), ["impression_timestamp", "event_id"])


@query("H03_resolve_conflicts", f"SELECT session_id, recipe_id, event_id, ft AS feedback_type, relevance_label FROM ({RESOLVED})")
def h03(t: Tables):
    return resolved(t).select("session_id", "recipe_id", "event_id", "feedback_type", "relevance_label")


_PARTS = "CASE WHEN rn <= CAST(floor(n * 0.7) AS BIGINT) THEN 'train' WHEN rn <= CAST(floor(n * 0.85) AS BIGINT) THEN 'val' ELSE 'test' END"
SPLIT = f"SELECT i.*, s.split FROM ({BASE_I}) i JOIN (SELECT session_id, {_PARTS} AS split FROM (SELECT session_id, row_number() OVER (ORDER BY st, session_id) AS rn, count(*) OVER () AS n FROM (SELECT session_id, min(ts) AS st FROM interactions GROUP BY 1))) s ON i.session_id = s.session_id"


@query("H04_session_split", f"SELECT session_id, event_id, split FROM ({SPLIT})")
def h04(t: Tables):
    return fb.split_by_session(rows(t)).select("session_id", "event_id", "split")


ROWSPLIT = f"SELECT *, {_PARTS} AS split FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n FROM ({BASE_I}))"
_LEAK = lambda src: f"""SELECT (SELECT CAST(coalesce(sum(a * b + a * c + b * c), 0) AS BIGINT) FROM (SELECT session_id, max(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS a, max(CASE WHEN split = 'val' THEN 1 ELSE 0 END) AS b, max(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS c FROM ({src}) GROUP BY 1)) AS session_overlap,
  CAST((mt > mv) AS INT) + CAST((mt > ms) AS INT) AS future_in_train FROM (SELECT max(CASE WHEN split = 'train' THEN ts END) AS mt, min(CASE WHEN split = 'val' THEN ts END) AS mv, min(CASE WHEN split = 'test' THEN ts END) AS ms FROM ({src}))"""  # noqa: E731


@query("H05_leakage_check", " UNION ALL ".join(f"SELECT '{n}' AS kind, *, session_overlap = 0 AND future_in_train = 0 AS passed FROM ({_LEAK(s)})" for n, s in (("session", SPLIT), ("row", ROWSPLIT))))
def h05(t: Tables):
    parts = {"session": fb.split_by_session(rows(t)), "row": fb.split_by_row(rows(t), ["ts", "event_id"])}
    a, b = [fb.leakage_report(df).withColumn("kind", F.lit(k)) for k, df in parts.items()]
    return a.unionByName(b)


@query("H06_row_split", f"SELECT event_id, split FROM ({ROWSPLIT})")
def h06(t: Tables):
    return fb.split_by_row(rows(t), ["ts", "event_id"]).select("event_id", "split")


@query("H07_sufficiency", f"""SELECT *, CASE WHEN total_interactions < 200 OR unique_users < 20 OR unique_recipes < 50 OR unique_queries < 30 OR positive_labels < 40 OR negative_labels < 10 OR days_of_data < 7 THEN 'INSUFFICIENT_DATA' ELSE 'SUFFICIENT' END AS status FROM (
  SELECT count(*) AS total_interactions, count(DISTINCT user_id) AS unique_users, count(DISTINCT recipe_id) AS unique_recipes, count(DISTINCT session_id) AS unique_queries, count(*) FILTER (upper(feedback_type) IN ('COOKED', 'SAVE', 'LIKE')) AS positive_labels,
  count(*) FILTER (upper(feedback_type) IN ('DISLIKE', 'HIDE')) AS negative_labels, {sql_round('(epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0', 2)} AS days_of_data FROM interactions)""")
def h07(t: Tables):
    return fb.sufficiency(rows(t)).drop("violations")


_Q8 = f"""SELECT count(*) AS total_records, count(*) FILTER (user_id IS NULL) AS missing_user_id, count(*) FILTER (recipe_id IS NULL) AS missing_recipe_id, count(*) FILTER (session_id IS NULL) AS missing_session_id,
  count(*) - count(DISTINCT session_id || '|' || recipe_id) AS duplicate_records, count(*) FILTER (feedback_timestamp < impression_timestamp) AS temporal_inversions, count(*) FILTER (upper(coalesce(feedback_type, '')) NOT IN {in_list(rules.KNOWN_FEEDBACK)}) AS invalid_feedback_types FROM ({BASE_I})"""


@query("H08_training_quality", f"SELECT *, total_records > 0 AND missing_user_id + missing_recipe_id + missing_session_id + temporal_inversions + invalid_feedback_types = 0 AS is_valid FROM ({_Q8})")
def h08(t: Tables):
    return fb.training_quality(rows(t))


@query("H09_feedback_breakdown", "SELECT feedback_type, count(*) AS n FROM interactions WHERE feedback_type IS NOT NULL GROUP BY 1")
def h09(t: Tables):
    return fb.feedback_breakdown(rows(t))


_USERS, _ITEMS = "SELECT c_custkey AS user_id FROM customer WHERE c_nationkey <> 7", "SELECT 'R' || CAST(p_partkey AS STRING) AS recipe_id FROM part WHERE p_size <> 11"


@query("H10_pilot_audit", f"""SELECT *, CASE WHEN invalid_users + invalid_recipes + temporal_violations > 0 THEN 'DEFECTS_DETECTED' WHEN duplicate_events + missing_sessions > 0 THEN 'ACCEPTABLE' ELSE 'CLEAN' END AS quality_status FROM (
SELECT count(*) AS total_interactions, count(DISTINCT user_id) AS unique_users, count(DISTINCT recipe_id) AS unique_recipes, count(*) FILTER ({_G('feedback_type')} >= 2) AS positive_labels, count(*) FILTER ({_G('feedback_type')} = 0) AS negative_labels,
 count(*) FILTER ({_G('feedback_type')} = 1) AS neutral_labels, count(*) FILTER (coalesce(session_id, '') = '') AS missing_sessions,
 (SELECT count(*) FROM (SELECT DISTINCT user_id FROM ({FEED})) WHERE user_id NOT IN ({_USERS})) AS invalid_users, (SELECT count(*) FROM (SELECT DISTINCT recipe_id FROM ({FEED})) WHERE recipe_id NOT IN ({_ITEMS})) AS invalid_recipes,
 (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM ({FEED}) GROUP BY user_id, recipe_id, feedback_type, session_id)) AS duplicate_events,
 (SELECT count(*) FROM (SELECT session_id, recipe_id FROM ({FEED}) GROUP BY 1, 2 HAVING count(DISTINCT feedback_type) > 1)) AS conflicting_pairs,
 (SELECT count(*) FROM ({FEED}) f JOIN (SELECT session_id, recipe_id, max(impression_timestamp) AS s FROM ({HIST}) GROUP BY 1, 2) h ON f.session_id = h.session_id AND f.recipe_id = h.recipe_id WHERE f.feedback_timestamp < h.s) AS temporal_violations FROM ({FEED}))""")
def h10(t: Tables):
    users = t.customer.where("c_nationkey <> 7").select(F.col("c_custkey").alias("user_id"))
    items = t.part.where("p_size <> 11").select(F.concat(F.lit("R"), F.col("p_partkey").cast("string")).alias("recipe_id"))
    return fb.pilot_audit(feedback(t), users, items, history(t))


def metrics_sql(order: str, thr: str, src: str = f"SELECT *, {_G('feedback_type')} AS rel FROM interactions") -> str:
    dcg = lambda k, p: f"sum(CASE WHEN {p} <= {k} AND rel > 0 THEN (pow(2.0, rel) - 1) / log2({p} + 1) ELSE 0 END)"
    return f"""SELECT session_id, least(1.0, coalesce({dcg(5, 'a')} / nullif({dcg(5, 'i')}, 0), 0)) AS ndcg_5, least(1.0, coalesce({dcg(10, 'a')} / nullif({dcg(10, 'i')}, 0), 0)) AS ndcg_10, coalesce(1.0 / min(CASE WHEN a <= 10 AND rel >= {thr} THEN a END), 0) AS mrr_10,
 count(*) FILTER (a <= 5 AND rel >= {thr}) / 5.0 AS precision_5, count(*) FILTER (a <= 10 AND rel >= {thr}) / 10.0 AS precision_10, coalesce(count(*) FILTER (a <= 5 AND rel >= {thr}) * 1.0 / nullif(count(*) FILTER (rel >= {thr}), 0), 0) AS recall_5, coalesce(count(*) FILTER (a <= 10 AND rel >= {thr}) * 1.0 / nullif(count(*) FILTER (rel >= {thr}), 0), 0) AS recall_10
 FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY {order}) AS a, row_number() OVER (PARTITION BY session_id ORDER BY rel DESC) AS i FROM ({src})) GROUP BY 1"""


ALLM = ["ndcg_5", "ndcg_10", "mrr_10", "precision_5", "precision_10", "recall_5", "recall_10"]


def labelled(t: Tables):
    return t.interactions.withColumn("rel", fb.grade("feedback_type"))


def per_session(t: Tables, threshold: float = 1.0):
    return fb.ranking_metrics(labelled(t), "session_id", [F.asc("position"), F.asc("event_id")], "rel", threshold)


@query("H11_ndcg", f"SELECT session_id, {sql_round('ndcg_5', 6)} AS ndcg_5, {sql_round('ndcg_10', 6)} AS ndcg_10 FROM ({metrics_sql('position, event_id', '1')})")
def h11(t: Tables):
    return per_session(t).select("session_id", rnd("ndcg_5", 6).alias("ndcg_5"), rnd("ndcg_10", 6).alias("ndcg_10"))


@query("H12_mrr_precision_recall", f"SELECT session_id, {', '.join(sql_round(m, 6) + f' AS {m}' for m in ALLM[2:])} FROM ({metrics_sql('position, event_id', '1')})")
def h12(t: Tables):
    return per_session(t).select("session_id", *[rnd(m, 6).alias(m) for m in ALLM[2:]])


_MEAN = lambda src, ms: f"SELECT {', '.join(sql_round(f'avg({m})', 4) + f' AS {m}' for m in ms)}, count(*) AS queries FROM ({src})"


@query("H13_macro_metrics", _MEAN(metrics_sql("position, event_id", "1"), ALLM))
def h13(t: Tables):
    return fb.macro_mean(per_session(t), ALLM)


@query("H14_session_metrics", _MEAN(metrics_sql("position, event_id", "2"), fb.METRICS))
def h14(t: Tables):
    return fb.macro_mean(per_session(t, 2.0))


RANKERS = {"by_value": "value DESC, event_id", "by_time": "ts, event_id"}


def rankers():
    return {"by_value": [F.desc("value"), F.asc("event_id")], "by_time": [F.asc("ts"), F.asc("event_id")]}


@query("H15_compare_rankers", " UNION ALL ".join(f"SELECT *, '{n}' AS ranker FROM ({_MEAN(metrics_sql(o, '2'), fb.METRICS)})" for n, o in RANKERS.items()))
def h15(t: Tables):
    return fb.compare_rankers(labelled(t), "session_id", rankers(), "rel", 2.0)


_DELTA = lambda m: f"CASE WHEN b.{m} > 0 THEN {sql_round(f'(c.{m} - b.{m}) / b.{m} * 100', 2)} ELSE 0.0 END"


@query("H16_compare_models", f"""SELECT *, gate_violations AND gate_ndcg5 AND gate_mrr10 AND gate_zero_results AND gate_latency AS passed_all FROM (SELECT {', '.join(f'b.{m} AS base_{m}, c.{m} AS cand_{m}, {_DELTA(m)} AS delta_pct_{m}' for m in fb.METRICS)},
  TRUE AS gate_violations, {_DELTA('ndcg_5')} >= 0 AS gate_ndcg5, {_DELTA('mrr_10')} >= 0 AS gate_mrr10, TRUE AS gate_zero_results, TRUE AS gate_latency FROM ({_MEAN(metrics_sql(RANKERS['by_time'], '2'), fb.METRICS)}) b, ({_MEAN(metrics_sql(RANKERS['by_value'], '2'), fb.METRICS)}) c)""")
def h16(t: Tables):
    one = lambda k: fb.macro_mean(fb.ranking_metrics(labelled(t), "session_id", rankers()[k], "rel", 2.0))
    return fb.compare_models(one("by_time"), one("by_value"), F.lit(0), F.lit(0.0), F.lit(85.0))


@query("H17_recommendation_evaluation", f"""WITH {CENT} SELECT count(DISTINCT id) AS unique_items, {sql_round('avg(score)', 4)} AS score_mean, {sql_round('min(score)', 4)} AS score_min, {sql_round('max(score)', 4)} AS score_max, {sql_round('stddev_pop(score)', 4)} AS score_std,
  {sql_round('count(DISTINCT id) * 1.0 / (SELECT count(*) FROM embeddings)', 4)} AS catalogue_coverage, (SELECT {sql_round('avg(diversity)', 4)} FROM ({DIV})) AS mean_diversity FROM ({_TOPK('score', 10)})""")
def h17(t: Tables):
    return fb.evaluate_recommendations(ret.dense_top(corpus(t), centroids(t), 10), diversity(t), t.embeddings.agg(F.count(F.lit(1))).scalar())


_HALF = "day_key <= 20240115"
_SHARE = lambda c, w: f"SELECT {c} AS v, count(*) * 1.0 / (SELECT count(*) FROM interactions WHERE {w} AND {c} IS NOT NULL) AS s FROM interactions WHERE {w} AND {c} IS NOT NULL GROUP BY 1"
_TVD = lambda c: f"(SELECT {sql_round('sum(abs(coalesce(a.s, 0) - coalesce(b.s, 0))) / 2', 4)} FROM ({_SHARE(c, _HALF)}) a FULL JOIN ({_SHARE(c, f'NOT {_HALF}')}) b ON a.v = b.v)"


@query("H18_label_drift", f"SELECT count(*) FILTER ({_HALF}) AS baseline_rows, count(*) FILTER (NOT {_HALF}) AS current_rows, 'EVALUATED' AS status, {sql_round(f'count(*) FILTER (NOT {_HALF}) * 1.0 / count(*) FILTER ({_HALF})', 3)} AS volume_ratio, {_TVD('feedback_type')} AS label_drift, {_TVD('recipe_id')} AS query_drift FROM interactions")
def h18(t: Tables):
    return fb.label_drift(t.interactions.where(_HALF), t.interactions.where(f"NOT {_HALF}"), "recipe_id")


_KINDS = ["IMPRESSION", "LIKE", "SAVE", "COOKED", "DISLIKE", "HIDE"]


@query("H19_product_kpis", f"""SELECT {', '.join(f"count(*) FILTER (upper(feedback_type) = '{k}') AS n_{k.lower()}" for k in _KINDS)}, count(*) FILTER (upper(feedback_type) IN {in_list(_KINDS[1:])}) AS total_engagements, (SELECT count(*) FROM customer) AS enrolled_users,
  count(DISTINCT user_id) AS active_users, count(DISTINCT session_id) AS recommendation_requests, CAST(NULL AS BIGINT) AS failed_requests FROM interactions""")
def h19(t: Tables):
    return fb.product_kpis(t.customer, t.interactions, t.interactions)


@query("H20_latency_percentiles", f"""SELECT event_type, CAST(n AS BIGINT) AS samples, {sql_round('a', 2)} AS avg_ms, {', '.join(sql_round(f'v[1 + least(CAST(floor(n * {p}) AS INT), n - 1)]', 2) + f' AS p{x}_ms' for p, x in ((0.5, 50), (0.95, 95), (0.99, 99)))}
FROM (SELECT event_type, count(*) AS n, avg(value) AS a, list(value ORDER BY value) AS v FROM events GROUP BY 1)""")
def h20(t: Tables):
    return fb.latency_percentiles(t.events, ["event_type"], "value")


@query("H20_request_kpis", f"SELECT count(*) AS total_requests, count(*) FILTER (feedback_type = 'HIDE') AS total_errors, count(DISTINCT user_id) AS active_users, {sql_round('''count(*) FILTER (feedback_type = 'HIDE') * 1.0 / count(*)''', 4)} AS error_rate, (SELECT count(*) FROM (SELECT user_id FROM interactions GROUP BY 1 HAVING count(DISTINCT session_id) > 1)) AS returning_users FROM interactions")
def h20b(t: Tables):
    return fb.request_kpis(t.interactions, F.col("feedback_type") == "HIDE")


@query("H21_history_page", "SELECT user_id, recipe_id, event_id, CAST(place AS INT) AS place, total FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place, count(*) OVER (PARTITION BY user_id) AS total FROM interactions) WHERE place > 5 AND place <= 15")
def h21(t: Tables):
    return fb.history_page(t.interactions, 10, 5, [F.desc("ts"), F.desc("event_id")]).select("user_id", "recipe_id", "event_id", "place", "total")


@query("H22_newest_feedback", "SELECT event_id, user_id, feedback_type FROM interactions WHERE feedback_type = 'HIDE' ORDER BY ts DESC, event_id DESC LIMIT 50")
def h22(t: Tables):
    return fb.newest_feedback(t.interactions, F.col("feedback_type") == "HIDE", [F.desc("ts"), F.desc("event_id")], 50).select("event_id", "user_id", "feedback_type")
