"""G: scoring and ranking of customers' candidate recipes, personalisation, learning to rank."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import rules
from larder.functions.common import rnd
from larder.functions.text import diet_flags
from larder.operators import ranking as rk
from larder.operators import retrieval as ret
from larder.operators import validation as val
from larder.operators.cleaning import approved_cuisine
from larder.plans.cleaning_queries import _FLAGS, APPROVED
from larder.plans.constraint_queries import FULL, LISTS, _split, evaluated, requests, write_lines
from larder.plans.registry import Tables, query
from larder.plans.sqltext import q, sql_round
from larder.sources.shared import materialize, scratch

GOALS = {g: g for g in ("calorie_target", "protein_target", "max_calories", "min_protein")}
_SH = lambda c: f"CASE WHEN len(list_distinct({_split('r.' + c)})) > 0 THEN len(list_intersect(list_distinct({_split('r.' + c)}), coalesce(cs.s, []))) * 1.0 / len(list_distinct({_split('r.' + c)})) END"
_IM = f"least(1.0, greatest(0.0, coalesce({_SH('required')}, {_SH('available')}, 1.0) - 0.2 * len(list_intersect({_split('r.disliked')}, coalesce(cs.s, [])))))"
_NC = f"CASE WHEN n.recipe_id IS NULL THEN 0.0 WHEN n.nutrition_quality = 'COMPLETE' THEN 1.0 WHEN n.nutrition_quality = 'APPROXIMATE' THEN 0.85 ELSE {sql_round('0.5 * least(1.0, n.calculated_ingredient_count * 1.0 / n.ingredient_count)', 3)} END"
_K, _P = "n.per_serving_calories_kcal", "coalesce(n.per_serving_protein_g, 0.0)"
_SUBS = f"""list_filter([CASE WHEN r.calorie_target > 0 THEN greatest(0.0, 1 - abs({_K} - r.calorie_target) / r.calorie_target) END, CASE WHEN r.protein_target > 0 THEN least(1.0, {_P} / r.protein_target) END,
 CASE WHEN r.max_calories > 0 THEN CASE WHEN {_K} <= r.max_calories THEN 1.0 ELSE greatest(0.0, 1 - ({_K} - r.max_calories) / r.max_calories) END END, CASE WHEN r.min_protein > 0 THEN least(1.0, {_P} / r.min_protein) END], lambda x: x IS NOT NULL)"""
_NS = f"CASE WHEN n.recipe_id IS NULL THEN 0.0 WHEN r.calorie_target IS NULL AND r.protein_target IS NULL AND r.max_calories IS NULL AND r.min_protein IS NULL THEN 1.0 ELSE {sql_round(f'list_avg({_SUBS})', 4)} END"
_PC = """list_filter([CASE WHEN r.vegetarian IS NOT NULL THEN CASE WHEN rf.vegetarian = r.vegetarian THEN 1.0 ELSE 0.0 END END, CASE WHEN r.vegan IS NOT NULL THEN CASE WHEN rf.vegan = r.vegan THEN 1.0 ELSE 0.0 END END,
 CASE WHEN r.want_cuisine IS NOT NULL THEN CASE WHEN contains(lower(trim(coalesce(o.cuisine, ''))), r.want_cuisine) THEN 1.0 ELSE 0.0 END END, CASE WHEN r.want_meal IS NOT NULL THEN CASE WHEN contains(lower(o.meal_type), r.want_meal) THEN 1.0 ELSE 0.0 END END], lambda x: x IS NOT NULL)"""
_PS = f"CASE WHEN len({_PC}) = 0 THEN 1.0 ELSE {sql_round(f'list_avg({_PC})', 4)} END"
SCORED = f"""
cs AS MATERIALIZED (SELECT recipe_id, list(DISTINCT canonical_ingredient) AS s FROM lines WHERE canonical_ingredient IS NOT NULL GROUP BY 1), rf AS (SELECT recipe_id, {_FLAGS} FROM recipes),
s0 AS (SELECT c.request_id, c.recipe_id, c.cust_no, c.order_no, c.similarity_score, {_IM} AS ingredient_match_score, {_NC} AS nutrition_confidence, {_NS} AS nutrition_score, {_PS} AS preference_score, o.cuisine, o.meal_type, o.region, o.category
  FROM candidates c JOIN requests r ON c.request_id = r.request_id JOIN recipes o ON c.recipe_id = o.recipe_id JOIN rf ON c.recipe_id = rf.recipe_id LEFT JOIN cs ON c.recipe_id = cs.recipe_id LEFT JOIN nutri n ON c.recipe_id = n.recipe_id),
sc AS MATERIALIZED (SELECT *, {sql_round('0.4 * similarity_score + 0.25 * ingredient_match_score + 0.2 * nutrition_score + 0.15 * preference_score', 4)} AS hybrid_score FROM s0)"""


def candidates(t: Tables):
    return t.candidates.select("request_id", "recipe_id", F.col("similarity_score").cast("double").alias("similarity_score"))


def nutrition(t: Tables):
    return t.nutri


def scored(t: Tables):
    return rk.score_candidates(candidates(t), requests(t), t.recipes, t.lines, nutrition(t), GOALS)


@query("G01_ingredient_match", f"WITH {SCORED} SELECT request_id, recipe_id, {sql_round('ingredient_match_score', 6)} AS score FROM sc")
def g01(t: Tables):
    return scored(t).select("request_id", "recipe_id", rnd("ingredient_match_score", 6).alias("score"))


@query("G02_batch_match", f"WITH {SCORED} SELECT request_id, count(*) AS recipes, {sql_round('avg(ingredient_match_score)', 6)} AS mean_score FROM sc GROUP BY 1")
def g02(t: Tables):
    return scored(t).groupBy("request_id").agg(F.count(F.lit(1)).alias("recipes"), rnd(F.avg("ingredient_match_score"), 6).alias("mean_score"))


@query("G03_nutrition_confidence", f"WITH {SCORED} SELECT request_id, recipe_id, nutrition_confidence FROM sc")
def g03(t: Tables):
    return scored(t).select("request_id", "recipe_id", "nutrition_confidence")


@query("G04_nutrition_score", f"WITH {SCORED} SELECT request_id, recipe_id, nutrition_score FROM sc")
def g04(t: Tables):
    return scored(t).select("request_id", "recipe_id", "nutrition_score")


@query("G05_preference_score", f"WITH {SCORED} SELECT request_id, recipe_id, preference_score FROM sc")
def g05(t: Tables):
    return scored(t).select("request_id", "recipe_id", "preference_score")


@query("G06_hybrid_score", f"WITH {SCORED} SELECT request_id, recipe_id, hybrid_score FROM sc")
def g06(t: Tables):
    return scored(t).select("request_id", "recipe_id", "hybrid_score")


_ORDER = "hybrid_score DESC, similarity_score DESC, ingredient_match_score DESC, recipe_id"


@query("G07_hybrid_topk", f"WITH {SCORED} SELECT request_id, recipe_id, hybrid_score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY {_ORDER}) AS rank FROM sc) WHERE rank <= 5")
def g07(t: Tables):
    return rk.rank_hybrid(scored(t), 5).select("request_id", "recipe_id", "hybrid_score", "rank")


def eligible(t: Tables):
    passed = evaluated(t).where("passed").select("request_id", "recipe_id")
    return candidates(t).join(passed, ["request_id", "recipe_id"], "left_semi")


def recommendations(t: Tables):
    return rk.recommend(eligible(t), requests(t), t.recipes, t.lines, nutrition(t), GOALS, 5)


RECS = f"""{FULL}, {SCORED}, rc AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY {_ORDER}) AS rank FROM sc JOIN fp USING (request_id, recipe_id) WHERE passed AND recipe_id IN (SELECT recipe_id FROM recipes WHERE {APPROVED}))"""
_RCOLS = ["hybrid_score", "nutrition_score", "preference_score", "nutrition_confidence"]


@query("G08_recommend", f"{RECS} SELECT request_id, recipe_id, CAST(rank AS INT) AS rank, {', '.join(_RCOLS)} FROM rc WHERE rank <= 5")
def g08(t: Tables):
    return recommendations(t).select("request_id", "recipe_id", "rank", *_RCOLS)


@query("G09_query_recommend")
def g09(t: Tables):
    """Free-text requests: lexical retrieval over the recipe corpus, then scoring and ranking."""
    corpus = ret.build_corpus(t.recipes.where(approved_cuisine("cuisine")), t.lines).select(F.col("recipe_id").alias("id"), F.col("corpus_text").alias("text"))
    asked = requests(t).select("segment", "available").distinct().select(F.col("segment").alias("query_id"), F.concat_ws(" ", "available").alias("text"))
    with scratch(corpus.sparkSession) as keep:
        top = keep(ret.lexical_retrieve(materialize(corpus, "corpus"), asked, 50, "id"))
    ask = requests(t).groupBy(F.col("segment").alias("request_id")).agg(*[F.max(c).alias(c) for c in ("required", "available", "preferred", "disliked")])
    ask = ask.withColumns({**{c: F.lit(None).cast("boolean") for c in ("vegetarian", "vegan")}, **{c: F.lit(None).cast("string") for c in ("want_cuisine", "want_meal")}, **{g: F.lit(None).cast("double") for g in GOALS}})
    found = top.select(F.col("query_id").alias("request_id"), F.col("id").alias("recipe_id"), F.col("score").alias("similarity_score"))
    return rk.recommend(found, ask, t.recipes, t.lines, nutrition(t), GOALS, 10).select("request_id", "recipe_id", "rank", "hybrid_score", "similarity_score")


PANTRY = f"SELECT cust_no AS user_id, x AS ingredient_name, CASE WHEN c_nationkey = 3 THEN 'OUT_OF_STOCK' ELSE 'IN_STOCK' END AS status FROM (SELECT cust_no, c_nationkey, unnest({_split('available')}) AS x FROM requests)"
_FSET = lambda n, k: f"coalesce(list_sort(list(DISTINCT recipe_id) FILTER (feedback_type = '{k}')), []) AS {n}"
CONTEXT = f"""fs AS (SELECT user_id, {_FSET('liked', 'LIKE')}, {_FSET('saved', 'SAVE')}, {_FSET('cooked', 'COOKED')}, {_FSET('disliked_recipes', 'DISLIKE')}, {_FSET('hidden', 'HIDE')} FROM user_feedback GROUP BY 1),
pt AS (SELECT user_id, list_sort(list(DISTINCT lower(ingredient_name))) AS pantry FROM ({PANTRY}) WHERE status <> 'OUT_OF_STOCK' GROUP BY 1),
rh AS (SELECT user_id, list_sort(list(DISTINCT recipe_id)) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, order_no DESC) AS r FROM user_history) WHERE r <= 30 GROUP BY 1),
cx AS MATERIALIZED (SELECT coalesce(fs.user_id, pt.user_id, rh.user_id) AS user_id, liked, saved, cooked, disliked_recipes, hidden, pantry, recent FROM fs FULL JOIN pt ON fs.user_id = pt.user_id FULL JOIN rh ON coalesce(fs.user_id, pt.user_id) = rh.user_id)"""
_CXS = ["liked", "saved", "cooked", "disliked_recipes", "hidden", "pantry", "recent"]


def context(t: Tables):
    pantry = requests(t).select(F.col("cust_no").alias("user_id"), F.explode("available").alias("ingredient_name"), F.when(F.col("c_nationkey") == 3, "OUT_OF_STOCK").otherwise("IN_STOCK").alias("status"))
    return rk.user_context(t.user_feedback, t.user_history, pantry, [F.desc("created_at"), F.desc("order_no")])


@query("G14_user_context", f"WITH {CONTEXT} SELECT user_id, {', '.join(f'''coalesce(array_to_string({c}, '|'), '') AS {c}''' for c in _CXS)} FROM cx")
def g14(t: Tables):
    return context(t).select("user_id", *[F.coalesce(F.array_join(c, "|"), F.lit("")).alias(c) for c in _CXS])


def signals(t: Tables, rows):
    """Personal signals of scored candidates."""
    ask = requests(t).select("request_id", F.col("cust_no").alias("user_id"), F.col("want_cuisine").alias("pref_cuisine"), F.col("want_meal").alias("pref_meal"), F.lit(None).cast("string").alias("pref_region"), F.lit("main").alias("pref_category"))
    rows = rows.join(ask, "request_id").join(context(t), "user_id", "left").withColumn("item_set", F.col("canon_set"))
    return rk.personal_signals(rows)


_FLAG = lambda c: f"CAST(coalesce(list_contains(cx.{c}, sc.recipe_id), FALSE) AS DOUBLE)"
_LC = lambda a, b: f"CAST(coalesce(lower(trim({a})) = {b}, FALSE) AS DOUBLE)"
_KC, _PR = "coalesce(n.per_serving_calories_kcal, 0.0)", "coalesce(n.per_serving_protein_g, 0.0)"
_AL = f"""list_filter([CASE WHEN r.calorie_target > 0 THEN greatest(0.0, 1 - abs({_KC} - r.calorie_target) / r.calorie_target) WHEN r.max_calories > 0 THEN CASE WHEN {_KC} <= r.max_calories THEN 1.0 ELSE greatest(0.0, 1 - ({_KC} - r.max_calories) / r.max_calories) END END,
  CASE WHEN r.protein_target > 0 THEN greatest(0.0, 1 - abs({_PR} - r.protein_target) / greatest(r.protein_target, 1.0)) END], lambda x: x IS NOT NULL)"""
SIGNALS = f"""{CONTEXT}, {SCORED}, sg AS MATERIALIZED (SELECT sc.request_id, sc.recipe_id, sc.hybrid_score, {_LC('sc.cuisine', 'r.want_cuisine')} AS cuisine_affinity, {_LC('sc.meal_type', 'r.want_meal')} AS meal_type_affinity, {_LC('sc.category', q('main'))} AS category_affinity, 0.0 AS region_affinity,
  least(1.0, len(list_intersect(coalesce(cs.s, []), coalesce(cx.pantry, []))) * 1.0 / greatest(len(coalesce(cs.s, [])), 1)) AS pantry_overlap_ratio, len(list_intersect(coalesce(cs.s, []), {_split('r.preferred')})) AS preferred_ingredient_match_count,
  CAST(len(list_intersect(coalesce(cs.s, []), {_split('r.disliked')})) > 0 AS DOUBLE) AS disliked_ingredient_penalty, {_FLAG('liked')} AS past_liked, {_FLAG('saved')} AS past_saved, {_FLAG('cooked')} AS past_cooked, {_FLAG('disliked_recipes')} AS past_disliked, {_FLAG('hidden')} AS past_hidden, {_FLAG('recent')} AS recently_recommended,
  coalesce(list_avg({_AL}), 0.0) AS nutrition_target_alignment FROM sc JOIN requests r ON sc.request_id = r.request_id LEFT JOIN cx ON r.cust_no = cx.user_id LEFT JOIN cs ON sc.recipe_id = cs.recipe_id LEFT JOIN nutri n ON sc.recipe_id = n.recipe_id)"""
_SIG = ["cuisine_affinity", "meal_type_affinity", "category_affinity", "pantry_overlap_ratio", "disliked_ingredient_penalty", "past_liked", "past_saved", "past_cooked", "past_disliked", "past_hidden", "recently_recommended", "nutrition_target_alignment"]


@query("G12_personal_signals", f"WITH {SIGNALS} SELECT request_id, recipe_id, preferred_ingredient_match_count, {', '.join(sql_round(s, 6) + f' AS {s}' for s in _SIG)} FROM sg")
def g12(t: Tables):
    return signals(t, scored(t)).select("request_id", "recipe_id", "preferred_ingredient_match_count", *[rnd(s, 6).alias(s) for s in _SIG])


_RAW = " + ".join(f"{w} * {c}" for c, w in rules.PERSONAL_GAINS.items()) + " + 0.15 * least(0.1 * preferred_ingredient_match_count, 0.3) - (" + " + ".join(f"{w} * {c}" for c, w in rules.PERSONAL_LOSSES.items()) + ")"
_ADJ = f"0.2 * greatest(-1.0, least(1.0, {_RAW}))"


@query("G13_adjustment", f"WITH {SIGNALS} SELECT request_id, recipe_id, {sql_round(_ADJ, 6)} AS adjustment FROM sg")
def g13(t: Tables):
    return signals(t, scored(t)).select("request_id", "recipe_id", rnd(rk.adjustment(), 6).alias("adjustment"))


@query("G10_personal_rerank", f"{FULL}, {SIGNALS} SELECT request_id, recipe_id, final_score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY final_score DESC, hybrid_score DESC, recipe_id) AS rank FROM (SELECT *, {sql_round(f'greatest(0.0, hybrid_score + {_ADJ})', 6)} AS final_score FROM sg JOIN fp USING (request_id, recipe_id) WHERE passed)) WHERE rank <= 5")
def g10(t: Tables):
    """Only candidates that passed the hard constraints are personalised, so a liked recipe that was rejected stays out."""
    rows = signals(t, rk.score_candidates(eligible(t), requests(t), t.recipes, t.lines, nutrition(t), GOALS))
    # snap the adjustment noise before ordering, as the SQL twin does
    return rk.rerank(rows, 5).select("request_id", "recipe_id", rnd("final_score", 6).alias("final_score"), "rank")


@query("G11_explanations")
def g11(t: Tables):
    return recommendations(t).select("request_id", "recipe_id", "rank", "explanation")


def feature_rows(t: Tables):
    o, c = F.col("order_no"), F.col("cust_no")
    base = t.candidates.select("request_id", "recipe_id", "order_no", "cust_no", F.col("similarity_score").cast("double").alias("tfidf_score"), (((o * 13 + c * 7) % 1000) / 1000.0).cast("double").alias("semantic_score"),
                               F.when(o % 3 != 0, (o % 50).cast("int")).alias("tfidf_rank"), F.when(o % 4 != 0, (c % 50).cast("int")).alias("semantic_rank")).drop("cust_no", "order_no")
    items = t.lines.groupBy("recipe_id").agg(F.sort_array(F.collect_set(F.lower("ingredient"))).alias("clean_items"))
    meta = t.recipes.select("recipe_id", "cuisine", "region", "meal_type", "category", "total_time_min", diet_flags("diet_type").alias("f")).select(
        "recipe_id", "cuisine", "region", "meal_type", "category", "total_time_min", *[F.col(f"f.{d}").alias(f"{d}_flag") for d in ("vegetarian", "vegan", "jain", "satvik")])
    ask = requests(t).select("request_id", *LISTS, "calorie_target", "protein_target", "want_cuisine", "want_meal", F.lit("Region 1").alias("want_region"), F.lit("main").alias("want_category"))
    return (base.join(ask, "request_id").join(meta, "recipe_id").join(items, "recipe_id", "left").join(rk.canonical_sets(t.lines), "recipe_id", "left")
            .join(nutrition(t), "recipe_id", "left").withColumns({"coverage_ratio": F.lit(None).cast("double"), "diet_ok": F.col("vegetarian_flag")}))


def features(t: Tables):
    return rk.ranking_features(feature_rows(t))


_FND = lambda c: f"len(list_filter({_split('r.' + c)}, lambda a: len(list_filter(coalesce(i.x, []), lambda z: contains(z, lower(a)))) > 0))"
_TOT = "greatest(1, len(coalesce(i.x, [])))"
_D = lambda e: f"CAST({e} AS DOUBLE)"
_CV = sql_round(f"{_FND('available')} * 1.0 / {_TOT}", 4)
FEATS = {
    "retrieval_tfidf_score": sql_round("c.similarity_score", 4), "retrieval_bge_score": sql_round("((c.order_no * 13 + c.cust_no * 7) % 1000) / 1000.0", 4),
    "retrieval_tfidf_rr": sql_round("CASE WHEN c.order_no % 3 <> 0 THEN 1.0 / (c.order_no % 50 + 1) ELSE 0 END", 4), "retrieval_bge_rr": sql_round("CASE WHEN c.order_no % 4 <> 0 THEN 1.0 / (c.cust_no % 50 + 1) ELSE 0 END", 4),
    "retrieval_both": _D("c.order_no % 3 <> 0 AND c.order_no % 4 <> 0"), "ingredient_match_count": _D(_FND("available")), "ingredient_total_count": _D(_TOT), "ingredient_coverage_ratio": _CV, "pantry_coverage_ratio": _CV,
    "required_ingredient_count": _D(_FND("required")), "preferred_ingredient_count": _D(_FND("preferred")), "canonical_match_count": _D(f"len(list_intersect({_split('r.available')}, coalesce(cs.s, [])))"),
    "calorie_target_distance": sql_round(f"coalesce(CASE WHEN {_K} > 0 THEN abs({_K} - r.calorie_target) / 500 END, 0)", 4), "protein_target_distance": sql_round("coalesce(CASE WHEN n.per_serving_protein_g > 0 THEN abs(n.per_serving_protein_g - r.protein_target) / 20 END, 0)", 4),
    **{f"per_serving_{m}": _D(f"coalesce(n.per_serving_{c}, 0)") for m, c in (("calories", "calories_kcal"), ("protein_g", "protein_g"), ("carbs_g", "carbs_g"), ("fat_g", "fat_g"), ("fiber_g", "fiber_g"))},
    "nutrition_available": _D(f"{_K} IS NOT NULL"), **{f"{d}_compliant": _D(f"rf.{d}") for d in ("vegetarian", "vegan", "jain", "satvik")},
    "cuisine_match": _D("coalesce(contains(lower(o.cuisine), r.want_cuisine), FALSE)"), "region_match": _D("contains(lower(o.region), 'region 1')"), "meal_type_match": _D("coalesce(contains(lower(o.meal_type), r.want_meal), FALSE)"), "category_match": _D("contains(lower(o.category), 'main')"),
    "total_time_min": _D("coalesce(o.total_time_min, 30)"), "hard_constraint_violation": "0.0",
}
FEATSQL = f"""cs AS MATERIALIZED (SELECT recipe_id, list(DISTINCT canonical_ingredient) AS s FROM lines WHERE canonical_ingredient IS NOT NULL GROUP BY 1), rf AS (SELECT recipe_id, {_FLAGS} FROM recipes),
i AS MATERIALIZED (SELECT recipe_id, list(DISTINCT ingredient) AS x FROM lines GROUP BY 1),
ft AS MATERIALIZED (SELECT c.request_id, c.recipe_id, rf.vegetarian AS diet_ok, {', '.join(f'{e} AS {n}' for n, e in FEATS.items())} FROM candidates c JOIN requests r ON c.request_id = r.request_id JOIN recipes o ON c.recipe_id = o.recipe_id JOIN rf ON c.recipe_id = rf.recipe_id
  LEFT JOIN cs ON c.recipe_id = cs.recipe_id LEFT JOIN i ON c.recipe_id = i.recipe_id LEFT JOIN nutri n ON c.recipe_id = n.recipe_id)"""


_F6 = lambda n: sql_round(n, 6) + f" AS {n}"


@query("G15_ranking_features", f"WITH {FEATSQL} SELECT request_id, recipe_id, {', '.join(_F6(n) for n in FEATS)} FROM ft")
def g15(t: Tables):
    return features(t).select("request_id", "recipe_id", *[rnd(n, 6).alias(n) for n in rules.FEATURE_NAMES])


_SCO = "CASE WHEN retrieval_both = 1 THEN (retrieval_tfidf_score + retrieval_bge_score) / 2 ELSE greatest(retrieval_tfidf_score, retrieval_bge_score) END"
_LAB = f"CASE WHEN NOT diet_ok THEN 0 WHEN (retrieval_both = 1 OR {_SCO} >= 0.45) AND ingredient_coverage_ratio >= 0.5 THEN 3 WHEN {_SCO} >= 0.35 OR ingredient_coverage_ratio >= 0.4 THEN 2 WHEN {_SCO} >= 0.15 OR ingredient_coverage_ratio >= 0.2 THEN 1 ELSE 0 END"


@query("G17_weak_labels", f"WITH {FEATSQL} SELECT request_id, recipe_id, {_LAB} AS relevance FROM ft")
def g17(t: Tables):
    return rk.ranking_dataset(features(t)).select("request_id", "recipe_id", "relevance")


@query("G18_ranking_dataset", f"WITH {FEATSQL} SELECT relevance, count(*) AS n, {sql_round('sum(ingredient_coverage_ratio)', 4)} AS coverage, {sql_round('avg(retrieval_bge_score)', 4)} AS dense FROM (SELECT *, {_LAB} AS relevance FROM ft) GROUP BY 1")
def g18(t: Tables):
    return rk.ranking_dataset(features(t)).groupBy("relevance").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("ingredient_coverage_ratio"), 4).alias("coverage"), rnd(F.avg("retrieval_bge_score"), 4).alias("dense"))


_HASH = "CAST(('0x' || substr(md5(text), 1, 6)) AS BIGINT) / 16777216.0"


@query("G19_query_group_split", f"SELECT item_id, CASE WHEN h < 0.7 THEN 'train' WHEN h < 0.85 THEN 'val' ELSE 'test' END AS split FROM (SELECT item_id, {_HASH} AS h FROM benchmark)")
def g19(t: Tables):
    return t.benchmark.select("item_id", rk.query_group_split(F.col("text")).alias("split"))


def _model(t: Tables):
    data = rk.ranking_dataset(features(t)).withColumn("relevance", F.col("relevance").cast("double"))
    from larder.sources.shared import materialize
    data = materialize(data.withColumn("split", rk.query_group_split(F.col("request_id"))), "ranking-data")
    return data, rk.train_ranker(data.where("split = 'train'"), iterations=5, depth=3)


@query("G16_model_ranking")
def g16(t: Tables):
    data, model = _model(t)
    return rk.rank_by_model(data.where("split <> 'train'"), model, F.col("retrieval_tfidf_score"), 5)


@query("G20_train_ranker")
def g20(t: Tables):
    from larder.operators import feedback as fb
    data, model = _model(t)
    out = model.transform(data.where("split = 'test'"))
    per = fb.ranking_metrics(out, "request_id", [F.desc("model_score"), F.asc("recipe_id")], "relevance", 2.0)
    return fb.macro_mean(per)


# The checks run on rankings with faults, so that they have something to count: rows that the hard constraints reject,
# and second places given again with a last rank and too high a score.
UNFILTERED = f"{FULL}, {SCORED}, un AS MATERIALIZED (SELECT request_id, recipe_id, hybrid_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY {_ORDER}) AS rank FROM sc) WHERE rank <= 5)"


def unfiltered(t: Tables):
    write_lines(t)
    return rk.rank_hybrid(scored(t), 5)


@query("H23_constraint_violations", f"{UNFILTERED} SELECT count(*) AS violations FROM un JOIN fp USING (request_id, recipe_id) WHERE NOT passed")
def h23(t: Tables):
    return rk.violation_count(unfiltered(t), evaluated(t))


@query("D19_recommendation_checks", f"""{UNFILTERED}, bad AS (SELECT * FROM un UNION ALL SELECT request_id, recipe_id, hybrid_score + 2, 9 FROM un WHERE rank = 2),
per AS (SELECT request_id, count(*) AS n, count(DISTINCT recipe_id) AS ids, max(rank) AS last FROM bad GROUP BY 1)
SELECT count(*) FILTER (n <> ids) AS duplicate_recipes, count(*) FILTER (last <> n) AS rank_gaps, count(*) FILTER (n > 5) AS too_long, (SELECT count(DISTINCT request_id) FROM bad WHERE rank = 9) AS order_broken,
  (SELECT count(*) FROM bad WHERE hybrid_score > 1) AS score_out_of_range, (SELECT count(*) FROM bad JOIN fp USING (request_id, recipe_id) WHERE NOT passed) AS rejected_readmitted FROM per""")
def d19(t: Tables):
    again = F.explode(F.when(F.col("rank") == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    bad = unfiltered(t).withColumn("again", again).withColumns(
        {"rank": F.when(F.col("again") == 1, 9).otherwise(F.col("rank")), "hybrid_score": F.col("hybrid_score") + 2 * F.col("again")})
    return val.recommendation_checks(bad, 5, evaluated(t).where("NOT passed"))
