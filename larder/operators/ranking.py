"""Scoring, ranking, personalisation, features and the ranking model."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import rules
from larder.functions.common import clip01, rnd, text_or_empty, top_k

def _none() -> Column:
    return F.array().cast("array<string>")


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), _none())


# ---------------------------------------------------------------- pillars


def canonical_sets(lines: DataFrame) -> DataFrame:
    """Distinct canonical names per recipe (G2 input)."""
    return lines.where(F.col("canonical_ingredient").isNotNull()).groupBy("recipe_id").agg(
        F.array_sort(F.collect_set(F.lower("canonical_ingredient"))).alias("canon_set")
    )


def ingredient_match(required: str, available: str, preferred: str, disliked: str) -> Column:
    """Match score over ``canon_set`` and resolved request lists.

    Required ingredients decide when asked, then available, then preferred ones;
    each disliked ingredient present costs 0.2.
    """
    canon = _list("canon_set")

    def share(c: str) -> Column:
        asked = F.array_distinct(_list(c))
        return F.try_divide(F.size(F.array_intersect(asked, canon)), F.size(asked))

    base = F.coalesce(share(required), share(available), share(preferred), F.lit(1.0))
    hits = F.size(F.array_intersect(_list(disliked), canon))
    return clip01(base - 0.2 * hits)


def nutrition_confidence() -> Column:
    """Confidence by tier and share of calculated lines; no record gives 0."""
    share = F.least(F.lit(1.0), F.col("calculated_ingredient_count") / F.col("ingredient_count"))
    return (
        F.when(F.col("nutrition_quality").isNull(), 0.0)
        .when(F.col("nutrition_quality") == "COMPLETE", 1.0)
        .when(F.col("nutrition_quality") == "APPROXIMATE", 0.85)
        .when(F.col("ingredient_count") > 0, rnd(0.5 * share, 3))
        .otherwise(0.10)
    )


GOALS = ["calorie_target", "protein_target", "max_calories", "min_protein", "max_fat", "max_carbs", "min_fiber"]


def nutrition_score(goals: dict[str, str]) -> Column:
    """Mean of the sub-scores of the goals that are asked.

    ``goals`` maps goal names to request columns. No goal gives 1, no record or
    no calories 0; other missing measures count as 0.
    """
    kcal = F.col("per_serving_calories_kcal")

    def measure(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0.0))

    def near(v: Column, x: Column) -> Column:
        return F.greatest(F.lit(0.0), 1.0 - F.abs(v - x) / x)

    def at_most(v: Column, x: Column) -> Column:
        return F.when(v <= x, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - (v - x) / x))

    def at_least(v: Column, x: Column) -> Column:
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), v / x))

    protein = measure("per_serving_protein_g")
    rule = {
        "calorie_target": (near, kcal), "protein_target": (at_least, protein), "max_calories": (at_most, kcal), "min_protein": (at_least, protein),
        "max_fat": (at_most, measure("per_serving_fat_g")), "max_carbs": (at_most, measure("per_serving_carbs_g")), "min_fiber": (at_least, measure("per_serving_fiber_g")),
    }
    subs = []
    for goal, column in goals.items():
        fn, value = rule[goal]
        x = F.col(column).cast("double")
        subs.append(F.when(x > 0, fn(value, x)))
    scores = F.array_compact(F.array(*subs))
    any_goal = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in goals.values()])
    mean = F.aggregate(scores, F.lit(0.0), lambda a, s: a + s) / F.nullif(F.size(scores), F.lit(0))
    return (
        F.when(F.col("nutrition_quality").isNull(), 0.0).when(~any_goal, 1.0).when(kcal.isNull(), 0.0)
        .otherwise(rnd(clip01(F.coalesce(mean, F.lit(1.0))), 4))
    )


def preference_score(flags: dict[str, tuple[Column, Column]], words: dict[str, tuple[Column, Column]]) -> Column:
    """Satisfied checks over asked checks.

    ``flags``: name -> (asked flag, recipe flag). ``words``: name -> (asked text,
    recipe text), satisfied when the recipe text holds the asked one.
    """
    checks = [F.when(asked.isNotNull(), F.when(F.coalesce(have, F.lit(False)) == asked, 1.0).otherwise(0.0)) for asked, have in flags.values()]
    checks += [
        F.when(text_or_empty(asked) != "", F.when(F.contains(F.lower(F.trim(text_or_empty(have))), F.lower(F.trim(asked))), 1.0).otherwise(0.0))
        for asked, have in words.values()
    ]
    asked = F.array_compact(F.array(*checks))
    total = F.aggregate(asked, F.lit(0.0), lambda a, s: a + s)
    return F.when(F.size(asked) == 0, 1.0).otherwise(rnd(total / F.nullif(F.size(asked), F.lit(0)), 4))


def hybrid_score(weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of the clamped pillars, 4 digits (G6); weights must sum to 1."""
    w = weights or rules.HYBRID_WEIGHTS
    if abs(sum(w.values()) - 1.0) > 1e-4 or any(not 0 <= v <= 1 for v in w.values()):
        raise ValueError(f"hybrid weights must lie in [0, 1] and sum to 1: {w}")
    column = {"similarity": "similarity_score", "ingredient": "ingredient_match_score", "nutrition": "nutrition_score", "preference": "preference_score"}
    return rnd(reduce(lambda a, b: a + b, [F.lit(w[k]) * clip01(F.col(c)) for k, c in column.items()]), 4)


def rank_hybrid(scored: DataFrame, k: int) -> DataFrame:
    """Top ``k`` per request by score, similarity, ingredient match and id."""
    order = [F.desc("hybrid_score"), F.desc("similarity_score"), F.desc("ingredient_match_score"), F.asc("recipe_id")]
    return top_k(scored, ["request_id"], order, k)


def score_candidates(candidates: DataFrame, requests: DataFrame, recipes: DataFrame, lines: DataFrame, nutrition: DataFrame, goals: dict[str, str], use_preferred: bool = False) -> DataFrame:
    """All four pillars and the hybrid score of each candidate.

    ``candidates`` carries request_id, recipe_id and similarity_score. Preferred
    ingredients enter the match score only with ``use_preferred``.
    """
    from larder.functions.text import diet_flags

    pref = "preferred" if use_preferred else "_no_preferred"
    meta = recipes.select(
        "recipe_id", "recipe_name", "cuisine", "region", "meal_type", "category", diet_flags("diet_type").alias("_diet")
    )
    asked = ["request_id", "required", "available", "preferred", "disliked", "vegetarian", "vegan", "want_cuisine", "want_meal", *goals.values()]
    rows = (
        candidates.join(requests.select(*dict.fromkeys(asked)), "request_id").join(meta, "recipe_id")
        .join(canonical_sets(lines), "recipe_id", "left").join(nutrition, "recipe_id", "left")
        .withColumn("_no_preferred", _none())
    )
    flags = {"vegetarian": (F.col("vegetarian"), F.col("_diet.vegetarian")), "vegan": (F.col("vegan"), F.col("_diet.vegan"))}
    words = {"cuisine": (F.col("want_cuisine"), F.col("cuisine")), "meal": (F.col("want_meal"), F.col("meal_type"))}
    rows = rows.withColumns(
        {
            "ingredient_match_score": ingredient_match("required", "available", pref, "disliked"),
            "nutrition_score": nutrition_score(goals),
            "nutrition_confidence": nutrition_confidence(),
            "preference_score": preference_score(flags, words),
            "matched_ingredients": F.array_sort(F.array_intersect(F.array_distinct(_list("available")), _list("canon_set"))),
            "missing_ingredients": F.array_sort(F.array_except(_list("canon_set"), _list("available"))),
        }
    )
    return rows.withColumn("hybrid_score", hybrid_score()).drop("_diet", "_no_preferred")


# ---------------------------------------------------------------- personalisation


def user_context(feedback: DataFrame, history: DataFrame, pantry: DataFrame, newest_first: Sequence[Column]) -> DataFrame:
    """Feedback sets by type, stocked pantry and the last 30 recommendations per user."""
    kinds = {"liked": "LIKE", "saved": "SAVE", "cooked": "COOKED", "disliked_recipes": "DISLIKE", "hidden": "HIDE"}
    sets = feedback.groupBy("user_id").agg(
        *[F.array_sort(F.collect_set(F.when(F.upper("feedback_type") == t, F.col("recipe_id")))).alias(n) for n, t in kinds.items()]
    )
    stocked = pantry.where(F.col("status") != "OUT_OF_STOCK").groupBy("user_id").agg(
        F.array_sort(F.collect_set(F.lower(F.trim("ingredient_name")))).alias("pantry")
    )
    recent = top_k(history, ["user_id"], newest_first, rules.RECENT_LIMIT, "_r").groupBy("user_id").agg(
        F.array_sort(F.collect_set("recipe_id")).alias("recent")
    )
    return sets.join(stocked, "user_id", "full").join(recent, "user_id", "full")


def personal_signals(rows: DataFrame) -> DataFrame:
    """Adds the signals of one candidate under one user's context.

    Reads ``item_set`` (recipe ingredient names), the context lists and
    ``pref_cuisine``/``pref_meal``; missing context leaves every signal 0.
    """
    def flag(c: str) -> Column:
        return F.coalesce(F.array_contains(c, F.col("recipe_id")), F.lit(False)).cast("double")

    def same(have: str, want: str) -> Column:
        return F.coalesce((F.lower(F.trim(have)) == F.lower(F.trim(want))) & (F.trim(have) != ""), F.lit(False)).cast("double")

    items = _list("item_set")
    overlap = F.size(F.array_intersect(items, _list("pantry")))
    kcal, protein = F.coalesce("per_serving_calories_kcal", F.lit(0.0)), F.coalesce("per_serving_protein_g", F.lit(0.0))
    over = F.when(kcal <= F.col("max_calories"), 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - (kcal - F.col("max_calories")) / F.col("max_calories")))
    parts = F.array_compact(
        F.array(
            F.when(F.col("calorie_target") > 0, F.greatest(F.lit(0.0), 1.0 - F.abs(kcal - F.col("calorie_target")) / F.col("calorie_target"))).when(F.col("max_calories") > 0, over),
            F.when(F.col("protein_target") > 0, F.greatest(F.lit(0.0), 1.0 - F.abs(protein - F.col("protein_target")) / F.greatest(F.col("protein_target"), F.lit(1.0)))),
        )
    )
    aligned = F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, s: a + s) / F.size(parts)).otherwise(0.0)
    return rows.withColumns(
        {
            "cuisine_affinity": same("cuisine", "pref_cuisine"),
            "meal_type_affinity": same("meal_type", "pref_meal"),
            "region_affinity": same("region", "pref_region"),
            "category_affinity": same("category", "pref_category"),
            "pantry_overlap_ratio": F.least(F.lit(1.0), overlap / F.greatest(F.size(items), F.lit(1))),
            "preferred_ingredient_match_count": F.size(F.array_intersect(items, _list("preferred"))),
            "disliked_ingredient_penalty": F.arrays_overlap(items, _list("disliked")).cast("double"),
            "past_liked": flag("liked"), "past_saved": flag("saved"), "past_cooked": flag("cooked"),
            "past_disliked": flag("disliked_recipes"), "past_hidden": flag("hidden"), "recently_recommended": flag("recent"),
            "nutrition_target_alignment": aligned,
        }
    )


def adjustment(weight: float = rules.PERSONAL_WEIGHT) -> Column:
    """Weighted signal sum, clipped to [-1, 1], times the weight."""
    gain = reduce(lambda a, b: a + b, [F.lit(w) * F.col(c) for c, w in rules.PERSONAL_GAINS.items()])
    preferred = F.least(F.col("preferred_ingredient_match_count") * rules.PREFERRED_STEP, F.lit(rules.PREFERRED_CAP)) * rules.PREFERRED_GAIN
    loss = reduce(lambda a, b: a + b, [F.lit(w) * F.col(c) for c, w in rules.PERSONAL_LOSSES.items()])
    return weight * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), gain + preferred - loss))


def rerank(scored: DataFrame, k: int) -> DataFrame:
    """Personalised order: score plus adjustment, then base score, then id.

    ``scored`` holds only candidates that passed the hard constraints, so
    personalisation can never bring a rejected recipe back. A request without a
    user (``user_id`` NULL) keeps its base order.
    """
    known = F.col("user_id").isNotNull()
    rows = scored.withColumn("personalization_score", F.when(known, adjustment()).otherwise(0.0))
    rows = rows.withColumn("final_score", F.when(known, F.greatest(F.lit(0.0), F.col("hybrid_score") + F.col("personalization_score"))).otherwise(F.col("hybrid_score")))
    order = [F.desc(F.round("final_score", 6)), F.desc(F.round("hybrid_score", 6)), F.when(known, F.lit(None)).otherwise(-F.col("similarity_score")).asc(),
             F.when(known, F.lit(None)).otherwise(-F.col("ingredient_match_score")).asc(), F.asc("recipe_id")]
    return top_k(rows, ["request_id"], order, k)


def explanation(rows: DataFrame) -> DataFrame:
    """Adds the recommendation sentence.

    Reads matched_ingredients, ``available``, query_name, similarity_score, the
    calorie and protein targets with their values, confidence and
    ``matched_preferences``.
    """
    total, hits = F.size(_list("available")), F.size(_list("matched_ingredients"))
    n = lambda c: c.cast("string")
    ingredient = (
        F.when((total > 0) & (hits == total), F.concat(F.lit("matches all "), n(total), F.lit(" of your available ingredients")))
        .when((total > 0) & (hits > 0), F.concat(F.lit("matches "), n(hits), F.lit(" of your "), n(total), F.lit(" available ingredients")))
        .when(total > 0, "offers a creative recipe alternative")
        .when(hits > 0, F.concat(F.lit("features key ingredients ("), F.array_join(F.slice("matched_ingredients", 1, 3), ", "), F.lit(")")))
    )
    s = F.col("similarity_score")
    band = (
        F.when(s >= 0.60, "very high culinary profile similarity").when(s >= 0.35, "high flavor and preparation similarity")
        .when(s >= 0.15, "complementary culinary style").otherwise("related flavor notes")
    )
    similar = F.when(F.col("query_name").isNotNull(), F.concat(F.lit("has "), band, F.lit(" to '"), "query_name", F.lit("'")))
    kcal, protein = F.col("per_serving_calories_kcal"), F.col("per_serving_protein_g")
    target, goal = F.col("calorie_target"), F.col("protein_target")
    food = (
        F.when(target.isNotNull() & kcal.isNotNull(), F.when(
            F.abs(kcal - target) <= 75, F.format_string("closely fits your target of %.0f kcal (~%.0f kcal/serving)", target.cast("double"), kcal.cast("double"))
        ).otherwise(F.format_string("provides ~%.0f kcal/serving toward your goal", kcal.cast("double"))))
        .when(goal.isNotNull() & protein.isNotNull(), F.when(
            protein >= goal, F.format_string("meets your protein goal with %.1fg protein/serving", protein.cast("double"))
        ).otherwise(F.format_string("supplies %.1fg protein/serving", protein.cast("double"))))
        .when((F.col("nutrition_confidence") >= 0.85) & kcal.isNotNull(), F.format_string("offers verified nutrition (%.0f kcal/serving)", kcal.cast("double")))
    )
    liked = F.when(F.size(_list("matched_preferences")) > 0, F.concat(F.lit("satisfies your "), F.array_join(F.slice("matched_preferences", 1, 2), ", "), F.lit(" preferences")))
    out = rows.withColumn("_why", F.array_compact(F.array(ingredient, similar, food, liked)))
    size = F.size("_why")
    joined = (
        F.when(size <= 2, F.array_join("_why", " and "))
        .otherwise(F.concat(F.array_join(F.slice("_why", F.lit(1), F.greatest(size - 1, F.lit(1))), ", "), F.lit(", and "), F.element_at("_why", -1)))
    )
    said = F.when(size == 0, F.format_string("Recommended with an overall hybrid match score of %.2f.", "hybrid_score")).otherwise(
        F.concat(F.lit("Recommended because it "), joined, F.lit(".")))
    return out.withColumn("explanation", said).drop("_why")


RECOMMENDATION_COLUMNS = [
    "rank", "recipe_id", "recipe_name", "hybrid_score", "similarity_score", "ingredient_match_score", "nutrition_score", "preference_score",
    "nutrition_confidence", "matched_ingredients", "missing_ingredients", "explanation",
]


def recommend(eligible: DataFrame, requests: DataFrame, recipes: DataFrame, lines: DataFrame, nutrition: DataFrame, goals: dict[str, str], k: int = 10) -> DataFrame:
    """Recommendation table of every request.

    ``eligible`` holds (request_id, recipe_id, similarity_score) of the candidates
    that passed the hard constraints, so filtering always precedes scoring.
    """
    from larder.operators.cleaning import approved_cuisine

    allowed = recipes.where(approved_cuisine("cuisine"))
    scored = score_candidates(eligible, requests, allowed, lines, nutrition, goals)
    top = rank_hybrid(scored, k)
    for c in ("query_name", "calorie_target", "protein_target"):
        if c not in top.columns:
            top = top.withColumn(c, F.lit(None).cast("string" if c == "query_name" else "double"))
    matched = F.array_compact(F.array(F.when(F.col("vegetarian"), "Vegetarian"), F.when(F.col("vegan"), "Vegan")))
    told = explanation(top.withColumn("matched_preferences", matched))
    return told.withColumns(
        {"matched_ingredients": F.array_join("matched_ingredients", ", "), "missing_ingredients": F.array_join("missing_ingredients", ", ")}
    ).select("request_id", *RECOMMENDATION_COLUMNS)


# ---------------------------------------------------------------- learning to rank


def ranking_features(rows: DataFrame) -> DataFrame:
    """The thirty model features in fixed order.

    ``rows`` joins candidate provenance (scores and ranks of both retrievers),
    request lists, recipe texts ``clean_items``, nutrition and diet statuses.
    """
    def z(c: str) -> Column:
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0))

    def rr(c: str) -> Column:
        return rnd(F.coalesce(1.0 / (F.col(c) + 1.0), F.lit(0.0)), 4)

    items = _list("clean_items")

    def found(c: str) -> Column:
        return F.size(F.filter(_list(c), lambda a: F.exists(items, lambda i: F.contains(i, F.lower(F.trim(a))))))

    total = F.greatest(F.lit(1), F.size(items))
    matched = found("available")
    cover = rnd(matched / total, 4)

    def has(want: str, have: str) -> Column:
        return F.coalesce((F.col(want) != "") & F.contains(F.lower(have), F.lower(want)), F.lit(False)).cast("double")

    def far(value: str, target: str, unit: float) -> Column:
        return rnd(F.coalesce(F.when(F.col(value) > 0, F.abs(F.col(value) - F.col(target)) / unit), F.lit(0.0)), 4)

    feature = {
        "retrieval_tfidf_score": rnd(z("tfidf_score"), 4), "retrieval_bge_score": rnd(z("semantic_score"), 4),
        "retrieval_tfidf_rr": rr("tfidf_rank"), "retrieval_bge_rr": rr("semantic_rank"),
        "retrieval_both": (F.col("tfidf_rank").isNotNull() & F.col("semantic_rank").isNotNull()).cast("double"),
        "ingredient_match_count": matched.cast("double"), "ingredient_total_count": total.cast("double"),
        "ingredient_coverage_ratio": cover, "pantry_coverage_ratio": rnd(F.coalesce("coverage_ratio", cover), 4),
        "required_ingredient_count": found("required").cast("double"), "preferred_ingredient_count": found("preferred").cast("double"),
        "canonical_match_count": F.size(F.array_intersect(_list("available"), _list("canon_set"))).cast("double"),
        "calorie_target_distance": far("per_serving_calories_kcal", "calorie_target", 500.0),
        "protein_target_distance": far("per_serving_protein_g", "protein_target", 20.0),
        "per_serving_calories": z("per_serving_calories_kcal"), "per_serving_protein_g": z("per_serving_protein_g"), "per_serving_carbs_g": z("per_serving_carbs_g"),
        "per_serving_fat_g": z("per_serving_fat_g"), "per_serving_fiber_g": z("per_serving_fiber_g"),
        "nutrition_available": F.col("per_serving_calories_kcal").isNotNull().cast("double"),
        **{f"{d}_compliant": F.coalesce(F.col(f"{d}_flag"), F.lit(False)).cast("double") for d in ("vegetarian", "vegan", "jain", "satvik")},
        "cuisine_match": has("want_cuisine", "cuisine"), "region_match": has("want_region", "region"),
        "meal_type_match": has("want_meal", "meal_type"), "category_match": has("want_category", "category"),
        "total_time_min": F.coalesce(F.col("total_time_min").cast("double"), F.lit(30.0)), "hard_constraint_violation": F.lit(0.0),
    }
    kept = [c for c in ("request_id", "recipe_id", "diet_ok") if c in rows.columns]
    return rows.select(*kept, *[feature[name].alias(name) for name in rules.FEATURE_NAMES])


def weak_label(tfidf: Column, dense: Column, both: Column, coverage: Column, diet_ok: Column) -> Column:
    """Weak grade 0 to 3 from retrieval agreement and coverage."""
    score = F.when(both, (tfidf + dense) / 2.0).otherwise(F.greatest(tfidf, dense))
    return (
        F.when(~diet_ok, 0).when((both | (score >= 0.45)) & (coverage >= 0.5), 3)
        .when((score >= 0.35) | (coverage >= 0.4), 2).when((score >= 0.15) | (coverage >= 0.2), 1).otherwise(0)
    )


def ranking_dataset(features: DataFrame) -> DataFrame:
    """Feature rows with their weak grade."""
    return features.withColumn(
        "relevance",
        weak_label(F.col("retrieval_tfidf_score"), F.col("retrieval_bge_score"), F.col("retrieval_both") == 1.0, F.col("ingredient_coverage_ratio"),
                   F.coalesce(F.col("diet_ok"), F.lit(True)) if "diet_ok" in features.columns else F.lit(True)),
    )


def query_group_split(content: Column, train: float = 0.70, val: float = 0.15) -> Column:
    """Split by the content of a query, so equal queries never part."""
    place = F.conv(F.substring(F.md5(content), 1, 6), 16, 10).cast("double") / float(16**6)
    return F.when(place < train, "train").when(place < train + val, "val").otherwise("test")


def train_ranker(train: DataFrame, label: str = "relevance", iterations: int = 10, depth: int = 4) -> PipelineModel:
    """Boosted trees on the grade (G20): pointwise, so not comparable to a listwise ranker."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    parts = VectorAssembler(inputCols=rules.FEATURE_NAMES, outputCol="features")
    trees = GBTRegressor(featuresCol="features", labelCol=label, predictionCol="model_score", maxIter=iterations, maxDepth=depth, seed=42)
    return Pipeline(stages=[parts, trees]).fit(train)


def rank_by_model(features: DataFrame, model: PipelineModel, hybrid: Column, k: int) -> DataFrame:
    """Model order with ties by dense score, lexical score and id.

    Falls back to the hybrid score for a whole request when any of its model
    scores is missing or not finite.
    """
    scored = model.transform(features).withColumn("_hybrid", hybrid)
    bad = F.col("model_score").isNull() | F.isnan("model_score") | (F.abs("model_score") == float("inf"))
    broken = scored.where(bad).select("request_id").distinct().withColumn("_broken", F.lit(True))
    rows = scored.join(broken, "request_id", "left")
    rows = rows.withColumn("rank_score", F.when(F.col("_broken"), F.col("_hybrid")).otherwise(F.col("model_score")))
    order = [F.desc("rank_score"), F.desc("retrieval_bge_score"), F.desc("retrieval_tfidf_score"), F.asc("recipe_id")]
    return top_k(rows, ["request_id"], order, k).select("request_id", "recipe_id", "rank_score", "rank")


def violation_count(recs: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Recommended rows that break a hard constraint; must be none."""
    bad = evaluated.where(~F.col("passed")).select("request_id", "recipe_id")
    return recs.join(bad, ["request_id", "recipe_id"], "left_semi").agg(F.count(F.lit(1)).alias("violations"))
