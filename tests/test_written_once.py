"""What several steps read is worked out once, and no task's share grows with the input."""

import re

from pyspark.sql import functions as F

from larder.functions.common import lookup
from larder.functions.quantity import parse_quantity
from larder.operators import constraints as con
from larder.operators import resolution as res
from larder.operators import retrieval as ret
from larder.plans import constraint_queries as cq
from larder.plans import validation_queries as vq
from larder.plans.registry import Tables


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_food_candidates_are_read_back(spark):
    ingredients = spark.createDataFrame(
        [("I1", "rice", "white rice", "default", "grain", ["old rice"]), ("I2", "zzz", "zzz", "default", "nut", [])],
        "ingredient_id string, canonical_name string, display_name string, ingredient_form string, category string, aliases array<string>")
    foods = spark.createDataFrame([(1, "Rice", []), (2, "Milk, whole", [])], "food_code long, food_name string, alternates array<string>")
    lines = spark.createDataFrame([("I1", "rice", "raw")], "ingredient_id string, ingredient string, preparation string")
    out = res.generate_food_candidates(ingredients, foods, lines)
    assert "Join" not in plan(out)
    assert {(r.ingredient_id, r.food_code, r.method) for r in out.collect()} == {("I1", 1, "EXACT_NAME"), ("I2", None, "NO_MATCH")}


def test_parsed_lines_are_read_back(spark):
    lines = spark.createDataFrame([("2 cups Rice - washed",), ("2 cups Rice - washed",), (None,)], "said string")
    canonical = spark.createDataFrame([("I1", "rice")], "ingredient_id string, canonical_name string")
    aliases = spark.createDataFrame([], "alias_id string, canonical_ingredient_id string, alias string, normalized_alias string, confidence double, review_status string")
    out = res.parse_and_resolve(lines, canonical, aliases, "said")
    assert "regexp_extract" not in plan(out)
    assert sorted((r.ingredient, r.ingredient_id, r.mapping_status) for r in out.collect() if r.said) == [("rice", "I1", "MAPPED_CANONICAL")] * 2


def test_nutrition_checks_parse_the_lines_once(spark):
    t = Tables(spark, "nowhere")
    t._cache.update(
        lines=spark.createDataFrame(
            [("R1", 1, "2 kg rice", "rice", "2", "kg", None, "I1", "rice", "MAPPED_CANONICAL"), ("R1", 2, "x", "x", None, None, None, None, None, None)],
            "recipe_id string, line_no int, original_ingredient string, ingredient string, quantity string, unit string, preparation string, "
            "ingredient_id string, canonical_ingredient string, mapping_status string"),
        recipes=spark.createDataFrame([("R1", "a", 2), ("R2", "b", 0)], "recipe_id string, recipe_name string, servings int"),
        curated=spark.createDataFrame([("I1", "APPROVED", 1, "rice, dry")], "ingredient_id string, curation_status string, cnf_food_code long, cnf_food_name string"),
        measure_rows=spark.createDataFrame([(1, 1, 1, 6, 10.0)], "food_code long, measure_code int, ord int, measure_type int, weight double"),
        measure_names=spark.createDataFrame([(1, "250ml")], "measure_code int, description string"),
        nutrient_rows=spark.createDataFrame([(1, 208, 100.0)], "food_code long, nutrient_code int, amount double"),
    )
    out = vq.d13(t)
    assert "RLIKE" not in plan(out)
    assert set(out.first()) == {0}


def test_a_looked_up_key_is_worked_out_once(spark):
    rows = spark.createDataFrame([("a",), ("B",), ("c",), (None,)], "x string")
    out = rows.select("x", lookup(F.upper("x"), {"A": 1, "B": 2}).alias("n"))
    assert plan(out).count("upper(") == 1
    assert [r.n for r in out.collect()] == [1, 2, None, None]


def test_a_quantity_is_cleaned_once(spark):
    rows = spark.createDataFrame([(" 1/2 ",), ("1 1/4",), ("nan",), ("some",), (None,)], "x string")
    out = rows.select(parse_quantity("x").alias("p"))
    assert plan(out).count("nan|none") == 1
    assert [r.p.quantity for r in out.collect()] == [0.5, 1.25, None, None, None]


def test_terms_are_counted_in_tasks_that_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(ret, "TASK_CHARS", 10)
    docs = spark.createDataFrame([(i, "rice dal and more rice") for i in range(20)], "doc_id long, text string")
    assert ret._by_document(docs, "doc_id", "text").rdd.getNumPartitions() == 44
    assert {r.df for r in ret.fit_tfidf(docs).terms.collect()} == {20}
    assert ret.fit_tfidf(docs.where("false")).terms.count() == 0


LINES = "recipe_id string, ingredient_id string, canonical_ingredient string, ingredient string, original_ingredient string, quantity string, l_quantity double, l_extendedprice double"


def test_candidates_are_checked_beside_their_recipe(spark):
    lists = ["allergens", "excluded", "required", "available", "preferred"]
    requests = spark.createDataFrame(
        [("Q1", None, True, ["Mace"], ["garlic"], ["rice", "milk"], ["rice"], ["onion"]), ("Q2", None, False, ["saffron"], None, None, None, None)],
        f"request_id string, vegan boolean, require_all boolean, {', '.join(f'{c} array<string>' for c in lists)}"
    ).withColumns({d: F.lit(None).cast("boolean") for d in ("vegetarian", "jain", "satvik")})
    recipes = spark.createDataFrame([("R1", "a", "Vegetarian", "salt, saffron water"), ("R2", "b", "Vegetarian", None)], "recipe_id string, recipe_name string, diet_type string, ingredients string")
    lines = spark.createDataFrame(
        [("R1", "I1", "rice", "Rice", "2 cups rice", "2", 1.0, 1.0), ("R1", None, None, "garlic", "garlic with MACE", None, 1.0, 1.0),
         ("R1", None, None, "garlic", "garlic with MACE", None, 1.0, 1.0), (None, "I2", "milk", "milk", "milk", None, 1.0, 1.0)], LINES)
    canonical = spark.createDataFrame([("I1", "rice", "grain"), ("I2", "milk", "dairy")], "ingredient_id string, canonical_name string, category string")
    aliases = spark.createDataFrame([], "alias_id string, canonical_ingredient_id string, alias string, normalized_alias string, confidence double, review_status string")
    nutrition = spark.createDataFrame([("R1", 100.0)], "recipe_id string, per_serving_calories_kcal double")
    candidates = spark.createDataFrame([("Q1", "R1"), ("Q1", "R1"), ("Q1", "R2"), ("Q1", "R9"), ("Q2", "R1"), ("Q2", None)], "request_id string, recipe_id string")
    out = con.evaluate(candidates, requests, con.recipe_evidence(recipes, lines, canonical), recipes, lines, nutrition, canonical, aliases, {})
    assert not re.search(r"Aggregate \[request_id#\d+, recipe_id#\d+\]", plan(out))
    rows = [(r.request_id, r.recipe_id, [f.kind for f in r.failures], r.matched_ingredients, r.missing_ingredients, r.coverage_ratio) for r in out.collect()]
    first = ("Q1", "R1", ["allergen", "excluded", "required", "required"], ["rice"], ["garlic"], 0.5)
    bare = ["required", "required"]
    assert sorted(rows, key=str) == sorted(
        [first, first, ("Q1", "R2", bare, None, None, None), ("Q1", "R9", bare, None, None, None), ("Q2", "R1", ["allergen"], [], ["garlic", "rice"], 0.0), ("Q2", None, [], None, None, None)], key=str)


def test_evaluation_and_nutrition_read_the_written_lines(spark):
    t = Tables(spark, "nowhere")
    lines = spark.createDataFrame([("R1", "I1", "rice", "rice", "rice", "2", 8.0, 200.0), ("R1", None, None, None, None, None, 4.0, 200.0)], LINES)
    t._cache["lines"] = lines.join(spark.createDataFrame([("R1",)], "recipe_id string").hint("merge"), "recipe_id")
    assert "Join" in plan(t.nutri)
    cq.write_lines(t)
    written = t.lines
    cq.write_lines(t)
    assert t.lines is written
    assert "Join" not in plan(t.nutri)
    assert [(r.per_serving_calories_kcal, r.ingredient_count, r.calculated_ingredient_count) for r in t.nutri.collect()] == [(2.0, 2, 1)]
