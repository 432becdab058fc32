from larder.operators import nutrition as nut

MEASURES = [
    (4471, 1, "250ml", 195.478), (3362, 1, "250ml", 154.269), (3381, 1, "250ml", 194.421), (7191, 1, "15ml", 13.82), (7191, 2, "5ml", 4.607),
    (1, 1, "1 can whole (100ml)", 90.0), (1, 2, "1 medium", 45.0), (2, 1, "125ml", 50.0), (2, 2, "250 ml chopped", 80.0),
]
# (canonical, food, quantity, unit, mapping quality, text) -> (grams, status)
CASES = [
    (("rice", 4471, 1.0, "cup", "APPROVED", "rice"), (195.478, "CNF_MEASURE")),
    (("dal", 3362, 1.0, "cup", "APPROVED", "dal"), (154.269, "CNF_MEASURE")),
    (("dal", 3381, 1.0, "cup", "APPROVED", "dal"), (194.421, "CNF_MEASURE")),
    (("sunflower oil", 7191, 1.0, "tbsp", "APPROVED", "oil"), (13.82, "CNF_MEASURE")),
    (("sunflower oil", 7191, 1.0, "tsp", "APPROVED", "oil"), (4.607, "CNF_MEASURE")),
    (("rice", 4471, 150.0, "g", "APPROVED", "rice"), (150.0, "DIRECT_MASS")),
    (("rice", 4471, 1.5, "kg", "APPROVED", "rice"), (1500.0, "DIRECT_MASS")),
    (("paneer", 4471, None, None, "NO_MATCH", "x"), (None, "NO_MATCH")),
    ((None, None, 1.0, "g", "UNMAPPED", "x"), (None, "UNMAPPED")),
    (("water", None, 2.0, "cup", "APPROVED", "water"), (500.0, "WATER")),
    (("black pepper", 9, 3.0, None, "APPROVED", "3 whole black peppercorns"), (0.15, "CNF_MEASURE")),
    (("almond", 1, 30.0, None, "APPROVED", "30 almonds"), (36.0, "CNF_MEASURE")),
    (("tomato", 1, 3.0, "piece", "APPROVED", "3 tomatoes"), (369.0, "CNF_MEASURE")),
    (("green chilli", 1, 1.0, None, "APPROVED", "1 green chilli"), (45.0, "CNF_MEASURE")),
    (("ghee", 9, 2.0, "tbsp", "APPROVED", "2 tbsp ghee"), (25.6, "CNF_MEASURE")),
    (("ghee", 2, 2.0, "tbsp", "APPROVED", "2 tbsp ghee"), (9.6, "CNF_MEASURE")),
    (("ginger", 1, 1.0, "inch", "APPROVED", "1 inch ginger"), (5.0, "CNF_MEASURE")),
    (("potato", 1, 1.0, "inch", "APPROVED", "1 inch potato"), (None, "NEEDS_PROXY")),
    (("mint", 1, 1.0, "sprig", "APPROVED", "1 sprig mint"), (None, "NEEDS_PROXY")),
    (("salt", 1, None, None, "APPROVED", "Salt - to taste"), (None, "ZERO_CALORIE_QUALITATIVE")),
    (("sunflower oil", 7191, None, None, "APPROVED", "oil - as required"), (13.82, "ESTIMATED_QUALITATIVE")),
    (("sugar", 1, None, None, "APPROVED", "a pinch sugar"), (None, "QUALITATIVE_QUANTITY")),
    (("raisin", 8, 10.0, None, "APPROVED", "10 raisins"), (None, "NO_CNF_CONVERSION")),
    (("onion", 1, None, "cup", "APPROVED", "onion"), (None, "MISSING_QUANTITY")),
]


def test_grams_ladder(spark):
    measures = spark.createDataFrame(MEASURES, "food_code long, ord int, description string, weight double")
    table = nut.measure_map(measures)
    rows = [(i, *c) for i, (c, _) in enumerate(CASES)]
    lines = spark.createDataFrame(
        rows, "i int, canonical_ingredient string, cnf_food_code long, parsed_quantity double, normalized_unit string, mapping_quality string, original_ingredient string"
    ).selectExpr("*", "'' AS preparation", "'ING00001' AS ingredient_id")
    out = nut.add_grams(lines.join(table.withColumnRenamed("food_code", "cnf_food_code"), "cnf_food_code", "left")).collect()
    got = {r["i"]: (r["grams"], r["conversion_status"]) for r in out}
    for i, (case, want) in enumerate(CASES):
        assert got[i] == want, (case, got[i])


def test_ladder_prefers_priority_then_file_order(spark):
    measures = spark.createDataFrame([(1, 1, "125ml", 50.0), (1, 2, "250 ml chopped", 80.0), (1, 3, "250ml", 90.0), (2, 1, "100ml", 40.0), (2, 2, "125ml", 50.0)],
                                     "food_code long, ord int, description string, weight double")
    got = {(r.food_code, r.unit): r.grams for r in nut.unit_grams(measures).collect()}
    assert got[(1, "cup")] == 90.0 and got[(2, "cup")] == 100.0


def test_roll_up_tiers(spark):
    recipes = spark.createDataFrame([("R1", "a", 2), ("R2", "b", 0), ("R3", "c", 4)], "recipe_id string, recipe_name string, servings int")
    zero = ", ".join(f"{p} double" for p in nut.PARTS[1:])
    schema = f"recipe_id string, canonical_ingredient string, ingredient_id string, mapping_quality string, conversion_status string, state_status string, nutrition_quality string, energy_kcal double, {zero}"
    row = lambda r, c, q, k: (r, c, "X", "APPROVED", "CNF_MEASURE", "MATCHED", q, k, *[0.0] * 6)
    lines = spark.createDataFrame([row("R1", "rice", "EXACT", 100.0), row("R1", "oil", "APPROXIMATE", 50.0), row("R2", "rice", "EXACT", 10.0), row("R2", "water", "UNAVAILABLE", 0.0)], schema)
    got = {r.recipe_id: r for r in nut.roll_up(recipes, lines).collect()}
    assert (got["R1"].nutrition_quality, got["R1"].total_calories_kcal, got["R1"].per_serving_calories_kcal) == ("APPROXIMATE", 150.0, 75.0)
    assert (got["R2"].nutrition_quality, got["R2"].per_serving_calories_kcal) == ("COMPLETE", None)
    assert (got["R3"].nutrition_quality, got["R3"].ingredient_count) == ("PARTIAL", 0)
