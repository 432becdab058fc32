"""N: nutrition over lineitem (lines), orders (recipes) and part (foods)."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import rules
from larder.functions.common import rnd
from larder.functions.quantity import normalize_unit, parse_quantity, water_grams
from larder.operators import nutrition as nut
from larder.plans.registry import Tables, query
from larder.plans.sqltext import has, in_list, q, quantity_status, quantity_value, sql_case, sql_round, unit_key

PARTS, TOTALS = nut.PARTS, nut.TOTALS


@query("N01_parse_quantity", f"SELECT quantity, {quantity_value('quantity')} AS value, {quantity_status('quantity')} AS status, count(*) AS n FROM lines GROUP BY quantity")
def n01(t: Tables):
    p = t.lines.groupBy("quantity").agg(F.count(F.lit(1)).alias("n")).select("quantity", "n", parse_quantity("quantity").alias("p"))
    return p.select("quantity", F.col("p.quantity").alias("value"), "p.status", "n")


@query("N02_normalize_unit", f"SELECT unit, {unit_key('unit')} AS unit_key, count(*) AS n FROM lines GROUP BY unit")
def n02(t: Tables):
    return t.lines.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).withColumn("unit_key", normalize_unit("unit"))


_FIXES = [(r"(?i)\b27\s*kg\b", "rice", "kg", "g"), (r"(?i)\b36\s*liter\b", "milk", "liter", "ml"), (r"(?i)\b45\s*kg\b", "chicken", "kg", "g")]
_HIT = "CASE " + " ".join(f"WHEN {has('original_ingredient', p)} AND contains(lower(original_ingredient), {q(w)}) AND {unit_key('unit')} = {q(u)} THEN {q(f)}" for p, w, u, f in _FIXES) + " END"


@query("N03_correct_units", f"""
SELECT original_ingredient, effective_unit, quality_status, count(*) AS n FROM (SELECT original_ingredient, coalesce(x, unit) AS effective_unit, CASE WHEN x IS NULL THEN 'ORIGINAL' ELSE 'CORRECTED_SOURCE_UNIT' END AS quality_status
  FROM (SELECT *, {_HIT} AS x FROM lines)) GROUP BY ALL""")
def n03(t: Tables):
    return nut.correct_units(t.lines, _FIXES).groupBy("original_ingredient", "effective_unit", "quality_status").agg(F.count(F.lit(1)).alias("n"))


MEASURES = "SELECT m.food_code, m.ord, n.description, m.weight FROM measure_rows m JOIN measure_names n ON m.measure_code = n.measure_code WHERE m.measure_type = 6"


def measures(t: Tables):
    return nut.household_measures(t.measure_rows, t.measure_names)


@query("N04_household_measures", f"SELECT food_code, ord, description, CAST(weight AS DOUBLE) AS weight FROM ({MEASURES})")
def n04(t: Tables):
    return measures(t).withColumn("weight", F.col("weight").cast("double"))


_LADDER = ", ".join(f"({q(u)}, {p}, {i}, {q('(?i)' + pat)}, CAST({f!r} AS DOUBLE))" for i, (u, p, pat, f) in enumerate(rules.MEASURE_LADDER))
CHOSEN = f"""
SELECT food_code, unit, min_by(CAST(weight AS DOUBLE) * factor, (prio, ord, step)) AS grams
FROM ({MEASURES}) JOIN (VALUES {_LADDER}) AS l(unit, prio, step, pat, factor)
ON regexp_matches(description, pat) AND (unit <> 'piece' OR NOT {has('description', '(?i)' + rules.CONTAINER_MEASURE)}) GROUP BY 1, 2"""


@query("N06_unit_ladders", f"SELECT food_code, unit, {sql_round('grams', 6)} AS grams FROM ({CHOSEN}) WHERE unit <> 'piece'")
def n06(t: Tables):
    return nut.unit_grams(measures(t)).where("unit <> 'piece'").withColumn("grams", rnd("grams", 6))


@query("N07_discrete_items", f"SELECT food_code, unit, {sql_round('grams', 6)} AS grams FROM ({CHOSEN}) WHERE unit = 'piece'")
def n07(t: Tables):
    return nut.unit_grams(measures(t)).where("unit = 'piece'").withColumn("grams", rnd("grams", 6))


_RULE = "CASE " + " ".join(f"WHEN canon = {q(p)} OR {has('said', chr(92) + 'b' + p + chr(92) + 'b')} THEN {q(c)}" for p, c, _, _ in rules.QUALITATIVE_RULES) + " END"


@query("N08_qualitative_rule", f"SELECT canon, said, {_RULE} AS cls FROM (SELECT DISTINCT ingredient AS canon, lower(original_ingredient || ' ' || preparation) AS said FROM lines WHERE {has('original_ingredient', rules.QUALITATIVE_PATTERN)})")
def n08(t: Tables):
    rows = t.lines.where(F.col("original_ingredient").rlike(rules.QUALITATIVE_PATTERN)).select(
        F.col("ingredient").alias("canon"), F.lower(F.concat_ws(" ", "original_ingredient", "preparation")).alias("said")).distinct()
    return rows.withColumn("cls", nut.qualitative_rule(F.col("canon"), F.col("said"))["cls"])


@query("N09_water_grams", f"SELECT quantity, unit, {sql_round(f'{quantity_value('quantity')} * {sql_case(unit_key('unit'), rules.WATER_GRAMS)}', 3)} AS grams, count(*) AS n FROM lines GROUP BY quantity, unit")
def n09(t: Tables):
    rows = t.lines.groupBy("quantity", "unit").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("grams", rnd(water_grams(parse_quantity("quantity")["quantity"], normalize_unit("unit")), 3))


PROFILES = "SELECT food_code, " + ", ".join(f"coalesce(max(CASE WHEN nutrient_code = {c} THEN CAST(amount AS DOUBLE) END), 0.0) AS {n}" for c, n in rules.CORE_NUTRIENTS.items()) + f" FROM nutrient_rows WHERE nutrient_code IN ({', '.join(rules.CORE_NUTRIENTS)}) GROUP BY 1"


def amounts(t: Tables):
    return t.nutrient_rows.withColumn("amount", F.col("amount").cast("double"))


@query("N10_nutrient_profiles", PROFILES)
def n10(t: Tables):
    return nut.nutrient_profiles(amounts(t))


@query("N11_scale_nutrients", f"SELECT l_orderkey, l_partkey, {sql_round('p_retailprice * l_quantity / 100', 3)} AS amount FROM lineitem JOIN part ON l_partkey = p_partkey")
def n11(t: Tables):
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return j.select("l_orderkey", "l_partkey", nut.scale(F.col("p_retailprice"), F.col("l_quantity")).alias("amount"))


_OV = sql_case("canon || '|' || unit_key", rules.MEASURE_OVERRIDES)
_POV = sql_case("canon || '|piece'", rules.MEASURE_OVERRIDES)
_ITEM = sql_case("canon", rules.ITEM_GRAMS)
_QUALCLS = "CASE " + " ".join(f"WHEN canon = {q(p)} OR {has('said', chr(92) + 'b' + p + chr(92) + 'b')} THEN {q(c)}" for p, c, _, _ in rules.QUALITATIVE_RULES) + " END"
GRAMS = f"""
SELECT *, CASE WHEN status = 'WATER' THEN qty * {sql_case('unit_key', rules.WATER_GRAMS)} WHEN status = 'ESTIMATED_QUALITATIVE' THEN {sql_round('tbsp', 3)}
   WHEN status = 'DIRECT_MASS' THEN qty * CASE unit_key WHEN 'kg' THEN 1000.0 ELSE 1.0 END WHEN status = 'CNF_MEASURE' THEN {sql_round('qty * per_unit', 3)} END AS grams0
FROM (SELECT *, CASE WHEN mq IN ('UNMAPPED', 'NO_MATCH') THEN mq WHEN water THEN 'WATER'
    WHEN qual THEN CASE WHEN cls = 'ZERO_CALORIE_QUALITATIVE' THEN cls WHEN cls = 'ESTIMABLE_QUALITATIVE' AND cnf_food_code IS NOT NULL AND tbsp IS NOT NULL THEN 'ESTIMATED_QUALITATIVE' ELSE 'QUALITATIVE_QUANTITY' END
    WHEN qty IS NULL THEN 'MISSING_QUANTITY' WHEN unit_key = 'inch' AND ov IS NULL THEN 'NEEDS_PROXY' WHEN unit_key IN ('sprig', 'bunch') THEN 'NEEDS_PROXY'
    WHEN unit_key IN ('g', 'kg') THEN 'DIRECT_MASS' WHEN coalesce(unit_key, '') <> 'inch' AND cnf_food_code IS NULL THEN 'NO_CNF_CONVERSION' WHEN per_unit IS NOT NULL THEN 'CNF_MEASURE' ELSE 'NO_CNF_CONVERSION' END AS status
  FROM (SELECT *, CASE WHEN unit_key = 'inch' THEN ov WHEN unit_key IN ('sprig', 'bunch') THEN NULL WHEN NOT has_measures THEN coalesce(ov, CASE WHEN step = 'piece' THEN item END)
        WHEN step = 'piece' THEN coalesce(item, measured, {_POV}, ov) ELSE coalesce(measured * CASE WHEN unit_key = 'liter' THEN 1000.0 ELSE 1.0 END, ov) END AS per_unit
    FROM (SELECT b.*, c.grams AS measured, tb.grams AS tbsp, hm.food_code IS NOT NULL AS has_measures, {_OV} AS ov, {_ITEM} AS item, {_QUALCLS} AS cls
      FROM (SELECT l.recipe_id, l.line_no, l.original_ingredient, l.ingredient, l.preparation, l.ingredient_id, l.canonical_ingredient, u.curation_status, u.cnf_food_code, u.cnf_food_name,
              coalesce(l.canonical_ingredient, '') AS canon, lower(l.original_ingredient || ' ' || l.preparation) AS said, {quantity_value('l.quantity')} AS qty, {quantity_status('l.quantity')} AS qstatus, {unit_key('l.unit')} AS unit_key,
              CASE WHEN {unit_key('l.unit')} = 'liter' THEN 'ml' ELSE coalesce({unit_key('l.unit')}, 'piece') END AS step,
              CASE WHEN l.mapping_status = 'REVIEW' OR l.ingredient_id IS NULL THEN 'UNMAPPED' ELSE coalesce(u.curation_status, 'NO_MATCH') END AS mq,
              coalesce(l.canonical_ingredient = 'water' OR l.ingredient_id = 'ING00126', FALSE) AS water,
              {has('l.original_ingredient', rules.QUALITATIVE_PATTERN)} OR {has('l.preparation', rules.QUALITATIVE_PATTERN)} AS qual
            FROM lines l LEFT JOIN curated u ON l.ingredient_id = u.ingredient_id) b
      LEFT JOIN ({CHOSEN}) c ON b.cnf_food_code = c.food_code AND b.step = c.unit LEFT JOIN ({CHOSEN}) tb ON b.cnf_food_code = tb.food_code AND tb.unit = 'tbsp'
      LEFT JOIN (SELECT DISTINCT food_code FROM ({MEASURES})) hm ON b.cnf_food_code = hm.food_code)))"""
_CUE = f"lower(regexp_extract(original_ingredient || ' ' || ingredient || ' ' || preparation, {q(rules.COOKED_CUE)}, 1))"
_YEXACT = sql_case("canon || '|' || cue", rules.YIELD_FACTORS)
_YCOOK = sql_case("canon || '|cooked'", rules.YIELD_FACTORS)
STATE = f"""
SELECT *, CASE WHEN NOT applies THEN 'MATCHED' WHEN cue = 'soaked' AND factor IS NOT NULL THEN 'SOAKING_YIELD_ESTIMATE' WHEN cue = 'soaked' THEN 'STATE_REVIEW_REQUIRED'
     WHEN factor IS NOT NULL THEN 'COOKING_YIELD_CONVERSION' ELSE 'STATE_MISMATCH' END AS state
FROM (SELECT *, CASE WHEN applies THEN CASE WHEN cue = 'soaked' THEN {_YEXACT} ELSE coalesce({_YEXACT}, {_YCOOK}) END END AS factor
  FROM (SELECT *, cue <> '' AND coalesce({has('cnf_food_name', rules.DRY_FOOD_CUE)}, FALSE) AND mq IN ('APPROVED', 'NEEDS_REVIEW') AND NOT water AS applies FROM (SELECT *, {_CUE} AS cue FROM ({GRAMS}))))"""
_COUNTED = "NOT water AND conversion_status <> 'ZERO_CALORIE_QUALITATIVE' AND nutrition_quality <> 'UNAVAILABLE'"
LINE = f"""
SELECT *, CASE WHEN water THEN 'APPROVED' ELSE mq END AS mapping_quality, {', '.join(f"CASE WHEN {_COUNTED} THEN {sql_round(f'p_{p} * grams / 100', 3)} ELSE 0.0 END AS {p}" for p in PARTS)}
FROM (SELECT *, CASE WHEN water OR conversion_status = 'ZERO_CALORIE_QUALITATIVE' THEN 'EXACT' WHEN conversion_status IN ('ESTIMATED_QUALITATIVE', 'COOKING_YIELD_CONVERSION', 'SOAKING_YIELD_ESTIMATE') AND measured_ok THEN 'APPROXIMATE'
        WHEN conversion_status IN ('DIRECT_MASS', 'CNF_MEASURE') AND measured_ok THEN CASE WHEN mq = 'NEEDS_REVIEW' THEN 'APPROXIMATE' ELSE 'EXACT' END ELSE 'UNAVAILABLE' END AS nutrition_quality
  FROM (SELECT s.*, coalesce(s.grams > 0, FALSE) AND p.food_code IS NOT NULL AS measured_ok, {', '.join(f'p.{x} AS p_{x}' for x in PARTS)}
    FROM (SELECT *, CASE WHEN state IN ('STATE_MISMATCH', 'STATE_REVIEW_REQUIRED') THEN NULL WHEN factor IS NOT NULL AND grams0 IS NOT NULL THEN {sql_round('grams0 * factor', 3)} ELSE grams0 END AS grams,
            CASE WHEN state IN ('STATE_MISMATCH', 'STATE_REVIEW_REQUIRED') OR (factor IS NOT NULL AND grams0 IS NOT NULL) THEN state ELSE status END AS conversion_status FROM ({STATE})) s
    LEFT JOIN ({PROFILES}) p ON s.cnf_food_code = p.food_code))"""


def food_table(t: Tables):
    return nut.food_table(t.curated, measures(t).withColumn("weight", F.col("weight").cast("double")), amounts(t))


def line_inputs(t: Tables):
    return t.lines.select("recipe_id", "line_no", "original_ingredient", "ingredient", "quantity", "unit", "preparation", "ingredient_id", "canonical_ingredient", "mapping_status")


def line_rows(t: Tables):
    return nut.line_nutrition(line_inputs(t), food_table(t))


@query("N05_grams_ladder", f"SELECT ingredient_id, original_ingredient, mq AS mapping_quality, status AS conversion_status, {sql_round('grams0', 3)} AS grams FROM ({GRAMS})")
def n05(t: Tables):
    rows = t.lines.select("original_ingredient", "preparation", "quantity", "unit", "ingredient_id", "canonical_ingredient", "mapping_status").join(food_table(t), "ingredient_id", "left")
    rows = rows.withColumns({
        "parsed_quantity": parse_quantity("quantity")["quantity"], "normalized_unit": normalize_unit("unit"),
        "mapping_quality": F.when((F.col("mapping_status") == "REVIEW") | F.col("ingredient_id").isNull(), "UNMAPPED").otherwise(F.coalesce("curation_status", F.lit("NO_MATCH")))})
    return nut.add_grams(rows).select("ingredient_id", "original_ingredient", "mapping_quality", "conversion_status", rnd("grams", 3).alias("grams"))


@query("N12_state_check", f"SELECT state AS state_status, canon AS canonical_ingredient, cue IS NOT NULL AS has_cue, count(*) AS n FROM ({STATE}) GROUP BY ALL")
def n12(t: Tables):
    return line_rows(t).groupBy("state_status", F.coalesce("canonical_ingredient", F.lit("")).alias("canonical_ingredient"), F.lit(True).alias("has_cue")).agg(F.count(F.lit(1)).alias("n"))


@query("N13_line_nutrition", f"SELECT recipe_id, original_ingredient, ingredient_id, qstatus AS quantity_parse_status, unit_key AS normalized_unit, {sql_round('grams', 3)} AS grams, conversion_status, state AS state_status, mapping_quality, nutrition_quality, {', '.join(PARTS)} FROM ({LINE})")
def n13(t: Tables):
    return line_rows(t).select("recipe_id", "original_ingredient", "ingredient_id", "quantity_parse_status", "normalized_unit", rnd("grams", 3).alias("grams"), "conversion_status", "state_status", "mapping_quality", "nutrition_quality", *PARTS)


_FAILST = in_list(rules.STATE_FAILURES)
_QS, _CF = in_list(rules.QUALITATIVE_STATUSES), in_list(rules.CONVERSION_FAILURES)
ROLL = f"""
SELECT r.recipe_id, r.recipe_name, r.servings, {', '.join(f'coalesce(s.total_{x}, 0.0) AS total_{x}' for x in TOTALS)},
  {', '.join(sql_round(f'coalesce(s.total_{x}, 0.0) / CASE WHEN r.servings > 0 THEN r.servings END', 3) + f' AS per_serving_{x}' for x in TOTALS)},
  CASE WHEN s.recipe_id IS NULL OR s.una > 0 THEN 'PARTIAL' WHEN s.app > 0 THEN 'APPROXIMATE' ELSE 'COMPLETE' END AS nutrition_quality,
  {', '.join(f'coalesce(s.{c}, 0) AS {c}' for c in ('ingredient_count', 'calculated_ingredient_count', 'unmapped_ingredient_count', 'no_match_ingredient_count', 'needs_review_ingredient_count', 'qualitative_quantity_count', 'conversion_failure_count', 'state_mismatch_count'))}
FROM recipes r LEFT JOIN (SELECT recipe_id, {', '.join(sql_round(f"sum(CASE WHEN nutrition_quality <> 'UNAVAILABLE' THEN {p} ELSE 0 END)", 3) + f' AS total_{x}' for p, x in zip(PARTS, TOTALS))},
   count(*) AS ingredient_count, count(*) FILTER (nutrition_quality <> 'UNAVAILABLE') AS calculated_ingredient_count, count(*) FILTER (mapping_quality = 'UNMAPPED') AS unmapped_ingredient_count,
   count(*) FILTER (mapping_quality = 'NO_MATCH') AS no_match_ingredient_count, count(*) FILTER (mapping_quality = 'NEEDS_REVIEW') AS needs_review_ingredient_count,
   count(*) FILTER (conversion_status IN {_QS}) AS qualitative_quantity_count, count(*) FILTER (conversion_status IN {_CF}) AS conversion_failure_count,
   count(*) FILTER (conversion_status NOT IN {_QS} AND conversion_status NOT IN {_CF} AND (conversion_status IN {_FAILST} OR state IN {_FAILST})) AS state_mismatch_count,
   count(*) FILTER (NOT water AND nutrition_quality = 'UNAVAILABLE') AS una, count(*) FILTER (NOT water AND nutrition_quality = 'APPROXIMATE') AS app
   FROM ({LINE}) GROUP BY recipe_id) s ON r.recipe_id = s.recipe_id"""


def recipe_nutrition(t: Tables):
    return nut.roll_up(t.recipes, line_rows(t))


@query("N14_recipe_rollup", ROLL)
def n14(t: Tables):
    return recipe_nutrition(t)


@query("N15_nutrition_pipeline", f"SELECT nutrition_quality, count(*) AS recipes, {sql_round('sum(total_calories_kcal)', 2)} AS calories, CAST(sum(ingredient_count) AS BIGINT) AS lines FROM ({ROLL}) GROUP BY 1")
def n15(t: Tables):
    _, recipes = nut.nutrition_pipeline(t.recipes, line_inputs(t), food_table(t))
    return recipes.groupBy("nutrition_quality").agg(F.count(F.lit(1)).alias("recipes"), rnd(F.sum("total_calories_kcal"), 2).alias("calories"), F.sum("ingredient_count").alias("lines"))


@query("N16_profile_algebra", f"SELECT a.food_code, {', '.join(sql_round(f'(a.{p} + a.{p}) / (f.p_size + 1)', 3) + f' AS {p}' for p in PARTS)} FROM ({PROFILES}) a JOIN foods f ON a.food_code = f.food_code")
def n16(t: Tables):
    rows = nut.nutrient_profiles(amounts(t)).join(t.foods.select("food_code", "p_size"), "food_code")
    cols = [F.col(p) for p in PARTS]
    return rows.select("food_code", *[c.alias(p) for c, p in zip(nut.divide_profile(nut.add_profiles(cols, cols), F.col("p_size") + 1), PARTS)])
