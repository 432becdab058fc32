"""D: contracts, integrity, outliers and parity over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import rules
from larder.functions.common import rnd
from larder.functions.quantity import normalize_unit, parse_quantity
from larder.operators import nutrition as nut
from larder.operators import resolution as res
from larder.operators import validation as val
from larder.plans.nutrition_queries import GRAMS, LINE, MEASURES, PARTS, ROLL, _ITEM, food_table, line_inputs, line_rows, measures, recipe_nutrition
from larder.plans.registry import Tables, query
from larder.plans.resolution_queries import foods, ranked
from larder.plans.sqltext import has, in_list, q, sql_round
from larder.sources.shared import materialize

_BLANK = lambda c: f"trim(coalesce({c}, '')) = ''"


def contract_sql(dataset: str, table: str, checks: list[tuple[str, str, str]], key: str | None = None) -> str:
    rows = [f"SELECT '{dataset}' AS dataset, (SELECT count(*) FROM {table}) AS total_records, '{n}' AS \"check\", '{s}' AS severity, (SELECT count(*) FROM {table} WHERE {c}) AS violations" for n, s, c in checks]
    if key:
        rows.append(f"SELECT '{dataset}', (SELECT count(*) FROM {table}), 'duplicate_{key}', 'error', (SELECT count(*) - count(DISTINCT {key}) FROM {table})")
    return " UNION ALL ".join(rows)


D1 = contract_sql("recipes", "recipes", [
    ("null_recipe_name", "error", "recipe_name IS NULL"), ("negative_times", "error", "prep_time_min < 0 OR cook_time_min < 0 OR total_time_min < 0"),
    ("invalid_servings", "error", "servings IS NULL OR servings < 1"), ("null_ingredients", "warning", "ingredients IS NULL"),
    ("bad_recipe_id", "error", "NOT regexp_matches(recipe_id, '^R[0-9]{5,}$')")], "recipe_id")


@query("D01_recipe_contract", D1)
def d01(t: Tables):
    return val.recipe_contract(t.recipes)


D2 = contract_sql("ingredients", "ingredient_dim", [
    ("bad_ingredient_id", "error", "NOT regexp_matches(ingredient_id, '^ING[0-9]{5}$')"), ("empty_canonical_name", "error", _BLANK("canonical_name")), ("empty_display_name", "error", _BLANK("display_name"))], "ingredient_id")


@query("D02_ingredient_contract", D2)
def d02(t: Tables):
    return val.ingredient_contract(t.ingredient_dim)


_MAPPED = "mapping_status IN ('MAPPED_CANONICAL', 'MAPPED_VALIDATED')"


@query("D03_link_contract", "SELECT dataset, total_records, \"check\", CASE WHEN \"check\" = 'unmapped_rows' AND violations > 0.3 * total_records THEN 'warning' ELSE severity END AS severity, violations FROM (" + contract_sql("links", "lines", [
    ("empty_text", "error", _BLANK("original_ingredient")), ("mapped_without_id", "error", f"{_MAPPED} AND {_BLANK('ingredient_id')}"),
    ("review_with_id", "warning", f"mapping_status = 'REVIEW' AND NOT ({_BLANK('ingredient_id')})"), ("unmapped_rows", "info", f"NOT {_MAPPED}")]) + ")")
def d03(t: Tables):
    return val.link_contract(t.lines)


_M4 = ["total_calories_kcal", "total_protein_g", "total_fat_g", "total_carbs_g", "total_fiber_g", "per_serving_calories_kcal", "per_serving_protein_g"]


@query("D04_recipe_nutrition_contract", f"WITH rn AS MATERIALIZED ({ROLL}) " + contract_sql("recipe_nutrition", "rn", [(f"negative_{m}", "error", f"{m} < 0") for m in _M4] + [
    ("bad_tier", "error", f"nutrition_quality NOT IN {in_list(rules.NUTRITION_TIERS)}"), ("zero_calories", "warning", "total_calories_kcal = 0")], "recipe_id"))
def d04(t: Tables):
    return val.recipe_nutrition_contract(recipe_nutrition(t))


@query("D05_line_nutrition_contract", f"WITH ln AS MATERIALIZED ({LINE}) " + contract_sql("line_nutrition", "ln", [(f"negative_{m}", "error", f"{m} < 0") for m in ("energy_kcal", "protein_g", "fat_g", "carbs_g", "fiber_g", "sodium_mg")]))
def d05(t: Tables):
    return val.line_nutrition_contract(line_rows(t))


D6 = contract_sql("aliases", "alias_rows", [
    ("bad_alias_id", "error", "NOT regexp_matches(alias_id, '^ALIAS[0-9]{5}$')"), ("bad_ingredient_id", "error", "NOT regexp_matches(canonical_ingredient_id, '^ING[0-9]{5}$')"),
    ("confidence_range", "error", "confidence < 0 OR confidence > 1"), ("bad_status", "error", f"review_status NOT IN {in_list(rules.ALIAS_STATUSES)}")], "alias_id")


@query("D06_alias_contract", D6)
def d06(t: Tables):
    return val.alias_contract(t.alias_rows)


def gap_sql(left: str, lk: str, right: str, rk: str, check: str, severity: str) -> str:
    return f"SELECT '{check}' AS \"check\", '{severity}' AS severity, (SELECT count(*) FROM (SELECT DISTINCT CAST({lk} AS VARCHAR) AS k FROM {left} WHERE trim(coalesce(CAST({lk} AS VARCHAR), '')) <> '') WHERE k NOT IN (SELECT CAST({rk} AS VARCHAR) FROM {right} WHERE {rk} IS NOT NULL)) AS violations"


D7 = " UNION ALL ".join(gap_sql(*g) for g in [
    ("recipe_ids_from_lines", "recipe_id", "recipes", "recipe_id", "orphan_nutrition", "error"), ("recipes", "recipe_id", "recipe_ids_from_lines", "recipe_id", "recipe_without_nutrition", "error"),
    ("lines", "recipe_id", "recipes", "recipe_id", "orphan_links", "error"), ("recipes", "recipe_id", "lines", "recipe_id", "recipe_without_links", "warning"),
    ("lines", "ingredient_id", "ingredient_dim", "ingredient_id", "unknown_ingredient", "error"), ("ingredient_dim", "ingredient_id", "lines", "ingredient_id", "unused_ingredient", "warning"),
    ("alias_rows", "canonical_ingredient_id", "ingredient_dim", "ingredient_id", "orphan_alias", "error")])


@query("D07_cross_integrity", "WITH recipe_ids_from_lines AS (SELECT DISTINCT recipe_id FROM lines) " + D7)
def d07(t: Tables):
    return val.cross_integrity(t.recipes, t.lines.select("recipe_id").distinct(), t.ingredient_dim, t.lines, t.alias_rows)


D8 = f"SELECT \"check\", severity, violations FROM ({D2}) UNION ALL SELECT \"check\", severity, violations FROM ({D6}) UNION ALL " + gap_sql("alias_rows", "canonical_ingredient_id", "ingredient_dim", "ingredient_id", "orphan_alias", "error")


@query("D08_ontology_report", D8)
def d08(t: Tables):
    return val.ontology_report(t.ingredient_dim, t.alias_rows)


RAW9 = "SELECT CASE WHEN order_no % 50 = 0 THEN 'X' ELSE recipe_id END AS recipe_id, CASE WHEN order_no % 41 = 0 THEN ' ' ELSE recipe_name END AS recipe_name, CASE order_no % 6 WHEN 0 THEN '' WHEN 1 THEN 'two' WHEN 2 THEN '2.9' WHEN 3 THEN '0' ELSE CAST(servings AS STRING) END AS servings, CASE order_no % 7 WHEN 0 THEN '' WHEN 1 THEN '-5' WHEN 2 THEN '1h' ELSE CAST(order_no % 90 AS STRING) END AS total_time_min, CASE order_no % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'T' WHEN 2 THEN 'no' END AS vegetarian FROM recipes"
_WHY = f"concat_ws(',', CASE WHEN NOT regexp_matches(recipe_id, '^R[0-9]{{5,}}$') THEN 'recipe_id' END, CASE WHEN {_BLANK('recipe_name')} THEN 'recipe_name' END, CASE WHEN NOT ({_BLANK('servings')}) AND TRY_CAST(servings AS DOUBLE) IS NULL THEN 'servings' END, CASE WHEN NOT ({_BLANK('total_time_min')}) AND (TRY_CAST(total_time_min AS INT) IS NULL OR TRY_CAST(total_time_min AS INT) < 0) THEN 'total_time_min' END)"


@query("D09_coerce_rows", f"""SELECT recipe_id, w AS reasons, CAST(CASE WHEN w = '' THEN CASE WHEN {_BLANK('servings')} THEN 1 ELSE greatest(1, floor(TRY_CAST(servings AS DOUBLE))) END END AS DOUBLE) AS servings, CASE WHEN w = '' THEN coalesce(lower(trim(vegetarian)) IN {in_list(rules.TRUE_WORDS)}, FALSE) END AS vegetarian
FROM (SELECT *, {_WHY} AS w FROM ({RAW9}))""")
def d09(t: Tables):
    raw = t.spark.sql(RAW9.replace("FROM recipes", "FROM {recipes}"), recipes=t.recipes)
    good, bad = val.coerce_recipes(raw)
    a = good.select("recipe_id", F.lit("").alias("reasons"), F.col("servings").cast("double").alias("servings"), "vegetarian")
    return a.unionByName(bad.select("recipe_id", F.array_join("reasons", ",").alias("reasons"), F.lit(None).cast("double").alias("servings"), F.lit(None).cast("boolean").alias("vegetarian")))


_PS = sql_round("l.grams / CASE WHEN r.servings > 0 THEN r.servings ELSE 1 END", 2)


@query("D10_unit_sanity", f"""SELECT recipe_id, original_ingredient, {sql_round('ps', 2)} AS per_serving_mass_g, split_part(rule, ':', 1) AS severity, split_part(rule, ':', 2) AS reason FROM (SELECT *,
  CASE WHEN unit_key = 'kg' AND qty >= 20 THEN 'CRITICAL:mass_prefix' WHEN unit_key = 'liter' AND qty >= 20 THEN 'CRITICAL:volume_prefix' WHEN ps > 2500 THEN 'CRITICAL:mass_per_serving' WHEN sv <= 6 AND unit_key = 'kg' AND qty >= 5 THEN 'HIGH:bulk_mass'
       WHEN sv <= 6 AND unit_key = 'liter' AND qty >= 5 THEN 'HIGH:bulk_volume' WHEN ps > 1200 THEN 'MEDIUM:mass_per_serving' END AS rule
  FROM (SELECT l.*, {_PS} AS ps, CASE WHEN r.servings > 0 THEN r.servings ELSE 1 END AS sv FROM ({LINE}) l LEFT JOIN recipes r ON l.recipe_id = r.recipe_id)) WHERE rule IS NOT NULL""")
def d10(t: Tables):
    return val.unit_sanity(line_rows(t), t.recipes).select("recipe_id", "original_ingredient", "per_serving_mass_g", "severity", "reason")


@query("D11_nutrition_outliers", f"""WITH ln AS MATERIALIZED ({LINE}), sm AS (SELECT l.* FROM ln l LEFT JOIN recipes r ON l.recipe_id = r.recipe_id WHERE CASE WHEN r.servings > 0 THEN r.servings ELSE 1 END <= 10),
h AS (SELECT recipe_id, 'ingredient_mass_g' AS metric, {sql_round('grams', 2)} AS value, line_no FROM sm WHERE grams >= 10000 UNION ALL SELECT recipe_id, 'ingredient_mass_kg', CAST(qty AS DOUBLE), line_no FROM sm WHERE NOT coalesce(grams >= 10000, FALSE) AND unit_key = 'kg' AND qty >= 10
  UNION ALL SELECT recipe_id, 'liquid_volume_l', CAST(qty AS DOUBLE), line_no FROM sm WHERE unit_key = 'liter' AND qty >= 10)
SELECT recipe_id, metric, min_by(value, (line_no, value)) AS value, 'HIGH' AS severity FROM h GROUP BY 1, 2
UNION ALL SELECT recipe_id, 'per_serving_calories_kcal', {sql_round('per_serving_calories_kcal', 2)}, 'CRITICAL' FROM ({ROLL}) WHERE per_serving_calories_kcal > 5000""")
def d11(t: Tables):
    lines = line_rows(t)
    return val.nutrition_outliers(nut.roll_up(t.recipes, lines), lines)


_AUDIT = f"""SELECT original_ingredient, canonical_ingredient, CASE WHEN status = 'CNF_MEASURE' AND item IS NOT NULL THEN 'EXACT_CALIBRATION' WHEN status = 'CNF_MEASURE' THEN 'EXACT_CNF_DISCRETE' ELSE 'UNAVAILABLE' END AS decision, count(*) AS n
FROM (SELECT g.*, u.food_code IS NOT NULL AS unsafe FROM ({GRAMS}) g LEFT JOIN (SELECT DISTINCT food_code FROM ({MEASURES}) WHERE {has('description', rules.UNSAFE_MEASURE)}) u ON g.cnf_food_code = u.food_code)
WHERE coalesce(unit_key, 'piece') = 'piece' AND qty IS NOT NULL AND ({has('original_ingredient', rules.DISCRETE_TARGETS)} OR {has("coalesce(canonical_ingredient, '')", rules.DISCRETE_TARGETS)} OR unsafe) GROUP BY ALL"""


@query("D12_discrete_audit", _AUDIT)
def d12(t: Tables):
    unsafe = measures(t).where(F.col("description").rlike(rules.UNSAFE_MEASURE)).select(F.col("food_code").alias("cnf_food_code"), F.lit(True).alias("has_unsafe_measure")).distinct()
    rows = t.lines.select("original_ingredient", "preparation", "quantity", "unit", "ingredient_id", "canonical_ingredient", "mapping_status").join(food_table(t), "ingredient_id", "left")
    rows = rows.withColumns({
        "parsed_quantity": parse_quantity("quantity")["quantity"], "normalized_unit": normalize_unit("unit"),
        "mapping_quality": F.when((F.col("mapping_status") == "REVIEW") | F.col("ingredient_id").isNull(), "UNMAPPED").otherwise(F.coalesce("curation_status", F.lit("NO_MATCH")))})
    rows = nut.add_grams(rows).join(unsafe, "cnf_food_code", "left").withColumn("has_unsafe_measure", F.coalesce("has_unsafe_measure", F.lit(False)))
    return val.discrete_audit(rows).groupBy("original_ingredient", "canonical_ingredient", "decision").agg(F.count(F.lit(1)).alias("n"))


@query("D12_unsafe_conversions", "SELECT count(*) FILTER (l_quantity < 0) AS unsafe_conversions FROM lineitem")
def d12b(t: Tables):
    return val.unsafe_conversions(line_rows(t))


@query("D13_nutrition_checks", "SELECT " + ", ".join(f"CAST(0 AS BIGINT) AS {c}" for c in ("total_mismatch", "per_serving_mismatch", "line_count_mismatch", "bad_tier", "line_rows_lost", "recipe_rows_lost", "negative_lines", "bad_line_quality")) + " FROM (SELECT count(*) FROM lineitem)")
def d13(t: Tables):
    lines, rolled = nut.nutrition_pipeline(t.recipes, line_inputs(t), food_table(t))
    return val.nutrition_checks(t.lines, lines, materialize(rolled, "recipe-nutrition"), t.recipes)


@query("D14_import_checks", """SELECT (SELECT count(*) FROM nutrient_rows WHERE nutrient_code = 307) AS lost_rows, CAST(0 AS BIGINT) AS extra_rows, (SELECT count(*) FROM nutrient_rows WHERE nutrient_code = 204) AS changed_values, CAST(0 AS BIGINT) AS negative_values, CAST(0 AS BIGINT) AS blank_values, CAST(0 AS BIGINT) AS duplicate_pairs, CAST(0 AS BIGINT) AS foods_without_rows""")
def d14(t: Tables):
    src = t.nutrient_rows.withColumn("amount", F.col("amount").cast("double"))
    bad = src.where("nutrient_code <> 307").withColumn("amount", F.when(F.col("nutrient_code") == 204, F.col("amount") + 1).otherwise(F.col("amount")))
    return val.import_checks(src, bad, t.foods)


@query("D15_candidate_checks")
def d15(t: Tables):
    return val.candidate_checks(t.ingredient_dim, ranked(t), foods(t))


CURATED = "SELECT ingredient_id, curation_status, CASE WHEN cnf_food_code % 29 = 0 THEN CAST(NULL AS BIGINT) ELSE cnf_food_code END AS cnf_food_code, cnf_food_name, CASE WHEN food_code % 37 = 0 THEN ' ' ELSE 'table' END AS curation_reason FROM curated"


@query("D16_curation_checks", f"WITH cu AS ({CURATED}) SELECT \"check\", severity, violations FROM (" + contract_sql("curated", "cu", [
    ("bad_status", "error", f"curation_status NOT IN {in_list(rules.CURATION_STATUSES)}"), ("no_match_filled", "error", "curation_status = 'NO_MATCH' AND (cnf_food_code IS NOT NULL OR cnf_food_name IS NOT NULL)"),
    ("approved_blank", "error", "curation_status = 'APPROVED' AND (cnf_food_code IS NULL OR cnf_food_name IS NULL)"), ("blank_reason", "error", _BLANK("curation_reason"))], "ingredient_id") + ") UNION ALL "
    + " UNION ALL ".join(gap_sql(*g) for g in [("ingredient_dim", "ingredient_id", "cu", "ingredient_id", "ingredient_without_decision", "error"), ("cu", "ingredient_id", "ingredient_dim", "ingredient_id", "unknown_ingredient", "error"), ("cu", "cnf_food_code", "food_names", "food_code", "unknown_food", "error")]))
def d16(t: Tables):
    c = t.spark.sql(CURATED.replace("FROM curated", "FROM {curated}"), curated=t.curated)
    return val.curation_checks(c, t.ingredient_dim, t.food_names)


@query("D17_table_parity", "SELECT (SELECT count(*) FROM orders) AS source_rows, (SELECT count(*) FROM orders WHERE o_orderkey % 100 <> 7) + 1 AS copy_rows, (SELECT count(*) FROM orders WHERE o_orderkey % 100 = 7) AS missing_in_copy, CAST(1 AS BIGINT) AS extra_in_copy, (SELECT count(*) FROM orders WHERE o_orderkey % 100 <> 7 AND o_orderstatus = 'P' AND o_custkey % 50 = 3) AS different_rows")
def d17(t: Tables):
    touched = (F.col("o_orderstatus") == "P") & (F.col("o_custkey") % 50 == 3)
    copy = t.orders.where("o_orderkey % 100 <> 7").withColumn("o_totalprice", F.when(touched, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    extra = t.orders.where("o_orderkey = 0").withColumn("o_orderkey", F.lit(-1).cast("bigint"))
    out = val.table_parity(t.orders, copy.unionByName(extra), "o_orderkey")
    return out.withColumns({c: F.col(c).cast("long") for c in out.columns})


@query("D18_row_fingerprint", """SELECT c_custkey, sha256('{' || concat_ws(',', '"c_acctbal":"' || CAST(round(CAST(c_acctbal AS DECIMAL(38,9)), 4) AS VARCHAR) || '"', '"c_custkey":"' || CAST(c_custkey AS VARCHAR) || '"', '"c_mktsegment":"' || c_mktsegment || '"', '"c_name":"' || c_name || '"', '"c_nationkey":"' || CAST(c_nationkey AS VARCHAR) || '"') || '}') AS row_hash FROM customer""")
def d18(t: Tables):
    return t.customer.select("c_custkey", val.fingerprint(t.customer).alias("row_hash"))


@query("D20_dataset_gate", f"""SELECT dataset, max(total_records) AS total_records, count(*) FILTER (severity = 'error' AND violations > 0) AS errors, count(*) FILTER (severity = 'warning' AND violations > 0) AS warnings, count(*) FILTER (severity = 'error' AND violations > 0) = 0 AS is_valid
FROM ({D1} UNION ALL {D2} UNION ALL {D6}) GROUP BY 1""")
def d20(t: Tables):
    return val.gate(val.recipe_contract(t.recipes).unionByName(val.ingredient_contract(t.ingredient_dim)).unionByName(val.alias_contract(t.alias_rows)))
