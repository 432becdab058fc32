"""Recipe-world relations derived from the given star-schema tables.

The operators take recipe, ingredient, request and event tables. The given
tables hold none of these, so each relation below re-reads a whole given table
as one of them: orders as recipes, line items as ingredient lines, parts as
foods, customers as requests, events as feedback. The text is plain SQL that
Spark and DuckDB both run, so the operator and its SQL twin start from equal
rows. Every relation grows with the table it reads.
"""

from __future__ import annotations

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

FOOD_WORD = {
    "anvil": "chicken", "bolt": "onion", "gear": "milk", "gizmo": "garlic",
    "plate": "rice", "ring": "almond", "rod": "moong dal", "widget": "water",
}
PREP_WORD = {
    "blue": "fresh", "cold": "finely chopped", "hot": "boiled", "large": "soaked",
    "new": "raw", "old": "to taste", "red": "cooked", "small": "sliced",
}
FOOD_CATEGORY = {
    "anvil": "meat", "bolt": "vegetable", "gear": "dairy", "gizmo": "vegetable",
    "plate": "grain", "ring": "nut", "rod": "pulse", "widget": "liquid",
}
UNIT_WORD = {
    0: "cups", 1: "tbsp", 2: "Teaspoon", 3: "grams", 4: "kg", 5: "ml",
    6: "liter", 7: "cloves", 8: "piece", 9: None, 10: "inch", 11: "sprig", 12: "handful",
}
TITLE = {
    0: "Chicken Biryani", 1: "No Onion No Garlic Paneer", 2: "Eggless Omelette Cake",
    3: "Mock Chicken Curry", 4: "Eggplant Bharta", 5: "Meat Masala Powder Rice",
    6: "One Pot Pav Bhaji Recipe Using Preethi Electric Pressure Cooker",
    7: "Coconut Meat Ladoo", 8: "Potato Egg Roast", 9: "Mint Chutney, side dish for fish",
    10: "Apple Lunch Box - Kids Recipes Made With Del Monte", 11: "Turkey Berry Kuzhambu",
    12: "Almond  Milk   Kheer",
}
CUISINE = {
    0: "  North   Indian Recipes ", 1: "Udupi", 2: "Chinese", 3: "Fusion", 4: "Punjabi",
    5: None, 6: "Indo Chinese", 7: "Bengali Recipes",
}
DIET = {
    0: "Vegetarian", 1: "Non Vegeterian", 2: "Vegan", 3: "Sattvic (No Onion No Garlic)",
    4: "Eggetarian", 5: "High Protein Vegetarian", 6: "Diabetic Friendly",
}
COURSE = {
    "1-URGENT": "Breakfast", "2-HIGH": "Lunch", "3-MEDIUM": "Dinner",
    "4-NOT SPECIFIED": "Snack", "5-LOW": "Dessert",
}
LINE_TEXT = {
    0: "2-1 / 2 tablespoons Red Chilli powder - roasted, 1/2 tsp Turmeric powder (Haldi), Salt - to taste",
    1: "3 cups Rice - washed and soaked, , 1.5 liter Water , 4 Cloves Garlic - finely chopped",
    2: "Pinch Asafoetida (hing), 1 inch Ginger, 10 Cashew nuts, 200 grams Paneer - cubed",
    3: "12 inches Sugarcane, 2 bunches Spinach Leaves (Palak), Curry leaves - as required.",
    4: "Roasted Peanuts (Moongphali), 1-1/2 teaspoons Cumin seeds (Jeera), 2 Eggs",
}
ALLERGEN = {"AUTOMOBILE": "dairy", "BUILDING": "tree_nut, gluten", "FURNITURE": "", "HOUSEHOLD": "peanut", "MACHINERY": "chicken"}
EXCLUDED = {"AUTOMOBILE": "garlic", "BUILDING": "", "FURNITURE": "onions", "HOUSEHOLD": "raw milk", "MACHINERY": ""}
REQUIRED = {"AUTOMOBILE": "", "BUILDING": "rice", "FURNITURE": "", "HOUSEHOLD": "", "MACHINERY": "onion, moong dal"}
PANTRY = {"AUTOMOBILE": "onion, chopped garlic, rice", "BUILDING": "milk", "FURNITURE": "almonds, water", "HOUSEHOLD": "", "MACHINERY": "moong dal, fresh chicken, salt"}
FEEDBACK = {"purchase": "COOKED", "click": "LIKE", "view": None, "error": "HIDE", "signup": "save"}


def _case(expr: str, table: dict, default: str = "NULL") -> str:
    def lit(v: object) -> str:
        if v is None:
            return "CAST(NULL AS STRING)"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    arms = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items())
    return f"CASE {expr} {arms} ELSE {default} END"


def _id(prefix: str, expr: str) -> str:
    text = f"CAST({expr} AS STRING)"
    return f"'{prefix}' || CASE WHEN {expr} < 100000 THEN lpad({text}, 5, '0') ELSE {text} END"


_NOUN = "split_part(p_name, ' ', 2)"
_ADJ = "split_part(p_name, ' ', 1)"

BASE: dict[str, str] = {}

BASE["foods"] = f"""
SELECT p_partkey AS food_code, {_id('ING', 'p_partkey')} AS ingredient_id, p_name, p_type, p_size,
       p_retailprice, CAST(substr(p_brand, 7) AS INT) AS brand_no,
       {_case(_NOUN, FOOD_WORD)} AS food, {_case(_ADJ, PREP_WORD)} AS prep,
       {_case(_NOUN, FOOD_CATEGORY)} AS category
FROM part
"""

_Q = "CAST(l_quantity AS INT)"
BASE["lines"] = f"""
SELECT {_id('R', 'l_orderkey')} AS recipe_id, l_orderkey AS order_no, l_linenumber AS line_no,
       q.quantity, q.unit, f.food AS ingredient, f.prep AS preparation,
       coalesce(q.quantity || ' ', '') || coalesce(q.unit || ' ', '') || f.food || ' - ' || f.prep AS original_ingredient,
       CASE WHEN q.mapping_status = 'REVIEW' THEN CAST(NULL AS STRING) ELSE f.ingredient_id END AS ingredient_id,
       CASE WHEN q.mapping_status = 'REVIEW' THEN CAST(NULL AS STRING) ELSE f.food END AS canonical_ingredient,
       CASE WHEN q.mapping_status = 'REVIEW' THEN CAST(NULL AS STRING) ELSE f.category END AS category,
       q.mapping_status, f.food_code, q.l_partkey, q.l_suppkey, q.l_quantity, q.l_extendedprice
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
        CASE {_Q} % 9 WHEN 0 THEN CAST({_Q} AS STRING) WHEN 1 THEN '1/2' WHEN 2 THEN CAST({_Q} AS STRING) || ' 1/4'
             WHEN 3 THEN '1-1/2' WHEN 4 THEN '11/2' WHEN 5 THEN CAST(NULL AS STRING)
             WHEN 6 THEN CAST({_Q} AS STRING) || '.5' WHEN 7 THEN 'some' ELSE '-' || CAST({_Q} AS STRING) END AS quantity,
        {_case('l_suppkey % 13', UNIT_WORD)} AS unit,
        CASE WHEN l_returnflag = 'A' THEN 'MAPPED_CANONICAL' WHEN l_linestatus = 'O' AND l_tax < 0.035 THEN 'REVIEW'
             ELSE 'MAPPED_VALIDATED' END AS mapping_status
      FROM lineitem) AS q
JOIN foods AS f ON q.l_partkey = f.food_code
"""

BASE["recipes"] = f"""
SELECT o_orderkey AS order_no, o_custkey AS cust_no, {_id('R', 'o_orderkey')} AS recipe_id,
       {_case('o_orderkey % 13', TITLE)} AS recipe_name, {_case('o_custkey % 8', CUISINE)} AS cuisine,
       CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Region ' || CAST(o_custkey % 5 AS STRING) END AS region,
       {_case('o_orderpriority', COURSE)} AS meal_type,
       CASE WHEN o_orderkey % 2 = 0 THEN {_case('o_orderpriority', COURSE)} ELSE 'Main' END AS category,
       {_case('(o_orderkey + o_custkey) % 7', DIET)} AS diet_type,
       {_case('(o_orderkey + o_custkey) % 5', LINE_TEXT)} AS ingredients,
       CAST(o_custkey % 9 AS INT) AS servings, CAST(o_orderkey % 70 AS INT) AS prep_time_min,
       CAST(o_custkey % 50 AS INT) - 1 AS cook_time_min,
       CASE WHEN o_orderkey % 17 = 0 THEN CAST(NULL AS INT) ELSE CAST(o_orderkey % 70 + o_custkey % 50 AS INT) END AS total_time_min,
       o_totalprice, o_orderstatus
FROM orders
"""

BASE["curated"] = """
SELECT ingredient_id, food_code,
       CASE brand_no % 5 WHEN 0 THEN 'NO_MATCH' WHEN 1 THEN 'NEEDS_REVIEW' ELSE 'APPROVED' END AS curation_status,
       CASE WHEN brand_no % 5 = 0 THEN CAST(NULL AS BIGINT) ELSE food_code END AS cnf_food_code,
       CASE WHEN brand_no % 5 = 0 THEN CAST(NULL AS STRING) WHEN p_size % 2 = 0 THEN food || ', dry, raw' ELSE food || ', prepared' END AS cnf_food_name
FROM foods
"""

BASE["measure_rows"] = f"""
SELECT food_code, measure_code, ord, CASE WHEN (brand_no + ord) % 7 = 0 THEN 2 ELSE 6 END AS measure_type, p_size + ord * 1.5 AS weight
FROM (SELECT food_code, brand_no, p_size, ord, (food_code + ord * brand_no) % 12 AS measure_code
      FROM foods JOIN (VALUES (1, 1), (1, 2), (1, 3), (1, 4)) AS m(k, ord) ON m.k = CASE WHEN p_size > 0 THEN 1 ELSE 0 END) AS x
"""

MEASURE_NAME = {
    0: "250ml", 1: "250 ml chopped", 2: "125ml", 3: "100ml", 4: "15ml", 5: "5 ml", 6: "1 medium (6cm)",
    7: "1 clove", 8: "1 large", 9: "1 slice", 10: "1 fruit", 11: "1 can whole (100ml)",
}
BASE["measure_names"] = f"""
SELECT DISTINCT CAST(p_partkey % 12 AS INT) AS measure_code, {_case('CAST(p_partkey % 12 AS INT)', MEASURE_NAME)} AS description FROM part
"""

BASE["nutrient_rows"] = """
SELECT food_code, code AS nutrient_code, (p_size * 7 + code * 3 + food_code % 13) % 97 + 0.25 AS amount
FROM foods JOIN (VALUES (1, 203), (1, 204), (1, 205), (1, 208), (1, 269), (1, 291), (1, 307), (1, 999)) AS n(k, code) ON n.k = CASE WHEN p_size > 0 THEN 1 ELSE 0 END
WHERE (food_code + code) % 19 <> 0
"""

BASE["requests"] = f"""
SELECT c_custkey AS cust_no, 'Q' || CAST(c_custkey AS STRING) AS request_id, c_mktsegment AS segment, c_nationkey,
       CASE WHEN c_custkey % 3 = 0 THEN TRUE END AS vegetarian, CASE WHEN c_custkey % 5 = 0 THEN TRUE END AS vegan,
       CASE WHEN c_custkey % 7 = 0 THEN TRUE END AS jain, CASE WHEN c_custkey % 11 = 0 THEN TRUE END AS satvik,
       {_case('c_mktsegment', ALLERGEN)} AS allergens, {_case('c_mktsegment', EXCLUDED)} AS excluded,
       {_case('c_mktsegment', REQUIRED)} AS required, {_case('c_mktsegment', PANTRY)} AS available,
       CASE WHEN c_custkey % 4 = 0 THEN 'onion, milk' ELSE '' END AS preferred,
       CASE WHEN c_custkey % 6 = 0 THEN 'garlic' ELSE '' END AS disliked,
       CASE WHEN c_custkey % 13 = 0 THEN TRUE ELSE FALSE END AS require_all,
       CASE WHEN c_custkey % 2 = 0 THEN 900.0 + c_custkey % 700 END AS max_calories,
       CASE WHEN c_custkey % 9 = 0 THEN 5.0 END AS min_protein,
       CASE WHEN c_custkey % 4 = 1 THEN 400.0 + c_custkey % 300 END AS calorie_target,
       CASE WHEN c_custkey % 8 = 3 THEN 20.0 + c_custkey % 30 END AS protein_target,
       CASE WHEN c_custkey % 3 = 1 THEN 'punjabi' END AS want_cuisine,
       CASE WHEN c_custkey % 4 = 2 THEN 'dinner' END AS want_meal,
       CASE WHEN c_custkey % 10 = 0 THEN 60 END AS max_total_time
FROM customer
"""

BASE["candidates"] = """
SELECT r.request_id, r.cust_no, o.recipe_id, o.order_no,
       CAST((o.order_no * 37 + r.cust_no * 11) % 1000 AS DOUBLE) / 1000.0 AS similarity_score
FROM requests AS r JOIN recipes AS o ON r.cust_no = o.cust_no
"""

BASE["interactions"] = f"""
SELECT 'S' || CAST(user_id AS STRING) || '-' || CAST(day_key AS STRING) AS session_id, user_id,
       'R' || CAST(event_id % 97 AS STRING) AS recipe_id, event_id, ts, value,
       CAST(event_id % 12 AS INT) + 1 AS position,
       {_case('event_type', FEEDBACK)} AS feedback_type, day_key
FROM (SELECT event_id, ts, user_id, event_type, value, CAST(extract(DAY FROM ts) AS INT) + 100 * CAST(extract(MONTH FROM ts) AS INT) + 10000 * CAST(extract(YEAR FROM ts) AS INT) AS day_key FROM events) AS e
"""

# candidate phrase -> canonical mapping rows, one per (part name, brand)
BASE["mapping"] = """
SELECT p_name || ' ' || CAST(brand_no AS STRING) AS candidate_ingredient, p_name AS cleaned_candidate,
       food || ' ' || CAST(brand_no AS STRING) AS normalized_candidate, brand_no, food, prep, count(*) AS frequency,
       CASE brand_no % 7 WHEN 0 THEN '' WHEN 1 THEN food || prep WHEN 2 THEN 'creamfresh' ELSE food END AS canonical,
       CASE prep WHEN 'cooked' THEN '' WHEN 'to taste' THEN 'default' WHEN 'finely chopped' THEN 'default' WHEN 'sliced' THEN 'powder' ELSE prep END AS form,
       CASE WHEN brand_no % 7 = 0 THEN 'REVIEW' ELSE 'AUTO' END AS status
FROM foods GROUP BY p_name, brand_no, food, prep
"""

# phrases to resolve: what people type for a food
BASE["phrases"] = """
SELECT food_code, CASE food_code % 8 WHEN 0 THEN food WHEN 1 THEN 'chopped ' || food WHEN 2 THEN 'Fresh ' || food || ' (organic)'
       WHEN 3 THEN '2 cups ' || food || 's' WHEN 4 THEN food || ' boiled' WHEN 5 THEN p_name WHEN 6 THEN 'finely chopped ' || p_name ELSE 'unknown thing' END AS phrase
FROM foods
"""

BASE["canon"] = """
SELECT 'ING' || lpad(CAST(dense AS STRING), 5, '0') AS ingredient_id, food AS canonical_name, 'Fine ' || food AS display_name, category, 'default' AS ingredient_form
FROM (SELECT food, category, CASE food WHEN 'almond' THEN 1 WHEN 'chicken' THEN 2 WHEN 'garlic' THEN 3 WHEN 'milk' THEN 4 WHEN 'moong dal' THEN 5 WHEN 'onion' THEN 6 WHEN 'rice' THEN 7 ELSE 8 END AS dense FROM foods GROUP BY food, category) AS c
"""

BASE["alias_rows"] = """
SELECT 'ALIAS' || lpad(CAST(n AS STRING), 5, '0') AS alias_id, c.ingredient_id AS canonical_ingredient_id, a.p_name AS alias, a.p_name AS normalized_alias,
       CASE WHEN a.n % 5 = 0 THEN 0.5 ELSE 0.95 END AS confidence, CASE WHEN a.n % 7 = 0 THEN 'REJECTED' ELSE 'VALIDATED' END AS review_status
FROM (SELECT p_name, food, min(food_code) AS n FROM foods GROUP BY p_name, food) AS a JOIN canon AS c ON a.food = c.canonical_name
"""

BASE["food_names"] = """
SELECT food_code, CASE p_type WHEN 'PROMO' THEN 'Soup, ' || food WHEN 'LARGE' THEN 'Spices, ' || food || ', ' || prep
       WHEN 'STANDARD' THEN p_name || ', ' || food WHEN 'MEDIUM' THEN food || ' powder, dried' WHEN 'SMALL' THEN 'Vegetable, ' || p_name || ', raw' ELSE food || ', ' || prep END AS food_name
FROM foods
"""

BASE["ingredient_dim"] = """
SELECT 'ING' || CASE WHEN n < 100000 THEN lpad(CAST(n AS STRING), 5, '0') ELSE CAST(n AS STRING) END AS ingredient_id, food AS canonical_name, p_name AS display_name,
       CASE prep WHEN 'fresh' THEN 'fresh' WHEN 'sliced' THEN 'powder' WHEN 'raw' THEN 'dried' ELSE 'default' END AS ingredient_form, category
FROM (SELECT p_name, food, prep, category, min(food_code) AS n FROM foods GROUP BY p_name, food, prep, category) AS g
"""

BASE["nutri"] = """
SELECT recipe_id, sum(l_extendedprice) / 200.0 AS per_serving_calories_kcal, CASE WHEN count(*) > 2 THEN sum(l_quantity) / 4.0 END AS per_serving_protein_g,
       sum(l_quantity) / 3.0 AS per_serving_carbs_g, max(l_quantity) / 2.0 AS per_serving_fat_g, min(l_quantity) / 5.0 AS per_serving_fiber_g,
       CASE WHEN count(*) > 5 THEN 'COMPLETE' WHEN count(*) > 3 THEN 'APPROXIMATE' ELSE 'PARTIAL' END AS nutrition_quality, count(*) AS ingredient_count, count(quantity) AS calculated_ingredient_count
FROM lines GROUP BY recipe_id
"""

BASE["user_feedback"] = """
SELECT o_custkey AS user_id, 'R' || CASE WHEN o_orderkey < 100000 THEN lpad(CAST(o_orderkey AS STRING), 5, '0') ELSE CAST(o_orderkey AS STRING) END AS recipe_id, o_orderkey AS order_no, o_orderdate AS created_at,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'DISLIKE' WHEN '2-HIGH' THEN 'LIKE' WHEN '3-MEDIUM' THEN 'SAVE' WHEN '5-LOW' THEN 'HIDE' ELSE 'COOKED' END AS feedback_type
FROM orders WHERE o_orderstatus <> 'P'
"""

BASE["user_history"] = """
SELECT o_custkey AS user_id, 'R' || CASE WHEN o_orderkey < 100000 THEN lpad(CAST(o_orderkey AS STRING), 5, '0') ELSE CAST(o_orderkey AS STRING) END AS recipe_id, o_orderkey AS order_no, o_orderdate AS created_at
FROM orders WHERE o_orderstatus <> 'F'
"""
