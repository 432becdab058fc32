"""A: sources, sinks and cleaning over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions import rules, text
from larder.functions.quantity import leading_quantity, leading_unit
from larder.operators import cleaning
from larder.plans.registry import Tables, query
from larder.plans.sqltext import (
    blank_null, clean_title, has, in_list, phrase_key, q, quantity_value, sql_case, sql_round, squeeze, sub,
)
from larder.functions.common import words_regex
from larder.sources import readers
from larder.sources.shared import shared_dir

CUSTOMER = T.StructType(
    [T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()), T.StructField("c_nationkey", T.IntegerType()),
     T.StructField("c_acctbal", T.DoubleType()), T.StructField("c_mktsegment", T.StringType())]
)


@query("A01_csv_source", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def a01(t: Tables):
    path = shared_dir(t.spark, "csv")
    readers.write_table(t.customer, path, ["c_custkey"], "csv")
    return readers.read_csv(t.spark, path, [f.name for f in CUSTOMER.fields], CUSTOMER)


@query("A02_nested_json_source", """
SELECT ingredient_id AS recipe_id, p_name AS recipe_name, '' AS name_hi, p_type AS category,
       CAST(p_size AS DOUBLE) AS serving_grams, CAST(p_retailprice AS DOUBLE) AS calories_kcal_100g, CAST(brand_no AS DOUBLE) AS protein_g_100g,
       food AS ingredients, p_size > 25 AS vegetarian, FALSE AS jain, food || ', ' || prep AS contains, p_type AS source
FROM foods""")
def a02(t: Tables):
    dishes = t.foods.select(
        F.col("ingredient_id").alias("id"), F.col("p_name").alias("name_en"), F.col("p_type").alias("category"),
        F.col("p_size").cast("double").alias("serving_grams_default"),
        F.struct(F.col("p_retailprice").alias("kcal"), F.col("brand_no").cast("double").alias("protein_g")).alias("macros_per_100g"),
        F.col("food").alias("ingredients_summary"), (F.col("p_size") > 25).alias("veg"),
        F.array("food", "prep").alias("contains"), F.array("p_type").alias("sources"),
    )
    path = shared_dir(t.spark, "json")
    dishes.write.json(path)
    flat = readers.read_dishes(t.spark, path, multi_line=False)
    return flat.select("recipe_id", "recipe_name", "name_hi", "category", "serving_grams", "calories_kcal_100g", "protein_g_100g",
                       "ingredients", "vegetarian", "jain", "contains", "source")


def raw_recipes(t: Tables):
    r = t.recipes
    return r.select(
        F.col("order_no").alias("Srno"), F.col("recipe_name").alias("TranslatedRecipeName"), F.col("recipe_name").alias("RecipeName"),
        F.col("cuisine").alias("Cuisine"), F.col("meal_type").alias("Course"), F.col("ingredients").alias("TranslatedIngredients"),
        F.col("region").alias("TranslatedInstructions"), F.col("prep_time_min").alias("PrepTimeInMins"),
        F.col("cook_time_min").alias("CookTimeInMins"), F.col("total_time_min").alias("TotalTimeInMins"),
        F.col("servings").alias("Servings"), F.col("diet_type").alias("Diet"),
    )


_DIET = "lower(" + squeeze("coalesce(diet_type, '')") + ")"
_NONVEG = has(_DIET, words_regex(rules.NON_VEG_LABEL_WORDS, boundary=False))
_SATVIK = has(_DIET, words_regex(rules.SATVIK_LABEL_WORDS, boundary=False))
_FLAGS = (
    f"(NOT {_NONVEG} AND (contains({_DIET}, 'vegetarian') OR contains({_DIET}, 'vegan') OR {_SATVIK})) AS vegetarian, "
    f"(contains({_DIET}, 'vegan') AND NOT {_NONVEG}) AS vegan, FALSE AS jain, ({_SATVIK} AND NOT {_NONVEG}) AS satvik"
)


@query("A03_normalize_recipes", f"""
SELECT recipe_id, {clean_title('recipe_name')} AS recipe_name, {squeeze("coalesce(cuisine, '')")} AS cuisine, meal_type,
       meal_type AS category, {squeeze('ingredients')} AS ingredients, prep_time_min, cook_time_min, CAST(total_time_min AS DOUBLE) AS total_time_min,
       servings, diet_type, {_FLAGS}, 'M001' AS source_id, 'CC BY 4.0' AS source_license
FROM recipes""")
def a03(t: Tables):
    out = cleaning.normalize_recipes(raw_recipes(t))
    return out.withColumn("total_time_min", F.col("total_time_min").cast("double")).drop("name_local", "region", "instructions", "contains")


@query("A04_title_clean", f"SELECT recipe_id, {clean_title('recipe_name')} AS title FROM recipes")
def a04(t: Tables):
    return t.recipes.select("recipe_id", text.clean_title("recipe_name").alias("title"))


@query("A05_diet_flags", f"SELECT recipe_id, {_FLAGS} FROM recipes")
def a05(t: Tables):
    return t.recipes.select("recipe_id", text.diet_flags("diet_type").alias("f")).select("recipe_id", "f.*")


_LEAD_M, _LEAD_F, _LEAD_N = r"^(\d+)\s*-\s*(\d+)\s*/\s*(\d+)", r"^(\d+)\s*/\s*(\d+)", r"^(\d+(?:\.\d+)?)"
_UNIT = "(?i)^" + words_regex(rules.LINE_UNITS, boundary=False) + r"\b"
_X = lambda p, n: f"regexp_extract(o, {q(p)}, {n})"
EXPLODED = f"""
SELECT *, trim(split_part(x, ' - ', 1)) AS ingredient, trim(split_part(x, ' - ', 2)) AS preparation FROM (
  SELECT *, lower(regexp_extract(rest, {q(_UNIT)})) AS unit, CASE WHEN {has('rest', _UNIT)} THEN trim({sub('rest', _UNIT)}) ELSE rest END AS x FROM (
    SELECT *, CASE WHEN {has('o', _LEAD_M)} THEN {_X(_LEAD_M, 1)} || ' ' || {_X(_LEAD_M, 2)} || '/' || {_X(_LEAD_M, 3)}
                   WHEN {has('o', _LEAD_F)} THEN {_X(_LEAD_F, 1)} || '/' || {_X(_LEAD_F, 2)}
                   WHEN {has('o', _LEAD_N)} THEN {_X(_LEAD_N, 1)} ELSE '' END AS quantity,
              CASE WHEN {has('o', _LEAD_M)} THEN trim({sub('o', _LEAD_M)}) WHEN {has('o', _LEAD_F)} THEN trim({sub('o', _LEAD_F)})
                   WHEN {has('o', _LEAD_N)} THEN trim({sub('o', _LEAD_N)}) ELSE o END AS rest
    FROM (SELECT recipe_id, i AS line_no, {squeeze('parts[i]')} AS o
          FROM (SELECT recipe_id, parts, unnest(generate_series(1, len(parts))) AS i FROM (SELECT recipe_id, string_split(ingredients, ',') AS parts FROM recipes)))
    WHERE o <> ''))"""


def exploded(t: Tables):
    return cleaning.explode_ingredient_text(t.recipes)


@query("A06_explode_ingredients", f"""
SELECT recipe_id, line_no, o AS original_ingredient, quantity, unit, ingredient, preparation FROM ({EXPLODED})""")
def a06(t: Tables):
    return exploded(t)


@query("A07_leading_quantity", f"SELECT o AS line, quantity, rest, count(*) AS n FROM ({EXPLODED}) GROUP BY ALL")
def a07(t: Tables):
    lead = leading_quantity("original_ingredient")
    return exploded(t).select(F.col("original_ingredient").alias("line"), lead["quantity"].alias("quantity"), lead["rest"].alias("rest")).groupBy(
        "line", "quantity", "rest").agg(F.count(F.lit(1)).alias("n"))


@query("A08_leading_unit", f"SELECT rest, unit, x AS remainder, count(*) AS n FROM ({EXPLODED}) GROUP BY ALL")
def a08(t: Tables):
    rest = leading_quantity("original_ingredient")["rest"]
    return exploded(t).select(rest.alias("rest")).select("rest", leading_unit("rest").alias("u")).select(
        "rest", "u.unit", F.col("u.rest").alias("remainder")).groupBy("rest", "unit", "remainder").agg(F.count(F.lit(1)).alias("n"))


@query("A09_split_preparation", """
SELECT trim(split_part(original_ingredient, ' - ', 1)) AS ingredient, trim(split_part(original_ingredient, ' - ', 2)) AS preparation, count(*) AS n
FROM lines GROUP BY ALL""")
def a09(t: Tables):
    return t.lines.select(text.split_preparation("original_ingredient").alias("p")).select("p.*").groupBy("ingredient", "preparation").agg(
        F.count(F.lit(1)).alias("n"))


_LEAD = rf"(?i)^{rules.LEADING_RANGE}({rules.LEADING_NUMBER})\s*(.*)$"
_DASHED = sub("original_ingredient", r"(\d+)\s*[-–—]\s*(\d+\s*/\s*\d+)", r"\1 \2")
_UNITKEY = sql_case("lower(split_part(rest, ' ', 1))", rules.UNIT_SPELLINGS)
PARSED = f"""
SELECT original_ingredient, CASE WHEN said <> 'to taste' THEN number END AS quantity, CASE WHEN said <> 'to taste' THEN u END AS unit,
       CASE WHEN said = 'to taste' THEN {phrase_key("trim(split_part(original_ingredient, '-', 1))")}
            ELSE {phrase_key("CASE WHEN u IS NOT NULL THEN trim(regexp_replace(rest, '^[^ ]+ *', '')) ELSE rest END")} END AS ingredient,
       said AS preparation
FROM (SELECT *, {_UNITKEY} AS u FROM (
  SELECT *, CASE WHEN number IS NOT NULL THEN trim(regexp_extract(core, {q(_LEAD)}, 2)) ELSE core END AS rest FROM (
    SELECT *, {quantity_value(f"trim(regexp_extract(core, {q(_LEAD)}, 1))")} AS number FROM (
      SELECT original_ingredient, trim(split_part(w, ' - ', 1)) AS core, trim(split_part(w, ' - ', 2)) AS said
      FROM (SELECT original_ingredient, {_DASHED} AS w FROM (SELECT DISTINCT original_ingredient FROM lines))))))"""


@query("A10_parse_line", PARSED)
def a10(t: Tables):
    return text.add_parsed_line(t.lines.select("original_ingredient").distinct(), "original_ingredient")


# The same lines in full-width letters and digits.
_PLAIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
_WIDE = "".join(chr(ord(x) + 0xFEE0) for x in _PLAIN)


@query("A10_parse_wide_line", f"SELECT quantity, unit, ingredient, preparation, count(*) AS n FROM ({PARSED}) GROUP BY ALL")
def a10b(t: Tables):
    wide = t.lines.select("original_ingredient").distinct().select(F.translate("original_ingredient", _PLAIN, _WIDE).alias("line"))
    return text.add_parsed_line(wide, "line").groupBy("quantity", "unit", "ingredient", "preparation").agg(F.count(F.lit(1)).alias("n"))


_PHRASE = lambda c: sub(sub(sub(f"lower(trim({c}))", r"\s+", " "), r"\s*\([^)]*\)"), r"^[ .]+|[ .]+$")


@query("A11_candidate_phrase", f"SELECT doc_id, md5({_PHRASE('text')}) AS phrase_md5, length({_PHRASE('text')}) AS phrase_length FROM documents")
def a11(t: Tables):
    p = text.candidate_phrase("text")
    return t.documents.select("doc_id", p.alias("p")).select("doc_id", F.md5("p").alias("phrase_md5"), F.length("p").alias("phrase_length"))


FREQ = f"SELECT {_PHRASE('ingredient')} AS candidate_ingredient, count(*) AS frequency FROM ({EXPLODED}) GROUP BY 1 HAVING candidate_ingredient <> ''"


@query("A12_candidate_frequency", FREQ)
def a12(t: Tables):
    return cleaning.candidate_frequency(exploded(t))


_C13 = "lower(trim(coalesce(candidate_ingredient, '')))"
for _p in rules.CANDIDATE_PREFIX_PATTERNS:
    _C13 = sub(_C13, _p, flags="")
for _p in rules.CANDIDATE_PREPARATION_PREFIXES:
    _C13 = sub(_C13, f"^{_p}", flags="")
CLEANED = f"SELECT *, CASE WHEN lower(candidate_ingredient) <> cleaned_candidate THEN 'CLEANED' ELSE 'UNCHANGED' END AS cleanup_status FROM (SELECT candidate_ingredient, frequency, {squeeze(_C13)} AS cleaned_candidate FROM ({FREQ}))"


def cleaned(t: Tables):
    return cleaning.with_clean_candidate(cleaning.candidate_frequency(exploded(t)))


@query("A13_clean_candidate", CLEANED)
def a13(t: Tables):
    return cleaned(t)


_HINDI = list(rules.HINDI_LEXICON)
_HWORD = sql_case(f"len(candidate_ingredient) % {len(_HINDI) + 1}", {i: w for i, w in enumerate(_HINDI)}, "cleaned_candidate")


@query("A14_hindi_names", f"""
SELECT candidate_ingredient, w AS cleaned_candidate, {sql_case('lower(trim(w))', rules.HINDI_LEXICON, 'lower(trim(w))')} AS normalized_candidate,
       CASE WHEN {sql_case('lower(trim(w))', rules.HINDI_LEXICON, 'lower(trim(w))')} <> w THEN 'NORMALIZED' ELSE 'UNCHANGED' END AS normalization_status
FROM (SELECT candidate_ingredient, {_HWORD} AS w FROM ({CLEANED}))""")
def a14(t: Tables):
    word = F.get(F.array(*[F.lit(w) for w in _HINDI]), F.length("candidate_ingredient") % (len(_HINDI) + 1))
    rows = cleaned(t).select("candidate_ingredient", F.coalesce(word, F.col("cleaned_candidate")).alias("cleaned_candidate"))
    return cleaning.with_hindi_names(rows)


_ITEM = "trim(" + sub(sub("lower(trim(x))", rules.PROFILE_QUANTITY_PATTERN), rules.PROFILE_UNIT_PATTERN) + ")"


@query("A15_ingredient_profile", f"""
SELECT i AS ingredient, count(*) AS occurrences FROM (SELECT {_ITEM} AS i FROM (SELECT unnest(string_split(text, ',')) AS x FROM documents))
WHERE i <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100""")
def a15(t: Tables):
    return cleaning.ingredient_profile(t.documents, "text")


_PROFILE = ["cuisine", "region", "meal_type", "diet_type", "total_time_min", "servings"]


@query("A16_null_profile", " UNION ALL ".join(
    f"SELECT count(*) AS row_count, '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_count FROM recipes" for c in _PROFILE))
def a16a(t: Tables):
    return cleaning.null_profile(t.recipes.select(*_PROFILE))


@query("A16_value_profile", " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{c}' AS column_name, {c} AS value, count(*) AS occurrences FROM recipes GROUP BY 2 ORDER BY 3 DESC, 2 NULLS LAST LIMIT 20)"
    for c in ("cuisine", "meal_type", "diet_type")))
def a16b(t: Tables):
    return cleaning.value_profile(t.recipes, ["cuisine", "meal_type", "diet_type"])


@query("A17_mapping_template", f"SELECT candidate_ingredient, frequency, '' AS canonical_ingredient, '' AS ingredient_form, '' AS category, 'REVIEW' AS mapping_status FROM ({FREQ})")
def a17(t: Tables):
    return cleaning.mapping_template(cleaning.candidate_frequency(exploded(t)))


_CUISINE = f"lower({squeeze('cuisine')})"
APPROVED = f"coalesce({_CUISINE} IN {in_list(rules.APPROVED_CUISINES)}, FALSE)"


@query("A18_cuisine_allow_list", f"SELECT recipe_id, cuisine FROM recipes WHERE {APPROVED}")
def a18(t: Tables):
    return t.recipes.where(cleaning.approved_cuisine("cuisine")).select("recipe_id", "cuisine")


@query("A19_catalogue_page", f"""
SELECT recipe_id, recipe_name, n AS total, greatest(1, CAST(ceil(n / 20.0) AS BIGINT)) AS total_pages
FROM (SELECT *, count(*) OVER () AS n FROM recipes WHERE {_CUISINE} = 'north indian recipes' AND lower(meal_type) = 'dinner')
ORDER BY order_no LIMIT 20 OFFSET 40""")
def a19(t: Tables):
    page = cleaning.list_recipes(t.recipes, 3, 20, ["order_no"], equals={"meal_type": "Dinner"}, cuisine="North Indian  recipes")
    return page.select("recipe_id", "recipe_name", "total", "total_pages")


@query("A20_recipe_detail", f"""
SELECT r.recipe_id, array_to_string(list_filter(list_transform(string_split(coalesce({blank_null('ingredients')}, ''), ','), lambda s: trim(s)), lambda s: s <> ''), '|') AS ingredients,
       {sql_round('n.kcal', 3)} AS kcal
FROM recipes AS r LEFT JOIN (SELECT recipe_id, sum(l_extendedprice) / 7 AS kcal FROM lines GROUP BY 1) AS n ON r.recipe_id = n.recipe_id""")
def a20(t: Tables):
    nutrition = t.lines.groupBy("recipe_id").agg((F.sum("l_extendedprice") / 7).alias("kcal"))
    return cleaning.recipe_details(t.recipes, nutrition, ["kcal"]).select("recipe_id", F.array_join("ingredients", "|").alias("ingredients"), "kcal")


_MANIFEST = {"documents": ["doc_id", "lang", "n_chars", "source", "text"], "labels": ["doc_id", "quality", "toxic"],
             "pages": ["html", "page_id", "url"], "conversations": ["conv_id", "role", "text", "turn"]}


@query("A21_dataset_manifest", " UNION ALL ".join(
    f"""SELECT '{name}' AS dataset, count(*) AS row_count, {len(cols)} AS column_count, '1.0.0' AS schema_version,
    CAST(sum(CAST('0x' || substr(md5(concat_ws(chr(31), {", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in cols)})), 1, 8) AS BIGINT)) AS BIGINT) AS checksum FROM {name}"""
    for name, cols in _MANIFEST.items()))
def a21(t: Tables):
    return readers.manifest({name: getattr(t, name) for name in _MANIFEST})


@query("A22_table_sinks", "SELECT p_partkey, p_name, p_size FROM part")
def a22(t: Tables):
    path = shared_dir(t.spark, "sink")
    readers.write_table(t.part.select("p_partkey", "p_name", "p_size"), path, ["p_partkey"])
    return t.spark.read.parquet(path)
