"""B: entity resolution over relations derived from part and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import rules, text
from larder.operators import resolution as res
from larder.operators import cleaning
from larder.plans.cleaning_queries import _PHRASE, EXPLODED, PARSED, exploded
from larder.plans.registry import Tables, query
from larder.plans.sqltext import any_of, food_tokens, has, in_list, phrase_key, q, sql_case, sql_round, squeeze, sub
from larder.functions.common import words_regex

DIRECT = "SELECT candidate_ingredient AS candidate, food AS canonical FROM mapping WHERE brand_no % 4 = 0"
FORMS = "SELECT candidate_ingredient AS candidate, food AS canonical, prep AS form FROM mapping WHERE brand_no % 3 = 0"


def _direct(t: Tables):
    return t.mapping.where("brand_no % 4 = 0").select(F.col("candidate_ingredient").alias("candidate"), F.col("food").alias("canonical"))


def _forms(t: Tables):
    return t.mapping.where("brand_no % 3 = 0").select(F.col("candidate_ingredient").alias("candidate"), F.col("food").alias("canonical"), F.col("prep").alias("form"))


@query("B01_phrase_key", f"SELECT original_ingredient, {phrase_key('original_ingredient')} AS phrase_key FROM (SELECT DISTINCT original_ingredient FROM lines)")
def b01(t: Tables):
    return text.add_phrase_key(t.lines.select("original_ingredient").distinct(), "original_ingredient")


AUTO = f"""
SELECT m.candidate_ingredient, coalesce(d.canonical, f.canonical, '') AS canonical_ingredient,
       CASE WHEN d.canonical IS NOT NULL THEN 'default' ELSE coalesce(f.form, '') END AS ingredient_form,
       CASE WHEN coalesce(d.canonical, f.canonical) IS NOT NULL THEN 'AUTO' ELSE 'REVIEW' END AS mapping_status
FROM mapping m LEFT JOIN ({DIRECT}) d ON m.candidate_ingredient = d.candidate LEFT JOIN ({FORMS}) f ON m.candidate_ingredient = f.candidate"""


def auto(t: Tables):
    return res.auto_map(t.mapping.select("candidate_ingredient"), _direct(t), _forms(t))


@query("B02_auto_map", AUTO)
def b02(t: Tables):
    return auto(t)


@query("B03_final_map", f"""
SELECT m.candidate_ingredient, m.normalized_candidate, coalesce(a.canonical_ingredient, r.food, '') AS final_canonical_ingredient,
       coalesce(a.ingredient_form, r.prep, '') AS final_ingredient_form,
       CASE WHEN coalesce(a.canonical_ingredient, r.food) IS NOT NULL THEN 'AUTO' ELSE 'REVIEW' END AS final_mapping_status
FROM mapping m LEFT JOIN (SELECT * FROM ({AUTO}) WHERE mapping_status = 'AUTO') a ON m.candidate_ingredient = a.candidate_ingredient
LEFT JOIN (SELECT normalized_candidate AS k, min(food) AS food, min(prep) AS prep FROM mapping WHERE brand_no % 5 = 1 GROUP BY 1) r ON m.normalized_candidate = r.k""")
def b03(t: Tables):
    previous = auto(t).withColumn("ord", F.lit(1))
    again = previous.withColumns({"ord": F.lit(2), "canonical_ingredient": F.lit("later")})
    table = t.mapping.where("brand_no % 5 = 1").groupBy(F.col("normalized_candidate").alias("candidate")).agg(F.min("food").alias("canonical"), F.min("prep").alias("form"))
    return res.final_map(t.mapping.select("candidate_ingredient", "normalized_candidate"), previous.unionByName(again), table)


_FIX = {k: v[0] for k, v in rules.MAPPING_CORRECTIONS.items()}
_FIXF = {k: v[1] for k, v in rules.MAPPING_CORRECTIONS.items()}
VALIDATED = f"""
SELECT candidate_ingredient, cleaned_candidate, normalized_candidate, frequency, status AS final_mapping_status,
       CASE WHEN fixed THEN {sql_case('canonical', _FIX)} ELSE canonical END AS final_canonical_ingredient,
       CASE WHEN fixed THEN {sql_case('canonical', _FIXF)} ELSE form END AS final_ingredient_form,
       CASE WHEN status <> 'AUTO' THEN 'REVIEW' WHEN fixed THEN 'CORRECTED'
            WHEN canonical = '' OR form NOT IN {in_list(rules.MAPPING_FORMS)} OR (form <> 'default' AND ends_with(canonical, form)) THEN 'SUSPICIOUS' ELSE 'VALID' END AS validation_status
FROM (SELECT *, status = 'AUTO' AND canonical IN {in_list(list(rules.MAPPING_CORRECTIONS))} AS fixed FROM mapping)"""


def final(t: Tables):
    return t.mapping.select(
        "candidate_ingredient", "cleaned_candidate", "normalized_candidate", "frequency", F.col("status").alias("final_mapping_status"),
        F.col("canonical").alias("final_canonical_ingredient"), F.col("form").alias("final_ingredient_form"))


def validated(t: Tables):
    return res.validate_mapping(final(t)).drop("validation_note")


@query("B04_validate_mapping", VALIDATED)
def b04(t: Tables):
    return validated(t)


@query("B05_canonical_top_frequency", f"""
SELECT canonical_name, ingredient_form, candidate_ingredient, frequency, 'ING' || lpad(CAST(row_number() OVER (ORDER BY frequency DESC, canonical_name, ingredient_form) AS VARCHAR), 5, '0') AS ingredient_id
FROM (SELECT final_canonical_ingredient AS canonical_name, final_ingredient_form AS ingredient_form, candidate_ingredient, CAST(frequency AS DOUBLE) AS frequency,
        row_number() OVER (PARTITION BY final_canonical_ingredient, final_ingredient_form ORDER BY frequency DESC, candidate_ingredient DESC) AS rn
      FROM ({VALIDATED}) WHERE final_mapping_status = 'AUTO' AND validation_status IN ('VALID', 'CORRECTED')) WHERE rn = 1""")
def b05(t: Tables):
    return res.canonical_by_top_frequency(validated(t))


_CAT = "CASE " + " ".join(
    f"WHEN canonical_name = {q(n)}" + (f" AND ingredient_form = {q(f)}" if f else "") + f" THEN {q(c)}" for n, f, c in rules.CATEGORY_OF_FORM
) + f" ELSE {sql_case('canonical_name', rules.CATEGORY_OF_NAME, q('other'))} END"
_DISP = "CASE " + " ".join(f"WHEN canonical_name = {q(k[0])} AND ingredient_form = {q(k[1])} THEN {q(v)}" for k, v in rules.DISPLAY_NAMES.items()) + (
    " WHEN ingredient_form IN ('', 'default') THEN {t} ELSE {t} || ' (' || {f} || ')' END".format(
        t="array_to_string(list_transform(string_split(canonical_name, ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')",
        f="array_to_string(list_transform(string_split(ingredient_form, ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')")
)
CANONICAL = f"""
SELECT *, 'ING' || lpad(CAST(row_number() OVER (ORDER BY canonical_name, ingredient_form) AS VARCHAR), 5, '0') AS ingredient_id, {_DISP} AS display_name, {_CAT} AS category
FROM (SELECT final_canonical_ingredient AS canonical_name, final_ingredient_form AS ingredient_form, CAST(sum(frequency) AS BIGINT) AS recipe_occurrence_count,
        count(DISTINCT candidate_ingredient) AS candidate_variant_count FROM ({VALIDATED})
      WHERE final_mapping_status = 'AUTO' AND validation_status IN ('VALID', 'CORRECTED') GROUP BY 1, 2)"""


@query("B06_canonical_table", f"SELECT canonical_name, ingredient_form, recipe_occurrence_count, candidate_variant_count, ingredient_id FROM ({CANONICAL})")
def b06(t: Tables):
    return res.canonical_table(validated(t)).drop("display_name", "category")


@query("B07_display_and_category", f"SELECT DISTINCT canonical_name, ingredient_form, {_DISP} AS display_name, {_CAT} AS category FROM (SELECT food AS canonical_name, prep AS ingredient_form FROM foods)")
def b07(t: Tables):
    n, f = F.col("canonical_name"), F.col("ingredient_form")
    rows = t.foods.select(F.col("food").alias("canonical_name"), F.col("prep").alias("ingredient_form")).distinct()
    return rows.withColumns({"display_name": res.display_name_of(n, f), "category": res.category_of(n, f)})


def _targets(t: Tables):
    return t.canon


_LINKMAP = "SELECT candidate_ingredient, cleaned_candidate, normalized_candidate, food AS final_canonical_ingredient, 'default' AS final_ingredient_form, CASE WHEN brand_no % 6 = 0 THEN 'SUSPICIOUS' ELSE 'VALID' END AS validation_status FROM mapping"
LINK_LINES = "SELECT l_partkey, CASE WHEN l_suppkey % 3 = 0 THEN ingredient WHEN l_suppkey % 3 = 1 THEN f.p_name ELSE 'Fine ' || f.food || '.' END AS ingredient FROM lines JOIN foods f ON lines.l_partkey = f.food_code"
LINKED = f"""
SELECT l.ingredient, count(*) AS n, coalesce(c.ingredient_id, v.ingredient_id, '') AS ingredient_id, coalesce(c.canonical_name, v.canonical_name, '') AS canonical_ingredient,
       CASE WHEN c.ingredient_id IS NOT NULL THEN 'MAPPED_CANONICAL' WHEN v.ingredient_id IS NOT NULL THEN 'MAPPED_VALIDATED' ELSE 'REVIEW' END AS mapping_status,
       CASE WHEN c.ingredient_id IS NOT NULL THEN 'CANONICAL_DATABASE' WHEN v.ingredient_id IS NOT NULL THEN 'VALIDATED_MAPPING' ELSE 'NONE' END AS mapping_source
FROM (SELECT ingredient, {_PHRASE('ingredient')} AS k FROM ({LINK_LINES})) l
LEFT JOIN (SELECT k, min(ingredient_id) AS ingredient_id, min(canonical_name) AS canonical_name FROM
   (SELECT lower(canonical_name) AS k, * FROM canon UNION ALL SELECT lower(display_name) AS k, * FROM canon) GROUP BY k HAVING count(DISTINCT ingredient_id) = 1) c ON l.k = c.k
LEFT JOIN (SELECT k, min(ingredient_id) AS ingredient_id, min(canonical_name) AS canonical_name FROM
   (SELECT unnest([candidate_ingredient, cleaned_candidate, normalized_candidate]) AS k, final_canonical_ingredient FROM ({_LINKMAP}) WHERE validation_status = 'VALID') m
   JOIN canon c2 ON m.final_canonical_ingredient = c2.canonical_name GROUP BY k HAVING count(DISTINCT ingredient_id) = 1) v ON l.k = v.k
GROUP BY ALL"""


def link_inputs(t: Tables):
    f = t.foods.select("food_code", "p_name", "food")
    name = F.when(F.col("l_suppkey") % 3 == 0, F.col("ingredient")).when(F.col("l_suppkey") % 3 == 1, F.col("p_name")).otherwise(F.concat(F.lit("Fine "), "food", F.lit(".")))
    lines = t.lines.drop("food_code").join(f, F.col("l_partkey") == F.col("food_code")).select("recipe_id", "line_no", name.alias("ingredient"))
    mapping = t.mapping.select(
        "candidate_ingredient", "cleaned_candidate", "normalized_candidate", F.col("food").alias("final_canonical_ingredient"),
        F.lit("default").alias("final_ingredient_form"), F.when(F.col("brand_no") % 6 == 0, "SUSPICIOUS").otherwise("VALID").alias("validation_status"))
    return lines, mapping


@query("B08_link_lines", LINKED)
def b08(t: Tables):
    lines, mapping = link_inputs(t)
    return res.link_lines(lines, t.canon, mapping).groupBy("ingredient", "ingredient_id", "canonical_ingredient", "mapping_status", "mapping_source").agg(F.count(F.lit(1)).alias("n"))


# One fault for each remainder of the line number by 4, and the second lines are lost.
_FAULT = lambda n: f"count(*) FILTER (line_no % 4 = {n} AND line_no <> 2)"


@query("B09_link_invariants", f"""SELECT count(*) FILTER (line_no = 2) AS row_count_change, {_FAULT(1)} AS unknown_ids, {_FAULT(2)} AS bad_status, {_FAULT(3)} AS bad_source, {_FAULT(0)} AS review_not_blank
FROM lines JOIN foods f ON lines.l_partkey = f.food_code""")
def b09(t: Tables):
    lines, mapping = link_inputs(t)
    linked = res.link_lines(lines, t.canon, mapping)
    k = F.col("line_no") % 4
    faulty = linked.where("line_no <> 2").withColumns(
        {
            "ingredient_id": F.when(k == 1, "ING99999").otherwise(F.col("ingredient_id")),
            "display_name": F.when(k == 0, "Left over").otherwise(F.col("display_name")),
            "mapping_status": F.when(k == 0, "REVIEW").when(k == 1, "MAPPED_CANONICAL").when(k == 2, "ODD").otherwise(F.col("mapping_status")),
            "mapping_source": F.when(k == 0, "NONE").when(k == 1, "CANONICAL_DATABASE").when(k == 3, "ELSEWHERE").otherwise(F.col("mapping_source")),
        })
    return res.link_invariants(lines, faulty, t.canon)


ALIAS_SOURCES = """
SELECT c.ingredient_id, c.canonical_name AS alias, 'canonical_database' AS source, 1.0 AS confidence, 'VALIDATED' AS status, 1 AS priority, c.ingredient_id AS ord FROM canon c
UNION ALL SELECT c.ingredient_id, c.display_name, 'canonical_database', 1.0, 'VALIDATED', 1, c.ingredient_id || 'b' FROM canon c
UNION ALL SELECT c.ingredient_id, 'fresh ' || m.food || 's', 'recipe_corpus', 0.95, 'AUTO', 4, m.candidate_ingredient FROM mapping m JOIN canon c ON m.food = c.canonical_name
UNION ALL SELECT c.ingredient_id, m.candidate_ingredient, 'candidate_corpus', CASE WHEN m.brand_no % 6 = 0 THEN 0.0 WHEN m.brand_no % 6 = 1 THEN 0.5 ELSE 0.95 END,
   CASE WHEN m.brand_no % 6 = 0 THEN 'REJECTED' WHEN m.brand_no % 6 = 1 THEN 'REVIEW_REQUIRED' ELSE 'VALIDATED' END, 5, m.candidate_ingredient FROM mapping m JOIN canon c ON m.food = c.canonical_name
"""


def alias_sources(t: Tables):
    c = t.canon.select("ingredient_id", "canonical_name", "display_name")
    m = t.mapping.join(c, F.col("food") == F.col("canonical_name"))
    k = F.col("brand_no") % 6

    def rows(df, alias, source, conf, status, priority, order):
        return df.select("ingredient_id", alias.alias("alias"), F.lit(source).alias("source"), conf.cast("double").alias("confidence"),
                         status.alias("status"), F.lit(priority).alias("priority"), order.alias("ord"))

    return (
        rows(c, F.col("canonical_name"), "canonical_database", F.lit(1.0), F.lit("VALIDATED"), 1, F.col("ingredient_id"))
        .unionByName(rows(c, F.col("display_name"), "canonical_database", F.lit(1.0), F.lit("VALIDATED"), 1, F.concat("ingredient_id", F.lit("b"))))
        .unionByName(rows(m, F.concat(F.lit("fresh "), "food", F.lit("s")), "recipe_corpus", F.lit(0.95), F.lit("AUTO"), 4, F.col("candidate_ingredient")))
        .unionByName(rows(m, F.col("candidate_ingredient"), "candidate_corpus", F.when(k == 0, 0.0).when(k == 1, 0.5).otherwise(0.95),
                          F.when(k == 0, "REJECTED").when(k == 1, "REVIEW_REQUIRED").otherwise("VALIDATED"), 5, F.col("candidate_ingredient")))
    )


@query("B10_compile_aliases", f"""
SELECT ingredient_id AS canonical_ingredient_id, alias, normalized_alias, source, confidence, status AS review_status,
       'ALIAS' || lpad(CAST(row_number() OVER (ORDER BY ingredient_id, confidence DESC, alias, normalized_alias) AS VARCHAR), 5, '0') AS alias_id
FROM (SELECT *, row_number() OVER (PARTITION BY ingredient_id, normalized_alias ORDER BY priority, ord, alias) AS rn
      FROM (SELECT ingredient_id, alias, source, CAST(confidence AS DOUBLE) AS confidence, status, priority, ord, {phrase_key('alias')} AS normalized_alias FROM ({ALIAS_SOURCES}))) WHERE rn = 1""")
def b10(t: Tables):
    return res.compile_aliases(alias_sources(t))


# Every recipe gets parts that each of the four rules drops, beside two that stay.
_NOTES = " (curd / dahi, ab, 2 cups of it, one two three four five, " + rules.NON_ALIAS_DESCRIPTORS[0] + ")"


@query("B10_alias_parts", f"""
SELECT recipe_id, trim(s) AS alias FROM (SELECT recipe_id, unnest(string_split_regex(p, '[/,]')) AS s FROM (SELECT recipe_id, unnest(regexp_extract_all(ingredients || {q(_NOTES)}, '\\(([^)]+)\\)', 1)) AS p FROM recipes))
WHERE length(trim(s)) >= 3 AND NOT regexp_matches(s, '[0-9]') AND lower(trim(s)) NOT IN {in_list(rules.NON_ALIAS_DESCRIPTORS)} AND len(string_split_regex(trim(s), '\\s+')) <= 4""")
def b10b(t: Tables):
    return t.recipes.select("recipe_id", F.explode(res.alias_parts(F.concat("ingredients", F.lit(_NOTES)))).alias("alias"))


_LIVE = "SELECT * FROM alias_rows WHERE review_status <> 'REJECTED'"
_LOOK = f"""
SELECT p.food_code, p.phrase, coalesce(e.canonical_ingredient_id, n.canonical_ingredient_id) AS ingredient_id, coalesce(e.confidence, n.confidence) AS confidence
FROM (SELECT *, {phrase_key('phrase')} AS k FROM phrases) p LEFT JOIN ({_LIVE}) e ON lower(trim(p.phrase)) = e.alias LEFT JOIN ({_LIVE}) n ON p.k = n.normalized_alias"""


@query("B11_alias_lookup", f"SELECT * REPLACE (CAST(confidence AS DOUBLE) AS confidence) FROM ({_LOOK})")
def b11(t: Tables):
    return res.lookup_alias(t.phrases, t.alias_rows).drop("matched_alias")


@query("B12_ontology", f"""
SELECT ingredient_id, canonical_name, v AS vegetarian, v AND category NOT IN ('dairy', 'meat', 'egg') AND NOT {any_of('canonical_name', rules.NON_VEGAN_NAMES)} AS vegan,
       array_to_string(list_sort(list_distinct(list_filter([{sql_case('category', rules.ALLERGEN_BY_CATEGORY)}, {", ".join(f"CASE WHEN contains(canonical_name, {q(k)}) THEN {q(v)} END" for k, v in rules.ALLERGEN_BY_NAME.items())}], lambda x: x IS NOT NULL))), ',') AS allergens,
       {sql_case('category', rules.DEFAULT_UNIT_BY_CATEGORY, q('g'))} AS default_unit
FROM (SELECT *, NOT {has('canonical_name', words_regex(rules.NON_VEGETARIAN_NAMES))} AND category NOT IN ('meat', 'egg') AS v FROM ingredient_dim)""")
def b12(t: Tables):
    return res.ontology(t.ingredient_dim).select("ingredient_id", "canonical_name", "vegetarian", "vegan", F.array_join("allergen_flags", ",").alias("allergens"), "default_unit")


def resolved_sql(source: str, column: str) -> str:
    """Rows of ``source`` with ingredient_id, confidence and match_method of the phrase in ``column``, as a statement.

    ``walk`` strips fitting words one by one and keeps the way it took; the first
    hit by way and kind wins, a normal form after all that lies below it.
    """
    words = ", ".join(f"({i + 1}, {q(w)})" for i, w in enumerate(rules.PREPARATION_WORDS))
    hit = lambda kind, way, target, rest, on, conf, method: (
        f"SELECT p0, list_append(path, {way}) AS way, {kind} AS kind, {target} AS ingredient_id, {conf} AS confidence, {q(method)} AS match_method FROM {rest} ON {on}"
    )
    live = f"({_LIVE}) a"
    exact = "(SELECT alias, max_by(canonical_ingredient_id, alias_id) AS canonical_ingredient_id, max_by(confidence, alias_id) AS confidence FROM (" + _LIVE + ") GROUP BY alias) a"
    return f"""
WITH RECURSIVE walk AS (
  SELECT DISTINCT trim(coalesce({column}, '')) AS p0, lower(trim(coalesce({column}, ''))) AS rest, CAST([] AS INT[]) AS path FROM {source}
  UNION ALL
  SELECT p0, less, list_append(path, j) FROM (SELECT p0, path, j,
    CASE WHEN starts_with(rest, w || ' ') AND rest NOT IN {in_list(rules.KEPT_AT_FRONT)} THEN trim(substr(rest, length(w) + 2))
         WHEN suffix(rest, ' ' || w) AND rest NOT IN {in_list(rules.KEPT_AT_END)} THEN trim(left(rest, length(rest) - length(w) - 1)) END AS less
    FROM walk JOIN (VALUES {words}) AS k(j, w) ON length(rest) > length(w)) WHERE less <> ''),
nodes AS (SELECT *, {phrase_key('rest')} AS n FROM walk WHERE rest <> ''),
hits AS (
  {hit(0, 0, 'c.ingredient_id', 'nodes JOIN canon c', 'rest = c.canonical_name', '1.0', 'EXACT_CANONICAL')} UNION ALL
  {hit(1, 0, 'a.canonical_ingredient_id', f'nodes JOIN {exact}', 'rest = a.alias', 'a.confidence', 'ALIAS_REGISTRY')} UNION ALL
  {hit(2, 0, 'a.canonical_ingredient_id', f'nodes JOIN {live}', 'n = a.normalized_alias', 'a.confidence', 'ALIAS_REGISTRY')} UNION ALL
  {hit(3, 1000, 'c.ingredient_id', 'nodes JOIN canon c', 'n = c.canonical_name', '0.9', 'NORMALIZED_CANONICAL')} UNION ALL
  {hit(4, 1000, 'a.canonical_ingredient_id', f'nodes JOIN {exact}', 'n = a.alias', 'round(CAST(a.confidence * 0.95 AS DECIMAL(18,9)), 4)', 'NORMALIZED_ALIAS')}),
best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY p0 ORDER BY way, kind, confidence DESC, ingredient_id) = 1)
SELECT s.*, b.ingredient_id, CAST(coalesce(b.confidence, 0.0) AS DOUBLE) AS confidence, coalesce(b.match_method, 'NONE') AS match_method
FROM {source} s LEFT JOIN best b ON trim(coalesce(s.{column}, '')) = b.p0"""


RESOLVED = resolved_sql("phrases", "phrase")


@query("B13_resolution_cascade", f"SELECT * FROM ({RESOLVED})")
def b13(t: Tables):
    return res.resolve(t.phrases, t.canon, t.alias_rows)


# Every phrase between other words of preparation, half of them around a name that begins with one itself.
_WORN = "SELECT food_code, CASE WHEN food_code % 2 = 0 THEN 'warm ' || phrase || ' sliced cold' ELSE 'boiled ' || phrase || ' warm' END AS phrase FROM phrases"
_CANON2 = "SELECT ingredient_id, CASE WHEN ingredient_id LIKE '%2' OR ingredient_id LIKE '%6' THEN 'boiled ' || canonical_name ELSE canonical_name END AS canonical_name FROM canon"


@query("B13_fall_through", f"WITH worn AS ({_WORN}), canon2 AS ({_CANON2}) SELECT * FROM (" + resolved_sql("worn", "phrase").replace("JOIN canon c", "JOIN canon2 c") + ")")
def b13b(t: Tables):
    worn = t.spark.sql(_WORN.replace("FROM phrases", "FROM {phrases}"), phrases=t.phrases)
    return res.resolve(worn, t.spark.sql(_CANON2.replace("FROM canon", "FROM {canon}"), canon=t.canon), t.alias_rows)


@query("B14_parse_and_resolve", f"""
WITH parsed AS ({PARSED}), named AS (SELECT DISTINCT ingredient FROM parsed), found AS ({resolved_sql("named", "ingredient")})
SELECT ingredient, ingredient_id, CASE WHEN match_method = 'EXACT_CANONICAL' THEN 'MAPPED_CANONICAL' WHEN ingredient_id IS NOT NULL THEN 'MAPPED_ALIAS' WHEN ingredient <> '' THEN 'REVIEW_REQUIRED' ELSE 'UNMAPPED' END AS mapping_status,
       confidence, count(*) AS n
FROM (SELECT p.ingredient FROM lines l JOIN parsed p ON l.original_ingredient = p.original_ingredient) JOIN found USING (ingredient) GROUP BY ALL""")
def b14(t: Tables):
    out = res.parse_and_resolve(t.lines.select("original_ingredient"), t.canon, t.alias_rows, "original_ingredient")
    return out.groupBy("ingredient", "ingredient_id", "mapping_status", "confidence").agg(F.count(F.lit(1)).alias("n"))


_MK = lambda e: f"trim({sub(sub(f'lower(trim({e}))', '[^a-z0-9 ]', ' '), ' +', ' ')})"
_DICT = f"""SELECT k, min_by(c, o) AS c FROM (SELECT canonical_name AS k, canonical_name AS c, '0' AS o FROM canon UNION ALL SELECT lower(display_name), canonical_name, '1' FROM canon
  UNION ALL SELECT {_MK('alias')}, canonical_name, '2' || alias_id FROM alias_rows JOIN canon ON canonical_ingredient_id = ingredient_id) GROUP BY k"""


@query("B15_matcher_resolution", f"""
SELECT p.food_code, p.phrase, coalesce(d0.c, d1.c, d2.c, d3.c, (SELECT min_by(canonical_name, (-length(canonical_name), canonical_name)) FROM canon WHERE contains(p.m, canonical_name) OR contains(canonical_name, p.m)), p.m) AS resolved
FROM (SELECT *, {_MK('phrase')} AS m, {_MK(phrase_key('phrase'))} AS n FROM phrases) p
LEFT JOIN ({_DICT}) d0 ON p.m = d0.k LEFT JOIN ({_DICT}) d1 ON p.n = d1.k LEFT JOIN ({_DICT}) d2 ON p.m LIKE '%es' AND left(p.m, length(p.m) - 2) = d2.k LEFT JOIN ({_DICT}) d3 ON p.m LIKE '%s' AND left(p.m, length(p.m) - 1) = d3.k""")
def b15(t: Tables):
    return res.resolve_for_matching(t.phrases, t.canon, t.alias_rows)


@query("B16_constraint_resolution", f"""
SELECT r.food_code, r.phrase, r.ingredient_id, CAST(r.confidence AS DOUBLE) AS confidence, CASE r.match_method WHEN 'EXACT_CANONICAL' THEN 'EXACT' WHEN 'ALIAS_REGISTRY' THEN 'ALIAS' WHEN 'NORMALIZED_CANONICAL' THEN 'NORMALIZED' ELSE 'UNRESOLVED' END AS match_type, c.canonical_name
FROM ({RESOLVED}) r LEFT JOIN canon c ON r.ingredient_id = c.ingredient_id""")
def b16(t: Tables):
    return res.resolve_for_constraints(t.phrases, t.canon, t.alias_rows)


_FORM = f"array_to_string(list_filter([{', '.join(f'CASE WHEN {has('lower(food_name)', chr(92) + 'b' + c + chr(92) + 'b')} THEN {q(c)} END' for c in rules.FOOD_FORM_CUES)}], lambda x: x IS NOT NULL), ';')"
_SLUG = f"CASE CAST(n.nutrient_code AS VARCHAR) {' '.join(f'WHEN {q(k)} THEN {q(v)}' for k, v in rules.NUTRIENT_COLUMN_NAMES.items())} ELSE 'cnf_' || {sub(sub('lower(nutrient_name)', '[^a-z0-9]+', '_'), '^_+|_+$')} || '_' || CAST(n.nutrient_code AS VARCHAR) END"


@query("B17_flatten_nutrients", f"""
SELECT a.food_code, a.nutrient_code, CAST(a.amount AS DOUBLE) AS amount, f.food_name, CASE WHEN {_FORM} = '' THEN 'unspecified_in_description' ELSE {_FORM} END AS food_form, {_SLUG} AS normalized_nutrient_name
FROM nutrient_rows a JOIN food_names f ON a.food_code = f.food_code JOIN (SELECT DISTINCT nutrient_code, 'Nutrient, no. ' || CAST(nutrient_code AS VARCHAR) || ' (total)' AS nutrient_name FROM nutrient_rows) n ON a.nutrient_code = n.nutrient_code""")
def b17(t: Tables):
    names = t.nutrient_rows.select("nutrient_code").distinct().withColumn("nutrient_name", F.concat(F.lit("Nutrient, no. "), F.col("nutrient_code").cast("string"), F.lit(" (total)")))
    return res.flatten_nutrients(t.nutrient_rows.withColumn("amount", F.col("amount").cast("double")), t.food_names, names).drop("nutrient_name")


@query("B18_food_form", f"SELECT food_code, CASE WHEN {_FORM} = '' THEN 'unspecified_in_description' ELSE {_FORM} END AS food_form FROM food_names")
def b18(t: Tables):
    return t.food_names.select("food_code", text.food_form("food_name").alias("food_form"))


@query("B19_food_tokens", f"SELECT doc_id, len(k) AS n_tokens, md5(array_to_string(k, ' ')) AS key_md5 FROM (SELECT doc_id, {food_tokens("replace(nfc_normalize(text), 'ß', 'ss')")} AS k FROM documents)")
def b19(t: Tables):
    return t.documents.select("doc_id", text.food_tokens(text.folded("text")).alias("k")).select("doc_id", F.size("k").alias("n_tokens"), F.md5(F.array_join("k", " ")).alias("key_md5"))


_COMP = "^(?:" + "|".join(" ".join(p.replace(",", " ").replace("-", " ").split()) for p in rules.COMPOSITE_PREFIXES) + ")"
_KEY = lambda e: f"array_to_string({food_tokens(e)}, ' ')"
_MTOK = lambda e: f"list_filter(list_distinct({food_tokens(e)}), lambda z: z NOT IN {in_list(rules.MATCH_STOPWORDS)})"
_SEGS = "list_filter(list_transform(string_split(food_name, ','), lambda s: trim(s)), lambda s: s <> '')"
DIM = f"""
SELECT food_code, food_name, {_KEY('food_name')} AS name_key, {_MTOK('seg')} AS primary_tokens, seg AS primary_segment FROM (
  SELECT *, coalesce(list_filter({_SEGS}, lambda s: lower(s) NOT IN {in_list(rules.BROAD_SEGMENTS)})[1], {_SEGS}[-1]) AS seg FROM food_names)
WHERE NOT {has(_KEY('food_name'), _COMP)}"""


def foods(t: Tables):
    return t.food_names.withColumn("alternates", F.array().cast("array<string>"))


@query("B20_food_dimension", f"SELECT food_code, name_key, primary_segment, array_to_string(list_sort(primary_tokens), ' ') AS primary_tokens FROM ({DIM})")
def b20(t: Tables):
    return res.food_dimension(foods(t)).select("food_code", "name_key", "primary_segment", F.array_join(F.array_sort("primary_tokens"), " ").alias("primary_tokens"))


def ingredients(t: Tables):
    return t.ingredient_dim.withColumn("aliases", F.array(F.concat(F.lit("old "), "canonical_name")))


_SUFFIX = "CASE ingredient_form WHEN 'fresh' THEN ['fresh'] WHEN 'powder' THEN ['ground', 'powder', 'powdered'] WHEN 'dried' THEN ['dehydrated', 'dried', 'dry'] ELSE CAST([] AS VARCHAR[]) END"
TERMS = f"""
SELECT ingredient_id, term_key, min_by(term, no) AS term, min_by(kind, no) AS kind, min(no) AS term_no FROM (
  SELECT ingredient_id, {_KEY('term')} AS term_key, term, kind, no FROM (
    SELECT ingredient_id, display_name AS term, 'display_name' AS kind, 0 AS no FROM ingredient_dim
    UNION ALL SELECT ingredient_id, 'old ' || canonical_name, 'validated_alias', 1 FROM ingredient_dim
    UNION ALL SELECT ingredient_id, canonical_name, 'canonical_name', 2 FROM ingredient_dim
    UNION ALL SELECT ingredient_id, canonical_name || ' ' || x[i], 'form_alias', 2 + i FROM (SELECT ingredient_id, canonical_name, x, unnest(generate_series(1, len(x))) AS i FROM (SELECT *, {_SUFFIX} AS x FROM ingredient_dim))))
WHERE term_key <> '' GROUP BY 1, 2"""


@query("B22_query_terms", TERMS)
def b22(t: Tables):
    return res.query_terms(ingredients(t)).drop("term_tokens")


_PAIRS = f"""
SELECT t.ingredient_id, t.term_key, t.term, t.kind, d.food_code, d.name_key AS phrase, d.primary_tokens, t.tt, d.pt, list_intersect(t.tt, d.pt) AS ov
FROM (SELECT *, {_MTOK('term_key')} AS tt FROM ({TERMS})) t JOIN (SELECT *, {_MTOK('name_key')} AS pt FROM ({DIM})) d
ON len(list_filter(list_intersect(t.tt, d.pt), lambda w: length(w) > 1)) > 0"""


def likely(t: Tables):
    return res.matching_pairs(res.query_terms(ingredients(t)), res.food_phrases(res.food_dimension(foods(t))))


def pairs(t: Tables):
    return res.blocked_pairs(res.query_terms(ingredients(t)), res.food_phrases(res.food_dimension(foods(t))))


@query("B21_token_blocking", f"SELECT ingredient_id, count(*) AS n_pairs, count(DISTINCT food_code) AS n_foods FROM ({_PAIRS}) GROUP BY 1")
def b21(t: Tables):
    return pairs(t).groupBy("ingredient_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("food_code").alias("n_foods"))


_COV = "(len(ov) * 1.0 / len(tt))"
_SCORE = f"CASE WHEN {_COV} >= 0.65 AND (len(tt) > 1 OR (len(pt) = 1 AND len(ov) = 1) OR len(list_intersect(ov, primary_tokens)) > 0) THEN 0.55 * {_COV} + 0.45 * len(ov) / (len(tt) + len(pt) - len(ov)) ELSE 0.0 END"


@query("B23_token_score", f"SELECT ingredient_id, term_key, food_code, {sql_round(_SCORE, 6)} AS score FROM ({_PAIRS})")
def b23(t: Tables):
    from larder.functions.common import rnd
    return pairs(t).select("ingredient_id", "term_key", "food_code", rnd(res.token_score(), 6).alias("score"))


BEST = f"""
SELECT ingredient_id, food_code, min_by(method, o) AS method, min_by(score, o) AS score, min_by(term, o) AS matched_term FROM (
  SELECT *, (CASE method WHEN 'EXACT_NAME' THEN 0 WHEN 'ALIAS_MATCH' THEN 1 WHEN 'FORM_MATCH' THEN 2 ELSE 3 END, -score, term_key) AS o FROM (
    SELECT ingredient_id, food_code, term, term_key,
      CASE WHEN term_key = phrase AND kind = 'form_alias' THEN 'FORM_MATCH' WHEN term_key = phrase AND kind = 'validated_alias' THEN 'ALIAS_MATCH' WHEN term_key = phrase THEN 'EXACT_NAME' WHEN s >= 0.35 THEN 'TOKEN_MATCH' END AS method,
      CASE WHEN term_key = phrase AND kind = 'form_alias' THEN 0.96 WHEN term_key = phrase AND kind = 'validated_alias' THEN 0.97 WHEN term_key = phrase THEN 1.0 ELSE s END AS score
    FROM (SELECT *, {sql_round(_SCORE, 9)} AS s FROM ({_PAIRS}))) WHERE method IS NOT NULL) GROUP BY 1, 2"""


@query("B24_best_match", f"SELECT ingredient_id, food_code, method, {sql_round('score', 6)} AS score, matched_term FROM ({BEST})")
def b24(t: Tables):
    from larder.functions.common import rnd
    return res.best_matches(likely(t)).select("ingredient_id", "food_code", "method", rnd("score", 6).alias("score"), "matched_term")


# Foods named after a one-letter segment, so that a plain name is in them without being their name; a few bear it alone.
_TYPED = "SELECT ingredient_id, canonical_name AS display_name, canonical_name, ingredient_form, category FROM ingredient_dim"
_NAMED = "SELECT food_code, CASE WHEN food_code % 1000 = 0 THEN food ELSE substr('bcdefghj', CAST(1 + food_code % 8 AS INT), 1) || ', ' || food END AS food_name FROM foods"


def _fuzzy(t: Tables, measure: str):
    typed = t.spark.sql(_TYPED.replace("FROM ingredient_dim", "FROM {i}"), i=t.ingredient_dim).withColumn("aliases", F.array(F.concat(F.lit("old "), "canonical_name")))
    named = t.spark.sql(_NAMED.replace("FROM foods", "FROM {f}"), f=t.foods).withColumn("alternates", F.array().cast("array<string>"))
    p = res.matching_pairs(res.query_terms(typed), res.food_phrases(res.food_dimension(named)))
    return res.fuzzy_fill(p, res.best_matches(p), measure)


def _over_typed(sql: str) -> str:
    return sql.replace("FROM ingredient_dim", "FROM typed").replace("FROM food_names", "FROM named")


_POOL = f"""
SELECT p.*, t.term_no FROM ({_over_typed(_PAIRS)}) p JOIN ({_over_typed(TERMS)}) t USING (ingredient_id, term_key)
WHERE len(ov) * 1.0 / len(tt) >= {rules.MIN_COVERAGE} AND length(replace(term_key, ' ', '')) >= {rules.FUZZY_MIN_LETTERS}
  AND ingredient_id NOT IN (SELECT ingredient_id FROM matched GROUP BY 1 HAVING count(*) >= {rules.FUZZY_FILL})
  AND NOT EXISTS (SELECT 1 FROM matched m WHERE m.ingredient_id = p.ingredient_id AND m.food_code = p.food_code)"""


@query("B25_fuzzy_fill")
def b25(t: Tables):
    return _fuzzy(t, "difflib")


@query("B25_fuzzy_edit", f"""
WITH typed AS ({_TYPED}), named AS ({_NAMED}), matched AS ({_over_typed(BEST)}), scored AS (
  SELECT *, 1 - levenshtein(term_key, phrase) / greatest(length(term_key), length(phrase)) AS s FROM ({_POOL})),
best AS (SELECT ingredient_id, food_code, s, term AS matched_term FROM scored WHERE s >= {rules.MIN_FUZZY_SCORE} - 1e-9
         QUALIFY row_number() OVER (PARTITION BY ingredient_id, food_code ORDER BY s DESC, term_no) = 1)
SELECT ingredient_id, food_code, {sql_round('s', 6)} AS score, matched_term, 'FUZZY_CANDIDATE' AS method FROM best
QUALIFY row_number() OVER (PARTITION BY ingredient_id ORDER BY {sql_round('s', 9)} DESC, food_code) <= {rules.FUZZY_FILL}""")
def b25b(t: Tables):
    from larder.functions.common import rnd
    return _fuzzy(t, "edit").select("ingredient_id", "food_code", rnd("score", 6).alias("score"), "matched_term", "method")


EVIDENCE = "SELECT ingredient_id, " + ", ".join(
    f"count(*) FILTER ({has('s', p)}) AS {k}_count" for k, p in rules.EVIDENCE_PATTERNS.items()
) + f", count(*) FILTER (NOT ({' OR '.join(has('s', p) for p in rules.EVIDENCE_PATTERNS.values())})) AS unspecified_count FROM (SELECT ingredient_id, ingredient || ' ' || preparation AS s FROM lines WHERE ingredient_id IS NOT NULL) GROUP BY 1"


@query("B26_form_evidence", EVIDENCE)
def b26(t: Tables):
    return res.form_evidence(t.lines)


_TAGS = f"list_filter([{', '.join(f'CASE WHEN {has('lower(d.food_name)', chr(92) + 'b' + c + chr(92) + 'b')} THEN {q(c)} END' for c in rules.NAME_FORM_TERMS)}], lambda x: x IS NOT NULL)"
_EXPECT = "CASE i.ingredient_form WHEN 'fresh' THEN ['fresh'] WHEN 'powder' THEN ['powder', 'powdered', 'ground'] WHEN 'dried' THEN ['dry', 'dried', 'dehydrated'] ELSE [i.ingredient_form] END"


@query("B27_form_signal", f"""
SELECT b.ingredient_id, b.food_code, CASE WHEN i.ingredient_form = 'default' THEN 'UNSPECIFIED' WHEN len(list_intersect({_EXPECT}, {_TAGS})) > 0 OR len(list_intersect({_EXPECT}, string_split(d.name_key, ' '))) > 0 THEN 'MATCH'
       WHEN len({_TAGS}) > 0 THEN 'CONFLICT' ELSE 'UNVERIFIED' END AS form_signal
FROM ({BEST}) b JOIN ingredient_dim i ON b.ingredient_id = i.ingredient_id JOIN ({DIM}) d ON b.food_code = d.food_code""")
def b27(t: Tables):
    rows = res.best_matches(likely(t)).join(t.ingredient_dim, "ingredient_id").join(res.food_dimension(foods(t)), "food_code")
    return rows.select("ingredient_id", "food_code", res.form_signal(F.col("ingredient_form")).alias("form_signal"))


def ranked(t: Tables):
    return res.generate_food_candidates(ingredients(t), foods(t), t.lines)


@query("B28_rank_candidates")
def b28(t: Tables):
    return ranked(t).select("ingredient_id", "food_code", "method", "form_signal", "match_score", "candidate_rank")


@query("B29_candidate_status")
def b29(t: Tables):
    return ranked(t).groupBy("selection_status", "method").agg(F.count(F.lit(1)).alias("n"))


@query("B30_apply_curation", """
SELECT i.ingredient_id, i.canonical_name, c.curation_status, CAST(c.cnf_food_code AS DOUBLE) AS cnf_food_code, f.food_name AS cnf_food_name, c.curation_status || ' by table' AS curation_reason
FROM ingredient_dim i JOIN curated c ON i.ingredient_id = c.ingredient_id LEFT JOIN food_names f ON c.cnf_food_code = f.food_code""")
def b30(t: Tables):
    d = t.curated.select("ingredient_id", "curation_status", F.col("cnf_food_code").alias("food_code"), F.concat("curation_status", F.lit(" by table")).alias("curation_reason"))
    out = res.apply_curation(t.ingredient_dim, d, t.food_names)
    return out.select("ingredient_id", "canonical_name", "curation_status", F.col("cnf_food_code").cast("double").alias("cnf_food_code"), "cnf_food_name", "curation_reason")
