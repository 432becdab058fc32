"""F: constraints of customers (requests) over their orders (candidate recipes)."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import rules
from larder.functions.common import rnd, words_regex
from larder.functions.diet import add_diet_terms, clean_context
from larder.operators import constraints as con
from larder.sources.shared import materialize, scratch
from larder.plans.cleaning_queries import _NONVEG, _SATVIK, _DIET
from larder.plans.registry import Tables, query
from larder.plans.resolution_queries import _LIVE
from larder.plans.sqltext import any_of, clean_context as sql_context, detectors, phrase_key, q, sql_case, sql_round

TEXTS = "SELECT DISTINCT recipe_id, lower(trim(t)) AS text FROM (SELECT recipe_id, unnest([ingredient, original_ingredient, canonical_ingredient]) AS t FROM lines UNION ALL SELECT recipe_id, unnest(string_split(ingredients, ',')) FROM recipes) WHERE trim(coalesce(t, '')) <> ''"
ALLTEXT = f"SELECT DISTINCT text FROM ({TEXTS}) UNION SELECT lower(recipe_name) FROM recipes"


def texts(t: Tables):
    return con.recipe_texts(t.recipes, t.lines)


def lines(t: Tables):
    """The lines with what the checks read, written once: they are a join of two tables and are read three times."""
    return materialize(t.lines.select("recipe_id", "ingredient_id", "canonical_ingredient", "ingredient", "original_ingredient"), "lines")


def all_texts(t: Tables):
    return texts(t).select("text").union(t.recipes.select(F.lower("recipe_name"))).distinct()


@query("F01_clean_context", f"SELECT text, {sql_context('text')} AS cleaned FROM ({ALLTEXT})")
def f01(t: Tables):
    return all_texts(t).withColumn("cleaned", clean_context("text"))


DET = detectors(f"({ALLTEXT})", "text", "text")


@query("F02_non_veg_terms", f"SELECT text, nonveg AS nonveg_term FROM ({DET})")
def f02(t: Tables):
    return add_diet_terms(all_texts(t), "text").select("text", "nonveg_term")


@query("F03_non_vegan_terms", f"SELECT text, nonvegan AS nonvegan_term FROM ({DET})")
def f03(t: Tables):
    return add_diet_terms(all_texts(t), "text").select("text", "nonvegan_term")


@query("F04_satvik_jain_terms", f"SELECT text, satvik AS satvik_term, jain AS jain_term FROM ({DET})")
def f04(t: Tables):
    return add_diet_terms(all_texts(t), "text").select("text", "satvik_term", "jain_term")


@query("F05_dairy", f"SELECT text, dairy FROM ({DET})")
def f05(t: Tables):
    return add_diet_terms(all_texts(t), "text").select("text", "dairy")


LISTS = ["allergens", "excluded", "required", "available", "preferred", "disliked"]


def requests(t: Tables):
    split = {c: F.filter(F.transform(F.split(c, ","), lambda s: F.trim(s)), lambda s: s != "") for c in LISTS}
    return t.requests.withColumns(split)


def wanted(t: Tables):
    """Requests that ask for what they may not have, to exercise the conflict check."""
    return requests(t).withColumn("required", F.concat("required", "excluded", F.when(F.col("cust_no") % 2 == 0, F.array(F.lit("chicken stock"), F.lit("butter"))).otherwise(F.array())))


def _split(c: str) -> str:
    return f"list_filter(list_transform(string_split({c}, ','), lambda s: trim(s)), lambda s: s <> '')"


WANT = f"SELECT *, unnest(list_concat({_split('required')}, {_split('excluded')}, CASE WHEN cust_no % 2 = 0 THEN ['chicken stock', 'butter'] ELSE [] END)) AS item FROM requests"
WDET = detectors(f"(SELECT DISTINCT item FROM ({WANT}))", "item", "item")
_ARMS = [("vegetarian", "nonveg IS NOT NULL", "vegetarian"), ("satvik", "nonveg IS NOT NULL", "satvik_non_vegetarian"), ("satvik", "satvikterm IS NOT NULL", "satvik"),
         ("vegan", "nonvegan IS NOT NULL", "vegan"), ("jain", "nonveg IS NOT NULL", "jain_non_vegetarian"), ("jain", "nonveg IS NULL AND jainterm IS NOT NULL", "jain")]


@query("F06_request_conflicts", f"""WITH wd AS MATERIALIZED (SELECT item AS it, low, nonveg, nonvegan, satvik AS satvikterm, jain AS jainterm, dairy FROM ({WDET})), w AS (SELECT DISTINCT * FROM ({WANT}) JOIN wd ON item = it)
{' UNION ALL '.join(f"SELECT request_id, item, '{k}' AS conflict FROM w WHERE {d} AND {c}" for d, c, k in _ARMS)}
UNION ALL SELECT request_id, item, 'allergen:' || a FROM (SELECT *, unnest({_split('allergens')}) AS a FROM w) WHERE CASE WHEN a = 'dairy' THEN dairy ELSE contains(low, a) END""")
def f06(t: Tables):
    return con.request_conflicts(wanted(t))


_VEG = f"(NOT {_NONVEG} AND (contains({_DIET}, 'vegetarian') OR contains({_DIET}, 'vegan') OR {_SATVIK}))"
_SAID = ", ".join(f"CASE WHEN {any_of('text', rules.ALLERGEN_TEXT_WORDS[g])} THEN {q(g)} END" for g in ("peanut", "tree_nut", "gluten"))
EVIDENCE = f"""
tx AS MATERIALIZED ({TEXTS}), dt AS MATERIALIZED (SELECT *, list_filter([CASE WHEN dairy THEN 'dairy' END, {_SAID}], lambda x: x IS NOT NULL) AS said FROM ({DET})),
xt AS (SELECT recipe_id, min_by(nonveg, tx.text) FILTER (nonveg IS NOT NULL) AS ing_nv, coalesce(list(DISTINCT nonvegan) FILTER (nonvegan IS NOT NULL), []) AS nonvegan, coalesce(list(DISTINCT jain) FILTER (jain IS NOT NULL), []) AS jain,
   coalesce(list(DISTINCT satvik) FILTER (satvik IS NOT NULL), []) AS satvik, flatten(list(said)) AS said FROM tx JOIN dt ON tx.text = dt.text GROUP BY 1),
ko AS (SELECT recipe_id, min(CASE WHEN food = 'chicken' THEN food END) AS cnv, coalesce(list(DISTINCT food) FILTER (food IN ('chicken', 'milk')), []) AS cvg, coalesce(list(CASE food WHEN 'milk' THEN 'dairy' WHEN 'almond' THEN 'tree_nut' END) FILTER (food IN ('milk', 'almond')), []) AS flag
   FROM lines JOIN foods ON lines.ingredient_id = foods.ingredient_id GROUP BY 1),
ev AS MATERIALIZED (SELECT r.recipe_id, xt.recipe_id IS NOT NULL AS has_ingredients,
  CASE WHEN {any_of('lower(r.diet_type)', rules.EXPLICIT_NON_VEG_LABELS)} THEN lower(r.diet_type) WHEN NOT {_VEG} AND NOT {any_of('lower(r.diet_type)', rules.FLAG_EXEMPT_LABELS)} THEN 'marked non-vegetarian'
    WHEN ti.nonveg IS NOT NULL THEN 'title contains ''' || ti.nonveg || '''' WHEN xt.ing_nv IS NOT NULL THEN 'ingredient contains ''' || xt.ing_nv || '''' WHEN ko.cnv IS NOT NULL THEN 'canonical ingredient ''' || ko.cnv || ''' is non-vegetarian' END AS nonveg_reason,
  list_sort(list_distinct(list_concat(coalesce(xt.nonvegan, []), coalesce(ko.cvg, [])))) AS nonvegan_terms, list_sort(list_distinct(list_filter(list_append(coalesce(xt.jain, []), ti.jain), lambda x: x IS NOT NULL))) AS jain_terms,
  list_sort(list_distinct(list_filter(list_append(coalesce(xt.satvik, []), ti.satvik), lambda x: x IS NOT NULL))) AS satvik_terms, list_sort(list_distinct(list_concat(coalesce(xt.said, []), coalesce(ko.flag, [])))) AS allergens
  FROM recipes r LEFT JOIN dt ti ON lower(r.recipe_name) = ti.text LEFT JOIN xt ON r.recipe_id = xt.recipe_id LEFT JOIN ko ON r.recipe_id = ko.recipe_id)"""


def food_ontology(t: Tables):
    return t.foods.select("ingredient_id", F.col("food").alias("canonical_name"), "category")


def evidence(t: Tables):
    return con.recipe_evidence(t.recipes, t.lines, food_ontology(t))


_EVCOLS = ["nonvegan_terms", "jain_terms", "satvik_terms", "allergens"]


@query("F07_recipe_evidence", f"WITH {EVIDENCE} SELECT recipe_id, has_ingredients, nonveg_reason, {', '.join(f'''array_to_string({c}, '|') AS {c}''' for c in _EVCOLS)} FROM ev")
def f07(t: Tables):
    return evidence(t).select("recipe_id", "has_ingredients", "nonveg_reason", *[F.array_join(c, "|").alias(c) for c in _EVCOLS])


def _status(d: str, terms: str | None) -> str:
    bad = f"OR len(e.{terms}) > 0 " if terms else ""
    return f"CASE WHEN NOT coalesce(r.{d}, FALSE) THEN NULL WHEN e.nonveg_reason IS NOT NULL THEN 'NON_COMPLIANT' WHEN NOT e.has_ingredients THEN 'UNKNOWN' WHEN FALSE {bad}THEN 'NON_COMPLIANT' ELSE 'COMPLIANT' END"


STATUS = {"vegetarian": _status("vegetarian", None), "vegan": _status("vegan", "nonvegan_terms"), "jain": _status("jain", "jain_terms"), "satvik": _status("satvik", "satvik_terms")}


@query("F07_diet_status", f"WITH {EVIDENCE} SELECT c.request_id, c.recipe_id, {', '.join(f'{s} AS {d}_status' for d, s in STATUS.items())} FROM candidates c JOIN requests r ON c.request_id = r.request_id JOIN ev e ON c.recipe_id = e.recipe_id")
def f07b(t: Tables):
    rows = t.candidates.join(requests(t).select("request_id", *con.DIETS), "request_id").join(evidence(t), "recipe_id", "left")
    return con.add_diet_evaluation(rows).select("request_id", "recipe_id", *[f"{d}_status" for d in con.DIETS])


ALG = f"""al AS MATERIALIZED (SELECT DISTINCT c.request_id, c.recipe_id, a.x AS allergen FROM candidates c JOIN (SELECT request_id, unnest({_split('allergens')}) AS x FROM requests) a ON c.request_id = a.request_id JOIN ev ON c.recipe_id = ev.recipe_id
  WHERE list_contains(ev.allergens, a.x) OR (a.x NOT IN ('dairy', 'peanut', 'tree_nut', 'gluten') AND EXISTS (SELECT 1 FROM tx WHERE tx.recipe_id = c.recipe_id AND contains(tx.text, a.x))))"""


@query("F08_allergen_exclusion", f"WITH {EVIDENCE}, {ALG} SELECT * FROM al")
def f08(t: Tables):
    return con.allergen_presence(t.candidates, requests(t), evidence(t), texts(t))


_STRIPPED = "regexp_replace(lower(item), '^(chopped|fresh|raw) ', '')"
ITEMS = f"""
it AS MATERIALIZED (SELECT DISTINCT request_id, kind, item FROM (SELECT request_id, 'excluded' AS kind, unnest({_split('excluded')}) AS item FROM requests UNION ALL SELECT request_id, 'required', unnest({_split('required')}) FROM requests
   UNION ALL SELECT request_id, 'preferred', unnest({_split('preferred')}) FROM requests UNION ALL SELECT request_id, 'available', unnest({_split('available')}) FROM requests)),
ik AS MATERIALIZED (SELECT item, {phrase_key('item')} AS key, {_STRIPPED} AS st FROM (SELECT DISTINCT item FROM it)),
ir AS MATERIALIZED (SELECT ik.item, ik.key, c.ingredient_id AS id, c.canonical_name AS nm FROM ik LEFT JOIN canon c ON c.canonical_name = CASE WHEN EXISTS (SELECT 1 FROM canon z WHERE z.canonical_name = ik.item) THEN ik.item WHEN ik.item LIKE 'chopped %' THEN ik.st ELSE ik.key END),
pr AS MATERIALIZED (SELECT c.request_id, c.recipe_id, i.kind, i.item, coalesce(bool_or(coalesce(l.ingredient_id = r.id, FALSE) OR coalesce(l.canonical_ingredient = r.nm, FALSE) OR contains(l.ingredient, r.key) OR contains(lower(l.original_ingredient), r.key)), FALSE) AS present
   FROM candidates c JOIN it i ON c.request_id = i.request_id AND i.kind <> 'available' JOIN ir r ON i.item = r.item LEFT JOIN lines l ON c.recipe_id = l.recipe_id GROUP BY 1, 2, 3, 4)"""


def items(t: Tables, lists):
    return con.with_resolution(con.request_items(requests(t), lists), t.canon, t.alias_rows)


@query("F09_item_presence", f"WITH {ITEMS} SELECT * FROM pr")
def f09(t: Tables):
    return con.item_presence(t.candidates, items(t, {c: c for c in ("excluded", "required", "preferred")}), t.lines)


@query("F10_ingredient_constraints", f"WITH {ITEMS} SELECT request_id, recipe_id, count(*) FILTER (kind = 'excluded' AND present) AS excluded_hits, count(*) FILTER (kind = 'required' AND NOT present) AS required_missing, count(*) FILTER (kind = 'preferred' AND present) AS preferred_hits FROM pr GROUP BY 1, 2")
def f10(t: Tables):
    from larder.functions.common import count_where
    p = con.item_presence(t.candidates, items(t, {c: c for c in ("excluded", "required", "preferred")}), t.lines)
    k = F.col("kind")
    return p.groupBy("request_id", "recipe_id").agg(
        count_where((k == "excluded") & F.col("present")).alias("excluded_hits"), count_where((k == "required") & ~F.col("present")).alias("required_missing"),
        count_where((k == "preferred") & F.col("present")).alias("preferred_hits"))


PANTRY = f"""{ITEMS},
pi AS MATERIALIZED (SELECT DISTINCT recipe_id, unnest([lower(ingredient), lower(canonical_ingredient)]) AS x FROM lines),
pn AS MATERIALIZED (SELECT c.request_id, c.recipe_id, pi.x, coalesce(bool_or(coalesce(contains(pi.x, r.nm), FALSE) OR contains(pi.x, r.key) OR contains(pi.x, lower(i.item)) OR contains(lower(i.item), pi.x)), FALSE) AS hit
   FROM candidates c JOIN pi ON c.recipe_id = pi.recipe_id AND pi.x IS NOT NULL LEFT JOIN it i ON c.request_id = i.request_id AND i.kind = 'available' LEFT JOIN ir r ON i.item = r.item GROUP BY 1, 2, 3),
pa AS MATERIALIZED (SELECT request_id, recipe_id, count(*) FILTER (hit) AS matched_count, count(*) AS recipe_total_count, {sql_round('count(*) FILTER (hit) * 1.0 / count(*)', 6)} AS coverage_ratio, coalesce(string_agg(x, '|' ORDER BY x) FILTER (hit), '') AS matched, coalesce(string_agg(x, '|' ORDER BY x) FILTER (NOT hit), '') AS missing FROM pn GROUP BY 1, 2)"""


@query("F11_pantry_metrics", f"WITH {PANTRY} SELECT * FROM pa")
def f11(t: Tables):
    p = con.pantry_metrics(t.candidates, requests(t), t.lines, t.canon, t.alias_rows)
    return p.select("request_id", "recipe_id", "matched_count", "recipe_total_count", rnd("coverage_ratio", 6).alias("coverage_ratio"), F.array_join("matched_ingredients", "|").alias("matched"), F.array_join("missing_ingredients", "|").alias("missing"))


@query("F12_strict_pantry", f"WITH {PANTRY} SELECT request_id, recipe_id FROM pa WHERE coverage_ratio < 1 AND request_id IN (SELECT request_id FROM requests WHERE require_all AND available <> '')")
def f12(t: Tables):
    strict = requests(t).where(F.col("require_all") & (F.size("available") > 0)).select("request_id")
    p = con.pantry_metrics(t.candidates.join(strict, "request_id", "left_semi"), requests(t), t.lines, t.canon, t.alias_rows)
    return p.where("coverage_ratio < 1").select("request_id", "recipe_id")


BOUNDS = {"calories": (None, "max_calories"), "protein": ("min_protein", None)}
_NF = "(CASE WHEN n.recipe_id IS NULL THEN CASE WHEN r.max_calories IS NOT NULL OR r.min_protein IS NOT NULL THEN 1 ELSE 0 END ELSE CASE WHEN r.max_calories IS NOT NULL AND (n.per_serving_calories_kcal IS NULL OR n.per_serving_calories_kcal > r.max_calories) THEN 1 ELSE 0 END + CASE WHEN r.min_protein IS NOT NULL AND (n.per_serving_protein_g IS NULL OR n.per_serving_protein_g < r.min_protein) THEN 1 ELSE 0 END END)"


@query("F13_nutrition_bounds", f"SELECT c.request_id, c.recipe_id, {_NF} AS n_failures FROM candidates c JOIN requests r ON c.request_id = r.request_id LEFT JOIN nutri n ON c.recipe_id = n.recipe_id")
def f13(t: Tables):
    rows = t.candidates.join(t.requests.select("request_id", "max_calories", "min_protein"), "request_id").join(t.nutri.withColumn("has_nutrition", F.lit(True)), "recipe_id", "left")
    rows = rows.withColumn("has_nutrition", F.coalesce("has_nutrition", F.lit(False)))
    return rows.select("request_id", "recipe_id", F.size(con.nutrition_failures(BOUNDS)).alias("n_failures"))


FULL = f"""WITH {EVIDENCE}, {ALG}, {PANTRY},
st AS (SELECT c.request_id, c.recipe_id, {', '.join(f'{s} AS {d}_status' for d, s in STATUS.items())}, {_NF} AS nf, r.require_all AND r.available <> '' AS strict, n.per_serving_calories_kcal AS kcal
  FROM candidates c JOIN requests r ON c.request_id = r.request_id JOIN ev e ON c.recipe_id = e.recipe_id LEFT JOIN nutri n ON c.recipe_id = n.recipe_id),
fe AS MATERIALIZED (SELECT st.*, coalesce(a.n, 0) AS n_allergen, coalesce(p.ex, 0) AS n_excluded, coalesce(p.mi, 0) + CASE WHEN strict AND pa.coverage_ratio < 1 THEN 1 ELSE 0 END AS n_required, pa.coverage_ratio,
   {' + '.join(f"CASE WHEN {d}_status IN ('NON_COMPLIANT', 'UNKNOWN') THEN 1 ELSE 0 END" for d in con.DIETS)} AS n_dietary, nf AS n_nutrition
  FROM st LEFT JOIN (SELECT request_id, recipe_id, count(*) AS n FROM al GROUP BY 1, 2) a USING (request_id, recipe_id)
  LEFT JOIN (SELECT request_id, recipe_id, count(*) FILTER (kind = 'excluded' AND present) AS ex, count(*) FILTER (kind = 'required' AND NOT present) AS mi FROM pr GROUP BY 1, 2) p USING (request_id, recipe_id)
  LEFT JOIN pa USING (request_id, recipe_id)),
fp AS MATERIALIZED (SELECT *, n_allergen + n_excluded + n_required + n_dietary + n_nutrition = 0 AS passed FROM fe)"""


def write_lines(t: Tables) -> None:
    """From here on ``t.lines`` is what checks, scores and ``t.nutri`` read of the lines, written once: they are a join of two tables."""
    if "written" not in t._cache:
        columns = ["recipe_id", *con.LINE_COLUMNS, "quantity", "l_quantity", "l_extendedprice"]
        t._cache["written"] = t._cache["lines"] = materialize(t.lines.select(*columns), "lines")
        t._cache.pop("nutri", None)


def evaluated(t: Tables):
    """The full evaluation, written once: each query here reads it, some of them more than once."""
    write_lines(t)
    with scratch(t.spark) as keep:
        # No table of its own: all that reads the bundles reads the one shuffle of the lines by recipe.
        bundles = con.line_bundles(t.lines)
        known = con.recipe_evidence(t.recipes, con.bundled_lines(bundles), food_ontology(t))
        return keep(materialize(con.evaluate_bundles(t.candidates.select("request_id", "recipe_id"), requests(t), known, t.recipes, bundles, t.nutri, t.canon, t.alias_rows, BOUNDS), "evaluated"))


def _n(kind: str):
    return F.size(F.filter("failures", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")


@query("F14_full_evaluation", f"{FULL} SELECT request_id, recipe_id, passed, {', '.join(f'CAST(n_{k} AS BIGINT) AS n_{k}' for k in con.KINDS)}, {', '.join(f'{d}_status' for d in con.DIETS)}, coverage_ratio FROM fp")
def f14(t: Tables):
    return evaluated(t).select("request_id", "recipe_id", "passed", *[_n(k) for k in con.KINDS], *[f"{d}_status" for d in con.DIETS], rnd("coverage_ratio", 6).alias("coverage_ratio"))


DIAG = f"{FULL}, dg AS (SELECT r.request_id, count(fp.recipe_id) AS total_candidates, count(*) FILTER (passed) AS eligible_count, count(*) FILTER (NOT passed) AS rejected_count, {', '.join(f'count(*) FILTER (n_{k} > 0) AS {k}_rejections' for k in con.KINDS)} FROM (SELECT request_id FROM requests UNION SELECT 'S' || s_suppkey FROM supplier) r LEFT JOIN fp ON r.request_id = fp.request_id GROUP BY 1)"


def asking(t: Tables):
    """All requests, and those of suppliers, for whom there are no candidates."""
    return t.requests.select("request_id").union(t.supplier.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))))


@query("F15_rejection_diagnostics", f"{DIAG} SELECT * FROM dg")
def f15(t: Tables):
    return con.rejection_diagnostics(evaluated(t), asking(t))


@query("F16_zero_result_causes", f"""{DIAG}, z AS (SELECT *, allergen_rejections > 0 AND allergen_rejections >= total_candidates * 0.5 AS ca FROM dg WHERE eligible_count = 0), z2 AS (SELECT *, dietary_rejections > 0 AND (dietary_rejections >= total_candidates * 0.5 OR NOT ca) AS cd FROM z),
z3 AS (SELECT *, nutrition_rejections > 0 AND (nutrition_rejections >= total_candidates * 0.5 OR NOT (ca OR cd)) AS cn FROM z2), z4 AS (SELECT *, excluded_rejections + required_rejections > 0 AND (NOT (ca OR cd OR cn) OR excluded_rejections + required_rejections >= total_candidates * 0.3) AS ci FROM z3),
z5 AS (SELECT request_id, concat_ws('|', CASE WHEN total_candidates = 0 THEN 'insufficient_eligible_recipes' END, CASE WHEN ca THEN 'allergen_conflict' END, CASE WHEN cd THEN 'dietary_conflict' END, CASE WHEN cn THEN 'nutrition_constraint_conflict' END, CASE WHEN ci AND excluded_rejections > 0 THEN 'unresolved_ingredient_constraints' END, CASE WHEN ci AND required_rejections > 0 THEN 'insufficient_pantry_coverage' END) AS c FROM z4)
SELECT request_id, CASE WHEN c = '' THEN 'incompatible_preference_combination' ELSE c END AS causes FROM z5""")
def f16(t: Tables):
    return con.zero_result_causes(con.rejection_diagnostics(evaluated(t), asking(t))).select("request_id", F.array_join("all_causes", "|").alias("causes"))


@query("F17_explanations")
def f17(t: Tables):
    return con.explain(evaluated(t)).select("request_id", "recipe_id", "passed", "explanation")


_GOOD = " + ".join(f"CASE WHEN {d}_status = 'COMPLIANT' THEN 1 ELSE 0 END" for d in con.DIETS)


@query("F17_explanation_parts", f"""{FULL} SELECT request_id, recipe_id, CASE WHEN NOT passed THEN 'Rejected' WHEN good > 0 THEN 'Eligible' ELSE 'Satisfies' END AS verdict,
  CAST(CASE WHEN passed THEN good ELSE n_allergen + n_excluded + n_required + n_dietary + n_nutrition END AS BIGINT) AS n_parts
FROM (SELECT fp.*, {_GOOD} + CASE WHEN round(coverage_ratio * 100) > 0 THEN 1 ELSE 0 END + coalesce(f.n, 0) + CASE WHEN kcal > 0 THEN 1 ELSE 0 END AS good
      FROM fp LEFT JOIN (SELECT request_id, recipe_id, count(*) AS n FROM pr WHERE kind = 'preferred' AND present GROUP BY 1, 2) f USING (request_id, recipe_id))""")
def f17b(t: Tables):
    """What the sentences consist of: their verdict and how many reasons they give."""
    e = F.col("explanation")
    parts = F.size(F.split(F.regexp_replace(e, "^(Rejected|Eligible): ", ""), "; "))
    verdict = F.regexp_extract(e, "^[A-Za-z]+", 0)
    return con.explain(evaluated(t)).select("request_id", "recipe_id", verdict.alias("verdict"), F.when(verdict == "Satisfies", 0).otherwise(parts).cast("long").alias("n_parts"))


@query("F18_legacy_filter", f"""WITH {EVIDENCE}, it AS MATERIALIZED (SELECT request_id, 'excluded' AS kind, unnest({_split('excluded')}) AS item FROM requests UNION ALL SELECT request_id, 'required', unnest({_split('required')}) FROM requests),
mt AS (SELECT c.request_id, c.recipe_id, i.kind, i.item, coalesce(bool_or(contains(coalesce(l.canonical_ingredient, l.ingredient), i.item) OR contains(i.item, coalesce(l.canonical_ingredient, l.ingredient))), FALSE) AS near, coalesce(bool_or(coalesce(l.canonical_ingredient = i.item, FALSE)), FALSE) AS same
  FROM candidates c JOIN it i ON c.request_id = i.request_id LEFT JOIN lines l ON c.recipe_id = l.recipe_id GROUP BY 1, 2, 3, 4)
SELECT c.request_id, c.recipe_id FROM candidates c JOIN requests r ON c.request_id = r.request_id JOIN ev e ON c.recipe_id = e.recipe_id JOIN recipes o ON c.recipe_id = o.recipe_id
WHERE {' AND '.join(f"coalesce({s}, 'COMPLIANT') = 'COMPLIANT'" for s in STATUS.values())} AND NOT coalesce(o.total_time_min > r.max_total_time, FALSE)
 AND NOT EXISTS (SELECT 1 FROM mt WHERE mt.request_id = c.request_id AND mt.recipe_id = c.recipe_id AND ((kind = 'excluded' AND near) OR (kind = 'required' AND NOT same)))""")
def f18(t: Tables):
    return con.legacy_filter(t.candidates.select("request_id", "recipe_id"), requests(t), evidence(t), t.recipes, t.lines)


@query("F19_merge_context", f"""SELECT request_id, coalesce(vegetarian, c_nationkey % 2 = 0, cust_no % 3 = 1) AS vegetarian, coalesce(vegan, CASE WHEN c_nationkey % 4 = 0 THEN FALSE END, cust_no % 2 = 0) AS vegan,
  array_to_string(list_sort(list_distinct(list_concat({_split('excluded')}, CASE WHEN c_nationkey % 3 = 0 THEN ['garlic', 'egg'] ELSE [] END))), '|') AS excluded FROM requests""")
def f19(t: Tables):
    r = requests(t)
    pref = r.select("request_id", (F.col("c_nationkey") % 2 == 0).alias("pref_vegetarian"), F.when(F.col("c_nationkey") % 4 == 0, False).alias("pref_vegan"), F.lit(None).cast("boolean").alias("pref_jain"), F.lit(None).cast("boolean").alias("pref_satvik"),
                    F.when(F.col("c_nationkey") % 3 == 0, F.array(F.lit("garlic"), F.lit("egg"))).alias("pref_excluded"))
    ctx = r.select("request_id", (F.col("cust_no") % 3 == 1).alias("ctx_vegetarian"), (F.col("cust_no") % 2 == 0).alias("ctx_vegan"), F.lit(False).alias("ctx_jain"), F.lit(False).alias("ctx_satvik"))
    out = con.merge_context(r, pref, ctx, ["excluded"])
    return out.select("request_id", "vegetarian", "vegan", F.array_join(F.array_sort("excluded"), "|").alias("excluded"))
