"""Dietary, allergen, ingredient, pantry and nutrition constraints.

Constraints are checked for a table of (request, recipe) candidates. What only
depends on the recipe is worked out once per recipe; what depends on both is a
join on the candidate pairs. List columns of ``requests`` are arrays of text,
NULL meaning "not asked".
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import rules, text
from larder.functions.common import count_where, fence, lookup, text_or_empty, words_regex
from larder.functions.diet import add_diet_terms, label_exempts_flag, label_is_non_veg
from larder.operators.resolution import ontology, resolve_for_constraints

DIETS = ["vegetarian", "vegan", "jain", "satvik"]

# ---------------------------------------------------------------- evidence per recipe


def _lowered(c: Column | str) -> Column:
    """Lower-cased trimmed text, NULL where there is none."""
    return F.nullif(F.lower(F.trim(F.col(c) if isinstance(c, str) else c)), F.lit(""))


def recipe_texts(recipes: DataFrame, lines: DataFrame) -> DataFrame:
    """Lower-cased ingredient texts of each recipe, from lines and recipe text; a text may come more than once."""
    from_lines = lines.select("recipe_id", F.explode(F.array_distinct(F.array(*[_lowered(c) for c in ("ingredient", "original_ingredient", "canonical_ingredient")]))).alias("text"))
    from_recipe = recipes.select("recipe_id", F.explode(F.split(text_or_empty(F.col("ingredients")), ",")).alias("_part")).select("recipe_id", _lowered("_part").alias("text"))
    return from_lines.unionByName(from_recipe).where(F.col("text").isNotNull())


def recipe_evidence(recipes: DataFrame, lines: DataFrame, canonical: DataFrame) -> DataFrame:
    """What each recipe is known to contain, once for all requests.

    The detectors run on distinct texts. Only terms from the fixed lists are
    collected per recipe, so the arrays are small whatever the recipe holds.
    Texts repeat from recipe to recipe, which minimum and set do not mind.
    """
    texts = recipe_texts(recipes, lines)
    terms = fence(add_diet_terms(texts.select("text").distinct(), "text"))
    words = {g: rules.ALLERGEN_TEXT_WORDS[g] for g in ("peanut", "tree_nut", "gluten")}
    said = {g: F.col("text").rlike(words_regex(w, boundary=False)) for g, w in words.items()}
    terms = terms.withColumn(
        "text_allergens", F.array_compact(F.array(F.when(F.col("dairy"), "dairy"), *[F.when(c, g) for g, c in said.items()]))
    )
    from_text = texts.join(terms, "text").groupBy("recipe_id").agg(
        F.min(F.when(F.col("nonveg_term").isNotNull(), F.struct("text", "nonveg_term")))["nonveg_term"].alias("_ing_nonveg"),
        F.array_sort(F.collect_set("nonvegan_term")).alias("_nonvegan"),
        F.array_sort(F.collect_set("jain_term")).alias("_jain"),
        F.array_sort(F.collect_set("satvik_term")).alias("_satvik"),
        F.array_distinct(F.flatten(F.collect_set("text_allergens"))).alias("_said"),
    )
    onto = ontology(canonical).select("ingredient_id", "canonical_name", "vegetarian", "vegan", "allergen_flags")
    known = lines.select("recipe_id", "ingredient_id").where(F.col("ingredient_id").isNotNull()).join(onto, "ingredient_id")
    from_onto = known.groupBy("recipe_id").agg(
        F.min(F.when(~F.col("vegetarian"), F.col("canonical_name"))).alias("_canon_nonveg"),
        F.collect_set(F.when(~F.col("vegan"), F.col("canonical_name"))).alias("_canon_nonvegan"),
        F.array_distinct(F.flatten(F.collect_set("allergen_flags"))).alias("_flagged"),
    )
    titles = add_diet_terms(recipes.select(F.lower("recipe_name").alias("_title")).distinct(), "_title").select(
        "_title", F.col("nonveg_term").alias("_t_nonveg"), F.col("jain_term").alias("_t_jain"), F.col("satvik_term").alias("_t_satvik")
    )
    none = F.array().cast("array<string>")
    flags = text.diet_flags("diet_type")
    out = (
        recipes.withColumn("_title", F.lower("recipe_name"))
        .join(titles, "_title", "left").join(from_text, "recipe_id", "left").join(from_onto, "recipe_id", "left")
        .withColumn("_flags", flags)
    )
    reason = (
        F.when(label_is_non_veg(F.col("diet_type")), F.lower("diet_type"))
        .when(~F.col("_flags.vegetarian") & ~label_exempts_flag(F.col("diet_type")), F.lit("marked non-vegetarian"))
        .when(F.col("_t_nonveg").isNotNull(), F.concat(F.lit("title contains '"), "_t_nonveg", F.lit("'")))
        .when(F.col("_ing_nonveg").isNotNull(), F.concat(F.lit("ingredient contains '"), "_ing_nonveg", F.lit("'")))
        .when(F.col("_canon_nonveg").isNotNull(), F.concat(F.lit("canonical ingredient '"), "_canon_nonveg", F.lit("' is non-vegetarian")))
    )

    def merged(*cols: Column) -> Column:
        return F.array_sort(F.array_distinct(F.array_compact(F.concat(*[F.coalesce(c, none) for c in cols]))))

    return out.select(
        "recipe_id",
        F.col("_nonvegan").isNotNull().alias("has_ingredients"),
        reason.alias("nonveg_reason"),
        merged(F.col("_nonvegan"), F.col("_canon_nonvegan")).alias("nonvegan_terms"),
        merged(F.col("_jain"), F.array("_t_jain")).alias("jain_terms"),
        merged(F.col("_satvik"), F.array("_t_satvik")).alias("satvik_terms"),
        merged(F.col("_said"), F.col("_flagged")).alias("allergens"),
    )


# ---------------------------------------------------------------- request checks


def request_conflicts(requests: DataFrame) -> DataFrame:
    """Required ingredients that contradict the asked diets or allergens."""
    items = requests.select("request_id", *DIETS, "allergens", F.explode("required").alias("item")).where(F.trim("item") != "")
    terms = add_diet_terms(items.select(F.lower(F.trim("item")).alias("_t")).distinct(), "_t")
    rows = items.withColumn("_key", F.lower(F.trim("item"))).join(terms, F.col("_key") == F.col("_t"))

    def asked(d: str) -> Column:
        return F.coalesce(F.col(d), F.lit(False))

    meat = F.col("nonveg_term").isNotNull()
    diet = [
        F.when(asked("vegetarian") & meat, "vegetarian"),
        F.when(asked("satvik") & meat, "satvik_non_vegetarian"),
        F.when(asked("satvik") & F.col("satvik_term").isNotNull(), "satvik"),
        F.when(asked("vegan") & F.col("nonvegan_term").isNotNull(), "vegan"),
        F.when(asked("jain") & meat, "jain_non_vegetarian").when(asked("jain") & F.col("jain_term").isNotNull(), "jain"),
    ]
    clash = F.filter(
        F.coalesce("allergens", F.array().cast("array<string>")),
        lambda a: F.when(F.lower(F.trim(a)) == "dairy", F.col("dairy")).otherwise(
            (F.trim(a) != "") & F.contains(F.col("_key"), F.lower(F.trim(a)))
        ),
    )
    kinds = F.concat(F.array_compact(F.array(*diet)), F.transform(clash, lambda a: F.concat(F.lit("allergen:"), F.lower(F.trim(a)))))
    return rows.select("request_id", "item", F.explode(kinds).alias("conflict"))


def diet_failures(asked: Column, diet: str, found: Column | None) -> Column:
    """Failure message of one diet for a candidate row with evidence, or NULL."""
    label = {"vegetarian": "vegetarian", "vegan": "vegan", "jain": "Jain", "satvik": "Satvik"}[diet]
    what = {"vegan": "animal-derived or dairy ingredients", "jain": "prohibited root vegetables", "satvik": "prohibited ingredients"}
    ladder = (
        F.when(~F.coalesce(asked, F.lit(False)), F.lit(None).cast("string"))
        .when(F.col("nonveg_reason").isNotNull(), F.concat(F.lit(f"Violates {label} constraint: "), "nonveg_reason", F.lit(".")))
        .when(~F.coalesce("has_ingredients", F.lit(False)), F.lit(f"Cannot verify {label} compliance: insufficient ingredient data."))
    )
    if found is not None:
        ladder = ladder.when(
            F.size(found) > 0, F.concat(F.lit(f"Violates {label} constraint: contains {what[diet]} ("), F.array_join(found, ", "), F.lit(")."))
        )
    return ladder


def diet_status(asked: Column, failure: Column) -> Column:
    """COMPLIANT / NON_COMPLIANT / UNKNOWN, NULL when not asked."""
    return (
        F.when(~F.coalesce(asked, F.lit(False)), None)
        .when(failure.isNull(), "COMPLIANT")
        .when(failure.startswith("Cannot verify"), "UNKNOWN")
        .otherwise("NON_COMPLIANT")
    )


def add_diet_evaluation(pairs: DataFrame) -> DataFrame:
    """Adds per-diet failure text and status to candidates joined with requests and evidence."""
    found = {"vegetarian": None, "vegan": F.col("nonvegan_terms"), "jain": F.col("jain_terms"), "satvik": F.col("satvik_terms")}
    out = pairs.withColumns({f"{d}_failure": diet_failures(F.col(d), d, found[d]) for d in DIETS})
    return out.withColumns({f"{d}_status": diet_status(F.col(d), F.col(f"{d}_failure")) for d in DIETS})


def request_items(requests: DataFrame, lists: dict[str, str]) -> DataFrame:
    """Rows (request_id, kind, item) of the listed array columns, blanks dropped."""
    parts = [
        requests.select("request_id", F.lit(kind).alias("kind"), F.explode(column).alias("item")) for column, kind in lists.items()
    ]
    rows = reduce(DataFrame.unionByName, parts).withColumn("item", F.trim("item"))
    return rows.where(F.col("item") != "").distinct()


def with_resolution(items: DataFrame, canonical: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds the resolved id and name and the plain phrase of each distinct item."""
    phrases = items.select(F.col("item").alias("phrase")).distinct()
    found = resolve_for_constraints(phrases, canonical, aliases)
    found = text.add_phrase_key(found.select("phrase", F.col("ingredient_id").alias("item_id"), F.lower("canonical_name").alias("item_name")), "phrase", "item_key")
    return items.join(found.withColumn("item_key", F.when(F.col("item_key") == "", F.lower(F.trim("phrase"))).otherwise(F.col("item_key"))),
                      F.col("item") == F.col("phrase")).drop("phrase")


def item_presence(candidates: DataFrame, items: DataFrame, lines: DataFrame) -> DataFrame:
    """Whether each candidate recipe holds each asked item, by id, name or text.

    Candidates meet their items by request and the lines by recipe; the answer
    per (request, recipe, item) is a map-side ``max``.
    """
    asked = candidates.select("request_id", "recipe_id").join(items, "request_id")
    line = lines.select(
        "recipe_id", F.col("ingredient_id").alias("_id"), F.lower("canonical_ingredient").alias("_name"), F.lower("ingredient").alias("_clean"),
        F.lower("original_ingredient").alias("_raw"),
    )
    hit = (
        (F.col("_id") == F.col("item_id")) | (F.col("_name") == F.col("item_name"))
        | F.contains(F.col("_clean"), F.col("item_key")) | F.contains(F.col("_raw"), F.col("item_key"))
    )
    return (
        asked.join(line, "recipe_id", "left")
        .groupBy("request_id", "recipe_id", "kind", "item")
        .agg(F.max(F.coalesce(hit, F.lit(False))).alias("present"))
    )


ALLERGEN_GROUPS = {k: k for k in ("dairy", "peanut", "tree_nut", "gluten")} | {"peanuts": "peanut", "tree_nuts": "tree_nut", "nuts": "tree_nut"}


def allergen_presence(candidates: DataFrame, requests: DataFrame, evidence: DataFrame, texts: DataFrame) -> DataFrame:
    """Excluded allergens found in each candidate (F8).

    Known groups are answered from the evidence; only free-text allergens meet
    the recipe texts. One row per candidate and allergen asked is then kept or not.
    """
    keys = ["request_id", "recipe_id", "allergen"]
    asked = request_items(requests, {"allergens": "allergen"}).select("request_id", F.lower("item").alias("allergen")).distinct()
    pairs = candidates.select("request_id", "recipe_id").distinct().join(asked, "request_id").withColumn("_group", lookup(F.col("allergen"), ALLERGEN_GROUPS))
    free = pairs.where(F.col("_group").isNull()).select(*keys).join(texts, "recipe_id").groupBy(*keys).agg(
        F.max(F.contains(F.col("text"), F.col("allergen"))).alias("_said")
    )
    flagged = F.array_contains("allergens", F.col("allergen")) | F.array_contains("allergens", F.col("_group"))
    rows = pairs.join(evidence.select("recipe_id", "allergens"), "recipe_id", "left").join(free, keys, "left")
    return rows.where(F.coalesce(flagged, F.lit(False)) | F.coalesce("_said", F.lit(False))).select(*keys)


def pantry_metrics(candidates: DataFrame, requests: DataFrame, lines: DataFrame, canonical: DataFrame, aliases: DataFrame) -> DataFrame:
    """Matched and missing recipe items and coverage for the available ingredients.

    ``coverage_ratio`` counts clean text and canonical name as separate items.
    """
    items = lines.select(
        "recipe_id", F.explode(F.array_distinct(F.array_compact(F.array(F.lower("ingredient"), F.lower("canonical_ingredient"))))).alias("_item")
    ).where(F.col("_item") != "").distinct()
    avail = with_resolution(request_items(requests, {"available": "available"}), canonical, aliases).select(
        "request_id", F.lower("item").alias("_raw"), F.col("item_name").alias("_name"), F.col("item_key").alias("_key")
    )
    pairs = candidates.select("request_id", "recipe_id").join(items, "recipe_id")
    hit = (
        F.contains(F.col("_item"), F.col("_name")) | F.contains(F.col("_item"), F.col("_key"))
        | F.contains(F.col("_item"), F.col("_raw")) | F.contains(F.col("_raw"), F.col("_item"))
    )
    per_item = pairs.join(avail, "request_id", "left").groupBy("request_id", "recipe_id", "_item").agg(
        F.max(F.coalesce(hit, F.lit(False))).alias("_hit")
    )
    return per_item.groupBy("request_id", "recipe_id").agg(
        count_where(F.col("_hit")).alias("matched_count"),
        F.count(F.lit(1)).alias("recipe_total_count"),
        (count_where(F.col("_hit")) / F.count(F.lit(1))).alias("coverage_ratio"),
        F.array_sort(F.collect_set(F.when(F.col("_hit"), F.col("_item")))).alias("matched_ingredients"),
        F.array_sort(F.collect_set(F.when(~F.col("_hit"), F.col("_item")))).alias("missing_ingredients"),
    )


BOUNDS = [
    ("calories", "per_serving_calories_kcal", " kcal"), ("protein", "per_serving_protein_g", "g"),
    ("carbohydrates", "per_serving_carbs_g", "g"), ("fat", "per_serving_fat_g", "g"), ("fiber", "per_serving_fiber_g", "g"),
]


def nutrition_failures(bounds: dict[str, tuple[str | None, str | None]]) -> Column:
    """Messages of the broken nutrition bounds.

    ``bounds`` maps a measure to its (minimum, maximum) request columns. A NULL
    value fails every bound that is asked; a missing record fails once if any
    bound is asked.
    """
    asked, messages = [], []
    for name, column, unit in BOUNDS:
        low, high = bounds.get(name, (None, None))
        value = F.col(column)
        for limit, broken, said in ((low, lambda v, x: v < x, "is below minimum requirement"), (high, lambda v, x: v > x, "exceeds maximum limit")):
            if limit is None:
                continue
            x = F.col(limit)
            asked.append(x.isNotNull())
            messages.append(
                F.when(x.isNotNull() & value.isNull(), F.lit(f"Cannot verify {name}: data unavailable.")).when(
                    broken(value, x), F.format_string(f"{name.title()} (%.1f{unit}) {said} (%.1f{unit}).", value, x.cast("double"))
                )
            )
    if not asked:
        return F.array().cast("array<string>")
    any_asked = reduce(lambda a, b: a | b, asked)
    missing = F.when(any_asked, F.array(F.lit("Nutrition record missing: cannot verify nutritional limits."))).otherwise(F.array().cast("array<string>"))
    return F.when(F.col("has_nutrition"), F.array_compact(F.array(*messages))).otherwise(missing)


ASKED = {"excluded": "excluded", "required": "required", "preferred": "preferred", "available": "available"}


def request_lists(requests: DataFrame, canonical: DataFrame, aliases: DataFrame) -> DataFrame:
    """Per row of ``requests``: its resolved items, its allergens and those without a known group, as arrays.

    ``_any_free`` are the latter of all rows with that request id.
    """
    items = with_resolution(request_items(requests, ASKED), canonical, aliases)
    lists = items.groupBy("request_id").agg(
        F.collect_set(F.struct("kind", "item", F.col("item_id").alias("id"), F.col("item_name").alias("name"), F.col("item_key").alias("key"))).alias("_items")
    )
    none = F.array().cast("array<string>")
    lowered = F.array_distinct(F.filter(F.transform(F.coalesce("allergens", none), lambda a: F.lower(F.trim(a))), lambda a: a != ""))
    known = F.array(*[F.lit(g) for g in ALLERGEN_GROUPS])
    allergens = requests.select("request_id", lowered.alias("_asked_allergens"), F.array_except(lowered, known).alias("_free"))
    free = allergens.groupBy("request_id").agg(F.array_distinct(F.flatten(F.collect_set("_free"))).alias("_any_free"))
    return allergens.join(free, "request_id").join(lists, "request_id", "left")


LINE_COLUMNS = ["ingredient_id", "canonical_ingredient", "ingredient", "original_ingredient"]


def line_bundles(lines: DataFrame) -> DataFrame:
    """One row per recipe: its different lines, texts lower-cased, as the array ``_lines``."""
    texts = [F.lower(c).alias(c) for c in LINE_COLUMNS[1:]]
    return lines.where(F.col("recipe_id").isNotNull()).groupBy("recipe_id").agg(F.collect_set(F.struct("ingredient_id", *texts)).alias("_lines"))


def bundled_lines(bundles: DataFrame) -> DataFrame:
    """The lines of ``line_bundles`` as rows."""
    return bundles.select("recipe_id", F.inline("_lines"))


def add_line_checks(rows: DataFrame) -> DataFrame:
    """Adds all that a candidate's lines tell about its request.

    Reads the request's arrays of ``request_lists``, ``_lines`` and ``_parts`` of the
    recipe, all of the row itself, so nothing moves. A row without ``_lines`` has
    no hits and no coverage.
    """
    true = lambda c: F.coalesce(c, F.lit(False))
    none = F.array().cast("array<string>")
    asked = lambda *kinds: F.filter("_items", lambda x: x["kind"].isin(*kinds))
    names = F.flatten(F.transform("_lines", lambda x: F.array(x["ingredient"], x["canonical_ingredient"])))
    met = rows.withColumns({
        "_wish": asked("excluded", "required", "preferred"), "_have": asked("available"),
        "_names": F.coalesce(F.array_distinct(F.filter(names, lambda t: t.isNotNull() & (t != ""))), none),
    })
    held = lambda x: F.exists(
        "_lines",
        lambda y: true(y["ingredient_id"] == x["id"]) | true(y["canonical_ingredient"] == x["name"])
        | true(F.contains(y["ingredient"], x["key"])) | true(F.contains(y["original_ingredient"], x["key"])),
    )
    in_text = lambda a: F.exists("_lines", lambda y: reduce(lambda p, q: p | q, [true(F.contains(F.trim(y[c]), a)) for c in LINE_COLUMNS[1:]]))
    stocked = lambda t: F.exists(
        "_have", lambda a: true(F.contains(t, a["name"])) | true(F.contains(t, a["key"])) | F.contains(t, F.lower(a["item"])) | F.contains(F.lower(a["item"]), t)
    )
    written = F.filter("_free", lambda a: F.exists("_parts", lambda x: F.contains(x, a)))
    told = met.withColumns({
        "_hits": F.filter("_wish", lambda x: true(held(x))), "_in_stock": F.coalesce(F.filter("_names", lambda t: true(stocked(t))), none),
        "_said": F.array_union(F.coalesce(F.filter("_any_free", lambda a: true(in_text(a))), none), F.coalesce(written, none)),
    })
    kind = lambda c, k: F.array_distinct(F.transform(F.filter(c, lambda x: x["kind"] == k), lambda x: x["item"]))
    total, matched = F.size("_names"), F.array_sort("_in_stock")
    return told.withColumns({
        "_excluded": F.array_sort(kind("_hits", "excluded")), "_preferred": F.array_sort(kind("_hits", "preferred")),
        "_missing": F.array_sort(F.array_except(F.coalesce(kind("_wish", "required"), none), F.coalesce(kind("_hits", "required"), none))),
        "matched_count": F.when(total > 0, F.size("_in_stock").cast("long")), "recipe_total_count": F.when(total > 0, total.cast("long")),
        "coverage_ratio": F.when(total > 0, F.size("_in_stock") / total),
        "matched_ingredients": F.when(total > 0, matched), "missing_ingredients": F.when(total > 0, F.array_sort(F.array_except("_names", "_in_stock"))),
    }).drop("_wish", "_have", "_names", "_hits", "_in_stock")


def evaluate(
    candidates: DataFrame, requests: DataFrame, evidence: DataFrame, recipes: DataFrame, lines: DataFrame, nutrition: DataFrame,
    canonical: DataFrame, aliases: DataFrame, bounds: dict[str, tuple[str | None, str | None]],
) -> DataFrame:
    """Full evaluation of every candidate.

    ``failures`` is an array of (kind, message) in the fixed order allergen,
    ingredient, dietary, nutrition; a candidate passes when it is empty.
    """
    return evaluate_bundles(candidates, requests, evidence, recipes, line_bundles(lines), nutrition, canonical, aliases, bounds)


def evaluate_bundles(
    candidates: DataFrame, requests: DataFrame, evidence: DataFrame, recipes: DataFrame, bundles: DataFrame, nutrition: DataFrame,
    canonical: DataFrame, aliases: DataFrame, bounds: dict[str, tuple[str | None, str | None]],
) -> DataFrame:
    """``evaluate`` on the ``line_bundles`` of the recipes.

    A candidate moves twice: to its request, and with the request's lists to its
    recipe. What the recipe has, its lines included, is one row there, so the
    checks themselves need no join and no grouping.
    """
    columns = [f"per_serving_{m}" for m in ("calories_kcal", "protein_g", "carbs_g", "fat_g", "fiber_g")]
    measures = nutrition.select("recipe_id", *[c for c in columns if c in nutrition.columns], F.lit(True).alias("has_nutrition"))
    parts = recipes.select("recipe_id", F.filter(F.transform(F.split(text_or_empty(F.col("ingredients")), ","), _lowered), lambda x: x.isNotNull()).alias("_parts"))
    lists = [c for c in requests.columns if c not in candidates.columns or c == "request_id"]
    wishes = request_lists(requests, canonical, aliases).withColumnRenamed("request_id", "_asking")
    whole = F.coalesce(F.col("require_all"), F.lit(False)) & (F.size(F.coalesce("available", F.array().cast("array<string>"))) > 0)
    asking = candidates.join(requests.select(*lists).withColumn("_whole", whole).drop("available"), "request_id").join(wishes, (F.col("request_id") == F.col("_asking")) & F.col("recipe_id").isNotNull(), "left").drop("_asking")
    rows = (
        asking.join(evidence.withColumnRenamed("allergens", "_flagged"), "recipe_id", "left").join(measures, "recipe_id", "left")
        .join(bundles, "recipe_id", "left").join(parts, "recipe_id", "left")
        .withColumn("has_nutrition", F.coalesce("has_nutrition", F.lit(False)))
    )
    rows = fence(add_line_checks(rows).drop("_lines", "_parts", "_items", "_free", "_any_free"))
    none = F.array().cast("array<string>")
    flagged = F.filter("_asked_allergens", lambda a: F.array_contains("_flagged", a) | F.coalesce(F.array_contains("_flagged", lookup(a, ALLERGEN_GROUPS)), F.lit(False)))
    rows = rows.withColumn("_allergens", F.array_sort(F.array_union(F.coalesce(flagged, none), F.coalesce("_said", none))))
    for c in columns:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("double"))
    rows = add_diet_evaluation(rows)

    def typed(kind: str, messages: Column) -> Column:
        return F.transform(messages, lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("message")))

    def each(column: str, before: str, after: str = "'") -> Column:
        return F.transform(F.coalesce(column, none), lambda x: F.concat(F.lit(before), x, F.lit(after)))

    short = F.col("_whole") & (F.col("coverage_ratio") < 1.0)
    strict = F.when(
        short,
        F.array(F.concat(F.lit("Pantry coverage ("), F.col("matched_count").cast("string"), F.lit("/"), F.col("recipe_total_count").cast("string"),
                         F.lit(") is incomplete. Missing: "), F.array_join("missing_ingredients", ", "))),
    ).otherwise(none)
    failures = F.concat(
        typed("allergen", each("_allergens", "Contains excluded allergen: '", "' (HARD REJECT).")),
        typed("excluded", each("_excluded", "Contains excluded ingredient: '")),
        typed("required", each("_missing", "Missing required ingredient: '")),
        typed("required", strict),
        typed("dietary", F.array_compact(F.array(*[F.col(f"{d}_failure") for d in DIETS]))),
        typed("nutrition", nutrition_failures(bounds)),
    )
    soft = each("_preferred", "Contains preferred ingredient: '")
    rows = rows.withColumns({"failures": failures, "soft_matches": soft})
    rows = rows.withColumn("passed", F.size("failures") == 0)
    keep = candidates.columns + ["passed", "failures", "soft_matches", "matched_count", "recipe_total_count", "coverage_ratio", "matched_ingredients", "missing_ingredients"]
    return rows.select(*keep, *[f"{d}_status" for d in DIETS], *columns)


KINDS = ["allergen", "excluded", "dietary", "nutrition", "required"]


def rejection_diagnostics(evaluated: DataFrame, requests: DataFrame) -> DataFrame:
    """Candidates, eligible and rejected ones and rejections by kind, per request.

    A candidate counts once per kind, however many messages it has. Every row of
    ``requests`` has a row here; one without candidates has zeros.
    """
    hit = {k: F.array_contains(F.transform("failures", lambda f: f["kind"]), k) for k in KINDS}
    counts = evaluated.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("total_candidates"), count_where(F.col("passed")).alias("eligible_count"), count_where(~F.col("passed")).alias("rejected_count"),
        *[count_where(c).alias(f"{k}_rejections") for k, c in hit.items()],
    )
    return requests.select("request_id").distinct().join(counts, "request_id", "left").fillna(0, [c for c in counts.columns if c != "request_id"])


def zero_result_causes(diagnostics: DataFrame) -> DataFrame:
    """Likely causes, in order, for requests without an eligible candidate (F16)."""
    total = F.col("total_candidates")
    a, d, n = F.col("allergen_rejections"), F.col("dietary_rejections"), F.col("nutrition_rejections")
    x, r = F.col("excluded_rejections"), F.col("required_rejections")
    rows = diagnostics.where(F.col("eligible_count") == 0)
    empty = total == 0
    allergen = (a > 0) & (a >= total * 0.5)
    dietary = (d > 0) & ((d >= total * 0.5) | ~(empty | allergen))
    nutrition = (n > 0) & ((n >= total * 0.5) | ~(empty | allergen | dietary))
    before = empty | allergen | dietary | nutrition
    ingredient = (x + r > 0) & (~before | (x + r >= total * 0.3))
    causes = F.array_compact(
        F.array(
            F.when(empty, "insufficient_eligible_recipes"), F.when(allergen, "allergen_conflict"), F.when(dietary, "dietary_conflict"),
            F.when(nutrition, "nutrition_constraint_conflict"), F.when(ingredient & (x > 0), "unresolved_ingredient_constraints"),
            F.when(ingredient & (r > 0), "insufficient_pantry_coverage"),
        )
    )
    causes = F.when(F.size(causes) == 0, F.array(F.lit("incompatible_preference_combination"))).otherwise(causes)
    return rows.withColumn("all_causes", causes).withColumn("primary_cause", F.col("all_causes")[0])


def explain(evaluated: DataFrame) -> DataFrame:
    """Adds a sentence saying why each candidate was accepted or rejected."""
    pct = F.round(F.col("coverage_ratio") * 100).cast("int")
    reasons = F.concat(
        F.array_compact(
            F.array(
                *[F.when(F.col(f"{d}_status") == "COMPLIANT", F.lit(f"Satisfies {d} requirement")) for d in DIETS],
                F.when(pct > 0, F.concat(pct.cast("string"), F.lit("% pantry ingredient match"))),
            )
        ),
        F.transform("soft_matches", lambda s: F.lower(s)),
        F.array_compact(F.array(F.when(F.col("per_serving_calories_kcal") > 0, F.format_string("%.0f kcal per serving", "per_serving_calories_kcal")))),
    )
    rejected = F.concat(F.lit("Rejected: "), F.array_join(F.transform("failures", lambda f: f["message"]), "; "))
    accepted = F.when(F.size(reasons) == 0, "Satisfies all specified criteria.").otherwise(F.concat(F.lit("Eligible: "), F.array_join(reasons, "; "), F.lit(".")))
    return evaluated.withColumn("explanation", F.when(F.col("passed"), accepted).otherwise(rejected))


def legacy_filter(candidates: DataFrame, requests: DataFrame, evidence: DataFrame, recipes: DataFrame, lines: DataFrame) -> DataFrame:
    """Candidates that pass diets, total time, exclusions and requirements.

    A missing total time passes. Exclusion matches by name or by substring either
    way, so it errs on the side of leaving recipes out.
    """
    keys = ["request_id", "recipe_id"]
    names = lines.select("recipe_id", F.lower(F.coalesce("canonical_ingredient", "ingredient")).alias("_n"), F.lower("canonical_ingredient").alias("_c"))
    asked = candidates.select(*keys).join(request_items(requests, {"excluded": "excluded", "required": "required"}), "request_id").withColumn("item", F.lower("item"))
    met = asked.join(names, "recipe_id", "left").groupBy(*keys, "kind", "item").agg(
        F.max(F.coalesce(F.contains(F.col("_n"), F.col("item")) | F.contains(F.col("item"), F.col("_n")), F.lit(False))).alias("_near"),
        F.max(F.coalesce(F.col("_c") == F.col("item"), F.lit(False))).alias("_same"),
    )
    bad = met.where(((F.col("kind") == "excluded") & F.col("_near")) | ((F.col("kind") == "required") & ~F.col("_same"))).select(*keys)
    rows = candidates.join(requests.select("request_id", *DIETS, "max_total_time"), "request_id").join(evidence, "recipe_id", "left").join(
        recipes.select("recipe_id", "total_time_min"), "recipe_id", "left"
    )
    rows = add_diet_evaluation(rows)
    diets_ok = reduce(lambda x, y: x & y, [F.col(f"{d}_failure").isNull() for d in DIETS])
    time_ok = ~F.coalesce(F.col("total_time_min") > F.col("max_total_time"), F.lit(False))
    return rows.where(diets_ok & time_ok).select(*candidates.columns).join(bad.distinct(), keys, "left_anti")


def merge_context(requests: DataFrame, preferences: DataFrame, context: DataFrame, lists: Sequence[str]) -> DataFrame:
    """Request filled up from preferences and stored user context.

    Diet flags: first non-NULL of request, preferences, context. Lists are
    concatenated in that order, without repeats.
    """
    out = requests.join(preferences, "request_id", "left").join(context, "request_id", "left")
    none = F.array().cast("array<string>")
    flags = {d: F.coalesce(d, f"pref_{d}", f"ctx_{d}") for d in DIETS}
    merged = {c: F.array_distinct(F.concat(*[F.coalesce(F.col(p + c), none) for p in ("", "pref_") if p + c in out.columns])) for c in lists}
    return out.withColumns({**flags, **merged}).select(*requests.columns)
