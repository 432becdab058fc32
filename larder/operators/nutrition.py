"""Nutrition: grams of each line, nutrients of each recipe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import rules
from larder.functions.common import bound, count_where, fence, lookup, rnd, spread_null, text_or_empty
from larder.functions.quantity import normalize_unit, parse_quantity, water_grams

NUTRIENTS = list(rules.CORE_NUTRIENTS.values())
PARTS = ["energy_kcal", "protein_g", "fat_g", "carbs_g", "fiber_g", "sugar_g", "sodium_mg"]
TOTALS = ["calories_kcal", "protein_g", "fat_g", "carbs_g", "fiber_g", "sugar_g", "sodium_mg"]


def correct_units(lines: DataFrame, corrections: list[tuple[str, str, str, str]] | None = None) -> DataFrame:
    """Adds effective quantity and unit and the correction status.

    ``corrections`` are (text pattern, ingredient word, written unit, meant unit);
    the first that applies wins.
    """
    unit = normalize_unit("unit")
    meant = None
    for pattern, word, written, fixed in corrections or rules.UNIT_CORRECTIONS:
        hit = F.col("original_ingredient").rlike(pattern) & F.lower("original_ingredient").contains(word) & (unit == written)
        meant = F.when(hit, F.lit(fixed)) if meant is None else meant.when(hit, F.lit(fixed))
    fixed_row = F.col("_meant").isNotNull()
    return (
        lines.withColumn("_meant", meant)
        .withColumns(
            {
                "effective_quantity": F.col("quantity"),
                "effective_unit": F.coalesce("_meant", "unit"),
                "quality_status": F.when(fixed_row, "CORRECTED_SOURCE_UNIT").otherwise("ORIGINAL"),
                "correction_type": F.when(fixed_row, "UNIT_PREFIX_CORRECTION").otherwise("NONE"),
                "correction_source": F.when(fixed_row, "CULINARY_VALIDATION").otherwise("SOURCE_DATA"),
            }
        )
        .drop("_meant")
    )


def household_measures(conversions: DataFrame, names: DataFrame) -> DataFrame:
    """Household measures per food: food_code, ord, description, weight."""
    return (
        conversions.where(F.col("measure_type") == rules.HOUSEHOLD_MEASURE_TYPE)
        .join(names, "measure_code", "left")
        .select("food_code", "ord", text_or_empty(F.col("description")).alias("description"), "weight")
    )


def unit_grams(measures: DataFrame) -> DataFrame:
    """Chosen grams per unit for every (food, unit).

    Each description is tested against the fixed ladder; the lowest priority wins,
    then file order. The choice is a ``min_by``, so it combines map-side.
    """
    arms = [
        F.when(
            F.col("description").rlike(f"(?i){pattern}")
            & (F.lit(True) if unit != "piece" else ~F.col("description").rlike(f"(?i){rules.CONTAINER_MEASURE}")),
            F.struct(F.lit(unit).alias("unit"), F.lit(prio).alias("prio"), F.lit(i).alias("step"), (F.col("weight") * factor).alias("grams")),
        )
        for i, (unit, prio, pattern, factor) in enumerate(rules.MEASURE_LADDER)
    ]
    return (
        measures.select("food_code", "ord", F.explode(F.array_compact(F.array(*arms))).alias("_m"))
        .groupBy("food_code", F.col("_m.unit").alias("unit"))
        .agg(F.min_by("_m.grams", F.struct("_m.prio", "ord", "_m.step")).alias("grams"))
    )


def measure_map(measures: DataFrame) -> DataFrame:
    """One row per food with measures: ``map(unit -> grams)``, at most one entry per ladder unit."""
    chosen = unit_grams(measures).groupBy("food_code").agg(
        F.map_from_entries(F.collect_list(F.struct("unit", "grams"))).alias("measures")
    )
    any_measure = measures.select("food_code").distinct()
    return any_measure.join(chosen, "food_code", "left").withColumn(
        "measures", F.coalesce("measures", F.create_map().cast("map<string,double>"))
    )


def nutrient_profiles(amounts: DataFrame) -> DataFrame:
    """Seven core nutrients per food and 100 g, missing ones 0."""
    codes = list(rules.CORE_NUTRIENTS)
    code = F.col("nutrient_code").cast("string")
    return (
        amounts.where(F.col("nutrient_code").isin([int(c) for c in codes]))
        .groupBy("food_code")
        .agg(*[F.coalesce(F.max(F.when(code == c, F.col("amount"))), F.lit(0.0)).alias(rules.CORE_NUTRIENTS[c]) for c in codes])
    )


def food_table(curated: DataFrame, measures: DataFrame, amounts: DataFrame) -> DataFrame:
    """Everything a line needs to know about its food, one row per ingredient.

    Built once so that the line table, the big side, is joined only once.
    """
    profile = nutrient_profiles(amounts).select("food_code", F.struct(*PARTS).alias("profile"))
    foods = measure_map(measures).join(profile, "food_code", "full")
    return curated.select("ingredient_id", "curation_status", "cnf_food_code", "cnf_food_name").join(
        foods.withColumnRenamed("food_code", "cnf_food_code"), "cnf_food_code", "left"
    )


def is_water(canonical: Column, ingredient_id: Column) -> Column:
    return F.coalesce((canonical == "water") | (ingredient_id == rules.WATER_INGREDIENT_ID), F.lit(False))


def qualitative_rule(canonical: Column, said: Column) -> Column:
    """First qualitative rule that names the ingredient, as struct(class, quantity, unit)."""

    def ladder(said: Column) -> Column:
        out = None
        for pattern, cls, qty, unit in rules.QUALITATIVE_RULES:
            hit = (canonical == pattern) | said.rlike(rf"(?i)\b{pattern}\b")
            rule = F.struct(F.lit(cls).alias("cls"), F.lit(qty).cast("double").alias("qty"), F.lit(unit).cast("string").alias("unit"))
            out = F.when(hit, rule) if out is None else out.when(hit, rule)
        return out

    return bound(said, ladder)


def add_grams(lines: DataFrame, estimate_qualitative: bool = True) -> DataFrame:
    """Adds ``grams`` and ``conversion_status`` by the priority ladder.

    Reads parsed_quantity, normalized_unit, mapping_quality, canonical_ingredient,
    original_ingredient, preparation, cnf_food_code and ``measures``.
    """
    qty, unit = F.col("parsed_quantity"), F.col("normalized_unit")
    canon = F.lower(F.trim(text_or_empty(F.col("canonical_ingredient"))))
    out = lines.withColumns(
        {
            "_canon": canon,
            "_water": is_water(F.col("canonical_ingredient"), F.col("ingredient_id")),
            "_step": F.when(unit == "liter", "ml").otherwise(F.coalesce(unit, F.lit("piece"))),
            "_scale": F.when(unit == "liter", 1000.0).otherwise(1.0),
        }
    )
    out = out.withColumns(
        {
            "_qual": F.col("original_ingredient").rlike(rules.QUALITATIVE_PATTERN)
            | text_or_empty(F.col("preparation")).rlike(rules.QUALITATIVE_PATTERN),
            "_override": lookup(F.concat_ws("|", "_canon", unit), rules.MEASURE_OVERRIDES),
            "_piece": F.col("_step") == "piece",
            "_item": lookup(F.col("_canon"), rules.ITEM_GRAMS),
        }
    )
    out = out.withColumn("_rule", F.when(F.col("_qual"), qualitative_rule(F.col("_canon"), F.concat_ws(" ", "original_ingredient", "preparation"))) if estimate_qualitative else F.lit(None))
    pepper = F.col("_canon").isin(rules.PEPPER_NAMES)
    whole_pepper = (F.col("_canon") == "peppercorn") | F.col("original_ingredient").rlike("(?i)" + rules.PEPPER_WHOLE_PATTERN)
    by_measure = F.col("measures")[F.col("_step")] * F.col("_scale")
    piece_override = lookup(F.concat(F.col("_canon"), F.lit("|piece")), rules.MEASURE_OVERRIDES)
    per_piece = (
        F.when(pepper, F.when(whole_pepper, F.coalesce("_item", F.lit(rules.PEPPER_GRAMS))))
        .when(F.col("_item").isNotNull(), F.col("_item"))
        .otherwise(F.coalesce(by_measure, piece_override))
    )
    per_unit = (
        F.when(F.col("measures").isNull(), F.coalesce("_override", F.when(F.col("_piece"), F.col("_item"))))
        .when(F.col("_piece"), F.coalesce(per_piece, F.col("_override")))
        .otherwise(F.coalesce(by_measure, F.col("_override")))
    )
    out = out.withColumn("_per_unit", F.when(unit == "inch", F.col("_override")).when(~F.coalesce(unit, F.lit("")).isin("sprig", "bunch"), per_unit))
    mass = lookup(unit, {"g": 1.0, "kg": 1000.0})
    blocked = F.col("mapping_quality").isin("UNMAPPED", "NO_MATCH")
    if estimate_qualitative:
        cls = F.col("_rule.cls")
        estimate = F.col("measures")[F.col("_rule.unit")] * F.col("_rule.qty")
        can_estimate = (cls == "ESTIMABLE_QUALITATIVE") & F.col("cnf_food_code").isNotNull() & estimate.isNotNull()
        qual_status = (
            F.when(cls == "ZERO_CALORIE_QUALITATIVE", "ZERO_CALORIE_QUALITATIVE")
            .when(can_estimate, "ESTIMATED_QUALITATIVE")
            .otherwise("QUALITATIVE_QUANTITY")
        )
        qual_grams = F.when(can_estimate, rnd(estimate, 3))
    else:
        qual_status, qual_grams = F.lit("QUALITATIVE_QUANTITY"), F.lit(None).cast("double")
    status = (
        F.when(blocked, F.col("mapping_quality"))
        .when(F.col("_water"), "WATER")
        .when(F.col("_qual"), qual_status)
        .when(qty.isNull(), "MISSING_QUANTITY")
        .when((unit == "inch") & F.col("_override").isNull(), "NEEDS_PROXY")
        .when(unit.isin("sprig", "bunch"), "NEEDS_PROXY")
        .when(mass.isNotNull(), "DIRECT_MASS")
        .when((unit != "inch") & F.col("cnf_food_code").isNull(), "NO_CNF_CONVERSION")
        .when(unit.isNull() & F.col("cnf_food_code").isNull(), "NO_CNF_CONVERSION")
        .when(F.col("_per_unit").isNotNull(), "CNF_MEASURE")
        .otherwise("NO_CNF_CONVERSION")
    )
    out = out.withColumn("conversion_status", status)
    grams = (
        F.when(F.col("conversion_status") == "WATER", water_grams(qty, unit))
        .when(F.col("conversion_status") == "ESTIMATED_QUALITATIVE", qual_grams)
        .when(F.col("conversion_status") == "DIRECT_MASS", qty * mass)
        .when(F.col("conversion_status") == "CNF_MEASURE", rnd(qty * F.col("_per_unit"), 3))
    )
    out = out.withColumn("grams", grams)
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def add_state(lines: DataFrame, yields: bool = True) -> DataFrame:
    """Adds ``state_status`` and ``yield_factor``: cooked text against a raw food."""
    said = F.concat_ws(" ", "original_ingredient", "ingredient", "preparation")
    cue = bound(said, lambda s: F.when(s.rlike(rules.COOKED_CUE), F.lower(F.regexp_extract(s, rules.COOKED_CUE, 1))).otherwise(""))
    out = lines.withColumns({"_cue": cue, "_canon": F.lower(F.trim(text_or_empty(F.col("canonical_ingredient"))))})
    applies = (
        (F.col("_cue") != "")
        & F.coalesce(F.col("cnf_food_name").rlike(rules.DRY_FOOD_CUE), F.lit(False))
        & F.col("mapping_quality").isin("APPROVED", "NEEDS_REVIEW")
        & ~is_water(F.col("canonical_ingredient"), F.col("ingredient_id"))
    )
    exact = lookup(F.concat_ws("|", "_canon", "_cue"), rules.YIELD_FACTORS)
    cooked = lookup(F.concat(F.col("_canon"), F.lit("|cooked")), rules.YIELD_FACTORS)
    factor = F.when(F.col("_cue") == "soaked", exact).otherwise(F.coalesce(exact, cooked)) if yields else F.lit(None).cast("double")
    out = out.withColumn("_applies", applies).withColumn("yield_factor", F.when(F.col("_applies"), factor))
    has = F.col("yield_factor").isNotNull()
    soaked = F.col("_cue") == "soaked"
    status = (
        F.when(~F.col("_applies"), "MATCHED")
        .when(soaked & has, "SOAKING_YIELD_ESTIMATE")
        .when(soaked, "STATE_REVIEW_REQUIRED")
        .when(has, "COOKING_YIELD_CONVERSION")
        .otherwise("STATE_MISMATCH")
    )
    return out.withColumn("state_status", status).drop("_cue", "_canon", "_applies")


def line_nutrition(lines: DataFrame, foods: DataFrame, estimate_qualitative: bool = True, yields: bool = True) -> DataFrame:
    """Grams, nutrients, quality and source of every ingredient line.

    ``foods`` is ``food_table``. One join, then projections only.
    """
    corrected = "quality_status" in lines.columns
    fixed = (F.col("quality_status") == "CORRECTED_SOURCE_UNIT") if corrected else F.lit(False)
    # lines without an ingredient match no food; their NULL keys must not meet in one task
    key = spread_null("ingredient_id", "recipe_id", "original_ingredient")
    out = lines.withColumn("_key", key).join(foods.withColumnRenamed("ingredient_id", "_key"), "_key", "left").drop("_key")
    unmapped = (F.coalesce(F.col("mapping_status"), F.lit("REVIEW")) == "REVIEW") | F.col("ingredient_id").isNull()
    out = out.withColumns(
        {
            "unit_fixed": fixed,
            "_q": parse_quantity(F.when(fixed, F.col("effective_quantity")).otherwise(F.col("quantity")) if corrected else F.col("quantity")),
            "normalized_unit": normalize_unit(F.when(fixed, F.col("effective_unit")).otherwise(F.col("unit")) if corrected else F.col("unit")),
            "mapping_quality": F.when(unmapped, "UNMAPPED").otherwise(F.coalesce("curation_status", F.lit("NO_MATCH"))),
        }
    )
    out = fence(out.withColumns({"parsed_quantity": F.col("_q.quantity"), "quantity_parse_status": F.col("_q.status")}).drop("_q"))
    out = add_state(add_grams(out, estimate_qualitative), yields)
    state = F.col("state_status")
    held = state.isin(rules.STATE_FAILURES)
    yielded = F.col("yield_factor").isNotNull() & F.col("grams").isNotNull()
    out = out.withColumns(
        {
            "grams": F.when(held, None).when(yielded, rnd(F.col("grams") * F.col("yield_factor"), 3)).otherwise(F.col("grams")),
            "conversion_status": F.when(held | yielded, state).otherwise(F.col("conversion_status")),
            "_water": is_water(F.col("canonical_ingredient"), F.col("ingredient_id")),
        }
    )
    out = out.withColumn("conversion_status", F.when(F.col("unit_fixed") & ~F.col("_water"), "SOURCE_UNIT_CORRECTION").otherwise(F.col("conversion_status")))
    status = F.col("conversion_status")
    measured = F.coalesce(F.col("grams") > 0, F.lit(False)) & F.col("profile").isNotNull()
    direct = status.isin("DIRECT_MASS", "CNF_MEASURE") & measured
    approx = (status.isin("SOURCE_UNIT_CORRECTION", "ESTIMATED_QUALITATIVE", "COOKING_YIELD_CONVERSION", "SOAKING_YIELD_ESTIMATE") & measured) | (
        direct & (F.col("mapping_quality") == "NEEDS_REVIEW")
    )
    quality = (
        F.when(F.col("_water") | (status == "ZERO_CALORIE_QUALITATIVE"), "EXACT")
        .when(approx, "APPROXIMATE")
        .when(direct, "EXACT")
        .otherwise("UNAVAILABLE")
    )
    source = (
        F.when(F.col("_water"), "WATER_DEFAULT")
        .when(status == "SOURCE_UNIT_CORRECTION", "QUALITY_CORRECTED")
        .when(status == "ZERO_CALORIE_QUALITATIVE", "QUALITATIVE_DEFAULT")
        .when(~measured, "NONE")
        .when(status == "ESTIMATED_QUALITATIVE", "ESTIMATED_QUALITATIVE")
        .when(status == "SOAKING_YIELD_ESTIMATE", "SOAKING_YIELD_ESTIMATE")
        .when(status == "COOKING_YIELD_CONVERSION", "CNF_2026_YIELD")
        .when(direct, "CNF_2026")
        .otherwise("NONE")
    )
    out = out.withColumns({"nutrition_quality": quality, "nutrition_source": source})
    counted = ~F.col("_water") & (status != "ZERO_CALORIE_QUALITATIVE") & F.col("nutrition_quality").isin("EXACT", "APPROXIMATE")
    out = out.withColumns({p: F.when(counted, scale(F.col(f"profile.{p}"), F.col("grams"))).otherwise(0.0) for p in PARTS})
    notes = F.concat(
        F.lit("[STATUS: "), "nutrition_quality", F.lit("] [METHOD: "), F.when(quality == "UNAVAILABLE", "NONE").otherwise(status),
        F.lit("] [PROVENANCE: "), "nutrition_source", F.lit("]"),
    )
    out = out.withColumn("calculation_notes", notes)
    return out.withColumn("mapping_quality", F.when(F.col("_water"), "APPROVED").otherwise(F.col("mapping_quality"))).drop(
        "_water", "unit_fixed", "measures", "profile", "yield_factor"
    )


def scale(per_100g: Column, grams: Column) -> Column:
    """Amount in ``grams`` of a food given its amount per 100 g; 0 when unknown."""
    return F.when(F.coalesce(grams > 0, F.lit(False)), F.coalesce(rnd(per_100g * grams / 100.0, 3), F.lit(0.0))).otherwise(0.0)


def add_profiles(a: list[Column], b: list[Column]) -> list[Column]:
    """Sum of two profiles, part by part."""
    return [x + y for x, y in zip(a, b)]


def divide_profile(parts: list[Column], by: Column) -> list[Column]:
    """Profile divided by a positive number; any other divisor fails the job."""
    guard = F.when(by > 0, by).otherwise(F.raise_error(F.lit("divisor must be positive")).cast("double"))
    return [rnd(p / guard, 3) for p in parts]


def roll_up(recipes: DataFrame, lines: DataFrame) -> DataFrame:
    """Recipe totals, per-serving amounts, counters and quality tier.

    One aggregation that combines map-side, so a recipe with very many lines
    costs no more than its partial sums.
    """
    ok = F.col("nutrition_quality").isin("EXACT", "APPROXIMATE")
    dry = ~is_water(F.col("canonical_ingredient"), F.col("ingredient_id"))
    status, quality = F.col("conversion_status"), F.col("mapping_quality")
    is_qual, is_fail = status.isin(rules.QUALITATIVE_STATUSES), status.isin(rules.CONVERSION_FAILURES)
    state = (status.isin(rules.STATE_FAILURES) | F.col("state_status").isin(rules.STATE_FAILURES)) & ~is_qual & ~is_fail
    sums = lines.groupBy("recipe_id").agg(
        *[F.sum(F.when(ok, F.col(p)).otherwise(0.0)).alias(f"_{t}") for p, t in zip(PARTS, TOTALS)],
        F.count(F.lit(1)).alias("ingredient_count"),
        count_where(ok).alias("calculated_ingredient_count"),
        count_where(quality == "UNMAPPED").alias("unmapped_ingredient_count"),
        count_where(quality == "NO_MATCH").alias("no_match_ingredient_count"),
        count_where(quality == "NEEDS_REVIEW").alias("needs_review_ingredient_count"),
        count_where(is_qual).alias("qualitative_quantity_count"),
        count_where(is_fail).alias("conversion_failure_count"),
        count_where(state).alias("state_mismatch_count"),
        count_where(dry & (F.col("nutrition_quality") == "UNAVAILABLE")).alias("_unavailable"),
        count_where(dry & (F.col("nutrition_quality") == "APPROXIMATE")).alias("_approximate"),
    )
    counters = [c for c in sums.columns if c.endswith("_count")]
    out = recipes.select("recipe_id", "recipe_name", "servings").join(sums, "recipe_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counters})
    tier = (
        F.when((F.col("ingredient_count") == 0) | (F.col("_unavailable") > 0), "PARTIAL")
        .when(F.col("_approximate") > 0, "APPROXIMATE")
        .otherwise("COMPLETE")
    )
    out = out.withColumn("nutrition_quality", tier)
    out = out.withColumns({f"total_{t}": rnd(F.coalesce(f"_{t}", F.lit(0.0)), 3) for t in TOTALS})
    served = F.when(F.col("servings") > 0, F.col("servings").cast("double"))
    out = out.withColumns({f"per_serving_{t}": rnd(F.col(f"total_{t}") / served, 3) for t in TOTALS})
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def nutrition_pipeline(recipes: DataFrame, lines: DataFrame, foods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Line and recipe tables (N15); the line table is written once and read by the roll-up."""
    from larder.sources.shared import materialize

    line_table = materialize(line_nutrition(lines, foods), "line-nutrition")
    return line_table, roll_up(recipes, line_table)
