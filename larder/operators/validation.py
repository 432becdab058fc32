"""Contracts, referential integrity, outliers and parity checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import rules
from larder.functions.common import count_where, rnd, text_or_empty
from larder.functions.quantity import normalize_unit, parse_quantity

# A check is (name, severity, condition that marks a bad row).
Check = tuple[str, str, Column]


def blank(c: str) -> Column:
    return F.trim(text_or_empty(F.col(c))) == ""


def contract(df: DataFrame, dataset: str, checks: Sequence[Check], key: str | None = None) -> DataFrame:
    """One result row per check: violations over all rows, in a single pass.

    ``key`` adds a duplicate check. All rows are checked, none sampled.
    """
    aggs = [count_where(F.coalesce(cond, F.lit(False))).alias(f"v{i}") for i, (_, _, cond) in enumerate(checks)]
    row = df.agg(F.count(F.lit(1)).alias("total_records"), *aggs)
    named = [(n, s, F.col(f"v{i}")) for i, (n, s, _) in enumerate(checks)]
    if key is not None:
        copies = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long"))
        row = row.withColumn("dup", copies.scalar())
        named.append((f"duplicate_{key}", "error", F.col("dup")))
    results = F.array(*[F.struct(F.lit(n).alias("check"), F.lit(s).alias("severity"), v.alias("violations")) for n, s, v in named])
    return row.select(F.lit(dataset).alias("dataset"), "total_records", F.inline(results))


def recipe_contract(df: DataFrame) -> DataFrame:
    """Recipe contract."""
    times = ["prep_time_min", "cook_time_min", "total_time_min"]
    return contract(
        df, "recipes",
        [
            ("null_recipe_name", "error", F.col("recipe_name").isNull()),
            ("negative_times", "error", reduce(lambda a, b: a | b, [F.coalesce(F.col(c) < 0, F.lit(False)) for c in times])),
            ("invalid_servings", "error", F.col("servings").isNull() | (F.col("servings") < 1)),
            ("null_ingredients", "warning", F.col("ingredients").isNull()),
            ("bad_recipe_id", "error", ~F.col("recipe_id").rlike(r"^R\d{5,}$")),
        ],
        "recipe_id",
    )


def ingredient_contract(df: DataFrame) -> DataFrame:
    """Canonical ingredient contract."""
    return contract(
        df, "ingredients",
        [
            ("bad_ingredient_id", "error", ~F.col("ingredient_id").rlike(r"^ING\d{5}$")),
            ("empty_canonical_name", "error", blank("canonical_name")),
            ("empty_display_name", "error", blank("display_name")),
        ],
        "ingredient_id",
    )


def link_contract(df: DataFrame) -> DataFrame:
    """Line link contract (D3); the mapped share below 70 % is a warning."""
    mapped = F.col("mapping_status").isin("MAPPED_CANONICAL", "MAPPED_VALIDATED")
    base = contract(
        df, "links",
        [
            ("empty_text", "error", blank("original_ingredient")),
            ("mapped_without_id", "error", mapped & blank("ingredient_id")),
            ("review_with_id", "warning", (F.col("mapping_status") == "REVIEW") & ~blank("ingredient_id")),
            ("unmapped_rows", "info", ~mapped),
        ],
    )
    low = F.when((F.col("check") == "unmapped_rows") & (F.col("violations") > 0.3 * F.col("total_records")), "warning")
    return base.withColumn("severity", F.coalesce(low, "severity"))


def recipe_nutrition_contract(df: DataFrame) -> DataFrame:
    """Recipe nutrition contract."""
    measures = ["total_calories_kcal", "total_protein_g", "total_fat_g", "total_carbs_g", "total_fiber_g", "per_serving_calories_kcal", "per_serving_protein_g"]
    return contract(
        df, "recipe_nutrition",
        [(f"negative_{m}", "error", F.col(m) < 0) for m in measures]
        + [
            ("bad_tier", "error", ~F.col("nutrition_quality").isin(rules.NUTRITION_TIERS)),
            ("zero_calories", "warning", F.col("total_calories_kcal") == 0),
        ],
        "recipe_id",
    )


def line_nutrition_contract(df: DataFrame) -> DataFrame:
    """Line nutrition contract."""
    return contract(df, "line_nutrition", [(f"negative_{m}", "error", F.col(m) < 0) for m in ("energy_kcal", "protein_g", "fat_g", "carbs_g", "fiber_g", "sodium_mg")])


def alias_contract(df: DataFrame) -> DataFrame:
    """Alias contract."""
    return contract(
        df, "aliases",
        [
            ("bad_alias_id", "error", ~F.col("alias_id").rlike(r"^ALIAS\d{5}$")),
            ("bad_ingredient_id", "error", ~F.col("canonical_ingredient_id").rlike(r"^ING\d{5}$")),
            ("confidence_range", "error", (F.col("confidence") < 0) | (F.col("confidence") > 1)),
            ("bad_status", "error", ~F.col("review_status").isin(rules.ALIAS_STATUSES)),
        ],
        "alias_id",
    )


def key_gap(left: DataFrame, left_key: str, right: DataFrame, right_key: str, check: str, severity: str) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` does not have, as one result row."""
    keys = left.select(F.col(left_key).cast("string").alias("_k")).where(~F.coalesce(F.trim("_k") == "", F.lit(True))).distinct()
    known = right.select(F.col(right_key).cast("string").alias("_k")).distinct()
    return keys.join(known, "_k", "left_anti").agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(check).alias("check"), F.lit(severity).alias("severity"), "violations"
    )


def cross_integrity(recipes: DataFrame, nutrition: DataFrame, ingredients: DataFrame, links: DataFrame, aliases: DataFrame) -> DataFrame:
    """Foreign keys across the tables, both ways."""
    gaps = [
        (nutrition, "recipe_id", recipes, "recipe_id", "orphan_nutrition", "error"),
        (recipes, "recipe_id", nutrition, "recipe_id", "recipe_without_nutrition", "error"),
        (links, "recipe_id", recipes, "recipe_id", "orphan_links", "error"),
        (recipes, "recipe_id", links, "recipe_id", "recipe_without_links", "warning"),
        (links, "ingredient_id", ingredients, "ingredient_id", "unknown_ingredient", "error"),
        (ingredients, "ingredient_id", links, "ingredient_id", "unused_ingredient", "warning"),
        (aliases, "canonical_ingredient_id", ingredients, "ingredient_id", "orphan_alias", "error"),
    ]
    return reduce(DataFrame.unionByName, [key_gap(*g) for g in gaps])


def ontology_report(canonical: DataFrame, aliases: DataFrame) -> DataFrame:
    """Ontology structure: D2 and D6 checks and orphan aliases."""
    gap = key_gap(aliases, "canonical_ingredient_id", canonical, "ingredient_id", "orphan_alias", "error")
    parts = [ingredient_contract(canonical), alias_contract(aliases)]
    rows = [p.select("check", "severity", "violations") for p in parts] + [gap]
    return reduce(DataFrame.unionByName, rows)


def coerce_recipes(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed rows and a reject table with reasons.

    Servings are whole and at least 1, blank servings become 1, flags accept the
    usual truthy words, times must be non-negative integers.
    """
    served = F.col("servings").try_cast("double")
    typed = raw.withColumns(
        {
            "_servings": F.when(blank("servings"), 1).otherwise(F.greatest(F.lit(1), F.floor(served).cast("int"))),
            "_time": F.col("total_time_min").try_cast("int"),
            "_veg": F.lower(F.trim(F.col("vegetarian").cast("string"))).isin(rules.TRUE_WORDS),
        }
    )
    reasons = F.array_compact(
        F.array(
            F.when(~text_or_empty(F.col("recipe_id")).rlike(r"^R\d{5,}$"), "recipe_id"),
            F.when(blank("recipe_name"), "recipe_name"),
            F.when(~blank("servings") & served.isNull(), "servings"),
            F.when(~blank("total_time_min") & (F.col("_time").isNull() | (F.col("_time") < 0)), "total_time_min"),
        )
    )
    checked = typed.withColumn("reasons", reasons)
    good = checked.where(F.size("reasons") == 0).select(
        "recipe_id", "recipe_name", F.col("_servings").alias("servings"), F.col("_time").alias("total_time_min"), F.coalesce("_veg", F.lit(False)).alias("vegetarian")
    )
    return good, checked.where(F.size("reasons") > 0).select("recipe_id", "reasons")


def unit_sanity(lines: DataFrame, recipes: DataFrame) -> DataFrame:
    """Implausible amounts, first rule that hits per line.

    ``lines`` carries quantity, unit, parsed_quantity, normalized_unit and grams.
    """
    joined = lines.join(recipes.select("recipe_id", "servings"), "recipe_id", "left")
    served = F.when(F.col("servings") > 0, F.col("servings").cast("double")).otherwise(1.0)
    rows = joined.withColumns(
        {"_qty": parse_quantity("quantity")["quantity"], "_unit": normalize_unit("unit"), "_served": served, "per_serving_mass_g": rnd(F.col("grams") / served, 2)}
    )
    big = F.col("parsed_quantity") >= 5.0
    rule = (
        F.when((F.col("_unit") == "kg") & (F.col("_qty") >= 20.0), F.array(F.lit("CRITICAL"), F.lit("mass_prefix")))
        .when((F.col("_unit") == "liter") & (F.col("_qty") >= 20.0), F.array(F.lit("CRITICAL"), F.lit("volume_prefix")))
        .when(F.col("per_serving_mass_g") > 2500.0, F.array(F.lit("CRITICAL"), F.lit("mass_per_serving")))
        .when((F.col("_served") <= 6) & (F.col("normalized_unit") == "kg") & big, F.array(F.lit("HIGH"), F.lit("bulk_mass")))
        .when((F.col("_served") <= 6) & (F.col("normalized_unit") == "liter") & big, F.array(F.lit("HIGH"), F.lit("bulk_volume")))
        .when(F.col("per_serving_mass_g") > 1200.0, F.array(F.lit("MEDIUM"), F.lit("mass_per_serving")))
    )
    return (
        rows.withColumn("_rule", rule)
        .where(F.col("_rule").isNotNull())
        .withColumns({"severity": F.col("_rule")[0], "reason": F.col("_rule")[1]})
        .drop("_qty", "_unit", "_served", "_rule")
    )


def nutrition_outliers(recipe_rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Extreme recipes and lines, one row per (recipe, metric).

    Of several lines with the same metric the first line is kept.
    """
    kcal = recipe_rows.where(F.col("per_serving_calories_kcal") > 5000.0).select(
        "recipe_id", F.lit("per_serving_calories_kcal").alias("metric"), rnd("per_serving_calories_kcal", 2).alias("value"), F.lit("CRITICAL").alias("severity")
    )
    served = F.when(F.col("servings") > 0, F.col("servings").cast("double")).otherwise(1.0)
    small = lines.join(recipe_rows.select("recipe_id", "servings"), "recipe_id", "left").where(served <= 10.0)
    unit, qty = F.lower(text_or_empty(F.col("normalized_unit"))), F.col("parsed_quantity")
    heavy = F.coalesce(F.col("grams") >= 10000.0, F.lit(False))

    def hit(cond: Column, metric: str, value: Column) -> Column:
        return F.when(cond, F.struct(F.lit(metric).alias("metric"), value.cast("double").alias("value")))

    hits = F.array_compact(
        F.array(
            hit(heavy, "ingredient_mass_g", rnd("grams", 2)),
            hit(~heavy & unit.isin("kg", "kilogram", "kilograms") & (qty >= 10.0), "ingredient_mass_kg", qty),
            hit(unit.isin("liter", "l", "liters", "litre", "litres") & (qty >= 10.0), "liquid_volume_l", qty),
        )
    )
    per_line = small.select("recipe_id", "line_no", F.explode(hits).alias("_h"))
    first = per_line.groupBy("recipe_id", F.col("_h.metric").alias("metric")).agg(F.min(F.struct("line_no", "_h.value")).alias("_v"))
    return kcal.unionByName(first.select("recipe_id", "metric", F.col("_v.value").alias("value"), F.lit("HIGH").alias("severity")))


def discrete_audit(lines: DataFrame) -> DataFrame:
    """Counted items that could have been converted by a container measure.

    ``lines`` carries the output of ``add_grams`` and ``has_unsafe_measure``.
    """
    counted = F.coalesce(F.col("normalized_unit"), F.lit("piece")) == "piece"
    target = F.col("original_ingredient").rlike(rules.DISCRETE_TARGETS) | text_or_empty(F.col("canonical_ingredient")).rlike(rules.DISCRETE_TARGETS)
    rows = lines.where(counted & (target | F.col("has_unsafe_measure")) & F.col("parsed_quantity").isNotNull())
    measured = F.col("conversion_status") == "CNF_MEASURE"
    calibrated = F.lower(F.trim("canonical_ingredient")).isin(*rules.ITEM_GRAMS)
    decision = F.when(measured & calibrated, "EXACT_CALIBRATION").when(measured, "EXACT_CNF_DISCRETE").otherwise("UNAVAILABLE")
    selected = (
        F.when(measured, F.col("conversion_status")).when(F.col("has_unsafe_measure"), "REJECTED_CONTAINER_MEASURE").otherwise("NONE")
    )
    return rows.withColumns({"decision": decision, "selected_measure": selected})


def unsafe_conversions(lines: DataFrame) -> DataFrame:
    """Counted lines whose note names a container measure; must be none."""
    counted = F.col("unit").isNull() | (F.col("unit") == "piece")
    return lines.agg(count_where(counted & text_or_empty(F.col("calculation_notes")).rlike(rules.UNSAFE_NOTE)).alias("unsafe_conversions"))


def nutrition_checks(source: DataFrame, lines: DataFrame, recipe_rows: DataFrame, recipes: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Alignment, enums, and totals recomputed for every recipe.

    ``lines`` is read by several checks and by ``recipe_rows``: pass a written table.
    """
    ok = F.col("nutrition_quality").isin("EXACT", "APPROXIMATE")
    again = lines.groupBy("recipe_id").agg(F.sum(F.when(ok, F.col("energy_kcal")).otherwise(0.0)).alias("_kcal"), F.count(F.lit(1)).alias("_n"))
    r = recipe_rows.join(again, "recipe_id", "left")
    off = F.abs(F.col("total_calories_kcal") - F.coalesce("_kcal", F.lit(0.0))) > tolerance
    per = F.abs(F.col("per_serving_calories_kcal") - F.col("total_calories_kcal") / F.when(F.col("servings") > 0, F.col("servings"))) > tolerance
    row = r.agg(
        count_where(off).alias("total_mismatch"), count_where(per).alias("per_serving_mismatch"),
        count_where(F.coalesce("_n", F.lit(0)) != F.col("ingredient_count")).alias("line_count_mismatch"),
        count_where(~F.col("nutrition_quality").isin(rules.NUTRITION_TIERS)).alias("bad_tier"),
    )
    def n(df: DataFrame) -> Column:
        return df.agg(F.count(F.lit(1))).scalar()

    return row.withColumns(
        {
            "line_rows_lost": n(source) - n(lines),
            "recipe_rows_lost": n(recipes) - n(recipe_rows),
            "negative_lines": lines.agg(count_where(F.col("energy_kcal") < 0)).scalar(),
            "bad_line_quality": lines.agg(count_where(~F.col("nutrition_quality").isin("EXACT", "APPROXIMATE", "UNAVAILABLE"))).scalar(),
        }
    )


def import_checks(amounts: DataFrame, normalized: DataFrame, foods: DataFrame) -> DataFrame:
    """Nutrient import: rows, keys and values equal to the source."""
    key = ["food_code", "nutrient_code"]
    pair = amounts.select(*key, F.col("amount").alias("_a"), F.lit(1).alias("_l")).join(
        normalized.select(*key, F.col("amount").alias("_b"), F.lit(1).alias("_r")), key, "full"
    )
    row = pair.agg(
        count_where(F.col("_l").isNull()).alias("extra_rows"), count_where(F.col("_r").isNull()).alias("lost_rows"),
        count_where(F.col("_l").isNotNull() & F.col("_r").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed_values"),
        count_where(F.col("_b") < 0).alias("negative_values"), count_where(F.col("_r").isNotNull() & F.col("_b").isNull()).alias("blank_values"),
    )
    copies = normalized.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return row.withColumns(
        {
            "duplicate_pairs": copies.agg(F.count(F.lit(1))).scalar(),
            "foods_without_rows": key_gap(foods, "food_code", normalized, "food_code", "x", "x").select("violations").scalar(),
        }
    )


def candidate_checks(ingredients: DataFrame, candidates: DataFrame, foods: DataFrame) -> DataFrame:
    """Coverage, known codes, contiguous ranks, unique rows, NO_MATCH blank."""
    per = candidates.groupBy("ingredient_id").agg(
        F.max("candidate_rank").alias("_max"), F.countDistinct("candidate_rank").alias("_ranks"), F.count(F.lit(1)).alias("_n")
    )
    row = candidates.agg(
        F.count(F.lit(1)).alias("candidate_rows"),
        count_where((F.col("selection_status") == "NO_MATCH") & F.col("food_code").isNotNull()).alias("no_match_with_food"),
        count_where(~F.col("selection_status").isin("AUTO_CANDIDATE", "REVIEW", "NO_MATCH")).alias("bad_status"),
    )
    return row.withColumns(
        {
            "not_contiguous": per.agg(count_where((F.col("_max") != F.col("_ranks")) | (F.col("_ranks") != F.col("_n")))).scalar(),
            "uncovered": key_gap(ingredients, "ingredient_id", candidates, "ingredient_id", "x", "x").select("violations").scalar(),
            "unknown_foods": key_gap(candidates, "food_code", foods, "food_code", "x", "x").select("violations").scalar(),
        }
    )


def curation_checks(curated: DataFrame, ingredients: DataFrame, foods: DataFrame) -> DataFrame:
    """Curated decisions: unique, legal, filled where approved, blank where not matched."""
    status, code = F.col("curation_status"), F.col("cnf_food_code")
    base = contract(
        curated, "curated",
        [
            ("bad_status", "error", ~status.isin(rules.CURATION_STATUSES)),
            ("no_match_filled", "error", (status == "NO_MATCH") & (code.isNotNull() | F.col("cnf_food_name").isNotNull())),
            ("approved_blank", "error", (status == "APPROVED") & (code.isNull() | F.col("cnf_food_name").isNull())),
            ("blank_reason", "error", blank("curation_reason")),
        ],
        "ingredient_id",
    ).select("check", "severity", "violations")
    gaps = [
        key_gap(ingredients, "ingredient_id", curated, "ingredient_id", "ingredient_without_decision", "error"),
        key_gap(curated, "ingredient_id", ingredients, "ingredient_id", "unknown_ingredient", "error"),
        key_gap(curated.where(code.isNotNull()), "cnf_food_code", foods, "food_code", "unknown_food", "error"),
    ]
    return reduce(DataFrame.unionByName, [base, *gaps])


def fingerprint(df: DataFrame, digits: int = 4) -> Column:
    """SHA-256 of a row: keys sorted, blanks null, floats rounded, JSON text."""
    parts = []
    for f in sorted(df.schema.fields, key=lambda x: x.name):
        kind = f.dataType.typeName()
        c = F.col(f.name)
        value = rnd(c, digits).cast("decimal(38,4)").cast("string") if kind in ("double", "float") else F.nullif(F.trim(c.cast("string")), F.lit(""))
        parts.append(F.concat(F.lit(f'"{f.name}":'), F.coalesce(F.concat(F.lit('"'), value, F.lit('"')), F.lit("null"))))
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)


def table_parity(source: DataFrame, copy: DataFrame, key: str) -> DataFrame:
    """Row counts, keys missing on either side and rows that differ (D17), by one full join on the key."""
    def keyed(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(key), fingerprint(df).alias("_f")).groupBy(key).agg(
            F.count(F.lit(1)).alias(f"_{name}_n"), F.sum(F.conv(F.substring("_f", 1, 12), 16, 10).cast("decimal(20,0)")).alias(f"_{name}_f")
        )

    both = keyed(source, "s").join(keyed(copy, "c"), key, "full")
    return both.agg(
        F.coalesce(F.sum("_s_n"), F.lit(0)).alias("source_rows"), F.coalesce(F.sum("_c_n"), F.lit(0)).alias("copy_rows"),
        count_where(F.col("_c_n").isNull()).alias("missing_in_copy"), count_where(F.col("_s_n").isNull()).alias("extra_in_copy"),
        count_where(F.col("_s_n").isNotNull() & F.col("_c_n").isNotNull() & ((F.col("_s_f") != F.col("_c_f")) | (F.col("_s_n") != F.col("_c_n")))).alias("different_rows"),
    )


def recommendation_checks(recs: DataFrame, k: int, rejected: DataFrame) -> DataFrame:
    """Bounds, order, duplicates and excluded rows of a recommendation table."""
    per = recs.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("_n"), F.countDistinct("recipe_id").alias("_ids"), F.max("rank").alias("_max"),
        F.array_sort(F.collect_list(F.struct("rank", "hybrid_score"))).alias("_o"),
    )
    falling = F.aggregate("_o", F.struct(F.lit(True).alias("ok"), F.lit(2.0).alias("last")), lambda a, x: F.struct(
        (a["ok"] & (x["hybrid_score"] <= a["last"] + 1e-6)).alias("ok"), x["hybrid_score"].alias("last")))["ok"]
    row = per.agg(
        count_where(F.col("_n") != F.col("_ids")).alias("duplicate_recipes"), count_where(F.col("_max") != F.col("_n")).alias("rank_gaps"),
        count_where(F.col("_n") > k).alias("too_long"), count_where(~falling).alias("order_broken"),
    )
    scores = ["hybrid_score", "similarity_score", "ingredient_match_score", "nutrition_score", "preference_score"]
    out = reduce(lambda a, b: a | b, [(F.col(c) < 0) | (F.col(c) > 1) for c in scores])
    back = recs.join(rejected.select("request_id", "recipe_id"), ["request_id", "recipe_id"], "left_semi")
    return row.withColumns(
        {
            "score_out_of_range": recs.agg(count_where(out)).scalar(),
            "rejected_readmitted": back.agg(F.count(F.lit(1))).scalar(),
        }
    )


def gate(results: DataFrame) -> DataFrame:
    """Pass or fail per dataset over contract result rows."""
    bad = (F.col("severity") == "error") & (F.col("violations") > 0)
    return results.groupBy("dataset").agg(
        F.max("total_records").alias("total_records"), count_where(bad).alias("errors"),
        count_where((F.col("severity") == "warning") & (F.col("violations") > 0)).alias("warnings"),
    ).withColumn("is_valid", F.col("errors") == 0)
