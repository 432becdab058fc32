"""Recipe and ingredient-text cleaning."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import rules, text
from larder.functions.common import blank_to_null, count_where, rnd, squeeze, text_or_empty, zero_pad
from larder.functions.quantity import leading_quantity, leading_unit


def normalize_recipes(raw: DataFrame) -> DataFrame:
    """Raw recipe rows to the recipe schema (A3, with A4 and A5)."""
    flags = text.diet_flags("Diet")
    return raw.select(
        zero_pad("R", F.col("Srno")).alias("recipe_id"),
        text.clean_title("TranslatedRecipeName").alias("recipe_name"),
        text.clean_title("RecipeName").alias("name_local"),
        squeeze(text_or_empty(F.col("Cuisine"))).alias("cuisine"),
        F.lit("").alias("region"),
        squeeze(text_or_empty(F.col("Course"))).alias("meal_type"),
        squeeze(text_or_empty(F.col("Course"))).alias("category"),
        squeeze(text_or_empty(F.col("TranslatedIngredients"))).alias("ingredients"),
        squeeze(text_or_empty(F.col("TranslatedInstructions"))).alias("instructions"),
        F.col("PrepTimeInMins").cast("int").alias("prep_time_min"),
        F.col("CookTimeInMins").cast("int").alias("cook_time_min"),
        F.col("TotalTimeInMins").cast("int").alias("total_time_min"),
        F.col("Servings").cast("int").alias("servings"),
        squeeze(text_or_empty(F.col("Diet"))).alias("diet_type"),
        *[flags[f].alias(f) for f in ("vegetarian", "vegan", "jain", "satvik")],
        F.lit("").alias("contains"),
        F.lit("M001").alias("source_id"),
        F.lit("CC BY 4.0").alias("source_license"),
    )


def explode_ingredient_text(recipes: DataFrame, parentheses_aware: bool = False) -> DataFrame:
    """One row per comma-separated ingredient with its parts.

    ``line_no`` is the place in the source text, kept because later rules depend
    on order. ``parentheses_aware`` keeps commas inside parentheses.
    """
    pattern = r",(?![^(]*\))" if parentheses_aware else ","
    lines = recipes.select(
        "recipe_id", F.posexplode(F.split(text_or_empty(F.col("ingredients")), pattern)).alias("_pos", "_raw")
    ).select("recipe_id", (F.col("_pos") + 1).alias("line_no"), squeeze("_raw").alias("original_ingredient"))
    return (
        lines.where(F.col("original_ingredient") != "")
        .withColumn("_amount", leading_quantity("original_ingredient"))
        .withColumn("_unit", leading_unit("_amount.rest"))
        .withColumn("_parts", text.split_preparation("_unit.rest"))
        .select(
            "recipe_id", "line_no", "original_ingredient", "_amount.quantity", "_unit.unit", "_parts.ingredient",
            "_parts.preparation",
        )
    )


def candidate_frequency(lines: DataFrame, column: str = "ingredient") -> DataFrame:
    """How often each normal phrase occurs."""
    phrase = text.candidate_phrase(column)
    # The blank test sits on an aggregate, not on the key: Spark would push a key
    # filter below the aggregate and evaluate the whole text chain once more.
    return (
        lines.groupBy(phrase.alias("candidate_ingredient"))
        .agg(F.count(F.lit(1)).alias("frequency"), F.max(F.length(phrase)).alias("_len"))
        .where(F.col("_len") > 0)
        .drop("_len")
    )


def with_clean_candidate(cands: DataFrame) -> DataFrame:
    """Adds ``cleaned_candidate`` and CLEANED/UNCHANGED."""
    cleaned = text.clean_candidate("candidate_ingredient")
    changed = F.lower(F.col("candidate_ingredient")) != F.col("cleaned_candidate")
    return cands.withColumn("cleaned_candidate", cleaned).withColumn(
        "cleanup_status", F.when(changed, "CLEANED").otherwise("UNCHANGED")
    )


def with_hindi_names(cands: DataFrame) -> DataFrame:
    """Adds ``normalized_candidate`` and NORMALIZED/UNCHANGED."""
    return cands.withColumn("normalized_candidate", text.hindi_to_english("cleaned_candidate")).withColumn(
        "normalization_status",
        F.when(F.col("normalized_candidate") != F.col("cleaned_candidate"), "NORMALIZED").otherwise("UNCHANGED"),
    )


def ingredient_profile(recipes: DataFrame, column: str = "ingredients", top: int = 100) -> DataFrame:
    """Most frequent raw ingredient strings."""
    return (
        recipes.select(F.explode(text.profile_items(column)).alias("ingredient"))
        .groupBy("ingredient")
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .orderBy(F.desc("occurrences"), "ingredient")
        .limit(top)
    )


def null_profile(df: DataFrame) -> DataFrame:
    """Null count of every column in one pass."""
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[count_where(F.col(c).isNull()).alias(c) for c in df.columns])
    return one.unpivot(["_rows"], df.columns, "column_name", "null_count").withColumnRenamed("_rows", "row_count")


def value_profile(df: DataFrame, columns: Sequence[str], top: int = 20) -> DataFrame:
    """Most frequent values of each listed column."""
    parts = [
        df.groupBy(F.col(c).cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .orderBy(F.desc("occurrences"), F.asc_nulls_last("value"))
        .limit(top)
        .select(F.lit(c).alias("column_name"), "value", "occurrences")
        for c in columns
    ]
    return reduce(DataFrame.unionByName, parts)


def mapping_template(cands: DataFrame) -> DataFrame:
    """Candidates with empty mapping columns for review."""
    blank = {c: F.lit("") for c in ("canonical_ingredient", "ingredient_form", "category")}
    return cands.withColumns(blank).withColumn("mapping_status", F.lit("REVIEW"))


def approved_cuisine(c: Column | str) -> Column:
    """True only for an approved cuisine label; missing labels are not approved."""
    return F.coalesce(text.cuisine_key(c).isin(rules.APPROVED_CUISINES), F.lit(False))


def list_recipes(
    recipes: DataFrame,
    page: int,
    page_size: int,
    order: Sequence[str],
    equals: dict[str, str] | None = None,
    flags: dict[str, bool] | None = None,
    cuisine: str | None = None,
) -> DataFrame:
    """One catalogue page with the total and page count.

    The page is a top-n of the ordered scan and the total a scalar subquery, so
    neither puts all rows into one task.
    """
    rows = recipes
    if cuisine is not None:
        rows = rows.where(approved_cuisine("cuisine") & (text.cuisine_key("cuisine") == text.cuisine_key(F.lit(cuisine))))
    for name, value in (equals or {}).items():
        rows = rows.where(F.lower(name) == value.lower().strip())
    for name, value in (flags or {}).items():
        rows = rows.where(F.col(name) == F.lit(value))
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        rows.orderBy(*order)
        .offset((page - 1) * page_size)
        .limit(page_size)
        .withColumn("total", total)
        .withColumn("total_pages", F.greatest(F.lit(1), F.ceil(F.col("total") / page_size)).cast("long"))
    )


def _finite(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), rnd(v, 3)).alias(c)


def recipe_details(recipes: DataFrame, nutrition: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Recipe with its nutrition, ingredient text as an array, finite rounded numbers."""
    items = F.filter(
        F.transform(F.split(text_or_empty(blank_to_null("ingredients")), ","), lambda s: F.trim(s)), lambda s: s != ""
    )
    picked = nutrition.select("recipe_id", *[_finite(m) for m in measures])
    return recipes.withColumn("ingredients", items).join(picked, "recipe_id", "left")
