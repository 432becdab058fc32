"""Dietary and allergen text detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import rules
from larder.functions.common import fence, text_or_empty, words_regex


def clean_context(c: Column | str) -> Column:
    """Lower-cased text without negations, mock meats, masala names and serving hints (F1)."""
    text = F.lower(F.trim(text_or_empty(c)))
    for pattern, replacement in rules.CONTEXT_CLEANERS:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def has_any(text: Column, phrases: list[str]) -> Column:
    return text.rlike(words_regex(phrases, boundary=False))


def _non_veg(low: Column, text: Column) -> Column:
    only_eggplant = has_any(low, rules.EGGPLANT_WORDS) & ~has_any(
        F.regexp_replace(low, rules.EGGPLANT_PATTERN, " "), rules.EGGPLANT_OVERRIDES
    )
    named = "(?i)" + "|".join(rules.NON_VEG_PATTERNS)
    ladder = F.when(only_eggplant, F.lit(None).cast("string")).when(text.rlike(named), F.regexp_extract(text, named, 0))
    for term, pattern, excuses in rules.GUARDED_NON_VEG:
        ladder = ladder.when(text.rlike(pattern) & ~has_any(text, excuses), F.lit(term))
    return ladder


def _listed(text: Column, names: list[str]) -> Column:
    """First name of the list present as whole words, minding plant-based exceptions."""
    ladder = None
    for name in names:
        hit = text.rlike(rf"\b{name}\b")
        if name in rules.PLANT_EXCEPTIONS:
            hit = hit & ~has_any(text, rules.PLANT_EXCEPTIONS[name])
        ladder = F.when(hit, F.lit(name)) if ladder is None else ladder.when(hit, F.lit(name))
    return ladder


TERMS = ("nonveg_term", "nonvegan_term", "satvik_term", "jain_term", "dairy")


def add_diet_terms(df: DataFrame, source: str) -> DataFrame:
    """Adds the first offending term per diet and a dairy flag.

    The cleaned text is projected once and then read by every detector. The list
    order fixes which term is reported. Run it on distinct texts: ingredient
    phrases repeat far more often than they vary.
    """
    out = df.withColumns({"_low": F.lower(F.trim(text_or_empty(F.col(source)))), "_ctx": clean_context(source)})
    out = out.withColumns({"nonveg_term": _non_veg(F.col("_low"), F.col("_ctx")), "_ctx2": clean_context("_ctx")})
    out = out.withColumns(
        {
            "nonvegan_term": F.coalesce(_non_veg(F.col("_ctx"), F.col("_ctx2")), _listed(F.col("_ctx"), rules.NON_VEGAN_NAMES)),
            "satvik_term": _listed(F.col("_ctx"), rules.SATVIK_PROHIBITED),
            "jain_term": _listed(F.col("_ctx"), rules.JAIN_PROHIBITED),
            "dairy": _listed(F.col("_low"), rules.DAIRY_NAMES).isNotNull(),
        }
    )
    return fence(out.drop("_low", "_ctx", "_ctx2"))


def label_is_non_veg(label: Column) -> Column:
    return has_any(F.lower(text_or_empty(label)), rules.EXPLICIT_NON_VEG_LABELS)


def label_exempts_flag(label: Column) -> Column:
    return has_any(F.lower(text_or_empty(label)), rules.FLAG_EXEMPT_LABELS)
