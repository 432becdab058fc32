"""Text expressions for titles, phrases, tokens and documents (A, B, E)."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from larder.functions import rules
from larder.functions.common import blank_to_null, col_of, fence, lookup, squeeze, text_or_empty, words_regex

NON_ASCII = r"[^\x00-\x7F]"


@F.pandas_udf(StringType())  # not as text: workers import this module and have no session to read it
def _decomposed(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKD", v), na_action="ignore")


@F.pandas_udf(StringType())  # not as text: workers import this module and have no session to read it
def _composed_folded(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v).casefold(), na_action="ignore")


def decomposed(c: Column | str) -> Column:
    """NFKD form: full-width letters, ligatures and composed accents as plain parts.

    Spark has no builtin for this. Only values that hold a non-ASCII character
    pass through Arrow; for all others the batch holds a null.
    """
    return F.coalesce(_decomposed(F.when(col_of(c).rlike(NON_ASCII), col_of(c))), col_of(c))


def folded(c: Column | str) -> Column:
    """NFKC form with case folded; ASCII text is lower-cased in the JVM."""
    return F.coalesce(_composed_folded(F.when(col_of(c).rlike(NON_ASCII), col_of(c))), F.lower(col_of(c)))


def clean_title(c: Column | str) -> Column:
    """Title without sponsor and appliance clauses (A4)."""
    title = squeeze(text_or_empty(c))
    sponsor = "(?i)" + "|".join(f"(?:{p})" for p in rules.TITLE_SPONSOR_PATTERNS)
    cut = F.trim(F.regexp_replace(title, sponsor, ""))
    return F.when(title.rlike(sponsor), squeeze(F.regexp_replace(cut, r"\s+-\s*$", ""))).otherwise(title)


def diet_flags(c: Column | str) -> Column:
    """Four flags of a diet label (A5)."""
    label = F.lower(squeeze(text_or_empty(c)))

    def any_of(words: Sequence[str]) -> Column:
        return label.rlike(words_regex(words, boundary=False))

    meat = any_of(rules.NON_VEG_LABEL_WORDS)
    vegan = label.contains("vegan")
    satvik = any_of(rules.SATVIK_LABEL_WORDS)
    return F.struct(
        (~meat & (label.contains("vegetarian") | vegan | satvik)).alias("vegetarian"),
        (vegan & ~meat).alias("vegan"),
        F.lit(False).alias("jain"),
        (satvik & ~meat).alias("satvik"),
    )


def split_preparation(c: Column | str) -> Column:
    """``struct(ingredient, preparation)`` around the first spaced dash."""
    parts = F.split(col_of(c), r"\s+-\s+", 2)
    return F.struct(
        squeeze(F.get(parts, 0)).alias("ingredient"),
        squeeze(text_or_empty(F.get(parts, 1))).alias("preparation"),
    )


def candidate_phrase(c: Column | str) -> Column:
    """Lower-cased phrase without parentheses and trailing dots."""
    text = F.regexp_replace(F.lower(F.trim(text_or_empty(c))), r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s*\([^)]*\)", ""), r"^[ .]+|[ .]+$", ""))


def clean_candidate(c: Column | str) -> Column:
    """Phrase without quantity and preparation prefixes."""
    text = F.lower(F.trim(text_or_empty(c)))
    for pattern in rules.CANDIDATE_PREFIX_PATTERNS:
        text = F.regexp_replace(text, pattern, "")
    for prefix in rules.CANDIDATE_PREPARATION_PREFIXES:
        text = F.regexp_replace(text, f"^{prefix}", "")
    return squeeze(text)


def hindi_to_english(c: Column | str) -> Column:
    """English name of a Hindi ingredient word; other words unchanged."""
    word = F.lower(F.trim(text_or_empty(c)))
    return F.coalesce(lookup(word, rules.HINDI_LEXICON), word)


def cuisine_key(c: Column | str) -> Column:
    label = F.lower(squeeze(col_of(c)))
    return F.when(label != "", label)


_UNITS = words_regex(list(rules.UNIT_SPELLINGS), boundary=False)
QUANTITY_PREFIX = f"^{rules.LEADING_RANGE}{rules.LEADING_NUMBER}" + r"\s*(?:" + _UNITS + r"\b\s*)?"


def add_phrase_key(df: DataFrame, source: str, name: str = "phrase_key", trace: str | None = None) -> DataFrame:
    """Adds the normal form of an ingredient phrase (B1) and, if asked, its audit steps.

    Built as a chain of projections rather than one nested expression: each step
    is read several times by the next, and nesting would repeat it every time.
    Unicode letters are kept at the ends, so phrases in other scripts survive;
    apply ``decomposed`` first where text may be non-ASCII.
    """
    protected = rules.PROTECTED_PHRASES
    out = df.withColumn("_k0", F.lower(squeeze(text_or_empty(F.col(source)))))
    out = out.withColumn(
        "_k1",
        F.regexp_replace(squeeze(F.regexp_replace("_k0", r"\([^)]*\)", "")), r"^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+$", ""),
    )
    out = out.withColumn("_cut", F.trim(F.regexp_replace("_k1", QUANTITY_PREFIX, "")))
    out = out.withColumn(
        "_k2", F.when(~F.col("_k1").isin(protected) & (F.col("_cut") != ""), F.col("_cut")).otherwise(F.col("_k1"))
    )
    last = "_k2"
    for i, word in enumerate(rules.GENERIC_QUALIFIERS):
        step = f"_q{i}"
        shorter = F.trim(F.regexp_replace(last, f"^{word} ", ""))
        out = out.withColumn(step, F.when(F.col(last).isin(protected), F.col(last)).otherwise(shorter))
        last = step
    singular = F.array_join(
        F.transform(F.split(squeeze(last), " "), lambda t: F.coalesce(lookup(t, rules.CONTROLLED_PLURALS), t)), " "
    )
    out = out.withColumn(name, F.coalesce(F.when(F.col("_k0").isin(protected), F.col("_k0")).otherwise(singular), F.lit("")))
    if trace is not None:
        kept = F.col("_k0").isin(protected)
        out = out.withColumn(
            trace,
            F.array_compact(
                F.array(
                    F.concat(F.lit("initial_clean:'"), "_k0", F.lit("'")),
                    F.when(kept, F.concat(F.lit("protected_phrase_exact_match:'"), "_k0", F.lit("'"))),
                    F.when(~kept & F.col("_k0").rlike(r"\([^)]+\)"), F.lit("extracted_parentheticals")),
                    F.when(~kept & (F.col("_k1") != F.col("_k2")), F.lit("removed_quantity_prefix")),
                    F.when(~kept & (F.col("_k2") != F.col(last)), F.lit("removed_qualifier")),
                    F.when(~kept, F.concat(F.lit("final_normalized:'"), name, F.lit("'"))),
                )
            ),
        )
    steps = ["_k0", "_k1", "_cut", "_k2"] + [f"_q{i}" for i in range(len(rules.GENERIC_QUALIFIERS))]
    return fence(out.drop(*steps))


PREPARATION_EDGE = words_regex(rules.PREPARATION_WORDS, boundary=False)


def add_edge_preparation(df: DataFrame, source: str, word: str, rest: str) -> DataFrame:
    """Adds the first listed preparation word at either end of ``source`` (or "") and the text without it."""
    words = F.array(*[F.lit(w) for w in rules.PREPARATION_WORDS])
    out = df.withColumn("_low", F.lower(source)).withColumn(
        word,
        F.coalesce(
            F.get(
                F.filter(
                    words,
                    lambda w: F.startswith(F.col("_low"), F.concat(w, F.lit(" "))) | F.endswith(F.col("_low"), F.concat(F.lit(" "), w)),
                ),
                0,
            ),
            F.lit(""),
        ),
    )
    n = F.length(word)
    at_front = F.startswith(F.col("_low"), F.concat(F.col(word), F.lit(" ")))
    cut = F.when(at_front, F.substring(source, n + 2, F.length(source))).otherwise(
        F.substring(source, F.lit(1), F.length(source) - n - 1)
    )
    return out.withColumn(rest, F.when(F.col(word) == "", F.col(source)).otherwise(F.trim(cut))).drop("_low")


def add_parsed_line(df: DataFrame, source: str) -> DataFrame:
    """Adds quantity, unit, ingredient and preparation of a free-text line (A10)."""
    from larder.functions.quantity import parse_quantity

    dash = r"(?<!\d)\s*[-–—]\s*(?!\d)"
    lead = rf"(?i)^{rules.LEADING_RANGE}({rules.LEADING_NUMBER})\s*(.*)$"
    out = df.withColumn("_text", squeeze(decomposed(text_or_empty(F.col(source)))))
    out = out.withColumns(
        {
            "_taste": F.col("_text").rlike(rules.TO_TASTE_PATTERN),
            "_season": F.trim(F.get(F.split("_text", rules.TO_TASTE_CUT), 0)),
            "_whole": F.regexp_replace("_text", r"(\d+)\s*[-–—]\s*(\d+\s*/\s*\d+)", "$1 $2"),
        }
    )
    out = out.withColumns({"_dash": F.split("_whole", dash, 2), "_comma": F.split("_whole", ", ", 2)})
    by_dash = F.size("_dash") > 1
    by_comma = (F.size("_comma") > 1) & F.lower(text_or_empty(F.get("_comma", 1))).rlike(PREPARATION_EDGE)
    out = out.withColumns(
        {
            "_core": F.when(by_dash, F.trim(F.get("_dash", 0))).when(by_comma, F.trim(F.get("_comma", 0))).otherwise(F.col("_whole")),
            "_said": F.when(by_dash, F.trim(F.get("_dash", 1))).when(by_comma, F.trim(F.get("_comma", 1))),
        }
    )
    out = out.withColumn("_amount", F.trim(F.regexp_extract("_core", lead, 1)))
    out = out.withColumn("_number", parse_quantity("_amount")["quantity"])
    out = out.withColumn("_rest", F.when(F.col("_number").isNotNull(), F.trim(F.regexp_extract("_core", lead, 2))).otherwise(F.col("_core")))
    out = out.withColumn("_unit", lookup(F.regexp_replace(F.lower(F.get(F.split("_rest", " "), 0)), r"[.,]+$", ""), rules.UNIT_SPELLINGS))
    out = out.withColumn("_name", F.when(F.col("_unit").isNotNull(), F.trim(F.regexp_replace("_rest", r"^\S+\s*", ""))).otherwise(F.col("_rest")))
    out = add_edge_preparation(out, "_name", "_word", "_bare")
    out = out.withColumn("_phrase", F.when(F.col("_taste"), F.col("_season")).otherwise(F.col("_bare")))
    out = add_phrase_key(out, "_phrase", "ingredient")
    out = out.withColumns(
        {
            "quantity": F.when(~F.col("_taste"), F.col("_number")),
            "unit": F.when(~F.col("_taste"), F.col("_unit")),
            "preparation": F.when(F.col("_taste"), F.lit("to taste")).otherwise(
                F.nullif(F.concat_ws(", ", "_said", F.nullif(F.col("_word"), F.lit(""))), F.lit(""))
            ),
        }
    )
    return fence(out.drop(*[c for c in out.columns if c.startswith("_")]))


def profile_items(c: Column | str) -> Column:
    """Ingredient strings of one comma list without digits and unit words."""
    return F.filter(
        F.transform(
            F.split(text_or_empty(c), ","),
            lambda s: F.trim(
                F.regexp_replace(
                    F.regexp_replace(F.lower(F.trim(s)), rules.PROFILE_QUANTITY_PATTERN, ""),
                    rules.PROFILE_UNIT_PATTERN,
                    "",
                )
            ),
        ),
        lambda s: s != "",
    )


def food_tokens(c: Column | str) -> Column:
    """Alphanumeric tokens with the food synonym map applied (B19); give it ``folded`` text where it may be non-ASCII."""
    tokens = F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(r"[\p{L}\p{N}]+"), 0)
    return F.transform(tokens, lambda t: F.coalesce(lookup(t, rules.FOOD_TOKEN_SYNONYMS), t))


def food_key(c: Column | str) -> Column:
    return F.array_join(food_tokens(c), " ")


def match_tokens(c: Column | str) -> Column:
    """Distinct food tokens that carry meaning for matching."""
    stop = F.array(*[F.lit(w) for w in rules.MATCH_STOPWORDS])
    return F.array_except(F.array_distinct(food_tokens(c)), stop)


def cues_in(c: Column | str, cues: Sequence[str]) -> Column:
    """Cue words present as whole words, in list order."""
    low = F.lower(text_or_empty(c))
    return F.array_compact(F.array(*[F.when(low.rlike(rf"\b{cue}\b"), F.lit(cue)) for cue in cues]))


def food_form(c: Column | str) -> Column:
    form = F.array_join(cues_in(c, rules.FOOD_FORM_CUES), ";")
    return F.when(form == "", rules.NO_FORM).otherwise(form)


def nutrient_slug(code: Column | str, name: Column | str) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(col_of(name)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    code = col_of(code).cast("string")
    return F.coalesce(lookup(code, rules.NUTRIENT_COLUMN_NAMES), F.concat(F.lit("cnf_"), slug, F.lit("_"), code))


def corpus_text(c: Column | str) -> Column:
    """Lower case, ASCII punctuation to spaces, squeezed."""
    return squeeze(F.regexp_replace(F.lower(text_or_empty(c)), r"\p{Punct}", " "))


def word_tokens(c: Column | str) -> Column:
    """Words of at least two word characters."""
    return F.regexp_extract_all(F.lower(col_of(c)), F.lit(r"[\p{L}\p{N}_]{2,}"), 0)


def uni_and_bigrams(tokens: Column) -> Column:
    shifted = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))), shifted, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(tokens, pairs)


def labelled(label: str, c: Column | str) -> Column:
    """``label: value`` or NULL, so that ``concat_ws`` skips missing parts."""
    value = blank_to_null(c)
    return F.when(value.isNotNull(), F.concat(F.lit(f"{label}: "), value))


def diet_tokens(diet: Column, flags: dict[str, Column]) -> Column:
    """Diet label and the flag names that it does not already state."""
    label = blank_to_null(diet)
    names = [
        F.when(F.coalesce(on, F.lit(False)) & (F.coalesce(F.lower(label), F.lit("")) != name.lower()), F.lit(name))
        for name, on in flags.items()
    ]
    return F.nullif(F.concat_ws(", ", label, *names), F.lit(""))


def semantic_text(
    name: Column, cuisine: Column, region: Column, meal: Column, category: Column | None, diet: Column | None,
    ingredients: Column | None,
) -> Column:
    """Labelled parts joined with ``". "`` (E8, E9); ``diet`` and ``ingredients`` are ready text."""
    parts = [name, labelled("Cuisine", cuisine), labelled("Region", region), labelled("Meal Type", meal)]
    if category is not None:
        same = F.lower(F.trim(text_or_empty(category))) == F.lower(F.trim(text_or_empty(meal)))
        parts.append(F.when(~same | (F.trim(text_or_empty(meal)) == ""), labelled("Category", category)))
    if diet is not None:
        parts.append(labelled("Diet", diet))
    if ingredients is not None:
        parts.append(labelled("Ingredients", ingredients))
    return F.concat_ws(". ", *parts)
