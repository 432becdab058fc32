"""Entity resolution: phrase to canonical ingredient, ingredient to food."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions import rules, text
from larder.functions.common import (
    count_where, fence, global_row_number, lookup, rnd, text_or_empty, top_k, words_regex, zero_pad,
)
from larder.sources.shared import materialize, measured_joins, scratch

# ---------------------------------------------------------------- candidate phrase -> canonical name


def auto_map(cands: DataFrame, direct: DataFrame, forms: DataFrame) -> DataFrame:
    """Direct dictionary first, then the (canonical, form) dictionary; else REVIEW (B2).

    ``direct(candidate, canonical)`` and ``forms(candidate, canonical, form)`` hold
    one row per candidate. Join strategy is left to the planner's size estimate.
    """
    key = F.lower(F.trim("candidate_ingredient"))
    d = direct.select(F.col("candidate").alias("_d"), F.col("canonical").alias("_dc"))
    f = forms.select(F.col("candidate").alias("_f"), F.col("canonical").alias("_fc"), F.col("form").alias("_ff"))
    return (
        cands.withColumn("_key", key)
        .join(d, F.col("_key") == F.col("_d"), "left")
        .join(f, F.col("_key") == F.col("_f"), "left")
        .withColumns(
            {
                "canonical_ingredient": F.coalesce("_dc", "_fc", F.lit("")),
                "ingredient_form": F.when(F.col("_dc").isNotNull(), "default").otherwise(F.coalesce("_ff", F.lit(""))),
                "mapping_status": F.when(F.coalesce("_dc", "_fc").isNotNull(), "AUTO").otherwise("REVIEW"),
            }
        )
        .drop("_key", "_d", "_dc", "_f", "_fc", "_ff")
    )


def final_map(cands: DataFrame, previous: DataFrame, rules_table: DataFrame) -> DataFrame:
    """Earlier AUTO decision (first per key), then the normalised rule, else REVIEW.

    ``previous`` carries ``ord``, its source order.
    """
    first = (
        previous.where(F.upper("mapping_status") == "AUTO")
        .groupBy(F.lower(F.trim("candidate_ingredient")).alias("_p"))
        .agg(F.min_by(F.struct("canonical_ingredient", "ingredient_form"), "ord").alias("_prev"))
    )
    r = rules_table.select(F.col("candidate").alias("_r"), F.struct("canonical", "form").alias("_rule"))
    return (
        cands.join(first, F.lower(F.trim("candidate_ingredient")) == F.col("_p"), "left")
        .join(r, F.lower(F.trim("normalized_candidate")) == F.col("_r"), "left")
        .withColumns(
            {
                "final_canonical_ingredient": F.coalesce("_prev.canonical_ingredient", "_rule.canonical", F.lit("")),
                "final_ingredient_form": F.coalesce("_prev.ingredient_form", "_rule.form", F.lit("")),
                "final_mapping_status": F.when(F.col("_prev").isNotNull() | F.col("_rule").isNotNull(), "AUTO").otherwise("REVIEW"),
            }
        )
        .drop("_p", "_prev", "_r", "_rule")
    )


def validate_mapping(mapping: DataFrame) -> DataFrame:
    """Adds validation status and note; known malformed values are corrected."""
    name = F.lower(F.trim(text_or_empty(F.col("final_canonical_ingredient"))))
    form = F.lower(F.trim(text_or_empty(F.col("final_ingredient_form"))))
    fixed_name = lookup(F.col("_name"), {k: v[0] for k, v in rules.MAPPING_CORRECTIONS.items()})
    fixed_form = lookup(F.col("_name"), {k: v[1] for k, v in rules.MAPPING_CORRECTIONS.items()})
    out = mapping.withColumns({"_name": name, "_form": form, "_auto": F.lower(F.trim("final_mapping_status"))})
    out = out.withColumns({"_fix": F.when(F.col("_auto") == "auto", fixed_name), "_fixform": fixed_form})
    suspicious = (
        (F.col("_name") == "")
        | ~F.col("_form").isin(rules.MAPPING_FORMS)
        | ((F.col("_form") != "default") & F.endswith(F.col("_name"), F.col("_form")))
    )
    status = (
        F.when(F.col("_auto") != "auto", "REVIEW")
        .when(F.col("_fix").isNotNull(), "CORRECTED")
        .when(suspicious, "SUSPICIOUS")
        .otherwise("VALID")
    )
    note = (
        F.when(F.col("_auto") == "review", "Requires ingredient mapping review")
        .when(F.col("_auto") != "auto", "Unknown mapping status")
        .when(F.col("_fix").isNotNull(), F.concat(F.lit("Corrected malformed mapping: "), "_name", F.lit(" → "), "_fix"))
        .when(suspicious, "Automatic mapping requires review")
        .otherwise("Validated automatic mapping")
    )
    return out.withColumns(
        {
            "validation_status": status,
            "validation_note": note,
            "final_canonical_ingredient": F.coalesce("_fix", "final_canonical_ingredient"),
            "final_ingredient_form": F.when(F.col("_fix").isNotNull(), F.col("_fixform")).otherwise(F.col("final_ingredient_form")),
        }
    ).drop("_name", "_form", "_auto", "_fix", "_fixform")


def category_of(name: Column, form: Column) -> Column:
    """Category by (name, form) override, else by name, else ``other``."""
    ladder = None
    for n, f, category in rules.CATEGORY_OF_FORM:
        hit = (name == n) & (form == f) if f else name == n
        ladder = F.when(hit, category) if ladder is None else ladder.when(hit, category)
    return ladder.otherwise(F.coalesce(lookup(name, rules.CATEGORY_OF_NAME), F.lit("other")))


def display_name_of(name: Column, form: Column) -> Column:
    """Special name of a (name, form) pair, else ``Name`` or ``Name (Form)``."""
    special = lookup(F.concat_ws("|", name, form), {"|".join(k): v for k, v in rules.DISPLAY_NAMES.items()})
    plain = F.when(form.isin("", "default"), F.initcap(name)).otherwise(
        F.concat(F.initcap(name), F.lit(" ("), F.initcap(form), F.lit(")"))
    )
    return F.coalesce(special, plain)


def _usable(mapping: DataFrame) -> DataFrame:
    return mapping.where(
        (F.upper("final_mapping_status") == "AUTO") & F.col("validation_status").isin("VALID", "CORRECTED")
    ).withColumns(
        {
            "canonical_name": F.lower(F.trim("final_canonical_ingredient")),
            "ingredient_form": F.lower(F.trim("final_ingredient_form")),
            "frequency": F.coalesce(F.col("frequency").cast("double"), F.lit(0.0)),
        }
    )


def canonical_by_top_frequency(mapping: DataFrame) -> DataFrame:
    """One row per (name, form): the most frequent spelling; ids in frequency order."""
    best = (
        _usable(mapping)
        .groupBy("canonical_name", "ingredient_form")
        .agg(F.max_by(F.struct("candidate_ingredient", "frequency"), F.struct("frequency", "candidate_ingredient")).alias("_b"))
        .select("canonical_name", "ingredient_form", "_b.candidate_ingredient", "_b.frequency", (-F.col("_b.frequency")).alias("_neg"))
    )
    return (
        global_row_number(best, ["_neg", "canonical_name", "ingredient_form"], "_n")
        .withColumn("ingredient_id", zero_pad("ING", F.col("_n")))
        .drop("_neg", "_n")
    )


def canonical_table(mapping: DataFrame) -> DataFrame:
    """Summed frequency and spelling count per (name, form); ids in sorted order."""
    grouped = _usable(mapping).groupBy("canonical_name", "ingredient_form").agg(
        F.sum("frequency").cast("long").alias("recipe_occurrence_count"),
        F.countDistinct("candidate_ingredient").alias("candidate_variant_count"),
    )
    return (
        global_row_number(grouped, ["canonical_name", "ingredient_form"], "_n")
        .withColumns(
            {
                "ingredient_id": zero_pad("ING", F.col("_n")),
                "display_name": display_name_of(F.col("canonical_name"), F.col("ingredient_form")),
                "category": category_of(F.col("canonical_name"), F.col("ingredient_form")),
            }
        )
        .drop("_n")
    )


# ---------------------------------------------------------------- linking lines


def _unambiguous(pairs: DataFrame, fields: list[str]) -> DataFrame:
    """Keys that reach exactly one target."""
    return (
        pairs.where(F.col("_key") != "")
        .groupBy("_key")
        .agg(F.min(F.struct(*fields)).alias("_lo"), F.max(F.struct(*fields)).alias("_hi"))
        .where(F.col("_lo") == F.col("_hi"))
        .select("_key", F.col("_lo").alias("_target"))
    )


LINK_FIELDS = ["ingredient_id", "canonical_ingredient", "display_name", "ingredient_form", "category"]


def link_lines(lines: DataFrame, canonical: DataFrame, mapping: DataFrame) -> DataFrame:
    """Link each line to one canonical ingredient when that is certain.

    Canonical and display names come first, then VALID mapping spellings; keys
    that reach two targets are dropped. Both lookups hold one row per key, so
    the row count of ``lines`` never changes.
    """
    canon = canonical.withColumnRenamed("canonical_name", "canonical_ingredient")
    names = reduce(
        DataFrame.unionByName,
        [canon.select(text.candidate_phrase(c).alias("_key"), *LINK_FIELDS) for c in ("canonical_ingredient", "display_name")],
    )
    valid = mapping.where(F.lower(F.trim("validation_status")) == "valid").withColumns(
        {"_name": text.candidate_phrase("final_canonical_ingredient"), "_form": text.candidate_phrase("final_ingredient_form")}
    )
    target = canon.withColumns({"_cname": text.candidate_phrase("canonical_ingredient"), "_cform": text.candidate_phrase("ingredient_form")})
    resolved = valid.join(
        target, (F.col("_name") == F.col("_cname")) & ((F.col("_form") == F.col("_cform")) | (F.col("_form") == "")), "inner"
    )
    spellings = resolved.select(
        F.explode(F.array(*[text.candidate_phrase(c) for c in ("candidate_ingredient", "cleaned_candidate", "normalized_candidate")])).alias("_key"),
        *LINK_FIELDS,
    )
    by_name = _unambiguous(names, LINK_FIELDS).withColumnRenamed("_target", "_by_name")
    by_spelling = _unambiguous(spellings, LINK_FIELDS).withColumnRenamed("_target", "_by_spelling")
    hit = F.coalesce("_by_name", "_by_spelling")
    drop = [c for c in LINK_FIELDS if c in lines.columns]
    return (
        lines.drop(*drop, "mapping_status", "mapping_source")
        .withColumn("_key", text.candidate_phrase("ingredient"))
        .join(by_name, "_key", "left")
        .join(by_spelling, "_key", "left")
        .withColumns({c: F.coalesce(hit[c], F.lit("")) for c in LINK_FIELDS})
        .withColumns(
            {
                "mapping_status": F.when(F.col("_by_name").isNotNull(), "MAPPED_CANONICAL")
                .when(F.col("_by_spelling").isNotNull(), "MAPPED_VALIDATED")
                .otherwise("REVIEW"),
                "mapping_source": F.when(F.col("_by_name").isNotNull(), "CANONICAL_DATABASE")
                .when(F.col("_by_spelling").isNotNull(), "VALIDATED_MAPPING")
                .otherwise("NONE"),
            }
        )
        .drop("_key", "_by_name", "_by_spelling")
    )


def link_invariants(lines: DataFrame, linked: DataFrame, canonical: DataFrame) -> DataFrame:
    """One row of violation counts; all zero when linking kept its promises."""
    legal = {"MAPPED_CANONICAL": "CANONICAL_DATABASE", "MAPPED_VALIDATED": "VALIDATED_MAPPING", "REVIEW": "NONE"}
    blank = reduce(lambda a, b: a & b, [F.col(c) == "" for c in LINK_FIELDS])
    known = canonical.select(F.col("ingredient_id").alias("_known")).distinct()
    return linked.join(known, F.col("ingredient_id") == F.col("_known"), "left").agg(
        F.abs(F.count(F.lit(1)) - lines.agg(F.count(F.lit(1)).alias("n")).scalar()).alias("row_count_change"),
        count_where((F.col("ingredient_id") != "") & F.col("_known").isNull()).alias("unknown_ids"),
        count_where(~F.col("mapping_status").isin(*legal)).alias("bad_status"),
        count_where(F.col("mapping_source") != lookup(F.col("mapping_status"), legal)).alias("bad_source"),
        count_where((F.col("mapping_status") == "REVIEW") & ~blank).alias("review_not_blank"),
    )


# ---------------------------------------------------------------- aliases


def alias_parts(c: Column | str) -> Column:
    """Synonyms written in parentheses, split on ``/`` and ``,`` and filtered."""
    inside = F.regexp_extract_all(text_or_empty(F.col(c) if isinstance(c, str) else c), F.lit(r"\(([^)]+)\)"), 1)
    parts = F.flatten(F.transform(inside, lambda p: F.transform(F.split(p, "[/,]"), lambda s: F.trim(s))))
    return F.filter(
        parts,
        lambda s: (F.length(s) >= 3)
        & ~s.rlike(r"\d")
        & ~F.lower(s).isin(rules.NON_ALIAS_DESCRIPTORS)
        & (F.size(F.split(F.trim(s), r"\s+")) <= 4),
    )


def compile_aliases(sources: DataFrame) -> DataFrame:
    """Alias table from ``(ingredient_id, alias, source, confidence, status, priority, ord)`` rows.

    The first (priority, ord) row per (ingredient, normal form) wins.
    """
    keyed = text.add_phrase_key(sources, "alias", "normalized_alias")
    fields = ["alias", "source", "confidence", "status"]
    best = (
        keyed.groupBy("ingredient_id", "normalized_alias")
        .agg(F.min_by(F.struct(*fields), F.struct("priority", "ord", "alias")).alias("_a"), F.max(F.length("normalized_alias")).alias("_len"))
        .where(F.col("_len") > 0)
        .select(
            F.col("ingredient_id").alias("canonical_ingredient_id"), F.trim("_a.alias").alias("alias"), "normalized_alias", "_a.source",
            "_a.confidence", F.col("_a.status").alias("review_status"), (-F.col("_a.confidence")).alias("_neg"),
        )
    )
    return (
        global_row_number(best, ["canonical_ingredient_id", "_neg", "alias", "normalized_alias"], "_n")
        .withColumn("alias_id", zero_pad("ALIAS", F.col("_n")))
        .drop("_neg", "_n")
    )


def alias_keys(aliases: DataFrame) -> DataFrame:
    """Lookup rows ``(key, kind, target)`` of the accepted aliases."""
    live = aliases.where(F.col("review_status") != "REJECTED").select(
        "alias_id", F.lower("alias").alias("_alias"), "normalized_alias",
        F.struct(F.col("canonical_ingredient_id").alias("ingredient_id"), F.col("confidence").cast("double").alias("confidence"), F.col("alias").alias("alias")).alias("target"),
    )
    exact = live.groupBy(F.col("_alias").alias("key")).agg(F.max_by("target", "alias_id").alias("target"))
    normal = live.groupBy(F.col("normalized_alias").alias("key")).agg(
        F.min_by("target", F.struct(-F.col("target.confidence"), "alias_id")).alias("target")
    )
    return exact.withColumn("kind", F.lit("ALIAS")).unionByName(normal.withColumn("kind", F.lit("NALIAS")))


def lookup_alias(phrases: DataFrame, aliases: DataFrame, column: str = "phrase") -> DataFrame:
    """Exact alias, else normalised alias."""
    keys = alias_keys(aliases)
    exact = keys.where(F.col("kind") == "ALIAS").select(F.col("key").alias("_e"), F.col("target").alias("_et"))
    normal = keys.where(F.col("kind") == "NALIAS").select(F.col("key").alias("_n"), F.col("target").alias("_nt"))
    base = text.add_phrase_key(phrases.withColumn("_exact", F.lower(F.trim(column))), column, "_norm")
    hit = F.coalesce("_et", "_nt")
    return (
        base.join(exact, F.col("_exact") == F.col("_e"), "left")
        .join(normal, F.col("_norm") == F.col("_n"), "left")
        .withColumns({"ingredient_id": hit["ingredient_id"], "confidence": hit["confidence"], "matched_alias": hit["alias"]})
        .drop("_exact", "_norm", "_e", "_et", "_n", "_nt")
    )


# ---------------------------------------------------------------- ontology and resolution


def ontology(canonical: DataFrame) -> DataFrame:
    """Diet, allergen and default-unit attributes of each canonical ingredient."""
    name, category = F.lower("canonical_name"), F.lower("category")
    out = canonical.withColumn(
        "vegetarian", ~name.rlike(words_regex(rules.NON_VEGETARIAN_NAMES)) & ~category.isin("meat", "egg")
    )
    flags = [F.when(category == k, F.lit(v)) for k, v in rules.ALLERGEN_BY_CATEGORY.items()]
    flags += [F.when(name.contains(k), F.lit(v)) for k, v in rules.ALLERGEN_BY_NAME.items()]
    return out.withColumns(
        {
            "vegan": F.col("vegetarian")
            & ~category.isin(rules.NON_VEGAN_CATEGORIES)
            & ~name.rlike(words_regex(rules.NON_VEGAN_NAMES, boundary=False)),
            "allergen_flags": F.array_sort(F.array_distinct(F.array_compact(F.array(*flags)))),
            "default_unit": F.coalesce(lookup(category, rules.DEFAULT_UNIT_BY_CATEGORY), F.lit("g")),
        }
    )


_EDGES = [(f"{w} ", f" {w}") for w in rules.PREPARATION_WORDS]
#: Rows that a task passes on at once.
STRIP_ROWS = 1 << 12


def _strips(phrase: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """What is left of ``phrase[start:end]`` without each fitting preparation word, in list order."""
    whole = phrase[start:end] if end - start <= 20 else None
    for front, back in _EDGES:
        if phrase.startswith(front, start, end) and whole not in rules.KEPT_AT_FRONT:
            i, j = start + len(front), end
        elif phrase.endswith(back, start, end) and whole not in rules.KEPT_AT_END:
            i, j = start, end - len(back)
        else:
            continue
        while i < j and phrase[i].isspace():
            i += 1
        while i < j and phrase[j - 1].isspace():
            j -= 1
        if i < j:
            yield i, j


def stripped_forms(phrase: str) -> Iterator[tuple[str, int, int]]:
    """(form, early, late) of a phrase and of all that stripping preparation words leaves of it, each once.

    A form is looked up as it stands at ``early``, then come the forms that one
    more word less leaves, first word first, and its normal form at ``late``: the
    first lookup by these numbers that finds something is the answer. A form met
    again has found nothing before. Places in the phrase stand for texts, so a
    phrase of n preparation words holds n * n / 2 pairs of numbers at most.
    """
    clock, seen = 1, {(0, len(phrase))}
    stack = [((0, len(phrase)), 0, _strips(phrase, 0, len(phrase)))]
    while stack:
        place, early, rest = stack[-1]
        inner = next(rest, None)
        if inner is None:
            yield phrase[place[0] : place[1]], early, clock
            stack.pop()
        elif inner in seen:
            continue
        else:
            seen.add(inner)
            stack.append((inner, clock, _strips(phrase, *inner)))
        clock += 1


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["phrase", "form", "plain", "early", "late"]
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
    rows: list[tuple] = []
    for batch in batches:
        for phrase, lowered in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for form, early, late in stripped_forms(lowered):
                rows.append((phrase, form, form if form.isascii() else unicodedata.normalize("NFKD", form), early, late))
                if len(rows) >= STRIP_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _key_ladder(phrases: DataFrame) -> DataFrame:
    """``phrase`` with its lookup keys, numbered in the order in which they are tried.

    Each form of a phrase is looked up as name, as alias and by its normal form
    among normal aliases; after all shorter forms its normal form is looked up as
    name and as alias. The plan is one projection, whatever the number of words.
    """
    lowered = phrases.select("phrase", F.lower(F.trim("phrase")).alias("_l")).where("_l != ''")
    forms = lowered.mapInArrow(_forms, "phrase string, form string, plain string, early long, late long")
    keyed = text.add_phrase_key(forms, "plain", "_n")

    def key(col: str, kind: str, at: Column, factor: float, method: str) -> Column:
        return F.struct(F.col(col).alias("key"), F.lit(kind).alias("kind"), at.alias("_pos"), F.lit(factor).alias("factor"), F.lit(method).alias("method"))

    early, late = F.col("early") * 3, F.col("late") * 3
    lookups = F.array(
        key("form", "NAME", early, 1.0, "EXACT_CANONICAL"), key("form", "ALIAS", early + 1, 1.0, "ALIAS_REGISTRY"), key("_n", "NALIAS", early + 2, 1.0, "ALIAS_REGISTRY"),
        key("_n", "NAME", late, 0.9, "NORMALIZED_CANONICAL"), key("_n", "ALIAS", late + 1, 0.95, "NORMALIZED_ALIAS"),
    )
    return keyed.select("phrase", F.inline(lookups)).where(F.col("key") != "")


def resolve(phrases: DataFrame, canonical: DataFrame, aliases: DataFrame, column: str = "phrase") -> DataFrame:
    """Resolution cascade (B13): adds ingredient_id, confidence and method.

    Works on distinct phrases and joins the answer back, so a phrase that makes
    up a third of the input is resolved once.
    """
    names = canonical.groupBy(F.lower("canonical_name").alias("key")).agg(
        F.max("ingredient_id").alias("_id")
    ).select("key", F.struct(F.col("_id").alias("ingredient_id"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("alias")).alias("target"), F.lit("NAME").alias("kind"))
    keys = names.unionByName(alias_keys(aliases))
    distinct = phrases.select(F.trim(text_or_empty(F.col(column))).alias("phrase")).distinct()
    best = (
        _key_ladder(distinct)
        .join(keys, ["key", "kind"])
        .groupBy("phrase")
        .agg(F.min_by(F.struct("target", "factor", "method"), "_pos").alias("_hit"))
        .select(
            F.col("phrase").alias("_phrase"), F.col("_hit.target.ingredient_id").alias("ingredient_id"),
            rnd(F.col("_hit.target.confidence") * F.col("_hit.factor"), 4).alias("confidence"), F.col("_hit.method").alias("match_method"),
        )
    )
    return (
        phrases.join(best, F.trim(text_or_empty(F.col(column))) == F.col("_phrase"), "left")
        .drop("_phrase")
        .withColumns({"confidence": F.coalesce("confidence", F.lit(0.0)), "match_method": F.coalesce("match_method", F.lit("NONE"))})
    )


def parse_and_resolve(lines: DataFrame, canonical: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """Parse free-text lines and resolve their ingredient."""
    # read for its distinct phrases and again for the answers
    parsed = materialize(text.add_parsed_line(lines, column), "parsed-lines")
    return resolve(parsed, canonical, aliases, "ingredient").withColumn(
        "mapping_status",
        F.when(F.col("match_method") == "EXACT_CANONICAL", "MAPPED_CANONICAL")
        .when(F.col("ingredient_id").isNotNull(), "MAPPED_ALIAS")
        .when(F.col("ingredient") != "", "REVIEW_REQUIRED")
        .otherwise("UNMAPPED"),
    )


def matcher_key(c: Column | str) -> Column:
    """Lower case with ASCII letters, digits and single spaces only."""
    low = F.lower(F.trim(text_or_empty(F.col(c) if isinstance(c, str) else c)))
    return F.when(low == "nan", "").otherwise(F.trim(F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9\s]", " "), r"\s+", " ")))


def containment(longer: DataFrame, shorter: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Pairs with ``shorter.short`` inside ``longer.long``, found by an equi-join.

    Whatever contains a text contains its first three characters, so the join key
    is that head against all grams of the longer text. No all-pairs comparison.
    """
    on = on or []
    grams = F.array_distinct(
        F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.length("long")),
                lambda i: F.array(*[F.substring(F.col("long"), i, F.lit(n)) for n in (1, 2, 3)]),
            )
        )
    )
    left = longer.where(F.length("long") > 0).withColumn("_gram", F.explode(grams))
    right = shorter.where(F.length("short") > 0).withColumn("_gram", F.substring("short", 1, 3))
    return left.join(right, on + ["_gram"]).where(F.contains(F.col("long"), F.col("short"))).drop("_gram")


def resolve_for_matching(phrases: DataFrame, canonical: DataFrame, aliases: DataFrame, column: str = "phrase") -> DataFrame:
    """Matcher-side resolution: direct, normalised, plural, substring either way, raw.

    Among substring hits the longest name wins, then the alphabetically first.
    """
    ids = canonical.select("ingredient_id", matcher_key("canonical_name").alias("_canon"), matcher_key("display_name").alias("_disp"))
    own = ids.select(F.col("_canon").alias("key"), "_canon", F.lit(0).alias("_o")).unionByName(
        ids.select(F.col("_disp").alias("key"), "_canon", F.lit(1).alias("_o"))
    )
    extra = aliases.join(ids, F.col("canonical_ingredient_id") == F.col("ingredient_id")).select(
        F.explode(F.array(matcher_key("alias"), matcher_key("normalized_alias"))).alias("key"), "_canon", F.lit(2).alias("_o"), "alias_id"
    )
    table = (
        own.withColumn("alias_id", F.lit("")).unionByName(extra)
        .where(F.col("key") != "")
        .groupBy("key")
        .agg(F.min_by("_canon", F.struct("_o", "alias_id", "_canon")).alias("_canon"))
    )
    distinct = phrases.select(F.col(column).alias("_p")).distinct().withColumn("_c", matcher_key("_p"))
    distinct = text.add_phrase_key(distinct, "_p", "_n").withColumn("_n", matcher_key("_n"))
    keys = F.array(
        F.col("_c"),
        F.col("_n"),
        F.when(F.endswith(F.col("_c"), F.lit("es")), F.expr("left(_c, length(_c) - 2)")),
        F.when(F.endswith(F.col("_c"), F.lit("s")), F.expr("left(_c, length(_c) - 1)")),
    )
    by_key = (
        distinct.select("_p", F.posexplode(keys).alias("_pos", "key"))
        .where(F.col("key") != "")
        .join(table, "key")
        .groupBy("_p")
        .agg(F.min_by("_canon", "_pos").alias("_hit"))
    )
    open_ = distinct.join(by_key, "_p", "left_anti").where(F.col("_c") != "")
    vocab = ids.select("_canon").distinct()
    inside = containment(open_.select("_p", F.col("_c").alias("long")), vocab.select(F.col("_canon").alias("short"))).select("_p", F.col("short").alias("_v"))
    around = containment(vocab.select(F.col("_canon").alias("long")), open_.select("_p", F.col("_c").alias("short"))).select("_p", F.col("long").alias("_v"))
    by_text = inside.unionByName(around).groupBy("_p").agg(F.min_by("_v", F.struct(-F.length("_v"), "_v")).alias("_sub"))
    answer = (
        distinct.join(by_key, "_p", "left").join(by_text, "_p", "left")
        .select("_p", F.coalesce("_hit", "_sub", "_c").alias("resolved"))
    )
    return phrases.join(answer, F.col(column) == F.col("_p"), "left").drop("_p")


def resolve_for_constraints(phrases: DataFrame, canonical: DataFrame, aliases: DataFrame, column: str = "phrase") -> DataFrame:
    """Constraint-side resolution: id literal, cascade, else UNRESOLVED."""
    kinds = {"EXACT_CANONICAL": "EXACT", "ALIAS_REGISTRY": "ALIAS", "NORMALIZED_ALIAS": "ALIAS", "NORMALIZED_CANONICAL": "NORMALIZED"}
    ids = canonical.select(F.col("ingredient_id").alias("_id"), F.col("canonical_name").alias("canonical_name"))
    literal = F.when(F.upper(F.trim(F.col(column))).rlike("^ING.{5}$"), F.upper(F.trim(F.col(column))))
    found = resolve(phrases, canonical, aliases, column).withColumn("_literal", literal)
    known = ids.select(F.col("_id").alias("_lit_id"))
    return (
        found.join(known, F.col("_literal") == F.col("_lit_id"), "left")
        .withColumns(
            {
                "ingredient_id": F.coalesce("_lit_id", "ingredient_id"),
                "confidence": F.when(F.col("_lit_id").isNotNull(), 1.0).otherwise(F.col("confidence")),
                "match_type": F.when(F.col("_lit_id").isNotNull(), "EXACT").otherwise(
                    F.coalesce(lookup(F.col("match_method"), kinds), F.lit("UNRESOLVED"))
                ),
            }
        )
        .join(ids, F.col("ingredient_id") == F.col("_id"), "left")
        .drop("_literal", "_lit_id", "_id", "match_method")
    )


# ---------------------------------------------------------------- nutrient reference


def flatten_nutrients(amounts: DataFrame, foods: DataFrame, nutrients: DataFrame) -> DataFrame:
    """One row per (food, nutrient) amount with both names.

    An amount that names an unknown food or nutrient fails the job.
    """
    f = foods.withColumn("_food", F.lit(True))
    n = nutrients.withColumn("_nutrient", F.lit(True))
    joined = amounts.join(f, "food_code", "left").join(n, "nutrient_code", "left")
    guard = F.when(F.col("_food").isNull(), F.raise_error(F.concat(F.lit("unknown food "), F.col("food_code").cast("string")))).when(
        F.col("_nutrient").isNull(), F.raise_error(F.concat(F.lit("unknown nutrient "), F.col("nutrient_code").cast("string")))
    )
    return joined.withColumns(
        {
            "food_form": F.coalesce(guard.cast("string"), text.food_form("food_name")),
            "normalized_nutrient_name": text.nutrient_slug("nutrient_code", "nutrient_name"),
        }
    ).drop("_food", "_nutrient")


# ---------------------------------------------------------------- food candidates


def _array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def food_dimension(foods: DataFrame) -> DataFrame:
    """Unique foods with phrases, primary tokens and form tags; composites dropped.

    ``foods(food_code, food_name, alternates ARRAY)``.
    """
    composite = "^(?:" + "|".join(" ".join(p.replace(",", " ").replace("-", " ").split()) for p in rules.COMPOSITE_PREFIXES) + ")"
    out = foods.dropDuplicates(["food_code"]).withColumn("name_key", text.food_key("food_name"))
    out = out.where(~F.col("name_key").rlike(composite))
    segments = F.filter(F.transform(F.split("food_name", ","), lambda s: F.trim(s)), lambda s: s != "")
    out = out.withColumns({"_segs": segments, "_plain": F.regexp_replace("food_name", r"\([^)]*\)", "")})
    broad = _array(rules.BROAD_SEGMENTS)
    specific = F.filter("_segs", lambda s: ~F.array_contains(broad, text.food_key(s)))
    first_specific = F.get(specific, 0)
    out = out.withColumn("primary_segment", F.coalesce(first_specific, F.element_at("_segs", -1), F.lit("")))
    forms = text.cues_in("_plain", rules.NAME_FORM_TERMS)
    return out.withColumns(
        {
            "primary_tokens": text.match_tokens("primary_segment"),
            "form_tokens": forms,
            "food_form": F.when(F.size(forms) == 0, rules.NO_FORM).otherwise(F.array_join(forms, ";")),
            "name_tokens": F.array_distinct(text.food_tokens("_plain")),
        }
    ).drop("_segs", "_plain")


def food_phrases(dim: DataFrame) -> DataFrame:
    """Name and alternates of each food as match phrases."""
    alts = F.transform(F.coalesce("alternates", F.array().cast("array<string>")), lambda a: F.struct(text.food_key(a).alias("phrase"), F.lit(False).alias("is_name")))
    name = F.array(F.struct(F.col("name_key").alias("phrase"), F.lit(True).alias("is_name")))
    return dim.select("food_code", "primary_tokens", F.explode(F.concat(name, alts)).alias("_p")).select(
        "food_code", "primary_tokens", "_p.phrase", "_p.is_name", text.match_tokens("_p.phrase").alias("phrase_tokens")
    )


def query_terms(ingredients: DataFrame) -> DataFrame:
    """Search terms per ingredient: display name, aliases, canonical name, form variants.

    ``ingredients(ingredient_id, canonical_name, display_name, ingredient_form, category, aliases ARRAY)``.
    """
    form = text.food_key("ingredient_form")
    synonyms = F.create_map(*[x for k, v in rules.FORM_SYNONYMS.items() for x in (F.lit(k), _array(sorted(v)))])
    suffixes = F.when(form.isin("", "default"), F.array().cast("array<string>")).otherwise(F.coalesce(synonyms[form], F.array(form)))

    def term(c: Column, kind: str) -> Column:
        return F.struct(c.alias("term"), F.lit(kind).alias("kind"))

    terms = F.concat(
        F.array(term(F.col("display_name"), "display_name")),
        F.transform("aliases", lambda a: term(a, "validated_alias")),
        F.array(term(F.col("canonical_name"), "canonical_name")),
        F.transform(suffixes, lambda s: term(F.concat("canonical_name", F.lit(" "), s), "form_alias")),
    )
    out = ingredients.select("ingredient_id", F.posexplode(terms).alias("term_no", "_t")).select(
        "ingredient_id", "term_no", "_t.term", "_t.kind", text.food_key("_t.term").alias("term_key"), text.match_tokens("_t.term").alias("term_tokens")
    )
    return (
        out.groupBy("ingredient_id", "term_key")
        .agg(F.min_by(F.struct("term_no", "term", "kind", "term_tokens"), "term_no").alias("_t"), F.max(F.length("term_key")).alias("_len"))
        .where(F.col("_len") > 0)
        .select("ingredient_id", "term_key", "_t.*")
    )


def blocked_pairs(terms: DataFrame, phrases: DataFrame) -> DataFrame:
    """(term, phrase) pairs that share a token (B21): a token equi-join, then one row per pair."""
    left = terms.withColumn("_tok", F.explode("term_tokens")).where(F.length("_tok") > 1)
    right = phrases.withColumn("_tok", F.explode("phrase_tokens")).where(F.length("_tok") > 1)
    return left.join(right, "_tok").drop("_tok").dropDuplicates(["ingredient_id", "term_key", "food_code", "phrase"])


def matching_pairs(terms: DataFrame, phrases: DataFrame) -> DataFrame:
    """The pairs of ``blocked_pairs`` that reach the coverage gate, without forming the others.

    A phrase that holds ``need`` of a term's n tokens holds one of its
    n - need + 1 rarest, so only those are join keys: a token that half of all
    phrases have is a key for terms that consist of it alone.
    """
    held = phrases.select(F.explode("phrase_tokens").alias("_tok")).groupBy("_tok").agg(F.count(F.lit(1)).alias("_df"))
    words = terms.select("ingredient_id", "term_key", F.explode("term_tokens").alias("_tok")).join(held, "_tok", "left")
    order = words.groupBy("ingredient_id", "term_key").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("_df", F.lit(0)).alias("df"), "_tok"))).alias("_order"))
    n = F.size("_order")
    rarest = F.slice("_order", F.lit(1), n - F.ceil(n * rules.MIN_COVERAGE - 1e-9).cast("int") + 1)
    keys = order.select("ingredient_id", "term_key", F.explode(rarest).alias("_o")).where("_o.df > 0").select("ingredient_id", "term_key", "_o._tok")
    right = phrases.withColumn("_tok", F.explode("phrase_tokens"))
    found = keys.join(right, "_tok").drop("_tok").dropDuplicates(["ingredient_id", "term_key", "food_code", "phrase"])
    both = F.array_intersect("term_tokens", "phrase_tokens")
    return found.join(terms, ["ingredient_id", "term_key"]).where(
        (F.size(both) / F.size("term_tokens") >= rules.MIN_COVERAGE) & F.exists(both, lambda w: F.length(w) > 1)
    )


def token_score(term: str = "term_tokens", phrase: str = "phrase_tokens") -> Column:
    """0.55 coverage + 0.45 Jaccard, zero below the coverage gate."""
    overlap = F.array_intersect(term, phrase)
    both = F.size(overlap)
    coverage = both / F.size(term)
    jaccard = both / F.size(F.array_union(term, phrase))
    same = (F.size(term) == F.size(phrase)) & (both == F.size(phrase))
    single_ok = (F.size(term) > 1) | same | (F.col("is_name") & F.arrays_overlap(overlap, F.col("primary_tokens")))
    return F.when(
        (both > 0) & single_ok & (coverage >= rules.MIN_COVERAGE), rules.COVERAGE_WEIGHT * coverage + rules.JACCARD_WEIGHT * jaccard
    ).otherwise(0.0)


def best_matches(pairs: DataFrame) -> DataFrame:
    """Best match per (ingredient, food) by method priority, score and term.

    Below the coverage gate no method applies, so ``matching_pairs`` are enough.
    """
    scored = pairs.withColumn("_score", rnd(token_score(), 9))
    exact = F.col("is_name") & (F.col("term_key") == F.col("phrase"))
    alternate = ~F.col("is_name") & (F.col("term_key") == F.col("phrase"))
    method = (
        F.when(exact & (F.col("kind") == "form_alias"), "FORM_MATCH")
        .when(exact & (F.col("kind") == "validated_alias"), "ALIAS_MATCH")
        .when(exact, "EXACT_NAME")
        .when(alternate, "ALIAS_MATCH")
        .when(F.col("_score") >= rules.MIN_TOKEN_SCORE, "TOKEN_MATCH")
    )
    score = (
        F.when(F.col("method") == "FORM_MATCH", 0.96)
        .when(F.col("method") == "EXACT_NAME", 1.0)
        .when(exact & (F.col("method") == "ALIAS_MATCH"), 0.97)
        .when(F.col("method") == "ALIAS_MATCH", 0.96)
        .otherwise(F.col("_score"))
    )
    ranked = scored.withColumn("method", method).where(F.col("method").isNotNull()).withColumn("score", score)
    order = F.struct(lookup(F.col("method"), rules.METHOD_PRIORITY), -F.col("score"), "term_key")
    return (
        ranked.groupBy("ingredient_id", "food_code")
        .agg(F.min_by(F.struct("method", "score", "term", "kind"), order).alias("_m"))
        .select("ingredient_id", "food_code", "_m.method", "_m.score", F.col("_m.term").alias("matched_term"), "_m.kind")
    )


@F.pandas_udf(T.DoubleType())
def difflib_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; Spark has no builtin with this value."""
    return pd.Series([SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)])


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; null where the distance passes what MIN_FUZZY_SCORE allows."""
    longer = F.greatest(F.length(a), F.length(b))
    limit = F.floor(longer * (1 - rules.MIN_FUZZY_SCORE) + 1e-9)
    distance = F.levenshtein(a, b)
    return F.when(distance <= limit, 1 - distance / longer)


def may_be_near(a: Column, b: Column) -> Column:
    """Necessary for a ``difflib_ratio`` of MIN_FUZZY_SCORE.

    The ratio is twice the matching characters over all characters, and no more match than the shorter text has.
    """
    la, lb = F.length(a), F.length(b)
    return 2 * F.least(la, lb) >= rules.MIN_FUZZY_SCORE * (la + lb)


def may_be_edited(a: Column, b: Column, q: int = 3) -> Column:
    """Necessary for ``edit_ratio``: length bound, then count filter on the distinct grams of q characters.

    An edit changes at most q grams, so at least the distinct grams of one text
    less q times the distance occur in the other.
    """
    longer, shorter = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    limit = F.floor(longer * (1 - rules.MIN_FUZZY_SCORE) + 1e-9)
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - q + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(q))))
    common = F.size(F.array_intersect(grams(a), grams(b)))
    return (longer - shorter <= limit) & (common >= F.greatest(F.size(grams(a)), F.size(grams(b))) - q * limit)


def fuzzy_fill(pairs: DataFrame, matches: DataFrame, measure: str = "difflib") -> DataFrame:
    """Up to three fuzzy candidates for ingredients with fewer than three matches.

    ``measure``: ``difflib``, or ``edit`` for a ratio that SQL has too and that stays in the JVM.
    """
    full = matches.groupBy("ingredient_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= rules.FUZZY_FILL)
    pool = pairs.join(full, "ingredient_id", "left_anti").join(matches.select("ingredient_id", "food_code"), ["ingredient_id", "food_code"], "left_anti")
    long_enough = F.length(F.regexp_replace("term_key", " ", "")) >= rules.FUZZY_MIN_LETTERS
    near = pool.where(
        long_enough
        & (F.size(F.array_intersect("term_tokens", "phrase_tokens")) / F.size("term_tokens") >= rules.MIN_COVERAGE)
    )
    term, phrase = F.col("term_key"), F.col("phrase")
    if measure == "edit":
        scored = fence(near.where(may_be_edited(term, phrase))).withColumn("score", edit_ratio(term, phrase))
    else:
        scored = near.where(may_be_near(term, phrase)).withColumn("score", difflib_ratio("term_key", "phrase"))
    best = (
        scored.groupBy("ingredient_id", "food_code")
        .agg(F.max_by(F.struct("score", "term"), F.struct("score", -F.col("term_no"))).alias("_m"))
        .select("ingredient_id", "food_code", rnd("_m.score", 9).alias("score"), F.col("_m.term").alias("matched_term"))
        .where(F.col("score") >= rules.MIN_FUZZY_SCORE)
    )
    top = top_k(best, ["ingredient_id"], [F.desc("score"), F.asc("food_code")], rules.FUZZY_FILL).drop("rank")
    return top.withColumns({"method": F.lit("FUZZY_CANDIDATE"), "kind": F.lit("fuzzy")})


def form_evidence(lines: DataFrame) -> DataFrame:
    """How often each ingredient is written raw, dry, cooked, boiled or without state."""
    said = F.concat_ws(" ", "ingredient", "preparation")
    hits = {s: said.rlike(p) for s, p in rules.EVIDENCE_PATTERNS.items()}
    none = ~reduce(lambda a, b: a | b, hits.values())
    return lines.where(F.col("ingredient_id").isNotNull()).groupBy("ingredient_id").agg(
        *[count_where(c).alias(f"{s}_count") for s, c in hits.items()], count_where(none).alias("unspecified_count")
    )


def form_signal(form: Column) -> Column:
    """MATCH / CONFLICT / UNVERIFIED / UNSPECIFIED between an ingredient form and a food."""
    key = text.food_key(form)
    synonyms = F.create_map(*[x for k, v in rules.FORM_SYNONYMS.items() for x in (F.lit(k), _array(v))])
    expected = F.coalesce(synonyms[key], F.array(key))
    match = (
        F.arrays_overlap(expected, F.col("form_tokens")) | F.array_contains("name_tokens", key)
        | F.arrays_overlap(expected, F.split("name_key", " "))
    )
    return (
        F.when(key.isin("", "default"), "UNSPECIFIED")
        .when(match, "MATCH")
        .when(F.size("form_tokens") > 0, "CONFLICT")
        .otherwise("UNVERIFIED")
    )


def rank_candidates(matches: DataFrame, ingredients: DataFrame, dim: DataFrame, evidence: DataFrame) -> DataFrame:
    """Ranked food candidates per ingredient, at most ten, NO_MATCH when there is none."""
    rows = matches.join(ingredients, "ingredient_id").join(
        dim.select("food_code", "food_name", "name_key", "name_tokens", "primary_tokens", "form_tokens", "food_form"), "food_code"
    ).join(evidence, "ingredient_id", "left")
    rows = rows.withColumns(
        {
            "form_signal": form_signal(F.col("ingredient_form")),
            "_canon": F.array_distinct(text.food_tokens("canonical_name")),
            "_disp": F.array_distinct(text.food_tokens("display_name")),
            "_alias": F.array_distinct(F.flatten(F.transform("aliases", text.match_tokens))),
            "_form": text.food_key("ingredient_form"),
            "_cat": text.food_key("category"),
            "_plain": F.coalesce("unspecified_count", F.lit(0)),
            "_moist": F.coalesce(F.col("cooked_count") + F.col("boiled_count"), F.lit(0)),
        }
    )
    none = F.array().cast("array<string>")
    synonyms = F.create_map(*[x for k, v in rules.FORM_SYNONYMS.items() for x in (F.lit(k), _array(v))])
    default_form = F.col("_form").isin("", "default")
    allowed = F.concat(
        F.col("_canon"), F.col("_disp"),
        F.when(default_form, none).otherwise(F.coalesce(synonyms[F.col("_form")], F.array("_form"))),
        F.when(F.col("_cat") == "dairy", _array(["milk", "cream", "butter"])).otherwise(none),
        F.when(F.col("_cat").isin("pulse", "grain"), _array(["dry", "dried", "raw", "boiled", "cooked"])).otherwise(none),
        F.when(F.col("_cat") == "nut", _array(["dry", "dried", "raw", "roasted", "toasted"])).otherwise(none),
    )
    food_words = F.concat(F.split("name_key", " "), F.col("form_tokens"))
    derived = F.array_except(F.array_intersect(food_words, _array(rules.DERIVED_FOOD_WORDS)), allowed)
    special = F.array_except(F.array_intersect("form_tokens", _array(rules.DEFAULT_FORM_PENALTY)), F.col("_canon"))
    grain = F.col("_cat") == "grain"
    prefer_dry = F.col("_cat").isin("grain", "pulse") & (F.col("_plain") > F.col("_moist"))
    dry = F.arrays_overlap("form_tokens", _array(["dry", "dried", "dehydrated", "raw"]))
    shift = F.when(F.col("form_signal") == "MATCH", rules.FORM_MATCH_BONUS).when(
        F.col("form_signal") == "CONFLICT", -rules.FORM_CONFLICT_PENALTY
    ).otherwise(0.0)
    identity = F.array_except(F.concat("_canon", "_disp", "_alias"), _array(rules.MATCH_STOPWORDS))
    rows = rows.withColumns(
        {
            "primary_rank": F.when(F.arrays_overlap(identity, F.col("primary_tokens")), 0).otherwise(1),
            "_derived": F.when(F.size(derived) > 0, 1).otherwise(0),
            "_dry": F.when(prefer_dry & dry, 0).otherwise(1),
            "_regular": F.when(grain & F.arrays_overlap("form_tokens", _array(rules.REGULAR_GRAIN_FORMS)), 0).otherwise(1),
            "_default": F.when(default_form, F.when(F.size(special) > 0, 1).otherwise(0) + F.when(grain & F.arrays_overlap("form_tokens", _array(rules.SPECIAL_GRAIN_FORMS)), 1).otherwise(0)).otherwise(0),
            "_signal": F.when(F.col("form_signal") == "MATCH", 0).when(F.col("form_signal") == "CONFLICT", 2).otherwise(1),
            "match_score": rnd(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") + shift)), 4),
        }
    )
    # forms over all candidates of the ingredient, before the top-ten cut
    spread = matches.join(dim.select("food_code", "form_tokens"), "food_code").groupBy("ingredient_id").agg(
        F.array_distinct(F.flatten(F.collect_set("form_tokens"))).alias("_all_forms"),
    )
    rows = rows.join(spread, "ingredient_id", "left")
    state = _array(rules.STATE_FORMS)
    many_states = F.size(F.array_intersect("_all_forms", state)) > 1
    many_forms = F.size(F.array_intersect("_all_forms", _array(rules.NAME_FORM_TERMS))) > 1
    has_cue = F.size("form_tokens") > 0
    review = (
        F.col("method").isin("TOKEN_MATCH", "FUZZY_CANDIDATE")
        | (F.col("form_signal") == "CONFLICT")
        | (~default_form & (F.col("form_signal") != "MATCH"))
        | (many_states & (F.col("_plain") > 0))
        | (default_form & (has_cue | many_forms))
    )
    rows = rows.withColumn("selection_status", F.when(review, "REVIEW").otherwise("AUTO_CANDIDATE"))
    order = [
        F.col(c) for c in ("primary_rank", "_derived", "_dry", "_regular", "_default", "_signal")
    ] + [lookup(F.col("method"), rules.METHOD_PRIORITY), -F.col("match_score"), F.col("name_key"), F.col("food_code")]
    top = top_k(rows, ["ingredient_id"], order, rules.MAX_FOOD_CANDIDATES, "candidate_rank")
    # rows sort by primary_rank first, so rank 1 tells whether the ingredient has primary candidates
    has_primary = F.min("primary_rank").over(Window.partitionBy("ingredient_id"))
    top = top.withColumn("_best", has_primary).where(F.col("primary_rank") == F.col("_best"))
    kept = top.select("ingredient_id", "food_code", "food_name", "food_form", "method", "form_signal", "match_score", "matched_term", "selection_status", "candidate_rank")
    return ingredients.select("ingredient_id").join(kept, "ingredient_id", "left").withColumns(
        {
            "method": F.coalesce("method", F.lit("NO_MATCH")),
            "selection_status": F.coalesce("selection_status", F.lit("NO_MATCH")),
            "candidate_rank": F.coalesce("candidate_rank", F.lit(1)),
            "match_score": F.coalesce("match_score", F.lit(0.0)),
        }
    )


def generate_food_candidates(ingredients: DataFrame, foods: DataFrame, lines: DataFrame) -> DataFrame:
    """B20 to B29; foods, pairs and matches are each read several times and are written once."""
    with scratch(foods.sparkSession) as keep, measured_joins(foods.sparkSession):
        dim = materialize(food_dimension(foods), "food-dimension")
        pairs = materialize(matching_pairs(query_terms(ingredients), food_phrases(dim)), "pairs")
        matches = materialize(best_matches(pairs), "matches")
        every = materialize(matches.unionByName(fuzzy_fill(pairs, matches)), "all-matches")
        return keep(materialize(rank_candidates(every, ingredients, dim, form_evidence(lines)), "food-candidates"))


def apply_curation(ingredients: DataFrame, decisions: DataFrame, foods: DataFrame) -> DataFrame:
    """Curated decision per ingredient with the food it names (B30); a missing decision fails the job."""
    d = decisions.select("ingredient_id", "curation_status", F.col("food_code").alias("cnf_food_code"), "curation_reason")
    f = foods.select(F.col("food_code").alias("cnf_food_code"), F.col("food_name").alias("cnf_food_name"))
    status = F.coalesce(
        "curation_status", F.raise_error(F.concat(F.lit("missing curation decision for "), F.col("ingredient_id"))).cast("string")
    )
    return ingredients.join(d, "ingredient_id", "left").withColumn("curation_status", status).join(f, "cnf_food_code", "left")
