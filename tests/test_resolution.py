"""Phrase resolution where preparation words can be stripped in several ways, and set-similarity matching."""

import itertools
import random

from pyspark.sql import functions as F

from larder.functions import rules
from larder.operators import resolution as res


def tables(spark, names):
    canon = spark.createDataFrame([(f"ING{i}", n, n, "x", "default") for i, n in enumerate(names)], "ingredient_id string, canonical_name string, display_name string, category string, ingredient_form string")
    aliases = spark.createDataFrame([], "alias_id string, canonical_ingredient_id string, alias string, normalized_alias string, confidence double, review_status string")
    return canon, aliases


def found(spark, names, phrases):
    canon, aliases = tables(spark, names)
    rows = res.resolve(spark.createDataFrame([(p,) for p in phrases], "phrase string"), canon, aliases).collect()
    return {r.phrase: (r.ingredient_id, r.match_method) for r in rows}


def test_the_next_word_is_tried_where_the_first_leads_nowhere(spark):
    got = found(spark, ["chopped tomatoes", "onion", "green chilli"], [
        "chopped tomatoes warm", "warm chopped tomatoes", "chopped warm onion cold", "chopped", "", None, "warm cold", "sliced green chilli", "warm unknown",
    ])
    assert got["chopped tomatoes warm"] == got["warm chopped tomatoes"] == ("ING0", "EXACT_CANONICAL")
    assert got["chopped warm onion cold"] == ("ING1", "EXACT_CANONICAL") and got["sliced green chilli"][0] == "ING2"
    assert all(got[p] == (None, "NONE") for p in ("chopped", "", None, "warm cold", "warm unknown"))


def test_many_words_cost_no_plan(spark):
    long = " ".join(["warm", "sliced", "chopped", "cold"] * 25) + " onion" + " diced boiled" * 50
    assert found(spark, ["onion"], [long, "onion"])[long] == ("ING0", "EXACT_CANONICAL")
    assert found(spark, ["onion"], [long.replace("onion", "nothing")])[long.replace("onion", "nothing")] == (None, "NONE")


def test_other_spellings_of_letters(spark):
    got = found(spark, ["onion", "fine rice"], ["Ｏｎｉｏｎ", "chopped ｏnion", "ﬁne rice", "fine rice"])
    assert {v[0] for v in got.values()} == {"ING0", "ING1"} and None not in {v[0] for v in got.values()}


def slow(text, names):
    if text in names:
        return text
    for w in rules.PREPARATION_WORDS:
        if text.startswith(w + " ") and text not in rules.KEPT_AT_FRONT:
            hit = slow(text[len(w) + 1 :].strip(), names)
        elif text.endswith(" " + w) and text not in rules.KEPT_AT_END:
            hit = slow(text[: -len(w) - 1].strip(), names)
        else:
            continue
        if hit:
            return hit
    return None


def test_order_of_forms():
    rng = random.Random(4)
    some = ["warm", "cold", "finely chopped", "chopped", "onion", "red chilli", "powder"]
    names = {"onion", "chopped onion", "warm onion cold", "red chilli powder", "cold onion", "red chilli"}
    for _ in range(300):
        phrase = " ".join(rng.choices(some, k=rng.randrange(1, 6)))
        forms = sorted((early, form) for form, early, _ in res.stripped_forms(phrase))
        assert len({f for _, f in forms}) <= len(forms)
        assert next((f for _, f in forms if f in names), None) == slow(phrase, names)


def test_matching_pairs_are_those_of_the_gate(spark):
    rng = random.Random(3)
    words = ["rice", "bean", "oil", "flour", "seed", "x", "dark", "light", "cream", "milk"]
    pick = lambda n: list(dict.fromkeys(rng.choices(words, weights=[9, 6, 4, 3, 3, 3, 2, 2, 1, 1], k=n)))
    terms = spark.createDataFrame([(f"I{i}", f"t{i}", pick(rng.randrange(1, 6))) for i in range(60)], "ingredient_id string, term_key string, term_tokens array<string>")
    phrases = spark.createDataFrame([(i, f"p{i}", pick(rng.randrange(1, 7))) for i in range(80)], "food_code long, phrase string, phrase_tokens array<string>")
    gate = F.size(F.array_intersect("term_tokens", "phrase_tokens")) / F.size("term_tokens") >= rules.MIN_COVERAGE
    pairs = lambda df: sorted((r.term_key, r.phrase) for r in df.collect())
    got, want = pairs(res.matching_pairs(terms, phrases)), pairs(res.blocked_pairs(terms, phrases).where(gate))
    assert got == want and len(want) > 100


def test_edit_filter_loses_nothing(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abc ", k=rng.randrange(1, 14))) for _ in range(40)]
    texts += [t[:k] + "z" + t[k + 1 :] for t in texts for k in (0, 3) if len(t) > 4]
    pairs = spark.createDataFrame(list(itertools.product(texts, texts)), "a string, b string")
    a, b = F.col("a"), F.col("b")
    good = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)) >= rules.MIN_FUZZY_SCORE
    assert pairs.where(good & ~res.may_be_edited(a, b)).isEmpty()
    assert pairs.where(good & ~(res.edit_ratio(a, b) >= rules.MIN_FUZZY_SCORE)).isEmpty()
    assert pairs.where(res.may_be_edited(a, b)).count() < pairs.count() / 4
    assert pairs.where((res.difflib_ratio("a", "b") >= rules.MIN_FUZZY_SCORE) & ~res.may_be_near(a, b)).isEmpty()
