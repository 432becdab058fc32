from pyspark.sql import functions as F

from larder.functions import text
from larder.functions.diet import add_diet_terms
from larder.functions.quantity import normalize_unit, parse_quantity
from larder.operators.cleaning import approved_cuisine, explode_ingredient_text


def frame(spark, values, name="x"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def column(df, name):
    return [r[name] for r in df.select(name).collect()]


def test_quantities(spark):
    cases = {
        "1": (1.0, "PARSED_NUMERIC"), "10": (10.0, "PARSED_NUMERIC"), "1/2": (0.5, "PARSED_FRACTION"), "1/8": (0.125, "PARSED_FRACTION"),
        "1 1/2": (1.5, "PARSED_MIXED_FRACTION"), "2 1/2": (2.5, "PARSED_MIXED_FRACTION"), "1-1/2": (1.5, "PARSED_MIXED_FRACTION"),
        "11/2": (1.5, "PARSED_ANOMALY"), "21/2": (2.5, "PARSED_ANOMALY"), "11/4": (1.25, "PARSED_ANOMALY"), "": (None, "MISSING_QUANTITY"),
        None: (None, "MISSING_QUANTITY"), "-2": (None, "PARSE_ERROR"), "1/0": (None, "PARSE_ERROR"), "1d": (None, "PARSE_ERROR"), "some": (None, "PARSE_ERROR"),
    }
    rows = frame(spark, list(cases)).select("x", parse_quantity("x").alias("q")).select("x", "q.*").collect()
    assert {r["x"]: (r["quantity"], r["status"]) for r in rows} == cases


def test_units(spark):
    got = column(frame(spark, ["Cups", "tablespoons", "kg", " bundle ", "", None]).select(normalize_unit("x").alias("u")), "u")
    assert got == ["cup", "tbsp", "kg", "bundle", None, None]


def test_titles(spark):
    titles = [
        "One Pot Pav Bhaji Recipe Using Preethi Electric Pressure Cooker", "Fruit Box - Kids Recipes Made With Del Monte",
        "Pressure Cooker Cake Recipe", "Tawa Pulao", "Pigeon Peas Curry Recipe",
    ]
    got = column(frame(spark, titles).select(text.clean_title("x").alias("t")), "t")
    assert got == ["One Pot Pav Bhaji Recipe", "Fruit Box", *titles[2:]]


def test_cuisine(spark):
    labels = ["Udupi", "Indo Chinese", "  NORTH   INDIAN RECIPES ", "Chinese", "Fusion", "", None]
    assert column(frame(spark, labels).select(approved_cuisine("x").alias("ok")), "ok") == [True, True, True, False, False, False, False]


def test_phrases(spark):
    cases = {
        "onions": "onion", "green chilli": "green chilli", "red chilli": "red chilli", "chilli powder": "chilli powder",
        "to 3 tablespoons karela": "karela", "Fresh Tomatoes (ripe)": "tomato", "अदरक": "अदरक",
    }
    rows = text.add_phrase_key(frame(spark, list(cases)), "x", trace="steps").collect()
    assert {r["x"]: r["phrase_key"] for r in rows} == cases
    assert all(r["steps"] for r in rows)


def test_parse_line(spark):
    cases = {
        "2 tablespoon chopped onion": (2.0, "tbsp", "onion", "chopped"),
        "1/2 teaspoon turmeric powder": (0.5, "tsp", "turmeric powder", None),
        "1-1 / 2 cups rice - cooked": (1.5, "cup", "rice", "cooked"),
        "Salt - to taste": (None, None, "salt", "to taste"),
        "2 onions, finely chopped": (2.0, None, "onion", "finely chopped"),
    }
    rows = text.add_parsed_line(frame(spark, list(cases)), "x").collect()
    assert {r["x"]: (r["quantity"], r["unit"], r["ingredient"], r["preparation"]) for r in rows} == cases


def test_explode_keeps_order_and_skips_blanks(spark):
    df = spark.createDataFrame([("R00001", "2 cups Rice - washed, , 1-1/2 tsp Cumin (a, b)")], "recipe_id string, ingredients string")
    rows = explode_ingredient_text(df).orderBy("line_no").collect()
    assert [(r.line_no, r.quantity, r.unit, r.ingredient, r.preparation) for r in rows] == [
        (1, "2", "cups", "Rice", "washed"), (3, "1 1/2", "tsp", "Cumin (a", ""), (4, "", "", "b)", "")]
    assert explode_ingredient_text(df, parentheses_aware=True).count() == 2


def test_diet_terms(spark):
    cases = {
        "2 अंडे (उबले हुए)": "अंडे", "ताज़ा मछली": "मछली", "चिकन टिक्का": "चिकन", "eggplant curry": None, "mock chicken": None, "no egg cake": None,
        "turkey berry kuzhambu": None, "roast turkey": "turkey", "coconut meat": None, "2 eggs": "egg", "graham ham": None,
    }
    rows = add_diet_terms(frame(spark, list(cases)), "x").collect()
    assert {r["x"]: r["nonveg_term"] for r in rows} == cases
    by = {r["x"]: r for r in add_diet_terms(frame(spark, ["coconut milk", "milk", "no onion no garlic paneer", "sweet potato"]), "x").collect()}
    assert by["coconut milk"]["nonvegan_term"] is None and not by["coconut milk"]["dairy"]
    assert by["milk"]["nonvegan_term"] == "milk" and by["milk"]["dairy"]
    assert by["no onion no garlic paneer"]["satvik_term"] is None
    assert by["sweet potato"]["jain_term"] == "potato"


def test_unicode_normalize(spark):
    got = column(frame(spark, ["café", "½ cup", "plain"]).select(text.decomposed("x").alias("x")), "x")
    assert sorted(got) == sorted(["café", "1⁄2 cup", "plain"])


def test_bigrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    got = [r["g"] for r in df.select(text.uni_and_bigrams(F.col("t")).alias("g")).collect()]
    assert got == [["a", "b", "c", "a b", "b c"], ["a"], []]


def test_any_number_of_preparation_words_is_stripped(spark):
    from larder.operators import resolution

    canon = spark.createDataFrame([("ING1", "onion", "Onion")], "ingredient_id string, canonical_name string, display_name string")
    aliases = spark.createDataFrame([], "alias_id string, alias string, normalized_alias string, canonical_ingredient_id string, confidence double, review_status string")
    phrases = spark.createDataFrame([("onion",), ("sliced onion",), ("peeled sliced fried roasted onion",), ("peeled sliced chopped fried roasted onion sliced",)], "phrase string")
    got = resolution.resolve(phrases, canon, aliases).collect()
    assert {r.ingredient_id for r in got} == {"ING1"}
