"""Tables that are broadcast are chosen by the size of their rows, not of the files that hold them."""

import pytest
from pyspark.sql import functions as F

from larder.operators import resolution as res
from larder.sources.shared import BROADCAST, BROADCAST_MEASURED, measured_joins


def test_food_candidates_broadcast_nothing_by_the_size_of_files(spark, monkeypatch):
    words = F.element_at(F.array(*[F.lit(w) for w in ("rice", "milk", "dal")]), (F.col("id") % 3 + 1).cast("int"))
    foods = spark.range(300).select(F.col("id").alias("food_code"), F.concat(words, F.lit(", raw")).alias("food_name"), F.array().cast("array<string>").alias("alternates"))
    ingredients = spark.createDataFrame(
        [("I1", "rice", "white rice", "default", "grain", ["old rice"]), ("I2", "zzz", "zzz", "default", "nut", [])],
        "ingredient_id string, canonical_name string, display_name string, ingredient_form string, category string, aliases array<string>")
    lines = spark.createDataFrame([("I1", "rice", "raw")], "ingredient_id string, ingredient string, preparation string")
    planned, write = {}, res.materialize

    def noted(df, label, **more):
        planned[label] = df._jdf.queryExecution().sparkPlan().toString()
        return write(df, label, **more)

    monkeypatch.setattr(res, "materialize", noted)
    out = res.generate_food_candidates(ingredients, foods, lines).orderBy("ingredient_id", "candidate_rank").collect()
    assert [(r.ingredient_id, r.food_code, r.candidate_rank) for r in out] == [("I1", 3 * i, i + 1) for i in range(10)] + [("I2", None, 1)]
    assert any("SortMergeJoin" in p for p in planned.values())
    assert [label for label, p in planned.items() if "BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p] == []


@pytest.mark.parametrize("limit", [None, "1000"])
def test_session_limits_come_back(spark, limit):
    keys = (BROADCAST, BROADCAST_MEASURED)
    if limit:
        spark.conf.set(BROADCAST, limit)
    before = [spark.conf.get(k, None) for k in keys]
    with pytest.raises(ZeroDivisionError), measured_joins(spark):
        assert spark.conf.get(BROADCAST) == "-1"
        assert spark.conf.get(BROADCAST_MEASURED) == (limit or before[0] or "10485760b")
        raise ZeroDivisionError
    assert [spark.conf.get(k, None) for k in keys] == before
    if limit:
        spark.conf.unset(BROADCAST)
