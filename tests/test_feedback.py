import datetime as dt
import random

from pyspark.sql import functions as F

from larder.functions.common import global_row_number
from larder.operators import feedback as fb
from larder.operators.ranking import weak_label


def test_grades(spark):
    cases = {"COOKED": 3, "SAVE": 2, "like": 2, "IMPRESSION": 1, None: 1, "???": 1, "DISLIKE": 0, "HIDE": 0}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", fb.grade("t").alias("g"))
    assert {r.t: r.g for r in df.collect()} == cases


def test_conflict_precedence(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("s", "r", "LIKE", t0), ("s", "r", "HIDE", t0), ("s", "q", None, t0)], "session_id string, recipe_id string, feedback_type string, impression_timestamp timestamp")
    got = {r.recipe_id: (r.feedback_type, r.relevance_label) for r in fb.resolve_conflicts(df).collect()}
    assert got == {"r": ("HIDE", 0), "q": ("IMPRESSION", 1)}


def sessions(spark):
    rows = [(f"s{i:02d}", dt.datetime(2024, 1, 1) + dt.timedelta(days=i)) for i in range(20)]
    return spark.createDataFrame(rows, "session_id string, impression_timestamp timestamp")


def test_session_split_and_leakage(spark):
    split = fb.split_by_session(sessions(spark))
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 14, "val": 3, "test": 3}
    assert fb.leakage_report(split).first().passed
    bad = spark.createDataFrame([("a", dt.datetime(2024, 10, 25), "train"), ("b", dt.datetime(2024, 10, 10), "val"), ("c", dt.datetime(2024, 10, 15), "test")], "session_id string, impression_timestamp timestamp, split string")
    report = fb.leakage_report(bad).first()
    assert not report.passed and report.future_in_train == 2


def test_sufficiency_of_little_data(spark):
    schema = "user_id long, recipe_id string, session_id string, feedback_type string, impression_timestamp timestamp"
    for rows in ([], [(1, "r", "s", "LIKE", dt.datetime(2024, 1, 1))] * 3):
        assert fb.sufficiency(spark.createDataFrame(rows, schema)).first().status == "INSUFFICIENT_DATA"


def test_global_row_number(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"))
    got = global_row_number(df, ["k"], "n").orderBy("k").collect()
    assert [r.n for r in got] == list(range(1, 5001))


def test_weak_labels(spark):
    cases = [((.9, .9, True, 1., False), 0), ((.6, .6, True, .8, True), 3), ((.4, .2, False, .4, True), 2), ((.2, .1, False, .1, True), 1), ((.05, .05, False, .05, True), 0)]
    df = spark.createDataFrame([(*c, w) for c, w in cases], "t double, d double, b boolean, c double, ok boolean, want int")
    rows = df.select(weak_label(F.col("t"), F.col("d"), F.col("b"), F.col("c"), F.col("ok")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in rows)


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([("q", 1, 0), ("q", 2, 3), ("q", 3, 2), ("z", 1, 0)], "q string, pos int, rel int")
    got = {r.q: r for r in fb.ranking_metrics(df, "q", [F.asc("pos")], "rel", 2.0).collect()}
    import math
    dcg = 7 / math.log2(3) + 3 / 2
    ideal = 7 + 3 / math.log2(3)
    assert abs(got["q"].ndcg_5 - dcg / ideal) < 1e-9 and got["q"].mrr_10 == 0.5 and got["q"].recall_5 == 1.0
    assert got["z"].ndcg_5 == 0.0 and got["z"].mrr_10 == 0.0


def test_feedback_without_a_session_goes_to_the_last_impression_before_it(spark):
    shown = [("a", 1, 1), ("b", 1, 5), ("c", 1, 9), ("a", 2, 1)]
    history = spark.createDataFrame([(s, "u", f"r{r}", at) for s, r, at in shown], "session_id string, user_id string, recipe_id string, impression_timestamp int")
    given = [(None, 1, "LIKE", 7), (None, 1, "LIKE", 7), (None, 1, "SAVE", 9), ("a", 1, "HIDE", 2), ("a", 1, "HIDE", 2), (None, 2, "LIKE", 0), (None, 3, "LIKE", 4), (None, 1, "COOKED", None)]
    feedback = spark.createDataFrame(
        [(s, "u", f"r{r}", kind, None, at) for s, r, kind, at in given], "session_id string, user_id string, recipe_id string, feedback_type string, rating int, feedback_timestamp int"
    )
    got = sorted((r.session_id, r.recipe_id, r.feedback_type or "") for r in fb.export_interactions(history, feedback).collect())
    assert got == [("a", "r1", "HIDE")] * 2 + [("a", "r2", ""), ("b", "r1", "LIKE"), ("b", "r1", "LIKE"), ("c", "r1", "SAVE")]


def test_percentiles_of_one_group_with_all_rows(spark):
    rng = random.Random(2)
    values = [rng.choice([rng.gauss(50, 20), 7.0, 1e-12 * rng.random(), -1e9, 1e9 + rng.random()]) for _ in range(5000)]
    rows = [("hot", v) for v in values] + [("one", 3.5), (None, 2.0), (None, 1.0), ("none", None), ("same", 4.0), ("same", 4.0)]
    got = {r.g: r for r in fb.latency_percentiles(spark.createDataFrame(rows, "g string, v double").repartition(6), ["g"], "v").collect()}
    ordered = sorted(values)
    for p, name in ((0.5, "p50_ms"), (0.95, "p95_ms"), (0.99, "p99_ms")):
        assert abs(got["hot"][name] - ordered[min(int(p * 5000), 4999)]) <= 0.006
    assert got["one"].p50_ms == 3.5 and got[None].p50_ms == 2.0 and got["same"].p99_ms == 4.0 and "none" not in got


def test_latest_mark_of_a_hot_key(spark):
    rng = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    when = lambda: None if rng.random() < 0.03 else t0 + dt.timedelta(minutes=rng.randrange(0, 60 * 24 * 4))
    user = lambda: rng.choice([1, 1, 1, 2, 3, None])
    marks = [(user(), when(), f"s{i}") for i in range(300)]
    rows = [(user(), when(), i) for i in range(300)]
    rows += rows[:5]
    got = fb.latest_before(spark.createDataFrame(rows, "user_id long, at timestamp, n long"), spark.createDataFrame(marks, "user_id long, at timestamp, mark string"), ["user_id"], "at", "mark")
    want = []
    for u, at, n in rows:
        seen = [(m, s) for v, m, s in marks if u is not None and u == v and at and m and m <= at]
        if seen:
            want.append((n, max(seen)[1]))
    assert sorted((r.n, r.mark) for r in got.collect()) == sorted(want)
