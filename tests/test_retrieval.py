import math
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from larder.operators import resolution as res
from larder.operators import retrieval as ret


def vectors(spark, n, key, seed):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(n)], f"{key} long, vector array<double>")


def brute(corpus, queries, k):
    out = {}
    for q in queries:
        s = [(-round(min(1.0, max(0.0, sum(a * b for a, b in zip(q.vector, c.vector)))), 9), c.id) for c in corpus]
        out[q.query_id] = [i for _, i in sorted(s)[:k]]
    return out


def test_dense_paths_agree_with_brute_force(spark, monkeypatch):
    corpus, queries = vectors(spark, 300, "id", 1), vectors(spark, 40, "query_id", 2)
    want = brute(corpus.collect(), queries.collect(), 5)

    def got():
        rows = ret.dense_top(corpus, queries, 5).orderBy("query_id", "rank").collect()
        return {q: [r.id for r in rows if r.query_id == q] for q in want}

    assert got() == want
    monkeypatch.setattr(ret, "BLOCK_ROWS", 64)
    assert got() == want
    assert ret.dense_top(corpus, queries.limit(0), 5).collect() == [] and ret.dense_top(corpus.limit(0), queries, 5).collect() == []


def test_tfidf_by_hand(spark):
    docs = spark.createDataFrame([(1, "rice dal rice"), (2, "rice milk"), (3, "dal, milk!")], "doc_id long, text string")
    model = ret.fit_tfidf(docs, bigrams=False)
    idf = {r.term: r.idf for r in model.terms.collect()}
    assert set(idf) == {"rice", "dal", "milk"} and abs(idf["rice"] - (math.log(4 / 3) + 1)) < 1e-12
    queries = spark.createDataFrame([(9, "rice unknown"), (8, "nothing known")], "query_id long, text string")
    rows = {r.doc_id: r.score for r in ret.lexical_scores(model, queries).collect()}
    one = (1 + math.log(2)) / math.sqrt((1 + math.log(2)) ** 2 + 1)
    assert set(rows) == {1, 2} and abs(rows[1] - one) < 1e-9 and abs(rows[2] - 1 / math.sqrt(2)) < 1e-9


def test_hot_and_rare_terms_weigh_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"common word{i % 7} other{i % 40}") for i in range(200)], "doc_id long, text string")
    model = ret.fit_tfidf(docs)

    def total():
        return ret.weigh(model.doc_terms, model).agg(F.sum("w").alias("s"), F.count("w").alias("n")).first()

    split = total()
    monkeypatch.setattr(ret, "HOT_SHARE", 2.0)
    plain = total()
    assert split.n == plain.n and abs(split.s - plain.s) < 1e-6


def test_diversity_without_pairs(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "id long, vector array<double>")
    lists = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1)], "query_id string, id long")
    got = {r.query_id: r.diversity for r in ret.list_diversity(lists, v).collect()}
    assert abs(got["a"] - (1 - 1 / 3)) < 1e-9 and got["b"] == 1.0


def test_fuzzy_fill(spark):
    pairs = spark.createDataFrame(
        [("I1", 0, "chicken breasts raw", 7, "chicken breast raw", ["chicken", "breasts", "raw"], ["chicken", "breast", "raw"])],
        "ingredient_id string, term_no int, term_key string, food_code long, phrase string, term_tokens array<string>, phrase_tokens array<string>",
    ).withColumn("term", F.col("term_key"))
    none = spark.createDataFrame([], "ingredient_id string, food_code long")
    row = res.fuzzy_fill(pairs, none).first()
    assert abs(row.score - SequenceMatcher(None, "chicken breasts raw", "chicken breast raw", autojunk=False).ratio()) < 1e-9


def test_containment_matches_brute_force(spark):
    long = ["fine chopped onion", "rice", "a", "onion ring", "moong dal"]
    short = ["onion", "a", "ring", "dal", "zz", "rice"]
    pairs = res.containment(spark.createDataFrame([(x,) for x in long], "long string"), spark.createDataFrame([(x,) for x in short], "short string")).collect()
    assert sorted((p.long, p.short) for p in pairs) == sorted((x, y) for x in long for y in short if y in x)


def test_food_candidates(spark):
    ingredients = spark.createDataFrame(
        [("ING00001", "onion", "Onion", "default", "vegetable", ["pyaz"]), ("ING00002", "kokum", "Kokum", "default", "spice", [])],
        "ingredient_id string, canonical_name string, display_name string, ingredient_form string, category string, aliases array<string>",
    )
    foods = spark.createDataFrame([(1, "Onion", []), (2, "Onion, dried", []), (3, "Soup, onion", []), (4, "Sweets, onion flavour", [])], "food_code long, food_name string, alternates array<string>")
    lines = spark.createDataFrame([("ING00001", "onion", "chopped")], "ingredient_id string, ingredient string, preparation string")
    rows = res.generate_food_candidates(ingredients, foods, lines).orderBy("ingredient_id", "candidate_rank").collect()
    onion = [r for r in rows if r.ingredient_id == "ING00001"]
    assert onion[0].food_code == 1 and onion[0].method == "EXACT_NAME" and [r.candidate_rank for r in onion] == list(range(1, len(onion) + 1))
    assert 3 not in [r.food_code for r in onion]
    assert [(r.method, r.selection_status, r.candidate_rank) for r in rows if r.ingredient_id == "ING00002"] == [("NO_MATCH", "NO_MATCH", 1)]


def test_search_skips_blocks_and_finds_the_same(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rare = lambda: " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(300)], k=rng.randrange(1, 60)))
    docs = spark.createDataFrame([(i, rare()) for i in range(400)] + [(400, ""), (401, None), (402, "w1 w2"), (403, "w1 w2")], "doc_id long, text string")
    queries = spark.createDataFrame([(i, rare()) for i in range(30)] + [(30, "unknown words"), (31, "w1 w2"), (32, None)], "query_id long, text string")
    model = ret.fit_tfidf(docs)
    index = ret.lexical_index(model)
    want = sorted(tuple(r) for r in ret.lexical_top(ret.lexical_scores(model, queries), 5).collect())
    assert sorted(tuple(r) for r in ret.lexical_search(index, queries, 5).collect()) == want
    own = docs.select(F.col("doc_id").alias("query_id"), "text")
    rows = [r for r in ret.lexical_scores(model, own).collect() if r.query_id != r.doc_id]
    best = ret.lexical_top(spark.createDataFrame(rows, "query_id long, doc_id long, score double"), 3)
    assert sorted(tuple(r) for r in ret.more_like_this(docs, 3, "doc_id", "text").collect()) == sorted(tuple(r) for r in best.collect())


def test_retrieval_counts_texts_once_and_keeps_only_its_result(spark, monkeypatch):
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{min(rng.randrange(1, 80), rng.randrange(1, 80))}" for _ in range(n))
    docs = spark.createDataFrame([(i, text(rng.randrange(1, 40))) for i in range(150)] + [(150, None), (None, "w1 w2 w3"), (7, "w1 w2")], "doc_id long, text string")
    queries = spark.createDataFrame([(i, text(12)) for i in range(6)] + [(6, "nothing known"), (None, "w1")], "query_id long, text string")
    model = ret.fit_tfidf(docs)
    want = sorted(tuple(r) for r in ret.lexical_top(ret.lexical_scores(model, queries), 5).where("doc_id is not null").collect())
    left = []
    write = ret.materialize

    def noted(df, label, **more):
        left.append((label, table := write(df, label, **more)))
        return table

    monkeypatch.setattr(ret, "materialize", noted)
    for weights in (0, 1 << 17):  # query weights joined by shuffle, then by broadcast
        monkeypatch.setattr(ret, "BROADCAST_WEIGHTS", weights)
        left.clear()
        assert sorted(tuple(r) for r in ret.lexical_retrieve(docs, queries, 5).collect()) == want
        assert [label for label, _ in left].count("doc-terms") == 1
        assert [label for label, t in left if shared_has(spark, t)] == ["lexical-top"]


def shared_has(spark, table):
    return all(spark._jvm.java.io.File(spark._jvm.java.net.URI(f)).exists() for f in table.inputFiles())
