"""E: retrieval over documents, benchmark texts and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import text
from larder.functions.common import rnd
from larder.operators import retrieval as ret
from larder.plans.registry import Tables, query
from larder.plans.sqltext import q, sql_round, squeeze, sub, tokens
from larder.sources.shared import materialize, scratch

PUNCT = r"[!-/:-@\[-`{-~]"
_CT = lambda e: squeeze(sub(f"lower(coalesce({e}, ''))", PUNCT, " "))


@query("E01_corpus_text", f"SELECT doc_id, md5({_CT('text')}) AS text_md5 FROM documents")
def e01(t: Tables):
    return t.documents.select("doc_id", F.md5(text.corpus_text("text")).alias("text_md5"))


_META = ", ".join(f"nullif({_CT(c)}, '')" for c in ("recipe_name", "cuisine", "region", "meal_type", "category", "diet_type"))


@query("E02_build_corpus", f"""
SELECT r.recipe_id, concat_ws(' ', {_META}, i.s, i.s, i.s) AS corpus_text FROM recipes r LEFT JOIN (
  SELECT recipe_id, string_agg(n, ' ' ORDER BY seen, n) AS s FROM (SELECT recipe_id, coalesce(canonical_ingredient, ingredient) AS n, min(line_no) AS seen FROM lines GROUP BY 1, 2) GROUP BY 1) i ON r.recipe_id = i.recipe_id""")
def e02(t: Tables):
    return ret.build_corpus(t.recipes, t.lines).drop("recipe_name")


def _counts(table: str, key: str, alias: str) -> str:
    tok = tokens(_CT("text"))
    return (
        f"SELECT {alias}, term, 1.0 + ln(count(*)) AS tf FROM (SELECT {key} AS {alias}, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END)) AS term "
        f"FROM (SELECT {key}, {tok} AS w FROM {table})) GROUP BY 1, 2"
    )


def tfidf_sql(table: str, key: str) -> str:
    return f"""
dt AS MATERIALIZED ({_counts(table, key, 'd')}),
tm AS MATERIALIZED (SELECT term, df, ln((1.0 + (SELECT count(*) FROM {table})) / (1.0 + df)) + 1.0 AS idf FROM (SELECT term, count(*) AS df FROM dt GROUP BY 1) WHERE df >= 2)"""


def scores_sql(table: str, key: str, queries: str, query_key: str) -> str:
    return f"""{tfidf_sql(table, key)},
qt AS MATERIALIZED (SELECT c.query_id, c.term, tf * idf AS w, idf FROM ({_counts(queries, query_key, 'query_id')}) c JOIN tm ON c.term = tm.term),
qn AS (SELECT query_id, sqrt(sum(w * w)) AS n FROM qt GROUP BY 1),
dn AS (SELECT d, sqrt(sum(tf * idf * tf * idf)) AS n FROM dt JOIN tm ON dt.term = tm.term GROUP BY 1),
sc AS (SELECT query_id, d, least(1.0, greatest(0.0, dot / (qn.n * dn.n))) AS score FROM (SELECT qt.query_id, dt.d, sum(dt.tf * qt.idf * qt.w) AS dot FROM dt JOIN qt ON dt.term = qt.term GROUP BY 1, 2) JOIN qn USING (query_id) JOIN dn USING (d))"""


LEX = scores_sql("documents", "doc_id", "benchmark", "item_id")


def bench_queries(t: Tables):
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


def doc_model(t: Tables):
    return ret.fit_tfidf(t.documents.select("doc_id", "text"))


@query("E03_tfidf_fit", f"WITH {tfidf_sql('documents', 'doc_id')} SELECT term, df, {sql_round('idf', 6)} AS idf FROM tm")
def e03(t: Tables):
    return doc_model(t).terms.withColumn("idf", rnd("idf", 6))


@query("E04_query_vector", f"WITH {LEX} SELECT query_id, term, {sql_round('w / n', 6)} AS weight FROM qt JOIN qn USING (query_id)")
def e04(t: Tables):
    return ret.query_vectors(bench_queries(t), doc_model(t)).select("query_id", "term", rnd("qw", 6).alias("weight"))


@query("E05_lexical_scores", f"WITH {LEX} SELECT query_id, count(*) AS n_docs, {sql_round('max(score)', 6)} AS best, {sql_round('sum(score)', 4)} AS total FROM sc GROUP BY 1")
def e05(t: Tables):
    with scratch(t.documents.sparkSession) as keep:
        model, queries = doc_model(t), bench_queries(t)
        s = ret.lexical_scores(ret.written(model, ret.asked_terms(model, queries)), queries)
        totals = s.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_docs"), rnd(F.max("score"), 6).alias("best"), rnd(F.sum("score"), 4).alias("total"))
        return keep(materialize(totals, "lexical-totals"))


_R9 = lambda e: sql_round(e, 9)


@query("E06_more_like_this", f"WITH {scores_sql('documents', 'doc_id', 'documents', 'doc_id')} SELECT query_id, d AS doc_id, {sql_round('s', 4)} AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, d) AS rank FROM (SELECT query_id, d, {_R9('score')} AS s FROM sc WHERE query_id <> d) WHERE s > 0) WHERE rank <= 5")
def e06(t: Tables):
    return ret.more_like_this(t.documents.select("doc_id", "text"), 5, "doc_id", "text")


TOP = f"SELECT query_id, d AS doc_id, {sql_round('s', 4)} AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, d) AS rank FROM (SELECT query_id, d, {_R9('score')} AS s FROM sc) WHERE s > 0) WHERE rank <= 10"


@query("E07_lexical_retrieve", f"WITH {LEX} {TOP}")
def e07(t: Tables):
    return ret.lexical_retrieve(t.documents.select("doc_id", "text"), bench_queries(t), 10)


_FLAGS = "list_filter([nullif(trim(diet_type), ''), CASE WHEN o % 2 = 0 AND lower(trim(diet_type)) <> 'vegetarian' THEN 'Vegetarian' END, CASE WHEN o % 3 = 0 AND lower(trim(diet_type)) <> 'vegan' THEN 'Vegan' END], lambda x: x IS NOT NULL)"


@query("E08_semantic_text", f"""
SELECT recipe_id, concat_ws('. ', trim(recipe_name), 'Cuisine: ' || nullif(trim(cuisine), ''), 'Region: ' || nullif(trim(region), ''), 'Meal Type: ' || meal_type, CASE WHEN lower(category) <> lower(meal_type) THEN 'Category: ' || category END,
  'Diet: ' || array_to_string({_FLAGS}, ', '), 'Ingredients: ' || trim(ingredients)) AS text FROM (SELECT *, order_no AS o FROM recipes)""")
def e08(t: Tables):
    flags = {"Vegetarian": F.col("order_no") % 2 == 0, "Vegan": F.col("order_no") % 3 == 0}
    return t.recipes.select("recipe_id", text.semantic_text(
        F.trim("recipe_name"), F.col("cuisine"), F.col("region"), F.col("meal_type"), F.col("category"), text.diet_tokens(F.col("diet_type"), flags), F.col("ingredients")).alias("text"))


@query("E09_query_text", """
SELECT request_id, concat_ws('. ', 'dinner for ' || segment, 'Cuisine: ' || want_cuisine, 'Meal Type: ' || want_meal,
  'Diet: ' || nullif(concat_ws(', ', CASE WHEN vegetarian THEN 'Vegetarian' END, CASE WHEN vegan THEN 'Vegan' END, CASE WHEN jain THEN 'Jain' END, CASE WHEN satvik THEN 'Satvik' END), ''), 'Ingredients: ' || nullif(available, '')) AS text FROM requests""")
def e09(t: Tables):
    flags = {n.title(): F.col(n) for n in ("vegetarian", "vegan", "jain", "satvik")}
    return t.requests.select("request_id", text.semantic_text(
        F.concat(F.lit("dinner for "), "segment"), F.col("want_cuisine"), F.lit(None).cast("string"), F.col("want_meal"), None,
        text.diet_tokens(F.lit(None).cast("string"), flags), F.col("available")).alias("text"))


@query("E10_vector_checks", "SELECT count(*) AS rows, count(*) FILTER (embedding IS NULL) AS missing, count(*) FILTER (len(embedding) <> 64) AS wrong_dim, count(*) FILTER (abs(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) > 1e-4) AS not_unit FROM embeddings")
def e10(t: Tables):
    return ret.vector_checks(t.embeddings, 64)


SCALED = "SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (1 + vec_id % 5)) AS v FROM embeddings"


@query("E11_l2_normalize", f"SELECT vec_id, {sql_round('list_sum(list_transform(v, lambda x: x / n))', 6)} AS total, {sql_round('v[1] / n', 6)} AS first FROM (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM ({SCALED}))")
def e11(t: Tables):
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * (1 + F.col("vec_id") % 5))
    rows = t.embeddings.select("vec_id", ret.l2_normalize(v).alias("u"))
    return rows.select("vec_id", rnd(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), rnd(F.col("u")[0], 6).alias("first"))


def centroids(t: Tables):
    """One query vector per label: the unit mean of its embeddings."""
    means = t.embeddings.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("x"))
    rows = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("p"))
    return rows.select(F.col("label").alias("query_id"), ret.l2_normalize(F.transform("p", lambda s: s["x"])).alias("vector"))


def corpus(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


CENT = """
cm AS MATERIALIZED (SELECT label, list(x ORDER BY pos) AS v FROM (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(0, 64)) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
cq AS MATERIALIZED (SELECT label AS query_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM cm),
ds AS MATERIALIZED (SELECT query_id, vec_id AS id, label, round(least(1.0, greatest(0.0, list_dot_product(CAST(embedding AS DOUBLE[]), v))), 9) AS score FROM embeddings, cq)"""
_TOPK = lambda col, k, where="TRUE": f"SELECT query_id, id, {sql_round(col, 4)} AS score, CAST(rank AS INT) AS rank FROM (SELECT query_id, id, {col}, row_number() OVER (PARTITION BY query_id ORDER BY {col} DESC, id) AS rank FROM ds WHERE {where}) WHERE rank <= {k}"


@query("E12_dense_scores", f"WITH {CENT} SELECT query_id, count(*) AS n, {sql_round('max(score)', 6)} AS best, {sql_round('sum(score)', 4)} AS total FROM ds GROUP BY 1")
def e12(t: Tables):
    return ret.dense_scores(corpus(t), centroids(t)).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), rnd(F.max("score"), 6).alias("best"), rnd(F.sum("score"), 4).alias("total"))


@query("E13_dense_retrieve", f"WITH {CENT} {_TOPK('score', 10)}")
def e13(t: Tables):
    return ret.dense_top(corpus(t), centroids(t), 10)


# One corpus for both lists: documents that have a vector. A label asks with its centroid and with the text of its first document.
def labelled(t: Tables):
    return t.embeddings.join(t.documents, F.col("vec_id") == F.col("doc_id")).select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"), t.documents["text"])


def label_texts(t: Tables):
    first = t.embeddings.groupBy(F.col("label").alias("query_id")).agg(F.min("vec_id").alias("_first"))
    return first.join(t.documents, F.col("_first") == F.col("doc_id")).select("query_id", "text")


def union(t: Tables):
    with scratch(t.documents.sparkSession) as keep:
        both = materialize(labelled(t), "labelled")
        lexical = ret.lexical_retrieve(both.select("id", "text"), label_texts(t), 50, "id")
        dense = ret.dense_top(both.select("id", "vector"), centroids(t), 50)
        return keep(materialize(ret.candidate_union(lexical, dense), "candidate-union"))


BOTH = f"""dv AS MATERIALIZED (SELECT vec_id AS id, label, text FROM embeddings JOIN documents ON vec_id = doc_id),
lq AS MATERIALIZED (SELECT query_id, text FROM (SELECT label AS query_id, min(vec_id) AS m FROM embeddings GROUP BY 1) JOIN documents ON doc_id = m),
{scores_sql('dv', 'id', 'lq', 'query_id')}, {CENT.strip()},
lx AS (SELECT query_id, id, {sql_round('s', 4)} AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM (SELECT query_id, d AS id, {sql_round('score', 9)} AS s FROM sc) WHERE s > 0) WHERE rank <= 50)"""
_IN_BOTH = "id IN (SELECT id FROM dv)"
UNION = f"""SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, a.score AS tfidf_score, a.rank AS tfidf_rank, b.score AS semantic_score, b.rank AS semantic_rank,
  CASE WHEN a.id IS NULL THEN 'semantic' WHEN b.id IS NULL THEN 'tfidf' ELSE 'both' END AS provenance FROM lx a FULL JOIN ({_TOPK('score', 50, _IN_BOTH)}) b ON a.query_id = b.query_id AND a.id = b.id"""


@query("E14_candidate_union", f"WITH {BOTH} SELECT query_id, id, tfidf_score, CAST(tfidf_rank AS DOUBLE) AS tfidf_rank, semantic_score, CAST(semantic_rank AS DOUBLE) AS semantic_rank, provenance FROM ({UNION})")
def e14(t: Tables):
    return union(t).withColumns({c: F.col(c).cast("double") for c in ("tfidf_rank", "semantic_rank")})


@query("E15_policy_retrieve", f"WITH {CENT} {_TOPK('score', 10, 'label % 3 <> 0')}")
def e15(t: Tables):
    allowed = t.embeddings.where("label % 3 <> 0").select(F.col("vec_id").alias("id"))
    return ret.policy_top(corpus(t), centroids(t), allowed, 10)


DIV = f"""SELECT query_id, n_items, least(1.0, greatest(0.0, 1 - s / p)) AS diversity FROM (SELECT a.query_id, sum(list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[]))) AS s, count(*) AS p, max(n) AS n_items
  FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM ({_TOPK('score', 10)})) a JOIN ({_TOPK('score', 10)}) b ON a.query_id = b.query_id AND a.id < b.id JOIN embeddings x ON a.id = x.vec_id JOIN embeddings y ON b.id = y.vec_id GROUP BY 1)"""


def diversity(t: Tables):
    return ret.list_diversity(ret.dense_top(corpus(t), centroids(t), 10), corpus(t))


@query("E16_retrieval_evaluation", f"""WITH {BOTH}, u AS MATERIALIZED ({UNION}), pq AS (SELECT query_id, count(*) AS pool, count(*) FILTER (tfidf_rank <= 10 AND semantic_rank <= 10) AS b, count(*) FILTER (tfidf_rank <= 10 OR semantic_rank <= 10) AS o FROM u GROUP BY 1)
SELECT count(*) FILTER (provenance = 'tfidf') AS n_tfidf, count(*) FILTER (provenance = 'semantic') AS n_semantic, count(*) FILTER (provenance = 'both') AS n_both,
  {sql_round('count(DISTINCT CASE WHEN tfidf_rank <= 10 THEN id END) * 100.0 / (SELECT count(*) FROM embeddings)', 2)} AS lexical_coverage_pct, {sql_round('count(DISTINCT CASE WHEN semantic_rank <= 10 THEN id END) * 100.0 / (SELECT count(*) FROM embeddings)', 2)} AS dense_coverage_pct,
  {sql_round('count(DISTINCT id) * 100.0 / (SELECT count(*) FROM embeddings)', 2)} AS union_coverage_pct, (SELECT {sql_round('avg(coalesce(b * 1.0 / nullif(o, 0), 0))', 4)} FROM pq) AS mean_jaccard, (SELECT {sql_round('avg(pool)', 2)} FROM pq) AS mean_pool, (SELECT count(*) FROM pq) AS queries,
  (SELECT {sql_round('avg(diversity)', 4)} FROM ({DIV})) AS mean_diversity FROM u""")
def e16(t: Tables):
    return ret.evaluate_retrieval(union(t), diversity(t), t.embeddings.agg(F.count(F.lit(1))).scalar())


@query("E17_list_diversity", f"WITH {CENT} SELECT query_id, n_items, {sql_round('diversity', 6)} AS diversity FROM ({DIV})")
def e17(t: Tables):
    return diversity(t).withColumn("diversity", rnd("diversity", 6))
