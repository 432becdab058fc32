"""Secret scans: a random forest removes false findings. DataFrame expressions and Spark ML only."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.common import fence
from larder.llm.base import view, words_of
from larder.sources.shared import materialize

#: A candidate is a run of these characters inside a word: of MIN_LENGTH with a digit, in a vendor's
#: format, or of SHORT_LENGTH after an announcing word or an assignment.
MIN_LENGTH, SHORT_LENGTH = 16, 4
CANDIDATE = rf"[A-Za-z0-9+/_\-]{{{SHORT_LENGTH},}}={{0,2}}"
LONG_CANDIDATE = rf"[A-Za-z0-9+/_\-]{{{MIN_LENGTH},}}"
#: Words taken on each side.
NEIGHBOURS = 3
#: At most so many labelled findings, half of each label, train the forest.
TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 20, 6, 7
THRESHOLD = 0.5

# Words that stand in readable names, that announce a secret, or that mark an example.
DICTIONARY = (
    "account admin agent android apache api app application array auth background base body button cache call center cert class client code color com "
    "common component config content control count create css data database date debug default delete demo dev dir display docs document domain "
    "download edit element email enable end error event example export factory field file filter flag font footer form format frame from func "
    "function get group handler hash head header height help home host html http https icon image img import index info init input install instance "
    "item java java key label lang language layout left length lib light line link linux list load local log login main manager map margin max menu "
    "message method min mode model module name net network new next node note null number object off offset open option order org output package page "
    "panel param parent password path plugin point port position post private process product project property public query read record ref remote "
    "report request resource response right root row sample schema script search section secret select sequence server service session set setting "
    "site size source sql start state static status stop storage store string style submit system tab table tag target task temp template test text "
    "the theme time title token tool top total tree true type update upload url user utils value version view web width window with word work write xml "
    "and for this that der die und les des que los las"
).split()
ANNOUNCING = "key keys token secret password passwd pwd apikey api_key access_key auth bearer credential credentials private"
EXAMPLES = "example sample dummy placeholder changeme xxxx test fake 12345678 abcdef"
VENDORS = r"^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^sk_(live|test)_[A-Za-z0-9]{16,}$|^AIza[A-Za-z0-9_\-]{35}$|^eyJ[A-Za-z0-9_\-]{16,}"

#: Text that ends with an assignment.
ASSIGNED = r"[=:]\s*[\"'`(\[{<]*$"

FEATURES = [
    "length", "case_changes", "digit_changes", "symbol_changes", "digit_share", "upper_share", "vowel_share", "distinct_share", "hex_only", "coverage",
    "longest_letters", "assigned", "quoted", "path_example", "path_config", "near_secret", "near_example", "near_letters",
]


def candidates(docs: DataFrame, path: Column) -> DataFrame:
    """doc_id, place (number of the word), part (of the word), candidate, prefix (text before it in the word), path, before, after.

    One projection over the words of each whole text; only the words that hold a
    candidate leave it, with their neighbours. Null and empty texts have none.
    Whether a candidate is prose is left to the forest.
    """
    split = docs.select("doc_id", path.alias("path"), words_of(F.col("text")).alias("words"))
    split = fence(fence(split).withColumn("announced", F.transform("words", lambda w: _has_word(F.lower(w), ANNOUNCING))))
    word = lambda i: F.get(F.col("words"), i)
    announced = lambda i: F.coalesce(F.get(F.col("announced"), i), F.lit(False))
    follows = lambda i: (
        announced(i) | announced(i - 1) | announced(i - 2) | announced(i - 3) | word(i).rlike("[=:]") | F.coalesce(word(i - 1).rlike(ASSIGNED), F.lit(False))
    )
    places = F.filter(
        F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: (F.length(word(i)) >= SHORT_LENGTH)
        & word(i).rlike(CANDIDATE)
        & ((word(i).rlike(LONG_CANDIDATE) & word(i).rlike("[0-9]")) | word(i).rlike(VENDORS.replace("^", "").replace("$", "")) | follows(i)),
    )
    around = lambda start, stop: F.lower(F.array_join(F.slice("words", start, stop), " "))
    found = split.select("doc_id", "path", "words", F.explode(places).alias("place")).select(
        "doc_id", "path", "place", word(F.col("place")).alias("word"),
        around(F.greatest(F.lit(1), F.col("place") + 1 - NEIGHBOURS), F.least(F.lit(NEIGHBOURS), F.col("place"))).alias("before"),
        around(F.col("place") + 2, F.lit(NEIGHBOURS)).alias("after"),
    )
    parts = found.select("*", F.posexplode(F.regexp_extract_all("word", F.lit(CANDIDATE), F.lit(0))).alias("part", "candidate"))
    parts = fence(parts.withColumn("prefix", F.lower(F.expr("substring_index(word, candidate, 1)"))))
    c, leading = F.col("candidate"), F.concat_ws(" ", "before", "prefix")
    follows = _has_word(leading, ANNOUNCING) | (leading.rlike(ASSIGNED) & ~c.rlike("^//"))
    return parts.where((c.rlike(LONG_CANDIDATE) & c.rlike("[0-9]")) | c.rlike(VENDORS) | follows)


def _has_word(text: Column, words: str) -> Column:
    return text.rlike(r"(?:^|[^a-z])(?:" + "|".join(words.split()) + r")(?:[^a-z]|$)")


def _with_word(text: Column, words: str) -> Column:
    return _has_word(text, words).cast("double")


def features(found: DataFrame) -> DataFrame:
    """``found`` plus FEATURES: length, character transitions, dictionary coverage, path and neighbouring words."""
    c = F.col("candidate")
    n = F.length(c).cast("double")
    count = lambda pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    bare = F.regexp_replace(F.lower(c), "|".join(sorted({w for w in DICTIONARY if len(w) > 2}, key=lambda w: (-len(w), w))), "")
    near = F.concat_ws(" ", "before", "prefix", "after")
    leading = F.concat_ws(" ", "before", "prefix")
    path = F.lower(F.coalesce("path", F.lit("")))
    columns = {
        "length": n,
        "case_changes": count("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])") / n,
        "digit_changes": count("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])") / n,
        "symbol_changes": count(r"(?<=[A-Za-z0-9])(?=[^A-Za-z0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])") / n,
        "digit_share": count("[0-9]") / n,
        "upper_share": count("[A-Z]") / n,
        "vowel_share": count("[AEIOUaeiou]") / n,
        "distinct_share": F.size(F.array_distinct(F.split(c, ""))) / n,
        "hex_only": c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "coverage": 1 - F.length(bare) / n,
        "longest_letters": F.array_max(F.transform(F.split(c, "[^A-Za-z]+"), lambda x: F.length(x))) / n,
        "assigned": F.col("prefix").rlike("[=:]").cast("double") + F.col("before").rlike("[=:]$").cast("double"),
        "quoted": F.col("prefix").rlike("[\"'`]$").cast("double"),
        "path_example": path.rlike("test|example|sample|demo|mock|fixture|docs?/").cast("double"),
        "path_config": path.rlike(r"\.env|config|settings|secret|credential|\.ya?ml|\.ini|\.pem").cast("double"),
        "near_secret": _with_word(leading, ANNOUNCING),
        "near_example": _with_word(near, EXAMPLES),
        "near_letters": F.length(F.regexp_replace(near, "[^a-z]", "")) / F.greatest(F.length(near), F.lit(1)),
    }
    return fence(found).withColumns({k: v.cast("double") for k, v in columns.items()})


def labelled(described: DataFrame) -> DataFrame:
    """The findings that rules are sure of, plus ``label``: the training set where nobody has labelled findings by hand.

    Secret (1): a vendor's format, or a value without readable words that an
    announcing word is given. Not (0): numbers, readable names, examples, and long
    words of prose. Everything else stays unlabelled.
    """
    c = F.col("candidate")
    readable = F.col("coverage") > 0.5
    example = (F.col("near_example") > 0) | F.lower(c).rlike("|".join(EXAMPLES.split()))
    vendor = c.rlike(VENDORS)
    given = (F.col("near_secret") > 0) & (F.col("assigned") > 0) & (F.col("digit_share") > 0.1) & (F.col("digit_share") < 0.95) & (F.col("coverage") < 0.2)
    false = c.rlike("^[0-9+/_-]+=*$") | readable | example | (F.col("digit_share") < 0.05)
    label = F.when(false & ~vendor, 0.0).when((vendor | given) & ~example, 1.0)
    return described.withColumn("label", label).where("label IS NOT NULL")


def train(findings: DataFrame, rows: int = TRAIN_ROWS) -> RandomForestClassificationModel | None:
    """A forest over FEATURES of labelled findings; None unless both labels occur.

    Copies of a finding, candidate and neighbours alike, count once for a label.
    The bounded sample is, of each label, the ``rows // 2`` findings with the
    smallest hashes, in one sorted partition, so that a rerun trains the same
    forest and neither copies nor a common label crowd the other label out.
    """
    same = ["candidate", "before", "after", "label"]
    distinct = findings.groupBy(*same).agg(F.min(F.struct(*FEATURES)).alias("_own"))
    distinct = distinct.select(F.xxhash64("candidate", "before", "after").alias("_key"), "_own.*", "label")
    order = ["_key", *FEATURES]
    halves = [distinct.where(F.col("label") == label).orderBy(*order).limit(rows // 2) for label in (0.0, 1.0)]
    sample = halves[0].unionByName(halves[1]).coalesce(1).sortWithinPartitions(*order, "label").select(*FEATURES, "label")
    sample = materialize(sample, "secret-sample")
    if sample.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample.coalesce(1)))


def judge(described: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """``described`` plus ``probability`` and ``is_secret``; without a model a finding counts as a secret if a vendor's format fits."""
    if model is None:
        return described.withColumn("probability", F.col("candidate").rlike(VENDORS).cast("double")).withColumn("is_secret", F.col("probability") >= THRESHOLD)
    judged = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(described))
    return judged.withColumn("probability", vector_to_array("probability")[1]).withColumn("is_secret", F.col("probability") >= THRESHOLD)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", findings: DataFrame | None = None) -> DataFrame:
    """Every finding in ``docs`` with its features, probability and verdict.

    ``findings``: labelled ones (columns of ``features`` and ``label``) to train on;
    by default the rules of ``labelled`` pick them from the scan. The scan is one
    pass over the texts; findings are few, are written once, and all are judged.
    A repeated row has its findings again.
    """
    rows = view(docs, doc_id=id_col, text=text_col, path=path_col)
    described = materialize(features(candidates(rows, F.col("path"))), "findings")
    return judge(described, train(findings if findings is not None else labelled(described)))


def query(docs: DataFrame) -> DataFrame:
    return scan(docs).select(
        "doc_id", F.col("place").cast("long").alias("place"), F.col("part").cast("long").alias("part"), F.length("candidate").cast("long").alias("length"),
        F.sha2("candidate", 256).alias("candidate_sha256"), F.round("probability", 6).alias("probability"), "is_secret",
    )
