"""Quality rules: a table of thresholds compiled into one projection."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.common import fence
from larder.llm.base import SPACE_CHARS, packed, view, words_of


class Rule(NamedTuple):
    """A document passes if ``low <= metric <= high``; an open end is None."""

    name: str
    metric: str
    low: float | None
    high: float | None


# Common function words of English, French, Spanish and German.
STOP_WORDS = (
    "the of and to in a is that it for on with as are was be this by an or at from have not "
    "le la les de des du un une et en que qui dans pour pas sur au par est ce avec il "
    "el los las y del se con por una su al lo como para mi no "
    "der die das und zu den von mit sich auf für ist im dem nicht ein eine als auch es an"
).split()

#: Languages of the stop words, and the words from which their absence tells something.
STOP_LANGS, STOP_MIN_WORDS = ("en", "fr", "es", "de"), 30
#: Characters of other scripts than Latin.
OTHER_SCRIPT = r"[^\x00-\x{024F}\x{1E00}-\x{1EFF}\x{2000}-\x{2BFF}]"

#: Metrics of ``measure`` and the range a good document has.
RULES = (
    Rule("length", "n_words", 10, None),
    Rule("word_length", "mean_word_chars", 2.0, 15.0),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("shouting", "upper_word_ratio", None, 0.4),
    Rule("exclamation", "bang_word_ratio", None, 0.3),
    Rule("stop_words", "stop_word_ratio", 0.02, None),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5),
    Rule("ellipsis_lines", "ellipsis_line_ratio", None, 0.5),
    Rule("bullet_lines", "bullet_line_ratio", None, 0.9),
    Rule("repetition", "repeat_word_ratio", None, 0.2),
)

WINDOW = 5


def measure(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All columns of ``docs`` plus a struct ``_quality`` of counts and ratios, which takes the place of one it has.

    One scan, no shuffle and no user function: every count is an array or string
    expression of the whole text, so a row needs no other row. A null text counts
    as empty: all counts are 0 and the ratios are 0. ``stop_word_ratio`` is 1 where
    missing stop words tell nothing: in texts of less than STOP_MIN_WORDS words,
    in a language (``lang_col``, where there is one) that the list does not cover,
    and in texts of another script. Repeated word windows are
    found by sorting the 64-bit hashes of the windows of one document; positions
    are worked out only where two hashes are equal.
    """
    whole = F.coalesce(F.col("_text"), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    empty = F.array().cast("array<bigint>")
    lang = F.col(f"`{lang_col}`").cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    start = docs.drop("_quality").select(F.struct("*").alias("_row"), F.col(f"`{text_col}`").alias("_text"), lang.alias("_lang"))
    foreign = F.coalesce(~F.col("_lang").isin(list(STOP_LANGS)), F.lit(False)) | (2 * F.regexp_count(whole, F.lit(OTHER_SCRIPT)) > F.length(whole))
    start = start.select("_row", "_text", foreign.alias("_foreign"))
    split = fence(start.select("_row", "_text", "_foreign", words_of(F.col("_text")).alias("_words"), lines.alias("_lines")))
    n = F.size("_words")
    window = F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: F.xxhash64(*[F.get(F.col("_words"), i + k) for k in range(WINDOW)]),
    )
    hashed = fence(
        split.select(
            "_row", "_words", "_lines", "_foreign",
            F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long").alias("_symbols"),
            F.when(n >= WINDOW, window).otherwise(empty).alias("_hashes"),
        )
    )
    ordered = fence(hashed.withColumn("_sorted", F.sort_array("_hashes")))
    last = F.size("_sorted") - 1
    twice = F.size(F.array_distinct("_sorted")) <= last
    pairs = F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    marked = fence(ordered.withColumn("_pairs", F.when(twice, pairs)))
    same = lambda i, j: F.get(F.col("_pairs"), i)["h"].eqNullSafe(F.get(F.col("_pairs"), j)["h"])
    at = F.filter("_pairs", lambda p, k: ((k > 0) & same(k, k - 1)) | ((k < last) & same(k, k + 1)))
    placed = fence(
        marked.select("_row", "_words", "_lines", "_foreign", "_symbols", F.sort_array(F.transform(at, lambda p: p["i"])).alias("_at"))
    )
    return placed.select(F.col("_row.*"), _metrics().alias("_quality"))


def _metrics() -> Column:
    words, lines, at = F.col("_words"), F.col("_lines"), F.col("_at")
    n_words, n_lines = F.size(words).cast("long"), F.size(lines).cast("long")
    chars = F.length(F.array_join(words, "")).cast("long")
    steps = F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1), x + WINDOW) - x))
    repeated = F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    dup_lines = n_lines - F.size(F.array_distinct(lines))
    share = lambda count, total: F.when(total > 0, count / total).otherwise(F.lit(0.0))
    some = lambda array, keep: F.size(F.filter(array, keep))
    bare = lambda w: F.lower(F.btrim(w, F.lit(".,;:!?\"'()")))
    joined = F.array_join(words, " ")
    return F.struct(
        n_words.alias("n_words"),
        chars.alias("word_chars"),
        F.col("_symbols").alias("n_symbols"),
        dup_lines.cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        n_lines.alias("n_lines"),
        share(chars, n_words).alias("mean_word_chars"),
        share(F.col("_symbols"), n_words).alias("symbol_ratio"),
        share(F.regexp_count(joined, F.lit(r"(?<![^ ])[^\p{Ll} ]*\p{Lu}{2}[^\p{Ll} ]*(?![^ ])")), n_words).alias("upper_word_ratio"),
        share(F.regexp_count(joined, F.lit("!(?: |$)")), n_words).alias("bang_word_ratio"),
        F.when((n_words < STOP_MIN_WORDS) | F.col("_foreign"), 1.0).otherwise(share(some(words, lambda w: bare(w).isin(list(STOP_WORDS))), n_words)).alias("stop_word_ratio"),
        share(dup_lines, n_lines).alias("dup_line_ratio"),
        share(some(lines, lambda x: F.btrim(x, F.lit(SPACE_CHARS)).rlike(r"(\.\.\.|…)$")), n_lines).alias("ellipsis_line_ratio"),
        share(some(lines, lambda x: F.btrim(x, F.lit(SPACE_CHARS)).rlike("^[-*•‣·] ")), n_lines).alias("bullet_line_ratio"),
        share(repeated, n_words).alias("repeat_word_ratio"),
    )


def compile_rules(rules: tuple[Rule, ...], source: str = "_quality") -> Column:
    """Array of the names of the rules a row breaks, as one expression."""
    broken = []
    for rule in rules:
        metric = F.col(f"{source}.{rule.metric}")
        tests = [t for t in ((metric < rule.low) if rule.low is not None else None, (metric > rule.high) if rule.high is not None else None) if t is not None]
        if not tests:
            continue
        bad = tests[0] if len(tests) == 1 else tests[0] | tests[1]
        broken.append(F.when(bad, F.lit(rule.name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``measure`` plus ``_broken`` (rules broken) and ``_kept``; repeated rows get equal verdicts."""
    measured = fence(measure(docs, text_col))
    judged = measured.withColumn("_broken", compile_rules(rules))
    q = F.col("_quality")
    base = (q["n_words"] < 10) | (100 * q["n_repeat_words"] > 20 * q["n_words"])
    return judged.withColumn("_base_failed", base).withColumn("_kept", ~base & (F.size("_broken") == 0))


def filter_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that break no rule, with their own columns."""
    return judge(packed(docs, text_col, *(["lang"] if "lang" in docs.columns and text_col != "lang" else [])), rules, text_col).where("_kept").select("_row.*")


def query(docs: DataFrame) -> DataFrame:
    judged = judge(view(docs, doc_id="doc_id", text="text", **({"lang": "lang"} if "lang" in docs.columns else {})))
    q = F.col("_quality")
    return judged.select(
        "doc_id", *[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"),
    )


def _sql() -> str:
    """The same counts and rules in SQL."""
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    langs = ", ".join(f"'{x}'" for x in STOP_LANGS)
    keep = []
    for r in RULES:
        if r.low is not None:
            keep.append(f"{r.metric} >= {r.low}")
        if r.high is not None:
            keep.append(f"{r.metric} <= {r.high}")
    return rf"""
    WITH d AS (
      SELECT doc_id, (coalesce(lang NOT IN ({langs}), FALSE) OR 2 * length(regexp_replace(coalesce(text, ''), '[\x00-\x{{024F}}\x{{1E00}}-\x{{1EFF}}\x{{2000}}-\x{{2BFF}}]', '', 'g')) > length(coalesce(text, ''))) AS foreign_, row_number() OVER () AS rid, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    ln AS (SELECT rid, l FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
    la AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines,
                  count(*) FILTER (WHERE regexp_matches(trim(l, chr(32)||chr(9)||chr(11)||chr(12)||chr(13)), '(\.\.\.|…)$')) AS n_dots,
                  count(*) FILTER (WHERE regexp_matches(trim(l, chr(32)||chr(9)||chr(11)||chr(12)||chr(13)), '^[-*•‣·] ')) AS n_bullets FROM ln GROUP BY rid),
    wi AS (SELECT rid, i, array_to_string(words[i:i+4], ' ') AS w FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM d)),
    rep AS (SELECT rid, i FROM wi QUALIFY count(*) OVER (PARTITION BY rid, w) > 1),
    ra AS (SELECT rid, sum(least(5, coalesce(nx - i, 5))) AS n_rep FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM rep) GROUP BY rid),
    c AS (SELECT doc_id, foreign_, len(words) AS n_words, coalesce(length(array_to_string(words, '')), 0) AS word_chars,
                 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                 coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_rep, 0) AS n_repeat_words,
                 coalesce(n_lines, 0) AS n_lines, coalesce(n_dots, 0) AS n_dots, coalesce(n_bullets, 0) AS n_bullets,
                 len(list_filter(words, lambda w: regexp_matches(w, '^\P{{Ll}}*\p{{Lu}}{{2}}\P{{Ll}}*$'))) AS n_upper,
                 len(list_filter(words, lambda w: w LIKE '%!')) AS n_bang,
                 len(list_filter(words, lambda w: lower(trim(w, '.,;:!?"''()')) IN ({stop}))) AS n_stop
          FROM d LEFT JOIN la USING (rid) LEFT JOIN ra USING (rid)),
    m AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
                 CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio,
                 CASE WHEN n_words > 0 THEN n_upper / n_words ELSE 0 END AS upper_word_ratio,
                 CASE WHEN n_words > 0 THEN n_bang / n_words ELSE 0 END AS bang_word_ratio,
                 CASE WHEN n_words < {STOP_MIN_WORDS} OR foreign_ THEN 1 WHEN n_words > 0 THEN n_stop / n_words ELSE 0 END AS stop_word_ratio,
                 CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
                 CASE WHEN n_lines > 0 THEN n_dots / n_lines ELSE 0 END AS ellipsis_line_ratio,
                 CASE WHEN n_lines > 0 THEN n_bullets / n_lines ELSE 0 END AS bullet_line_ratio,
                 CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_word_ratio,
                 (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM c)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
           (NOT base_failed AND {' AND '.join(keep)}) AS kept FROM m"""


SQL = _sql()
