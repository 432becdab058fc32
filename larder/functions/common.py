"""Column and DataFrame helpers shared by every operator family."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANK_PATTERN = "(?i)^(nan|none|<na>)?$"


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: Column | str, digits: int) -> Column:
    """Round half-up after snapping to 9 decimals.

    The snap removes the last-bit noise that a different summation order leaves,
    so a result does not depend on how Spark partitioned the rows.
    """
    return F.round(F.round(col_of(c), 9), digits)


def squeeze(c: Column | str) -> Column:
    """Collapse any run of whitespace to one space and trim."""
    return F.trim(F.regexp_replace(col_of(c), r"(?U)\s+", " "))


def blank_to_null(c: Column | str) -> Column:
    """Trimmed text, or NULL for the spellings that mean "missing"."""
    text = F.trim(col_of(c))
    return F.when(~text.rlike(BLANK_PATTERN), text)


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(col_of(c), F.lit(""))


def lookup(key: Column, table: dict[str, object]) -> Column:
    """Value of a fixed lookup table, NULL for an unknown key.

    ``element_at`` keeps the table one constant. ``map[key]`` over literals is
    rewritten as a CASE with a copy of ``key`` in each arm, so that a key worked out
    by patterns is worked out once per entry, in code too long to be compiled.
    """
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.element_at(F.create_map(*pairs), key)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often ``body`` names it.

    The step runs outside whole-stage code, whose one method over a long chain of
    CASE arms grows past what the JVM compiles.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_regex(words: Sequence[str], boundary: bool = True) -> str:
    """One alternation, longest word first, so that no word hides a longer one."""
    ordered = sorted(words, key=lambda w: (-len(w), w))
    body = "|".join(w.replace(".", r"\.") for w in ordered)
    return rf"\b(?:{body})\b" if boundary else f"(?:{body})"


def zero_pad(prefix: str, number: Column, width: int = 5) -> Column:
    """``prefix`` + zero-padded number; wider numbers are never cut."""
    return F.format_string(f"{prefix}%0{width}d", number.cast("long"))


def clip01(c: Column) -> Column:
    """Clip to [0, 1]. NULL stays NULL, although ``least`` and ``greatest`` skip it."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def spread_null(key: Column | str, *row: Column | str) -> Column:
    """Join key for a left join whose NULLs match nothing.

    A shuffle sends all NULL keys to one task. Here each becomes one of 1024
    values that no real key has, so unmatched rows spread over the tasks.
    """
    salt = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*row), F.lit(1024)).cast("string"))
    return F.coalesce(col_of(key).cast("string"), salt)


def count_where(cond: Column) -> Column:
    """Rows for which ``cond`` holds; NULL counts as false, no rows gives 0."""
    return F.count(F.when(cond, F.lit(1)))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group.

    Written as a filtered ``row_number`` so that Spark plans WindowGroupLimit:
    every map task keeps at most ``k`` rows per group before the shuffle, which
    is what makes a group holding a third of all rows harmless.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def global_row_number(df: DataFrame, key: Sequence[str], name: str, buckets: int | None = None) -> DataFrame:
    """1..n in ascending order of the unique ``key`` columns, with no single-task sort.

    Range bounds come from a bounded sample (the rows with the smallest key
    hashes, so the same rows on every evaluation); each range is numbered on its
    own and shifted by the row counts of the ranges before it. Only the bounds
    and one count per range are gathered, both limited by ``buckets``: as many as
    shuffle partitions, 64 at least, so that ranges grow in number with the cluster.
    """
    buckets = buckets or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    per_bucket = 16
    tagged_key = F.struct(*[F.col(c) for c in key])
    sample = (
        df.select(tagged_key.alias("_k"))
        .orderBy(F.xxhash64("_k"), "_k")
        .limit(buckets * per_bucket)
        .agg(F.array_sort(F.collect_list("_k")).alias("_b"))
        .select(F.filter("_b", lambda x, i: i % per_bucket == per_bucket - 1).alias("_b"))
    )
    tagged = (
        df.withColumn("_k", tagged_key)
        .withColumn("_b", sample.scalar())
        .withColumn("_bucket", F.size(F.filter("_b", lambda x: x < F.col("_k"))))
        .drop("_b")
    )
    counts = tagged.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    within = Window.partitionBy("_bucket").orderBy("_k")
    return (
        tagged.withColumn("_rn", F.row_number().over(within))
        .join(F.broadcast(offsets), "_bucket")  # at most buckets + 1 rows
        .withColumn(name, (F.col("_rn") + F.col("_offset")).cast("long"))
        .drop("_rn", "_offset", "_bucket", "_k")
    )


def fence(df: DataFrame) -> DataFrame:
    """Same rows and columns, but the optimizer does not look through them.

    A long chain of text projections is read several times per step. Filters that
    Spark infers for joins would be pushed down the chain and repeat each step
    inside the next, growing without bound. A one-element ``inline`` stops both
    filter pushdown and constraint propagation, stays inside codegen and moves no
    data. Select the needed columns first: all columns of ``df`` are carried.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def require_columns(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Fail once, naming every missing column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{label} missing required columns: {', '.join(missing)}")
    return df


def is_small(df: DataFrame, max_rows: int) -> bool:
    """True if ``df`` has at most ``max_rows`` rows; reads no more than one row beyond."""
    return df.limit(max_rows + 1).count() <= max_rows
