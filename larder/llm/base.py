"""What the operators of this subpackage share: word definition, views of a table, shared folders."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.common import is_small
from larder.sources.shared import materialize

#: A word is a maximal run of other characters than space, \t, \n, \v, \f and \r.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def view(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns of ``df`` under the given names, so that no other column can clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def packed(df: DataFrame, *columns: str) -> DataFrame:
    """All columns of ``df`` as the struct ``_row``, and the named ones beside it, so that no other column can clash."""
    return df.select(F.struct("*").alias("_row"), *[F.col(f"`{c}`") for c in columns])


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE, -1))


#: Keys of 32 bytes that may go to every task.
BROADCAST_KEYS = 1 << 17


def ordinals(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` plus ``name``: 0, 1, 2, ... among rows of equal ``key``, 0 where a key occurs once.

    Only rows of repeated keys are written and numbered: per task that wrote them,
    after the rows of the tasks before, so that a hot key is numbered in many tasks.
    """
    repeated = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(key).alias("_repeated"))
    repeated = materialize(repeated, "repeated")
    if repeated.isEmpty():
        return rows.withColumn(name, F.lit(0).cast("long"))
    those = F.broadcast(repeated) if is_small(repeated, BROADCAST_KEYS) else repeated
    alone = rows.join(those, F.col(key) == F.col("_repeated"), "left_anti").withColumn(name, F.lit(0).cast("long"))
    several = rows.join(those, F.col(key) == F.col("_repeated"), "left_semi")
    written = materialize(several.withColumn("_serial", F.monotonically_increasing_id()), "repeated-rows")
    task = F.shiftright("_serial", 33)
    counts = written.groupBy(F.col(key).alias("_repeated"), task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_repeated").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy(key, "_task").orderBy("_serial")) - 1
    placed = written.withColumn("_task", task).withColumn("_place_in_task", place)
    joined = placed.alias("r").join(starts.alias("s"), (F.col(f"r.{key}") == F.col("s._repeated")) & (F.col("r._task") == F.col("s._task")))
    return alone.unionByName(joined.select(*[F.col(f"r.{c}") for c in rows.columns], (F.col("_start") + F.col("_place_in_task")).cast("long").alias(name)))


def lowered_words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8 with A-Z in lower case.

    ``bytes`` methods touch ASCII only: ``lower`` maps A-Z, and ``split`` cuts at
    exactly the six white-space characters of SPACE.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples of the named columns, one batch in memory at a time."""
    for batch in batches:
        yield from zip(*[batch.column(n).to_pylist() for n in names], strict=True)
