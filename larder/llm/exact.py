"""Exact dedup by content-defined chunk recipes. JVM expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.common import fence
from larder.llm.base import SPACE, view
from larder.sources.shared import materialize

#: A chunk has MIN to MAX characters and ends at the first cut after MIN: a space that
#: follows one of these character pairs, so that a cut depends on nearby text only.
MIN_CHUNK, MAX_CHUNK = 256, 4096
CUT = r"(?<=[a-eA-E][n-zN-Z] |[.!?] )"


def normalised(text: Column) -> Column:
    """Each run of white space is one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def chunks_of(norm: Column) -> Column:
    """The content-defined chunks of a text, in order; joined they give the text."""
    pattern = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?{CUT}|.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(norm, F.lit(pattern), F.lit(0))


def recipes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) of ``doc_id, text`` rows.

    documents: doc_id, text_sha256, n_chars, recipe (ordered chunk identifiers),
    odd (see below). chunks: chunk_id, n_chars.

    The identifier of a chunk is its 64-bit hash, verified: the distinct chunk
    texts are grouped by themselves, so that equal text means one row whatever
    its hash, and a hash that two texts share is found by counting. A document
    with such a chunk carries its whole text in ``odd`` and is compared by it;
    for all others the recipe alone decides. Chunk texts move once, after
    map-side deduplication, and documents never move.
    """
    source = fence(docs.select("doc_id", normalised(F.col("text")).alias("norm")))
    cut = fence(source.withColumn("chunks", chunks_of(F.col("norm"))))
    described = materialize(
        cut.select(
            "doc_id", F.sha2(F.col("norm"), 256).alias("text_sha256"), F.length("norm").cast("long").alias("n_chars"),
            F.transform("chunks", lambda c: F.xxhash64(c)).alias("recipe"),
        ),
        "recipes",
    )
    distinct = cut.select(F.explode("chunks").alias("chunk")).distinct()
    chunks = materialize(distinct.select(F.xxhash64("chunk").alias("chunk_id"), F.length("chunk").alias("n_chars")), "chunks")
    shared = materialize(chunks.groupBy("chunk_id").count().where("count > 1").select("chunk_id"), "collisions")
    if shared.isEmpty():
        return described.withColumn("odd", F.lit(None).cast("string")), chunks
    hit = described.select("doc_id", "text_sha256", F.explode("recipe").alias("chunk_id")).join(shared, "chunk_id", "left_semi")
    texts = source.withColumn("text_sha256", F.sha2(F.col("norm"), 256)).join(hit.select("doc_id", "text_sha256").distinct(), ["doc_id", "text_sha256"], "left_semi")
    odd = texts.groupBy("doc_id", "text_sha256").agg(F.max("norm").alias("odd"))
    return described.join(odd, ["doc_id", "text_sha256"], "left"), chunks


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs``.

    Texts are equal when identical after white-space normalisation; null counts
    as empty. The row with the smallest id stays, a null id counts as largest.
    Rows that repeat an id stand and fall together, each counts in the size.

    Recipes are grouped with map-side combination, so a group that holds a third
    of all rows is one row per task before the shuffle. Only groups of two or
    more are joined back, from a written table, so that Spark can split the hot
    ones.
    """
    described, _ = recipes(view(docs, doc_id=id_col, text=text_col))
    groups = described.groupBy("recipe", "odd").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    several = materialize(groups.where("group_size > 1"), "groups")
    left, right = described.alias("d"), several.alias("g")
    same = (F.col("d.recipe") == F.col("g.recipe")) & F.col("d.odd").eqNullSafe(F.col("g.odd"))
    keep = F.when(F.col("g.group_size").isNotNull(), F.col("g.keep_id")).otherwise(F.col("d.doc_id"))
    return left.join(right, same, "left").select(
        F.col("d.doc_id"), keep.alias("keep_id"), F.coalesce("g.group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("d.doc_id")).alias("kept"), F.col("d.text_sha256"),
    )


def query(docs: DataFrame) -> DataFrame:
    return dedup(docs)


SQL = r"""
    WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
           (doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY t)) AS kept, sha256(t) AS text_sha256 FROM n"""
