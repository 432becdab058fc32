"""Mixing sources to target weights by nested hash thresholds, without sorting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.base import WORD, ordinals, packed, view
from larder.sources.shared import materialize

#: Bits of the hash that each level of the histogram resolves.
LEVEL_BITS = (12, 12, 12, 12)
BITS = sum(LEVEL_BITS)
MAX_EPOCHS = 3
WEIGHTS = (5.0, 2.0, 1.0)


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def identity_of(doc_id: Column, text: Column, source: Column) -> Column:
    """MD5 of a row's id, text and source."""
    kind = F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))
    joined = F.concat(kind, F.lit("|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.md5(joined.cast("binary"))


def place_of(identity: Column, ordinal: Column) -> Column:
    """A row's place in [0, 2^48): the first 12 hex digits of the MD5 of its identity and its number among equal rows."""
    return F.conv(F.substring(F.md5(F.concat(identity, F.lit("|"), ordinal.cast("string")).cast("binary")), 1, 12), 16, 10).cast("long")


def targets(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to rows ``source, source_size, weight``: shares of the total, none above its limit.

    Sources whose limit, ``max_epochs`` times their size, is small for their
    weight reach it first: in that order, the rest of the total is divided by the
    rest of the weights until a source stays below its limit. ``sources`` has one
    row per source, whatever the number of documents.
    """
    limited = sources.withColumn("_limit", (F.col("source_size") * max_epochs).cast("double"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("_limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = limited.withColumn("_level", rest / weights)
    free = F.when(F.col("_level") <= F.col("_limit") / F.col("weight"), F.col("_level"))
    first = F.first(free, ignorenulls=True).over(everything)
    return (
        level.withColumn("_free", first)
        .withColumn("target", F.when(F.col("_free").isNull(), F.col("_limit")).otherwise(F.least("_limit", F.col("_free") * F.col("weight"))))
        .drop("_limit", "_level", "_free")
    )


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """``source, _below``: documents placed below ``_below`` come nearest to each source's ``_budget``.

    Level by level: sum sizes by source and the next bits of the place, run
    through the sums of a source in order (at most 2^12 of them), and go on with
    the one bucket in which the budget ends. A level reads only the boundary
    buckets of the one before, so all but the first are small.
    """
    state = budgets.select("source", F.col("_budget").alias("_left"), F.lit(0).cast("long").alias("_base"))
    rows, shift = sized.select("source", "size", "_place"), BITS
    for bits in LEVEL_BITS:
        shift -= bits
        bucket = F.shiftright("_place", shift)
        sums = rows.groupBy("source", bucket.alias("_bucket")).agg(F.sum("size").alias("_n"))
        w = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        run = sums.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
        own = run.alias("r").join(state.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
        # At the last level a bucket is taken if half of it fits; above, the bucket that the budget ends in is refined.
        fits = (F.col("_before") + F.col("_n") / 2 <= F.col("_left")) if shift == 0 else (F.col("_before") + F.col("_n") <= F.col("_left"))
        taken = F.when(fits, F.col("_n")).otherwise(0)
        nxt = F.when(~fits, F.col("_bucket"))
        state = materialize(
            own.groupBy(F.col("s.source").alias("source"), "_left", "_base").agg(F.min(nxt).alias("_next"), F.sum(taken).alias("_taken"))
            .select(
                "source", (F.col("_left") - F.col("_taken")).alias("_left"),
                F.coalesce(F.shiftleft("_next", shift), F.col("_base") + F.lit(1 << (shift + bits))).alias("_base"), F.col("_next").alias("_bucket"),
            ),
            "thresholds",
        )
        if shift:
            r, s = rows.withColumn("_bucket", bucket).alias("r"), state.alias("s")
            at = F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r._bucket") == F.col("s._bucket"))
            rows = materialize(r.join(s, at, "left_semi").select("source", "size", "_place"), "boundary")
            done = state
            state = state.where("_bucket IS NOT NULL").select("source", "_left", "_base")
            finished = done.where("_bucket IS NULL").select("source", F.col("_base").alias("_below"))
            ended = finished if shift == BITS - bits else ended.unionByName(finished)
    return ended.unionByName(state.select("source", F.col("_base").alias("_below")))


def plan(sized: DataFrame, weights: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, target, epochs, _below`` per source of ``source, size, _place`` rows.

    A source gives each document ``epochs`` times, and once more those placed
    below ``_below``. ``weights``: ``source, weight``.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    joined = totals.alias("t").join(weights.alias("w"), F.col("t.source").eqNullSafe(F.col("w.source"))).select("t.source", "source_size", "weight")
    aimed = targets(joined, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    aimed = materialize(aimed.withColumn("epochs", epochs).withColumn("_budget", F.col("target") - F.col("epochs") * F.col("source_size")), "targets")
    ends = thresholds(sized, aimed.where("source_size > 0"))
    a, e = aimed.alias("a"), ends.alias("e")
    below = F.coalesce(F.col("e._below"), F.lit(0))
    return materialize(a.join(e, F.col("a.source").eqNullSafe(F.col("e.source")), "left").select("a.source", "source_size", "target", "epochs", below.alias("_below")), "mix")


def cyclic_weights(sized: DataFrame, cycle: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``source, weight``: the sources by code point, null last, take the weights in turn."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(cycle)
    return sized.select("source").distinct().withColumn("weight", F.get(F.array(*[F.lit(float(x)) for x in cycle]), place))


def mix(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``docs`` plus ``_mix``: size, source_size, target, copies; it takes the place of one ``docs`` has.

    Documents are never moved, but for rows that repeat id, text and source: only
    sizes are summed, and each row is compared with its source's threshold. The
    plan has one row per source, ordered in one task (millions are no burden), and
    reaches the documents by a join that Spark can split for hot sources. Null and
    blank texts have size 0 and are taken like others. A row's place comes from its
    id, text and source and its number among rows equal in all three, so rows
    without an id, and rows that share one, are taken each by itself; a rerun
    takes the same documents.
    """
    id_, text, source = (F.col(f"`{c}`") for c in (id_col, text_col, source_col))
    own = docs.drop("_mix").select(F.struct("*").alias("_row"), source.alias("source"), size_of(text).alias("size"), identity_of(id_, text, source).alias("_same"))
    own = ordinals(own, "_same", "_k").select("_row", "source", "size", place_of(F.col("_same"), F.col("_k")).alias("_place"))
    sized = materialize(own.select("source", "size", "_place"), "sizes")
    planned = plan(sized, weights if weights is not None else cyclic_weights(sized), max_epochs)
    d, p = own.alias("d"), planned.alias("p")
    copies = F.col("epochs") + F.when(F.col("d._place") < F.col("_below"), 1).otherwise(0)
    return d.join(p, F.col("d.source").eqNullSafe(F.col("p.source")), "left").select(
        "d._row.*", F.struct(F.col("d.size").alias("size"), "source_size", "target", copies.cast("long").alias("copies")).alias("_mix")
    )


def repeated(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as it is taken, with its own columns."""
    mixed = mix(packed(docs, "doc_id", "text", "source"), weights)
    return mixed.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("_mix.copies").cast("int")))).select("_row.*")


def query(docs: DataFrame) -> DataFrame:
    mixed = mix(view(docs, doc_id="doc_id", text="text", source="source"))
    return mixed.select("doc_id", "_mix.size", "_mix.source_size", "_mix.target", (F.col("_mix.size") * F.col("_mix.copies")).alias("taken"))


SQL = rf"""
    WITH h AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                      md5(coalesce('s' || source, 'n') || '|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS same FROM documents),
    d AS (SELECT doc_id, source, size, ('0x' || md5(same || '|' || (row_number() OVER (PARTITION BY same) - 1))[1:12])::BIGINT AS place FROM h),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM d GROUP BY source),
    l AS (SELECT *, {MAX_EPOCHS}.0::DOUBLE * source_size AS lim FROM s),
    v AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(lim) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS lev
          FROM l WINDOW b AS (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    f AS (SELECT max(lev) FILTER (WHERE k = 1) AS free FROM (SELECT lev, row_number() OVER (ORDER BY lim / weight, source NULLS LAST) AS k FROM v WHERE lev <= lim / weight)),
    t AS (SELECT source, source_size, CASE WHEN free IS NULL THEN lim ELSE least(lim, free * weight) END AS target FROM v, f),
    e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
    p AS (SELECT source, place, sum(size) AS n FROM d GROUP BY source, place),
    c AS (SELECT p.source, place, (sum(n) OVER (PARTITION BY p.source ORDER BY place) - n / 2.0) <= target - epochs * source_size AS extra
          FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source)
    SELECT d.doc_id, d.size, source_size, target, (d.size * (epochs + extra::INT))::BIGINT AS taken
    FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.place = c.place"""
