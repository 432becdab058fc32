"""Interaction export, labels, splits, audits, ranking metrics, drift and KPIs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import rules
from larder.functions.common import count_where, global_row_number, is_small, lookup, rnd, text_or_empty, top_k
from larder.sources.shared import materialize

# ---------------------------------------------------------------- labels


def grade(c: Column | str) -> Column:
    """Relevance grade of a feedback type; missing and unknown types count as seen (H2)."""
    key = F.upper(F.trim(text_or_empty(F.col(c) if isinstance(c, str) else c)))
    return F.coalesce(lookup(key, rules.GRADES), F.lit(rules.GRADES["IMPRESSION"]))


def export_interactions(history: DataFrame, feedback: DataFrame, by: Sequence[str] = ("session_id", "user_id", "recipe_id")) -> DataFrame:
    """Impressions with the feedback given on them and its grade (H1).

    Feedback is tied to the session it was given in. Feedback without a session
    goes to the latest earlier impression of that user and recipe, row by row, so
    that repeated feedback stays repeated (``latest_before``). Passing
    ``by=("user_id", "recipe_id")`` ties it to every impression instead.
    """
    fields = ["feedback_type", "rating", "feedback_timestamp"]
    tied = feedback
    if "session_id" in by:
        loose = feedback.where("session_id IS NULL").drop("session_id").withColumn("_at", F.col("feedback_timestamp"))
        seen = history.select("user_id", "recipe_id", F.col("impression_timestamp").alias("_at"), "session_id")
        placed = latest_before(loose, seen, ["user_id", "recipe_id"], "_at", "session_id")
        tied = feedback.where(F.col("session_id").isNotNull()).select(*by, *fields).unionByName(placed.select(*by, *fields))
    return history.join(tied.select(*by, *fields), list(by), "left").withColumn("relevance_label", grade("feedback_type"))


#: Seconds of time that one task looks at for one key.
ASOF_SECONDS = 3600


def latest_before(rows: DataFrame, marks: DataFrame, on: Sequence[str], at: str, value: str, seconds: int = ASOF_SECONDS) -> DataFrame:
    """``rows`` that have an earlier mark, or one of the same moment, of equal ``on``, with its ``value`` (as-of join).

    Of several marks of one moment the largest value counts. Rows and marks meet
    in buckets of time, so that a key with half of all rows is many groups; the
    last mark of each bucket is carried on to the next ones by a window over the
    buckets of a key, of which there are as many as hours in the data. Rows
    without a key or a time are left out before anything moves.
    """
    keyed = lambda df: df.where(F.col(at).isNotNull() & reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])).withColumn(
        "_bucket", F.floor(F.unix_micros(F.col(at).cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")
    )
    group = [*on, "_bucket"]
    left, right = keyed(rows), keyed(marks).select(*group, at, F.struct(F.col(value).alias("v")).alias("_mark"))
    events = right.unionByName(left.withColumn("_row", F.lit(True)), allowMissingColumns=True)
    order = Window.partitionBy(*group).orderBy(at, F.col("_mark").isNull(), "_mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = events.withColumn("_last", F.last("_mark", ignorenulls=True).over(order)).where("_row").drop("_mark", "_row")
    ends = right.groupBy(*group).agg(F.max(F.struct(F.col(at).alias("_t"), "_mark")).alias("_end"))
    wanted = left.select(*group).distinct()
    buckets = wanted.join(ends, group, "full")
    earlier = Window.partitionBy(*on).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.withColumn("_carry", F.last("_end", ignorenulls=True).over(earlier)).select(*group, F.col("_carry._mark").alias("_carry"))
    out = inside.join(carried, group, "left").withColumn("_last", F.coalesce("_last", "_carry"))
    return out.where(F.col("_last").isNotNull()).select(*rows.columns, F.col("_last.v").alias(value))


def resolve_conflicts(df: DataFrame, order: Sequence[str] = ("impression_timestamp",)) -> DataFrame:
    """One row per (session, recipe) by feedback precedence, then ``order`` (H3).

    A ``min_by`` instead of a window: rows of a hot session combine map-side.
    """
    clean = df.withColumn("feedback_type", F.upper(F.coalesce("feedback_type", F.lit("IMPRESSION"))))
    rank = F.coalesce(lookup(F.col("feedback_type"), {a: i for i, a in enumerate(rules.PRECEDENCE)}), F.lit(99))
    rest = [c for c in clean.columns if c not in ("session_id", "recipe_id")]
    best = clean.groupBy("session_id", "recipe_id").agg(F.min_by(F.struct(*rest), F.struct(rank, *order)).alias("_r"))
    return best.select("session_id", "recipe_id", "_r.*").withColumn("relevance_label", grade("feedback_type"))


# ---------------------------------------------------------------- splits


def _part(place: Column, n: Column, train: float, val: float) -> Column:
    return F.when(place <= F.floor(n * train), "train").when(place <= F.floor(n * (train + val)), "val").otherwise("test")


def split_by_session(df: DataFrame, ts: str = "impression_timestamp", train: float = 0.70, val: float = 0.15) -> DataFrame:
    """Adds ``split``: whole sessions in order of their first timestamp (H4)."""
    starts = df.groupBy("session_id").agg(F.min(ts).alias("_start"))
    n = starts.agg(F.count(F.lit(1))).scalar()
    placed = global_row_number(starts, ["_start", "session_id"], "_place").select("session_id", _part(F.col("_place"), n, train, val).alias("split"))
    return df.join(placed, "session_id")


def split_by_row(df: DataFrame, order: Sequence[str], train: float = 0.70, val: float = 0.15) -> DataFrame:
    """Adds ``split`` by row order in time (H6)."""
    n = df.agg(F.count(F.lit(1))).scalar()
    return global_row_number(df, list(order), "_place").withColumn("split", _part(F.col("_place"), n, train, val)).drop("_place")


def leakage_report(df: DataFrame, ts: str = "impression_timestamp") -> DataFrame:
    """Sessions in two splits and time inversions between splits, as one row (H5)."""
    def in_split(s: str) -> Column:
        return F.max(F.when(F.col("split") == s, 1).otherwise(0)).alias(s)

    spread = df.where(F.col("session_id").isNotNull()).groupBy("session_id").agg(*[in_split(s) for s in ("train", "val", "test")])
    pairs = F.col("train") * F.col("val") + F.col("train") * F.col("test") + F.col("val") * F.col("test")
    overlap = spread.agg(F.coalesce(F.sum(pairs), F.lit(0)).alias("n")).scalar()
    edges = df.agg(
        F.max(F.when(F.col("split") == "train", F.col(ts))).alias("_train"),
        F.min(F.when(F.col("split") == "val", F.col(ts))).alias("_val"),
        F.min(F.when(F.col("split") == "test", F.col(ts))).alias("_test"),
    )
    late = [F.when(F.col("_train") > F.col(c), 1).otherwise(0) for c in ("_val", "_test")]
    return edges.select(overlap.cast("long").alias("session_overlap"), (late[0] + late[1]).alias("future_in_train")).withColumn(
        "passed", (F.col("session_overlap") == 0) & (F.col("future_in_train") == 0)
    )


# ---------------------------------------------------------------- audits


def _kind(*types: str) -> Column:
    return F.upper("feedback_type").isin(*types)


def sufficiency(df: DataFrame, ts: str = "impression_timestamp") -> DataFrame:
    """Seven volume thresholds in one row (H7)."""
    span = (F.unix_micros(F.max(F.col(ts).cast("timestamp"))) - F.unix_micros(F.min(F.col(ts).cast("timestamp")))) / 86_400_000_000
    row = df.agg(
        F.count(F.lit(1)).alias("total_interactions"), F.countDistinct("user_id").alias("unique_users"),
        F.countDistinct("recipe_id").alias("unique_recipes"), F.countDistinct("session_id").alias("unique_queries"),
        count_where(_kind("COOKED", "SAVE", "LIKE")).alias("positive_labels"), count_where(_kind("DISLIKE", "HIDE")).alias("negative_labels"),
        F.coalesce(rnd(span, 2), F.lit(0.0)).alias("days_of_data"),
    )
    low = [F.when(F.col(c) < limit, F.lit(c)) for c, limit in rules.SUFFICIENCY.items()]
    return row.withColumn("violations", F.concat_ws(", ", *low)).withColumn(
        "status", F.when(F.col("violations") == "", "SUFFICIENT").otherwise("INSUFFICIENT_DATA")
    )


def training_quality(df: DataFrame) -> DataFrame:
    """Nulls, duplicate impressions, time inversions and unknown feedback types (H8, H9)."""
    row = df.agg(
        F.count(F.lit(1)).alias("total_records"),
        *[count_where(F.col(c).isNull()).alias(f"missing_{c}") for c in ("user_id", "recipe_id", "session_id")],
        (F.count(F.lit(1)) - F.countDistinct(F.struct("session_id", "recipe_id"))).alias("duplicate_records"),
        count_where(F.col("feedback_timestamp") < F.col("impression_timestamp")).alias("temporal_inversions"),
        count_where(~F.upper(text_or_empty(F.col("feedback_type"))).isin(rules.KNOWN_FEEDBACK)).alias("invalid_feedback_types"),
    )
    bad = [F.col(c) for c in ("missing_user_id", "missing_recipe_id", "missing_session_id", "temporal_inversions", "invalid_feedback_types")]
    return row.withColumn("is_valid", (F.col("total_records") > 0) & (reduce(lambda a, b: a + b, bad) == 0))


def feedback_breakdown(df: DataFrame) -> DataFrame:
    """Row counts by feedback type (H9)."""
    return df.where(F.col("feedback_type").isNotNull()).groupBy("feedback_type").agg(F.count(F.lit(1)).alias("n"))


def pilot_audit(feedback: DataFrame, users: DataFrame, recipes: DataFrame, history: DataFrame) -> DataFrame:
    """Referential, duplicate, conflict and time checks of raw feedback."""
    label = F.coalesce(lookup(F.upper(F.trim(text_or_empty(F.col("feedback_type")))), rules.GRADES), F.lit(1))
    base = feedback.agg(
        F.count(F.lit(1)).alias("total_interactions"), F.countDistinct("user_id").alias("unique_users"), F.countDistinct("recipe_id").alias("unique_recipes"),
        count_where(label >= 2).alias("positive_labels"), count_where(label == 0).alias("negative_labels"), count_where(label == 1).alias("neutral_labels"),
        count_where(F.coalesce(F.col("session_id"), F.lit("")) == "").alias("missing_sessions"),
    )

    def one(df: DataFrame, c: Column) -> Column:
        return df.agg(F.coalesce(c, F.lit(0)).cast("long")).scalar()

    unknown = lambda col, known: feedback.select(col).distinct().join(known.select(col).distinct(), col, "left_anti")
    copies = feedback.groupBy("user_id", "recipe_id", "feedback_type", "session_id").agg(F.count(F.lit(1)).alias("n"))
    kinds = feedback.groupBy("session_id", "recipe_id").agg(
        F.min(text_or_empty(F.col("feedback_type"))).alias("lo"), F.max(text_or_empty(F.col("feedback_type"))).alias("hi"))
    shown = history.groupBy("session_id", "recipe_id").agg(F.max("impression_timestamp").alias("_shown"))
    early = feedback.join(shown, ["session_id", "recipe_id"]).where(F.col("feedback_timestamp") < F.col("_shown"))
    row = base.withColumns(
        {
            "invalid_users": one(unknown("user_id", users), F.count(F.lit(1))),
            "invalid_recipes": one(unknown("recipe_id", recipes), F.count(F.lit(1))),
            "duplicate_events": one(copies, F.sum(F.col("n") - 1)),
            "conflicting_pairs": one(kinds.where(F.col("lo") < F.col("hi")), F.count(F.lit(1))),
            "temporal_violations": one(early, F.count(F.lit(1))),
        }
    )
    broken = F.col("invalid_users") + F.col("invalid_recipes") + F.col("temporal_violations") > 0
    return row.withColumn(
        "quality_status",
        F.when(broken, "DEFECTS_DETECTED").when(F.col("duplicate_events") + F.col("missing_sessions") > 0, "ACCEPTABLE").otherwise("CLEAN"),
    )


# ---------------------------------------------------------------- ranking metrics

MRR_PLACES = 10


def ranking_metrics(rows: DataFrame, query: str, order: Sequence[Column], label: str, threshold: float, ks: Sequence[int] = (5, 10)) -> DataFrame:
    """NDCG, precision, recall at each k and MRR@10 per query.

    Only the first ``max(ks)`` places matter (ten at least, for MRR), so both
    orders are cut to that before the shuffle; a query group of any size stays cheap.
    """
    depth = max(MRR_PLACES, *ks)
    gain = F.when(F.col(label) > 0, F.pow(F.lit(2.0), F.col(label).cast("double")) - 1.0).otherwise(0.0)
    discounted = gain / F.log2(F.col("_place") + 1.0)
    hit = F.col(label) >= threshold

    def dcg(k: int) -> Column:
        return F.sum(F.when(F.col("_place") <= k, discounted).otherwise(0.0))

    shown = top_k(rows, [query], list(order), depth, "_place").groupBy(query).agg(
        *[dcg(k).alias(f"_dcg{k}") for k in ks],
        *[count_where(hit & (F.col("_place") <= k)).alias(f"_hit{k}") for k in ks],
        F.coalesce(1.0 / F.min(F.when(hit & (F.col("_place") <= MRR_PLACES), F.col("_place"))), F.lit(0.0)).alias("mrr_10"),
    )
    ideal = top_k(rows, [query], [F.desc(label)], depth, "_place").groupBy(query).agg(*[dcg(k).alias(f"_idcg{k}") for k in ks])
    relevant = rows.groupBy(query).agg(count_where(hit).alias("_relevant"))
    out = shown.join(ideal, query).join(relevant, query)
    for k in ks:
        out = out.withColumns(
            {
                f"ndcg_{k}": F.least(F.lit(1.0), F.coalesce(F.try_divide(f"_dcg{k}", f"_idcg{k}"), F.lit(0.0))),
                f"precision_{k}": F.col(f"_hit{k}") / float(k),
                f"recall_{k}": F.coalesce(F.try_divide(F.col(f"_hit{k}"), F.col("_relevant")), F.lit(0.0)),
            }
        )
    return out.drop(*[c for c in out.columns if c.startswith("_")])


METRICS = ["ndcg_5", "ndcg_10", "mrr_10", "precision_5", "precision_10"]


def macro_mean(per_query: DataFrame, metrics: Sequence[str] = tuple(METRICS), by: Sequence[str] = ()) -> DataFrame:
    """Mean of each metric over queries, to 4 digits."""
    return per_query.groupBy(*by).agg(*[rnd(F.avg(m), 4).alias(m) for m in metrics], F.count(F.lit(1)).alias("queries"))


def compare_rankers(rows: DataFrame, query: str, orders: dict[str, Sequence[Column]], label: str, threshold: float) -> DataFrame:
    """Macro metrics of several rankings of the same groups, one row per ranker."""
    parts = [
        macro_mean(ranking_metrics(rows, query, order, label, threshold)).withColumn("ranker", F.lit(name)) for name, order in orders.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def compare_models(baseline: DataFrame, candidate: DataFrame, violations: Column, zero_result_pct: Column, p95_ms: Column) -> DataFrame:
    """Relative change of each metric and the acceptance gates (H16). Both inputs have one row."""
    b = baseline.select(F.lit(1).alias("_one"), *[F.col(m).alias(f"base_{m}") for m in METRICS])
    c = candidate.select(F.lit(1).alias("_one"), *[F.col(m).alias(f"cand_{m}") for m in METRICS])
    out = b.join(c, "_one").drop("_one")
    out = out.withColumns(
        {
            f"delta_pct_{m}": F.when(F.col(f"base_{m}") > 0, rnd((F.col(f"cand_{m}") - F.col(f"base_{m}")) / F.col(f"base_{m}") * 100.0, 2)).otherwise(0.0)
            for m in METRICS
        }
    )
    out = out.withColumns(
        {
            "gate_violations": violations <= rules.GATES["max_violations"],
            "gate_ndcg5": F.col("delta_pct_ndcg_5") >= rules.GATES["min_ndcg5_pct"],
            "gate_mrr10": F.col("delta_pct_mrr_10") >= rules.GATES["min_mrr10_pct"],
            "gate_zero_results": zero_result_pct <= rules.GATES["max_zero_result_pct"],
            "gate_latency": p95_ms <= rules.GATES["max_p95_ms"],
        }
    )
    gates = [F.col(c) for c in out.columns if c.startswith("gate_")]
    return out.withColumn("passed_all", reduce(lambda x, y: x & y, gates))


def evaluate_recommendations(recs: DataFrame, diversity: DataFrame, catalogue_size: Column, score: str = "score") -> DataFrame:
    """Catalogue coverage, unique items, diversity and score spread."""
    return recs.agg(
        F.countDistinct("id").alias("unique_items"), rnd(F.avg(score), 4).alias("score_mean"), rnd(F.min(score), 4).alias("score_min"),
        rnd(F.max(score), 4).alias("score_max"), rnd(F.stddev_pop(score), 4).alias("score_std"),
    ).withColumns(
        {
            "catalogue_coverage": rnd(F.col("unique_items") / catalogue_size, 4),
            "mean_diversity": diversity.agg(rnd(F.avg("diversity"), 4)).scalar(),
        }
    )


def label_drift(baseline: DataFrame, current: DataFrame, query: str | None = None, min_samples: int = 50) -> DataFrame:
    """Volume ratio and total variation distance of feedback types (H18); also over ``query`` keys if given."""
    def distance(column: str) -> Column:
        def shares(df: DataFrame, name: str) -> DataFrame:
            total = df.where(F.col(column).isNotNull()).agg(F.count(F.lit(1))).scalar()
            return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg((F.count(F.lit(1)) / total).alias(name))

        both = shares(baseline, "_p").join(shares(current, "_q"), "_v", "full")
        gap = F.abs(F.coalesce("_p", F.lit(0.0)) - F.coalesce("_q", F.lit(0.0)))
        return both.agg(rnd(F.sum(gap) / 2.0, 4)).scalar()

    sizes = baseline.agg(F.count(F.lit(1)).alias("baseline_rows")).withColumn("current_rows", current.agg(F.count(F.lit(1))).scalar())
    enough = (F.col("baseline_rows") >= min_samples) & (F.col("current_rows") >= min_samples)
    return sizes.withColumns(
        {
            "status": F.when(enough, "EVALUATED").otherwise("INSUFFICIENT_DATA"),
            "volume_ratio": F.when(enough, rnd(F.col("current_rows") / F.col("baseline_rows"), 3)),
            "label_drift": F.when(enough, distance("feedback_type")),
            "query_drift": F.when(enough, distance(query)) if query else F.lit(None).cast("double"),
        }
    )


# ---------------------------------------------------------------- KPIs and listings


def product_kpis(users: DataFrame, history: DataFrame, feedback: DataFrame) -> DataFrame:
    """Adoption, usage and engagement counts in one row (H19); what is not measured stays NULL."""
    kinds = ["IMPRESSION", "LIKE", "SAVE", "COOKED", "DISLIKE", "HIDE"]
    row = feedback.agg(*[count_where(F.upper("feedback_type") == k).alias(f"n_{k.lower()}") for k in kinds])
    return row.withColumns(
        {
            "total_engagements": reduce(lambda a, b: a + b, [F.col(f"n_{k.lower()}") for k in kinds[1:]]),
            "enrolled_users": users.agg(F.count(F.lit(1))).scalar(),
            "active_users": history.agg(F.countDistinct("user_id")).scalar(),
            "recommendation_requests": history.agg(F.countDistinct("session_id")).scalar(),
            "failed_requests": F.lit(None).cast("long"),
        }
    )


#: Buckets of a range that a rank is searched in; ranges that may go to every task.
RANK_BUCKETS, BROADCAST_RANGES = 1024, 1 << 14
PERCENTILES = (0.5, 0.95, 0.99)


def values_at(rows: DataFrame, by: Sequence[str], value: str, ranks: DataFrame) -> DataFrame:
    """``by, p, found``: the value at each 0-based ``index`` of a group's sorted values, for ``ranks`` of ``by, p, index``.

    Distributed selection. The range of a group is cut into RANK_BUCKETS, counts
    by bucket combine before the shuffle, and the bucket that holds the index is
    the next range, cut at its own least and largest value, until both are equal.
    No task holds more of a group than the counts of its buckets; a round reads
    the rows in the ranges that are left. The number of rounds is at most that of
    the digits of a value in that base, some of 6.
    """
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by])
    held = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    ends = held.groupBy(*by).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    state = ranks.alias("k").join(ends.alias("e"), same("k", "e")).select(*[F.col(f"k.{c}").alias(c) for c in by], "k.p", "k.index", "e.lo", "e.hi")
    state = materialize(state, "ranks")
    done = []
    while True:
        done.append(state.where("lo = hi").select(*by, "p", F.col("lo").alias("found")))
        wide = state.where("lo < hi")
        if wide.isEmpty():
            return reduce(DataFrame.unionByName, done)
        ranges = wide.select(*by, "lo", "hi").distinct()
        ranges = F.broadcast(ranges) if is_small(ranges, BROADCAST_RANGES) else ranges
        inside = held.alias("r").join(ranges.alias("g"), same("r", "g") & F.col("r._v").between(F.col("g.lo"), F.col("g.hi")))
        bucket = F.least(F.floor((F.col("r._v") - F.col("g.lo")) / (F.col("g.hi") - F.col("g.lo")) * RANK_BUCKETS), F.lit(RANK_BUCKETS - 1))
        counts = inside.groupBy(*[F.col(f"g.{c}").alias(c) for c in by], "g.lo", "g.hi", bucket.alias("_b")).agg(
            F.count(F.lit(1)).alias("_n"), F.min("r._v").alias("_least"), F.max("r._v").alias("_most")
        )
        upto = Window.partitionBy(*by, "lo", "hi").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
        placed = counts.withColumn("_upto", F.sum("_n").over(upto))
        s, c = wide.alias("s"), placed.alias("c")
        at = same("s", "c") & (F.col("s.lo") == F.col("c.lo")) & (F.col("s.hi") == F.col("c.hi"))
        hit = s.join(c, at).where((F.col("index") < F.col("_upto")) & (F.col("index") >= F.col("_upto") - F.col("_n")))
        nxt = hit.select(*[F.col(f"s.{x}").alias(x) for x in by], "s.p", (F.col("index") - F.col("_upto") + F.col("_n")).alias("index"), F.col("_least").alias("lo"), F.col("_most").alias("hi"))
        state = materialize(nxt, "ranks")


def latency_percentiles(rows: DataFrame, by: Sequence[str], value: str, newest_first: Sequence[Column] = (), keep: int | None = None) -> DataFrame:
    """Count, mean and nearest-index percentiles per group (H20), over all rows or the newest ``keep``.

    The value at each index comes from ``values_at``, so a group with all rows spreads over all tasks.
    """
    used = top_k(rows, by, newest_first, keep, "_r") if keep else rows
    totals = used.groupBy(*by).agg(F.count(value).alias("samples"), rnd(F.avg(value), 2).alias("avg_ms")).where("samples > 0")
    p = F.explode(F.array(*[F.lit(x) for x in PERCENTILES])).alias("p")
    ranks = totals.select(*by, "samples", p).select(*by, "p", F.least(F.floor(F.col("samples") * F.col("p")), F.col("samples") - 1).alias("index"))
    found = values_at(used, by, value, ranks)
    at = lambda x: rnd(F.max(F.when(F.col("p") == x, F.col("found"))), 2)
    wide = found.groupBy(*by).agg(at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms"), at(0.99).alias("p99_ms"))
    t, w = totals.alias("t"), wide.alias("w")
    on = reduce(lambda x, y: x & y, [F.col(f"t.{c}").eqNullSafe(F.col(f"w.{c}")) for c in by])
    return t.join(w, on).select("t.*", "p50_ms", "p95_ms", "p99_ms")


def request_kpis(rows: DataFrame, is_error: Column) -> DataFrame:
    """Requests, error rate, active and returning users."""
    visits = rows.groupBy("user_id").agg(F.countDistinct("session_id").alias("_n"))
    return rows.agg(
        F.count(F.lit(1)).alias("total_requests"), count_where(is_error).alias("total_errors"), F.countDistinct("user_id").alias("active_users")
    ).withColumns(
        {
            "error_rate": F.coalesce(rnd(F.try_divide("total_errors", "total_requests"), 4), F.lit(0.0)),
            "returning_users": visits.agg(count_where(F.col("_n") > 1)).scalar(),
        }
    )


def history_page(history: DataFrame, limit: int, offset: int, newest_first: Sequence[Column]) -> DataFrame:
    """One page of every user's history with the user's total."""
    totals = history.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    page = top_k(history, ["user_id"], newest_first, offset + limit, "place").where(F.col("place") > offset)
    return page.join(totals, "user_id")


def newest_feedback(feedback: DataFrame, where: Column, newest_first: Sequence[Column], limit: int) -> DataFrame:
    """Newest feedback rows that match."""
    return feedback.where(where).orderBy(*newest_first).limit(limit)
