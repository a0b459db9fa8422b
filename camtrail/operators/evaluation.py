"""Retrieval evaluation: hits against truth intervals, ranking metrics, AUC, latencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from camtrail.functions import text, vectors, vocabulary as V
from camtrail.scale import broadcast_if_small, join_same, micros, running_counts

NO_MATCH_ERROR = 999.0


def label_matches(result_label: Column, truth_label: Column) -> Column:
    """Same label, a listed synonym of the truth label, or a whole frame (which matches any truth)."""
    r, t = F.trim(F.lower(result_label)), F.trim(F.lower(truth_label))
    synonyms = F.create_map(
        *[c for k, v in V.TRUTH_SYNONYMS.items() for c in (F.lit(k), F.array(*[F.lit(x) for x in v]))]
    )
    listed = F.array_contains(F.try_element_at(synonyms, t), r)
    return (result_label == "whole_frame") | (r == t) | F.coalesce(listed, F.lit(False))


def judge_hits(results: DataFrame, truth: DataFrame, delta_s: float = 3.0, with_labels: bool = True) -> DataFrame:
    """Results with ``hit`` and ``time_error``.

    ``truth``: query_id, truth_no, camera, t_from, t_to, label. A result hits
    when camera (cam_ ignored), label and the interval widened by ``delta_s``
    agree. The error is the distance to the raw interval: of the first
    interval hit, else the smallest among intervals of the camera, else 999.
    An equi-join on (question, camera); the interval is tested on the match.
    """
    t = truth.select(
        "query_id", text.camera_key(F.col("camera")).alias("_cam"), "truth_no",
        micros(F.col("t_from")).alias("_from"), micros(F.col("t_to")).alias("_to"), F.col("label").alias("_truth"),
    )
    r = results.withColumn("_cam", text.camera_key(F.col("camera")))
    both = r.join(t, ["query_id", "_cam"], "left")
    gap = F.greatest(F.col("_from") - F.col("ts_us"), F.col("ts_us") - F.col("_to"), F.lit(0))
    fits = F.col("truth_no").isNotNull()
    if with_labels:
        fits = fits & label_matches(F.col("label"), F.col("_truth"))
    error = F.when(fits, gap / 1e6)
    is_hit = fits & (gap <= int(delta_s * 1_000_000))
    keys = results.columns
    judged = both.withColumn("_e", error).withColumn("_h", F.coalesce(is_hit, F.lit(False)))
    hit_error = F.min_by(F.when(F.col("_h"), F.col("_e")), F.when(F.col("_h"), F.col("truth_no")))
    plain = [c for c in keys if c not in ("query_id", "rank")]
    return judged.groupBy("query_id", "rank").agg(
        *[F.first(c).alias(c) for c in plain],
        F.max("_h").alias("hit"),
        F.coalesce(hit_error, F.min("_e"), F.lit(NO_MATCH_ERROR)).alias("time_error"),
    )


def first_hits(judged: DataFrame) -> DataFrame:
    """First hit rank (0 when none) and its time error per question."""
    rank = F.when(F.col("hit"), F.col("rank"))
    return judged.groupBy("query_id").agg(
        F.coalesce(F.min(rank), F.lit(0)).alias("hit_rank"),
        F.min_by(F.when(F.col("hit"), F.col("time_error")), rank).alias("time_error"),
    )


def retrieval_metrics(queries: DataFrame, hits: DataFrame, by: Sequence[str] = ("mode", "split")) -> DataFrame:
    """MRR, recall@1, recall@5 and mean time error per group, with totals; questions without results count as misses.

    ``hits`` belongs to the same mode of a question when both sides carry one.
    """
    on = [c for c in ("query_id", "mode") if c in hits.columns and c in queries.columns]
    rank = F.coalesce("hit_rank", F.lit(0))
    near = (rank >= 1) & (rank <= 5)
    one = lambda test: F.avg(F.when(test, 1.0).otherwise(0.0))
    return (
        queries.join(hits, on, "left")
        .rollup(*by)
        .agg(
            F.count(F.lit(1)).alias("num_queries"),
            F.round(F.avg(F.when(near, F.try_divide(F.lit(1.0), rank)).otherwise(0.0)), 4).alias("mrr"),
            F.round(one(rank == 1), 4).alias("recall_1"),
            F.round(one(near), 4).alias("recall_5"),
            F.round(F.coalesce(F.avg(F.when(near, F.col("time_error"))), F.lit(0.0)), 2).alias("mean_time_error_s"),
        )
    )


def latency_stats(samples: DataFrame, stage: str = "stage", value: str = "ms") -> DataFrame:
    """Median, interpolated 95th percentile, minimum and worst per stage.

    Ranks come from range-partitioned running counts of distinct values, so no task
    holds the values of a stage; nulls do not count.
    """
    shares = {"median": 0.5, "p95": 0.95}
    base = samples.groupBy(stage).agg(F.count(value).alias("_all"), F.min(value).alias("best"), F.max(value).alias("worst"))
    counts = samples.filter(F.col(value).isNotNull()).groupBy(stage, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_counts(counts, [stage], value, ["_n"])
    ranked = join_same(ranked, broadcast_if_small(base.select(stage, "_all")), [stage])
    at = {name: share * (F.col("_all") - 1) for name, share in shares.items()}

    def holds(place: Column) -> Column:
        return F.max(F.when((place >= F.col("before__n")) & (place < F.col("before__n") + F.col("_n")), F.col(value)))

    around = ranked.groupBy(stage).agg(
        *[holds(F.floor(p)).alias(f"_lo_{n}") for n, p in at.items()], *[holds(F.ceil(p)).alias(f"_hi_{n}") for n, p in at.items()]
    )

    def between(name: str) -> Column:
        low, high, p = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), at[name]
        mixed = (F.ceil(p) - p) * low + (p - F.floor(p)) * high
        return F.round(F.when(low == high, low).otherwise(mixed), 2).alias(name)

    return join_same(base, around, [stage], "left").select(stage, *[between(n) for n in shares], "best", "worst")


def roc_auc(scores: DataFrame, key: str, score: str, positive: str, degenerate: float = 0.5) -> DataFrame:
    """ROC-AUC per key as the Mann-Whitney statistic with average ranks for ties.

    Rows are first reduced to one per (key, distinct score); the number of rows
    below a score comes from range-partitioned running counts, so one huge key
    is spread over tasks.
    """
    ties = scores.groupBy(key, score).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(positive).cast("long")).alias("p")
    )
    ranked = running_counts(ties, [key], score, ["n"])
    mean_rank = F.col("before_n") + (F.col("n") + 1) / 2.0
    sums = ranked.groupBy(key).agg(
        F.sum(F.col("p") * mean_rank).alias("s"), F.sum("p").alias("pos"), (F.sum("n") - F.sum("p")).alias("neg")
    )
    u = F.col("s") - F.col("pos") * (F.col("pos") + 1) / 2.0
    return sums.select(
        key, F.when((F.col("pos") == 0) | (F.col("neg") == 0), F.lit(degenerate))
        .otherwise(F.try_divide(u, F.col("pos") * F.col("neg"))).alias("auc")
    )


def precision_recall_at(scores: DataFrame, key: str, score: str, positive: str, tie: str, k: int) -> DataFrame:
    """Precision@k and recall@k per key."""
    order = W.partitionBy(key).orderBy(F.desc(score), tie)
    top = scores.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= k)
    hits = top.groupBy(key).agg(F.sum(F.col(positive).cast("long")).alias("_h"))
    total = scores.groupBy(key).agg(F.sum(F.col(positive).cast("long")).alias("_t"))
    return total.join(hits, key).select(
        key, (F.col("_h") / F.lit(float(k))).alias("precision"),
        F.when(F.col("_t") > 0, F.col("_h") / F.col("_t")).otherwise(0.0).alias("recall"),
    )


def class_blocks(prompts: DataFrame, block: int = 1_000) -> list[Column]:
    """Class prompts (name, vec) as scalar arrays of at most about ``block`` entries each."""
    parts = max(1, -(-prompts.count() // block))
    pick = F.pmod(F.xxhash64("name"), F.lit(parts))
    return [
        prompts.filter(pick == i).agg(F.collect_list(F.struct(F.col("name"), F.col("vec")))).scalar() for i in range(parts)
    ]


def zero_shot(crops: DataFrame, prompts: DataFrame, block: int = 1_000) -> DataFrame:
    """Best class of every crop with its score; ties go to the smaller name.

    Prompts travel as bounded arrays, so crops are neither shuffled nor paired up.
    """
    out = crops.withColumn("_b", F.lit(None).cast("struct<score:double,name:string>"))
    for classes in class_blocks(prompts, block):
        out = out.withColumn("_c", classes).withColumn("_n", vectors.nearest_class(F.col("emb"), F.col("_c")))
        better = F.col("_b").isNull() | (F.col("_n.score") > F.col("_b.score"))
        better = better | ((F.col("_n.score") == F.col("_b.score")) & (F.col("_n.name") < F.col("_b.name")))
        out = out.withColumn("_b", F.when(better & F.col("_n.name").isNotNull(), F.col("_n")).otherwise(F.col("_b")))
    return out.select(*crops.columns, F.col("_b.name").alias("best"), F.col("_b.score").alias("best_score"))


def class_ranks(crops: DataFrame, prompts: DataFrame, target: str, block: int = 1_000) -> DataFrame:
    """Rank of the target class of every crop among all prompts; equal scores are ordered by name."""
    own = prompts.select(F.col("name").alias(target), F.col("vec").alias("_vec"))
    out = crops.join(broadcast_if_small(own, 10_000), target)
    out = out.withColumn("_own", vectors.dot(F.col("emb"), F.col("_vec"))).withColumn("target_rank", F.lit(1))
    for classes in class_blocks(prompts, block):
        out = out.withColumn("_c", classes)
        scores = F.transform("_c", lambda c: F.struct(vectors.dot(F.col("emb"), c["vec"]).alias("s"), c["name"].alias("n")))
        ahead = F.filter(scores, lambda x: (x["s"] > F.col("_own")) | ((x["s"] == F.col("_own")) & (x["n"] < F.col(target))))
        out = out.withColumn("target_rank", F.col("target_rank") + F.size(ahead))
    return out.select(*crops.columns, "target_rank")


def top1_accuracy(ranked: DataFrame) -> DataFrame:
    return ranked.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum((F.col("target_rank") == 1).cast("long")).alias("correct"),
        F.round(F.avg((F.col("target_rank") == 1).cast("double")) * 100, 2).alias("accuracy_pct"),
    )


def suboptimal(queries: DataFrame, judged: DataFrame) -> DataFrame:
    """Questions whose first hit is not at rank 1, with their (at most top-k) candidates."""
    hits = first_hits(judged)
    shown = judged.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "hit", "score", "result_id"))).alias("candidates")
    )
    return (
        queries.join(hits, "query_id", "left").join(shown, "query_id", "left")
        .withColumn("hit_rank", F.coalesce("hit_rank", F.lit(0)))
        .filter(F.col("hit_rank") != 1)
    )


def word_errors(pairs: DataFrame) -> DataFrame:
    """Word error rate of every (reference, hypothesis) pair."""
    return pairs.withColumn("wer", text.word_error_rate(F.col("reference"), F.col("hypothesis")))


def classifier_agreement(zero_shot: DataFrame, histogram: DataFrame, key: str) -> DataFrame:
    """Share of crops whose zero-shot colour is among the top two histogram colours (``top2`` array)."""
    both = zero_shot.join(histogram, key)
    agree = F.array_contains("top2", F.col("zero_shot"))
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.sum(agree.cast("long")).alias("n_agree"),
        F.round(F.avg(agree.cast("double")) * 100, 1).alias("agreement_pct"),
    )


def detections_side_by_side(detections: DataFrame, setup: str, setups: Sequence[str]) -> DataFrame:
    """Detections per class for two detector set-ups."""
    return detections.groupBy("label").pivot(setup, list(setups)).agg(F.count(F.lit(1))).na.fill(0)


def restrict(results: DataFrame, videos: DataFrame) -> DataFrame:
    """Rows of the given videos only."""
    return results.join(broadcast_if_small(videos.select("video").distinct()), "video", "left_semi")
