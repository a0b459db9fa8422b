"""Mixing sources to target weights: repetition rates per source, whole copies plus one hash-seeded draw per document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from camtrail.scale import broadcast_if_small

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def _sized(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))


def targets(sized: DataFrame, source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(mix_source, source_size, target): what each source gives to the mix.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` times all sizes; a target stops at ``cap``
    times its source's size and the excess goes to the others by weight until none is above. That fixed point is one water level:
    targets are min(cap, level * weight), and the level is found with running sums over the sources, one row each. Empty sources get 0.
    """
    sums = sized.groupBy(F.col(source).alias("mix_source")).agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("mix_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    s = sums.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * float(cap))
    order = W.orderBy(F.col("_cap") / F.col("_w"), F.col("mix_source").asc_nulls_last())
    whole = W.partitionBy()
    s = s.withColumns({
        "_capped": F.coalesce(F.sum("_cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
        "_open": F.sum("_w").over(order.rowsBetween(0, W.unboundedFollowing)),
        "_total": F.sum("source_size").over(whole) * float(share),
    }).withColumn("_level", (F.col("_total") - F.col("_capped")) / F.col("_open"))
    level = F.max(F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.col("_level"))).over(whole)
    s = s.withColumn("_water", level)
    target = F.when(F.col("_water").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_water") * F.col("_w")))
    return s.select("mix_source", "source_size", target.alias("target"))


def plan_mix(
    docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", weights: Sequence[float] = WEIGHTS,
    share: float = SHARE, cap: float = CAP, seed: str = SEED,
) -> DataFrame:
    """Every row of ``docs`` with size (words), source_size, target and copies: floor(rate), plus one if the row's draw is below the fraction.

    The draw comes from a hash of ``seed`` and doc_id alone (of the text where doc_id is null), so reruns and retried tasks agree; rows
    with one doc_id share it. Columns of ``docs`` named like a new one are replaced. A null text has size 0 and is copied like any other row; a source without words has rate 0. Integer and fractional parts of a rate are
    below ``cap`` + 1, so no document exceeds ``cap`` times its size when ``cap`` is whole. A source with any share of the rows costs one
    row per task in the sums; the targets, one row per source, are broadcast after they were counted.
    """
    sized = _sized(docs.drop("size", "source_size", "target", "copies"), text)
    goal = targets(sized, source, weights, share, cap)
    rows = sized.join(broadcast_if_small(goal), F.col(source).eqNullSafe(F.col("mix_source")), "left").drop("mix_source")
    who = F.coalesce(F.col(doc_id).cast("string"), F.col(text), F.lit(""))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), who)), 1, 13), 16, 10).cast("double") / float(1 << 52)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("_rate", rate)
    whole = F.floor("_rate")
    return rows.withColumn("copies", (whole + F.when(draw < F.col("_rate") - whole, 1).otherwise(0)).cast("long")).drop("_rate")


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as plan_mix says, with the columns of ``docs`` only."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    keys = [options.get(k, k) for k in ("source", "text", "doc_id")]
    planned = plan_mix(docs.select(own, *[F.col(f"`{c}`") for c in keys]), **options)
    repeated = planned.filter("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return repeated.select("_row.*")


def oracle(weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> str:
    cases = " ".join(f"WHEN {i} THEN {float(w)}" for i, w in enumerate(weights))
    return rf"""
    WITH sized AS (SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT size FROM documents),
    sums AS (SELECT source, sum(size)::BIGINT source_size FROM sized GROUP BY source),
    weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {cases} END::DOUBLE w,
                source_size * {float(cap)}::DOUBLE c FROM sums),
    levels AS (SELECT *, (sum(source_size) OVER () * {float(share)}::DOUBLE
               - coalesce(sum(c) OVER (ORDER BY c / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / sum(w) OVER (ORDER BY c / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) lv FROM weighed),
    goal AS (SELECT source, source_size, least(c, coalesce(max(CASE WHEN lv <= c / w THEN lv END) OVER () * w, c)) target FROM levels),
    rated AS (SELECT s.doc_id, s.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END rate,
              ('0x' || substr(md5('{seed}:' || coalesce(s.doc_id::VARCHAR, s.text, '')), 1, 13))::BIGINT / {float(1 << 52)}::DOUBLE draw
              FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
    SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT taken FROM rated"""
