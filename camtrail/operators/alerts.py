"""Standing alert rules: definition tables and the rule x track similarity join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from camtrail.operators import scoring
from camtrail.scale import broadcast_if_small, cut_lineage

DEFAULT_SCORE = 0.05


def create_rules(rules: DataFrame, new: DataFrame) -> DataFrame:
    """Append rules (rule_name, query_text, q_emb, camera_filter, min_score, created_at); the id is a hash of name, text, camera and threshold."""
    named = F.to_json(F.struct("rule_name", "query_text", "camera_filter", F.coalesce("min_score", F.lit(DEFAULT_SCORE)).alias("min_score")))
    made = new.select(
        F.concat(F.lit("rule_"), F.sha2(named, 256)).alias("id"),
        "rule_name",
        "query_text",
        "q_emb",
        "camera_filter",
        F.coalesce("min_score", F.lit(DEFAULT_SCORE)).alias("min_score"),
        F.lit(True).alias("is_active"),
        "created_at",
    )
    return rules.unionByName(made, allowMissingColumns=True)


def active_rules(rules: DataFrame, active_only: bool = True) -> DataFrame:
    """Rules, newest first."""
    kept = rules.filter("is_active") if active_only else rules
    return kept.orderBy(F.desc("created_at"), "id")


def delete_rules(rules: DataFrame, events: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules and events without the deleted rules (``gone``: id)."""
    left = rules.join(gone.select("id"), "id", "left_anti")
    kept = events.join(gone.select(F.col("id").alias("rule_id")), "rule_id", "left_anti")
    return left, kept


def event_id(rule: Column, track: Column) -> Column:
    """The same rule and track always give the same event, so a repeated batch adds nothing."""
    rule, track = rule.cast("string"), track.cast("string")
    key = F.concat_ws("|", F.length(rule), rule, track)  # the length keeps ("a|b", "c") and ("a", "b|c") apart
    return F.concat(F.lit("evt_"), F.sha2(key, 256))


def evaluate(rules: DataFrame, tracks: DataFrame, fired: DataFrame | None = None) -> DataFrame:
    """New events: active rule x track with cosine >= min_score, exact camera filter, not fired before.

    Rules are scored as blocks of vectors while the tracks stream by; only
    pairs at or above their own rule's threshold leave the scan. A rule without a threshold never fires. ``fired`` (rule_id, track_id) removes pairs already stored.
    """
    live = cut_lineage(rules.filter("is_active"))  # read twice below
    least = F.coalesce("min_score", F.lit(float("inf"))).alias("minimum")
    probes = live.select(F.col("id").alias("query_id"), "q_emb", F.col("camera_filter").alias("camera_key"), least)
    rows = tracks.select(
        F.col("id").alias("track_id"), "camera", F.col("camera").alias("camera_key"), "label", "t_start", "snapshot", "emb"
    )
    hits = scoring.score(
        rows, probes, ["track_id", "camera", "label", "t_start", "snapshot"], cosine=True, raw=True
    )
    rule = live.select(F.col("id").alias("rule_id"), "rule_name", "query_text")
    events = hits.withColumnRenamed("query_id", "rule_id").join(broadcast_if_small(rule), "rule_id")
    if fired is not None:
        events = events.join(fired.select("rule_id", "track_id"), ["rule_id", "track_id"], "left_anti")
    return events.select(
        event_id(F.col("rule_id"), F.col("track_id")).alias("event_id"),
        "rule_id", "rule_name", "track_id", "camera", "label", F.round("score", 4).alias("score"),
        F.col("t_start").alias("ts"), "snapshot",
    )


def touch_rules(rules: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """Set last_triggered_at of the rules that fired."""
    hit = events.select(F.col("rule_id").alias("id")).distinct().withColumn("_now", now)
    out = rules.join(hit, "id", "left")
    before = F.col("last_triggered_at") if "last_triggered_at" in rules.columns else F.lit(None).cast("timestamp_ntz")
    return out.withColumn("last_triggered_at", F.coalesce("_now", before)).drop("_now")


def recent_events(events: DataFrame, rules: DataFrame, rule_id=None, limit: int = 50) -> DataFrame:
    """Events with their rule, newest first."""
    if rule_id is not None:
        events = events.filter(F.col("rule_id") == rule_id)
    rule = rules.select(F.col("id").alias("rule_id"), "rule_name", "query_text")
    return events.drop("rule_name", "query_text").join(rule, "rule_id").orderBy(F.desc("ts"), "event_id").limit(limit)
