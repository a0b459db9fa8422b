"""Search, joins, aliases, alerts, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from camtrail.functions import text, vectors, vocabulary as V
from camtrail.operators import alerts, assets, evaluation, greedy, places, providers, reid, scoring, search
from camtrail.plans import ask as ask_plan
from camtrail.scale import cut_lineage, micros
from camtrail.sources import keyed, video_files, zones
from checks.expressions import BOOST, CLASSES_SQL, LABELS, PARSED, TRACKS_COLS, class_vectors, dot, norm, polygon_test
from checks.registry import query, stored
from checks.views import seconds_sql

K = 5
DEDUP_S = 600

# --- SQL building blocks -----------------------------------------------------

CAMERAS = "(SELECT camera FROM videos UNION SELECT camera FROM tracks)"
PLAIN = "regexp_replace(lower({}), '^cam_', '')"
ALIAS_NAME = r"""trim(regexp_replace(regexp_replace(CASE WHEN starts_with(lower(trim({0})), 'the ') THEN trim(substr(lower(trim({0})), 5))
  ELSE lower(trim({0})) END, '[^\p{{L}}\p{{N}}_\s\-]', '', 'g'), '\s+', ' ', 'g'))"""
BY_ALIAS = f"""(SELECT place, name AS alias, camera, polygon FROM (
  SELECT p.place, a.name, a.camera, a.polygon, row_number() OVER (PARTITION BY p.place ORDER BY CASE WHEN a.name = p.ref THEN 0 ELSE 1 END, length(a.name) DESC, a.name) AS rn
  FROM (SELECT DISTINCT place, {ALIAS_NAME.format('place')} AS ref FROM {PARSED} WHERE place IS NOT NULL) p
  JOIN aliases a ON p.ref <> '' AND (a.name = p.ref OR contains(p.ref, a.name) OR contains(a.name, p.ref))) WHERE rn = 1)"""
BY_CAMERA = f"""(SELECT p.place, min(c.camera) AS known FROM (SELECT DISTINCT place FROM {PARSED} WHERE place IS NOT NULL) p
  JOIN {CAMERAS} c ON lower(p.place) IN (lower(c.camera), {PLAIN.format('c.camera')}) GROUP BY p.place)"""
RESOLVED = f"""(SELECT q.query_id, q.text, q.t_start, q.t_end, q.place, q.prompt, coalesce(k.known, a.camera) AS camera,
  CASE WHEN k.known IS NULL THEN a.polygon END AS polygon,
  CASE WHEN q.place IS NULL THEN 'NONE' WHEN coalesce(k.known, a.camera) IS NULL THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS status
  FROM {PARSED} q LEFT JOIN {BY_CAMERA} k ON k.place = q.place LEFT JOIN {BY_ALIAS} a ON a.place = q.place)"""


def greedy_sql(rows: str, group: str, order: str, conflict: str, keep: str, limit: int | None = None) -> str:
    """Recursive form of a greedy pass: walk each group in order carrying the kept rows."""
    stop = f"len(s.kept) >= {limit} OR " if limit else ""
    cap = f" WHERE len(s.kept) < {limit}" if limit else ""
    return f"""WITH RECURSIVE ordered AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS rn FROM ({rows})),
    steps AS (SELECT {group}, rn, [{keep}] AS kept FROM ordered o WHERE rn = 1
      UNION ALL SELECT {', '.join('o.' + g.strip() for g in group.split(','))}, o.rn,
        CASE WHEN {stop}len(list_filter(s.kept, lambda k: {conflict})) > 0 THEN s.kept ELSE list_append(s.kept, {keep}) END
      FROM steps s JOIN ordered o ON {' AND '.join(f's.{g.strip()} = o.{g.strip()}' for g in group.split(','))} AND o.rn = s.rn + 1{cap}),
    kept AS (SELECT {group}, arg_max(kept, rn) AS kept FROM steps GROUP BY {group})"""


# --- Retrieval ---------------------------------------------------------------

CANDIDATES = f"""SELECT q.query_id, t.id AS result_id, 'track' AS result_type, t.camera, epoch_us(t.t_best) AS ts_us, t.offset_best AS offset_s, t.label,
    coalesce(t.cols[1], 'unknown') AS color, {dot('q.q_emb', 't.emb')} + {BOOST} AS raw
  FROM q JOIN {TRACKS_COLS} t ON (q.camera IS NULL OR {PLAIN.format('t.camera')} = {PLAIN.format('q.camera')})
    AND (q.t_start IS NULL OR q.t_end IS NULL OR (t.t_start <= q.t_end AND t.t_end >= q.t_start))
    AND (q.labels IS NULL OR lower(t.label) = 'object' OR list_contains(q.labels, lower(t.label)))
    AND {polygon_test('((t.bx1 + t.bx2) / 2.0)', '((t.by1 + t.by2) / 2.0)', 'q.polygon')}"""
FRAME_CANDIDATES = f"""SELECT q.query_id, f.id AS result_id, 'frame' AS result_type, f.camera, epoch_us(f.t_abs) AS ts_us, f.offset_s, 'whole_frame' AS label,
    CAST(NULL AS VARCHAR) AS color, {dot('q.q_emb', 'f.emb')} AS raw
  FROM q JOIN frames f ON (q.camera IS NULL OR {PLAIN.format('f.camera')} = {PLAIN.format('q.camera')})
    AND (q.t_start IS NULL OR q.t_end IS NULL OR f.t_abs BETWEEN q.t_start AND q.t_end)
  WHERE (q.polygon IS NULL OR len(q.polygon) < 3)"""
SEARCH_Q = f"""q AS MATERIALIZED (SELECT s.query_id, s.text, s.q_emb, r.camera, r.t_start, r.t_end, r.polygon, l.labels FROM search_questions s
  JOIN {RESOLVED} r ON r.query_id = s.query_id JOIN {LABELS} l ON l.query_id = s.query_id WHERE r.status <> 'UNRESOLVED'),
  tc AS MATERIALIZED ({CANDIDATES}),
  cand AS MATERIALIZED (SELECT *, round(raw, 4) AS score FROM (SELECT * FROM tc UNION ALL
    SELECT f.* FROM ({FRAME_CANDIDATES}) f JOIN q ON q.query_id = f.query_id
    WHERE q.labels IS NULL OR f.query_id NOT IN (SELECT query_id FROM tc)))"""


def search_sql(limit: int = K, select: str | None = None) -> str:
    """The whole search with de-duplication as SQL; ends in a CTE ``found``."""
    walk = greedy_sql(
        "SELECT * FROM cand", "query_id", "score DESC, result_type DESC, result_id",
        f"k.camera = o.camera AND abs(k.ts_us - o.ts_us) <= {DEDUP_S * 1000000}",
        "{'result_id': o.result_id, 'result_type': o.result_type, 'camera': o.camera, 'ts_us': o.ts_us, 'offset_s': o.offset_s, "
        "'label': o.label, 'color': o.color, 'score': o.score}", limit,
    )
    walk = walk.replace("WITH RECURSIVE ordered", f"WITH RECURSIVE {SEARCH_Q}, ordered", 1)
    found = """, found AS (SELECT query_id, unnest(range(1, len(kept) + 1)) AS rank, unnest(kept) AS r FROM kept)"""
    return walk + found + (select or """ SELECT query_id, rank, r.result_id AS result_id, r.result_type AS result_type, r.camera AS camera, r.ts_us AS ts_us,
      r.offset_s AS offset_s, r.score AS score, r.label AS label, r.color AS color FROM found""")


def searched(d):
    return ask_plan.ask(d.search_questions, d.tracks, d.frames, d.videos, d.aliases, k=K, dedup_s=DEDUP_S)


@query("v05_filtered_search", search_sql())
def _(d):
    """Every question against tracks and fallback frames: filters, scores, colour boost, de-duplication, top k."""
    results, _ = searched(d)
    return results.select("query_id", "rank", "result_id", "result_type", "camera", "ts_us", "offset_s", "score", "label", "color")


TC = "(SELECT 'track' AS result_type, id AS result_id, camera, epoch_us(t_best) AS ts_us, label, emb FROM tracks UNION ALL SELECT 'frame', id, camera, epoch_us(t_abs), 'whole_frame', emb FROM frames)"
BATCH = f"""(SELECT query_id, result_id, result_type, camera, ts_us, label, score, rank FROM (
  SELECT q.query_id, r.*, round({dot('q.q_emb', 'r.emb')}, 4) AS score,
   row_number() OVER (PARTITION BY q.query_id ORDER BY round({dot('q.q_emb', 'r.emb')}, 4) DESC, r.result_type DESC, r.result_id) AS rank
  FROM search_questions q, {TC} r) WHERE rank <= {K})"""


def batch(d):
    q = d.search_questions.select("query_id", "q_emb")
    return search.top_k(q, d.tracks.withColumn("colors", F.lit("{}")), d.frames, k=K, dedup_s=None, gated=False)


@query("v08_batch_search", f"SELECT query_id, rank, result_id, result_type, score FROM {BATCH}")
def _(d):
    """All questions of the corpus against all tracks and frames, no filters."""
    return batch(d).select("query_id", "rank", "result_id", "result_type", "score")


# A night that three days of recordings reach into.
ZONE_FROM, ZONE_TO, ZONE_LEAST = "2024-01-10 22:00:00", "2024-01-12 04:00:00", 0.3


@query(
    "f03_zone_mapped_search",
    f"""SELECT query_id, rank, result_id, camera, score FROM (SELECT q.query_id, t.id AS result_id, t.camera, round({dot('q.q_emb', 't.emb')}, 4) AS score,
      row_number() OVER (PARTITION BY q.query_id ORDER BY round({dot('q.q_emb', 't.emb')}, 4) DESC, t.id) AS rank FROM search_questions q
      JOIN tracks t ON t.t_start <= TIMESTAMP '{ZONE_TO}' AND t.t_end >= TIMESTAMP '{ZONE_FROM}' WHERE {dot('q.q_emb', 't.emb')} >= {ZONE_LEAST}) WHERE rank <= {K}""",
)
def _(d):
    """All questions over stored tracks, by a window and a threshold: folders of other days and files that cannot reach the threshold are not opened."""
    table = stored(d, keyed.tracks, d.tracks)
    at = lambda t: micros(F.lit(t).cast("timestamp_ntz"))
    q = d.search_questions.select("query_id", "q_emb", at(ZONE_FROM).alias("start_us"), at(ZONE_TO).alias("end_us"))
    found = search.top_k(q, zones.ZonedTable(table, least=ZONE_LEAST), k=K, threshold=ZONE_LEAST, dedup_s=None)
    return found.select("query_id", "rank", "result_id", "camera", "score")


@query(
    "v09_whole_frame_baseline",
    f"""SELECT query_id, rank, result_id, score FROM (SELECT q.query_id, f.id AS result_id, round({dot('q.q_emb', 'f.emb')}, 4) AS score,
      row_number() OVER (PARTITION BY q.query_id ORDER BY round({dot('q.q_emb', 'f.emb')}, 4) DESC, f.id) AS rank FROM search_questions q, frames f) WHERE rank <= {K}""",
)
def _(d):
    q = d.search_questions.select("query_id", "q_emb")
    return search.frame_baseline(q, d.frames, K).select("query_id", "rank", "result_id", "score")


@query(
    "v11_score_blend_rerank",
    f"""WITH j AS (SELECT b.*, CASE WHEN rank <> 4 THEN CASE WHEN label = 'car' OR label = 'whole_frame' THEN 0.4 * score + 0.6 * (CASE WHEN rank = 2 THEN 0.9 ELSE 0.25 END)
      ELSE 0.4 * score END END AS blended FROM {BATCH} b),
    s AS (SELECT *, CASE WHEN rank <= 4 AND blended IS NOT NULL THEN round(blended, 4) ELSE score END AS new_score FROM j)
    SELECT query_id, result_id, rank AS old_rank, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank <= 4 THEN 0 ELSE 1 END,
      CASE WHEN rank <= 4 THEN -new_score END, rank) AS new_rank, new_score AS score FROM s""",
)
def _(d):
    b = batch(d)
    judged = b.filter(F.col("rank") != 4).select(
        "query_id", "result_id", F.col("label").isin("car", "whole_frame").alias("is_match"),
        F.when(F.col("rank") == 2, 0.9).otherwise(0.25).alias("conf"),
    )
    return search.rerank(b, judged, k=4).withColumn("new_rank", F.col("new_rank").cast("long")).withColumn(
        "old_rank", F.col("old_rank").cast("long")
    )


@query(
    "f13_frame_fallback_gate",
    f"""WITH {SEARCH_Q} SELECT result_type, count(DISTINCT query_id) AS questions, count(*) AS candidates FROM cand GROUP BY result_type""",
)
def _(d):
    """Which questions see frames at all, over complete candidate sets."""
    resolved = places.resolve(places.parse(d.search_questions), places.known_cameras(d.videos, d.tracks), d.aliases)
    q = ask_plan.search_queries(resolved.filter(F.col("status") != "UNRESOLVED"))
    found = search.candidate_counts(q, d.tracks, d.frames)
    return found.groupBy("result_type").agg(F.count(F.lit(1)).alias("questions"), F.sum("n").alias("candidates"))


@query(
    "d01_temporal_dedup",
    greedy_sql("SELECT id, camera, epoch_us(t_start) AS us, quality FROM tracks", "camera", "quality DESC, id",
               f"abs(k.us - o.us) <= {DEDUP_S * 1000000}", "{'id': o.id, 'us': o.us}")
    + " SELECT camera, k.id AS id FROM (SELECT camera, unnest(kept) AS k FROM kept)",
)
def _(d):
    rows = d.tracks.select("id", "camera", micros(F.col("t_start")).alias("us"), "quality")
    return greedy.thin_in_time(rows, ["camera"], "us", [("quality", True)], "id", DEDUP_S).select("camera", "id")


@query("o01_top_k_by_score", f"""SELECT id, score FROM (SELECT t.id, round({dot('t.emb', 'p.emb')}, 4) AS score FROM tracks t, tracks p WHERE p.id = 't7')
    ORDER BY score DESC, id LIMIT 10""")
def _(d):
    probe = d.tracks.filter(F.col("id") == "t7").select("emb").first().emb
    s = F.round(vectors.dot(F.array(*[F.lit(float(x)) for x in probe]), F.col("emb")), 4)
    return d.tracks.select("id", s.alias("score")).orderBy(F.desc("score"), "id").limit(10)


@query("o02_order_and_limit", "SELECT path, camera, start_time FROM videos ORDER BY start_time DESC, path LIMIT 50")
def _(d):
    return video_files.newest_first(d.videos.select("path", "camera", "start_time"))


@query("o03_candidate_union", f"SELECT result_type, result_id, camera, ts_us, label FROM {TC}")
def _(d):
    cols = ["result_type", "result_id", "camera", "ts_us", "label"]
    return search.track_rows(d.tracks).select(cols).unionByName(search.frame_rows(d.frames).select(cols))


@query("o04_known_cameras", f"SELECT camera FROM {CAMERAS}")
def _(d):
    return places.known_cameras(d.videos, d.tracks)


@query(
    "o05_vocabulary_extension",
    "SELECT DISTINCT lower(trim(w)) AS word FROM (SELECT p_name AS w FROM part UNION ALL SELECT upper(p_type) FROM part) WHERE trim(w) <> ''",
)
def _(d):
    part = d.table("part")
    words = part.select(F.col("p_name").alias("label"))
    return places.extend_vocabulary(words, part.select(F.upper("p_type").alias("label"))).select(F.col("label").alias("word"))


# --- Joins -------------------------------------------------------------------

GAP_S, MIN_SIM = 7200, 0.3
PAIRS = f"""(SELECT a.id AS src, b.id AS dst, a.camera AS ca, b.camera AS cb, a.t_start AS ta, b.t_start AS tb, b.label AS lb, b.t_end AS te,
   {dot('a.emb', 'b.emb')} / ({norm('a.emb')} * {norm('b.emb')}) AS sim
  FROM tracks a JOIN tracks b ON a.camera <> b.camera AND abs(epoch_us(b.t_start) - epoch_us(a.t_start)) <= {GAP_S * 1000000})"""


@query(
    "j01_reid_of_track",
    f"""SELECT dst AS track_id, cb AS camera, round(sim, 4) AS similarity, tb AS t_start, {seconds_sql('(epoch_us(tb) - epoch_us(ta))', 2)} AS time_delta_s,
     CASE WHEN tb > ta THEN 'after' WHEN tb < ta THEN 'before' ELSE 'concurrent' END AS chronological_order
    FROM {PAIRS} WHERE src = 't9' AND sim >= 0.05""",
)
def _(d):
    return reid.matches_of(d.tracks, "t9", 0.05, GAP_S).select(
        "track_id", "camera", "similarity", "t_start", "time_delta_s", "chronological_order"
    )


@query(
    "d07_trajectory_narrative",
    f"""SELECT src AS query_id, '[' || any_value(ca) || ' @ ' || strftime(any_value(ta), '%Y-%m-%dT%H:%M:%S.%f') || '] ' ||
      string_agg('-> [' || cb || ' @ ' || strftime(tb, '%Y-%m-%dT%H:%M:%S.%f') || ' (sim: ' || printf('%.2f', round(sim, 4)) || ')]', ' ' ORDER BY tb, -round(sim, 4), dst) AS trajectory
    FROM {PAIRS} WHERE src = 't9' AND sim >= 0.05 GROUP BY src""",
)
def _(d):
    return reid.narrative(reid.matches_of(d.tracks, "t9", 0.05, GAP_S))


@query(
    "j02_cross_camera_associations",
    f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY tb, round(sim, 4) DESC, dst) AS rn FROM {PAIRS} WHERE sim >= {MIN_SIM}),
    u AS (SELECT *, row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY ta, src) AS first FROM m WHERE rn <= 3)
    SELECT src AS track_a, dst AS track_b, ca AS camera_a, cb AS camera_b, round(sim, 4) AS similarity,
      {seconds_sql('(epoch_us(tb) - epoch_us(ta))', 2)} AS time_delta_s FROM u WHERE first = 1""",
)
def _(d):
    return reid.associations(d.tracks, MIN_SIM, GAP_S, 3).select(
        "track_a", "track_b", "camera_a", "camera_b", "similarity", "time_delta_s"
    )


HITS = f"""(SELECT r.id AS rule_id, r.rule_name, t.id AS track_id, t.camera, t.label, t.t_start AS ts,
   {dot('r.q_emb', 't.emb')} / ({norm('r.q_emb')} * {norm('t.emb')}) AS sim, r.min_score
  FROM rules r JOIN tracks t ON r.is_active AND (r.camera_filter IS NULL OR r.camera_filter = t.camera))"""
FIRED_BEFORE = "t.label = 'dog'"
ALERTS = f"(SELECT * FROM {HITS} WHERE sim >= min_score)"


def fired(d):
    """Events stored earlier: all those on dogs."""
    return alerts.evaluate(d.rules, d.tracks.filter(F.col("label") == "dog"))


@query(
    "j03_standing_rules",
    f"SELECT rule_id, rule_name, track_id, camera, label, round(sim, 4) AS score, ts FROM {ALERTS} WHERE label <> 'dog'",
)
def _(d):
    return alerts.evaluate(d.rules, d.tracks, fired(d)).select("rule_id", "rule_name", "track_id", "camera", "label", "score", "ts")


@query(
    "j04_events_with_rules",
    f"""SELECT a.rule_id, a.track_id, r.query_text, a.ts FROM {ALERTS} a JOIN rules r ON r.id = a.rule_id
    ORDER BY a.ts DESC, 'evt_' || sha256(length(a.rule_id) || '|' || a.rule_id || '|' || a.track_id) LIMIT 50""",
)
def _(d):
    events = alerts.evaluate(d.rules, d.tracks)
    return alerts.recent_events(events, d.rules, limit=50).select("rule_id", "track_id", "query_text", "ts")


@query("r03_rule_lifecycle", f"""SELECT 'rule' AS kind, id AS rule_id, count(*) AS n FROM rules WHERE is_active AND id NOT IN (SELECT id FROM rules WHERE camera_filter = 'cam_2') GROUP BY id
    UNION ALL SELECT 'event', rule_id, count(*) FROM {ALERTS} WHERE rule_id NOT IN (SELECT id FROM rules WHERE camera_filter = 'cam_2') GROUP BY rule_id
    UNION ALL SELECT 'created', rule_name, count(*) FROM rules WHERE camera_filter = 'cam_2' GROUP BY rule_name""")
def _(d):
    """Delete the rules of one camera with their events, make them again as new rules, then list what is there."""
    gone = d.rules.filter(F.col("camera_filter") == "cam_2").select("id")
    rules, events = alerts.delete_rules(d.rules, alerts.evaluate(d.rules, d.tracks), gone)
    new = d.rules.filter(F.col("camera_filter") == "cam_2").select("rule_name", "query_text", "q_emb", "camera_filter", "min_score", "created_at")
    made = alerts.create_rules(rules, new).filter(F.col("id").startswith("rule_")).groupBy("rule_name").agg(F.count_distinct("id").alias("n"))
    left = alerts.active_rules(rules).select(F.lit("rule").alias("kind"), F.col("id").alias("rule_id"), F.lit(1).cast("long").alias("n"))
    counted = events.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    created = made.select(F.lit("created").alias("kind"), F.col("rule_name").alias("rule_id"), "n")
    return left.unionByName(counted.select(F.lit("event").alias("kind"), "rule_id", "n")).unionByName(created)


JUDGED = f"""(SELECT query_id, rank, any_value(label) AS label, any_value(score) AS score, any_value(result_id) AS result_id, bool_or(h) AS hit,
   coalesce(arg_min(CASE WHEN h THEN e END, CASE WHEN h THEN truth_no END), min(e), 999.0::DOUBLE) AS time_error FROM (
   SELECT *, coalesce(f AND gap <= D * 1000000, false) AS h, CASE WHEN f THEN gap / 1000000.0::DOUBLE END AS e FROM (
     SELECT b.*, t.truth_no, t.truth_no IS NOT NULL AND (LABELRULE) AS f,
       greatest(epoch_us(t.t_from) - b.ts_us, b.ts_us - epoch_us(t.t_to), 0) AS gap
     FROM {BATCH} b LEFT JOIN truth t ON t.query_id = b.query_id AND {PLAIN.format('t.camera')} = {PLAIN.format('b.camera')}))
   GROUP BY query_id, rank)"""
SYNONYMS = " OR ".join(
    f"(lower(t.label) = '{k}' AND lower(b.label) IN ({', '.join(map(repr, v))}))" for k, v in V.TRUTH_SYNONYMS.items()
)
LABEL_RULE = f"b.label = 'whole_frame' OR lower(b.label) = lower(t.label) OR {SYNONYMS}"
STRICT = JUDGED.replace("LABELRULE", LABEL_RULE).replace("D * 1000000", "3 * 1000000")
LOOSE = JUDGED.replace("LABELRULE", "true").replace("D * 1000000", "5 * 1000000")


@query("j07_truth_hits", f"SELECT query_id, rank, result_id, hit, round(time_error, 6) AS time_error FROM {STRICT}")
def _(d):
    return evaluation.judge_hits(batch(d), d.truth).select("query_id", "rank", "result_id", "hit", F.round("time_error", 6).alias("time_error"))


@query("j08_hits_without_labels", f"SELECT query_id, rank, hit, round(time_error, 6) AS time_error FROM {LOOSE}")
def _(d):
    return evaluation.judge_hits(batch(d), d.truth, 5.0, with_labels=False).select("query_id", "rank", "hit", F.round("time_error", 6).alias("time_error"))


@query(
    "j09_label_synonyms",
    f"SELECT DISTINCT b.label AS result_label, t.label AS truth_label FROM {BATCH} b JOIN truth t ON t.query_id = b.query_id WHERE {LABEL_RULE}",
)
def _(d):
    truth = d.truth.select("query_id", F.col("label").alias("truth_label"))
    both = batch(d).join(truth, "query_id")
    fits = evaluation.label_matches(F.col("label"), F.col("truth_label"))
    return both.filter(fits).select(F.col("label").alias("result_label"), "truth_label").distinct()


@query("j10_alias_resolution", f"SELECT place, alias, camera FROM {BY_ALIAS}")
def _(d):
    return places.resolve_aliases(places.parse(d.questions), d.aliases).select("place", "alias", "camera")


ITEMS = "(SELECT id AS item_id FROM tracks UNION SELECT id FROM frames UNION SELECT camera FROM tracks UNION SELECT replace(camera, 'cam_', '') FROM tracks UNION SELECT path FROM videos WHERE rotation = 90)"
FIRST_SNAP = "(SELECT camera, arg_min(snapshot, (epoch_us(t_start), id)) AS snapshot FROM tracks GROUP BY camera)"


def items(d):
    cams = d.tracks.select("camera")
    return (
        d.tracks.select(F.col("id").alias("item_id")).union(d.frames.select("id")).union(cams)
        .union(cams.select(F.replace("camera", F.lit("cam_"), F.lit("")))).union(d.videos.filter("rotation = 90").select("path")).distinct()
    )


@query(
    "j11_asset_lookup",
    f"""SELECT i.item_id, coalesce(t.snapshot, f.snapshot, c.snapshot) AS snapshot FROM {ITEMS} i LEFT JOIN tracks t ON t.id = i.item_id
    LEFT JOIN frames f ON f.id = i.item_id LEFT JOIN {FIRST_SNAP} c ON c.camera = i.item_id OR c.camera = 'cam_' || i.item_id""",
)
def _(d):
    return assets.snapshots(items(d), d.tracks, d.frames)


@query(
    "j12_clip_lookup",
    f"""SELECT i.item_id, coalesce(t.video, f.video) AS video, greatest(0.0::DOUBLE, coalesce(t.offset_best, f.offset_s) - 2) AS start_s,
     greatest(1.0::DOUBLE, ((coalesce(t.offset_best, f.offset_s) + 3) - coalesce(t.offset_best, f.offset_s)) + 4) AS length_s
    FROM {ITEMS} i LEFT JOIN tracks t ON t.id = i.item_id LEFT JOIN frames f ON f.id = i.item_id WHERE coalesce(t.video, f.video) IS NOT NULL""",
)
def _(d):
    return assets.clips(items(d), d.tracks, d.frames)


SPOKEN_CANDIDATES = ["cam_landscape", "cam_landscape2", "mobile_cam01", "mobile_cam02", "cam_entrance"]


def _share_sql(a: str, b: str) -> str:
    """200 x longest common subsequence / total length, row by row."""
    inner = (
        f"list_reduce([[j] FOR j IN range(1, length({b}) + 1)], lambda acc, x: list_append(acc, CASE WHEN {a}[y[1]] = {b}[x[1]] THEN prev[x[1]] + 1 "
        f"ELSE greatest(prev[x[1] + 1], acc[x[1]]) END), [CAST(0 AS BIGINT)])"
    )
    rows = f"list_reduce([[i] FOR i IN range(1, length({a}) + 1)], lambda prev, y: {inner}, [CAST(0 AS BIGINT) FOR z IN range(0, length({b}) + 1)])"
    return f"(200.0::DOUBLE * ({rows})[-1] / (length({a}) + length({b})))"


def _spoken_names() -> str:
    rows, at = [], 0
    for camera in SPOKEN_CANDIDATES:
        for name in [camera, *V.SPOKEN_CAMERAS.get(camera, [])]:
            rows.append(f"('{name}', '{camera}', {at})")
            at += 1
    return f"(VALUES {', '.join(rows)}) n(name, camera, ord)"


_PHRASE = "regexp_replace(regexp_extract(text, '(?:near|at|by|through|towards) (.*)$', 1), 'nation|front yard', 'mobile cam')"
_HEARD = r"trim(regexp_replace(regexp_replace(lower(trim(phrase)), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
for _prefix in V.SPOKEN_PREFIXES:
    _HEARD = f"trim(regexp_replace({_HEARD}, '^{_prefix}', ''))"


@query(
    "j13_fuzzy_camera_match",
    f"""WITH p AS MATERIALIZED (SELECT phrase, {_HEARD} AS c FROM (SELECT DISTINCT {_PHRASE} AS phrase FROM questions)),
    pairs AS MATERIALIZED (SELECT *, array_to_string(list_sort(string_split(c, ' ')), ' ') AS sc, array_to_string(list_sort(string_split(name, ' ')), ' ') AS sn,
      CASE WHEN length(c) <= length(name) THEN c ELSE name END AS short, CASE WHEN length(c) <= length(name) THEN name ELSE c END AS long FROM p, {_spoken_names()}),
    sides AS (SELECT * FROM pairs UNION ALL SELECT * REPLACE (long AS short, short AS long) FROM pairs WHERE length(short) = length(long)),
    windows AS MATERIALIZED (SELECT *, unnest(range(1 - length(short), length(long))) AS w FROM sides WHERE short <> ''),
    cut AS MATERIALIZED (SELECT *, substring(long, greatest(0, w) + 1, w + length(short) - greatest(0, w)) AS piece FROM windows),
    partial AS (SELECT phrase, name, max({_share_sql('short', 'piece')}) AS score FROM cut GROUP BY phrase, name),
    scored AS (SELECT a.phrase, a.c, a.name, a.camera, a.ord, a.name = a.c AS exact, {_share_sql('sc', 'sn')} AS sorted_score, coalesce(w.score, 0.0) AS part_score
      FROM pairs a LEFT JOIN partial w ON w.phrase = a.phrase AND w.name = a.name),
    best AS (SELECT phrase, arg_min(camera, ord) FILTER (exact) AS e, arg_min(camera, (-sorted_score, ord)) AS s, max(sorted_score) AS ss,
      arg_min(camera, (-part_score, ord)) AS p, max(part_score) AS ps FROM scored GROUP BY phrase)
    SELECT phrase, CASE WHEN e IS NOT NULL THEN e WHEN ss >= 65 THEN s WHEN ps >= 75 THEN p END AS camera FROM best""",
)
def _(d):
    """Camera meant by every spoken phrase cut from the question log."""
    spoken = F.regexp_replace(F.regexp_extract("text", r"(?:near|at|by|through|towards) (.*)$", 1), "nation|front yard", "mobile cam")
    return providers.match_spoken_cameras(d.questions.select(spoken.alias("phrase")), SPOKEN_CANDIDATES)


@query("j14_place_status", f"SELECT query_id, place, status, camera FROM {RESOLVED}")
def _(d):
    cams = places.known_cameras(d.videos, d.tracks)
    return places.resolve(places.parse(d.questions), cams, d.aliases).select("query_id", "place", "status", "camera")


# --- Aliases, clarify, providers ----------------------------------------------

NEW_ALIASES = "(SELECT ' The ' || upper(replace(n_name, '_', ' ')) || '!' AS name, 'cam_' || n_regionkey AS camera FROM nation UNION ALL SELECT ' Front  Yard ', 'cam_4')"


def new_aliases(d):
    kind = "array<struct<x:double,y:double>>"
    rows = d.table("nation").select(
        F.concat(F.lit(" The "), F.upper(F.replace("n_name", F.lit("_"), F.lit(" "))), F.lit("!")).alias("name"),
        F.concat(F.lit("cam_"), "n_regionkey").alias("camera"), F.lit(None).cast(kind).alias("polygon"),
    )
    yard = d.table("region").agg(F.lit(" Front  Yard ").alias("name"), F.lit("cam_4").alias("camera"), F.lit(None).cast(kind).alias("polygon"))
    return rows.unionByName(yard)


@query(
    "r01_alias_save_and_delete",
    f"""SELECT coalesce(n.name, a.name) AS name, coalesce(n.camera, a.camera) AS camera FROM aliases a
    FULL JOIN (SELECT {ALIAS_NAME.format('name')} AS name, camera FROM {NEW_ALIASES}) n ON n.name = a.name WHERE coalesce(n.name, a.name) <> 'nation 3'""",
)
def _(d):
    now = F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")
    saved = places.save_aliases(d.aliases, new_aliases(d), now)
    gone = d.table("nation").filter(F.col("n_nationkey") == 3).select(F.replace("n_name", F.lit("_"), F.lit(" ")).alias("name"))
    return places.delete_aliases(saved, gone).select("name", "camera")


@query(
    "r02_clarify_once",
    f"""SELECT query_id, place AS referent, (SELECT string_agg(camera, ',' ORDER BY camera) FROM {CAMERAS}) AS options,
    CASE WHEN place = 'the front yard' OR place = 'front yard' THEN 'cam_4' END AS camera_after FROM {RESOLVED} WHERE status = 'UNRESOLVED'""",
)
def _(d):
    """Questions with an unknown place ask back; once the alias is saved the same questions resolve."""
    cams = places.known_cameras(d.videos, d.tracks)
    parsed = cut_lineage(places.parse(d.questions))  # read twice
    asked = cut_lineage(places.clarify(places.resolve(parsed, cams, d.aliases), cams))
    yard = new_aliases(d).filter(F.col("camera") == "cam_4").filter(F.col("name").contains("Yard"))
    known = places.save_aliases(d.aliases, yard, F.lit("2024-01-03 00:00:00").cast("timestamp_ntz"))
    pending = parsed.join(asked.select("query_id"), "query_id", "left_semi")
    after = places.resolve(pending, cams, known).select("query_id", F.col("camera").alias("camera_after"))
    return asked.join(after, "query_id").select("query_id", "referent", F.array_join("options", ",").alias("options"), "camera_after")


@query("r04_embedding_provider", "SELECT query_id, 1.0::DOUBLE AS length FROM questions")
def _(d):
    """Prompts of all questions embedded by the injected provider."""
    prompts = places.parse(d.questions).select("query_id", "prompt")
    made = providers.embed(prompts, "prompt", providers.hashed_tokens(64))
    return made.select("query_id", F.round(vectors.norm(F.col("emb")), 6).alias("length"))


_RESPONSE = """CASE p_partkey % 5 WHEN 0 THEN 'YES | 0.' || (10 + p_size) || ' | ' || p_name WHEN 1 THEN 'no|0.4' WHEN 2 THEN 'Yes' WHEN 3 THEN 'NO' ELSE ' yes | high | ' || p_name END"""


@query(
    "r05_judgement_parse",
    f"""SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN false ELSE contains(lower(string_split(trim(r), '|')[1]), 'yes') END AS is_match,
     CASE WHEN len(string_split(trim(r), '|')) < 2 THEN CASE WHEN contains(lower(r), 'yes') THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END
       ELSE coalesce(TRY_CAST(trim(string_split(trim(r), '|')[2]) AS DOUBLE), 0.0) END AS conf,
     coalesce(trim(string_split(trim(r), '|')[3]), trim(r)) AS reason FROM (SELECT p_partkey, {_RESPONSE} AS r FROM part)""",
)
def _(d):
    k = F.col("p_partkey") % 5
    r = (
        F.when(k == 0, F.concat(F.lit("YES | 0."), 10 + F.col("p_size"), F.lit(" | "), "p_name")).when(k == 1, "no|0.4").when(k == 2, "Yes")
        .when(k == 3, "NO").otherwise(F.concat(F.lit(" yes | high | "), "p_name"))
    )
    return d.table("part").withColumn("j", text.judgement(r)).select("p_partkey", "j.is_match", "j.conf", "j.reason")


class BoxesFromBytes:
    """A detector for tests: two boxes per frame whose size follows the payload length."""

    def detect(self, frame):
        n = float(len(frame))
        return [
            {"bbox": [0, 0, n, n], "conf": 0.9, "label": "car", "source": "a"},
            {"bbox": [n, n, 2 * n, 3 * n], "conf": 0.4, "label": "person", "source": "b"},
        ]


@query(
    "r06_detector_hook",
    """SELECT camera, video, CAST(floor(offset_s) AS BIGINT) AS frame_idx, t_abs AS ts, k * n AS x1, k * n AS y1, n + k * n AS x2, n + 2 * k * n AS y2,
      CASE k WHEN 0 THEN 0.9::DOUBLE ELSE 0.4::DOUBLE END AS conf, CASE k WHEN 0 THEN 'car' ELSE 'person' END AS label, CASE k WHEN 0 THEN 'a' ELSE 'b' END AS source
    FROM (SELECT *, CAST(length(snapshot) AS DOUBLE) AS n FROM frames), (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) t(k)""",
)
def _(d):
    frames = d.frames.select("camera", "video", F.col("offset_s").cast("long").alias("frame_idx"), F.col("t_abs").alias("ts"), F.col("snapshot").alias("image"))
    return providers.detect(frames, BoxesFromBytes())


# --- Evaluation ----------------------------------------------------------------

FIRST = f"""(SELECT query_id, coalesce(min(CASE WHEN hit THEN rank END), 0) AS hit_rank, arg_min(CASE WHEN hit THEN time_error END, CASE WHEN hit THEN rank END) AS time_error FROM {STRICT} GROUP BY query_id)"""
SPLITS = "(SELECT query_id, CASE WHEN contains(text, 'nation') THEN 'dev2' ELSE 'dev' END AS split, 'no_tracking' AS mode FROM search_questions)"


def splits(d):
    split = F.when(F.contains("text", F.lit("nation")), "dev2").otherwise("dev")
    return d.search_questions.select("query_id", split.alias("split"), F.lit("no_tracking").alias("mode"))


@query("d08_first_hit_rank", f"SELECT query_id, hit_rank, round(time_error, 6) AS time_error FROM {FIRST}")
def _(d):
    return evaluation.first_hits(evaluation.judge_hits(batch(d), d.truth)).select("query_id", F.col("hit_rank").cast("long").alias("hit_rank"), F.round("time_error", 6).alias("time_error"))


@query(
    "a11_retrieval_metrics",
    f"""SELECT mode, split, count(*) AS num_queries, round(avg(CASE WHEN hit_rank BETWEEN 1 AND 5 THEN 1.0::DOUBLE / hit_rank ELSE 0.0 END), 4) AS mrr,
     round(avg(CASE WHEN hit_rank = 1 THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS recall_1, round(avg(CASE WHEN hit_rank BETWEEN 1 AND 5 THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS recall_5,
     round(coalesce(avg(CASE WHEN hit_rank BETWEEN 1 AND 5 THEN time_error END), 0.0), 2) AS mean_time_error_s
    FROM {SPLITS} s LEFT JOIN {FIRST} f USING (query_id) GROUP BY ROLLUP (mode, split)""",
)
def _(d):
    return evaluation.retrieval_metrics(splits(d), evaluation.first_hits(evaluation.judge_hits(batch(d), d.truth)))


_FULL = greedy_sql(
    f"SELECT q.query_id, r.result_id, r.result_type, r.camera, r.ts_us, r.label, round({dot('q.q_emb', 'r.emb')}, 4) AS score FROM search_questions q, {TC} r",
    "query_id", "score DESC, result_type DESC, result_id", "k.camera = o.camera AND abs(k.ts_us - o.ts_us) <= 3000000",
    "{'result_id': o.result_id, 'camera': o.camera, 'ts_us': o.ts_us, 'label': o.label, 'score': o.score}", K,
)
_FRAMES = f"""(SELECT * FROM (SELECT q.query_id, f.id AS result_id, f.camera, epoch_us(f.t_abs) AS ts_us, 'whole_frame' AS label, round({dot('q.q_emb', 'f.emb')}, 4) AS score,
  row_number() OVER (PARTITION BY q.query_id ORDER BY round({dot('q.q_emb', 'f.emb')}, 4) DESC, f.id) AS rank FROM search_questions q, frames f) WHERE rank <= {K})"""


@query(
    "a11_retrieval_modes",
    f"""{_FULL}, res AS MATERIALIZED (SELECT query_id, rank, r.result_id AS result_id, r.camera AS camera, r.ts_us AS ts_us, r.label AS label, r.score AS score
      FROM (SELECT query_id, unnest(range(1, len(kept) + 1)) AS rank, unnest(kept) AS r FROM kept)),
    hits AS (SELECT 'full' AS mode, * FROM {FIRST.replace(BATCH, 'res')} UNION ALL SELECT 'whole_frame', * FROM {FIRST.replace(BATCH, _FRAMES)} UNION ALL SELECT 'no_tracking', * FROM {FIRST}),
    s AS (SELECT query_id, split, m.mode FROM {SPLITS}, (VALUES ('full'), ('whole_frame'), ('no_tracking')) m(mode))
    SELECT s.mode, s.split, count(*) AS num_queries, round(avg(CASE WHEN hit_rank BETWEEN 1 AND 5 THEN 1.0::DOUBLE / hit_rank ELSE 0.0 END), 4) AS mrr,
     round(avg(CASE WHEN hit_rank = 1 THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS recall_1, round(avg(CASE WHEN hit_rank BETWEEN 1 AND 5 THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS recall_5,
     round(coalesce(avg(CASE WHEN hit_rank BETWEEN 1 AND 5 THEN time_error END), 0.0), 2) AS mean_time_error_s
    FROM s LEFT JOIN hits f ON f.query_id = s.query_id AND f.mode = s.mode GROUP BY ROLLUP (s.mode, s.split)""",
)
def _(d):
    """The same corpus with de-duplication, on whole frames only, and without de-duplication."""
    q = d.search_questions.select("query_id", "q_emb")
    plain = d.tracks.withColumn("colors", F.lit("{}"))
    runs = {
        "full": search.top_k(q, plain, d.frames, k=K, dedup_s=3.0, gated=False),
        "whole_frame": search.frame_baseline(q, d.frames, K),
        "no_tracking": batch(d),
    }
    hits = None
    for mode, results in runs.items():
        part = evaluation.first_hits(evaluation.judge_hits(results, d.truth)).withColumn("mode", F.lit(mode))
        hits = part if hits is None else hits.unionByName(part)
    modes = splits(d).withColumn("mode", F.explode(F.array(*[F.lit(m) for m in runs])))
    return evaluation.retrieval_metrics(modes, hits)


@query(
    "a12_latency_stats",
    """SELECT event_type AS stage, round(quantile_cont(value, 0.5), 2) AS median, round(quantile_cont(value, 0.95), 2) AS p95, min(value) AS best, max(value) AS worst
    FROM events GROUP BY event_type""",
)
def _(d):
    return evaluation.latency_stats(d.table("events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms")))


CLASS_SCORES = f"""(SELECT c.name, t.id, round({dot('t.emb', 'c.vec')}, 4) AS score, CASE WHEN 'c' || t.cls = c.name THEN 1 ELSE 0 END AS pos FROM tracks t, {CLASSES_SQL} c)"""


def class_scores(d):
    """Score of every track for every class prompt; the few prompts go out as a block of queries."""
    prompts = class_vectors(d).select(F.col("name").alias("query_id"), F.col("vec").alias("q_emb"))
    rows = d.tracks.select(F.col("id").alias("result_id"), "camera", "cls", "emb")
    scored = scoring.score(rows, prompts, ["result_id", "cls"], minimum=-2.0)
    return scored.select(F.col("query_id").alias("name"), F.col("result_id").alias("id"), "score",
                         (F.concat(F.lit("c"), "cls") == F.col("query_id")).cast("int").alias("pos"))


@query(
    "a13_roc_auc",
    f"""WITH r AS (SELECT *, rank() OVER (PARTITION BY name ORDER BY score) + (count(*) OVER (PARTITION BY name, score) - 1) / 2.0::DOUBLE AS rk FROM {CLASS_SCORES})
    SELECT name, round(CASE WHEN sum(pos) = 0 OR sum(1 - pos) = 0 THEN 0.5 ELSE (sum(CASE WHEN pos = 1 THEN rk ELSE 0 END) - sum(pos) * (sum(pos) + 1) / 2.0::DOUBLE) / (sum(pos) * sum(1 - pos)) END, 9) AS auc
    FROM r GROUP BY name""",
)
def _(d):
    auc = evaluation.roc_auc(class_scores(d), "name", "score", "pos")
    return auc.select("name", F.round("auc", 9).alias("auc"))


@query(
    "a14_precision_recall",
    f"""SELECT name, round(sum(CASE WHEN rn <= 20 THEN pos ELSE 0 END) / 20.0::DOUBLE, 9) AS precision, round(CASE WHEN sum(pos) > 0 THEN sum(CASE WHEN rn <= 20 THEN pos ELSE 0 END)::DOUBLE / sum(pos) ELSE 0.0 END, 9) AS recall
    FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, id) AS rn FROM {CLASS_SCORES}) GROUP BY name""",
)
def _(d):
    pr = evaluation.precision_recall_at(class_scores(d), "name", "score", "pos", "id", 20)
    return pr.select("name", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query(
    "a15_target_rank",
    f"""WITH r AS (SELECT t.id, c.name, t.cls, row_number() OVER (PARTITION BY t.id ORDER BY {dot('t.emb', 'c.vec')} DESC, c.name) AS rn FROM tracks t, {CLASSES_SQL} c)
    SELECT count(*) AS total, CAST(sum(CASE WHEN rn = 1 THEN 1 ELSE 0 END) AS BIGINT) AS correct, round(avg(CASE WHEN rn = 1 THEN 1.0::DOUBLE ELSE 0.0 END) * 100, 2) AS accuracy_pct FROM r WHERE name = 'c' || cls""",
)
def _(d):
    crops = d.tracks.select("id", "emb", F.concat(F.lit("c"), "cls").alias("target"))
    return evaluation.top1_accuracy(evaluation.class_ranks(crops, class_vectors(d), "target"))


_WORDS_OF = r"CASE WHEN trim(regexp_replace(regexp_replace(lower({0}), '[.,]', '', 'g'), '\s+', ' ', 'g')) = '' THEN [] ELSE string_split(trim(regexp_replace(regexp_replace(lower({0}), '[.,]', '', 'g'), '\s+', ' ', 'g')), ' ') END"


@query(
    "a22_word_error_rate",
    f"""WITH RECURSIVE p AS MATERIALIZED (SELECT c.conv_id, c.turn, {_WORDS_OF.format('b.text')} AS r, {_WORDS_OF.format('c.text')} AS h
      FROM conversations c JOIN conversations b ON b.conv_id = c.conv_id AND b.turn + 1 = c.turn),
    steps AS (SELECT conv_id, turn, CAST(0 AS BIGINT) AS i, range(0, len(h) + 1) AS row FROM p
      UNION ALL SELECT s.conv_id, s.turn, s.i + 1, list_reduce([[j] FOR j IN range(1, len(p.h) + 1)], lambda acc, x: list_append(acc,
        least(s.row[x[1] + 1] + 1, acc[x[1]] + 1, s.row[x[1]] + CASE WHEN p.r[s.i + 1] = p.h[x[1]] THEN 0 ELSE 1 END)), [s.i + 1])
      FROM steps s JOIN p ON p.conv_id = s.conv_id AND p.turn = s.turn WHERE s.i < len(p.r))
    SELECT p.conv_id, p.turn, round(CASE WHEN len(p.r) = 0 THEN CASE WHEN len(p.h) = 0 THEN 0.0 ELSE 1.0 END ELSE s.row[len(p.h) + 1]::DOUBLE / len(p.r) END, 9) AS wer
    FROM steps s JOIN p ON p.conv_id = s.conv_id AND p.turn = s.turn AND s.i = len(p.r)""",
)
def _(d):
    """Every turn of every conversation against the turn before it."""
    c = d.table("conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    pairs = c.select("conv_id", "turn", F.col("text").alias("hypothesis")).join(before, ["conv_id", "turn"])
    return evaluation.word_errors(pairs).select("conv_id", "turn", F.round("wer", 9).alias("wer"))


@query(
    "d09_recent_questions",
    """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5""",
)
def _(d):
    return places.recent_questions(d.table("events"), "user_id", ["ts", "event_id"], 5).select("user_id", "event_id", "event_type")


@query(
    "d10_suboptimal_report",
    f"""SELECT s.query_id, coalesce(f.hit_rank, 0) AS hit_rank, c.candidates FROM {SPLITS} s LEFT JOIN {FIRST} f USING (query_id)
    LEFT JOIN (SELECT query_id, string_agg(rank || ':' || result_id || ':' || hit, ' ' ORDER BY rank) AS candidates FROM {STRICT} GROUP BY query_id) c USING (query_id)
    WHERE coalesce(f.hit_rank, 0) <> 1""",
)
def _(d):
    report = evaluation.suboptimal(splits(d), evaluation.judge_hits(batch(d), d.truth))
    shown = F.array_join(F.transform("candidates", lambda c: F.concat_ws(":", c["rank"], c["result_id"], c["hit"])), " ")
    return report.select("query_id", F.col("hit_rank").cast("long").alias("hit_rank"), shown.alias("candidates"))


@query("d11_first_snapshot", f"SELECT camera, snapshot FROM {FIRST_SNAP}")
def _(d):
    return assets.first_snapshots(d.tracks)


# --- Answers and export ----------------------------------------------------------

_SAY = "trim(replace(replace(lower({0}), 'cam_', 'cam '), '_', ' '))"
_CLOCK = "CASE WHEN minute({0}) = 0 THEN strftime({0}, '%-I %p') ELSE strftime({0}, '%-I:%M %p') END"


@query(
    "u11_answer_sentence",
    search_sql(select=f""", top AS (SELECT query_id, count(*) AS n, arg_min(r, rank) AS t FROM found GROUP BY query_id),
    opts AS (SELECT list(camera ORDER BY camera) AS o FROM {CAMERAS})
    SELECT s.query_id, CASE WHEN s.status = 'UNRESOLVED' THEN 'Did you mean ' || {_SAY.format('o[1]')} || ' or ' || {_SAY.format('o[2]')} || '?'
      WHEN coalesce(n, 0) = 0 THEN 'No objects found matching ' || s.prompt || '.'
      ELSE CASE WHEN n = 1 THEN 'Found ' ELSE 'Found ' || n || ' matches, most recent was ' END ||
        CASE WHEN t.color IS NULL OR t.color IN ('unknown', 'none') THEN CASE WHEN t.label[1] IN ('a','e','i','o','u') THEN 'an ' ELSE 'a ' END || t.label
          ELSE CASE WHEN t.color[1] IN ('a','e','i','o','u') THEN 'an ' ELSE 'a ' END || t.color || ' ' || t.label END
        || ' on ' || {_SAY.format('t.camera')} || ' at ' || {_CLOCK.format('make_timestamp(t.ts_us)')} || '.' END AS answer
    FROM (SELECT r.* FROM {RESOLVED} r JOIN search_questions USING (query_id)) s LEFT JOIN top USING (query_id), opts"""),
)
def _(d):
    results, clarify = searched(d)
    prompts = places.parse(d.search_questions).select("query_id", "prompt")
    return ask_plan.answers(prompts, results, clarify)


@query(
    "s14_result_documents",
    f"""SELECT b.query_id, 'success' AS status, any_value(q.text) AS query, arg_min(result_id, rank) AS first_id, max(rank) AS n_results,
      round(arg_max(b.score, rank), 4) AS last_score FROM {BATCH} b JOIN search_questions q ON q.query_id = b.query_id GROUP BY b.query_id""",
)
def _(d):
    """One JSON document per question, read back field by field."""
    from camtrail.sources import export

    docs = export.documents(batch(d), d.search_questions.select("query_id", "text"))
    read = F.from_json("document", "status string, query string, results array<struct<rank:bigint,result_id:string,score:double>>")
    r = docs.withColumn("r", read)
    last = F.try_element_at("r.results", F.lit(-1))
    return r.select("query_id", "r.status", "r.query", F.try_element_at("r.results", F.lit(1))["result_id"].alias("first_id"),
                    last["rank"].alias("n_results"), F.round(last["score"], 4).alias("last_score"))
