"""Filters, vector expressions, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from camtrail.functions import boxes, text, vectors, vocabulary as V
from camtrail.operators import evaluation, places, scoring, search, tracks
from camtrail.plans.ask import reference_now
from camtrail.scale import broadcast_if_small
from camtrail.sources import video_files
from checks.registry import query
from checks.views import POLYGONS

DOT = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
US = "epoch_us({})"


def dot(a: str, b: str) -> str:
    return DOT.format(a=a, b=b)


def norm(a: str) -> str:
    return f"sqrt({dot(a, a)})"


def polygon_test(x: str, y: str, poly: str) -> str:
    """Even-odd rule for an expression ``poly`` holding a list of corners."""
    p, q = f"{poly}[i]", f"{poly}[i % len({poly}) + 1]"
    cross = (
        f"CASE WHEN {y} > least({p}.y, {q}.y) AND {y} <= greatest({p}.y, {q}.y) AND {x} <= greatest({p}.x, {q}.x) "
        f"AND ({p}.x = {q}.x OR {x} <= ({y} - {p}.y) * ({q}.x - {p}.x) / nullif({q}.y - {p}.y, 0) + {p}.x) THEN 1 ELSE 0 END"
    )
    return (
        f"CASE WHEN {poly} IS NULL OR len({poly}) < 3 THEN true "
        f"ELSE list_sum([{cross} FOR i IN range(1, len({poly}) + 1)]) % 2 = 1 END"
    )


# --- Filters ---------------------------------------------------------------

@query("f01_camera_filter", "SELECT id, camera, label FROM tracks WHERE lower(camera) IN ('cam_3', '3')")
def _(d):
    return d.tracks.filter(search.camera_is("camera", "CAM_3")).select("id", "camera", "label")


FROM_TO = ("2024-01-01 06:00:00", "2024-01-01 12:30:00")


@query(
    "f02_track_time_overlap",
    f"SELECT id, t_start, t_end FROM tracks WHERE t_start <= TIMESTAMP '{FROM_TO[1]}' AND t_end >= TIMESTAMP '{FROM_TO[0]}'",
)
def _(d):
    a, b = (F.lit(x).cast("timestamp_ntz") for x in FROM_TO)
    return d.tracks.filter(search.overlaps(F.col("t_start"), F.col("t_end"), a, b)).select("id", "t_start", "t_end")


@query(
    "f03_frame_time_containment",
    f"SELECT id, camera, t_abs FROM frames WHERE t_abs BETWEEN TIMESTAMP '{FROM_TO[0]}' AND TIMESTAMP '{FROM_TO[1]}'",
)
def _(d):
    a, b = (F.lit(x).cast("timestamp_ntz") for x in FROM_TO)
    return d.frames.filter(search.contains(F.col("t_abs"), a, b)).select("id", "camera", "t_abs")


@query("f04_target_label_filter", "SELECT id, label FROM tracks WHERE lower(label) IN ('car', 'truck', 'object')")
def _(d):
    targets = F.array(F.lit("car"), F.lit("truck"))
    return d.tracks.filter(search.label_allowed(F.col("label"), targets)).select("id", "label")


def _centres(d):
    return d.tracks.select("id", "camera", ((F.col("bx1") + F.col("bx2")) / 2.0).alias("cx"),
                           ((F.col("by1") + F.col("by2")) / 2.0).alias("cy"))


@query(
    "f05_polygon_filter",
    f"""SELECT a.name, t.id FROM (SELECT id, camera, (bx1 + bx2) / 2.0 AS cx, (by1 + by2) / 2.0 AS cy FROM tracks) t
    JOIN aliases a ON a.camera = t.camera WHERE {polygon_test('t.cx', 't.cy', 'a.polygon')}""",
)
def _(d):
    """Regions of all aliases of a camera at once."""
    named = broadcast_if_small(d.aliases.select("name", "camera", "polygon"))
    inside = boxes.in_polygon(F.col("cx"), F.col("cy"), F.col("polygon"))
    return _centres(d).join(named, "camera").filter(inside).select("name", "id")


@query(
    "f05_fixed_polygon_filter",
    f"""WITH p AS (SELECT polygon FROM aliases WHERE name = 'nation 4')
    SELECT t.id FROM (SELECT id, (bx1 + bx2) / 2.0 AS cx, (by1 + by2) / 2.0 AS cy FROM tracks) t, p
    WHERE {polygon_test('t.cx', 't.cy', 'p.polygon')}""",
)
def _(d):
    return _centres(d).filter(boxes.in_fixed_polygon(F.col("cx"), F.col("cy"), POLYGONS[4])).select("id")


BOOST = f"""CASE WHEN len(list_intersect(string_split_regex(lower(q.text), '\\s+'),
 ['red','blue','green','yellow','black','white','silver','grey','orange','brown','purple','pink'])) = 0 THEN 0.0::DOUBLE
 WHEN list_has_any(list_intersect(string_split_regex(lower(q.text), '\\s+'),
 ['red','blue','green','yellow','black','white','silver','grey','orange','brown','purple','pink']), t.cols) THEN 0.03::DOUBLE
 WHEN len(t.cols) > 0 THEN -0.02::DOUBLE ELSE 0.0::DOUBLE END"""
ROW_COLOURS = """CASE user_no WHEN 1 THEN ['red','blue'] WHEN 2 THEN ['black'] WHEN 3 THEN ['green'] ELSE [] END"""
TRACKS_COLS = """(SELECT *, CASE colors WHEN '{}' THEN CAST([] AS VARCHAR[])
 ELSE list_filter([lower(c) FOR c IN regexp_extract_all(colors, '"color":"([^"]+)"', 1)], lambda c: c <> 'unknown') END AS cols FROM tracks)"""


@query(
    "f06_similarity_threshold",
    f"""SELECT q.query_id, t.id, round({dot('q.q_emb', 't.emb')} + {BOOST}, 4) AS score
    FROM search_questions q, {TRACKS_COLS} t WHERE {dot('q.q_emb', 't.emb')} + {BOOST} >= 0.2""",
)
def _(d):
    """Every question against every track: threshold on the unrounded boosted score."""
    q = d.search_questions.select("query_id", "q_emb", text.query_colours(F.col("text")).alias("colours"))
    found = scoring.score(search.track_rows(d.tracks), q, ["result_id"], minimum=0.2)
    return found.select("query_id", F.col("result_id").alias("id"), "score")


@query(
    "f08_box_clamp",
    """WITH b AS (SELECT rid, l.x1 * 100 - 10 AS x1, l.y1 * 100 - 5 AS y1, l.x2 * 100 AS x2, l.y2 * 100 AS y2 FROM detections l),
    c AS (SELECT rid, greatest(0.0::DOUBLE, x1) AS x1, greatest(0.0::DOUBLE, y1) AS y1, least(80.0::DOUBLE, x2) AS x2, least(45.0::DOUBLE, y2) AS y2 FROM b)
    SELECT rid, round(x1 / 80.0, 4) AS x1, round(y1 / 45.0, 4) AS y1, round(x2 / 80.0, 4) AS x2, round(y2 / 45.0, 4) AS y2
    FROM c WHERE x2 > x1 AND y2 > y1""",
)
def _(d):
    w, h = F.lit(80.0), F.lit(45.0)
    raw = d.detections
    cut = boxes.clamp(F.col("x1") * 100 - 10, F.col("y1") * 100 - 5, F.col("x2") * 100, F.col("y2") * 100, w, h)
    rows = raw.select("rid", *[c.alias(n) for n, c in cut.items()])
    box = {c: F.col(c) for c in ("x1", "y1", "x2", "y2")}
    return rows.filter(boxes.has_area(box)).select("rid", *[c.alias(n) for n, c in boxes.normalise(box, w, h).items()])


@query(
    "f09_min_box_size",
    "SELECT rid, label FROM detections WHERE x2 * 100 - x1 * 100 >= 35 AND y2 * 100 - y1 * 100 >= 35",
)
def _(d):
    box = {c: F.col(c) * 100 for c in ("x1", "y1", "x2", "y2")}
    return d.detections.filter(boxes.at_least(box, 35)).select("rid", "label")


@query(
    "f10_display_label",
    "SELECT rid, CASE WHEN conf >= 0.35 THEN label ELSE 'object' END AS shown FROM observations",
)
def _(d):
    return d.observations.select("rid", tracks.display_label(F.col("label"), F.col("conf")).alias("shown"))


@query("f11_stride_sampling", "SELECT rid, frame_idx FROM observations WHERE frame_idx % 2 = 0")
def _(d):
    """The stride is the operator itself: every second frame is detected on."""
    return tracks.every_nth(d.observations).select("rid", "frame_idx")


@query("f12_restrict_to_videos", "SELECT id, video FROM tracks WHERE video IN (SELECT path FROM videos WHERE camera = 'cam_1')")
def _(d):
    chosen = d.videos.filter(F.col("camera") == "cam_1").select(F.col("path").alias("video"))
    return evaluation.restrict(d.tracks, chosen).select("id", "video")


@query(
    "f14_vocabulary_split",
    """SELECT DISTINCT p_name AS label FROM part
    WHERE lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_type = 'ECONOMY')""",
)
def _(d):
    part = d.table("part")
    base = part.filter(F.col("p_type") == "ECONOMY").select(F.col("p_name").alias("label"))
    return tracks.new_words(part.select(F.col("p_name").alias("label")), base)


@query(
    "f15_clip_window",
    """SELECT id, greatest(0.0::DOUBLE, offset_best - 2) AS start_s,
    greatest(1.0::DOUBLE, ((offset_best + 3) - offset_best) + 4) AS length_s FROM tracks""",
)
def _(d):
    from camtrail.operators.assets import clip_window

    start, length = clip_window(F.col("offset_best"), F.col("offset_best") + 3)
    return d.tracks.select("id", start.alias("start_s"), length.alias("length_s"))


@query(
    "f16_crop_quality",
    """SELECT rid, round(conf * sqrt(greatest(1.0::DOUBLE, (x2 - x1) * 100) * greatest(1.0::DOUBLE, (y2 - y1) * 100) / greatest(1.0::DOUBLE, 1920.0 * 1080.0))
    * least(greatest(quality / 120.0, 0.05::DOUBLE), 5.0::DOUBLE), 9) AS q FROM observations""",
)
def _(d):
    q = boxes.crop_quality(F.col("conf"), (F.col("x2") - F.col("x1")) * 100, (F.col("y2") - F.col("y1")) * 100,
                           F.lit(1920.0), F.lit(1080.0), F.col("quality"))
    return d.observations.select("rid", F.round(q, 9).alias("q"))


# --- Vectors ---------------------------------------------------------------

@query(
    "v01_dot_score",
    f"SELECT a.id, round({dot('a.emb', 'b.emb')}, 9) AS score FROM tracks a, tracks b WHERE b.id = 't0'",
)
def _(d):
    """Every track against the vector of one."""
    probe = d.tracks.filter(F.col("id") == "t0").select("emb").first().emb
    q = F.array(*[F.lit(float(x)) for x in probe])
    return d.tracks.select("id", F.round(vectors.dot(q, F.col("emb")), 9).alias("score"))


@query(
    "v02_cosine",
    f"""SELECT t.id, f.id AS frame_id, round({dot('t.emb', 'f.emb')} / ({norm('t.emb')} * {norm('f.emb')}), 9) AS sim
    FROM tracks t JOIN frames f ON f.video = t.video""",
)
def _(d):
    f = d.frames.select(F.col("id").alias("frame_id"), "video", F.col("emb").alias("f_emb"))
    return d.tracks.join(f, "video").select("id", "frame_id", F.round(vectors.cosine(F.col("emb"), F.col("f_emb")), 9).alias("sim"))


@query(
    "v03_l2_normalise",
    f"SELECT id, round(sqrt(list_sum([x * x FOR x IN u])), 9) AS length, round(u[1], 9) AS u_first, round(u[64], 9) AS u_last "
    f"FROM (SELECT id, [x::DOUBLE * 3 / sqrt(list_sum([y::DOUBLE * 3 * y::DOUBLE * 3 FOR y IN emb])) FOR x IN emb] AS u FROM tracks)",
)
def _(d):
    u = vectors.unit(F.transform("emb", lambda x: x.cast("double") * 3))
    rows = d.tracks.select("id", u.alias("u"))
    return rows.select("id", F.round(vectors.norm(F.col("u")), 9).alias("length"), F.round(F.col("u")[0], 9).alias("u_first"),
                       F.round(F.col("u")[63], 9).alias("u_last"))


@query(
    "v04_vector_mean",
    f"""WITH m AS (SELECT cls, [{', '.join(f'avg(emb[{i}]::DOUBLE)' for i in range(1, 65))}] AS m, count(*) AS n FROM tracks GROUP BY cls)
    SELECT cls, n, round(m[1] / sqrt(list_sum([y * y FOR y IN m])), 8) AS u_first, round(m[64] / sqrt(list_sum([y * y FOR y IN m])), 8) AS u_last FROM m""",
)
def _(d):
    rows = d.tracks.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), vectors.mean_vector("emb", 64).alias("u"))
    return rows.select("cls", "n", F.round(F.col("u")[0], 8).alias("u_first"), F.round(F.col("u")[63], 8).alias("u_last"))


@query(
    "v06_colour_boost",
    f"SELECT q.query_id, t.id, {BOOST} AS boost FROM search_questions q JOIN {TRACKS_COLS} t ON t.track_id = q.query_id",
)
def _(d):
    rows = d.search_questions.join(d.tracks.select(F.col("track_id").alias("query_id"), "id", "colors"), "query_id")
    boost = text.colour_boost(text.query_colours(F.col("text")), text.row_colours(F.col("colors")))
    return rows.select("query_id", "id", boost.alias("boost"))


@query(
    "v07_row_colours",
    f"SELECT id, array_to_string(cols, ',') AS known, coalesce(cols[1], 'unknown') AS shown FROM {TRACKS_COLS}",
)
def _(d):
    cols = text.row_colours(F.col("colors"))
    return d.tracks.select("id", F.array_join(cols, ",").alias("known"),
                           F.coalesce(F.try_element_at(cols, F.lit(1)), F.lit("unknown")).alias("shown"))


CLASSES_SQL = f"""(SELECT 'c' || cls AS name, [{', '.join(f'round(avg(emb[{i}]::DOUBLE), 6)' for i in range(1, 65))}] AS vec
  FROM tracks GROUP BY cls)"""


def class_vectors(d):
    """One prompt vector per class: the mean of its members."""
    mean = F.array(*[F.round(F.avg(F.col("emb")[i].cast("double")), 6) for i in range(64)])
    return d.tracks.groupBy("cls").agg(mean.alias("vec")).select(F.concat(F.lit("c"), "cls").alias("name"), "vec")


@query(
    "v10_zero_shot_label",
    f"""SELECT id, name AS best, round(score, 6) AS score FROM (
      SELECT t.id, c.name, {dot('t.emb', 'c.vec')} AS score, row_number() OVER (PARTITION BY t.id ORDER BY {dot('t.emb', 'c.vec')} DESC, c.name) AS rn
      FROM tracks t, {CLASSES_SQL} c) WHERE rn = 1""",
)
def _(d):
    best = evaluation.zero_shot(d.tracks, class_vectors(d))
    return best.select("id", "best", F.round("best_score", 6).alias("score"))


@query(
    "v12_label_boost",
    """SELECT q.query_id, t.id, CASE WHEN contains(lower(t.label), w) OR contains(w, lower(t.label)) THEN 0.025::DOUBLE ELSE 0.0::DOUBLE END AS boost
    FROM (SELECT query_id, regexp_extract(lower(text), '(car|person|truck|thing|dogs)', 1) AS w FROM questions) q
    JOIN tracks t ON t.track_id = q.query_id""",
)
def _(d):
    word = F.regexp_extract(F.lower("text"), "(car|person|truck|thing|dogs)", 1)
    q = d.questions.select("query_id", word.alias("w"))
    rows = q.join(d.tracks.select(F.col("track_id").alias("query_id"), "id", "label"), "query_id")
    return rows.select("query_id", "id", text.label_boost(F.col("w"), F.col("label")).alias("boost"))


# --- Text ------------------------------------------------------------------

def _hit(pattern: str, source: str = "low") -> str:
    return f"regexp_matches({source}, '{pattern}')"


def _num(pattern: str, group: int) -> str:
    return f"TRY_CAST(regexp_extract(low, '{pattern}', {group}) AS INTEGER)"


P12, P24 = V.BETWEEN_12H, V.BETWEEN_24H
_H1 = f"""CASE WHEN coalesce(nullif(regexp_extract(low, '{P12}', 3), ''), regexp_extract(low, '{P12}', 6)) = 'pm' AND {_num(P12, 1)} < 12 THEN {_num(P12, 1)} + 12
  WHEN coalesce(nullif(regexp_extract(low, '{P12}', 3), ''), regexp_extract(low, '{P12}', 6)) = 'am' AND {_num(P12, 1)} = 12 THEN 0 ELSE {_num(P12, 1)} END"""
_H2 = f"""CASE WHEN regexp_extract(low, '{P12}', 6) = 'pm' AND {_num(P12, 4)} < 12 THEN {_num(P12, 4)} + 12
  WHEN regexp_extract(low, '{P12}', 6) = 'am' AND {_num(P12, 4)} = 12 THEN 0 ELSE {_num(P12, 4)} END"""
_DAY = "date_trunc('day', now_ref)"
_ISO = f"TRY_CAST(replace(regexp_extract(text, '{V.ISO_INSTANT}', 1), 'T', ' ') AS TIMESTAMP)"
RULES = [
    (_hit(V.LAST_MINUTES), f"now_ref - to_minutes({_num(V.LAST_MINUTES, 1)})", "now_ref", V.LAST_MINUTES, "low"),
    (_hit(V.LAST_HOURS), f"now_ref - to_hours({_num(V.LAST_HOURS, 1)})", "now_ref", V.LAST_HOURS, "low"),
    (_hit(V.LAST_HOUR), "now_ref - INTERVAL 1 HOUR", "now_ref", V.LAST_HOUR, "low"),
    (_hit(V.TODAY), _DAY, "now_ref", V.TODAY, "low"),
    (_hit(V.YESTERDAY), f"{_DAY} - INTERVAL 1 DAY", f"{_DAY} - INTERVAL 1 MICROSECOND", V.YESTERDAY, "low"),
    (_hit(V.MORNING), f"{_DAY} + INTERVAL 6 HOUR", f"{_DAY} + INTERVAL 12 HOUR", V.MORNING, "low"),
    (_hit(V.AFTERNOON), f"{_DAY} + INTERVAL 12 HOUR", f"{_DAY} + INTERVAL 18 HOUR", V.AFTERNOON, "low"),
    (_hit(V.EVENING), f"{_DAY} + INTERVAL 18 HOUR", f"{_DAY} + INTERVAL 86399 SECOND", V.EVENING, "low"),
    (_hit(P12), f"{_DAY} + to_hours({_H1}) + to_minutes(coalesce({_num(P12, 2)}, 0))",
     f"{_DAY} + to_hours({_H2}) + to_minutes(coalesce({_num(P12, 5)}, 0))", P12, "low"),
    (_hit(P24), f"{_DAY} + to_hours({_num(P24, 1)}) + to_minutes({_num(P24, 2)})",
     f"{_DAY} + to_hours({_num(P24, 3)}) + to_minutes({_num(P24, 4)})", P24, "low"),
    (_hit(V.ISO_INSTANT, "text"), f"{_ISO} - INTERVAL 5 MINUTE", f"{_ISO} + INTERVAL 5 MINUTE", V.ISO_INSTANT, "text"),
]


def _cases(i: int) -> str:
    parts = []
    for test, start, end, pattern, source in RULES:
        value = (start, end, f"regexp_extract({source}, '{pattern}', 0)")[i]
        parts.append(f"WHEN {test} THEN {value}")
    return "CASE " + " ".join(parts) + " END"


TIMED = f"""(SELECT query_id, text, now_ref, {_cases(0)} AS t_start, {_cases(1)} AS t_end, {_cases(2)} AS span
  FROM (SELECT *, lower(trim(text)) AS low FROM questions))"""


@query("u01_time_window", f"SELECT query_id, t_start, t_end, span FROM {TIMED}")
def _(d):
    w = text.time_window(F.trim("text"), F.col("now_ref"))
    return d.questions.withColumn("w", w).select("query_id", "w.t_start", "w.t_end", "w.span")


_WHOLE = [f"(?is)^(.*?){p}(.*)$" for p in V.PLACE_PATTERNS]
CLEANED = f"""(SELECT *, CASE WHEN span IS NULL OR span = '' THEN trim(text)
  ELSE regexp_replace(trim(text), regexp_escape(span), ' ', 'gi') END AS cleaned FROM {TIMED})"""
PLACED = f"""(SELECT *, CASE {' '.join(f"WHEN regexp_matches(cleaned, '{w}') THEN trim(regexp_extract(cleaned, '{w}', 2))" for w in _WHOLE)} END AS place,
  CASE {' '.join(f"WHEN regexp_matches(cleaned, '{w}') THEN regexp_extract(cleaned, '{w}', 1) || ' ' || regexp_extract(cleaned, '{w}', 3)" for w in _WHOLE)}
  ELSE cleaned END AS rest FROM {CLEANED})"""
_F1, _F2, _F3 = V.FILLER_PATTERNS
_STRIPPED = f"regexp_replace(regexp_replace(regexp_replace(rest, '{_F1}', ' ', 'gi'), '{_F2}', ' ', 'gi'), '{_F3}', ' ', 'gi')"
_WORDS = rf"trim(regexp_replace(trim(regexp_replace({_STRIPPED}, '[^\p{{L}}\p{{N}}_\s\-]', '', 'g')), '\s+', ' ', 'g'))"
_FILLED = "CASE WHEN words = '' THEN 'person or vehicle' ELSE words END"
PROMPT = f"""CASE WHEN string_split(lower({_FILLED}), ' ')[1] IN ('a', 'an', 'the') THEN {_FILLED} ELSE 'a ' || {_FILLED} END"""
PARSED = f"(SELECT *, {PROMPT} AS prompt FROM (SELECT *, {_WORDS} AS words FROM {PLACED}))"


@query("u02_question_decomposition", f"SELECT query_id, place, prompt FROM {PARSED}")
def _(d):
    return places.parse(d.questions).select("query_id", "place", "prompt")


@query(
    "v13_prompt_variants",
    f"""SELECT query_id, variant, CASE variant WHEN 'as_is' THEN prompt WHEN 'bare' THEN regexp_replace(prompt, '^(?:a|an) ', '')
    ELSE 'a photo of ' || prompt END AS prompt FROM {PARSED}, (VALUES ('as_is'), ('bare'), ('photo')) v(variant)""",
)
def _(d):
    p = places.parse(d.questions)
    prompt = F.col("prompt")
    forms = F.create_map(F.lit("as_is"), prompt, F.lit("bare"), text.bare_prompt(prompt), F.lit("photo"), text.photo_prompt(prompt))
    return p.select("query_id", F.explode(forms).alias("variant", "prompt"))


_SYN = "(VALUES " + ", ".join(f"('{k}', {v!r})" for k, v in V.LABEL_WORDS.items()) + ") s(word, labels)"
_SYN_MAP = "MAP([" + ", ".join(f"'{k}'" for k in V.LABEL_WORDS) + "], [" + ", ".join(str(v) for v in V.LABEL_WORDS.values()) + "])"
LABELS = rf"""(SELECT query_id, nullif(list_sort(list_distinct(flatten([coalesce(m[w], CASE WHEN suffix(w, 's') THEN m[w[1:-2]] END,
  CASE WHEN suffix(w, 'es') THEN m[w[1:-3]] END, []) FOR w IN regexp_extract_all(lower(text), '\b[a-zA-Z]+\b')]))), []) AS labels
  FROM questions, (SELECT {_SYN_MAP} AS m))"""


@query("u03_target_labels", f"SELECT query_id, array_to_string(labels, ',') AS labels FROM {LABELS}")
def _(d):
    return d.questions.select("query_id", F.array_join(text.target_labels(F.col("text")), ",").alias("labels"))


_NAME = "concat('  The ', p_name, ',  ', p_brand, '! ')"


@query(
    "u04_alias_normalise",
    rf"""SELECT p_partkey, trim(regexp_replace(regexp_replace(CASE WHEN starts_with(lower(trim({_NAME})), 'the ') THEN trim(substr(lower(trim({_NAME})), 5))
    ELSE lower(trim({_NAME})) END, '[^\p{{L}}\p{{N}}_\s\-]', '', 'g'), '\s+', ' ', 'g')) AS name FROM part""",
)
def _(d):
    raw = F.concat(F.lit("  The "), "p_name", F.lit(",  "), "p_brand", F.lit("! "))
    return d.table("part").select("p_partkey", text.alias_name(raw).alias("name"))


@query(
    "u05_object_group",
    f"""SELECT query_id, w, CASE WHEN w IN ({', '.join(map(repr, V.PERSON_LABELS))}) THEN 'person'
    WHEN w IN ({', '.join(map(repr, V.VEHICLE_LABELS))}) THEN 'vehicle' ELSE 'object' END AS grp
    FROM (SELECT query_id, regexp_extract(lower(text), '(car|person|truck|thing|dog)', 1) AS w FROM questions)""",
)
def _(d):
    w = F.regexp_extract(F.lower("text"), "(car|person|truck|thing|dog)", 1)
    rows = d.questions.select("query_id", w.alias("w"))
    return rows.select("query_id", "w", text.object_group(F.concat(F.lit(" A "), "w")).alias("grp"))


def _colour_sql(t: str) -> str:
    tests = []
    for colour, words in V.COLOUR_WORDS.items():
        any_word = " OR ".join(f"contains(' ' || lower({t}) || ' ', ' {w} ') OR starts_with(lower({t}), '{w} ')" for w in words)
        tests.append(f"CASE WHEN {any_word} THEN '{colour}' END")
    return "list_filter([" + ", ".join(tests) + "], lambda c: c IS NOT NULL)"


@query(
    "u07_colour_question",
    f"""SELECT p_partkey, CASE WHEN len(c) > 0 THEN list_contains(c, CASE WHEN p_size % 2 = 0 THEN 'red' ELSE 'blue' END) END AS matches
    FROM (SELECT *, {_colour_sql('p_name')} AS c FROM part)""",
)
def _(d):
    seen = F.when(F.col("p_size") % 2 == 0, "red").otherwise("blue")
    return d.table("part").select("p_partkey", text.colour_asked(F.col("p_name"), seen).alias("matches"))


VOCABULARY = ["red widget", "gear", "juice box", "laptop"]
_RAW = """CASE p_partkey % 9 WHEN 0 THEN 'A ' || p_name WHEN 1 THEN 'the juice bottle ' || p_name WHEN 2 THEN 'orange juice' WHEN 3 THEN 'power strip'
  WHEN 4 THEN p_name || ' adapter' WHEN 5 THEN 'an old notebook' WHEN 6 THEN 'water ' || p_name WHEN 7 THEN 'Laptop' ELSE p_name END"""


@query(
    "u08_detector_label",
    f"""SELECT p_partkey, CASE WHEN s IN ('red widget', 'gear', 'juice box', 'laptop') THEN s
      WHEN contains(s, 'juice') THEN CASE WHEN contains(s, 'bottle') THEN 'juice bottle' ELSE 'juice box' END
      WHEN contains(s, 'extension') OR contains(s, 'power strip') THEN 'extension board' WHEN contains(s, 'power bank') THEN 'power bank'
      WHEN contains(s, 'charger') OR contains(s, 'adapter') THEN 'phone charger' WHEN contains(s, 'speaker') THEN 'bluetooth speaker'
      WHEN contains(s, 'monitor') OR contains(s, 'display') THEN 'computer monitor' WHEN contains(s, 'laptop') OR contains(s, 'notebook') THEN 'laptop'
      WHEN contains(s, 'soda') THEN 'soda can' WHEN contains(s, 'water') OR contains(s, 'bottle') THEN 'water bottle'
      WHEN contains(s, 'red widget') THEN 'red widget' WHEN contains(s, 'gear') THEN 'gear' ELSE s END AS label
    FROM (SELECT p_partkey, regexp_replace(lower(trim({_RAW})), '^(a|an|the) ', '') AS s FROM part)""",
)
def _(d):
    n, k = F.col("p_name"), F.col("p_partkey") % 9
    raw = (
        F.when(k == 0, F.concat(F.lit("A "), n)).when(k == 1, F.concat(F.lit("the juice bottle "), n)).when(k == 2, "orange juice")
        .when(k == 3, "power strip").when(k == 4, F.concat(n, F.lit(" adapter"))).when(k == 5, "an old notebook")
        .when(k == 6, F.concat(F.lit("water "), n)).when(k == 7, "Laptop").otherwise(n)
    )
    return d.table("part").select("p_partkey", text.detector_label(raw, VOCABULARY).alias("label"))


_SPOKEN = """CASE event_id % 5 WHEN 0 THEN 'a car at the Landscape two camera' WHEN 1 THEN 'show test video ' || (1 + user_id % 3) || ' now'
  WHEN 2 THEN 'dogs near in mobile cam one?' WHEN 3 THEN 'At at landscape  with ' || event_type ELSE event_type || ' by the cam landscape 1' END"""
_REWRITE = _SPOKEN
for _p, _name in V.SPOKEN_REWRITES:
    _REWRITE = f"regexp_replace({_REWRITE}, '{_p}', '{_name}', 'gi')"
_REWRITE = rf"trim(regexp_replace(regexp_replace({_REWRITE}, '{V.DOUBLED_PREPOSITION}', '\1', 'gi'), '\s+', ' ', 'g'))"


def _spoken():
    u, e = F.col("user_id"), F.col("event_id") % 5
    return (
        F.when(e == 0, "a car at the Landscape two camera").when(e == 1, F.concat(F.lit("show test video "), 1 + u % 3, F.lit(" now")))
        .when(e == 2, "dogs near in mobile cam one?").when(e == 3, F.concat(F.lit("At at landscape  with "), "event_type"))
        .otherwise(F.concat("event_type", F.lit(" by the cam landscape 1")))
    )


@query("u09_spoken_camera_rewrite", f"SELECT event_id, {_REWRITE} AS said FROM events")
def _(d):
    return d.table("events").select("event_id", text.rewrite_spoken_cameras(_spoken()).alias("said"))


@query(
    "u10_spoken_text_clean",
    r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(trim(text)), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS said
    FROM conversations""",
)
def _(d):
    return d.table("conversations").select("conv_id", "turn", text.clean_spoken(F.col("text")).alias("said"))


@query(
    "u12_time_of_offset",
    """SELECT path, start_time + to_microseconds(CAST(round(rotation / fps * 1000000) AS BIGINT)) AS at FROM videos""",
)
def _(d):
    return d.videos.select("path", video_files.frame_time(F.col("start_time"), F.col("rotation"), F.col("fps")).alias("at"))


@query(
    "u13_track_key",
    "SELECT id, 'clip_' || regexp_extract(video, '(v[0-9]+)', 1) || '_trk_' || track_id AS key, camera || '_trk_' || track_id AS live_key FROM tracks",
)
def _(d):
    stem = text.file_stem(F.concat(F.lit("data/clip_"), "video", F.lit(".mp4")))
    return d.tracks.select("id", text.track_key(stem, "trk", F.col("track_id")).alias("key"),
                           text.track_key(F.col("camera"), "trk", F.col("track_id")).alias("live_key"))


@query("a07_reference_now", "SELECT max(start_time) AS now_ref FROM videos")
def _(d):
    return d.videos.agg(F.max("start_time").alias("now_ref")).select(F.coalesce("now_ref", reference_now(d.videos)).alias("now_ref"))
