"""Table layouts."""

VIDEOS = (
    "path string, camera string, start_time timestamp_ntz, fps double, width int, height int, duration_s double, "
    "start_source string, rotation int, indexed_at timestamp_ntz"
)
DETECTIONS = (
    "camera string, video string, frame_idx bigint, ts timestamp_ntz, x1 double, y1 double, x2 double, y2 double, "
    "conf double, label string, source string"
)
OBSERVATIONS = (
    "camera string, video string, track_id bigint, frame_idx bigint, offset_s double, ts timestamp_ntz, x1 double, "
    "y1 double, x2 double, y2 double, conf double, quality double, label string"
)
TRACKS = (
    "id string, video string, camera string, track_id bigint, label string, grp string, t_start timestamp_ntz, "
    "t_end timestamp_ntz, t_best timestamp_ntz, offset_start double, offset_end double, offset_best double, bx1 double, "
    "by1 double, bx2 double, by2 double, snapshot string, emb array<float>, colors string, quality double, hits bigint"
)
FRAMES = "id string, video string, camera string, t_abs timestamp_ntz, offset_s double, snapshot string, emb array<float>"
ALIASES = "name string, camera string, polygon array<struct<x:double,y:double>>, created_at timestamp_ntz"
RULES = (
    "id string, rule_name string, query_text string, q_emb array<float>, camera_filter string, min_score double, "
    "is_active boolean, created_at timestamp_ntz, last_triggered_at timestamp_ntz"
)
EVENTS = (
    "event_id string, rule_id string, rule_name string, track_id string, camera string, label string, score double, "
    "ts timestamp_ntz, snapshot string"
)
