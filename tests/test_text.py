"""Question parsing, names, colours and file times."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from camtrail.functions import text
from camtrail.operators import places, providers
from camtrail.sources import video_files

NOW = "2026-10-08 19:00:00"


def day(d, h=0, m=0, s=0, us=0):
    return datetime(2026, 10, d, h, m, s, us)


WINDOWS = [
    ("a red car in the last hour", day(8, 18), day(8, 19)),
    ("a delivery van yesterday", day(7), day(7, 23, 59, 59, 999999)),
    ("someone walking between 2 and 3 PM", day(8, 14), day(8, 15)),
    ("a bicyclist this morning", day(8, 6), day(8, 12)),
    ("a courier this afternoon", day(8, 12), day(8, 18)),
    ("a car in the past 30 minutes", day(8, 18, 30), day(8, 19)),
    ("any intruder today", day(8), day(8, 19)),
    ("vehicles in the last 2 hours", day(8, 17), day(8, 19)),
    ("cats this evening", day(8, 18), day(8, 23, 59, 59)),
    ("between 14:00 and 15:30 a car", day(8, 14), day(8, 15, 30)),
    ("between 12 am and 12 pm", day(8), day(8, 12)),
    ("seen 2026-10-08T10:00:00", day(8, 9, 55), day(8, 10, 5)),
    ("between 25:00 and 26:00", None, None),
    ("a car", None, None),
    (None, None, None),
]


def test_time_windows(spark):
    df = spark.createDataFrame([(t,) for t, *_ in WINDOWS], "text string").withColumn("now", F.lit(NOW).cast("timestamp_ntz"))
    got = {r.text: (r.w.t_start, r.w.t_end) if r.w else (None, None) for r in df.withColumn("w", text.time_window(F.col("text"), F.col("now"))).collect()}
    for t, start, end in WINDOWS:
        assert got[t] == (start, end), t


@pytest.fixture(scope="module")
def index(spark):
    cams = spark.createDataFrame([("cam_landscape",), ("cam_landscape2",), ("cam_gate_2",)], "camera string")
    kind = "name string, camera string, polygon array<struct<x:double,y:double>>, created_at timestamp_ntz"
    aliases = spark.createDataFrame([("back alley", "cam_landscape2", None, None)], kind)
    return cams, aliases


def resolve(spark, texts, cams, aliases):
    df = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string").withColumn("now_ref", F.lit(NOW).cast("timestamp_ntz"))
    return {r.text: r for r in places.resolve(places.parse(df), cams, aliases).collect()}


def test_question_parsing(spark, index):
    rows = resolve(spark, ["a red car near cam_landscape in the last hour", "a dog in the back alley", "a person at the main gate", "cat?"], *index)
    r = rows["a red car near cam_landscape in the last hour"]
    assert (r.place, r.status, r.camera) == ("cam_landscape", "RESOLVED", "cam_landscape") and "red car" in r.prompt
    r = rows["a dog in the back alley"]
    assert (r.place, r.status, r.camera) == ("back alley", "RESOLVED", "cam_landscape2")
    r = rows["a person at the main gate"]
    assert (r.place, r.status, r.camera, r.prompt) == ("main gate", "UNRESOLVED", None, "a person")
    assert rows["cat?"].status == "NONE" and rows["cat?"].labels == ["cat"]


def test_clarify_once(spark, index):
    cams, aliases = index
    asks = ["a person at the main gate", "show cars near main gate", "did a delivery truck pass by the main gate in the last hour?"]
    before = resolve(spark, asks, cams, aliases)
    assert {r.status for r in before.values()} == {"UNRESOLVED"}
    new = spark.createDataFrame([("The Main Gate!", "cam_landscape", None)], "name string, camera string, polygon array<struct<x:double,y:double>>")
    saved = places.save_aliases(aliases, new, F.lit(NOW).cast("timestamp_ntz"))
    after = resolve(spark, asks, cams, saved)
    assert {(r.status, r.camera) for r in after.values()} == {("RESOLVED", "cam_landscape")}
    gone = places.delete_aliases(saved, spark.createDataFrame([("main gate",)], "name string"))
    assert {r.name for r in gone.collect()} == {"back alley"}


def test_alias_without_a_name_is_an_error(spark, index):
    new = spark.createDataFrame([(" !", "c", None)], "name string, camera string, polygon array<struct<x:double,y:double>>")
    with pytest.raises(Exception, match="cannot be empty"):
        places.save_aliases(index[1], new, F.lit(NOW).cast("timestamp_ntz")).collect()


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("v")).first().v


def test_names_and_labels(spark):
    c = F.col("t")
    assert one(spark, text.alias_name(c), t="The Main Gate!") == "main gate"
    assert one(spark, text.alias_name(c), t="  the   Front Yard   ") == "front yard"
    assert one(spark, text.alias_name(c), t="LOBBY") == "lobby"
    assert one(spark, text.target_labels(c), t="buses and bottles") == ["bottle", "bus", "juice bottle", "water bottle"]
    assert one(spark, text.target_labels(c), t="nothing here") is None
    assert one(spark, text.object_group(c), t="A Police Car ") == "vehicle"
    assert one(spark, text.detector_label(c, ["mug"]), t="the old mug rack") == "mug"
    assert one(spark, text.rewrite_spoken_cameras(c), t="cars at the Landscape two camera") == "cars at cam_landscape2"
    for q, want in (("blue car", True), ("red car", False), ("a car", None)):
        assert one(spark, text.colour_asked(c, F.lit("blue")), t=q) is want


def test_spoken_cameras(spark):
    cameras = ["cam_landscape", "mobile_cam01", "mobile_cam02", "cam_entrance"]
    want = {
        "cam landscape": "cam_landscape", "camera landscape": "cam_landscape", "mobile cam 1": "mobile_cam01", "mobile cam 02": "mobile_cam02",
        "entrance": "cam_entrance", "completely unrelated sky": None,
    }
    df = spark.createDataFrame([(p,) for p in want], "phrase string")
    assert {r.phrase: r.camera for r in providers.match_spoken_cameras(df, cameras).collect()} == want


def test_similarities():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = row[:]
            for j, y in enumerate(b):
                row[j + 1] = prev[j] + 1 if x == y else max(prev[j + 1], row[j])
        return row[-1]

    for a, b in (("kitten", "sitting"), ("abcabc", "cabcab"), ("", "x"), ("same", "same")):
        assert providers.similarity(a, b) == pytest.approx(200 * lcs(a, b) / (len(a) + len(b)))
    assert providers.partial_similarity("entrance", "cam entrance") == 100


ANSWERS = [
    (("success", None, None, 0, "a red car", None, None, None, None), "No objects found matching a red car."),
    (("success", None, None, 1, "a red car", "car", "red", "cam_landscape", "2026-10-08 14:30:00"), "Found a red car on landscape at 2:30 PM."),
    (("success", None, None, 2, "x", "umbrella", "unknown", "cam_x_1", "2026-10-08 18:00:00"), "Found 2 matches, most recent was an umbrella on cam x 1 at 6 PM."),
    (("clarify", "gate", ["cam_landscape", "mobile_cam01"], 0, "x", None, None, None, None), "Did you mean landscape or mobile cam one?"),
    (("clarify", "gate", [], 0, "x", None, None, None, None), "Which camera covers gate?"),
]


def test_answers(spark):
    schema = "status string, ref string, options array<string>, n int, prompt string, label string, color string, camera string, ts string"
    df = spark.createDataFrame([a for a, _ in ANSWERS], schema)
    said = text.answer(*[F.col(c) for c in ("status", "ref", "options", "n", "prompt", "label", "color", "camera")],
                       F.col("ts").cast("timestamp_ntz"), F.lit(None).cast("double"))
    assert [r.s for r in df.select(said.alias("s")).collect()] == [want for _, want in ANSWERS]


def test_file_times_and_fallbacks(spark):
    rows = [
        ("x/gate_cam_20261008_143000.mp4", None, None, None), ("cctv1_2026-10-08_14-30-00.mp4", None, None, None), ("random_video.mp4", None, None, None),
        ("clip.mp4", "2026-10-08 12:00:00", "front_yard", None), ("clip_a.mp4", None, None, None), ("unnamed_no_metadata.mp4", None, None, None),
        ("tagged.mp4", None, None, "2026-10-08 07:00:00"),
    ]
    files = spark.createDataFrame(rows, "path string, manual_start string, manual_camera string, creation_time string")
    for c in ("manual_start", "creation_time"):
        files = files.withColumn(c, F.col(c).cast("timestamp_ntz"))
    files = files.withColumn("mtime", F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"))
    doc = '{"clip_a.mp4": {"start_time": "2026-10-08T09:15:00", "camera": "cam_lobby"}}'
    manifest = video_files.manifest_rows(spark.createDataFrame([(doc,)], "value string"))
    got = {r.path: (r.start_time, r.start_source, r.camera) for r in video_files.resolve_start(files, manifest).collect()}
    assert got["x/gate_cam_20261008_143000.mp4"] == (day(8, 14, 30), "filename", "gate_cam")
    assert got["cctv1_2026-10-08_14-30-00.mp4"] == (day(8, 14, 30), "filename", "cctv1")
    assert got["random_video.mp4"][1:] == ("mtime_fallback", "random_video")
    assert got["clip.mp4"] == (day(8, 12), "manual", "front_yard")
    assert got["clip_a.mp4"] == (day(8, 9, 15), "manifest", "cam_lobby")
    assert got["unnamed_no_metadata.mp4"][1:] == ("mtime_fallback", "unnamed_no_metadata")
    assert got["tagged.mp4"] == (day(8, 7), "ffprobe", "tagged")


def test_rotation(spark):
    docs = [
        '{"streams":[{"side_data_list":[{"rotation":-90}]}]}', '{"streams":[{"tags":{"rotate":"180"}}]}', '{"streams":[{"width":4}]}', "{}",
    ]
    df = spark.createDataFrame([(d,) for d in docs], "j string").select(video_files.probe_fields(F.col("j")).alias("p"))
    assert [r.p.rotation for r in df.collect()] == [270, 180, 0, 0]


def test_word_errors(spark):
    def plain(ref, hyp):
        a, b = (t.lower().replace(".", "").replace(",", "").split() for t in (ref, hyp))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y)))
        return row[-1] / len(a) if a else float(bool(b))

    pairs = [("The cat sat, on the mat.", "the cat sat on mat"), ("", "a"), ("", ""), ("a b", ""), ("one two three", "three two one")]
    pairs += [(" ".join(f"w{i * 7 % 311}" for i in range(400)), " ".join(f"w{i * 5 % 311}" for i in range(350)))]
    df = spark.createDataFrame(pairs, "r string, h string").select("*", text.word_error_rate(F.col("r"), F.col("h")).alias("w"))
    for row in df.collect():
        assert row.w == pytest.approx(plain(row.r, row.h))
