"""Keyed tables: what an upsert reads and writes, repeated and failed commits."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from camtrail.sources import keyed

SCHEMA = "id string, video string, camera string, track_id bigint, label string, t_start timestamp_ntz, quality double"
NAMES = ["id", "video", "camera", "track_id", "label", "t_start", "quality"]
CAMERAS = ["cam_1", "gate 2+b", "a:b/é%", "", None]


def row(i, camera, day, label="dog", quality=1.0):
    return (f"t{i}", f"v{i % 7}", camera, i, label, dt.datetime(2024, 1, day, i % 24), quality)


def base():
    return [row(i, CAMERAS[i % 5], 1 + i % 4) for i in range(200)]


def rows_of(table, version=None):
    return {r["id"]: tuple(r[c] for c in NAMES) for r in table.read(version).collect()}


@pytest.fixture()
def table(spark, tmp_path):
    out = keyed.tracks(spark, str(tmp_path / "tracks"), SCHEMA)
    assert out.version() == 0 and out.read().count() == 0
    assert out.upsert(spark.createDataFrame(base(), SCHEMA), "base") == 1
    return out


def data(table, version=None):
    return {f["file"] for f in table.files(version) if f["kind"] == "data"}


def test_rows_come_back_whole(table):
    assert rows_of(table) == {r[0]: r for r in base()}


def test_an_upsert_touches_only_parts_with_its_keys(spark, table):
    # Two known keys of one camera and day, one of which moves to another day, and two new ones, one of them in another part.
    batch = [("t0", "other", "other", -1, "cat", dt.datetime(2024, 1, 1), 2.0), ("t20", "other", "other", -1, "cat", dt.datetime(2024, 1, 9), 2.0)]
    batch += [row(900, "cam_1", 1), row(901, "gate 2+b", 2)]
    new = spark.createDataFrame(batch, SCHEMA)
    assert len(table.touched(new)) == 1
    before = data(table)
    assert table.upsert(new, "one") == 2
    gone = before - data(table)
    assert gone and {f.split("/", 1)[1].rsplit("/", 1)[0] for f in gone} == {"of_camera=cam_1/dt=2024-01-01"}
    want = {r[0]: r for r in base()} | {r[0]: r for r in batch[2:]}
    for k, day in (("t0", 1), ("t20", 9)):
        want[k] = (*want[k][:4], "cat", dt.datetime(2024, 1, day), 2.0)
    assert rows_of(table) == want
    assert rows_of(table, 1) == {r[0]: r for r in base()}
    # The moved key is found where it is now.
    assert table.touched(new.filter("id = 't20'")) == {"of_camera=cam_1/dt=2024-01-09"}


def test_filters_on_the_layout_skip_folders(table):
    plan = table.read().filter(F.col("dt") == dt.date(2024, 1, 2))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan


def test_repeated_and_failed_commits_leave_one_version(spark, table, monkeypatch):
    new = spark.createDataFrame([row(3, "cam_1", 1, "cat"), row(950, "cam_1", 1)], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(table, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.upsert(new, "two")
    assert table.version() == 1 and rows_of(table) == {r[0]: r for r in base()}
    assert table.upsert(new, "two") == 2
    assert table.upsert(new, "two") == 2 and table.upsert(spark.createDataFrame(base(), SCHEMA), "base") == 2
    got = rows_of(table)
    assert len(got) == 201 and got["t3"][4] == "cat" and got["t3"][2] == CAMERAS[3]


def test_many_commits_and_vacuum(spark, tmp_path):
    table = keyed.KeyedTable(spark, str(tmp_path / "few"), "id string, n int", "id", {"p": F.col("n") % 2}, buckets=2)
    want = {}
    for k in range(12):
        batch = {f"k{i % 9}": k for i in range(k, k + 3)} | {f"new{k}": k}
        want |= batch
        table.upsert(spark.createDataFrame(list(batch.items()), "id string, n int"), f"c{k}")
    assert {r["id"]: r["n"] for r in table.read().collect()} == want
    per_bucket = {}
    for f in table.files():
        if f["kind"] == "keys":
            per_bucket[f["bucket"]] = per_bucket.get(f["bucket"], 0) + 1
    assert max(per_bucket.values()) <= keyed.KEY_FILES + 1
    table.vacuum()
    assert {r["id"]: r["n"] for r in table.read().collect()} == want
    assert table.upsert(spark.createDataFrame([("k0", 77)], "id string, n int"), "last") == 13
    assert {r["id"]: r["n"] for r in table.read().collect()} == want | {"k0": 77}


def test_replace_forgets_removed_keys(spark, table):
    again = spark.createDataFrame([("v1",), ("v2",)], "video string")
    rows = spark.createDataFrame([("t1", "v1", "cam_9", 5, "new", None, 0.0), ("t3", "v9", "cam_9", 6, "new", None, 0.0)], SCHEMA)
    table.replace(again, "video", rows, "again")
    want = {r[0]: r for r in base() if r[1] not in ("v1", "v2")} | {"t1": ("t1", "v1", "cam_9", 5, "new", None, 0.0)}
    want["t3"] = (*want["t3"][:4], "new", None, 0.0)
    assert rows_of(table) == want
    # t8 (video v1) is gone, so it comes in as a new row with its own camera.
    table.upsert(spark.createDataFrame([row(8, "cam_new", 3)], SCHEMA), "back")
    assert rows_of(table)["t8"][2] == "cam_new"
