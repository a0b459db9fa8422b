"""Zone maps: files that are read, and answers that stay the same."""

from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from camtrail.operators import search
from camtrail.sources import keyed, zones
from test_retrieval import START, TRACKS, make_tracks


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = []
    for day in range(4):
        for r in make_tracks(60, 40 + day):
            r = list(r)
            r[0] = f"d{day}{r[0]}"
            r[3:6] = [t + timedelta(days=day) for t in r[3:6]]
            # The vectors of a day lie around one axis.
            r[13] = (0.05 * np.array(r[13]) + 2.0 * np.eye(8)[day]).tolist()
            r[2] = "car" if day == 2 else r[2]
            rows.append(tuple(r))
    frame = spark.createDataFrame(rows, TRACKS)
    table = keyed.tracks(spark, str(tmp_path_factory.mktemp("zones") / "t"), frame.schema)
    table.upsert(frame, "base")
    return frame, table


Q = "query_id long, q_emb array<float>, camera_key string, start_us long, end_us long, labels array<string>"


def ask(spark, axis, day=None, camera=None, labels=None):
    us = lambda t: int((t - START.replace(year=1970, month=1, day=1, hour=0, minute=0, second=0)).total_seconds() * 1_000_000)
    span = (None, None) if day is None else (us(START + timedelta(days=day)), us(START + timedelta(days=day, hours=20)))
    return spark.createDataFrame([(1, np.eye(8)[axis].tolist(), camera, *span, labels)], Q)


def found(queries, tracks, **options):
    rows = search.top_k(queries, tracks, k=20, dedup_s=None, **options).collect()
    return [(r.query_id, r["rank"], r.result_id, r.score) for r in sorted(rows, key=lambda r: (r.query_id, r["rank"]))]


def read(table, queries, least=None):
    from camtrail.operators.scoring import QueryBlock

    zoned = zones.ZonedTable(table, least=least)
    return zoned.files_for(QueryBlock.read(queries.toArrow()))


def test_only_files_that_can_answer_are_read(spark, stored):
    frame, table = stored
    every = {f["file"] for f in table.files() if f["kind"] == "data"}
    days = {f["dt"] for f in table.read().select("dt").distinct().collect()}
    assert len(days) >= 4 and len(every) >= 8
    assert set(read(table, ask(spark, 0))) == every
    one_day = read(table, ask(spark, 0, day=1))
    assert one_day and len(one_day) < len(every)
    one_camera = read(table, ask(spark, 0, camera="1"))
    assert one_camera and all("of_camera=cam_1/" in f for f in one_camera)
    close = read(table, ask(spark, 3), least=1.0)
    assert close and len(close) <= len(every) / 2
    assert read(table, ask(spark, 0), least=5.0) == []
    assert set(read(table, ask(spark, 0, labels=["nothing"]))) <= every


@pytest.mark.parametrize("case", [{}, {"day": 1}, {"camera": "1"}, {"day": 2, "camera": "2", "labels": ["car"]}, {"labels": ["car"]}])
@pytest.mark.parametrize("threshold", [None, 1.2])
def test_answers_are_those_of_the_whole_table(spark, stored, case, threshold):
    frame, table = stored
    q = ask(spark, 2, **case)
    zoned = zones.ZonedTable(table, least=threshold)
    assert found(q, zoned, threshold=threshold) == found(q, frame, threshold=threshold)


def test_new_files_get_entries(spark, stored):
    frame, table = stored
    zoned = zones.ZonedTable(table)
    before = zoned.entries().count()
    row = list(make_tracks(1, 77)[0])
    row[0], row[13] = "late", (9.0 * np.eye(8)[7]).tolist()
    table.upsert(spark.createDataFrame([tuple(row)], TRACKS), "late")
    assert zoned.entries().count() == before + 1
    got = found(ask(spark, 7), zones.ZonedTable(table, least=8.0), threshold=8.0)
    assert [g[2] for g in got] == ["late"] and len(read(table, ask(spark, 7), least=8.0)) == 1


def test_days_are_partition_filters(spark, stored):
    from camtrail.operators.scoring import QueryBlock

    _, table = stored
    scan = search.narrow(table.read(), "t_start", "t_end", QueryBlock.read(ask(spark, 0, day=1).toArrow()))
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan
    assert scan.filter(F.col("dt").isNull()).count() == 0
