"""The folder watch that waits until a file's size is stable."""

from pyspark.sql import DataFrame

from camtrail.streaming import watch


def test_a_growing_file_is_taken_once_and_whole(spark, tmp_path):
    folder, taken = tmp_path / "in", []
    folder.mkdir()

    def ingest(batch: DataFrame, n: int) -> None:
        taken.append((n, sorted((r["path"].split("/")[-1], r["length"]) for r in batch.collect())))

    look = watch.stable_files(str(folder), str(tmp_path / "looks"), ingest)
    tick = spark.range(1)
    look(tick, 0)  # nothing there
    (folder / "a.mp4").write_bytes(b"x" * 10)
    (folder / "b.MKV").write_bytes(b"x" * 7)
    (folder / "empty.mp4").write_bytes(b"")
    (folder / "notes.txt").write_bytes(b"x")
    (folder / "c_invalid.mp4").write_bytes(b"x")
    look(tick, 1)
    assert taken == []
    (folder / "a.mp4").write_bytes(b"x" * 25)  # still being written
    look(tick, 2)
    assert taken == [(2, [("b.MKV", 7)])]
    look(tick, 3)
    assert taken[1:] == [(3, [("a.mp4", 25)])]
    look(tick, 3)  # the same batch delivered again
    look(tick, 4)
    (folder / "a.mp4").write_bytes(b"x" * 30)  # changed after it was taken
    look(tick, 5)
    look(tick, 6)
    assert len(taken) == 2


def test_a_look_that_failed_is_made_again(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    (folder / "a.mp4").write_bytes(b"x")

    def ingest(batch: DataFrame, n: int) -> None:
        seen.append(n)
        if len(seen) == 1:
            raise RuntimeError("stopped")

    look = watch.stable_files(str(folder), str(tmp_path / "looks"), ingest)
    look(spark.range(1), 0)
    try:
        look(spark.range(1), 1)
    except RuntimeError:
        look(spark.range(1), 1)
    look(spark.range(1), 2)
    assert seen == [1, 1]


def test_the_clock_drives_the_looks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.mp4").write_bytes(b"xyz")
    taken = []
    look = watch.stable_files(str(tmp_path / "in"), str(tmp_path / "looks"), lambda batch, n: taken.extend(batch.collect()))
    for _ in range(4):
        watch.watch_stable(spark, look, str(tmp_path / "state"), once=True).awaitTermination()
    assert [(r["path"].split("/")[-1], r["length"]) for r in taken] == [("a.mp4", 3)]


def test_the_watch_query_names_tables_stored_as_folders(spark, tmp_path):
    from checks.all_queries import QUERIES
    from checks.views import TABLES

    for t in TABLES:
        (tmp_path / "in").mkdir(exist_ok=True)
        if t in ("events", "orders"):
            spark.range(20).repartition(3).write.parquet(str(tmp_path / "in" / f"{t}.parquet"))
        else:
            (tmp_path / "in" / f"{t}.parquet").write_bytes(b"x")
    found = QUERIES["s18_folder_watch"](spark, str(tmp_path / "in")).collect()
    assert sorted(tuple(r) for r in found) == sorted((f"{t}.parquet", True) for t in TABLES)
