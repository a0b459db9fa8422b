"""Index tables that are updated by key: a key index names the parts a batch touches, and only those are read and written again.

Layout below one folder that all executors reach::

    data/commit=<c>/<layout columns>/...   rows, one folder per part
    keys/commit=<c>/bucket=<b>/...         (key, part, seq) of keys that this commit placed, moved or removed, by hash bucket
    versions/v=<n>/...                     the files that make up version n, and the commits that led to it

A commit writes new folders beside the old ones; the version that names them is written last, in one small Parquet file. Readers see whole versions, a commit that failed
leaves nothing that a version names, and repeating it, or one that was done already, ends in one version. One writer at a time; a second one fails when it
writes the version that the first has written. Old files stay until ``vacuum``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from camtrail.scale import broadcast_if_small
from camtrail.schema import EVENTS, RULES
from camtrail.sources.index import upsert_rows

BUCKETS = 64
# Commits that a version remembers; only one that is repeated soon after can be asked for.
COMMITS = 1_000
# A bucket of the key index with more files than this is written anew as one by the commit that touches it.
KEY_FILES = 8
_VERSION = "kind string, file string, part string, bucket int, commits array<string>"


class KeyedTable:
    """A table with one row per ``key``, laid out by ``layout`` (folder column -> expression over the row)."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, key: str, layout: Mapping[str, Column], sticky: Sequence[str] = (), buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.layout, self.sticky, self.buckets = spark, path.rstrip("/"), key, dict(layout), sticky, buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        folders = spark.createDataFrame([], self.schema).select(*[e.alias(c) for c, e in self.layout.items()]).schema
        self.stored = T.StructType([*self.schema.fields, *folders.fields, T.StructField("commit", T.StringType())])
        self.index = T.StructType([T.StructField("key", self.schema[key].dataType), *T.StructType.fromDDL("part string, seq long, bucket int, commit string").fields])

    # Versions

    def version(self) -> int:
        """Number of the latest version, 0 before the first."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        store = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(folder):
            return 0
        done = [s.getPath() for s in store.listStatus(folder) if store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max((int(p.getName().removeprefix("v=")) for p in done), default=0)

    def files(self, version: int | None = None) -> list:
        """Rows (kind, file, part, bucket, commits) of a version, the latest one by default: one per file, as a listing of its folders would have."""
        n = self.version() if version is None else version
        return self.spark.read.schema(_VERSION).parquet(f"{self.path}/versions/v={n}").collect() if n else []

    def _publish(self, version: int, files: list[tuple], commits: Sequence[str]) -> int:
        rows = [(*f, None) for f in files] + [("commits", None, None, None, list(commits))]
        self.spark.createDataFrame(rows, _VERSION).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/versions/v={version}")
        return version

    # Reading

    def _rows(self, files: Sequence[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.stored)
        return self.spark.read.schema(self.stored).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/{unquote(f)}" for f in files])

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version with the layout columns, so filters on them skip folders."""
        return self._rows([f["file"] for f in self.files(version) if f["kind"] == "data"]).drop("commit")

    def _keys(self, files: Sequence[str]) -> DataFrame:
        """(key, part) of some files of the key index: the last entry of a key counts, and a null part removes it."""
        if not files:
            return self.spark.createDataFrame([], "key {}, part string".format(self.schema[self.key].dataType.simpleString()))
        rows = self.spark.read.schema(self.index).option("basePath", f"{self.path}/keys").parquet(*[f"{self.path}/keys/{unquote(f)}" for f in files])
        return rows.groupBy("key").agg(F.max_by("part", "seq").alias("part")).filter("part is not null")

    # Writing

    def _written(self, folder: str, kind: str) -> list[tuple]:
        """(kind, file, part, bucket) of the files that a commit has written; the part is the folder below the commit's."""
        root = f"{self.path}/{kind}/"
        out = []
        for name in self.spark.read.schema(self.stored if kind == "data" else self.index).option("basePath", f"{self.path}/{kind}").parquet(f"{root}{folder}").inputFiles():
            file = name[name.index(f"/{kind}/{folder}/") + len(kind) + 2 :]
            part = file[len(folder) + 1 : file.rindex("/")]
            out.append((kind, file, part, int(part.removeprefix("bucket="))) if kind == "keys" else (kind, file, part, None))
        return out

    def _placed(self, files: Sequence[str], *columns: str) -> DataFrame:
        """(key, columns, part) of stored rows: the part is the folder of a row's file."""
        rows = self._rows(files)
        path = F.col("_metadata.file_path") if files else F.lit(None).cast("string")
        return rows.select(F.col(self.key).alias("key"), *columns, F.regexp_extract(path, r"/data/commit=[^/]*/(.*)/[^/]*$", 1).alias("part"))

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _commit(self, commit: str, version: int, before: list, rows: DataFrame, parts: set[str], keys: DataFrame, known: Sequence[str], removed: DataFrame | None) -> int:
        """Write ``rows`` in place of the data files of ``parts``, and index entries of ``keys`` that are new or elsewhere than ``known`` files of the key index say."""
        folder = f"commit={commit}"
        placed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        placed = placed.select("*", *[e.alias(c) for c, e in self.layout.items()])
        placed.hint("rebalance", *[F.col(c) for c in self.layout]).write.mode("overwrite").partitionBy(*self.layout).parquet(f"{self.path}/data/{folder}")
        data = self._written(folder, "data")
        now = self._placed([f for _, f, _, _ in data])
        now = now.join(broadcast_if_small(keys), "key", "left_semi")
        entries = now.join(self._keys(known), ["key", "part"], "left_anti")
        if removed is not None:
            entries = entries.unionByName(removed.select("key", F.lit(None).cast("string").alias("part")))
        crowded = self._crowded(before, known)
        if crowded:
            old = self._keys([f["file"] for f in crowded]).join(entries.select("key"), "key", "left_anti")
            entries = entries.unionByName(old)
        entries = entries.withColumn("seq", F.lit(version).cast("long")).withColumn("bucket", self._bucket(F.col("key")))
        entries.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/keys/{folder}")
        gone = {f["file"] for f in crowded}
        kept = [(f["kind"], f["file"], f["part"], f["bucket"]) for f in before if f["kind"] == "data" and f["part"] not in parts]
        kept += [(f["kind"], f["file"], f["part"], f["bucket"]) for f in before if f["kind"] == "keys" and f["file"] not in gone]
        return self._publish(version, kept + data + self._written(folder, "keys"), [*self._commits(before), commit][-COMMITS:])

    def _crowded(self, before: list, known: Sequence[str]) -> list:
        touched, count = set(known), {}
        for f in before:
            if f["kind"] == "keys":
                count[f["bucket"]] = count.get(f["bucket"], 0) + 1
        return [f for f in before if f["file"] in touched and count[f["bucket"]] > KEY_FILES]

    @staticmethod
    def _commits(files: list) -> list[str]:
        return next((list(f["commits"]) for f in files if f["kind"] == "commits"), [])

    def _locate(self, files: list, keys: DataFrame) -> tuple[list[str], set[str]]:
        """Files of the key index that can hold ``keys`` (key), and the parts that do hold some. Only buckets of the batch are read."""
        buckets = {r[0] for r in keys.select(self._bucket(F.col("key"))).distinct().collect()}
        known = [f["file"] for f in files if f["kind"] == "keys" and f["bucket"] in buckets]
        hits = self._keys(known).join(broadcast_if_small(keys), "key", "left_semi").select("part").distinct()
        return known, {r["part"] for r in hits.collect()}

    def touched(self, batch: DataFrame) -> set[str]:
        """Parts that hold keys of ``batch``."""
        return self._locate(self.files(), batch.select(F.col(self.key).alias("key")).distinct())[1]

    def existing(self, keys: DataFrame) -> DataFrame:
        """Those of ``keys`` (one column, named like the table's key) that the table has; only their buckets of the key index are read."""
        named = keys.select(F.col(self.key).alias("key")).distinct()
        known, _ = self._locate(self.files(), named)
        return self._keys(known).join(broadcast_if_small(named), "key", "left_semi").select(F.col("key").alias(self.key))

    def rows_of(self, keys: DataFrame) -> DataFrame:
        """Rows of ``keys``; only the parts that hold some are read."""
        files = self.files()
        named = keys.select(self.key).distinct()
        _, parts = self._locate(files, named.select(F.col(self.key).alias("key")))
        rows = self._rows([f["file"] for f in files if f["kind"] == "data" and f["part"] in parts]).select(*self.schema.names)
        return rows.join(broadcast_if_small(named), self.key, "left_semi")

    def done(self, commit: str) -> bool:
        """Whether a version has this commit."""
        return commit in self._commits(self.files())

    def upsert(self, batch: DataFrame, commit: str) -> int:
        """Insert or replace rows by key (one row per key in ``batch``) and return the version that has them.

        Sticky columns keep their first value; columns that the batch lacks keep theirs. Parts without a key of the batch are neither read nor written; new keys add
        a file to their part. A commit that an earlier version has is not done again.
        """
        version = self.version()
        before = self.files(version)
        if commit in self._commits(before):
            return version
        missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name not in batch.columns]
        keys = batch.select(F.col(self.key).alias("key")).distinct()
        known, parts = self._locate(before, keys)
        old = self._rows([f["file"] for f in before if f["kind"] == "data" and f["part"] in parts]).select(*self.schema.names)
        rows = upsert_rows(old, batch, self.key, self.sticky) if parts else batch.select("*", *missing).select(*self.schema.names)
        return self._commit(commit, version + 1, before, rows, parts, keys, known, None)

    def merge(self, other: DataFrame, column: str, not_like: str, commit: str) -> int:
        """Take over the rows of another index whose ``column`` does not match a pattern; they replace rows of the same key."""
        return self.upsert(other.filter(~F.col(column).like(not_like)), commit)

    def replace(self, values: DataFrame, column: str, rows: DataFrame, commit: str) -> int:
        """Remove the rows whose ``column`` is among ``values`` and add ``rows``. The column alone is read to find the parts that hold such rows."""
        version = self.version()
        before = self.files(version)
        if commit in self._commits(before):
            return version
        values = broadcast_if_small(values.select(column).distinct())
        lost = self._placed([f["file"] for f in before if f["kind"] == "data"], column).join(values, column, "left_semi")
        parts = {r["part"] for r in lost.select("part").distinct().collect()}
        added = rows.select(F.col(self.key).alias("key"))
        known, more = self._locate(before, added)
        old = self._rows([f["file"] for f in before if f["kind"] == "data" and f["part"] in parts | more]).select(*self.schema.names)
        kept = old.join(values, column, "left_anti")
        removed = lost.select("key").join(added, "key", "left_anti").distinct()
        return self._commit(commit, version + 1, before, upsert_rows(kept, rows, self.key, self.sticky), parts | more, added, known, removed)

    def vacuum(self) -> None:
        """Delete data and key files that the latest version does not name, and the versions before it. No reader of an older version may be running."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        latest = self.version()
        used = {(f["kind"], f["file"]) for f in self.files(latest)}
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        store = root.getFileSystem(conf)
        for kind in ("data", "keys"):
            folder = jvm.org.apache.hadoop.fs.Path(root, kind)
            names = store.listFiles(folder, True)
            while names.hasNext():
                path = names.next().getPath()
                name = path.toUri().getRawPath()
                file = name[name.index(f"/{kind}/commit=") + len(kind) + 2 :]
                if file.endswith(".parquet") and (kind, file) not in used:
                    store.delete(path, False)
        for status in store.listStatus(jvm.org.apache.hadoop.fs.Path(root, "versions")):
            if int(status.getPath().getName().removeprefix("v=")) < latest:
                store.delete(status.getPath(), True)


def videos(spark: SparkSession, path: str, schema: T.StructType | str) -> KeyedTable:
    """Videos by path: the last write replaces every other column."""
    return KeyedTable(spark, path, schema, "path", {"of_camera": F.col("camera")})


def tracks(spark: SparkSession, path: str, schema: T.StructType | str) -> KeyedTable:
    """Tracks by id, by camera and day: video, camera and track number keep their first value."""
    return KeyedTable(spark, path, schema, "id", {"of_camera": F.col("camera"), "dt": F.to_date("t_start")}, ("video", "camera", "track_id"))


def events(spark: SparkSession, path: str) -> KeyedTable:
    """Alert events by id, by day."""
    return KeyedTable(spark, path, EVENTS, "event_id", {"dt": F.to_date("ts")})


def rules(spark: SparkSession, path: str, schema: T.StructType | str = RULES) -> KeyedTable:
    """Alert rules by id."""
    return KeyedTable(spark, path, schema, "id", {"active": F.col("is_active")}, buckets=8)


def frames(spark: SparkSession, path: str, schema: T.StructType | str) -> KeyedTable:
    """Frames by id, by camera and day: only time, offset, snapshot and vector are replaced."""
    return KeyedTable(spark, path, schema, "id", {"of_camera": F.col("camera"), "dt": F.to_date("t_abs")}, ("video", "camera"))
