"""Helpers that keep plans safe when one key, bucket or timeline holds much of the data."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

# A side is broadcast only after its row count is known to be at most this.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can read: the one the session names, a temporary one only for a local session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is not None:
        return folder
    current = spark.sparkContext.getCheckpointDir()
    if current is not None:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the session names; survives the loss of executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def free_shuffles(spark: SparkSession) -> None:
    """Have the files of shuffles that nothing refers to any more removed now; Spark's cleaner does so only after a collection on the driver."""
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` has at most ``rows`` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast for a side of proven size; beyond it Spark shuffles with skew splitting."""
    return F.broadcast(df) if small(df, rows) else df


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal ``keys`` where two nulls are equal too, so rows without a camera or video are a group like any other."""
    theirs = right.select(*[F.col(c).alias(f"_same_{c}" if c in keys else c) for c in right.columns])
    test = F.lit(True)
    for c in keys:
        test = test & left[c].eqNullSafe(theirs[f"_same_{c}"])
    return left.join(theirs, test, how).drop(*[f"_same_{c}" for c in keys])


def hot_groups(df: DataFrame, group: Sequence[str], limit: int) -> DataFrame:
    """Groups with more than ``limit`` rows; a map-side combined count on the key columns only."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)


def split_hot(df: DataFrame, group: Sequence[str], limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary groups, and rows of hot groups or None when there is none."""
    hot = cut_lineage(hot_groups(df, group, limit).select(*group))
    if hot.isEmpty():
        return df, None
    hot = broadcast_if_small(hot)
    return join_same(df, hot, group, "left_anti"), join_same(df, hot, group, "left_semi")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ column, without a zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def from_micros(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def seconds(us: Column, digits: int) -> Column:
    """Microseconds as seconds rounded half away from zero, decided on the integer."""
    step = 10 ** (6 - digits)
    return F.signum(us) * F.floor((F.abs(us) + step // 2) / step) / float(10**digits)


def floor_div(value: Column, width: int) -> Column:
    """Integer floor division that also holds for negative values."""
    return ((value - F.pmod(value, F.lit(width))) / F.lit(width)).cast("long")


def previous_in_time(
    df: DataFrame,
    key: Sequence[str],
    time_us: str,
    value: str,
    tie: Sequence[str] = (),
    chunk_us: int = 86_400_000_000,
) -> DataFrame:
    """Add ``prev_<value>``, the value of the preceding row of the key in time order.

    A window per (key, time chunk) instead of per key, so a camera that holds
    much of the data is spread over tasks; the first row of a chunk takes the
    last row of the nearest earlier chunk from a one-row-per-chunk summary.
    """
    keys = list(key)
    out = f"prev_{value}"
    order = [F.col(time_us), *[F.col(c) for c in tie]]
    rows = df.withColumn("_chunk", floor_div(F.col(time_us), chunk_us))
    last = rows.groupBy(*keys, "_chunk").agg(
        F.max_by(F.col(value), F.struct(*order)).alias("_last")
    )
    carry = last.withColumn("_carry", F.lag("_last").over(W.partitionBy(*keys).orderBy("_chunk")))
    inside = F.lag(value).over(W.partitionBy(*keys, "_chunk").orderBy(*order))
    return (
        join_same(rows.withColumn("_inside", inside), carry.select(*keys, "_chunk", "_carry"), [*keys, "_chunk"])
        .withColumn(out, F.coalesce("_inside", "_carry"))
        .drop("_chunk", "_inside", "_carry")
    )


def carry_forward(
    df: DataFrame, key: Sequence[str], time_us: str, value: str, out: str, chunk_us: int = 86_400_000_000
) -> DataFrame:
    """Add ``out``: the last non-null ``value`` at or before the row, in time chunks as above."""
    keys = list(key)
    rows = df.withColumn("_chunk", floor_div(F.col(time_us), chunk_us))
    last = rows.groupBy(*keys, "_chunk").agg(
        F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(time_us))).alias("_last")
    )
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = last.select(*keys, "_chunk", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    upto = W.partitionBy(*keys, "_chunk").orderBy(time_us).rangeBetween(W.unboundedPreceding, 0)
    return (
        join_same(rows.withColumn("_inside", F.last(value, ignorenulls=True).over(upto)), carry, [*keys, "_chunk"])
        .withColumn(out, F.coalesce("_inside", "_carry"))
        .drop("_chunk", "_inside", "_carry")
    )


def running_counts(df: DataFrame, key: Sequence[str], order: str, sums: Sequence[str]) -> DataFrame:
    """Add ``before_<c>``: per key, the sum of ``c`` over rows with a smaller ``order`` value.

    ``(key, order)`` must be unique (aggregate first). Range partitioning on it
    is balanced whatever the key sizes; offsets travel as one row per
    (key, range), so no key is ever gathered in one task.
    """
    keys = list(key)
    parts = df.repartitionByRange(*[F.col(c) for c in [*keys, order]])
    parts = cut_lineage(parts.withColumn("_range", F.spark_partition_id()))
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    offsets = offsets.select(
        *keys, "_range", *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums]
    )
    inside = W.partitionBy(*keys, "_range").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    out = join_same(parts, offsets, [*keys, "_range"])
    for c in sums:
        out = out.withColumn(f"before_{c}", F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_o_{c}"))
    return out.drop("_range", *[f"_o_{c}" for c in sums])


def next_at_or_after(probes: DataFrame, marks: DataFrame, key: Sequence[str], at: str, mark: str, out: str) -> DataFrame:
    """(key, ``at``, ``out``): the smallest ``mark`` of the key at or after each distinct ``at``, null where there is none.

    Both sides are range-partitioned together, so no key is gathered in one task; a range without a later mark takes the first one of the nearest range
    that has any, from one row per (key, range).
    """
    keys = list(key)
    both = marks.select(*keys, F.col(mark).alias("_at"), F.col(mark).alias("_mark"), F.lit(False).alias("_asked"))
    both = both.unionByName(probes.select(*keys, F.col(at).alias("_at"), F.lit(None).cast(marks.schema[mark].dataType).alias("_mark"), F.lit(True).alias("_asked")))
    both = both.groupBy(*keys, "_at").agg(F.max("_mark").alias("_mark"), F.max("_asked").alias("_asked"))
    parts = both.repartitionByRange(*[F.col(c) for c in [*keys, "_at"]])
    parts = cut_lineage(parts.withColumn("_range", F.spark_partition_id()))
    # Both windows run backwards in time: a frame that ends at the last row is worked out anew for every row, one that begins at the first is carried on.
    later = W.partitionBy(*keys).orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1)
    heads = parts.groupBy(*keys, "_range").agg(F.min("_mark").alias("_head"))
    heads = heads.select(*keys, "_range", F.last("_head", ignorenulls=True).over(later).alias("_carry"))
    inside = W.partitionBy(*keys, "_range").orderBy(F.desc("_at")).rowsBetween(W.unboundedPreceding, 0)
    found = parts.withColumn("_inside", F.last("_mark", ignorenulls=True).over(inside)).filter("_asked")
    return join_same(found, heads, [*keys, "_range"]).select(*keys, F.col("_at").alias(at), F.coalesce("_inside", "_carry").alias(out))


def band_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_at: str,
    right_at: str,
    low: float,
    high: float,
    condition: Column | None = None,
    bucket_rows: int = 20_000,
) -> DataFrame:
    """Pairs with equal ``keys`` and ``low <= right_at - left_at <= high``.

    Catalyst would run a bare band predicate as a nested loop. Here both sides
    get a bucket of the band width; the left row is offered to every bucket its
    band can reach and the join is an equi-join with the exact predicate (and
    ``condition``) evaluated inside it, so only matches leave the join. A
    bucket with more than ``bucket_rows`` left rows is split into salts: its
    left rows spread over them, the right rows of that bucket repeat per salt.
    Column names of the two sides must differ outside ``keys``.
    """
    keys = list(keys)
    width = float(high - low) or 1.0
    first = F.floor((F.col(left_at) + F.lit(float(low))) / width)
    last = F.floor((F.col(left_at) + F.lit(float(high))) / width)
    lhs = left.withColumn("_bucket", F.explode(F.sequence(first, last)))
    rhs = right.withColumn("_bucket", F.floor(F.col(right_at) / width))
    slots = [*keys, "_bucket"]
    hot = lhs.groupBy(*slots).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > bucket_rows)
    hot = cut_lineage(hot.select(*slots, F.ceil(F.col("_n") / bucket_rows).cast("int").alias("_salts")))
    if hot.isEmpty():
        on = slots
    else:
        hot = broadcast_if_small(hot)
        salts = F.coalesce("_salts", F.lit(1))
        lhs = lhs.join(hot, slots, "left").withColumn(
            "_salt", F.pmod(F.xxhash64(*[F.col(f.name) for f in left.schema if f.dataType.typeName() != "map"]), salts).cast("int")
        ).drop("_salts")
        rhs = rhs.join(hot, slots, "left").withColumn(
            "_salt", F.explode(F.sequence(F.lit(0), (salts - 1).cast("int")))
        ).drop("_salts")
        on = [*slots, "_salt"]
    a, b = lhs.alias("a"), rhs.alias("b")
    gap = F.col(f"b.{right_at}") - F.col(f"a.{left_at}")
    test = (gap >= low) & (gap <= high)
    for c in on:
        test = test & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    if condition is not None:
        test = test & condition
    joined = a.join(b, test)
    drop = {*on}
    return joined.select(
        *[F.col(f"a.{c}") for c in keys],
        *[F.col(f"a.{c}") for c in left.columns if c not in drop],
        *[F.col(f"b.{c}") for c in right.columns if c not in drop],
    )


def follow_pointers(links: DataFrame, node: str, nxt: str) -> DataFrame:
    """Last node reached from every node of a successor map; pointer doubling, log2(length) rounds.

    ``links`` has one row per node with a successor. Returns (node, root, hops)
    for those nodes.
    """
    state = cut_lineage(links.select(F.col(node).alias("n"), F.col(nxt).alias("root"), F.lit(1).cast("long").alias("hops")))
    while True:
        ahead = state.select(F.col("n").alias("root"), F.col("root").alias("r2"), F.col("hops").alias("h2"))
        step = cut_lineage(
            state.join(ahead, "root", "left").select(
                "n",
                F.coalesce("r2", "root").alias("root"),
                (F.col("hops") + F.coalesce("h2", F.lit(0))).alias("hops"),
                F.col("r2").isNotNull().alias("moved"),
            )
        )
        state = step.drop("moved")
        if step.filter("moved").isEmpty():
            return state.select(F.col("n").alias(node), "root", "hops")


def session(name: str = "camtrail", cores: str = "*", shuffle: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; on a cluster bring your own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
