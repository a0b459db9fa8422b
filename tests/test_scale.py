"""Helpers for skewed data against plain computations."""

import random

from pyspark.sql import Window as W, functions as F

from camtrail.scale import band_join, carry_forward, previous_in_time, running_counts


def test_band_join_with_and_without_salts(spark):
    rnd = random.Random(1)
    left = [(rnd.choice("ab"), i, 0 if rnd.random() < 0.4 else rnd.randrange(-500, 500)) for i in range(200)]
    right = [(rnd.choice("ab"), i, rnd.randrange(-500, 500)) for i in range(200)]
    want = {(a, b) for g, a, t in left for h, b, u in right if g == h and -3 <= u - t <= 20}
    ldf = spark.createDataFrame(left, "g string, a long, t long")
    rdf = spark.createDataFrame(right, "g string, b long, u long")
    for bucket_rows in (10_000, 7):
        rows = band_join(ldf, rdf, ["g"], "t", "u", -3, 20, bucket_rows=bucket_rows).collect()
        assert len(rows) == len(want) and {(r.a, r.b) for r in rows} == want


def test_previous_and_carry_forward(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("ab"), i, i * rnd.choice([1, 1, 1]) * 10 + rnd.randrange(9), i if rnd.random() < 0.2 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i long, t long, v long")
    w = W.partitionBy("k").orderBy("t", "i")
    want = {(r.i, r.p) for r in df.withColumn("p", F.lag("t").over(w)).collect()}
    got = {(r.i, r.prev_t) for r in previous_in_time(df, ["k"], "t", "t", ["i"], chunk_us=100).collect()}
    assert got == want
    want = {(r.i, r.p) for r in df.withColumn("p", F.last("v", ignorenulls=True).over(w)).collect()}
    got = {(r.i, r.c) for r in carry_forward(df, ["k"], "t", "v", "c", chunk_us=100).collect()}
    assert got == want


def test_running_counts(spark):
    rnd = random.Random(4)
    rows = list({(rnd.choice("aab"), rnd.randrange(1000)): None for _ in range(500)})
    df = spark.createDataFrame([(k, o, 1 + o % 3) for k, o in rows], "k string, o long, n long")
    w = W.partitionBy("k").orderBy("o").rowsBetween(W.unboundedPreceding, -1)
    want = {(r.k, r.o, r.b or 0) for r in df.withColumn("b", F.sum("n").over(w)).collect()}
    assert {(r.k, r.o, r.before_n) for r in running_counts(df, ["k"], "o", ["n"]).collect()} == want


def test_vector_expressions_work_out_lengths_and_products_once(spark):
    """Plans that name a length or a product inside another lambda do work that grows with the square of the dimensions or classes."""
    from pyspark.sql import functions as F

    from camtrail.functions import vectors

    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "id int, v array<double>")
    unit = rows.select("id", vectors.unit(F.col("v")).alias("u"))
    assert [r["u"] for r in unit.orderBy("id").collect()] == [[0.6, 0.8], [0.0, 0.0], None]
    nearest = "array(struct('b' as name, array(1D, 1D) as vec), struct('a' as name, array(1D, 1D) as vec), struct('c' as name, array(-1D, 0D) as vec), struct('n' as name, cast(null as array<double>) as vec))"
    best = rows.select("id", vectors.nearest_class(F.col("v"), F.expr(nearest)).alias("b")).orderBy("id").collect()
    assert [(r["b"]["score"], r["b"]["name"]) for r in best] == [(7.0, "a"), (0.0, "a"), (None, None)]
    text = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert text(unit).count("aggregate(") <= 1
    assert text(rows.select(vectors.nearest_class(F.col("v"), F.expr(nearest)).alias("b"))).count("aggregate(") <= 1


def test_next_at_or_after_carries_one_value_on(spark):
    """A frame that ends at the last row is scanned anew for every row, so its cost is the square of a range's rows."""
    from camtrail.scale import next_at_or_after

    rnd = random.Random(5)
    marks = sorted({(rnd.choice("aab"), rnd.randrange(4000)) for _ in range(400)})
    probes = sorted({(rnd.choice("abc"), rnd.randrange(4100)) for _ in range(400)})
    found = next_at_or_after(spark.createDataFrame(probes, "k string, t long"), spark.createDataFrame(marks, "k string, m long"), ["k"], "t", "m", "n")
    want = {(k, t, min((m for j, m in marks if j == k and m >= t), default=None)) for k, t in probes}
    assert {tuple(r) for r in found.collect()} == want
    assert "unboundedfollowing" not in found._jdf.queryExecution().analyzed().toString().lower()
