"""Colours of crops from pixel tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from camtrail.functions import vocabulary as V


def name_pixels(pixels: DataFrame, out: str = "color") -> DataFrame:
    """Add the colour name of every 8-bit Lab pixel: neutral rules first, else the nearest centre.

    The distances are one array in a projection of its own: each is computed
    once, and the generated method stays under the 8000 bytes of bytecode beyond
    which the JVM would only interpret it.
    """
    L, a, b = F.col("L"), F.col("a"), F.col("b")
    chroma = F.sqrt((a - 128.0) * (a - 128.0) + (b - 128.0) * (b - 128.0))
    distances = [
        0.5 * (L - cl) * (L - cl) + 1.2 * (a - ca) * (a - ca) + 1.2 * (b - cb) * (b - cb) for _, cl, ca, cb in V.LAB_CENTRES
    ]
    rows = pixels.select("*", chroma.alias("_c"), F.array(*distances).alias("_d"))
    # The first of equally near centres wins.
    order = F.array_position("_d", F.array_min("_d")).cast("int")
    nearest = F.element_at(F.array(*[F.lit(name) for name, *_ in V.LAB_CENTRES]), order)
    c = F.col("_c")
    name = (
        F.when((L < 45) & (c < 35), "black")
        .when((L > 225) & (c < 25), "white")
        .when((c < 18) & (L < 50), "black")
        .when((c < 18) & (L < 165), "grey")
        .when((c < 18) & (L < 220), "silver")
        .when(c < 18, "white")
        .when(L < 35, "black")
        .otherwise(nearest)
    )
    return rows.select(*pixels.columns, name.alias(out))


def hsv_name(h: Column, s: Column, v: Column) -> Column:
    """Colour name and confidence of a mean HSV: STRUCT<color, conf>."""

    def out(name: str, conf: Column) -> Column:
        return F.struct(F.lit(name).alias("color"), F.round(conf, 2).alias("conf"))

    one = F.lit(1.0)
    return (
        F.when(v < 48, out("black", F.least(one, (48 - v) / 30.0 + 0.6)))
        .when((s < 42) & (v > 165), out("white", F.least(one, (v - 165) / 50.0 + 0.6)))
        .when(s < 42, out("silver/gray", F.lit(0.75)))
        .when((h < 11) | (h > 168), out("red", F.lit(0.85)))
        .when(h < 26, out("orange", F.lit(0.80)))
        .when(h < 35, out("yellow", F.lit(0.85)))
        .when(h < 85, out("green", F.lit(0.85)))
        .when(h < 132, out("blue", F.lit(0.85)))
        .otherwise(out("purple", F.lit(0.75)))
    )


def centre(pixels: DataFrame, ratio: float) -> DataFrame:
    """Pixels of the central part of each crop; expects x, y, width, height."""
    low, high = (1.0 - ratio) / 2.0, (1.0 + ratio) / 2.0

    def inside(at: str, size: str) -> Column:
        return (F.col(at) >= F.floor(F.col(size) * low)) & (F.col(at) < F.floor(F.col(size) * high))

    return pixels.filter(inside("x", "width") & inside("y", "height"))


def dominant(pixels: DataFrame, keys: Sequence[str] = ("crop_id",), top: int = 2) -> DataFrame:
    """Top colours of each crop by share of pixels: (keys, rank, color, fraction).

    Pixels collapse to at most a dozen colours per crop before the first
    shuffle, so a crop with very many pixels costs no more than any other.
    """
    named = name_pixels(pixels.select(*keys, "L", "a", "b")).groupBy(*keys, "color").agg(F.count(F.lit(1)).alias("n"))
    each = W.partitionBy(*keys)
    share = F.round(F.col("n") / F.sum("n").over(each), 3)
    rank = F.row_number().over(each.orderBy(F.desc("n"), "color"))
    return named.select(*keys, rank.alias("rank"), "color", share.alias("fraction")).filter(F.col("rank") <= top)


def with_parts(pixels: DataFrame) -> DataFrame:
    """Part of each pixel: upper or lower body for persons, else vehicle or object."""
    upper = F.col("y") < F.greatest(F.lit(1), F.floor(F.col("height") * 0.5))
    part = (
        F.when((F.col("grp") == "person") & upper, "person_upper")
        .when(F.col("grp") == "person", "person_lower")
        .when(F.col("grp") == "vehicle", "vehicle")
        .otherwise("object")
    )
    return pixels.withColumn("part", part)


def part_colours(pixels: DataFrame, key: str = "crop_id") -> DataFrame:
    """Colours of a crop as {part: [{color, fraction}]} JSON."""
    tops = dominant(with_parts(pixels), (key, "part"))
    entry = F.struct("rank", F.struct("color", "fraction").alias("c"))
    parts = tops.groupBy(key, "part").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["c"]).alias("colors")
    )
    merged = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("part", "colors"))).alias("p"))
    return merged.select(key, F.to_json(F.map_from_entries("p")).alias("colors"))


def mean_hsv_colour(pixels: DataFrame, key: str = "crop_id") -> DataFrame:
    """Dominant colour of the central 60% of each crop by its mean HSV."""
    means = centre(pixels, 0.6).groupBy(key).agg(F.avg("h").alias("h"), F.avg("s").alias("s"), F.avg("v").alias("v"))
    name = hsv_name(F.round("h", 6), F.round("s", 6), F.round("v", 6))
    return means.select(key, name.alias("c")).select(key, "c.color", "c.conf")


def chromatic(tops: DataFrame, key: str = "crop_id", min_fraction: float = 0.5) -> DataFrame:
    """Colour to show live: the top colour if it is chromatic and fills more than ``min_fraction``."""
    return tops.filter(
        (F.col("rank") == 1) & (F.col("fraction") > min_fraction) & F.col("color").isin(V.CHROMATIC)
    ).select(key, "color", "fraction")


