"""Rasters as rows (id, y, x, value ...): histogram hashes, nearest resizing and rotation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket(value: Column | str, bins: int = 4, top: float = 256.0) -> Column:
    """The bin, from 0, of a value in [0, top); values outside go to the nearest bin."""
    value = F.col(value) if isinstance(value, str) else value
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(value * F.lit(float(bins) / top)).cast("int")))


def histogram_hash(pixels: DataFrame, key: str, *channels: str, bins: int = 4, top: float = 256.0) -> DataFrame:
    """The joint histogram of channels of each image, scaled to length 1: key, cell and weight, empty cells left out."""
    cell = F.lit(0)
    for c in channels:
        cell = cell * bins + bucket(c, bins, top)
    counts = pixels.groupBy(key, cell.cast("int").alias("cell")).agg(F.count("*").alias("n"))
    norms = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norms, key).select(key, "cell", (F.col("n") / F.col("norm")).alias("weight"))


def similarity_to(hashes: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """The dot product of each query's hash with every other image's: query, key and similarity; a stated set of
    queries against all. Images that share no cell with a query are not there (their similarity is 0)."""
    own = queries.select(F.col(key).alias("query"), "cell", F.col("weight").alias("w"))
    return hashes.join(own, "cell").groupBy("query", key).agg(F.sum(F.col("weight") * F.col("w")).alias("similarity"))


def resize_nearest(pixels: DataFrame, height: int, width: int, new_height: int, new_width: int, key: str = "id") -> DataFrame:
    """Pixels (key, y, x, value) of another size: each new pixel is the old one under its upper left corner. Each
    old pixel is repeated as often as it is wanted, so nothing is joined."""
    rows = F.expr(f"sequence(cast(ceil(y * {new_height} / {height}) as int), cast(ceil((y + 1) * {new_height} / {height}) as int) - 1)")
    columns = F.expr(f"sequence(cast(ceil(x * {new_width} / {width}) as int), cast(ceil((x + 1) * {new_width} / {width}) as int) - 1)")
    wanted_rows = F.when(F.expr(f"ceil((y + 1) * {new_height} / {height}) > ceil(y * {new_height} / {height})"), rows)
    wanted_columns = F.when(F.expr(f"ceil((x + 1) * {new_width} / {width}) > ceil(x * {new_width} / {width})"), columns)
    return pixels.withColumn("__y", F.explode(wanted_rows)).withColumn("__x", F.explode(wanted_columns)).select(key, F.col("__y").cast("int").alias("y"), F.col("__x").cast("int").alias("x"), "value")


def rotate_nearest(pixels: DataFrame, size: int, degrees: float, key: str = "id") -> DataFrame:
    """Square images turned about their centre, counterclockwise; new pixels from outside the image are left out."""
    c, s, mid = math.cos(math.radians(degrees)), math.sin(math.radians(degrees)), (size - 1) / 2
    targets = {}
    for y in range(size):
        for x in range(size):
            sx, sy = c * (x - mid) - s * (y - mid) + mid, s * (x - mid) + c * (y - mid) + mid
            source = (math.floor(round(sy, 9) + 0.5), math.floor(round(sx, 9) + 0.5))
            targets.setdefault(source, []).append((y, x))
    spark = pixels.sparkSession
    plan = spark.createDataFrame([(sy, sx, y, x) for (sy, sx), new in targets.items() if 0 <= sy < size and 0 <= sx < size for y, x in new], "sy int, sx int, ny int, nx int")
    return pixels.join(F.broadcast(plan), (F.col("y") == F.col("sy")) & (F.col("x") == F.col("sx"))).select(key, F.col("ny").alias("y"), F.col("nx").alias("x"), "value")


def resize_labels(pixels: DataFrame, height: int, width: int, new_height: int, new_width: int, key: str = "id") -> DataFrame:
    """A label raster of a smaller size: the most frequent label under each new pixel, the least of equal ones."""
    cells = pixels.select(key, F.expr(f"cast(floor(y * {new_height} / {height}) as int)").alias("y"), F.expr(f"cast(floor(x * {new_width} / {width}) as int)").alias("x"), "value")
    votes = cells.groupBy(key, "y", "x", "value").agg(F.count("*").alias("n"))
    return votes.groupBy(key, "y", "x").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))


def to_u8(value: Column | str) -> Column:
    """A level in [0, 1] as an integer in [0, 255]; others are clipped."""
    value = F.col(value) if isinstance(value, str) else value
    return F.least(F.greatest(value * 255, F.lit(0)), F.lit(255)).cast("int")


def hsv_colors(spark, count: int) -> DataFrame:
    """``count`` evenly spaced hues as style texts."""
    return spark.range(count).select(F.col("id").alias("i"), F.concat(F.lit("hsl("), F.floor(F.col("id") * 360 / count).cast("string"), F.lit(",100%,50%)")).alias("color"))


def to_rgb(value: Column | str) -> Column:
    """A grey level as r, g and b."""
    value = F.col(value) if isinstance(value, str) else value
    return F.struct(value.alias("r"), value.alias("g"), value.alias("b"))


def _spread(pixels: DataFrame, key: str, rows: Column, columns: Column) -> DataFrame:
    """New pixels as means of old ones: each old pixel goes to the new places it has a weight at, and no table of
    places is joined."""
    out = pixels.select(key, "value", F.explode(rows).alias("r"), columns.alias("cs")).select(key, "value", "r", F.explode("cs").alias("c"))
    weight = F.col("r.w") * F.col("c.w")
    means = out.groupBy(key, F.col("r.i").alias("y"), F.col("c.i").alias("x")).agg((F.sum(weight * F.col("value")) / F.sum(weight)).alias("value"))
    return means.select(key, "y", "x", "value")


def _places(low: Column, high: Column, size: int, weight) -> Column:
    """Places (i, w) from low to high, kept inside an axis, where the weight is above zero."""
    span = F.sequence(F.greatest(low, F.lit(0)).cast("int"), F.least(high, F.lit(size - 1)).cast("int"))
    return F.filter(F.transform(span, lambda i: F.struct(i.alias("i"), weight(i).alias("w"))), lambda p: p["w"] > 0)


def resize_area(pixels: DataFrame, height: int, width: int, new_height: int, new_width: int, key: str = "id") -> DataFrame:
    """Pixels of another size: each new one is the mean of the old ones under it, weighted by shared area. Null
    values have no part in it."""

    def axis(at: Column, size: int, new: int) -> Column:
        # both axes are cut into size * new equal steps, so that shares are whole numbers
        overlap = lambda i: F.least((at + 1) * new, (i + 1) * size) - F.greatest(at * new, i * size)
        return _places(F.floor(at * new / size), F.ceil((at + 1) * new / size) - 1, new, overlap)

    return _spread(pixels.where("value is not null"), key, axis(F.col("y"), height, new_height), axis(F.col("x"), width, new_width))


def resize_linear(pixels: DataFrame, height: int, width: int, new_height: int, new_width: int, key: str = "id") -> DataFrame:
    """Pixels of another size by linear interpolation between pixel centres; beyond the outer centres the border's
    values go on. Null values have no part in it."""

    def axis(at: Column, size: int, new: int) -> Column:
        ratio = size / new
        low = F.when(at == 0, 0).otherwise(F.floor((at - 0.5) / ratio - 0.5))
        high = F.when(at == size - 1, new - 1).otherwise(F.ceil((at + 1.5) / ratio - 0.5))
        source = lambda i: F.greatest(F.lit(0.0), F.least(F.lit(size - 1.0), (i + 0.5) * ratio - 0.5))
        return _places(low, high, new, lambda i: 1 - F.abs(source(i) - at))

    return _spread(pixels.where("value is not null"), key, axis(F.col("y"), height, new_height), axis(F.col("x"), width, new_width))
