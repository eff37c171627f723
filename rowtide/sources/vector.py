"""Polygons of SVG files, by group label."""

from __future__ import annotations

import xml.etree.ElementTree as ElementTree
from xml.sax.saxutils import quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "path string, label string, polygon int, point int, x int, y int"


def parse_svg(text: str | bytes) -> list[tuple[str, int, int, int, int]]:
    """(label, number of the polygon, number of the point, x, y) of every polygon inside a labelled group."""
    out = []
    for group in ElementTree.fromstring(text).iter():
        label = group.get("label") if group.tag.rpartition("}")[2] == "g" else None
        if label is None:
            continue
        polygons = [e for e in group.iter() if e.tag.rpartition("}")[2] == "polygon"]
        for i, polygon in enumerate(polygons):
            numbers = [round(float(v)) for v in (polygon.get("points") or "").replace(",", " ").split()]
            out += [(label, i, j, x, y) for j, (x, y) in enumerate(zip(numbers[::2], numbers[1::2]))]
    return out


def read_svg(spark: SparkSession, path: str) -> DataFrame:
    """POINTS of all SVG files at a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.svg").load(path)

    def run(batches):
        for pdf in batches:
            rows = [(p, *r) for p, c in zip(pdf["path"], pdf["content"]) for r in parse_svg(c)]
            yield pd.DataFrame(rows, columns=["path", "label", "polygon", "point", "x", "y"])

    return files.select("path", "content").mapInPandas(run, POINTS)


def polygon_lists(points: DataFrame) -> DataFrame:
    """path, label and polygons: an array of arrays of (x, y)."""
    item = F.struct("point", "x", "y")
    polygons = points.groupBy("path", "label", "polygon").agg(F.transform(F.sort_array(F.collect_list(item)), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))
    return polygons.groupBy("path", "label").agg(F.transform(F.sort_array(F.collect_list(F.struct("polygon", "points"))), lambda p: p["points"]).alias("polygons"))


def svg_texts(points: DataFrame, height: int, width: int) -> DataFrame:
    """path and the text of an SVG file with a labelled group for each label."""
    corners = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("point", "x", "y"))), lambda p: F.concat(p["x"].cast("string"), F.lit(","), p["y"].cast("string"))), " ")
    polygons = points.groupBy("path", "label", "polygon").agg(F.concat(F.lit('<polygon points="'), corners, F.lit('"/>')).alias("e"))
    groups = polygons.groupBy("path", "label").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("polygon", "e"))), lambda p: p["e"]), "").alias("e"))
    quoted = F.concat(F.lit('"'), F.replace(F.replace(F.replace("label", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;")), F.lit('"'))
    labelled = groups.withColumn("g", F.concat(F.lit("<g label="), quoted, F.lit(">"), F.col("e"), F.lit("</g>")))
    head = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox={quoteattr(f"0 0 {width} {height}")}>'
    return labelled.groupBy("path").agg(F.concat(F.lit(head), F.array_join(F.sort_array(F.collect_list("g")), ""), F.lit("</svg>")).alias("text"))
