"""Queries of the file sources, on files made from tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rowtide.plans.registry import query, table
from rowtide.sources import sound, vector
from rowtide.streaming.runner import shared_dir


@query("select user_id, t, channel, cast(round_even(value, 0) as bigint) as sample from (select user_id, row_number() over (partition by user_id order by event_id) - 1 as t, value from events), range(2) c(channel)")
def sound_round_trip(spark, sf_dir):
    from pyspark.sql import Window

    t = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    events = table(spark, sf_dir, "events", "event_id", "user_id", "value").withColumn("t", t)
    samples = events.withColumn("channel", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("sample", F.col("value").cast("float"))
    files = sound.wav_files(samples.select("user_id", "t", "channel", "sample"), "user_id").select(F.col("user_id").cast("string").alias("path"), "content")
    back = sound.wav_samples(files)
    return back.select(F.col("path").cast("long").alias("user_id"), "t", F.col("channel").cast("long").alias("channel"), F.col("sample").cast("long").alias("sample"))


@query("select block, pos, cast(v as bigint) as v from (select (r - 1) // 64 as block, (r - 1) % 64 as pos, c_custkey as v from (select c_custkey, row_number() over (order by c_custkey) as r from customer)) union all select i // 64, i % 64, 0 from (select unnest(range(n, cast(ceil(n / 64.0) as bigint) * 64)) as i from (select count(*) as n from customer))")
def sound_blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "customer", "c_custkey").withColumn("v", F.col("c_custkey"))
    return sound.blocks(rows, 64, "c_custkey", "v")


@query("select n_name as label, 0::bigint as polygon, p as point, cast(n_nationkey * 10 + p as bigint) as x, cast(n_regionkey * 7 + p * p as bigint) as y from nation, range(4) r(p)")
def svg_round_trip(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(3))))
    points = nation.select(F.lit("map").alias("path"), F.col("n_name").alias("label"), F.lit(0).alias("polygon"), "point", (F.col("n_nationkey") * 10 + F.col("point")).alias("x"), (F.col("n_regionkey") * 7 + F.col("point") * F.col("point")).alias("y"))
    texts = vector.svg_texts(points, 100, 300)
    folder = f"{shared_dir(spark)}/svg-{uuid.uuid4().hex}"
    texts.select("text").coalesce(1).write.text(folder)
    back = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").cast("binary").alias("content"))
    import pandas as pd

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(p, *r) for p, c in zip(pdf["path"], pdf["content"]) for r in vector.parse_svg(c)], columns=["path", "label", "polygon", "point", "x", "y"])

    found = back.mapInPandas(run, vector.POINTS)
    return found.select("label", *[F.col(c).cast("long").alias(c) for c in ("polygon", "point", "x", "y")])
