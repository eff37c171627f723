"""WAV files as rows of samples: read from binary files, written one file for each sound."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sample widths in bytes and their types; 8-bit samples are unsigned with the zero at 128.
_KINDS = {1: "u1", 2: "<i2", 4: "<i4"}
SAMPLES = "path string, rate int, t long, channel int, sample float"


def decode(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and float32 samples, shape (n, channels), of a WAV file of 8, 16 or 32 bits; integers keep their values."""
    with wave.open(io.BytesIO(data)) as f:
        width, channels = f.getsampwidth(), f.getnchannels()
        if channels > 2:
            raise ValueError("at most two channels")
        if width not in _KINDS:
            raise ValueError(f"samples of {8 * width} bits are not supported")
        raw = np.frombuffer(f.readframes(f.getnframes()), dtype=_KINDS[width]).reshape(-1, channels)
        return f.getframerate(), raw.astype(np.float32) - (128 if width == 1 else 0)


def encode(samples: np.ndarray, rate: int = 44_100, width: int = 2) -> bytes:
    """A WAV file of samples, shape (n,) or (n, channels) with up to two channels, rounded to integers of a width."""
    samples = samples.reshape(len(samples), -1)
    if samples.shape[1] > 2:
        raise ValueError("at most two channels")
    info = np.iinfo(np.dtype(_KINDS[width]))
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(samples.shape[1]), f.setsampwidth(width), f.setframerate(rate)
        f.writeframes(np.clip(np.rint(samples) + (128 if width == 1 else 0), info.min, info.max).astype(_KINDS[width]).tobytes())
    return out.getvalue()


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """(path, rate, t, channel, sample) of all WAV files at a path; one file is one task's work."""
    return wav_samples(spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path))


def wav_samples(files: DataFrame) -> DataFrame:
    """The samples of a table (path, content)."""

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                rate, samples = decode(content)
                n, channels = samples.shape
                for a in range(0, n, 1 << 18):
                    part = samples[a : a + (1 << 18)]
                    yield pd.DataFrame({"path": path, "rate": rate, "t": np.repeat(np.arange(a, a + len(part)), channels), "channel": np.tile(np.arange(channels, dtype=np.int32), len(part)), "sample": part.reshape(-1)})

    return files.select("path", "content").mapInPandas(run, SAMPLES)


def wav_files(samples: DataFrame, key: str = "path", rate: int = 44_100, width: int = 2) -> DataFrame:
    """(key, content): a WAV file for each key of a table of samples (t, channel, sample); a sound must fit in memory."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = pdf.pivot(index="t", columns="channel", values="sample").sort_index()
        return pd.DataFrame({key: [pdf[key].iloc[0]], "content": [encode(grid.to_numpy(), rate, width)]})

    kind = samples.schema[key].dataType.simpleString()
    return samples.groupBy(key).applyInPandas(run, f"{key} {kind}, content binary")


def durations(samples: DataFrame) -> DataFrame:
    """path and the interval each sound takes."""
    n = samples.where("channel = 0").groupBy("path", "rate").agg(F.count("*").alias("n"))
    return n.select("path", F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("n") / F.col("rate")).cast("decimal(18,6)")).alias("duration"))


def blocks(df: DataFrame, size: int, order_by: str, value: str) -> DataFrame:
    """Blocks of a size, the last filled with zeros: block, pos and value; padding comes from the count alone."""
    n = df.count()
    from rowtide.operators.sequence import ichunked

    rows = ichunked(df, size, order_by, value).withColumnRenamed("chunk", "block")
    kind = df.schema[value].dataType
    padding = df.sparkSession.range(n, -(-n // size) * size).select(F.expr(f"id div {size}").alias("block"), (F.col("id") % size).alias("pos"), F.lit(0).cast(kind).alias(value))
    return rows.unionByName(padding)
