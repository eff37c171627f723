"""Tables and files between jobs, in the folder all executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The URI of the session's ``spark.checkpoint.dir``; in local mode without one, a temporary folder.

    A cluster without the setting is an error: its executors do not see each other's disks.
    """
    context = spark.sparkContext
    if at := context.getConf().get("spark.checkpoint.dir"):
        return at.rstrip("/") + "/rowtide"
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="rowtide-") + "/rowtide"
        atexit.register(shutil.rmtree, _own[context.applicationId], ignore_errors=True)
    return "file://" + _own[context.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; ``clean`` deletes what was made there."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_forget_local)
    _made.append(path)
    return path


def clean(spark: SparkSession) -> None:
    """Delete all tables and files of this process in the shared folder; what still reads them fails afterwards."""
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _forget_local() -> None:
    """At the end of the process: what a local path or file URI names."""
    for path in _made:
        if path.startswith(("/", "file:")):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)


def release(spark: SparkSession) -> None:
    """Let Spark forget what belongs to finished jobs (broadcasts, plans) now instead of at its next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value):
    """The session with one setting changed for the time being."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield spark
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def write(df: DataFrame, path: str) -> None:
    """Write df as Parquet. Spark deletes the shuffle files of the job as soon as it ends: nothing reads them again."""
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)


def materialize(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there.

    ``small`` writes an eighth of the usual number of files, for tables that are a small part of the input.

    The table survives lost executors, its rows are computed once however many plans read them, and the
    shuffle files that made it go.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if small:
        df = df.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    write(df, path)
    if not small:
        release(spark)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the table in the shared folder that df, from ``materialize``, reads; nothing must read it afterwards."""
    found = {path.rpartition("/")[0].rpartition("/")[2] for path in df.inputFiles()}
    for path in [p for p in _made if p.rpartition("/")[2] in found]:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
        _made.remove(path)


def small_batches(spark: SparkSession, size: int = 4 << 20) -> SparkSession:
    """Bound the Arrow batches of the session: texts differ so much in length that a bound in rows is none."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return spark
