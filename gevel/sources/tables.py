"""Table files: read, write and publish."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from gevel.operators.lookup import require_unique


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A parquet table; pass ``schema`` to skip the look into a footer."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal out a table of fewer splits than cores, ahead of costly work per row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def write_table(df: DataFrame, path: str) -> None:
    """Replace the table at ``path``."""
    df.write.mode("overwrite").parquet(path)


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions below ``root``, oldest first."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        done = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("version=") and fs.exists(done):
            found.append(int(name.split("=")[1]))
    return sorted(found)


#: Hadoop's setting that has a job leave ``_SUCCESS`` in its folder.
MARKER = "mapreduce.fileoutputcommitter.marksuccessfuljobs"


class StaleVersion(RuntimeError):
    """A version that was overtaken while it was written."""


def publish(df: DataFrame, root: str, key: str | None = None) -> str:
    """Stage a new version of a table and make it the current one.

    Readers take the newest version with a commit marker, so the switch is one
    atomic step and a failed write leaves the current version in place. A writer that
    was overtaken by one with a higher number raises ``StaleVersion``: its version was
    made without knowing the newer one, and no reader will see it. The commit marker is
    written whatever the session says of markers, as readers go by it.
    """
    spark = df.sparkSession
    if key is not None:
        require_unique(df, key)
    version = (_versions(spark, root) or [0])[-1]
    while True:
        version += 1
        path = f"{root.rstrip('/')}/version={version}"
        try:
            df.write.mode("errorifexists").option(MARKER, "true").parquet(path)
        except AnalysisException as error:
            # Another writer has this number, or left it half done: take the next.
            if error.getCondition() != "PATH_ALREADY_EXISTS":
                raise
        else:
            # a listing may lag behind: one that does not show this version overtakes nothing
            newest = max(_versions(spark, root), default=version)
            if newest > version:
                raise StaleVersion(f"version {version} of {root} was overtaken by version {newest}")
            return path


@contextmanager
def reading(spark: SparkSession, root: str) -> Iterator[DataFrame]:
    """The current version, which ``prune`` leaves alone until the block ends.

    The hold is a file beside the versions, so that it counts for other sessions too.
    """
    fs, path = _files(spark, root)
    while True:
        version = _current(spark, root)
        hold = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/_readers/{version}/{uuid.uuid4().hex}")
        fs.create(hold, False).close()
        if exists(spark, f"{root.rstrip('/')}/version={version}/_SUCCESS"):
            break
        fs.delete(hold, False)  # pruned just before it was held: take the one there is now
    try:
        yield spark.read.parquet(f"{root.rstrip('/')}/version={version}")
    finally:
        fs.delete(hold, False)


def prune(spark: SparkSession, root: str) -> list[int]:
    """Remove versions older than the current one that nobody reads; returns their numbers."""
    fs, _ = _files(spark, root)
    gone = []
    for version in _versions(spark, root)[:-1]:
        held = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/_readers/{version}")
        if fs.exists(held) and len(fs.listStatus(held)) > 0:
            continue
        at = f"{root.rstrip('/')}/version={version}"
        # without its marker a version does not count, so that none is seen half removed
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS"), False)
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(at), True)
        gone.append(version)
    return gone


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _current(spark: SparkSession, root: str) -> int:
    versions = _versions(spark, root)
    if not versions:
        raise FileNotFoundError(f"nothing published at {root}")
    return versions[-1]


def read_published(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/version={_current(spark, root)}")


def write_csv(df: DataFrame, path: str) -> None:
    """Result tables (statistics, scores, labels, predictions) as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)
