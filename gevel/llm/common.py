"""Helpers shared by the text operators: byte-level words, Arrow maps, lineage cuts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gevel.session import scratch_dir

#: A-Z to a-z on UTF-8 bytes.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: As LOWER, and every byte that is no ASCII letter, digit or part of a longer character to a blank.
ALNUM = bytes(
    b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)
#: Bytes of text that are cut into words at once.
PIECE = 1 << 22
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def word_chunks(text: bytes, table: bytes | None = None) -> Iterator[list[bytes]]:
    """The words of a text, blank-separated after ``table`` is applied, some megabytes at a time."""
    if len(text) <= PIECE:
        yield (text.translate(table) if table else text).split()
        return
    text = text.translate(table) if table else text
    at = 0
    while at < len(text):
        cut = _GAP.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        yield text[at:end].split()
        at = end


def utf8(column: pa.Array) -> list[bytes | None]:
    """Text cells as UTF-8 bytes, null as None."""
    return column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def map_arrow(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes, so that long texts do not add up."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    return df.mapInArrow(fn, schema)


#: Whether Spark removes a query's shuffle files as it ends.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write to the shared folder and read back; also the path, for ``forget``.

    Once the table is there nothing reads the shuffles that made it, so they go.
    """
    spark = df.sparkSession
    path, before = scratch_dir(spark, name), spark.conf.get(_TIDY)
    spark.conf.set(_TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_TIDY, before)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Remove a table this job wrote and will not read again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The names, lengthened until ``df`` has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def text_hash(text: str = "text") -> Column:
    """64-bit hash of a text, null like the empty one. With doc_id it names a document."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def fraction(seed: str, *columns: Column) -> Column:
    """A reproducible draw from [0, 1): the leading 52 bits of an MD5."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(seed), *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


#: Stands for a missing doc_id in join keys.
NO_ID = -(1 << 62)


def known_id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def same_doc(docs: DataFrame, keys: DataFrame) -> Column:
    """Whether rows are the same document: ``keys`` has ``k_id`` (may be null) and ``k_hash``."""
    hashed = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return (known_id(docs["doc_id"]) == known_id(keys["k_id"])) & (hashed == keys["k_hash"])
