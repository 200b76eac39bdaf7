"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than these six ASCII blanks.
BLANKS = " \\t\\n\\x0B\\f\\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> str:
    """A column's name quoted for SQL, whatever characters it has."""
    return "`" + column.replace("`", "``") + "`"


def nested(df: DataFrame, *more: F.Column) -> DataFrame:
    """``df`` as one struct column ``row``, out of reach of internal names, with ``more`` beside it."""
    return df.select(F.struct(*[F.col(named(c)) for c in df.columns]).alias("row"), *more)


def unnested(inner: DataFrame, df: DataFrame, **outputs: F.Column) -> DataFrame:
    """The columns of ``df`` out of ``row``, then ``outputs``.

    An input column called like an output (whatever the case) gets underscores
    appended until its name is free, so nothing is lost and nothing is ambiguous.
    """
    taken = {x.lower() for x in outputs}
    own = []
    for c in df.columns:
        name = c
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        own.append(F.col("row").getField(c).alias(name))
    return inner.select(*own, *[column.alias(name) for name, column in outputs.items()])


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as an URI."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="specloom-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, its lineage cut.

    The folder is the session's ``spark.checkpoint.dir``. Only under a local
    master a temporary folder takes its place where that is unset; elsewhere
    that is an error. ``spark.cleaner.referenceTracking.cleanCheckpoints``
    lets Spark delete what is no longer referenced.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that this package has written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def utf8(column: str = "text") -> F.Column:
    """The bytes of a text, empty for null; workers then need not encode it."""
    return F.coalesce(F.col(named(column)).cast("string"), F.lit("")).cast("binary")


def crc_bucket(column: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo ``modulus``; null where the id is null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def release() -> None:
    """At a task's end: returns what a reused Python worker no longer needs.

    Workers outlive tasks, so the tables of one stage would otherwise add to
    those of the next.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)
