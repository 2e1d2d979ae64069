"""What the operators share: word pattern, the shared folder, shipping the package to executors."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word: a run of characters that are none of space, tab, line feed, VT, FF, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
# Python workers get texts in batches of at most this many rows and bytes.
BATCH_ROWS = "1000"
BATCH_BYTES = "4m"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def whole(text: str | Column = "text") -> Column:
    """The text, NULL read as empty."""
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def crc_remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the decimal text of an id, modulo ``divisor``; a NULL id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def prepare(spark: SparkSession) -> None:
    """Makes this package importable on executors and bounds the batches that Python workers get.

    The batch limits hold for the session; they are not results, and a limit that the user has set
    stays.
    """
    limits = {"maxRecordsPerBatch": BATCH_ROWS, "maxBytesPerBatch": BATCH_BYTES}
    for key, most in limits.items():
        name = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, most)
    context = spark.sparkContext
    if getattr(context, "_cohortry_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="cohortry-"), "cohortry_package.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, path.relative_to(package.parent))
    context.addPyFile(target)
    context._cohortry_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors and the driver can reach.

    Where that setting is missing, as in local tests, a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = Path(tempfile.gettempdir(), "cohortry-shared").as_uri()
    return f"{base.rstrip('/')}/cohortry-{uuid.uuid4().hex}"


def stored(frame: DataFrame, folder: str, name: str) -> DataFrame:
    """The frame written as Parquet in a shared folder and read again: its lineage ends there."""
    path = f"{folder}/{name}"
    frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


@contextmanager
def no_collection() -> Iterator[None]:
    """Python's search for cycles stops meanwhile: it would walk all remembered strings, again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def lean(batches: Iterator) -> Iterator:
    """The same batches; after each one Arrow's memory pool gives back what it has no use for. Else a worker keeps
    it for its whole life, through the stages of others."""
    pool = pa.default_memory_pool()
    for batch in batches:
        yield batch
        del batch
        pool.release_unused()


def release(spark: SparkSession) -> None:
    """Lets go of finished steps: once the driver's JVM has collected its garbage, Spark deletes
    their shuffle files on all executors. For operators of several large steps."""
    spark.sparkContext._jvm.System.gc()
