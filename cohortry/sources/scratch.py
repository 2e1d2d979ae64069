"""A place for tables that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors and the driver can reach.

    Where that setting is missing, a temporary folder takes its place, on a local master only.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = Path(tempfile.gettempdir(), "cohortry-scratch").as_uri()
    return f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"
