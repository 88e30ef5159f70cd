"""A folder for what a query stores on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path on storage that driver and executors share: below ``spark.checkpoint.dir``.

    On one machine alone, where that is unset, a temporary folder will do.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to storage that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tractwise-')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
