"""Folders for tables that a job writes for itself."""

from __future__ import annotations

import tempfile
import uuid


def scratch(spark, name: str) -> str:
    """A fresh folder in the one named by spark.checkpoint.dir; where the setting is unset, a local master gets a temporary one, a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-attesta-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/attesta-{uuid.uuid4().hex}/{name}"
