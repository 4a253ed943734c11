"""Folders for files that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


@atexit.register
def _clean() -> None:
    for path in _own:
        shutil.rmtree(path, ignore_errors=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir. A local session may lack the setting; a cluster may not."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="loomline-"))
        root = f"file://{_own[0]}"
    return f"{root.rstrip('/')}/loomline-{name}-{uuid.uuid4().hex}"
