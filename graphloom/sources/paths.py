"""Path resolution on any file system that Spark knows."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

from ..errors import SourceError


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def find(spark: SparkSession, path: str, working_dir: str | None) -> str:
    """``path`` if it exists, else the same below ``working_dir``; local relative paths become absolute."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path):
        tries = [path]
    else:
        tries = [os.path.abspath(path)]
        if working_dir:
            local = not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", working_dir)
            tries.append(os.path.abspath(os.path.join(working_dir, path)) if local else f"{working_dir.rstrip('/')}/{path}")
    for t in tries:
        if exists(spark, t if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", t) else f"file://{t}"):
            return t
    raise SourceError(f"File not found: {path}")


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that executors share; in local mode without one, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise SourceError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"file://{tempfile.mkdtemp()}"
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"
