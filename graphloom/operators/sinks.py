"""Sinks: standard output, one file, or a directory of part files."""

from __future__ import annotations

import os
import re
import sys
import uuid
from pathlib import Path
from typing import TextIO

from pyspark.sql import DataFrame

from ..errors import SinkError


def _drain(lines: DataFrame, out: TextIO) -> None:
    # one partition at a time is held by the driver
    for row in lines.toLocalIterator(prefetchPartitions=True):
        out.write(row[0] + "\n")
    out.flush()


def to_stdout(lines: DataFrame) -> None:
    _drain(lines, sys.stdout)


def to_file(lines: DataFrame, path: str) -> None:
    """A path that ends in ``/`` is a directory of parts; another is one file on any file system that Spark knows.

    Executors write the parts beside it, and their bytes are put together in order by the
    driver, one buffer at a time; the file is put in place once it is whole.
    """
    if path.endswith("/"):
        lines.write.mode("overwrite").text(path)
        return
    spark = lines.sparkSession
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path):
        path = Path(os.path.abspath(path)).as_uri()
    own = f"{path}.{uuid.uuid4().hex}"
    parts, whole, target = hadoop.fs.Path(f"{own}.parts"), hadoop.fs.Path(f"{own}.part"), hadoop.fs.Path(path)
    files = hadoop.fs.FileSystem.newInstance(target.toUri(), conf)
    files.setWriteChecksum(False)
    try:
        lines.write.text(parts.toString())
        out = files.create(whole)
        for at in sorted(str(f.getPath()) for f in files.listStatus(parts) if f.getPath().getName().startswith("part-")):
            held = files.open(hadoop.fs.Path(at))
            hadoop.io.IOUtils.copyBytes(held, out, 1 << 20, False)
            held.close()
        out.close()
        files.delete(target, False)
        if not files.rename(whole, target):
            raise SinkError(f"{path} can't be put in place")
    finally:
        files.delete(parts, True)
        files.delete(whole, False)
        files.close()
