"""Storage that all executors share, for results that are read more than once."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: For folders of files: no checksum file beside each file. Where Hadoop has no native library it starts a process for every file
#: and folder made, to set its mode, and until that process is under way it shows the whole memory of the executor a second time.
_PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}

#: Folders written within each open ``scratch``, the innermost last.
_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where the session names none, a temporary one on a local master and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cipherlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back: cuts lineage and survives lost executors.

    Within a ``scratch`` the folder goes at its end, unless it is to be kept.
    """
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    if _SCOPES and not keep:
        _SCOPES[-1].append(path)
    df.write.options(**(_PLAIN_FILES if path.startswith("file:") else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Removes what ``materialise`` writes within, at its end; a result that reads it must be written by then. Yields the folders."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield paths
    finally:
        _SCOPES[:] = [s for s in _SCOPES if s is not paths]
        for path in paths:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
