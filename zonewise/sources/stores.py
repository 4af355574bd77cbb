"""Files reached from Python tasks, through Arrow's file systems: local ones, HDFS and the usual object stores."""

from __future__ import annotations

from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import SparkSession

_SCHEMES = ("file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss")


def full(spark: SparkSession, path: str) -> str:
    """The path with its scheme and authority, as Spark's file systems name it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def reachable(spark: SparkSession, path: str) -> bool:
    """Does Arrow know the file system of the path?"""
    return full(spark, path).split(":", 1)[0] in _SCHEMES


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and place in it of a full path."""
    scheme, rest = uri.split(":", 1)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(quote(f"{'s3' if scheme == 's3a' else scheme}:{rest}", safe=":/@=+,;"))
