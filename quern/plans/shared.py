"""Where lineage is cut: tables written to the folder that all machines of the cluster share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only a single-machine session, as in tests, may go without the setting; it then gets a
    temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="quern-")
    return _OWN[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}/{label}"
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path).getParent()
    top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(top)
    if _SCOPES:
        _SCOPES[-1].append(top.toString())
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what ``new_path`` named within; nothing may read it any more by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            remove(spark, path)


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: a cut in the lineage that
    survives lost executors and that several consumers can read without computing it twice."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete what ``new_path`` named, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
