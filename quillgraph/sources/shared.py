"""Tables in the folder that driver and executors share, which cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_noted: ContextVar[tuple[list[str], ...]] = ContextVar("noted", default=())


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``. A folder of our own is made only where all run in one process; elsewhere it must be set."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("spark.checkpoint.dir", root)
    folder = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for noted in _noted.get():
        noted.append(folder)
    return folder


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Delete the folders that are named within, once what needs them is done."""
    noted: list[str] = []
    token = _noted.set((*_noted.get(), noted))
    try:
        yield
    finally:
        _noted.reset(token)
        for folder in noted:
            remove(spark, folder)


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(df: DataFrame, name: str) -> DataFrame:
    """df computed now, and read from the shared folder from here on, however often it is used."""
    return written(df, shared_dir(df.sparkSession, name))


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
