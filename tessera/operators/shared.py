"""Tables written to the folder that all executors share, to cut lineage and to be read more than once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class NoSharedFolder(RuntimeError):
    """spark.checkpoint.dir is not set, and this is no local session."""


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder of our own only in a local session (tests), where one machine is all there is."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, name: str) -> DataFrame:
    """rows, written as Parquet and read again."""
    path = fresh_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
