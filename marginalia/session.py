"""Spark session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: list[str] = []


def build_session(app: str = "marginalia", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on; anything else is the cluster's choice."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's shared folder, ``spark.checkpoint.dir``.

    A session without that setting gets a temporary folder only where the driver is the one executor (local mode, as in tests);
    on a cluster a folder of one machine would lose rows, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    folder = os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")
    _FOLDERS.append(folder)
    return folder


def scratch_folders() -> list[str]:
    """Folders made so far and not dropped."""
    return list(_FOLDERS)


def drop_scratch(spark: SparkSession, folders: list[str]) -> None:
    """Delete scratch folders whose rows nobody reads any more, in whatever store they are."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if folder in _FOLDERS:
            _FOLDERS.remove(folder)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows read back from a table in the shared folder, for plans that use them several times."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
