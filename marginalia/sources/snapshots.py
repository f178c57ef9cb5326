"""Tables published as numbered snapshots: readers follow the highest entry of a log and never see a gap.

A table is a folder with ``data/<id>`` per snapshot and an empty file ``log/<number>.<id>`` per published one. Data are written first, one file
name publishes them, and older snapshots go last, so a crash between any two steps leaves the last published rows readable. One writer
at a time; what a crashed one left behind goes with the next publication.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Snapshots that stay, for readers that began before the last publication.
KEEP = 2


def store(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no folder."""
    place, fs = store(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    place, fs = store(spark, path)
    fs.delete(place, True)


def entries(spark: SparkSession, path: str) -> list[tuple[int, str, str]]:
    """(number, id, log name) of the published snapshots, oldest first."""
    names = [n for n in children(spark, f"{path}/log") if n.count(".") == 1 and n.split(".")[0].isdigit()]
    return [(int(n.split(".")[0]), n.split(".")[1], n) for n in names]


def _commit(spark: SparkSession, path: str, number: int, folder: str) -> None:
    place, fs = store(spark, f"{path}/log/{number:020d}.{folder}")
    fs.create(place, False).close()


def _tidy(spark: SparkSession, path: str, keep: int) -> None:
    known = entries(spark, path)
    for _, _, name in known[:-keep]:
        remove(spark, f"{path}/log/{name}")
    stay = {folder for _, folder, _ in known[-keep:]}
    for folder in children(spark, f"{path}/data"):
        if folder not in stay:
            remove(spark, f"{path}/data/{folder}")


def publish(df: DataFrame, path: str, keep: int = KEEP) -> int:
    """Publish the rows as the table's next snapshot and return its number (from 1)."""
    spark, path = df.sparkSession, path.rstrip("/")
    folder = uuid.uuid4().hex
    df.write.parquet(f"{path}/data/{folder}")
    number = (entries(spark, path) or [(0, "", "")])[-1][0] + 1
    _commit(spark, path, number, folder)
    _tidy(spark, path, keep)
    return number


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the last snapshot; none if nothing was published."""
    known = entries(spark, path.rstrip("/"))
    if not known:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/data/{known[-1][1]}")
