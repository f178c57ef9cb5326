"""Incremental chat and manifest tables with Structured Streaming.

The aggregates are the batch operators of ``operators.chat`` and ``operators.crawl``; here they
run on file streams with an ``availableNow`` trigger, so a run ends when its input is consumed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import crawl
from marginalia.sources import snapshots

#: Micro-batches whose rows wait beside the table before they are folded into it.
FOLD = 16


def table_stream(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """Parquet folder as a stream, a file per micro-batch, with the schema of the files already there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", 1).parquet(path)


def landed(df: DataFrame, folder: str, order: str, parts: int = 3) -> None:
    """Add the rows to a landing folder as several files by ``order``, as a producer would over time."""
    df.repartitionByRange(parts, order).write.mode("append").parquet(f"{folder}/landing.parquet")


def _deltas(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the micro-batches whose rows are not folded into the table yet."""
    return sorted(int(n.split("=")[1]) for n in snapshots.children(spark, f"{root}/out") if n.startswith("batch=") and n[6:].isdigit())


def _current(spark: SparkSession, root: str, keys: list[str], schema: str, before: int | None = None) -> DataFrame:
    """Latest row per key with the number of its micro-batch: the table's last snapshot and the batches behind it."""
    rows = snapshots.read(spark, f"{root}/latest", f"{schema}, batch BIGINT")
    if _deltas(spark, root):
        rows = rows.unionByName(spark.read.schema(f"{schema}, batch BIGINT").parquet(f"{root}/out"))
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*").select(rows.columns)


def _fold(spark: SparkSession, root: str, keys: list[str], schema: str, expired: str | None = None) -> None:
    """Publish the latest rows as the table's next snapshot, then drop the batches that it holds; ``expired`` names a flag of rows that leave.

    A crash before the publication leaves the old snapshot and all batches, one after it a snapshot and batches that say the same.
    """
    done = _deltas(spark, root)
    if done or not snapshots.entries(spark, f"{root}/latest"):
        rows = _current(spark, root, keys, schema)
        snapshots.publish(rows.where(~F.col(expired)) if expired else rows, f"{root}/latest")
    for n in done:
        snapshots.remove(spark, f"{root}/out/batch={n}")


def run_aggregate(stream: DataFrame, aggregate: Callable[[DataFrame], DataFrame], keys: list[str], root: str) -> DataFrame:
    """Run an aggregating stream to the end of its input and return the latest row per key.

    ``root`` is the caller's folder for state and results: a later call with the same folder goes on where this one ended, and a
    stopped one is resumed. Every micro-batch writes the changed rows under its number, so a replayed batch changes nothing;
    at the end of a run, and every ``FOLD`` batches, they are folded into a snapshot. An input without rows gives an empty table.
    """
    spark = stream.sparkSession
    result = aggregate(stream)
    schema = ", ".join(f"`{n}` {t}" for n, t in result.dtypes)

    def save(batch: DataFrame, number: int) -> None:
        if len(_deltas(spark, root)) >= FOLD:
            _fold(spark, root, keys, schema)
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    query = (
        result.writeStream.outputMode("update").option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True).foreachBatch(save).start()
    )
    query.awaitTermination()
    _fold(spark, root, keys, schema)
    return snapshots.read(spark, f"{root}/latest", f"{schema}, batch BIGINT").drop("batch")


def run_manifest(stream: DataFrame, root: str, order: str) -> DataFrame:
    """Idempotent upsert of (url, sha256, and the ``order`` column): the last row of a url counts; only new and changed documents are
    written. ``root`` is the caller's folder, as for ``run_aggregate``."""
    spark = stream.sparkSession
    schema = "url STRING, sha256 STRING"

    def upsert(batch: DataFrame, number: int) -> None:
        if len(_deltas(spark, root)) >= FOLD:
            _fold(spark, root, ["url"], schema)
        # only earlier batches count, so a replayed batch rewrites its own folder with the same rows
        known = _current(spark, root, ["url"], schema, number).drop("batch")
        latest = batch.where("url IS NOT NULL").groupBy("url").agg(F.max_by("sha256", order).alias("sha256"))
        status = crawl.manifest_diff(latest, known)
        changed = latest.join(status.where(F.col("status").isin("new", "changed")), "url").select("url", "sha256")
        changed.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    stream.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(upsert).start().awaitTermination()
    _fold(spark, root, ["url"], schema)
    return snapshots.read(spark, f"{root}/latest", f"{schema}, batch BIGINT").drop("batch")
