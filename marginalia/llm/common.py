"""Helpers shared by the operators: table reading, hashing into tasks, components, bounded numbering."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.session import written

#: White space of a word pattern ``[^\x20\x09-\x0D]+``; ``bytes.split()`` cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fan_out(spark: SparkSession) -> int:
    """Tasks of a shuffle, as the cluster sets them."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts (or sizes, if the column is of numbers) add up to about ``limit`` bytes, one row at least."""
    own = batch.column(column)
    sizes = pc.fill_null(own if pa.types.is_integer(own.type) else pc.binary_length(own), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        total += int(n)
        if total >= limit:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` in the rows before, within ``keys``; for small tables of counts."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("bigint"))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """0-based position of each row within ``keys`` in any fixed order.

    A hot key is dealt over as many salts as the session has shuffle tasks; a table of one count
    per key and salt supplies the offsets, so no task holds a whole key.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(fan_out(df.sparkSession))).cast("int"))
    counts = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    offsets = running_total(counts, keys, ["_salt"], "_n", "_before").drop("_n")
    inside = Window.partitionBy(*keys, "_salt").orderBy(*order)
    numbered = salted.withColumn("_row", F.row_number().over(inside) - 1)
    return (
        numbered.join(offsets, [*keys, "_salt"])
        .withColumn(name, (F.col("_row") + F.col("_before")).cast("bigint"))
        .drop("_row", "_before", "_salt")
    )


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components as rows (node, root): the root is the smallest node.

    Alternating large-star and small-star steps: every node hooks its larger, then its smaller neighbours to the
    smallest one it sees, so the number of edges never grows and long chains halve in every round. Each round is written to the
    shared folder. Nodes without an edge do not appear.
    """
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("x"), "m", "u")
        small = small.select(F.col("x").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        after = written(small.where("u <> v").distinct(), "edges")
        same = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).alias("s")
        before = now.agg(same).first()
        now = after
        if after.agg(same).first() == before:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    raise RuntimeError("components did not settle")

