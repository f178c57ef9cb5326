"""Numbering and best-of helpers that stay parallel when one key is hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into the session's full number of shuffle partitions.

    For rows that are about to grow (texts into n-grams): adaptive coalescing looks at the
    bytes before the growth and would leave too few tasks.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def stripes(spark: SparkSession) -> int:
    """Stripes of a table that streams past rows which each stripe gets whole: what these cost must not grow with the session's shuffle
    partitions, which grow with the data."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def keep_best(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the smallest by ``order`` (negate numbers to rank downwards).

    An aggregate, not a window: map-side partial results keep a hot key to one
    row per input partition.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("row"))).alias("best")
    )
    return picked.select(*keys, "best.row.*").select(*df.columns)


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows per key. ``row_number() <= k`` lets Spark cut every input
    partition to ``k`` rows per key before the shuffle (window group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def positions(
    df: DataFrame, keys: Sequence[str], order: str, name: str, width: int = 65536
) -> DataFrame:
    """1-based dense position of each row within ``keys`` by the integer column ``order``.

    Two levels: rows are numbered inside slices of ``width`` order values, and a
    small table of slice counts supplies the offsets. No task ever holds more than
    one slice of a key, however large the key is. ``order`` must be unique per key.
    """
    sliced = df.withColumn("_slice", F.floor(F.col(order) / F.lit(width)))
    counts = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(order)
    return (
        sliced.join(offsets, [*keys, "_slice"])
        .withColumn(name, (F.row_number().over(inside) + F.col("_offset")).cast("bigint"))
        .drop("_slice", "_offset")
    )


def positions_in(df: DataFrame, keys: Sequence[str], slices: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """1-based position of each row within ``keys`` by (slices, order), both in ascending order.

    Like ``positions`` for rows that come in slices (the pages of a document): rows are numbered inside a slice, and a table of one
    count per slice supplies the offsets. The order columns stay what they are, so there is no largest number.
    """
    counts = df.groupBy(*keys, *slices).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(*slices).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, *slices, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, *slices).orderBy(*order)
    return df.join(offsets, [*keys, *slices]).withColumn(name, (F.row_number().over(inside) + F.col("_offset")).cast("bigint")).drop("_offset")


def longest_runs(
    df: DataFrame, keys: Sequence[str], value: str, name: str = "longest_run", width: int = 65536
) -> DataFrame:
    """Longest run of consecutive integers per key (gaps and islands).

    Runs are found inside slices of ``width`` values first. Only runs that touch
    a slice border can grow, so the second level sees at most two rows per slice.
    """
    sliced = df.select(*keys, value).distinct().withColumn("_slice", F.floor(F.col(value) / F.lit(width)))
    w1 = Window.partitionBy(*keys, "_slice").orderBy(value)
    runs = (
        sliced.withColumn("_island", F.col(value) - F.row_number().over(w1))
        .groupBy(*keys, "_slice", "_island")
        .agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    )
    at_border = ((F.col("_lo") % F.lit(width)) == 0) | ((F.col("_hi") % F.lit(width)) == F.lit(width - 1))
    interior = runs.where(~at_border).groupBy(*keys).agg(F.max(F.col("_hi") - F.col("_lo") + 1).alias("_len"))
    w2 = Window.partitionBy(*keys).orderBy("_lo")
    border = (
        runs.where(at_border)
        .withColumn("_start", F.coalesce((F.col("_lo") != F.lag("_hi").over(w2) + 1).cast("int"), F.lit(1)))
        .withColumn("_grp", F.sum("_start").over(w2.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_grp")
        .agg((F.max("_hi") - F.min("_lo") + 1).alias("_len"))
        .select(*keys, "_len")
    )
    return interior.unionByName(border).groupBy(*keys).agg(F.max("_len").cast("bigint").alias(name))
