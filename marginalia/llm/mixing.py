"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm import common
from marginalia.session import written

#: Slices of a source in the order of its sampling hash: two hexadecimal digits more would be 256 times as many.
SLICE_DIGITS = 3


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), epochs: int = 3) -> DataFrame:
    """Rows (source, source_size, target) from rows (source, source_size).

    Weights repeat over the sources in code-point order, null last. All sources share the sum of the sizes by weight; none gets
    more than ``epochs`` times its size, and what that leaves over is shared by weight among the others until none is above.
    Sources fill in the order of cap by weight, so the rounds of clamping and sharing are running sums over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("bigint"))
    cap = F.col("source_size") * epochs
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    weighed = weighed.withColumn("_cap", cap).withColumn("_total", F.sum("source_size").over(whole)).withColumn("_all", F.sum("_w").over(whole))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    level = rest / (F.col("_all") - F.coalesce(F.sum("_w").over(before), F.lit(0)))  # a unit of weight, if all before are clamped
    weighed = weighed.withColumn("_level", level).withColumn("_free", F.col("_level") * F.col("_w") <= F.col("_cap"))
    # The first source that is not clamped sets the level of all that follow.
    final = F.min(F.when(F.col("_free"), F.struct((F.col("_cap") / F.col("_w")).alias("at"), "_level"))).over(whole)
    weighed = weighed.withColumn("_final", final["_level"])
    target = F.when(F.col("_final").isNull(), F.col("_cap").cast("double")).otherwise(F.least(F.col("_cap").cast("double"), F.col("_final") * F.col("_w")))
    return weighed.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), epochs: int = 3, seed: str = "mix", carry: Sequence[str] = ()) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken, and the carried columns) of all documents.

    A source whose target is r times its size is taken floor(r) times whole; the fraction is a seeded sample: in the order of
    md5(seed:doc_id) documents are taken once more until it is reached, the last one as far as needed, so that a source's words
    add up to its rounded target. Null text: size 0. Null source: a source of its own, last. Null doc_id: sorts by the hash
    of the seed alone. Repeated rows count each; an empty table gives no rows; other columns than the carried ones are left out.

    The order is cut into slices by the hash's first digits: sums per slice find the slice in which a source's sample ends, and only
    that slice is sorted.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), words_in(F.col("text")).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_h"), *carry,
    ).withColumn("_slice", F.substring("_h", 1, SLICE_DIGITS))
    rows = written(rows, "sizes")
    slices = written(rows.groupBy("source", "_slice").agg(F.sum("size").alias("_sum")), "slices")
    goal = targets(slices.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, epochs)
    goal = goal.withColumn("_goal", F.round("target").cast("bigint"))
    goal = goal.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("_goal") / F.col("source_size"))).otherwise(0).cast("bigint"))
    goal = written(goal.withColumn("_more", F.col("_goal") - F.col("_whole") * F.col("source_size")), "targets")
    along = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    upto = slices.withColumn("_before", F.coalesce(F.sum("_sum").over(along), F.lit(0)))
    ends = (
        upto.join(goal, upto["source"].eqNullSafe(goal["source"])).select(upto["source"], "_slice", "_before", "_more")
        .where((F.col("_before") < F.col("_more")) & (F.col("_before") + F.col("_sum") > F.col("_more")))
        .select(F.col("source").alias("_source"), F.col("_slice").alias("_end"), "_before")
    )
    # One row per source: where its sample ends. Without such a slice it ends between two slices.
    last = upto.join(goal, upto["source"].eqNullSafe(goal["source"])).where("_before < _more").groupBy(upto["source"].alias("_s")).agg(F.max("_slice").alias("_last"))
    goal = goal.join(ends, F.col("source").eqNullSafe(F.col("_source")), "left").join(last, F.col("source").eqNullSafe(F.col("_s")), "left")
    goal = goal.select(F.col("source").alias("_src"), "source_size", "target", "_whole", "_more", "_end", "_before", "_last")
    same = F.col("source").eqNullSafe(F.col("_src"))
    ends_here = F.col("_slice").eqNullSafe(F.col("_end"))
    easy = rows.join(goal, same).where(~ends_here).withColumn("_extra", F.when(F.col("_slice") <= F.col("_last"), F.col("size")).otherwise(0))
    # the slice is part of the join, so the window of a hot source gets the rows of one slice and no more
    inside = Window.partitionBy("source").orderBy("_h", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_more") - F.col("_before") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    hard = rows.join(goal.where(F.col("_end").isNotNull()), same & (F.col("_slice") == F.col("_end"))).withColumn("_extra", F.greatest(F.lit(0), F.least(F.col("size"), left)))
    taken = (F.col("_whole") * F.col("size") + F.col("_extra")).cast("bigint")
    return easy.unionByName(hard).select("doc_id", "size", "source_size", "target", taken.alias("taken"), *carry)
