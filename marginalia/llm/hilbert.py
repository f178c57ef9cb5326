"""Approximate nearest neighbours by shifted space-filling curves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm import common
from marginalia.session import written

#: Rows that the projection's centre and spread are fitted on (those with the smallest hashed ids); every row is indexed.
FIT_ROWS = 4096
#: Queries that meet one block of a curve in one task at most, about; more are dealt over copies of the block.
QUERIES_A_TASK = 4096


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of integer cells (rows, dimensions) along a Hilbert curve of ``bits`` bits a dimension.

    By Gray-code transposition (Skilling 2004): from the top bit down, a set bit inverts the lower bits of the first axis and a clear one
    exchanges them with the axis at hand; then the axes are chained by exclusive or and their bits interleaved.
    """
    axes = [c.astype(np.uint64) for c in cells.T]
    for b in range(bits - 1, 0, -1):
        top, low = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i, own in enumerate(axes):
            is_set = (axes[i] & top) != 0
            swap = np.where(is_set, np.uint64(0), (axes[0] ^ axes[i]) & low)
            axes[0] = axes[0] ^ np.where(is_set, low, swap)
            if i:
                axes[i] = axes[i] ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    flip = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((axes[-1] >> np.uint64(b)) & np.uint64(1), np.uint64((1 << b) - 1), np.uint64(0))
    key = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, -1, -1):
        for a in axes:
            key = key << np.uint64(1) | ((a ^ flip) >> np.uint64(b)) & np.uint64(1)
    return key


def usable(vector: Column) -> Column:
    """Not null or empty, every component present and finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _curve_keys(dims: int, curves: int, axes: int, bits: int, seed: int, centre: np.ndarray):
    """Function from vectors to their keys on each curve: its own rotation, spread and shift."""
    made = []
    rng = np.random.default_rng([seed, dims])
    m = min(axes, dims)
    for _ in range(curves):
        turn = np.linalg.qr(rng.normal(size=(dims, dims)))[0][:, :m]
        seen = centre @ turn
        made.append((turn, seen.mean(0), np.maximum(seen.std(0), 1e-12), rng.uniform(-0.1, 0.1, m)))

    def keys(x: np.ndarray) -> Iterator[np.ndarray]:
        for turn, mean, spread, shift in made:
            place = np.clip((x @ turn - mean) / spread / 8 + 0.5 + shift, 0, 1 - 1e-9)
            yield hilbert_keys((place * (1 << bits)).astype(np.int64), bits).astype(np.int64)

    return keys


def search(
    vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    curves: int = 16, axes: int = 8, bits: int = 6, window: float = 0.04, block: int = 2048, seed: int = 7,
) -> DataFrame:
    """The ``k`` nearest found of every row for which ``queries`` holds: (query_id, rank, vec_id, score).

    Rows are ordered along ``curves`` Hilbert curves of rotated, projected and shifted vectors. A query meets all rows within ``window``
    (a share of the rows) of its place on any curve, and the nearest of what the curves find are ranked by exact distance. A share, because
    on vectors without structure a fixed number of neighbours would lose recall as the table grows.

    Equal vectors are one point of the curves, with its k + 1 smallest ids, so copies cost nothing and ties are whole. Null,
    zero, null-holding and non-finite vectors take no part, nor do null ids; vectors of different length never meet; repeated rows count once.
    Fewer than k candidates: all of them. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double") + 0.0).alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v"))).groupBy("id", "v").agg(F.max("q").alias("q"))
    # Copies of a vector: its smallest ids, in one window over a hashed key and the vector, cut by task before the shuffle.
    few = Window.partitionBy("v").orderBy("id")
    members = written(rows.withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1).select("v", "id"), "members")
    points = members.groupBy("v").agg(F.min("id").alias("point"), F.sort_array(F.collect_list("id")).alias("ids"))
    points = written(points.withColumn("dims", F.size("v")), "points")
    asks = written(rows.where("q").join(points.select("v", "point"), "v").select(F.col("id").alias("query_id"), "point"), "queries")

    spaces = {}
    for d in [r[0] for r in points.select("dims").distinct().toLocalIterator()]:
        own = points.where(F.col("dims") == d)
        total = own.count()
        centre = np.array([r[0] for r in own.orderBy(F.xxhash64("point"), "point").limit(FIT_ROWS).select("v").toLocalIterator()], np.float64)
        spaces[d] = (total, _curve_keys(d, curves, axes, bits, seed, centre))
    if not spaces:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                part = batch.take(pa.array(at))
                x = part.column("v").flatten().to_numpy().reshape(len(at), d)
                packed = pa.array([r.tobytes() for r in x], pa.binary())
                for c, key in enumerate(spaces[int(d)][1](x)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), d, np.int32)), pa.array(np.full(len(at), c, np.int32)), pa.array(key), part.column("point"), packed, part.column("asked")], names=["dims", "curve", "key", "point", "vec", "asked"])

    marked = points.join(asks.select("point").distinct().withColumn("asked", F.lit(True)), "point", "left").select("v", "point", "dims", F.coalesce("asked", F.lit(False)).alias("asked"))
    along = marked.mapInArrow(order, "dims int, curve int, key bigint, point bigint, vec binary, asked boolean")
    along = along.repartitionByRange(common.fan_out(spark), "dims", "curve", "key", "point").sortWithinPartitions("dims", "curve", "key", "point")
    along = written(along.withColumn("_at", F.monotonically_increasing_id()), "curves")
    along = along.withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = along.groupBy("_part", "dims", "curve").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    offsets = common.running_total(counts, ["dims", "curve"], ["_part"], "_n", "_before")
    placed = along.join(offsets, ["_part", "dims", "curve"]).withColumn("place", F.col("_row") - F.col("_first") + F.col("_before"))

    n_of = F.create_map(*[F.lit(x) for d, (n, _) in spaces.items() for x in (d, n)])
    half = F.ceil(n_of[F.col("dims")] * window)
    copies = {d: max(1, round(asks.count() * (2 * window * n + 2 * block) / max(n, 1) / QUERIES_A_TASK)) for d, (n, _) in spaces.items()}
    copy_of = F.create_map(*[F.lit(x) for d, c in copies.items() for x in (d, c)])[F.col("dims")]
    stored = placed.select("dims", "curve", F.floor(F.col("place") / block).alias("block"), F.explode(F.sequence(F.lit(0), copy_of - 1)).alias("copy"), F.lit(False).alias("ask"), "point", "vec")
    low, high = F.floor(F.greatest(F.col("place") - half, F.lit(0)) / block), F.floor(F.least(F.col("place") + half, n_of[F.col("dims")] - 1) / block)
    asked = placed.where("asked").select("dims", "curve", F.explode(F.sequence(low, high)).alias("block"), F.pmod(F.xxhash64("point"), copy_of).cast("int").alias("copy"), F.lit(True).alias("ask"), "point", "vec")

    def rerank(group: pa.Table) -> pa.Table:
        ask = group.column("ask").to_numpy()
        points_, vecs = group.column("point").to_numpy(), group.column("vec").to_pylist()
        x = np.frombuffer(b"".join(vecs), np.float64).reshape(len(vecs), -1)
        own, ids = x[~ask], points_[~ask]
        out: tuple[list, list, list] = ([], [], [])
        if len(own):
            for q, p in zip(x[ask], points_[ask]):
                d = np.sqrt(np.square(own - q).sum(1))
                near = np.flatnonzero(d <= np.partition(d, min(k, len(d) - 1))[min(k, len(d) - 1)])
                near = near[np.lexsort((ids[near], d[near]))][: k + 1]
                out[0].append(np.full(len(near), p))
                out[1].append(ids[near])
                out[2].append(d[near])
        cols = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table([pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2].astype(np.float64))], names=["q", "point", "score"])

    found = stored.unionByName(asked).groupBy("dims", "curve", "block", "copy").applyInArrow(rerank, "q bigint, point bigint, score double")
    best = Window.partitionBy("q").orderBy("score", "point")
    found = found.groupBy("q", "point").agg(F.min("score").alias("score")).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    near = found.join(points.select("point", "ids"), "point").select("q", "score", F.explode("ids").alias("vec_id"))
    rows = asks.join(near, F.col("point") == F.col("q")).where("query_id <> vec_id")
    final = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return rows.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
