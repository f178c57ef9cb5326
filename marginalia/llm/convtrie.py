"""Prefix trie of conversations; sums over subtrees by centroid decomposition."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm import common
from marginalia.operators.ranking import positions_in
from marginalia.session import written

#: Turns of a conversation whose running sums one task makes; a longer conversation is a sum of such slices.
SLICE = 4096
#: Conversation ids that are joined into one string before a digest reads them.
JOINED = 4096
#: Components of at most this weight (turns of all their conversations) are taken apart inside a task.
PIECE = 1 << 16
#: Nodes of whole small components that a task takes apart together.
BATCH = 4096


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """Rows (conv, pos, role, text) with positions from 0 by turn (null first), then role and text; null role or text is empty."""
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Slices follow the order of turns; equal turns beyond one slice are rows of one turn number and stay together.
    rows = rows.withColumn("slice", F.coalesce(F.floor(F.col("turn") / SLICE), F.lit(-(1 << 62))))
    return positions_in(rows, ["conv"], ["slice"], ["turn", "role", "text"], "n").select("conv", (F.col("n") - 1).alias("pos"), "role", "text")


def regrouped(turns: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Rebuilt conversations (conv, pos, role, text): the first h turns of conversation conv - conv % family, then its own after the first h.

    h is the unsigned crc32 of the decimal conv modulo ``most``. A family head that is not there adds none.
    """
    own = turns.withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % most).withColumn("base", F.col("conv") - F.col("conv") % family)
    heads = turns.where(F.col("pos") < most).select(F.col("conv").alias("base"), "pos", "role", "text")
    lengths = heads.groupBy("base").agg(F.count(F.lit(1)).alias("there"))
    convs = own.select("conv", "h", "base").distinct()
    copied = convs.join(heads, "base").where(F.col("pos") < F.col("h")).select("conv", "pos", "role", "text")
    rest = own.where(F.col("pos") >= F.col("h")).join(lengths, "base", "left")
    moved = F.col("pos") - F.col("h") + F.least(F.col("h"), F.coalesce("there", F.lit(0)))
    return copied.union(rest.select("conv", moved.alias("pos"), "role", "text"))


def prefixes(conversations: DataFrame, sequences: DataFrame) -> DataFrame:
    """Membership rows (conv, depth, a, b, size, length): one per conversation and depth, from the root at 0.

    A prefix is named by sums of hashes of its (position, role, text), two of 64 bits, so it needs no chain from turn to turn: running sums are
    made in slices of a conversation and a table of slice totals supplies what comes before. ``size`` is the bytes of the last text,
    ``length`` the depth of the whole conversation.
    """
    turns = sequences.select("conv", (F.col("pos") + 1).alias("depth"), F.octet_length("text").cast("bigint").alias("size"), *[F.xxhash64(F.lit(i), "pos", "role", "text").alias(f"x{i}") for i in (1, 2)])
    # Halves of 32 bits: their sums cannot overflow.
    halves = [(f"x{i}", f"{part}{i}") for i in (1, 2) for part in ("lo", "hi")]
    cut = {"lo": lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)), "hi": lambda c: F.shiftrightunsigned(F.col(c), 32)}
    names = [n for _, n in halves]
    turns = turns.select("conv", "depth", "size", F.floor(F.col("depth") / SLICE).alias("slice"), *[cut[n[:2]](c).alias(n) for c, n in halves])
    totals = turns.groupBy("conv", "slice").agg(F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(f"t_{n}") for n in names])
    along = Window.partitionBy("conv").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("conv")
    offsets = totals.select("conv", "slice", F.sum("n").over(every).alias("length"), *[F.coalesce(F.sum(f"t_{n}").over(along), F.lit(0)).alias(f"t_{n}") for n in names])
    inside = Window.partitionBy("conv", "slice").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    summed = turns.join(offsets, ["conv", "slice"]).select("conv", "depth", "size", "length", *[(F.sum(n).over(inside) + F.col(f"t_{n}")).alias(n) for n in names])
    below = summed.select("conv", "depth", *[F.xxhash64(F.lit(i), *names).alias(n) for i, n in ((1, "a"), (2, "b"))], "size", "length")
    lengths = offsets.select("conv", "length").distinct()
    root = conversations.join(lengths, "conv", "left").select("conv", F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("size"), F.coalesce("length", F.lit(0)).alias("length"))
    return below.union(root)


def centroid_sums(up: list[int], weights: Sequence[Sequence[int]]) -> list[list[int]]:
    """Sums of every weight over the subtree of each node of a forest, ``up[i] < i`` being the parent (-1: none).

    A component is split at its centroid, the deepest node under which lies more than half of it. The part from the centroid down is added up
    once and added to every node from there to the component's top; the parts below the centroid and the part above it are split in turn.
    A node meets each of its descendants in one component only, at the centroid between them.
    """
    sums = [[0] * len(up) for _ in weights]
    root = list(range(len(up)))
    for i, p in enumerate(up):
        if p >= 0:
            root[i] = root[p]
    whole: dict[int, list[int]] = {}
    for i, r in enumerate(root):
        whole.setdefault(r, []).append(i)
    waiting = list(whole.values())
    while waiting:
        nodes = waiting.pop()
        top = nodes[0]
        here = dict.fromkeys(nodes, 1)
        for i in reversed(nodes):
            if i != top:
                here[up[i]] += here[i]
        centroid = max(i for i in nodes if 2 * here[i] > len(nodes))
        part = {centroid: centroid}
        for i in nodes:
            if i > centroid and up[i] in part:
                part[i] = i if up[i] == centroid else part[up[i]]
        totals = [sum(w[i] for i in part) for w in weights]
        at = centroid
        while True:
            for s, t in zip(sums, totals):
                s[at] += t
            if at == top:
                break
            at = up[at]
        split: dict[int, list[int]] = {}
        for i in nodes:
            if i != centroid:
                split.setdefault(part.get(i, -1), []).append(i)
        waiting += split.values()
    return sums


def subtree_sums(nodes: DataFrame, members: DataFrame, weights: Sequence[str], piece: int = PIECE) -> DataFrame:
    """Rows (a, b, weights summed over each node's subtree) by centroid decomposition of the parent-edge forest.

    ``nodes``: (a, b, depth, conv, parent_a, parent_b, load, weights) with one conversation through each node and its load, the number of turns
    that all its conversations still have from there on. That is the sum of the conversation counts in the subtree, which a plain aggregate
    of ``members`` (conv, depth, a, b, next_a, next_b) gives, so a component's centroid is its deepest node with more than half of its load.
    Every level halves the load of all components: the part from the centroid down is added up, added along the path from the centroid to the
    top (the prefixes of the centroid's own conversation), and taken from the load there. Components of at most ``piece`` are finished in a task.
    """
    state = written(nodes.select("a", "b", "depth", "conv", "parent_a", "parent_b", "load", *weights, *[F.lit(0).cast("bigint").alias(c) for c in ("top_a", "top_b", "top")]), "components")
    comp, node = ["top_a", "top_b"], ["a", "b"]
    added, small = [], []
    while True:
        large = written(state.groupBy(*comp).agg(F.max("load").alias("whole")).where(F.col("whole") > piece), "large")
        small.append(state.join(large, comp, "left_anti"))
        if large.isEmpty():
            break
        big = written(state.join(large, comp), "big")
        # The nodes with more than half of the load are a path from the top; the lowest is the centroid.
        heavy = big.where(2 * F.col("load") > F.col("whole")).groupBy(*comp).agg(F.max(F.struct("depth", "a", "b", "conv", "load", "top")).alias("c"))
        centroids = written(heavy.select(*comp, *[F.col(f"c.{k}").alias(f"c_{k}") for k in ("depth", "a", "b", "conv", "load", "top")]), "centroids")
        through = members.join(centroids, (members["a"] == centroids["c_a"]) & (members["b"] == centroids["c_b"])).select("conv", *comp, "c_depth", "next_a", "next_b")
        # A node lies under the centroid if its conversation goes through it and the node is no higher.
        split = big.join(through, [*comp, "conv"], "left").withColumn("under", F.coalesce(F.col("depth") >= F.col("c_depth"), F.lit(False)))
        split = written(split, "split")
        totals = split.where("under").groupBy(*comp).agg(*[F.sum(w).alias(w) for w in weights])
        ways = centroids.join(totals, comp).withColumnRenamed("c_conv", "conv")
        paths = members.select("conv", "depth", *node).join(ways, "conv").where(F.col("depth").between(F.col("c_top"), F.col("c_depth")))
        paths = written(paths.select(*node, "depth", "c_depth", "c_load", *weights), "paths")
        added.append(paths.select(*node, *weights))
        off = paths.where(F.col("depth") < F.col("c_depth")).select(*node, F.col("c_load").alias("off"))
        below = split.where(F.col("under") & (F.col("depth") > F.col("c_depth"))).drop(*comp, "top")
        below = below.withColumn("top_a", F.col("next_a")).withColumn("top_b", F.col("next_b")).withColumn("top", F.col("c_depth") + 1)
        above = split.where(~F.col("under")).join(off, node, "left").withColumn("load", F.col("load") - F.coalesce("off", F.lit(0)))
        state = written(below.select(state.columns).union(above.select(state.columns)), "components")

    rest = small[0]
    for more in small[1:]:
        rest = rest.union(more)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def result() -> pa.RecordBatch:
            place = {(r[2], r[3]): i for i, r in enumerate(held)}
            up = [-1 if r[:2] == r[2:4] else place[r[4:6]] for r in held]
            sums = centroid_sums(up, [[r[7 + k] for r in held] for k in range(len(weights))])
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ([r[2] for r in held], [r[3] for r in held], *sums)], names=[*node, *weights])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(held) >= BATCH and row[:2] != held[-1][:2]:
                    yield result()
                    held = []
                held.append(row)
        if held:
            yield result()

    ordered = rest.repartition(common.fan_out(nodes.sparkSession), *comp).sortWithinPartitions(*comp, "depth").select(*comp, *node, "parent_a", "parent_b", "depth", *weights)
    inner = ordered.mapInArrow(finish, "a bigint, b bigint, " + ", ".join(f"{w} bigint" for w in weights))
    for extra in added:
        inner = inner.union(extra)
    return inner.groupBy(*node).agg(*[F.sum(w).alias(w) for w in weights])


def digests(ends: DataFrame) -> DataFrame:
    """Rows (a, b, ends_sha256) from rows (a, b, conv): SHA-256 of each node's decimal conversation ids, ascending and joined by commas.

    Ids are joined in slices first; a node's slices are then read in order by one task that holds only the digest.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, b) != now:
                    if now:
                        out.append((*now, digest.hexdigest()))
                    now, digest = (a, b), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield rows(out)
        if now:
            yield rows([(*now, digest.hexdigest())])

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["a", "b", "ends_sha256"])

    sliced = ends.withColumn("slice", F.floor(F.col("conv") / JOINED)).groupBy("a", "b", "slice").agg(F.sort_array(F.collect_list("conv")).alias("ids"))
    joined = sliced.select("a", "b", "slice", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    ordered = joined.repartition(common.fan_out(ends.sparkSession), "a", "b").sortWithinPartitions("a", "b", "slice").select("a", "b", "ids")
    return ordered.mapInArrow(stream, "a bigint, b bigint, ends_sha256 string")


def trie(sequences: DataFrame, conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """Rows (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one per distinct prefix.

    ``sequences``: (conv, pos, role, text), positions from 0 without gaps, role and text not null; ``conversations``: (conv), all of them, those
    without turns too. A node is named by its smallest conversation and its depth. No conversations: no rows.
    """
    rows = written(prefixes(conversations, sequences), "prefixes")
    step = rows.select("conv", (F.col("depth") + 1).alias("depth"), F.col("a").alias("parent_a"), F.col("b").alias("parent_b"))
    ahead = rows.select("conv", (F.col("depth") - 1).alias("depth"), F.col("a").alias("next_a"), F.col("b").alias("next_b"))
    members = written(rows.join(step, ["conv", "depth"], "left").join(ahead, ["conv", "depth"], "left"), "members")
    grouped = members.groupBy("a", "b").agg(
        F.min("conv").alias("conv"), F.min(F.struct("depth", "parent_a", "parent_b", "size")).alias("one"), F.count(F.lit(1)).alias("n_convs"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("load"))
    grouped = grouped.select("a", "b", "conv", "one.*", "n_convs", "load")
    grouped = written(grouped, "nodes")
    children = grouped.where("depth > 0").groupBy("parent_a", "parent_b").agg(F.count(F.lit(1)).alias("n_children")).select(F.col("parent_a").alias("a"), F.col("parent_b").alias("b"), "n_children")
    nodes = grouped.join(children, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("bigint"))
    nodes = written(nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("bigint")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("size")), "weighed")
    weights = ("n_leaves", "saved_tokens")
    sums = subtree_sums(nodes, members, weights, piece)
    parents = nodes.select(F.col("a").alias("parent_a"), F.col("b").alias("parent_b"), F.col("conv").alias("parent_conv_id"))
    ended = digests(members.where("depth = length").select("a", "b", "conv"))
    out = nodes.drop(*weights).join(sums, ["a", "b"]).join(ended, ["a", "b"], "left").join(parents, ["parent_a", "parent_b"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", *weights, F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, family: int = 5, most: int = 9, piece: int = PIECE) -> DataFrame:
    """The prefix trie of ``regrouped`` conversations.

    Rows without a conv_id take no part; null roles and texts are empty; turns follow by turn (null first), then role and text, so ties and repeated
    rows have a fixed order and count each. Other columns are left out. An empty table gives no rows.
    """
    turns = written(ordered_turns(conversations), "turns")
    sequences = written(regrouped(turns, family, most), "regrouped")
    return trie(sequences, turns.select("conv").distinct(), piece)
