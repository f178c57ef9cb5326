"""SimHash near-duplicates: deletion-variant signatures, equality join, verified links, components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm import common, tokens
from marginalia.session import written

#: A bucket of up to so many fingerprints is compared in one task; a larger one is split by its other bits.
BUCKET = 512
_LANES = np.uint64(0x0101010101010101)


def fold(hashes: np.ndarray) -> int:
    """Fingerprint of 64-bit hashes: a bit is 1 if it is set in over half of them."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for start in range(0, n, 65280):
        part = hashes[start : start + 65280]
        short = -len(part) % 255
        if short:
            part = np.concatenate([part, np.zeros(short, np.uint64)])
        part = part.reshape(-1, 255)
        for k in range(8):  # eight bits at a time, in byte lanes that hold at most 255
            lanes = ((part >> np.uint64(k)) & _LANES).sum(axis=1, dtype=np.uint64)
            counts[k::8] += lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * counts > n))


def fingerprint(text: str | None, words: int = 3) -> int:
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) < words:
        return fold(np.array([digest(b" ".join(w), 42)], np.uint64))
    return fold(np.fromiter((digest(b" ".join(g), 42) for g in zip(*(w[i:] for i in range(words)))), np.uint64, len(w) - words + 1))


def fingerprints(docs: DataFrame, words: int = 3, carry: Sequence[str] = ()) -> DataFrame:
    """Rows (doc_id, fp, and the carried columns): the fingerprint as a signed 64-bit number. Null or blank text: 0."""
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in batches:
            got = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64)
            own = [batch.column(c) for c in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64), pa.int64()), *own], names=["doc_id", "fp", *carry])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *carry).mapInArrow(run, f"doc_id bigint, fp bigint{kinds}")


def _variants(rows: DataFrame, low: int, width: int) -> DataFrame:
    """Signatures of bits [low, low + width) cut in two segments: each segment whole, and each with one bit left out.

    Two numbers that differ in at most two of these bits agree on a segment but for one bit at most. ``bit`` is the value of the bit left
    out, null for a whole segment: a pair that agrees there meets at the whole segment.
    """
    half = width // 2
    made: list[Column] = []
    for at in (low, low + half):
        mask = ((1 << half) - 1) << at
        for i in (None, *range(half)):
            kept = mask if i is None else mask & ~(1 << (at + i))
            signed = kept - (1 << 64) if kept >> 63 else kept
            bit = F.lit(None).cast("int") if i is None else F.shiftrightunsigned("fp", at + i).bitwiseAND(F.lit(1)).cast("int")
            key = F.xxhash64("key", F.lit(at), F.lit(-1 if i is None else i), F.col("fp").bitwiseAND(F.lit(signed).cast("bigint")))
            made.append(F.struct(key.alias("key"), bit.alias("bit"), F.lit(low + half if at == low else low).alias("low")))
    return rows.select("fp", F.explode(F.array(*made)).alias("v")).select("fp", "v.*")


def _forest(lists: DataFrame, distance: int) -> DataFrame:
    """Links that connect what is within ``distance`` in each list: at most one per member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in batches:
            ends: list[tuple[int, int]] = []
            for row in batch.column(0):
                fp = np.asarray(row.values, np.int64)
                open_, bits = np.arange(1, len(fp)), fp.view(np.uint64)
                front = [0]
                while True:
                    while front and len(open_):
                        i = front.pop()
                        near = np.bitwise_count(bits[open_] ^ bits[i]) <= distance
                        found, open_ = open_[near], open_[~near]
                        ends += [(int(fp[i]), int(fp[j])) for j in found]
                        front += found.tolist()
                    if not len(open_):
                        break
                    front, open_ = [int(open_[0])], open_[1:]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return lists.mapInArrow(run, "a bigint, b bigint")


def links(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect all pairs within ``distance`` <= 2.

    Signatures meet by equality. A bucket of two is a candidate pair, one of up to ``BUCKET`` is compared in a task, and a larger one is cut
    again by the bits that its signature leaves free: 64 bits, then 32, 16 and 8, after which a bucket cannot hold more than
    2^11 numbers. Nothing is capped. Every candidate is verified by its differing bits.
    """
    if distance > 2:
        raise ValueError("two segments with one free bit find at most two differing bits")
    found = []
    tasks = common.fan_out(distinct.sparkSession)  # a row grows to 66 signatures, so the few bytes of the rows are dealt over all tasks
    rows, width = distinct.select("fp", F.lit(0).cast("bigint").alias("key"), F.lit(0).alias("low")).repartition(tasks, "fp"), 64
    while True:
        halves = range(0, 64, width) if width < 64 else [0]
        made = None
        for low in halves:
            part = _variants(rows if width == 64 else rows.where(F.col("low") == low), low, width)
            made = part if made is None else made.unionByName(part)
        size = made.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"), F.min("bit").alias("b0"), F.max("bit").alias("b1"))
        size = written(size.where("n > 1 AND (b0 IS NULL OR b0 < b1)").select("key", "n", "a", "b"), "buckets")
        found.append(size.where("n = 2").select("a", "b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
        width //= 2
        last = width < 8
        many = made.join(size.where("n > 2").select("key", "n"), "key")
        lists = many.where(F.lit(last) | (F.col("n") <= BUCKET)).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps")).select("fps").distinct()
        found.append(_forest(lists, distance))
        if last or size.where(F.col("n") > BUCKET).limit(1).count() == 0:
            break
        rows = written(many.where(F.col("n") > BUCKET).select("fp", "key", "low"), "large").repartition(tasks, "fp", "key")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2, carry: Sequence[str] = ()) -> DataFrame:
    """Rows (doc_id, fp, component_id) of all documents; with ``carry``, also _root, which names the group even where no doc_id does, and the carried columns.

    component_id is the smallest doc_id that links of at most ``distance`` differing bits reach (null if all of them are null). Equal
    fingerprints, those of blank and null texts too, are one class from the start, so copies never make pairs. Repeated rows stay
    rows; an empty table gives no rows; columns besides doc_id, text and the carried ones are left out.
    """
    marked = written(fingerprints(docs, words, carry), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = common.components(links(classes, distance)).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id", F.col("root").alias("_root"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id", *(("_root", *carry) if carry else ()))
