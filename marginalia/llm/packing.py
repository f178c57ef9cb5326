"""Packing documents into fixed windows by minimum bin slack."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import common, tokens
from marginalia.session import written

_PIECE = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def token_pieces(docs: DataFrame, window: int = 2048, vocabulary: str = tokens.BYTE_VOCABULARY, end_id: int = 1) -> DataFrame:
    """Cut every document's ids into whole windows and one remainder: (doc_id, start, length, ids_crc32, doc_tokens).

    The ids are those of the whole text (null: none) and ``end_id``. Cuts depend on the document alone, so its ids
    are made once and never move; later steps see lengths only.
    """
    kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary).encode
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                rows += [(doc, s, min(window, n - s), zlib.crc32(ids[4 * s : 4 * (s + window)]), n) for s in range(0, n, window)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)] if rows else [pa.array([], t) for t in kind.types], schema=kind)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(cut, f"doc_id bigint, {_PIECE}")


def fill_windows(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Minimum bin slack over a multiset of lengths.

    Each step seeds a window with the longest remaining length and asks a bitset of reachable sums which multiset of
    the other lengths comes closest to the window; the counts are read back from the bitsets of the partial sums. The
    window is then repeated as often as its counts allow. Rows (length, first, last, times, sequence, offset): pieces first..last-1
    of that length go to sequences from ``sequence`` on, ``times`` each, at ``offset``. There are at most ``window`` lengths, and
    each step uses one up or halves what it may be taken, so the plan is small however many pieces there are.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int, int]] = []
    sequence, full = 0, (1 << (window + 1)) - 1
    while left:
        lengths = sorted(left, reverse=True)
        pattern = {lengths[0]: 1}
        room = window - lengths[0]
        if room:
            reach, trail = 1, []
            for n in lengths:
                free = left[n] - pattern.get(n, 0)
                if n > room or free <= 0:
                    continue
                trail.append((n, reach, min(free, room // n)))
                most, k = trail[-1][2], 1
                while most > 0:  # up to ``most`` copies by shifts of 1, 2, 4, ...
                    step = min(k, most)
                    reach |= (reach << (n * step)) & full
                    most, k = most - step, 2 * k
                if reach >> room & 1:
                    break
            total = (reach & ((1 << (room + 1)) - 1)).bit_length() - 1
            for n, before, most in reversed(trail):
                times = next(t for t in range(most + 1) if total >= n * t and before >> (total - n * t) & 1)
                if times:
                    pattern[n] = pattern.get(n, 0) + times
                    total -= n * times
        repeat = min(left[n] // t for n, t in pattern.items())
        offset = 0
        for n, t in pattern.items():
            rows.append((n, used[n], used[n] + repeat * t, t, sequence, offset))
            offset += n * t
            used[n] += repeat * t
            left[n] -= repeat * t
            if not left[n]:
                del left[n]
        sequence += repeat
    return rows


def place(pieces: DataFrame, window: int = 2048) -> DataFrame:
    """Give pieces (any columns, with ``length`` in 1..window) a ``sequence_id`` and an ``offset`` in it.

    Only the counts per length (at most ``window`` rows) reach the driver. Pieces are numbered within their length, hot lengths
    over many tasks, and each looks its place up in the plan.
    """
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().toLocalIterator()}
    plan: dict[int, tuple[list[int], list[tuple[int, int, int, int]]]] = {}
    for n, first, _, times, sequence, offset in fill_windows(counts, window):
        starts, places = plan.setdefault(n, ([], []))
        starts.append(first)
        places.append((first, times, sequence, offset))
    shared = pieces.sparkSession.sparkContext.broadcast(plan)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.empty((2, batch.num_rows), np.int64)
            for i, (n, rank) in enumerate(zip(batch.column("length").to_pylist(), batch.column("_rank").to_pylist())):
                starts, places = shared.value[n]
                first, times, sequence, offset = places[bisect_right(starts, rank) - 1]
                at[:, i] = sequence + (rank - first) // times, offset + (rank - first) % times * n
            keep = [j for j, name in enumerate(batch.schema.names) if name != "_rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in keep), pa.array(at[0]), pa.array(at[1])], names=[*(batch.schema.names[j] for j in keep), "sequence_id", "offset"])

    numbered = common.ranked(pieces, ["length"], ["doc_id", "start", "ids_crc32"], "_rank")
    fields = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    return numbered.select(*pieces.columns, "_rank").mapInArrow(look_up, f"{fields}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, window: int = 2048, vocabulary: str = tokens.BYTE_VOCABULARY, end_id: int = 1) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most ``window`` ids.

    Null or empty text: one piece that holds ``end_id`` alone. Null ids, repeated rows and equal lengths are pieces like any
    other; an empty table gives no rows; columns besides doc_id and text are left out.
    """
    return place(written(token_pieces(docs, window, vocabulary, end_id), "pieces"), window)
