"""Files of token ids: an adaptive context-mixing range coder over independent, checksummed blocks.

A block is coded in up to 2^14 lanes, each a run of neighbouring ids, that advance together: step t codes the t-th id of every lane.
The model is shared by the lanes and starts anew in each block; it learns after every step what the decoder knows by then.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import common, tokens
from marginalia.session import scratch_dir

LANES = 1 << 14
BLOCK = 1 << 22
_MAGIC = b"TIDB\x01"
_HEAD = "<5sQIIII"  # magic, ids, lanes, alphabet, words, crc32 of the ids
_ONE = 1 << 16  # probabilities are 16-bit integers: nothing depends on floating point
_LEAST = 256
_U = np.uint64


class _Model:
    """Predicted ids of order 2 and order 1, frequencies of order 0, and the mixed chances of a hit.

    Each order's evidence (its confidence, or the predicted id's frequency) keeps adaptive counts of hits; a fourth table keeps them for all
    of it together. Their predictions are mixed with weights that follow their squared errors.
    """

    def __init__(self, alphabet: int, lanes: int):
        self.size = alphabet
        self.slots = 1 << max(10, min(20, (lanes * 64).bit_length()))
        self.next2, self.sure2 = np.zeros(self.slots, np.int32), np.zeros(self.slots, np.int8)
        self.next1, self.sure1 = np.zeros(alphabet, np.int32), np.zeros(alphabet, np.int8)
        cell = np.arange(1024)
        sure2, sure1, agree, often = cell >> 7, cell >> 4 & 7, cell >> 3 & 1, cell & 7
        # the tables of all views behind one another, and for each view where a cell's entry is
        self.views = np.stack([sure2, 8 + sure1 * 2 + agree, 24 + often * 2 + agree, 40 + cell])
        self.seen, self.hits = np.full(40 + 1024, 8, np.int64), np.full((2, 40 + 1024), 2, np.int64)
        self.begins, self.widths = np.zeros((1024, 3), _U), np.zeros((1024, 3), _U)
        self.error = [1, 1, 1, 1]
        self.counts, self.uncounted = np.zeros(alphabet, np.int64), []
        self.steps, self.due = 0, 0
        self._frequencies()
        self._mix()

    def _count(self) -> None:
        if self.uncounted:
            self.counts += np.bincount(np.concatenate(self.uncounted), minlength=self.size)
            self.uncounted.clear()

    def _frequencies(self) -> None:
        self._count()
        f = 1 + 16 * self.counts
        self.frequency = f.astype(_U)
        self.until = np.concatenate([[0], np.cumsum(f)])
        self.start, self.total = self.until.astype(_U), _U(int(self.until[-1]))
        self.near = None  # made when a decoder asks
        share = f * 4096 // int(self.until[-1])
        self.often = np.minimum(np.frexp((share + 1).astype(np.float64))[1] - 1, 7).astype(np.int16)

    def find(self, value: np.ndarray) -> np.ndarray:
        """Ids whose ranges hold the values: a coarse table, then a search between two of its entries."""
        if self.near is None:
            self.shift = max(0, int(self.total).bit_length() - 16)
            marks = np.arange((int(self.total) >> self.shift) + 2) << self.shift
            self.near = np.searchsorted(self.until, marks, "right") - 1
        place = value >> self.shift
        low, high = self.near[place], np.minimum(self.near[place + 1], self.size - 1)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_] + 1) // 2
            up = self.until[middle] <= value[open_]
            low[open_] = np.where(up, middle, low[open_])
            high[open_] = np.where(up, high[open_], middle - 1)
            open_ = open_[low[open_] < high[open_]]
        return low

    def _mix(self) -> None:
        best = min(self.error)
        weight = np.array([max(1, (best << 16) ** 4 // e**4 >> 48) for e in self.error])
        self.parts = (self.hits * _ONE // self.seen)[:, self.views]
        two, one = (weight[:, None] * self.parts).sum(1) // weight.sum()
        self.p2 = np.minimum(np.maximum(two, _LEAST), _ONE - 3 * _LEAST)
        p1 = np.minimum(np.maximum(one, _LEAST), _ONE - _LEAST - self.p2)
        self.both = self.p2 + p1
        # by cell and outcome: 0 the order-2 id, 1 the order-1 id, 2 neither
        self.begins[:, 1], self.begins[:, 2] = self.p2, self.both
        self.widths[:, 0], self.widths[:, 1], self.widths[:, 2] = self.p2, p1, _ONE - self.both

    def predict(self, before: np.ndarray, last: np.ndarray):
        mixed = last.view(np.uint32) * np.uint32(2654435761)
        mixed ^= before.view(np.uint32) * np.uint32(0x9E3779B1)
        slot = ((mixed >> np.uint32(8)) & np.uint32(self.slots - 1)).astype(np.intp)
        at = last.astype(np.intp)
        a, b, sure2, sure1 = self.next2[slot], self.next1[at], self.sure2[slot], self.sure1[at]
        cell = sure2.astype(np.int16) << 7
        cell |= sure1.astype(np.int16) << 4
        cell |= (a == b).astype(np.int16) << 3
        cell |= self.often[a]
        return slot, at, a, b, sure2, sure1, cell

    def learn(self, slot: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray, sure2: np.ndarray, sure1: np.ndarray, kind: np.ndarray, ids: np.ndarray) -> None:
        hit_a, hit_b = a == ids, b == ids
        h2, h1, miss = np.bincount(kind, minlength=3072).reshape(1024, 3).T
        n = h2 + h1 + miss
        bits = np.stack([n, h2, h1]).reshape(3, 8, 8, 2, 8)  # the views add up over the bits of a cell that they leave out
        agreed = bits.sum(1)
        new = np.concatenate([bits.reshape(3, 8, 128).sum(2), agreed.sum(3).reshape(3, 16), agreed.sum(1).transpose(0, 2, 1).reshape(3, 16), bits.reshape(3, 1024)], 1)
        p = self.parts[0]
        wrong = (h2 * (_ONE - p) ** 2 + (n - h2) * p**2).sum(1)
        self.error = [e + (w >> 16) for e, w in zip(self.error, wrong.tolist())]
        self.seen += new[0]
        self.hits += new[1:]
        for following, sureness, place, guess, sure, hit in ((self.next2, self.sure2, slot, a, sure2, hit_a), (self.next1, self.sure1, at, b, sure1, hit_b)):
            following[place] = guess + (ids - guess) * ~(hit | (sure != 0))
            half = sure >> 1
            sureness[place] = half + (sure + (sure < 7) - half) * hit
        self.uncounted.append(ids)
        if len(self.uncounted) >= 64:
            self._count()
        self._mix()
        self.steps += 1
        if self.steps >= self.due:
            self._frequencies()
            self.due = self.steps + 1 + self.steps // 8


def _due(low: np.ndarray, span: np.ndarray, todo: np.ndarray | None = None) -> np.ndarray:
    """Of some lanes (all, if none are named), those whose top word is settled, or whose span is too short and is cut at the next border so that it is settled."""
    x, y = (low, span) if todo is None else (low[todo], span[todo])
    settled = (x ^ (x + y)) < _U(1 << 48)
    short = np.flatnonzero(y < _U(1 << 40))
    short = short[~settled[short]]
    if len(short):
        at = short if todo is None else todo[short]
        span[at] = (-low[at].astype(np.int64)).astype(_U) & _U((1 << 40) - 1)
        settled[short] = True
    return np.flatnonzero(settled) if todo is None else todo[settled]


def encode_block(ids: np.ndarray) -> bytes:
    """A self-contained block: header, words per lane, words."""
    n = len(ids)
    lanes = max(1, min(LANES, n // 32))
    length = -(-n // lanes) if n else 0
    lanes = -(-n // length) if n else 0
    alphabet = int(ids.max()) + 1 if n else 1
    rows = np.zeros((length, lanes), np.int32)
    padded = np.zeros(lanes * length, np.int32)
    padded[:n] = ids
    rows[:] = padded.reshape(lanes, length).T if n else 0
    model = _Model(alphabet, lanes)
    low, span = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    last, before = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
    out_lane, out_word = [], []
    for t in range(length):
        active = (n - 1 - t) // length + 1  # lanes are full, but for the end of the last
        now = rows[t, :active]
        slot, at, a, b, sure2, sure1, cell = model.predict(before[:active], last[:active])
        other = a != now
        miss = other & (b != now)
        kind = (cell * np.int16(3) + other + miss).astype(np.intp)
        part = span[:active] >> _U(16)
        l, s = low[:active] + model.begins.ravel().take(kind) * part, part * model.widths.ravel().take(kind)
        open_ = np.flatnonzero(miss)
        if len(open_):
            which = now[open_]
            step = s[open_] // model.total
            l[open_] += model.start[which] * step
            s[open_] = step * model.frequency[which]
        todo = _due(l, s)
        while len(todo):
            x = l[todo]
            out_lane.append(todo.astype(np.uint16))
            out_word.append((x >> _U(48)).astype(np.uint16))
            l[todo], s[todo] = x << _U(16), s[todo] << _U(16)
            todo = _due(l, s, todo)
        low[:active], span[:active] = l, s
        model.learn(slot, at, a, b, sure2, sure1, kind, now)
        before[:active] = last[:active]
        last[:active] = now
    end = (low + _U((1 << 32) - 1)) >> _U(32)  # two words name a number within the last interval
    for shift in (16, 0):
        out_lane.append(np.arange(lanes, dtype=np.uint16))
        out_word.append((end >> _U(shift)).astype(np.uint16))
    lane, word = np.concatenate(out_lane), np.concatenate(out_word)
    word = word[np.argsort(lane, kind="stable")]
    head = struct.pack(_HEAD, _MAGIC, n, lanes, alphabet, len(word), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()))
    return head + np.bincount(lane, minlength=lanes)[:lanes].astype("<u4").tobytes() + word.astype("<u2").tobytes()


def decode_block(block: bytes) -> np.ndarray:
    """The ids of a block; an error if they do not match its checksum."""
    magic, n, lanes, alphabet, words, crc = struct.unpack_from(_HEAD, block)
    if magic != _MAGIC or len(block) != struct.calcsize(_HEAD) + 4 * lanes + 2 * words:
        raise ValueError("no block of token ids, or one cut short")
    ends = np.cumsum(np.frombuffer(block, "<u4", lanes, struct.calcsize(_HEAD)).astype(np.int64))
    word = np.concatenate([np.frombuffer(block, "<u2", words, struct.calcsize(_HEAD) + 4 * lanes), np.zeros(1, np.uint16)]).astype(_U)
    at = np.concatenate([[0], ends[:-1]]) if lanes else np.zeros(0, np.int64)
    length = -(-n // lanes) if n else 0
    model = _Model(alphabet, lanes)
    low, span = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    code = np.zeros(lanes, _U)
    for _ in range(4):
        code = code << _U(16) | np.where(at < ends, word[np.minimum(at, words)], _U(0))
        at = at + 1
    last, before = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
    rows = np.zeros((length, lanes), np.int32)
    for t in range(length):
        active = (n - 1 - t) // length + 1
        slot, place, a, b, sure2, sure1, cell = model.predict(before[:active], last[:active])
        l, s, c = low[:active], span[:active], code[:active]
        part = s >> _U(16)
        value = np.minimum((c - l) // part, _U(_ONE - 1)).astype(np.int64)
        other, miss = value >= model.p2[cell], value >= model.both[cell]
        kind = (cell * np.int16(3) + other + miss).astype(np.intp)
        now = a + (b - a) * other
        l, s = l + model.begins.ravel().take(kind) * part, part * model.widths.ravel().take(kind)
        open_ = np.flatnonzero(miss)
        if len(open_):
            step = s[open_] // model.total
            value = np.minimum((c[open_] - l[open_]) // step, model.total - _U(1)).astype(np.int64)
            which = model.find(value)
            now[open_] = which
            l[open_] += model.start[which] * step
            s[open_] = step * model.frequency[which]
        c = c.copy()
        todo = _due(l, s)
        while len(todo):
            l[todo], s[todo] = l[todo] << _U(16), s[todo] << _U(16)
            p = at[todo]
            c[todo] = c[todo] << _U(16) | np.where(p < ends[todo], word[np.minimum(p, words)], _U(0))
            at[todo] = p + 1
            todo = _due(l, s, todo)
        low[:active], span[:active], code[:active] = l, s, c
        model.learn(slot, place, a, b, sure2, sure1, kind, now)
        before[:active] = last[:active]
        last[:active] = now
        rows[t, :active] = now
    ids = rows.T.ravel()[:n].astype("<u4") if n else np.zeros(0, "<u4")
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("the ids do not match the block's checksum")
    return ids


def write_ids(docs: DataFrame, path: str, vocabulary: str = tokens.WORD_VOCABULARY, end_id: int = 2) -> None:
    """Write the ids of all whole texts, each with ``end_id``, in ascending doc_id order: rows (part, block, doc_ids, lengths, n_ids, ids).

    Parts follow one another by doc_id (nulls first, equal ones by text); a block holds whole documents, about ``BLOCK`` ids, and is decoded
    alone. Null text: the end id alone. Other columns are left out. Spark commits the files, so a lost task leaves none behind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary).encode_all
        end = int(end_id).to_bytes(4, "little")
        held: list[bytes] = []
        docs_: list[int | None] = []
        size = number = 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            row = (number, docs_, [len(h) // 4 for h in held], len(ids), encode_block(ids))
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["block", "doc_ids", "lengths", "n_ids", "ids"])

        for batch in batches:
            for part in common.slices(batch, "text", 8 << 20):
                for doc, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text"))):
                    got = ids + end
                    held.append(got)
                    docs_.append(doc)
                    size += len(got) // 4
                    if size >= BLOCK:
                        yield flush()
                        held, docs_, size, number = [], [], 0, number + 1
        if held:
            yield flush()

    spark = docs.sparkSession
    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange(common.fan_out(spark), "doc_id", F.xxhash64("text"))
    made = ordered.sortWithinPartitions("doc_id", "text").mapInArrow(run, "block bigint, doc_ids array<bigint>, lengths array<bigint>, n_ids bigint, ids binary")
    made.withColumn("part", F.spark_partition_id()).write.parquet(path)


def read_ids(spark, path: str) -> DataFrame:
    """Per document, read back from the files: (doc_id, start, n_tokens, ids_crc32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs_, lengths, ids, first in zip(*(batch.column(c) for c in ("doc_ids", "lengths", "ids", "first"))):
                data = decode_block(ids.as_py()).tobytes()
                n = lengths.values.to_numpy()
                start = np.cumsum(n) - n
                crc = [zlib.crc32(data[4 * s : 4 * (s + k)]) for s, k in zip(start.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([docs_.values, pa.array(start + first.as_py()), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    blocks = spark.read.parquet(path)
    sizes = blocks.select("part", "block", "n_ids")
    parts = common.running_total(sizes.groupBy("part").agg(F.sum("n_ids").alias("n")), [], ["part"], "n", "base").drop("n")
    inner = common.running_total(sizes, ["part"], ["block"], "n_ids", "inner").drop("n_ids")
    placed = blocks.join(inner.join(parts, "part").select("part", "block", (F.col("base") + F.col("inner")).alias("first")), ["part", "block"])
    return placed.select("doc_ids", "lengths", "ids", "first").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def write_and_read(docs: DataFrame) -> DataFrame:
    path = scratch_dir(docs.sparkSession, "token-ids")
    write_ids(docs, path)
    return read_ids(docs.sparkSession, path)
