"""Byte strings that repeat across documents: hash-compared suffix sort over sampled anchors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import common, tokens
from marginalia.session import written

SPAN = 50
#: Bytes of an anchor; a string of SPAN bytes is filed under the anchor with the least hash in it.
ANCHOR = 20
_WINDOW = SPAN - ANCHOR + 1
#: Bytes beside an anchor of which a string of SPAN bytes holds either these on the left or one more on the right.
_SIDE = (SPAN - ANCHOR) // 2
#: Bytes hashed at a time.
CHUNK = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LOW24 = np.uint64((1 << 24) - 1)

_letters = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, ``n`` at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 64)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size - 1, b, np.uint64))]) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes (modulo 2^64) of all prefixes of some bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    each = _letters[data]
    each *= _power(len(data) + 1)[0][: len(data)]
    np.cumsum(each, out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes [start, end), the same wherever they lie."""
    return (prefix[end] - prefix[start]) * _power(len(prefix))[1][start]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of the texts that end at ``ends`` in ``data``: (first string, number of strings, hash, hash of all their bytes, hashes of both sides).

    Each string of SPAN bytes within a text belongs to the last of its least-hashed anchors, which depends on its bytes alone, so equal strings
    have equal anchors at equal places. An anchor's strings start at neighbouring bytes; the second hash covers them and the anchor's place.
    The sides are two numbers of 24 bits: of the anchor with the bytes to its left and with those to its right, 0 where no string reaches so far.
    """
    n = len(data)
    if n < SPAN:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    prefix = prefix_hashes(data)
    inverse = _power(n + 1)[1]
    hashed = prefix[ANCHOR:] - prefix[:-ANCHOR]  # arrays of 8 bytes a byte: changed in place and dropped as soon as they have served
    hashed *= inverse[: n - ANCHOR + 1]
    for shift, factor in ((31, _MIX), (29, np.uint64(1))):  # as mix() does
        hashed ^= hashed >> np.uint64(shift)
        hashed *= factor
    least = hashed & ~_LOW24
    least |= np.arange(int(_LOW24), int(_LOW24) - len(hashed), -1).view(np.uint64)
    width = 1
    while 2 * width <= _WINDOW:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < _WINDOW:
        least = np.minimum(least[: len(least) - (_WINDOW - width)], least[_WINDOW - width :])
    least &= _LOW24
    place = (np.int64(_LOW24) - least.view(np.int64)).astype(np.int32)
    del least
    inside = np.ones(n + SPAN, bool)  # no string crosses the end of a text
    for back in range(1, SPAN):
        at = ends - back
        inside[at[at >= 0]] = False
    starts = np.flatnonzero(inside[: len(place)])
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    place = place[starts]
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = starts[new]
    count = np.diff(np.concatenate([np.flatnonzero(new), [len(starts)]]))
    at = place[new].astype(np.int64)
    del starts, place, new
    whole = range_hash(prefix, first, first + count + SPAN - 1)
    sides = np.zeros(len(at), np.uint64)
    for has, start, end in ((at - first >= _SIDE, at - _SIDE, at + ANCHOR), (at - first - count + 1 < _SIDE, at, at + SPAN - _SIDE + 1)):
        sides <<= np.uint64(24)
        sides[has] |= np.maximum(mix(range_hash(prefix, start[has], end[has])) >> np.uint64(40), np.uint64(1))
    return first, count, hashed[at], mix(whole + (at - first).astype(np.uint64) * np.uint64(0x94D049BB133111EB) + count.astype(np.uint64)), sides


def longest_common(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int = SPAN) -> np.ndarray:
    """Common extension of the suffixes at ``a`` and ``b``, up to ``limit``: binary search over prefix hashes."""
    found = np.zeros(len(a), np.int64)
    step = 1 << (limit.bit_length() - 1)
    while step:
        wider = found + step
        fits = wider <= limit
        same = np.zeros(len(a), bool)
        i, j, n = a[fits], b[fits], found[fits]
        same[fits] = range_hash(prefix, i + n, i + n + step) == range_hash(prefix, j + n, j + n + step)
        found = np.where(same, wider, found)
        step >>= 1
    return found


def _before(prefix: np.ndarray, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the string at ``a`` is less than the one at ``b``: they differ after their common extension, if at all."""
    common_ = longest_common(prefix, a, b)
    i, j = np.minimum(a + common_, len(data) - 1), np.minimum(b + common_, len(data) - 1)
    return (common_ < SPAN) & (data[i] < data[j])


def suffix_order(prefix: np.ndarray, data: np.ndarray, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the strings of SPAN bytes at ``starts`` within their (ascending) groups, equal strings as they come.

    A bottom-up mergesort of all groups at once: in every round each element finds its place in the sorted run beside its own by binary
    search, so a round costs a logarithm of comparisons, and a comparison a logarithm of hashes.
    """
    n = len(starts)
    order = np.arange(n)
    first = np.searchsorted(group, group, "left")
    size = np.searchsorted(group, group, "right") - first
    inner = np.arange(n) - first
    run = 1
    while n and run < int(size.max()):
        live = np.flatnonzero(size > run)
        at = inner[live]
        right = (at // run) % 2 == 1
        base = first[live] + at // (2 * run) * (2 * run)
        end = first[live] + size[live]
        low = np.where(right, base, np.minimum(base + run, end))
        high = np.where(right, np.minimum(base + run, end), np.minimum(base + 2 * run, end))
        begin, own = low.copy(), starts[order[live]]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) // 2
            other, mine, is_right = starts[order[middle]], own[open_], right[open_]
            # a right element goes after equal ones of the left run, a left one before those of the right run
            x, y = np.where(is_right, mine, other), np.where(is_right, other, mine)
            less = _before(prefix, data, x, y)
            onward = np.where(is_right, ~less, less)
            low[open_] = np.where(onward, middle + 1, low[open_])
            high[open_] = np.where(onward, high[open_], middle)
        moved = base + at % run + (low - begin)
        placed = order.copy()
        placed[moved] = order[live]
        order = placed
        run *= 2
    return order


def repeated_starts(data: np.ndarray, prefix: np.ndarray, starts: np.ndarray, docs: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which of the strings at ``starts`` also stand in their group with a smaller document (groups ascending).

    Neighbours in suffix order with a common extension of SPAN are equal by hash; their bytes are compared before they count.
    """
    order = suffix_order(prefix, data, starts, group)
    s, d = starts[order], docs[order]
    same = np.zeros(len(s), bool)
    if len(s) > 1:
        near = np.flatnonzero(group[order][1:] == group[order][:-1])
        a, b = s[near], s[near + 1]
        equal = longest_common(prefix, a, b) == SPAN
        a, b, near = a[equal], b[equal], near[equal]
        for k in range(0, len(a), 1 << 16):
            i, j = a[k : k + (1 << 16), None] + np.arange(SPAN), b[k : k + (1 << 16), None] + np.arange(SPAN)
            same[near[k : k + (1 << 16)] + 1] = (data[i] == data[j]).all(1)
    heads = np.flatnonzero(~same)
    out = np.zeros(len(s), bool)
    if len(heads):
        least = np.minimum.reduceat(d, heads)
        out[order] = d > least[np.cumsum(~same) - 1]
    return out


_NONE = np.iinfo(np.int64).max  # a null doc_id, after all others


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of integers, byte by byte, so that what they share compresses away."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(packed: bytes, width: int) -> np.ndarray:
    got = np.frombuffer(packed, np.uint8).reshape(width, -1)
    out = np.zeros((got.shape[1], 8), np.uint8)
    out[:, :width] = got.T
    return out.view("<u8").ravel()


def _part_planes(part: np.ndarray) -> bytes:
    """Nothing where all parts are 0."""
    return _planes(part, 8) if part.any() else b""


def _parts(packed: bytes, n: int) -> np.ndarray:
    return _unplanes(packed, 8).astype(np.int64) if packed else np.zeros(n, np.int64)


def _leaders(h: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by anchor, surroundings and document; where anchors and classes of equal surroundings begin in it."""
    order = np.lexsort((d, c, h))
    h, c = h[order], c[order]
    new_h = np.concatenate([[True], h[1:] != h[:-1]])
    return order, new_h, new_h | np.concatenate([[True], c[1:] != c[:-1]])


def _shared(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which rows have a key that another document has too."""
    order = np.argsort(key)
    k = key[order]
    next_ = k[1:] == k[:-1]
    again = np.concatenate([next_, [False]]) | np.concatenate([[False], next_]) if len(k) else np.zeros(0, bool)
    order, k = order[again], k[again]
    out = np.zeros(len(key), bool)
    if len(k):
        d = doc[order]
        heads = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        several = np.minimum.reduceat(d, heads) < np.maximum.reduceat(d, heads)
        out[order] = np.repeat(several, np.diff(np.concatenate([heads, [len(k)]])))
    return out


def _beside(h: np.ndarray, side: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which anchors have a side that another document has at the same anchor: equal strings have one, so the rest repeats nothing."""
    out = np.zeros(len(h), bool)
    for shift in (0, 24):
        half = side >> np.uint64(shift) & _LOW24
        has = np.flatnonzero(half)
        out[has] |= _shared(h[has] << np.uint64(24) | half[has], doc[has])
    return out


def _marked(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Rows (_doc, _part, _data, and the carried columns): documents as bytes. _part is 0, and a 64-bit hash of the text where a doc_id names several texts."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NONE)).alias("_doc"), F.coalesce("text", F.lit("")).alias("_text"), *carry)
    tag = F.xxhash64("_text")
    several = written(rows.groupBy("_doc").agg(F.min(tag).alias("a"), F.max(tag).alias("b")).where("a < b").select("_doc"), "several")
    if several.isEmpty():
        return rows.select("_doc", F.lit(0).cast("bigint").alias("_part"), F.col("_text").cast("binary").alias("_data"), *carry)
    more = several.withColumn("_more", F.lit(True))
    return rows.join(more, "_doc", "left").select("_doc", F.when(F.col("_more"), tag).otherwise(F.lit(0)).cast("bigint").alias("_part"), F.col("_text").cast("binary").alias("_data"), *carry)


def _squeezed(rows: DataFrame) -> DataFrame:
    """Bytes compressed for the shuffle: texts move twice, and this halves them."""
    at = rows.columns.index("_data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tokens.forget()
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for part in common.slices(batch, "_data"):
                cols = list(part.columns)
                cols[at] = pa.array([squeeze(v.as_py()) for v in cols[at]], pa.binary())
                yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def _anchored(marked: DataFrame, buckets: int) -> DataFrame:
    """Rows (kind, bucket, payload): anchors by bucket (0), and strings that an earlier document of the same chunk repeats (1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        held: list[tuple[bytes, int, int, int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            data = np.frombuffer(b"".join(t for t, _, _, _ in held), np.uint8)
            ends = np.cumsum([len(t) for t, _, _, _ in held])
            first, count, h, c, side = anchors(data, ends)
            text = np.searchsorted(ends, first, "right")
            doc = np.array([d for _, d, _, _ in held], np.int64)[text]
            part = np.array([p for _, _, p, _ in held], np.int64)[text]
            base = np.array([b for _, _, _, b in held], np.int64)[text]
            where = (base + first - np.concatenate([[0], ends])[text]).astype(np.uint64) << np.uint64(5) | (count - 1).astype(np.uint64)
            out: list[tuple[int, int, bytes, bytes, bytes, bytes, bytes, bytes]] = []
            if len(h):
                bucket = (h >> np.uint64(48)) % np.uint64(buckets)
                h = (h >> np.uint64(4)) & np.uint64((1 << 40) - 1)
                c = c >> np.uint64(16)
                order, _, new_c = _leaders(h, c, doc)
                doc, part, where, h, c, side, bucket = doc[order], part[order], where[order], h[order], c[order], side[order], bucket[order]
                later = doc > doc[new_c][np.cumsum(new_c) - 1]
                out.append((1, 0, b"", b"", b"", _planes(doc[later], 8), _part_planes(part[later]), _planes(where[later], 8)))
                doc, part, where, h, c, side, bucket = doc[~later], part[~later], where[~later], h[~later], c[~later], side[~later], bucket[~later]
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1).astype(np.uint64))
                for b in np.flatnonzero(cuts[1:] > cuts[:-1]):
                    i = order[cuts[b] : cuts[b + 1]]
                    out.append((0, int(b), _planes(h[i], 5), _planes(c[i], 6), _planes(side[i], 6), _planes(doc[i], 8), _part_planes(part[i]), _planes(where[i], 8)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds], names=names)

        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 6)
        names = ["kind", "bucket", "h", "c", "side", "doc", "part", "at"]
        for batch in batches:
            for doc, part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = data.as_py()
                for s in range(0, max(1, len(data) - SPAN + 1), CHUNK - SPAN):  # pieces of a very long text share SPAN - 1 bytes
                    piece = data[s : s + CHUNK - 1]
                    if size and size + len(piece) > CHUNK:
                        yield flush()
                        size = 0
                    held.append((piece, doc, part, s))
                    size += len(piece)
        if held:
            yield flush()

    return marked.mapInArrow(run, "kind int, bucket int, h binary, c binary, side binary, doc binary, part binary, at binary")


_FOUND = "kind int, doc bigint, part bigint, at bigint, h bigint"


def _met(payloads: DataFrame, buckets: int) -> DataFrame:
    """Anchors that meet: rows (kind, doc, part, at, h). Kind 1: strings of equal surroundings in a smaller document, decided. Kind 2: the
    first of each class of surroundings, where another document has the anchor in others with an equal side, to be compared byte by byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        held: list[tuple[bytes, bytes, bytes, bytes, bytes, bytes]] = []
        now = -1

        def rows(kind: int, doc: np.ndarray, part: np.ndarray | None, at: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
            for s in range(0, len(doc), 1 << 16):
                e = s + (1 << 16)
                n = len(doc[s:e])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *(pa.array(np.zeros(n, np.int64) if x is None else x[s:e].astype(np.int64)) for x in (doc, part, at, h))], names=["kind", "doc", "part", "at", "h"])

        def meet() -> Iterator[pa.RecordBatch]:
            h, c, side, doc, at = (np.concatenate([_unplanes(p[k], w) for p in held]) for k, w in ((0, 5), (1, 6), (2, 6), (3, 8), (5, 8)))
            doc = doc.astype(np.int64)
            part = np.concatenate([_parts(p[4], len(p[3]) // 8) for p in held]) if any(p[4] for p in held) else None
            order, new_h, new_c = _leaders(h, c, doc)
            h, doc, part, at = h[order], doc[order], None if part is None else part[order], at[order]
            class_of = np.cumsum(new_c) - 1
            least = doc[new_c]
            later = doc > least[class_of]
            yield from rows(1, doc[later], None if part is None else part[later], at[later], h[later])
            heads = np.flatnonzero(new_h[new_c])
            several = np.repeat(np.minimum.reduceat(least, heads) < np.maximum.reduceat(least, heads), np.diff(np.concatenate([heads, [len(least)]])))
            ask = np.flatnonzero(several[class_of] & ~later)
            ask = ask[_beside(h[ask], side[order[ask]], doc[ask])]
            yield from rows(2, doc[ask], None if part is None else part[ask], at[ask], h[ask] | np.uint64(now % (1 << 23)) << np.uint64(40))

        for batch in batches:
            for kind, bucket, h, c, side, doc, part, at in zip(*(col.to_pylist() for col in batch.columns)):
                if kind == 1:
                    d = _unplanes(doc, 8).astype(np.int64)
                    yield from rows(1, d, _parts(part, len(d)), _unplanes(at, 8), np.zeros(len(d), np.uint64))
                    continue
                if bucket != now and held:
                    yield from meet()
                    held.clear()
                now = bucket
                held.append((h, c, side, doc, part, at))
        if held:
            yield from meet()

    spread = F.when(F.col("kind") == 1, F.pmod(F.xxhash64("doc"), F.lit(buckets)).cast("int")).otherwise(F.col("bucket"))
    dealt = payloads.withColumn("deal", spread).repartition(common.fan_out(payloads.sparkSession), "deal").sortWithinPartitions("kind", "bucket")
    return dealt.select("kind", "bucket", "h", "c", "side", "doc", "part", "at").mapInArrow(run, _FOUND)


def _places(found: DataFrame, kind: int) -> DataFrame:
    """Per document and part, its places of one kind."""
    return found.where(F.col("kind") == kind).groupBy(F.col("doc").alias("_doc"), F.col("part").alias("_part")).agg(F.collect_list(F.struct("at", "h")).alias("_at"))


def _contexts(squeezed: DataFrame, places: DataFrame) -> DataFrame:
    """Rows (h, doc, part, at, data): the bytes of the strings that an anchor has in a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tokens.forget()
        for batch in batches:
            for doc, part, packed, places_ in zip(*(batch.column(c) for c in ("_doc", "_part", "_data", "_at"))):
                data = zstandard.decompress(packed.as_py())
                at, h = (places_.values.field(k).to_numpy() for k in ("at", "h"))
                start, count = at >> 5, (at & 31) + 1
                cut = [data[s : s + n + SPAN - 1] for s, n in zip(start.tolist(), count.tolist())]
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(n, doc.as_py())), pa.array(np.full(n, part.as_py())), pa.array(at), pa.array(cut, pa.binary())], names=["h", "doc", "part", "at", "data"])

    joined = squeezed.join(places, ["_doc", "_part"]).select("_doc", "_part", "_data", "_at")
    return joined.mapInArrow(run, "h bigint, doc bigint, part bigint, at bigint, data binary")


def _compared(contexts: DataFrame) -> DataFrame:
    """Kind 1 rows for the strings of contexts that a smaller document has at the same anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]] = []
        size = 0

        def compare(upto: int) -> pa.RecordBatch:
            """All held rows but the last ``upto`` (an anchor that may go on)."""
            h, doc, part, at = (np.concatenate([x[k] for x in held]) for k in range(4))
            texts = [t for x in held for t in x[4]]
            held[:] = [(h[upto:], doc[upto:], part[upto:], at[upto:], texts[upto:])]
            h, doc, part, at, texts = h[:upto], doc[:upto], part[:upto], at[:upto], texts[:upto]
            data = np.frombuffer(b"".join(texts), np.uint8)
            lengths = np.fromiter(map(len, texts), np.int64, upto)
            begin = np.cumsum(lengths) - lengths
            count = lengths - SPAN + 1
            row = np.repeat(np.arange(upto), count)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            starts = begin[row] + inner
            prefix = prefix_hashes(data)
            anchor = _anchor_in(prefix, begin)  # strings are equal only at equal distance from the anchor
            new = np.concatenate([[True], h[1:] != h[:-1]])
            group = (np.cumsum(new) - 1)[row] * 64 + (anchor[row] - inner)
            # a string whose hash no other document has in its group is not sorted
            order = np.flatnonzero(_shared(mix(range_hash(prefix, starts, starts + SPAN) + group.astype(np.uint64) * _MIX), doc[row]))
            order = order[np.argsort(group[order], kind="stable")]
            gone = np.zeros(len(row), bool)
            gone[order] = repeated_starts(data, prefix, starts[order], doc[row[order]], group[order])
            edge = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
            brk = np.flatnonzero(gone[1:] & gone[:-1] & (row[1:] != row[:-1])) + 1
            s, e = np.sort(np.concatenate([np.flatnonzero(edge == 1), brk])), np.sort(np.concatenate([np.flatnonzero(edge == -1), brk]))
            where = ((at[row[s]] >> 5) + inner[s]) << 5 | (e - s - 1)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(s), 1, np.int32)), pa.array(doc[row[s]]), pa.array(part[row[s]]), pa.array(where), pa.array(np.zeros(len(s), np.int64))], names=["kind", "doc", "part", "at", "h"])

        for batch in batches:
            h, doc, part, at = (batch.column(k).to_numpy() for k in range(4))
            held.append((h, doc, part, at, batch.column(4).to_pylist()))
            size += len(h)
            if size >= 1 << 15:
                last = len(np.concatenate([x[0] for x in held])) - int(sum((x[0] == h[-1]).sum() for x in held))
                if last:
                    yield compare(last)
                    size = len(held[0][0])
        if held and size:
            yield compare(sum(len(x[0]) for x in held))

    dealt = contexts.repartition(common.fan_out(contexts.sparkSession), "h").sortWithinPartitions("h")
    return dealt.mapInArrow(run, _FOUND)


def _anchor_in(prefix: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Distance of the anchor from the start of each context: the last least hash of its first string."""
    at = begin[:, None] + np.arange(_WINDOW)
    h = mix(range_hash(prefix, at, at + ANCHOR)) & ~_LOW24
    return _WINDOW - 1 - np.argmin(h[:, ::-1], axis=1)


def removals(docs: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """Rows (_doc, _part, _at): per document the places (first byte << 5 | strings - 1) of strings of SPAN bytes that start in a smaller one.

    Every string of SPAN bytes has one anchor (about one in sixteen positions is one), equal strings at equal places. Anchors meet by hash, many to a row,
    without texts; the first of equal surroundings stands for all in later steps. Where surroundings differ but one side of the anchor is equal, the bytes
    around the anchors are fetched, their suffixes sorted with hash-compared extensions, and equal ones verified.
    """
    marked = (_marked(docs) if marked is None else marked).select("_doc", "_part", "_data")
    buckets = 8 * common.fan_out(docs.sparkSession)
    found = written(_met(_anchored(marked, buckets), buckets), "anchors")
    contexts = _contexts(_squeezed(marked), _places(found, 2))
    more = written(_compared(contexts), "compared")
    return _places(found.where("kind = 1").unionByName(more), 1)


def remove_repeats(docs: DataFrame, carry: Sequence[str] = (), as_text: bool = False) -> DataFrame:
    """Rows (doc_id, kept, n_bytes, n_removed, n_spans, and the carried columns): the bytes of each document without those covered by a string of SPAN bytes that also
    starts in a document with a smaller doc_id. Strings are judged on the input; overlaps count; matches never cross documents.

    Null text: empty. Null doc_id: after all others, and not before one another. Rows with the same doc_id are one document: its texts do not remove
    from one another. Texts under SPAN bytes are whole. An empty table gives no rows; other columns than the
    carried ones are left out. ``as_text``: kept is a string, without characters that lost a byte.
    """
    marked = _marked(docs, carry)
    places = removals(docs, marked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tokens.forget()
        for batch in batches:
            for part in common.slices(batch, "_data", 1 << 20):  # compressed: some 3 MB of texts
                out: list[tuple] = []
                for doc, packed, at in zip(part.column("_doc").to_pylist(), part.column("_data").to_pylist(), part.column("_at")):
                    data = zstandard.decompress(packed)
                    kept, removed, spans = data, 0, 0
                    if at.is_valid:
                        places_ = at.values.field("at").to_numpy()
                        start = places_ >> 5
                        cover = np.zeros(len(data) + 1, np.int32)
                        np.add.at(cover, start, 1)
                        np.add.at(cover, start + (places_ & 31) + SPAN, -1)
                        gone = np.cumsum(cover[:-1]) > 0
                        removed, spans = int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    if as_text:
                        kept = kept.decode("utf-8", "ignore")
                    out.append((None if doc == _NONE else doc, kept, len(data), removed, spans))
                kinds = (pa.int64(), pa.string() if as_text else pa.binary(), pa.int64(), pa.int64(), pa.int64())
                made = [pa.array(v, t) for v, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds]
                yield pa.RecordBatch.from_arrays([*made, *(part.column(c) for c in range(3, part.num_columns))], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", *carry])

    joined = _squeezed(marked).join(places, ["_doc", "_part"], "left").select("_doc", "_data", "_at", *carry)
    carried = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return joined.mapInArrow(run, f"doc_id bigint, kept {'string' if as_text else 'binary'}, n_bytes bigint, n_removed bigint, n_spans bigint{carried}")
