"""Quality rules: repetition and length counts, and perplexity bands of an n-gram model counted by Spark.

The model is a modified Kneser-Ney model of order 4 over all code points, one per language. Its n-grams are rows of a table: Spark counts
and smooths them with joins, so the model grows with the corpus and is neither broadcast nor collected. To score, the documents are dealt
into chunks; a chunk asks for its distinct n-grams, meets them by an equality join, and looks them up in sorted hash arrays. (A model of
words would need about one row for every word of a large crawl, as most word triples occur once.)
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm import common, tokens
from marginalia.session import written

ORDER = 4
#: Stands before every text; a text that holds this noncharacter itself counts it as such.
START = "\uffff"
#: The probability that is left after the shortest n-gram is shared by all code points.
CODE_POINTS = 0x110000


@functools.cache
def _letters() -> np.ndarray:
    """Which code points count as letters: the bits of a text are divided by these, so that signs among words cost extra."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LMN" for c in range(CODE_POINTS)), bool, CODE_POINTS)


def _mixed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes whose bits all depend on each other, in place."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(31)
    return h


def _seed(lang: str | None) -> int:
    import xxhash

    return 0 if lang is None else xxhash.xxh64_intdigest(lang.encode(), 42)


def ngrams(texts: Sequence[str], langs: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts, each behind starts; where their n-grams end; a 64-bit hash of each with its language; n-grams per text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    front = START * (ORDER - 1)
    points = np.frombuffer(front.join(["", *texts]).encode("utf-32-le"), np.uint32)
    points = np.maximum(points, 1)  # NUL counts as U+0001
    ends = np.arange(lengths.sum()) + np.repeat(np.arange(1, len(texts) + 1) * (ORDER - 1), lengths)
    wide = points.astype(np.uint64)
    hashes = np.repeat(np.fromiter(map(_seed, langs), np.uint64, len(langs)), lengths)
    sums = np.zeros(max(len(wide) - ORDER + 1, 0), np.uint64)
    for back in range(ORDER):
        sums += wide[ORDER - 1 - back : len(wide) - back] * np.uint64(pow(0x9E3779B97F4A7C15, back + 1, 1 << 64))
    hashes += sums[ends - (ORDER - 1)]
    return points, ends, _mixed(hashes), lengths


def _starts(keys: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    """For each value of the leading bits: where sorted hashes with these begin; and how far a hash is shifted to get its leading bits."""
    shift = np.uint64(64 - min(24, len(keys).bit_length() + 3))
    sizes = np.bincount((keys >> shift).astype(np.int64), minlength=1 << (64 - int(shift)))
    return np.minimum(np.cumsum(sizes) - sizes, max(len(keys) - 1, 0)).astype(np.int32), shift


def _found(keys: np.ndarray, hashes: np.ndarray, begins: tuple[np.ndarray, np.uint64] | None = None) -> np.ndarray:
    """Places of hashes in a sorted array that has them all: by their leading bits, by binary search where these are shared."""
    starts, shift = begins or _starts(keys)
    at = starts[(hashes >> shift).astype(np.int64)]
    other = np.flatnonzero(keys[at] != hashes)
    at[other] = np.searchsorted(keys, hashes[other])
    return at


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


#: Bytes of texts that a task hashes at a time. Its arrays take some fifty times as much.
SLICE = 1 << 20


def _packed(docs: DataFrame, text: str, size: str) -> DataFrame:
    """The rows with their text compressed on its own and, in ``size``, its bytes: what is shuffled is smaller than by blocks of rows."""
    kept = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in batches:
            for part in common.slices(batch, text):
                raw = [t.encode() for t in _texts(part.column(text))]
                small = pa.array([pa.compress(t, codec="zstd", asbytes=True) for t in raw], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), small, pa.array([len(t) for t in raw], pa.int64())], names=[*kept, text, size])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]
    return docs.select(*kept, text).mapInArrow(run, ", ".join([*kinds, f"`{text}` binary", f"`{size}` bigint"]))


def _unpacked(part: pa.RecordBatch) -> list[str]:
    return [pa.decompress(t, n, codec="zstd", asbytes=True).decode() for t, n in zip(part.column("_text").to_pylist(), part.column("_size").to_pylist())]


def count_ngrams(docs: DataFrame) -> DataFrame:
    """Rows (lang, gram, n) of all n-grams of order ``ORDER`` over all whole texts: counted per task, then summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            columns = [np.concatenate(c) for c in zip(*held)]
            keys, first, where = np.unique(columns[0], return_index=True, return_inverse=True)
            return keys, np.bincount(where, columns[1], len(keys)).astype(np.int64), columns[2][first], columns[3][first]

        def rows() -> Iterator[pa.RecordBatch]:
            keys, n, grams, langs = merged()
            for s in range(0, len(keys), 1 << 16):
                cut = slice(s, s + (1 << 16))
                arrays = [pa.array(langs[cut], pa.string()), pa.array(grams[cut], pa.string()), pa.array(n[cut])]
                yield pa.RecordBatch.from_arrays(arrays, names=["lang", "gram", "n"])

        for batch in batches:
            for part in common.slices(batch, "text", SLICE):
                langs, texts = part.column(0).to_pylist(), _texts(part.column(1))
                points, ends, hashes, lengths = ngrams(texts, langs)
                if not len(hashes):
                    continue
                keys, n = np.unique(hashes, return_counts=True)
                first = np.empty(len(keys), np.int64)
                first[_found(keys, hashes)] = np.arange(len(hashes))
                at = ends[first]
                grams = np.ascontiguousarray(points[at[:, None] + np.arange(1 - ORDER, 1)]).view(f"<U{ORDER}").ravel().astype(object)
                named = np.empty(len(langs), object)
                named[:] = langs
                held.append((keys, n, grams, named[np.searchsorted(np.cumsum(lengths), first, "right")]))
                if len(held) >= 32:
                    held[:] = [merged()]
                    if len(held[0][0]) > HELD:
                        yield from rows()
                        held.clear()
        if held:
            yield from rows()

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, gram string, n bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def hashed(grams: DataFrame) -> DataFrame:
    """The counted n-grams with h, their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in batches:
            if batch.num_rows:
                h = ngrams(batch.column("gram").to_pylist(), batch.column("lang").to_pylist())[2][ORDER - 1 :: ORDER]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h.view(np.int64))], names=[*batch.schema.names, "h"])

    return grams.select("lang", "gram", "n").mapInArrow(run, "lang string, gram string, n bigint, h bigint")


#: A counting task passes its n-grams on when it holds more than so many.
HELD = 1 << 21


def _discounts(n: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts (_d1, _d2, _d3) of each language, for counts of 1, 2, and 3 or more; without n-grams that occur once
    or twice Y is 1/2."""
    times = [F.count(F.when(F.col("n") == k, 1)) for k in (1, 2, 3, 4)]
    rows = n.groupBy(F.col("lang").alias("_lang")).agg(*[t.alias(f"_t{k}") for k, t in enumerate(times, 1)])
    y = F.when((F.col("_t1") > 0) & (F.col("_t2") > 0), F.col("_t1") / (F.col("_t1") + 2 * F.col("_t2"))).otherwise(0.5)

    def of(k: int) -> Column:
        d = F.when(F.col(f"_t{k}") > 0, k - (k + 1) * y * F.col(f"_t{k + 1}") / F.col(f"_t{k}")).otherwise(k * y)
        return F.least(F.greatest(d, F.lit(0.05)), F.lit(k - 0.05)).alias(f"_d{k}")

    return rows.select("_lang", of(1), of(2), of(3))


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def fit(grams: DataFrame) -> DataFrame:
    """Rows (lang, gram, h, n, p, alone) of the counted n-grams of order ``ORDER``: p is the probability of the last code point after those
    before it, alone the same for a text that holds all occurrences of the n-gram: as if the n-gram was not there, nor the shorter ones at
    its end that stand behind nothing else.

    Lower orders count the distinct code points in front of an n-gram. From one code point up, an order gives its discounted share plus
    its context's left-over weight times the probability in the order below. Every step is an aggregate or a join on (lang, n-gram).
    """
    levels = [grams]
    for order in range(ORDER - 1, 0, -1):
        shorter = levels[-1].groupBy("lang", F.right("gram", F.lit(order)).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        levels.append(written(shorter, "level"))
    below = None
    for order, level in enumerate(reversed(levels), 1):
        cut = F.when(F.col("n") == 1, F.col("_d1")).when(F.col("n") == 2, F.col("_d2")).otherwise(F.col("_d3"))
        known = level.join(_discounts(level), _same("lang", "_lang")).withColumn("_cut", cut).drop("_lang", "_d1", "_d2", "_d3")
        known = known.withColumn("_context", F.left("gram", F.lit(order - 1)))
        contexts = known.groupBy(F.col("lang").alias("_l"), F.col("_context").alias("_c")).agg(F.sum("n").alias("_total"), F.sum("_cut").alias("_free"))
        met = known.join(contexts, _same("lang", "_l") & (F.col("_context") == F.col("_c"))).drop("_l", "_c")
        if below is None:
            low = alone = F.lit(1.0 / CODE_POINTS)
        else:
            lower = below.select(F.col("lang").alias("_l"), F.col("gram").alias("_c"), F.col("p").alias("_p"), F.col("alone").alias("_alone"))
            met = met.join(lower, _same("lang", "_l") & (F.right("gram", F.lit(order - 1)) == F.col("_c")))
            low, alone = F.col("_p"), F.col("_alone")
        p = (F.col("n") - F.col("_cut") + F.col("_free") * low) / F.col("_total")
        alone = F.col("_free") * alone / F.col("_total")
        if order < ORDER:
            smoothed = met.select("lang", "gram", p.alias("p"), F.when(F.col("n") == 1, alone).otherwise(p).alias("alone"))
        else:
            smoothed = met.select("lang", "gram", "h", "n", p.alias("p"), alone.alias("alone"))
        below = written(smoothed, "smoothed")
    return below


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text."""
    data = text.encode()
    words = data.split()
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    symbols = sum(data.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    lines = [line for line in data.split(b"\n") if line.strip()]
    repeated = 0
    if len(words) >= 4:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        m = len(number)
        if m < 1 << 21:
            grams = (ids[:-2] * m + ids[1:-1]) * m + ids[2:]
        else:
            pairs = np.unique(ids[:-1] * m + ids[1:], return_inverse=True)[1]
            grams = pairs[:-1].astype(np.int64) * m + ids[2:]
        order = np.sort(grams)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            hit = np.isin(grams, twice)
            cover = np.zeros(len(ids), bool)
            for k in range(3):
                cover[k : k + len(hit)] |= hit
            repeated = int(cover.sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def scored(docs: DataFrame, model: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """The carried columns with the base counts, base_failed and ``_bits`` (log2 probability by letter; null for a text without letters).

    ``model`` is the fitted table of all n-grams of these documents. Texts are shuffled once, into chunks by a hash of the row, as many as
    the session has shuffle tasks; the same exchange feeds the chunk's list of distinct n-grams and its scoring. A text travels compressed.
    """
    fields = [docs.schema[c] for c in carry]
    chunk = F.pmod(F.xxhash64("text", *carry), F.lit(common.fan_out(docs.sparkSession))).cast("int")
    rows = docs.select(chunk.alias("_chunk"), F.col("text").alias("_text"), F.col("lang").alias("_lang"), *carry)
    dealt = _packed(rows, "_text", "_size").repartition(common.fan_out(docs.sparkSession), "_chunk")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            chunks = batch.column("_chunk").to_numpy()
            for c in np.unique(chunks):
                for part in common.slices(batch.filter(pa.array(chunks == c)), "_size", SLICE):
                    own = held.setdefault(int(c), [])
                    own.append(np.unique(ngrams(_unpacked(part), part.column("_lang").to_pylist())[2]))
                    if len(own) >= 32:
                        own[:] = [np.unique(np.concatenate(own))]
        for c, own in held.items():
            keys = np.unique(np.concatenate(own)).view(np.int64)
            for s in range(0, len(keys), 1 << 16):
                k = keys[s : s + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), c, np.int32)), pa.array(k)], names=["_chunk", "h"])

    def run(rows: pa.Table, grams: pa.Table) -> pa.Table:
        tokens.forget()
        keys = grams.column("h").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        keys, total = keys[order], grams.column("n").fill_null(0).to_numpy()[order]
        log_p, log_alone = (np.log2(grams.column(c).fill_null(1.0).to_numpy()[order].astype(np.float64)) for c in ("p", "alone"))
        begins = _starts(keys) if len(keys) else None
        made = []
        for batch in rows.to_batches():
            for part in common.slices(batch, "_size", SLICE):
                texts = _unpacked(part)
                points, ends, hashes, lengths = ngrams(texts, part.column("_lang").to_pylist())
                bits = np.full(len(texts), np.nan)
                full = lengths > 0
                if full.any():
                    at = (np.cumsum(lengths) - lengths)[full]
                    pairs, own_n = np.unique(np.repeat(np.arange(len(texts)) * len(keys), lengths) + _found(keys, hashes, begins), return_counts=True)
                    text_of, entry = np.divmod(pairs, len(keys))
                    cost = own_n * np.where(own_n == total[entry], log_alone[entry], log_p[entry])
                    sums = np.bincount(text_of, cost, len(texts))[full]
                    letters = np.add.reduceat(_letters()[points[ends]].astype(np.int64), at)
                    bits[full] = np.where(letters > 0, -sums / np.maximum(letters, 1), np.nan)
                stats = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 5)
                failed = (stats[:, 0] < 50) | (100 * stats[:, 4] > 50 * stats[:, 0])
                own = [part.column(c) for c in carry]
                made.append(pa.RecordBatch.from_arrays([*own, *(pa.array(stats[:, k]) for k in range(5)), pa.array(failed), pa.array(bits, pa.float64(), mask=np.isnan(bits))], names=[*carry, *COUNTS, "base_failed", "_bits"]))
        return pa.Table.from_batches(made) if made else pa.table({})

    kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{c} bigint" for c in COUNTS), "base_failed boolean, _bits double"])
    # what several chunks ask for is in several texts: only the rest carry what a text alone with its n-gram needs
    single = F.count(F.lit(1)).over(Window.partitionBy("h")) == 1
    needed = dealt.mapInArrow(asked, "_chunk int, h bigint").withColumn("_single", single)
    parts = needed.join(model.select("h", "n", F.col("p").cast("float"), F.col("alone").cast("float")), "h")
    parts = parts.select("_chunk", "h", F.when(F.col("_single"), F.col("n")).alias("n"), "p", F.when(F.col("_single"), F.col("alone")).alias("alone"))
    return dealt.groupBy("_chunk").cogroup(parts.groupBy("_chunk")).applyInArrow(run, kind)


def bands(rows: DataFrame, below: float, above: float, step: float = 0.001) -> DataFrame:
    """Rows (_l, _low, _high): per language, the median of _bits over documents that pass the base rules, less ``below`` and plus ``above``
    times its quartile distances. Exact over bins of ``step`` bits, so they depend on neither order nor size."""
    counts = rows.where("NOT base_failed AND _bits IS NOT NULL").groupBy(F.col("lang").alias("_l"), F.round(F.col("_bits") / step).cast("bigint").alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    upto = common.running_total(counts, ["_l"], ["_bin"], "_n", "_before")
    whole = counts.groupBy(F.col("_l").alias("_k")).agg(F.sum("_n").alias("_all"))
    ranked = upto.join(whole, F.col("_l").eqNullSafe(F.col("_k")))
    at = [F.min(F.when(F.col("_before") + F.col("_n") >= F.col("_all") * q, F.col("_bin"))) * step for q in (0.25, 0.5, 0.75)]
    q1, q2, q3 = (a for a in at)
    return ranked.groupBy("_l").agg((q2 - below * F.greatest(q2 - q1, F.lit(10 * step))).alias("_low"), (q2 + above * F.greatest(q3 - q2, F.lit(10 * step))).alias("_high"))


def judge(docs: DataFrame, carry: tuple[str, ...] = ("doc_id", "lang"), below: float = 12.0, above: float = 12.0) -> DataFrame:
    """Every document with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, perplexity and kept.

    The model is counted over all documents; an n-gram that only the document itself has does not speak for it. A document is kept if it passes the base rules and its perplexity lies within its
    language's band. Null and empty texts have no perplexity and fail the base rules (no words); a text without
    letters has none either and is not kept. Null language: a language
    of its own. Repeated rows each get a row; an empty table gives no rows. ``carry`` names the columns that come along, in front.
    """
    carry = tuple(dict.fromkeys(carry))
    clash = {*COUNTS, "base_failed", "kept", "perplexity", "_chunk", "_text", "_size", "_lang", "_bits", "_l", "_low", "_high"} & set(carry)
    if clash:
        raise ValueError(f"columns in the way: {sorted(clash)}")
    model = fit(written(hashed(count_ngrams(docs)), "grams"))
    rows = written(scored(docs, model, carry if "lang" in carry else (*carry, "lang")), "scored")
    limits = written(bands(rows, below, above), "bands")
    judged = rows.join(limits, F.col("lang").eqNullSafe(F.col("_l")), "left")
    inside = F.coalesce(F.col("_bits").between(F.col("_low"), F.col("_high")), F.lit(False))
    return judged.select(*carry, *COUNTS, "base_failed", F.pow(F.lit(2.0), "_bits").alias("perplexity"), (~F.col("base_failed") & inside).alias("kept"))
