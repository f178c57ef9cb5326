"""Line dedup with DataFrame functions alone: range-partitioned line hashes, first occurrences, keep bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.session import written

#: What is stripped from both ends of a line.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents with ids this close share a block: a line that is everywhere makes one group per block, not one.
BLOCK = 4096


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased and nothing else."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_count(text: Column) -> Column:
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit("\n")) + 1).cast("bigint")


def _text_hash(text: Column) -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _varint(n: Column) -> Column:
    """Hexadecimal digits of a number in groups of seven bits, the highest first, all but the last with the top bit set."""
    groups = [F.lpad(F.hex(F.shiftright(n, 7 * k).bitwiseAND(F.lit(127)).bitwiseOR(F.lit(128 if k else 0))), 2, "0") for k in range(4, -1, -1)]
    return F.concat(*[F.when(F.shiftright(n, 7 * k) > 0, g).otherwise("") for k, g in zip(range(4, 0, -1), groups)], groups[-1])


def runs_in(bitmap: Column) -> Column:
    """Run lengths of a bitmap: kept, dropped, kept, ... lines."""
    codes = F.regexp_extract_all(F.hex(bitmap), F.lit("((?:[89A-F][0-9A-F])*[0-7][0-9A-F])"), F.lit(1))
    byte = lambda code, i: F.conv(F.substring(code, i * 2 + 1, 2), 16, 10).cast("bigint").bitwiseAND(F.lit(127))
    places = lambda code: F.sequence(F.lit(0), (F.length(code) / 2 - 1).cast("int"))
    return F.transform(codes, lambda code: F.aggregate(places(code), F.lit(0).cast("bigint"), lambda acc, i: acc * 128 + byte(code, i)))


def kept_text(text: Column, bitmap: Column) -> Column:
    """The kept lines joined by newlines; the whole text (null: empty) where there is no bitmap."""
    bits = F.flatten(F.transform(runs_in(bitmap), lambda n, i: F.array_repeat(i % 2 == 0, n.cast("int"))))
    marked = F.arrays_zip(_lines(text).alias("line"), bits.alias("keep"))
    kept = F.transform(F.filter(marked, lambda m: m["keep"]), lambda m: m["line"])
    return F.when(bitmap.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(kept, "\n"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Rows (doc_id, text_hash, n_dropped, keep_bitmap) of the documents that lose a line, one per doc_id and text; all others keep every line.

    A key (see ``line_key``) of at least ``min_chars`` code points that at least ``min_docs`` documents hold stays in the one with the largest doc_id,
    in all its lines there, and goes everywhere else. A document is a doc_id: rows of one id count once and are told apart by ``text_hash``;
    rows without an id are one document, below all others. Null text: one empty line. Repeated rows lose the same lines. Other columns play no part.

    Lines travel as two 64-bit hashes of their key, in ranges of the hash and blocks of the id, sorted by document and position; in that order the
    first occurrences are marked, and a line's blocks are added up. Only lines that go reach the last shuffle, by document. A bitmap is one bit a line,
    run-length coded: lengths of kept and dropped runs by turns, seven bits a byte (see ``runs_in``).
    """
    # The text's hash and lines are made once a document, in front of the explode.
    whole = docs.select(F.col("doc_id").cast("bigint").alias("doc"), _text_hash(F.col("text")).alias("t"), line_count(F.col("text")).alias("lines"), _lines(F.col("text")).alias("all"))
    rows = whole.select("doc", "t", "lines", F.posexplode("all").alias("pos", "line"))
    rows = rows.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    block = F.coalesce(F.floor(F.col("doc") / BLOCK), F.pmod(F.col("t"), F.lit(BLOCK)) - (1 << 62))
    lines = rows.select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"), block.alias("block"), "doc", "t", F.col("pos").cast("bigint").alias("pos"), "lines")
    group = ("h", "g", "block")
    order = [F.col("doc").desc_nulls_last(), F.col("t"), F.col("pos")]
    ranged = lines.repartitionByRange(*group).sortWithinPartitions(*group, *order)
    along = Window.partitionBy(*group).orderBy(*order)
    first = (F.row_number().over(along) == 1) | ~F.lag("doc").over(along).eqNullSafe(F.col("doc"))
    seen = written(ranged.withColumn("first", first), "lines")
    # Blocks hold different ids, so first occurrences add up; rows without an id lie in many blocks and count once.
    counts = seen.groupBy("h", "g").agg(F.count_if(F.col("first") & F.col("doc").isNotNull()).alias("n"), F.max(F.col("doc").isNull().cast("int")).alias("bare"), F.max("doc").alias("stays"))
    common = written(counts.where(F.col("n") + F.col("bare") >= min_docs).select("h", "g", "stays"), "common")  # so that a line that is everywhere can be split in the join
    gone = seen.join(common, ["h", "g"]).where(~F.col("doc").eqNullSafe(F.col("stays")))

    # Kept lines before a dropped one: its position less the number of dropped ones before it. Equal within a run.
    own = Window.partitionBy("doc", "t")
    numbered = gone.withColumn("kept", F.col("pos") - F.dense_rank().over(own.orderBy("pos")) + 1)
    runs = numbered.groupBy("doc", "t", "kept").agg((F.max("pos") - F.min("pos") + 1).alias("lost"), F.max("lines").alias("lines"))
    coded = runs.withColumn("code", F.concat(_varint(F.col("kept") - F.lag("kept", 1, 0).over(own.orderBy("kept"))), _varint(F.col("lost"))))
    bitmaps = coded.groupBy("doc", "t").agg(
        F.sum("lost").alias("n_dropped"), (F.max("lines") - F.sum("lost") - F.max("kept")).alias("tail"), F.sort_array(F.collect_list(F.struct("kept", "code"))).alias("codes"))
    return bitmaps.select(F.col("doc").alias("doc_id"), F.col("t").alias("text_hash"), "n_dropped", F.unhex(F.concat(F.array_join("codes.code", ""), _varint(F.col("tail")))).alias("keep_bitmap"))


def drop_lines(docs: DataFrame, carry: tuple[str, ...] = (), min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Rows (doc_id, carried columns, n_lines, n_dropped, keep_bitmap, kept) of every row of ``docs``; ``kept`` is the text that its bitmap leaves.

    See ``keep_bitmaps``. Carried columns go by names of their own until the end, so they clash with these alone. An empty table gives no rows.
    """
    lost = keep_bitmaps(docs, min_chars, min_docs).select(F.col("doc_id").alias("_doc"), "text_hash", "n_dropped", "keep_bitmap")
    names = {c: f"_c{i}" for i, c in enumerate(carry)}
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    own = own.withColumn("_hash", _text_hash(F.col("text"))).withColumn("n_lines", line_count(F.col("text")))
    both = own.join(lost, own["doc_id"].eqNullSafe(lost["_doc"]) & (own["_hash"] == lost["text_hash"]), "left")
    kept = kept_text(F.col("text"), F.col("keep_bitmap"))
    whole = F.unhex(_varint(F.col("n_lines")))
    return both.select(
        "doc_id", *[F.col(n).alias(c) for c, n in names.items()], "n_lines", F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"),
        F.coalesce("keep_bitmap", whole).alias("keep_bitmap"), kept.alias("kept"))
