"""Terms found in texts with an automaton over the terms: one pass over each text, no table of substrings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from marginalia.session import written

#: Characters of the terms of one automaton; more terms are dealt over several, and texts pass each of them.
SHARD_CHARS = 2_000_000
#: Characters of the texts of one stripe, where terms fill several automata.
STRIPE_CHARS = 20_000_000
#: Found terms that are sent on together, about.
ROWS = 20_000


def contained_terms(
    docs: DataFrame, terms: DataFrame, term: str, keys: Sequence[str], around: tuple[str, str] | None = None
) -> DataFrame:
    """(keys, term) for every text (column ``text``) that contains the term; empty terms and null texts find nothing.

    With ``around`` also ``place``: where the term first stands between these two strings, from 0 (-1: nowhere).

    Terms are hashed into shards of bounded size. Texts are dealt over stripes; a stripe first gets its shard's terms, builds the automaton, and
    then streams its texts, so the terms travel once per stripe and a text once per shard; the more
    shards there are, the fewer stripes. Keys must tell the texts apart.
    """
    wanted = written(terms.select(term).where(F.length(term) > 0).distinct(), "terms")
    chars = wanted.agg(F.coalesce(F.sum(F.length(term)), F.lit(0))).first()[0]
    spark, keys = docs.sparkSession, list(keys)
    shards = max(1, -(-chars // SHARD_CHARS))
    stripes = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if shards > 1:  # every stripe builds all automata, so there are no more than keep the tasks busy, or than the texts fill
        size = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
        stripes = min(stripes, max(-(-stripes // shards), -(-size // STRIPE_CHARS)))
    numbers = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    shard = F.pmod(F.xxhash64(term), F.lit(shards))
    left = wanted.select(F.col(term).alias("_term"), F.explode(F.transform(numbers(stripes), lambda s: (s * shards + shard).cast("int"))).alias("_place"))
    stripe = F.pmod(F.xxhash64(*keys), F.lit(stripes))
    right = docs.where("text IS NOT NULL").select(*keys, F.col("text").alias("_text"), F.explode(F.transform(numbers(shards), lambda s: (stripe * shards + s).cast("int"))).alias("_place"))
    # Text rows have no term; nulls last puts the terms first.
    both = left.unionByName(right, allowMissingColumns=True)
    ordered = both.repartitionById(stripes * shards, "_place").sortWithinPartitions("_place", F.col("_term").asc_nulls_last())
    schema = t.StructType([*[t.StructField(k, docs.schema[k].dataType) for k in keys], t.StructField(term, t.StringType()), t.StructField("place", t.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, place, open_ = None, None, False
        for batch in batches:
            owners, found, at = [], [], []
            rows = zip(batch.column("_place").to_pylist(), batch.column("_term").to_pylist(), batch.column("_text").to_pylist())
            for i, (now, word, text) in enumerate(rows):
                if now != place:
                    finder, place, open_ = ahocorasick.Automaton(), now, True
                if word is not None:
                    finder.add_word(word, word)
                    continue
                if open_:
                    finder.make_automaton()
                    open_ = False
                if not len(finder):
                    continue
                hits = _framed(finder, text, *around) if around else dict.fromkeys((w for _, w in finder.iter(text)), -1)
                owners += [i] * len(hits)
                found += hits
                at += hits.values()
                if len(owners) >= ROWS:
                    yield out(batch, owners, found, at)
                    owners, found, at = [], [], []
            if owners:
                yield out(batch, owners, found, at)

    def out(batch: pa.RecordBatch, owners: list[int], found: list[str], at: list[int]) -> pa.RecordBatch:
        held = pa.array(owners, pa.int64())
        return pa.RecordBatch.from_arrays([*(batch.column(k).take(held) for k in keys), pa.array(found, pa.string()), pa.array(at, pa.int32())], names=[*keys, term, "place"])

    found = ordered.mapInArrow(run, schema)
    return found if around else found.drop("place")


def _framed(finder: ahocorasick.Automaton, text: str, before: str, after: str) -> dict[str, int]:
    """Each term found and the first place of ``before`` + term + ``after``, or -1."""
    hits: dict[str, int] = {}
    for end, word in finder.iter(text):
        if hits.get(word, -1) < 0:
            start = end + 1 - len(word) - len(before)
            whole = start >= 0 and text.startswith(before, start) and text.startswith(after, end + 1)
            hits[word] = start if whole else -1
    return hits
