"""The corpus pipeline: documents in, packed training windows out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm import mixing, packing, perplexity, simhash, substrings
from marginalia.llm.common import table
from marginalia.session import drop_scratch, scratch_folders, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

_made: list[str] = []


def _tidy(stage: Stage, first: bool = False) -> Stage:
    """The stage, which begins by dropping the scratch tables of the one before it (its rows are written by then)."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not first:
            drop_scratch(spark, _made)
        before = set(scratch_folders())
        out = stage(spark, docs, sf_dir)
        _made[:] = [f for f in scratch_folders() if f not in before]
        return out

    return run_stage


def _renamed(docs: DataFrame) -> tuple[dict[str, str], DataFrame]:
    """Every column under a name of its own, beside doc_id, text, lang and source: none can be in an operator's way."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    return names, docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], "doc_id", "text", "lang", "source")


def _restored(df: DataFrame, names: dict[str, str], text: str | None = None) -> DataFrame:
    """The columns of the documents again, with another text and its length if ``text`` names one."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("bigint")} if text else {}
    return df.select(*[new.get(c, F.col(n)).alias(c) for c, n in names.items()])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's perplexity band."""
    names, named = _renamed(docs)
    return _restored(perplexity.judge(named, carry=(*names.values(), "lang")).where("kept"), names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near-duplicates stays: that of the smallest doc_id (a null one after all others), then of the smallest text hash.

    Groups are told apart by their root, not by doc_id: a doc_id that names texts of several groups stays once in each where it is the
    smallest, and a group without any doc_id keeps one row.
    """
    names, named = _renamed(docs)
    hashed = named.withColumn("_h", F.xxhash64("text"))
    grouped = simhash.near_duplicates(hashed, carry=("_h",))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_h").alias("h")))
    first = grouped.groupBy("_root").agg(least.alias("_m")).select(F.col("_m.id").alias("_id"), F.col("_m.h").alias("_first"))
    kept = hashed.join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_first")), "left_semi")
    once = Window.partitionBy("doc_id", "_h").orderBy(F.xxhash64(*names.values()))
    return _restored(kept.withColumn("_n", F.row_number().over(once)).where("_n = 1"), names)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that an earlier one has in a string of 50; a character that loses a byte goes whole."""
    names, named = _renamed(docs)
    return _restored(substrings.remove_repeats(named, carry=tuple(names.values()), as_text=True), names, "kept")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; where a source's share ends within a document, its first words, one space apart."""
    names, named = _renamed(docs)
    mine = mixing.mix(named, carry=(*names.values(), "text")).where("taken > 0")
    copies = mine.withColumn("_k", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    left = F.col("taken") - (F.col("_k") - 1) * F.col("size")
    words = F.slice(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), F.lit(1), left.cast("int"))
    return _restored(copies.withColumn("_text", F.when(left >= F.col("size"), F.col("text")).otherwise(F.concat_ws(" ", words))), names, "_text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", _tidy(quality_rules, first=True)), ("near_dedup", _tidy(near_dedup)), ("suffix_dedup", _tidy(suffix_dedup)),
    ("mix_sources", _tidy(mix_sources)), ("packing", _tidy(pack)),
]

#: Perplexity and suffix comparison have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
