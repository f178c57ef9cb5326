"""Printed page numbers from page texts: candidates, offset votes, confidence, page map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators.ranking import longest_runs, top_k
from marginalia.session import written

# --- Fixed values: thresholds of the confidence rules ---
MIN_MATCHES = 10
MIN_MARGIN = 3.0
HIGH_RATIO, HIGH_RUN = 0.70, 20
MEDIUM_RATIO, MEDIUM_RUN = 0.40, 10
STATUSES = ("AUTO_OK", "MANUAL_OVERRIDE", "WARNING", "MANUAL_REQUIRED")
# ---------------------------------------------------------


def candidates(pages: DataFrame) -> DataFrame:
    """(book, pdf_page, candidates) with the stand-alone numbers near the end of each page."""
    return pages.select("book", "pdf_page", T.page_number_candidates(F.col("text")).alias("candidates"))


def _hits(cands: DataFrame) -> DataFrame:
    each = cands.select("book", "pdf_page", F.explode("candidates").alias("_c"))
    return each.select("book", "pdf_page", (F.col("pdf_page") - F.col("_c")).alias("offset")).where("offset >= 0")


def offset_votes(cands: DataFrame) -> DataFrame:
    """Votes per (book, offset); candidates of a page are distinct, so a page votes once per offset."""
    return _hits(cands).groupBy("book", "offset").agg(F.count(F.lit(1)).alias("votes"))


def offset_evaluation(cands: DataFrame, offsets: DataFrame | None = None) -> DataFrame:
    """Matches, candidate pages, ratio and longest run per (book, offset).

    Every voted offset is evaluated; ``offsets`` adds (book, offset) rows of its own.
    """
    hits = _hits(cands)
    with_candidates = cands.groupBy("book").agg(F.count_if(F.size("candidates") > 0).alias("candidate_page_count"))
    counted = hits.groupBy("book", "offset").agg(F.count(F.lit(1)).alias("match_count"))
    if offsets is not None:
        counted = offsets.select("book", "offset").unionByName(counted.select("book", "offset")).distinct().join(
            counted, ["book", "offset"], "left")
    runs = longest_runs(hits, ["book", "offset"], "pdf_page")
    return (
        counted.join(runs, ["book", "offset"], "left")
        .join(with_candidates, "book")
        .select(
            "book", "offset",
            F.coalesce("match_count", F.lit(0)).alias("match_count"),
            "candidate_page_count",
            F.when(F.col("candidate_page_count") > 0, F.coalesce("match_count", F.lit(0)) / F.col("candidate_page_count"))
            .otherwise(0.0).alias("match_ratio"),
            F.coalesce("longest_run", F.lit(0)).alias("longest_run"),
        )
    )


def best_offset(evaluated: DataFrame) -> DataFrame:
    """Best offset per book by matches, run and ratio, with the match count of the runner-up."""
    order = [F.col("match_count").desc(), F.col("longest_run").desc(), F.col("match_ratio").desc(), F.col("offset")]
    two = top_k(evaluated.where("match_count > 0"), ["book"], order, 2)
    first = two.where("rank = 1").drop("rank")
    second = two.where("rank = 2").select("book", F.col("match_count").alias("second_count"))
    return first.join(second, "book", "left")


def offset_confidence(best: DataFrame) -> DataFrame:
    """Adds ``status`` and ``reason``; a row without an offset needs manual work."""
    n, ratio, run = F.col("match_count"), F.col("match_ratio"), F.col("longest_run")
    close = F.col("second_count").isNotNull() & (n / F.col("second_count") < MIN_MARGIN)
    verdict = (
        F.when(F.col("offset").isNull(), F.struct(F.lit("MANUAL_REQUIRED").alias("status"), F.lit("no page-number candidates").alias("reason")))
        .when(n < MIN_MATCHES, F.struct(F.lit("MANUAL_REQUIRED").alias("status"), F.concat(F.lit("too few matches: "), n.cast("string")).alias("reason")))
        .when(close, F.struct(F.lit("WARNING").alias("status"), F.lit("offset candidates are too close").alias("reason")))
        .when((ratio >= HIGH_RATIO) | (run >= HIGH_RUN), F.struct(F.lit("AUTO_OK").alias("status"), F.lit("high confidence").alias("reason")))
        .when((ratio >= MEDIUM_RATIO) | (run >= MEDIUM_RUN), F.struct(F.lit("WARNING").alias("status"), F.lit("medium confidence").alias("reason")))
        .otherwise(F.struct(F.lit("MANUAL_REQUIRED").alias("status"), F.lit("low confidence").alias("reason")))
    )
    return best.withColumn("_v", verdict).withColumn("status", F.col("_v.status")).withColumn("reason", F.col("_v.reason")).drop("_v")


def offset_override(decided: DataFrame, evaluated: DataFrame, overrides: DataFrame) -> DataFrame:
    """A manual offset wins; its own evaluation is reported. A negative offset stops the job."""
    manual = overrides.select(
        "book",
        F.when(F.col("offset") < 0, F.raise_error(F.lit("negative override offset")).cast("bigint")).otherwise(F.col("offset")).alias("offset"),
    ).join(evaluated, ["book", "offset"], "left").select(
        "book", "offset",
        F.coalesce("match_count", F.lit(0)).alias("match_count"), "candidate_page_count",
        F.coalesce("match_ratio", F.lit(0.0)).alias("match_ratio"), F.coalesce("longest_run", F.lit(0)).alias("longest_run"),
        F.lit("MANUAL_OVERRIDE").alias("status"), F.lit("manual offset override").alias("reason"),
        F.lit("manual_override").alias("detection_source"),
    )
    auto = decided.join(overrides.select("book"), "book", "left_anti").withColumn("detection_source", F.lit("auto"))
    return manual.unionByName(auto.select(*manual.columns))


def page_map_build(pages: DataFrame, decided: DataFrame) -> DataFrame:
    """Printed page per physical page of every book that has an offset; null before page 1."""
    return (
        pages.select("book", "pdf_page")
        .join(decided.where(F.col("offset").isNotNull()).select("book", "offset", "detection_source"), "book")
        .select(
            "book", "pdf_page",
            F.when(F.col("pdf_page") - F.col("offset") >= 1, F.col("pdf_page") - F.col("offset")).alias("logical_page"),
            F.col("detection_source").alias("source"),
        )
    )


def status_summary(rows: DataFrame, statuses=STATUSES) -> DataFrame:
    """Counts by status in fixed order, zeros included."""
    names = rows.sparkSession.createDataFrame([(i, s) for i, s in enumerate(statuses)], "pos INT, status STRING")
    return (
        names.join(rows.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", "left")
        .select("pos", "status", F.coalesce("n", F.lit(0)).alias("n"))
    )


def page_map_job(pages: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(status per book, page map) for all books in one job."""
    cands = written(candidates(pages), "page-numbers")  # the texts are read once
    evaluated = written(offset_evaluation(cands, overrides), "offsets")
    books = cands.select("book").distinct()
    decided = offset_confidence(books.join(best_offset(evaluated), "book", "left"))
    status = offset_override(decided, evaluated, overrides)
    return status, page_map_build(cands, status)
