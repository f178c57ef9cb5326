"""Cases for page numbering. Page numbers are printed under the texts by a rule of the data:
most pages carry their position minus 3, pages of other lengths a number from their length."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import pagemap as P
from marginalia.operators.ranking import longest_runs
from marginalia.plans import bindings as B
from marginalia.plans.bindings import sql
from marginalia.plans.registry import case, typed


def numbered(spark, sf):
    p = B.pages(spark, sf)
    foot = F.concat(
        F.lit("\n"), F.when(F.col("n_chars") % 4 != 0, F.col("pdf_page") - 3).otherwise(F.col("n_chars") % 90).cast("string"),
        F.lit("\n \n"), F.when(F.col("n_chars") % 5 == 0, (F.col("pdf_page") + 2).cast("string")).otherwise("note"),
    )
    return p.select("book", "pdf_page", F.concat("text", foot).alias("text"), "n_chars")


B.CTES["numbered"] = (
    ("bpages",),
    "SELECT book, pdf_page, n_chars, text || chr(10) || CAST(CASE WHEN n_chars % 4 <> 0 THEN pdf_page - 3 ELSE n_chars % 90 END AS VARCHAR) || chr(10) || ' ' || chr(10) || "
    "CASE WHEN n_chars % 5 = 0 THEN CAST(pdf_page + 2 AS VARCHAR) ELSE 'note' END AS text FROM bpages")
B.CTES["cands"] = (
    ("numbered",),
    "SELECT DISTINCT book, pdf_page, c FROM (SELECT book, pdf_page, CAST(unnest(list_filter(list_slice(l, greatest(1, len(l) - 9), len(l)), "
    "lambda s: regexp_matches(s, '^[0-9]{1,4}$'))) AS BIGINT) AS c FROM (SELECT book, pdf_page, list_filter(list_transform(string_split(text, chr(10)), "
    "lambda s: trim(s)), lambda s: s <> '') AS l FROM numbered)) WHERE c BETWEEN 1 AND 1000")
B.CTES["hits"] = (("cands",), "SELECT book, pdf_page, pdf_page - c AS off FROM cands WHERE pdf_page >= c")
B.CTES["runs"] = (
    ("hits",),
    "SELECT book, off, max(n) AS longest_run FROM (SELECT book, off, isle, count(*) AS n FROM (SELECT book, off, pdf_page - row_number() OVER "
    "(PARTITION BY book, off ORDER BY pdf_page) AS isle FROM hits) GROUP BY ALL) GROUP BY ALL")
B.CTES["evaluated"] = (
    ("hits", "runs"),
    "SELECT book, off AS \"offset\", m AS match_count, cp AS candidate_page_count, m::DOUBLE / cp AS match_ratio, longest_run FROM "
    "(SELECT book, off, count(*) AS m FROM hits GROUP BY ALL) JOIN runs USING (book, off) JOIN (SELECT book, count(DISTINCT pdf_page) AS cp FROM cands GROUP BY 1) USING (book)")
B.CTES["decided"] = (
    ("evaluated", "bpages"),
    "SELECT *, CASE WHEN \"offset\" IS NULL OR match_count < 10 THEN 'MANUAL_REQUIRED' WHEN match_count / second_count < 3.0 THEN 'WARNING' "
    "WHEN match_ratio >= 0.7 OR longest_run >= 20 THEN 'AUTO_OK' WHEN match_ratio >= 0.4 OR longest_run >= 10 THEN 'WARNING' ELSE 'MANUAL_REQUIRED' END AS status FROM "
    "(SELECT DISTINCT book FROM bpages) LEFT JOIN (SELECT * FROM (SELECT *, lead(match_count) OVER w AS second_count, row_number() OVER w AS rn FROM evaluated "
    "WINDOW w AS (PARTITION BY book ORDER BY match_count DESC, longest_run DESC, match_ratio DESC, \"offset\")) WHERE rn = 1) USING (book)")
# books that end in 5 have a manual offset
B.CTES["status_"] = (
    ("decided",),
    "SELECT d.book, CASE WHEN d.book LIKE '%5' THEN 2 ELSE d.\"offset\" END AS \"offset\", CASE WHEN d.book LIKE '%5' THEN coalesce(e.match_count, 0) ELSE d.match_count END AS match_count, "
    "CASE WHEN d.book LIKE '%5' THEN 'MANUAL_OVERRIDE' ELSE d.status END AS status, CASE WHEN d.book LIKE '%5' THEN 'manual_override' ELSE 'auto' END AS source "
    "FROM decided d LEFT JOIN evaluated e ON e.book = d.book AND e.\"offset\" = 2")


def _overrides(spark, sf):
    return B.table(spark, sf, "documents").select(F.col("source").alias("book")).where(F.col("book").endswith("5")).distinct().select(
        "book", F.lit(2).cast("bigint").alias("offset"))


@case("page_number_candidates", sql("SELECT book, pdf_page, c AS candidate FROM cands", "cands"))
def page_number_candidates(spark, sf):
    return typed(P.candidates(numbered(spark, sf)).select("book", "pdf_page", F.explode("candidates").alias("candidate")))


@case("offset_votes", sql("SELECT book, off AS \"offset\", count(*) AS votes FROM hits GROUP BY ALL", "hits"))
def offset_votes(spark, sf):
    return typed(P.offset_votes(P.candidates(numbered(spark, sf))))


@case("longest_run", sql(
    "SELECT book, category, max(n) AS longest_run FROM (SELECT book, category, isle, count(*) AS n FROM (SELECT book, category, pdf_page - row_number() OVER "
    "(PARTITION BY book, category ORDER BY pdf_page) AS isle FROM bpages) GROUP BY ALL) GROUP BY ALL", "bpages"))
def longest_run(spark, sf):
    return longest_runs(B.pages(spark, sf), ["book", "category"], "pdf_page", width=16)


@case("offset_evaluation", sql("SELECT * REPLACE (round(match_ratio, 6) AS match_ratio) FROM evaluated", "evaluated"))
def offset_evaluation(spark, sf):
    return typed(P.offset_evaluation(P.candidates(numbered(spark, sf))).withColumn("match_ratio", F.round("match_ratio", 6)))


@case("best_offset", sql("SELECT book, \"offset\", match_count, longest_run, second_count FROM decided WHERE \"offset\" IS NOT NULL", "decided"))
def best_offset(spark, sf):
    best = P.best_offset(P.offset_evaluation(P.candidates(numbered(spark, sf))))
    return typed(best.select("book", "offset", "match_count", "longest_run", "second_count"))


@case("offset_confidence", sql("SELECT book, \"offset\", status FROM decided", "decided"))
def offset_confidence(spark, sf):
    p = numbered(spark, sf)
    best = P.best_offset(P.offset_evaluation(P.candidates(p)))
    return typed(P.offset_confidence(p.select("book").distinct().join(best, "book", "left")).select("book", "offset", "status"))


@case("offset_override", sql("SELECT book, \"offset\", match_count, status FROM status_", "status_"))
def offset_override(spark, sf):
    status, _ = P.page_map_job(numbered(spark, sf), _overrides(spark, sf))
    return typed(status.select("book", "offset", "match_count", "status"))


_MAP = ("SELECT p.book, p.pdf_page, CASE WHEN p.pdf_page - s.\"offset\" >= 1 THEN p.pdf_page - s.\"offset\" END AS logical_page, s.source "
        "FROM bpages p JOIN status_ s USING (book) WHERE s.\"offset\" IS NOT NULL")


@case("page_map_build", sql(_MAP, "status_", "bpages"))
def page_map_build(spark, sf):
    p = numbered(spark, sf)
    evaluated = P.offset_evaluation(P.candidates(p))
    decided = P.offset_confidence(p.select("book").distinct().join(P.best_offset(evaluated), "book", "left"))
    return typed(P.page_map_build(p, P.offset_override(decided, evaluated, _overrides(spark, sf))))


@case("page_map_job", sql(
    f"SELECT book, status, m.n AS pages, m.mapped FROM status_ JOIN (SELECT book, count(*) AS n, count(logical_page) AS mapped FROM ({_MAP}) GROUP BY 1) m USING (book)",
    "status_", "bpages"))
def page_map_job(spark, sf):
    status, page_map = P.page_map_job(numbered(spark, sf), _overrides(spark, sf))
    counts = page_map.groupBy("book").agg(F.count(F.lit(1)).alias("pages"), F.count("logical_page").alias("mapped"))
    return status.select("book", "status").join(counts, "book")


@case("status_summary", sql(
    "SELECT pos, status, coalesce(n, 0) AS n FROM (VALUES (0::BIGINT, 'AUTO_OK'), (1, 'MANUAL_OVERRIDE'), (2, 'WARNING'), (3, 'MANUAL_REQUIRED')) v(pos, status) "
    "LEFT JOIN (SELECT status, count(*) AS n FROM status_ GROUP BY 1) USING (status)", "status_"))
def status_summary(spark, sf):
    status, _ = P.page_map_job(numbered(spark, sf), _overrides(spark, sf))
    return typed(P.status_summary(status))
