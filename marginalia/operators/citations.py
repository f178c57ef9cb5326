"""Numbered citations, marker clean-up in answers and the choice of returned citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators.ranking import keep_best, top_k
from marginalia.operators.retrieval import KEY

# --- Fixed values: caps and bonuses of unused citations ---
TABLE_EXTRA, GENERAL_EXTRA, MIN_RELEVANCE = 6, 3, 4.0
BONUS_TABLE = {"structured": 220.0, "reference": 30.0, "index": 50.0, "toc": 35.0, "section": 25.0}
BONUS_GENERAL = {"structured": 70.0, "reference": 80.0, "index": 50.0, "toc": 35.0, "section": 25.0}
# -----------------------------------------------------------


def citation_numbering(items: DataFrame, chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """One citation per page in order of first appearance; the best item supplies the text.

    items: (query_id, key, position, context_score, reason, source [, context_text]).
    """
    if "context_text" not in items.columns:
        items = items.withColumn("context_text", F.lit(None).cast("string"))
    pages = items.groupBy("query_id", "book", "pdf_page").agg(
        F.min("position").alias("_first"),
        F.max_by(F.struct("chunk", "context_text", "context_score", "source"), F.struct("context_score", -F.col("position"))).alias("_b"),
        F.array_join(F.array_distinct(F.transform(
            F.array_sort(F.collect_list(F.when(F.length("reason") > 0, F.struct("position", "reason")))), lambda s: s["reason"])), " / ").alias("reason"),
    )
    w = Window.partitionBy("query_id").orderBy("_first")  # at most one context per query
    with_text = pages.select("query_id", "book", "pdf_page", "_first", "reason", "_b.*").join(
        chunks.select(*KEY, "logical_page", "category", "text"), list(KEY)).where(F.col("logical_page").isNotNull())
    q = F.col("question")
    asked = questions.select("query_id", T.norm_query(q).alias("_nq"), T.query_terms(q).alias("_terms"))
    terms = F.concat(F.array("_nq"), T.reason_terms(F.col("reason")), F.col("_terms"))
    return with_text.join(asked, "query_id").withColumn("id", F.row_number().over(w)).select(
        "query_id", "id", "book", F.col("logical_page").alias("page"), "pdf_page", "category",
        T.excerpt(F.coalesce("context_text", "text"), terms).alias("excerpt"),
        F.when(F.length("reason") > 0, F.col("reason")).otherwise("検索結果から選定").alias("reason"), "context_score", "source")


def citation_relevance(citations: DataFrame, questions: DataFrame) -> DataFrame:
    """Adds ``relevance``: closeness of excerpt and reason to the question."""
    q = F.col("question")
    asked = questions.select("query_id", T.norm_nav(T.norm_query(q)).alias("_q"), F.transform(T.query_terms(q), T.norm_nav).alias("_terms"))
    words = F.concat_ws(" ", F.nullif("excerpt", F.lit("")), F.nullif("reason", F.lit("")))

    def score(hay):
        term = lambda t: F.when(F.length(t) == 0, 0.0).when(F.contains(hay, t), 12.0).otherwise(T.ngram_coverage(t, hay) * 3.0)
        whole = F.when((F.length("_q") > 0) & F.contains(hay, F.col("_q")), 30.0).otherwise(0.0)
        return F.aggregate("_terms", whole, lambda acc, t: acc + term(t))

    return citations.join(asked, "query_id").withColumn("relevance", F.round(T.let(T.norm_nav(words), score), 6)).drop("_q", "_terms")


def citation_marker_join(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """Citations used in an answer in order of mention; unknown numbers drop out."""
    used = answers.select("query_id", F.posexplode(T.citation_ids(T.citation_markers(F.col("answer")))).alias("pos", "id"))
    return used.join(citations, ["query_id", "id"])


def collapse_citations(answers: DataFrame) -> DataFrame:
    """Within a block of lines keep every trailing marker only on its last line.

    An answer is one row; its lines stay together in a task.
    """
    tail = "((?:\\s*\\[C\\d+\\])+)\\s*$"
    lines = answers.select("query_id", F.posexplode(F.split("answer", "\\r\\n|[\\n\\r]")).alias("line", "txt"))
    w = Window.partitionBy("query_id").orderBy("line")
    blocks = lines.withColumn("_blank", (F.length(T.strip(F.col("txt"))) == 0).cast("int")).withColumn("_block", F.sum("_blank").over(w))
    marked = blocks.withColumn("_tail", F.regexp_extract("txt", tail, 1)).withColumn(
        "_ids", F.regexp_extract_all("_tail", F.lit("\\[C(\\d+)\\]"), F.lit(1)))
    last = marked.select("query_id", "_block", "line", F.explode("_ids").alias("_id")).groupBy("query_id", "_block", "_id").agg(F.max("line").alias("_last"))
    keep = last.groupBy("query_id", F.col("_last").alias("line")).agg(F.collect_set("_id").alias("_keep"))
    joined = marked.join(keep, ["query_id", "line"], "left")
    kept = F.filter("_ids", lambda i: F.array_contains("_keep", i))
    none_gone = F.size(kept) == F.size("_ids")
    base = F.regexp_replace(F.regexp_replace("txt", "(?:\\s*\\[C\\d+\\])+\\s*$", ""), "\\s+$", "")
    rest = F.array_join(F.transform(kept, lambda i: F.concat(F.lit("[C"), i, F.lit("]"))), "")
    text = (
        F.when((F.size("_ids") == 0) | F.coalesce(none_gone, F.lit(False)), F.col("txt"))
        .when(F.col("_keep").isNull() | (F.size(kept) == 0), base)
        .otherwise(F.concat(base, F.lit(" "), rest))
    )
    return joined.select("query_id", "line", text.alias("txt")).groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "txt"))), lambda s: s["txt"]), "\n").alias("answer"))


def return_citations(answers: DataFrame, citations: DataFrame, questions: DataFrame, structured_terms=T.STRUCTURED_TERMS) -> DataFrame:
    """Used citations in order of mention, then a few unused ones of high value.

    citations carry ``context_score`` and ``source`` of their page. For table questions, table
    pages come first and unseen books before repeats.
    """
    used = citation_marker_join(answers, citations).select(
        *citations.columns, F.lit(True).alias("used_in_answer"), F.col("pos").cast("double").alias("_o"), F.lit(0).alias("_part"))
    table = questions.select("query_id", T.is_structured(F.col("question"), structured_terms).alias("_table"))
    bonus = lambda values: F.coalesce(*[F.when(F.col("source") == s, F.lit(v)) for s, v in values.items()], F.lit(0.0))
    unused = citation_relevance(citations.join(used.select("query_id", "id"), ["query_id", "id"], "left_anti"), questions).join(table, "query_id")
    fit = unused.where(F.col("_table") | ((F.col("source") != "hybrid") & (F.col("relevance") >= MIN_RELEVANCE)))
    scored = fit.withColumn("_score", F.round(
        F.coalesce("context_score", F.lit(0.0)) + F.when(F.col("_table"), bonus(BONUS_TABLE)).otherwise(bonus(BONUS_GENERAL)) + F.col("relevance"), 6))
    seen = used.select("query_id", "book").distinct().withColumn("_seen", F.lit(True))
    order = [(F.col("_table") & (F.col("source") != "structured")).cast("int"), F.col("_score").desc(), F.col("id")]
    in_book = Window.partitionBy("query_id", "book").orderBy(*order)
    spread_out = (
        scored.join(seen, ["query_id", "book"], "left").withColumn("_b", F.row_number().over(in_book))
        .withColumn("_repeat", (F.col("_table") & (F.col("_seen").isNotNull() | (F.col("_b") > 1))).cast("int"))
    )
    ranked = top_k(spread_out, ["query_id"], [F.col("_repeat"), *order], TABLE_EXTRA, "_n").where(
        F.col("_n") <= F.when(F.col("_table"), TABLE_EXTRA).otherwise(GENERAL_EXTRA))
    extra = ranked.select(*citations.columns, F.lit(False).alias("used_in_answer"), F.col("_n").cast("double").alias("_o"), F.lit(1).alias("_part"))
    w = Window.partitionBy("query_id").orderBy("_part", "_o")
    return used.unionByName(extra).withColumn("position", F.row_number().over(w)).drop("_o", "_part")


def source_labels(citations: DataFrame) -> DataFrame:
    """One display line per citation (needs source_type, target_book and target_page)."""
    page = F.lit(" - p.")
    corr = F.concat(F.lit("公式エラッタ・追加訂正 / "), F.coalesce("target_book", "book"), page, F.coalesce("target_page", "page").cast("string"))
    named = F.concat("category", F.lit(" / "), "book", page, F.col("page").cast("string"))
    plain = F.concat("book", page, F.col("page").cast("string"))
    return citations.withColumn("label", F.when(F.col("source_type") == "official_correction", corr)
                                .when(F.coalesce(F.length("category"), F.lit(0)) > 0, named).otherwise(plain))


def prompt_context(items: DataFrame, citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Context text per query in item order. A context is a few dozen bounded items; an item's own ``context_text`` goes before its chunk."""
    if "context_text" not in items.columns:
        items = items.withColumn("context_text", F.lit(None).cast("string"))
    joined = items.join(chunks.select(*KEY, "text"), list(KEY)).join(
        citations.select("query_id", "book", "pdf_page", "id", "page"), ["query_id", "book", "pdf_page"])
    block = F.concat(
        F.lit("引用ID: [C"), F.col("id").cast("string"), F.lit("]\n書籍: "), "book", F.lit("\n書籍ページ: "), F.col("page").cast("string"),
        F.when(F.length("source") > 0, F.concat(F.lit("\n検索種別: "), "source")).otherwise(""),
        F.when(F.length("reason") > 0, F.concat(F.lit("\n検索補助情報: "), "reason")).otherwise(""), F.lit("\n本文:\n"), F.coalesce("context_text", "text"))
    return joined.groupBy("query_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("position", block.alias("b")))), lambda s: s["b"]), "\n\n").alias("context"))
