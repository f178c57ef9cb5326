"""Page references, chunk choice, context packing and conversation memory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators.corpus import allowed
from marginalia.operators.ranking import keep_best, top_k
from marginalia.operators.retrieval import KEY

# --- Fixed values: reference patterns, base scores and caps ---
REFERENCE_PATTERNS = (
    "[⇒→]\\s*(\\d{1,4})\\s*頁",
    "(\\d{1,4})\\s*頁\\s*(?:も|を)?\\s*参照",
    "(?:詳しくは|詳細は|については)[^。\\n]{0,30}?(\\d{1,4})\\s*頁",
)
NEXT_PAGE, PREVIOUS_PAGE = "次頁|次ページ|次のページ", "前頁|前ページ|前のページ"
SOURCE_BASE = {"reference": 1500.0, "structured": 1350.0, "index": 1200.0, "toc": 1100.0, "section": 1050.0}
CONTEXT_ITEMS, HYBRID_RESERVE = 28, 8
REFERENCES_PER_SEED, REFERENCE_PAGES, MEMORY_PAGES, FRESH_ITEMS = 2, 8, 8, 20
REFERENCE_SEEDS, STRUCTURED_FULL, CHUNKS_A_PAGE = 12, 3, 2
# ---------------------------------------------------------------


def reference_edges(pages: DataFrame, patterns: Sequence[str] = REFERENCE_PATTERNS) -> DataFrame:
    """Printed pages a page refers to, in order, distinct: (book, pdf_page, logical_page, pos, target, label)."""
    def found(pattern: str) -> Column:
        hits = F.regexp_extract_all("page_text", F.lit(pattern), F.lit(0))
        return F.transform(hits, lambda h: F.struct(F.regexp_extract(h, pattern, 1).cast("bigint").alias("target"), T.strip(h).alias("label")))

    here = F.col("logical_page").cast("bigint")
    entry = lambda page, label: F.array(F.struct(page.alias("target"), F.lit(label).alias("label")))
    none = F.array().cast("array<struct<target: bigint, label: string>>")
    refs = F.concat(
        *[found(p) for p in patterns],
        F.when(F.col("page_text").rlike(NEXT_PAGE), entry(here + 1, "次頁")).otherwise(none),
        F.when((here > 1) & F.col("page_text").rlike(PREVIOUS_PAGE), entry(here - 1, "前頁")).otherwise(none),
    )
    distinct = T.let(
        F.filter(refs, lambda r: r["target"] > 0),
        lambda rs: F.filter(rs, lambda r, i: F.array_position(F.transform(rs, lambda x: x["target"]), r["target"]) == i + 1),
    )
    return pages.select("book", "pdf_page", "logical_page", F.posexplode(distinct).alias("_p", "_r")).select(
        "book", "pdf_page", "logical_page", (F.col("_p") + 1).cast("bigint").alias("pos"), "_r.target", "_r.label")


def reference_expand(
    seeds: DataFrame, edges: DataFrame, lookup: DataFrame, weights: DataFrame,
    per_seed: int = REFERENCES_PER_SEED, k: int = REFERENCE_PAGES,
) -> DataFrame:
    """Pages referred to by the seed pages of each query, best per page."""
    followed = (
        seeds.select("query_id", "book", "pdf_page", "context_score")
        .join(edges.where(F.col("pos") <= per_seed), ["book", "pdf_page"])
        .join(lookup.select("book", F.col("logical_page").alias("target"), F.col("pdf_page").alias("_to")), ["book", "target"])
        .where(F.col("_to") != F.col("pdf_page"))
        .join(weights.select("book", "authority"), "book", "left")
    )
    reason = F.concat(F.lit("参照先補完: "), "book", F.lit(" p."), F.col("logical_page").cast("string"), F.lit(" の「"), "label",
                      F.lit("」から p."), F.col("target").cast("string"))
    rows = followed.select(
        "query_id", "book", F.col("_to").alias("pdf_page"), F.col("target").alias("logical_page"),
        (F.col("context_score") + 150.0).alias("score"), F.coalesce("authority", F.lit(1.0)).alias("authority"),
        F.lit("reference").alias("source"), reason.alias("label"))
    best = keep_best(rows, ["query_id", "book", "pdf_page"], [-F.col("score"), F.col("label")])
    return top_k(best, ["query_id"], [F.col("score").desc(), F.col("authority").desc(), F.col("book"), F.col("pdf_page")], k)


def asked_terms(questions: DataFrame) -> DataFrame:
    """Normalized question and terms, computed once per query."""
    q = F.col("question")
    return questions.select(
        "query_id", T.norm_nav(T.norm_query(q)).alias("_q"), F.transform(T.query_terms(q), T.norm_nav).alias("_terms"))


def page_chunk_select(
    candidates: DataFrame, chunks: DataFrame, questions: DataFrame, weights: DataFrame, max_chunks: int
) -> DataFrame:
    """Best chunks of every candidate page; the first one is mandatory. Joins and windows are by page."""
    base = F.coalesce(*[F.when(F.col("source") == s, F.lit(v)) for s, v in SOURCE_BASE.items()], F.lit(1000.0))
    rows = (
        candidates.select("query_id", "book", "pdf_page", "source", "score", "label")
        .join(chunks.select(*KEY, "text"), ["book", "pdf_page"])
        .join(asked_terms(questions), "query_id")
        .join(weights.select("book", "authority"), "book", "left")
        .withColumn("authority", F.coalesce("authority", F.lit(1.0)))
    )
    terms = F.concat(F.transform(T.reason_terms(F.col("label")), T.norm_nav), F.col("_terms"))
    close = T.let(
        T.norm_nav(F.col("text")),
        lambda t: T.chunk_relevance(t, F.col("_q"), terms, F.col("authority"), F.col("chunk"), F.col("source").isin("toc", "section", "reference")),
    )
    scored = rows.withColumn("_s", F.round(close, 6))
    kept = top_k(scored, ["query_id", "book", "pdf_page", "source"], [F.col("_s").desc(), F.col("chunk")], max_chunks)
    return kept.select(
        "query_id", *KEY, (F.col("rank") == 1).alias("mandatory"), F.round(base + F.col("score") + F.col("_s"), 6).alias("context_score"),
        F.concat("label", F.when(F.col("authority") > 1.0, " / 資料優先度を加味").otherwise("")).alias("reason"), "source")


def hybrid_items(hybrid: DataFrame, chunks: DataFrame, questions: DataFrame, weights: DataFrame) -> DataFrame:
    """Fused hits as optional context items: base 100, a rank bonus and the chunk relevance."""
    rows = (
        hybrid.select("query_id", *KEY, "rank", "reason").join(chunks.select(*KEY, "text"), list(KEY))
        .join(asked_terms(questions), "query_id").join(weights.select("book", "authority"), "book", "left")
        .withColumn("authority", F.coalesce("authority", F.lit(1.0)))
    )
    close = T.let(T.norm_nav(F.col("text")), lambda t: T.chunk_relevance(t, F.col("_q"), F.col("_terms"), F.col("authority"), F.col("chunk")))
    score = F.lit(100.0) + F.greatest(F.lit(0.0), F.lit(30.0) - F.col("rank")) + close
    return rows.select(
        "query_id", *KEY, F.lit(False).alias("mandatory"), F.round(score, 6).alias("context_score"),
        F.concat("reason", F.when(F.col("authority") > 1.0, " / 資料優先度を加味").otherwise("")).alias("reason"), F.lit("hybrid").alias("source"))


def context_pack(items: DataFrame, limit: int = CONTEXT_ITEMS, reserve: int = HYBRID_RESERVE) -> DataFrame:
    """Quota packing: mandatory items up to the limit less the hybrid reserve, the reserve, then the rest.

    items: (query_id, key, mandatory, context_score, reason, source); source ``hybrid`` marks the
    hybrid pool. No chunk is chosen twice. Output adds ``position``.
    """
    pool = F.when(F.col("source") == "hybrid", 2).when(F.col("mandatory"), 0).otherwise(1)
    rows = items.withColumn("_pool", pool)
    order = [F.col("context_score").desc(), F.col("source"), *[F.col(c) for c in KEY]]
    one = keep_best(rows, ["query_id", "_pool", *KEY], [-F.col("context_score"), F.col("source")])
    held = Window.partitionBy("query_id")
    sized = one.withColumn("_r", F.least(F.lit(min(reserve, limit)), F.count_if(F.col("_pool") == 2).over(held)))
    in_pool = Window.partitionBy("query_id", "_pool").orderBy(*order)
    ranked = sized.withColumn("_n", F.row_number().over(in_pool))
    same = Window.partitionBy("query_id", *KEY)
    first = (F.col("_pool") == 0) & (F.col("_n") <= F.lit(limit) - F.col("_r"))
    marked = ranked.withColumn("_in_a", F.max(first.cast("int")).over(same))
    left = marked.where((F.col("_in_a") == 0) | first)
    # ranks of hybrid items that mandatory ones have not taken
    free = Window.partitionBy("query_id", "_pool", "_in_a").orderBy(*order)
    phased = left.withColumn("_m", F.row_number().over(free)).withColumn(
        "_phase", F.when(first, 0).when((F.col("_pool") == 2) & (F.col("_m") <= F.col("_r")), 1).otherwise(F.col("_pool") + 2))
    unique = keep_best(phased.drop("_n", "_m", "_r", "_in_a", "_pool"), ["query_id", *KEY], [F.col("_phase"), -F.col("context_score"), F.col("source")])
    return top_k(unique, ["query_id"], [F.col("_phase"), *order], limit, "position").drop("_phase")


def ordered_union(first: DataFrame, second: DataFrame, head: int = FRESH_ITEMS, limit: int = CONTEXT_ITEMS) -> DataFrame:
    """First ``head`` items of ``first``, then ``second``, then the rest of ``first``; distinct by chunk, cut at ``limit``."""
    a = first.withColumn("_list", F.when(F.col("position") <= head, 0).otherwise(2))
    b = second.withColumn("_list", F.lit(1))
    best = keep_best(a.unionByName(b), ["query_id", *KEY], [F.col("_list"), F.col("position")])
    ordered = best.withColumnRenamed("position", "_at")
    return top_k(ordered, ["query_id"], [F.col("_list"), F.col("_at"), *[F.col(c) for c in KEY]], limit, "position").drop("_list", "_at")


def chat_memory(sources: DataFrame, chunks: DataFrame, questions: DataFrame, weights: DataFrame, k: int = MEMORY_PAGES) -> DataFrame:
    """Best chunk of every remembered page of a query's chat: (query_id, book, pdf_page) -> items with position."""
    rows = (
        sources.select("query_id", "book", "pdf_page").distinct().join(chunks.select(*KEY, "text"), ["book", "pdf_page"])
        .join(questions.select("query_id", "books"), "query_id").where(allowed(F.col("books"), F.col("book")))
        .join(asked_terms(questions), "query_id").join(weights.select("book", "authority"), "book", "left")
    )
    close = T.let(T.norm_nav(F.col("text")), lambda t: T.chunk_relevance(
        t, F.col("_q"), F.col("_terms"), F.coalesce("authority", F.lit(1.0)), F.col("chunk")))
    scored = rows.select("query_id", *KEY, F.lit(False).alias("mandatory"), F.round(F.lit(180.0) + close, 6).alias("context_score"),
                         F.lit("このチャットで以前参照した資料").alias("reason"), F.lit("chat_memory").alias("source"))
    best = keep_best(scored, ["query_id", "book", "pdf_page"], [-F.col("context_score"), F.col("chunk")])
    return top_k(best, ["query_id"], [F.col("context_score").desc(), F.col("book"), F.col("pdf_page")], k, "position")


def retrieval_usage(items: DataFrame) -> DataFrame:
    """Context items per query by kind of retrieval."""
    return items.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("context_items"),
        *[F.count_if(F.col("source").isin(*kinds)).alias(name) for name, kinds in (
            ("hybrid", ("hybrid",)), ("navigation", ("index", "toc", "section")), ("structured", ("structured",)), ("reference", ("reference",)))],
    )
