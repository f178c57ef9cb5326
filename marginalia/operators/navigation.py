"""Contents and index tables of books, and search over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.functions.match import sequence_ratio
from marginalia.operators.corpus import allowed
from marginalia.operators.ranking import keep_best, spread, top_k
from marginalia.operators.containment import contained_terms
from marginalia.operators.fuzzy import fuzzy_pairs
from marginalia.operators.retrieval import ASK

# --- Fixed values: heading words, scan ranges, match scores and caps ---
TOC_HEADINGS = "(?i)目次|もくじ|contents?"
INDEX_SUFFIX = "索引"
TOC_END_RATIO, INDEX_START_RATIO = 0.30, 0.60
TOC_MAX_PAGES, INDEX_MAX_PAGES = 10, 12
SEED_DISTANCE = 3
BEFORE_FIRST, AFTER_FIRST, FALLBACK_PAGES = 8, 20, 24
INDEX_SCORES = {"exact": (4, 100.0), "term_in_query": (3, 92.0), "query_in_term": (2, 82.0)}
TOC_SCORES = {"exact": (4, 95.0), "term_in_query": (3, 88.0), "query_in_term": (2, 78.0)}
INDEX_FUZZY, TOC_FUZZY, TYPE_FUZZY = 0.72, 0.60, 0.55
INDEX_PAGES, TOC_PAGES, SECTION_STEPS, SECTION_PAGES, NAVIGATION_PAGES = 8, 4, 2, 6, 12
SOURCE_ORDER = {"index": 3, "toc": 2, "section": 1}
# ------------------------------------------------------------------------


# ---- page detection ------------------------------------------------------------

def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\\r\\n|[\\n\\r\\u000b\\f\\u001c-\\u001e\\u0085\\u2028\\u2029]"), T.strip), lambda s: F.length(s) > 0)


def has_toc_heading(text: Column, pattern: str = TOC_HEADINGS, width: int = 40) -> Column:
    heads = F.transform(_lines(text), T.norm_heading)
    return F.exists(heads, lambda h: (F.length(h) > 0) & (F.length(h) <= width) & h.rlike(pattern))


def index_headings(text: Column, suffix: str = INDEX_SUFFIX, width: int = 30) -> Column:
    """Ordered distinct index headings of a page."""
    heads = F.transform(_lines(text), T.norm_heading)
    return F.array_distinct(F.filter(heads, lambda h: (F.length(h) <= width) & h.endswith(suffix)))


def _last_pages(pages: DataFrame) -> DataFrame:
    return pages.groupBy("book").agg(F.max("pdf_page").alias("_last"))


def toc_seeds(pages: DataFrame, pattern: str = TOC_HEADINGS) -> DataFrame:
    """First pages of contents runs in the first part of each book."""
    head = pages.join(_last_pages(pages), "book").where(
        (F.col("pdf_page") <= F.greatest(F.lit(1), F.floor(F.col("_last") * TOC_END_RATIO))) & has_toc_heading(F.col("text"), pattern))
    return collapse_seeds(head.select("book", F.col("pdf_page").alias("seed")), SEED_DISTANCE)


def tail_index_seeds(pages: DataFrame, suffix: str = INDEX_SUFFIX) -> DataFrame:
    tail = pages.join(_last_pages(pages), "book").where(
        (F.col("pdf_page") >= F.greatest(F.lit(1), F.floor(F.col("_last") * INDEX_START_RATIO)))
        & (F.size(index_headings(F.col("text"), suffix)) > 0))
    return tail.select("book", F.col("pdf_page").alias("seed")).distinct()


def toc_index_seeds(toc: DataFrame, suffix: str = INDEX_SUFFIX) -> DataFrame:
    return toc.where(T.norm_heading(F.col("title")).endswith(suffix) & F.col("pdf_page").isNotNull()).select(
        "book", F.col("pdf_page").alias("seed")).distinct()


def raw_toc_index_seeds(pages: DataFrame, lookup: DataFrame, suffix: str = INDEX_SUFFIX) -> DataFrame:
    """Index pages named by raw contents lines: the page number ends the line or is the next line."""
    head = pages.join(_last_pages(pages), "book").where(
        F.col("pdf_page") <= F.greatest(F.lit(1), F.floor(F.col("_last") * TOC_END_RATIO)))
    lines = head.select("book", _lines(F.col("text")).alias("_l"))
    same = f"^.{{0,30}}?{suffix}[\\s.．…⋯・･\\-―ー]*([0-9]{{1,4}})$"
    number = F.transform(
        F.col("_l"),
        lambda s, i: F.when(s.rlike(same), F.regexp_extract(s, same, 1)).when(
            T.norm_heading(s).endswith(suffix),
            F.regexp_extract(F.coalesce(F.get("_l", i + 1), F.lit("")), "^([0-9]{1,4})$", 1),
        ),
    )
    found = lines.select("book", F.explode(number).alias("_n")).select("book", F.expr("try_cast(_n AS INT)").alias("logical_page"))
    return found.where(F.col("logical_page").isNotNull()).join(lookup, ["book", "logical_page"]).select(
        "book", F.col("pdf_page").alias("seed")).distinct()


def index_seeds(pages: DataFrame, toc: DataFrame, lookup: DataFrame, suffix: str = INDEX_SUFFIX) -> DataFrame:
    """Union of the three kinds of index seeds."""
    return (
        tail_index_seeds(pages, suffix)
        .union(toc_index_seeds(toc, suffix))
        .union(raw_toc_index_seeds(pages, lookup, suffix))
        .distinct()
    )


def collapse_seeds(seeds: DataFrame, distance: int = SEED_DISTANCE) -> DataFrame:
    """Seeds whose predecessor is further away than ``distance``.

    The predecessor test is an anti join with the shifted seeds, so a book needs no ordered pass.
    """
    distinct = seeds.select("book", "seed").distinct()
    near = distinct.select("book", F.explode(F.sequence(F.col("seed") + 1, F.col("seed") + distance)).alias("seed"))
    return distinct.join(near, ["book", "seed"], "left_anti")


def toc_fallback_order(pages: DataFrame, page_map: DataFrame) -> DataFrame:
    """Pages to try for a contents table: printed page 1, then before it, then after it."""
    first = page_map.where("logical_page = 1").groupBy("book").agg(F.min("pdf_page").alias("_one"))
    steps = F.transform(F.sequence(F.lit(1), F.lit(BEFORE_FIRST)), lambda d: -d)
    deltas = F.concat(F.array(F.lit(0)), steps, F.sequence(F.lit(1), F.lit(AFTER_FIRST)))
    around = first.select("book", "_one", F.posexplode(deltas).alias("priority", "_d")).select(
        "book", (F.col("_one") + F.col("_d")).alias("pdf_page"), (F.col("priority") + 1).cast("bigint").alias("priority"))
    known = around.join(pages.select("book", "pdf_page").distinct(), ["book", "pdf_page"], "left_semi")
    rest = pages.select("book", "pdf_page").distinct().join(first, "book", "left_anti")
    return known.select("book", "pdf_page", "priority").unionByName(
        top_k(rest, ["book"], [F.col("pdf_page")], FALLBACK_PAGES, "priority").withColumn("priority", F.col("priority").cast("bigint")))


def sequence_stop_rule(seeds: DataFrame, results: DataFrame, max_pages: int) -> DataFrame:
    """Pages visited from each seed until the run ends.

    results: (book, pdf_page, positive); null ``positive`` means the page could not be read,
    which is an error but not a miss. A page missing from ``results`` ends the run. Runs are at
    most ``max_pages`` long, so the windows are tiny.
    """
    steps = seeds.select("book", "seed", F.explode(F.sequence(F.lit(0), F.lit(max_pages - 1))).alias("_o")).withColumn(
        "pdf_page", F.col("seed") + F.col("_o"))
    seen = steps.join(results.select("book", "pdf_page", "positive", F.lit(True).alias("_valid")), ["book", "pdf_page"], "left")
    w = Window.partitionBy("book", "seed").orderBy("_o")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    found = F.coalesce(F.max(F.col("positive").cast("int")).over(upto), F.lit(0)) == 1
    misses = F.sum(F.when(F.col("positive") == F.lit(False), 1).otherwise(0)).over(upto)
    stop = F.when(F.col("positive") == F.lit(False), found | (misses >= 2)).otherwise(False)
    marked = seen.withColumn("_stop", stop.cast("int")).withColumn("_gap", F.col("_valid").isNull().cast("int"))
    return (
        marked.withColumn("_over", F.coalesce(F.sum("_stop").over(before), F.lit(0)) + F.sum("_gap").over(upto))
        .where("_over = 0")
        .select("book", "seed", "pdf_page", "positive", F.col("positive").isNull().alias("error"))
    )


# ---- merged tables ---------------------------------------------------------------

def toc_merge(entries: DataFrame, lookup: DataFrame) -> DataFrame:
    """Contents rows by space-free title and printed page.

    entries: (book, source_pdf_page, pos, title, logical_page, level) of contents pages.
    """
    clean = entries.withColumn("title", T.strip(F.col("title"))).where((F.length("title") > 0) & F.col("logical_page").isNotNull())
    level = F.least(F.lit(3), F.greatest(F.lit(1), F.coalesce("level", F.lit(1))))
    merged = clean.groupBy("book", T.norm_term_key(F.col("title")).alias("_key"), "logical_page").agg(
        F.min_by("title", F.struct("source_pdf_page", "pos")).alias("title"),
        F.min(level).alias("level"),
        F.sort_array(F.collect_set("source_pdf_page")).alias("source_toc_pages"),
    )
    return merged.join(lookup, ["book", "logical_page"], "left").select(
        "book", "title", "logical_page", "pdf_page", "level", "source_toc_pages")


def index_types(toc: DataFrame, suffix: str = INDEX_SUFFIX) -> DataFrame:
    """Index types announced per page by the contents; the general name gives way to specific ones."""
    named = toc.withColumn("_t", T.norm_heading(F.col("title"))).where(F.col("_t").endswith(suffix) & F.col("pdf_page").isNotNull())
    first = named.groupBy("book", "pdf_page", "_t").agg(F.min(F.struct("logical_page", "level", "title")).alias("_o"))
    lists = first.groupBy("book", "pdf_page").agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_t"))), lambda s: s["_t"]).alias("_all"))
    specific = F.filter("_all", lambda t: t != suffix)
    return lists.select("book", "pdf_page", F.when(F.size(specific) > 0, specific).otherwise(F.col("_all")).alias("expected"))


def index_type_join(detected: DataFrame, expected: DataFrame, suffix: str = INDEX_SUFFIX) -> DataFrame:
    """Correct detected index types with the ones the contents announce for the page.

    detected: (book, pdf_page, detected); adds ``index_type`` and ``candidate_index_types``.
    """
    named = detected.select("book", "pdf_page", "detected").distinct().withColumn("_d", T.norm_index_type(F.col("detected"), suffix)).join(
        expected, ["book", "pdf_page"], "left")
    n = F.coalesce(F.size("expected"), F.lit(0))
    plain = (n <= 1) | F.array_contains("expected", F.col("_d")) | (F.col("_d") == suffix)
    none = F.array().cast("array<string>")
    easy = named.where(plain | F.col("expected").isNull()).select(
        "book", "pdf_page", "detected",
        F.when(n == 1, F.get("expected", F.lit(0))).otherwise(F.col("_d")).alias("index_type"),
        F.when((n > 1) & ~F.array_contains("expected", F.col("_d")), F.col("expected")).otherwise(none).alias("candidate_index_types"),
    )
    rated = named.where(~plain).select("book", "pdf_page", "detected", "_d", "expected", F.posexplode("expected").alias("_pos", "_e")).withColumn(
        "_r", sequence_ratio(F.col("_d"), F.col("_e")))
    best = keep_best(rated, ["book", "pdf_page", "detected"], [-F.col("_r"), F.col("_pos")])
    close = F.col("_r") >= TYPE_FUZZY
    return easy.unionByName(best.select(
        "book", "pdf_page", "detected", F.when(close, F.col("_e")).otherwise(F.col("_d")).alias("index_type"),
        F.when(close, none).otherwise(F.col("expected")).alias("candidate_index_types")))


def index_merge(entries: DataFrame, types: DataFrame, lookup: DataFrame) -> DataFrame:
    """Index terms by corrected type and space-free term, with all their pages.

    entries: (book, source_pdf_page, pos, detected, term, logical_pages). Page numbers are
    aggregated one row at a time, so a frequent term only costs its distinct pages.
    """
    clean = entries.withColumn("term", T.strip(F.col("term"))).where(F.length("term") > 0)
    typed = clean.join(types.withColumnRenamed("pdf_page", "source_pdf_page"), ["book", "source_pdf_page", "detected"])
    pages = typed.select(
        "book", "index_type", T.norm_term_key(F.col("term")).alias("_key"), "term", "pos", "source_pdf_page", "candidate_index_types",
        F.explode("logical_pages").alias("logical_page")).where("logical_page > 0")
    with_pdf = pages.join(lookup, ["book", "logical_page"], "left")
    return with_pdf.groupBy("book", "index_type", "_key").agg(
        F.min_by("term", F.struct("source_pdf_page", "pos")).alias("term"),
        F.sort_array(F.collect_set("logical_page")).alias("logical_pages"),
        F.sort_array(F.collect_set("pdf_page")).alias("pdf_pages"),
        F.sort_array(F.collect_set("source_pdf_page")).alias("source_index_pages"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("candidate_index_types")))).alias("candidate_index_types"),
    ).drop("_key")


def unresolved_errors(errors: DataFrame, results: DataFrame) -> DataFrame:
    """Errors whose (book, kind, page) has no result."""
    return errors.join(results.select("book", "kind", "pdf_page"), ["book", "kind", "pdf_page"], "left_anti")


def navigation_status(books: DataFrame, toc: DataFrame, index: DataFrame, errors: DataFrame) -> DataFrame:
    """OK, TOC_ONLY or WARNING per book with reason and counts."""
    count = lambda df, name: df.groupBy("book").agg(F.count(F.lit(1)).alias(name))
    joined = books
    for df, name in ((toc, "toc_count"), (index, "index_count"), (errors, "error_count")):
        joined = joined.join(count(df, name), "book", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    has_toc, has_index, has_errors = F.col("toc_count") > 0, F.col("index_count") > 0, F.col("error_count") > 0
    return joined.select(
        "*",
        F.when(~has_toc | has_errors, "WARNING").when(has_index, "OK").otherwise("TOC_ONLY").alias("status"),
        F.when(~has_toc & has_index, "index extracted but toc was not detected")
        .when(~has_toc, "toc was not detected")
        .when(has_errors, "navigation extracted with unresolved page-level errors")
        .when(has_index, "toc and index extracted")
        .otherwise("toc extracted; no index found").alias("reason"),
    )


def navigation_build(
    books: DataFrame, toc_entries: DataFrame, index_entries: DataFrame, errors: DataFrame, results: DataFrame, lookup: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(toc, index, status) of every book from the extraction tables."""
    toc = toc_merge(toc_entries, lookup)
    detected = index_entries.select("book", F.col("source_pdf_page").alias("pdf_page"), "detected")
    index = index_merge(index_entries, index_type_join(detected, index_types(toc)), lookup)
    return toc, index, navigation_status(books, toc, index, unresolved_errors(errors, results))


# ---- string matching ----------------------------------------------------------------

def match_strings(
    queries: DataFrame, entries: DataFrame, scores: dict[str, tuple[int, float]], fuzzy: tuple[float, float, float] | None
) -> DataFrame:
    """Best relation per (q, e) of distinct normalized strings: exact, either containment, fuzzy.

    ``fuzzy`` is (threshold, base, factor) for base + factor * ratio. Containment runs over
    automata of the terms (``containment``); no pair table is built.
    """
    def rated(df: DataFrame, kind: str) -> DataFrame:
        return df.select("q", "e", F.lit(scores[kind][0]).alias("priority"), F.lit(scores[kind][1]).alias("score"))

    q = queries.select("q").distinct().where(F.length("q") > 0)
    e = entries.select("e").distinct().where(F.length("e") > 0)
    pairs = [
        rated(q.join(e, F.col("q") == F.col("e")), "exact"),
        rated(contained_terms(q.withColumn("text", F.col("q")), e, "e", ("q",)).where("q <> e"), "term_in_query"),
        rated(contained_terms(e.withColumn("text", F.col("e")), q, "q", ("e",)).where("q <> e"), "query_in_term"),
    ]
    if fuzzy is not None:
        threshold, base, factor = fuzzy
        pairs.append(fuzzy_pairs(q, e, threshold).select(
            "q", "e", F.lit(1).alias("priority"), (F.lit(base) + F.col("ratio") * factor).alias("score")))
    merged = pairs[0]
    for p in pairs[1:]:
        merged = merged.unionByName(p)
    return keep_best(merged, ["q", "e"], [-F.col("priority")])


# ---- search over navigation tables -----------------------------------------------------

def _asked(variants: DataFrame) -> DataFrame:
    return variants.withColumn("q", T.norm_nav(T.norm_query(F.col("query")))).where(F.length("q") > 0)


def index_search(
    variants: DataFrame, terms: DataFrame, weights: DataFrame, fuzzy: float | None = INDEX_FUZZY, k: int = INDEX_PAGES
) -> tuple[DataFrame, DataFrame]:
    """(best pages per query variant, variants with an exact hit) from index terms (book, term, pdf_page)."""
    asked = _asked(variants)
    entries = terms.withColumn("e", T.norm_nav(F.col("term"))).where(F.length("e") > 0)
    matched = match_strings(asked, entries, INDEX_SCORES, None if fuzzy is None else (fuzzy, 50.0, 40.0))
    hits = asked.select(*ASK, "books", "q").join(matched, "q").join(entries, "e").where(allowed(F.col("books"), F.col("book")))
    exact = hits.where("priority = 4").select(*ASK).distinct()
    rated = hits.where(F.col("pdf_page").isNotNull()).join(weights.select("book", "authority"), "book", "left").withColumn(
        "authority", F.coalesce("authority", F.lit(1.0)))
    order = [-F.col("priority"), -F.col("authority"), -F.col("score")]
    pages = keep_best(
        rated.select(*ASK, "book", "pdf_page", "priority", "authority", "score", "term"),
        [*ASK, "book", "pdf_page"], [*order, -F.length("term"), F.col("term")])
    best = top_k(pages, ASK, [*order, F.col("pdf_page"), F.col("book")], k)
    return best.withColumn("label", F.concat(F.lit("索引: "), F.col("term"))), exact


def toc_search(
    variants: DataFrame, toc: DataFrame, weights: DataFrame, fuzzy: float | None = TOC_FUZZY, k: int = TOC_PAGES
) -> DataFrame:
    """Best contents entries per query variant, one per page."""
    asked = _asked(variants)
    entries = toc.where(F.col("pdf_page").isNotNull()).withColumn("e", T.norm_nav(F.col("title"))).where(F.length("e") > 0)
    matched = match_strings(asked, entries, TOC_SCORES, None if fuzzy is None else (fuzzy, 45.0, 35.0))
    hits = (
        asked.select(*ASK, "books", "q").join(matched, "q").join(entries, "e").where(allowed(F.col("books"), F.col("book")))
        .join(weights.select("book", "authority"), "book", "left").withColumn("authority", F.coalesce("authority", F.lit(1.0)))
    )
    order = [-F.col("score"), -F.col("authority"), F.col("level")]
    pages = keep_best(
        hits.select(*ASK, "book", "pdf_page", "score", "authority", "level", "title"),
        [*ASK, "book", "pdf_page"], [*order, F.col("title")])
    best = top_k(pages, ASK, [*order, F.col("book"), F.col("pdf_page")], k)
    return best.withColumn("label", F.concat(F.lit("目次: "), F.col("title")))


def section_expand(toc_hits: DataFrame, pages: DataFrame, steps: int = SECTION_STEPS, k: int = SECTION_PAGES) -> DataFrame:
    """Pages right behind a contents hit that exist in the corpus."""
    behind = toc_hits.select(
        *ASK, "book", "rank", "score", "authority", "title", (F.col("pdf_page")).alias("_from"),
        F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("delta"),
    ).withColumn("pdf_page", F.col("_from") + F.col("delta"))
    known = behind.join(pages.select("book", "pdf_page").distinct(), ["book", "pdf_page"], "left_semi")
    first = keep_best(known.drop("_from"), [*ASK, "book", "pdf_page"], [F.col("rank"), F.col("delta")])
    cut = top_k(first.withColumnRenamed("rank", "_toc_rank"), ASK, [F.col("_toc_rank"), F.col("delta")], k)
    return cut.select(
        *ASK, "book", "pdf_page", (F.col("score") - 5.0 - F.col("delta")).alias("score"), "authority", "rank",
        F.concat(F.lit("目次セクション続き: "), F.col("title")).alias("label"))


def navigation_search(
    questions: DataFrame, variants: DataFrame, terms: DataFrame, toc: DataFrame, pages: DataFrame, weights: DataFrame,
    fuzzy: bool = True, k: int = NAVIGATION_PAGES,
) -> DataFrame:
    """Index, contents and section hits of all variants, merged per page."""
    index, exact = index_search(variants, terms, weights, INDEX_FUZZY if fuzzy else None)
    contents = toc_search(variants, toc, weights, TOC_FUZZY if fuzzy else None)
    section = section_expand(contents.join(exact, list(ASK), "left_anti"), pages)

    def row(df: DataFrame, source: str, priority: Column) -> DataFrame:
        return df.select(*ASK, "book", "pdf_page", F.lit(source).alias("source"), F.lit(SOURCE_ORDER[source]).alias("_s"),
                         priority.alias("priority"), "authority", "score", "label")

    union = row(index, "index", F.col("priority")).unionByName(row(contents, "toc", F.lit(0))).unionByName(row(section, "section", F.lit(0)))
    plain = questions.select("query_id", T.norm_query(F.col("question")).alias("_plain"))
    expanded = F.col("query") != F.col("_plain")
    named = union.join(variants.select(*ASK, "query"), list(ASK)).join(plain, "query_id").select(
        "query_id", "variant_no", "book", "pdf_page", "source", "_s", "priority", "authority",
        (F.col("score") - F.when(expanded, 1.5).otherwise(0.0)).alias("score"),
        F.when(expanded, F.concat("label", F.lit("（検索展開: "), "query", F.lit("）"))).otherwise(F.col("label")).alias("label"))
    order = [-F.col("_s"), -F.col("priority"), -F.col("authority"), -F.col("score")]
    merged = keep_best(named, ["query_id", "book", "pdf_page"], [*order, F.col("variant_no")])
    return top_k(merged, ["query_id"], [*order, F.col("book"), F.col("pdf_page")], k).drop("_s", "variant_no")
