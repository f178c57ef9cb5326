"""Cases for contents and index tables. Entries are lines of the documents; index types carry
the suffix the rules look for."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import navigation as N
from marginalia.plans import bindings as B
from marginalia.plans import sqltext as S
from marginalia.plans.bindings import sql
from marginalia.plans.registry import case, typed
from marginalia.plans.search_cases import variants

_TOC_WORDS = "(?i)tion|ung"
_HEAD = "regexp_replace(regexp_replace({}, '\\s+', '', 'g'), '^[・･.…⋯\\-―ー]+|[・･.…⋯\\-―ー]+$', '', 'g')"
_HEADS = f"list_filter(list_transform(string_split(text, chr(10)), lambda s: {_HEAD.format('s')}), lambda h: h <> '')"


@case("heading_norm", f"SELECT doc_id, md5({_HEAD.format('text')}) AS value FROM documents")
def heading_norm(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", F.md5(T.norm_heading(F.col("text"))).alias("value"))


_TOC_HIT = f"len(list_filter({_HEADS}, lambda h: length(h) <= 40 AND regexp_matches(h, '{_TOC_WORDS}'))) > 0"


@case("toc_heading", f"SELECT doc_id, {_TOC_HIT} AS value FROM documents")
def toc_heading(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", N.has_toc_heading(F.col("text"), _TOC_WORDS).alias("value"))


_IDX = f"list_filter({_HEADS}, lambda h: length(h) <= 30 AND ends_with(h, 'on'))"


@case("index_headings",
      f"SELECT doc_id, v[i] AS heading, i - 1 AS pos FROM (SELECT *, unnest(generate_series(1, len(v))) AS i FROM (SELECT doc_id, {S.distinct('x')} AS v FROM "
      f"(SELECT doc_id, {_IDX} AS x FROM (SELECT doc_id, replace(text, '.', chr(10)) AS text FROM documents))))")
def index_headings(spark, sf):
    text = F.replace("text", F.lit("."), F.lit("\n"))
    return typed(B.table(spark, sf, "documents").select("doc_id", F.posexplode(N.index_headings(text, "on")).alias("pos", "heading")))


@case("collapse_seeds", sql(
    "SELECT book, pdf_page AS seed FROM (SELECT book, pdf_page, lag(pdf_page) OVER (PARTITION BY book ORDER BY pdf_page) AS prev FROM bpages WHERE regexp_matches(text, '[0-9]')) "
    "WHERE prev IS NULL OR pdf_page - prev > 3", "bpages"))
def collapse_seeds(spark, sf):
    return N.collapse_seeds(B.pages(spark, sf).where(F.col("text").rlike("[0-9]")).select("book", F.col("pdf_page").alias("seed")))


B.CTES["last_"] = (("bpages",), "SELECT book, max(pdf_page) AS last FROM bpages GROUP BY 1")


@case("navigation_seeds", sql(
    f"SELECT book, pdf_page AS seed FROM (SELECT book, pdf_page, lag(pdf_page) OVER (PARTITION BY book ORDER BY pdf_page) AS prev FROM bpages JOIN last_ USING (book) "
    f"WHERE pdf_page <= greatest(1, CAST(floor(last * 0.3) AS BIGINT)) AND {_TOC_HIT}) WHERE prev IS NULL OR pdf_page - prev > 3", "bpages", "last_"))
def navigation_seeds(spark, sf):
    return N.toc_seeds(B.pages(spark, sf), _TOC_WORDS)


def _lookup(spark, sf):
    return B.pages(spark, sf).where(F.col("logical_page").isNotNull()).select("book", "logical_page", "pdf_page")


def _named_toc(spark, sf):
    """Contents entries; every title of an odd-length line is an index type."""
    t = B.toc(spark, sf)
    word = F.regexp_extract("title", "^([^ ]*)", 1)
    return t.withColumn("title", F.when(F.col("level") == 2, F.concat(word, F.lit("索引"))).when(F.col("level") == 3, "索引").otherwise(F.col("title")))


B.CTES["named_toc"] = (
    ("toc",),
    "SELECT book, pdf_page, logical_page, level, CASE WHEN level = 2 THEN regexp_extract(title, '^([^ ]*)', 1) || '索引' WHEN level = 3 THEN '索引' ELSE title END AS title FROM toc")


@case("seed_union", sql(
    f"SELECT book, pdf_page AS seed FROM bpages JOIN last_ USING (book) WHERE pdf_page >= greatest(1, CAST(floor(last * 0.6) AS BIGINT)) AND len({_IDX.replace('on', '索引')}) > 0 "
    f"UNION SELECT book, pdf_page FROM named_toc WHERE ends_with({_HEAD.format('title')}, '索引')", "bpages", "last_", "named_toc"))
def seed_union(spark, sf):
    return N.index_seeds(B.pages(spark, sf), _named_toc(spark, sf), _lookup(spark, sf))


@case("toc_fallback_order", sql(
    "WITH one AS (SELECT book, pdf_page AS p1 FROM bpages WHERE logical_page = 1 AND book NOT LIKE '%2'), d AS (SELECT 0 AS pos, 0 AS d UNION ALL SELECT i, -i FROM generate_series(1, 8) t(i) UNION ALL "
    "SELECT 8 + i, i FROM generate_series(1, 20) t(i)) SELECT book, pdf_page, CAST(pos + 1 AS BIGINT) AS priority FROM one, d JOIN bpages USING (book) WHERE pdf_page = p1 + d.d "
    "UNION ALL SELECT book, pdf_page, pdf_page FROM bpages WHERE book LIKE '%2' AND pdf_page <= 24", "bpages")
    .replace("FROM one, d JOIN bpages USING (book)", "FROM one CROSS JOIN d JOIN bpages USING (book)"))
def toc_fallback_order(spark, sf):
    p = B.pages(spark, sf)
    return N.toc_fallback_order(p, p.where(~F.col("book").endswith("2")))


_RESULTS = "SELECT book, pdf_page, CASE WHEN n_chars % 11 = 0 THEN NULL ELSE n_chars % 3 <> 0 END AS positive FROM bpages WHERE n_chars >= 60"


@case("sequence_stop_rule", sql(
    f"WITH RECURSIVE res AS ({_RESULTS}), walk AS (SELECT book, pdf_page AS seed, pdf_page, positive, coalesce(positive, false) AS found, "
    "CASE WHEN positive = false THEN 1 ELSE 0 END AS misses, 1 AS n FROM res UNION ALL "
    "SELECT w.book, w.seed, r.pdf_page, r.positive, w.found OR coalesce(r.positive, false), w.misses + CASE WHEN r.positive = false THEN 1 ELSE 0 END, n + 1 "
    "FROM walk w JOIN res r ON r.book = w.book AND r.pdf_page = w.pdf_page + 1 WHERE n < 10 AND NOT (w.positive IS NOT NULL AND NOT w.positive AND (w.found OR w.misses >= 2))) "
    "SELECT book, seed, pdf_page, positive, positive IS NULL AS error FROM walk", "bpages").replace("WITH bpages", "WITH RECURSIVE bpages").replace(", RECURSIVE res", ", res"))
def sequence_stop_rule(spark, sf):
    p = B.pages(spark, sf)  # every page is a seed; short pages were never looked at
    results = p.where("n_chars >= 60").select("book", "pdf_page", F.when(F.col("n_chars") % 11 != 0, F.col("n_chars") % 3 != 0).alias("positive"))
    seeds = p.select("book", F.col("pdf_page").alias("seed"))
    return N.sequence_stop_rule(seeds, results, N.TOC_MAX_PAGES)


def _toc_entries(spark, sf):
    """Title lines seen on contents pages of ten pages each; printed pages repeat by length."""
    t = B.toc(spark, sf)
    return t.select("book", F.floor(F.col("pdf_page") / 10).alias("source_pdf_page"), F.col("pdf_page").alias("pos"),
                    "title", (F.col("logical_page") % 7).alias("logical_page"), (F.col("level") * 2 - 2).alias("level"))


_TOC_MERGED = (
    "SELECT m.book, m.title, m.logical_page, b.pdf_page, m.level, m.pages FROM (SELECT book, regexp_replace(title, '\\s+', '', 'g') AS k, logical_page, min_by(title, (s, pos)) AS title, "
    "min(least(3, greatest(1, level))) AS level, array_to_string(list_sort(list(DISTINCT s)), ',') AS pages FROM (SELECT book, pdf_page // 10 AS s, pdf_page AS pos, trim(title) AS title, "
    "logical_page % 7 AS logical_page, level * 2 - 2 AS level FROM toc) WHERE title <> '' GROUP BY ALL) m LEFT JOIN bpages b ON b.book = m.book AND b.logical_page = m.logical_page")


@case("toc_merge", sql(_TOC_MERGED, "toc"))
def toc_merge(spark, sf):
    merged = N.toc_merge(_toc_entries(spark, sf), _lookup(spark, sf))
    return typed(merged.select("book", "title", "logical_page", "pdf_page", "level",
                               F.array_join(F.col("source_toc_pages").cast("array<string>"), ",").alias("pages")))


def _index_entries(spark, sf):
    """Index lines: the first two words of a line with the page they stand on."""
    t = B.index_terms(spark, sf).join(_lookup(spark, sf), ["book", "pdf_page"])
    return t.select("book", F.floor(F.col("pdf_page") / 10).alias("source_pdf_page"), F.col("pdf_page").alias("pos"), "term",
                    F.concat(F.substring("term", 1, 1), F.lit("索引")).alias("detected"), F.array("logical_page").alias("logical_pages"))


_INDEX_MERGED = (
    "SELECT book, idx AS index_type, min_by(term, (s, pdf_page, term)) AS term, array_to_string(list_sort(list(DISTINCT pdf_page)), ',') AS pdf_pages, "
    "array_to_string(list_sort(list(DISTINCT s)), ',') AS sources FROM (SELECT book, pdf_page, pdf_page // 10 AS s, term, substring(term, 1, 1) || '索引' AS idx FROM index_terms) "
    "GROUP BY book, idx, regexp_replace(term, '\\s+', '', 'g')")


@case("index_merge", sql(_INDEX_MERGED, "index_terms"))
def index_merge(spark, sf):
    entries = _index_entries(spark, sf).withColumn("pos", F.struct("pos", "term"))
    detected = entries.select("book", F.col("source_pdf_page").alias("pdf_page"), "detected")
    none = B.pages(spark, sf).where("false").select("book", "pdf_page", F.array(F.lit("")).alias("expected"))
    merged = N.index_merge(entries, N.index_type_join(detected, none), _lookup(spark, sf))
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return merged.select("book", "index_type", "term", join("pdf_pages").alias("pdf_pages"), join("source_index_pages").alias("sources"))


@case("index_type_join")
def index_type_join(spark, sf):
    expected = N.index_types(_named_toc(spark, sf).withColumn("pdf_page", F.floor(F.col("pdf_page") / 10)))
    detected = _index_entries(spark, sf).select("book", F.col("source_pdf_page").alias("pdf_page"), "detected")
    return typed(N.index_type_join(detected, expected).withColumn("candidate_index_types", F.array_join("candidate_index_types", ",")))


@case("unresolved_errors", sql(
    "SELECT book, 'toc' AS kind, pdf_page FROM bpages WHERE NOT regexp_matches(text, '[0-9]')", "bpages"))
def unresolved_errors(spark, sf):
    p = B.pages(spark, sf).withColumn("kind", F.lit("toc"))
    return N.unresolved_errors(p.select("book", "kind", "pdf_page"), p.where(F.col("text").rlike("[0-9]")))


@case("navigation_status", sql(
    "SELECT book, status, CASE WHEN t = 0 AND i > 0 THEN 'index extracted but toc was not detected' WHEN t = 0 THEN 'toc was not detected' WHEN e > 0 THEN "
    "'navigation extracted with unresolved page-level errors' WHEN i > 0 THEN 'toc and index extracted' ELSE 'toc extracted; no index found' END AS reason, t AS toc_count, i AS index_count, e AS error_count "
    "FROM (SELECT *, CASE WHEN t = 0 OR e > 0 THEN 'WARNING' WHEN i > 0 THEN 'OK' ELSE 'TOC_ONLY' END AS status FROM (SELECT book, count(*) FILTER (n_chars > 8000) AS t, "
    "count(*) FILTER (n_chars < 40) AS i, count(*) FILTER (n_chars > 16000) AS e FROM bpages GROUP BY 1))", "bpages"))
def navigation_status(spark, sf):
    p = B.pages(spark, sf)
    return N.navigation_status(p.select("book").distinct(), p.where("n_chars > 8000"), p.where("n_chars < 40"), p.where("n_chars > 16000"))


@case("navigation_build", sql(
    f"WITH t AS ({_TOC_MERGED}), i AS ({_INDEX_MERGED}), n AS (SELECT book, (SELECT count(*) FROM t WHERE t.book = b.book) AS t, (SELECT count(*) FROM i WHERE i.book = b.book) AS i, "
    "count(*) FILTER (n_chars % 97 = 0 AND n_chars % 2 <> 0) AS e FROM bpages b GROUP BY book) "
    "SELECT 'toc' AS part, book, title AS name, pages FROM t UNION ALL SELECT 'index', book, term, pdf_pages FROM i UNION ALL "
    "SELECT 'status', book, CASE WHEN t = 0 OR e > 0 THEN 'WARNING' WHEN i > 0 THEN 'OK' ELSE 'TOC_ONLY' END, t || ',' || i || ',' || e FROM n", "bpages", "toc", "index_terms"))
def navigation_build(spark, sf):
    p = B.pages(spark, sf)
    errors = p.where("n_chars % 97 = 0").select("book", F.lit("toc").alias("kind"), "pdf_page")
    results = p.where("n_chars % 2 = 0").select("book", F.lit("toc").alias("kind"), "pdf_page")
    entries = _index_entries(spark, sf).withColumn("pos", F.struct("pos", "term"))
    toc, index, status = N.navigation_build(p.select("book").distinct(), _toc_entries(spark, sf), entries, errors, results, _lookup(spark, sf))
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias("pages")
    return toc.select(F.lit("toc").alias("part"), "book", F.col("title").alias("name"), join("source_toc_pages")).unionByName(
        index.select(F.lit("index").alias("part"), "book", F.col("term").alias("name"), join("pdf_pages"))).unionByName(
        status.select(F.lit("status").alias("part"), "book", F.col("status").alias("name"), F.concat_ws(",", "toc_count", "index_count", "error_count").alias("pages")))


# ---- search ----

_ASKED = f"asked AS (SELECT query_id, variant_no, query, {S.nav(S.norm_query('query'))} AS q FROM variants)"


def _relation(exact, t_in_q, q_in_t):
    return (f"CASE WHEN q = e THEN {{{{'p': 4, 's': {exact}}}}} WHEN contains(q, e) THEN {{{{'p': 3, 's': {t_in_q}}}}} "
            f"WHEN contains(e, q) THEN {{{{'p': 2, 's': {q_in_t}}}}} END").replace("{{", "{").replace("}}", "}")


_INDEX_HITS = (
    f"ihits AS (SELECT query_id, variant_no, book, pdf_page, term, r.p AS priority, r.s AS score, authority FROM (SELECT *, {_relation('100.0', '92.0', '82.0')} AS r FROM asked, "
    f"(SELECT *, {S.nav('term')} AS e FROM index_terms) WHERE e <> '' AND (contains(q, e) OR contains(e, q))) JOIN book_weights USING (book)), "
    "ipages AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, variant_no, book, pdf_page ORDER BY priority DESC, authority DESC, score DESC, length(term) DESC, term) AS rn FROM ihits) WHERE rn = 1), "
    "isearch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY priority DESC, authority DESC, score DESC, pdf_page, book) AS rank FROM ipages) WHERE rank <= 8)")
_TOC_HITS = (
    f"thits AS (SELECT query_id, variant_no, book, pdf_page, title, level, r.s AS score, authority FROM (SELECT *, {_relation('95.0', '88.0', '78.0')} AS r FROM asked, "
    f"(SELECT *, {S.nav('title')} AS e FROM toc) WHERE e <> '' AND (contains(q, e) OR contains(e, q))) JOIN book_weights USING (book)), "
    "tpages AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, variant_no, book, pdf_page ORDER BY score DESC, authority DESC, level, title) AS rn FROM thits) WHERE rn = 1), "
    "tsearch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY score DESC, authority DESC, level, book, pdf_page) AS rank FROM tpages) WHERE rank <= 4)")
_SECTION = (
    "behind AS (SELECT t.*, d.d AS delta, t.pdf_page + d.d AS p FROM tsearch t, (SELECT unnest([1, 2]) AS d) d), "
    "sec AS (SELECT * FROM (SELECT b.*, row_number() OVER (PARTITION BY query_id, variant_no, b.book, p ORDER BY rank, delta) AS rn2 FROM behind b SEMI JOIN searchable s ON s.book = b.book AND s.pdf_page = b.p) WHERE rn2 = 1), "
    "ssearch AS (SELECT * FROM (SELECT query_id, variant_no, book, p AS pdf_page, score - 5.0 - delta AS score, authority, title, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY rank, delta) AS rn3 FROM sec) WHERE rn3 <= 6)")


@case("term_containment_join", sql(
    f"WITH {_ASKED}, {_INDEX_HITS} SELECT query_id, variant_no, book, pdf_page, term, CAST(priority AS BIGINT) AS priority, CAST(score AS DOUBLE) AS score, rank FROM isearch",
    "variants", "index_terms", "book_weights"))
def term_containment_join(spark, sf):
    v = variants(spark, sf)
    best, _ = N.index_search(v, B.index_terms(spark, sf), B.book_weights(spark, sf), fuzzy=None)
    return typed(best.select("query_id", "variant_no", "book", "pdf_page", "term", "priority", "score", "rank"))


@case("toc_containment_join", sql(
    f"WITH {_ASKED}, {_TOC_HITS} SELECT query_id, variant_no, book, pdf_page, title, CAST(score AS DOUBLE) AS score, rank FROM tsearch", "variants", "toc", "book_weights"))
def toc_containment_join(spark, sf):
    best = N.toc_search(variants(spark, sf), B.toc(spark, sf), B.book_weights(spark, sf), fuzzy=None)
    return typed(best.select("query_id", "variant_no", "book", "pdf_page", "title", "score", "rank"))


@case("fuzzy_ratio_join")
def fuzzy_ratio_join(spark, sf):
    q = B.index_terms(spark, sf).select(T.norm_nav(F.col("term")).alias("q")).distinct()
    e = B.toc(spark, sf).select(T.norm_nav(F.col("title")).alias("e")).distinct()
    return N.fuzzy_pairs(q, e, N.TOC_FUZZY).withColumn("ratio", F.round("ratio", 6))


@case("section_range_join", sql(
    f"WITH {_ASKED}, {_TOC_HITS}, {_SECTION} SELECT query_id, variant_no, book, pdf_page, CAST(score AS DOUBLE) AS score FROM ssearch",
    "variants", "toc", "book_weights", "searchable"))
def section_range_join(spark, sf):
    best = N.toc_search(variants(spark, sf), B.toc(spark, sf), B.book_weights(spark, sf), fuzzy=None)
    return N.section_expand(best, B.searchable(spark, sf)).select("query_id", "variant_no", "book", "pdf_page", "score")


def navigation(spark, sf, fuzzy=True):
    terms = B.once(spark, sf, "index_terms", lambda: B.index_terms(spark, sf))  # both are read for matching and again for the hits
    toc = B.once(spark, sf, "toc", lambda: B.toc(spark, sf))
    return N.navigation_search(B.questions(spark, sf), variants(spark, sf), terms, toc, B.stored_searchable(spark, sf), B.book_weights(spark, sf), fuzzy)


@case("navigation_search")
def navigation_search(spark, sf):
    return typed(navigation(spark, sf))


@case("navigation_search_contained", sql(
    f"WITH {_ASKED}, {_INDEX_HITS}, {_TOC_HITS}, {_SECTION}, exact AS (SELECT DISTINCT query_id, variant_no FROM ihits WHERE priority = 4), un AS ("
    "SELECT query_id, variant_no, book, pdf_page, 'index' AS source, 3 AS s, priority, authority, score FROM isearch UNION ALL "
    "SELECT query_id, variant_no, book, pdf_page, 'toc', 2, 0, authority, score FROM tsearch UNION ALL "
    "SELECT query_id, variant_no, book, pdf_page, 'section', 1, 0, authority, score FROM ssearch ANTI JOIN exact USING (query_id, variant_no)), "
    f"named AS (SELECT un.* EXCLUDE (score), score - CASE WHEN query <> {S.norm_query('question')} THEN 1.5 ELSE 0.0 END AS score FROM un JOIN variants USING (query_id, variant_no) JOIN questions USING (query_id)), "
    "merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, book, pdf_page ORDER BY s DESC, priority DESC, authority DESC, score DESC, variant_no) AS rn FROM named) WHERE rn = 1) "
    "SELECT query_id, book, pdf_page, source, CAST(score AS DOUBLE) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, priority DESC, authority DESC, score DESC, book, pdf_page) AS rank FROM merged) WHERE rank <= 12",
    "variants", "questions", "index_terms", "toc", "book_weights", "searchable"))
def navigation_search_contained(spark, sf):
    return typed(navigation(spark, sf, False).select("query_id", "book", "pdf_page", "source", "score", "rank"))
