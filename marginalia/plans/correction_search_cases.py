"""Cases for searching corrections and linking them to pages. Every document also serves as a
correction of the page its length points at."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import correction_search as Q
from marginalia.operators import retrieval as R
from marginalia.plans import bindings as B
from marginalia.plans import context_cases as CC
from marginalia.plans import search_cases as SC
from marginalia.plans import sqltext as S
from marginalia.plans.bindings import sql
from marginalia.plans.registry import case, typed


def corrections(spark, sf):
    d = B.table(spark, sf, "documents")
    n = F.col("n_chars")
    return d.select(
        F.concat("source", F.lit(":errata:"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("source").alias("source_key"), F.lit(None).cast("string").alias("source_name"),
        F.col("doc_id").alias("vec_id"), F.when(n % 10 != 0, n % 45 + 1).alias("target_page"),
        F.element_at(F.array(*[F.lit(o) for o in ("replace", "append", "delete")]), (n % 3 + 1).cast("int")).alias("operation"),
        F.regexp_extract("text", "^([^ ]*)", 1).alias("location"), F.regexp_extract("text", "^[^.,\n]*", 0).alias("before"),
        F.when(n % 3 == 0, F.regexp_extract("text", "[.,\n]([^.,\n]*)", 1)).alias("after"), F.when(n % 3 == 2, F.regexp_extract("text", "^([^ ]+ ?[^ ]*)", 1)).alias("delete_text"), "text")


B.CTES["corr"] = (
    (),
    "SELECT source || ':errata:' || doc_id AS chunk_id, source AS source_key, doc_id AS vec_id, CASE WHEN n_chars % 10 <> 0 THEN n_chars % 45 + 1 END AS target_page, ['replace', 'append', 'delete'][n_chars % 3 + 1] AS operation, "
    "regexp_extract(text, '^([^ ]*)', 1) AS location, text FROM documents")


def _hints(spark, sf):
    return B.table(spark, sf, "documents").select(F.col("source").alias("source_key"), F.col("source").alias("hint")).distinct()


def _targets(spark, sf):
    return Q.target_books(corrections(spark, sf), _hints(spark, sf), _hints(spark, sf).select(F.col("hint").alias("book")))


B.CTES["targets"] = ((), "SELECT a.source AS source_key, min(b.source) AS target_book FROM (SELECT DISTINCT source FROM documents) a JOIN (SELECT DISTINCT source FROM documents) b ON contains(b.source, a.source) GROUP BY 1 HAVING count(*) = 1")


@case("norm_nfkc", sql(
    f"SELECT chunk_id, md5({S.override('said')}) AS digest FROM (SELECT source || ':errata:' || doc_id AS chunk_id, concat_ws(chr(10), nullif(text, ''), nullif(regexp_extract(text, '^([^ ]*)', 1), ''), nullif(regexp_extract(text, '^[^.,\n]*', 0), ''), "
    "CASE WHEN n_chars % 3 = 0 THEN nullif(regexp_extract(text, '[.,\n]([^.,\n]*)', 1), '') END, CASE WHEN n_chars % 3 = 2 THEN nullif(regexp_extract(text, '^([^ ]+ ?[^ ]*)', 1), '') END, source) AS said FROM documents)"))
def norm_nfkc(spark, sf):
    return Q.haystacks(corrections(spark, sf)).select("chunk_id", F.md5("hay").alias("digest"))


_ENDLESS = S.strip("regexp_replace({}, '[。.!！?？]+$', '')")


@case("norm_official_question", f"SELECT item_id, {_ENDLESS.format('text')} AS value FROM benchmark")
def norm_official_question(spark, sf):
    from marginalia.functions.match import nfkc
    return B.table(spark, sf, "benchmark").select("item_id", nfkc(F.col("text")).alias("t")).select("item_id", Q.norm_question(F.col("t")).alias("value"))


_OTERMS = (f"SELECT query_id, whole, CASE WHEN whole <> '' AND NOT list_contains(l, whole) THEN list_prepend(whole, l) ELSE l END AS terms FROM (SELECT query_id, {S.override('c')} AS whole, {S.distinct('x')} AS l FROM "
           f"(SELECT query_id, c, list_filter(list_transform({S.terms_list(S.norm_query('c'))}, lambda w: {S.override('w')}), lambda w: w <> '') AS x FROM (SELECT query_id, {_ENDLESS.format('question')} AS c FROM questions)))")


@case("official_terms", sql(f"SELECT query_id, i - 1 AS pos, terms[i] AS term FROM (SELECT *, unnest(generate_series(1, len(terms))) AS i FROM ({_OTERMS}))", "questions"))
def official_terms(spark, sf):
    return typed(Q.question_terms(B.questions(spark, sf)).select("query_id", F.posexplode("terms").alias("pos", "term")))


@case("correction_lexical", sql(
    f"WITH {SC.scores_sql('corr', 'chunk_id', 'variants', 'query_id, variant_no')} SELECT * FROM (SELECT query_id, variant_no, chunk_id, score, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 100", "corr", "variants"))
def correction_lexical(spark, sf):
    return typed(R.lexical_search(corrections(spark, sf), SC.variants(spark, sf), 100, Q.CKEY))


_CFUSED = (
    f"WITH {SC.scores_sql('corr', 'chunk_id', 'variants', 'query_id, variant_no')}, lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 100), "
    f"{SC._VEC.replace('rank <= 100', 'rank <= 200')}, surv AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM near JOIN corr USING (vec_id)), "
    "lists AS (SELECT query_id, chunk_id, s.rank, 0.4 AS w FROM surv s JOIN variants USING (query_id) UNION ALL SELECT query_id, chunk_id, rank, 0.6 FROM lex), "
    "fused AS (SELECT query_id, chunk_id, round(sum(w::DOUBLE / (60.0 + rank)), 9) AS score FROM lists GROUP BY ALL) "
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fused) WHERE rank <= 20")


B.CTES["chits"] = (("corr", "variants"), _CFUSED)


def _hits(spark, sf):
    """The corrections that a question's search finds, as a table that later steps start from."""
    return B.once(spark, sf, "correction-hits", lambda: correction_search(spark, sf))


@case("correction_search", sql("SELECT * FROM chits", "chits"))
def correction_search(spark, sf):
    return typed(Q.correction_search(corrections(spark, sf), SC.vectors(spark, sf), SC.variants(spark, sf), SC.query_vectors(spark, sf)).drop("reason"))


@case("correction_relevance", sql(
    f"SELECT query_id, chunk_id, round(CASE WHEN wm THEN 1.0 WHEN len(s) = 1 THEN s[1] ELSE list_min(s) * 0.65 + list_sum(s) / len(s) * 0.35 END, 6) AS relevance, wm AS whole_match FROM (SELECT query_id, chunk_id, length(whole) >= 4 AND contains(hay, whole) AS wm, "
    f"list_transform(terms, lambda w: CASE WHEN contains(hay, w) THEN 1.0::DOUBLE WHEN length(w) >= 2 THEN {S.coverage('w', 'hay')} ELSE 0.0 END) AS s FROM (SELECT t.query_id, c.chunk_id, whole, terms, {S.override('c.text')} AS hay FROM ({_OTERMS}) t JOIN chits h USING (query_id) JOIN corr c USING (chunk_id)))", "questions", "corr", "chits"))
def correction_relevance(spark, sf):
    hits = _hits(spark, sf).select("query_id", "chunk_id")
    pairs = Q.question_terms(B.questions(spark, sf)).join(hits, "query_id")
    # only what a question has found is folded and travels
    hay = Q.haystacks(corrections(spark, sf).select("chunk_id", "text").join(hits.select("chunk_id"), "chunk_id", "left_semi"))
    return typed(Q.relevance(pairs.join(hay, "chunk_id")).select("query_id", "chunk_id", "relevance", "whole_match"))


@case("correction_target_book", sql("SELECT * FROM targets", "targets"))
def correction_target_book(spark, sf):
    return _targets(spark, sf).select("source_key", "target_book")


@case("correction_books_filter", sql("SELECT chunk_id, target_book FROM corr LEFT JOIN targets USING (source_key) WHERE vec_id % 2 = 0 OR target_book = 'src3'", "corr", "targets"))
def correction_books_filter(spark, sf):
    pairs = corrections(spark, sf).join(_targets(spark, sf), "source_key", "left").withColumn("books", F.when(F.col("vec_id") % 2 == 1, F.array(F.lit("src3"))))
    return Q.books_filter(pairs).select("chunk_id", "target_book")


@case("correction_target_pages", sql(
    "SELECT chunk_id, target_book, target_page, md5(p.t) AS digest FROM corr LEFT JOIN targets USING (source_key) LEFT JOIN (SELECT book AS target_book, logical_page AS target_page, string_agg(text, chr(10) ORDER BY chunk) AS t FROM searchable GROUP BY 1, 2) p USING (target_book, target_page)", "corr", "targets", "searchable"))
def correction_target_pages(spark, sf):
    r = Q.target_page_text(corrections(spark, sf), _targets(spark, sf), B.chunks(spark, sf))
    return typed(r.select("chunk_id", "target_book", "target_page", F.md5("page_text").alias("digest")))


@case("best_target_chunk")
def best_target_chunk(spark, sf):
    return typed(Q.best_target_chunk(corrections(spark, sf), _targets(spark, sf), B.chunks(spark, sf)))


@case("override_similarity")
def override_similarity(spark, sf):
    t = B.table(spark, sf, "conversations")
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("needle"))
    return Q.add_similarity(t.join(before, ["conv_id", "turn"]), "needle", "text", "similarity").select("conv_id", "turn", F.round("similarity", 6).alias("similarity"))


@case("correction_resolve")
def correction_resolve(spark, sf):
    r = Q.resolve(corrections(spark, sf), _targets(spark, sf), B.chunks(spark, sf))
    return typed(r.select("chunk_id", "operation", "match_status", "match_score"))


@case("correction_select")
def correction_select(spark, sf):
    return typed(selected(spark, sf).select("query_id", "rank", "chunk_id", "relevance", "retrieval_score", "whole_match"))


def selected(spark, sf):
    return Q.select_corrections(B.questions(spark, sf), corrections(spark, sf), _targets(spark, sf), SC.vectors(spark, sf), SC.query_vectors(spark, sf))


def _picked(spark, sf):
    """The first corrections that a question's search finds, with the book they amend."""
    hits = _hits(spark, sf).where(F.col("rank") <= Q.TOP).select("query_id", "chunk_id", "rank")
    return hits.join(corrections(spark, sf), "chunk_id").join(_targets(spark, sf), "source_key", "left")


_PICKED = "SELECT * FROM (SELECT query_id, chunk_id, rank FROM chits WHERE rank <= 6) JOIN corr USING (chunk_id) LEFT JOIN targets USING (source_key)"


@case("correction_citations", sql(
    f"SELECT query_id, chunk_id, query_id + rank AS id, source_key AS book, coalesce(target_page, 0) AS page, '公式エラッタ・追加訂正 / operation=' || operation || CASE WHEN location <> '' THEN ' / 対象箇所=' || location ELSE '' END AS reason, "
    f"{S.excerpt('raw', 'CAST([] AS VARCHAR[])')} AS excerpt FROM (SELECT *, {S.squeeze('text')} AS raw FROM ({_PICKED}))", "corr", "targets", "chits"))
def correction_citations(spark, sf):
    cited = B.questions(spark, sf).select("query_id", F.col("query_id").alias("id"))
    return typed(Q.correction_citations(_picked(spark, sf), cited).select("query_id", "chunk_id", "id", "book", "page", "reason", "excerpt"))


@case("correction_citation_join", sql(
    f"SELECT query_id, chunk_id, rank AS own_citation, p.id AS page_citation FROM ({_PICKED}) k LEFT JOIN (SELECT query_id, book AS target_book, pdf_page AS target_page, id FROM cited) p USING (query_id, target_book, target_page)", "corr", "targets", "chits", "cited"))
def correction_citation_join(spark, sf):
    picked = _picked(spark, sf).withColumn("target_pdf_page", F.col("target_page"))
    pages = CC.numbered(spark, sf).select("query_id", "book", "pdf_page", "id")
    own = picked.select("query_id", "chunk_id", F.col("rank").alias("id"))
    return typed(Q.citation_join(picked, own, pages).select("query_id", "chunk_id", "own_citation", "page_citation"))


@case("correction_context_text", sql(
    f"SELECT query_id, count(*) AS n, md5(string_agg(text, chr(10) ORDER BY rank)) AS digest FROM ({_PICKED}) GROUP BY 1", "corr", "targets", "chits"))
def correction_context_text(spark, sf):
    s = _picked(spark, sf).withColumn("match_status", F.lit("PAGE_ONLY")).withColumn("match_score", F.lit(0.5)).withColumn("own_citation", F.col("rank")).withColumn("page_citation", F.lit(None).cast("int"))
    texts = Q.context_text(s)
    blocks = F.split("corrections", "(?:^|\\n\\n)\\[訂正\\]\\n")
    body = F.transform(F.slice(blocks, F.lit(2), F.size(blocks)), lambda b: F.regexp_extract(b, "(?s)\\n内容:\\n(.*)$", 1))
    return texts.select("query_id", (F.size(blocks) - 1).cast("bigint").alias("n"), F.md5(F.array_join(body, "\n")).alias("digest"))


@case("correction_target_context")
def correction_target_context(spark, sf):
    s = _picked(spark, sf).withColumn("relevance", F.lit(1.0)).withColumn("append_text", F.lit(None).cast("string"))
    return typed(Q.target_context(s, _targets(spark, sf), B.chunks(spark, sf), B.questions(spark, sf), B.book_weights(spark, sf)))
