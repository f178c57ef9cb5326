"""Cases for retrieval: TF-IDF, vectors, fusion, definitions, table search."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import retrieval as R
from marginalia.plans import bindings as B
from marginalia.plans import sqltext as S
from marginalia.plans.bindings import sql
from marginalia.plans.registry import case, typed

# ---- shared SQL ----
_FLAT = "regexp_replace(lower({}), '\\s{{2,}}', ' ', 'g')"


def grams_sql(source: str, key: str, text: str, sizes=(2, 3, 4)) -> str:
    parts = " UNION ALL ".join(
        f"SELECT {key}, unnest(list_transform(generate_series(1, length(t) - {n - 1}), lambda i: substring(t, CAST(i AS BIGINT), {n}))) AS gram "
        f"FROM (SELECT {key}, {_FLAT.format(text)} AS t FROM {source}) WHERE length(t) >= {n}" for n in sizes)
    return f"SELECT {key}, gram, count(*) AS tf FROM ({parts}) GROUP BY ALL"


def _variants_sql(source: str = "questions", text: str = "question", aliases=T.DOMAIN_ALIASES) -> str:
    inner = (f"SELECT query_id, nq, {S.distinct('raw')} AS terms FROM (SELECT query_id, nq, {S.terms_list('nq')} AS raw FROM "
             f"(SELECT query_id, {S.norm_query(text)} AS nq FROM {source}))")
    return (f"SELECT query_id, i AS variant_no, v[i] AS query FROM (SELECT *, unnest(generate_series(1, len(v))) AS i FROM "
            f"(SELECT query_id, {S.variants('nq', 'terms', aliases)} AS v FROM ({inner})))")


B.CTES["variants"] = (("questions",), _variants_sql(aliases={}))


def scores_sql(docs: str, key: str, queries: str, ask: str, text: str = "text", query: str = "query") -> str:
    """CTE list that ends in ``scored(ask, key, score)``."""
    dkey = ", ".join(f"d.{k.strip()}" for k in key.split(","))
    qkey = ", ".join(f"q.{k.strip()}" for k in ask.split(","))
    return (
        f"tf AS ({grams_sql(docs, key, text)}), n AS (SELECT count(*) AS n FROM {docs}), "
        "idf AS (SELECT gram, ln((1.0 + (SELECT n FROM n)) / (1.0 + count(*))) + 1 AS idf FROM tf GROUP BY gram), "
        f"dn AS (SELECT {key}, sqrt(sum((tf * idf) * (tf * idf))) AS dn FROM tf JOIN idf USING (gram) GROUP BY {key}), "
        f"qtf AS (SELECT * FROM ({grams_sql(queries, ask, query)}) JOIN idf USING (gram)), "
        f"qn AS (SELECT {ask}, sqrt(sum((tf * idf) * (tf * idf))) AS qn FROM qtf GROUP BY {ask}), "
        f"qw AS (SELECT {qkey}, q.gram, q.tf * q.idf * q.idf / n.qn AS w FROM qtf q JOIN qn n USING ({ask})), "
        f"dots AS (SELECT {dkey}, {qkey}, sum(d.tf * q.w) AS dot FROM tf d JOIN qw q USING (gram) GROUP BY ALL), "
        f"scored AS (SELECT * FROM (SELECT * EXCLUDE (dot, dn), round(dot / dn, 6) AS score FROM dots JOIN dn USING ({key})) WHERE score > 0)"
    )


_KEY = "book, pdf_page, chunk"
_SCORES = scores_sql("searchable", _KEY, "variants", "query_id, variant_no")
_LEX = (f"lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY score DESC, {_KEY}) AS rank FROM scored) "
        "WHERE rank <= 100)")
_VEC = (
    "qvec AS (SELECT item_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM benchmark JOIN embeddings ON vec_id = item_id), "
    "dist AS (SELECT query_id, vec_id, round(list_sum(list_transform(generate_series(1, len(e)), lambda i: (e[i] - v[i]) * (e[i] - v[i]))), 6) AS distance "
    "FROM qvec, (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)), "
    "near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM dist) WHERE rank <= 100)")
_SURV = ("surv AS (SELECT query_id, book, pdf_page, chunk, distance, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank "
         "FROM near JOIN searchable ON doc_id = vec_id AND chunk = 0)")


def queries_one(spark, sf):
    """Questions with their own text as the single variant."""
    return B.questions(spark, sf).select("query_id", F.lit(1).cast("bigint").alias("variant_no"), F.col("question").alias("query"))


def variants(spark, sf):
    return R.explode_variants(B.questions(spark, sf))


def vectors(spark, sf):
    return B.table(spark, sf, "embeddings").select("vec_id", "embedding")


def query_vectors(spark, sf):
    """A question's vector is the one that carries its id."""
    return B.table(spark, sf, "benchmark").join(vectors(spark, sf), F.col("item_id") == F.col("vec_id")).select(
        F.col("item_id").alias("query_id"), "embedding")


def indexed(spark, sf):
    """Searchable chunks; the vector of a document belongs to its first chunk."""
    return B.stored_searchable(spark, sf).withColumn("vec_id", F.when(F.col("chunk") == 0, F.col("doc_id")))


def index(spark, sf):
    """The chunks' texts for lexical search, straight from their table."""
    return R.postings(B.stored_searchable(spark, sf), stored=True)


@case("tfidf_fit", sql(
    f"WITH tf AS ({grams_sql('searchable', _KEY, 'text')}) SELECT gram, count(*) AS df, "
    "round(ln((1.0 + (SELECT count(*) FROM searchable)) / (1.0 + count(*))) + 1, 6) AS idf FROM tf GROUP BY gram", "searchable"))
def tfidf_fit(spark, sf):
    return R.tfidf_fit(R.postings(B.searchable(spark, sf))).withColumn("idf", F.round("idf", 6))


@case("lexical_search", sql(
    f"WITH one AS (SELECT query_id, CAST(1 AS BIGINT) AS variant_no, question AS query FROM questions), "
    f"{scores_sql('searchable', _KEY, 'one', 'query_id, variant_no')} SELECT * FROM (SELECT query_id, {_KEY}, score, "
    f"row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {_KEY}) AS rank FROM scored) WHERE rank <= 20", "searchable", "questions"))
def lexical_search(spark, sf):
    return typed(R.lexical_search(B.stored_searchable(spark, sf), queries_one(spark, sf), 20, index=index(spark, sf)).drop("variant_no"))


@case("rank_positions", sql(
    f"WITH {_SCORES}, kept AS (SELECT * FROM scored WHERE query_id % 2 = 0 OR book LIKE '%1') SELECT * FROM (SELECT query_id, variant_no, {_KEY}, "
    f"row_number() OVER (PARTITION BY query_id, variant_no ORDER BY score DESC, {_KEY}) AS rank FROM kept) WHERE rank <= 100", "searchable", "variants"))
def rank_positions(spark, sf):
    # odd questions carry an allow-list of books: ranks count what passes it
    listed = B.table(spark, sf, "documents").where(F.col("source").endswith("1")).agg(F.collect_set("source").alias("books"), F.lit(1).alias("odd"))
    q = variants(spark, sf).drop("books").withColumn("odd", F.col("query_id") % 2).join(listed, "odd", "left").drop("odd")
    return typed(R.lexical_search(B.stored_searchable(spark, sf), q, index=index(spark, sf)).drop("score"))


@case("topk_per_query", sql(
    f"WITH {_SCORES} SELECT * FROM (SELECT query_id, variant_no, {_KEY}, score, row_number() OVER "
    f"(PARTITION BY query_id, variant_no ORDER BY score DESC, {_KEY}) AS rank FROM scored) WHERE rank <= 3", "searchable", "variants"))
def topk_per_query(spark, sf):
    return typed(R.lexical_search(B.stored_searchable(spark, sf), variants(spark, sf), 3, index=index(spark, sf)))


@case("vector_search", f"WITH {_VEC} SELECT query_id, vec_id, distance, rank FROM near")
def vector_search(spark, sf):
    return typed(R.vector_search(vectors(spark, sf), query_vectors(spark, sf)))


@case("vector_filter_after", sql(f"WITH {_VEC}, {_SURV} SELECT query_id, {_KEY}, rank FROM surv", "searchable"))
def vector_filter_after(spark, sf):
    near = R.vector_search(vectors(spark, sf), query_vectors(spark, sf))
    docs = indexed(spark, sf).where(F.col("vec_id").isNotNull())
    return typed(R.surviving_ranks(near, docs, ("query_id",)).select("query_id", *R.KEY, "rank"))


def _listed(spark, sf):
    """Questions and their vectors; odd questions may only see books that end in 1."""
    books = B.table(spark, sf, "documents").where(F.col("source").endswith("1")).agg(F.collect_set("source").alias("books"), F.lit(1).alias("odd"))
    return query_vectors(spark, sf).withColumn("odd", F.col("query_id") % 2).join(books, "odd", "left").drop("odd")


_BOOKED = ("vbook AS (SELECT e.vec_id, s.book, CAST(embedding AS DOUBLE[]) AS v FROM embeddings e LEFT JOIN (SELECT doc_id, source AS book FROM documents) s ON s.doc_id = e.vec_id), "
           "bdist AS (SELECT item_id AS query_id, vbook.vec_id, book, round(list_sum(list_transform(generate_series(1, len(v)), lambda i: (e[i] - v[i]) * (e[i] - v[i]))), 6) AS distance "
           "FROM (SELECT item_id, CAST(embedding AS DOUBLE[]) AS e FROM benchmark JOIN embeddings ON vec_id = item_id), vbook)")


def _with_books(spark, sf):
    docs = B.table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.col("source").alias("book"))
    return vectors(spark, sf).join(docs, "vec_id", "left")


@case("vector_prefilter", f"WITH {_BOOKED} SELECT query_id, vec_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank "
      "FROM bdist WHERE query_id % 2 = 0 OR book LIKE '%1') WHERE rank <= 100")
def vector_prefilter(spark, sf):
    return typed(R.vector_search(_with_books(spark, sf), _listed(spark, sf), prefilter=True))


@case("vector_books_after", f"WITH {_BOOKED} SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (SELECT *, row_number() OVER "
      "(PARTITION BY query_id ORDER BY distance, vec_id) AS first FROM bdist) WHERE first <= 100 AND (query_id % 2 = 0 OR book LIKE '%1')")
def vector_books_after(spark, sf):
    asked = _listed(spark, sf)
    near = R.vector_search(vectors(spark, sf), asked).join(asked.select("query_id", "books"), "query_id")
    return typed(R.surviving_ranks(near, _with_books(spark, sf), ("query_id",), ("book",)).select("query_id", "vec_id", "distance", "rank"))


def variant_vectors(spark, sf):
    """A vector per question (its own id), and per later variant (the id of question and variant added)."""
    later = variants(spark, sf).where("variant_no > 1").select("query_id", "variant_no", (F.col("query_id") + F.col("variant_no")).alias("vec_id"))
    return later.join(vectors(spark, sf), "vec_id").select("query_id", "variant_no", "embedding").unionByName(
        query_vectors(spark, sf).select("query_id", F.lit(None).cast("bigint").alias("variant_no"), "embedding"))


@case("variant_vectors", sql(
    "WITH asked AS (SELECT query_id, variant_no, coalesce(CASE WHEN variant_no > 1 THEN o.vec_id END, q.vec_id) AS id FROM variants LEFT JOIN embeddings o ON o.vec_id = query_id + variant_no "
    "LEFT JOIN embeddings q ON q.vec_id = query_id), qv AS (SELECT asked.*, CAST(embedding AS DOUBLE[]) AS e FROM asked JOIN embeddings ON vec_id = id), "
    "vd AS (SELECT query_id, variant_no, vec_id, round(list_sum(list_transform(generate_series(1, len(e)), lambda i: (e[i] - v[i]) * (e[i] - v[i]))), 6) AS distance "
    "FROM qv, (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)), "
    "vn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY distance, vec_id) AS first FROM vd) WHERE first <= 100) "
    f"SELECT query_id, variant_no, {_KEY}, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY distance, vec_id) AS rank FROM vn JOIN searchable ON doc_id = vec_id AND chunk = 0",
    "searchable", "variants"))
def variant_vector_ranks(spark, sf):
    docs = indexed(spark, sf).where(F.col("vec_id").isNotNull())
    ranks = R.variant_ranks(vectors(spark, sf), docs, variants(spark, sf), variant_vectors(spark, sf), None, R.CANDIDATES)
    return typed(ranks.select("query_id", "variant_no", *R.KEY, "rank"))


_FUSED = (
    f"WITH {_SCORES}, {_LEX}, {_VEC}, {_SURV}, lists AS (SELECT query_id, variant_no, {_KEY}, s.rank, 0 AS kind FROM surv s JOIN variants USING (query_id) "
    f"UNION ALL SELECT query_id, variant_no, {_KEY}, rank, 1 FROM lex), "
    f"fused AS (SELECT query_id, {_KEY}, sum((CASE WHEN kind = 0 THEN 0.4 ELSE 0.6 END) / (60.0 + rank)) AS score, "
    "array_to_string(list_slice(list(CASE WHEN kind = 0 THEN 'ベクトル検索 #' ELSE '文字列検索 #' END || rank || '（' || query || '）' "
    "ORDER BY variant_no, kind) FILTER (rank <= 15), 1, 3), ' / ') AS reasons FROM lists JOIN variants USING (query_id, variant_no) GROUP BY ALL)")


B.CTES["hybrid"] = (
    ("searchable", "variants", "book_weights"),
    _FUSED + f" SELECT * FROM (SELECT query_id, {_KEY}, score, '通常検索で高関連' || CASE WHEN reasons <> '' THEN '（' || reasons || '）' ELSE '' END AS reason, "
    f"row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {_KEY}) AS rank FROM (SELECT query_id, {_KEY}, reasons, "
    "round(score * authority, 9) AS score FROM fused JOIN book_weights USING (book))) WHERE rank <= 20")


@case("hybrid_search", sql("SELECT * FROM hybrid", "hybrid"))
def hybrid_search(spark, sf):
    return typed(hybrid(spark, sf))


def hybrid(spark, sf, k=20):
    return R.hybrid_search(indexed(spark, sf), vectors(spark, sf), B.questions(spark, sf), query_vectors(spark, sf),
                           B.book_weights(spark, sf), k, index=index(spark, sf))


def hits(spark, sf):
    """The fused hits as a table that later steps start from."""
    return B.once(spark, sf, "hybrid", lambda: typed(hybrid(spark, sf)))


@case("top_reasons", sql(
    _FUSED + f" SELECT query_id, {_KEY}, round(score, 9) AS score, coalesce(reasons, '') AS reasons FROM fused", "searchable", "variants"))
def top_reasons(spark, sf):
    near = R.vector_search(vectors(spark, sf), query_vectors(spark, sf))
    docs = indexed(spark, sf)
    v = variants(spark, sf)
    survivors = R.surviving_ranks(near, docs.where(F.col("vec_id").isNotNull()), ("query_id",)).join(v.select(*R.ASK), "query_id")
    fused = R.fuse(survivors, R.lexical_search(docs, v, index=index(spark, sf)), v, R.KEY, ("ベクトル検索", "文字列検索"))
    return fused.select("query_id", *R.KEY, F.round("score", 9).alias("score"), F.col("_reasons").alias("reasons"))


_WORDS = (f"SELECT DISTINCT unnest({S.terms_list(S.norm_query('question'))}) AS query FROM questions")


@case("definition_search", sql(
    f"WITH words AS ({_WORDS}), terms AS (SELECT query, {S.norm_query('query')} AS term FROM words), hits AS (SELECT query, {_KEY}, "
    "instr(text, ' ' || term || '.') - 1 AS place, " + S.count_of("text", B.LATIN_MARKERS) + " * 0.75 AS extra FROM terms JOIN searchable ON contains(text, term) "
    "WHERE length(term) BETWEEN 1 AND 30), scored AS (SELECT query, book, pdf_page, chunk, round((1.0 + extra + CASE WHEN place < 0 THEN 0.0 WHEN place <= 100 THEN 13.0 "
    "WHEN place <= 250 THEN 12.0 WHEN place <= 500 THEN 11.0 ELSE 10.0 END) * authority, 6) AS score FROM hits JOIN book_weights USING (book)) "
    f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, {_KEY}) AS rank FROM scored) WHERE rank <= 20",
    "searchable", "questions", "book_weights"))
def definition_search(spark, sf):
    words = B.questions(spark, sf).select(F.explode(T.query_terms(F.col("question"))).alias("query")).distinct()
    return typed(R.definition_search(B.searchable(spark, sf), words, B.book_weights(spark, sf), 20, ask=("query",),
                                     brackets=(" ", "."), markers=B.LATIN_MARKERS).select("query", *R.KEY, "score", "rank"))


_STRUCT_QUERY = S.any_of(S.norm_query("question"), B.LATIN_TABLE_TERMS)


@case("structured_search", sql(
    f"WITH asked AS (SELECT query_id, {S.norm_query('question')} AS nq FROM questions WHERE {_STRUCT_QUERY}), "
    f"wanted AS (SELECT query_id, variant_no, query, {S.nav('query')} AS v FROM variants JOIN asked USING (query_id)), "
    f"rated AS (SELECT *, {S.count_of('text', B.LATIN_TABLE_TERMS)} * 8.0 + least(18.0, length(regexp_replace(text, '[^\\p{{Nd}}]', '', 'g'))::DOUBLE / length(text) * 180.0) "
    f"+ {S.count_of('text', B.LATIN_MARKERS)} * 4.0 AS signal FROM (SELECT *, {S.nav('text')} AS t FROM searchable JOIN (SELECT book, authority FROM book_weights) USING (book)) WHERE t <> ''), "
    f"pairs AS (SELECT query_id, variant_no, query, book, pdf_page, logical_page, chunk, authority, signal, contains(t, v) AS hit, {S.coverage('v', 't')} AS cov "
    "FROM wanted, rated), "
    f"scored AS (SELECT query_id, {_KEY}, logical_page, authority, signal + sum(CASE WHEN hit THEN (CASE WHEN variant_no = 1 THEN 120.0 ELSE 40.0 END) "
    "WHEN cov >= 0.65 THEN cov * 18.0 ELSE 0.0 END) AS raw, min_by(query, variant_no) FILTER (hit) AS term FROM pairs GROUP BY query_id, book, pdf_page, chunk, logical_page, authority, signal), "
    "pages_ AS (SELECT query_id, book, pdf_page, logical_page, authority, max(score) AS score, min_by(term, (-score, chunk)) AS term FROM "
    "(SELECT *, round(raw * authority, 6) AS score FROM scored WHERE raw >= 25) GROUP BY ALL), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, book ORDER BY score DESC, pdf_page) AS rn FROM pages_) "
    "SELECT query_id, rank, book, pdf_page, logical_page, score, authority, 'structured' AS source, '表・一覧検索: ' || coalesce(term, nq) AS label FROM "
    "(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (rn > 1)::INT, score DESC, authority DESC, book, pdf_page) AS rank FROM ranked WHERE rn <= 2) "
    "JOIN asked USING (query_id) WHERE rank <= 8", "searchable", "variants", "book_weights"))
def structured_search(spark, sf):
    return typed(structured(spark, sf))


def structured(spark, sf):
    return R.structured_search(B.stored_searchable(spark, sf), B.questions(spark, sf), variants(spark, sf), B.book_weights(spark, sf),
                               B.LATIN_TABLE_TERMS, B.LATIN_MARKERS)


@case("book_diversity_topk", sql(
    "SELECT * FROM (SELECT query_id, book, pdf_page, score, row_number() OVER (PARTITION BY query_id ORDER BY (rn > 1)::INT, score DESC, book, pdf_page) AS rank FROM "
    "(SELECT *, row_number() OVER (PARTITION BY query_id, book ORDER BY score DESC, pdf_page) AS rn FROM (SELECT category AS query_id, book, pdf_page, n_chars AS score "
    "FROM bpages)) WHERE rn <= 2) WHERE rank <= 30", "bpages"))
def book_diversity_topk(spark, sf):
    p = B.pages(spark, sf).select(F.col("category").alias("query_id"), "book", "pdf_page", F.col("n_chars").alias("score"))
    return typed(R.diverse_top_k(p, ["query_id"], [F.col("score").desc(), F.col("book"), F.col("pdf_page")], 30))
