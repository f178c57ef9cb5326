"""Ranking of chunks for a whole table of questions: lexical, vector, fused, definition, table search.

Queries come as ``(query_id, variant_no, query)`` rows, chunks as ``(book, pdf_page, chunk, text, ...)``.
Ties are broken by the chunk key, upwards.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import inverted
from marginalia.operators.containment import contained_terms
from marginalia.operators.corpus import allowed
from marginalia.operators.linked import linked_pages
from marginalia.operators.ranking import keep_best, spread, stripes, top_k
from marginalia.session import written

# --- Fixed values: fusion and table-search weights ---
RRF_K = 60.0
VECTOR_WEIGHT = 0.40
LEXICAL_WEIGHT = 0.60
CANDIDATES = 100
REASON_RANKS = 15
# -----------------------------------------------------

KEY = ("book", "pdf_page", "chunk")
ASK = ("query_id", "variant_no")


def explode_variants(questions: DataFrame, aliases=T.DOMAIN_ALIASES, limit: int = T.MAX_VARIANTS) -> DataFrame:
    """One row per search variant of each question, numbered from 1."""
    cols = questions.columns
    return questions.select(
        *cols, F.posexplode(T.query_variants(F.col("question"), aliases, limit)).alias("_pos", "query")
    ).select(*cols, (F.col("_pos") + 1).cast("bigint").alias("variant_no"), "query")


# ---- TF-IDF over character n-grams ---------------------------------------------

def gram_counts(
    docs: DataFrame, keys: Sequence[str], text: str, sizes: Sequence[int] = (2, 3, 4), placed: bool = False
) -> DataFrame:
    """Term frequency of every character n-gram per document.

    The texts are shuffled by document key, not the grams: counting per document then
    needs no further exchange, and document keys are never skewed. ``placed`` says that the
    rows are already spread by key.
    """
    flat = F.regexp_replace(F.lower("_t"), f"{T.WS}{{2,}}", " ")

    def grams(cs: Column) -> Column:
        def of_size(n: int) -> Column:
            each = F.transform(
                F.sequence(F.lit(0), F.size(cs) - n), lambda i: F.concat(*[F.get(cs, i + j) for j in range(n)])
            )
            return F.when(F.size(cs) >= n, each).otherwise(F.array().cast("array<string>"))

        return F.flatten(F.array(*[of_size(n) for n in sizes]))

    texts = docs.select(*keys, F.col(text).alias("_t"))
    return (
        (texts if placed else spread(texts, *keys))
        .select(*keys, flat.alias("_t"))
        .select(*keys, F.explode(T.let(F.split("_t", ""), grams)).alias("gram"))
        .groupBy(*keys, "gram")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def postings(docs: DataFrame, keys: Sequence[str] = KEY, stored: bool = False) -> DataFrame:
    """The documents' texts placed for n-gram passes, see ``inverted.postings``; frequencies, norms and scores read them, so they are written once."""
    return inverted.postings(docs, keys, stored)


def tfidf_fit(index: DataFrame) -> DataFrame:
    """Document frequency and smoothed inverse document frequency per gram of a ``postings`` table."""
    return inverted.frequencies(index)


def lexical_search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = CANDIDATES,
    keys: Sequence[str] = KEY,
    ask: Sequence[str] = ASK,
    index: DataFrame | None = None,
) -> DataFrame:
    """Top ``k`` documents per query by TF-IDF cosine over character n-grams.

    Query grams unknown to the documents are dropped before the query norm, and a ``books`` allow-list applies before the cut. The search
    streams the texts past the queries (``inverted.best_documents``): lists of grams live in a task for one segment of texts, and neither they nor
    scored pairs are ever written or shuffled.
    """
    index = postings(docs, keys) if index is None else index
    idf = written(tfidf_fit(index).select("gram", "idf"), "idf")
    weight = F.col("tf") * F.col("idf")
    known = gram_counts(queries, ask, "query").join(idf, "gram")
    # idf enters once for the query and once for the document side of the product
    packed = known.groupBy(*ask).agg(
        F.sqrt(F.sum(weight * weight)).alias("norm"),
        F.collect_list(F.struct("gram", (weight * F.col("idf")).alias("w"))).alias("_g"),
    )
    books = queries.select(*ask, "books") if "books" in queries.columns else queries.select(
        *ask, F.lit(None).cast("array<string>").alias("books"))
    wanted = packed.join(books, list(ask)).select(
        *ask, "books", F.col("_g.gram").alias("grams"), F.transform("_g.w", lambda w: w / F.col("norm")).alias("ws"))
    near = inverted.best_documents(index, idf, wanted, keys, ask, k)
    return top_k(near, ask, [F.col("score").desc(), *[F.col(c) for c in keys]], k)


# ---- exact nearest neighbours ----------------------------------------------------

def vector_search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = CANDIDATES,
    ask: Sequence[str] = ("query_id",),
    prefilter: bool = False,
    block_rows: int = 4_096,
    query_rows: int = 1_024,
) -> DataFrame:
    """Exact nearest vectors by squared Euclidean distance, ties by ``vec_id``; null vectors take no part.

    With ``prefilter`` the ``books`` of a query (null or empty: all) choose among the vectors' ``book`` before the cut, so that a query
    gets its ``k`` nearest of what it may see; otherwise books play no part here.

    Queries are sent once to each stripe of the vectors, which then stream by in blocks, by book: a query keeps its ``k`` best so far and passes over
    blocks without a book of its own. Only these leave the task. Nothing is broadcast and no pair table is built.
    """
    ask = list(ask)
    spark = vectors.sparkSession
    many = stripes(spark)
    book = F.col("book") if prefilter else F.lit(None).cast("string")
    # Empty, not null: writing a null list to Arrow walks back to the last list that is none.
    books = F.coalesce("books", F.array().cast("array<string>")) if prefilter else F.array().cast("array<string>")
    asked = written(queries.where("embedding IS NOT NULL").select(*ask, F.col("embedding").cast("array<double>").alias("embedding"), books.alias("books")), "asked")
    parts = max(1, -(-asked.count() // query_rows))
    numbers = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    part, stripe = F.pmod(F.xxhash64(*ask), F.lit(parts)), F.pmod(F.xxhash64("vec_id"), F.lit(many))
    left = asked.select(*ask, "embedding", "books", F.explode(F.transform(numbers(many), lambda s: (s * parts + part).cast("int"))).alias("_place"))
    shown = vectors.where("embedding IS NOT NULL").select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), book.alias("_book"))
    right = shown.select("*", F.explode(F.transform(numbers(parts), lambda p: (stripe * parts + p).cast("int"))).alias("_place"))
    both = left.unionByName(right.withColumn("books", F.array().cast("array<string>")), allowMissingColumns=True).withColumn("_asks", F.col("vec_id").isNull())
    ordered = both.repartitionById(many * parts, "_place").sortWithinPartitions("_place", F.col("_asks").desc(), "_book")
    types = dict(queries.dtypes)
    schema = ", ".join(f"{a} {types[a]}" for a in ask) + ", vec_id bigint, distance double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, waiting, near = None, [], None
        for batch in batches:
            where, asks = batch.column("_place").to_numpy(), batch.column("_asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((where[1:] != where[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if where[a] != place:
                    if near:
                        yield near.rows()
                    place, waiting, near = where[a], [], None
                if asks[a]:
                    waiting.append(batch.slice(a, b - a))
                    continue
                if near is None and waiting:
                    near = _Nearest(pa.Table.from_batches(waiting), ask, k)
                for at in range(a, b, block_rows) if near else ():
                    near.add(batch.slice(at, min(block_rows, b - at)))
        if near:
            yield near.rows()

    return top_k(ordered.mapInArrow(run, schema), ask, [F.col("distance"), F.col("vec_id")], k)


class _Nearest:
    """The nearest so far of some queries."""

    def __init__(self, queries: pa.Table, ask: list[str], k: int):
        self.asks, self.k = queries.select(ask), k
        self.points = _matrix(queries)
        self.books = [set(b) if b else None for b in queries.column("books").to_pylist()]
        self.best = [(np.empty(0), np.empty(0, np.int64)) for _ in self.books]

    def add(self, block: pa.RecordBatch) -> None:
        ids, a, b = block.column("vec_id").to_numpy(), _matrix(block), self.points
        distance = np.round((b * b).sum(1)[:, None] + (a * a).sum(1)[None, :] - 2.0 * (b @ a.T), 6) + 0.0
        book = block.column("_book").to_numpy(zero_copy_only=False)
        here = set(book.tolist())
        for q, (held, own) in enumerate(self.best):
            books = self.books[q]
            if books is not None and not books & here:
                continue
            near = distance[q] <= (held[-1] if len(held) == self.k else np.inf)
            if books is not None:
                near &= np.isin(book, list(books))
            at = np.flatnonzero(near)
            if len(at):
                d, i = np.concatenate([held, distance[q][at]]), np.concatenate([own, ids[at]])
                order = np.lexsort((i, d))[: self.k]
                self.best[q] = d[order], i[order]

    def rows(self) -> pa.RecordBatch:
        owner = pa.array(np.repeat(np.arange(len(self.best)), [len(d) for d, _ in self.best]))
        asks = {c: self.asks.column(c).combine_chunks().take(owner) for c in self.asks.column_names}
        found = {"vec_id": np.concatenate([i for _, i in self.best]), "distance": np.concatenate([d for d, _ in self.best])}
        return pa.RecordBatch.from_pydict({**asks, **found})


def _matrix(block: pa.Table | pa.RecordBatch) -> np.ndarray:
    lists = block.column("embedding")
    flat = (lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists).flatten().to_numpy(zero_copy_only=False)
    return flat.astype("float64").reshape(block.num_rows, -1)


def surviving_ranks(ranked: DataFrame, docs: DataFrame, ask: Sequence[str], keys: Sequence[str] = KEY) -> DataFrame:
    """Join ranked vectors to searchable documents and count ranks over the survivors only."""
    kept = ranked.join(docs.select("vec_id", *keys), "vec_id")
    if "books" in kept.columns:
        kept = kept.where(allowed(F.col("books"), F.col("book")))
    return top_k(kept.drop("rank"), ask, [F.col("distance"), F.col("vec_id")], 2**31 - 1)


def variant_ranks(
    vectors: DataFrame, docs: DataFrame, variants: DataFrame, query_vectors: DataFrame, books: DataFrame | None, k: int, keys: Sequence[str] = KEY, prefilter: bool = False
) -> DataFrame:
    """Ranks (query_id, variant_no, keys, rank) of the documents nearest to each query variant.

    ``query_vectors``: (query_id, embedding), or with ``variant_no`` too: a variant without a vector of its own takes the question's, the one whose
    ``variant_no`` is null. ``books``: (query_id, books); with ``prefilter`` they apply before the cut, to the documents' ``book``, else behind it.
    """
    if "variant_no" not in query_vectors.columns:
        query_vectors = query_vectors.withColumn("variant_no", F.lit(None).cast("bigint"))
    asked = query_vectors.join(books, "query_id", "left") if books is not None else query_vectors
    searched = vectors
    if prefilter:
        searched = vectors.join(docs.select("vec_id", "book"), "vec_id")
    near = vector_search(searched, asked, k, ASK, prefilter)
    near = near.join(books, "query_id", "left") if books is not None else near
    ranked = written(surviving_ranks(near, docs, ASK, keys), "near")
    # A null variant_no is the question's vector; it serves the variants that have none.
    own = ranked.where("variant_no IS NOT NULL")
    without = variants.select(*ASK).join(query_vectors.where("variant_no IS NOT NULL").select(*ASK), list(ASK), "left_anti")
    shared = ranked.where("variant_no IS NULL").drop("variant_no").join(without, "query_id")
    return own.join(variants.select(*ASK), list(ASK), "left_semi").unionByName(shared.select(own.columns))


# ---- definitions -------------------------------------------------------------------

def definition_search(
    docs: DataFrame,
    queries: DataFrame,
    weights: DataFrame,
    k: int,
    ask: Sequence[str] = ASK,
    brackets: tuple[str, str] = ("《", "》"),
    markers: Sequence[str] = T.DEFINITION_MARKERS,
    max_chars: int = 30,
) -> DataFrame:
    """Chunks that define a one-word question: bracketed early mentions and definition words score higher."""
    asked = queries.withColumn("term", T.norm_query(F.col("query"))).where(
        (F.length("term") > 0) & (F.length("term") <= max_chars) & ~F.col("term").rlike("[ 　]")
    )
    place = F.col("place")
    bonus = F.when(place < 0, 0.0).when(place <= 100, 13.0).when(place <= 250, 12.0).when(place <= 500, 11.0).otherwise(10.0)
    rated = docs.select(*KEY, (F.lit(1.0) + T.count_contains(F.col("text"), markers) * 0.75).alias("_base")).join(weights.select("book", "authority"), "book", "left")
    hits = contained_terms(docs, asked, "term", KEY, brackets).join(rated, list(KEY))
    scored = hits.select(*KEY, "term", F.round((F.col("_base") + bonus) * F.coalesce("authority", F.lit(1.0)), 6).alias("score"))
    matched = asked.join(scored, "term")
    if "books" in asked.columns:
        matched = matched.where(allowed(F.col("books"), F.col("book")))
    return top_k(
        matched.select(*ask, "query", *KEY, "score"), ask, [F.col("score").desc(), *[F.col(c) for c in KEY]], k
    )


# ---- rank fusion ---------------------------------------------------------------------

def fuse(
    vector: DataFrame, lexical: DataFrame, variants: DataFrame, keys: Sequence[str], labels: tuple[str, str]
) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists over all variants of a query.

    Output: query, key, score and the first three reasons in arrival order (variant by
    variant, vector before lexical). A group has at most two entries per variant.
    """
    both = vector.select(*ASK, *keys, "rank", F.lit(0).alias("_kind")).unionByName(
        lexical.select(*ASK, *keys, "rank", F.lit(1).alias("_kind"))
    )
    gain = F.when(F.col("_kind") == 0, F.lit(VECTOR_WEIGHT)).otherwise(F.lit(LEXICAL_WEIGHT)) / (F.lit(RRF_K) + F.col("rank"))
    shown = F.when(F.col("rank") <= REASON_RANKS, F.struct("variant_no", "_kind", "rank"))
    fused = both.groupBy("query_id", *keys).agg(
        F.sum(gain).alias("score"), F.slice(F.array_sort(F.collect_list(shown)), 1, 3).alias("_shown")
    )
    names = variants.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("variant_no", "query"))).alias("_names"))
    text = F.array_join(
        F.transform(
            "_shown",
            lambda s: F.concat(
                F.when(s["_kind"] == 0, labels[0]).otherwise(labels[1]), F.lit(" #"), s["rank"].cast("string"),
                F.lit("（"), F.try_element_at("_names", s["variant_no"]), F.lit("）"),
            ),
        ),
        " / ",
    )
    return fused.join(names, "query_id").select("query_id", *keys, "score", text.alias("_reasons"))


def hybrid_search(
    docs: DataFrame,
    vectors: DataFrame,
    questions: DataFrame,
    query_vectors: DataFrame,
    weights: DataFrame,
    k: int = 20,
    candidates: int = CANDIDATES,
    variants: DataFrame | None = None,
    prefilter: bool = False,
    brackets: tuple[str, str] = ("《", "》"),
    markers: Sequence[str] = T.DEFINITION_MARKERS,
    index: DataFrame | None = None,
) -> DataFrame:
    """Fused vector and lexical ranks times authority, led by a few definition hits.

    docs: searchable chunks with ``vec_id``; vectors: every indexed vector (vector ranks are cut before the class and book filter, or
    after it with ``prefilter``); query_vectors: (query_id, embedding) or with ``variant_no``, see ``variant_ranks``;
    index: ``postings`` of the docs, made here if there are none.
    """
    variants = explode_variants(questions) if variants is None else variants
    vector = variant_ranks(vectors, docs.where(F.col("vec_id").isNotNull()), variants, query_vectors, questions.select("query_id", "books"), candidates, KEY, prefilter)
    lexical = lexical_search(docs, variants, candidates, index=index)
    fused = fuse(vector, lexical, variants, KEY, ("ベクトル検索", "文字列検索"))
    auth = weights.select("book", "authority")
    ranked = fused.join(auth, "book", "left").select(
        "query_id", *KEY, F.round(F.col("score") * F.coalesce("authority", F.lit(1.0)), 9).alias("score"),
        F.lit(1).alias("_phase"),
        F.concat(F.lit("通常検索で高関連"), F.when(F.col("_reasons") != "", F.concat(F.lit("（"), F.col("_reasons"), F.lit("）"))).otherwise("")).alias("reason"),
    )
    defined = definition_search(docs, variants.where("variant_no <= 3"), weights, 2, ASK, brackets, markers)
    defined = keep_best(defined, ["query_id", *KEY], [F.col("variant_no"), F.col("rank")]).select(
        "query_id", *KEY, "score", F.lit(0).alias("_phase"),
        F.concat(F.lit("定義候補として直接一致（"), F.col("query"), F.lit("）")).alias("reason"),
    )
    merged = keep_best(defined.unionByName(ranked), ["query_id", *KEY], [F.col("_phase")])
    order = [F.col("_phase"), F.col("score").desc(), *[F.col(c) for c in KEY]]
    return top_k(merged, ["query_id"], order, k).drop("_phase")


# ---- tables and lists -------------------------------------------------------------------

def table_signal(
    text: Column, words: Sequence[str] = T.STRUCTURED_TERMS, markers: Sequence[str] = T.TABLE_MARKERS
) -> Column:
    """Question-independent part of the table score: table words, digit density and markers."""
    digits = F.length(F.regexp_replace(text, "[^\\p{Nd}]", ""))
    return (
        T.count_contains(text, words) * 8.0
        + F.least(F.lit(18.0), digits / F.greatest(F.length(text), F.lit(1)) * 180.0)
        + T.count_contains(text, markers) * 4.0
    )


def diverse_top_k(pages: DataFrame, ask: Sequence[str], order: Sequence[Column], k: int = 8, per_book: int = 2) -> DataFrame:
    """First one page per book, then up to ``per_book``, until ``k`` pages are chosen."""
    kept = top_k(pages, [*ask, "book"], order, per_book, "_in_book")
    return top_k(kept, ask, [(F.col("_in_book") > 1).cast("int"), *order], k).drop("_in_book")


def structured_search(
    docs: DataFrame,
    questions: DataFrame,
    variants: DataFrame,
    weights: DataFrame,
    words: Sequence[str] = T.STRUCTURED_TERMS,
    markers: Sequence[str] = T.TABLE_MARKERS,
    k: int = 8,
    per_book: int = 2,
    min_score: float = 25.0,
    min_coverage: float = 0.65,
) -> DataFrame:
    """Best table or list pages for table-like questions, spread over books.

    Pages that score without any link to the question are the same for every question, so at
    most ``2 k`` of them can ever be chosen; that bounded list is shared. All other pages are
    scored where they lie against all questions (``linked.linked_pages``); only a bounded number per question leaves a task.
    """
    asked = questions.where(T.is_structured(F.col("question"), words)).select("query_id", "books", "question")
    rated = (
        spread(docs.select(*KEY, "logical_page", "text"), *KEY)
        .join(weights.select("book", "authority"), "book", "left")
        .withColumn("authority", F.coalesce("authority", F.lit(1.0)))
        .withColumn("_norm", T.norm_nav(F.col("text")))
        .withColumn("_signal", table_signal(F.col("text"), words, markers))
        .drop("text")
    )
    rated = written(rated, "rated").where(F.length("_norm") > 0)  # before, the test would move in front of the shuffle and normalize every text twice
    wanted = (
        variants.join(asked.select("query_id"), "query_id", "left_semi")
        .withColumn("_v", T.norm_nav(F.col("query")))
        .where(F.length("_v") > 0)
        .select("query_id", "variant_no", "query", "_v")
    )
    facts = rated.select(*KEY, "logical_page", "authority", "_signal")

    def pages_of(scored: DataFrame, ask: Sequence[str]) -> DataFrame:
        kept = scored.where(F.col("_raw") >= min_score).withColumn("score", F.round(F.col("_raw") * F.col("authority"), 6))
        cols = [*ask, "book", "pdf_page", "logical_page", "authority", "score", "_term"]
        return keep_best(kept.select(*cols, "chunk"), [*ask, "book", "pdf_page"], [-F.col("score"), F.col("chunk")]).select(*cols)

    order = [F.col("score").desc(), F.col("authority").desc(), F.col("book"), F.col("pdf_page")]
    alone = pages_of(facts.withColumn("_raw", F.col("_signal")).withColumn("_term", F.lit(None).cast("string")), ())
    per_rank = top_k(alone, ["book"], order, per_book, "_in_book")
    filtered = asked.where(F.coalesce(F.size("books"), F.lit(0)) > 0)
    free = asked.where(F.coalesce(F.size("books"), F.lit(0)) <= 0)
    shared_rows = None
    for n in range(1, per_book + 1):
        part = per_rank.where(F.col("_in_book") == n).orderBy(*order).limit(k)
        shared_rows = part if shared_rows is None else shared_rows.unionByName(part)
    packed = shared_rows.drop("_in_book").agg(F.collect_list(F.struct(*alone.columns))).scalar()  # at most per_book * k rows
    base_free = free.select("query_id", F.inline(packed))
    base_filtered = (
        filtered.select("query_id", F.explode("books").alias("book")).distinct()
        .join(per_rank.drop("_in_book"), "book").select("query_id", *alone.columns)
    )
    chunks = rated.select(*KEY, "logical_page", "authority", F.col("_norm").alias("norm"), F.col("_signal").alias("signal"))
    asked_for = wanted.join(asked.select("query_id", "books"), "query_id").withColumnRenamed("_v", "v")
    found = linked_pages(chunks, asked_for, k, per_book, min_score, min_coverage).select("query_id", *alone.columns)
    everything = found.unionByName(base_free).unionByName(base_filtered)
    best = keep_best(everything, ["query_id", "book", "pdf_page"], [-F.col("score"), F.col("_term").isNull()])
    chosen = diverse_top_k(best, ["query_id"], order, k, per_book)
    return chosen.join(asked.select("query_id", T.norm_query(F.col("question")).alias("_q")), "query_id").select(
        "query_id", "rank", "book", "pdf_page", "logical_page", "score", "authority", F.lit("structured").alias("source"),
        F.concat(F.lit("表・一覧検索: "), F.coalesce("_term", "_q")).alias("label"),
    )
