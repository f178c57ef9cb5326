"""Cases for the text, query and scoring expressions over whole driver texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.plans import bindings as B
from marginalia.plans import sqltext as S
from marginalia.plans.registry import case, typed

LATIN_SUFFIXES = ("of the", "the", "tion", "ing", "es", "re")
_KEY = "conv_id, turn"


def _turns(spark, sf):
    return B.table(spark, sf, "conversations")


@case("norm_query", f"SELECT {_KEY}, {S.norm_query('text', LATIN_SUFFIXES)} AS value FROM conversations")
def norm_query(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", T.norm_query(F.col("text"), LATIN_SUFFIXES).alias("value"))


@case("norm_nav", f"SELECT doc_id, md5({S.nav('text')}) AS value FROM documents")
def norm_nav(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", F.md5(T.norm_nav(F.col("text"))).alias("value"))


@case("norm_override", f"SELECT doc_id, md5({S.override('text')}) AS value FROM documents")
def norm_override(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", F.md5(T.norm_override(F.col("text"))).alias("value"))


@case("query_terms",
      f"SELECT {_KEY}, i AS pos, terms[i + 1] AS term FROM (SELECT *, unnest(generate_series(0, len(terms) - 1)) AS i FROM "
      f"(SELECT {_KEY}, {S.distinct('raw')} AS terms FROM (SELECT {_KEY}, {S.terms_list(S.norm_query('text'))} AS raw FROM conversations)))")
def query_terms(spark, sf):
    return typed(_turns(spark, sf).select("conv_id", "turn", F.posexplode(T.query_terms(F.col("text"))).alias("pos", "term")))


_TERMS_SQL = (f"(SELECT *, {S.distinct('raw')} AS terms FROM (SELECT *, {S.terms_list('nq')} AS raw FROM "
              f"(SELECT *, {S.norm_query('text')} AS nq FROM {{}})))")


@case("query_variants",
      f"SELECT {_KEY}, i AS pos, v[i + 1] AS variant FROM (SELECT *, unnest(generate_series(0, len(v) - 1)) AS i FROM "
      f"(SELECT {_KEY}, {S.variants('nq', 'terms', B.LATIN_ALIASES)} AS v FROM {_TERMS_SQL.format('conversations')}))")
def query_variants(spark, sf):
    return typed(_turns(spark, sf).select(
        "conv_id", "turn", F.posexplode(T.query_variants(F.col("text"), B.LATIN_ALIASES)).alias("pos", "variant")))


_BROAD = ("que", "tion of")


@case("is_structured", f"SELECT {_KEY}, {S.any_of(S.norm_query('text'), B.LATIN_TABLE_TERMS)} AS value FROM conversations")
def is_structured(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", T.is_structured(F.col("text"), B.LATIN_TABLE_TERMS).alias("value"))


@case("is_broad", f"SELECT {_KEY}, {S.any_of(S.strip('text'), _BROAD)} AS value FROM conversations")
def is_broad(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", T.is_broad(F.col("text"), _BROAD).alias("value"))


@case("guidance",
      f"SELECT {_KEY}, CASE WHEN {S.any_of(S.norm_query('text'), B.LATIN_TABLE_TERMS)} THEN 'table' WHEN {S.any_of(S.strip('text'), _BROAD)} "
      "THEN 'survey' ELSE 'direct' END AS value FROM conversations")
def guidance(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", T.answer_guidance(F.col("text"), B.LATIN_TABLE_TERMS, _BROAD).alias("value"))


def _pairs(spark, sf):
    """Each turn with the text of the turn before it."""
    t = _turns(spark, sf)
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    return t.join(before, ["conv_id", "turn"])


_PAIRS = "(SELECT t.conv_id, t.turn, t.text, b.text AS question FROM conversations t JOIN conversations b ON b.conv_id = t.conv_id AND b.turn = t.turn - 1)"
_NORM_PAIRS = f"(SELECT *, {S.nav('text')} AS t, {S.nav(S.norm_query('question'))} AS q FROM {_PAIRS})"
_TERM_PAIRS = (f"(SELECT *, {S.distinct('raw')} AS terms FROM (SELECT *, {S.terms_list('nq')} AS raw FROM "
               f"(SELECT *, {S.norm_query('question')} AS nq, {S.nav('text')} AS t, {S.nav(S.norm_query('question'))} AS q FROM {_PAIRS})))")


@case("ngram_coverage",
      f"SELECT {_KEY}, round({S.coverage('q', 't', 2)}, 6) AS c2, round({S.coverage('q', 't', 3)}, 6) AS c3 FROM {_NORM_PAIRS}")
def ngram_coverage(spark, sf):
    p = _pairs(spark, sf).withColumn("q", T.norm_nav(T.norm_query(F.col("question")))).withColumn("t", T.norm_nav(F.col("text")))
    return p.select("conv_id", "turn", F.round(T.ngram_coverage(F.col("q"), F.col("t"), 2), 6).alias("c2"),
                    F.round(T.ngram_coverage(F.col("q"), F.col("t"), 3), 6).alias("c3"))


@case("reason_terms",
      f"SELECT doc_id, {S.strip('split_part(text, chr(32) || chr(47), 1)')} AS term FROM documents "
      f"WHERE {S.strip('split_part(text, chr(32) || chr(47), 1)')} <> ''")
def reason_terms(spark, sf):
    reason = F.concat(F.lit("目次: "), F.col("text"), F.lit(" / 資料"))
    return B.table(spark, sf, "documents").select("doc_id", F.explode(T.reason_terms(reason)).alias("term"))


@case("chunk_relevance",
      f"SELECT {_KEY}, round({S.relevance('t', 'q', 'list_transform(terms, lambda w: ' + S.nav('w') + ')', '1.1', 'CASE WHEN turn = 1 THEN 5.0 ELSE 0.0 END')}, 6) AS score "
      f"FROM {_TERM_PAIRS}")
def chunk_relevance(spark, sf):
    p = (_pairs(spark, sf).withColumn("q", T.norm_nav(T.norm_query(F.col("question")))).withColumn("t", T.norm_nav(F.col("text")))
         .withColumn("terms", F.transform(T.query_terms(F.col("question")), T.norm_nav)))
    score = T.chunk_relevance(F.col("t"), F.col("q"), F.col("terms"), F.lit(1.1), F.col("turn") - 1, F.lit(True))
    return p.select("conv_id", "turn", F.round(score, 6).alias("score"))


@case("excerpt",
      f"SELECT {_KEY}, {S.excerpt('s', 'list_prepend(nq, terms)')} AS value FROM (SELECT *, {S.squeeze('text')} AS s FROM {_TERM_PAIRS})")
def excerpt(spark, sf):
    q = F.col("question")
    terms = F.concat(F.array(T.norm_query(q)), T.query_terms(q))
    return _pairs(spark, sf).withColumn("terms", terms).select("conv_id", "turn", T.excerpt(F.col("text"), F.col("terms")).alias("value"))


@case("structured_excerpt",
      f"SELECT {_KEY}, {S.structured_excerpt('s', 'list_prepend(nq, terms)', 300)} AS value FROM (SELECT *, {S.strip('text')} AS s FROM {_TERM_PAIRS})")
def structured_excerpt(spark, sf):
    q = F.col("question")
    terms = F.concat(F.array(T.norm_query(q)), T.query_terms(q))
    return _pairs(spark, sf).withColumn("terms", terms).select(
        "conv_id", "turn", T.structured_excerpt(F.col("text"), F.col("terms"), 300).alias("value"))


@case("citation_markers",
      "SELECT doc_id, md5(text || '[C' || n_chars || '][C' || n_chars % 7 || '] [C' || n_chars || ']') AS digest, "
      "CASE WHEN n_chars = n_chars % 7 THEN CAST(n_chars AS VARCHAR) ELSE n_chars || ',' || n_chars % 7 END AS ids FROM documents")
def citation_markers(spark, sf):
    d = B.table(spark, sf, "documents")
    n, m = F.col("n_chars").cast("string"), (F.col("n_chars") % 7).cast("string")
    raw = F.concat("text", F.lit("[CITATION:C"), n, F.lit("]［Ｃ"), m, F.lit("］ [c"), n, F.lit("]"))
    clean = T.citation_markers(raw)
    return d.select("doc_id", F.md5(clean).alias("digest"), F.array_join(T.citation_ids(clean).cast("array<string>"), ",").alias("ids"))


@case("content_hash", "SELECT doc_id, sha256(text) AS value FROM documents")
def content_hash(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("value"))


@case("auto_title",
      f"SELECT {_KEY}, substring({S.squeeze('text')}, 1, 40) || (CASE WHEN length({S.squeeze('text')}) > 40 THEN '…' ELSE '' END) AS value FROM conversations")
def auto_title(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", T.auto_title(F.col("text")).alias("value"))


@case("page_label", "SELECT doc_id, CASE WHEN n_chars > 500 THEN n_chars || '頁' ELSE 'ページ指定なし' END AS value FROM documents")
def page_label(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", T.page_label(F.when(F.col("n_chars") > 500, F.col("n_chars"))).alias("value"))


@case("source_title", "SELECT doc_id, CASE WHEN source = 'src1' AND lang = 'en' THEN 'First source' ELSE source || ' ' || lang END AS value FROM documents")
def source_title(spark, sf):
    key = F.concat_ws("_", "source", "lang")
    return B.table(spark, sf, "documents").select("doc_id", T.source_title(key, {"src1_en": "First source"}).alias("value"))
