"""Cases for corrections. Layout rows are lines of the documents: a page number on every third
line, then location, wrong and right text cut from the line, with edit marks by line length."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import corrections as K
from marginalia.operators.ranking import positions_in
from marginalia.plans import bindings as B
from marginalia.plans import sqltext as S
from marginalia.plans.bindings import sql
from marginalia.plans.registry import case, typed

_MARKS = ("を削除", "※追記", "", "※注", "", "")


def _cells(spark, sf):
    """One row per line with its cells."""
    lines = B.pages(spark, sf).select(F.col("book").alias("doc"), "pdf_page", F.posexplode(F.split("text", "\n")).alias("line", "txt"))
    n = F.length("txt")
    rest = F.regexp_extract("txt", "^[^ ]*(.*)$", 1)
    half = F.floor(F.length(rest) / 2).cast("int")
    mark = F.element_at(F.array(*[F.lit(m) for m in _MARKS]), (n % 6 + 1).cast("int"))
    return lines.select(
        "doc", "pdf_page", "line", n.alias("n"), F.when(F.col("line") % 3 == F.col("pdf_page") % 2, (n % 300 + 1).cast("string")).alias("page"),
        F.regexp_extract("txt", "^([^ ]*)", 1).alias("location"), F.concat(F.substring(rest, F.lit(1), half), mark).alias("before"),
        F.when(n % 6 > 1, F.substring(rest, half + 1, F.length(rest))).alias("after"))


def layout(spark, sf):
    c = _cells(spark, sf)
    item = lambda name, x, w: F.struct(F.col(name).alias("text"), F.lit(float(x)).alias("x_min"), F.lit(float(x + w)).alias("x_max"))
    extra = F.when(F.col("n") % 7 == 0, F.struct(F.lit("列").alias("text"), F.lit(360.0).alias("x_min"), F.lit(380.0).alias("x_max")))
    items = F.array_compact(F.array(item("page", 50, 20), item("location", 150, 60), item("before", 300, 40), extra, item("after", 450, 60)))
    return c.select("doc", "pdf_page", (F.lit(120.0) + F.col("line") * 12.0).alias("y_min"), F.explode(items).alias("i")).where("i.text is not null").select(
        "doc", "pdf_page", F.lit(595.32).alias("page_width"), F.lit("layout").alias("extract_method"), "i.text", "i.x_min", "i.x_max", "y_min")


B.CTES["cells"] = (
    ("bpages",),
    "SELECT book AS doc, pdf_page, line, length(txt) AS n, CASE WHEN line % 3 = pdf_page % 2 THEN CAST(length(txt) % 300 + 1 AS VARCHAR) END AS page, regexp_extract(txt, '^([^ ]*)', 1) AS location, "
    "substring(rest, 1, length(rest) // 2) || ['を削除', '※追記', '', '※注', '', ''][length(txt) % 6 + 1] AS before, CASE WHEN length(txt) % 6 > 1 THEN substring(rest, length(rest) // 2 + 1) END AS after "
    "FROM (SELECT *, regexp_extract(txt, '^[^ ]*(.*)$', 1) AS rest FROM (SELECT book, pdf_page, i - 1 AS line, l[i] AS txt FROM (SELECT book, pdf_page, l, unnest(generate_series(1, len(l))) AS i FROM "
    "(SELECT book, pdf_page, string_split(text, chr(10)) AS l FROM bpages))))")
B.CTES["items_"] = (
    ("cells",),
    " UNION ALL ".join(
        f"SELECT doc, pdf_page, line, n, {t} AS text, {x}.0 AS x_min, {x + w}.0 AS x_max, {r} AS rk, '{c}' AS col FROM cells WHERE trim(coalesce({t}, '')) <> ''{extra}"
        for t, x, w, r, c, extra in (("page", 50, 20, 0, "page", ""), ("location", 150, 60, 1, "location", ""), ("before", 300, 40, 2, "before", ""),
                                     ("'列'", 360, 20, 3, "before", " AND n % 7 = 0"), ("after", 450, 60, 4, "after", ""))))
# Records: rows from one page number to the next on a page.
B.CTES["recs"] = (
    ("items_",),
    "WITH r AS (SELECT *, count(*) FILTER (col = 'page') OVER (PARTITION BY doc, pdf_page ORDER BY line) AS record FROM items_) "
    "SELECT doc, pdf_page, record, max(CASE WHEN col = 'page' THEN CAST(text AS BIGINT) END) AS target_page, "
    + ", ".join(f"nullif(trim(coalesce(string_agg(trim(text), '' ORDER BY line, rk) FILTER (col = '{c}'), '')), '') AS {c}" for c in ("location", "before", "after"))
    + ", bool_or(n % 7 = 0 AND rk = 3 AND EXISTS (SELECT 1 FROM items_ j WHERE j.doc = r.doc AND j.pdf_page = r.pdf_page AND j.line = r.line AND j.rk = 2)) AS internal_table_detected FROM r WHERE record > 0 GROUP BY 1, 2, 3")


@case("classify_source", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'ERRATA' WHEN lang = 'de' THEN 'FAQ' WHEN lang = 'fr' THEN 'ADDITIONAL_DATA' ELSE 'OTHER' END AS kind, source || CASE WHEN lang = 'es' THEN '_x' ELSE '' END AS key FROM documents")
def classify_source(spark, sf):
    tail = F.when(F.col("lang") == "en", "_eratta.pdf").when(F.col("lang") == "de", "_FAQ.pdf").when(F.col("lang") == "fr", "_additional_20data.pdf").otherwise("_x.pdf")
    name = F.concat("source", tail)
    return B.table(spark, sf, "documents").select("doc_id", K.classify_source(name).alias("kind"), K.source_key(name).alias("key"))


@case("source_key_filters", "SELECT source AS key, count(*) AS n FROM documents WHERE lang = 'en' AND source NOT LIKE '%3' GROUP BY 1")
def source_key_filters(spark, sf):
    d = B.table(spark, sf, "documents").withColumn("name", F.concat("source", F.when(F.col("lang") == "en", "_eratta.pdf").otherwise("_faq.pdf")))
    excluded = d.where(F.col("source").endswith("3")).select(F.col("source").alias("key")).distinct()
    return K.errata_sources(d, "name", excluded).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@case("source_key_only", "SELECT source AS key, count(*) AS n FROM documents WHERE lang = 'en' AND source NOT LIKE '%3' AND source LIKE '%1' GROUP BY 1")
def source_key_only(spark, sf):
    d = B.table(spark, sf, "documents").withColumn("name", F.concat("source", F.when(F.col("lang") == "en", "_eratta.pdf").otherwise("_faq.pdf")))
    ends = lambda x: d.where(F.col("source").endswith(x)).select(F.col("source").alias("key")).distinct()
    return K.errata_sources(d, "name", ends("3"), ends("1")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@case("column_by_x", sql("SELECT col AS \"column\", count(*) AS n FROM items_ GROUP BY 1", "items_"))
def column_by_x(spark, sf):
    items = layout(spark, sf).where(F.length(F.trim("text")) > 0)
    return items.groupBy(K.column_by_x(F.col("x_min"), F.col("page_width")).alias("column")).agg(F.count(F.lit(1)).alias("n"))


@case("drop_header_footer", sql("SELECT doc, pdf_page, count(*) AS n FROM items_ WHERE line > 0 GROUP BY 1, 2", "items_"))
def drop_header_footer(spark, sf):
    # shifted up so that the first line of a page falls into the title area
    items = layout(spark, sf).withColumn("y_min", F.col("y_min") - 25.0)
    return items.where(~K.is_header(F.col("text"), F.col("y_min"), F.col("page_width"))).groupBy("doc", "pdf_page").agg(F.count(F.lit(1)).alias("n"))


@case("target_page", sql("SELECT doc, pdf_page, line, CAST(page AS BIGINT) AS target, n % 2 = 0 AS starred FROM cells WHERE page IS NOT NULL", "cells"))
def target_page(spark, sf):
    c = _cells(spark, sf).where(F.col("page").isNotNull()).withColumn("mark", F.concat(F.when(F.col("n") % 2 == 0, "★ ").otherwise(" "), "page"))
    return typed(c.select("doc", "pdf_page", "line", K.page_token(F.col("mark")).cast("bigint").alias("target"), K.starred(F.col("mark")).alias("starred")))


@case("cell_text", f"SELECT doc_id, md5({S.strip('text')}) AS digest FROM documents")
def cell_text(spark, sf):
    wide = F.concat(F.lit("　"), "text", F.lit("  "))
    return B.table(spark, sf, "documents").select("doc_id", F.md5(K.cell(wide)).alias("digest"))


@case("truncation_flag", sql("SELECT doc, pdf_page, line, length(trim(t)) >= 2 AND (ends_with(trim(t), 'の') OR n % 4 = 1) AS flag FROM (SELECT *, location || CASE n % 4 WHEN 0 THEN 'の' WHEN 1 THEN '「a' WHEN 2 THEN '「a」' ELSE '' END AS t FROM cells)", "cells"))
def truncation_flag(spark, sf):
    tail = F.when(F.col("n") % 4 == 0, "の").when(F.col("n") % 4 == 1, "「a").when(F.col("n") % 4 == 2, "「a」").otherwise("")
    return typed(_cells(spark, sf).select("doc", "pdf_page", "line", K.truncated(F.concat("location", tail)).alias("flag")))


@case("split_notes", sql("SELECT doc, pdf_page, line, CASE WHEN instr(t, '※') > 1 THEN nullif(trim(split_part(t, '※', 1)), '') ELSE nullif(t, '') END AS main, CASE WHEN instr(t, '※') > 1 THEN substring(t, instr(t, '※')) END AS note "
      "FROM (SELECT doc, pdf_page, line, trim(before) AS t FROM cells)", "cells"))
def split_notes(spark, sf):
    c = _cells(spark, sf).withColumn("_s", K.split_note(F.col("before")))
    return typed(c.select("doc", "pdf_page", "line", F.nullif("_s.main", F.lit("")).alias("main"), "_s.note"))


@case("y_band_rows", sql("SELECT doc, pdf_page, dense_rank() OVER (PARTITION BY doc, pdf_page ORDER BY line) - 1 AS band, text, CAST(x_min AS DOUBLE) AS x_min FROM items_", "items_"))
def y_band_rows(spark, sf):
    items = layout(spark, sf).where(F.length(F.trim("text")) > 0).withColumn("y_min", F.col("y_min") + F.col("x_min") / 500.0)
    return K.y_bands(items).select("doc", "pdf_page", "band", "text", "x_min")


@case("carry_forward_records", sql("SELECT doc, pdf_page, record, target_page, location, before, after FROM recs", "recs"))
def carry_forward_records(spark, sf):
    return typed(K.carry_forward(K.banded_items(layout(spark, sf))).select("doc", "pdf_page", "record", "target_page", "location", "before", "after"))


@case("internal_table_flag", sql("SELECT doc, pdf_page, record, coalesce(internal_table_detected, false) AS internal_table_detected FROM recs WHERE location IS NOT NULL OR before IS NOT NULL OR after IS NOT NULL", "recs"))
def internal_table_flag(spark, sf):
    return typed(K.internal_table(K.banded_items(layout(spark, sf))).where("record > 0"))


@case("record_numbering", sql("SELECT doc, pdf_page, record, row_number() OVER (PARTITION BY doc ORDER BY pdf_page, record) AS record_index FROM recs", "recs"))
def record_numbering(spark, sf):
    r = K.carry_forward(K.banded_items(layout(spark, sf))).select("doc", "pdf_page", "record")
    return typed(positions_in(r, ["doc"], ["pdf_page"], ["record"], "record_index"))


# The ordered rules on the marks that the driver's lines carry (を削除, ※追記, ※注).
B.CTES["classed"] = (
    ("recs",),
    "SELECT doc, pdf_page, record, before, CASE WHEN rule = 'kept' THEN 'complex' ELSE rule END AS operation, after, internal_table_detected, "
    "CASE WHEN rule = 'append' THEN added END AS append_text, CASE WHEN rule = 'append' THEN instr END AS append_instruction, "
    "CASE WHEN rule = 'delete' THEN nullif(CASE WHEN contains(suffix, '※') OR suffix = '' THEN trim(regexp_replace(prefix, '^※+', '')) ELSE suffix END, '') END AS delete_text, "
    "CASE WHEN rule = 'delete' THEN 'を削除' END AS delete_instruction, CASE WHEN rule = 'delete' AND contains(suffix, '※') THEN substring(suffix, instr(suffix, '※')) END AS note FROM ("
    "SELECT *, CASE WHEN internal_table_detected THEN 'kept' WHEN before IS NOT NULL AND after IS NOT NULL THEN 'replace' WHEN contains(b, 'を削除') THEN 'delete' "
    "WHEN contains(b, '※追記') AND t0 <> '' AND added <> '' THEN 'append' ELSE 'kept' END AS rule FROM (SELECT *, trim(regexp_replace(t0, '^[。．.、 ]+', '')) AS added FROM (SELECT *, coalesce(before, '') AS b, "
    "trim(split_part(coalesce(before, ''), 'を削除', 1)) AS prefix, trim(substring(coalesce(before, ''), instr(coalesce(before, ''), 'を削除') + 3)) AS suffix, "
    "trim(split_part(coalesce(before, ''), '※追記', 1) || '※追記') AS instr, trim(substring(coalesce(before, ''), instr(coalesce(before, ''), '※追記') + 3)) AS t0 FROM recs)))")
B.CTES["rated"] = (
    ("classed", "items_", "cells"),
    "WITH w AS (SELECT *, list_filter([CASE WHEN before IS NULL OR after IS NULL THEN 'MISSING_BEFORE_OR_AFTER' END, CASE WHEN contains(coalesce(before, ''), '※追記') OR contains(coalesce(after, ''), '※追記') THEN 'APPEND_INSTRUCTION_PATTERN' END, "
    "CASE WHEN internal_table_detected THEN 'INTERNAL_TABLE_PATTERN' END], lambda v: v IS NOT NULL) AS why FROM classed), "
    "e AS (SELECT *, CASE WHEN operation = 'append' THEN list_filter(why, lambda v: v NOT IN ('MISSING_BEFORE_OR_AFTER', 'APPEND_INSTRUCTION_PATTERN')) WHEN operation = 'delete' AND delete_text IS NOT NULL THEN list_filter(why, lambda v: v <> 'MISSING_BEFORE_OR_AFTER') ELSE why END AS l FROM w), "
    "q AS (SELECT *, CASE WHEN operation = 'complex' AND len(l) = 0 THEN ['COMPLEX_OPERATION'] ELSE l END AS reasons FROM e) "
    "SELECT doc, pdf_page, record AS o, false AS rescued, CASE WHEN operation = 'complex' OR len(reasons) > 0 THEN 'complex' ELSE operation END AS operation, "
    "CASE WHEN operation = 'complex' OR len(reasons) > 0 THEN 'LAYOUT_COMPLEX' ELSE 'LAYOUT_PARSED' END AS parse_status, array_to_string(reasons, ',') AS reasons FROM q UNION ALL "
    "SELECT doc, pdf_page, line, true, 'replace', 'LAYOUT_PARSED', '' FROM (SELECT doc, pdf_page, line, list_transform(string_split(string_agg(trim(text), ' | ' ORDER BY rk), '|'), lambda p: trim(p)) AS p FROM items_ i "
    "WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.doc = i.doc AND c.pdf_page = i.pdf_page AND c.line <= i.line AND c.page IS NOT NULL) GROUP BY doc, pdf_page, line) WHERE len(p) IN (3, 4) AND NOT list_contains(p, '') AND p[-1] <> p[-2]")


@case("errata_classify", sql("SELECT doc, pdf_page, record, operation, after, append_text, append_instruction, delete_text, delete_instruction, note FROM classed", "classed"))
def errata_classify(spark, sf):
    banded = K.banded_items(layout(spark, sf))
    base = K.carry_forward(banded).join(K.internal_table(banded), ["doc", "pdf_page", "record"], "left").withColumn(
        "internal_table_detected", F.coalesce("internal_table_detected", F.lit(False)))
    return typed(K.classify(base).select("doc", "pdf_page", "record", "operation", "after", "append_text", "append_instruction", "delete_text", "delete_instruction", "note"))


@case("errata_rescue", sql(
    "SELECT doc, pdf_page, array_to_string(p[1:-3], ' ') AS location, p[-2] AS before, p[-1] AS after FROM (SELECT doc, pdf_page, list_transform(string_split(concat_ws(' | ', location, before, after), '|'), lambda v: trim(v)) AS p FROM cells) "
    "WHERE len(p) IN (3, 4) AND NOT list_contains(p, '') AND p[-1] <> p[-2]", "cells"))
def errata_rescue(spark, sf):
    d = _cells(spark, sf).select("doc", "pdf_page", F.col("line").alias("band"), F.lit("UNASSIGNED_ROW").alias("type"), F.concat_ws(" | ", "location", "before", "after").alias("text"))
    return K.rescue(d).select("doc", "pdf_page", "location", "before", "after")


def records(spark, sf):
    return K.errata_records(layout(spark, sf))


@case("errata_quality", sql("SELECT parse_status, operation, reasons, count(*) AS n FROM rated GROUP BY ALL", "rated"))
def errata_quality(spark, sf):
    return records(spark, sf)[0].groupBy("parse_status", "operation", F.array_join("quality_reasons", ",").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


# Every record with its number; rows above the first page number of a page that are not rescued stay diagnostics.
B.CTES["numbered"] = (("rated",), "SELECT *, row_number() OVER (PARTITION BY doc ORDER BY rescued, pdf_page, o) AS record_index FROM rated")
B.CTES["loose"] = (
    ("items_", "cells"),
    "SELECT *, coalesce(len(p) IN (3, 4) AND NOT list_contains(p, '') AND p[-1] <> p[-2], false) AS saved FROM (SELECT doc, pdf_page, line, list_transform(string_split(string_agg(trim(text), ' | ' ORDER BY rk), '|'), lambda p: trim(p)) AS p "
    "FROM items_ i WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.doc = i.doc AND c.pdf_page = i.pdf_page AND c.line <= i.line AND c.page IS NOT NULL) GROUP BY doc, pdf_page, line)")


@case("errata_records", sql("SELECT doc, record_index, pdf_page, operation, parse_status, reasons FROM numbered", "numbered"))
def errata_records(spark, sf):
    return typed(records(spark, sf)[0].select("doc", "record_index", "pdf_page", "operation", "parse_status", F.array_join("quality_reasons", ",").alias("reasons")))


@case("correction_eligibility", sql("SELECT doc, CASE WHEN parse_status <> 'LAYOUT_PARSED' THEN 'not_layout_parsed' END AS skip_reason, count(*) AS n FROM rated GROUP BY ALL", "rated"))
def correction_eligibility(spark, sf):
    return K.skip_reason(records(spark, sf)[0]).groupBy("doc", "skip_reason").agg(F.count(F.lit(1)).alias("n"))


_LINE = "'{}' || nullif({}, '') || '{}'"


@case("errata_chunk_text", sql(
    "WITH w AS (SELECT n.doc, n.record_index, n.operation, r.target_page, CASE WHEN n.rescued THEN array_to_string(l.p[1:-3], ' ') ELSE r.location END AS location, CASE WHEN n.rescued THEN l.p[-2] ELSE c.before END AS before, "
    "CASE WHEN n.rescued THEN l.p[-1] ELSE c.after END AS after, c.append_text, c.append_instruction, c.delete_text, c.delete_instruction, c.note FROM numbered n "
    "LEFT JOIN classed c ON c.doc = n.doc AND c.pdf_page = n.pdf_page AND c.record = n.o AND NOT n.rescued LEFT JOIN recs r ON r.doc = n.doc AND r.pdf_page = n.pdf_page AND r.record = n.o AND NOT n.rescued "
    "LEFT JOIN loose l ON l.doc = n.doc AND l.pdf_page = n.pdf_page AND l.line = n.o AND n.rescued WHERE n.parse_status = 'LAYOUT_PARSED') "
    "SELECT doc || ':errata:' || record_index AS chunk_id, operation, operation IN ('replace', 'delete') AS override_candidate, operation = 'append' AS supplement_candidate, concat_ws(chr(10), "
    "replace(doc, '_', ' ') || ' ' || coalesce(target_page || '頁', 'ページ指定なし') || CASE operation WHEN 'replace' THEN 'の公式エラッタ。' WHEN 'append' THEN 'の公式追加・追記。' ELSE 'の公式削除エラッタ。' END, "
    + _LINE.format("対象箇所は「", "location", "」。") + ", "
    + ", ".join(f"CASE WHEN operation = '{op}' THEN " + _LINE.format(h, c, t) + " END" for op, h, c, t in (
        ("replace", "訂正前は「", "before", "」。"), ("replace", "訂正後は「", "after", "」。"), ("append", "追記指示: ", "append_instruction", ""),
        ("append", "追記内容: ", "append_text", ""), ("delete", "削除指示: ", "delete_instruction", ""), ("delete", "削除対象: ", "delete_text", "")))
    + ", " + _LINE.format("注記: ", "note", "") + ") AS text FROM w", "numbered", "classed", "recs", "loose"))
def errata_chunk_text(spark, sf):
    return typed(K.correction_chunks(records(spark, sf)[0]).select("chunk_id", "operation", "override_candidate", "supplement_candidate", "text"))


@case("document_counts", sql(" UNION ALL ".join(f"SELECT doc, '{k}' AS kind, {v} AS name, count(*) AS n FROM rated GROUP BY ALL" for k, v in (("parse_status", "parse_status"), ("operation", "operation"), ("extract_method", "'layout'"))), "rated"))
def document_counts(spark, sf):
    return K.document_counts(records(spark, sf)[0])


@case("normalization_report", sql(
    "WITH r AS (SELECT doc, count(*) AS record_count, count(*) FILTER (parse_status = 'LAYOUT_PARSED') AS parsed_count, count(*) FILTER (parse_status = 'LAYOUT_COMPLEX') AS complex_count FROM rated GROUP BY doc), "
    "f AS (SELECT r.*, coalesce(n, 0) AS diagnostic_count, round(complex_count / record_count, 4) AS complex_ratio FROM r LEFT JOIN (SELECT doc, count(*) AS n FROM loose WHERE NOT saved GROUP BY doc) USING (doc)) "
    "SELECT *, row_number() OVER (ORDER BY complex_ratio DESC, complex_count DESC, doc) <= 10 AS review_ratio, row_number() OVER (ORDER BY diagnostic_count DESC, doc) <= 10 AS review_diagnostics FROM f", "rated", "loose"))
def normalization_report(spark, sf):
    return typed(K.normalization_report(*records(spark, sf)))


@case("normalization_totals", sql(
    "WITH k AS (SELECT doc, operation, parse_status, 'layout' AS method FROM rated), c AS (SELECT CASE WHEN grouping(doc) = 0 THEN 'doc' WHEN grouping(operation) = 0 THEN 'operation' WHEN grouping(method) = 0 THEN 'extract_method' ELSE 'total' END AS kind, "
    "coalesce(doc, operation, method, '') AS name, count(*) AS record_count, count(*) FILTER (parse_status = 'LAYOUT_PARSED') AS parsed_count, count(*) FILTER (parse_status = 'LAYOUT_COMPLEX') AS complex_count, CAST(0 AS BIGINT) AS fallback_count "
    "FROM k GROUP BY GROUPING SETS ((doc), (operation), (method), ())) SELECT c.*, CAST(coalesce(CASE kind WHEN 'doc' THEN n WHEN 'total' THEN (SELECT count(*) FROM loose WHERE NOT saved) END, 0) AS BIGINT) AS diagnostic_count, "
    "round(complex_count / record_count, 4) AS complex_ratio FROM c LEFT JOIN (SELECT doc AS name, count(*) AS n FROM loose WHERE NOT saved GROUP BY doc) USING (name)", "rated", "loose"))
def normalization_totals(spark, sf):
    return typed(K.normalization_totals(*records(spark, sf)))


@case("correction_totals", sql(
    "SELECT CASE WHEN grouping(doc) = 0 THEN 'source' WHEN grouping(operation) = 0 THEN 'operation' ELSE 'total' END AS kind, coalesce(doc, operation, '') AS name, count(*) AS chunk_count FROM rated "
    "WHERE parse_status = 'LAYOUT_PARSED' AND doc NOT LIKE '%9' GROUP BY GROUPING SETS ((doc), (operation), ())", "rated"))
def correction_totals(spark, sf):
    r = records(spark, sf)[0]
    return typed(K.chunk_totals(r, B.pages(spark, sf).where(F.col("book").endswith("9")).select(F.col("book").alias("doc")).distinct()))


@case("correction_manifest", sql(
    "SELECT doc, CASE WHEN doc LIKE '%9' THEN 'EXCLUDED' ELSE 'BUILT' END AS status, CAST(count(*) AS BIGINT) AS record_count, CAST(count(*) FILTER (parse_status = 'LAYOUT_PARSED' AND doc NOT LIKE '%9') AS BIGINT) AS chunk_count, "
    "CASE WHEN count(*) FILTER (parse_status <> 'LAYOUT_PARSED') > 0 THEN '{\"not_layout_parsed\":' || count(*) FILTER (parse_status <> 'LAYOUT_PARSED') || '}' ELSE '{}' END AS skipped_counts FROM rated GROUP BY doc", "rated"))
def correction_manifest(spark, sf):
    r = records(spark, sf)[0]
    return typed(K.correction_manifest(r, r.where(F.col("doc").endswith("9")).select("doc").distinct()))
